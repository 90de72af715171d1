"""Record checks, fallbacks, template texts and Markdown documents, one row per ticker or run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom import fixed_values as V
from ledgerloom.functions.texts import bullets, markdown_escaped, number_text, printf, sentence_count
from ledgerloom.operators.corpus import filled_template


def _outside(count: Column, bounds: tuple[int, int], what: str) -> Column:
    low, high = bounds
    wanted = f"exactly {low}" if low == high else f"between {low} and {high}"
    text = F.format_string(f"{what}: %d, wanted {wanted}", F.coalesce(count, F.lit(0)))
    return F.when(~F.coalesce(count.between(low, high), F.lit(False)), text)


def check_recommendations(answers: DataFrame) -> DataFrame:
    """Answers (recommendation, justification, key_factors) with ``violations``; an empty array is valid."""
    c = F.col
    known = F.coalesce(c("recommendation").isin(V.RECOMMENDATIONS), F.lit(False))
    problems = F.array(
        F.when(~known, F.concat(F.lit("unknown recommendation "), F.coalesce("recommendation", F.lit("None")))),
        _outside(sentence_count("justification"), V.SENTENCES, "sentences"),
        _outside(F.size("key_factors"), V.KEY_FACTORS, "key factors"),
    )
    return answers.withColumn("violations", F.array_compact(problems))


def check_research_answers(answers: DataFrame) -> DataFrame:
    """Answers (summary, risks ARRAY of (title, explanation, evidence), legs, strategy) with ``violations``."""
    c = F.col
    bad_risks = F.filter("risks", lambda r: ~F.size(r["evidence"]).between(*V.EVIDENCE))
    problems = F.array(
        _outside(sentence_count("summary"), V.SENTENCES, "sentences"),
        _outside(F.size("risks"), V.RISKS, "risks"),
        F.when(
            F.size(bad_risks) > 0,
            F.concat(F.lit("evidence count outside 1-3 for: "), F.array_join(F.transform(bad_risks, lambda r: r["title"]), ", ")),
        ),
        _outside(F.size("legs"), V.LEGS, "legs"),
        F.when(~F.coalesce(c("strategy").isin(V.STRATEGIES), F.lit(False)), "unknown strategy"),
    )
    return answers.withColumn("violations", F.array_compact(problems))


def range_violations(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows with ``violations`` naming every present value outside its inclusive range."""
    checks = [F.when(~F.col(n).between(low, high), F.lit(f"{n} outside {low:g}..{high:g}")) for n, (low, high) in ranges.items()]
    return df.withColumn("violations", F.array_compact(F.array(*checks)))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their violations)."""
    valid = F.size("violations") == 0
    return checked.where(valid).drop("violations"), checked.where(~valid)


def with_placeholder(tickers: DataFrame, answers: DataFrame) -> DataFrame:
    """Each ticker's valid recommendation, else the fixed Hold with ``ok`` false."""
    valid, _ = split_valid(check_recommendations(answers))
    joined = tickers.select("ticker").distinct().join(valid, "ticker", "left")
    return joined.select(
        "ticker",
        F.coalesce("recommendation", F.lit("Hold")).alias("recommendation"),
        F.coalesce("justification", F.lit(V.PLACEHOLDER_JUSTIFICATION)).alias("justification"),
        F.coalesce("key_factors", F.array(*[F.lit(x) for x in V.PLACEHOLDER_FACTORS])).alias("key_factors"),
        F.col("recommendation").isNotNull().alias("ok"),
    )


# --- template texts -----------------------------------------------------------------


def _signed(pct: Column) -> Column:
    return F.when(pct.isNull(), "an unknown distance").otherwise(printf("%+.1f%%", pct))


def figures(tickers: DataFrame, snapshot: DataFrame, volatility: DataFrame, sentiment: DataFrame) -> DataFrame:
    """The latest price, volatility and sentiment structs per ticker, NULL where there is none."""

    def as_struct(df: DataFrame, name: str) -> DataFrame:
        return df.select("ticker", F.struct(*[c for c in df.columns if c != "ticker"]).alias(name))

    return (
        tickers.select("ticker").distinct()
        .join(as_struct(snapshot, "price"), "ticker", "left")
        .join(as_struct(volatility, "volatility"), "ticker", "left")
        .join(as_struct(sentiment, "sentiment"), "ticker", "left")
    )


def template_observations(found: DataFrame) -> DataFrame:
    """(ticker, observations): three plain sentences quoting the figures."""
    p, v, s = F.col("price"), F.col("volatility"), F.col("sentiment")
    trend = F.when(
        p.isNotNull(),
        printf(
            "The close of %.2f is %s from the 200-day average and %s from the 50-day average.",
            p["close"], _signed(p["close_vs_sma_200_pct"]), _signed(p["close_vs_sma_50_pct"]),
        ),
    ).otherwise("No price data was available, so the trend is unknown.")
    vol = F.when(
        v.isNotNull(),
        printf(
            "%d-day volatility is %.1f%%, at the %.0fth percentile of the past year.", v["window"], v["current_pct"], v["percentile_1y"]
        ),
    ).otherwise("No volatility figure was available.")
    news = F.when(
        s["score"].isNotNull(),
        printf("The Sentiment score of the given headlines is %+.2f (%s).", s["score"], s["label"]),
    ).otherwise("No headline sentiment was available.")
    return found.select("ticker", F.array(trend, vol, news).alias("observations"))


def template_reports(found: DataFrame, levels: DataFrame) -> DataFrame:
    """A plain report per ticker from the figures alone: summary, three risks with evidence, one hedge."""
    p, v, s = F.col("price"), F.col("volatility"), F.col("sentiment")
    to_200 = _signed(p["close_vs_sma_200_pct"])
    trend = F.when(
        p.isNotNull(),
        printf(
            "The price closed at %.2f on %s, %s from its 200-day average and %s from its 50-day average.",
            p["close"], p["as_of"].cast("string"), to_200, _signed(p["close_vs_sma_50_pct"]),
        ),
    ).otherwise("Price data was unavailable, so the trend could not be assessed.")
    trend_fact = F.when(p.isNotNull(), F.format_string("Close %s vs the 200-day average", to_200)).otherwise("No price data was returned")
    vol = F.when(
        v.isNotNull(),
        printf(
            "Annualised %d-day volatility is %.1f%%, at the %.0fth percentile of the past year.",
            v["window"], v["current_pct"], v["percentile_1y"],
        ),
    ).otherwise("Volatility was unavailable.")
    vol_fact = F.when(
        v.isNotNull(), printf("Volatility %.1f%%, percentile %.0f", v["current_pct"], v["percentile_1y"])
    ).otherwise("No volatility result was returned")
    scored = s["score"].isNotNull()
    news = F.when(
        scored, printf("The Sentiment score of recent headlines is %+.2f (%s).", s["score"], s["label"])
    ).otherwise("Headline sentiment was unavailable.")
    news_fact = F.when(
        scored, printf("Sentiment score %+.2f over %d headlines", s["score"], s["scored"])
    ).otherwise("No sentiment result was returned")

    def risk(title: str, fact: Column, tool: str) -> Column:
        evidence = F.array(F.struct(fact.alias("fact"), F.lit(tool).alias("source_tool")))
        return F.struct(F.lit(title).alias("title"), F.lit(V.RISK_TEXTS[title]).alias("explanation"), evidence.alias("evidence"))

    risks = F.array(
        risk("Trend reversal", trend_fact, "get_price_data"),
        risk("Volatility", vol_fact, "calculate_volatility"),
        risk("News sentiment", news_fact, "llm_sentiment"),
    )
    put = F.col("expected_move").isNotNull()
    leg = F.struct(
        F.when(put, "buy").otherwise("sell").alias("action"),
        F.when(put, "put").otherwise("shares").alias("instrument"),
        F.when(put, "one_sd_low").alias("level_name"),
    )
    level_columns = ["price", "volatility_pct", "volatility_source", "horizon_trading_days", "expected_move", "expected_move_pct", "candidates"]
    named = levels.select("ticker", "expected_move", F.struct(*level_columns).alias("levels"))
    return found.join(named, "ticker", "left").select(
        "ticker",
        F.concat_ws(" ", trend, vol, news).alias("summary"),
        risks.alias("risks"),
        F.when(put, "protective_put").otherwise("trim_and_stop").alias("strategy"),
        F.array(leg).alias("legs"),
        F.when(put, V.PUT_RATIONALE).otherwise(V.TRIM_RATIONALE).alias("rationale"),
        "levels",
        p.isNotNull().alias("has_prices"),
    )


def choose_reports(templates: DataFrame, answers: DataFrame) -> DataFrame:
    """The model's valid answer where prices came back, else the template, marked in ``generated_by``.

    ``answers`` holds (ticker, summary, risks, strategy, legs, rationale).
    """
    valid, _ = split_valid(check_research_answers(answers))
    fields = ["summary", "risks", "strategy", "legs", "rationale"]
    renamed = valid.select("ticker", *[F.col(f).alias(f"a_{f}") for f in fields])
    joined = templates.join(renamed, "ticker", "left")
    by_model = F.col("has_prices") & F.col("a_summary").isNotNull()
    return joined.select(
        "ticker",
        *[F.when(by_model, F.col(f"a_{f}")).otherwise(F.col(f)).alias(f) for f in fields],
        "levels",
        F.when(by_model, "llm").otherwise("template").alias("generated_by"),
        F.array_compact(
            F.array(
                F.when(~F.col("has_prices"), V.NO_PRICE_DATA).when(
                    ~by_model, "no LLM is available for the report, so it was written from a template"
                )
            )
        ).alias("warnings"),
    )


def report_markdown(reports: DataFrame, as_of: Column) -> DataFrame:
    """(ticker, markdown) of checked reports: risks with sources, hedge legs with levels, the expected move."""
    c = F.col
    because = F.coalesce(F.try_element_at("warnings", F.lit(1)), F.lit(V.TEMPLATE_REASON))
    note = F.when(c("generated_by") == "template", F.concat(F.lit("> Not written by the LLM: "), because, F.lit(".\n\n"))).otherwise("")

    def risk_text(r: Column, i: Column) -> Column:
        facts = F.transform(r["evidence"], lambda e: F.concat(F.lit("\n   - "), e["fact"], F.lit(" _(source: "), e["source_tool"], F.lit(")_")))
        return F.concat((i + 1).cast("string"), F.lit(". **"), r["title"], F.lit("**: "), r["explanation"], F.array_join(facts, ""))

    def leg_text(leg: Column) -> Column:
        found = F.filter(c("levels.candidates"), lambda x: x["name"] == leg["level_name"])
        price = F.try_element_at(found, F.lit(1))["level"]
        where = F.when(price.isNotNull(), printf(" at %.2f (%s)", price, leg["level_name"])).otherwise("")
        return F.concat(F.lit("- "), leg["action"], F.lit(" "), F.replace(leg["instrument"], F.lit("_"), F.lit(" ")), where)

    lv = c("levels")
    move = F.when(
        lv.isNotNull(),
        printf(
            "Expected %d-trading-day move: ±%.2f (%.1f%%) from %.2f, using %.1f%% volatility (%s).\n",
            lv["horizon_trading_days"], lv["expected_move"], lv["expected_move_pct"], lv["price"], lv["volatility_pct"], lv["volatility_source"],
        ),
    ).otherwise("")
    text = F.concat(
        F.lit("# "), c("ticker"), F.lit(" research report ("), as_of.cast("string"), F.lit(")\n\n"), note,
        F.lit("## Financial Health Summary\n\n"), c("summary"),
        F.lit("\n\n## Top Three Risks\n\n"), F.array_join(F.transform("risks", risk_text), "\n"),
        F.lit("\n\n## Hedge Strategy Recommendation\n\n**"), F.initcap(F.replace("strategy", F.lit("_"), F.lit(" "))), F.lit("**\n\n"),
        F.array_join(F.transform("legs", leg_text), "\n"),
        F.lit("\n\n"), c("rationale"), F.lit("\n\n"), move,
        F.lit("\n_"), F.lit(V.PREMIUM_NOTE), F.lit("_"),
        F.when(F.coalesce("clarification", F.lit("")) != "", F.concat(F.lit("\n\n## What the clarification changed\n\n"), c("clarification"))).otherwise("")
        if "clarification" in reports.columns else F.lit(""),
        F.when(F.size("data_gaps") > 0, F.concat(F.lit("\n\n## Data gaps\n\n"), bullets("data_gaps"))).otherwise("")
        if "data_gaps" in reports.columns else F.lit(""),
    )
    return reports.select("ticker", text.alias("markdown"))


# --- the market brief -----------------------------------------------------------------


def sentiment_section(sentiment: DataFrame, top: DataFrame, tickers: DataFrame) -> DataFrame:
    """(ticker, section). ``top`` holds at most three rows per ticker with rank, title, publisher and published."""
    c = F.col
    publisher = F.coalesce(markdown_escaped("publisher"), F.lit("unknown publisher"))
    byline = F.when(
        c("published").isNotNull(), F.concat(F.lit(" ("), publisher, F.lit(", "), F.date_format("published", "yyyy-MM-dd"), F.lit(")"))
    ).otherwise("")
    line = F.concat(
        c("rank").cast("string"), F.lit(". **"), markdown_escaped("title"), F.lit("**"), byline, F.lit(": "), c("sentiment"),
        printf(", score %+.2f. ", c("score")), markdown_escaped(F.coalesce("brief_reason", F.lit(""))),
    )
    ordered = F.array_sort(F.collect_list(F.struct(c("rank"), line.alias("line"))))
    lines = top.groupBy("ticker").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("lines"))
    counts = c("counts")
    head = printf(
        "**Sentiment score: %+.2f (%s)** on a scale from -1 to +1, "
        f"the mean of %d headlines from the last {V.NEWS_MAX_AGE_DAYS} days: %d positive, %d negative, %d neutral.",
        c("score"), c("label"), c("scored"), counts["positive"], counts["negative"], counts["neutral"],
    )
    body = F.concat(head, F.lit(f"\n\nTop {V.TOP_HEADLINES} headlines by strength of sentiment:\n\n"), F.coalesce("lines", F.lit("")))
    joined = tickers.select("ticker").distinct().join(sentiment, "ticker", "left").join(lines, "ticker", "left")
    section = F.when(c("scored").isNull(), V.NO_HEADLINES).when(c("score").isNull(), V.NO_SCORED_HEADLINES).otherwise(body)
    return joined.select("ticker", section.alias("section"))


def market_briefs(
    summary: DataFrame, facts: DataFrame, sections: DataFrame, recommendations: DataFrame, sentiment: DataFrame,
    generated_at: Column, primary_name: str = "the primary scorer", writer: str = "the report model",
) -> DataFrame:
    """(ticker, markdown): the brief of every ticker from one-row-per-ticker inputs."""
    c = F.col
    counted = sentiment.select("ticker", "by_primary", "by_secondary", "failed")
    joined = (
        summary.join(facts, "ticker")
        .join(sections, "ticker", "left")
        .join(recommendations, "ticker", "left")
        .join(counted, "ticker", "left")
    )
    currency = F.when(c("currency").isNotNull(), F.concat(F.lit(" "), c("currency"))).otherwise("")

    def money(name: str) -> Column:
        return F.when(c(name).isNotNull(), F.concat(printf("%.2f", c(name)), currency)).otherwise(V.UNAVAILABLE)

    method = F.array(
        F.lit(
            "Indicators computed from first principles: SMA 50 and 200, RSI 14 (Wilder), "
            "MACD (12, 26, 9), Bollinger Bands (20, 2 standard deviations)."
        ),
        F.format_string(
            f"Headline sentiment labelled by {primary_name} for %d headlines and by the LLM for %d; %d could not be scored.",
            *[F.coalesce(n, F.lit(0)) for n in ("by_primary", "by_secondary", "failed")],
        ),
        F.concat(
            F.lit("Recommendation written by "), F.when(c("ok"), writer).otherwise("no model (placeholder)"),
            F.lit(", from the computed facts above and the Sentiment score."),
        ),
    )
    notes = F.transform("warnings", lambda w: markdown_escaped(w))
    values = {
        "company": markdown_escaped(F.coalesce("company_name", "ticker")),
        "ticker": c("ticker"),
        "generated_at": F.date_format(generated_at, "yyyy-MM-dd HH:mm 'UTC'"),
        "as_of": F.coalesce(c("as_of").cast("string"), F.lit(V.UNAVAILABLE)),
        "price": money("current_price"),
        "high_52w": money("high_52w"),
        "low_52w": money("low_52w"),
        "pe_ratio": number_text("pe_ratio", "%.1f"),
        "ytd": number_text("ytd_return_pct", "%+.1f%%"),
        "momentum": F.coalesce(F.format_string("%s (score %+d of ±5)", c("momentum.label"), c("momentum.score")), F.lit(V.UNAVAILABLE)),
        "chart": F.lit(V.NO_CHART),
        "technical_facts": bullets("facts"),
        "sentiment": F.coalesce("section", F.lit(V.NO_HEADLINES)),
        "recommendation": c("recommendation"),
        "horizon_days": F.lit(V.RECOMMENDATION_DAYS),
        "placeholder": F.when(c("ok"), "").otherwise(V.PLACEHOLDER_NOTE + "\n\n"),
        "justification": markdown_escaped("justification"),
        "key_factors": bullets(F.transform("key_factors", lambda k: markdown_escaped(k))),
        "method": bullets(method),
        "data_notes": F.when(F.size("warnings") > 0, F.concat(F.lit("\n## Data notes\n\n"), bullets(notes), F.lit("\n"))).otherwise(""),
        "disclaimer": F.lit(V.DISCLAIMER),
    }
    return joined.select("ticker", filled_template(V.BRIEF_TEMPLATE, values).alias("markdown"))


# --- handoff between agents -------------------------------------------------------------


def default_requests(requests: DataFrame) -> DataFrame:
    """Requests (run_id, needs, question, period, window, headlines, why) with the default where none is usable.

    No request, or one for sentiment without headlines, becomes the 63-day volatility
    request; a missing period or window gets its default.
    """
    c = F.col
    empty = F.coalesce(F.size("headlines"), F.lit(0)) <= 0
    gone = c("needs").isNull()
    bare = (c("needs") == "sentiment") & empty
    use_default = gone | F.coalesce(bare, F.lit(False))
    needs = F.when(use_default, "volatility").otherwise(c("needs"))
    return requests.select(
        "run_id",
        needs.alias("needs"),
        F.when(use_default, V.DEFAULT_REQUEST_QUESTION).otherwise(c("question")).alias("question"),
        F.when(needs == "price_data", F.coalesce(F.nullif(c("period"), F.lit("")), F.lit("1y"))).alias("period"),
        F.when(use_default, V.HORIZON_DAYS)
        .when(needs == "volatility", F.coalesce(F.nullif(c("window"), F.lit(0)), F.lit(V.HORIZON_DAYS))).alias("window"),
        F.when(needs == "sentiment", c("headlines")).alias("headlines"),
        F.when(use_default, V.DEFAULT_REQUEST_WHY).otherwise(c("why")).alias("why"),
        F.when(bare, "the request asked for sentiment without headlines, so the default request was sent instead")
        .when(gone, "no LLM for the clarification request, so the default request was sent").alias("warning"),
    )


def fulfil_requests(requests: DataFrame, answered: DataFrame, supplied: DataFrame) -> DataFrame:
    """Each request with the agent's own result if it has one, else the one supplied for it.

    ``answered`` and ``supplied`` are :func:`ledgerloom.operators.evidence.latest_ok`
    tables: at most one row per (run_id, tool).
    """
    tool = F.lit(None).cast("string")
    for need, name in V.NEED_TOOLS.items():
        tool = F.when(F.col("needs") == need, name).otherwise(tool)
    own = answered.select("run_id", "tool", F.col("data").alias("own"))
    other = supplied.select("run_id", "tool", F.col("data").alias("other"))
    joined = requests.withColumn("tool", tool).join(own, ["run_id", "tool"], "left").join(other, ["run_id", "tool"], "left")
    by_agent = F.col("own").isNotNull()
    status = F.when(F.col("other").isNotNull(), "ok").otherwise("empty")
    warnings = F.array(
        F.when(
            ~by_agent,
            F.format_string("Agent A did not fetch the requested %s, so the pipeline called %s for it (%s)", F.col("needs"), F.col("tool"), status),
        ),
        F.when(~by_agent & F.col("other").isNull(), F.format_string("the requested %s could not be fetched; the answer has no data", "needs")),
    )
    return joined.select(
        "run_id", "needs", "tool",
        F.coalesce("own", "other").alias("data"),
        F.when(by_agent, "agent").otherwise("pipeline").alias("fulfilled_by"),
        F.array_compact(warnings).alias("warnings"),
    )


def data_briefs(
    found: DataFrame, levels: DataFrame, observations: DataFrame, gaps: DataFrame, tools: DataFrame, headlines_given: DataFrame
) -> DataFrame:
    """One brief per ticker: figures, levels, template observations, gaps and usable tools side by side.

    Every input is one row per ticker, except ``gaps`` (at most one row per tool).
    """
    listed = gaps.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("tool_no", "gap"))).alias("g"))
    listed = listed.select("ticker", F.transform("g", lambda x: x["gap"]).alias("data_gaps"))
    hedge = levels.select("ticker", F.struct(*[c for c in levels.columns if c != "ticker"]).alias("hedge_levels"))
    none = F.array().cast("array<string>")
    return (
        found.join(hedge, "ticker", "left")
        .join(observations, "ticker", "left")
        .join(listed, "ticker", "left")
        .join(tools, "ticker", "left")
        .join(headlines_given, "ticker", "left")
        .select(
            "ticker",
            F.coalesce("headlines_given", F.lit(0)).alias("headlines_given"),
            "price", "volatility", "sentiment", "hedge_levels",
            F.col("observations").alias("key_observations"),
            F.coalesce("data_gaps", none).alias("data_gaps"),
            F.coalesce("tools", none).alias("tools_called"),
            F.lit("template").alias("generated_by"),
        )
    )
