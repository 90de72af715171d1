"""Report queries: record checks, fallbacks, templates, Markdown, handoff records, stored snapshots and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.texts import markdown_escaped, sentence_count
from ledgerloom.operators import evidence as E
from ledgerloom.operators import facts, hedge, indicators as I, news as N, reports as R, sentiment as S, summary
from ledgerloom.operators.run_results import checked_reports
from ledgerloom.plans import bindings as D
from ledgerloom.plans.market import market_brief
from ledgerloom.session import shared_dir
from ledgerloom.sources import jsonl, snapshots
from registered import market as MK
from registered import traces as TR


def _headlines(spark, d):
    """Headlines keyed by the line-item tickers: one per language."""
    h = D.headlines(spark, d)
    flag = F.when(F.col("ticker") == "en", "A").when(F.col("ticker") == "fr", "N").otherwise("R")
    return h.withColumn("ticker", flag).withColumnRenamed("pos", "ord")


def _scored(spark, d):
    return S.score_headlines(_headlines(spark, d), D.primary_decisions(spark, d), D.secondary_labels(spark, d), ["ord"])


def sentence_counts(spark, d):
    return D.table(spark, d, "documents").select("doc_id", sentence_count("text").alias("sentences"))


def _recommendations(spark, d):
    """Assistant turns as recommendation answers; role and length decide the other fields."""
    t = D.table(spark, d, "conversations")
    label = F.when(F.col("role") == "system", "Maybe").when(F.col("role") == "user", "Buy").otherwise("Sell")
    factors = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"), F.lit("e")), 1, F.length("text") % 5 + 1)
    return t.select("conv_id", "turn", label.alias("recommendation"), F.col("text").alias("justification"), factors.alias("key_factors"))


def checked_recommendations(spark, d):
    out = R.check_recommendations(_recommendations(spark, d))
    return out.select("conv_id", "turn", F.array_join("violations", "; ").alias("violations"))


def recommendation_fallback(spark, d):
    """Every turn is asked for a recommendation."""
    ticker = F.concat_ws("-", "conv_id", "turn").alias("ticker")
    answers = _recommendations(spark, d).select("*", ticker)
    tickers = D.table(spark, d, "conversations").select(ticker)
    out = R.with_placeholder(tickers, answers.select("ticker", "recommendation", "justification", "key_factors"))
    return out.select("ticker", "recommendation", "ok", F.size("key_factors").alias("factors"))


def checked_research_answers(spark, d):
    """Conversations as research answers: one risk per user turn, one leg per assistant turn."""
    t = D.table(spark, d, "conversations")
    risk = F.struct(F.col("turn").cast("string").alias("title"), F.lit("x").alias("explanation"), F.slice(F.array(F.lit("e"), F.lit("f"), F.lit("g"), F.lit("h")), 1, F.length("text") % 4 + 1).alias("evidence"))
    answers = t.groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("summary"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "user", risk))).alias("risks"),
        F.collect_list(F.when(F.col("role") == "assistant", F.col("turn"))).alias("legs"),
        F.when(F.max("turn") > 3, "collar").otherwise("unknown").alias("strategy"),
    )
    out = R.check_research_answers(answers)
    return out.select("conv_id", F.array_join("violations", "; ").alias("violations"))


def range_violations(spark, d):
    rows = D.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("confidence"), (F.col("l_quantity") / 25 - 1).alias("score"),
        (F.col("l_extendedprice") / 900).alias("percentile"),
    )
    out = R.range_violations(rows, {"confidence": (0, 0.08), "score": (-0.9, 0.9), "percentile": (0, 100)})
    return out.groupBy(F.array_join("violations", "; ").alias("violations")).agg(F.count(F.lit(1)).alias("rows"))


def _figures(spark, d, priced):
    tickers = D.flag_fundamentals(spark, d).select("ticker").unionByName(spark.range(1).select(F.lit("Z").alias("ticker")))
    return R.figures(tickers, MK._snapshot(priced), I.volatility_rank(priced, 63), S.summarise(_scored(spark, d), ["ticker"]))


def _levels(priced):
    return hedge.hedge_levels(MK._snapshot(priced), I.volatility_rank(priced, 63))


def _templates(spark, d, priced):
    return R.template_reports(_figures(spark, d, priced), _levels(priced))


def template_observations(spark, d):
    out = R.template_observations(_figures(spark, d, MK._priced(spark, d)))
    return out.select("ticker", F.posexplode("observations").alias("n", "observation"))


def template_reports(spark, d):
    out = _templates(spark, d, MK._priced(spark, d))
    return out.select(
        "ticker", "summary", "strategy", F.col("legs")[0]["instrument"].alias("instrument"),
        F.col("risks")[1]["evidence"][0]["fact"].alias("volatility_fact"), F.col("risks")[2]["evidence"][0]["fact"].alias("news_fact"),
    )


def _answers(spark, d):
    """Model answers for two of the tickers, one of them with too short a summary."""
    base = D.flag_fundamentals(spark, d).select("ticker")
    risk = lambda t: F.struct(F.lit(t).alias("title"), F.lit("It may matter.").alias("explanation"), F.array(F.struct(F.lit("a fact").alias("fact"), F.lit("get_price_data").alias("source_tool"))).alias("evidence"))
    text = F.when(F.col("ticker") == "A", "One. Two. Three.").otherwise("Too short.")
    return base.where("ticker <> 'R'").select(
        "ticker", text.alias("summary"), F.array(risk("x"), risk("y"), risk("z")).alias("risks"), F.lit("collar").alias("strategy"),
        F.array(F.struct(F.lit("buy").alias("action"), F.lit("put").alias("instrument"), F.lit("bb_lower").alias("level_name"))).alias("legs"),
        F.lit("Because.").alias("rationale"),
    )


def chosen_reports(spark, d):
    out = R.choose_reports(_templates(spark, d, MK._priced(spark, d)), _answers(spark, d))
    return out.select("ticker", "generated_by", "strategy", F.array_join("warnings", "; ").alias("warnings"))


def report_documents(spark, d):
    """Reports of all tickers, checked against what their tools returned."""
    priced = MK._priced(spark, d)
    chosen = R.choose_reports(_templates(spark, d, priced), _answers(spark, d))
    calls = _ticker_calls(spark, d).withColumnRenamed("run_id", "ticker")
    return R.report_markdown(checked_reports(chosen, calls, chosen.select("ticker", "levels"), "ticker"), D.last_date(priced))


def escaped_markdown(spark, d):
    return D.table(spark, d, "pages").select("page_id", markdown_escaped("html").alias("text"))


def sentiment_sections(spark, d):
    h = _headlines(spark, d)
    scored = _scored(spark, d)
    top = S.strongest(scored, ["ticker"], "ord")
    return R.sentiment_section(S.summarise(scored, ["ticker"]), top, h)


def sentiment_fact_lines(spark, d):
    return facts.sentiment_facts(S.summarise(_scored(spark, d), ["ticker"]))


def _advice(spark, d):
    """The turns of all conversations as one recommendation a ticker; that for N is too short to be valid."""
    ticker = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("conv_id") % 3 + 1).cast("int"))
    text = F.when(F.col("ticker") == "N", "Too short.").otherwise("One. Two. Three.")
    found = _recommendations(spark, d).groupBy(ticker.alias("ticker")).agg(F.max("recommendation").alias("_most"), F.min("recommendation").alias("_least"))
    return found.select("ticker", F.coalesce(F.nullif("_most", F.lit("Maybe")), "_least").alias("recommendation"), text.alias("justification"), F.array(F.lit("a"), F.lit("b")).alias("key_factors"))


def market_briefs(spark, d):
    """The whole market brief of every ticker, from ticks and documents to Markdown."""
    priced = MK._priced(spark, d)
    return market_brief(
        priced, summary.fundamentals(D.flag_fundamentals(spark, d)), _headlines(spark, d), D.primary_decisions(spark, d),
        D.secondary_labels(spark, d), ["ord"], _advice(spark, d),
        D.last_date(priced), F.lit("2024-02-01 00:00:00").cast("timestamp"),
    )


def default_requests(spark, d):
    c = F.col
    asked = D.table(spark, d, "customer").select(
        c("c_custkey").cast("string").alias("run_id"),
        F.when(c("c_mktsegment") == "HOUSEHOLD", "sentiment").when(c("c_mktsegment") == "MACHINERY", "volatility").when(c("c_mktsegment") == "BUILDING", "price_data").alias("needs"),
        F.lit("why?").alias("question"),
        F.when(c("c_nationkey") > 12, "3mo").alias("period"),
        F.when(c("c_nationkey") > 15, c("c_nationkey")).alias("window"),
        F.when(c("c_nationkey") < 10, F.array(F.lit("a headline"))).alias("headlines"),
        F.lit("because").alias("why"),
    )
    return R.default_requests(asked).select("run_id", "needs", "question", "period", "window", F.size("headlines").alias("given"), "why", "warning")


def fulfilled_requests(spark, d):
    obs = TR._observations(spark, d)
    runs = obs.select("run_id").distinct()
    need = F.when(F.col("run_id").cast("int") % 3 == 0, "price_data").when(F.col("run_id").cast("int") % 3 == 1, "volatility").otherwise("sentiment")
    out = R.fulfil_requests(
        runs.withColumn("needs", need), E.latest_ok(TR._quick_is_empty(obs, 80)), E.latest_ok(TR._quick_is_empty(obs, 50))
    )
    return out.select("run_id", "tool", "fulfilled_by", F.col("data").isNotNull().alias("has_data"), F.size("warnings").alias("warnings"))


def _ticker_calls(spark, d):
    """All tool calls, dealt to the tickers; those of up to 300 ms count as empty."""
    keyed = TR._observations(spark, d).withColumn("run_id", F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("seq") % 3 + 1).cast("int")))
    return TR._quick_is_empty(keyed, 300)


def data_briefs(spark, d):
    priced = MK._priced(spark, d)
    found = _figures(spark, d, priced)
    keyed = _ticker_calls(spark, d)
    gaps = E.data_gaps(keyed, keyed, ["get_price_data", "calculate_volatility", "llm_sentiment"]).withColumnRenamed("run_id", "ticker")
    tools = E.ok_tools(keyed).withColumnRenamed("run_id", "ticker")
    given = _headlines(spark, d).groupBy("ticker").agg(F.count(F.lit(1)).alias("headlines_given"))
    out = R.data_briefs(found, _levels(priced), R.template_observations(found), gaps, tools, given)
    return out.select(
        "ticker", "headlines_given", F.col("price.close").alias("close"), F.col("volatility.window").alias("window"),
        F.round("sentiment.score", 4).alias("score"), F.size("hedge_levels.candidates").alias("levels"),
        F.size("key_observations").alias("observations"), F.array_join("data_gaps", "; ").alias("data_gaps"), F.array_join("tools_called", ",").alias("tools"),
    )


# --- stored tables --------------------------------------------------------------------


def _runs(spark, d):
    c = F.col
    return D.table(spark, d, "orders").select(
        c("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("as_of"), c("o_orderkey"),
        F.when(c("o_orderstatus") == "O", 0).otherwise(1).alias("schema_version"),
        F.when(c("o_orderstatus") == "P", "template").otherwise("llm").alias("generated_by"),
        F.when(c("o_custkey") % 20 != 0, F.concat(F.lit("run "), c("o_orderkey").cast("string"))).alias("payload"),
    )


def _stored_runs(spark, d):
    """The last run of every (ticker, month start)."""
    runs = _runs(spark, d).withColumn("as_of", F.trunc("as_of", "quarter").cast("date"))
    return runs.groupBy("ticker", "as_of").agg(*[F.max_by(c, "o_orderkey").alias(c) for c in ("schema_version", "generated_by", "payload")])


def snapshot_actions(spark, d):
    return snapshots.save_actions(_stored_runs(spark, d))


def snapshot_lookup(spark, d):
    """Save snapshots to files, read them back, and look requests up in them."""
    path = shared_dir(spark, "snapshots")
    runs = _stored_runs(spark, d)
    snapshots.save_snapshots(runs, path)
    stored = snapshots.read_snapshots(spark, path, runs.schema)
    requests = runs.select(F.lower("ticker").alias("ticker"), "as_of", (F.month("as_of") == 1).alias("force_refresh"))
    return snapshots.lookup(requests, stored)


def snapshot_recompute(spark, d):
    runs = _stored_runs(spark, d)
    requests = runs.select("ticker", "as_of", (F.month("as_of") == 1).alias("force_refresh"))
    return snapshots.to_recompute(requests, runs.where("generated_by <> 'template'").withColumn("ticker", F.upper("ticker"))).select("ticker", "as_of")


def saved_reports(spark, d):
    """Reports written one folder per ticker and read back."""
    path = shared_dir(spark, "reports")
    docs = D.table(spark, d, "documents").groupBy(F.col("source").alias("ticker")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    text = F.format_string("# %s\n\n- documents: %d\n- first: %d", "ticker", "n", "first")
    snapshots.save_reports(docs.select("ticker", text.alias("markdown")), path)
    return spark.read.text(path).select("ticker", F.col("value").alias("line"))


def jsonl_round_trip(spark, d):
    """Documents written as JSON lines per split, one split appended to, and read back."""
    path = shared_dir(spark, "jsonl")
    docs = D.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang", F.col("source").alias("split"))
    jsonl.write_jsonl(docs.where("lang <> 'en'"), path, ["split"])
    jsonl.write_jsonl(docs.where("lang = 'en'"), path, ["split"], append=True)
    schema = docs.select("id", "lang", "split").schema
    return jsonl.read_jsonl(spark, path, schema).groupBy("split", "lang").agg(F.count(F.lit(1)).alias("rows"))


W = TR.W
HEADS = """hd AS (SELECT CASE lang WHEN 'en' THEN 'A' WHEN 'fr' THEN 'N' ELSE 'R' END AS ticker, doc_id AS pos, text AS title, source AS publisher,
    make_timestamp((1704067200 + (n_chars * 977 + doc_id * 7) % 1209600) * 1000000) AS published FROM documents)"""


def _sent() -> str:
    from registered.news import SCORED

    scored = SCORED.replace("h.", "hd.").replace("FROM h LEFT", "FROM hd LEFT")
    return f"""{HEADS}, {scored}, ss AS (SELECT ticker, round(avg(score), 4) AS score, count(score) AS scored, count(*) FILTER (score IS NOT NULL AND sentiment = 'positive') AS pos_n,
      count(*) FILTER (score IS NOT NULL AND sentiment = 'negative') AS neg_n, count(*) FILTER (score IS NOT NULL AND sentiment = 'neutral') AS neu_n FROM sc GROUP BY ticker),
    sl AS (SELECT *, CASE WHEN score > 0.2 THEN 'positive' WHEN score < -0.2 THEN 'negative' WHEN score IS NOT NULL THEN 'neutral' END AS label FROM ss)"""


SENT = _sent()
FIG = f"""{MK.L_IND}, {MK.SNAP}, {SENT}, rk AS (SELECT * FROM {MK._rank(63)}),
tk AS (SELECT ticker FROM snap UNION ALL SELECT 'Z'),
fg AS (SELECT tk.ticker, s.close, s.as_of, s.close_vs_sma_200_pct AS d200, s.close_vs_sma_50_pct AS d50, r."window" AS win, r.current_pct, r.percentile_1y, l.score, l.label, l.scored
  FROM tk LEFT JOIN snap s USING (ticker) LEFT JOIN rk r USING (ticker) LEFT JOIN sl l USING (ticker))"""
SENTENCES = "len(list_filter(string_split(regexp_replace(trim({x}, ' '), '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda p: p <> ''))"
RUNS = """rs AS (SELECT o_orderpriority AS ticker, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS as_of, arg_max(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, o_orderkey) AS v,
    arg_max(CASE WHEN o_orderstatus = 'P' THEN 'template' ELSE 'llm' END, o_orderkey) AS g, max(o_orderkey) AS k, max_by(o_custkey, o_orderkey) % 20 <> 0 AS good FROM orders GROUP BY 1, 2),
rr AS (SELECT *, CASE WHEN good THEN 'run ' || k END AS payload FROM rs)"""

QUERIES = {
    "sentence_counts": sentence_counts,
    "checked_recommendations": checked_recommendations,
    "recommendation_fallback": recommendation_fallback,
    "checked_research_answers": checked_research_answers,
    "range_violations": range_violations,
    "template_observations": template_observations,
    "template_reports": template_reports,
    "chosen_reports": chosen_reports,
    "report_documents": report_documents,
    "escaped_markdown": escaped_markdown,
    "sentiment_sections": sentiment_sections,
    "sentiment_fact_lines": sentiment_fact_lines,
    "market_briefs": market_briefs,
    "default_requests": default_requests,
    "fulfilled_requests": fulfilled_requests,
    "data_briefs": data_briefs,
    "snapshot_actions": snapshot_actions,
    "snapshot_lookup": snapshot_lookup,
    "snapshot_recompute": snapshot_recompute,
    "saved_reports": saved_reports,
    "jsonl_round_trip": jsonl_round_trip,
}

_SG = lambda c: f"coalesce(printf('%+.1f%%', {c}), 'an unknown distance')"
ORACLE = {
    "sentence_counts": f"SELECT doc_id, {SENTENCES.format(x='text')} AS sentences FROM documents",
    "checked_recommendations": f"""WITH c AS (SELECT conv_id, turn, role, {SENTENCES.format(x='text')} AS s, length(text) % 5 + 1 AS k FROM conversations)
      SELECT conv_id, turn, concat_ws('; ', CASE WHEN role = 'system' THEN 'unknown recommendation Maybe' END, CASE WHEN s NOT BETWEEN 3 AND 5 THEN 'sentences: ' || s || ', wanted between 3 and 5' END,
        CASE WHEN k NOT BETWEEN 2 AND 4 THEN 'key factors: ' || k || ', wanted between 2 and 4' END) AS violations FROM c""",
    "recommendation_fallback": f"""WITH c AS (SELECT conv_id, turn, role, length(text) % 5 + 1 AS k FROM conversations WHERE role <> 'system' AND {SENTENCES.format(x='text')} BETWEEN 3 AND 5 AND length(text) % 5 + 1 BETWEEN 2 AND 4)
      SELECT t.conv_id || '-' || t.turn AS ticker, CASE role WHEN 'user' THEN 'Buy' WHEN 'assistant' THEN 'Sell' ELSE 'Hold' END AS recommendation, role IS NOT NULL AS ok, coalesce(k, 2) AS factors
      FROM (SELECT DISTINCT conv_id, turn FROM conversations) t LEFT JOIN c ON c.conv_id = t.conv_id AND c.turn = t.turn""",
    "checked_research_answers": f"""WITH a AS (SELECT conv_id, arg_max(text, turn) AS x, count(*) FILTER (role = 'user') AS r, string_agg(CAST(turn AS VARCHAR), ', ' ORDER BY CAST(turn AS VARCHAR)) FILTER (role = 'user' AND length(text) % 4 = 3) AS bad,
        count(*) FILTER (role = 'assistant') AS l, max(turn) > 3 AS known FROM conversations GROUP BY conv_id), b AS (SELECT *, {SENTENCES.format(x='x')} AS s FROM a)
      SELECT conv_id, concat_ws('; ', CASE WHEN s NOT BETWEEN 3 AND 5 THEN 'sentences: ' || s || ', wanted between 3 and 5' END, CASE WHEN r <> 3 THEN 'risks: ' || r || ', wanted exactly 3' END,
        'evidence count outside 1-3 for: ' || bad, CASE WHEN l NOT BETWEEN 1 AND 3 THEN 'legs: ' || l || ', wanted between 1 and 3' END, CASE WHEN NOT known THEN 'unknown strategy' END) AS violations FROM b""",
    "range_violations": """SELECT concat_ws('; ', CASE WHEN l_discount NOT BETWEEN 0 AND 0.08::DOUBLE THEN 'confidence outside 0..0.08' END, CASE WHEN l_quantity / 25 - 1 NOT BETWEEN -0.9::DOUBLE AND 0.9::DOUBLE THEN 'score outside -0.9..0.9' END,
        CASE WHEN l_extendedprice / 900 NOT BETWEEN 0 AND 100 THEN 'percentile outside 0..100' END) AS violations, count(*) AS rows FROM lineitem GROUP BY 1""",
    "template_observations": f"""{FIG} SELECT ticker, 0 AS n, CASE WHEN close IS NULL THEN 'No price data was available, so the trend is unknown.' ELSE 'The close of ' || printf('%.2f', close) || ' is ' || {_SG('d200')} || ' from the 200-day average and ' || {_SG('d50')} || ' from the 50-day average.' END AS observation FROM fg
      UNION ALL SELECT ticker, 1, coalesce(win || '-day volatility is ' || printf('%.1f%%, at the %.0fth percentile of the past year.', current_pct, percentile_1y), 'No volatility figure was available.') FROM fg
      UNION ALL SELECT ticker, 2, coalesce('The Sentiment score of the given headlines is ' || printf('%+.2f (%s).', score, label), 'No headline sentiment was available.') FROM fg""",
    "template_reports": f"""{FIG} SELECT ticker, CASE WHEN close IS NULL THEN 'Price data was unavailable, so the trend could not be assessed.' ELSE 'The price closed at ' || printf('%.2f', close) || ' on ' || as_of || ', ' || {_SG('d200')} || ' from its 200-day average and ' || {_SG('d50')} || ' from its 50-day average.' END
        || ' ' || coalesce('Annualised ' || win || '-day volatility is ' || printf('%.1f%%, at the %.0fth percentile of the past year.', current_pct, percentile_1y), 'Volatility was unavailable.')
        || ' ' || coalesce('The Sentiment score of recent headlines is ' || printf('%+.2f (%s).', score, label), 'Headline sentiment was unavailable.') AS summary,
        CASE WHEN close IS NULL THEN 'trim_and_stop' ELSE 'protective_put' END AS strategy, CASE WHEN close IS NULL THEN 'shares' ELSE 'put' END AS instrument,
        coalesce(printf('Volatility %.1f%%, percentile %.0f', current_pct, percentile_1y), 'No volatility result was returned') AS volatility_fact,
        coalesce(printf('Sentiment score %+.2f over %d headlines', score, scored), 'No sentiment result was returned') AS news_fact FROM fg""",
    "chosen_reports": """SELECT * FROM (VALUES ('A', 'llm', 'collar', ''), ('N', 'template', 'protective_put', 'no LLM is available for the report, so it was written from a template'),
        ('R', 'template', 'protective_put', 'no LLM is available for the report, so it was written from a template'),
        ('Z', 'template', 'trim_and_stop', 'no price data came back, so the report was written from a template: the LLM would have nothing to ground its risks in')) t(ticker, generated_by, strategy, warnings)
      WHERE ticker = 'Z' OR ticker IN (SELECT l_returnflag FROM lineitem)""",
    "escaped_markdown": """SELECT page_id, replace(regexp_replace(html, '([\\\\`*_\\[\\]])', '\\\\\\1', 'g'), '<', '&lt;') AS text FROM pages""",
    "sentiment_sections": f"""WITH {SENT}, top AS (SELECT * FROM (SELECT sc.*, title, row_number() OVER (PARTITION BY sc.ticker ORDER BY abs(score) DESC, ord) AS rank FROM sc JOIN hd ON hd.pos = sc.ord WHERE score IS NOT NULL) WHERE rank <= 3),
      e AS (SELECT *, replace(regexp_replace(title, '([\\\\`*_\\[\\]])', '\\\\\\1', 'g'), '<', '&lt;') AS t FROM top),
      ln AS (SELECT ticker, string_agg(rank || '. **' || t || '** (' || publisher || ', ' || strftime(published, '%Y-%m-%d') || '): ' || sentiment || printf(', score %+.2f. ', score) || coalesce(brief_reason, ''), chr(10) ORDER BY rank) AS lines FROM e GROUP BY ticker)
      SELECT ticker, printf('**Sentiment score: %+.2f (%s)** on a scale from -1 to +1, the mean of %d headlines from the last 7 days: %d positive, %d negative, %d neutral.', score, label, scored, pos_n, neg_n, neu_n)
        || chr(10) || chr(10) || 'Top 3 headlines by strength of sentiment:' || chr(10) || chr(10) || lines AS section FROM sl JOIN ln USING (ticker)""",
    "sentiment_fact_lines": f"""WITH {SENT} SELECT ticker, printf('Sentiment score: %+.2f (%s) on a scale from -1 to +1, from %d headlines of the last 7 days (%d positive, %d negative, %d neutral)', score, label, scored, pos_n, neg_n, neu_n) AS fact FROM sl""",
    "default_requests": """WITH a AS (SELECT CAST(c_custkey AS VARCHAR) AS run_id, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'sentiment' WHEN 'MACHINERY' THEN 'volatility' WHEN 'BUILDING' THEN 'price_data' END AS nd, c_nationkey AS n FROM customer),
      b AS (SELECT *, nd IS NULL OR (nd = 'sentiment' AND n >= 10) AS def, CASE WHEN nd IS NULL OR (nd = 'sentiment' AND n >= 10) THEN 'volatility' ELSE nd END AS needs FROM a)
      SELECT run_id, needs, CASE WHEN def THEN 'What is the annualised volatility over 63 trading days, the length of the 90-day horizon?' ELSE 'why?' END AS question,
        CASE WHEN needs = 'price_data' THEN CASE WHEN n > 12 THEN '3mo' ELSE '1y' END END AS period, CASE WHEN def THEN 63 WHEN needs = 'volatility' THEN CASE WHEN n > 15 THEN n ELSE 63 END END AS "window",
        CASE WHEN needs = 'sentiment' THEN 1 END AS given, CASE WHEN def THEN 'The brief''s 30-day volatility is shorter than the report''s 90-day horizon; the longer window shows whether the expected move is understated.' ELSE 'because' END AS why,
        CASE WHEN nd = 'sentiment' AND def THEN 'the request asked for sentiment without headlines, so the default request was sent instead' WHEN def THEN 'no LLM for the clarification request, so the default request was sent' END AS warning FROM b""",
    "fulfilled_requests": f"""{W}, o AS (SELECT run_id, tool, bool_or(duration_ms > 80) AS own, bool_or(duration_ms > 50) AS other FROM tr WHERE status = 'ok' GROUP BY run_id, tool),
      q AS (SELECT DISTINCT run_id, CASE CAST(run_id AS INT) % 3 WHEN 0 THEN 'get_price_data' WHEN 1 THEN 'calculate_volatility' ELSE 'llm_sentiment' END AS tool FROM tr WHERE event = 'tool_call')
      SELECT q.run_id, q.tool, CASE WHEN coalesce(own, false) THEN 'agent' ELSE 'pipeline' END AS fulfilled_by, coalesce(other, false) AS has_data,
        CASE WHEN coalesce(own, false) THEN 0 WHEN coalesce(other, false) THEN 1 ELSE 2 END AS warnings FROM q LEFT JOIN o USING (run_id, tool)""",
    "snapshot_actions": f"""WITH {RUNS} SELECT ticker, as_of, CASE WHEN g = 'template' THEN 'skip_save' ELSE 'save' END AS action, CASE WHEN g = 'template' THEN 'the report was written from a template, so it is not cached' END AS reason FROM rr""",
    "snapshot_lookup": f"""WITH {RUNS}, l AS (SELECT *, month(as_of) = 1 AS forced, g <> 'template' AS found FROM rr)
      SELECT upper(ticker) AS ticker, as_of, CASE WHEN forced THEN 'skip' WHEN found AND good AND v = 1 THEN 'hit' ELSE 'miss' END AS action,
        CASE WHEN forced THEN 'force_refresh' WHEN NOT found THEN 'no file' WHEN NOT good THEN 'unreadable' WHEN v <> 1 THEN 'schema version ' || v || ', expected 1' END AS reason,
        CASE WHEN NOT forced AND found AND v = 1 THEN payload END AS payload FROM l""",
    "snapshot_recompute": f"WITH {RUNS} SELECT ticker, as_of FROM rr WHERE month(as_of) = 1 OR NOT (g <> 'template' AND v = 1 AND good)",
    "saved_reports": """WITH s AS (SELECT source AS ticker, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source)
      SELECT ticker, unnest(['# ' || ticker, '', '- documents: ' || n, '- first: ' || first]) AS line FROM s""",
    "jsonl_round_trip": "SELECT source AS split, lang, count(*) AS rows FROM documents GROUP BY source, lang",
    "data_briefs": f"""{FIG}, {TR.TRACE}, kd AS (SELECT (['A', 'N', 'R'])[seq % 3 + 1] AS tk, * REPLACE (CASE WHEN duration_ms > 300 THEN status ELSE 'empty' END AS status), status AS was FROM tr WHERE event = 'tool_call'),
      c AS (SELECT tk, tool, count(*) FILTER (status = 'ok') AS ok, min(seq) FILTER (status = 'ok') AS first, arg_max(status, seq) AS st, arg_max(CASE WHEN was = 'error' THEN output WHEN was = 'empty' THEN 'slow; ' || tool ELSE 'no detail' END, seq) AS pr FROM kd GROUP BY tk, tool),
      gp AS (SELECT a.tk, string_agg(CASE WHEN c.ok IS NULL THEN t.tool || ' was not called' ELSE t.tool || ' returned no usable result (' || st || ': ' || pr || ')' END, '; ' ORDER BY t.n) AS gaps
        FROM (SELECT DISTINCT tk FROM kd) a CROSS JOIN (VALUES (0, 'get_price_data'), (1, 'calculate_volatility'), (2, 'llm_sentiment')) t(n, tool) LEFT JOIN c ON c.tk = a.tk AND c.tool = t.tool WHERE coalesce(c.ok, 0) = 0 GROUP BY a.tk),
      tl AS (SELECT tk, string_agg(tool, ',' ORDER BY first) AS tools FROM c WHERE ok > 0 GROUP BY tk), hn AS (SELECT ticker, count(*) AS n FROM hd GROUP BY ticker)
      SELECT fg.ticker, coalesce(hn.n, 0) AS headlines_given, close, win AS "window", round(score, 4) AS score, CASE WHEN close IS NOT NULL THEN 5 END AS levels, 3 AS observations, coalesce(gaps, '') AS data_gaps, coalesce(tools, '') AS tools
      FROM fg LEFT JOIN hn USING (ticker) LEFT JOIN gp ON gp.tk = fg.ticker LEFT JOIN tl ON tl.tk = fg.ticker""",
}
