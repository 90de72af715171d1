"""Queries over what runs returned: open trace lines, figures, hedge levels and checked reports; and as-of lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import run_results as RR
from ledgerloom.operators import traces as T
from ledgerloom.operators.asof import as_of_join
from ledgerloom.plans import bindings as D
from ledgerloom.schemas import TRACE_SCHEMA
from ledgerloom.sources import jsonl
from registered import market as MK
from registered import traces as TR


def _open(spark, d):
    """Trace rows as JSON text with two fields that the schema doesn't name, one known field of another type, blank and broken lines."""
    c = F.col
    trace = D.trace(spark, d)
    columns = [F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"), *[c(x) for x in trace.columns if x not in ("ts", "tokens")]]
    tokens = F.when(c("seq") % 13 == 0, F.to_variant_object(F.array(c("seq")))).otherwise(F.try_parse_json(c("tokens").cast("string")))
    extra = [tokens.alias("tokens"), F.when(c("seq") % 7 == 0, F.struct(c("seq").alias("n"))).alias("meta"), F.when(c("seq") % 3 == 0, F.concat(F.lit("x"), c("seq") % 5)).alias("experiment")]
    text = F.when(c("seq") % 50 == 0, F.lit("  ")).when(c("seq") % 50 == 1, F.lit('{"ts": ')).when(c("seq") % 50 == 2, F.lit("[1]")).otherwise(F.to_json(F.struct(*columns, *extra)))
    return jsonl.open_lines(trace.select(c("seq").alias("line_no"), text.alias("value")), TRACE_SCHEMA)


def open_trace_lines(spark, d):
    """Known fields typed, the others beside them, broken lines as rows."""
    out = _open(spark, d)
    return out.select(
        "line_no", "run_id", "ts", "event", "duration_ms", "tokens", F.variant_get(F.try_element_at("rest", F.lit("meta")), "$.n", "bigint").alias("meta_n"),
        F.variant_get(F.try_element_at("rest", F.lit("experiment")), "$", "string").alias("experiment"), F.array_join(F.array_sort(F.map_keys("rest")), ",").alias("others"), F.col("_corrupt_record").alias("broken"),
    )


def open_trace_fields(spark, d):
    return jsonl.field_counts(_open(spark, d)).withColumn("type", F.regexp_extract("type", "^[A-Z]+", 0))


def _results(spark, d):
    """Tool calls with a result as the tool writes it; some have a field of another type, lack one, or are no JSON."""
    c = F.col
    ms, seq = c("duration_ms"), c("seq")
    close = F.when(seq % 11 == 0, F.try_parse_json(F.lit('"n/a"'))).otherwise(F.try_parse_json((ms + 50).cast("string")))
    indicators = F.struct((ms / 100).alias("hv_30"), F.when(seq % 2 == 0, ms + 40).alias("sma_200"))
    price = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("as_of"), close.alias("close"), (ms - 10).alias("close_vs_sma_200_pct"), (ms + 20).alias("low_52w"), indicators.alias("indicators")))
    window = F.element_at(F.array(F.lit(30), F.lit(63), F.lit(90)), (seq % 3 + 1).cast("int"))
    volatility = F.to_json(F.struct(window.alias("window"), F.when(seq % 13 != 0, ms).alias("current_pct"), (seq % 100).alias("percentile_1y")))
    sentiment = F.to_json(F.struct(F.struct((seq % 9).alias("scored"), F.when(seq % 9 > 0, (seq % 201 - 100) / 100).alias("score"), F.when(seq % 9 > 0, "neutral").alias("label")).alias("summary")))
    data = F.when(c("tool") == "get_price_data", price).when(c("tool") == "calculate_volatility", volatility).when(c("tool") == "llm_sentiment", F.when(seq % 17 == 0, "no JSON").otherwise(sentiment))
    calls = T.tool_calls(D.trace(spark, d)).select("run_id", "seq", "tool", "status", "duration_ms", F.when(c("status") == "ok", data).alias("data"), "output")
    return TR._quick_is_empty(calls, 60).withColumns({"error": F.when(c("status") == "error", c("output")), "warnings": F.array().cast("array<string>")})


def run_figures(spark, d):
    out = RR.run_figures(_results(spark, d))
    return out.select(
        "run_id", F.round("price.close", 4).alias("close"), "price.as_of", F.round("price.sma_200", 4).alias("sma_200"), "volatility.window", F.round("volatility.current_pct", 4).alias("current_pct"),
        "sentiment.scored", "sentiment.score", "sentiment.label", F.array_join("warnings", "; ").alias("warnings"),
    )


def run_hedge_levels(spark, d):
    out = RR.run_hedge_levels(_results(spark, d)).select("run_id", "levels.*")
    return out.select("run_id", "price", "volatility_pct", "volatility_source", "expected_move", F.array_join(F.transform("candidates", lambda x: x["name"]), ",").alias("candidates"))


def _answers(spark, d):
    """An answer a run: its messages as three risks whose evidence cites tools, and two legs."""
    c = F.col
    facts = TR._evidence(spark, d).groupBy("run_id", "risk", "source_tool").agg(F.min("fact").alias("fact"))
    cited = F.transform(F.array_sort(F.collect_list(F.struct("source_tool", "fact"))), lambda e: F.struct(e["fact"].alias("fact"), e["source_tool"].alias("source_tool")))
    risks = facts.groupBy("run_id", "risk").agg(cited.alias("evidence"))
    risk = F.struct(c("risk").alias("title"), F.lit("It may matter.").alias("explanation"), "evidence")
    low = F.when(c("run_id").cast("long") % 2 == 0, "one_sd_low").otherwise("made_up")
    legs = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(b).alias("instrument"), n.alias("level_name")) for a, b, n in (("buy", "put", low), ("sell", "call", F.lit("one_sd_high")))])
    return risks.groupBy("run_id").agg(F.array_sort(F.collect_list(risk)).alias("risks")).select("run_id", "risks", legs.alias("legs"))


def checked_run_reports(spark, d):
    results = _results(spark, d)
    out = RR.checked_reports(_answers(spark, d), results, RR.run_hedge_levels(results))
    kept = F.transform("risks", lambda r: F.concat(r["title"], F.lit(":"), F.array_join(F.transform(r["evidence"], lambda e: e["fact"]), ",")))
    return out.select(
        "run_id", F.array_join(kept, ";").alias("risks"), F.col("legs")[0]["level"].alias("put_level"), F.col("legs")[1]["level"].alias("call_level"), F.col("levels.volatility_source").alias("source"),
        F.array_join("data_gaps", "; ").alias("data_gaps"), F.array_join("tools_called", ",").alias("tools"), F.array_join("warnings", " | ").alias("warnings"),
    )


def calls_after_ok(spark, d):
    """Each call beside its agent's last ok call before it. There are two agents, so each key has about half of all rows."""
    calls = T.tool_calls(D.trace(spark, d)).select("agent", "seq", "tool", "status", "duration_ms")
    out = as_of_join(calls.select("agent", "seq", "tool"), calls.where("status = 'ok'").withColumn("at", F.col("seq")), ["agent"], "seq", "at", "seq", strict=True)
    return out.select("agent", "seq", "tool", F.col("as_of.seq").alias("ok_seq"), F.col("as_of.tool").alias("ok_tool"), F.col("as_of.duration_ms").alias("ok_ms"))


def headlines_with_close(spark, d):
    """Each headline, dealt over the years of the bars, beside its ticker's last close up to that day."""
    c = F.col
    flag = F.when(c("lang") == "en", "A").when(c("lang") == "fr", "N").otherwise("R")
    day = F.date_add(F.lit("1992-01-01").cast("date"), (c("doc_id") * 37 % 2600).cast("int"))
    news = D.table(spark, d, "documents").select("doc_id", flag.alias("ticker"), day.alias("day"))
    closes = MK.daily_bars(spark, d).select("ticker", "date", "close")
    out = as_of_join(news, closes, ["ticker"], "day", "date", "date")
    return out.select("doc_id", "ticker", "day", F.col("as_of.date").alias("close_date"), F.round("as_of.close", 4).alias("close"))


QUERIES = {
    "calls_after_ok": calls_after_ok,
    "headlines_with_close": headlines_with_close,
    "open_trace_lines": open_trace_lines,
    "open_trace_fields": open_trace_fields,
    "run_figures": run_figures,
    "run_hedge_levels": run_hedge_levels,
    "checked_run_reports": checked_run_reports,
}
W = TR.W
RES = f"""{W}, o AS (SELECT run_id, seq, tool, CASE WHEN duration_ms > 60 THEN status ELSE 'empty' END AS status, output, duration_ms AS ms, ts FROM tr WHERE event = 'tool_call'),
  n AS (SELECT run_id, max(CASE WHEN tool = 'get_price_data' AND status = 'ok' THEN seq END) AS p, max(CASE WHEN tool = 'calculate_volatility' AND status = 'ok' THEN seq END) AS v, max(CASE WHEN tool = 'llm_sentiment' AND status = 'ok' THEN seq END) AS s FROM o GROUP BY run_id),
  f AS (SELECT n.run_id, p, v, s, CASE WHEN p % 11 <> 0 THEN po.ms + 50 END AS close, CASE WHEN p % 11 <> 0 THEN CAST(po.ts AS DATE) END AS as_of, CASE WHEN p % 11 <> 0 AND p % 2 = 0 THEN po.ms + 40 END AS sma_200,
    CASE WHEN p % 11 <> 0 THEN po.ms + 20 END AS low_52w, round(po.ms, 2) AS hv, CASE WHEN v % 13 <> 0 THEN ([30, 63, 90])[v % 3 + 1] END AS win, CASE WHEN v % 13 <> 0 THEN vo.ms END AS pct
    FROM n LEFT JOIN o po ON po.seq = p LEFT JOIN o vo ON vo.seq = v),
  z AS (SELECT run_id, first(ms ORDER BY abs(win - 63), seq DESC) AS ms, first(win ORDER BY abs(win - 63), seq DESC) AS win FROM (SELECT *, ([30, 63, 90])[seq % 3 + 1] AS win FROM o WHERE tool = 'calculate_volatility' AND status = 'ok' AND seq % 13 <> 0) GROUP BY run_id),
  h AS (SELECT f.*, coalesce(z.ms, hv) AS used, z.win AS zwin, close * coalesce(z.ms, hv) / 100 * sqrt(63.0 / 252) AS move FROM f LEFT JOIN z USING (run_id) WHERE close IS NOT NULL)"""
OPEN = f"""{W}, l AS (SELECT *, seq % 50 IN (1, 2) AS bad, CASE WHEN event = 'agent_turn' AND k <> 7 THEN k END AS tk FROM tr WHERE seq % 50 <> 0)"""
ORACLE = {
    "calls_after_ok": f"""{W}, o AS (SELECT agent, seq, tool, status, duration_ms FROM tr WHERE event = 'tool_call') SELECT a.agent, a.seq, a.tool, b.seq AS ok_seq, b.tool AS ok_tool, b.duration_ms AS ok_ms
      FROM o a ASOF LEFT JOIN (SELECT * FROM o WHERE status = 'ok') b ON a.agent = b.agent AND a.seq > b.seq""",
    "headlines_with_close": f"""WITH {MK.BARS}, h AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'A' WHEN 'fr' THEN 'N' ELSE 'R' END AS ticker, DATE '1992-01-01' + CAST(doc_id * 37 % 2600 AS INTEGER) AS day FROM documents)
      SELECT doc_id, h.ticker, day, b.date AS close_date, round(b.close, 4) AS close FROM h ASOF LEFT JOIN bars b ON h.ticker = b.ticker AND h.day >= b.date""",
    "open_trace_lines": f"""{OPEN} SELECT seq AS line_no, CASE WHEN NOT bad THEN run_id END AS run_id, CASE WHEN NOT bad THEN ts END AS ts, CASE WHEN NOT bad THEN event END AS event, CASE WHEN NOT bad THEN duration_ms END AS duration_ms,
      CAST(CASE WHEN NOT bad AND seq % 13 <> 0 THEN tk END AS BIGINT) AS tokens, CASE WHEN NOT bad AND seq % 7 = 0 THEN seq END AS meta_n, CASE WHEN NOT bad AND seq % 3 = 0 THEN 'x' || (seq % 5) END AS experiment,
      CASE WHEN NOT bad THEN concat_ws(',', CASE WHEN seq % 3 = 0 THEN 'experiment' END, CASE WHEN seq % 7 = 0 THEN 'meta' END, CASE WHEN seq % 13 = 0 THEN 'tokens' END) END AS others,
      CASE WHEN seq % 50 = 1 THEN '{{"ts": ' WHEN seq % 50 = 2 THEN '[1]' END AS broken FROM l""",
    "open_trace_fields": f"""{OPEN}, g AS (SELECT seq FROM l WHERE NOT bad) SELECT 'experiment' AS field, 'STRING' AS type, count(*) AS rows FROM g WHERE seq % 3 = 0 HAVING count(*) > 0
      UNION ALL SELECT 'meta', 'OBJECT', count(*) FROM g WHERE seq % 7 = 0 HAVING count(*) > 0 UNION ALL SELECT 'tokens', 'ARRAY', count(*) FROM g WHERE seq % 13 = 0 HAVING count(*) > 0""",
    "run_figures": f"""{RES} SELECT f.run_id, round(close, 4) AS close, as_of, round(sma_200, 4) AS sma_200, win AS "window", round(pct, 4) AS current_pct,
      CASE WHEN s % 17 <> 0 THEN s % 9 END AS scored, CASE WHEN s % 17 <> 0 AND s % 9 > 0 THEN (s % 201 - 100) / 100.0::DOUBLE END AS score, CASE WHEN s % 17 <> 0 AND s % 9 > 0 THEN 'neutral' END AS label,
      concat_ws('; ', CASE WHEN p % 11 = 0 THEN 'get_price_data: close is no double' END, CASE WHEN v % 13 = 0 THEN 'calculate_volatility: current_pct is missing' END, CASE WHEN s % 17 = 0 THEN 'llm_sentiment: the result is no JSON' END) AS warnings FROM f""",
    "run_hedge_levels": f"""{RES} SELECT run_id, round(close, 2) AS price, round(used, 2) AS volatility_pct, coalesce('calculate_volatility, ' || zwin || '-day', 'get_price_data hv_30') AS volatility_source, round(move, 2) AS expected_move,
      concat_ws(',', 'one_sd_low', 'one_sd_high', CASE WHEN sma_200 IS NOT NULL THEN 'sma_200' END, 'low_52w') AS candidates FROM h WHERE used IS NOT NULL""",
    "checked_run_reports": f"""{RES}, e AS (SELECT run_id, CASE k % 3 WHEN 0 THEN 'Trend' WHEN 1 THEN 'Volatility' ELSE 'News' END AS risk,
        (['get_price_data','calculate_volatility','get_news','llm_sentiment','web_search'])[k % 5 + 1] AS tool, min('fact ' || k) AS fact FROM tr WHERE event IN ('handoff', 'critique') GROUP BY 1, 2, 3),
      ok AS (SELECT run_id, tool, min(seq) AS first FROM o WHERE status = 'ok' GROUP BY run_id, tool),
      r AS (SELECT e.run_id, risk, risk || ':' || coalesce(string_agg(fact, ',' ORDER BY e.tool) FILTER (ok.tool IS NOT NULL), '') AS kept,
        concat_ws(' | ', string_agg('dropped evidence for ''' || risk || ''' citing ' || e.tool || ', which returned no usable result: ''' || fact || '''', ' | ' ORDER BY e.tool) FILTER (ok.tool IS NULL),
          CASE WHEN count(ok.tool) = 0 THEN 'risk ''' || risk || ''' has no supporting evidence left' END) AS said FROM e LEFT JOIN ok ON ok.run_id = e.run_id AND ok.tool = e.tool GROUP BY e.run_id, risk),
      a AS (SELECT run_id, string_agg(kept, ';' ORDER BY risk) AS risks, string_agg(nullif(said, ''), ' | ' ORDER BY risk) AS said FROM r GROUP BY run_id),
      t AS (SELECT run_id, string_agg(tool, ',' ORDER BY first) AS tools FROM ok GROUP BY run_id),
      c AS (SELECT run_id, tool, count(*) FILTER (status = 'ok') AS ok, arg_max(status, seq) AS st, arg_max(CASE WHEN status = 'error' THEN output ELSE 'no detail' END, seq) AS pr FROM o GROUP BY run_id, tool),
      g AS (SELECT a.run_id, string_agg(x.tool || CASE WHEN c.ok IS NULL THEN ' was not called' ELSE ' returned no usable result (' || st || ': ' || pr || ')' END, '; ' ORDER BY x.tool_no) AS gaps FROM a CROSS JOIN {TR._TOOLS.replace(') t(', ') x(')} LEFT JOIN c ON c.run_id = a.run_id AND c.tool = x.tool WHERE coalesce(c.ok, 0) = 0 GROUP BY a.run_id)
      SELECT a.run_id, risks, CASE WHEN CAST(a.run_id AS BIGINT) % 2 = 0 THEN round(close - move, 2) END AS put_level, round(close + move, 2) AS call_level, CASE WHEN move IS NOT NULL THEN coalesce('calculate_volatility, ' || zwin || '-day', 'get_price_data hv_30') END AS source,
        coalesce(gaps, '') AS data_gaps, coalesce(tools, '') AS tools,
        concat_ws(' | ', said, CASE WHEN CAST(a.run_id AS BIGINT) % 2 = 1 THEN 'hedge leg ''buy put'' names an unknown level ''made_up'', so it has no price' WHEN move IS NULL THEN 'hedge leg ''buy put'' names an unknown level ''one_sd_low'', so it has no price' END,
          CASE WHEN move IS NULL THEN 'hedge leg ''sell call'' names an unknown level ''one_sd_high'', so it has no price' END) AS warnings
      FROM a LEFT JOIN t USING (run_id) LEFT JOIN g USING (run_id) LEFT JOIN h ON h.run_id = a.run_id""",
}
