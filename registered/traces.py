"""Trace queries: runs, timelines, messages, steps, tool statistics, replan cycles, observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.fixed_values import TOOLS
from ledgerloom.operators import evidence as E
from ledgerloom.operators import traces as T
from ledgerloom.plans import bindings as D
from ledgerloom.schemas import TRACE_SCHEMA
from ledgerloom.sources.jsonl import parse_lines

KINDS = ["agent_turn", "cache", "critique", "handoff", "tool_call"]


def _observations(spark, d):
    """Tool calls as observations with a JSON result."""
    c = F.col
    calls = T.tool_calls(D.trace(spark, d))
    return calls.select(
        "run_id", "seq", "tool", "args", "status", "duration_ms",
        F.when(c("duration_ms") > 10, F.to_json(F.struct("tool", "status", "duration_ms"))).alias("digest"),
        F.when(c("status") == "ok", F.to_json(F.struct(c("seq").alias("n"), c("duration_ms").alias("ms")))).alias("data"),
        F.when(c("status") == "error", c("output")).alias("error"),
        F.when(c("status") == "empty", F.array(F.lit("slow"), c("tool"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def _quick_is_empty(observations, least: int):
    """Calls that took up to ``least`` ms count as empty."""
    return observations.withColumn("status", F.when(F.col("duration_ms") > least, F.col("status")).otherwise("empty"))


def _evidence(spark, d):
    """Critique events as evidence rows citing a tool."""
    k = F.get_json_object("content", "$.k").cast("int")
    messages = D.trace(spark, d).where("event in ('handoff', 'critique')")
    tool = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), k % 5 + 1)
    return messages.select(
        "run_id", "seq", F.when(k % 3 == 0, "Trend").when(k % 3 == 1, "Volatility").otherwise("News").alias("risk"),
        tool.alias("source_tool"), F.concat(F.lit("fact "), k.cast("string")).alias("fact"),
    )


def tool_stats(spark, d):
    return T.tool_stats(D.trace(spark, d))


def run_tool_stats(spark, d):
    return T.tool_stats(D.trace(spark, d), ["run_id"])


def run_summaries(spark, d):
    return T.run_summary(D.trace(spark, d))


def runs_table(spark, d):
    return T.runs_table(D.trace(spark, d))


def run_labels(spark, d):
    """Labels of shorter runs too: every (run, hour) is a run of its own, so all label shapes occur."""
    hourly = D.trace(spark, d).withColumn("run_id", F.concat_ws("-", "run_id", F.date_format("ts", "yyyyMMddHH")))
    return T.run_labels(hourly)


def run_tickers(spark, d):
    hourly = D.trace(spark, d).withColumn("run_id", F.concat_ws("-", "run_id", F.date_format("ts", "yyyyMMddHH")))
    return T.run_tickers(hourly)


def timelines(spark, d):
    return T.timeline(D.trace(spark, d))


def agent_messages(spark, d):
    return T.messages(D.trace(spark, d))


def timeline_rows(spark, d):
    return T.row_order(D.trace(spark, d))


def run_steps(spark, d):
    return T.steps(D.trace(spark, d)).select("run_id", "seq", "kind", "time", "title")


def stored_outputs(spark, d):
    calls = T.tool_calls(D.trace(spark, d)).withColumn("output", F.repeat("output", 12))
    return T.stored_output(calls).select("run_id", "seq", "output", "output_preview", "output_chars")


def replan_cycles(spark, d):
    return T.replan_cycles(D.trace(spark, d), block=4096)


def call_log_rollup(spark, d):
    c = F.col
    k = F.get_json_object("props", "$.k").cast("int")
    log = D.table(spark, d, "events").select(
        c("event_type").alias("prompt"),
        F.when(k < 40, "first").when(k < 80, "second").alias("provider"),
        F.when(c("value") > 5, "ok").otherwise("repaired").alias("outcome"),
        F.when(k < 80, F.lit(1) + k % 3).cast("bigint").alias("attempts"),
        (k % 2).cast("bigint").alias("sdk_retries"),
        F.when(k < 80, F.floor(c("value") * 10)).cast("double").alias("latency_ms"),
        F.when(k < 80, k * 10).cast("bigint").alias("prompt_tokens"),
        F.when(k < 60, k).cast("bigint").alias("completion_tokens"),
    )
    return T.call_log_rollup(log)


def trace_totals(spark, d):
    return T.totals(D.trace(spark, d))


def event_counts(spark, d):
    return T.event_counts(D.trace(spark, d))


def event_pivot(spark, d):
    return T.event_pivot(D.trace(spark, d), "run_id", KINDS)


def agent_tool_crosstab(spark, d):
    return T.agent_tool_crosstab(D.trace(spark, d), TOOLS)


def result_durations(spark, d):
    trace = D.trace(spark, d)
    runs = trace.select("run_id").distinct()
    results = runs.withColumn("tool", F.explode(F.array(*[F.lit(t) for t in TOOLS])))
    return T.result_durations(results, trace)


def side_by_side_runs(spark, d):
    calls = T.tool_calls(D.trace(spark, d))
    agent = lambda a: calls.where(F.col("agent") == a).select("run_id", "seq", "tool")
    return T.side_by_side(agent("A"), agent("B"), ["run_id"])


def latest_usable_results(spark, d):
    return E.latest_ok(_observations(spark, d))


def usable_tools(spark, d):
    return E.ok_tools(_observations(spark, d)).select("run_id", F.array_join("tools", ",").alias("tools"))


def data_gaps(spark, d):
    """Gaps per hour of each run, so that never-called and never-successful tools both occur."""
    hour = F.concat_ws("-", "run_id", (F.col("seq") / 20).cast("int").cast("string"))
    obs = _observations(spark, d).withColumn("run_id", hour)
    return E.data_gaps(obs, obs)


def failure_hints(spark, d):
    failed = _observations(spark, d).where("status <> 'ok'").select(
        "run_id", "seq", "tool", F.get_json_object("args", "$.ticker").alias("ticker"),
        F.when(F.col("duration_ms") > 50, F.array(F.lit("get_price_data"), F.lit("web_search")))
        .otherwise(F.array(F.lit("get_news"))).alias("available"),
    )
    return E.failure_hints(failed)


def supported_evidence(spark, d):
    return E.supported_evidence(_evidence(spark, d), _observations(spark, d)).select("run_id", "seq", "risk", "source_tool", "fact")


def dropped_evidence(spark, d):
    out = E.dropped_evidence(_evidence(spark, d), _quick_is_empty(_observations(spark, d), 60))
    return out.select("run_id", "seq", "risk", "warning")


def unsupported_risks(spark, d):
    return E.unsupported_risks(_evidence(spark, d), _quick_is_empty(_observations(spark, d), 60))


def numbered_observations(spark, d):
    out = E.numbered_observations(_observations(spark, d))
    read = lambda path: F.get_json_object("line", f"$.{path}")
    return out.select(
        "run_id", "call", read("call").cast("bigint").alias("in_line"), read("args").alias("args"), read("tool").alias("tool"), read("status").alias("status"),
        F.round(read("duration_ms").cast("double"), 3).alias("duration_ms"), F.array_join(F.json_object_keys("line"), ",").alias("fields"),
    )


def tool_results(spark, d):
    out = E.tool_result(_observations(spark, d))
    return out.select(
        "run_id", "seq", F.get_json_object("result", "$.status").alias("status"),
        F.get_json_object("result", "$.data.n").cast("bigint").alias("n"),
        F.get_json_object("result", "$.error").alias("error"),
        F.get_json_object("result", "$.warnings[1]").alias("second_warning"),
    )


def parsed_trace_lines(spark, d):
    """Trace rows written as JSON text and read back, with blank and broken lines in between."""
    trace = D.trace(spark, d)
    text = F.when(F.col("seq") % 50 == 0, F.lit("  ")).when(F.col("seq") % 50 == 1, F.lit('{"ts": ')).otherwise(F.to_json(F.struct(*trace.columns)))
    lines = trace.select(F.col("seq").alias("line_no"), text.alias("value"))
    return parse_lines(lines, TRACE_SCHEMA).select(
        "line_no", "run_id", "event", "tool", "duration_ms", F.col("_corrupt_record").isNotNull().alias("broken")
    )


TRACE = """ev AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
ev2 AS (SELECT *, CASE WHEN event_type = 'view' THEN 'agent_turn' WHEN event_type = 'signup' AND k < 50 THEN 'handoff'
    WHEN event_type = 'signup' AND k < 70 THEN 'critique' WHEN event_type = 'signup' THEN 'cache' ELSE 'tool_call' END AS event FROM ev),
ev3 AS (SELECT *, CASE WHEN event = 'tool_call' THEN CASE WHEN k < 20 THEN 'get_price_data' WHEN k < 45 THEN 'calculate_volatility'
      WHEN k < 60 THEN 'get_news' WHEN k < 85 THEN 'llm_sentiment' ELSE 'web_search' END END AS tool,
    CASE WHEN event = 'tool_call' THEN CASE WHEN event_type = 'error' THEN 'error' WHEN value < 2 THEN 'empty' ELSE 'ok' END END AS status FROM ev2),
tr AS (SELECT ts, CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, event, k, props,
    CASE WHEN event IN ('tool_call', 'agent_turn') THEN CASE WHEN k % 2 = 0 THEN 'A' ELSE 'B' END END AS agent, tool,
    CASE WHEN event = 'tool_call' AND k <> 33 THEN '{"ticker": "t' || k || '"}' END AS args,
    CASE WHEN event = 'tool_call' AND value > 20 THEN 'checking' END AS why, status,
    CASE WHEN event = 'tool_call' THEN CASE WHEN status = 'error' AND k < 5 THEN 'injected failure: ' || tool ELSE 'result ' || props END END AS output,
    CASE WHEN event = 'tool_call' THEN value END AS duration_ms,
    CASE WHEN event = 'tool_call' THEN event_type = 'click' AND k % 10 = 0 END AS cache_hit,
    CASE WHEN event = 'agent_turn' THEN event_id END AS turn,
    CASE WHEN event = 'agent_turn' AND k <> 7 THEN k END AS tokens,
    CASE WHEN event IN ('handoff', 'critique') THEN CASE WHEN k % 2 = 0 THEN 'A' ELSE 'B' END END AS sender,
    CASE WHEN event IN ('handoff', 'critique') THEN CASE WHEN k % 2 = 0 THEN 'B' ELSE 'A' END END AS receiver,
    CASE WHEN event = 'handoff' THEN 'DataBrief' WHEN event = 'critique' THEN CASE WHEN k % 2 = 0 THEN 'ClarificationRequest' ELSE 'ClarificationResponse' END END AS msg,
    CASE WHEN event = 'cache' THEN CASE WHEN k < 80 THEN 'hit' WHEN k < 90 THEN 'miss' ELSE 'save' END END AS action,
    CASE WHEN event = 'cache' THEN 'runs/cache/C' || k || '_2024-01-01.json' END AS path,
    CASE WHEN event = 'cache' AND k BETWEEN 80 AND 89 THEN 'no file' END AS reason
  FROM ev3)"""
W = f"WITH {TRACE}"
RUN = """CASE WHEN bool_or(event = 'handoff') THEN '3B pipeline'
      WHEN bool_and(event = 'cache') THEN CASE WHEN bool_or(action = 'hit') THEN '3B cache hit' ELSE '3B cache lookup' END
      WHEN bool_or(event = 'agent_turn') THEN '3A research agent' ELSE 'Direct tool calls' END
    || coalesce(' (' || string_agg(DISTINCT CASE WHEN output LIKE '%injected failure%' THEN tool END, ', ' ORDER BY CASE WHEN output LIKE '%injected failure%' THEN tool END) || ' failing)', '')"""
TICKER = """coalesce(arg_min(CASE WHEN event = 'tool_call' AND k <> 33 THEN 'T' || k END, seq), arg_min(CASE WHEN event = 'cache' THEN 'C' || k END, seq))"""
HOURLY = f"{W}, h AS (SELECT * REPLACE (run_id || '-' || strftime(ts, '%Y%m%d%H') AS run_id) FROM tr)"
EVID = f"""{W}, obs AS (SELECT * FROM tr WHERE event = 'tool_call'), ev9 AS (SELECT run_id, seq, CASE k % 3 WHEN 0 THEN 'Trend' WHEN 1 THEN 'Volatility' ELSE 'News' END AS risk,
    (['get_price_data','calculate_volatility','get_news','llm_sentiment','web_search'])[k % 5 + 1] AS source_tool, 'fact ' || k AS fact FROM tr WHERE event IN ('handoff', 'critique'))"""

QUERIES = {
    "tool_stats": tool_stats,
    "run_tool_stats": run_tool_stats,
    "run_summaries": run_summaries,
    "runs_table": runs_table,
    "run_labels": run_labels,
    "run_tickers": run_tickers,
    "timelines": timelines,
    "agent_messages": agent_messages,
    "timeline_rows": timeline_rows,
    "run_steps": run_steps,
    "stored_outputs": stored_outputs,
    "replan_cycles": replan_cycles,
    "call_log_rollup": call_log_rollup,
    "trace_totals": trace_totals,
    "event_counts": event_counts,
    "event_pivot": event_pivot,
    "agent_tool_crosstab": agent_tool_crosstab,
    "result_durations": result_durations,
    "side_by_side_runs": side_by_side_runs,
    "latest_usable_results": latest_usable_results,
    "usable_tools": usable_tools,
    "data_gaps": data_gaps,
    "failure_hints": failure_hints,
    "supported_evidence": supported_evidence,
    "dropped_evidence": dropped_evidence,
    "unsupported_risks": unsupported_risks,
    "numbered_observations": numbered_observations,
    "tool_results": tool_results,
    "parsed_trace_lines": parsed_trace_lines,
}

STATS = """count(*) AS calls, count(*) FILTER (status = 'ok') AS ok, round(avg(duration_ms), 1) AS mean_ms, round(max(duration_ms), 1) AS max_ms, count(*) FILTER (cache_hit) AS cache_hits"""
_TOOLS = "(VALUES (0, 'get_price_data'), (1, 'calculate_volatility'), (2, 'get_news'), (3, 'llm_sentiment'), (4, 'web_search')) t(tool_no, tool)"

ORACLE = {
    "tool_stats": f"{W} SELECT tool, {STATS} FROM tr WHERE event = 'tool_call' GROUP BY tool",
    "run_tool_stats": f"{W} SELECT run_id, tool, {STATS} FROM tr WHERE event = 'tool_call' GROUP BY run_id, tool",
    "run_summaries": f"""{W} SELECT run_id, count(*) FILTER (event = 'tool_call') AS tool_calls, count(*) FILTER (event = 'tool_call' AND status <> 'ok') AS problems,
      round(coalesce(sum(duration_ms), 0) / 1000, 1) AS tool_seconds, count(*) FILTER (event = 'agent_turn') AS model_turns, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens,
      count(*) FILTER (cache_hit OR action = 'hit') AS cache_hits FROM tr GROUP BY run_id""",
    "runs_table": f"""{W} SELECT run_id, min(seq) AS first_seq, {RUN} AS label, {TICKER} AS ticker, arg_min(ts, seq) AS started,
      count(*) FILTER (event = 'tool_call') AS tool_calls, count(*) FILTER (event = 'tool_call' AND status <> 'ok') AS problems FROM tr GROUP BY run_id""",
    "run_labels": f"{HOURLY} SELECT run_id, {RUN} AS label FROM h GROUP BY run_id",
    "run_tickers": f"{HOURLY} SELECT run_id, {TICKER} AS ticker FROM h GROUP BY run_id",
    "timelines": f"""{W} SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS call, agent, tool, agent || ' · ' || tool AS row, status,
      ts - to_microseconds(CAST(round(duration_ms * 1000) AS BIGINT)) AS start, ts AS "end", duration_ms, coalesce(why, '') AS why FROM tr WHERE event = 'tool_call'""",
    "agent_messages": f"""{W} SELECT run_id, seq, ts AS at, sender AS agent, 'messages A <-> B' AS row, sender || ' -> ' || receiver || ': ' || msg AS message,
      sender || '->' || receiver || ' ' || CASE msg WHEN 'DataBrief' THEN 'brief' WHEN 'ClarificationRequest' THEN 'request' ELSE 'answer' END AS short FROM tr WHERE event IN ('handoff', 'critique')""",
    "timeline_rows": f"""{W} SELECT run_id, agent || ' · ' || tool AS row, CASE agent WHEN 'A' THEN 3 ELSE 4 END AS lane, agent, min(seq) AS first_seq FROM tr WHERE event = 'tool_call' GROUP BY run_id, agent, tool
      UNION ALL SELECT run_id, 'messages A <-> B', 6, '', min(seq) FROM tr WHERE event IN ('handoff', 'critique') GROUP BY run_id""",
    "run_steps": f"""{W} SELECT run_id, seq, event AS kind, ts AS time, CASE event
        WHEN 'tool_call' THEN '[' || agent || '] ' || tool || ' -> ' || status || ' (' || CAST(round(duration_ms) AS BIGINT) || ' ms)'
        WHEN 'agent_turn' THEN '[' || agent || '] turn ' || turn || ': answers in text'
        WHEN 'cache' THEN 'cache ' || action || coalesce(': ' || reason, '') ELSE sender || ' -> ' || receiver || ': ' || msg END AS title FROM tr""",
    "stored_outputs": f"{W} SELECT run_id, seq, repeat(output, 12) AS output, left(repeat(output, 12), 200) AS output_preview, 12 * length(output) AS output_chars FROM tr WHERE event = 'tool_call'",
    "replan_cycles": f"""{W}, t AS (SELECT *, sum(CASE WHEN event = 'agent_turn' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, agent ORDER BY seq) AS n FROM tr WHERE event IN ('agent_turn', 'tool_call')),
      g AS (SELECT run_id, agent, n, max(turn) AS turn, count(*) FILTER (event = 'tool_call') AS c FROM t WHERE n > 0 GROUP BY ALL),
      p AS (SELECT a.run_id, a.agent, a.n, b.turn FROM g a JOIN g b ON a.run_id = b.run_id AND a.agent = b.agent AND b.n = a.n + 1 WHERE a.c > 0 AND b.c > 0)
      SELECT t.run_id, t.agent, p.turn, 'observed' AS side, t.seq, t.tool, t.status FROM t JOIN p ON p.run_id = t.run_id AND p.agent = t.agent AND p.n = t.n WHERE t.event = 'tool_call'
      UNION ALL SELECT t.run_id, t.agent, p.turn, 'chose', t.seq, t.tool, t.status FROM t JOIN p ON p.run_id = t.run_id AND p.agent = t.agent AND p.n + 1 = t.n WHERE t.event = 'tool_call'""",
    "call_log_rollup": """WITH l AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)
      SELECT event_type AS prompt, CASE WHEN k < 40 THEN 'first' WHEN k < 80 THEN 'second' END AS provider, CASE WHEN value > 5 THEN 'ok' ELSE 'repaired' END AS outcome,
        count(*) AS requests, CAST(sum(CASE WHEN k < 80 THEN 1 + k % 3 END) AS BIGINT) AS attempts, CAST(sum(k % 2) AS BIGINT) AS sdk_retries,
        round(avg(CASE WHEN k < 80 THEN floor(value * 10) END), 0) AS mean_latency_ms, CAST(sum(CASE WHEN k < 80 THEN k * 10 END) AS BIGINT) AS prompt_tokens,
        CAST(sum(CASE WHEN k < 60 THEN k END) AS BIGINT) AS completion_tokens FROM l GROUP BY ALL""",
    "trace_totals": f"{W} SELECT CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, count(*) FILTER (event = 'tool_call') AS tool_calls, max(length(output)) AS longest_output FROM tr",
    "event_counts": f"{W} SELECT event, count(*) AS events FROM tr GROUP BY event",
    "event_pivot": f"{W} SELECT run_id, " + ", ".join(f"count(*) FILTER (event = '{k}') AS {k}" for k in KINDS) + " FROM tr GROUP BY run_id",
    "agent_tool_crosstab": f"{W} SELECT agent, " + ", ".join(f"count(*) FILTER (tool = '{t}') AS {t}" for t in TOOLS) + " FROM tr WHERE event = 'tool_call' GROUP BY agent",
    "result_durations": f"""{W}, l AS (SELECT run_id, tool, arg_max(duration_ms, seq) AS duration_ms FROM tr WHERE event = 'tool_call' GROUP BY run_id, tool)
      SELECT r.run_id, t.tool, l.duration_ms FROM (SELECT DISTINCT run_id FROM tr) r CROSS JOIN {_TOOLS} LEFT JOIN l ON l.run_id = r.run_id AND l.tool = t.tool""",
    "side_by_side_runs": f"""{W}, n AS (SELECT run_id, agent, tool, row_number() OVER (PARTITION BY run_id, agent ORDER BY seq) AS call FROM tr WHERE event = 'tool_call')
      SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.call, b.call) AS call, coalesce(a.tool, '') AS left_tool, coalesce(b.tool, '') AS right_tool
      FROM (SELECT * FROM n WHERE agent = 'A') a FULL JOIN (SELECT * FROM n WHERE agent = 'B') b ON a.run_id = b.run_id AND a.call = b.call""",
    "latest_usable_results": f"""{W} SELECT run_id, tool, max(seq) AS seq, '{{"n":' || max(seq) || ',"ms":' || arg_max(duration_ms, seq) || '}}' AS data FROM tr WHERE status = 'ok' GROUP BY run_id, tool""",
    "usable_tools": f"""{W}, f AS (SELECT run_id, tool, min(seq) AS s FROM tr WHERE status = 'ok' GROUP BY run_id, tool) SELECT run_id, string_agg(tool, ',' ORDER BY s) AS tools FROM f GROUP BY run_id""",
    "data_gaps": f"""{W}, o AS (SELECT *, run_id || '-' || CAST(floor(seq / 20) AS INT) AS r FROM tr WHERE event = 'tool_call'),
      c AS (SELECT r, tool, count(*) FILTER (status = 'ok') AS ok, arg_max(status, seq) AS st, arg_max(CASE WHEN status = 'error' THEN output WHEN status = 'empty' THEN 'slow; ' || tool ELSE 'no detail' END, seq) AS pr FROM o GROUP BY r, tool)
      SELECT a.r AS run_id, t.tool_no, t.tool, CASE WHEN c.ok IS NULL THEN t.tool || ' was not called' ELSE t.tool || ' returned no usable result (' || st || ': ' || pr || ')' END AS gap
      FROM (SELECT DISTINCT r FROM o) a CROSS JOIN {_TOOLS} LEFT JOIN c ON c.r = a.r AND c.tool = t.tool WHERE coalesce(c.ok, 0) = 0""",
    "failure_hints": f"""{W}, f AS (SELECT run_id, seq, tool, CASE WHEN k <> 33 THEN 'T' || k ELSE 'THE TICKER' END AS t, duration_ms > 50 AS wide FROM tr WHERE event = 'tool_call' AND status <> 'ok')
      SELECT run_id, seq, tool, CASE tool
        WHEN 'get_price_data' THEN 'Check that ' || t || ' is a valid Yahoo Finance symbol; calculate_volatility reads the same prices. ' || CASE WHEN wide THEN 'Alternatives: web_search: search ''' || t || ' stock price performance'' to describe recent moves in words.' ELSE n.x END
        WHEN 'calculate_volatility' THEN 'A shorter window needs less history. ' || CASE WHEN wide THEN 'Alternatives: get_price_data: its indicators include hv_30, the 30-day annualised volatility; web_search: search ''' || t || ' implied volatility''.' ELSE n.x END
        WHEN 'get_news' THEN CASE WHEN wide THEN 'Alternatives: web_search: search ''' || t || ' stock news this week'' for recent headlines.' ELSE n.x END
        WHEN 'llm_sentiment' THEN CASE WHEN wide THEN 'Alternatives: web_search: search for analyst commentary on ' || t || ' and judge its tone from the snippets.' ELSE n.x END
        ELSE 'Try a shorter or differently worded query. ' || CASE WHEN wide THEN n.x ELSE 'Alternatives: get_news: use recent headlines for ' || t || ' as commentary instead.' END END AS hint
      FROM f, (SELECT 'No other tool you have can supply this; record it as a data gap and continue with what you have.' AS x) n""",
    "supported_evidence": f"{EVID} SELECT * FROM ev9 WHERE (run_id, source_tool) IN (SELECT (run_id, tool) FROM obs WHERE status = 'ok')",
    "dropped_evidence": f"""{EVID} SELECT run_id, seq, risk, 'dropped evidence for ''' || risk || ''' citing ' || source_tool || ', which returned no usable result: ''' || fact || '''' AS warning FROM ev9
      WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.run_id = ev9.run_id AND o.tool = ev9.source_tool AND o.status = 'ok' AND o.duration_ms > 60)""",
    "unsupported_risks": f"""{EVID}, ok AS (SELECT DISTINCT run_id, tool FROM obs WHERE status = 'ok' AND duration_ms > 60)
      SELECT e.run_id, risk, 'risk ''' || risk || ''' has no supporting evidence left' AS warning FROM ev9 e LEFT JOIN ok ON ok.run_id = e.run_id AND ok.tool = e.source_tool
      GROUP BY e.run_id, risk HAVING count(ok.tool) = 0""",
    "numbered_observations": f"{W} SELECT run_id, row_number() OVER w AS call, row_number() OVER w AS in_line, replace(args, ': ', ':') AS args, tool, status, CASE WHEN duration_ms > 10 THEN round(duration_ms, 3) END AS duration_ms, 'call,args,tool,status' || CASE WHEN duration_ms > 10 THEN ',duration_ms' ELSE '' END AS fields FROM tr WHERE event = 'tool_call' WINDOW w AS (PARTITION BY run_id ORDER BY seq)",
    "tool_results": f"""{W} SELECT run_id, seq, status, CASE WHEN status = 'ok' THEN seq END AS n, CASE WHEN status = 'error' THEN output END AS error, CASE WHEN status = 'empty' THEN tool END AS second_warning FROM tr WHERE event = 'tool_call'""",
    "parsed_trace_lines": f"""{W} SELECT seq AS line_no, CASE WHEN seq % 50 <> 1 THEN run_id END AS run_id, CASE WHEN seq % 50 <> 1 THEN event END AS event, CASE WHEN seq % 50 <> 1 THEN tool END AS tool,
      CASE WHEN seq % 50 <> 1 THEN duration_ms END AS duration_ms, seq % 50 = 1 AS broken FROM tr WHERE seq % 50 <> 0""",
}
