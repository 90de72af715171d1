"""Trace views, observations and the order-dependent helpers."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerloom.operators import evidence as E
from ledgerloom.operators import ordered as O
from ledgerloom.operators import traces as T
from ledgerloom.schemas import TRACE_SCHEMA
from ledgerloom.streaming import live as L
from ledgerloom.sources.jsonl import read_jsonl, split_corrupt, write_jsonl

KINDS = {"duration_ms": float, "turn": int, "tokens": int, "cache_hit": lambda x: x == "yes"}


def log(spark, table):
    """A trace from a table of text: column names first, then one event a line, second by second; ``-`` is no value."""
    head, *lines = [[cell.strip() for cell in line.split(";")] for line in table.strip().split("\n")]
    data = []
    for seq, line in enumerate(lines):
        cells = {name: KINDS.get(name, str)(cell) for name, cell in zip(head, line, strict=True) if cell != "-"}
        data.append({f.name: None for f in TRACE_SCHEMA.fields} | {"ts": datetime(2026, 3, 2, 9) + timedelta(seconds=seq), "seq": seq} | cells)
    return spark.createDataFrame(data, TRACE_SCHEMA)


def test_run_labels_and_tickers(spark):
    df = log(spark, """
        run_id; event;      agent;  tool;       status; output; args; sender; receiver; schema; action; path; reason; tokens; turn
        plain;  tool_call;  direct; web_search; ok;     x; {"ticker": "nvda"}; -; -; -; -; -; -; -; -
        broken; tool_call;  single; web_search; error;  injected failure: web_search is in failing_tools; -; -; -; -; -; -; -; -; -
        duo;    handoff;    -;      -;          -;      -; -; A; B; DataBrief; -; -; -; -; -
        cached; cache;      -;      -;          -;      -; -; -; -; -; hit; /store/TSLA_2026-03-02.json; -; -; -
        absent; cache;      -;      -;          -;      -; -; -; -; -; miss; ; no file; -; -
        talk;   agent_turn; A;      -;          -;      -; -; -; -; -; -; -; -; 5; 1
    """)
    got = {r.run_id: (r.label, r.ticker, r.tool_calls, r.problems) for r in T.runs_table(df).collect()}
    assert got == {
        "plain": ("Direct tool calls", "NVDA", 1, 0),
        "broken": ("3A research agent (web_search failing)", None, 1, 1),
        "duo": ("3B pipeline", None, 0, 0),
        "cached": ("3B cache hit", "TSLA", 0, 0),
        "absent": ("3B cache lookup", None, 0, 0),
        "talk": ("3A research agent", None, 0, 0),
    }


def test_summary_timeline_steps_and_order(spark, rows):
    df = log(spark, """
        run_id; event;      agent; tool;       status; duration_ms; cache_hit; sender; receiver; schema; step; generated_by; hedge; action; reason; turn; tokens
        r;      agent_turn; B;     -;          -;      -;    -;   -; -; -; -; -; -; -; -; 1; 10
        r;      tool_call;  B;     get_news;   ok;     1500; no;  -; -; -; -; -; -; -; -; -; -
        r;      tool_call;  A;     web_search; empty;  20;   no;  -; -; -; -; -; -; -; -; -; -
        r;      tool_call;  B;     get_news;   ok;     4;    yes; -; -; -; -; -; -; -; -; -; -
        r;      handoff;    -;     -;          -;      -;    -;   A; B; DataBrief; -; -; -; -; -; -; -
        r;      critique;   -;     -;          -;      -;    -;   B; A; -; request; -; -; -; -; -; -
        r;      report;     B;     -;          -;      -;    -;   -; -; -; -; llm; collar; -; -; -; -
        r;      cache;      -;     -;          -;      -;    -;   -; -; -; -; -; -; hit; why; -; -
    """)
    assert rows(T.run_summary(df)) == [("r", 3, 1, 1.5, 1, 10, 2)]
    line = T.timeline(df).orderBy("call").collect()
    assert [(x.call, x.row) for x in line] == [(1, "B · get_news"), (2, "A · web_search"), (3, "B · get_news")]
    assert (line[0].end - line[0].start).total_seconds() == 1.5
    assert [x.title for x in T.steps(df).orderBy("seq").collect()] == [
        "[B] turn 1: answers in text", "[B] get_news -> ok (1,500 ms)", "[A] web_search -> empty (20 ms)", "[B] get_news -> ok (4 ms)",
        "A -> B: DataBrief", "B -> A: ClarificationRequest", "[B] report written by llm, hedge collar", "cache hit: why",
    ]
    order = [x.row for x in T.row_order(df).orderBy("lane", "agent", "first_seq").collect()]
    assert order == ["A · web_search", "B · get_news", "messages A <-> B"]
    assert [x.short for x in T.messages(df).orderBy("seq").collect()] == ["A->B brief", "B->A request"]


def test_replan_cycles(spark, rows):
    """Calls before any turn and turns without calls make no cycle; agents don't mix."""
    df = log(spark, """
        run_id; event;      agent; tool; turn
        r;      tool_call;  A;     t;    -
        r;      agent_turn; A;     -;    1
        r;      tool_call;  A;     t;    -
        r;      tool_call;  B;     t;    -
        r;      tool_call;  A;     u;    -
        r;      agent_turn; A;     -;    2
        r;      agent_turn; B;     -;    1
        r;      tool_call;  A;     t;    -
        r;      tool_call;  B;     t;    -
        r;      agent_turn; A;     -;    3
        r;      agent_turn; A;     -;    4
        r;      tool_call;  A;     t;    -
        r;      agent_turn; B;     -;    2
    """)
    assert rows(T.replan_cycles(df), "agent", "turn", "side", "seq") == [("A", 2, "chose", 7), ("A", 2, "observed", 2), ("A", 2, "observed", 4)]


CYCLES = """WITH n AS (SELECT *, sum(if(event = 'agent_turn', 1, 0)) OVER (PARTITION BY run_id, agent ORDER BY seq) AS n FROM events),
    c AS (SELECT run_id, agent, n, turn FROM n WHERE event = 'agent_turn'), t AS (SELECT * FROM n WHERE event = 'tool_call' AND n > 0),
    pairs AS (SELECT c.* FROM c LEFT SEMI JOIN t a ON a.run_id = c.run_id AND a.agent = c.agent AND a.n = c.n LEFT SEMI JOIN t b ON b.run_id = c.run_id AND b.agent = c.agent AND b.n = c.n - 1)
    SELECT t.run_id, t.agent, p.turn, if(t.n = p.n, 'chose', 'observed') AS side, t.seq FROM t JOIN pairs p ON p.run_id = t.run_id AND p.agent = t.agent AND t.n IN (p.n, p.n - 1)"""


def test_replan_cycles_for_any_block_size(spark, rows):
    draw = random.Random(3)
    lines = ["run_id; event; agent; tool; turn"]
    for k in range(300):
        run, agent = ("hot" if draw.random() < 0.7 else f"r{draw.randrange(4)}"), draw.choice("AB")
        lines.append(f"{run}; agent_turn; {agent}; -; {k}" if draw.random() < 0.4 else f"{run}; tool_call; {agent}; t; -")
    df = log(spark, "\n".join(lines))
    df.createOrReplaceTempView("events")
    want = rows(spark.sql(CYCLES), "run_id", "agent", "turn", "side", "seq")
    assert want
    for block in (7, 64, 65_536):
        assert rows(T.replan_cycles(df, block), "run_id", "agent", "turn", "side", "seq") == want


def test_positions_and_ranks_do_not_depend_on_blocks(spark, rows):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("key"), (F.col("id") * 7 - 3000).alias("seq"))
    one = rows(O.with_position(df, ["key"], "n", block=10), "key", "seq", "n")
    two = rows(O.with_position(df, ["key"], "n"), "key", "seq", "n")
    assert one == two
    digest = F.md5(F.col("seq").cast("string"))
    small = rows(O.with_hash_rank(df, ["key"], digest, "seq", "r", 2), "key", "seq", "r", "r_of")
    assert small == rows(O.with_hash_rank(df, ["key"], digest, "seq", "r", 4096), "key", "seq", "r", "r_of")


def test_exact_quantiles_match_the_built_in(spark):
    df = spark.range(997).select((F.col("id") % 4).alias("k"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pow(F.col("id") % 101, 2.0)).alias("x"))
    want = {(r.k, q): v for r in df.groupBy("k").agg(F.expr("percentile(x, array(0.0, 0.25, 0.5, 0.9, 1.0))").alias("p")).collect() for q, v in zip((0.0, 0.25, 0.5, 0.9, 1.0), r.p, strict=True)}
    for bins in (1, 3, 128):
        got = {(r.k, r.fraction): r.value for r in O.exact_quantiles(df, ["k"], "x", [0.0, 0.25, 0.5, 0.9, 1.0], bins).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_call_log_keeps_null_groups(spark):
    schema = "prompt string, provider string, outcome string, attempts long, sdk_retries long, latency_ms double, prompt_tokens long, completion_tokens long"
    df = spark.createDataFrame([("p", None, "fallback", None, None, 0.0, None, None), ("p", "x", "ok", 1, 0, 700.0, 5, 6)], schema)
    assert {(r.provider, r.requests) for r in T.call_log_rollup(df).collect()} == {(None, 1), ("x", 1)}


def observations(spark, *data):
    schema = "run_id string, seq long, tool string, args string, status string, digest string, data string, error string, warnings array<string>"
    return spark.createDataFrame([("r", i, t, "{}", s, None, d, e, w) for i, (t, s, d, e, w) in enumerate(data)], schema)


def test_gaps_evidence_and_hints(spark):
    obs = observations(
        spark, ("get_news", "error", None, "boom", []), ("get_price_data", "ok", "{}", None, []), ("web_search", "empty", None, None, ["no hits", "slow"]),
        ("get_price_data", "error", None, "late", []),
    )
    gaps = {r.tool: r.gap for r in E.data_gaps(obs, obs).collect()}
    assert gaps == {
        "get_news": "get_news returned no usable result (error: boom)",
        "calculate_volatility": "calculate_volatility was not called",
        "llm_sentiment": "llm_sentiment was not called",
        "web_search": "web_search returned no usable result (empty: no hits; slow)",
    }
    assert E.ok_tools(obs).first().tools == ["get_price_data"]
    cited = spark.createDataFrame([("r", "Trend", "get_price_data", "f"), ("r", "News", "get_news", "g")], "run_id string, risk string, source_tool string, fact string")
    assert [r.fact for r in E.supported_evidence(cited, obs).collect()] == ["f"]
    assert E.dropped_evidence(cited, obs).first().warning == "dropped evidence for 'News' citing get_news, which returned no usable result: 'g'"
    assert E.unsupported_risks(cited, obs).first().risk == "News"
    failed = spark.createDataFrame([("r", 1, "calculate_volatility", " aapl ", ["web_search"]), ("r", 2, "get_news", None, [])], "run_id string, seq long, tool string, ticker string, available array<string>")
    hints = [r.hint for r in E.failure_hints(failed).orderBy("seq").collect()]
    assert hints[0] == "A shorter window needs less history. Alternatives: web_search: search 'AAPL implied volatility'."
    assert hints[1].startswith("No other tool you have can supply this")


def test_jsonl_files(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    (path / "a.jsonl").write_text('{"run_id": "a", "event": "cache", "seq": 1}\n\n{"run_id": "b"\n{"run_id": "b", "tokens": 3, "extra": 1}\n')
    good, bad = split_corrupt(read_jsonl(spark, str(path), TRACE_SCHEMA).cache())
    assert sorted(r.run_id for r in good.collect()) == ["a", "b"] and bad.count() == 1
    assert read_jsonl(spark, str(path), TRACE_SCHEMA, "a").count() == 1
    assert read_jsonl(spark, str(tmp_path / "none"), TRACE_SCHEMA).count() == 0
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("1", "train"), ("2", "val")], "id string, split string")
    write_jsonl(df, out, ["split"])
    write_jsonl(df.where("split = 'val'").withColumn("id", F.lit("3")), out, ["split"])
    write_jsonl(df.where("split = 'val'").withColumn("id", F.lit("4")), out, ["split"], append=True)
    assert sorted(r.id for r in read_jsonl(spark, out, df.schema).collect()) == ["1", "3", "4"]


def test_numbered_observations_merge_the_digest(spark):
    rows = [("r", 1, "t", '{"n": 3}', "ok", '{"tool": "t", "a": [1]}'), ("r", 2, "u", "n \"3\"", "error", None), ("r", 3, "u", None, "ok", "{}"), ("r", 4, "u", "1", "ok", "no json")]
    got = E.numbered_observations(spark.createDataFrame(rows, "run_id string, seq long, tool string, args string, status string, digest string"))
    assert [json.loads(r["line"]) for r in got.orderBy("call").collect()] == [
        {"call": 1, "args": {"n": 3}, "tool": "t", "a": [1]}, {"call": 2, "args": 'n "3"', "tool": "u", "status": "error"}, {"call": 3, "args": None}, {"call": 4, "args": 1, "tool": "u", "status": "ok"},
    ]


def test_snapshot_upserts_keep_the_newest_run_whatever_comes_last(spark, tmp_path):
    schema = "ticker string, as_of date, k int, text string"
    batches = [[("A", 5, "new"), ("B", 1, "b")], [("A", 3, "old"), ("C", 1, "c")], [("A", 5, "new"), ("B", 2, None)]]
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "ticker string, k int, text string").select("ticker", F.to_date(F.lit("2026-01-05")).alias("as_of"), "k", "text")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        runs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        L.upsert_snapshots(runs, str(tmp_path / "table"), str(tmp_path / "checkpoint"), "k").awaitTermination()
    table = spark.read.schema(schema).parquet(str(tmp_path / "table"))
    assert {(r["ticker"], r["k"], r["text"]) for r in table.collect()} == {("A", 5, "new"), ("B", 2, None), ("C", 1, "c")}


def test_tool_stats_of_a_run_add_in_order(spark):
    """durations whose mean is near a half; added in the order of seq they always give the same mean."""
    durations = [93.11, 168.16, 181.31, 8.06, 13.11, 168.28, 9.52]
    schema = "run_id string, seq bigint, event string, tool string, status string, duration_ms double, cache_hit boolean"
    rows = [("t", i, "tool_call", "web_search", "ok", x, False) for i, x in enumerate(durations)]
    for dealt in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(dealt, schema)
        assert T.tool_stats(df.coalesce(1), ["run_id"]).first().mean_ms == T.tool_stats(df.repartition(4), ["run_id"]).first().mean_ms == 91.6
    calls = [("t", i, "tool_call", "web_search", "ok", x, False) for i, x in enumerate([58.949999999999996] * 2)]
    assert T.tool_stats(spark.createDataFrame(calls, schema), ["run_id"]).first().mean_ms == 59.0
