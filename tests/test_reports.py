"""Record checks, fallbacks, Markdown, snapshots and the streaming forms."""

from datetime import date, datetime

from pyspark.sql import functions as F

from ledgerloom.operators import reports as R
from ledgerloom.sources import snapshots
from ledgerloom.streaming import live as L
from registered import reports as Q

SF = "/root/testdata/sf0.001"


def test_placeholder_when_the_answer_breaks_a_rule(spark):
    answers = spark.createDataFrame(
        [("A", "Buy", "One up. Two up. Three up.", ["x", "y"]), ("B", "Buy", "Short.", ["x", "y"]), ("C", "Maybe", "One. Two. Three.", ["x"])],
        "ticker string, recommendation string, justification string, key_factors array<string>",
    )
    checked = {r.ticker: r.violations for r in R.check_recommendations(answers).collect()}
    assert checked == {
        "A": [], "B": ["sentences: 1, wanted between 3 and 5"],
        "C": ["unknown recommendation Maybe", "key factors: 1, wanted between 2 and 4"],
    }
    tickers = spark.createDataFrame([("A",), ("B",), ("Z",)], "ticker string")
    assert {r.ticker: (r.recommendation, r.ok) for r in R.with_placeholder(tickers, answers).collect()} == {
        "A": ("Buy", True), "B": ("Hold", False), "Z": ("Hold", False)
    }


def test_documents(spark):
    text = {r.ticker: r.markdown for r in Q.report_documents(spark, SF).collect()}
    assert text["Z"].startswith("# Z research report (")
    assert "> Not written by the LLM: no price data came back" in text["Z"]
    assert "- sell shares\n" in text["Z"] and "**Trim And Stop**" in text["Z"]
    assert "_(source: " not in text["Z"] and "- get_price_data was not called" in text["Z"]  # no tool returned anything for it
    assert all("source: " not in line or "no usable result" not in line for x in text.values() for line in x.split("\n"))
    assert "- buy put at " in text["A"] and "(bb_lower)" in text["A"] and "Expected 63-trading-day move: ±" in text["A"]
    briefs = {r.ticker: r.markdown for r in Q.market_briefs(spark, SF).collect()}
    assert briefs["N"].startswith("# Flag N (N): equity research brief\n\nGenerated 2024-02-01 00:00 UTC · market data as of 200")
    assert "## Recommendation: Hold over the next 90 days\n\n> **Placeholder:**" in briefs["N"]
    assert "**Sentiment score: " in briefs["A"] and "\n1. **" in briefs["A"]
    assert "- Close: " in briefs["A"] and briefs["A"].rstrip().endswith("investment decision.")


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    schema = "ticker string, as_of date, schema_version int, generated_by string, payload string"
    day = date(2026, 10, 7)
    first = spark.createDataFrame([("AAPL", day, 1, "llm", "one"), ("MSFT", day, 0, "llm", "old"), ("TMPL", day, 1, "template", "x"), ("BAD", day, 1, "llm", None)], schema)
    assert snapshots.read_snapshots(spark, path, first.schema).count() == 0
    snapshots.save_snapshots(first, path)
    snapshots.save_snapshots(first.where("ticker = 'AAPL'").withColumn("payload", F.lit("two")), path)
    stored = snapshots.read_snapshots(spark, path, first.schema)
    wanted = spark.createDataFrame([(t, day, f) for t, f in (("aapl", False), ("msft", False), ("tmpl", False), ("bad", False), ("aapl", True))], "ticker string, as_of date, force_refresh boolean")
    got = sorted((r.ticker, r.action, r.reason or "", r.payload or "") for r in snapshots.lookup(wanted, stored).collect())
    assert got == [
        ("AAPL", "hit", "", "two"), ("AAPL", "skip", "force_refresh", ""), ("BAD", "miss", "unreadable", ""),
        ("MSFT", "miss", "schema version 0, expected 1", ""), ("TMPL", "miss", "no file", ""),
    ]
    assert sorted(r.ticker for r in snapshots.to_recompute(wanted, stored).collect()) == ["AAPL", "BAD", "MSFT", "TMPL"]


def test_live_replan_cycles_across_micro_batches(spark, tmp_path):
    """The same cycles come out when the events arrive one file at a time."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    lines = [
        '{"run_id": "r", "agent": "A", "event": "tool_call", "seq": 0, "tool": "early"}',
        '{"run_id": "r", "agent": "A", "event": "agent_turn", "seq": 1, "turn": 1}',
        '{"run_id": "r", "agent": "A", "event": "tool_call", "seq": 2, "tool": "x"}',
        '{"run_id": "r", "agent": "A", "event": "agent_turn", "seq": 3, "turn": 2}',
        '{"run_id": "r", "agent": "A", "event": "tool_call", "seq": 4, "tool": "y"}',
        '{"run_id": "r", "agent": "A", "event": "tool_call", "seq": 5, "tool": "z"}',
        '{"run_id": "r", "agent": "A", "event": "agent_turn", "seq": 6, "turn": 3}',
    ]
    import os
    for i, line in enumerate(lines):
        (source / f"{i}.json").write_text(line + "\n")
        os.utime(source / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = L.trace_stream(spark, str(source), spark.createDataFrame([], "run_id string, agent string, event string, seq bigint, turn bigint, tool string").schema, 1)
        L.append_to_table(L.live_replan_cycles(stream), str(out), str(tmp_path / "cp")).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.turn, r.side, r.seq) for r in spark.read.parquet(str(out)).collect())
    assert got == [(2, "chose", 4), (2, "chose", 5), (2, "observed", 2)]


class _Counted:
    """A value or list state that counts the calls to it."""

    calls = 0

    def __init__(self, is_list):
        self.is_list, self.held = is_list, None

    def __getattribute__(self, name):
        if name in ("exists", "get", "update", "put", "clear", "appendList", "appendValue"):
            _Counted.calls += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return bool(self.held)

    def get(self):
        return iter(self.held or []) if self.is_list else self.held

    def update(self, value):
        self.held = tuple(value)

    def put(self, values):
        self.held = list(values)

    def clear(self):
        self.held = None

    def appendList(self, values):
        self.held = [*(self.held or []), *values]


def test_replan_cycles_read_and_write_state_once_a_micro_batch():
    """Random events of a key in micro-batches of any size give a plain pass's cycles, by at most seven calls a batch."""
    import random
    from types import SimpleNamespace

    from pyspark.sql import Row

    for seed in range(40):
        rng = random.Random(seed)
        events = [("agent_turn", k if rng.random() < 0.9 else None, None) if rng.random() < 0.3 else ("tool_call", None, rng.choice("xyz")) for k in range(200)]
        want, turn, before, now = [], None, [], []
        for k, (event, number, tool) in enumerate(events):
            if event == "agent_turn":
                turn, before, now = (number,), now, []
            elif turn:
                if before:
                    want += [(*turn, "observed", *x) for x in before if not now] + [(*turn, "chose", k, tool)]
                now.append((k, tool))
        cycles = L.ReplanCycles()
        cycles.init(SimpleNamespace(getValueState=lambda *_: _Counted(False), getListState=lambda *_: _Counted(True)))
        got, at = [], 0
        while at < len(events):
            to = at + rng.choice([1, 2, 5, 60])
            batch = [Row(event=e, turn=n, seq=k, tool=t) for k, (e, n, t) in enumerate(events) if at <= k < to]
            rng.shuffle(batch)
            _Counted.calls, at = 0, to
            got += [tuple(r)[2:] for r in cycles.handleInputRows(("r", "A"), iter(batch), None)]
            assert _Counted.calls <= 7
        assert got == want


def test_scratch_folder_comes_from_the_session(spark):
    from ledgerloom.session import shared_dir

    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_default_request(spark):
    df = spark.createDataFrame(
        [("a", "sentiment", "q", None, None, [], "w"), ("b", None, None, None, None, None, None), ("c", "price_data", "q", "", 5, None, "w")],
        "run_id string, needs string, question string, period string, window int, headlines array<string>, why string",
    )
    got = {r.run_id: (r.needs, r.period, r.window) for r in R.default_requests(df).collect()}
    assert got == {"a": ("volatility", None, 63), "b": ("volatility", None, 63), "c": ("price_data", "1y", None)}


def test_generated_at_is_utc(spark):
    assert datetime(2024, 2, 1) == spark.sql("select timestamp'2024-02-01 00:00:00'").first()[0]


def test_saving_two_runs_of_a_pair_keeps_the_newest(spark, tmp_path):
    rows = [("aapl", 1, "llm", "one", 1), ("AAPL", 1, "llm", "two", 2), ("AAPL", 1, "template", "three", 3)]
    runs = spark.createDataFrame(rows, "ticker string, schema_version int, generated_by string, payload string, seq int").withColumn("as_of", F.to_date(F.lit("2026-01-05")))
    snapshots.save_snapshots(runs, str(tmp_path / "s"), ["seq"])
    stored = snapshots.read_snapshots(spark, str(tmp_path / "s"), runs.schema)
    assert [(r.ticker, r.payload) for r in stored.collect()] == [("AAPL", "two")]


def test_printf_prints_exact_values(spark):
    """F6, F7, F8: decimal halves were rounded up from the shortest decimal form, 114.55 to 114.6."""
    import random

    from ledgerloom.functions.texts import printf

    rng = random.Random(3)
    values = [114.55, 0.25, 0.35, 12.5, 13.5, 0.5, -0.04, 1.005, 2.675, -0.45, 0.0, 123456789012345.67, 0.95, 99.95]
    values += [round(rng.uniform(-300, 300), rng.choice((1, 2, 3))) for _ in range(3000)]
    specs = ("%+.1f%%", "%.2f", "%.0fth")
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [tuple(r) for r in df.select("v", *[printf(s, "v").alias(f"p{i}") for i, s in enumerate(specs)]).collect()]
    assert got == [(v, *[s % v for s in specs]) for v in values]


def test_live_unique_stories_of_a_table_in_many_files(spark, tmp_path):
    """a table that is a folder of files gave no rows, and stories of later micro-batches came late or twice."""
    from registered import streams as RS

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, f"Story {i % 30}" if i % 2 else f"story  {i % 30}", "en", "src1", (i * 7919) % 5000) for i in range(120)]
    spark.createDataFrame(rows, schema).repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in RS.live_unique_stories(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) == 30
    one_file = [tuple(r) for r in RS.live_unique_stories(spark, "/root/testdata/sf0.001").collect()]
    assert len(one_file) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("lang", "lower(text) t").distinct().count()
