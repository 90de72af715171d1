"""As-of lookups, open JSON lines, figures and checked reports of runs, stems and ROUGE-L on whole documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.stems import stem
from ledgerloom.operators import reports as R
from ledgerloom.operators import run_results as RR
from ledgerloom.operators.asof import as_of_join
from ledgerloom.schemas import struct, LONG, REAL, TEXT, TEXTS, TIME
from ledgerloom.sources import jsonl
from registered import corpus as CQ

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_matches_brute_force(spark, strict):
    rng = random.Random(3)
    key = lambda: "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])
    left = [(key(), rng.choice([None, *range(60)]), k) for k in range(400)]
    right = [(key(), rng.choice([None, *range(60)]), k) for k in range(150)]
    right += right[:20]
    a, b = spark.createDataFrame(left, "k string, t long, i int"), spark.createDataFrame(right, "k string, t long, n int")
    got = sorted((r.i, r.as_of and (r.as_of.t, r.as_of.n)) for r in as_of_join(a, b, ["k"], "t", "t", "n", strict, ranges=9).collect())
    want = []
    for k, t, i in left:
        found = [(u, n) for q, u, n in right if k is not None and q == k and t is not None and u is not None and (u < t or (u == t and not strict))]
        want.append((i, max(found) if found else None))
    assert got == sorted(want)
    assert {r.as_of for r in as_of_join(a, b.limit(0), ["k"], "t", "t", "n", strict).collect()} == {None}
    assert as_of_join(a.limit(0), b, ["k"], "t", "t", "n", strict).count() == 0


def test_open_lines_lose_nothing(spark, tmp_path):
    lines = [
        '{"run_id": "r", "seq": 1, "args": {"a": [1, 2]}, "new": {"x": null}, "tokens": "many"}', "  ", '{"run_id": "r", "seq": 2.0, "tokens": null, "zero": null, "tags": ["u", "v"]}',
        "[1, 2]", '{"broken": ', '"text"', '{"run_id": 7, "ts": "2026-01-02T03:04:05+00:00", "we.ird \'key\'": 1}',
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    schema = struct(ts=TIME, run_id=TEXT, seq=LONG, args=TEXT, tokens=LONG, tags=TEXTS, duration_ms=REAL)
    rows = jsonl.read_open_jsonl(spark, str(tmp_path / "t.jsonl"), schema)
    got = [(r.run_id, r.seq, r.args, r.tokens, r.tags, r.ts is not None, sorted(r.rest or []), r._corrupt_record) for r in rows.withColumn("rest", F.map_keys("rest")).collect()]
    assert got == [
        ("r", 1, '{"a":[1,2]}', None, None, False, ["new", "tokens"], None), ("r", 2, None, None, ["u", "v"], False, ["zero"], None), (None, None, None, None, None, False, [], "[1, 2]"),
        (None, None, None, None, None, False, [], '{"broken": '), (None, None, None, None, None, False, [], '"text"'), ("7", None, None, None, None, True, ["we.ird 'key'"], None),
    ]
    counts = {(r.field, r.type): r.rows for r in jsonl.field_counts(rows).collect()}
    assert counts == {("new", "OBJECT<x: VOID>"): 1, ("tokens", "STRING"): 1, ("zero", "VOID"): 1, ("we.ird 'key'", "BIGINT"): 1}
    assert [r.seq for r in jsonl.read_open_jsonl(spark, str(tmp_path / "t.jsonl"), schema, "r").collect()] == [1, 2]
    assert jsonl.read_open_jsonl(spark, str(tmp_path / "none"), schema).count() == 0


OBS = "run_id string, seq long, tool string, status string, data string, error string, warnings array<string>"


@pytest.fixture(scope="module")
def observations(spark):
    price = '{"as_of": "2026-10-07", "close": 100, "indicators": {"hv_30": 0.2, "sma_200": null}, "low_52w": 80.5}'
    rows = [
        ("r1", 1, "get_price_data", "ok", price.replace("100", "90")), ("r1", 2, "get_price_data", "ok", price), ("r1", 3, "get_price_data", "error", None),
        ("r1", 4, "calculate_volatility", "ok", '{"window": 30, "current_pct": 21, "percentile_1y": 50}'), ("r1", 5, "calculate_volatility", "ok", '{"window": 63, "current_pct": 27.5, "percentile_1y": 60}'),
        ("r1", 6, "calculate_volatility", "ok", '{"window": "long", "current_pct": 27.5, "percentile_1y": 60}'), ("r1", 7, "llm_sentiment", "ok", "no json"),
        ("r2", 1, "get_price_data", "ok", '{"as_of": "2026-10-07"}'), ("r2", 2, "llm_sentiment", "ok", '{"summary": {"scored": 2, "score": -0.5, "label": "negative"}}'),
        ("r3", 1, "web_search", "empty", None), ("r4", 1, "get_price_data", "ok", price),
    ]
    return spark.createDataFrame([(*r, None, []) for r in rows], OBS)


def test_figures_of_runs(observations):
    got = {r.run_id: r for r in RR.run_figures(observations).collect()}
    assert (got["r1"].price.close, str(got["r1"].price.as_of), got["r1"].price.sma_200, got["r1"].price.low_52w) == (100.0, "2026-10-07", None, 80.5)
    assert got["r1"].volatility is None and got["r1"].sentiment is None
    assert got["r1"].warnings == ["calculate_volatility: window is no int", "llm_sentiment: the result is no JSON"]
    assert got["r2"].price is None and got["r2"].sentiment.asDict() == {"scored": 2, "score": -0.5, "label": "negative"}
    assert got["r2"].warnings == ["get_price_data: close is missing"]
    assert (got["r3"].price, got["r3"].volatility, got["r3"].sentiment, got["r3"].warnings) == (None, None, None, [])
    assert [(r.run_id, r.window, r.current_pct) for r in RR.run_volatility(observations).collect()] == [("r1", 63, 27.5)]
    levels = {r.run_id: r.levels for r in RR.run_hedge_levels(observations).collect()}
    assert levels["r1"].volatility_source == "calculate_volatility, 63-day" and levels["r4"].volatility_source == "get_price_data hv_30"
    assert set(levels) == {"r1", "r4"} and levels["r1"].expected_move == 13.75


def test_unsupported_evidence_is_never_printed(spark, observations):
    schema = "run_id string, summary string, risks array<struct<title:string,explanation:string,evidence:array<struct<fact:string,source_tool:string>>>>, strategy string, legs array<struct<action:string,instrument:string,level_name:string>>, rationale string, generated_by string, warnings array<string>"
    risks = [("Trend", "Because.", [("kept fact", "get_price_data"), ("made up", "web_search"), ("no source", None)]), ("News", "Maybe.", [("gone", "get_news")]), ("Bare", "Hm.", None)]
    legs = [("buy", "put", "one_sd_low"), ("sell", "call", "no_such"), ("sell", "shares", None)]
    answers = spark.createDataFrame([("r1", "Sum.", risks, "collar", legs, "Why.", "llm", ["earlier"]), ("r9", "Sum.", None, "collar", None, "Why.", "llm", None)], schema)
    out = RR.checked_reports(answers, observations, RR.run_hedge_levels(observations))
    got = {r.run_id: r for r in out.collect()}
    assert [[e.fact for e in r.evidence or []] for r in got["r1"].risks] == [["kept fact"], [], []]
    assert [x.level for x in got["r1"].legs] == [86.25, None, None]
    assert got["r1"].tools_called == ["get_price_data", "calculate_volatility", "llm_sentiment"]
    assert got["r1"].data_gaps == ["get_news was not called", "web_search was not called"]
    assert got["r1"].warnings == [
        "earlier", "dropped evidence for 'Trend' citing web_search, which returned no usable result: 'made up'", "dropped evidence for 'Trend' citing no tool, which returned no usable result: 'no source'",
        "dropped evidence for 'News' citing get_news, which returned no usable result: 'gone'", "risk 'News' has no supporting evidence left", "risk 'Bare' has no supporting evidence left",
        "hedge leg 'sell call' names an unknown level 'no_such', so it has no price",
    ]
    assert got["r9"].warnings == [] and got["r9"].tools_called == [] and len(got["r9"].data_gaps) == 5
    text = R.report_markdown(out.where("run_id = 'r1'").withColumnRenamed("run_id", "ticker"), F.lit("2026-10-07")).first().markdown
    assert "kept fact" in text and "86.25 (one_sd_low)" in text and not re.search("made up|no source|gone", text.split("## Data gaps")[0].split("## Hedge")[0])


def test_stems():
    known = {
        "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "agreed": "agre", "feed": "feed", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
        "sized": "size", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "enjoy": "enjoy", "relational": "relat", "conditional": "condit", "valenci": "valenc",
        "radicalli": "radic", "vietnamization": "vietnam", "hopefulness": "hope", "sensibiliti": "sensibl", "triplicate": "triplic", "electrical": "electr", "goodness": "good", "allowance": "allow",
        "replacement": "replac", "adoption": "adopt", "communism": "commun", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "dying": "die", "spied": "spi",
        "generalizations": "gener", "oscillators": "oscil", "is": "is", "news": "news", "skies": "sky",
    }
    assert {w: stem(w) for w in known} == known


def plain_rouge(prediction, reference):
    tokens = lambda t: [stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", t.lower())]
    p, r = tokens(prediction), tokens(reference)
    row = [0] * (len(r) + 1)
    for x in p:
        before = 0
        for j, y in enumerate(r, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(p) + len(r)) if p or r else 0.0


def test_rouge_l_of_whole_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000").collect()}
    got = {r.doc_id: r.rouge_l for r in CQ.rouge_l_documents(spark, SF).collect()}
    both = [k for k in texts if k + 1 in texts]
    assert len(both) > 100
    for k in both[:60]:
        assert got[k] == pytest.approx(plain_rouge(texts[k], texts[k + 1]), abs=1e-6)


@pytest.mark.parametrize(("window", "alpha"), [(14, 1 / 14), (3, 0.5), (1, 0.9999)])
def test_scan_equals_the_recursion(spark, window, alpha):
    """One hot series over many ranges and blocks, a short one, one without a whole seed, and rows without values."""
    import numpy as np

    from ledgerloom.operators.scan import seeded_scan
    from ledgerloom.operators.smoothing import seeded

    rng = random.Random(window)
    rows = [("hot", k * 7, rng.choice([None, rng.uniform(-5, 50), rng.uniform(0, 1e6)])) for k in range(1500)] + [("short", k, float(k)) for k in range(20)] + [("bare", 1, None), (None, 2, 1.0)]
    table = spark.createDataFrame(rows, "k string, at long, x double")
    got = {(r.k, r.at): r.smoothed for r in seeded_scan(table, ["k"], "at", "x", window, alpha, ranges=5).collect()}
    assert len(got) == len(rows)
    for key in ("hot", "short", "bare"):
        mine = [(at, x) for k, at, x in rows if k == key]
        want = seeded(np.array([np.nan if x is None else x for _, x in mine], float), window, alpha)
        for (at, _), y in zip(mine, want, strict=True):
            assert got[key, at] == (None if np.isnan(y) else pytest.approx(y, rel=1e-9, abs=1e-6))
    assert got[None, 2] is None


def test_scan_over_many_batches_and_keys_shuffles_rows_by_range_only(spark):
    """Keys of two columns end and begin inside of batches of seven rows; odd rows are among them; no join by the order."""
    import numpy as np

    from ledgerloom.operators.scan import seeded_scan
    from ledgerloom.operators.smoothing import seeded

    rng = random.Random(5)
    sizes = {("a", 1): 90, ("a", 2): 4, ("b", 1): 31, ("b", 2): 5, ("c", 1): 200}
    rows = [(*k, at, rng.choice([None, float("nan"), rng.uniform(1, 9), rng.uniform(1, 9)])) for k, n in sizes.items() for at in range(n)]
    odd = [("a", 1, None, 3.0), ("a", 1, None, 3.0), (None, 1, 5, 2.0), ("b", None, 6, 2.0), ("c", 1, None, None)]
    table = spark.createDataFrame(rows + odd, "k string, j int, at long, x double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for ranges in (1, 3, 60):
            out = seeded_scan(table, ["k", "j"], "at", "x", 5, 0.25, ranges=ranges)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert not any("partitioning" in line and "at#" in line for line in plan.splitlines())
            found = out.collect()
            assert len(found) == len(rows) + len(odd)
            got = {(r.k, r.j, r.at): r.smoothed for r in found}
            for key in sizes:
                mine = [(at, x) for *k, at, x in rows if tuple(k) == key]
                want = seeded(np.array([np.nan if x is None else x for _, x in mine]), 5, 0.25)
                for (at, _), y in zip(mine, want, strict=True):
                    assert got[*key, at] == (None if np.isnan(y) else pytest.approx(y, rel=1e-12))
            assert all(got[k] is None for k in [("a", 1, None), (None, 1, 5), ("b", None, 6), ("c", 1, None)])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
