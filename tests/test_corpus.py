"""Code facts, docstring checks, routing, splits, near copies and ROUGE-L."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.code_facts import code_facts
from ledgerloom.operators import corpus as C
from ledgerloom.operators import scores as S
from ledgerloom.operators import similar as M

DISCOUNT = '''def discounted(price, rate=0.1, *codes, strict=False, **extra):
    if rate < 0:
        raise ValueError("rate")
    def inner():
        yield 1
        raise KeyError
    total = math.floor(price * (1 - rate))
    return total
'''


def test_facts():
    f = code_facts(DISCOUNT)
    assert f["params"] == ["price", "rate", "codes", "strict", "extra"]
    assert (f["name"], f["is_generator"], f["returns_value"], f["raises"], f["modules"]) == ("discounted", False, True, ["ValueError"], ["math"])
    g = code_facts("async def f(self, x):\n    raise errors.Bad(x) from None\n    return None\n")
    assert (g["params"], g["is_async"], g["returns_value"], g["raises"], g["first_arg"]) == (["x"], True, False, ["Bad"], "self")
    assert code_facts("def f():\n    yield 1\n")["is_generator"]
    assert code_facts("x = 1")["error"] == "code must be exactly one top-level function"
    assert code_facts("def f(:")["error"]
    assert code_facts("def f():\n    return " + " + ".join(["x"] * 2000) + "\n")["returns_value"]
    assert code_facts("def f():\n    return " + "-" * 50000 + "1\n")["error"]


GOOD = """Price after a discount.

More text.

Args:
    price: Old price.
    rate (float): Share.
    *codes: Codes.
    strict: Flag.
    **extra: Rest.

Returns:
    The new price.

Raises:
    ValueError: If the rate is negative."""


@pytest.mark.parametrize(
    ("docstring", "label", "missing", "invented"),
    [
        (GOOD, "correct", [], []),
        (GOOD.replace("    strict: Flag.\n", ""), "partial", ["arg strict"], []),
        (GOOD.replace("strict:", "loose:"), "hallucinated", ["arg strict"], ["arg loose"]),
        (GOOD.replace("Returns:", "Yields:"), "hallucinated", ["Returns"], ["Yields"]),
        (GOOD.replace("ValueError", "errors.Bad"), "hallucinated", ["raises ValueError"], ["raises Bad"]),
        ("```\n" + GOOD + "\n```", "correct", [], []),
        ("Args:\n    price: x", "unparseable", [], []),
        ("", "unparseable", [], []),
    ],
)
def test_docstring_check(spark, docstring, label, missing, invented):
    df = C.with_code_facts(spark.createDataFrame([(DISCOUNT, docstring)], "code string, docstring string"))
    got = C.check_docstrings(df).first()
    assert (got.label, got.missing, got.invented) == (label, missing, invented)


def body(n):
    return "".join("    x = 1\n" for _ in range(n))


@pytest.mark.parametrize(
    ("code", "kind", "reason"),
    [
        ("def a(x):\n" + body(4), "function", None),
        ("def a(x):\n" + body(3), "function", "4 lines, outside 5-40"),
        ("def a(self):\n" + body(4), "function", "does not match kind 'function'"),
        ("def a(self):\n" + body(4), "method", None),
        ("def a():\n" + body(4) + "    yield x\n", "generator", None),
        ("async def a():\n" + body(4), "async", None),
        ("async def a():\n" + body(4), "generator", "does not match kind 'generator'"),
        ('def a():\n    """Doc."""\n' + body(4), "function", "already has a docstring"),
        ("x = 1", "function", "not one valid function: code must be exactly one top-level function"),
    ],
)
def test_validation(spark, code, kind, reason):
    df = C.with_code_facts(spark.createDataFrame([(code, kind)], "code string, kind string"))
    assert df.select(C.reject_reason(F.col("kind"))).first()[0] == reason


def test_routing(spark):
    ok = lambda name: f"\ndef {name}(x):\n" + body(4)
    data = [("t", "function", "simple", i, code) for i, code in enumerate([ok("a"), "x = 1", ok("late")])]
    data += [("t", "function", "medium", 3, ok("a")), ("u", "function", "simple", 4, ok("stored"))]
    df = spark.createDataFrame(data, "topic string, kind string, level string, seq int, code string")
    stored = spark.createDataFrame([("stored",)], "name string")
    routed = C.route_functions(df, stored).collect()
    assert [(r.id, r.seq, r.reason) for r in routed if r.status == "ignored"] == [(None, 2, "beyond the 2 arrivals of its slot")]
    got = {r.id: r.reason for r in routed if r.status != "ignored"}
    assert got == {
        "t-function-simple-01": None,
        "t-function-simple-02": "not one valid function: code must be exactly one top-level function",
        "t-function-medium-01": "duplicate function name 'a'",
        "u-function-simple-01": "duplicate function name 'stored'",
    }


def test_split_sizes_and_order_independence(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 195, "common").otherwise("rare").alias("kind"))
    one = {r.id: r.split for r in C.stratified_split(df).collect()}
    two = {r.id: r.split for r in C.stratified_split(df.orderBy(F.rand(1)), buckets=2).collect()}
    assert one == two
    counts = {r.split: r.examples for r in S.split_sizes(C.stratified_split(df.where("kind = 'common'"))).collect()}
    assert counts == {"test": 20, "val": 20, "train": 155}


def grams(text):
    t = re.sub(r"\s+", " ", text)
    return {t[i:i + 5] for i in range(max(1, len(t) - 4))}


def brute_pairs(data):
    out = []
    for (a, x), (b, y) in itertools.combinations(sorted(data), 2):
        sx, sy = grams(x), grams(y)
        out.append((a, b, len(sx & sy) / len(sx | sy)))
    return out


def corpus_with_copies():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    data = []
    for group in range(12):
        words = [word() for _ in range(60)]
        for _ in range(5):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(60)] = word()
            data.append((len(data), "  ".join(copy) if rng.random() < 0.3 else " ".join(copy)))
    hot = "the same text again and again"
    data += [(len(data) + i, hot) for i in range(40)]
    data += [(200, "ab"), (201, ""), (202, "aaaaaaa"), (203, "aaaaaaaaaa")]
    return data


def test_similar_sets_finds_every_pair(spark):
    data = corpus_with_copies()
    df = spark.createDataFrame(data, "id int, text string")
    reps = M.distinct_sets(M.shingle_sets(df)).cache()
    kept = {r.id for r in reps.select("id").collect()}
    for t in (0.5, 0.8, 0.95):
        want = sorted((a, b, round(s, 9)) for a, b, s in brute_pairs([d for d in data if d[0] in kept]) if s >= t)
        got = sorted((r.a, r.b, round(r.similarity, 9)) for r in M.similar_sets(reps, t).collect())
        assert got == want and got


def test_similar_sets_carry_texts_and_compare_sketches_of_any_length(spark):
    """sets were carried whole, and texts of one vocabulary formed nearly all pairs."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
    data = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(150)]
    long = ["".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(450)]
    data += [(1000, " ".join(long)), (1001, " ".join(long[:400])), (1002, " ".join(long[:200]))]  # on both sides of 4096 5-grams
    reps = M.distinct_sets(M.shingle_sets(spark.createDataFrame(data, "id int, text string"))).cache()
    assert "grams" not in reps.columns and reps.select(F.size("sketch")).distinct().count() == 2
    want = sorted((a, b, round(s, 9)) for a, b, s in brute_pairs(data) if s >= 0.8)
    got = sorted((r.a, r.b, round(r.similarity, 9)) for r in M.similar_sets(reps, 0.8).collect())
    assert got == want and (1000, 1001) in [(a, b) for a, b, _ in got]
    assert M._like_sketches(reps, 0.8).count() < 20


def test_similar_pairs_send_neither_sets_nor_texts_over_and_over(spark, tmp_path):
    """blocks of sketches met each other by copies, and the text of each side of each pair was sent."""
    from registered import corpus as CQ

    rng = random.Random(11)
    letters = "abcdefghijklmnopqrst"
    data = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([3, 7, 20, 300, 500, 900, 1500])))) for i in range(240)]
    base = data[1][1] + "".join(rng.choice(letters) for _ in range(600))
    data += [(2000 + i, base[:k] + "#" + base[k + 1 :]) for i, k in enumerate(rng.sample(range(500), 30))]  # all alike: 435 pairs
    data += [(3000 + i, data[i][1][: int(len(data[i][1]) * rng.uniform(0.7, 1))]) for i in range(80)] + [(4000, data[0][1]), (4001, None), (4002, "")]
    data += [(5, data[5][1])]  # the row comes twice
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sets = {}
    for i, text in sorted(set(data), key=lambda r: r[0]):
        sets.setdefault(frozenset(M._grams(text or "", 5).tolist()), i)
    sets = sorted((i, x) for x, i in sets.items())
    want = {(i, j): len(x & y) / len(x | y) for k, (i, x) in enumerate(sets) for j, y in sets[k + 1 :] if len(x & y) >= 0.8 * len(x | y)}
    out = CQ.similar_pairs(spark, str(tmp_path)).collect()
    assert {(r.a, r.b): r.similarity for r in out} == pytest.approx(want, abs=1e-6) and len(out) == len(want) > 435
    # a set is sent once, and a second time at most; few texts are sent, and few times
    docs = spark.createDataFrame(data, "id long, text string")
    reps = M.distinct_sets(M.shingle_sets(docs, threshold=0.8)).cache()
    assert reps.select(F.max(F.size("parts"))).first()[0] <= 2
    pairs = M._like_sketches(reps, 0.8, docs).cache()
    assert pairs.count() < 1.2 * len(want)
    sent = M._sent_texts(M._cells(pairs).withColumn("bucket", F.col("cell")), docs)
    assert sent.count() < 3 * docs.count()


def test_similar_sets_in_blocks_and_words(spark, monkeypatch):
    """sets of a class that are too many for a task, and words that differ by few bits."""
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    words = np.concatenate([words, words[:50], *(words[:100] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (1, 3, 4, 5))])
    monkeypatch.setattr(M, "ROW_PAIRS", 7)
    got = sorted((min(x, y), max(x, y)) for one, two in M._row_pairs(words, 4) for x, y in zip(one.tolist(), two.tolist(), strict=True))
    assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if int(words[i] ^ words[j]).bit_count() <= 4]
    data = corpus_with_copies()
    reps = M.distinct_sets(M.shingle_sets(spark.createDataFrame(data, "id int, text string"))).cache()
    whole = sorted(map(tuple, M.similar_sets(reps, 0.8).collect()))
    for name, value in (("BLOCK_ROWS", 12), ("SLICE_BYTES", 256), ("CELL_TEXTS", 8), ("CELL_PAIRS", 3)):
        monkeypatch.setattr(M, name, value)
    assert max(blocks for _, blocks in M._cuts(reps, 0.8).values()) > 2
    assert sorted(map(tuple, M.similar_sets(reps, 0.8).collect())) == whole and whole


@pytest.mark.parametrize("k", [5, 900, 1500])
def test_most_similar_pairs_match_brute_force(spark, k):
    data = corpus_with_copies()
    df = spark.createDataFrame(data, "id int, text string")
    ranked = sorted(brute_pairs(data), key=lambda p: (-p[2], p[0], p[1]))
    want = [(a, b, round(s, 9)) for a, b, s in ranked][:k]
    got = [(r.a, r.b, round(r.similarity, 9)) for r in M.most_similar_pairs(df, k).collect()]
    assert got == want


def test_most_similar_pairs_without_any_near_copy(spark):
    data = [(1, "completely different"), (2, "words everywhere"), (3, "differently put"), (4, "zzzzz"), (5, "zzzzz"), (6, "")]
    want = sorted(((a, b, round(s, 9)) for a, b, s in brute_pairs(data)), key=lambda p: (-p[2], p[0], p[1]))
    for k in (1, 3, 8, 40):
        got = M.most_similar_pairs(spark.createDataFrame(data, "id int, text string"), k).collect()
        assert [(r.a, r.b, round(r.similarity, 9)) for r in got] == want[:k]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence_and_rouge(spark):
    rng = random.Random(5)
    for _ in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        assert S.common_subsequence(a, b) == lcs(a, b)
    df = spark.createDataFrame([("```\nA b, c d\n```", "b x d"), ("", "x"), ("", "")], "p string, r string")
    got = [r.rouge_l for r in S.with_rouge_l(df, "p", "r").collect()]
    assert got == pytest.approx([4 / 7, 0.0, 0.0])


def test_rendering_skips_empty_parts(spark):
    entry = "array(named_struct('name', 'x', 'text', ' the x '))"
    none = f"slice({entry}, 1, 0)"
    df = spark.range(1).select(
        C.render_docstring(F.lit(" Do. "), F.lit(" "), F.expr(entry), F.lit(None).cast("string"), F.lit("y"), F.expr(none)).alias("d")
    )
    assert df.first().d == "Do.\n\nArgs:\n    x: the x\n\nYields:\n    y"


def test_templates_and_markers(spark):
    with pytest.raises(KeyError):
        C.filled_template("{a} {b}", {"a": F.lit(1)})
    lines = spark.createDataFrame([("a.py", 1, "# MARK: x 2024"), ("a.py", 2, "# MARK: x"), ("b.py", 1, "code")], "path string, line_no long, line string")
    index = spark.createDataFrame([("c.py",)], "path string")
    got = sorted((r.path, r.line_no, r.problem) for r in C.marker_problems(lines, "MARK:", r"\d{4}", index).fillna(0).collect())
    assert got == [("a.py", 0, "not in the index"), ("a.py", 2, "malformed marker")]


def test_losses(spark):
    log = spark.createDataFrame(
        [("r", 0.9, 1, 1.5, None), ("r", 1.0, 2, None, 0.9), ("r", 2.0, 3, 1.0, None), ("r", 2.0, 4, None, 0.8), ("r", 3.0, 5, None, 0.85)],
        "run string, epoch double, step int, loss double, eval_loss double",
    )
    losses = S.epoch_losses(log)
    assert sorted((r.epoch, r.train_loss, r.val_loss) for r in losses.fillna(0.0).collect()) == [(1, 1.5, 0.9), (2, 1.0, 0.8), (3, 0.0, 0.85)]
    got = S.loss_check(losses).first()
    assert (got.falls_every_epoch, got.best_epoch, got.best_loss) == (False, 2, 0.8)


def test_prediction_export_parses_once_and_broadcasts_nothing(spark):
    """the whole table of texts was broadcast while it was parsed, twice, because its source file is small."""
    from registered import corpus as CQ

    out = CQ.prediction_export(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "MapInArrow" not in plan and "MapInPandas" not in plan
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id as p_partkey"), "p_partkey").count()


def test_code_facts_look_into_nested_functions_only_for_modules():
    """F14 to F26: one pass over a tree instead of two; what nested functions and classes do is not the function's."""
    f = code_facts("@deco(json.loads)\ndef f(a=lambda: (yield)):\n    class C:\n        raise KeyError\n    def g():\n        return math.floor(1)\n    return\n")
    assert (f["is_generator"], f["returns_value"], f["raises"], f["modules"]) == (False, False, [], ["math"])


def test_rouge_sends_joined_tokens_and_takes_null_texts(spark):
    """whole batches of tokens became Python strings at once, and a null text had no list."""
    df = spark.createDataFrame([("the cats sat", "the cats ran"), (None, "a b"), ("a b", None)], "p string, r string")
    out = S.with_rouge_l(df, "p", "r", stemmed=False)
    assert [round(r.rouge_l, 6) for r in out.collect()] == [0.666667, 0.0, 0.0]
    assert "array_join" in out._jdf.queryExecution().optimizedPlan().toString()
