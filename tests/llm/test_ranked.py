"""Phrase collocations, toxicity and ranked search against plain versions of themselves, odd rows included."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bytehash, collocations, rankedsearch, toxicity

UPPER_LOWER = {k: k + 32 for k in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark, sf, odd_docs):
    """The odd rows (with other columns of clashing names) and a table of documents."""
    table = spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text", F.expr("if(doc_id % 7 = 0, null, lang)").alias("lang"))
    odd = odd_docs.select("doc_id", "text", "lang", F.lit("x").alias("phrase"), F.lit(1).alias("f"), F.lit("y").alias("w1"), F.col("score"), F.lit(3).alias("item"), F.lit(0).alias("_text"))
    return odd.unionByName(table, allowMissingColumns=True).cache()


# collocations


def plain_collocations(rows, least, top, share=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER_LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = set()
    for lang, counts in f.items():
        able = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in able.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in able.items():
            if 100 * inside[p] >= share * a:
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, k, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), k, left, right))
        for rank, (score, a, phrase, k, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, k, left, right, n[lang], -score))
    return out


@pytest.mark.parametrize(("least", "top", "share"), [(3, 40, 100), (2, 10_000, 60)])
def test_collocations(docs, least, top, share):
    got = collocations.collocations(docs, least, top, share).select("lang", "rank", "phrase", "a", "cut", "l", "r", "n", "score").collect()
    want = plain_collocations([(r["lang"], r["text"]) for r in docs.collect()], least, top, share)
    assert len(got) == len(want) > 40
    assert {tuple(r) for r in got} == want


def test_collocation_scores_pass_64_bits(spark):
    counts = spark.createDataFrame([("en", 0, "", 4 * 10**15), ("en", 1, "a", 3 * 10**9), ("en", 1, "b", 2 * 10**9), ("en", 2, "a b", 10**9 + 7)], "lang string, k int, phrase string, f long")
    row = collocations.scored(counts).first()
    assert row["score"] == 1000 * (10**9 + 7) * 4 * 10**15 // (6 * 10**18)


def test_full_slots_change_no_count(docs, monkeypatch):
    want = Counter(tuple(r) for r in collocations.phrase_counts(docs, 3).collect())
    monkeypatch.setattr(collocations, "FEWEST", 6)
    monkeypatch.setattr(collocations, "MOST", 6)
    assert Counter(tuple(r) for r in collocations.phrase_counts(docs, 3).collect()) == want


def test_no_collocations(no_docs, odd_docs):
    assert collocations.collocations(no_docs).collect() == []
    assert collocations.collocations(odd_docs.filter("text is null or text = ''")).collect() == []


# toxicity


def plain_scores(model, text):
    """The score of a text and its offending sentences, word by word."""
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    spans = [m.span() for m in re.finditer(r"[^.!?\n]+", text or "") if re.search(r"[0-9A-Za-z\x80-\U0010ffff]", m.group())]
    rest, found = 1 - model.leak, []
    for a, b in spans:
        z = model.bias + model.crowd * math.log(len(spans))
        for word in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text[a:b]):
            raw = word.translate(UPPER_LOWER).encode()
            keys = [one_hash(raw) >> 44]
            for n in toxicity.BEGINNINGS:
                if len(raw) > n:
                    keys.append(int(bytehash.mix(np.array([(one_hash(raw[:n]) * 2 + 1) % (1 << 64)], np.uint64))[0]) >> 44)
            z += sum(weights.get(k, 0.0) for k in keys)
        p = 1 / (1 + math.exp(-z))
        rest *= 1 - p
        if p >= 0.5:
            found.append((a, b))
    return 1 - rest, found


def one_hash(raw):
    data = np.frombuffer(raw, np.uint8)
    return int(bytehash.slice_hashes(data, np.array([0]), np.array([len(raw)]), fold=True)[0])


@pytest.fixture(scope="module")
def model(spark):
    d = "/root/testdata/sf0.01"
    return toxicity.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))


def test_toxicity_scores(docs, model):
    got = toxicity.with_score(docs.drop("score"), model, ["doc_id", "text", "phrase"])
    for r in got.collect():
        score, spans = plain_scores(model, r["text"])
        assert r["score"] == pytest.approx(score, abs=1e-9)
        assert [(s["start"], s["end"]) for s in r["offending"]] == spans


def test_toxicity_finds_the_sentence(spark):
    rows = [(k, f"All is well here. Nothing to see number {k}. " + ("You are a zorgle, really! " if k % 4 == 0 else "") + "We go home now.") for k in range(400)]
    table = spark.createDataFrame([*rows, (400, None), (401, ""), (0, rows[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0), 9) for k in range(400)] + [(4, 1, 9), (5000, 1, 9), (None, 1, 9), (7, None, 9)], "doc_id long, toxic int, text int")
    found = toxicity.fit(table, labels)
    for r in toxicity.with_score(table, found, ["doc_id", "text"]).collect():
        toxic = bool(r["text"]) and r["doc_id"] % 4 == 0
        assert (r["score"] >= toxicity.THRESHOLD) == toxic, r
        assert [r["text"][s["start"] : s["end"]].strip() for s in r["offending"]] == (["You are a zorgle, really"] if toxic else [])


def test_toxicity_held_out(spark, model):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = toxicity.with_score(docs, toxicity.fit(docs, labels), ["doc_id"]).join(labels, "doc_id")
    held = [(r["score"] >= toxicity.THRESHOLD, r["toxic"]) for r in scored.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    caught = sum(p for p, y in held if y) / sum(y for _, y in held)
    spared = sum(not p for p, y in held if not y) / sum(not y for _, y in held)
    assert caught > 0.85 and spared > 0.98


def test_toxicity_without_rows_or_labels(spark, no_docs, odd_docs, model):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(odd_docs, none) is None
    assert {r["score"] for r in toxicity.with_score(odd_docs, None, ["doc_id"]).collect()} == {0.0}
    assert toxicity.with_score(no_docs, model, ["doc_id"]).collect() == []
    one = toxicity.fit(odd_docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int"))
    assert {round(r["score"], 6) for r in toxicity.with_score(odd_docs, one, ["doc_id"]).collect()} == {1.0}


def test_toxicity_model_is_repeatable():
    texts, y = pa.array(["good day. fine.", "bad zorgle day", "zorgle", "fine weather", None, ""] * 5), np.array([0, 1, 1, 0, 0, 0] * 5)
    one, two = (toxicity.train(texts, y, np.ones(30)) for _ in range(2))
    assert (one.weights == two.weights).all() and one.bias == two.bias


# ranked search


def plain_search(docs, items, best):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    counts = [(i, Counter(term.findall((t or "").translate(UPPER_LOWER)))) for i, t in docs]
    some, every = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = Counter()
    for item, text in set(items):
        asked = term.findall((text or "").translate(UPPER_LOWER))
        found = []
        for i, c in counts:
            n = sum(c.values())
            if n:
                m = 75 + 25 * n * some // every
                score = sum(math.floor(1000 * math.log((2 * some + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in asked if c[w])
                if score > 0:
                    found.append((-score, i is None, i or 0))
        for rank, (score, null, i) in enumerate(sorted(found)[:best], 1):
            out[item, rank, None if null else i, -score] += 1
    return out


@pytest.fixture(scope="module")
def items(spark, sf):
    table = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    odd = [(900, None), (901, ""), (902, "the the the quick fox"), (902, "the the the quick fox"), (903, "zzz none such"), (904, "é中😀 wörter"), (None, "lazy dog")]
    return spark.createDataFrame(odd, "item_id long, text string").unionByName(table).withColumn("doc_id", F.lit("z"))


@pytest.mark.parametrize(("best", "postings", "at_once"), [(20, 200_000, 1 << 21), (3, 300, 64)])
def test_search(docs, items, best, postings, at_once, monkeypatch):
    want = plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], best)
    monkeypatch.setattr(rankedsearch, "AT_ONCE", at_once)
    got = rankedsearch.search(docs, items, best, postings=postings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == want


def test_sums_beyond_doubles():
    """Sums that a double may round are made of integers."""
    index = rankedsearch.build_index([0], ["a " * 400_000 + "b"], pa.int64())
    assert index.times.max() == 400_000 and len(index.keys) == 2


def test_search_in_empty_tables(spark, docs, no_docs, items):
    assert rankedsearch.search(no_docs, items).collect() == []
    got = rankedsearch.search(docs, items.limit(0))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.collect() == []
    assert rankedsearch.search(docs.filter("text is null or text = ''"), items).collect() == []


def test_search_needs_whole_number_ids(docs, items):
    with pytest.raises(TypeError):
        rankedsearch.search(docs.withColumn("doc_id", F.col("doc_id").cast("string")), items)
