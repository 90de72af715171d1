"""Toxicity by multiple-instance learning: sentences get scores, a document is toxic if one of its sentences is.

Only documents are labelled. A sentence's score p is logistic in the words and word beginnings
it holds; the document's is the noisy-or 1 - (1 - leak) * prod(1 - p), the leak being what no sentence
explains. The gradient of the document's likelihood shares its label out among its sentences, so
that training finds those which carry it, and they are what ``offending`` reports.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import bytehash as B

#: Bounds of what is learned from: labelled texts of each label, their length, and features that are weighed.
TOXIC, CLEAN, MOST_CHARS, FEATURES = 3000, 6000, 16_000, 20_000
#: Features are hashed into so many slots, whatever the vocabulary.
SLOTS = 1 << 20
#: Bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Features have to be in so many of the texts, and to tell labels apart with this likelihood ratio.
LEAST_TEXTS, LEAST_RATIO = 3, 8.0
#: A label is wrong with this chance, whatever the text.
WRONG = 0.02
THRESHOLD = 0.7
STEPS, RATE, DECAY = 400, 0.05, 2e-4


@dataclass(frozen=True)
class Model:
    """Ascending slots of features and their weights, the bias, the weight of the log number of sentences, and the leak."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    crowd: float
    leak: float


def _letter(data: np.ndarray) -> np.ndarray:
    low = data | 32
    return (data >= 128) | ((low >= 97) & (low <= 122)) | ((data >= 48) & (data <= 57))


def sentences(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of the sentences: runs of bytes other than ``.``, ``!``, ``?`` and line feed that hold a letter or digit."""
    low, high = B.runs((data != 46) & (data != 33) & (data != 63) & (data != 10), starts)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_letter(data), out=before[1:])
    some = before[high] > before[low]
    return low[some], high[some]


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """For each kind of feature, a slot a word: of the whole word, then of its beginnings (SLOTS where the word is no longer)."""
    shift = np.uint64(64 - (SLOTS - 1).bit_length())
    yield (B.slice_hashes(data, starts, ends, fold=True) >> shift).astype(np.int64)
    for n in BEGINNINGS:
        part = B.mix(B.slice_hashes(data, starts, np.minimum(starts + n, ends), fold=True) * np.uint64(2) + np.uint64(1))
        yield np.where(ends - starts > n, (part >> shift).astype(np.int64), SLOTS)


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Sentence slices, the text of each, word slices, and the sentence of each word."""
    low, high = sentences(data, starts)
    word_starts, word_ends = B.runs(_letter(data), starts)
    return low, high, B.owner(ends, low), word_starts, word_ends, np.searchsorted(high, word_starts, "right")


def _crowds(owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """How many sentences each text has, and its logarithm for each sentence."""
    count = np.bincount(owner, minlength=texts)
    return count, np.log(count[owner])


def _telling(texts: pa.Array, y: np.ndarray) -> np.ndarray:
    """Ascending slots of at most FEATURES features whose share of texts differs most between the labels."""
    found = np.zeros((2, SLOTS + 1))
    for row, end, data, starts, ends in B.parts(texts):
        a, b = B.runs(_letter(data), starts)
        pairs = np.unique(np.concatenate([slot * (end - row) + B.owner(ends, a) for slot in _features(data, a, b)]))
        label = y[row + pairs % (end - row)]
        for k in (0, 1):
            found[k] += np.bincount(pairs[label == k] // (end - row), minlength=SLOTS + 1)
    zero, one = found[:, :SLOTS]
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    both = (one + zero) / (n1 + n0)
    part = lambda k, n: k * np.log(np.maximum(k, 1e-9) / np.maximum(n * both, 1e-9)) + (n - k) * np.log(np.maximum(n - k, 1e-9) / np.maximum(n * (1 - both), 1e-9))
    ratio = 2 * (part(one, n1) + part(zero, n0))
    able = np.flatnonzero((one + zero >= LEAST_TEXTS) & (ratio >= LEAST_RATIO))
    return np.sort(able[np.lexsort((able, -ratio[able]))[:FEATURES]])


def _examples(texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each occurrence of a known feature: its number and its sentence; and the text of each sentence."""
    number = np.full(SLOTS + 1, -1, np.int32)
    number[known] = np.arange(len(known))
    at, of, owners, shift = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for row, _, data, starts, ends in B.parts(texts):
        _, _, owner, a, b, sentence = _cut(data, starts, ends)
        for slots in _features(data, a, b):
            hit = np.flatnonzero(number[slots] >= 0)
            at.append(number[slots[hit]])
            of.append(sentence[hit] + shift)
        owners.append(owner + row)
        shift += len(owner)
    return np.concatenate(at), np.concatenate(of), np.concatenate(owners)


def _sigmoid(z: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(texts: pa.Array, y: np.ndarray, weight: np.ndarray) -> Model:
    """Maximises the labels' likelihood over all weights by Adam, with a little decay; the same rows give the same model."""
    known = _telling(texts, y)
    at, of, owner = _examples(texts, known)
    _, crowd = _crowds(owner, len(y))
    share = float((weight * y).sum() / weight.sum())
    theta = np.zeros(len(known) + 3)  # weights, bias, crowd, log odds of the leak
    theta[-3:] = -4.0, -0.5, np.log(0.02 / 0.98)
    first, second, weight = np.zeros_like(theta), np.zeros_like(theta), weight / weight.sum()
    if 0 < share < 1:
        for step in range(1, STEPS + 1):
            z = theta[-3] + theta[-2] * crowd + np.bincount(of, weights=theta[at], minlength=len(owner))
            p, leak = _sigmoid(z), _sigmoid(theta[-1])
            rest = (1 - leak) * np.exp(np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y)))
            chance = WRONG + (1 - 2 * WRONG) * (1 - rest)
            slope = -weight * (y / chance - (1 - y) / (1 - chance)) * (1 - 2 * WRONG) * rest
            by_sentence = slope[owner] * p
            grad = np.concatenate([np.bincount(at, weights=by_sentence[of], minlength=len(known)), [by_sentence.sum(), (by_sentence * crowd).sum(), (slope * leak).sum()]])
            grad[:-3] += DECAY * theta[:-3] / max(len(known), 1) ** 0.5
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        return Model(known, theta[:-3].copy(), float(theta[-3]), float(theta[-2]), float(_sigmoid(theta[-1])))
    return Model(known, np.zeros(len(known)), -40.0, 0.0, share)


def remainder(id_col: str):
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 1, toxic: int = TOXIC, clean: int = CLEAN) -> Model | None:
    """Learns from labelled rows (doc_id, toxic 0 or 1) whose id's remainder isn't ``held_out``.

    Fitted on a bounded sample: of each label the ``toxic`` or ``clean`` rows with the lowest id
    hashes whose text has at most MOST_CHARS code points, weighed so that labels count by their
    shares. Other labels, null ids and ids without such a text are not learned from; repeated label rows
    count once, and of several texts of an id the least is taken. None without any labelled row.
    """
    c = F.col
    known = labels.select("doc_id", c("toxic").cast("int").alias("toxic")).filter(c("toxic").isin(0, 1) & (remainder("doc_id") != held_out)).distinct()
    texts = docs.select("doc_id", c("text").cast("string").alias("text")).filter(F.char_length("text") <= MOST_CHARS)
    known = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("_hash", F.xxhash64(c("doc_id").cast("string")))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not sizes:
        return None
    lowest = lambda label, n: known.filter(c("toxic") == label).orderBy("_hash", "doc_id").limit(n)
    sample = F.broadcast(lowest(1, toxic).unionByName(lowest(0, clean)))  # at most toxic + clean rows
    picked = texts.join(sample.select("doc_id").distinct(), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = picked.join(sample, "doc_id").orderBy("_hash", "doc_id", "toxic").select("text", "toxic").toArrow()
    y = rows["toxic"].to_numpy().astype(np.int64)
    taken = np.bincount(y, minlength=2)
    weight = np.array([sizes.get(k, 0) / max(taken[k], 1) for k in (0, 1)])[y]
    return train(rows["text"].combine_chunks(), y, weight)


def _sentence_chances(model: Model, table: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Slices of all sentences, their texts, and their scores; ``table`` has the weight of every slot."""
    low, high, owner, a, b, sentence = _cut(data, starts, ends)
    _, crowd = _crowds(owner, len(starts))
    z = model.bias + model.crowd * crowd
    for slots in _features(data, a, b):
        weight = table[slots]
        hit = np.flatnonzero(weight)
        z += np.bincount(sentence[hit], weights=weight[hit], minlength=len(z))
    return low, high, owner, _sigmoid(z)


def with_score(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The ``keep`` columns of every row, ``score`` and ``offending``; only the text is looked at, all of it.

    offending: an array of (start, end, score) of the sentences whose own score is ``least`` or
    more, in order, in code points. A null or empty text, or one without letters, has the leak as its score.
    Repeated rows have equal scores. Without a model every score is 0. Nothing is shuffled.
    """
    spans = "array<struct<start:bigint,end:bigint,score:double>>"
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"), F.array().cast(spans).alias("offending"))
    picked = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema[:-1]) + f"score double, offending {spans}"
    names = [*picked.columns[:-1], "score", "offending"]
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS + 1)
        table[model.keys] = model.weights
        for batch in batches:
            scores, found, cuts = [np.zeros(0)], [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]], [np.zeros(1, np.int64)]
            for _, _, data, starts, ends in B.parts(batch.column(batch.num_columns - 1)):
                low, high, owner, p = _sentence_chances(model, table, data, starts, ends)
                rest = np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(starts))
                scores.append(1 - (1 - model.leak) * np.exp(rest))
                bad = np.flatnonzero(p >= least)
                points = B.code_points_before(data).astype(np.int64)
                base = points[starts[owner[bad]]]
                for out, values in zip(found, (points[low[bad]] - base, points[high[bad]] - base, p[bad]), strict=True):
                    out.append(values)
                cuts.append(np.cumsum(np.bincount(owner[bad], minlength=len(starts))) + cuts[-1][-1])
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in found], fields=list(kind))
            offsets = pa.array(np.concatenate(cuts).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores)), pa.ListArray.from_arrays(offsets, flat)], names=names)

    return picked.mapInArrow(score, schema)


def op12_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    scored = with_score(docs, fit(docs, spark.read.parquet(f"{d}/labels.parquet")), ["doc_id"])
    worst = F.array_max(F.transform("offending", lambda s: F.struct(s["score"].alias("score"), s["start"].alias("start"), s["end"].alias("end"))))
    return scored.select(
        "doc_id", F.coalesce(remainder("doc_id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("offending").cast("long").alias("n_offending"), worst["start"].alias("worst_start"), worst["end"].alias("worst_end"),
    )


QUERIES = {"op12_toxicity": op12_toxicity}
ORACLE: dict[str, str] = {}
