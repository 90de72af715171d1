"""Quality classifier by compression: which of two zstandard dictionaries, of good or of bad text, shortens a text more."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import bytehash as B

#: Bounds of what is fitted on: passages a class for its dictionary, characters a passage, and texts for the calibration.
PASSAGES, PASSAGE_CHARS, CALIBRATION = 2000, 2000, 4000
DICTIONARY_BYTES, LEVEL = 112_640, 3
#: Bytes compressed at a time, so that the dictionary counts as much at the end of a long text as at its start.
BLOCK = 2000
#: Bytes of text that weigh as much as the share of good labels: what little a short text shows is drawn towards that share.
PRIOR_BYTES = 100
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    """Two dictionaries, a logistic curve over their normalised difference, and the log odds of a good label."""

    good: bytes
    bad: bytes
    slope: float
    bias: float
    prior: float


def _log_odds(share: float) -> float:
    return math.log((share + 1e-9) / (1 - share + 1e-9))


def _dictionary(passages: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, passages).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: all of it
        return b"\n".join(passages)[:DICTIONARY_BYTES]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(content)
    made.precompute_compress(LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_dict_id=False)


def _differences(texts: pa.Array, good, bad) -> Iterator[np.ndarray]:
    """For each text, bytes saved by the good dictionary beyond the bad one's, over its bytes; 0 for an empty text."""
    for _, _, data, starts, ends in B.parts(texts):
        raw, out = memoryview(data), np.zeros(len(starts))
        for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            if a < b:
                out[k] = sum(len(bad.compress(raw[i : min(b, i + BLOCK)])) - len(good.compress(raw[i : min(b, i + BLOCK)])) for i in range(a, b, BLOCK)) / (b - a)
        yield out


def with_difference(docs: DataFrame, good: bytes, bad: bytes, keep: list, text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and ``difference`` of every row. Nothing is shuffled."""
    picked = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[:-1]) + ", difference double"

    names = [*picked.columns[:-1], "difference"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, b = _compressor(good), _compressor(bad)
        for batch in batches:
            found = np.concatenate([np.zeros(0), *_differences(batch.column(batch.num_columns - 1), g, b)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=names)

    return picked.mapInArrow(measure, schema)


def _curve(x: np.ndarray, size: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and bias of the curve by Newton's method, with targets drawn in by one row a class."""
    scale = float(np.abs(x).mean()) or 1.0
    weight = size / (size + PRIOR_BYTES)
    rows, offset = np.stack([weight * x / scale, weight], 1), (1 - weight) * prior
    ones, zeros = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    w = np.array([0.0, prior])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(rows @ w + offset, -40, 40)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(2), rows.T @ (p - target) + 1e-3 * w)
        w = w - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def remainder(id_col: str):
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 2, passages: int = PASSAGES, calibration: int = CALIBRATION) -> Model:
    """Learns from labelled rows (doc_id, quality 0 or 1) whose id's remainder isn't ``held_out``.

    Fitted on a bounded sample: for each label ``passages`` rows with the lowest id hashes, of
    each one passage of PASSAGE_CHARS characters at a hashed place, make a dictionary; the
    logistic curve is fitted on ``calibration`` other rows' whole texts. Labels other than 0 and
    1, null ids and ids without a document are not learned from; repeated label rows count once.
    Without rows of both labels every score is the share of good labels, or 1 without any label.
    """
    c = F.col
    place = F.xxhash64(c("doc_id").cast("string"))
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(c("quality").isin(0, 1) & (remainder("doc_id") != held_out)).distinct()
    known = known.join(docs.select("doc_id").distinct(), "doc_id").withColumns({"_hash": place, "_test": remainder("doc_id") == (held_out + 1) % 4})
    lowest = lambda df, n: df.orderBy("_hash", "quality").limit(n)
    chosen = [lowest(known.filter(~c("_test") & (c("quality") == q)), passages) for q in (0, 1)] + [lowest(known.filter("_test"), calibration)]
    sample = chosen[0].unionByName(chosen[1]).unionByName(chosen[2])  # at most 2 * passages + calibration rows
    of_sample = docs.select("doc_id", c("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    blocks = F.greatest(F.ceil(F.length("text") / PASSAGE_CHARS), F.lit(1))
    passage = F.substring("text", (F.pmod(F.xxhash64(c("_hash")), blocks) * PASSAGE_CHARS + 1).cast("int"), F.lit(PASSAGE_CHARS))
    taught = of_sample.filter(~c("_test") & (F.length("text") > 0)).dropDuplicates(["doc_id", "quality"]).select("quality", passage.alias("passage")).collect()
    by = {q: sorted(r["passage"].encode() for r in taught if r["quality"] == q) for q in (0, 1)}
    share = known.agg(F.avg("quality")).first()[0]
    prior = _log_odds(1.0 if share is None else share)
    if not by[0] or not by[1]:
        return Model(b"", b"", 0.0, prior, prior)
    good, bad = _dictionary(by[1]), _dictionary(by[0])
    tested = with_difference(of_sample.filter("_test"), good, bad, ["quality", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")]).collect()
    x, size, y = (np.array([r[k] for r in tested], float) for k in ("difference", "size", "quality"))
    if len(y) == 0 or y.min() == y.max():  # too few rows to calibrate on: the passages stand in
        x = np.concatenate([*_differences(pa.array([p.decode() for q in (0, 1) for p in by[q]]), _compressor(good), _compressor(bad))])
        size, y = np.array([len(p) for q in (0, 1) for p in by[q]], float), np.repeat([0, 1], [len(by[0]), len(by[1])])
    return Model(good, bad, *_curve(x, size, y, prior), prior)


def with_score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of every row and its ``score``, from 0 to 1; only the text is looked at.

    A null or empty text scores the share of good labels, and so, nearly, does a very short
    one. Repeated rows have equal scores.
    """
    if not model.good:
        return docs.select(*keep, F.lit(1 / (1 + math.exp(-model.prior))).alias("score"))
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0))
    found = with_difference(docs, model.good, model.bad, [*keep, size.alias("_size")], text_col)
    weight = F.col("_size") / (F.col("_size") + PRIOR_BYTES)
    z = weight * (F.lit(model.slope) * F.col("difference") + F.lit(model.bias)) + (1 - weight) * F.lit(model.prior)
    return found.withColumn("score", 1 / (1 + F.exp(-z))).drop("difference", "_size")


def op5_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    scored = with_score(docs, model, ["doc_id"])
    return scored.select(
        "doc_id", F.coalesce(remainder("doc_id") == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
ORACLE: dict[str, str] = {}
