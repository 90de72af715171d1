"""Ranked lexical search the other way round: the items are indexed, and documents stream through the index.

The items' terms make an inverted index of bounded size, which every task gets whole; more items
go in several blocks, each a pass over the documents. A document's counts of indexed terms become,
by the postings, its scores for all items that share a term with it, and each task keeps for every
item only a heap of its best documents. Heaps of all tasks are merged in two rounds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegralType, StructType

from ledgerloom.llm import bytehash as B
from ledgerloom.session import shared_dir, spread

BEST = 20
#: Postings of an index block (an item with more is a block of its own): some 10 MB, whatever the number of items.
POSTINGS = 200_000
#: Scores that are held at a time.
AT_ONCE = 1 << 21


@dataclass(frozen=True)
class Index:
    """Ascending term hashes; for each its postings, from offsets on: item numbers and how often the item has the term."""

    keys: np.ndarray
    offsets: np.ndarray
    items: np.ndarray
    times: np.ndarray
    ids: pa.Array


def _letters(data: np.ndarray) -> np.ndarray:
    low = data | 32
    return (data >= 128) | ((low >= 97) & (low <= 122)) | ((data >= 48) & (data <= 57))


def _terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts: first row, end row, and the hash and the text (counted from the first) of every term."""
    for row, end, data, starts, ends in B.parts(texts):
        a, b = B.runs(_letters(data), starts)
        yield row, end, B.slice_hashes(data, a, b, fold=True), B.owner(ends, a)


def build_index(ids: list, texts: list[str | None], kind: pa.DataType) -> Index:
    """The inverted index of some items; terms are told apart by 64-bit hashes."""
    hashes, of, first = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for row, _, found, owner in _terms(pa.array(texts, pa.string())):
        hashes.append(found)
        of.append(owner + row)
    pairs = Counter(zip(np.concatenate(hashes).tolist(), np.concatenate(of).tolist(), strict=True))
    order = sorted(pairs)
    keys, counts = np.unique(np.array([h for h, _ in order], np.uint64), return_counts=True)
    offsets = np.concatenate([[first], np.cumsum(counts)]).astype(np.int64)
    return Index(keys, offsets, np.array([i for _, i in order], np.int64), np.array([pairs[p] for p in order], np.int64), pa.array(ids, kind))


def blocks(items: DataFrame, id_col: str, text_col: str, postings: int = POSTINGS) -> Iterator[Index]:
    """Indexes over all distinct rows of the items, in order of id, each of about ``postings`` postings at most; items stream through the driver."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).distinct().orderBy("id", "text")
    kind = rows.limit(0).toArrow().schema.field("id").type
    ids, texts, size = [], [], 0
    for row in rows.toLocalIterator():
        words = len(row["text"] or "") // 2 + 1
        if ids and size + words > postings:
            yield build_index(ids, texts, kind)
            ids, texts, size = [], [], 0
        ids.append(row["id"])
        texts.append(row["text"])
        size += words
    if ids:
        yield build_index(ids, texts, kind)


def _looked_up(index: Index, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which terms are in the index, and the places of those."""
    if not len(index.keys):
        return np.zeros(len(hashes), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(index.keys, hashes), len(index.keys) - 1)
    hit = index.keys[at] == hashes
    return hit, at[hit]


def _counts(index: Index, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, how often) of the indexed terms, by text."""
    hit, at = _looked_up(index, hashes)
    pairs, times = np.unique(owner[hit] * max(len(index.keys), 1) + at, return_counts=True)
    return pairs // max(len(index.keys), 1), pairs % max(len(index.keys), 1), times


def statistics(docs: DataFrame, index: Index, text_col: str = "text") -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms with repeats, and for each indexed term the documents that hold it; over all rows."""
    n = len(index.keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, some, every = np.zeros(n, np.int64), 0, 0
        for batch in batches:
            for _, _, hashes, owner in _terms(batch.column(0)):
                every, some = every + len(hashes), some + len(np.unique(owner))
                found += np.bincount(_counts(index, hashes, owner)[1], minlength=n)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], at])), pa.array(np.concatenate([[some, every], found[at]]))], names=["term", "n"])

    summed = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    by = {r["term"]: r["n"] for r in summed.collect()}  # a row a term of the index, and two
    df = np.zeros(n, np.int64)
    for term, documents in by.items():
        if term >= 0:
            df[term] = documents
    return by.get(-2, 0), by.get(-1, 0), df


def _chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts whose sizes sum to ``most``, or one text that is larger."""
    total, low = np.cumsum(sizes), 0
    while low < len(sizes):
        high = max(int(np.searchsorted(total, (total[low - 1] if low else 0) + most, "right")), low + 1)
        yield low, high
        low = high


class _Heaps:
    """The best documents of every item so far: item, document, whether its id is null, and score."""

    def __init__(self, items: int, best: int):
        self._n, self._best, self._least = items, best, np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """scores: a row a document, a column an item. Only scores that may be among the best are kept, ties by id."""
        least = self._least
        if len(scores) > self._best:
            least = np.maximum(least, np.partition(scores, len(scores) - self._best, axis=0)[len(scores) - self._best])
        row, item = np.nonzero(scores >= least)
        if not len(row):
            return
        new = [item, ids[row], null[row], scores[row, item]]
        rows = [np.concatenate(pair) for pair in zip(self.rows, new, strict=True)]
        order = np.lexsort((rows[1], rows[2], -rows[3], rows[0]))
        item = rows[0][order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        self.rows = [x[order[rank < self._best]] for x in rows]
        count = np.bincount(self.rows[0], minlength=self._n)
        ends = np.cumsum(count)[count == self._best]
        self._least[count == self._best] = self.rows[3][ends - 1]


def heaps(docs: DataFrame, index: Index, some: int, every: int, df: np.ndarray, best: int = BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item, doc_id, score): from each partition of the documents at most ``best`` rows an item."""
    weight = np.floor(1000 * np.log((2 * some + 2) / (2 * df + 1))).astype(np.int64)
    items, lengths = len(index.ids), np.diff(index.offsets)
    whole = int(np.bincount(index.items, weights=index.times, minlength=1).max()) * int(weight.max(initial=0)) * 10**6 < 1 << 53

    def by_item(text: np.ndarray, term: np.ndarray, gain: np.ndarray, texts: int) -> np.ndarray:
        reps = lengths[term]
        place = np.repeat(index.offsets[term] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
        cell, value = np.repeat(text, reps) * items + index.items[place], np.repeat(gain, reps) * index.times[place]
        if whole:  # every sum is exact in a double
            return np.bincount(cell, weights=value, minlength=texts * items).astype(np.int64).reshape(texts, items)
        out = np.zeros(texts * items, np.int64)
        np.add.at(out, cell, value)
        return out.reshape(texts, items)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Heaps(items, best)
        for batch in batches:
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for row, end, hashes, owner in _terms(batch.column(1)):
                n = np.bincount(owner, minlength=end - row)
                m = np.array([75 + 25 * x * some // every for x in n.tolist()], np.int64) if every else np.full(end - row, 75)
                text, term, tf = _counts(index, hashes, owner)
                gain = weight[term] * (10**9 * tf // (1000 * tf + 12 * m[text]))
                size = np.bincount(text, weights=lengths[term], minlength=end - row).astype(np.int64) + items
                for low, high in _chunks(size, AT_ONCE):
                    a, b = np.searchsorted(text, [low, high])
                    if a < b:
                        kept.add(by_item(text[a:b] - low, term[a:b], gain[a:b], high - low), ids[row + low : row + high], null[row + low : row + high])
        item, doc, null, score = kept.rows
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, pa.int64(), mask=null), pa.array(score)], names=["item", "doc_id", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(stream, "item long, doc_id long, score long")


def merged(found: DataFrame, keys: list[str], best: int = BEST) -> DataFrame:
    """The ``best`` rows of each key with their rank; a key's rows are cut in parts first, so that none meets all of them."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = max(int(found.rdd.getNumPartitions() ** 0.5), 1)
    part = found.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(parts)))
    first = part.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).filter(F.col("rank") <= best).drop("_part")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= best)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", postings: int = POSTINGS) -> DataFrame:
    """Every item's ``best`` documents with a score above 0: item_id, rank, doc_id, score.

    A document's id has to be of an integer type; a null one ranks behind others of its score. Null
    and empty texts share no term with anything. Each row of docs is a document, repeated ones
    too; equal rows of the items count once, and rows of one id with unlike texts are items of their
    own. Other columns don't matter. An empty table on either side gives no rows.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} has to be of an integer type")
    spark, docs = docs.sparkSession, spread(docs.select(id_col, text_col))
    path, number = shared_dir(spark, "ranked-search"), 0
    kind = StructType([items.schema[item_col]]).simpleString()[7:-1].split(":", 1)[1]
    schema = f"item long, doc_id long, score long, item_id {kind}"
    for index in blocks(items, item_col, item_text, postings):
        found = heaps(docs, index, *statistics(docs, index, text_col), best, id_col, text_col)
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(index.ids)), pa.int64()), "item_id": index.ids}))
        found.join(F.broadcast(names), "item").select("item", "doc_id", "score", "item_id").write.parquet(f"{path}/block={number}")
        number += 1
    if not number:
        return spark.createDataFrame([], schema).select("item_id", F.lit(1).alias("rank"), "doc_id", "score")
    rows = spark.read.schema(schema).option("basePath", path).parquet(*(f"{path}/block={k}" for k in range(number)))
    return merged(rows, ["block", "item"], best).select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, d: str) -> DataFrame:
    return search(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet"))


QUERIES = {"op13_ranked_search": op13_ranked_search}
ORACLE = {
    "op13_ranked_search": r"""WITH dt AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    it AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    q AS (SELECT item_id, term, count(*) AS times FROM it GROUP BY ALL),
    n AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY doc_id),
    s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
    m AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // terms) AS m FROM n, s),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term),
    x AS (SELECT q.item_id, tf.doc_id, CAST(sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m.m))) AS BIGINT) AS score
      FROM tf JOIN q USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM x WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
}
