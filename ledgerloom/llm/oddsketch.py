"""Near-duplicate documents: MinHash bands propose, odd sketches estimate, whole shingle sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.llm import bytehash as B
from ledgerloom.llm.bitmaps import may_be_among
from ledgerloom.llm.graph import components
from ledgerloom.session import shared_dir, stored

WORDS = 5
#: Percent of the union that two sets must share.
PERCENT = 75
#: A pair of similarity 0.75 shares no band of 40 with 5 samples once in 50,000 times.
BANDS, SAMPLES = 40, 5
#: Bits of an odd sketch, and the estimate below which a pair is not looked at: 4 deviations under the threshold.
BITS, LEAST_ESTIMATE = 512, 0.55
#: Bits of the parity of a whole set. Sets differ in at least as many shingles as these in bits, so no link is missed by them.
PARITY = 2048
_K = BANDS * SAMPLES
_DRAW = np.random.default_rng(7)
_A, _C = _DRAW.integers(0, 1 << 31, _K, np.uint32) * np.uint32(2) + np.uint32(1), _DRAW.integers(0, 1 << 32, _K, np.uint32)


def shingle_sets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Each text's set of shingles as ascending 64-bit hashes; with fewer words, the whole sequence is the only one."""
    w_from, w_to = B.words(data, starts)
    doc, hashes = B.owner(ends, w_from), B.slice_hashes(data, w_from, w_to, fold=True)
    grams, at = B.grams(hashes, doc, words)
    cuts = np.searchsorted(doc[at], np.arange(len(starts) + 1))
    first = np.searchsorted(doc, np.arange(len(starts) + 1))
    out = [np.unique(grams[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for k in np.flatnonzero((first[1:] > first[:-1]) & (cuts[1:] == cuts[:-1])):
        h = hashes[first[k] : first[k + 1]]
        out[k] = B.mix(B.grams(h, np.zeros(len(h), np.int64), len(h))[0] + np.uint64(len(h)))
    return out


def _digest(shingles: np.ndarray) -> int:
    """A 64-bit digest of a set, as a signed number."""
    return int(B.mix(np.array([B.mix(shingles + np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(shingles))], np.uint64)).astype(np.int64)[0])


def _samples(shingles: np.ndarray) -> np.ndarray:
    low = np.full(_K, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 1024):
        drawn = np.multiply.outer(short[k : k + 1024], _A)
        drawn += _C
        np.minimum(low, drawn.min(axis=0), out=low)
    return low


def _folded(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (rows, BANDS) and odd sketches (rows, BITS / 64) of rows of samples."""
    wide = B.mix(samples.astype(np.uint64) + np.arange(_K, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keys = np.zeros((len(samples), BANDS), np.uint64)
    for k in range(SAMPLES):
        keys = B.mix(keys * np.uint64(31) + wide[:, k::SAMPLES])
    rows = np.arange(len(samples), dtype=np.int64)[:, None] * BITS
    flips = np.bincount((rows + (wide % np.uint64(BITS)).astype(np.int64)).ravel(), minlength=len(samples) * BITS) & 1
    sketch = np.packbits(flips.astype(np.uint8).reshape(-1, BITS), axis=1, bitorder="little").view("<i8")
    return keys.astype(np.int64), sketch


def _parity(sets: list[np.ndarray]) -> np.ndarray:
    """Of each whole set, which bits an odd number of its shingles falls on, as rows of 64-bit numbers."""
    odd = np.stack([np.bincount((s % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1 for s in sets])
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<i8")


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, copy (a hash of the text, null as empty), n_shingles, set_id (a digest of the set), bands, sketch and parity of every row. Nothing is shuffled.

    Rows without words have no set: n_shingles 0 and nulls.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("copy"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, starts, ends in B.parts(batch.column(1)):
                sets = shingle_sets(data, starts, ends)
                keys, sketch = _folded(np.stack([_samples(s) for s in sets]))
                none = np.array([len(s) == 0 for s in sets])
                digests = pa.array([_digest(s) for s in sets], pa.int64(), mask=none)
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], batch.column(2)[low:high], pa.array([len(s) for s in sets], pa.int64()), digests, _lists(keys), _lists(sketch), _lists(_parity(sets))], names=names)

    names = ["doc_id", "copy", "n_shingles", "set_id", "bands", "sketch", "parity"]
    return picked.mapInArrow(measure, "doc_id long, copy long, n_shingles long, set_id long, bands array<long>, sketch array<long>, parity array<long>")


def _differing(left: str, right: str, bits: int = BITS) -> Column:
    counts = [F.bit_count(F.col(left)[k].bitwiseXOR(F.col(right)[k])) for k in range(bits // 64)]
    return sum(counts[1:], counts[0])


#: Differing bits that a pair of estimated similarity LEAST_ESTIMATE has.
MOST_BITS = int(BITS / 2 * (1 - math.exp(-4 * _K * (1 - LEAST_ESTIMATE) / BITS)))


def _plausible(n: str, m: str, left: str, right: str, odd: str, even: str) -> Column:
    """By size, by the estimate from the odd sketches, and by what the parities leave possible."""
    most = (F.col(n) + F.col(m)) * (100 - PERCENT) / (100 + PERCENT)
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (_differing(left, right) <= MOST_BITS) & (_differing(odd, even, PARITY) <= most)


def linked(pairs: DataFrame, sets: DataFrame, docs: DataFrame, per_task: int = 200) -> DataFrame:
    """Which of the pairs (lead, member) of set ids share PERCENT of the union of their whole sets, as links (a, b).

    A lead's text is sent once for every ``per_task`` of its members, so a hot lead is spread.
    sets: (set_id, doc, copy); docs: (doc, copy, text), doc being the id or what stands for a null one.
    """
    c = F.col
    sizes = pairs.groupBy("lead").agg(F.ceil(F.count("*") / per_task).cast("int").alias("_salts"))
    members = pairs.join(sizes, "lead").select("lead", F.pmod(F.xxhash64("member"), c("_salts")).cast("int").alias("salt"), F.lit(True).alias("is_member"), c("member").alias("set_id"))
    leads = members.select("lead", "salt").distinct().select("lead", "salt", F.lit(False).alias("is_member"), c("lead").alias("set_id"))
    needs = stored(members.unionByName(leads).join(sets.select("set_id", "doc", "copy"), "set_id"), shared_dir(docs.sparkSession, "needed"))
    texts = may_be_among(docs, needs, ["doc", "copy"]).join(needs, ["doc", "copy"]).select("lead", "salt", "is_member", "set_id", "text")
    dealt = texts.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "is_member")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for batch in batches:
            leads, salts, is_member, ids = (batch.column(k).to_pylist() for k in range(4))
            for low, high, data, starts, ends in B.parts(batch.column(4)):
                found = []
                for k, shingles in zip(range(low, high), shingle_sets(data, starts, ends), strict=True):
                    if _digest(shingles) != ids[k]:
                        continue  # another text of the same id and hash
                    if not is_member[k]:
                        head, own = (leads[k], salts[k]), shingles
                    elif head == (leads[k], salts[k]):
                        shared = len(np.intersect1d(own, shingles, assume_unique=True))
                        if 100 * shared >= PERCENT * (len(own) + len(shingles) - shared):
                            found.append((leads[k], ids[k]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, hub_rounds: int = 1) -> DataFrame:
    """doc_id, copy, n_shingles, component_id, kept and first for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links of at least PERCENT similarity; a
    row is kept if that is its own id. Rows without words are linked with nothing. Copies of
    one set are one node. Rows of a null id take part, and are kept only where no row with an
    id is reachable. Rows of one id with different texts are nodes of their own; their component's
    id counts for each. ``first`` marks one text of every component, that with the smallest id (null
    last) and hash of the text, and rows without words; rows equal in id and text are one.
    Other columns are not read. An empty table gives an empty one.

    Candidates are nodes that share a band. Verifying all of them would take the square of a
    group's size, so in ``hub_rounds`` every node of a bucket is first compared with one hub of
    the bucket (the most similar by sketch, of the buckets it is in; in the first round hubs are
    the nodes that meet most others, in later ones any); afterwards, all pairs that are still in different components,
    fit by size, look similar by sketch and can be linked by their parities are compared. A
    candidate pair goes unverified only where its nodes are already connected.
    """
    c = F.col
    spark = docs.sparkSession
    save = lambda df, name: stored(df, shared_dir(spark, name))
    text, doc = F.coalesce(c("text").cast("string"), F.lit("")), F.coalesce(c("doc_id").cast("long"), F.lit(2**63 - 1))
    texts = docs.select(doc.alias("doc"), F.xxhash64(text).alias("copy"), text.alias("text"))
    rows = save(sketches(docs), "sketches")
    keyed = rows.withColumn("doc", doc)
    firsts = keyed.filter("set_id is not null").groupBy("set_id").agg(F.min(F.struct("doc", "copy")).alias("_first")).select("set_id", "_first.*")
    sets = save(keyed.select("set_id", "doc", "copy", c("n_shingles").alias("n"), "bands", "sketch", "parity").join(firsts, ["set_id", "doc", "copy"]).dropDuplicates(["set_id"]), "sets")

    banded = sets.select("set_id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("met")).filter("met > 1")
    buckets = save(banded.join(shared, "key"), "buckets")
    # how often a node meets others: the text that a group's copies were made from leads
    buckets = save(buckets.select("key", "set_id").join(buckets.groupBy("set_id").agg(F.sum("met").alias("met")), "set_id"), "buckets")
    sizes = sets.select("set_id", "n", "sketch", "parity")
    side = lambda name: sizes.toDF(name, f"n_{name}", f"s_{name}", f"p_{name}")
    labels, tried = None, None

    def labelled() -> DataFrame:
        """Buckets whose nodes are in several components."""
        named = buckets.withColumn("component", c("set_id")) if labels is None else buckets.join(labels, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        return named

    def merged(links: DataFrame) -> DataFrame:
        """Labels after these links."""
        nonlocal labels
        if labels is None:
            return save(components(links).toDF("set_id", "component"), "labels")
        named = lambda name: labels.toDF(name, f"c_{name}")
        between = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
        joined = components(between).toDF("component", "_low")
        old = labels.join(joined, "component", "left").select("set_id", F.coalesce("_low", "component").alias("component"))
        fresh = joined.join(labels.select(c("set_id").alias("component")), "component", "left_anti").select(c("component").alias("set_id"), c("_low").alias("component"))
        return save(old.unionByName(fresh), "labels")

    for turn in range(hub_rounds):
        place = F.xxhash64("set_id", F.lit(turn)) if turn else -c("met")
        table = labelled()
        hubs = table.groupBy("key").agg(F.min_by("set_id", place).alias("lead"), F.min_by("component", place).alias("_hub"), F.min("component").alias("_low"), F.max("component").alias("_high"))
        pairs = table.join(hubs.filter("_low <> _high"), "key").filter("component <> _hub").select("lead", c("set_id").alias("member")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["lead", "member"], "left_anti")
        fit = pairs.join(side("lead"), "lead").join(side("member"), "member").filter(_plausible("n_lead", "n_member", "s_lead", "s_member", "p_lead", "p_member"))
        best = save(fit.groupBy("member").agg(F.min_by("lead", _differing("s_lead", "s_member")).alias("lead")).select("lead", "member"), "hub-pairs")
        if best.isEmpty():
            break
        both_ways = best.unionByName(best.select(c("member").alias("lead"), c("lead").alias("member")))
        tried = both_ways if tried is None else tried.unionByName(both_ways)
        labels = merged(save(linked(best, sets, texts), "linked"))

    table = labelled()
    open_keys = table.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low <> _high").select("key")
    table = save(table.join(open_keys, "key").join(sizes, "set_id"), "open-buckets")
    other = table.select("key", *(c(x).alias(f"{x}_b") for x in ("set_id", "component", "n", "sketch", "parity")))
    pairs = table.join(other, "key").filter((c("component") < c("component_b")) & _plausible("n", "n_b", "sketch", "sketch_b", "parity", "parity_b"))
    pairs = pairs.select(c("set_id").alias("lead"), c("set_id_b").alias("member")).distinct()
    if tried is not None:
        pairs = pairs.join(tried, ["lead", "member"], "left_anti")
    pairs = save(pairs, "open-pairs")
    if not pairs.isEmpty():
        labels = merged(save(linked(pairs, sets, texts), "linked"))

    named = keyed.select("doc_id", "doc", "copy", "n_shingles", "set_id")
    if labels is not None:
        named = named.join(labels, "set_id", "left").withColumn("_group", F.coalesce("component", "set_id"))
    else:
        named = named.withColumn("_group", c("set_id"))
    lowest = named.groupBy("_group").agg(F.min("doc_id").alias("_id"), F.min(F.struct("doc", "copy")).alias("_first"))
    out = named.join(lowest, "_group", "left").withColumn("component_id", F.when(c("set_id").isNull(), c("doc_id")).otherwise(c("_id")))
    kept = c("component_id").isNull() | F.coalesce(c("doc_id") == c("component_id"), F.lit(False))
    first = c("set_id").isNull() | F.coalesce((c("doc") == c("_first.doc")) & (c("copy") == c("_first.copy")), F.lit(False))
    return out.select("doc_id", "copy", "n_shingles", "component_id", kept.alias("kept"), first.alias("first"))


def op10_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op10_minhash_near_dedup": op10_minhash_near_dedup}
ORACLE: dict[str, str] = {}
