"""Document fingerprints by spot signatures: chains of content words that follow common words."""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import bytehash as B

#: Common words of English, German, French and Spanish at which chains begin; all other words are content.
ANCHORS = (
    "a an and are as at be by for from had has have in is it of on or that the this to was were will with "
    "als auf aus bei das dem den der des die ein eine einen für im ist mit nicht sich sie und von zu "
    "au aux avec ce dans de des du en est et il la le les ne par pas pour qui que se sur un une "
    "al como con del el es las lo los más no para por su sus una y"
).split()
CHAIN = 2
#: Content words in a row behind the last common word (or the beginning) from which on each begins a chain itself.
GAP = 16
_R = np.uint64(0xA0761D6478BD642F)
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _anchor_hashes() -> np.ndarray:
    raw = [w.encode() for w in dict.fromkeys(ANCHORS)]
    ends = np.cumsum([len(w) for w in raw])
    return np.sort(B.slice_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends))


_ANCHORS = _anchor_hashes()


def signatures(texts: list[bytes], chain: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """All texts' signatures as ascending distinct (text number << 32 | signature), and where each text's begin (and the end).

    Chains begin at common words, and at each content word where those are missing: in all of a text
    in which no common word has a whole chain, and from the GAP-th content word in a row on in others.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    w_from, w_to = B.runs(_IN_WORD[data], ends - sizes)
    doc, hashes = B.owner(ends, w_from), B.slice_hashes(data, w_from, w_to, fold=True)
    at = np.minimum(np.searchsorted(_ANCHORS, hashes), len(_ANCHORS) - 1)
    common = _ANCHORS[at] == hashes
    content = np.flatnonzero(~common)
    c_doc, c_hash = doc[content], hashes[content]
    spots = np.flatnonzero(common)
    after = np.searchsorted(content, spots)  # the first content word behind each anchor
    behind = np.searchsorted(spots, content)  # the anchors before each content word
    begin = np.maximum(np.searchsorted(c_doc, c_doc), np.concatenate([[0], after])[behind])
    whole = np.zeros(len(spots), bool)
    inside = after + chain <= len(content)
    whole[inside] = c_doc[after[inside] + chain - 1] == doc[spots[inside]]
    spots, after = spots[whole], after[whole]
    value = hashes[spots]
    for k in range(chain):
        value = value * _R + c_hash[after + k]
    anchored = np.zeros(len(texts), bool)
    anchored[doc[spots]] = True
    loose = np.flatnonzero(~anchored[c_doc] | (np.arange(len(content)) - begin >= GAP))
    loose = loose[loose + chain <= len(content)]
    loose = loose[c_doc[loose + chain - 1] == c_doc[loose]]
    plain = np.ones(len(loose), np.uint64)
    for k in range(chain):
        plain = plain * _R + c_hash[loose + k]
    # each text's beginning is an anchor too; there a shorter chain will do, or the first word
    firsts = np.flatnonzero(np.diff(doc, prepend=-1))
    began = doc[firsts]
    head, lead = np.searchsorted(c_doc, began), np.ones(len(firsts), np.uint64)
    for k in range(chain):
        here = head + k < len(content)
        here[here] = c_doc[head[here] + k] == began[here]
        lead[here] = lead[here] * _R + c_hash[head[here] + k]
    bare = lead == 1
    lead[bare] = hashes[firsts[bare]]
    values, owners = np.concatenate([B.mix(value), B.mix(plain), B.mix(lead)]), np.concatenate([doc[spots], c_doc[loose], began])
    keys = np.unique(owners.astype(np.uint64) << np.uint64(32) | values >> np.uint64(32))
    return keys, np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    keys, cuts = signatures(texts)
    low = keys.astype(np.uint32)
    return [low[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of each pair of distinct signatures; of two empty sets 1."""
    numbered = lambda sets: np.concatenate([np.zeros(0, np.uint64), *(s.astype(np.uint64) | np.uint64(k << 32) for k, s in enumerate(sets))])
    both = np.intersect1d(numbered(left), numbered(right), assume_unique=True) >> np.uint64(32)
    shared = np.bincount(both.astype(np.int64), minlength=len(left))
    union = np.array([len(a) + len(b) for a, b in zip(left, right, strict=True)], np.int64) - shared
    return np.where(union > 0, shared / np.maximum(union, 1), 1.0)


def fingerprint_text(signature_set: np.ndarray) -> str:
    """Base64 of the ascending signatures as little-endian 32-bit numbers."""
    return base64.b64encode(signature_set.astype("<u4").tobytes()).decode()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_signatures and signatures, an ascending array of distinct 32-bit values.

    Words are runs of letters, digits and bytes beyond ASCII; A-Z count as a-z. Every text
    with a word has a signature; null, empty and wordless texts have none. Equal texts have
    equal sets. Repeated rows each get a row, null ids stay null, other columns are not read.
    """
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, starts, ends in B.parts(batch.column(1)):
                raw = data.tobytes()
                sets = _sets([raw[a:b] for a, b in zip(starts, ends, strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array([len(s) for s in sets], pa.int32()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "n_signatures", "signatures"])

    return picked.mapInArrow(measure, f"id {picked.schema['id'].dataType.simpleString()}, n_signatures int, signatures array<long>").withColumnRenamed("id", id_col)


def similar(prints: DataFrame, threshold: float = 0.75, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Classes of equal fingerprints, and all pairs of classes whose Jaccard similarity reaches ``threshold``.

    Returns (id, class_id) for every row with a signature, class_id being the smallest id of its
    class, and (left, right, similarity) between class ids, left < right. Sets are dealt by
    bands of set length; only equal or neighbouring bands can reach the threshold. In them,
    sets meet by the signatures of their prefix, so no pair is missed and no group is paired
    as a whole; lengths are compared before the sets are.
    """
    c = F.col
    sized = prints.filter("n_signatures > 0")
    classes = sized.groupBy("signatures").agg(F.min(id_col).alias("class_id"), F.max("n_signatures").alias("n"))
    members = sized.join(classes.select("signatures", "class_id"), "signatures").select(id_col, "class_id")
    band = F.floor(F.log("n") / F.lit(-math.log(threshold)) + 1e-9)
    prefix = F.slice("signatures", F.lit(1), (c("n") - F.ceil(c("n") * threshold - 1e-9) + 1).cast("int"))
    spread = classes.select("class_id", "n", band.alias("band"), F.explode(prefix).alias("signature"))
    left = spread.select(c("class_id").alias("left"), c("n").alias("_n"), "signature", F.explode(F.array(c("band"), c("band") + 1)).alias("band"))
    right = spread.select(c("class_id").alias("right"), "n", "signature", "band")
    # the left band is the lower one; in an equal band the ids decide
    met = left.join(right, ["signature", "band"]).filter((c("left") != c("right")) & (F.least("_n", "n") >= threshold * F.greatest("_n", "n") - 1e-9))
    pairs = met.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct()
    side = lambda name: classes.select(c("class_id").alias(name), c("signatures").alias(f"_{name}"))
    sets = pairs.join(side("left"), "left").join(side("right"), "right")
    shared = F.size(F.array_intersect("_left", "_right"))
    value = shared / (F.size("_left") + F.size("_right") - shared)
    return members, sets.withColumn("similarity", value).filter(c("similarity") >= threshold - 1e-12).select("left", "right", "similarity")


def in_order_with_next(docs: DataFrame, stretches: int) -> DataFrame:
    """(stretch, borrowed, doc_id, text) such that a partition's stretches hold the table in order of id, each followed by the row after it.

    Ids are cut at ``stretches`` of their approximate quantiles, which are ids of the table
    themselves; rows with such an id are also sent, as borrowed, to the end of the stretch before
    (those of the first to the last). One shuffle, and a pass over the ids alone.
    """
    c = F.col
    key = F.coalesce(c("doc_id").cast("long"), F.lit(-(2**63)))  # null comes first
    rows = docs.select("doc_id", c("text").cast("string").alias("text"), key.alias("_key"))
    shares = [k / stretches for k in range(stretches)]
    found = rows.agg(F.min("_key").alias("first"), F.percentile_approx("_key", shares, 100 * stretches).alias("cuts")).first()
    cuts = sorted({found["first"], *found["cuts"]}) if found["cuts"] else [0]
    here = F.aggregate(F.lit(cuts), F.lit(-1), lambda n, x: n + (x <= c("_key")).cast("int"))
    places = F.array(F.struct(c("_at").alias("stretch"), F.lit(False).alias("borrowed")))
    before = F.array(F.struct(F.pmod(c("_at") - 1, F.lit(len(cuts))).alias("stretch"), F.lit(True).alias("borrowed")))
    heads = F.element_at(F.lit(cuts), c("_at") + 1) == c("_key")
    dealt = rows.withColumn("_at", here).withColumn("_to", F.explode(F.when(heads, F.concat(places, before)).otherwise(places)))
    dealt = dealt.select("_to.stretch", "_to.borrowed", "doc_id", "text", "_key")
    return dealt.repartitionByRange("stretch").sortWithinPartitions("stretch", "borrowed", "_key", "text").drop("_key")


def neighbour_fingerprints(docs: DataFrame, stretches: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next text.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many
    first ones (or all) of the next document by ascending doc_id; after the last comes the
    first. Rows of one id follow each other by text, a null id comes first, a null text is empty.
    A table of one row is its own next. Other columns are not read.
    """
    spark = docs.sparkSession
    stretches = stretches or min(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 1000)
    rows = in_order_with_next(docs, stretches)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long"
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def measured(rows: list[tuple], known: np.ndarray | None) -> tuple[pa.RecordBatch, np.ndarray]:
        """rows: (borrowed, id, text); all but the last get a row. known: the first one's signatures."""
        texts, edits = [t for _, _, t in rows], []
        for text, following in zip(texts, texts[1:], strict=False):
            half = len(text) // 2
            edits.append((text[: len(text) - half] + following[:half]).encode())
        skip = known is not None
        sets = _sets([t.encode() for t in texts[skip:]] + edits)
        own = [known, *sets[: len(texts) - 1]] if skip else sets[: len(texts)]
        changed = sets[len(texts) - skip :]
        pick = [k for k in range(len(edits)) if not rows[k][0]]
        of = lambda values: [values[k] for k in pick]
        now, then, new = of(own), of(own[1:]), of(changed)
        columns = [
            of([r[1] for r in rows]), of([len(t) for t in texts]), [hashlib.sha256(edits[k]).hexdigest() for k in pick], [fingerprint_text(s) for s in now],
            [fingerprint_text(s) for s in new], likeness(now, new), likeness(now, then), [len(s) for s in now],
        ]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, types, strict=True)], names=names), own[-1]

    types = [pa.int64() if docs.schema["doc_id"].dataType.simpleString() == "bigint" else None, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, known, size = [], None, 0
        for batch in batches:
            for borrowed, key, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                text = text.as_py() or ""
                group.append((borrowed, key, text))
                size += len(text)
                if size > 500_000 and len(group) > 1:
                    out, known = measured(group, known)
                    yield out
                    group, size = group[-1:], len(text)
        if len(group) > 1:
            yield measured(group, known)[0]

    return rows.mapInArrow(walk, schema)


def op9_document_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return neighbour_fingerprints(spark.read.parquet(f"{d}/documents.parquet"))


QUERIES = {"op9_document_fingerprints": op9_document_fingerprints}
ORACLE: dict[str, str] = {}
