"""Phrase collocations: only the longest windows are counted, and ROLLUP sums them to all shorter phrases.

A window is a word and those that follow it in its piece, five in all, padded with '' where the
piece ends. Each word begins one window, so the sums by ever shorter prefixes of the five columns are
the counts of all phrases of five words to one, and of all words: no other n-grams are listed.

A window also ends before a pair or triple of words that can't be frequent. Pairs, and then triples
of pairs that may be, are counted in hashed slots for that, and a slot that counts fewer than ``least``
rules all in it out; no phrase that is frequent holds one of them, so frequent phrases are counted
whole, and only they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerloom.llm import bytehash as B
from ledgerloom.session import shared_dir, spread, stored

WORDS = 5
LEAST, TOP, COVERED = 100, 2000, 100
NAMES = [f"w{k + 1}" for k in range(WORDS)]
#: Bytes of text a slot of the pair and triple counts, and bounds of the number of slots (2 to the power): a bit each, 8 MB at most; and slots that travel together.
BYTES_A_SLOT, FEWEST, MOST, CHUNK = 128, 10, 26, 1 << 14
#: Languages whose totals may be broadcast.
FEW = 10_000
#: Bytes of text that are worked on, and pre-counted, at a time.
RUN = 1 << 21
_ENDS = np.zeros(256, bool)
_ENDS[[46, 44, 59, 58, 33, 63, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _words(langs: pa.Array, texts: pa.Array) -> Iterator[tuple]:
    """Runs of texts: distinct words, and for each word its code among them, its language (a row of ``langs``, by its first), its hash, and whether the next word is in the same piece."""
    named = langs.dictionary_encode()
    names, code = named.dictionary, named.indices.to_numpy()
    first = np.zeros(len(names), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    salt = np.concatenate([np.zeros(0, np.uint64), *(B.slice_hashes(data, a, b) for _, _, data, a, b in B.parts(names))])
    for row, _, data, starts, ends in B.parts(texts, RUN):
        stop = _ENDS[data]
        inside = ~stop & (data != 32) & (data != 9)
        a, b = B.runs(inside, starts)
        held = _FOLD[data[inside]]
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(b - a)])
        words = pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(offsets), pa.py_buffer(held)).dictionary_encode()
        piece = np.cumsum(stop, dtype=np.int32)[a] if len(a) else np.zeros(0, np.int32)
        owner = B.owner(ends, a)
        goes_on = np.zeros(len(a), bool)
        goes_on[:-1] = (piece[1:] == piece[:-1]) & (owner[1:] == owner[:-1])
        of = code[owner + row]
        yield words.dictionary, words.indices.to_numpy().astype(np.int64), first[of], B.mix(B.slice_hashes(data, a, b, fold=True) + salt[of]), goes_on


def _slots(hashes: np.ndarray, slots: int, ahead: int) -> np.ndarray:
    """The slot of the pair (``ahead`` 1) or triple (2) that each word makes with those behind it."""
    key = hashes[: len(hashes) - ahead]
    for k in range(1, ahead + 1):
        key = B.mix(key * np.uint64(3) + hashes[k : len(hashes) - ahead + k])
    return (key & np.uint64(slots - 1)).astype(np.int64)


def _ahead(flags: np.ndarray, k: int) -> np.ndarray:
    """For each word the flag of the k-th word behind it."""
    return np.concatenate([flags[k:], np.zeros(min(k, len(flags)), bool)])


def _linked(hashes: np.ndarray, goes_on: np.ndarray, tables: list[np.ndarray]) -> list[np.ndarray]:
    """For each word, whether it, and the pair and triple that begin there, may be frequent: one array a table (of pairs, then triples)."""
    out = []
    for ahead, bits in enumerate(tables, 1):
        slot = _slots(hashes, 8 * len(bits), ahead)
        may = goes_on.copy() if ahead == 1 else out[0] & _ahead(out[0], 1)
        may[len(slot) :] = False
        may[: len(slot)] &= (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        out.append(may)
    return out


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.coalesce(F.col("text").cast("string"), F.lit("")))


def frequent_slots(docs: DataFrame, slots: int, least: int, tables: list[np.ndarray]) -> np.ndarray:
    """One bit a slot: whether the word pairs of the slot (or, with the table of pairs, the triples of such pairs) occur ``least`` times in all.

    A task counts in one table of all slots, up to a number that is frequent anyway. Tables travel in
    chunks, those with few entries as lists, and are added in two rounds, so that no task meets the chunks of all others.
    """
    ahead = len(tables) + 1
    most = 255 if least <= 255 else (1 << 31) - 1
    kind = np.uint8 if least <= 255 else np.int32
    chunk, rounds = min(slots, CHUNK), max(int(docs.rdd.getNumPartitions() ** 0.5), 1)

    def packed(counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
        places = np.flatnonzero(counts).astype(np.uint16)
        few = 2 * len(places) + len(places) * counts.itemsize < counts.nbytes
        return pa.array([places.tobytes() if few else None], pa.binary()), pa.array([(counts[places] if few else counts).tobytes()])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = np.zeros(slots, kind), TaskContext.get().partitionId() % rounds
        for batch in batches:
            for _, _, _, hashes, goes_on in _words(batch.column(0), batch.column(1)):
                goes = goes_on if not tables else (linked := _linked(hashes, goes_on, tables)[0]) & _ahead(linked, 1)
                slot = _slots(hashes, slots, ahead)
                found, n = np.unique(slot[goes[: len(slot)]], return_counts=True)
                table[found] = np.minimum(table[found] + n, most)
        used = np.flatnonzero(table.reshape(-1, chunk).any(axis=1))
        for at in used.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([part]), *packed(table[at * chunk : (at + 1) * chunk])], names=["at", "part", "places", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(chunk, np.int64)
        for places, counts in zip(rows["places"], rows["counts"], strict=True):
            at = slice(None) if places is None else np.frombuffer(places, np.uint16)
            total[at] = np.minimum(total[at] + np.frombuffer(counts, kind), most)
        places, counts = packed(total.astype(kind))
        return pd.DataFrame({"at": rows["at"].iloc[:1], "places": places.to_pylist(), "counts": counts.to_pylist()})

    parts = _rows(docs).mapInArrow(count, "at long, part long, places binary, counts binary")
    for keys in (["at", "part"], ["at"]):
        parts = parts.groupBy(*keys).applyInPandas(add, "at long, places binary, counts binary")

    def told(places: bytes | None, counts: bytes) -> bytes:
        often = np.zeros(chunk, bool)
        often[slice(None) if places is None else np.frombuffer(places, np.uint16)] = np.frombuffer(counts, kind) >= least
        return np.packbits(often, bitorder="little").tobytes()

    frequent = parts.mapInPandas(lambda frames: (pd.DataFrame({"at": f["at"], "bits": [told(p, x) for p, x in zip(f["places"], f["counts"], strict=True)]}) for f in frames), "at long, bits binary")
    out = np.zeros(slots // chunk * (chunk // 8), np.uint8)  # at most 2 ** MOST bits
    for row in frequent.toLocalIterator():
        out[row["at"] * (chunk // 8) : (row["at"] + 1) * (chunk // 8)] = np.frombuffer(row["bits"], np.uint8)
    return out


def _counted(columns: list[np.ndarray], base: int) -> tuple[np.ndarray, np.ndarray]:
    """The first place of every distinct row of the columns (numbers from -1 below ``base``), and how often it occurs."""
    key = columns[0]
    for column in columns[1:]:
        key = np.unique(key, return_inverse=True)[1] * (base + 1) + column + 1
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    return at, n


def windows(docs: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """(lang, w1 to w5, n): the windows of all words, counted run by run; '' stands behind a piece's end and behind an infrequent pair or triple."""

    def list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, code, lang, hashes, goes_on in _words(batch.column(0), batch.column(1)):
                if not len(code):
                    continue
                linked, triple = _linked(hashes, goes_on, tables)
                columns, whole = [lang, code], linked
                for k in range(1, WORDS):  # the k-th word ahead
                    ahead = np.full(len(code), -1, np.int64)
                    ahead[: len(code) - k] = np.where(whole[: len(code) - k], code[k:], -1)
                    columns.append(ahead)
                    whole = whole & _ahead(triple, k - 1)  # which begins with the pair from the k-th word on
                for chosen in (np.flatnonzero(~linked), np.flatnonzero(linked)):  # most windows are one word
                    part = [x[chosen] for x in (columns if len(chosen) and linked[chosen[0]] else columns[:2])]
                    at, n = _counted(part, len(words))
                    at = chosen[at]
                    names = [batch.column(0).take(pa.array(lang[at]))]
                    names += [words.take(pa.array(x[at], mask=x[at] < 0)).fill_null("").cast(pa.string()) for x in columns[1:]]
                    yield pa.RecordBatch.from_arrays([*names, pa.array(n)], names=["lang", *NAMES, "n"])

    return _rows(docs).mapInArrow(list_windows, "lang string, " + "".join(f"{x} string, " for x in NAMES) + "n long")


def _rolled_up(counted: DataFrame, names: list[str]) -> DataFrame:
    """(lang, k, phrase, f): the sums by all prefixes of ``names``, with k = 0 those by language."""
    summed = counted.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    k, last = F.lit(None).cast("int"), F.lit("")
    for gone in range(len(names) + 1):
        k = F.when(F.col("g") == (1 << gone) - 1, len(names) - gone).otherwise(k)
        last = F.when(F.col("g") == (1 << gone) - 1, F.col(names[len(names) - 1 - gone]) if gone < len(names) else F.lit("all")).otherwise(last)
    return summed.withColumns({"k": k, "_last": last}).filter("_last <> ''").select("lang", "k", F.concat_ws(" ", *names).alias("phrase"), "f")


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, k, phrase, f): all phrases of 1 to 5 words that occur ``least`` times in a language, and with k = 0 its number of words.

    The windows are stored in the shared folder. Those of one word, the most, are summed by
    themselves: no longer phrase begins there.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    slots = 1 << min(max((size // BYTES_A_SLOT).bit_length(), FEWEST), MOST)
    tables: list[np.ndarray] = []
    for _ in ("pairs", "triples"):
        tables.append(frequent_slots(docs, slots, least, tables))
    table = stored(windows(docs, tables), shared_dir(docs.sparkSession, "windows"))
    longer = _rolled_up(table.filter("w2 <> ''"), NAMES).filter((F.col("k") < 2) | (F.col("f") >= least))
    both = longer.unionByName(_rolled_up(table.filter("w2 = ''"), NAMES[:1]))
    return both.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).filter((F.col("k") == 0) | (F.col("f") >= least))


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, cut, l, r, n, score) of every phrase of ``counts`` of two words or more, cut where it holds together least."""
    c = F.col
    totals = counts.filter("k = 0").select("lang", c("f").alias("n"))
    totals = F.broadcast(totals) if totals.count() <= FEW else totals
    part = lambda name, count: counts.filter(f"k between 1 and {WORDS - 1}").select("lang", c("phrase").alias(name), c("f").alias(count))
    candidates = counts.filter("k >= 2").withColumn("ws", F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", "k", c("f").alias("a"), "ws", F.explode(F.sequence(F.lit(1), c("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"first": F.concat_ws(" ", F.slice("ws", 1, c("cut"))), "rest": F.concat_ws(" ", F.slice("ws", c("cut") + 1, c("k") - c("cut")))}).drop("ws")
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_b"))
    return best.select("lang", "phrase", "k", "a", "_b.cut", "_b.l", "_b.r", "n", "_b.score")


def covered(counts: DataFrame, share: int = COVERED) -> DataFrame:
    """(lang, phrase) of those that lie in a longer phrase of ``counts`` which occurs at least ``share`` per cent as often."""
    c = F.col
    longer = counts.filter("k >= 3").select("lang", "k", "f", F.split("phrase", " ").alias("ws"))
    lengths = longer.select("lang", "k", "f", "ws", F.explode(F.sequence(F.lit(2), c("k") - 1)).alias("m"))
    inner = lengths.select("lang", "f", "ws", "m", F.explode(F.sequence(F.lit(1), c("k") - c("m") + 1)).alias("at"))
    inner = inner.groupBy("lang", F.concat_ws(" ", F.slice("ws", c("at"), c("m"))).alias("phrase")).agg(F.max("f").alias("most"))
    return counts.filter("k >= 2").join(inner, ["lang", "phrase"]).filter(100 * c("most") >= share * c("f")).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = COVERED) -> DataFrame:
    """Each language's ``top`` phrases of ``docs`` (text, lang): lang, rank, phrase, k, a, cut, l, r, n, score.

    By score descending, a descending, phrase ascending in bytes. Repeated rows count as often as
    they occur; null and empty texts have no words; other columns don't matter; an empty table has no
    phrases. The counts are stored once in the shared folder.
    """
    counts = stored(phrase_counts(spread(docs.select("text", "lang")), least), shared_dir(docs.sparkSession, "phrase-counts"))
    kept = scored(counts).join(covered(counts, share), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= top).drop("_part")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", F.col("k").cast("long").alias("k"), "a", F.col("cut").cast("long").alias("cut"), "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, d: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{d}/documents.parquet")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES = {"op11_phrase_collocations": op11_phrase_collocations}
ORACLE = {
    "op11_phrase_collocations": r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
    s AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM w),
    g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(ws)),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 100),
    cuts AS (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM c),
    parts AS (SELECT *, array_to_string(ws[1:cut], ' ') AS first, array_to_string(ws[cut + 1:], ' ') AS rest FROM cuts),
    z AS (SELECT x.lang, x.phrase, x.k, x.a, x.cut, y.f AS l, z.f AS r, n.n,
        CAST((CAST(1000 AS HUGEINT) * x.a * n.n) // (CAST(y.f AS HUGEINT) * z.f) AS BIGINT) AS score
      FROM parts x JOIN f y ON y.lang = x.lang AND y.phrase = x.first JOIN f z ON z.lang = x.lang AND z.phrase = x.rest JOIN n ON n.lang = x.lang),
    b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    gone AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c t ON t.lang = s.lang AND t.k > s.k AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * t.a >= 100 * s.a),
    o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b ANTI JOIN gone ON gone.lang = b.lang AND gone.phrase = b.phrase)
    SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score FROM o WHERE rank <= 2000""",
}
