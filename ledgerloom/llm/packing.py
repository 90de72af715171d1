"""Best-fit packing by exact complements: lengths that sum to the capacity are found by hashed sums and consumed by count.

How pieces are packed depends only on how many there are of each length, so the plan is made
from one row a length (at most ``capacity`` rows, whatever the table's size) and is at most a few
thousand rows. Pieces get a rank among those of their length and are placed by joining their
rank with the plan's intervals. No piece, group or table passes through the driver or one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerloom.llm.wordids import word_ids
from ledgerloom.session import shared_dir, stored

CAPACITY = 2048
#: Id after each document's last token.
END_ID = 0
#: Parts into which the pieces of one length are dealt while they get ranks.
RANK_PARTS = 256


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each text's token ids and END_ID, cut into pieces only where they are longer than ``capacity``.

    Returns the id, piece (from 0), start, length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit) and, with_ids, the ids themselves. A null or empty text is the single id
    END_ID. Repeated rows each have their pieces; other columns are not read. No shuffle.
    """
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = picked.schema["id"].dataType.simpleString()
    end = END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        for batch in batches:
            row, start, length, crc, parts = [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                ids = memoryview(words.of(text.as_py() or "") + end)
                for at in range(0, len(ids), 4 * capacity):
                    part = ids[at : at + 4 * capacity]
                    row.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        parts.append(bytes(part))
            begin = pa.array(start, pa.int64())
            piece = pa.array([x // capacity for x in start], pa.int32())
            columns = [batch.column(0).take(pa.array(row, pa.int64())), piece, begin, pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *([pa.array(parts, pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return picked.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in them, how many such sequences), from the count of each length.

    Longest first. The gap a length leaves is filled by one length, else by two, else by
    three that sum to it exactly, as often as their counts allow; what no exact sum fills takes
    the longest lengths that fit, one after another.
    """
    left = Counter({n: c for n, c in counts.items() if c > 0})
    present = sorted(left)
    made: list[tuple[tuple[int, ...], int]] = []

    def fits(parts: tuple[int, ...]) -> int:
        """How many times the parts can be taken together."""
        return min(left[n] // k for n, k in Counter(parts).items()) if parts else 0

    def take(parts: tuple[int, ...]) -> int:
        times = fits(parts)
        if times:
            made.append((parts, times))
            for n in parts:
                left[n] -= times
        return times

    def pairs(total: int) -> Iterator[tuple[int, int]]:
        """Pairs with this sum: of each length at most half of it, the complement is looked up."""
        for n in reversed(present[: bisect.bisect_right(present, total // 2)]):
            if left[n] and left.get(total - n):
                yield total - n, n

    for longest in reversed(list(present)):
        gap = capacity - longest
        if not left[longest]:
            continue
        if gap == 0:
            take((longest,))
            continue
        if left.get(gap):
            take((longest, gap))
        if left[longest]:
            for a, b in pairs(gap):
                take((longest, a, b))
                if not left[longest]:
                    break
        if left[longest]:
            small = [n for n in present if n <= gap and left[n]]
            for a in reversed(small):
                if not left[longest]:
                    break
                for b, c in pairs(gap - a):
                    if b > a:
                        break  # met before with the longer of the two in front
                    take((longest, a, b, c))
                    if not left[longest] or not left[a]:
                        break
        while left[longest]:
            chosen, room, spare = [longest], gap, left.copy()
            spare[longest] -= 1
            while (k := bisect.bisect_right(present, room)) and (best := next((n for n in reversed(present[:k]) if spare[n]), 0)):
                chosen.append(best)
                spare[best] -= 1
                room -= best
            take(tuple(chosen))
        present = [n for n in present if left[n]]
    return made


def _intervals(made: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """For each length: first rank, sequence of that rank, offset; ranks go up within an interval with the sequence."""
    ranks: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    first = 0
    for parts, times in made:
        at = 0
        for n in parts:
            out[n].append((ranks[n], first, at))
            ranks[n] += times
            at += n
        first += times
    return out


def with_rank(pieces: DataFrame, key: str, order: list[str], parts: int = RANK_PARTS) -> DataFrame:
    """Adds ``rank``: 0, 1, … among the rows of a key, without gathering a key's rows in one task.

    Rows are dealt to ``parts`` by a hash of ``order``, numbered in each, and shifted by the
    counts of the parts before.
    """
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1
    return dealt.withColumn("_own", own).join(shifts, [key, "_part"]).withColumn("rank", F.col("_own") + F.col("_shift")).drop("_part", "_own", "_shift")


def pack(pieces: DataFrame, capacity: int = CAPACITY, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` from 1 to ``capacity``.

    Every piece is in one sequence, sequences hold at most ``capacity`` and their offsets have
    no gaps. Ties and repeated rows are placed apart, in any order. Other lengths (null, 0 or
    above the capacity) keep their row with null places. An empty table stays empty.
    ``pieces`` is read twice: store it first if it is costly.
    """
    sound = F.col("length").between(1, capacity)
    ok = pieces.filter(sound)
    counts = {r["length"]: r["n"] for r in ok.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    spans = _intervals(plan(counts, capacity))
    ranked = with_rank(ok, "length", list(key))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lows = {n: [x[0] for x in of] for n, of in spans.items()}
        for frame in frames:
            at = [spans[n][bisect.bisect_right(lows[n], r) - 1] for n, r in zip(frame["length"], frame["rank"], strict=True)]
            frame["sequence_id"] = [seq + r - low for (low, seq, _), r in zip(at, frame["rank"], strict=True)]
            frame["offset"] = [off for _, _, off in at]
            yield frame[names]

    names = [*pieces.columns, "sequence_id", "offset"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    placed = ranked.mapInPandas(place, schema)
    odd = pieces.filter(~F.coalesce(sound, F.lit(False))).withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    return placed.unionByName(odd)


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every document, stored once in the shared folder, then packed."""
    pieces = stored(token_pieces(docs, tokenizer_path, capacity), shared_dir(docs.sparkSession, "pieces"))
    return pack(pieces, capacity, ("doc_id", "piece", "ids_crc32"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{d}/documents.parquet"), tokenizer_file())


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
ORACLE: dict[str, str] = {}
