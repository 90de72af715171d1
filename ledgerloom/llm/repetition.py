"""Quality rules on repetition: how much of a text lies inside n-grams and lines that it repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import bytehash as B

#: Most of a text's word characters that may lie in n-grams found twice or more (every occurrence counts).
COVERED = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: Most of its word characters that may lie in lines found twice or more, and most lines that may be repeats.
LINE_CHARS, REPEAT_LINES = 0.40, 0.30
SYMBOLS = b"#*$%&|<>"
WINDOW = 3


def _measured(data, starts, ends, lengths) -> dict[str, np.ndarray]:
    n = len(starts)
    points = B.code_points_before(data)
    w_from, w_to = B.words(data, starts)
    doc = B.owner(ends, w_from)
    chars = (points[w_to] - points[w_from]).astype(np.int64)
    total = lambda weights, of: np.bincount(of, weights, n).astype(np.int64)  # noqa: E731  sums below 2**53 are exact
    out = {"n_words": total(None, doc), "word_chars": total(chars, doc)}
    symbols = np.flatnonzero(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))
    out["n_symbols"] = total(None, B.owner(ends, symbols))

    l_from, l_to = B.runs(data != 10, starts)  # blank lines hold no word, so they may go
    held = np.searchsorted(l_to, w_from, "right")
    line_chars = np.bincount(held, chars, len(l_from)) if len(l_from) else np.zeros(0)
    real = line_chars > 0
    keys = B.in_text(B.slice_hashes(data, l_from[real], l_to[real]), line_doc := B.owner(ends, l_from[real]))
    out["n_lines"] = total(None, line_doc)
    out["n_dup_lines"] = out["n_lines"] - total(None, line_doc[np.unique(keys, return_index=True)[1]])
    again = B.repeated(keys)
    out["dup_line_chars"] = total(line_chars[real][again], line_doc[again])

    hashes = B.slice_hashes(data, w_from, w_to)
    for k in (WINDOW, *lengths):
        gram, at = B.grams(hashes, doc, k)
        hit = at[B.repeated(B.in_text(gram, doc[at]))]
        covered = np.zeros(len(doc), bool)
        for step in range(k):
            covered[hit + step] = True
        if k == WINDOW:
            out["n_repeat_words"] = total(None, doc[covered])
        if k in lengths:
            out[f"dup{k}_chars"] = total(chars[covered], doc[covered])
    return out


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = tuple(COVERED)) -> DataFrame:
    """One row per row of ``docs``: its id and the measures of its whole text. Nothing is shuffled.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a word),
    n_dup_lines (those equal to an earlier line), dup_line_chars (word characters in lines
    found twice or more), n_repeat_words (words in repeated windows of three words), and
    dup<n>_chars for each of ``lengths``: word characters inside n-grams of that many words
    found twice or more. Every occurrence counts, the first included.

    A null or empty text has zeros; a null id stays null; repeated rows each get a row;
    other columns of ``docs`` are not read. An empty table gives an empty table.
    """
    ints = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words", *(f"dup{k}_chars" for k in lengths)]
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = picked.schema["id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, starts, ends in B.parts(batch.column(1)):
                found = _measured(data, starts, ends, lengths)
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], *(pa.array(found[c]) for c in ints)], names=["id", *ints])

    return picked.mapInArrow(measure, f"id {id_type}, " + ", ".join(f"{c} long" for c in ints)).withColumnRenamed("id", id_col)


def verdict(measures: DataFrame, covered: dict[int, float] = COVERED, line_chars: float = LINE_CHARS, repeat_lines: float = REPEAT_LINES) -> DataFrame:
    """Adds ``repetitive``: some share of repeated n-grams, line characters or lines is above its limit. A text without words isn't."""
    c = F.col
    over = [c(f"dup{k}_chars") > share * c("word_chars") for k, share in covered.items()]
    over += [c("dup_line_chars") > line_chars * c("word_chars"), c("n_dup_lines") > repeat_lines * c("n_lines")]
    rule = over[0]
    for x in over[1:]:
        rule = rule | x
    return measures.withColumn("repetitive", rule)


def op7_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    failed = (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    measured = verdict(repetition(spark.read.parquet(f"{d}/documents.parquet")))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & ~c("repetitive")).drop("repetitive")


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE: dict[str, str] = {}
