"""Token counts as additive rollups that are kept by deltas: signed inserts, deletes and revised counts, committed batch by batch.

A rollup is a shared folder. Each commit of a batch writes a new folder of its own and counts from when Spark
has marked it complete, so a failure leaves what was there before; of several commits of a batch the
last counts. Compaction writes the totals and the ids of the batches in them; a batch that is
sent again after that changes nothing.
"""

from __future__ import annotations

import functools
import os
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm.packing import tokenizer_file
from ledgerloom.llm.pieces import SPACE, model_file, pieces_of
from ledgerloom.llm.wordids import word_ids
from ledgerloom.session import shared_dir, stored

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["docs", "tokens", "chars"]
#: Bytes of texts whose words are looked up together, about.
TOGETHER = 4 << 20
_SCHEMA = ", ".join(f"{k} string" for k in KEYS) + ", " + ", ".join(f"{k} long" for k in SUMS)


def tokenizers() -> dict[str, str]:
    """The versions that are counted, and the file of each."""
    return {"word_bpe_49k": tokenizer_file(), "piece_bpe_32k": model_file()}


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in parts of at most TOGETHER bytes, or of one text; null is empty."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")), at + 1)
        yield texts[at:to]
        at = to


def _runs(texts: pa.Array, mark: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different runs of texts cut at each ``mark``; the runs of all texts by number; and where each text's end."""
    parts = pc.split_pattern(texts, mark)
    coded = parts.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))


def _summed(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the values up to each end, from the end before on."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return np.diff(upto[np.concatenate([[0], ends])])


@functools.lru_cache(maxsize=2)
def _library(path: str):
    """The model as its library reads it, for all tasks of a worker."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _piece_counts(path: str, texts: pa.Array) -> list[int]:
    """How many pieces each text has, by the model's library.

    Before a space that follows another character no piece goes on (``pieces_of`` checks that the model is
    so), so texts are cut at spaces and each different run of many texts is encoded once. Texts with
    spaces in a row or in front, or with space marks, are encoded whole.
    """
    model, out = _library(path), []
    mark = len(pieces_of(path).unit(SPACE)) // 4  # a space at the end stands alone
    for part in _slices(texts):
        runs, index, ends = _runs(part, " ")
        n = np.fromiter(map(len, model.encode(runs)), np.int64, len(runs))
        n[[k for k, run in enumerate(runs) if not run]] = mark
        whole = pc.or_(pc.match_substring_regex(part, f"^ |  |{SPACE}"), pc.equal(part, "")).to_numpy(zero_copy_only=False)
        out += [len(model.encode(part[k].as_py())) if whole[k] else x for k, x in enumerate(_summed(n[index], ends).tolist())]
    return out


def _counts(path: str, texts: pa.Array) -> list[int]:
    if path.endswith(".json"):
        words = word_ids(path)
        return [len(words.of(x.as_py() or "")) // 4 for x in texts]
    return _piece_counts(path, texts)


def counted(docs: DataFrame, versions: dict[str, str] | None = None, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(copy, source, lang, tokenizer, tokens, chars): a row a document and version, in one pass over whole texts.

    copy is a digest of the text; chars are code points. A null text is empty and has no tokens. Null
    keys stay. Repeated rows are counted each; other columns are not read. Nothing is shuffled.
    """
    versions = tokenizers() if versions is None else versions
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    picked = docs.select(F.unhex(F.sha2(text, 256)).alias("copy"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.char_length(text).cast("long").alias("chars"), text.alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, path in versions.items():
                tokens = pa.array(_counts(path, batch.column(4)), pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([name] * len(tokens), pa.string()), tokens, batch.column(3)], names=["copy", *KEYS, "tokens", "chars"])

    return picked.mapInArrow(count, "copy binary, source string, lang string, tokenizer string, tokens long, chars long")


def deltas(changes: DataFrame) -> DataFrame:
    """The signed sums of a batch of changes by KEYS: docs, tokens and chars, all long.

    A change has ``before`` and ``after``, each a struct of KEYS, tokens and chars or null: an insert
    has only ``after``, a delete only ``before``, a revised count both (also where it moves to
    another key). A change with neither is nothing. Null keys are keys like others, null counts
    are 0. Each row is a change: what was changed twice is in the batch twice. Changes of one
    key are summed before they are shuffled, so a hot source is no hot task.
    """
    c = F.col
    signed = lambda side, sign: F.when(c(side).isNotNull(), F.struct(*(c(side)[k].alias(k) for k in KEYS), F.lit(sign).cast("long").alias("docs"), *((sign * F.coalesce(c(side)[k], F.lit(0))).cast("long").alias(k) for k in SUMS[1:])))
    rows = changes.select(F.explode(F.filter(F.array(signed("before", -1), signed("after", 1)), lambda x: x.isNotNull())).alias("_d")).select("_d.*")
    return rows.groupBy(*KEYS).agg(*(F.sum(k).alias(k) for k in SUMS))


def _found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, on whatever file system they are, by name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    matches = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(m.getPath().toString() for m in matches or [])


def _new_name() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def _state(spark: SparkSession, path: str) -> tuple[str | None, set[int], dict[int, str]]:
    """The newest compacted sums, the batches in them, and the folder of each batch that was committed beside them."""
    bases = _found(spark, f"{path}/base/*/batches/_SUCCESS")
    base = os.path.dirname(os.path.dirname(bases[-1])) if bases else None
    covered = {r["batch"] for r in spark.read.schema("batch long").parquet(f"{base}/batches").collect()} if base else set()
    batches = {int(x.split("/")[-3].removeprefix("batch=")): os.path.dirname(x) for x in _found(spark, f"{path}/batch=*/*/_SUCCESS")}  # the last by name wins
    return (f"{base}/sums" if base else None), covered, {k: x for k, x in batches.items() if k not in covered}


def commit(changes: DataFrame, batch_id: int, path: str) -> None:
    """Adds a batch to the rollup in the folder ``path``, which all executors share.

    A batch that is sent again, after a failure or by a stream that replays it, takes the place of
    its former sums, or changes nothing once it is compacted. Batches may come in any order.
    """
    deltas(changes).write.parquet(f"{path}/batch={int(batch_id)}/{_new_name()}")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """The rollup after all committed batches: KEYS and SUMS; keys whose sums are all 0 are gone."""
    base, _, batches = _state(spark, path)
    folders = [*([base] if base else []), *batches.values()]
    rows = spark.read.schema(_SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], _SCHEMA)
    return rows.groupBy(*KEYS).agg(*(F.sum(k).alias(k) for k in SUMS)).filter(" or ".join(f"{k} <> 0" for k in SUMS))


def compact(spark: SparkSession, path: str) -> None:
    """Writes the totals as one folder that stands for all batches so far, so that what ``totals`` reads stays small."""
    _, covered, batches = _state(spark, path)
    new = f"{path}/base/{_new_name()}"
    totals(spark, path).write.parquet(f"{new}/sums")
    spark.createDataFrame([(k,) for k in sorted(covered | set(batches))], "batch long").coalesce(1).write.parquet(f"{new}/batches")


def follow(changes: DataFrame, path: str, checkpoint: str):
    """Commits every micro-batch of a stream of changes; a replayed one replaces itself."""
    return changes.writeStream.foreachBatch(lambda df, batch_id: commit(df, batch_id, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _side(tokens: str = "tokens"):
    return F.struct(*KEYS, F.col(tokens).alias("tokens"), "chars")


def op2_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """The token counts of all documents, kept by five batches: estimates go in, are revised to counts, rows of repeated texts are taken out and put back.

    Between them a batch is sent twice, the batches are compacted, and a compacted one is sent
    again. Texts are counted once, into a stored narrow table that feeds all batches.
    """
    c = F.col
    rows = stored(counted(spark.read.parquet(f"{d}/documents.parquet")), shared_dir(spark, "token-counts")).withColumn("estimate", F.ceil(c("chars") / 4))
    none = F.lit(None).cast("struct<source:string,lang:string,tokenizer:string,tokens:bigint,chars:bigint>")
    entered = rows.select(none.alias("before"), _side("estimate").alias("after"))
    repeated = rows.groupBy("copy").agg(F.count_if(c("tokenizer") == list(tokenizers())[0]).alias("n")).filter("n > 1").select("copy")
    copies = rows.join(repeated, "copy", "left_semi")
    path = shared_dir(spark, "token-rollup")
    commit(entered, 1, path)
    commit(rows.select(_side("estimate").alias("before"), _side().alias("after")), 2, path)
    commit(copies.select(_side().alias("before"), none.alias("after")), 3, path)
    commit(entered, 1, path)
    compact(spark, path)
    commit(entered, 1, path)
    commit(copies.select(none.alias("before"), _side().alias("after")), 4, path)
    return totals(spark, path)


QUERIES = {"op2_token_counts": op2_token_counts}
#: Tokens can't be counted in SQL; the test counts them by the tokenizers' libraries.
ORACLE: dict[str, str] = {}
