"""The corpus pipeline: from documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
Null, empty, very long and repeated texts and ids are treated as each operator's docstring
says; an empty table stays empty through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import compression, linededup, oddsketch, packing, secrets
from ledgerloom.session import shared_dir, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score is below the threshold; learns from labelled documents of the input."""
    model = compression.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row"), "text")
    return compression.with_score(rows, model, ["row"]).filter(F.col("score") >= compression.THRESHOLD).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that nearly repeat an earlier one, short ones too (up to 5 distinct words only of equal sets of words).

    A document that had no other line goes, all others stay.
    """
    return linededup.cleaned(docs, least_words=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that with the smallest id (null last), then hash of the text.

    Rows equal in id and text are one document; all of them stay or go.
    """
    found = oddsketch.near_duplicates(docs)
    gone = found.filter(~F.col("first")).select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("_doc"), F.col("copy").alias("_copy")).distinct()
    doc, copy = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(gone, (doc == F.col("_doc")) & (copy == F.col("_copy")), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every reported span of keys and linked credentials in the texts; all documents stay."""
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences."""
    return packing.packed_documents(docs, packing.tokenizer_file())


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("secret_scans", secret_scan),
    ("best_fit_packing", best_fit_packing),
]
#: Scores and token ids can't be computed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each stage's rows are stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), shared_dir(spark, name))
    return STAGES[-1][1](spark, docs, sf_dir)
