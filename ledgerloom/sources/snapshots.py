"""The snapshot table of finished runs, and the text sink for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.session import shared_dir, stored
from ledgerloom.sources.jsonl import path_exists

SCHEMA_VERSION = 1
#: Into how many files a day's runs are hashed by ticker.
BUCKETS = 16
SKIP_TEMPLATE = "the report was written from a template, so it is not cached"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("ticker"), F.lit(buckets)).cast("int")


def put(fresh: DataFrame, path: str, staged: str, buckets: int = BUCKETS) -> None:
    """Stores rows, one a (ticker, as_of), in place of those of the same keys.

    The table is laid out by day and hashed bucket, so its files grow with the runs of a day and not
    with the number of keys. Only the buckets that ``fresh`` touches are read and written again; their
    new content is complete in ``staged`` before any is replaced, and ``staged`` goes afterwards.
    Buckets are replaced one by one: a reader may meet some before and some after.
    """
    spark = fresh.sparkSession
    rows = fresh.withColumn("bucket", _bucket(buckets))
    if path_exists(spark, path):
        held = spark.read.schema(rows.schema).parquet(path)
        touched = rows.select("as_of", "bucket").distinct()
        rows = rows.unionByName(held.join(touched, ["as_of", "bucket"], "left_semi").join(fresh.select("ticker", "as_of"), ["ticker", "as_of"], "left_anti").select(rows.columns))
    stored(rows, staged).repartition("as_of", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of", "bucket").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(staged)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def save_snapshots(runs: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Store runs (ticker, as_of, schema_version, generated_by, ...) by (ticker, as_of), tickers in upper case.

    A pair that is present again replaces its former run; of several runs of a pair the one
    with the greatest ``order`` columns (else the greatest row) is stored. Template-written
    runs are never stored. A null ticker or day makes no key, so its runs are not stored either.
    """
    kept = runs.where("generated_by <> 'template' and ticker is not null and as_of is not null").withColumn("ticker", F.upper("ticker"))
    rest = [c for c in runs.columns if c not in ("ticker", "as_of")]
    ranked = [*(order or []), *[c for c in rest if c not in (order or [])]]
    newest = kept.groupBy("ticker", "as_of").agg(F.max(F.struct(*ranked)).alias("_run"))
    put(newest.select("ticker", "as_of", *[F.col("_run")[c].alias(c) for c in rest]), path, shared_dir(runs.sparkSession, "snapshots"))


def save_actions(runs: DataFrame) -> DataFrame:
    """What saving does with each run: save, or skip_save with its reason."""
    template = F.col("generated_by") == "template"
    return runs.select(
        "ticker", "as_of",
        F.when(template, "skip_save").otherwise("save").alias("action"),
        F.when(template, SKIP_TEMPLATE).alias("reason"),
    )


def read_snapshots(spark: SparkSession, path: str, schema) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select([f.name for f in schema.fields])


def lookup(requests: DataFrame, stored: DataFrame, version: int = SCHEMA_VERSION) -> DataFrame:
    """Requests (ticker, as_of, force_refresh) with action hit, miss or skip and its reason.

    ``stored`` has tickers in upper case; of its days only those of the requests are read.
    """
    found = stored.select(
        "ticker", "as_of", F.col("schema_version").alias("stored_version"), "payload",
        F.lit(True).alias("found"),
    )
    joined = requests.withColumn("ticker", F.upper("ticker")).join(found, ["ticker", "as_of"], "left")
    forced = F.coalesce("force_refresh", F.lit(False))
    readable = F.col("payload").isNotNull()
    same = F.coalesce(F.col("stored_version") == version, F.lit(False))
    hit = ~forced & readable & same
    reason = (
        F.when(forced, "force_refresh")
        .when(F.col("found").isNull(), "no file")
        .when(~readable, "unreadable")
        .when(~same, F.format_string(f"schema version %d, expected {version}", "stored_version"))
    )
    return joined.select(
        "ticker", "as_of",
        F.when(forced, "skip").when(hit, "hit").otherwise("miss").alias("action"),
        reason.alias("reason"),
        F.when(hit, F.col("payload")).alias("payload"),
    )


def to_recompute(requests: DataFrame, stored: DataFrame, version: int = SCHEMA_VERSION) -> DataFrame:
    """Requests without a usable snapshot: forced ones, and an anti join with ``stored`` (tickers in upper case) for the rest."""
    usable = stored.where((F.col("schema_version") == version) & F.col("payload").isNotNull()).select("ticker", "as_of")
    wanted = requests.withColumn("ticker", F.upper("ticker"))
    forced = F.coalesce("force_refresh", F.lit(False))
    return (
        wanted.where(~forced).join(usable, ["ticker", "as_of"], "left_anti").unionByName(wanted.where(forced))
    )


def save_reports(reports: DataFrame, path: str) -> None:
    """One Markdown text per ticker, in a folder per ticker; a rerun replaces only its tickers."""
    (
        reports.select("ticker", F.col("markdown").alias("value"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ticker")
        .text(path)
    )
