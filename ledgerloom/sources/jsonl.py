"""JSON-lines tables: explicit schemas, blank and broken lines handled, partitioned writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CORRUPT = "_corrupt_record"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) matches anything on its own file system."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    matches = fs.globStatus(jvm_path)
    return matches is not None and len(matches) > 0


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, run_id: str | None = None) -> DataFrame:
    """One row per line; blank lines are skipped and a missing path is an empty table.

    Lines that do not parse keep their text in ``_corrupt_record``.
    """
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    if not path_exists(spark, path):
        return spark.createDataFrame([], full)
    df = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return df if run_id is None else df.where(F.col("run_id") == run_id)


def parse_lines(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """The same for lines already in a table, such as an upload."""
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json(column, full, options)
    return lines.where(F.trim(column) != "").withColumn("_row", parsed).select(
        *[c for c in lines.columns if c != column], "_row.*"
    )


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined lines)."""
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, df.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def write_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None, append: bool = False) -> None:
    """Write JSON lines, overwriting the partitions present in ``df`` or appending to them."""
    writer = df.write.mode("append" if append else "overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
        if not append:
            writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.json(path)


def open_lines(lines: DataFrame, schema: T.StructType, column: str = "value", rest: str = "rest") -> DataFrame:
    """Lines of JSON objects of any shape: the fields of ``schema`` typed, all others kept in ``rest``, a map of VARIANT.

    Each line is parsed once, to VARIANT. A known field of another type is NULL and stays in ``rest``
    too, so nothing that was written is lost; an object or array where the schema has a text is its
    JSON. Blank lines are skipped. A line that is no JSON object keeps its text in ``_corrupt_record``.
    """
    whole = lines.where(F.trim(column) != "").withColumn("_all", F.try_variant_get(F.try_parse_json(column), "$", "map<string,variant>"))
    names = [f.name for f in schema.fields]
    given = {name: F.try_element_at("_all", F.lit(name)) for name in names}
    known = {f.name: F.try_variant_get(given[f.name], "$", f.dataType.simpleString()) for f in schema.fields}
    misfit = [F.when(known[x].isNull() & (F.schema_of_variant(given[x]) != "VOID"), F.struct(F.lit(x).alias("key"), given[x].alias("value"))) for x in names]
    left = F.map_concat(F.map_filter("_all", lambda name, v: ~name.isin(names)), F.map_from_entries(F.array_compact(F.array(*misfit))))
    others = [c for c in lines.columns if c != column and c not in names]
    return whole.select(*others, *[v.alias(name) for name, v in known.items()], left.alias(rest), F.when(F.col("_all").isNull(), F.col(column)).alias(CORRUPT))


def read_open_jsonl(spark: SparkSession, path: str, schema: T.StructType, run_id: str | None = None) -> DataFrame:
    """``open_lines`` of files; a missing path is an empty table."""
    lines = spark.read.text(path) if path_exists(spark, path) else spark.createDataFrame([], "value string")
    rows = open_lines(lines.select("value"), schema)
    return rows if run_id is None else rows.where(F.col("run_id") == run_id)


def field_counts(rows: DataFrame, rest: str = "rest") -> DataFrame:
    """(field, type, rows): how often each field that the schema doesn't name, or names with another type, was written."""
    # explode would infer a filter that repeats all of the parsing
    entries = rows.select(F.explode_outer(rest).alias("field", "_value")).where(F.col("field").isNotNull())
    return entries.groupBy("field", F.schema_of_variant("_value").alias("type")).agg(F.count(F.lit(1)).alias("rows"))
