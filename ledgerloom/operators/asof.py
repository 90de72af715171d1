"""As-of lookups: beside each row the last row of another table before it, for keys and times of any frequency.

Rows of one key and time have one answer, so only distinct times are looked up. They are cut into ranges
of (key, time) of about equal size, so a hot key is many ranges and many cold keys are one. The order inside
a range is a window that holds that range only; the last row of each key in a range is carried into the
key's next ones by a table with one row a key and range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.session import shared_dir, stored


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, order: str, strict: bool = False, ranges: int | None = None) -> DataFrame:
    """``left`` with ``as_of``: a struct of the last row of ``right`` with the same keys and a time up to the row's, or before it (``strict``).

    Of several such rows at one time the one with the greatest ``order`` counts. Times are compared as
    those of ``right`` are. Without such a row, or where a key or time is null, ``as_of`` is NULL; null keys and
    times of ``right`` never match. All rows and columns of ``left`` stay, so none may be called as_of.
    ``ranges``: into how many ranges the distinct times are cut; by default as many as shuffles have
    partitions. The ranges are stored in the shared folder, as they are found by sampling.
    """
    c = F.col
    rows = right.dropna(subset=[*keys, right_time])
    last = rows.groupBy(*keys, c(right_time).alias("_time")).agg(F.max_by(F.struct(*[x for x in right.columns if x not in keys]), order).alias("_row"))
    kinds = {name: last.schema[name].dataType for name in ("_time", "_row")}
    timed = left.withColumn("_time", c(left_time).cast(kinds["_time"]))
    asked = timed.select(*keys, "_time").dropna().distinct()
    events = last.withColumn("_given", F.lit(True)).unionByName(asked.withColumns({"_row": F.lit(None).cast(kinds["_row"]), "_given": F.lit(False)}))
    cut = events.repartitionByRange(*([ranges] if ranges else []), *keys, "_time").withColumn("_range", F.spark_partition_id())
    cut = stored(cut, shared_dir(left.sparkSession, "as-of"))
    ends = cut.groupBy(*keys, "_range").agg(F.max_by("_row", F.when(c("_given"), c("_time"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_range", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    # at equal times a row is before the lookup, unless only earlier ones count
    inside = Window.partitionBy(*keys, "_range").orderBy("_time", (c("_given") if strict else ~c("_given"))).rowsBetween(Window.unboundedPreceding, 0)
    found = cut.withColumn("_own", F.last("_row", ignorenulls=True).over(inside)).where("not _given")
    found = found.join(carried, [*keys, "_range"]).select(*keys, "_time", F.coalesce("_own", "_before").alias("as_of"))
    return timed.join(found, [*keys, "_time"], "left").select(*left.columns, "as_of")
