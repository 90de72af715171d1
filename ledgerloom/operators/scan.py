"""Seeded recursive smoothing of series of any length, by an associative scan.

A step y + alpha * (x - y) is an affine map of y, and affine maps compose: the values of a range
are those it has from 0 on, plus the decayed value that enters it. So ranges are worked out apart, the
entering values are folded from one row a range, and a series of any length is spread over many tasks.
Daily bars, bounded by the calendar, are smoothed by :mod:`ledgerloom.operators.smoothing`; this is for ticks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledgerloom.session import shared_dir, stored


def _scanned(df: DataFrame, keys: list[str], order: str, sound: str, value: str, alpha: float, ranges: int | None) -> DataFrame:
    """``df`` in ranges of equal size by keys and order, with ``_range``, ``_own`` (the row's place in its key's part of the range, from 1) and ``_local`` (the smoothed value from 0 on).

    Rows that aren't ``sound`` are spread by a hash of the row and have no place.
    """
    odd = F.when(~F.col(sound), F.xxhash64(*df.columns))
    # sound rows of a key are neighbours: rows without a place come first
    by = [sound, *keys, order, "_odd"]
    cut = df.withColumn("_odd", odd).repartitionByRange(*([ranges] if ranges else []), *by).sortWithinPartitions(*by).drop("_odd").withColumn("_range", F.spark_partition_id())
    keep = 1 - alpha

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, y = None, 0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            # a batch begins a key if its first row's key is another than the last one of the batch before
            changed = np.zeros(batch.num_rows, bool)
            for k in keys:
                column = batch.column(k)
                changed[1:] |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
            key = [batch.column(k)[0].as_py() for k in keys]
            if key != last:
                n, y = 0, 0.0
            place, local = np.zeros(batch.num_rows, "int64"), np.zeros(batch.num_rows)
            good = batch.column(sound).to_numpy(zero_copy_only=False)
            begin = int(np.argmax(good)) if good.any() else batch.num_rows
            steps = alpha * batch.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
            cuts = [begin, *(int(c) for c in np.flatnonzero(changed) if c > begin), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if changed[a : a + 1].any():
                    n, y = 0, 0.0
                if a < b:
                    local[a:b] = list(accumulate(steps[a:b].tolist(), lambda y, x: keep * y + x, initial=y))[1:]
                    place[a:b] = np.arange(n + 1, n + 1 + b - a)
                    n, y = int(place[b - 1]), float(local[b - 1])
            last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
            if not good[-1]:
                n, y = 0, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, mask=~good), pa.array(local, mask=~good)], names=[*batch.schema.names, "_own", "_local"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", _own long, _local double"
    return cut.mapInArrow(scan, schema)


def seeded_scan(df: DataFrame, keys: list[str], order: str, value: str, window: int, alpha: float, name: str = "smoothed", ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``: y += alpha * (x - y), started by the mean of the first ``window`` values on the last of them, for 0 < alpha < 1.

    Rows with a null or NaN value, key or order have no place in the series and NULL; so have those before
    the seed and all of a shorter series. ``order`` is unique in a key. Rows are dealt into ranges and
    stored once; what else is shuffled is a row a key and range.
    """
    c = F.col
    keep = F.lit(1 - alpha)
    sound = F.lit(True)
    for column in (*keys, order, value):
        sound &= c(column).isNotNull()
        if dict(df.dtypes)[column] in ("double", "float"):
            sound &= ~F.isnan(column)
    rows = stored(_scanned(df.withColumns({"_sound": sound, "_x": c(value).cast("double")}), keys, order, "_sound", "_x", alpha, ranges), shared_dir(df.sparkSession, "ranges"))
    placed = rows.where(c("_own").isNotNull())
    # a row a key and range: its rows, its last local value and the first ``window`` values, as far as it has them
    early = F.collect_list(F.when(c("_own") <= window, F.struct("_own", "_x")))
    parts = placed.groupBy(*keys, "_range").agg(F.max(F.struct("_own", "_local")).alias("_end"), F.transform(F.array_sort(early), lambda e: e["_x"]).alias("_early"))
    listed = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_range", c("_end._own").alias("n"), c("_end._local").alias("y"), "_early"))).alias("_parts"))
    first = F.aggregate("_parts", F.array().cast("array<double>"), lambda seen, p: F.when(F.size(seen) < window, F.slice(F.concat(seen, p["_early"]), 1, window)).otherwise(seen))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("y"))
    start = F.struct(F.array().cast("array<struct<part:int,n:bigint,y:double>>").alias("all"), zero.alias("last"))

    def step(done, p):
        before = done["last"]
        now = F.struct((before["n"] + p["n"]).alias("n"), (before["y"] * F.pow(keep, p["n"].cast("double")) + p["y"]).alias("y"))
        return F.struct(F.concat(done["all"], F.array(F.struct(p["_range"].alias("part"), before["n"].alias("n"), before["y"].alias("y")))).alias("all"), now.alias("last"))

    heads = listed.select(*keys, first.alias("_first"), F.explode(F.aggregate("_parts", start, step, lambda done: done["all"])).alias("_head")).where(F.size("_first") == window)
    # the recursion starts with the mean instead of what the first values come to from 0 on
    mean = F.aggregate("_first", F.lit(0.0), lambda a, x: a + x) / window
    from_zero = F.aggregate("_first", F.lit(0.0), lambda y, x: keep * y + alpha * x)
    heads = stored(heads.select(*keys, c("_head.part").alias("_range"), c("_head.n").alias("_before"), c("_head.y").alias("_in"), mean.alias("_mean"), from_zero.alias("_zero")), shared_dir(df.sparkSession, "heads"))
    at = c("_before") + c("_own")
    whole = c("_local") + c("_in") * F.pow(keep, c("_own").cast("double"))
    smoothed = F.when(at == window, c("_mean")).when(at > window, whole + (c("_mean") - c("_zero")) * F.pow(keep, (at - window).cast("double")))
    return rows.join(heads, [*keys, "_range"], "left").select(*df.columns, F.when(c("_own").isNotNull(), smoothed).alias(name))
