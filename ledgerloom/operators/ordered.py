"""Order-dependent values for keys of any size.

A plain window over a key sends all of the key's rows to one task. Here a key is
cut into blocks of ``seq`` values first. ``seq`` is unique per key, so a block holds
at most ``block`` rows; only one summary row per (key, block) is ordered per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 65_536
#: Slots of the table that tells how common hashed values are; values of one slot count together.
SLOTS = 1 << 16


def with_running_sum(
    df: DataFrame, keys: list[str], value: Column, name: str, seq: str = "seq", block: int = BLOCK
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the key's rows up to and including this one."""
    # floor, not integer division: negative numbers must stay ordered too
    blocked = df.withColumns({"_block": F.floor(F.col(seq) / block), "_value": value})
    totals = blocked.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_before") + F.sum("_value").over(inside))
        .drop("_block", "_value", "_before")
    )


def with_position(df: DataFrame, keys: list[str], name: str, seq: str = "seq", block: int = BLOCK) -> DataFrame:
    """Add ``name``: the row's position within its key, from 1."""
    return with_running_sum(df, keys, F.lit(1).cast("bigint"), name, seq, block)


def with_hash_rank(
    df: DataFrame, keys: list[str], order: Column, tie: str, name: str, buckets: int = 4096
) -> DataFrame:
    """Add ``name``: the row's rank within its key by a hex digest, from 1, and ``<name>_of``, the key's size.

    Rows are ranked inside (key, first digits of the digest) and shifted by the sizes
    of the earlier buckets, so a key of any size is ranked by many tasks.
    """
    digest = df.withColumns({"_order": order})
    digest = digest.withColumn("_bucket", F.conv(F.substring("_order", 1, 6), 16, 10).cast("bigint") % (1 << 24))
    digest = digest.withColumn("_bucket", F.floor(F.col("_bucket") / ((1 << 24) // buckets)))
    sizes = digest.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket")
    offsets = sizes.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_size").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy(*keys)).alias(f"{name}_of"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_order", tie)
    return (
        digest.join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_before") + F.row_number().over(inside))
        .drop("_order", "_bucket", "_before")
    )


def exact_quantiles(
    df: DataFrame, keys: list[str], column: str, fractions: list[float], bins: int = 128
) -> DataFrame:
    """(keys, fraction, value): exact quantiles with linear interpolation, for keys of any size.

    Equal values are counted first. Approximate percentiles of a key's distinct values
    cut it into bins of similar size whatever the distribution; ranks are found from the
    bin counts, and only bins that hold a wanted rank are ordered. The cuts decide how
    the work is split, never the result.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    edges = F.percentile_approx("_v", [i / bins for i in range(1, bins)] if bins > 1 else [0.5], 10_000)
    cuts = counted.groupBy(*keys).agg(F.array_distinct(edges).alias("_cuts"), F.sum("_n").alias("_rows"))
    joined = counted.join(cuts, keys) if keys else counted.crossJoin(F.broadcast(cuts))
    binned = joined.withColumn("_bin", F.size(F.filter("_cuts", lambda edge: edge < F.col("_v")))).drop("_cuts")
    totals = binned.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_in_bin"), F.max("_rows").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    ranks = (
        totals.withColumn("_before", F.coalesce(F.sum("_in_bin").over(earlier), F.lit(0)))
        .withColumn("fraction", wanted)
        .withColumn("_at", F.col("fraction") * (F.col("_rows") - 1))
        .withColumn("_first", F.floor("_at") + 1)
        .withColumn("_second", F.ceil("_at") + 1)
        .where((F.col("_second") > F.col("_before")) & (F.col("_first") <= F.col("_before") + F.col("_in_bin")))
        .select(*keys, "_bin", "fraction", "_at", "_first", "_second", "_before")
    )
    inside = Window.partitionBy(*keys, "_bin", "fraction").orderBy("_v")
    picked = (
        binned.select(*keys, "_bin", "_v", "_n")
        .join(ranks, [*keys, "_bin"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_from", F.col("_upto") - F.col("_n"))
    )
    holds = lambda rank: (F.col("_from") < F.col(rank)) & (F.col("_upto") >= F.col(rank))
    return (
        picked.groupBy(*keys, "fraction")
        .agg(
            F.max(F.when(holds("_first"), F.col("_v"))).alias("_a"),
            F.max(F.when(holds("_second"), F.col("_v"))).alias("_b"),
            F.max("_at").alias("_at"),
        )
        .select(
            *keys, "fraction", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))).alias("value")
        )
    )


def slot_levels(hashes: DataFrame, slots: int = SLOTS, rows: Column | None = None) -> bytes:
    """One byte a slot: 3 times the binary logarithm of how many rows of ``hash`` fall in it; ``rows`` where a row stands for several.

    The table's size does not depend on the input's: it orders values from rare to common.
    """
    counts = hashes.groupBy(F.pmod("hash", F.lit(slots)).alias("slot")).agg((F.count(F.lit(1)) if rows is None else F.sum(rows)).alias("rows"))
    every = hashes.sparkSession.range(slots).withColumnRenamed("id", "slot").join(counts, "slot", "left")
    level = F.least((3 * F.log2(F.coalesce("rows", F.lit(0)) + 1)).cast("int"), F.lit(127))
    listed = every.agg(F.sort_array(F.collect_list(F.struct("slot", level.alias("level")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.char(x["level"])), "")
    return listed.select(text.alias("levels")).first()["levels"].encode("ascii")


def rare_first(value: Column, levels: bytes) -> Column:
    """A number that ascends with how common the hashed value is and keeps 55 of its bits."""
    slot = F.pmod(value, F.lit(len(levels))) + 1
    level = F.ascii(F.substring(F.lit(bytearray(levels)), slot.cast("int"), F.lit(1)).cast("string"))
    return F.shiftleft(level.cast("long"), 55).bitwiseOR(F.shiftrightunsigned(value, 9))
