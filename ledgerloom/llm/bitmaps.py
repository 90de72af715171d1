"""Semi-join filters of fixed size: which rows may be needed is told before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Bits of a bitmap. The more keys, the more other rows pass too; none that is needed is missed.
BITS = 1 << 20


def may_be_among(table: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``table`` whose ``columns`` may equal a row of ``keys``; a join has to follow. Nothing of ``table`` is shuffled.

    The bitmap is a scalar subquery: as a constant it would stand in every text of the plan, which the driver keeps.
    """
    slot = F.pmod(F.xxhash64(*columns), F.lit(BITS))
    bit = F.expr("shiftleft(1, cast(slot & 31 as int))").alias("bits")
    words = keys.select(slot.alias("slot")).select(F.shiftright("slot", 5).cast("int").alias("word"), bit)
    every = words.unionByName(keys.sparkSession.range(BITS // 32).select(F.col("id").cast("int").alias("word"), F.lit(0).alias("bits")))
    listed = F.sort_array(F.collect_list(F.struct("word", "bits")))  # BITS / 32 rows, whatever the tables' sizes
    bitmap = every.groupBy("word").agg(F.bit_or("bits").alias("bits")).agg(F.transform(listed, lambda x: x["bits"]).alias("bitmap"))
    found = table.withColumn("_slot", slot).withColumn("_word", F.get(bitmap.scalar(), F.shiftright("_slot", 5).cast("int")))
    return found.filter(F.expr("(shiftright(_word, cast(_slot & 31 as int)) & 1) = 1")).drop("_slot", "_word")
