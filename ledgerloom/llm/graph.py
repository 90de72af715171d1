"""Connected components of a table of links, by rounds of stars, all on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.session import shared_dir, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b), the component being the smallest node reached.

    Large-star and small-star rounds alternate until nothing changes; each round is written to
    the shared folder. A node's neighbours are never collected: their minimum is
    aggregated and joined back. Self-links and repeated links do no harm; nulls are dropped.
    """
    spark = links.sparkSession
    c = F.col
    tidy = lambda df: df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(tidy(links.dropna()), shared_dir(spark, "links"))
    before = None
    while True:
        both = edges.unionByName(edges.select(c("b").alias("a"), c("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), c("a")).alias("low"))
        large = tidy(both.filter("b > a").join(lowest, "a").select(c("b").alias("a"), c("low").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.select(c("b").alias("a"), c("low").alias("b")).unionByName(small.select("a", c("low").alias("b")))
        edges = stored(tidy(small), shared_dir(spark, "links"))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(edges.select(c("b").alias("node"), c("b").alias("component")).distinct())
