"""RSS documents kept as text columns, parsed into headline rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.texts import blank_to_null, rfc822_utc, squeezed, without_publisher
from ledgerloom.schemas import RSS_SCHEMA

_ITEMS = RSS_SCHEMA["item"].dataType


def _parsed(feeds: DataFrame) -> DataFrame:
    return feeds.withColumn("_rss", F.from_xml("xml", RSS_SCHEMA, {"rowTag": "rss"}))


def broken_feeds(feeds: DataFrame) -> DataFrame:
    """Documents that do not parse as XML: a NULL root, not an error."""
    return _parsed(feeds).where(F.col("_rss.channel").isNull() & F.col("_rss.item").isNull()).drop("_rss")


def feed_items(feeds: DataFrame) -> DataFrame:
    """Every item of (ticker, feed_rank, xml) documents in feed order, with ``usable`` for titled, dated ones."""
    none = F.array().cast(_ITEMS)
    listed = F.concat(F.coalesce("_rss.channel.item", none), F.coalesce("_rss.item", none))
    items = _parsed(feeds).select("ticker", "feed_rank", F.posexplode(listed).alias("pos", "item"))
    publisher = blank_to_null(squeezed("item.source._VALUE"))
    rows = items.select(
        "ticker",
        "feed_rank",
        "pos",
        F.coalesce(squeezed("item.title"), F.lit("")).alias("raw_title"),
        publisher.alias("publisher"),
        rfc822_utc("item.pubDate").alias("published"),
        blank_to_null("item.link").alias("url"),
    )
    title = F.when(F.col("publisher").isNotNull(), without_publisher("raw_title", "publisher")).otherwise(F.col("raw_title"))
    usable = (F.col("raw_title") != "") & F.col("published").isNotNull()
    return rows.select("ticker", "feed_rank", "pos", title.alias("title"), "publisher", "published", "url", usable.alias("usable"))


def parse_feed(feeds: DataFrame) -> DataFrame:
    """Titled, dated items as headlines."""
    return feed_items(feeds).where("usable").drop("usable")


def skipped_items(feeds: DataFrame) -> DataFrame:
    """How many items of each document are not usable; documents without items have no row."""
    return feed_items(feeds).groupBy("ticker", "feed_rank").agg(F.count_if(~F.col("usable")).alias("skipped"))
