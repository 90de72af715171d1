"""Headlines: recency, duplicates across feeds, newest n, stored search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.fixed_values import (
    NEWS_BOUNDS,
    NEWS_MAX_AGE_DAYS,
    NEWS_MIN,
    NEWS_TARGET,
    SEARCH_RESULTS,
    SNIPPET_CHARS,
)
from ledgerloom.functions.numbers import clamp
from ledgerloom.functions.texts import squeezed


def clamped(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """The column limited to low..high, with a warning where that changed it."""
    kept = clamp(column, low, high)
    text = F.format_string(f"{column}=%d is outside {low}..{high}, using %d", F.col(column), kept)
    return df.withColumn(f"{column}_warning", F.when(kept != F.col(column), text)).withColumn(column, kept)


def recent(headlines: DataFrame, today: Column, days: int = NEWS_MAX_AGE_DAYS) -> DataFrame:
    """Published from midnight UTC of today - ``days`` on, that instant included."""
    return headlines.where(F.col("published") >= F.date_sub(today, days).cast("timestamp"))


def story_key(title: str = "title") -> Column:
    """Same text apart from case and white space = same story; long texts are keyed by digest."""
    return F.sha2(F.lower(squeezed(title)), 256)


def unique_stories(headlines: DataFrame) -> DataFrame:
    """One row per (ticker, story): the earliest feed's, then the earliest position.

    The digest keeps the shuffle key short; the group limit drops copies before the
    shuffle, so a story copied a million times does not meet in one task.
    """
    order = Window.partitionBy("ticker", "_story").orderBy("feed_rank", "pos")
    return (
        headlines.withColumn("_story", story_key())
        .withColumn("_nth", F.row_number().over(order))
        .where("_nth <= 1")
        .drop("_nth")
    )


def topped_up(headlines: DataFrame, n: int = NEWS_TARGET) -> DataFrame:
    """Unique stories; a later feed counts only for tickers whose earlier feeds hold fewer than ``n``.

    Copies are dropped first, in favour of the earlier feed, so each feed's count is
    the number of stories it adds.
    """
    stories = unique_stories(headlines)
    counts = stories.groupBy("ticker", "feed_rank").agg(F.count(F.lit(1)).alias("added"))
    before = Window.partitionBy("ticker").orderBy("feed_rank").rowsBetween(Window.unboundedPreceding, -1)
    read = counts.withColumn("before", F.coalesce(F.sum("added").over(before), F.lit(0))).where(F.col("before") < n)
    return stories.join(read.select("ticker", "feed_rank"), ["ticker", "feed_rank"], "left_semi").drop("_story")


def newest(headlines: DataFrame, n: int = NEWS_TARGET) -> DataFrame:
    """The ``n`` newest per ticker with ``ord`` from 1; on equal times the earlier feed comes first."""
    order = Window.partitionBy("ticker").orderBy(F.col("published").desc(), "feed_rank", "pos")
    return headlines.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= n)


def collect_headlines(headlines: DataFrame, today: Column, n: int = NEWS_TARGET) -> DataFrame:
    """Recent, unique, topped-up, newest first: as many as asked for; :func:`clamped` bounds a caller's number and says so."""
    return newest(topped_up(recent(headlines, today), n), n)


def shortfall(headlines: DataFrame, tickers: DataFrame, n: int = NEWS_TARGET) -> DataFrame:
    """(ticker, headlines, warning): a warning where fewer than min(n, 10) were found."""
    expected = min(n, NEWS_MIN)
    counts = headlines.groupBy("ticker").agg(F.count(F.lit(1)).alias("headlines"))
    found = F.coalesce("headlines", F.lit(0))
    text = F.format_string(
        f"only %d headlines for %s in the last {NEWS_MAX_AGE_DAYS} days, below the minimum of {expected}", found, F.col("ticker")
    )
    return (
        tickers.select("ticker").distinct()
        .join(counts, "ticker", "left")
        .select("ticker", found.alias("headlines"), F.when(found < expected, text).alias("warning"))
    )


def search_hits(raw: DataFrame, n: int = SEARCH_RESULTS) -> DataFrame:
    """Stored search rows (query, pos, title, href, url, body, date) as hits: the first ``n`` per query."""
    order = Window.partitionBy("query").orderBy("pos")
    return (
        raw.withColumn("hit", F.row_number().over(order))
        .where(F.col("hit") <= n)
        .select(
            "query", "hit",
            F.coalesce("title", F.lit("")).alias("title"),
            F.coalesce("href", "url").alias("url"),
            F.coalesce("body", F.lit("")).alias("snippet"),
            F.col("date").alias("published"),
        )
    )


def hit_digest(hits: DataFrame) -> DataFrame:
    """Hits with what is shown to a reader beside the whole snippet: its start and its full length."""
    return hits.withColumns({"snippet_chars": F.length("snippet"), "snippet_preview": F.substring("snippet", 1, SNIPPET_CHARS)})
