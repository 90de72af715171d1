"""The market summary: 52-week range, year-to-date return, P/E, latest indicators, ordered warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.fixed_values import FIFTY_TWO_WEEK_DAYS, SUMMARY_INDICATORS
from ledgerloom.functions.numbers import finite, rounded
from ledgerloom.functions.texts import blank_to_null
from ledgerloom.operators.signals import SIGNAL_COLUMNS, with_signal


def fifty_two_week_range(bars: DataFrame, today: Column) -> DataFrame:
    """Per ticker: highest high and lowest low on dates from today - 364 days on, that day included."""
    inside = F.col("date") >= F.date_sub(today, FIFTY_TWO_WEEK_DAYS)
    return bars.groupBy("ticker").agg(
        F.max(F.when(inside, F.col("high"))).alias("high_52w"),
        F.min(F.when(inside, F.col("low"))).alias("low_52w"),
    )


def rolling_52_week_range(bars: DataFrame) -> DataFrame:
    """The same range as of every bar, over a calendar frame."""
    span = Window.partitionBy("ticker").orderBy(F.unix_date("date")).rangeBetween(-FIFTY_TWO_WEEK_DAYS, 0)
    return bars.select(
        "ticker", "date", F.max("high").over(span).alias("high_52w"), F.min("low").over(span).alias("low_52w")
    )


def ytd_return(bars: DataFrame, today: Column) -> DataFrame:
    """Per ticker: percent change from the last close before January 1st of today's year."""
    early = F.when(F.col("date") < F.trunc(today, "year"), F.col("date"))
    picked = bars.where(F.col("close").isNotNull()).groupBy("ticker").agg(
        F.max_by("close", "date").alias("current"), F.max_by("close", early).alias("base")
    )
    change = F.when(F.col("base") > 0, (F.col("current") / F.col("base") - 1) * 100.0)
    return picked.select("ticker", "current", "base", change.alias("ytd_return_pct"))


def rolling_year_base(bars: DataFrame) -> DataFrame:
    """As-of form: at every bar, the last close of the year before."""
    by_year = bars.groupBy("ticker", F.year("date").alias("year")).agg(F.max_by("close", "date").alias("year_close"))
    before = F.lag("year_close").over(Window.partitionBy("ticker").orderBy("year"))
    bases = by_year.select("ticker", "year", before.alias("base_close"))
    return (
        bars.withColumn("year", F.year("date"))
        .join(bases, ["ticker", "year"], "left")
        .select(
            "ticker", "date", "close", "base_close",
            F.when(F.col("base_close") > 0, (F.col("close") / F.col("base_close") - 1) * 100.0).alias("ytd_return_pct"),
        )
    )


def fundamentals(raw: DataFrame) -> DataFrame:
    """One row per ticker: long name, else short name; P/E and EPS only when finite."""
    return raw.select(
        "ticker",
        F.coalesce(blank_to_null("long_name"), blank_to_null("short_name")).alias("company_name"),
        blank_to_null("currency").alias("currency"),
        finite("trailing_pe").alias("trailing_pe"),
        finite("trailing_eps").alias("trailing_eps"),
    )


def pe_ratio(current: Column, pe: Column, eps: Column) -> Column:
    """Trailing P/E when positive, else price / EPS when EPS is positive, else NULL."""
    return F.when(pe > 0, pe).when(eps > 0, current / eps)


def pe_warning(current: Column, pe: Column, eps: Column) -> Column:
    return (
        F.when(pe > 0, F.lit(None).cast("string"))
        .when(eps.isNull(), "P/E unavailable: Yahoo returned neither trailingPE nor trailing EPS")
        .when(
            eps <= 0,
            F.concat(
                F.lit("P/E unavailable: trailing EPS is "), eps.cast("string"),
                F.lit(", and a P/E on negative earnings is meaningless"),
            ),
        )
        .when(current.isNull(), "P/E unavailable: Yahoo returned no trailingPE and there is no current price")
        .otherwise("Yahoo returned no trailingPE, so P/E is computed as current price / trailing EPS")
    )


def latest_figures(bars: DataFrame, today: Column) -> DataFrame:
    """Per ticker, in one pass over bars with indicators: price, year base, 52-week range, latest indicators, signal."""
    date = F.col("date")
    priced = F.when(F.col("close").isNotNull(), date)
    early = F.when(F.col("close").isNotNull() & (date < F.trunc(today, "year")), date)
    inside = date >= F.date_sub(today, FIFTY_TWO_WEEK_DAYS)
    before = F.lag("macd_hist").over(Window.partitionBy("ticker").orderBy("date"))
    kept = list(dict.fromkeys([*SIGNAL_COLUMNS, *SUMMARY_INDICATORS]))
    latest = bars.withColumn("hist_before", before).groupBy("ticker").agg(
        F.max(priced).alias("as_of"),
        F.max_by("close", priced).alias("current"),
        F.max_by("close", early).alias("base"),
        F.max(F.when(inside, F.col("high"))).alias("high_52w"),
        F.min(F.when(inside, F.col("low"))).alias("low_52w"),
        F.max_by("hist_before", "date").alias("hist_yesterday"),
        *[F.max_by(c, "date").alias(c) for c in kept],
    )
    change = F.when(F.col("base") > 0, (F.col("current") / F.col("base") - 1) * 100.0)
    return with_signal(latest.withColumn("ytd_return_pct", change))


def market_summary(
    bars: DataFrame, facts: DataFrame, today: Column, tickers: DataFrame | None = None,
    fetch_warnings: DataFrame | None = None,
) -> DataFrame:
    """One row per ticker: every figure rounded to two decimals, missing ones explained.

    ``bars`` carries indicators and ``facts`` is :func:`fundamentals`. ``tickers`` adds
    rows for tickers without bars, and ``fetch_warnings`` may hold (ticker, warnings
    ARRAY<STRING>) from reading. All inputs to the joins are one row per ticker.
    """
    joined = latest_figures(bars, today)
    if tickers is not None:
        # a ticker without bars has all its votes unavailable, which with_signal works out from its nulls
        kept = [x for x in joined.columns if x not in ("label", "score", "votes", "flags", "unavailable")]
        joined = with_signal(tickers.select("ticker").distinct().join(joined.select(kept), "ticker", "left"))
    joined = joined.join(facts, "ticker", "left")
    if fetch_warnings is None:
        joined = joined.withColumn("fetch_warnings", F.array().cast("array<string>"))
    else:
        named = fetch_warnings.select("ticker", F.col("warnings").alias("fetch_warnings"))
        joined = joined.join(named, "ticker", "left")
    current, pe, eps = F.col("current"), F.col("trailing_pe"), F.col("trailing_eps")
    priced = current.isNotNull()
    day = today.cast("string")
    messages = F.array_compact(
        F.array(
            F.when(~priced, F.concat("ticker", F.lit(": no prices, so current price, 52-week range and YTD return are empty"))),
            F.when(
                priced & F.col("high_52w").isNull(),
                F.concat(F.lit("no bars in the 52 weeks to "), day, F.lit(", so the 52-week high and low are empty")),
            ),
            pe_warning(current, pe, eps),
            F.when(
                priced & F.col("ytd_return_pct").isNull(),
                F.concat(F.lit("no close before "), F.trunc(today, "year").cast("string"), F.lit(", so the YTD return is empty")),
            ),
        )
    )
    entries = []
    for name in SUMMARY_INDICATORS:
        entries += [F.lit(name), rounded(name)]
    return joined.select(
        "ticker",
        "company_name",
        "currency",
        "as_of",
        rounded("current").alias("current_price"),
        rounded("high_52w").alias("high_52w"),
        rounded("low_52w").alias("low_52w"),
        rounded(pe_ratio(current, pe, eps)).alias("pe_ratio"),
        rounded("ytd_return_pct").alias("ytd_return_pct"),
        F.struct("label", "score", "votes", "flags", "unavailable").alias("momentum"),
        F.create_map(*entries).alias("indicators"),
        F.concat(F.coalesce("fetch_warnings", F.array().cast("array<string>")), messages).alias("warnings"),
    )
