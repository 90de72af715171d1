"""Daily price bars: building, cleaning, trimming, and per-period figures.

A bar table has columns ticker, date, seq, open, high, low, close, volume. After
:func:`clean_bars` there is one row per (ticker, date), so a ticker holds at most
one row per calendar day. Windows partitioned by ticker are bounded by that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.fixed_values import (
    DEFAULT_PERIOD,
    FIFTY_TWO_WEEK_DAYS,
    HISTORY_TOLERANCE_DAYS,
    HISTORY_YEARS,
    INDICATORS,
    LAST_BARS,
    PERIOD_MONTHS,
    TRAILING_YEAR_DAYS,
)
from ledgerloom.functions.numbers import finite, pct_from, rounded

PRICES = ["open", "high", "low", "close"]
BAR_COLUMNS = [*PRICES, "volume"]


def bars_from_ticks(ticks: DataFrame, price: str = "price", size: str = "size") -> DataFrame:
    """Bars from (ticker, date, seq, price, size) rows; ``seq`` orders the ticks of a day.

    Every aggregate buffer is a primitive, so this is a hash aggregation with a
    map-side partial step: a day or ticker holding a third of all ticks reaches the
    shuffle as one row per input task.
    """
    return ticks.groupBy("ticker", "date").agg(
        F.min_by(price, "seq").alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, "seq").alias("close"),
        F.sum(size).alias("volume"),
    )


def normalised_ticker(df: DataFrame, column: str = "ticker") -> DataFrame:
    """Trimmed, upper-cased ticker plus ``ticker_ok``: an empty one is an error row to set aside."""
    cleaned = F.upper(F.trim(F.col(column)))
    return df.withColumn(column, cleaned).withColumn("ticker_ok", F.coalesce(cleaned != "", F.lit(False)))


def exchange_date(ts_utc: Column, zone: str | Column) -> Column:
    """The calendar date on the exchange's clock of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(ts_utc, zone))


def _last_of_each_day(raw: DataFrame) -> DataFrame:
    picks = [F.max_by(finite(c), "seq").alias(c) for c in BAR_COLUMNS]
    return raw.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("copies"), *picks)


def clean_bars(raw: DataFrame) -> DataFrame:
    """One bar per (ticker, date): the copy with the highest ``seq``, kept only if its prices are complete.

    The last copy is chosen first, so a day whose last copy lacks a price is dropped
    even when an earlier copy was whole. Zero volume is kept. A table without one of
    the five columns is treated as empty.
    """
    missing = [c for c in BAR_COLUMNS if c not in raw.columns]
    if missing:
        typed = [F.lit(None).cast("double").alias(c) for c in BAR_COLUMNS]
        return raw.select("ticker", "date", *typed).where(F.lit(False))
    return _last_of_each_day(raw).drop("copies").dropna(subset=PRICES)


def cleaning_report(raw: DataFrame) -> DataFrame:
    """Per ticker: rows read, duplicates dropped, incomplete days dropped, bars kept."""
    whole = F.lit(True)
    for c in PRICES:
        whole = whole & F.col(c).isNotNull()
    return (
        _last_of_each_day(raw)
        .groupBy("ticker")
        .agg(
            F.sum("copies").alias("rows_read"),
            F.sum(F.col("copies") - 1).alias("duplicates"),
            F.count_if(~whole).alias("incomplete"),
            F.count_if(whole).alias("kept"),
        )
    )


def history_window(bars: DataFrame, today: Column, years: int = HISTORY_YEARS) -> DataFrame:
    """Bars of the ``years`` up to and including ``today``; the start is counted back from tomorrow."""
    end = F.date_add(today, 1)
    return bars.where((F.col("date") >= F.add_months(end, -12 * years)) & (F.col("date") < end))


def short_history(bars: DataFrame, today: Column, years: int = HISTORY_YEARS) -> DataFrame:
    """Per ticker: first bar, and a warning when it is over a week later than asked for."""
    start = F.add_months(F.date_add(today, 1), -12 * years)
    first = bars.groupBy("ticker").agg(F.min("date").alias("first_date"), F.count(F.lit(1)).alias("bars"))
    late = F.date_diff("first_date", start) > HISTORY_TOLERANCE_DAYS
    text = F.concat(
        F.col("ticker"), F.lit(" history starts "), F.col("first_date").cast("string"),
        F.lit(", later than the requested "), start.cast("string"),
        F.lit(f": less than {years} years of data"),
    )
    return first.withColumn("warning", F.when(late, text))


def with_period_start(requests: DataFrame, today: Column) -> DataFrame:
    """Add the used period, its start date and a warning when an unknown period was replaced."""
    known = F.col("period").isin(list(PERIOD_MONTHS))
    used = F.when(known, F.col("period")).otherwise(F.lit(DEFAULT_PERIOD))
    months = F.lit(None).cast("int")
    for name, count in PERIOD_MONTHS.items():
        months = F.when(used == name, F.lit(count)).otherwise(months)
    listed = "[" + ", ".join(f"'{p}'" for p in PERIOD_MONTHS) + "]"
    warning = F.format_string(
        f"period '%s' is not one of {listed}, so {DEFAULT_PERIOD} was used", F.coalesce("period", F.lit("None"))
    )
    return (
        requests.withColumn("period_warning", F.when(~F.coalesce(known, F.lit(False)), warning))
        .withColumn("period", F.coalesce(used, F.lit(DEFAULT_PERIOD)))
        .withColumn("period_start", F.add_months(today, -F.coalesce(months, F.lit(PERIOD_MONTHS[DEFAULT_PERIOD]))))
    )


def trim_to_period(bars: DataFrame, today: Column, period: str = DEFAULT_PERIOD) -> DataFrame:
    """Bars of the period, cut after indicators were computed so that long averages stay warm."""
    months = PERIOD_MONTHS.get(period, PERIOD_MONTHS[DEFAULT_PERIOD])
    return bars.where(F.col("date") >= F.add_months(today, -months))


def period_stats(bars: DataFrame, today: Column, period: str = DEFAULT_PERIOD) -> DataFrame:
    """Per ticker: return, high and low of the period, 52-week range, distance to the two averages.

    ``bars`` carries indicator columns. One conditional aggregation, no window.
    """
    months = PERIOD_MONTHS.get(period, PERIOD_MONTHS[DEFAULT_PERIOD])
    inside = F.col("date") >= F.add_months(today, -months)
    year = F.col("date") >= F.date_sub(today, FIFTY_TWO_WEEK_DAYS)
    in_date = F.when(inside, F.col("date"))
    stats = bars.groupBy("ticker").agg(
        F.max(in_date).alias("as_of"),
        F.count_if(inside).alias("bars"),
        F.min_by("close", in_date).alias("first_close"),
        F.max_by("close", in_date).alias("close"),
        F.max(F.when(inside, F.col("high"))).alias("period_high"),
        F.min(F.when(inside, F.col("low"))).alias("period_low"),
        F.max(F.when(year, F.col("high"))).alias("high_52w"),
        F.min(F.when(year, F.col("low"))).alias("low_52w"),
        F.max_by("sma_50", in_date).alias("sma_50"),
        F.max_by("sma_200", in_date).alias("sma_200"),
    )
    return stats.where("bars > 0").select(
        "ticker",
        F.lit(period if period in PERIOD_MONTHS else DEFAULT_PERIOD).alias("period"),
        "as_of",
        "bars",
        "close",
        F.when(F.col("bars") > 1, pct_from("close", "first_close")).alias("period_return_pct"),
        "period_high",
        "period_low",
        "high_52w",
        "low_52w",
        pct_from("close", "sma_50").alias("close_vs_sma_50_pct"),
        pct_from("close", "sma_200").alias("close_vs_sma_200_pct"),
    )


def latest_bars(bars: DataFrame, n: int = 1) -> DataFrame:
    """The last ``n`` bars per ticker with ``back`` = 0 for the newest.

    Catalyst turns the rank filter into a group limit before the shuffle.
    """
    newest = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    ranked = bars.withColumn("back", F.row_number().over(newest) - 1)
    return ranked.where(F.col("back") <= n - 1)


def last_bars_list(bars: DataFrame, n: int = LAST_BARS) -> DataFrame:
    """Per ticker: its last ``n`` bars as an array, oldest first, rounded to two decimals."""
    bar = F.struct("date", *[rounded(c).alias(c) for c in PRICES], F.col("volume").cast("bigint").alias("volume"))
    return latest_bars(bars, n).groupBy("ticker").agg(F.array_sort(F.collect_list(bar)).alias("last_bars"))


def trailing_year(bars: DataFrame, days: int = TRAILING_YEAR_DAYS) -> DataFrame:
    """Bars of the year before each ticker's own last bar."""
    newest = Window.partitionBy("ticker")
    return (
        bars.withColumn("newest", F.max("date").over(newest))
        .where(F.col("date") >= F.date_sub("newest", days))
        .drop("newest")
    )


def bars_with_indicator_map(bars: DataFrame) -> DataFrame:
    """Bars with their indicators as one map column, missing values as NULL entries."""
    entries = []
    for name in INDICATORS:
        entries += [F.lit(name), finite(name)]
    return bars.select("ticker", "date", *BAR_COLUMNS, F.create_map(*entries).alias("indicators"))


def price_snapshot(bars: DataFrame, stats: DataFrame) -> DataFrame:
    """The latest price figures per ticker, rounded: period stats joined to the latest indicator row."""
    names = ["sma_200", "rsi_14", "macd", "macd_signal", "macd_hist", "bb_lower", "bb_pct_b"]
    latest = latest_bars(bars).select("ticker", *names, "hv_30")
    stat_names = ["close", "period_return_pct", "close_vs_sma_50_pct", "close_vs_sma_200_pct", "high_52w", "low_52w"]
    return stats.join(latest, "ticker").select(
        "ticker",
        "period",
        "as_of",
        *[rounded(c).alias(c) for c in stat_names + names],
        rounded(F.col("hv_30") * 100.0).alias("hv_30_pct"),
    )


def price_digest(bars: DataFrame, stats: DataFrame) -> DataFrame:
    """What a reader of the price result sees: rounded stats, the latest indicators, the last five bars."""
    latest = latest_bars(bars).select("ticker", *INDICATORS)
    entries = []
    for name in INDICATORS:
        entries += [F.lit(name), rounded(name)]
    kept = [
        "close", "period_return_pct", "period_high", "period_low", "high_52w", "low_52w",
        "close_vs_sma_50_pct", "close_vs_sma_200_pct",
    ]
    return (
        stats.join(latest, "ticker")
        .join(last_bars_list(bars), "ticker")
        .select(
            "ticker", "period", "as_of",
            *[rounded(c).alias(c) for c in kept],
            F.create_map(*entries).alias("indicators"),
            "last_bars",
        )
    )
