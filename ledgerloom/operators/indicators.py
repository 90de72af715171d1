"""Window indicators over daily bars, and the volatility rank."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ledgerloom.fixed_values import (
    BAND_STDS,
    BAND_WINDOW,
    INDICATORS,
    SMA_LONG,
    SMA_SHORT,
    TOO_FEW_PRICES,
    TRADING_DAYS,
    VOLATILITY_WINDOW,
    ZERO_WIDTH,
)
from ledgerloom.functions.numbers import finite
from ledgerloom.operators.bars import latest_bars
from ledgerloom.operators.smoothing import latest_smoothed_native, with_rsi_and_macd


def _by_date() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def _frame(n: int) -> WindowSpec:
    return _by_date().rowsBetween(-(n - 1), 0)


def _full(value: Column, source: Column, n: int) -> Column:
    """``value`` only where the frame holds ``n`` present inputs: warm-up rows stay NULL."""
    return F.when(F.count(source).over(_frame(n)) == n, value)


def sma(price: Column, n: int) -> Column:
    return _full(F.avg(price).over(_frame(n)), price, n)


def band_columns(price: Column, n: int = BAND_WINDOW, stds: float = BAND_STDS) -> dict[str, Column]:
    """Bollinger Bands with the population deviation; %b is 0.5 in a band of zero width."""
    middle = sma(price, n)
    spread = stds * _full(F.stddev_pop(price).over(_frame(n)), price, n)
    upper, lower = middle + spread, middle - spread
    width = upper - lower
    pct_b = F.when(F.abs(width) < ZERO_WIDTH, F.lit(0.5)).otherwise(F.try_divide(price - lower, width))
    return {"bb_middle": middle, "bb_upper": upper, "bb_lower": lower, "bb_pct_b": F.when(width.isNotNull(), pct_b)}


def with_log_return(bars: DataFrame, price: str = "close") -> DataFrame:
    before = F.lag(price).over(_by_date())
    ratio = F.try_divide(F.col(price), before)
    return bars.withColumn("log_return", finite(F.when(ratio > 0, F.log(ratio))))


def annualised_volatility(n: int, log_return: Column | None = None) -> Column:
    """Sample deviation of the last ``n`` log returns, times sqrt(252), as a fraction."""
    r = F.col("log_return") if log_return is None else log_return
    return _full(F.stddev_samp(r).over(_frame(n)), r, n) * math.sqrt(TRADING_DAYS)


def with_window_indicators(bars: DataFrame, price: str = "close") -> DataFrame:
    """The moving averages, bands and 30-day volatility: native frames over one shuffle by ticker."""
    p = F.col(price)
    return (
        with_log_return(bars, price)
        .withColumns(
            {
                "sma_50": sma(p, SMA_SHORT),
                "sma_200": sma(p, SMA_LONG),
                **band_columns(p),
                "hv_30": annualised_volatility(VOLATILITY_WINDOW),
            }
        )
        .drop("log_return")
    )


def add_indicators(bars: DataFrame, price: str = "close") -> DataFrame:
    """Bars with all eleven indicator columns. A missing price column is a caller error."""
    if price not in bars.columns:
        raise ValueError(f"column {price!r} not found; columns are {bars.columns}")
    base = bars.columns
    return with_rsi_and_macd(with_window_indicators(bars, price), price).select(*base, *INDICATORS)


def volatility_series(bars: DataFrame, window: int = VOLATILITY_WINDOW) -> DataFrame:
    """(ticker, date, volatility) for every bar that has one."""
    return (
        with_log_return(bars)
        .withColumn("volatility", annualised_volatility(window))
        .where(F.col("volatility").isNotNull())
        .select("ticker", "date", "volatility")
    )


def volatility_rank(bars: DataFrame, window: int = VOLATILITY_WINDOW, days: int = TRADING_DAYS) -> DataFrame:
    """Where the newest volatility sits among the last ``days`` values, in percent.

    At most ``days`` rows per ticker reach the exact median.
    """
    newest = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    recent = (
        volatility_series(bars, window)
        .withColumn("back", F.row_number().over(newest))
        .where(F.col("back") <= days)
    )
    current = F.max(F.when(F.col("back") == 1, F.col("volatility"))).over(Window.partitionBy("ticker"))
    return (
        recent.withColumn("current", current)
        .groupBy("ticker")
        .agg(
            F.lit(window).alias("window"),
            F.max("date").alias("as_of"),
            (F.max("current") * 100.0).alias("current_pct"),
            (F.min("volatility") * 100.0).alias("min_1y_pct"),
            (F.median("volatility") * 100.0).alias("median_1y_pct"),
            (F.max("volatility") * 100.0).alias("max_1y_pct"),
            (F.avg((F.col("volatility") <= F.col("current")).cast("int")) * 100.0).alias("percentile_1y"),
            F.count(F.lit(1)).alias("observations"),
        )
    )


def volatility_report(bars: DataFrame, window: int = VOLATILITY_WINDOW, days: int = TRADING_DAYS) -> DataFrame:
    """The volatility rank of every ticker with bars: status ok, or empty with a warning where there are too few prices."""
    tickers = bars.select("ticker").distinct()
    ranked = tickers.join(volatility_rank(bars, window, days), "ticker", "left")
    found = F.col("observations").isNotNull()
    text = F.concat("ticker", F.lit(TOO_FEW_PRICES.format(least=window + 1, window=window)))
    return ranked.withColumns({"status": F.when(found, "ok").otherwise("empty"), "warning": F.when(~found, text)})


def value_back(column: str, k: int) -> Column:
    """The column's value ``k`` bars earlier; NULL if missing or not finite."""
    return finite(F.lag(column, k).over(_by_date())) if k else finite(column)


def recompute_audit(bars: DataFrame) -> DataFrame:
    """The nine latest summary indicators by a second route, and the largest difference per ticker.

    Frames are recomputed from the last 200 closes as arrays, recursions by SQL folds.
    """
    engine = latest_bars(add_indicators(bars))
    closes = F.transform(F.array_sort(F.collect_list(F.struct("date", "close"))), lambda s: s["close"])
    tail = latest_bars(bars, SMA_LONG).groupBy("ticker").agg(closes.alias("c"))

    def mean(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)

    def last(n: int) -> Column:
        return F.when(F.size("c") >= n, F.slice("c", -n, n))

    middle = mean(last(BAND_WINDOW))
    spread = F.sqrt(mean(F.transform(last(BAND_WINDOW), lambda x: (x - F.col("m")) * (x - F.col("m")))))
    frames = (
        tail.withColumn("m", middle)
        .withColumn("s", spread)
        .select(
            "ticker",
            mean(last(SMA_SHORT)).alias("n_sma_50"),
            mean(last(SMA_LONG)).alias("n_sma_200"),
            (F.col("m") + BAND_STDS * F.col("s")).alias("n_bb_upper"),
            (F.col("m") - BAND_STDS * F.col("s")).alias("n_bb_lower"),
            F.try_divide(F.element_at("c", -1) - (F.col("m") - BAND_STDS * F.col("s")), 2 * BAND_STDS * F.col("s")).alias("n_bb_pct_b"),
        )
    )
    folds = latest_smoothed_native(bars)
    folds = folds.select("ticker", *[F.col(c).alias(f"n_{c}") for c in folds.columns if c != "ticker"])
    names = ["sma_50", "sma_200", "rsi_14", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_lower", "bb_pct_b"]
    joined = engine.join(frames, "ticker").join(folds, "ticker")
    gaps = [F.abs(F.col(n) - F.col(f"n_{n}")) for n in names]
    return joined.select(
        "ticker",
        F.greatest(*gaps).alias("largest_gap"),
        (F.coalesce(F.greatest(*gaps), F.lit(0.0)) < 1e-8).alias("agrees"),
        *names,
    )
