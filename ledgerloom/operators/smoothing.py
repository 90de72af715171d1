"""Recursive smoothing: seeded EMA, RSI and MACD.

A seeded recursion has no built-in. Bars are one row per (ticker, date), so a
ticker's group is bounded by the calendar (about 252 rows a year), and one grouped
Arrow pass per ticker runs every recursion with the shuffle the frames already use.
:func:`latest_smoothed_native` computes the newest values with SQL folds instead,
as an independent check.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerloom.fixed_values import MACD_FAST, MACD_SIGNAL, MACD_SLOW, RSI_PERIOD


def seeded(values: np.ndarray, window: int, alpha: float) -> np.ndarray:
    """y += alpha * (x - y), started by the mean of the first ``window`` present values on the last of them."""
    out = np.full(len(values), np.nan)
    present = np.flatnonzero(~np.isnan(values))
    if len(present) >= window:
        start = float(values[present[:window]].mean())
        later = values[present[window:]]
        out[present[window - 1:]] = list(accumulate(later, lambda y, x: y + alpha * (x - y), initial=start))
    return out


def ema_values(values: np.ndarray, span: int) -> np.ndarray:
    return seeded(values, span, 2.0 / (span + 1))


def rsi_values(close: np.ndarray, period: int) -> np.ndarray:
    change = np.diff(close, prepend=np.nan)
    gain = seeded(np.where(np.isnan(change), np.nan, np.maximum(change, 0.0)), period, 1.0 / period)
    loss = seeded(np.where(np.isnan(change), np.nan, np.maximum(-change, 0.0)), period, 1.0 / period)
    total = gain + loss
    with np.errstate(divide="ignore", invalid="ignore"):
        index = 100.0 - 100.0 / (1.0 + gain / loss)
    index = np.where(loss == 0, 100.0, index)
    index = np.where(total == 0, 50.0, index)
    return np.where(np.isnan(gain), np.nan, index)


def macd_values(close: np.ndarray, fast: int, slow: int, signal: int) -> tuple[np.ndarray, np.ndarray]:
    line = ema_values(close, fast) - ema_values(close, slow)
    return line, ema_values(line, signal)


def _per_ticker(bars: DataFrame, names: list[str], compute, price: str) -> DataFrame:
    """Run ``compute(close) -> arrays`` once per ticker and add its columns to the bars."""
    schema = T.StructType(bars.schema.fields + [T.StructField(n, T.DoubleType()) for n in names])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date", kind="stable")
        columns = compute(group[price].to_numpy(dtype=float))
        return group.assign(**dict(zip(names, columns, strict=True)))

    return bars.groupBy("ticker").applyInPandas(run, schema)


def with_smoothing(bars: DataFrame, window: int, alpha: float, price: str = "close", name: str = "smoothed") -> DataFrame:
    return _per_ticker(bars, [name], lambda x: [seeded(x, window, alpha)], price)


def with_ema(bars: DataFrame, spans: list[int], price: str = "close") -> DataFrame:
    """Columns ema_<span>, all in one pass."""
    return _per_ticker(bars, [f"ema_{s}" for s in spans], lambda x: [ema_values(x, s) for s in spans], price)


def with_rsi(bars: DataFrame, period: int = RSI_PERIOD, price: str = "close") -> DataFrame:
    return _per_ticker(bars, [f"rsi_{period}"], lambda x: [rsi_values(x, period)], price)


def with_macd(
    bars: DataFrame, fast: int = MACD_FAST, slow: int = MACD_SLOW, signal: int = MACD_SIGNAL, price: str = "close"
) -> DataFrame:
    def compute(x):
        line, smooth = macd_values(x, fast, slow, signal)
        return [line, smooth, line - smooth]

    return _per_ticker(bars, ["macd", "macd_signal", "macd_hist"], compute, price)


def with_rsi_and_macd(bars: DataFrame, price: str = "close") -> DataFrame:
    """RSI and MACD at their standard settings in one grouped pass."""

    def compute(x):
        line, smooth = macd_values(x, MACD_FAST, MACD_SLOW, MACD_SIGNAL)
        return [rsi_values(x, RSI_PERIOD), line, smooth, line - smooth]

    return _per_ticker(bars, [f"rsi_{RSI_PERIOD}", "macd", "macd_signal", "macd_hist"], compute, price)


# --- the same values by SQL folds, latest bar only --------------------------------


def _fold(values: Column, window: int, alpha: float) -> Column:
    """The last smoothed value of an array, NULL when it is shorter than the seed."""
    seed = F.aggregate(F.slice(values, 1, window), F.lit(0.0), lambda a, x: a + x) / window
    rest = F.slice(values, F.lit(window + 1), F.greatest(F.size(values) - window, F.lit(0)))
    return F.when(
        F.size(values) >= window, F.aggregate(rest, seed, lambda y, x: y + F.lit(alpha) * (x - y))
    )


def _macd_fold(prices: Column, fast: int, slow: int, signal: int) -> Column:
    """One pass over an array of prices: struct(n, fast, slow, line, line_sum, signal) after the last one."""

    def mean_of_first(n: int) -> Column:
        return F.aggregate(F.slice(prices, 1, n), F.lit(0.0), lambda a, x: a + x) / n

    def ema_step(n: Column, before: Column, x: Column, span: int) -> Column:
        step = before + F.lit(2.0 / (span + 1)) * (x - before)
        return F.when(n == span, mean_of_first(span)).when(n > span, step)

    null = F.lit(None).cast("double")
    start = F.struct(
        F.lit(0).alias("n"), null.alias("fast"), null.alias("slow"),
        null.alias("line"), F.lit(0.0).alias("line_sum"), null.alias("signal"),
    )

    def step(state: Column, x: Column) -> Column:
        n = state["n"] + 1
        quick, long = ema_step(n, state["fast"], x, fast), ema_step(n, state["slow"], x, slow)
        line = quick - long
        total = state["line_sum"] + F.coalesce(line, F.lit(0.0))
        first = slow + signal - 1
        smooth = F.when(n == first, total / signal).when(
            n > first, state["signal"] + F.lit(2.0 / (signal + 1)) * (line - state["signal"])
        )
        return F.struct(
            n.alias("n"), quick.alias("fast"), long.alias("slow"),
            line.alias("line"), total.alias("line_sum"), smooth.alias("signal"),
        )

    return F.aggregate(prices, start, step)


def latest_smoothed_native(bars: DataFrame, price: str = "close") -> DataFrame:
    """Latest RSI and MACD per ticker from ordered arrays and SQL folds."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("date", F.col(price).alias("p")))), lambda s: s["p"])
    arrays = bars.where(F.col(price).isNotNull()).groupBy("ticker").agg(ordered.alias("p"))
    count = F.greatest(F.size("p") - 1, F.lit(0))
    change = F.zip_with(F.slice("p", F.lit(2), count), F.slice("p", F.lit(1), count), lambda now, then: now - then)
    arrays = arrays.withColumn("d", change)
    folded = arrays.select(
        "ticker",
        _fold(F.transform("d", lambda x: F.greatest(x, F.lit(0.0))), RSI_PERIOD, 1.0 / RSI_PERIOD).alias("gain"),
        _fold(F.transform("d", lambda x: F.greatest(-x, F.lit(0.0))), RSI_PERIOD, 1.0 / RSI_PERIOD).alias("loss"),
        _macd_fold(F.col("p"), MACD_FAST, MACD_SLOW, MACD_SIGNAL).alias("m"),
    )
    rsi = (
        F.when(F.col("gain").isNull(), F.lit(None).cast("double"))
        .when((F.col("loss") == 0) & (F.col("gain") == 0), 50.0)
        .when(F.col("loss") == 0, 100.0)
        .otherwise(100.0 - 100.0 / (1.0 + F.try_divide("gain", "loss")))
    )
    return folded.select(
        "ticker",
        rsi.alias(f"rsi_{RSI_PERIOD}"),
        F.col("m.line").alias("macd"),
        F.col("m.signal").alias("macd_signal"),
        (F.col("m.line") - F.col("m.signal")).alias("macd_hist"),
    )
