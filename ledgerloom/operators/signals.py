"""Momentum votes, score, label and stretch flags on the latest bar of every ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.fixed_values import (
    DIRECTIONAL_SCORE,
    RSI_MIDLINE,
    RSI_OVERBOUGHT,
    RSI_OVERSOLD,
    STRONG_SCORE,
)
from ledgerloom.functions.numbers import finite, sign
from ledgerloom.functions.texts import significant4
from ledgerloom.operators.bars import latest_bars

# (vote, left name, left column, right name, right column); a number is a constant.
RULES = [
    ("short_term_trend", "close", "close", "sma_50", "sma_50"),
    ("long_term_regime", "sma_50", "sma_50", "sma_200", "sma_200"),
    ("macd_crossover", "macd", "macd", "macd_signal", "macd_signal"),
    ("macd_acceleration", "hist_today", "macd_hist", "hist_yesterday", "hist_yesterday"),
    ("rsi_momentum", "rsi_14", "rsi_14", "midline", RSI_MIDLINE),
]


def _side(source) -> Column:
    return F.lit(float(source)) if isinstance(source, (int, float)) else finite(source)


def _vote(name: str, left_name: str, left, right_name: str, right) -> Column:
    a, b = _side(left), _side(right)
    vote = F.coalesce(sign(a - b), F.lit(0))
    ta, tb = significant4(a), significant4(b)
    reason = (
        F.when(a.isNull() | b.isNull(), F.lit(f"unavailable: {left_name} or {right_name} has no value yet"))
        .when(a > b, F.concat(F.lit(f"{left_name} "), ta, F.lit(f" is above {right_name} "), tb))
        .when(a < b, F.concat(F.lit(f"{left_name} "), ta, F.lit(f" is below {right_name} "), tb))
        .otherwise(F.concat(F.lit(f"{left_name} equals {right_name} ("), ta, F.lit(")")))
    )
    return F.struct(
        F.lit(name).alias("name"),
        F.create_map(F.lit(left_name), a, F.lit(right_name), b).alias("inputs"),
        vote.alias("vote"),
        reason.alias("reason"),
    )


def score_label(score: Column) -> Column:
    """Five labels; +4 and -4 count as plain Bullish and Bearish."""
    return (
        F.when(score >= STRONG_SCORE, "Strong Bullish")
        .when(score >= DIRECTIONAL_SCORE, "Bullish")
        .when(score <= -STRONG_SCORE, "Strong Bearish")
        .when(score <= -DIRECTIONAL_SCORE, "Bearish")
        .otherwise("Neutral")
    )


def stretch_flags() -> Column:
    rsi, pct_b = finite("rsi_14"), finite("bb_pct_b")
    return F.array_compact(
        F.array(
            F.when(rsi > RSI_OVERBOUGHT, "overbought"),
            F.when(rsi < RSI_OVERSOLD, "oversold"),
            F.when(pct_b > 1.0, "above_upper_band"),
            F.when(pct_b < 0.0, "below_lower_band"),
        )
    )


SIGNAL_COLUMNS = ["close", "sma_50", "sma_200", "macd", "macd_signal", "macd_hist", "rsi_14", "bb_pct_b"]


def with_signal(latest: DataFrame) -> DataFrame:
    """Add label, score, votes, flags and unavailable to one-row-per-ticker latest values.

    ``latest`` holds :data:`SIGNAL_COLUMNS` and ``hist_yesterday``.
    """
    score = F.aggregate("votes", F.lit(0), lambda total, v: total + v["vote"])
    gone = F.filter("votes", lambda v: F.exists(F.map_values(v["inputs"]), lambda x: x.isNull()))
    voted = latest.withColumn("votes", F.array(*[_vote(*rule) for rule in RULES])).withColumn("score", score)
    return voted.withColumns(
        {
            "label": score_label(F.col("score")),
            "flags": stretch_flags(),
            "unavailable": F.transform(gone, lambda v: v["name"]),
        }
    )


def momentum_signal(bars: DataFrame) -> DataFrame:
    """One row per ticker from bars with indicators: as_of, label, score, votes, flags, unavailable."""
    last = F.col("back") == 0
    latest = latest_bars(bars, 2).groupBy("ticker").agg(
        F.max(F.when(last, F.col("date"))).alias("as_of"),
        *[F.max(F.when(last, F.col(c))).alias(c) for c in SIGNAL_COLUMNS],
        F.max(F.when(~last, F.col("macd_hist"))).alias("hist_yesterday"),
    )
    return with_signal(latest).select("ticker", "as_of", "label", "score", "votes", "flags", "unavailable")
