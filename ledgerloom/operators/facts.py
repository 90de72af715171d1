"""Derived fact lines: where price, trend, momentum and sentiment stand, in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.fixed_values import NEWS_MAX_AGE_DAYS, RSI_LOOKBACK, TREND_LOOKBACK, UNAVAILABLE
from ledgerloom.functions.numbers import finite, pct_from
from ledgerloom.functions.texts import printf
from ledgerloom.operators.bars import latest_bars


def direction(now: Column, before: Column) -> Column:
    return F.when(now > before, "rising").when(now < before, "falling").when(now == before, "flat")


def gap_change(now: Column, then: Column) -> Column:
    """How the distance between two averages moved: crossed, widening, narrowing or unchanged."""
    return (
        F.when((now > 0) != (then > 0), "averages crossed")
        .when(F.abs(now) > F.abs(then), "gap widening")
        .when(F.abs(now) < F.abs(then), "gap narrowing")
        .when(now.isNotNull() & then.isNotNull(), "gap unchanged")
    )


def range_position(close: Column, low: Column, high: Column) -> Column:
    """Where the close sits in its 52-week range, in percent; NULL without a real range."""
    return F.when(high > low, (close - low) / (high - low) * 100.0)


def trend_readings(bars: DataFrame) -> DataFrame:
    """Latest values with the earlier ones they are compared to: 1, 5 and 10 bars back."""
    recent = latest_bars(bars, TREND_LOOKBACK + 1)

    def at(column: str, back: int = 0) -> Column:
        return F.max(F.when(F.col("back") == back, finite(column)))

    picked = recent.groupBy("ticker").agg(
        at("close").alias("close"),
        at("sma_50").alias("sma_50"),
        at("sma_200").alias("sma_200"),
        at("sma_50", TREND_LOOKBACK).alias("sma_50_then"),
        at("sma_200", TREND_LOOKBACK).alias("sma_200_then"),
        at("rsi_14").alias("rsi_now"),
        at("rsi_14", RSI_LOOKBACK).alias("rsi_then"),
        at("macd").alias("macd"),
        at("macd_signal").alias("macd_signal"),
        at("macd_hist").alias("hist_now"),
        at("macd_hist", 1).alias("hist_before"),
        at("bb_pct_b").alias("pct_b"),
        at("hv_30").alias("hv_30"),
    )
    gap_now, gap_then = pct_from("sma_50", "sma_200"), pct_from("sma_50_then", "sma_200_then")
    return (
        picked.withColumn("gap_now", gap_now)
        .withColumn("gap_then", gap_then)
        .withColumn("gap_change", gap_change(F.col("gap_now"), F.col("gap_then")))
        .withColumn("rsi_direction", direction(F.col("rsi_now"), F.col("rsi_then")))
        .withColumn("hist_direction", direction(F.col("hist_now"), F.col("hist_before")))
    )


def _or_unavailable(label: str, text: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), F.coalesce(text, F.lit(UNAVAILABLE)))


def _fmt(spec: str, *values: Column) -> Column:
    """format_string that is NULL as soon as one value is."""
    present = F.lit(True)
    for v in values:
        present = present & v.isNotNull()
    return F.when(present, printf(spec, *values))


def _versus(label: str, value: str, reference: str) -> Column:
    text = _fmt(" (%.2f): %+.1f%%", F.col(reference), pct_from(value, reference))
    return F.concat(F.lit(label), F.coalesce(text, F.lit(f": {UNAVAILABLE}")))


def technical_facts(bars: DataFrame, summary: DataFrame) -> DataFrame:
    """(ticker, facts): ten lines per ticker, each a raw value with its computed relation."""
    c = F.col
    df = trend_readings(bars).join(
        summary.select("ticker", "currency", "low_52w", "high_52w", "ytd_return_pct"), "ticker"
    )
    currency = F.when(c("currency").isNotNull(), F.concat(F.lit(" "), c("currency"))).otherwise(F.lit(""))
    gap_now = printf("%+.1f%% now", c("gap_now"))
    trend = F.when(
        c("gap_now").isNotNull(),
        F.coalesce(
            F.concat(gap_now, _fmt(f", %+.1f%% {TREND_LOOKBACK} trading days ago (%s)", c("gap_then"), c("gap_change"))),
            F.concat(gap_now, F.lit(f"; the value {TREND_LOOKBACK} trading days ago is {UNAVAILABLE}")),
        ),
    )
    rsi_now = printf("%.1f now", c("rsi_now"))
    rsi = F.when(
        c("rsi_now").isNotNull(),
        F.coalesce(
            F.concat(
                rsi_now,
                _fmt(
                    f", %.1f {RSI_LOOKBACK} trading days ago (%s); overbought above 70, oversold below 30",
                    c("rsi_then"), c("rsi_direction"),
                ),
            ),
            F.concat(rsi_now, F.lit(f"; the value {RSI_LOOKBACK} trading days ago is {UNAVAILABLE}")),
        ),
    )
    side = (
        F.when(c("macd") > c("macd_signal"), "above").when(c("macd") < c("macd_signal"), "below").otherwise("level with")
    )
    macd = F.concat(
        _fmt("%.2f, signal line %.2f (MACD %s the signal line)", c("macd"), c("macd_signal"), side),
        F.coalesce(
            _fmt("; histogram %.2f now, %.2f the day before (%s)", c("hist_now"), c("hist_before"), c("hist_direction")),
            F.lit(""),
        ),
    )
    bands = _fmt("%.2f (0 is the lower band, 1 the upper band; outside 0 to 1 is outside the bands)", c("pct_b"))
    position = _fmt(
        "low %.2f, high %.2f; close at %.0f%% of the range",
        c("low_52w"), c("high_52w"), range_position(c("close"), c("low_52w"), c("high_52w")),
    )
    facts = F.array(
        _or_unavailable("Close", F.concat(_fmt("%.2f", c("close")), currency)),
        _versus("Close vs 50-day SMA", "close", "sma_50"),
        _versus("Close vs 200-day SMA", "close", "sma_200"),
        _or_unavailable("50-day SMA vs 200-day SMA", trend),
        _or_unavailable("RSI-14", rsi),
        _or_unavailable("MACD", macd),
        _or_unavailable("Bollinger %B", bands),
        _or_unavailable("52-week range", position),
        _or_unavailable("30-day annualised volatility", _fmt("%.1f%%", c("hv_30") * 100.0)),
        _or_unavailable("Year-to-date return", _fmt("%+.1f%%", c("ytd_return_pct"))),
    )
    return df.select("ticker", facts.alias("facts"))


def sentiment_fact(score: Column, label: Column, scored: Column, counts: Column) -> Column:
    text = printf(
        "Sentiment score: %+.2f (%s) on a scale from -1 to +1, "
        f"from %d headlines of the last {NEWS_MAX_AGE_DAYS} days (%d positive, %d negative, %d neutral)",
        score, label, scored,
        F.coalesce(counts["positive"], F.lit(0)),
        F.coalesce(counts["negative"], F.lit(0)),
        F.coalesce(counts["neutral"], F.lit(0)),
    )
    return F.when(score.isNotNull(), text).otherwise(
        F.lit(f"Sentiment score: {UNAVAILABLE} (no headline could be scored)")
    )


def sentiment_facts(summary: DataFrame) -> DataFrame:
    """(ticker, fact) from a sentiment summary table."""
    fact = sentiment_fact(F.col("score"), F.col("label"), F.col("scored"), F.col("counts"))
    return summary.select("ticker", fact.alias("fact"))


