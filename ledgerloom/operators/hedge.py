"""Expected move and candidate hedge levels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.fixed_values import HORIZON_DAYS, LEVEL_MEANINGS, TRADING_DAYS
from ledgerloom.functions.numbers import rounded


def expected_move(price: Column, volatility_pct: Column, days: int = HORIZON_DAYS) -> Column:
    """One standard deviation of price change over ``days`` trading days."""
    return price * volatility_pct / 100.0 * math.sqrt(days / TRADING_DAYS)


def horizon_volatility(estimates: DataFrame, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Per ticker, of several volatility results (ticker, call_no, window, current_pct, ...), the one whose
    window is nearest the horizon; on a tie the later call."""
    rank = F.struct(F.abs(F.col("window") - horizon), -F.col("call_no"))
    rest = [c for c in estimates.columns if c != "ticker"]
    best = estimates.groupBy("ticker").agg(F.min_by(F.struct(*rest), rank).alias("best"))
    return best.select("ticker", "best.*")


def hedge_levels(snapshot: DataFrame, volatility: DataFrame) -> DataFrame:
    """Levels per ticker from price snapshots and (ticker, window, current_pct) volatility results.

    The volatility result wins over the snapshot's 30-day figure; a ticker with
    neither has no row. Levels without a value are left out of ``candidates``.
    """
    vol = volatility.select("ticker", F.col("window").alias("v_window"), F.col("current_pct").alias("v_pct"))
    joined = snapshot.join(vol, "ticker", "left")
    used = F.coalesce("v_pct", "hv_30_pct")
    source = F.when(
        F.col("v_pct").isNotNull(), F.format_string("calculate_volatility, %d-day", F.col("v_window"))
    ).otherwise(F.lit("get_price_data hv_30"))
    df = (
        joined.withColumn("used", used)
        .where(F.col("used").isNotNull() & F.col("close").isNotNull())
        .withColumn("move", expected_move(F.col("close"), F.col("used")))
    )
    values = {
        "one_sd_low": F.col("close") - F.col("move"),
        "one_sd_high": F.col("close") + F.col("move"),
        "sma_200": F.col("sma_200"),
        "bb_lower": F.col("bb_lower"),
        "low_52w": F.col("low_52w"),
    }
    candidates = [
        F.when(
            value.isNotNull(),
            F.struct(
                F.lit(name).alias("name"),
                rounded(value).alias("level"),
                rounded((value / F.col("close") - 1) * 100.0).alias("pct_from_price"),
                F.lit(LEVEL_MEANINGS[name]).alias("meaning"),
            ),
        )
        for name, value in values.items()
    ]
    return df.select(
        "ticker",
        rounded("close").alias("price"),
        rounded("used").alias("volatility_pct"),
        source.alias("volatility_source"),
        F.lit(HORIZON_DAYS).alias("horizon_trading_days"),
        rounded("move").alias("expected_move"),
        rounded(F.col("move") / F.col("close") * 100.0).alias("expected_move_pct"),
        F.array_compact(F.array(*candidates)).alias("candidates"),
    )


def priced_legs(legs: DataFrame, levels: DataFrame) -> DataFrame:
    """Hedge legs (ticker, leg_no, action, instrument, level_name) with the level they name.

    A name that matches no level gets a warning and no price. The level side holds
    at most five rows per ticker.
    """
    named = levels.select("ticker", F.explode("candidates").alias("c")).select(
        "ticker", F.col("c.name").alias("level_name"), F.col("c.level").alias("level")
    )
    unknown = F.col("level_name").isNotNull() & F.col("level").isNull()
    text = F.format_string(
        "hedge leg '%s %s' names an unknown level '%s', so it has no price",
        F.col("action"), F.col("instrument"), F.col("level_name"),
    )
    return legs.join(named, ["ticker", "level_name"], "left").select(
        "ticker", "leg_no", "action", "instrument", "level_name", "level", F.when(unknown, text).alias("warning")
    )
