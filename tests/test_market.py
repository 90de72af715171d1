"""Bars, indicators, signals, summaries and hedge levels on hand-checked series."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import bars as B
from ledgerloom.operators import facts, hedge, indicators as I, signals, smoothing as S, summary

START = date(2024, 1, 1)


def series(spark, closes, ticker="T", start=START):
    data = [(ticker, start + timedelta(days=i), float(c), float(c), float(c), float(c), 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(data, "ticker string, date date, open double, high double, low double, close double, volume double")


def column(df, name):
    return [r[0] for r in df.orderBy("date").select(name).collect()]


def close_to(got, want, tolerance=1e-9):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None), (got, want)
        if w is not None:
            assert g == pytest.approx(w, abs=tolerance)


def test_ema_is_seeded_with_the_mean(spark):
    df = S.with_ema(series(spark, [10, 12, 11, 13, 15, 14, 20]), [3])
    close_to(column(df, "ema_3"), [None, None, 11, 12, 13.5, 13.75, 16.875])


def test_smoothing_skips_leading_gaps():
    x = np.array([np.nan, np.nan, 10, 12, 11, 13.0])
    got = S.seeded(x, 3, 0.5)
    assert np.isnan(got[:4]).all() and got[4:].tolist() == [11.0, 12.0]
    assert np.isnan(S.seeded(np.array([1.0, 2.0]), 3, 0.5)).all()


def test_rsi_by_hand(spark):
    df = S.with_rsi(series(spark, [10, 11, 10.5, 11.5, 12, 11]), 3)
    close_to(column(df, "rsi_3"), [None, None, None, 80, 100 - 100 / 6.5, 50])


def test_rsi_of_rising_and_flat_prices(spark):
    assert set(column(S.with_rsi(series(spark, range(1, 31))), "rsi_14")[14:]) == {100.0}
    assert set(column(S.with_rsi(series(spark, [50] * 60)), "rsi_14")[14:]) == {50.0}


def test_macd_warm_up_and_signal_seed(spark):
    wave = [100 + 5 * math.sin(i / 5) for i in range(80)]
    df = S.with_macd(series(spark, wave))
    line, signal = column(df, "macd"), column(df, "macd_signal")
    assert line.index(next(x for x in line if x is not None)) == 25
    assert signal[32] is None and signal[33] == pytest.approx(sum(line[25:34]) / 9)


def test_bands_use_the_population_deviation(spark):
    df = series(spark, [20, 22, 21, 23, 24])
    out = df.withColumns(I.band_columns(F.col("close"), 5, 2.0))
    last = out.orderBy(F.desc("date")).first()
    assert last.bb_middle == 22 and last.bb_upper == pytest.approx(22 + 2 * math.sqrt(2))
    assert out.where("bb_middle is not null").count() == 1


def test_volatility_uses_the_sample_deviation(spark):
    df = I.with_log_return(series(spark, [100, 102, 99, 101])).withColumn("v", I.annualised_volatility(3))
    r = [math.log(b / a) for a, b in ((100, 102), (102, 99), (99, 101))]
    m = sum(r) / 3
    close_to(column(df, "v"), [None, None, None, math.sqrt(sum((x - m) ** 2 for x in r) / 2 * 252)])


def test_flat_prices(spark):
    last = I.add_indicators(series(spark, [50.0] * 60)).orderBy(F.desc("date")).first()
    assert (last.rsi_14, last.bb_pct_b, last.hv_30) == (50, 0.5, 0)
    assert last.bb_upper == last.bb_lower == 50 and last.sma_200 is None


def test_missing_price_column_is_an_error(spark):
    with pytest.raises(ValueError, match="not found"):
        I.add_indicators(series(spark, [1.0]).drop("close"))


def test_rsi_stays_in_range_and_both_routes_agree(spark):
    walk = 100 * np.exp(np.cumsum(np.random.default_rng(7).normal(0, 0.02, 500)))
    bars = series(spark, walk).unionByName(series(spark, walk[::-1], "U"))
    rsi = [x for x in column(S.with_rsi(bars), "rsi_14") if x is not None]
    assert all(0 <= x <= 100 for x in rsi)
    assert {r.agrees for r in I.recompute_audit(bars).collect()} == {True}


def test_cleaning_keeps_the_last_copy_then_drops_incomplete_days(spark, rows):
    raw = [
        ("T", date(2026, 10, 5), 1, 1.0, 1.0, 1.0, 105.0, 0.0),
        ("T", date(2026, 10, 1), 2, 1.0, 1.0, 1.0, 101.0, 5.0),
        ("T", date(2026, 10, 2), 3, 1.0, 1.0, 1.0, 102.0, 5.0),
        ("T", date(2026, 10, 2), 4, 1.0, 1.0, 1.0, 102.5, 5.0),
        ("T", date(2026, 10, 3), 5, 1.0, None, 1.0, 103.0, 5.0),
        ("T", date(2026, 10, 4), 6, 1.0, 1.0, 1.0, 104.0, 5.0),
        ("T", date(2026, 10, 4), 7, 1.0, 1.0, float("nan"), 104.5, 5.0),
    ]
    df = spark.createDataFrame(raw, "ticker string, date date, seq long, open double, high double, low double, close double, volume double")
    assert rows(B.clean_bars(df), "date", "close") == [
        (date(2026, 10, 1), 101.0), (date(2026, 10, 2), 102.5), (date(2026, 10, 5), 105.0)
    ]
    assert rows(B.cleaning_report(df)) == [("T", 7, 2, 2, 3)]
    assert B.clean_bars(df.drop("volume")).count() == 0


def test_exchange_date_is_the_local_calendar_date(spark):
    df = spark.sql("select timestamp'2026-01-02 03:00:00' as ts")
    assert df.select(B.exchange_date(F.col("ts"), "America/New_York")).first()[0] == date(2026, 1, 1)


def test_summary_boundaries(spark):
    today = date(2026, 1, 15)
    data = [
        (date(2025, 1, 15), 999.0, 1.0, 90.0), (date(2025, 1, 16), 130.0, 85.0, 95.0), (date(2025, 6, 2), 120.0, 80.0, 100.0),
        (date(2025, 12, 31), 101.0, 99.0, 100.0), (date(2026, 1, 15), 111.0, 105.0, 110.0),
    ]
    df = spark.createDataFrame([("T", d, c, h, lo, c, 1.0) for d, h, lo, c in data], "ticker string, date date, open double, high double, low double, close double, volume double")
    r = summary.fifty_two_week_range(df, F.lit(today)).first()
    assert (r.high_52w, r.low_52w) == (130.0, 80.0)
    assert summary.ytd_return(df, F.lit(today)).first().ytd_return_pct == pytest.approx(10.0)


def test_history_window_and_short_history(spark):
    bars = series(spark, range(1, 1200), start=date(2022, 1, 1))
    today = F.lit(date(2024, 6, 30))
    kept = B.history_window(bars, today).agg(F.min("date"), F.max("date")).first()
    assert tuple(kept) == (date(2022, 7, 1), date(2024, 6, 30))
    assert B.short_history(bars, today).first().warning is None
    late = B.short_history(series(spark, [1, 2], start=date(2022, 7, 9)), today).first()
    assert late.warning == "T history starts 2022-07-09, later than the requested 2022-07-01: less than 2 years of data"


VOTES = ["close", "sma_50", "sma_200", "macd", "macd_signal", "rsi_14", "bb_pct_b"]


@pytest.mark.parametrize(
    ("changes", "hist", "label", "score"),
    [
        ({}, (1.0, 2.0), "Strong Bullish", 5),
        ({}, (2.0, 1.0), "Bullish", 3),
        ({"rsi_14": 50.0}, (1.0, 2.0), "Bullish", 4),
        ({"close": 90.0, "sma_200": 120.0}, (1.0, 2.0), "Neutral", 1),
        ({"close": 90.0, "sma_200": 120.0, "macd": -1.0, "rsi_14": 40.0}, (2.0, 1.0), "Strong Bearish", -5),
        ({"sma_200": None}, (1.0, 2.0), "Bullish", 4),
    ],
)
def test_votes(spark, changes, hist, label, score):
    base = {"close": 110.0, "sma_50": 100.0, "sma_200": 90.0, "macd": 2.0, "macd_signal": 1.0, "rsi_14": 60.0, "bb_pct_b": 0.5, **changes}
    data = [("T", START, *[base[c] for c in VOTES], hist[0]), ("T", START + timedelta(days=1), *[base[c] for c in VOTES], hist[1])]
    df = spark.createDataFrame(data, "ticker string, date date, " + ", ".join(f"{c} double" for c in VOTES) + ", macd_hist double")
    got = signals.momentum_signal(df).first()
    assert (got.label, got.score) == (label, score)
    assert got.unavailable == (["long_term_regime"] if "sma_200" in changes and changes["sma_200"] is None else [])


def test_reason_text_and_flags(spark):
    data = [("T", START, 12345.678, 0.000012347, 90.0, 2.0, 1.0, 75.0, -0.1, 1.0)]
    df = spark.createDataFrame(data, "ticker string, date date, " + ", ".join(f"{c} double" for c in VOTES) + ", macd_hist double")
    got = signals.momentum_signal(df).first()
    assert got.votes[0].reason == "close 1.235e+04 is above sma_50 1.235e-05"
    assert got.votes[2].reason == "macd 2 is above macd_signal 1"
    assert got.votes[3].reason == "unavailable: hist_today or hist_yesterday has no value yet"
    assert got.flags == ["overbought", "below_lower_band"]


def test_percentile_rank(spark):
    moves = [100 * (1.01 if i % 2 else 1.0) for i in range(100)]
    got = I.volatility_rank(series(spark, moves), 5).first()
    assert got.observations == 95 and 0 < got.percentile_1y <= 100
    assert I.volatility_rank(series(spark, moves[:5]), 5).count() == 0


def test_expected_move_and_levels(spark):
    one = spark.range(1).select(hedge.expected_move(F.lit(200.0), F.lit(30.0))).first()[0]
    assert one == pytest.approx(30.0)
    snap = spark.createDataFrame([("T", 200.0, None, 190.0, 150.0, 20.0)], "ticker string, close double, sma_200 double, bb_lower double, low_52w double, hv_30_pct double")
    vol = spark.createDataFrame([("T", 63, 30.0)], "ticker string, window int, current_pct double")
    got = hedge.hedge_levels(snap, vol).first()
    assert got.volatility_source == "calculate_volatility, 63-day" and got.expected_move == 30.0
    assert [(c.name, c.level, c.pct_from_price) for c in got.candidates] == [
        ("one_sd_low", 170.0, -15.0), ("one_sd_high", 230.0, 15.0), ("bb_lower", 190.0, -5.0), ("low_52w", 150.0, -25.0)
    ]
    fallback = hedge.hedge_levels(snap, vol.where("ticker = 'X'")).first()
    assert fallback.volatility_source == "get_price_data hv_30" and fallback.expected_move == 20.0


def test_horizon_pick(spark):
    df = spark.createDataFrame([("T", 1, 60, 1.0), ("T", 2, 66, 2.0), ("T", 3, 30, 3.0), ("U", 1, 30, 4.0), ("U", 2, 63, 5.0)], "ticker string, call_no int, window int, current_pct double")
    assert {r.ticker: r.window for r in hedge.horizon_volatility(df).collect()} == {"T": 66, "U": 63}


def test_fact_lines(spark):
    days = [START + timedelta(days=i) for i in range(12)]
    names = ["close", "sma_50", "sma_200", "rsi_14", "macd", "macd_signal", "macd_hist", "bb_pct_b", "hv_30"]
    early = [100.0, 104.0, 100.0, 45.0, 1.0, 1.5, -0.5, 0.5, 0.2]
    late = [110.0, 102.0, 100.0, 55.0, 2.0, 1.5, 0.5, 0.75, 0.25]
    data = [("T", d, *(late if i > 6 else early)) for i, d in enumerate(days)]
    df = spark.createDataFrame(data, "ticker string, date date, " + ", ".join(f"{n} double" for n in names))
    summ = spark.createDataFrame([("T", "USD", 80.0, 130.0, 10.0)], "ticker string, currency string, low_52w double, high_52w double, ytd_return_pct double")
    assert facts.technical_facts(df, summ).first().facts == [
        "Close: 110.00 USD",
        "Close vs 50-day SMA (102.00): +7.8%",
        "Close vs 200-day SMA (100.00): +10.0%",
        "50-day SMA vs 200-day SMA: +2.0% now, +4.0% 10 trading days ago (gap narrowing)",
        "RSI-14: 55.0 now, 45.0 5 trading days ago (rising); overbought above 70, oversold below 30",
        "MACD: 2.00, signal line 1.50 (MACD above the signal line); histogram 0.50 now, 0.50 the day before (flat)",
        "Bollinger %B: 0.75 (0 is the lower band, 1 the upper band; outside 0 to 1 is outside the bands)",
        "52-week range: low 80.00, high 130.00; close at 60% of the range",
        "30-day annualised volatility: 25.0%",
        "Year-to-date return: +10.0%",
    ]
    bare = facts.technical_facts(df.where("date > '2024-01-11'").withColumn("rsi_14", F.lit(None).cast("double")), summ).first().facts
    assert bare[3] == "50-day SMA vs 200-day SMA: +2.0% now; the value 10 trading days ago is unavailable"
    assert bare[4] == "RSI-14: unavailable"


def test_too_few_prices_give_an_empty_row(spark):
    rows = [("A", day, 100.0 + day % 3) for day in range(1, 29)] + [("B", day, 50.0) for day in range(1, 4)]
    bars = spark.createDataFrame(rows, "ticker string, day int, close double").select("ticker", F.make_date(F.lit(2026), F.lit(1), "day").alias("date"), "close")
    got = {r["ticker"]: (r["status"], r["warning"]) for r in I.volatility_report(bars, 5).collect()}
    assert got == {"A": ("ok", None), "B": ("empty", "B has fewer than 6 daily prices, too few for a 5-day volatility")}
