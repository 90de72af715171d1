"""Market queries: bars, indicators, signals, summaries, hedge levels."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.operators import bars as B
from ledgerloom.operators import facts, hedge, indicators as I, signals, smoothing as S, summary
from ledgerloom.operators.scan import seeded_scan
from ledgerloom.plans import bindings as D
from ledgerloom.session import shared_dir, stored


def _bars(spark, d):
    return B.bars_from_ticks(D.ticks(spark, d))


def _stored_bars(spark, d):
    """Daily bars kept in the shared folder: for queries that read them more than once."""
    return stored(_bars(spark, d), shared_dir(spark, "bars"))


def _priced(spark, d):
    """Bars with every indicator, stored."""
    return stored(I.add_indicators(_bars(spark, d)), shared_dir(spark, "priced"))


def _clean_orders(spark, d):
    return B.clean_bars(D.order_bars(spark, d))


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def daily_bars(spark: SparkSession, d: str) -> DataFrame:
    return _bars(spark, d)


def cleaned_bars(spark, d):
    return _clean_orders(spark, d)


def bar_cleaning_report(spark, d):
    return B.cleaning_report(D.order_bars(spark, d))


def bar_history_window(spark, d):
    bars = _clean_orders(spark, d)
    return B.history_window(bars, D.last_date(bars)).select("ticker", "date", "close")


def short_history_warnings(spark, d):
    bars = _clean_orders(spark, d)
    return B.short_history(bars, F.date_add(D.last_date(bars), 400), years=8)


def normalised_tickers(spark, d):
    raw = D.table(spark, d, "part").select(
        F.col("p_partkey").alias("part"),
        F.when(F.col("p_size") == 1, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("ticker"),
    )
    return B.normalised_ticker(raw)


def period_trim(spark, d):
    requests = D.table(spark, d, "nation").select(
        F.col("n_name").alias("ticker"),
        F.element_at(F.array([F.lit(x) for x in ("1mo", "3mo", "6mo", "1y", "2y", "7w")]), F.col("n_regionkey") + 2).alias("period"),
    )
    bars = _clean_orders(spark, d)
    return B.with_period_start(requests, D.last_date(bars))


def trimmed_bars(spark, d):
    """All bars, cut to each of the periods; an unknown one counts as the default."""
    bars = _clean_orders(spark, d)
    today = D.last_date(bars)
    cut = [B.trim_to_period(bars, today, p).select(F.lit(p).alias("period"), "ticker", "date", "close") for p in ("1mo", "3mo", "6mo", "1y", "2y", "7w")]
    return functools.reduce(lambda a, b: a.unionByName(b), cut)


def moving_averages(spark, d):
    w = I.with_window_indicators(_bars(spark, d))
    return _round(w.select("ticker", "date", "sma_50", "sma_200"), 5, "sma_50", "sma_200")


def bollinger_bands(spark, d):
    w = I.with_window_indicators(_bars(spark, d)).select("ticker", "date", "bb_middle", "bb_upper", "bb_lower", "bb_pct_b")
    return _round(_round(w, 5, "bb_middle"), 4, "bb_upper", "bb_lower", "bb_pct_b")


def volatility(spark, d):
    return _round(I.volatility_series(_bars(spark, d)), 5, "volatility")


def tick_ema(spark, d):
    """The 12-tick EMA of every ticker's ticks in order of their number (of equal numbers the dearest); a ticker has about a third of all rows."""
    ticks = D.ticks(spark, d).groupBy("ticker", "seq").agg(F.max("price").alias("price"))
    out = seeded_scan(ticks, ["ticker"], "seq", "price", 12, 2.0 / 13, "ema")
    return out.select("ticker", F.col("seq").cast("string").alias("seq"), F.round("ema", 4).alias("ema"))


def seeded_smoothing(spark, d):
    w = S.with_smoothing(_bars(spark, d), 14, 1.0 / 14).select("ticker", "date", "smoothed")
    return _round(w, 2, "smoothed")


def ema(spark, d):
    w = S.with_ema(_bars(spark, d), [12, 26]).select("ticker", "date", "ema_12", "ema_26")
    return _round(w, 2, "ema_12", "ema_26")


def rsi(spark, d):
    return _round(S.with_rsi(_bars(spark, d)).select("ticker", "date", "rsi_14"), 4, "rsi_14")


def macd(spark, d):
    w = S.with_macd(_bars(spark, d)).select("ticker", "date", "macd", "macd_signal", "macd_hist")
    return _round(w, 2, "macd", "macd_signal", "macd_hist")


def all_indicators(spark, d):
    w = I.add_indicators(_bars(spark, d)).drop("open", "high", "low", "volume")
    rest = ["macd", "macd_signal", "macd_hist", "bb_upper", "bb_lower", "rsi_14", "bb_pct_b", "hv_30"]
    return _round(_round(w, 5, "sma_50", "sma_200", "bb_middle"), 4, *rest)


def indicator_audit(spark, d):
    return I.recompute_audit(_stored_bars(spark, d)).select("ticker", "agrees")


def values_back(spark, d):
    w = I.with_window_indicators(_bars(spark, d))
    return w.select(
        "ticker", "date",
        F.round(I.value_back("sma_50", 10), 5).alias("sma_50_10_back"),
        F.round(I.value_back("hv_30", 5), 5).alias("hv_30_5_back"),
    )


def range_52_weeks(spark, d):
    bars = _clean_orders(spark, d)
    return summary.fifty_two_week_range(bars, D.last_date(bars))


def rolling_range_52_weeks(spark, d):
    return summary.rolling_52_week_range(_clean_orders(spark, d))


def ytd_return(spark, d):
    bars = _clean_orders(spark, d)
    return _round(summary.ytd_return(bars, D.last_date(bars)), 6, "ytd_return_pct")


def year_base_as_of(spark, d):
    return _round(summary.rolling_year_base(_clean_orders(spark, d)), 6, "ytd_return_pct")


def period_statistics(spark, d):
    w = stored(I.with_window_indicators(_bars(spark, d)), shared_dir(spark, "windows"))
    out = B.period_stats(w, D.last_date(w), "1y")
    return _round(out, 4, "period_return_pct", "close_vs_sma_50_pct", "close_vs_sma_200_pct")


def volatility_rank(spark, d):
    out = I.volatility_rank(_bars(spark, d), 63)
    return _round(out, 4, "current_pct", "min_1y_pct", "median_1y_pct", "max_1y_pct", "percentile_1y")


def last_five_bars(spark, d):
    return B.latest_bars(_bars(spark, d), 5).select("ticker", "date", "open", "close", "back")


def trailing_year(spark, d):
    return B.trailing_year(_clean_orders(spark, d)).select("ticker", "date", "close")


def bar_indicator_maps(spark, d):
    w = B.bars_with_indicator_map(I.add_indicators(_bars(spark, d)))
    return w.select(
        "ticker", "date",
        F.size("indicators").alias("entries"),
        F.round(F.col("indicators")["rsi_14"], 4).alias("rsi_14"),
        F.size(F.filter(F.map_values("indicators"), lambda x: x.isNotNull())).alias("present"),
    )


def momentum(spark, d):
    m = signals.momentum_signal(I.add_indicators(_bars(spark, d)))
    return m.select(
        "ticker", "as_of", "label", "score",
        F.array_join(F.transform("votes", lambda v: v["vote"].cast("string")), ",").alias("votes"),
        F.array_join("flags", ",").alias("flags"),
        F.array_join("unavailable", ",").alias("unavailable"),
    )


def vote_reasons(spark, d):
    m = signals.momentum_signal(I.add_indicators(_clean_orders(spark, d)))
    return m.select("ticker", F.explode("votes").alias("v")).select("ticker", "v.name", "v.vote", "v.reason")


def company_fundamentals(spark, d):
    return summary.fundamentals(D.supplier_fundamentals(spark, d))


def pe_fallback(spark, d):
    raw = summary.fundamentals(D.supplier_fundamentals(spark, d))
    priced = D.table(spark, d, "supplier").select(
        F.col("s_name").alias("ticker"), F.when(F.col("s_nationkey") != 11, F.abs("s_acctbal")).alias("current")
    )
    c = F.col
    joined = raw.join(priced, "ticker")
    return joined.select(
        "ticker",
        F.round(summary.pe_ratio(c("current"), c("trailing_pe"), c("trailing_eps")), 4).alias("pe_ratio"),
        summary.pe_warning(c("current"), c("trailing_pe"), c("trailing_eps")).alias("warning"),
    )


def _summary(spark, d, priced):
    companies = summary.fundamentals(D.flag_fundamentals(spark, d))
    return summary.market_summary(priced, companies, D.last_date(priced))


def market_summary(spark, d):
    out = _summary(spark, d, _priced(spark, d))
    return out.select(
        "ticker", "company_name", "currency", "as_of", "current_price", "high_52w", "low_52w", "pe_ratio",
        "ytd_return_pct",
        F.col("momentum.label").alias("label"),
        F.col("momentum.score").alias("score"),
        F.col("indicators")["sma_50"].alias("sma_50"),
        F.col("indicators")["macd_hist"].alias("macd_hist"),
        F.array_join("warnings", " | ").alias("warnings"),
    )


def trend_changes(spark, d):
    t = facts.trend_readings(I.add_indicators(_bars(spark, d)))
    return t.select(
        "ticker", F.round("gap_now", 4).alias("gap_now"), F.round("gap_then", 4).alias("gap_then"),
        "gap_change", "rsi_direction", "hist_direction",
    )


def range_positions(spark, d):
    bars = _clean_orders(spark, d)
    span = summary.rolling_52_week_range(bars).withColumnsRenamed({"high_52w": "high", "low_52w": "low"})
    joined = bars.select("ticker", "date", "close").join(span, ["ticker", "date"])
    place = facts.range_position(F.col("close"), F.col("low"), F.col("high"))
    return joined.select("ticker", "date", F.round(place, 4).alias("position"))


def technical_fact_lines(spark, d):
    priced = _priced(spark, d)
    lines = facts.technical_facts(priced, _summary(spark, d, priced))
    return lines.select("ticker", F.posexplode("facts").alias("line_no", "line"))


def expected_moves(spark, d):
    w = I.with_window_indicators(_bars(spark, d)).where("hv_30 is not null")
    move = hedge.expected_move(F.col("close"), F.col("hv_30") * 100.0)
    return w.select("ticker", "date", F.round(move, 2).alias("expected_move"))


def _vol_results(bars):
    """Three volatility results per ticker: windows 30, 60 and 66, the last two tied around the horizon."""
    out = None
    for call_no, window in enumerate((30, 60, 66), 1):
        one = I.volatility_rank(bars, window).withColumn("call_no", F.lit(call_no))
        out = one if out is None else out.unionByName(one)
    return out


def horizon_volatility(spark, d):
    best = hedge.horizon_volatility(_vol_results(_stored_bars(spark, d)))
    return best.select("ticker", "window", "call_no", F.round("current_pct", 4).alias("current_pct"))


def _snapshot(priced):
    return B.price_snapshot(priced, B.period_stats(priced, D.last_date(priced), "1y"))


def price_snapshots(spark, d):
    return _snapshot(_priced(spark, d))


def price_digests(spark, d):
    w = _priced(spark, d)
    out = B.price_digest(w, B.period_stats(w, D.last_date(w), "1y"))
    return out.select(
        "ticker", "as_of", "close", "period_high", F.col("indicators")["rsi_14"].alias("rsi_14"),
        F.size("last_bars").alias("bars_shown"),
        F.element_at("last_bars", 1)["date"].alias("first_shown"),
        F.element_at("last_bars", -1)["volume"].alias("last_volume"),
    )


def hedge_candidates(spark, d):
    priced = _priced(spark, d)
    levels = hedge.hedge_levels(_snapshot(priced), hedge.horizon_volatility(_vol_results(priced)))
    return levels.select(
        "ticker", "price", "volatility_pct", "volatility_source", "expected_move", "expected_move_pct",
        F.explode("candidates").alias("c"),
    ).select("*", "c.name", "c.level", "c.pct_from_price", "c.meaning").drop("c")


def hedge_legs_priced(spark, d):
    priced = _priced(spark, d)
    levels = hedge.hedge_levels(_snapshot(priced), I.volatility_rank(priced, 63))
    legs = (
        D.table(spark, d, "lineitem")
        .groupBy(F.col("l_returnflag").alias("ticker"), F.col("l_linenumber").alias("leg_no"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "ticker", "leg_no",
            F.when(F.col("leg_no") < 4, "buy").otherwise("sell").alias("action"),
            F.lit("put").alias("instrument"),
            F.element_at(F.array(*[F.lit(x) for x in ("one_sd_low", "sma_200", "bb_lower", "low_52w", "unknown_level")], F.lit(None).cast("string"), F.lit("one_sd_high")), F.col("leg_no")).alias("level_name"),
        )
    )
    return hedge.priced_legs(legs, levels)


# --- SQL ------------------------------------------------------------------------

BARS = """bars AS (
  SELECT ticker, date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, seq) AS close, sum(size) AS volume
  FROM (SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS price, l_quantity AS size,
               l_orderkey::HUGEINT * 100000000000000 + l_linenumber::HUGEINT * 1000000000000 + l_partkey AS seq
        FROM lineitem) GROUP BY ticker, date)"""
ORDERS_RAW = """raw AS (
  SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, o_orderkey AS seq, o_totalprice AS open,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS high, o_totalprice AS low, o_totalprice AS close,
         CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE CAST(o_custkey AS DOUBLE) END AS volume FROM orders)"""
OBARS = ORDERS_RAW + """, last AS (
  SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY seq DESC) AS rn,
         count(*) OVER (PARTITION BY ticker, date) AS copies FROM raw),
bars AS (SELECT ticker, date, open, high, low, close, volume FROM last WHERE rn = 1 AND high IS NOT NULL)"""


def _ind(source: str, price_of: str = "bars") -> str:
    """The indicator columns over ``bars``; recursions by recursive CTEs."""
    return f"""{source},
num AS (SELECT *, row_number() OVER w AS rn, close - lag(close) OVER w AS diff,
          ln(close / lag(close) OVER w) AS lr FROM {price_of} WINDOW w AS (PARTITION BY ticker ORDER BY date)),
seed AS (SELECT ticker, avg(close) FILTER (rn <= 12) AS f0, avg(close) FILTER (rn <= 26) AS s0,
           avg(greatest(diff, 0)) FILTER (rn BETWEEN 2 AND 15) AS g0,
           avg(greatest(-diff, 0)) FILTER (rn BETWEEN 2 AND 15) AS l0,
           avg(close) FILTER (rn <= 14) AS m0 FROM num GROUP BY ticker),
walk AS (
  SELECT ticker, rn, CAST(NULL AS DOUBLE) AS f, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS g,
         CAST(NULL AS DOUBLE) AS l, CAST(NULL AS DOUBLE) AS m FROM num WHERE rn = 1
  UNION ALL
  SELECT n.ticker, n.rn,
    CASE WHEN n.rn = 12 THEN f0 WHEN n.rn > 12 THEN f + (2.0/13) * (close - f) END,
    CASE WHEN n.rn = 26 THEN s0 WHEN n.rn > 26 THEN s + (2.0/27) * (close - s) END,
    CASE WHEN n.rn = 15 THEN g0 WHEN n.rn > 15 THEN g + (1.0/14) * (greatest(diff, 0) - g) END,
    CASE WHEN n.rn = 15 THEN l0 WHEN n.rn > 15 THEN l + (1.0/14) * (greatest(-diff, 0) - l) END,
    CASE WHEN n.rn = 14 THEN m0 WHEN n.rn > 14 THEN m + (1.0/14) * (close - m) END
  FROM walk w JOIN num n ON n.ticker = w.ticker AND n.rn = w.rn + 1 JOIN seed z ON z.ticker = n.ticker),
line AS (SELECT ticker, rn, f - s AS line FROM walk),
lseed AS (SELECT ticker, avg(line) FILTER (rn BETWEEN 26 AND 34) AS x0 FROM line GROUP BY ticker),
sig AS (
  SELECT ticker, rn, CAST(NULL AS DOUBLE) AS sg FROM line WHERE rn = 1
  UNION ALL
  SELECT n.ticker, n.rn, CASE WHEN n.rn = 34 THEN x0 WHEN n.rn > 34 THEN sg + (2.0/10) * (line - sg) END
  FROM sig w JOIN line n ON n.ticker = w.ticker AND n.rn = w.rn + 1 JOIN lseed z ON z.ticker = n.ticker),
frames AS (SELECT num.*,
    CASE WHEN rn >= 50 THEN avg(close) OVER (w ROWS 49 PRECEDING) END AS sma_50,
    CASE WHEN rn >= 200 THEN avg(close) OVER (w ROWS 199 PRECEDING) END AS sma_200,
    CASE WHEN rn >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS bb_middle,
    CASE WHEN rn >= 20 THEN stddev_pop(close) OVER (w ROWS 19 PRECEDING) END AS sd,
    CASE WHEN rn >= 31 THEN stddev_samp(lr) OVER (w ROWS 29 PRECEDING) * sqrt(252.0) END AS hv_30,
    CASE WHEN rn >= 61 THEN stddev_samp(lr) OVER (w ROWS 59 PRECEDING) * sqrt(252.0) END AS hv_60,
    CASE WHEN rn >= 64 THEN stddev_samp(lr) OVER (w ROWS 62 PRECEDING) * sqrt(252.0) END AS hv_63,
    CASE WHEN rn >= 67 THEN stddev_samp(lr) OVER (w ROWS 65 PRECEDING) * sqrt(252.0) END AS hv_66
  FROM num WINDOW w AS (PARTITION BY ticker ORDER BY date)),
ind AS (SELECT fr.*, walk.f AS ema_12, walk.s AS ema_26, walk.m AS smoothed,
    CASE WHEN g IS NULL THEN NULL WHEN l = 0 AND g = 0 THEN 50.0 WHEN l = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + g / l) END AS rsi_14,
    f - s AS macd, sg AS macd_signal, f - s - sg AS macd_hist,
    bb_middle + 2 * sd AS bb_upper, bb_middle - 2 * sd AS bb_lower,
    CASE WHEN 4 * sd < 1e-12 THEN 0.5 ELSE (close - (bb_middle - 2 * sd)) / (4 * sd) END AS bb_pct_b
  FROM frames fr JOIN walk USING (ticker, rn) JOIN sig USING (ticker, rn)),
latest AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) - 1 AS back FROM ind)"""


L_IND = "WITH RECURSIVE " + _ind(BARS)
O_IND = "WITH RECURSIVE " + _ind(OBARS)
TODAY = "(SELECT max(date) FROM bars)"
VOTES = """two AS (SELECT a.*, b.macd_hist AS hist_yesterday FROM latest a LEFT JOIN latest b ON b.ticker = a.ticker AND b.back = 1 WHERE a.back = 0),
v AS (SELECT *, coalesce(sign(close - sma_50), 0)::INT AS v1, coalesce(sign(sma_50 - sma_200), 0)::INT AS v2,
  coalesce(sign(macd - macd_signal), 0)::INT AS v3, coalesce(sign(macd_hist - hist_yesterday), 0)::INT AS v4,
  coalesce(sign(rsi_14 - 50), 0)::INT AS v5 FROM two),
scored AS (SELECT *, v1 + v2 + v3 + v4 + v5 AS score,
  CASE WHEN v1+v2+v3+v4+v5 >= 5 THEN 'Strong Bullish' WHEN v1+v2+v3+v4+v5 >= 3 THEN 'Bullish'
       WHEN v1+v2+v3+v4+v5 <= -5 THEN 'Strong Bearish' WHEN v1+v2+v3+v4+v5 <= -3 THEN 'Bearish' ELSE 'Neutral' END AS label FROM v)"""
STATS = f"""stats AS (SELECT ticker, max(date) FILTER (p) AS as_of, count(*) FILTER (p) AS bars, arg_min(close, date) FILTER (p) AS first_close,
    arg_max(close, date) FILTER (p) AS close, max(high) FILTER (p) AS period_high, min(low) FILTER (p) AS period_low,
    max(high) FILTER (y) AS high_52w, min(low) FILTER (y) AS low_52w, arg_max(sma_50, date) AS sma_50, arg_max(sma_200, date) AS sma_200
  FROM (SELECT *, date >= {TODAY} - INTERVAL 12 MONTH AS p, date >= {TODAY} - INTERVAL 364 DAY AS y FROM ind) GROUP BY ticker)"""
SNAP = STATS + """, snap AS (SELECT s.ticker, '1y' AS period, s.as_of, round(s.close, 2) AS close,
    round((s.close / s.first_close - 1) * 100, 2) AS period_return_pct, round((s.close / s.sma_50 - 1) * 100, 2) AS close_vs_sma_50_pct,
    round((s.close / s.sma_200 - 1) * 100, 2) AS close_vs_sma_200_pct, round(high_52w, 2) AS high_52w, round(low_52w, 2) AS low_52w,
    round(l.sma_200, 2) AS sma_200, round(rsi_14, 2) AS rsi_14, round(macd, 2) AS macd, round(macd_signal, 2) AS macd_signal,
    round(macd_hist, 2) AS macd_hist, round(bb_lower, 2) AS bb_lower, round(bb_pct_b, 2) AS bb_pct_b, round(hv_30 * 100, 2) AS hv_30_pct
  FROM stats s JOIN latest l ON l.ticker = s.ticker AND l.back = 0)"""


def _rank(n: int) -> str:
    return f"""(SELECT ticker, {n} AS "window", max(date) AS as_of, max(cur) * 100 AS current_pct, min(x) * 100 AS min_1y_pct,
    median(x) * 100 AS median_1y_pct, max(x) * 100 AS max_1y_pct, avg(CASE WHEN x <= cur THEN 1 ELSE 0 END) * 100 AS percentile_1y, count(*) AS observations
    FROM (SELECT *, first_value(x) OVER (PARTITION BY ticker ORDER BY date DESC) AS cur,
            row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r
          FROM (SELECT ticker, date, hv_{n} AS x FROM ind WHERE hv_{n} IS NOT NULL)) WHERE r <= 252 GROUP BY ticker)"""


SUPPLIER = """fund AS (SELECT s_name AS ticker, s_acctbal, s_nationkey,
    CASE WHEN s_nationkey >= 5 AND s_nationkey < 20 THEN s_name || ' Ltd' WHEN s_nationkey < 23 THEN 'S' || s_suppkey END AS company_name,
    CASE WHEN s_nationkey <> 7 THEN 'USD' END AS currency,
    CASE WHEN s_acctbal < 0 OR s_nationkey = 3 THEN NULL WHEN s_nationkey < 12 THEN s_acctbal / 100 END AS trailing_pe,
    CASE WHEN s_nationkey <> 9 THEN (s_nationkey - 10) / 4.0::DOUBLE END AS trailing_eps FROM supplier)"""
FLAGS = """fund AS (SELECT l_returnflag AS ticker, CASE WHEN l_returnflag <> 'A' THEN 'Flag ' || l_returnflag ELSE 'Flag' END AS company_name,
    CASE WHEN l_returnflag <> 'N' THEN 'USD' END AS currency, CASE WHEN l_returnflag = 'R' THEN max(l_quantity) END AS trailing_pe,
    CASE WHEN l_returnflag <> 'N' THEN max(l_linenumber)::DOUBLE END AS trailing_eps FROM lineitem GROUP BY l_returnflag)"""
SUMMARY = f"""{VOTES}, {FLAGS},
ytd AS (SELECT ticker, arg_max(close, date) AS current, arg_max(close, date) FILTER (date < date_trunc('year', {TODAY})) AS base FROM bars GROUP BY ticker),
yr AS (SELECT ticker, max(high) AS high_52w, min(low) AS low_52w FROM bars WHERE date >= {TODAY} - INTERVAL 364 DAY GROUP BY ticker),
summ AS (SELECT s.*, company_name, currency, current, CASE WHEN base > 0 THEN (current / base - 1) * 100 END AS ytd_return_pct, high_52w, low_52w,
    CASE WHEN trailing_pe > 0 THEN trailing_pe WHEN trailing_eps > 0 THEN current / trailing_eps END AS pe_ratio,
    CASE WHEN trailing_pe > 0 THEN '' WHEN trailing_eps IS NULL THEN 'P/E unavailable: Yahoo returned neither trailingPE nor trailing EPS'
         ELSE 'Yahoo returned no trailingPE, so P/E is computed as current price / trailing EPS' END AS warnings
  FROM scored s JOIN fund USING (ticker) JOIN ytd USING (ticker) JOIN yr USING (ticker))"""
TREND = """trend AS (SELECT a.ticker, a.close, a.sma_50, a.sma_200, a.macd, a.macd_signal, a.bb_pct_b, a.hv_30, (a.sma_50 / a.sma_200 - 1) * 100 AS gap_now, (c.sma_50 / c.sma_200 - 1) * 100 AS gap_then,
    a.rsi_14 AS rsi_now, b5.rsi_14 AS rsi_then, a.macd_hist AS hist_now, b1.macd_hist AS hist_before
  FROM latest a LEFT JOIN latest c ON c.ticker = a.ticker AND c.back = 10 LEFT JOIN latest b5 ON b5.ticker = a.ticker AND b5.back = 5
  LEFT JOIN latest b1 ON b1.ticker = a.ticker AND b1.back = 1 WHERE a.back = 0),
words AS (SELECT *, CASE WHEN (gap_now > 0) <> (gap_then > 0) THEN 'averages crossed' WHEN abs(gap_now) > abs(gap_then) THEN 'gap widening'
    WHEN abs(gap_now) < abs(gap_then) THEN 'gap narrowing' WHEN gap_now IS NOT NULL AND gap_then IS NOT NULL THEN 'gap unchanged' END AS gap_change,
    CASE WHEN rsi_now > rsi_then THEN 'rising' WHEN rsi_now < rsi_then THEN 'falling' WHEN rsi_now = rsi_then THEN 'flat' END AS rsi_direction,
    CASE WHEN hist_now > hist_before THEN 'rising' WHEN hist_now < hist_before THEN 'falling' WHEN hist_now = hist_before THEN 'flat' END AS hist_direction FROM trend)"""
HEDGE = SNAP + f""", ests AS (SELECT 1 AS call_no, * FROM {_rank(30)} UNION ALL SELECT 2, * FROM {_rank(60)} UNION ALL SELECT 3, * FROM {_rank(66)}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY abs("window" - 63), call_no DESC) AS pick FROM ests) WHERE pick = 1),
hedge AS (SELECT s.*, b."window", b.current_pct, s.close * b.current_pct / 100 * sqrt(63.0 / 252) AS move FROM snap s JOIN best b USING (ticker))"""

QUERIES = {
    "daily_bars": daily_bars,
    "cleaned_bars": cleaned_bars,
    "bar_cleaning_report": bar_cleaning_report,
    "bar_history_window": bar_history_window,
    "short_history_warnings": short_history_warnings,
    "normalised_tickers": normalised_tickers,
    "period_trim": period_trim,
    "trimmed_bars": trimmed_bars,
    "moving_averages": moving_averages,
    "bollinger_bands": bollinger_bands,
    "volatility": volatility,
    "seeded_smoothing": seeded_smoothing,
    "tick_ema": tick_ema,
    "ema": ema,
    "rsi": rsi,
    "macd": macd,
    "all_indicators": all_indicators,
    "indicator_audit": indicator_audit,
    "values_back": values_back,
    "range_52_weeks": range_52_weeks,
    "rolling_range_52_weeks": rolling_range_52_weeks,
    "ytd_return": ytd_return,
    "year_base_as_of": year_base_as_of,
    "period_statistics": period_statistics,
    "volatility_rank": volatility_rank,
    "last_five_bars": last_five_bars,
    "trailing_year": trailing_year,
    "bar_indicator_maps": bar_indicator_maps,
    "momentum": momentum,
    "vote_reasons": vote_reasons,
    "company_fundamentals": company_fundamentals,
    "pe_fallback": pe_fallback,
    "market_summary": market_summary,
    "trend_changes": trend_changes,
    "range_positions": range_positions,
    "technical_fact_lines": technical_fact_lines,
    "expected_moves": expected_moves,
    "horizon_volatility": horizon_volatility,
    "price_snapshots": price_snapshots,
    "price_digests": price_digests,
    "hedge_candidates": hedge_candidates,
    "hedge_legs_priced": hedge_legs_priced,
}

ORACLE = {
    "daily_bars": f"WITH {BARS} SELECT * FROM bars",
    "cleaned_bars": f"WITH {OBARS} SELECT * FROM bars",
    "bar_cleaning_report": f"""WITH {OBARS} SELECT ticker, CAST(sum(copies) AS BIGINT) AS rows_read, CAST(sum(copies - 1) AS BIGINT) AS duplicates,
      count(*) FILTER (high IS NULL) AS incomplete, count(*) FILTER (high IS NOT NULL) AS kept FROM last WHERE rn = 1 GROUP BY ticker""",
    "bar_history_window": f"""WITH {OBARS} SELECT ticker, date, close FROM bars
      WHERE date >= {TODAY} + 1 - INTERVAL 24 MONTH AND date < {TODAY} + 1""",
    "short_history_warnings": f"""WITH {OBARS}, s AS (SELECT CAST({TODAY} + 401 - INTERVAL 96 MONTH AS DATE) AS start)
      SELECT ticker, min(date) AS first_date, count(*) AS bars,
        CASE WHEN min(date) - any_value(start) > 7 THEN ticker || ' history starts ' || min(date) || ', later than the requested ' || any_value(start) || ': less than 8 years of data' END AS warning
      FROM bars, s GROUP BY ticker""",
    "normalised_tickers": """SELECT p_partkey AS part, CASE WHEN p_size = 1 THEN '' ELSE upper(p_name) END AS ticker, p_size <> 1 AS ticker_ok FROM part""",
    "period_trim": f"""WITH {OBARS}, req AS (SELECT n_name AS ticker, (['1mo','3mo','6mo','1y','2y','7w'])[n_regionkey + 2] AS p FROM nation)
      SELECT ticker, CASE WHEN p = '7w' THEN '6mo' ELSE p END AS period,
        CASE WHEN p = '7w' THEN 'period ''7w'' is not one of [''1mo'', ''3mo'', ''6mo'', ''1y'', ''2y''], so 6mo was used' END AS period_warning,
        CAST({TODAY} - (CASE p WHEN '1mo' THEN 1 WHEN '3mo' THEN 3 WHEN '1y' THEN 12 WHEN '2y' THEN 24 ELSE 6 END) * INTERVAL 1 MONTH AS DATE) AS period_start FROM req""",
    "trimmed_bars": f"""WITH {OBARS} SELECT period, ticker, date, close FROM bars, (VALUES ('1mo', 1), ('3mo', 3), ('6mo', 6), ('1y', 12), ('2y', 24), ('7w', 6)) p(period, months)
      WHERE date >= CAST({TODAY} - months * INTERVAL 1 MONTH AS DATE)""",
    "moving_averages": f"{L_IND} SELECT ticker, date, round(sma_50, 5) AS sma_50, round(sma_200, 5) AS sma_200 FROM ind",
    "bollinger_bands": f"{L_IND} SELECT ticker, date, round(bb_middle, 5) AS bb_middle, round(bb_upper, 4) AS bb_upper, round(bb_lower, 4) AS bb_lower, round(bb_pct_b, 4) AS bb_pct_b FROM ind",
    "volatility": f"{L_IND} SELECT ticker, date, round(hv_30, 5) AS volatility FROM ind WHERE hv_30 IS NOT NULL",
    "tick_ema": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY seq) AS place FROM (SELECT l_returnflag AS ticker, max(l_extendedprice) AS price,
        l_orderkey::HUGEINT * 100000000000000 + l_linenumber::HUGEINT * 1000000000000 + l_partkey AS seq FROM lineitem GROUP BY ticker, seq)),
      s AS (SELECT ticker, avg(price) AS seed FROM l WHERE place <= 12 GROUP BY ticker), -- what is more than 240 ticks old weighs less than 10 ** -17
      w AS (SELECT *, list(CASE WHEN place > 12 THEN price ELSE 0 END) OVER (PARTITION BY ticker ORDER BY place ROWS 239 PRECEDING) AS xs FROM l)
      SELECT ticker, CAST(seq AS VARCHAR) AS seq, round(CASE WHEN place >= 12 THEN pow(11 / 13.0::DOUBLE, place - 12) * seed + 2 / 13.0::DOUBLE * list_sum(list_transform(xs, lambda x, i: x * pow(11 / 13.0::DOUBLE, len(xs) - i))) END, 4) AS ema
      FROM w JOIN s USING (ticker)""",
    "seeded_smoothing": f"{L_IND} SELECT ticker, date, round(smoothed, 2) AS smoothed FROM ind",
    "ema": f"{L_IND} SELECT ticker, date, round(ema_12, 2) AS ema_12, round(ema_26, 2) AS ema_26 FROM ind",
    "rsi": f"{L_IND} SELECT ticker, date, round(rsi_14, 4) AS rsi_14 FROM ind",
    "macd": f"{L_IND} SELECT ticker, date, round(macd, 2) AS macd, round(macd_signal, 2) AS macd_signal, round(macd_hist, 2) AS macd_hist FROM ind",
    "all_indicators": f"""{L_IND} SELECT ticker, date, close, round(sma_50, 5) AS sma_50, round(sma_200, 5) AS sma_200, round(rsi_14, 4) AS rsi_14,
      round(macd, 4) AS macd, round(macd_signal, 4) AS macd_signal, round(macd_hist, 4) AS macd_hist, round(bb_middle, 5) AS bb_middle,
      round(bb_upper, 4) AS bb_upper, round(bb_lower, 4) AS bb_lower, round(bb_pct_b, 4) AS bb_pct_b, round(hv_30, 4) AS hv_30 FROM ind""",
    "indicator_audit": "SELECT DISTINCT l_returnflag AS ticker, true AS agrees FROM lineitem",
    "values_back": f"""{L_IND} SELECT ticker, date, round(lag(sma_50, 10) OVER w, 5) AS sma_50_10_back, round(lag(hv_30, 5) OVER w, 5) AS hv_30_5_back
      FROM ind WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    "range_52_weeks": f"""WITH {OBARS} SELECT ticker, max(high) AS high_52w, min(low) AS low_52w FROM bars WHERE date >= {TODAY} - INTERVAL 364 DAY GROUP BY ticker""",
    "rolling_range_52_weeks": f"""WITH {OBARS} SELECT ticker, date, max(high) OVER w AS high_52w, min(low) OVER w AS low_52w FROM bars
      WINDOW w AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 364 DAY PRECEDING AND CURRENT ROW)""",
    "ytd_return": f"""WITH {OBARS}, y AS (SELECT ticker, arg_max(close, date) AS current, arg_max(close, date) FILTER (date < date_trunc('year', {TODAY})) AS base FROM bars GROUP BY ticker)
      SELECT *, CASE WHEN base > 0 THEN round((current / base - 1) * 100, 6) END AS ytd_return_pct FROM y""",
    "year_base_as_of": f"""WITH {OBARS}, y AS (SELECT ticker, year(date) AS y, arg_max(close, date) AS yc FROM bars GROUP BY ALL),
      z AS (SELECT ticker, y, lag(yc) OVER (PARTITION BY ticker ORDER BY y) AS base FROM y)
      SELECT b.ticker, date, close, base AS base_close, CASE WHEN base > 0 THEN round((close / base - 1) * 100, 6) END AS ytd_return_pct
      FROM bars b LEFT JOIN z ON z.ticker = b.ticker AND z.y = year(b.date)""",
    "period_statistics": f"""{L_IND}, {STATS} SELECT ticker, '1y' AS period, as_of, bars, close, round((close / first_close - 1) * 100, 4) AS period_return_pct,
      period_high, period_low, high_52w, low_52w, round((close / sma_50 - 1) * 100, 4) AS close_vs_sma_50_pct, round((close / sma_200 - 1) * 100, 4) AS close_vs_sma_200_pct FROM stats""",
    "volatility_rank": f"""{L_IND} SELECT ticker, "window", as_of, round(current_pct, 4) AS current_pct, round(min_1y_pct, 4) AS min_1y_pct, round(median_1y_pct, 4) AS median_1y_pct,
      round(max_1y_pct, 4) AS max_1y_pct, round(percentile_1y, 4) AS percentile_1y, observations FROM {_rank(63)}""",
    "last_five_bars": f"""WITH {BARS} SELECT * FROM (SELECT ticker, date, open, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) - 1 AS back FROM bars) WHERE back < 5""",
    "trailing_year": f"""WITH {OBARS} SELECT ticker, date, close FROM (SELECT *, max(date) OVER (PARTITION BY ticker) AS m FROM bars) WHERE date >= m - 365""",
    "bar_indicator_maps": f"""{L_IND} SELECT ticker, date, 11 AS entries, round(rsi_14, 4) AS rsi_14,
      (sma_50 IS NOT NULL)::INT + (sma_200 IS NOT NULL)::INT + (rsi_14 IS NOT NULL)::INT + (macd IS NOT NULL)::INT + 2 * (macd_signal IS NOT NULL)::INT + 4 * (bb_middle IS NOT NULL)::INT + (hv_30 IS NOT NULL)::INT AS present FROM ind""",
    "momentum": f"""{L_IND}, {VOTES} SELECT ticker, date AS as_of, label, score, concat_ws(',', v1, v2, v3, v4, v5) AS votes,
      concat_ws(',', CASE WHEN rsi_14 > 70 THEN 'overbought' END, CASE WHEN rsi_14 < 30 THEN 'oversold' END, CASE WHEN bb_pct_b > 1 THEN 'above_upper_band' END, CASE WHEN bb_pct_b < 0 THEN 'below_lower_band' END) AS flags,
      concat_ws(',', CASE WHEN close IS NULL OR sma_50 IS NULL THEN 'short_term_trend' END, CASE WHEN sma_200 IS NULL THEN 'long_term_regime' END, CASE WHEN macd_signal IS NULL THEN 'macd_crossover' END, CASE WHEN hist_yesterday IS NULL THEN 'macd_acceleration' END, CASE WHEN rsi_14 IS NULL THEN 'rsi_momentum' END) AS unavailable FROM scored""",
    "vote_reasons": f"""{O_IND}, {VOTES}, long AS (
        SELECT ticker, 'short_term_trend' AS name, v1 AS vote, 'close' AS ln, close AS l, 'sma_50' AS rn2, sma_50 AS r FROM v
        UNION ALL SELECT ticker, 'long_term_regime', v2, 'sma_50', sma_50, 'sma_200', sma_200 FROM v
        UNION ALL SELECT ticker, 'macd_crossover', v3, 'macd', macd, 'macd_signal', macd_signal FROM v
        UNION ALL SELECT ticker, 'macd_acceleration', v4, 'hist_today', macd_hist, 'hist_yesterday', hist_yesterday FROM v
        UNION ALL SELECT ticker, 'rsi_momentum', v5, 'rsi_14', rsi_14, 'midline', 50.0 FROM v)
      SELECT ticker, name, vote, CASE WHEN l IS NULL OR r IS NULL THEN 'unavailable: ' || ln || ' or ' || rn2 || ' has no value yet'
        WHEN l > r THEN ln || ' ' || printf('%.4g', l) || ' is above ' || rn2 || ' ' || printf('%.4g', r)
        WHEN l < r THEN ln || ' ' || printf('%.4g', l) || ' is below ' || rn2 || ' ' || printf('%.4g', r)
        ELSE ln || ' equals ' || rn2 || ' (' || printf('%.4g', l) || ')' END AS reason FROM long""",
    "company_fundamentals": f"WITH {SUPPLIER} SELECT ticker, company_name, currency, trailing_pe, trailing_eps FROM fund",
    "pe_fallback": f"""WITH {SUPPLIER}, p AS (SELECT *, CASE WHEN s_nationkey <> 11 THEN abs(s_acctbal) END AS current FROM fund)
      SELECT ticker, round(CASE WHEN trailing_pe > 0 THEN trailing_pe WHEN trailing_eps > 0 THEN current / trailing_eps END, 4) AS pe_ratio,
        CASE WHEN trailing_pe > 0 THEN NULL WHEN trailing_eps IS NULL THEN 'P/E unavailable: Yahoo returned neither trailingPE nor trailing EPS'
          WHEN trailing_eps <= 0 THEN 'P/E unavailable: trailing EPS is ' || trailing_eps || ', and a P/E on negative earnings is meaningless'
          WHEN current IS NULL THEN 'P/E unavailable: Yahoo returned no trailingPE and there is no current price'
          ELSE 'Yahoo returned no trailingPE, so P/E is computed as current price / trailing EPS' END AS warning FROM p""",
    "market_summary": f"""{L_IND}, {SUMMARY} SELECT ticker, company_name, currency, date AS as_of, round(current, 2) AS current_price, round(high_52w, 2) AS high_52w,
      round(low_52w, 2) AS low_52w, round(pe_ratio, 2) AS pe_ratio, round(ytd_return_pct, 2) AS ytd_return_pct, label, score,
      round(sma_50, 2) AS sma_50, round(macd_hist, 2) AS macd_hist, warnings FROM summ""",
    "trend_changes": f"""{L_IND}, {TREND} SELECT ticker, round(gap_now, 4) AS gap_now, round(gap_then, 4) AS gap_then, gap_change, rsi_direction, hist_direction FROM words""",
    "range_positions": f"""WITH {OBARS}, s AS (SELECT ticker, date, close, max(high) OVER w AS h, min(low) OVER w AS l FROM bars
      WINDOW w AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 364 DAY PRECEDING AND CURRENT ROW))
      SELECT ticker, date, CASE WHEN h > l THEN round((close - l) / (h - l) * 100, 4) END AS position FROM s""",
    "technical_fact_lines": f"""{L_IND}, {SUMMARY}, {TREND}, j AS (SELECT w.*, s.currency, s.high_52w, s.low_52w, s.ytd_return_pct FROM words w JOIN summ s USING (ticker)),
      r AS (SELECT *, round(high_52w, 2) AS hi, round(low_52w, 2) AS lo, round(ytd_return_pct, 2) AS ytd FROM j),
      l AS (SELECT ticker, [
        'Close: ' || printf('%.2f', close) || coalesce(' ' || currency, ''),
        'Close vs 50-day SMA (' || printf('%.2f', sma_50) || '): ' || printf('%+.1f%%', (close / sma_50 - 1) * 100),
        'Close vs 200-day SMA (' || printf('%.2f', sma_200) || '): ' || printf('%+.1f%%', (close / sma_200 - 1) * 100),
        '50-day SMA vs 200-day SMA: ' || printf('%+.1f%% now, %+.1f%% 10 trading days ago (%s)', gap_now, gap_then, gap_change),
        'RSI-14: ' || printf('%.1f now, %.1f 5 trading days ago (%s); overbought above 70, oversold below 30', rsi_now, rsi_then, rsi_direction),
        'MACD: ' || printf('%.2f, signal line %.2f (MACD %s the signal line); histogram %.2f now, %.2f the day before (%s)', macd, macd_signal,
          CASE WHEN macd > macd_signal THEN 'above' WHEN macd < macd_signal THEN 'below' ELSE 'level with' END, hist_now, hist_before, hist_direction),
        'Bollinger %B: ' || printf('%.2f', bb_pct_b) || ' (0 is the lower band, 1 the upper band; outside 0 to 1 is outside the bands)',
        '52-week range: ' || printf('low %.2f, high %.2f; close at %.0f%% of the range', lo, hi, (close - lo) / (hi - lo) * 100),
        '30-day annualised volatility: ' || printf('%.1f%%', hv_30 * 100),
        'Year-to-date return: ' || printf('%+.1f%%', ytd)] AS lines FROM r)
      SELECT ticker, unnest(range(10))::INT AS line_no, unnest(lines) AS line FROM l""",
    "expected_moves": f"{L_IND} SELECT ticker, date, round(close * hv_30 * sqrt(63.0 / 252), 2) AS expected_move FROM ind WHERE hv_30 IS NOT NULL",
    "horizon_volatility": f'{L_IND}, {HEDGE} SELECT ticker, "window", call_no, round(current_pct, 4) AS current_pct FROM best',
    "price_snapshots": f"{L_IND}, {SNAP} SELECT * FROM snap",
    "price_digests": f"""{L_IND}, {STATS} SELECT s.ticker, s.as_of, round(s.close, 2) AS close, round(period_high, 2) AS period_high, round(rsi_14, 2) AS rsi_14, 5 AS bars_shown,
      f.date AS first_shown, CAST(l.volume AS BIGINT) AS last_volume FROM stats s JOIN latest l ON l.ticker = s.ticker AND l.back = 0
      JOIN (SELECT ticker, date FROM latest WHERE back = 4) f ON f.ticker = s.ticker""",
    "hedge_candidates": f"""{L_IND}, {HEDGE}, c AS (
        SELECT *, 'one_sd_low' AS name, close - move AS lv, 'price minus one expected move: the bottom of the likely 90-day range' AS meaning FROM hedge
        UNION ALL SELECT *, 'one_sd_high', close + move, 'price plus one expected move: the top of the likely 90-day range' FROM hedge
        UNION ALL SELECT *, 'sma_200', sma_200, 'the 200-day moving average, the long-term trend line' FROM hedge
        UNION ALL SELECT *, 'bb_lower', bb_lower, 'the lower Bollinger Band, two standard deviations below the 20-day average' FROM hedge
        UNION ALL SELECT *, 'low_52w', low_52w, 'the lowest price of the past 52 weeks' FROM hedge)
      SELECT ticker, close AS price, round(current_pct, 2) AS volatility_pct, 'calculate_volatility, ' || "window" || '-day' AS volatility_source,
        round(move, 2) AS expected_move, round(move / close * 100, 2) AS expected_move_pct, name, round(lv, 2) AS level,
        round((lv / close - 1) * 100, 2) AS pct_from_price, meaning FROM c WHERE lv IS NOT NULL""",
    "hedge_legs_priced": f"""{L_IND}, {SNAP}, h AS (SELECT s.*, s.close * r.current_pct / 100 * sqrt(63.0 / 252) AS move FROM snap s JOIN {_rank(63)} r USING (ticker)),
      legs AS (SELECT DISTINCT l_returnflag AS ticker, l_linenumber AS leg_no, CASE WHEN l_linenumber < 4 THEN 'buy' ELSE 'sell' END AS action, 'put' AS instrument,
        (['one_sd_low', 'sma_200', 'bb_lower', 'low_52w', 'unknown_level', NULL, 'one_sd_high'])[l_linenumber] AS level_name FROM lineitem)
      SELECT l.ticker, leg_no, action, instrument, level_name,
        round(CASE level_name WHEN 'one_sd_low' THEN close - move WHEN 'one_sd_high' THEN close + move WHEN 'sma_200' THEN sma_200 WHEN 'bb_lower' THEN bb_lower WHEN 'low_52w' THEN low_52w END, 2) AS level,
        CASE WHEN level_name = 'unknown_level' THEN 'hedge leg ''' || action || ' put'' names an unknown level ''unknown_level'', so it has no price' END AS warning
      FROM legs l JOIN h USING (ticker)""",
}
