"""From bars, fundamentals, headlines and labels to one Markdown brief per ticker, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.operators import facts, reports, sentiment as S
from ledgerloom.operators.summary import market_summary


def market_brief(
    priced: DataFrame, fundamentals: DataFrame, headlines: DataFrame, primary: DataFrame, secondary: DataFrame,
    key: list[str], answers: DataFrame, today: Column, generated_at: Column,
) -> DataFrame:
    """(ticker, markdown). ``priced`` are cleaned daily bars with indicators; all tickers are computed at once.

    It is read twice, so pass a stored table.
    """
    summary = market_summary(priced, fundamentals, today)
    scored = S.score_headlines(headlines, primary, secondary, key)
    mood = S.summarise(scored, ["ticker"])
    sections = reports.sentiment_section(mood, S.strongest(scored, ["ticker"], "ord"), fundamentals)
    recommendations = reports.with_placeholder(fundamentals, answers)
    notes = S.quality_warnings(mood.join(recommendations.select("ticker", "ok"), "ticker"), F.col("ok"))
    extra = notes.select("ticker", F.col("warnings").alias("news_warnings"))
    noted = summary.join(extra, "ticker", "left").withColumn(
        "warnings", F.concat("warnings", F.coalesce("news_warnings", F.array().cast("array<string>")))
    ).drop("news_warnings")
    lines = facts.technical_facts(priced, summary)
    return reports.market_briefs(noted, lines, sections, recommendations, mood, generated_at)
