"""Headline labels: checked decisions, fallback between scorers, scores, summaries, strongest headlines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.fixed_values import (
    MAX_LABELLED_HEADLINES,
    NOT_LABELLED_REASON,
    NOT_SCORED_REASON,
    PROBABILITY_SUM_TOLERANCE,
    REASON_UNAVAILABLE,
    SENTIMENT_THRESHOLD,
    SENTIMENTS,
    TOP_HEADLINES,
)
from ledgerloom.functions.numbers import finite
from ledgerloom.functions.texts import printf


def decision_problem(choice: Column, probabilities: Column, options: list[str] = SENTIMENTS) -> Column:
    """Why a decision does not fit its question, or NULL when it does."""
    listed = F.array(*[F.lit(o) for o in options])
    shown = "[" + ", ".join(f"'{o}'" for o in options) + "]"
    missing = F.filter(listed, lambda o: ~F.map_contains_key(probabilities, o))
    total = F.aggregate(listed, F.lit(0.0), lambda s, o: s + F.element_at(probabilities, o))
    return (
        F.when(choice.isNull(), "no answer")
        .when(~F.array_contains(listed, choice), F.concat(F.lit("choice '"), choice, F.lit(f"' is not one of the options {shown}")))
        .when(
            F.size(missing) > 0,
            F.concat(F.lit("missing probabilities for ['"), F.array_join(missing, "', '"), F.lit("']")),
        )
        .when(
            # one part in 1e9 of slack, so a sum of exactly 0.98 or 1.02 passes
            F.abs(total - 1.0) > PROBABILITY_SUM_TOLERANCE + 1e-9,
            printf("probabilities sum to %.2f, not 1", total),
        )
    )


def check_decisions(decisions: DataFrame) -> DataFrame:
    """Decisions with ``problem``; rows where it is NULL are usable."""
    return decisions.withColumn("problem", decision_problem(F.col("choice"), F.col("probabilities")))


def label_sign(label: Column) -> Column:
    return F.when(label == "positive", 1).when(label == "negative", -1).when(label == "neutral", 0)


def score_headlines(
    headlines: DataFrame, primary: DataFrame, secondary: DataFrame, key: list[str], reasons: DataFrame | None = None
) -> DataFrame:
    """Each headline with the primary scorer's decision, else the secondary's label, else none.

    ``primary`` holds (key, choice, confidence, probabilities) and ``secondary`` (key,
    sentiment, confidence, reason), each at most one row per key. ``reasons`` may hold (key,
    reason) for the primary scorer's decisions; without one, a fixed text stands in.
    """
    good = check_decisions(primary).where(F.col("problem").isNull()).select(
        *key, F.col("choice").alias("p_choice"), F.col("confidence").alias("p_conf"), "probabilities"
    )
    other = secondary.select(
        *key, F.col("sentiment").alias("s_choice"), F.col("confidence").alias("s_conf"), F.col("reason").alias("s_reason")
    )
    joined = headlines.join(good, key, "left").join(other, key, "left")
    if reasons is None:
        joined = joined.withColumn("p_reason", F.lit(None).cast("string"))
    else:
        joined = joined.join(reasons.select(*key, F.col("reason").alias("p_reason")), key, "left")
    by_primary, by_secondary = F.col("p_choice").isNotNull(), F.col("s_choice").isNotNull()
    spread = F.round(F.col("probabilities")["positive"] - F.col("probabilities")["negative"], 4)
    return joined.select(
        *headlines.columns,
        F.coalesce("p_choice", "s_choice", F.lit("neutral")).alias("sentiment"),
        F.coalesce("p_conf", "s_conf", F.lit(0.0)).alias("confidence"),
        F.when(by_primary, F.coalesce("p_reason", F.lit(REASON_UNAVAILABLE))).when(by_secondary, F.col("s_reason"))
        .otherwise(F.lit(NOT_SCORED_REASON)).alias("brief_reason"),
        F.when(by_primary, F.col("probabilities")).alias("probabilities"),
        F.when(by_primary, "primary").when(by_secondary, "secondary").otherwise("none").alias("scored_by"),
        F.when(by_primary, spread).when(by_secondary, label_sign(F.col("s_choice")) * F.col("s_conf")).alias("score"),
    )


def score_label(score: Column) -> Column:
    return F.when(score > SENTIMENT_THRESHOLD, "positive").when(score < -SENTIMENT_THRESHOLD, "negative").when(
        score.isNotNull(), "neutral"
    )


def summarise(scored: DataFrame, by: list[str]) -> DataFrame:
    """Per key: mean score, label, counts by scorer, failed count, counts per label including zeros."""
    has = F.col("score").isNotNull()
    sums = scored.groupBy(*by).agg(
        F.round(F.avg("score"), 4).alias("score"),
        F.count("score").alias("scored"),
        F.count_if(F.col("scored_by") == "primary").alias("by_primary"),
        F.count_if(F.col("scored_by") == "secondary").alias("by_secondary"),
        F.count_if(~has).alias("failed"),
        *[F.count_if(has & (F.col("sentiment") == s)).alias(f"_{s}") for s in SENTIMENTS],
    )
    entries = []
    for s in SENTIMENTS:
        entries += [F.lit(s), F.col(f"_{s}")]
    return sums.select(
        *by, "score", score_label(F.col("score")).alias("label"), "scored", "by_primary", "by_secondary", "failed",
        F.create_map(*entries).alias("counts"),
    )


def quality_warnings(summary: DataFrame, has_recommendation: Column) -> DataFrame:
    """Ordered messages per key: nothing scored, labels by the secondary scorer, unscored headlines, placeholder."""
    c = F.col
    messages = F.array_compact(
        F.array(
            F.when(c("score").isNull(), "no headline could be scored, so there is no Sentiment score"),
            F.when(
                c("by_secondary") > 0,
                F.format_string("the primary scorer was unavailable for %d headlines, so the secondary labelled them", "by_secondary"),
            ),
            F.when(c("failed") > 0, F.format_string("%d headlines could not be scored and are left out of the Sentiment score", "failed")),
            F.when(~has_recommendation, "the Recommendation is a placeholder Hold: no LLM provider answered"),
        )
    )
    return summary.withColumn("warnings", messages)


def strongest(scored: DataFrame, by: list[str], order: str, n: int = TOP_HEADLINES) -> DataFrame:
    """The ``n`` headlines per key with the largest absolute score; ties keep ``order``."""
    rank = Window.partitionBy(*by).orderBy(F.abs("score").desc(), order)
    with_score = scored.where(F.col("score").isNotNull())
    return with_score.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)


def labelled_input(headlines: DataFrame, n: int = MAX_LABELLED_HEADLINES) -> DataFrame:
    """Batches (batch, pos, title): trimmed, blanks dropped, in parts of ``n`` numbered ``part`` from 0, with ``index`` from 1 in each.

    A scorer takes at most ``n`` titles at a time; every title is in one part.
    """
    kept = headlines.withColumn("title", F.trim("title")).where("title <> ''")
    order = Window.partitionBy("batch").orderBy("pos")
    nth = kept.withColumn("_nth", F.row_number().over(order) - 1)
    return nth.withColumns({"part": F.floor(F.col("_nth") / n).cast("int"), "index": (F.col("_nth") % n + 1).cast("int")}).drop("_nth")


def overfull_batches(headlines: DataFrame, n: int = MAX_LABELLED_HEADLINES) -> DataFrame:
    """(batch, given, warning) for batches that are labelled in several parts of ``n``."""
    given = headlines.where(F.trim("title") != "").groupBy("batch").agg(F.count(F.lit(1)).alias("given"))
    text = F.format_string(f"%d headlines given; they are labelled {n} at a time", "given")
    return given.where(F.col("given") > n).withColumn("warning", text)


def apply_labels(batches: DataFrame, labels: DataFrame) -> DataFrame:
    """Batch labels by index: the first label for an index wins, an unlabelled headline has no score.

    ``labels`` holds (batch, part, index, arrival, sentiment, confidence, reason).
    """
    place = ["batch", "part", "index"]
    first = labels.groupBy(*place).agg(
        F.min_by("sentiment", "arrival").alias("l_sentiment"),
        F.min_by("confidence", "arrival").alias("l_confidence"),
        F.min_by("reason", "arrival").alias("l_reason"),
    )
    found = F.col("l_sentiment").isNotNull()
    score = F.round(label_sign(F.col("l_sentiment")) * F.col("l_confidence"), 4)
    return batches.join(first, place, "left").select(
        *batches.columns,
        F.coalesce("l_sentiment", F.lit("neutral")).alias("sentiment"),
        F.coalesce("l_confidence", F.lit(0.0)).alias("confidence"),
        F.when(found, F.col("l_reason")).otherwise(NOT_LABELLED_REASON).alias("brief_reason"),
        F.when(found, "secondary").otherwise("none").alias("scored_by"),
        finite(score).alias("score"),
    )


def paired_with_sources(scored: DataFrame, headlines: DataFrame) -> DataFrame:
    """Labels beside the publisher and date of the headline at the same position of the same ticker."""
    sources = headlines.select("ticker", "ord", "publisher", "published")
    return scored.join(sources, ["ticker", "ord"], "left")


def run_scorer(headlines: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Label headlines with a caller's model, one Arrow batch at a time on the executors."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield scorer(frame)

    return headlines.mapInPandas(batches, schema)
