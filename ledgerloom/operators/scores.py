"""Evaluation tables: ROUGE-L, score and label tables, losses, descriptions and histograms."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ledgerloom.fixed_values import CHECK_LABELS, REVIEW_COUNT, SPLIT_SEED
from ledgerloom.functions.stems import stems
from ledgerloom.functions.texts import unwrapped
from ledgerloom.operators.ordered import exact_quantiles


def rouge_tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))


def common_subsequence(left: list[str], right: list[str]) -> int:
    """Length of the longest common subsequence, one machine-word-parallel row per token of ``right``."""
    where: dict[str, int] = {}
    for i, token in enumerate(left):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(left)) - 1
    row = full
    for token in right:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(left) - row.bit_count()


@F.arrow_udf(T.IntegerType())
def _subsequence_lengths(left: pa.Array, right: pa.Array) -> pa.Array:
    """Tokens come joined by spaces and are cut apart a row at a time: as lists, those of a whole batch take several times as much memory."""
    pairs = zip(left, right, strict=True)
    return pa.array([common_subsequence((a.as_py() or "").split(), (b.as_py() or "").split()) for a, b in pairs], pa.int32())


def with_rouge_l(pairs: DataFrame, prediction: str, reference: str, name: str = "rouge_l", stemmed: bool = True) -> DataFrame:
    """Add the ROUGE-L F1 of each unwrapped prediction against its reference.

    Words of more than three characters are compared by their Porter stems, or, not ``stemmed``, as written.
    """
    form = stems if stemmed else (lambda tokens: tokens)
    tokens = pairs.withColumns(
        {"_p": form(rouge_tokens(unwrapped(F.col(prediction)))), "_r": form(rouge_tokens(F.col(reference)))}
    )
    shared = _subsequence_lengths(F.array_join("_r", " "), F.array_join("_p", " "))
    f1 = F.coalesce(F.try_divide(2.0 * shared, F.size("_p") + F.size("_r")), F.lit(0.0))
    return tokens.withColumn(name, f1).drop("_p", "_r")


def long_scores(wide: DataFrame, models: dict[str, str], keys: list[str]) -> DataFrame:
    """(keys, model, score) from one score column per model."""
    pieces = ", ".join(f"'{model}', `{column}`" for model, column in models.items())
    return wide.selectExpr(*keys, f"stack({len(models)}, {pieces}) as (model, score)")


def score_table(scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median and minimum per group; the median is exact for groups of any size."""
    plain = scores.groupBy(*by).agg(F.avg("score").alias("mean"), F.min("score").alias("min"))
    middle = exact_quantiles(scores, by, "score", [0.5]).select(*by, F.col("value").alias("median"))
    return plain.join(middle, by)


def label_table(labels: DataFrame, by: list[str]) -> DataFrame:
    """Counts per label with zeros, one column per label, and the share that is hallucinated."""
    counts = [F.count_if(F.col("label") == name).alias(name) for name in CHECK_LABELS]
    share = F.avg((F.col("label") == CHECK_LABELS[2]).cast("int")).alias("share_hallucinated")
    return labels.groupBy(*by).agg(*counts, share)


def common_errors(checked: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most common (first word, missing or invented) error types."""
    kinds = F.explode(
        F.concat(
            F.transform("missing", lambda m: F.concat(F.split(m, " ")[0], F.lit(" missing"))),
            F.transform("invented", lambda m: F.concat(F.split(m, " ")[0], F.lit(" invented"))),
        )
    )
    return (
        checked.select(kinds.alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("uses"))
        .orderBy(F.col("uses").desc(), "error").limit(n)
    )


def hallucination_rate(reviewed: DataFrame) -> DataFrame:
    wrong = (F.col("label") == CHECK_LABELS[2]).cast("int")
    return reviewed.agg(F.count(F.lit(1)).alias("reviewed"), F.sum(wrong).alias("hallucinated"), F.avg(wrong).alias("rate"))


def review_sample(df: DataFrame, key: str = "id", n: int = REVIEW_COUNT, seed: int = SPLIT_SEED) -> DataFrame:
    """``n`` rows in a random but repeatable order: the smallest digests of seed and key."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("_digest", digest).orderBy("_digest", key).limit(n).drop("_digest")


def label_agreement(review: DataFrame, checker: DataFrame) -> DataFrame:
    """Reviewed rows beside the checker's label."""
    return review.join(checker.select("id", F.col("label").alias("checker")), "id").withColumn(
        "agree", F.col("label") == F.col("checker")
    )


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, count, mean, std, min, p25, p50, p75, max) with exact, interpolated quartiles.

    Each column is reduced to value counts first, so a column with few distinct
    values shuffles few rows whatever its length.
    """
    pieces = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {pieces}) as (column, value)").where("value is not null")
    plain = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    parts = exact_quantiles(long.withColumnRenamed("value", "_x"), ["column"], "_x", [0.25, 0.5, 0.75])
    wide = parts.groupBy("column").agg(
        *[F.max(F.when(F.col("fraction") == q, F.col("value"))).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
    )
    return plain.join(wide, "column")


def histogram(df: DataFrame, column: str, by: list[str], bins: int = 20) -> DataFrame:
    """Rows per group and equal-width bin of the group's own range; the last bin holds the maximum."""
    span = df.groupBy(*by).agg(F.min(column).alias("low"), F.max(column).alias("high"))
    counted = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_rows"))
    at = F.floor(F.try_divide((F.col(column) - F.col("low")) * bins, F.col("high") - F.col("low")))
    binned = counted.join(span, by).withColumn("bin", F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)))
    return binned.groupBy(*by, "bin").agg(F.sum("_rows").alias("rows"))


def crosstab_with_margins(df: DataFrame, left: str, right: str) -> DataFrame:
    """Counts by both columns with 'All' margins, as rows."""
    named = lambda c: F.when(F.grouping(c) == 1, "All").otherwise(F.col(c)).alias(c)
    return df.cube(left, right).agg(
        F.count(F.lit(1)).alias("rows"), named(left).alias("_l"), named(right).alias("_r")
    ).select(F.col("_l").alias(left), F.col("_r").alias(right), "rows")


def epoch_losses(log: DataFrame) -> DataFrame:
    """Per run and epoch with a validation loss: the last training and validation loss logged for it."""
    epoch = F.bround("epoch", 0).cast("int")
    one = lambda name: F.max_by(name, F.when(F.col(name).isNotNull(), F.col("step")))
    per = log.groupBy("run", epoch.alias("epoch")).agg(one("loss").alias("train_loss"), one("eval_loss").alias("val_loss"))
    return per.where(F.col("val_loss").isNotNull())


def loss_check(losses: DataFrame) -> DataFrame:
    """Per run: does the validation loss fall every epoch, and which epoch is best. Epochs per run are few."""
    before = F.lag("val_loss").over(Window.partitionBy("run").orderBy("epoch"))
    return losses.withColumn("_before", before).groupBy("run").agg(
        F.coalesce(F.bool_and(F.col("val_loss") < F.col("_before")), F.lit(True)).alias("falls_every_epoch"),
        F.min_by("epoch", "val_loss").alias("best_epoch"),
        F.min("val_loss").alias("best_loss"),
    )


def answer_share(lengths: DataFrame, answer: str, total: str, limit: int) -> DataFrame:
    """One row: answer tokens, all tokens, their share, the longest example and whether it fits."""
    return lengths.agg(
        F.sum(answer).alias("answer_tokens"),
        F.sum(total).alias("all_tokens"),
        (F.sum(answer) / F.sum(total)).alias("share"),
        F.max(total).alias("longest"),
        (F.max(total) <= limit).alias("fits"),
    )


def split_sizes(records: DataFrame) -> DataFrame:
    return records.groupBy("split").agg(F.count(F.lit(1)).alias("examples"))


def prediction_export(predictions: DataFrame, scores: DataFrame, checks: DataFrame) -> DataFrame:
    """One wide row per id: code, reference, answers, scores and checks.

    All sides have a row an id, so none is broadcast: a small file of texts that compress well is large in memory.
    """
    return predictions.join(scores.hint("merge"), "id").join(checks.hint("merge"), "id")
