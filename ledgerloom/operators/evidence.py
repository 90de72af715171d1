"""Observations of a run: usable results, gaps, hints, checked evidence.

An observation table has run_id, seq, tool, args, status, digest, data, error,
warnings. Tools are a small fixed vocabulary; runs may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.fixed_values import NO_ALTERNATIVE, TOOL_ADVICE, TOOL_ALTERNATIVES, TOOLS
from ledgerloom.operators.ordered import BLOCK, with_position


def latest_ok(observations: DataFrame) -> DataFrame:
    """Per run and tool: the last observation that is ok and carries data."""
    good = observations.where((F.col("status") == "ok") & F.col("data").isNotNull())
    return good.groupBy("run_id", "tool").agg(F.max("seq").alias("seq"), F.max_by("data", "seq").alias("data"))


def ok_tools(observations: DataFrame) -> DataFrame:
    """Per run: its tools with at least one ok result, in first-call order."""
    first = observations.where("status = 'ok'").groupBy("run_id", "tool").agg(F.min("seq").alias("seq"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "tool")))
    return first.groupBy("run_id").agg(F.transform(ordered, lambda s: s["tool"]).alias("tools"))


def problem_text(error: Column, warnings: Column) -> Column:
    joined = F.nullif(F.array_join(warnings, "; "), F.lit(""))
    return F.coalesce(F.nullif(error, F.lit("")), joined, F.lit("no detail"))


def data_gaps(observations: DataFrame, runs: DataFrame, tools: list[str] = TOOLS) -> DataFrame:
    """(run_id, tool, gap) for every available tool that was never called or never succeeded."""
    offered = runs.select("run_id").distinct().withColumn(
        "t", F.explode(F.array(*[F.struct(F.lit(i).alias("tool_no"), F.lit(t).alias("tool")) for i, t in enumerate(tools)]))
    ).select("run_id", "t.*")
    calls = observations.groupBy("run_id", "tool").agg(
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.max_by("status", "seq").alias("last_status"),
        F.max_by(problem_text(F.col("error"), F.col("warnings")), "seq").alias("last_problem"),
    )
    unused = F.format_string("%s was not called", "tool")
    failed = F.format_string("%s returned no usable result (%s: %s)", "tool", "last_status", "last_problem")
    return (
        offered.join(calls, ["run_id", "tool"], "left")
        .where(F.coalesce("ok", F.lit(0)) == 0)
        .select("run_id", "tool_no", "tool", F.when(F.col("ok").isNull(), unused).otherwise(failed).alias("gap"))
    )


def alternatives(spark: SparkSession) -> DataFrame:
    """The fixed table of what to try when a tool fails: six rows."""
    return spark.createDataFrame(TOOL_ALTERNATIVES, "tool string, rank int, other string, how string")


def failure_hints(failures: DataFrame) -> DataFrame:
    """Failures (run_id, seq, tool, ticker, available ARRAY) with advice and the alternatives the agent has.

    The alternatives are six fixed rows, so they travel inside the expression instead
    of a join.
    """
    ticker = F.upper(F.trim(F.coalesce(F.nullif(F.col("ticker"), F.lit("")), F.lit("the ticker"))))

    def filled(template: str) -> Column:
        return F.replace(F.lit(template), F.lit("{ticker}"), ticker)

    advice, options = F.lit(""), F.array().cast("array<string>")
    for tool in TOOLS:
        mine = [
            F.when(F.array_contains("available", other), F.concat(F.lit(f"{other}: "), filled(how)))
            for name, _, other, how in TOOL_ALTERNATIVES
            if name == tool
        ]
        advice = F.when(F.col("tool") == tool, filled(TOOL_ADVICE[tool])).otherwise(advice)
        options = F.when(F.col("tool") == tool, F.array_compact(F.array(*mine))).otherwise(options)
    listed = F.concat(F.lit("Alternatives: "), F.array_join(options, "; "), F.lit("."))
    second = F.when(F.size(options) > 0, listed).otherwise(F.lit(NO_ALTERNATIVE))
    hint = F.concat_ws(" ", F.nullif(advice, F.lit("")), second)
    return failures.select("run_id", "seq", "tool", hint.alias("hint"))


def supported_evidence(evidence: DataFrame, observations: DataFrame) -> DataFrame:
    """Evidence rows whose source tool was ok in their run."""
    ok = observations.where("status = 'ok'").select("run_id", F.col("tool").alias("source_tool")).distinct()
    return evidence.join(ok, ["run_id", "source_tool"], "left_semi")


def dropped_evidence(evidence: DataFrame, observations: DataFrame) -> DataFrame:
    """The other evidence rows, each with the warning it becomes."""
    ok = observations.where("status = 'ok'").select("run_id", F.col("tool").alias("source_tool")).distinct()
    text = F.format_string(
        "dropped evidence for '%s' citing %s, which returned no usable result: '%s'", "risk", "source_tool", "fact"
    )
    return evidence.join(ok, ["run_id", "source_tool"], "left_anti").withColumn("warning", text)


def unsupported_risks(evidence: DataFrame, observations: DataFrame) -> DataFrame:
    """Risks left without any evidence, with their warning."""
    kept = supported_evidence(evidence, observations).select("run_id", "risk").distinct()
    text = F.format_string("risk '%s' has no supporting evidence left", "risk")
    return evidence.select("run_id", "risk").distinct().join(kept, ["run_id", "risk"], "left_anti").withColumn("warning", text)


def numbered_observations(observations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(run_id, call, line): each call's number, arguments and the fields of its digest as one JSON line.

    ``args`` and ``digest`` are JSON texts; a digest that is no object is replaced by tool and
    status, arguments that are no JSON stay a text.
    """
    numbered = with_position(observations, ["run_id"], "call", block=block)
    digest = F.trim("digest")
    fields = F.when(digest.rlike(r"^\{[\s\S]*\}$") & F.try_parse_json(digest).isNotNull(), digest).otherwise(F.to_json(F.struct("tool", "status")))
    inner = F.trim(F.expr("substring(_fields, 2, length(_fields) - 2)"))
    args = F.when(F.col("args").isNull(), "null").when(F.try_parse_json("args").isNotNull(), F.col("args")).otherwise(F.expr("substring(to_json(struct(args)), 9, length(to_json(struct(args))) - 9)"))
    line = F.concat(F.lit('{"call":'), F.col("call").cast("string"), F.lit(',"args":'), args, F.when(inner != "", F.concat(F.lit(","), inner)).otherwise(""), F.lit("}"))
    return numbered.withColumn("_fields", fields).select("run_id", "call", line.alias("line"))


def tool_result(df: DataFrame) -> DataFrame:
    """The envelope as one JSON text, empty fields left out.

    ``data`` is JSON text of any shape; it is embedded as parsed JSON through VARIANT.
    """
    fields = F.struct(
        "tool", "status", F.try_parse_json("data").alias("data"), F.nullif("error", F.lit("")).alias("error"),
        F.when(F.size("warnings") > 0, F.col("warnings")).alias("warnings"),
    )
    return df.select("run_id", "seq", F.to_json(fields).alias("result"))
