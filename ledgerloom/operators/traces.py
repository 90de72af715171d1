"""Run traces: run tables, summaries, timelines, messages, steps, tool statistics and replan cycles.

A trace table has one row per event: ts, run_id, seq (unique write order), event,
and the per-event columns of :data:`ledgerloom.schemas.TRACE_SCHEMA`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.fixed_values import (
    AGENT_LANES,
    INJECTED_FAILURE,
    MESSAGES_ROW,
    MESSAGE_SHORT_NAMES,
    TRACE_OUTPUT_CHARS,
)
from ledgerloom.functions.numbers import rounded_scaled
from ledgerloom.operators.ordered import BLOCK, with_position, with_running_sum


def is_event(*kinds: str) -> Column:
    return F.col("event").isin(*kinds)


def tool_calls(trace: DataFrame) -> DataFrame:
    return trace.where(is_event("tool_call"))


def _not_ok() -> Column:
    return F.coalesce(F.col("status"), F.lit("")) != "ok"


def tool_stats(trace: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per tool (and ``by``, such as run_id): calls, ok calls, mean and longest duration, cache hits.

    Within ``by``, durations are added in the order of ``seq``, as a reader of the trace adds them: a mean near a
    half is then rounded the same way however the rows are dealt. All calls of a tool are added in any order.
    """
    calls, keys = tool_calls(trace), [*(by or []), "tool"]
    mean = F.avg("duration_ms")
    if by:
        upto = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        calls = calls.withColumn("_sum", F.sum("duration_ms").over(upto))
        mean = F.try_divide(F.max_by("_sum", "seq"), F.count("duration_ms"))
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        rounded_scaled(mean, 1).alias("mean_ms"),
        rounded_scaled(F.max("duration_ms"), 1).alias("max_ms"),
        F.count_if(F.col("cache_hit")).alias("cache_hits"),
    )


def run_summary(trace: DataFrame) -> DataFrame:
    """The headline numbers of every run in one conditional aggregation."""
    call, turn = is_event("tool_call"), is_event("agent_turn")
    hit = (call & F.col("cache_hit")) | (is_event("cache") & (F.col("action") == "hit"))
    return trace.groupBy("run_id").agg(
        F.count_if(call).alias("tool_calls"),
        F.count_if(call & _not_ok()).alias("problems"),
        F.round(F.coalesce(F.sum(F.when(call, F.col("duration_ms"))), F.lit(0.0)) / 1000.0, 1).alias("tool_seconds"),
        F.count_if(turn).alias("model_turns"),
        F.coalesce(F.sum(F.when(turn, F.col("tokens"))), F.lit(0)).alias("tokens"),
        F.count_if(hit).alias("cache_hits"),
    )


def _run_facts(trace: DataFrame) -> DataFrame:
    """What the label, the ticker and the start of a run are read from: one row per run.

    Every buffer is a primitive or a set of tool names, so runs of any size combine
    map-side.
    """
    call = is_event("tool_call")
    ticker = F.nullif(F.get_json_object("args", "$.ticker"), F.lit(""))
    named = F.when(call & ticker.isNotNull(), F.col("seq"))
    cached = F.when(is_event("cache") & (F.coalesce("path", F.lit("")) != ""), F.col("seq"))
    failing = F.when(call & F.contains("output", F.lit(INJECTED_FAILURE)), F.col("tool"))
    return trace.groupBy("run_id").agg(
        F.min("seq").alias("first_seq"),
        F.min_by("ts", "seq").alias("started"),
        F.count_if(call).alias("tool_calls"),
        F.count_if(call & _not_ok()).alias("problems"),
        F.count_if(is_event("handoff")).alias("handoffs"),
        F.count_if(~is_event("cache")).alias("not_cache"),
        F.count_if(is_event("cache") & (F.col("action") == "hit")).alias("hits"),
        F.count_if(is_event("agent_turn") | (call & (F.col("agent") == "single"))).alias("agent_events"),
        F.min_by(F.upper(ticker), named).alias("called_ticker"),
        F.min_by("path", cached).alias("cache_path"),
        F.array_sort(F.collect_set(failing)).alias("failing"),
    )


def run_label() -> Column:
    c = F.col
    base = (
        F.when(c("handoffs") > 0, "3B pipeline")
        .when((c("not_cache") == 0) & (c("hits") > 0), "3B cache hit")
        .when(c("not_cache") == 0, "3B cache lookup")
        .when(c("agent_events") > 0, "3A research agent")
        .otherwise("Direct tool calls")
    )
    suffix = F.concat(F.lit(" ("), F.array_join("failing", ", "), F.lit(" failing)"))
    return F.concat(base, F.when(F.size("failing") > 0, suffix).otherwise(F.lit("")))


def run_ticker() -> Column:
    """The first ticker argument, else the leading part of the cache file's name."""
    file = F.substring_index("cache_path", "/", -1)
    return F.coalesce(F.col("called_ticker"), F.substring_index(file, "_", 1))


def runs_table(trace: DataFrame) -> DataFrame:
    """One row per run; sort by ``first_seq`` for first-appearance order."""
    return _run_facts(trace).select(
        "run_id", "first_seq", run_label().alias("label"), run_ticker().alias("ticker"),
        "started", "tool_calls", "problems",
    )


def run_labels(trace: DataFrame) -> DataFrame:
    return _run_facts(trace).select("run_id", run_label().alias("label"))


def run_tickers(trace: DataFrame) -> DataFrame:
    return _run_facts(trace).select("run_id", run_ticker().alias("ticker"))


def timeline(trace: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per tool call with its number in the run, start and end."""
    numbered = with_position(tool_calls(trace), ["run_id"], "call", block=block)
    micros = F.round(F.col("duration_ms") * 1000).cast("bigint")
    return numbered.select(
        "run_id", "call", "agent", "tool",
        F.concat_ws(" · ", "agent", "tool").alias("row"),
        "status",
        F.timestamp_micros(F.unix_micros("ts") - micros).alias("start"),
        F.col("ts").alias("end"),
        "duration_ms",
        F.coalesce("why", F.lit("")).alias("why"),
    )


def _message_name() -> Column:
    handoff = F.coalesce("schema", F.lit("handoff"))
    return F.when(is_event("handoff"), handoff).when(
        F.col("step") == "request", "ClarificationRequest"
    ).otherwise("ClarificationResponse")


def messages(trace: DataFrame) -> DataFrame:
    """Messages between agents, with a long and a short name."""
    sent = trace.where(is_event("handoff", "critique")).withColumn("name", _message_name())
    short = F.col("name")
    for long, brief in MESSAGE_SHORT_NAMES.items():
        short = F.when(F.col("name") == long, brief).otherwise(short)
    return sent.select(
        "run_id", "seq",
        F.col("ts").alias("at"),
        F.col("sender").alias("agent"),
        F.lit(MESSAGES_ROW).alias("row"),
        F.format_string("%s -> %s: %s", "sender", "receiver", "name").alias("message"),
        F.format_string("%s->%s %s", F.col("sender"), F.col("receiver"), short).alias("short"),
    )


def lane_rank(agent: Column) -> Column:
    """Known agents first in their fixed order; all others share the last rank and sort by name."""
    rank = F.lit(len(AGENT_LANES))
    for i, name in enumerate(AGENT_LANES):
        rank = F.when(agent == name, i).otherwise(rank)
    return rank


def row_order(trace: DataFrame) -> DataFrame:
    """(run_id, row, lane, agent, first_seq): sort by the last three for the drawing order.

    One row per (run, agent, tool), and one for the messages of a run.
    """
    calls = (
        tool_calls(trace)
        .groupBy("run_id", "agent", "tool")
        .agg(F.min("seq").alias("first_seq"))
        .select(
            "run_id", F.concat_ws(" · ", "agent", "tool").alias("row"),
            lane_rank(F.col("agent")).alias("lane"), "agent", "first_seq",
        )
    )
    notes = (
        trace.where(is_event("handoff", "critique"))
        .groupBy("run_id")
        .agg(F.min("seq").alias("first_seq"))
        .select(
            "run_id", F.lit(MESSAGES_ROW).alias("row"),
            F.lit(len(AGENT_LANES) + 1).alias("lane"), F.lit("").alias("agent"), "first_seq",
        )
    )
    return calls.unionByName(notes)


def steps(trace: DataFrame) -> DataFrame:
    """One title and one JSON detail per event, five shapes."""
    c = F.col
    agent = F.concat(F.lit("["), c("agent"), F.lit("] "))
    milliseconds = F.format_string("%,.0f", c("duration_ms"))
    chosen = F.array_join("tool_calls", ", ") if "tool_calls" in trace.columns else F.lit("")
    chose = F.coalesce(F.nullif(chosen, F.lit("")), F.lit("answers in text"))
    reason = F.when(F.coalesce(c("reason"), F.lit("")) != "", F.concat(F.lit(": "), c("reason"))).otherwise(F.lit(""))
    optional = {n: (c(n) if n in trace.columns else F.lit(None).cast("string")) for n in
                ("model", "text", "generated_by", "hedge", "risks", "warnings", "turn", "tokens")}
    title = (
        F.when(
            is_event("tool_call"),
            F.concat(agent, c("tool"), F.lit(" -> "), c("status"), F.lit(" ("), milliseconds, F.lit(" ms)")),
        )
        .when(is_event("agent_turn"), F.concat(agent, F.lit("turn "), optional["turn"].cast("string"), F.lit(": "), chose))
        .when(
            is_event("handoff", "critique"),
            F.concat(c("sender"), F.lit(" -> "), c("receiver"), F.lit(": "), _message_name()),
        )
        .when(
            is_event("report"),
            F.concat(agent, F.lit("report written by "), optional["generated_by"], F.lit(", hedge "), optional["hedge"]),
        )
        .otherwise(F.concat(F.lit("cache "), F.coalesce(c("action"), F.lit("None")), reason))
    )
    detail = (
        F.when(
            is_event("tool_call"),
            F.to_json(F.struct("args", "why", F.substring("output", 1, TRACE_OUTPUT_CHARS).alias("output"), "cache_hit")),
        )
        .when(is_event("agent_turn"), F.to_json(F.struct(*[optional[n].alias(n) for n in ("model", "tokens", "text")])))
        .when(is_event("handoff", "critique"), c("content"))
        .when(is_event("report"), F.to_json(F.struct(*[optional[n].alias(n) for n in ("risks", "warnings")])))
        .otherwise(F.to_json(F.struct("path", "reason")))
    )
    return trace.select("run_id", "seq", c("event").alias("kind"), c("ts").alias("time"), title.alias("title"), detail.alias("detail"))


def stored_output(calls: DataFrame, limit: int = TRACE_OUTPUT_CHARS) -> DataFrame:
    """Calls with the short form of their output, ``output_preview``, and its full length beside the whole."""
    return calls.withColumns({"output_chars": F.length("output"), "output_preview": F.substring("output", 1, limit)})


def turns_of_calls(trace: DataFrame, block: int = BLOCK) -> DataFrame:
    """Turns and calls with ``turn_no``: the number of model turns of that run and agent so far."""
    kept = trace.where(is_event("agent_turn", "tool_call"))
    return with_running_sum(
        kept, ["run_id", "agent"], is_event("agent_turn").cast("bigint"), "turn_no", block=block
    )


def replan_cycles(trace: DataFrame, block: int = BLOCK) -> DataFrame:
    """What each replanning turn had observed and then chose, one row per call.

    A cycle pairs turn k with turn k + 1 of the same run and agent when both asked
    for calls; calls before the first turn belong to none. ``side`` is ``observed`` for
    the calls of turn k and ``chose`` for those of turn k + 1. Rows are joined on
    (run, agent, turn), so no run is gathered in one place.
    """
    numbered = turns_of_calls(trace, block).where(F.col("turn_no") > 0)
    per_turn = numbered.groupBy("run_id", "agent", "turn_no").agg(
        F.max("turn").alias("turn"), F.count_if(is_event("tool_call")).alias("calls")
    ).where(F.col("calls") > 0)
    following = per_turn.select("run_id", "agent", (F.col("turn_no") - 1).alias("turn_no"), F.col("turn").alias("next_turn"))
    pairs = per_turn.join(following, ["run_id", "agent", "turn_no"]).select("run_id", "agent", "turn_no", "next_turn")
    calls = numbered.where(is_event("tool_call")).select("run_id", "agent", "turn_no", "seq", "tool", "status")
    observed = calls.join(pairs, ["run_id", "agent", "turn_no"]).withColumn("side", F.lit("observed"))
    chose = calls.join(
        pairs.withColumn("turn_no", F.col("turn_no") + 1), ["run_id", "agent", "turn_no"]
    ).withColumn("side", F.lit("chose"))
    both = observed.unionByName(chose)
    return both.select("run_id", "agent", F.col("next_turn").alias("turn"), "side", "seq", "tool", "status")


def call_log_rollup(log: DataFrame) -> DataFrame:
    """Model-call log by (prompt, provider, outcome), NULL groups kept."""
    return log.groupBy("prompt", "provider", "outcome").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("attempts").alias("attempts"),
        F.sum("sdk_retries").alias("sdk_retries"),
        F.round(F.avg("latency_ms"), 0).alias("mean_latency_ms"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )


def totals(trace: DataFrame) -> DataFrame:
    """One row: tokens of all turns, tool calls, longest stored output."""
    return trace.agg(
        F.coalesce(F.sum(F.when(is_event("agent_turn"), F.coalesce("tokens", F.lit(0)))), F.lit(0)).alias("tokens"),
        F.count_if(is_event("tool_call")).alias("tool_calls"),
        F.max(F.length(F.when(is_event("tool_call"), F.col("output")))).alias("longest_output"),
    )


def event_counts(trace: DataFrame) -> DataFrame:
    return trace.groupBy("event").agg(F.count(F.lit(1)).alias("events"))


def event_pivot(trace: DataFrame, section: str, kinds: list[str]) -> DataFrame:
    """Events per section, one column per kind, zero where there is none."""
    return trace.groupBy(section).pivot("event", kinds).agg(F.count("ts")).na.fill(0)


def agent_tool_crosstab(trace: DataFrame, tools: list[str]) -> DataFrame:
    return tool_calls(trace).groupBy("agent").pivot("tool", tools).agg(F.count(F.lit(1))).na.fill(0)


def result_durations(results: DataFrame, trace: DataFrame) -> DataFrame:
    """Results (run_id, tool, ...) with the duration of the last call of that tool in the run."""
    last = tool_calls(trace).groupBy("run_id", "tool").agg(F.max_by("duration_ms", "seq").alias("duration_ms"))
    return results.join(last, ["run_id", "tool"], "left")


def side_by_side(left: DataFrame, right: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """The tool order of two runs next to each other, the shorter one padded with ''.

    Both sides are calls with ``keys``, ``seq`` and ``tool``; rows meet on their position.
    """
    first = with_position(left, keys, "call", block=block).select(*keys, "call", F.col("tool").alias("left_tool"))
    second = with_position(right, keys, "call", block=block).select(*keys, "call", F.col("tool").alias("right_tool"))
    return first.join(second, [*keys, "call"], "full_outer").select(
        *keys, "call",
        F.coalesce("left_tool", F.lit("")).alias("left_tool"),
        F.coalesce("right_tool", F.lit("")).alias("right_tool"),
    )
