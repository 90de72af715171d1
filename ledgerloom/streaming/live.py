"""Live forms of the trace, news and snapshot operators.

Every function takes a streaming DataFrame and returns one, except the sinks. State
is bounded by a watermark, or per key by what the next event needs. Windows and
sessions are emitted once, in append mode, when the watermark passes their end.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerloom.operators.news import story_key
from ledgerloom.operators.traces import is_event
from ledgerloom.sources.jsonl import path_exists
from ledgerloom.sources.snapshots import put, read_snapshots

CYCLE_SCHEMA = "run_id string, agent string, turn bigint, side string, seq bigint, tool string"


def trace_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """JSON-lines files appearing under ``path``, at most ``files_per_batch`` per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def polled_feeds(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(ticker, feed_rank, polled, xml): RSS documents as pollers append them, one JSON line a poll, a file at a time.

    Which files were read is in the checkpoint of the query that reads the stream, so a restarted one reads no
    poll twice and misses none. ``feeds.parse_feed`` and ``feeds.broken_feeds`` take the rows as they are.
    """
    schema = "ticker string, feed_rank int, polled timestamp, xml string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def live_tool_stats(trace: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Tool statistics per tumbling window, or sliding with ``slide``."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    calls = trace.where(is_event("tool_call")).withWatermark("ts", late)
    stats = calls.groupBy(window.alias("w"), "tool").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.avg("duration_ms").alias("mean_ms"),
        F.max("duration_ms").alias("max_ms"),
    )
    return stats.select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "tool", "calls", "ok", "mean_ms", "max_ms"
    )


def run_sessions(trace: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each run, split where nothing happened for ``gap``. Works on tables too."""
    call, turn = is_event("tool_call"), is_event("agent_turn")
    stamped = trace.withWatermark("ts", late) if trace.isStreaming else trace
    sessions = stamped.groupBy(F.session_window("ts", gap).alias("w"), "run_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(call).alias("tool_calls"),
        F.count_if(call & (F.col("status") != "ok")).alias("problems"),
        F.coalesce(F.sum(F.when(turn, F.col("tokens"))), F.lit(0)).alias("tokens"),
    )
    return sessions.select(
        "run_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "tool_calls", "problems", "tokens"
    )


def live_unique_stories(headlines: DataFrame, days: int | None = 7) -> DataFrame:
    """Headlines whose story was not seen for the ticker within the last ``days``; older arrivals are late and dropped.

    Without ``days`` no arrival is late and a story is new only once; each then stays in the state, best kept in RocksDB.
    """
    keyed = headlines.withColumn("title_key", story_key())
    if days is None:
        return keyed.dropDuplicates(["ticker", "title_key"])
    return keyed.withWatermark("published", f"{days} days").dropDuplicatesWithinWatermark(["ticker", "title_key"])


class ReplanCycles(StatefulProcessor):
    """Per (run, agent): the previous turn's calls, and whether the current turn has asked for any.

    Rows of one micro-batch are put in write order; micro-batches arrive in write order. State
    doesn't expire: an expiry needs processing time, under which a run over what is available
    now doesn't end.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turn = handle.getValueState("turn", "turn bigint, cycle boolean")
        self.current = handle.getListState("current", "seq bigint, tool string")
        self.previous = handle.getListState("previous", "seq bigint, tool string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Every call to a state is a round trip, so each is read and written once a micro-batch, if it is needed at all."""
        run_id, agent = key
        stored = self.turn.get()
        number, cycle = stored or (None, False)
        begun = bool(stored)
        previous = None if stored else []  # calls of the previous turn; None: not read yet
        led = None if stored else False  # whether there are any
        calls: list[tuple] = []  # of the current turn, in this micro-batch
        turned = False
        for seq, event, turn, tool in sorted(((r.seq, r.event, r.turn, r.tool) for r in rows), key=itemgetter(0)):
            if event == "agent_turn":
                previous = calls if turned or not stored else [*self.current.get(), *calls]
                led, calls, turned = bool(previous), [], True
                number, cycle, begun = turn, False, True
            elif event == "tool_call" and begun:
                if not cycle:
                    if previous is None:
                        previous = list(self.previous.get())
                        led = bool(previous)
                    for s, t in previous:
                        yield Row(run_id=run_id, agent=agent, turn=number, side="observed", seq=s, tool=t)
                    cycle = True
                if led is None:
                    led = self.previous.exists()
                if led:
                    yield Row(run_id=run_id, agent=agent, turn=number, side="chose", seq=seq, tool=tool)
                calls.append((seq, tool))
        if begun and (number, cycle) != stored:
            self.turn.update((number, cycle))
        if turned:
            for state, now in ((self.previous, previous), (self.current, calls)):
                if now:
                    state.put(now)
                elif stored:
                    state.clear()
        elif calls:
            self.current.appendList(calls)

    def close(self) -> None:
        pass


def live_replan_cycles(trace: DataFrame) -> DataFrame:
    """Replan cycles as they happen. Needs the RocksDB state store."""
    kept = trace.where(is_event("agent_turn", "tool_call")).select("run_id", "agent", "event", "turn", "seq", "tool")
    return kept.groupBy("run_id", "agent").transformWithState(
        statefulProcessor=ReplanCycles(), outputStructType=CYCLE_SCHEMA, outputMode="Append", timeMode="None"
    )


def append_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over everything available now and append to a Parquet table."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )


def upsert_snapshots(runs: DataFrame, path: str, checkpoint: str, order: str) -> StreamingQuery:
    """Keep the newest run per (ticker, as_of) in the snapshot table; of equal ``order`` the greatest row.

    Runs without a ticker or day are left out. A micro-batch is compared with what the table holds for the keys it touches, so an older
    run that arrives late changes nothing, and a replayed batch id writes the same content
    again. What is written is complete in a folder beside the checkpoint before the table is
    touched: the table is not read while it is written.
    """
    rest = [c for c in runs.columns if c not in ("ticker", "as_of")]
    ordered = [order, *[c for c in rest if c != order]]

    def newest(rows: DataFrame) -> DataFrame:
        best = rows.groupBy("ticker", "as_of").agg(F.max(F.struct(*ordered)).alias("run"))
        return best.select("ticker", "as_of", *[F.col("run")[c].alias(c) for c in rest])

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropna(subset=["ticker", "as_of"])
        fresh = newest(batch)
        if path_exists(spark, path):
            stored = read_snapshots(spark, path, batch.schema)
            touched = batch.select("ticker", "as_of").distinct()
            fresh = newest(stored.join(touched, ["ticker", "as_of"], "left_semi").select(batch.columns).unionByName(batch))
        put(fresh, path, f"{checkpoint}-staged/batch={batch_id}")

    return runs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
