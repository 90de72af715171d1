"""Chat formatting from an event log: streamed deltas, edits and regenerations folded into messages, then rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Marks of the template, and what else of other templates is escaped inside texts.
START, END = "<|im_start|>", "<|im_end|>\n"
_OPEN, _REST = r"([<\[])", r"(\||/?s>|/?INST\])"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    r"""The text with one more backslash behind the first character of every control string: ``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``."""
    return F.regexp_replace(text, _OPEN + r"(\\*+)" + _REST, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    """What ``escaped`` was given."""
    return F.regexp_replace(text, _OPEN + r"\\(\\*+)" + _REST, "$1$2$3")


def _role_line(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _role_read(line: Column) -> Column:
    return unescaped(F.replace(F.replace(line, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def fold_turns(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log (conv_id, seq, turn, kind, role, text).

    Events of a turn are taken by seq. ``message`` and ``edit`` set the turn's text, ``delta``
    appends to it, ``regenerate`` empties it and withdraws all later turns written before it;
    the last role given counts. Events delivered twice (equal in all six columns) count once.
    A null kind is a message, a null text is empty, a null seq comes first, a null turn is a turn
    before all others, a null role is empty, a null conv_id is a conversation. Events of one
    seq are taken in the order of kind, role and text. Other columns are not read.
    A turn's events meet in one row, a conversation's turns (not their events) in one task.
    """
    c = F.col
    event = F.struct(
        F.coalesce(c("seq").cast("long"), F.lit(-(2**63))).alias("seq"), F.coalesce(F.lower("kind"), F.lit("message")).alias("kind"),
        c("role").cast("string").alias("role"), F.coalesce(c("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = events.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_set(event)).alias("log"))
    renewed = F.array_max(F.transform(F.filter("log", lambda e: e["kind"] == "regenerate"), lambda e: e["seq"]))
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("cut", F.max(renewed).over(earlier))
    turns = turns.withColumn("log", F.filter("log", lambda e: c("cut").isNull() | (e["seq"] > c("cut")))).filter(F.size("log") > 0)
    set_at = F.coalesce(F.array_max(F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i))), F.lit(0))
    roles = F.filter(c("log")["role"], lambda r: r.isNotNull())
    return turns.select(
        "conv_id", "turn", F.coalesce(F.get(roles, F.size(roles) - 1), F.lit("")).alias("role"),
        F.array_join(F.slice(c("log")["text"], set_at + 1, F.size("log")), "").alias("text"),
    )


def rendered_turns(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """Each turn's segment of its conversation's output, with its place and the place of what is trained on.

    Adds segment, start, length, and loss_start and loss_length (null where the role isn't
    ``loss_role``); places are code points of the whole output, from 0.
    """
    c = F.col
    head, body = F.concat(F.lit(START), _role_line(c("role")), F.lit("\n")), escaped(c("text"))
    parts = turns.select("conv_id", "turn", c("role") == loss_role, head, body).toDF("conv_id", "turn", "_loss", "_head", "_body")
    parts = parts.withColumn("segment", F.concat("_head", "_body", F.lit(END))).withColumn("length", F.char_length("segment").cast("long"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return parts.select(
        "conv_id", "turn", "segment", "start", "length",
        F.when(c("_loss"), c("start") + F.char_length("_head")).alias("loss_start"), F.when(c("_loss"), F.char_length("_body").cast("long")).alias("loss_length"),
    )


def formatted(events: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row a conversation: conv_id, formatted, and ``turns``, the places of its segments and loss spans in order.

    A conversation is one training example and so has to fit in a row. A conversation
    whose turns were all withdrawn has none.
    """
    c = F.col
    places = ["start", "length", "loss_start", "loss_length"]
    rows = rendered_turns(fold_turns(events), loss_role).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "length", "loss_start", "loss_length", "segment"))).alias("rows"))
    return rows.select("conv_id", F.array_join(c("rows")["segment"], "").alias("formatted"), F.transform("rows", lambda r: F.struct(*(r[p].alias(p) for p in places))).alias("turns"))


def read_back(conversations: DataFrame) -> DataFrame:
    """Adds what the output says: ``messages`` (role, text of each turn) and ``trained`` (the texts under the loss mask), unescaped."""
    c = F.col
    cut = conversations.withColumn("_pieces", F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 2**31 - 1))
    paired = F.arrays_zip(c("_pieces").alias("piece"), c("turns").alias("turn"))

    def message(piece: Column) -> Column:
        line = F.substring_index(piece, "\n", 1)
        used = F.char_length(line) + 1
        return F.struct(_role_read(line).alias("role"), unescaped(F.substring(piece, used + 1, F.char_length(piece) - used - len(END))).alias("text"))

    def trained(pair: Column) -> Column:
        place = pair["turn"]
        first = (place["loss_start"] - place["start"] - len(START) + 1).cast("int")
        return unescaped(F.substring(pair["piece"], first, place["loss_length"].cast("int")))

    under_mask = F.filter(paired, lambda p: p["turn"]["loss_start"].isNotNull())
    return cut.withColumns({"messages": F.transform("_pieces", message), "trained": F.transform(under_mask, trained)}).drop("_pieces")


def _log_of(conversations: DataFrame) -> DataFrame:
    """A log whose messages are the table's rows: users' texts are drafts that are edited, others' are streamed, dropped and streamed anew."""
    c = F.col
    text = F.coalesce(c("text"), F.lit(""))
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length(text) / 256) - 1, F.lit(0))), lambda i: F.substring(text, (i * 256 + 1).cast("int"), F.lit(256)))
    draft = F.substring(text, 1, 64)
    event = lambda kind, of, role=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else role).alias("role"), of.alias("text"))
    edited = F.array(event("message", draft, c("role")), event("edit", text))
    streamed = F.concat(F.array(event("message", F.lit(""), c("role")), event("delta", draft), event("regenerate", F.lit(""))), F.transform(chunks, lambda x: event("delta", x)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("turn", F.row_number().over(order).cast("long"))
    rows = rows.select("conv_id", "turn", F.posexplode(F.when(c("role") == "user", edited).otherwise(streamed)).alias("at", "event"))
    return rows.select("conv_id", (F.shiftleft("turn", 32) + c("at")).alias("seq"), "turn", "event.kind", "event.role", "event.text")


def op3_chat_formatting(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    both = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    table = spark.read.parquet(f"{d}/conversations.parquet").select(c("conv_id").cast("long"), c("turn").cast("long"), "role", "text")
    table = table.unionByName(spark.createDataFrame(both, table.schema))
    read = read_back(formatted(_log_of(table)))
    trained = F.array_join("trained", "")
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("messages").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op3_chat_formatting": op3_chat_formatting}
_ESCAPED = r"regexp_replace(coalesce({}, ''), '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')"
ORACLE = {
    "op3_chat_formatting": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, v.turn, v.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum({len(START) + 1 + len(END)} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id""",
}
