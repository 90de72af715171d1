"""Corpus preparation: code facts, validation and routing, docstring checks, chat records, splits, counts."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.fixed_values import (
    CHECK_LABELS,
    CODE_LINES,
    DOC_HEADER,
    KINDS,
    LEVELS,
    NAME_STOPWORDS,
    PER_LEVEL,
    RECEIVERS,
    REJECT_DETAIL,
    SPLIT_FRACTION,
    SPLIT_SEED,
)
from ledgerloom.functions.code_facts import code_facts
from ledgerloom.functions.texts import unwrapped, word_tokens
from ledgerloom.operators.ordered import with_hash_rank
from ledgerloom.schemas import CODE_FACTS


def with_code_facts(df: DataFrame, code: str = "code") -> DataFrame:
    """Add ``facts``, a struct read from the syntax tree of each code text, in Arrow batches without a shuffle."""
    schema = T.StructType(df.schema.fields + [T.StructField("facts", CODE_FACTS)])
    facts, place = to_arrow_type(CODE_FACTS), df.columns.index(code)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gc.disable()  # syntax trees hold no cycles, and many nodes: looking for some took half of the time
            try:
                rows = [code_facts(text or "") for text in batch.column(place).to_pylist()]
            finally:
                gc.enable()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, facts)], names=[*batch.schema.names, "facts"])

    return df.mapInArrow(parse, schema)


def reject_reason(kind: Column) -> Column:
    """Why a generated function is unusable: the first failing check, or NULL."""
    f = F.col("facts")
    low, high = CODE_LINES
    receiver = F.coalesce(f["first_arg"].isin(RECEIVERS), F.lit(False))
    fits = (
        F.when(kind == "function", ~f["is_async"] & ~f["is_generator"] & ~receiver)
        .when(kind == "method", F.coalesce(f["first_arg"] == "self", F.lit(False)) & ~f["is_async"] & ~f["is_generator"])
        .when(kind == "generator", f["is_generator"] & ~f["is_async"])
        .when(kind == "async", f["is_async"] & ~f["is_generator"])
        .otherwise(F.lit(False))
    )
    return (
        F.when(f["error"].isNotNull(), F.concat(F.lit("not one valid function: "), f["error"]))
        .when(f["has_docstring"], "already has a docstring")
        .when(~f["code_lines"].between(low, high), F.format_string(f"%d lines, outside {low}-{high}", f["code_lines"]))
        .when(~fits, F.concat(F.lit("does not match kind '"), kind, F.lit("'")))
    )


def recipe_id(topic: Column, kind: Column, level: Column, n: Column) -> Column:
    return F.format_string("%s-%s-%s-%02d", topic, kind, level, n)


def recipe_grid(topics: DataFrame, kinds: list[str] = KINDS, levels: list[str] = LEVELS, per_level: int = PER_LEVEL) -> DataFrame:
    """Every (topic, kind, level, n) with its id, from a table of topics; the other sides are fixed lists."""
    grid = topics.select("topic").distinct()
    for name, values in (("kind", kinds), ("level", levels), ("n", list(range(1, per_level + 1)))):
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.withColumn("id", recipe_id(*[F.col(c) for c in ("topic", "kind", "level", "n")]))


def open_cells(grid: DataFrame, attempted: DataFrame) -> DataFrame:
    """(topic, kind) cells of the grid that no kept or rejected function names yet."""
    return grid.select("topic", "kind").distinct().join(attempted.select("topic", "kind").distinct(), ["topic", "kind"], "left_anti")


def unlabelled(functions: DataFrame, labels: DataFrame) -> DataFrame:
    return functions.join(labels.select("id"), "id", "left_anti")


def route_functions(arrivals: DataFrame, stored_names: DataFrame | None = None, per_level: int = PER_LEVEL) -> DataFrame:
    """Generated functions (topic, kind, level, seq, code) with id, status kept, rejected or ignored, and the reason.

    Only the first ``per_level`` arrivals of a (topic, kind, level) have a slot; later ones are
    ignored: they have no id, their code is not parsed, and no cell's rows are ranked beyond its slots. Of valid functions with one name the first arrival wins, unless
    the name is stored already. Winners come from an aggregation, so a name that a
    third of all rows share costs one row per task in the shuffle.
    """
    slot = Window.partitionBy("topic", "kind", "level").orderBy("seq")
    slotted = arrivals.withColumn("n", F.row_number().over(slot)).where(F.col("n") <= per_level)
    cleaned = slotted.withColumn("code", F.regexp_replace("code", r"\A\n+|\n+\z", ""))
    checked = with_code_facts(cleaned).withColumn("reason", reject_reason(F.col("kind")))
    valid = checked.where(F.col("reason").isNull()).select(F.col("facts.name").alias("name"), "seq")
    winners = valid.groupBy("name").agg(F.min("seq").alias("winner"))
    if stored_names is not None:
        winners = winners.join(stored_names.select("name").distinct(), "name", "left_anti")
    won = winners.select(F.col("winner").alias("seq"), F.lit(True).alias("first"))
    duplicate = F.concat(F.lit("duplicate function name '"), F.col("facts.name"), F.lit("'"))
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("first").isNull(), duplicate)
    routed = checked.join(won, "seq", "left").select(
        recipe_id(*[F.col(c) for c in ("topic", "kind", "level", "n")]).alias("id"),
        "topic", "kind", "level", "seq", "code",
        F.when(reason.isNull(), "kept").otherwise("rejected").alias("status"),
        reason.alias("reason"),
    )
    late = arrivals.join(slotted.select("seq"), "seq", "left_anti").select(
        F.lit(None).cast("string").alias("id"), "topic", "kind", "level", "seq", "code",
        F.lit("ignored").alias("status"), F.lit(f"beyond the {per_level} arrivals of its slot").alias("reason"),
    )
    return routed.unionByName(late)


def reject_histogram(routed: DataFrame) -> DataFrame:
    """Rejections by reason, with quoted names, details and digits left out."""
    short = F.trim(F.regexp_replace("reason", REJECT_DETAIL, ""))
    return routed.where("status = 'rejected'").groupBy(short.alias("reason")).agg(F.count(F.lit(1)).alias("functions"))


# --- docstrings ---------------------------------------------------------------------

_HEADER_LINE = r"(?m)^(?! )[^\S\n]*(?:Args|Arguments|Returns|Yields|Raises):[^\S\n]*$"
_HEADER_NAME = r"(?m)^(?! )[^\S\n]*(Args|Arguments|Returns|Yields|Raises):[^\S\n]*$"
_ENTRY_LINE = r"(?m)^ {4}(\*{0,2}[A-Za-z_][\w.]*)[^\S\n]*(?:\([^)\n]*\))?[^\S\n]*:"


def docstring_claims(docstring: Column) -> Column:
    """What a docstring claims: struct(summary, args, has_returns, has_yields, raises), NULL without a summary line."""
    text = F.regexp_replace(unwrapped(docstring), r"\r\n?|[\x0b\f\x{85}\x{2028}\x{2029}]", "\n")

    def claims(t: Column) -> Column:
        summary = F.trim(F.regexp_extract(t, r"\A([^\n]*)", 1))
        rest = F.regexp_replace(t, r"\A[^\n]*\n?", "")
        names = F.regexp_extract_all(rest, F.lit(_HEADER_NAME), F.lit(1))
        pieces = F.split(rest, _HEADER_LINE)
        bodies = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        sections = F.arrays_zip(names.alias("section"), bodies.alias("body"))

        def entries(*wanted: str) -> Column:
            mine = F.filter(sections, lambda s: s["section"].isin(*wanted))
            found = F.flatten(F.transform(mine, lambda s: F.regexp_extract_all(s["body"], F.lit(_ENTRY_LINE), F.lit(1))))
            return F.transform(found, lambda e: F.regexp_replace(e, r"^\*+", ""))

        raises = F.transform(entries("Raises"), lambda e: F.substring_index(e, ".", -1))
        parsed = F.struct(
            summary.alias("summary"),
            entries("Args", "Arguments").alias("args"),
            F.array_contains(names, "Returns").alias("has_returns"),
            F.array_contains(names, "Yields").alias("has_yields"),
            F.array_distinct(raises).alias("raises"),
        )
        return F.when((summary != "") & ~F.rlike(summary, F.lit(DOC_HEADER)), parsed)

    return F.transform(F.array(text), claims)[0]


def check_docstrings(df: DataFrame, docstring: str = "docstring") -> DataFrame:
    """Rows with ``facts`` and a docstring, plus claims, missing, invented and the label.

    Unparseable first (the docstring, or code that is not one valid function, so that nothing
    can be compared), then hallucinated (anything invented), partial (anything missing), correct.
    """
    f, c = F.col("facts"), F.col("claims")
    gen = f["is_generator"]
    none = F.array().cast("array<string>")

    def named(prefix: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.concat(F.lit(prefix), v))

    def only(condition: Column, text: str) -> Column:
        return F.when(condition, F.array(F.lit(text))).otherwise(none)

    missing = F.concat(
        named("arg ", F.filter(f["params"], lambda p: ~F.array_contains(c["args"], p))),
        only(gen & ~c["has_yields"], "Yields"),
        only(~gen & f["returns_value"] & ~c["has_returns"], "Returns"),
        named("raises ", F.array_sort(F.array_except(f["raises"], c["raises"]))),
    )
    invented = F.concat(
        named("arg ", F.filter(c["args"], lambda a: ~F.array_contains(f["params"], a))),
        only(~gen & c["has_yields"], "Yields"),
        only(c["has_returns"] & (gen | ~f["returns_value"]), "Returns"),
        named("raises ", F.array_sort(F.array_except(c["raises"], f["raises"]))),
    )
    parsed = df.withColumn("claims", docstring_claims(F.col(docstring)))
    known = c.isNotNull() & f["error"].isNull()
    lists = parsed.withColumns(
        {
            "missing": F.when(known, missing).otherwise(none),
            "invented": F.when(known, invented).otherwise(none),
        }
    )
    label = (
        F.when(~known, CHECK_LABELS[3])
        .when(F.size("invented") > 0, CHECK_LABELS[2])
        .when(F.size("missing") > 0, CHECK_LABELS[1])
        .otherwise(CHECK_LABELS[0])
    )
    return lists.withColumn("label", label)


def render_docstring(
    summary: Column, details: Column, args: Column, returns: Column, yields: Column, raises: Column
) -> Column:
    """One docstring in the fixed layout; ``args`` and ``raises`` are arrays of (name, text) structs."""

    def block(header: str, body: Column) -> Column:
        kept = F.nullif(F.trim(body), F.lit(""))
        return F.when(kept.isNotNull(), F.concat(F.lit(f"{header}:\n    "), kept))

    def listing(header: str, rows: Column) -> Column:
        lines = F.transform(rows, lambda r: F.concat(F.lit("    "), r["name"], F.lit(": "), F.trim(r["text"])))
        return F.when(F.size(rows) > 0, F.concat(F.lit(f"{header}:\n"), F.array_join(lines, "\n")))

    return F.concat_ws(
        "\n\n",
        F.trim(summary),
        F.nullif(F.trim(details), F.lit("")),
        listing("Args", args),
        block("Returns", returns),
        block("Yields", yields),
        listing("Raises", raises),
    )


def name_words(facts: DataFrame) -> DataFrame:
    """Words of function names with their counts and the first row that used them."""
    words = facts.where(F.col("facts.name").isNotNull()).select(
        "seq", F.posexplode(F.split(F.lower("facts.name"), "_")).alias("at", "word")
    )
    kept = words.where((F.col("word") != "") & ~F.col("word").isin(NAME_STOPWORDS))
    place = F.col("seq").cast("decimal(20,0)") * 1_000_000 + F.col("at")
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("uses"), F.min(place).alias("first"))


def most_common(counts: DataFrame, count: str, first: str, n: int) -> DataFrame:
    """The ``n`` largest counts; ties by first appearance."""
    return counts.orderBy(F.col(count).desc(), first).limit(n)


def modules_used(facts: DataFrame) -> DataFrame:
    used = facts.select("seq", F.explode("facts.modules").alias("module"))
    return used.groupBy("module").agg(F.count(F.lit(1)).alias("functions"), F.min("seq").alias("first"))


# --- records, splits, tables ------------------------------------------------------------


def chat_records(functions: DataFrame, labels: DataFrame, system: str, label: str = "correct") -> DataFrame:
    """Functions whose docstring has the wanted label, as three-turn chat records."""
    kept = labels.where(F.col("label") == label).select("id", "docstring")
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return kept.join(functions, "id").select(
        "id", "topic", "kind", "level",
        F.array(turn("system", F.lit(system)), turn("user", F.col("code")), turn("assistant", F.col("docstring"))).alias("messages"),
    )


def orphan_labels(functions: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels whose function is missing: an error in the input."""
    return labels.join(functions.select("id"), "id", "left_anti")


def turns_to_messages(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows as one messages array per conversation."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(
        F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")
    )


def chat_text(messages: Column) -> Column:
    """A conversation as one tagged text."""
    tagged = F.transform(
        messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))
    )
    return F.array_join(tagged, "")


def prompt_text(messages: Column) -> Column:
    """The first two turns, ending where the answer starts."""
    return F.concat(chat_text(F.slice(messages, 1, 2)), F.lit("<|im_start|>assistant\n"))


def prefix_violations(records: DataFrame) -> DataFrame:
    """Records whose prompt is not a prefix of the whole conversation."""
    return records.where(~F.startswith(chat_text(F.col("messages")), prompt_text(F.col("messages"))))


def stratified_split(
    records: DataFrame, key: str = "id", stratum: str = "kind", seed: int = SPLIT_SEED,
    fraction: float = SPLIT_FRACTION, buckets: int = 4096,
) -> DataFrame:
    """Add ``split``: per stratum round(10 %) test, round(10 %) val, the rest train.

    Rows are ordered by a digest of seed and key, so the split depends on nothing
    else. Half counts round to even.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    ranked = with_hash_rank(records, [stratum], digest, key, "_rank", buckets)
    part = F.bround(F.col("_rank_of") * fraction, 0)
    return ranked.withColumn(
        "split", F.when(F.col("_rank") <= part, "test").when(F.col("_rank") <= 2 * part, "val").otherwise("train")
    ).drop("_rank", "_rank_of")


def token_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add <column>_tokens (word tokens) and total_tokens."""
    counts = {f"{c}_tokens": F.size(word_tokens(F.coalesce(F.col(c), F.lit("")))) for c in columns}
    total = sum((F.col(f"{c}_tokens") for c in columns), F.lit(0))
    return df.withColumns(counts).withColumn("total_tokens", total)


def funnel(routed: DataFrame, labels: DataFrame) -> DataFrame:
    """Arrived, ignored, written, valid, labelled, kept: what arrived is what was ignored and what was written."""
    ignored = F.col("status") == "ignored"
    a = routed.agg(F.count(F.lit(1)).alias("arrived"), F.count_if(ignored).alias("ignored"), F.count_if(~ignored).alias("written"), F.count_if(F.col("status") == "kept").alias("valid"))
    b = labels.agg(F.count(F.lit(1)).alias("labelled"), F.count_if(F.col("label") == "correct").alias("kept"))
    first = a.selectExpr("stack(4, 1, 'arrived', arrived, 2, 'ignored', ignored, 3, 'written', written, 4, 'valid', valid) as (step_no, step, examples)")
    return first.unionByName(b.selectExpr("stack(2, 5, 'labelled', labelled, 6, 'kept', kept) as (step_no, step, examples)"))


def filled_template(template: str, variables: dict[str, Column]) -> Column:
    """``{name}`` placeholders replaced per row; a placeholder without a variable is a caller error."""
    import string

    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            if name not in variables:
                raise KeyError(f"the template needs a value for {name!r}")
            parts.append(variables[name].cast("string"))
    return F.concat(*parts)


def numbered_list(items: Column) -> Column:
    """'1. a' lines from an array."""
    return F.array_join(F.transform(items, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")


def marker_problems(lines: DataFrame, marker: str, valid: str, index: DataFrame) -> DataFrame:
    """(path, line_no, problem): malformed marker lines, and files with markers that the index does not list."""
    hits = lines.where(F.rlike("line", F.lit(marker)))
    malformed = hits.where(~F.rlike("line", F.lit(valid))).select("path", "line_no", F.lit("malformed marker").alias("problem"))
    unlisted = hits.select("path").distinct().join(index.select("path").distinct(), "path", "left_anti")
    return malformed.unionByName(
        unlisted.select("path", F.lit(None).cast("bigint").alias("line_no"), F.lit("not in the index").alias("problem"))
    )
