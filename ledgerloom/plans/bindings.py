"""How the star-schema test tables map onto bars, headlines, labels, corpora and traces.

Each function reads whole tables and derives rows with built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.session import spread

TICK_ORDER = "l_orderkey, l_linenumber, l_partkey"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- market ---------------------------------------------------------------------


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ticks: one ticker per return flag, ordered inside a day by a unique number.

    The order number is a decimal so that the first/last aggregates stay hash-based.
    """
    seq = F.expr(
        "cast(l_orderkey as decimal(20,0)) * 100000000000000 "
        "+ cast(l_linenumber as decimal(20,0)) * 1000000000000 + l_partkey"
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("ticker"),
        F.to_date("l_shipdate").alias("date"),
        seq.cast("decimal(38,0)").alias("seq"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("size"),
    )


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw bars with repeated days and missing highs, one ticker per priority."""
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("ticker"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderkey").alias("seq"),
        price.alias("open"),
        F.when(F.col("o_orderstatus") != "P", price).alias("high"),
        price.alias("low"),
        price.alias("close"),
        F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(F.col("o_custkey").cast("double")).alias("volume"),
    )


def last_date(df: DataFrame, column: str = "date") -> Column:
    """The newest date of a table as a scalar subquery, standing in for today's date."""
    return df.select(F.max(column)).scalar()


def supplier_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "supplier").select(
        c("s_name").alias("ticker"),
        F.when(c("s_nationkey") < 5, F.lit("  ")).when(c("s_nationkey") < 20, F.concat(c("s_name"), F.lit(" Ltd "))).alias("long_name"),
        F.when(c("s_nationkey") < 23, F.concat(F.lit(" S"), c("s_suppkey").cast("string"))).alias("short_name"),
        F.when(c("s_nationkey") != 7, "USD").alias("currency"),
        F.when(c("s_acctbal") < 0, F.lit(float("inf"))).when(c("s_nationkey") == 3, F.lit(float("nan")))
        .when(c("s_nationkey") < 12, c("s_acctbal") / 100).alias("trailing_pe"),
        F.when(c("s_nationkey") != 9, (c("s_nationkey") - 10) / 4).alias("trailing_eps"),
    )


def flag_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fundamentals of the line-item tickers, from per-flag aggregates."""
    c = F.col
    agg = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("ticker")).agg(
        F.max("l_quantity").alias("q"), F.max("l_linenumber").alias("n")
    )
    return agg.select(
        "ticker",
        F.when(c("ticker") != "A", F.concat(F.lit("Flag "), c("ticker"))).alias("long_name"),
        F.lit(" Flag ").alias("short_name"),
        F.when(c("ticker") != "N", "USD").alias("currency"),
        F.when(c("ticker") == "R", c("q")).alias("trailing_pe"),
        F.when(c("ticker") != "N", c("n").cast("double")).alias("trailing_eps"),
    )


# --- traces ---------------------------------------------------------------------


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as agent traces: one run per user.

    Views are model turns, sign-ups are messages between agents or cache lookups,
    everything else is a tool call. ``k`` from the JSON column picks agent and tool.
    """
    c = F.col
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (
        F.when(c("event_type") == "view", "agent_turn")
        .when((c("event_type") == "signup") & (c("k") < 50), "handoff")
        .when((c("event_type") == "signup") & (c("k") < 70), "critique")
        .when(c("event_type") == "signup", "cache")
        .otherwise("tool_call")
    )
    call = c("event") == "tool_call"
    tool = (
        F.when(c("k") < 20, "get_price_data")
        .when(c("k") < 45, "calculate_volatility")
        .when(c("k") < 60, "get_news")
        .when(c("k") < 85, "llm_sentiment")
        .otherwise("web_search")
    )
    status = F.when(c("event_type") == "error", "error").when(c("value") < 2, "empty").otherwise("ok")
    message = c("event").isin("handoff", "critique")
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", k)
        .withColumn("event", kind)
        .select(
            c("ts").cast("timestamp").alias("ts"),
            c("user_id").cast("string").alias("run_id"),
            c("event_id").alias("seq"),
            "event",
            F.when(call | (c("event") == "agent_turn"), F.when(c("k") % 2 == 0, "A").otherwise("B")).alias("agent"),
            F.when(call, tool).alias("tool"),
            F.when(call & (c("k") != 33), F.concat(F.lit('{"ticker": "t'), c("k").cast("string"), F.lit('"}'))).alias("args"),
            F.when(call & (c("value") > 20), "checking").alias("why"),
            F.when(call, status).alias("status"),
            F.when(
                call,
                F.when((status == "error") & (c("k") < 5), F.concat(F.lit("injected failure: "), tool)).otherwise(
                    F.concat(F.lit("result "), c("props"))
                ),
            ).alias("output"),
            F.when(call, c("value")).alias("duration_ms"),
            F.when(call, (c("event_type") == "click") & (c("k") % 10 == 0)).alias("cache_hit"),
            F.when(c("event") == "agent_turn", c("event_id")).alias("turn"),
            F.when((c("event") == "agent_turn") & (c("k") != 7), c("k").cast("bigint")).alias("tokens"),
            F.when(message, F.when(c("k") % 2 == 0, "A").otherwise("B")).alias("sender"),
            F.when(message, F.when(c("k") % 2 == 0, "B").otherwise("A")).alias("receiver"),
            F.when(c("event") == "handoff", "DataBrief").alias("schema"),
            F.when(c("event") == "critique", F.when(c("k") % 2 == 0, "request").otherwise("answer")).alias("step"),
            F.when(message, c("props")).alias("content"),
            F.when(c("event") == "cache", F.when(c("k") < 80, "hit").when(c("k") < 90, "miss").otherwise("save")).alias("action"),
            F.when(c("event") == "cache", F.concat(F.lit("runs/cache/C"), c("k").cast("string"), F.lit("_2024-01-01.json"))).alias("path"),
            F.when((c("event") == "cache") & c("k").between(80, 89), "no file").alias("reason"),
        )
    )


# --- news and labels --------------------------------------------------------------


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as headlines: one ticker per language, two feeds, one publication time per row."""
    c = F.col
    feed_rank = F.when(c("source").isin("src0", "src1", "src2"), 1).otherwise(2)
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("ticker"),
        feed_rank.alias("feed_rank"),
        c("doc_id").alias("pos"),
        c("text").alias("title"),
        c("source").alias("publisher"),
        F.timestamp_seconds(F.lit(1704067200) + (c("n_chars") * 977 + c("doc_id") * 7) % 1209600).alias("published"),
        F.concat(F.lit("https://example.org/"), c("doc_id").cast("string")).alias("url"),
    )


def primary_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents of good quality as decisions with a probability per sentiment."""
    c = F.col
    toxic = c("toxic") == 1
    p = lambda bad, good: F.when(toxic, bad).otherwise(good)
    return table(spark, sf_dir, "labels").where("quality = 1").select(
        c("doc_id").alias("ord"),
        F.when(toxic, "negative").when(c("doc_id") % 3 == 0, "neutral").otherwise("positive").alias("choice"),
        p(0.8, 0.7).alias("confidence"),
        F.create_map(
            F.lit("positive"), p(0.05, 0.7) + (c("doc_id") % 7) * 0.01,
            F.lit("neutral"), F.lit(0.2) - (c("doc_id") % 7) * 0.01,
            F.lit("negative"), p(0.75, 0.1),
        ).alias("probabilities"),
    )


def secondary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "labels").where("toxic = 0").select(
        c("doc_id").alias("ord"),
        F.when(c("toxic") == 1, "negative").when(c("quality") == 1, "positive").otherwise("neutral").alias("sentiment"),
        F.lit(0.6).alias("confidence"),
        F.lit("tone of the text").alias("reason"),
    )


# --- corpus -----------------------------------------------------------------------


def part_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as generated Python functions: the columns of a part decide the shape of its code.

    ``shape`` is the real kind of the code; it differs from ``kind`` for one brand. Two
    more brands get broken code and code that already has a docstring.
    """
    c = F.col
    base = spread(table(spark, sf_dir, "part")).select(
        c("p_partkey").alias("seq"),
        F.lower("p_type").alias("topic"),
        F.when(c("p_size") < 17, "simple").when(c("p_size") < 34, "medium").otherwise("tricky").alias("level"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), c("p_size").cast("string")).alias("fn"),
        (c("p_partkey") % 4).cast("int").alias("k"),
        c("p_size").alias("size"),
        c("p_brand").alias("brand"),
        (c("p_retailprice") > 950).alias("raising"),
    )
    kinds = F.array(*[F.lit(x) for x in ("function", "method", "generator", "async")])
    shape = F.when(c("brand") == "Brand#3", (c("k") + 1) % 4).otherwise(c("k"))
    shaped = base.withColumn("shape", shape).withColumn("kind", F.element_at(kinds, c("k") + 1))
    heads = F.array(
        F.concat(F.lit("def "), c("fn"), F.lit("(q, r=1):\n")),
        F.concat(F.lit("def "), c("fn"), F.lit("(self, q):\n")),
        F.concat(F.lit("def "), c("fn"), F.lit("(q, *rest):\n")),
        F.concat(F.lit("async def "), c("fn"), F.lit("(q, *, key=None, **extra):\n")),
    )
    call = F.when(c("size") % 3 == 0, "math.sqrt").when(c("size") % 3 == 1, "json.dumps").otherwise("text.split")
    error = F.when(c("size") % 2 == 0, "ValueError").otherwise("errors.BadPart")
    code = F.concat(
        F.element_at(heads, c("shape") + 1),
        F.when(c("brand") == "Brand#7", '    """Already documented."""\n').otherwise(""),
        F.lit("    x = 1\n\n"),
        F.repeat(F.concat(F.lit("    x = "), call, F.lit("(q)\n")), c("size") % 43),
        F.when(c("raising"), F.concat(F.lit("    if q is None:\n        raise "), error, F.lit("('bad part')\n"))).otherwise(""),
        F.when(c("shape") == 2, "    yield x\n").when(c("size") % 5 == 0, "    return None\n").otherwise("    return x\n"),
    )
    broken = F.lit("x = 1\n")
    return shaped.withColumn("code", F.when(c("brand") == "Brand#9", broken).otherwise(code))


def part_docstrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A docstring per part, with missing and invented claims for some brands."""
    from ledgerloom.operators.corpus import render_docstring

    c = F.col
    entry = lambda name: F.struct(F.lit(name).alias("name"), F.lit("a value").alias("text"))
    known = F.array(
        F.array(entry("q"), entry("r")), F.array(entry("q")), F.array(entry("q"), entry("*rest")),
        F.array(entry("q"), entry("key"), entry("**extra")),
    )
    args = F.element_at(known, c("shape") + 1)
    args = F.when(c("brand") == "Brand#5", F.slice(args, 1, 1)).when(c("brand") == "Brand#6", F.concat(args, F.array(entry("ghost")))).otherwise(args)
    error = F.when(c("size") % 2 == 0, "ValueError").otherwise("errors.BadPart")
    raised = F.array(F.struct(error.alias("name"), F.lit("the part is bad").alias("text")))
    no_entries = F.slice(raised, 1, 0)
    text = render_docstring(
        F.concat(F.lit("Handle "), c("fn"), F.lit(".")),
        F.when(c("size") % 4 == 0, " More about it. "),
        args,
        F.when((c("shape") != 2) & (c("size") % 5 != 0), "the value"),
        F.when((c("shape") == 2) & (c("brand") != "Brand#8"), "values"),
        F.when(c("raising") & (c("brand") != "Brand#4"), raised).when(c("brand") == "Brand#10", raised).otherwise(no_entries),
    )
    wrapped = F.when(c("brand") == "Brand#11", F.concat(F.lit("```python\n"), text, F.lit("\n```"))).when(
        c("brand") == "Brand#12", F.concat(F.lit('"""'), text, F.lit('\n"""'))
    ).when(c("brand") == "Brand#13", F.lit("Args:\n    q: alone")).otherwise(text)
    return part_functions(spark, sf_dir).withColumn("docstring", wrapped)
