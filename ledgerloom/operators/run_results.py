"""What a run's tools returned: typed figures out of open results, and answers checked against them.

Results are JSON texts of any shape. They are parsed to VARIANT once, and fields are taken by path and
type; a field of another type is a warning and no figure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.fixed_values import HORIZON_DAYS, TOOLS
from ledgerloom.functions.numbers import rounded
from ledgerloom.operators.evidence import data_gaps, ok_tools
from ledgerloom.operators.hedge import hedge_levels

#: Path and type of the figures of each tool; those that a result must have come first, with a star.
PRICE = {
    "close": ("*", "$.close", "double"), "as_of": ("*", "$.as_of", "date"), "period_return_pct": ("", "$.period_return_pct", "double"),
    "close_vs_sma_50_pct": ("", "$.close_vs_sma_50_pct", "double"), "close_vs_sma_200_pct": ("", "$.close_vs_sma_200_pct", "double"),
    "high_52w": ("", "$.high_52w", "double"), "low_52w": ("", "$.low_52w", "double"), "sma_200": ("", "$.indicators.sma_200", "double"),
    "bb_lower": ("", "$.indicators.bb_lower", "double"), "hv_30": ("", "$.indicators.hv_30", "double"),
}
VOLATILITY = {"window": ("*", "$.window", "int"), "current_pct": ("*", "$.current_pct", "double"), "percentile_1y": ("*", "$.percentile_1y", "double")}
SENTIMENT = {"scored": ("*", "$.summary.scored", "bigint"), "score": ("", "$.summary.score", "double"), "label": ("", "$.summary.label", "string")}
FIGURES = {"price": ("get_price_data", PRICE), "volatility": ("calculate_volatility", VOLATILITY), "sentiment": ("llm_sentiment", SENTIMENT)}


def _given(result: Column, path: str) -> Column:
    """Whether the path leads to a value other than a JSON null."""
    kind = F.schema_of_variant(F.try_variant_get(result, path, "variant"))
    return F.coalesce(kind != "VOID", F.lit(False))


def typed(result: Column, fields: dict[str, tuple[str, str, str]], tool: Column | str) -> tuple[Column, Column]:
    """(a struct of the fields, NULL where one that must be there isn't; the warnings), from a VARIANT column."""
    name = F.lit(tool) if isinstance(tool, str) else tool
    value = {field: F.try_variant_get(result, path, kind) for field, (_, path, kind) in fields.items()}
    whole, warnings = F.lit(True), []
    for field, (need, path, kind) in fields.items():
        bad = _given(result, path) & value[field].isNull()
        warnings.append(F.when(bad, F.concat(name, F.lit(f": {field} is no {kind}"))))
        if need:
            whole = whole & value[field].isNotNull()
            warnings.append(F.when(result.isNotNull() & ~bad & value[field].isNull(), F.concat(name, F.lit(f": {field} is missing"))))
    return F.when(whole, F.struct(*[v.alias(f) for f, v in value.items()])), F.array_compact(F.array(*warnings))


def parsed(observations: DataFrame) -> DataFrame:
    """Observations with ``result``: the data as VARIANT, NULL where they are no JSON or the call was not ok."""
    return observations.withColumn("result", F.when(F.col("status") == "ok", F.try_parse_json("data")))


def run_figures(observations: DataFrame) -> DataFrame:
    """(run_id, price, volatility, sentiment, warnings): a row for every run, from all its observations.

    Each figure comes from the tool's newest ok call that returned data; data that are no JSON, or a needed
    field that is missing or of another type, leave it NULL with a warning. Runs of any size: only the
    newest result of each tool is kept while they are aggregated.
    """
    c = F.col
    newest = [
        F.max_by("data", F.when((c("tool") == tool) & (c("status") == "ok") & c("data").isNotNull(), c("seq"))).alias(name)
        for name, (tool, _) in FIGURES.items()
    ]
    rows = observations.groupBy("run_id").agg(*newest)
    rows = rows.withColumns({f"_{name}": F.try_parse_json(name) for name in FIGURES})
    found, warnings = [], []
    for name, (tool, fields) in FIGURES.items():
        figure, said = typed(c(f"_{name}"), fields, tool)
        broken = F.when(c(name).isNotNull() & c(f"_{name}").isNull(), F.array(F.lit(f"{tool}: the result is no JSON")))
        found.append(figure.alias(name))
        warnings.append(F.coalesce(broken, said))
    return rows.select("run_id", *found, F.concat(*warnings).alias("warnings"))


def run_volatility(observations: DataFrame, horizon: int = HORIZON_DAYS) -> DataFrame:
    """(run_id, window, current_pct, percentile_1y): of all usable volatility results the one whose window is nearest the horizon; on a tie the later call."""
    calls = parsed(observations.where("tool = 'calculate_volatility'"))
    figure, _ = typed(F.col("result"), VOLATILITY, "calculate_volatility")
    calls = calls.select("run_id", "seq", figure.alias("v")).where("v is not null")
    nearest = F.min_by("v", F.struct(F.abs(F.col("v.window") - horizon), -F.col("seq"))).alias("v")
    return calls.groupBy("run_id").agg(nearest).select("run_id", "v.*")


def run_hedge_levels(observations: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """(run_id, levels): expected move and candidate levels of every run with a price and a volatility."""
    figures = run_figures(observations) if figures is None else figures
    snapshot = figures.where("price is not null").select(F.col("run_id").alias("ticker"), "price.*")
    snapshot = snapshot.withColumn("hv_30_pct", rounded(F.col("hv_30") * 100.0))
    levels = hedge_levels(snapshot, run_volatility(observations).withColumnRenamed("run_id", "ticker"))
    return levels.select(F.col("ticker").alias("run_id"), F.struct(*[x for x in levels.columns if x != "ticker"]).alias("levels"))


def checked_reports(answers: DataFrame, observations: DataFrame, levels: DataFrame, key: str = "run_id", tools: list[str] = TOOLS) -> DataFrame:
    """The answers with what the run's results don't bear out taken away: a row an answer.

    ``answers`` holds (key, risks ARRAY of (title, explanation, evidence ARRAY of (fact, source_tool)),
    legs ARRAY of (action, instrument, level_name)) and further columns, which stay; ``levels`` (key,
    levels) at most a row a key. Evidence stays where its tool had an ok result in that run, legs
    get the level they name. Added are data_gaps, tools_called and, in reading order behind
    warnings that are there already, a warning for every piece of evidence, risk or leg that lost something.
    Nothing is taken apart: a run's ok tools, a few, meet its nested answer as an array.
    """
    c = F.col
    keyed = observations if key == "run_id" else observations.withColumn("run_id", c(key))
    gaps = data_gaps(keyed, answers.select(c(key).alias("run_id")), tools).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("tool_no", "gap"))).alias("_gaps"))
    facts = ok_tools(keyed).withColumnRenamed("tools", "_tools").join(gaps, "run_id", "full").withColumnRenamed("run_id", "_key")
    priced = levels.select(c(key).alias("_level_key"), c("levels").alias("_levels"))
    rows = answers.join(facts, c(key) == c("_key"), "left").join(priced, c(key) == c("_level_key"), "left")
    usable, empty = F.coalesce("_tools", F.array().cast("array<string>")), F.array().cast("array<string>")

    def supported(e: Column) -> Column:
        return F.coalesce(F.array_contains(usable, e["source_tool"]), F.lit(False))

    def evidence(r: Column) -> Column:
        return F.filter(r["evidence"], supported)

    def lost(r: Column) -> Column:
        gone = F.transform(
            F.filter(r["evidence"], lambda e: ~supported(e)),
            lambda e: F.concat(
                F.lit("dropped evidence for '"), F.coalesce(r["title"], F.lit("")), F.lit("' citing "), F.coalesce(e["source_tool"], F.lit("no tool")),
                F.lit(", which returned no usable result: '"), F.coalesce(e["fact"], F.lit("")), F.lit("'"),
            ),
        )
        bare = F.when(F.coalesce(F.size(evidence(r)), F.lit(0)) <= 0, F.array(F.concat(F.lit("risk '"), F.coalesce(r["title"], F.lit("")), F.lit("' has no supporting evidence left"))))
        return F.concat(F.coalesce(gone, empty), F.coalesce(bare, empty))

    def level(leg: Column) -> Column:
        return F.try_element_at(F.filter(c("_levels.candidates"), lambda x: x["name"] == leg["level_name"]), F.lit(1))["level"]

    def unknown(leg: Column) -> Column:
        text = F.format_string("hedge leg '%s %s' names an unknown level '%s', so it has no price", leg["action"], leg["instrument"], leg["level_name"])
        return F.when(leg["level_name"].isNotNull() & level(leg).isNull(), text)

    risks = F.transform("risks", lambda r: F.struct(r["title"].alias("title"), r["explanation"].alias("explanation"), evidence(r).alias("evidence")))
    legs = F.transform("legs", lambda x: F.struct(x["action"].alias("action"), x["instrument"].alias("instrument"), x["level_name"].alias("level_name"), level(x).alias("level")))
    said = [F.coalesce(F.flatten(F.transform("risks", lost)), empty), F.coalesce(F.array_compact(F.transform("legs", unknown)), empty)]
    before = F.coalesce("warnings", empty) if "warnings" in answers.columns else empty
    new = {"risks": risks, "legs": legs, "levels": c("_levels"), "data_gaps": F.coalesce(F.transform("_gaps", lambda g: g["gap"]), empty), "tools_called": usable, "warnings": F.concat(before, *said)}
    rest = [x for x in answers.columns if x not in new]
    return rows.select(*rest, *[v.alias(k) for k, v in new.items()])
