"""Secret scans: spans of keys in whole texts, and weaker parts of credentials where complementary parts stand near them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerloom.session import shared_dir, stored

#: Code points within which parts belong to one credential.
REACH = 400
MASK = "[SECRET]"


@dataclass(frozen=True)
class Kind:
    """One kind of span. ``group`` of a match has to be ``least`` long, and ``exactly`` so if given, with every one of ``holds`` in it."""

    name: str
    pattern: str
    part: str
    group: int = 0
    least: int = 0
    exactly: int = 0
    holds: tuple[str, ...] = ()


#: Reported wherever they are found.
BASE = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "secret", 2, 8),
    Kind("access", r"AKIA[A-Z0-9]+", "identifier", 0, 16),
    Kind("hex", r"[0-9a-f]{32,}", "secret"),
)
#: Weak alone: reported only near complementary parts.
WEAK = (
    Kind("account", r"""(?i:client_?id|user_?name|user_?id|account_?id|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", "identifier"),
    Kind("mixed40", r"[A-Za-z0-9+/]{40,}", "secret", 0, 40, 40, ("[A-Z]", "[a-z]", "[0-9]")),
    Kind("endpoint", r"""(?:https?|ftp|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D"'<>]+""", "endpoint"),
)
KINDS = (*BASE, *WEAK)
NEEDS = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}


def _matches(text: Column, order: int, kind: Kind) -> Column:
    """Of each match, in the order of the text: kind, number, code points between it and the match before, its own, and whether it counts."""
    pattern = F.lit(kind.pattern)
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, kind.pattern, -1)
    tested = F.regexp_extract_all(text, pattern, F.lit(kind.group)) if kind.group else found

    def one(pair: Column, at: Column) -> Column:
        ok = F.char_length(pair["2"]) >= kind.least
        if kind.exactly:
            ok = ok & (F.char_length(pair["2"]) == kind.exactly)
        for mark in kind.holds:
            ok = ok & pair["2"].rlike(mark)
        return F.struct(F.lit(order).alias("kind"), at.alias("i"), F.char_length(pair["1"]).cast("long").alias("gap"), F.char_length(pair["0"]).cast("long").alias("size"), ok.alias("ok"))

    zipped = F.slice(F.arrays_zip(found.alias("0"), between.alias("1"), tested.alias("2")), F.lit(1), F.size(found))
    return F.when(text.rlike(kind.pattern), F.transform(zipped, one))


def _row_key(id_col: str, text: Column) -> Column:
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.hex(F.xxhash64(text)))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> tuple[DataFrame, DataFrame]:
    """Every row's key, and the spans of each key that has any.

    The first table has ``id_col`` and ``_key`` for each row; the second ``_key`` and ``spans``,
    an array of (start, kind, end) sorted by start, then kind (its place in KINDS), in code points,
    end exclusive. Matches of one kind don't overlap, those of several may. Spans of BASE kinds
    are always there. A WEAK part is there if, in the same text and at most ``reach`` code
    points away, stands a part of each role that it needs: an identifier needs a secret, a
    secret an identifier, an endpoint both.

    Texts are scanned once, what is found (without the texts) is stored in the shared folder, and
    parts meet by an equi-join on text and stretch of ``reach`` code points. Rows equal in id
    and text share a key; null and empty texts have no spans; a null id is a key like others.
    """
    c = F.col
    text = F.coalesce(c(text_col).cast("string"), F.lit(""))
    hits = [F.coalesce(_matches(text, k, kind), F.array().cast("array<struct<kind:int,i:int,gap:bigint,size:bigint,ok:boolean>>")) for k, kind in enumerate(KINDS)]
    scanned = docs.select(id_col, _row_key(id_col, text).alias("_key"), F.concat(*hits).alias("_hits"))
    scanned = stored(scanned, shared_dir(docs.sparkSession, "secret-hits"))
    rows = scanned.filter(F.size("_hits") > 0).select("_key", "_hits").dropDuplicates(["_key"]).select("_key", F.inline("_hits"))
    upto = Window.partitionBy("_key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(c("gap") + c("size")).over(upto)
    role = F.element_at(F.array(*(F.lit(k.part) for k in KINDS)), c("kind") + 1)
    parts = rows.withColumn("end", end).filter("ok").select("_key", "kind", (c("end") - c("size")).alias("start"), "end", role.alias("role"))

    # both are sent to every stretch that they touch, parts with reach to either side, so any two that are near share one;
    # of the stretches that they share only the first makes a row
    stretches = lambda start, end: F.sequence(F.greatest(F.floor(start / reach), F.lit(0)), F.floor(end / reach))
    weak = parts.filter(c("kind") >= len(BASE)).withColumn("_bins", stretches(c("start"), c("end"))).withColumn("_from", c("_bins")[0]).withColumn("_bin", F.explode("_bins")).drop("_bins")
    near = parts.select("_key", c("role").alias("_role"), c("start").alias("_start"), c("end").alias("_end"), stretches(c("start") - reach, c("end") + reach).alias("_bins"))
    near = near.withColumn("_near_from", c("_bins")[0]).withColumn("_near_bin", F.explode("_bins")).drop("_bins").withColumnRenamed("_key", "_near_key")
    apart = F.greatest(c("_start") - c("end"), c("start") - c("_end"))
    here = (c("_key") == c("_near_key")) & (c("_bin") == c("_near_bin")) & (c("_bin") == F.greatest("_from", "_near_from"))
    met = weak.join(near, here & (c("_role") != c("role")) & (apart <= reach))
    met = met.groupBy("_key", "kind", "start", "end", "role").agg(*(F.max(c("_role") == r).alias(f"_{r}") for r in ("identifier", "secret")))
    wanted = F.lit(False)
    for part, needs in NEEDS.items():
        here = c("role") == part
        for need in needs:
            here = here & c(f"_{need}")
        wanted = wanted | here
    reported = parts.filter(c("kind") < len(BASE)).select("_key", "kind", "start", "end").unionByName(met.filter(wanted).select("_key", "kind", "start", "end"))
    return scanned.select(id_col, "_key"), reported.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = MASK) -> DataFrame:
    """All rows and columns of ``docs``, with every reported span of the text replaced by ``mask`` (overlapping spans by one).

    Null texts stay null. The widest shuffle is one of the table by row key.
    """
    c = F.col
    _, spans = find_spans(docs, id_col, text_col)
    keyed = docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row"), c(text_col).alias("text"), _row_key(id_col, F.coalesce(c(text_col).cast("string"), F.lit(""))).alias("_key"))
    joined = keyed.join(spans, "_key", "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(done: Column, s: Column) -> Column:
        kept = F.substring("text", (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        fresh = s["start"] >= done["at"]
        return F.struct(F.when(fresh, F.concat(done["out"], kept, F.lit(mask))).otherwise(done["out"]).alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    rest = lambda done: F.concat(done["out"], F.substring("text", (done["at"] + 1).cast("int"), F.char_length("text")))
    masked = F.when(c("spans").isNull(), c("text")).otherwise(F.aggregate("spans", start, step, rest))
    return joined.select(*(masked.alias(x) if x == text_col else c("row")[x].alias(x) for x in docs.columns))


def op4_secret_scans(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows, spans = find_spans(spark.read.parquet(f"{d}/documents.parquet"))
    found = rows.join(spans, "_key", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{kind.name}") for k, kind in enumerate(BASE)),
        F.sha2(span_text(F.filter("spans", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"), span_text(c("spans")).alias("spans"),
    )


QUERIES = {"op4_secret_scans": op4_secret_scans}


def _sql_hits() -> str:
    one = """SELECT doc_id, {k} AS kind, '{part}' AS role, regexp_extract_all(text, '{re}') AS ms, regexp_split_to_array(text, '{re}') AS ps,
      list_transform(regexp_extract_all(text, '{re}', {group}), lambda x: length(x) >= {least}{more}) AS ok FROM d WHERE regexp_matches(text, '{re}')"""
    return " UNION ALL ".join(
        one.format(
            k=k, part=kind.part, group=kind.group, least=kind.least, re=kind.pattern.replace("'", "''"),
            more=(f" AND length(x) = {kind.exactly}" if kind.exactly else "") + "".join(f" AND regexp_matches(x, '{h}')" for h in kind.holds),
        )
        for k, kind in enumerate(KINDS)
    )


_LISTED = "CASE kind " + " ".join(f"WHEN {k} THEN '{kind.name}'" for k, kind in enumerate(KINDS)) + " END || ':' || s || ':' || e, ',' ORDER BY s, kind"
ORACLE = {
    "op4_secret_scans": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), h AS ({_sql_hits()}),
    i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM h),
    p AS (SELECT doc_id, kind, role, e - length(ms[i]) AS s, e FROM (
      SELECT *, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))) AS BIGINT) AS e FROM i WHERE ok[i])),
    near AS (SELECT a.*, list(DISTINCT b.role) AS roles FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.kind >= {len(BASE)} AND a.role <> b.role AND greatest(b.s - a.e, a.s - b.e) <= {REACH} GROUP BY ALL),
    r AS (SELECT doc_id, kind, s, e FROM p WHERE kind < {len(BASE)} UNION ALL SELECT doc_id, kind, s, e FROM near
      WHERE (role = 'identifier' AND list_contains(roles, 'secret')) OR (role = 'secret' AND list_contains(roles, 'identifier')) OR (role = 'endpoint' AND len(list_filter(roles, lambda x: x <> 'endpoint')) = 2)),
    g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
      coalesce(string_agg({_LISTED}) FILTER (kind < {len(BASE)}), '') AS base, string_agg({_LISTED}) AS spans FROM r GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g ON d.doc_id = g.doc_id""",
}
