"""Line dedup as an exact set-similarity join: lines whose words are nearly those of an earlier line are removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerloom.llm.bitmaps import may_be_among
from ledgerloom.session import shared_dir, stored

#: Jaccard similarity of two lines' sets of words from which the later one goes, in percent, and the fewest
#: distinct words of a line that is compared: all that have a word.
PERCENT, LEAST_WORDS = 85, 1
#: Slots of the table of word frequencies; words that share one are ordered by its sum, which changes no result.
SLOTS = 1 << 16
#: What a line with a word holds.
WORD = r"[^\x20\x09-\x0D]"
#: Classes of frequency for each doubling; 127 classes reach past 10^12 words a slot.
CLASSES = 3

def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _frequencies(docs: DataFrame) -> DataFrame:
    """One row, ``levels``: for each slot, CLASSES times the binary logarithm of how many words of all texts fall in it."""
    hashed = docs.select(F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("word")).filter("word <> ''").select(F.xxhash64("word").bitwiseAND(F.lit(SLOTS - 1)).alias("slot"), F.lit(1).cast("long").alias("n"))
    every = hashed.unionByName(docs.sparkSession.range(SLOTS).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("n")))
    level = F.least((CLASSES * F.log2(F.sum("n") + 1)).cast("int"), F.lit(127)).cast("tinyint")
    listed = F.sort_array(F.collect_list(F.struct("slot", "level")))  # SLOTS rows, whatever the table's size
    return every.groupBy("slot").agg(level.alias("level")).agg(F.transform(listed, lambda x: x["level"]).alias("levels"))


def _codes(hashes: Column, levels: Column) -> Column:
    """32-bit codes of words that ascend with their frequency: its class, then 24 bits of the hash, in order.

    Words may share a code, which is then there twice: two sets share at least as many codes as words.
    """
    level = lambda h: F.get(levels, h.bitwiseAND(F.lit(SLOTS - 1)).cast("int")).cast("int")
    return F.sort_array(F.transform(hashes, lambda h: F.shiftleft(level(h), 24).bitwiseOR(F.shiftrightunsigned(h, 40).cast("int"))))


def _prefix(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / 100).cast("int") + 1


def _keys(id_col: str, text_col: str) -> list[Column]:
    """doc (the id, null last) and copy, which tells rows of one id with different texts apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64(text).alias("copy")]


def _compared(text: Column, least_words: int) -> Column:
    """The numbers, from 0, of a text's lines of at least ``least_words`` distinct words."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    enough = (lambda x: x.rlike(WORD)) if least_words == 1 else (lambda x: F.size(F.array_distinct(_words(F.lower(x)))) >= least_words)
    return F.array_compact(F.transform(F.split(text, "\n"), lambda x, k: F.when(enough(x), k))).alias("compared")


def _removed(keyed: DataFrame, docs: DataFrame, percent: int, least_words: int, id_col: str, text_col: str) -> DataFrame:
    """``removed`` in place of ``compared``, the lines that are compared: those that don't stay. ``keyed`` has doc and copy, too."""
    joined = keyed.join(_staying(docs, percent, least_words, id_col, text_col), ["doc", "copy"], "left")
    none = F.array().cast("array<int>")
    return joined.withColumn("removed", F.array_except("compared", F.coalesce("stay", none))).drop("stay", "compared")


def removed_lines(docs: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, copy, removed) of every text that loses lines, ``removed`` being its line numbers, ascending from 0.

    Lines are split at \\n, their words at space and 0x09-0x0D, case is folded. A line with at
    least ``least_words`` distinct words is removed if an earlier line (by id, then by hash of the
    text, then by line number) has a Jaccard similarity of ``percent`` or more; removed lines
    count as earlier lines too. A null id comes last; null and empty texts have no words; rows
    equal in id and text are one. Other columns are not read.
    """
    keyed = docs.select(*_keys(id_col, text_col), _compared(F.col(text_col), least_words))
    return _removed(keyed, docs, percent, least_words, id_col, text_col).filter(F.size("removed") > 0).dropDuplicates(["doc", "copy"])


def _staying(docs: DataFrame, percent: int, least_words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, copy, stay) of texts that have lines that are the first of their set of words and have no earlier match.

    Lines of equal word sets are one node. Nodes meet by the rarest words of each (prefix filter)
    where lengths and positions allow the similarity and the parities of their sets don't rule
    it out; sets so small that only equal ones reach the similarity meet none. A node needs one earlier match only, so where the earliest node of a bucket passes
    these filters it is the only one that a node meets there; other nodes meet all nodes of the
    bucket that pass and aren't of later texts. Nodes that were led so but found no earlier match meet all of their
    buckets afterwards. Lines that need it are looked up again in the texts, whole.
    """
    c = F.col
    spark = docs.sparkSession
    save = lambda df, name: stored(df, shared_dir(spark, name))
    texts = docs.select(*_keys(id_col, text_col), F.coalesce(c(text_col).cast("string"), F.lit("")).alias("text"))
    frequency = _frequencies(texts).scalar()

    def lines_of(table: DataFrame) -> DataFrame:
        return table.select("doc", "copy", F.posexplode(F.split(F.lower("text"), "\n")).alias("line", "said"))

    # told by a character, as a filter on the words would split and hash them twice
    worded = lines_of(texts).filter(c("said").rlike(WORD))
    hashed = worded.select("doc", "copy", "line", F.sort_array(F.array_distinct(F.transform(_words(c("said")), lambda w: F.xxhash64(w)))).alias("_set"))
    n = F.size("_set")
    bits = F.aggregate("_set", F.lit(0).cast("long"), lambda x, h: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))))
    lines = hashed.select("doc", "copy", "line", F.xxhash64("_set").alias("set"), n.alias("n"), bits.alias("bits"), "_set")
    # the levels are a subquery, which a lambda can't name itself; as a constant they would stand in every text of the plan
    codes = _codes(c("_set"), c("_levels"))
    lines = lines.withColumn("_levels", frequency).select("doc", "copy", "line", "set", "n", "bits", F.slice(codes, F.lit(1), _prefix(n, percent)).alias("prefix"))
    nodes = lines.groupBy("set").agg(F.min(F.struct("doc", "copy", "line")).alias("first"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix"))
    # short numbers that tell nodes apart take half a hash's room in all shuffles
    nodes = save(nodes.filter(c("n") >= least_words).select(F.monotonically_increasing_id().alias("node"), "first.*", "n", "bits", "prefix"), "line-nodes")
    near = (F.ceil(c("n") * percent / 100) < c("n")) | (F.floor(c("n") * 100 / percent) > c("n"))  # sets other than equal ones can be

    def coded(table: DataFrame) -> DataFrame:
        """A row for each code of each node's prefix."""
        return table.filter(near).select("node", "doc", "n", "bits", F.posexplode("prefix").alias("pos", "code"))

    # dealt once: what follows reads the same columns of the same shuffle, whose rows no join has to filter
    index = coded(nodes)
    index = index.filter(" and ".join(f"{k} is not null" for k in index.columns)).repartition("code")

    def alike(left: str, right: str) -> Column:
        """Lengths, positions and parities allow the similarity."""
        x, y = (lambda k: c(left + k)), (lambda k: c(right + k))
        sizes = 100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n"))
        reach = 1 + F.least(x("n") - x("pos") - 1, y("n") - y("pos") - 1) >= F.ceil((x("n") + y("n")) * percent / (100 + percent))
        return sizes & reach & (F.bit_count(x("bits").bitwiseXOR(y("bits"))) * (100 + percent) <= (x("n") + y("n")) * (100 - percent))

    row = ["doc", "node", "n", "bits", "pos"]
    side = lambda table, x: table.select("code", *(c(k).alias(f"{x}_{k}") for k in row))
    met = index.withColumn("hub", F.min(F.struct(*row)).over(Window.partitionBy("code")))
    led = met.withColumn("led", (c("hub.node") != c("node")) & alike("hub.", ""))
    rest = led.filter(~c("led") & (c("hub.node") != c("node")))
    earlier = (c("x_node") != c("y_node")) & (c("y_doc") <= c("x_doc"))
    apart = side(rest, "x").join(side(index, "y"), "code").filter(earlier & alike("x_", "y_")).select(c("x_node").alias("x"), c("y_node").alias("y"), F.lit(False).alias("hub"))
    pairs = led.filter("led").select(c("node").alias("x"), c("hub.node").alias("y"), F.lit(True).alias("hub")).unionByName(apart)
    led_by = lambda k: F.max(c("hub") & (c("x") == F.expr(k))).alias
    pairs = pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(led_by("least(x, y)")("a_led"), led_by("greatest(x, y)")("b_led"))
    pairs = save(pairs, "line-pairs")

    def later(pairs: DataFrame) -> DataFrame:
        """The later node of each pair (a, b) whose whole sets reach the similarity."""
        place = ["doc", "copy", "line"]
        wanted = pairs.select(c("a").alias("node")).union(pairs.select("b")).distinct()
        places = save(nodes.select("node", *place).join(wanted, "node"), "line-places")
        looked = may_be_among(lines_of(may_be_among(texts, places, ["doc", "copy"])), places, place)
        found = looked.join(places, place).dropDuplicates(place)
        found = save(found.select("node", F.struct(*place).alias("at"), F.size(F.array_distinct(_words(c("said")))).alias("n"), "said"), "line-sets")
        whole = lambda x: found.toDF(x, f"at_{x}", f"n_{x}", f"said_{x}")
        both = pairs.select("a", "b").join(whole("a"), "a").join(whole("b"), "b")
        shared = F.size(F.array_intersect(_words(c("said_a")), _words(c("said_b"))))
        enough = (100 + percent) * shared >= percent * (c("n_a") + c("n_b"))
        return save(both.filter(enough).select(F.when(c("at_a") > c("at_b"), c("a")).otherwise(c("b")).alias("node")).distinct(), "line-links")

    settled = later(pairs)
    again = pairs.filter("a_led").select(c("a").alias("node")).union(pairs.filter("b_led").select("b")).distinct()
    again = save(again.join(settled, "node", "left_anti"), "line-again")
    if not again.isEmpty():
        rest = save(side(coded(nodes.join(again, "node")), "x"), "line-rest")
        apart = rest.join(side(may_be_among(coded(nodes), rest, ["code"]), "y"), "code").filter(earlier & alike("x_", "y_"))
        more = apart.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
        settled = settled.union(later(save(more, "line-pairs"))).distinct()
    return nodes.join(settled, "node", "left_anti").groupBy("doc", "copy").agg(F.collect_list("line").alias("stay"))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the removed lines, by the limits of removed_lines; a row of which only blank lines would be left goes as a whole.

    All columns stay, whatever their names.
    """
    c = F.col
    keyed = docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row"), *_keys(id_col, text_col), _compared(c(text_col), least_words))
    joined = _removed(keyed, docs, percent, least_words, id_col, text_col)
    kept = F.array_join(F.filter(F.split(c("row")[text_col].cast("string"), "\n"), lambda x, k: ~F.array_contains("removed", k)), "\n")
    joined = joined.withColumn("kept", F.when(F.size("removed") > 0, kept))
    joined = joined.filter((F.size("removed") == 0) | c("kept").rlike(WORD))
    return joined.select(*(F.coalesce("kept", c("row")[x]).alias(x) if x == text_col else c("row")[x].alias(x) for x in docs.columns))


def op1_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines")
    keyed = docs.select("doc_id", lines, *_keys("doc_id", "text"), _compared(c("text"), LEAST_WORDS))
    return _removed(keyed, docs, PERCENT, LEAST_WORDS, "doc_id", "text").select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"))


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLE = {
    "op1_line_dedup": f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
    w AS (SELECT doc_id, line, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(t), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS ws FROM l),
    c AS (SELECT ws, len(ws) AS n, list_aggregate(list_transform(ws, lambda x: CAST(1 AS UBIGINT) << (hash(x) % 63)), 'bit_or') AS bits,
      row_number() OVER (ORDER BY min(doc_id), min((doc_id, line))) AS id, min((doc_id, line)) AS first FROM w WHERE len(ws) >= {LEAST_WORDS} GROUP BY ws),
    s AS MATERIALIZED (SELECT id, n, bits FROM c), t AS (SELECT *, unnest(range(CAST(ceil(n * {PERCENT} / 100) AS BIGINT), CAST(n * 100 // {PERCENT} AS BIGINT) + 1)) AS m FROM s),
    p AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM s a JOIN t b ON a.n = b.m AND a.id < b.id
      WHERE {100 + PERCENT} * bit_count(xor(a.bits, b.bits)) <= {100 - PERCENT} * (a.n + b.n)), -- sets differ in at least as many words as bits
    near AS (SELECT DISTINCT b.ws FROM p JOIN c a ON a.id = p.a JOIN c b ON b.id = p.b WHERE {100 + PERCENT} * len(list_intersect(a.ws, b.ws)) >= {PERCENT} * (a.n + b.n)),
    gone AS (SELECT w.doc_id, w.line FROM w JOIN c USING (ws) LEFT JOIN near ON near.ws = w.ws WHERE (w.doc_id, w.line) <> c.first OR near.ws IS NOT NULL),
    g AS (SELECT doc_id, count(*) AS n, string_agg(line, ',' ORDER BY line) AS removed FROM gone GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS BIGINT) AS n_lines, coalesce(g.n, 0) AS n_removed, coalesce(g.removed, '') AS removed
    FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id""",
}
