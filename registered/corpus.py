"""Corpus queries: functions, docstrings, chat records, splits, near copies, scores, tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.texts import unwrapped, word_tokens
from ledgerloom.operators import corpus as C
from ledgerloom.operators import scores as S
from ledgerloom.operators import similar as M
from ledgerloom.plans import bindings as D
from ledgerloom.session import shared_dir, spread, stored


def _functions(spark, d):
    return D.part_functions(spark, d)


def _routed(spark, d):
    return C.route_functions(_functions(spark, d).select("topic", "kind", "level", "seq", "code"))


def _checked(spark, d):
    docs = D.part_docstrings(spark, d)
    return C.check_docstrings(C.with_code_facts(docs.select("seq", "kind", "topic", "level", "code", "docstring")))


def code_facts(spark, d):
    f = C.with_code_facts(_functions(spark, d).select("seq", "code"))
    c = F.col("facts")
    return f.select(
        "seq", c["name"].alias("name"), F.array_join(c["params"], ",").alias("params"), c["is_async"].alias("is_async"),
        c["is_generator"].alias("is_generator"), c["returns_value"].alias("returns_value"),
        F.array_join(c["raises"], ",").alias("raises"), c["has_docstring"].alias("has_docstring"),
        c["code_lines"].alias("code_lines"), F.array_join(c["modules"], ",").alias("modules"), c["error"].alias("error"),
    )


def reject_reasons(spark, d):
    f = C.with_code_facts(_functions(spark, d).select("seq", "kind", "code"))
    return f.select("seq", C.reject_reason(F.col("kind")).alias("reason"))


def _slotted(spark, d):
    """Every part with a topic of its own size class, so that many slots exist."""
    return _functions(spark, d).withColumn("topic", F.concat_ws("_", "topic", F.col("size").cast("string")))


def routed_functions(spark, d):
    routed = C.route_functions(_slotted(spark, d).select("topic", "kind", "level", "seq", "code"))
    return routed.select("id", "seq", "status", "reason")


def routed_with_stored_names(spark, d):
    stored = D.table(spark, d, "part").where("p_brand = 'Brand#1'").select(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string")).alias("name")
    )
    routed = C.route_functions(_slotted(spark, d).select("topic", "kind", "level", "seq", "code"), stored)
    return routed.select("id", "status", "reason")


def reject_histogram(spark, d):
    return C.reject_histogram(C.route_functions(_slotted(spark, d).select("topic", "kind", "level", "seq", "code")))


def recipe_grid(spark, d):
    return C.recipe_grid(D.table(spark, d, "part").select(F.lower("p_name").alias("topic")))


def open_cells(spark, d):
    grid = C.recipe_grid(D.table(spark, d, "part").select(F.lower("p_name").alias("topic")))
    done = _functions(spark, d).where("size < 20").select(F.regexp_extract("fn", r"^([a-z]+)_([a-z]+)_", 1).alias("x"), F.regexp_extract("fn", r"^([a-z]+)_([a-z]+)_", 2).alias("y"), "kind")
    return C.open_cells(grid, done.select(F.concat_ws(" ", "x", "y").alias("topic"), "kind"))


def unwrapped_answers(spark, d):
    return D.part_docstrings(spark, d).select("seq", unwrapped(F.col("docstring")).alias("text"))


def docstring_claims(spark, d):
    c = F.col("claims")
    return D.part_docstrings(spark, d).withColumn("claims", C.docstring_claims(F.col("docstring"))).select(
        "seq", c["summary"].alias("summary"), F.array_join(c["args"], ",").alias("args"),
        c["has_returns"].alias("has_returns"), c["has_yields"].alias("has_yields"), F.array_join(c["raises"], ",").alias("raises"),
    )


def checked_docstrings(spark, d):
    return _checked(spark, d).select(
        "seq", "label", F.array_join("missing", ";").alias("missing"), F.array_join("invented", ";").alias("invented")
    )


def rendered_docstrings(spark, d):
    return D.part_docstrings(spark, d).select("seq", unwrapped(F.col("docstring")).alias("docstring"))


def function_name_words(spark, d):
    f = C.with_code_facts(_functions(spark, d).select("seq", "code"))
    return C.name_words(f).select("word", "uses")


def top_name_words(spark, d):
    f = C.with_code_facts(_functions(spark, d).select("seq", "code"))
    return C.most_common(C.name_words(f), "uses", "first", 20).select("word", "uses")


def modules_used(spark, d):
    f = C.with_code_facts(_functions(spark, d).select("seq", "code"))
    return C.most_common(C.modules_used(f), "functions", "first", 15).select("module", "functions")


def _labels(spark, d):
    return _checked(spark, d).select(F.col("seq").alias("id"), "docstring", "label", "missing", "invented", "kind", "level", "topic")


def _as_functions(spark, d):
    return _functions(spark, d).select(F.col("seq").alias("id"), "topic", "kind", "level", "code")


def chat_records(spark, d):
    records = C.chat_records(_as_functions(spark, d), _labels(spark, d), "Write a docstring.")
    return records.select(
        "id", "kind", F.size("messages").alias("turns"), F.col("messages")[0]["content"].alias("system"),
        F.col("messages")[2]["role"].alias("last_role"), F.length(F.col("messages")[2]["content"]).alias("answer_chars"),
    )


def orphan_labels(spark, d):
    return C.orphan_labels(_as_functions(spark, d).where("level <> 'tricky'"), _labels(spark, d)).select("id", "label")


def unlabelled_functions(spark, d):
    return C.unlabelled(_as_functions(spark, d), _labels(spark, d).where("label = 'correct'")).select("id")


def conversation_messages(spark, d):
    m = C.turns_to_messages(D.table(spark, d, "conversations"))
    return m.select("conv_id", F.size("messages").alias("turns"), F.col("messages")[0]["role"].alias("first_role"),
                    F.md5(C.chat_text(F.col("messages"))).alias("text_md5"))


def prompt_prefix_check(spark, d):
    """Conversations whose third turn is not the assistant's break the prefix rule."""
    m = C.turns_to_messages(D.table(spark, d, "conversations"))
    return C.prefix_violations(m).select("conv_id")


def stratified_split(spark, d):
    docs = D.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"))
    return C.stratified_split(docs)


def split_sizes(spark, d):
    docs = D.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("kind"))
    return S.split_sizes(C.stratified_split(docs))


def token_lengths(spark, d):
    return C.token_lengths(D.table(spark, d, "conversations"), ["text"]).select("conv_id", "turn", "text_tokens", "total_tokens")


def _lengths(spark, d):
    df = D.part_docstrings(spark, d).select("seq", "level", "topic", "kind", "code", "docstring")
    return C.token_lengths(df, ["code", "docstring"])


def described_lengths(spark, d):
    out = S.describe(_lengths(spark, d), ["code_tokens", "docstring_tokens", "total_tokens"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "p50", "p75")})


def length_histogram(spark, d):
    return S.histogram(_lengths(spark, d), "code_tokens", ["level"])


def topic_kind_crosstab(spark, d):
    return S.crosstab_with_margins(_functions(spark, d), "topic", "kind")


def level_counts(spark, d):
    return _functions(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("examples"))


def corpus_funnel(spark, d):
    return C.funnel(_routed(spark, d), _labels(spark, d))


def label_counts(spark, d):
    return S.label_table(_labels(spark, d), ["kind"]).withColumn("share_hallucinated", F.round("share_hallucinated", 6))


def common_errors(spark, d):
    return S.common_errors(_checked(spark, d))


def dropped_examples(spark, d):
    return _labels(spark, d).where("label <> 'correct'").orderBy("id").limit(3).select("id", "label")


def review_sample(spark, d):
    return S.review_sample(D.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"))


def review_agreement(spark, d):
    review = D.table(spark, d, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "hallucinated").when(F.col("quality") == 0, "partial").otherwise("correct").alias("label")
    )
    return S.label_agreement(review, _labels(spark, d)).select("id", "label", "checker", "agree")


def hallucination_rate(spark, d):
    review = D.table(spark, d, "labels").select(F.when(F.col("toxic") == 1, "hallucinated").otherwise("correct").alias("label"))
    out = S.hallucination_rate(review)
    return out.withColumn("rate", F.round("rate", 6))


def _score_pairs(spark, d):
    """Assistant turns beside the turn before them: the earlier turn is the reference."""
    t = D.table(spark, d, "conversations")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return t.where("role = 'assistant'").join(before, ["conv_id", "turn"]).withColumnRenamed("text", "prediction")


def rouge_l(spark, d):
    out = S.with_rouge_l(_score_pairs(spark, d), "prediction", "reference", stemmed=False)
    return out.select("conv_id", "turn", F.round("rouge_l", 6).alias("rouge_l"))


def rouge_l_documents(spark, d):
    """Every document against the text of the same source and language with the next number."""
    docs = spread(D.table(spark, d, "documents").select("doc_id", "text"))
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("reference"))
    out = S.with_rouge_l(docs.join(nxt, "doc_id"), "text", "reference")
    return out.select("doc_id", F.round("rouge_l", 6).alias("rouge_l"))


def _wide_scores(spark, d):
    """Two score columns per document, derived from its length and line counts."""
    return D.table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("kind"),
        (F.col("n_chars") % 101 / 100.0).alias("base_score"),
        (F.length(F.regexp_replace("text", "[^e]", "")) / F.length("text")).alias("tuned_score"),
    )


def score_table(spark, d):
    long = S.long_scores(_wide_scores(spark, d), {"base": "base_score", "tuned": "tuned_score"}, ["kind"])
    out = S.score_table(long, ["model"])
    return out.select("model", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("min", 6).alias("min"))


def scores_by_kind(spark, d):
    long = S.long_scores(_wide_scores(spark, d), {"base": "base_score", "tuned": "tuned_score"}, ["kind"])
    out = S.score_table(long, ["kind", "model"])
    return out.select("kind", "model", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


def _log(spark, d):
    """Orders as a training log: one run per customer segment, one epoch per year."""
    o = D.table(spark, d, "orders").join(D.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return o.select(
        F.col("c_mktsegment").alias("run"),
        (F.year("o_orderdate") - 1995 + F.when(F.col("o_orderkey") % 2 == 0, 0.25).otherwise(-0.25)).alias("epoch"),
        F.col("o_orderkey").alias("step"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("loss"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).alias("eval_loss"),
    )


def epoch_losses(spark, d):
    return S.epoch_losses(_log(spark, d))


def loss_check(spark, d):
    return S.loss_check(S.epoch_losses(_log(spark, d)))


def answer_share(spark, d):
    out = S.answer_share(_lengths(spark, d), "docstring_tokens", "total_tokens", 2048)
    return out.withColumn("share", F.round("share", 6))


def prediction_export(spark, d):
    checked = stored(_checked(spark, d).select("seq", "code", "docstring", "label"), shared_dir(spark, "checked"))
    predictions = checked.select(F.col("seq").alias("id"), "code", "docstring")
    scores = _wide_scores(spark, d).select("id", "base_score")
    checks = checked.select(F.col("seq").alias("id"), "label")
    return S.prediction_export(predictions, scores, checks).select(
        "id", F.length("code").alias("code_chars"), F.round("base_score", 6).alias("base_score"), "label"
    )


def prompt_table(spark, d):
    """One filled prompt per conversation with its turns as a numbered list."""
    c = F.col
    m = C.turns_to_messages(D.table(spark, d, "conversations"))
    text = C.filled_template(
        "Conversation {id}:\n{turns}\nLabel {{each}} turn.",
        {"id": c("conv_id"), "turns": C.numbered_list(F.transform("messages", lambda t: t["role"]))},
    )
    return m.select("conv_id", text.alias("prompt"))


def _lines(spark, d):
    split = D.table(spark, d, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    return split.withColumn("line_no", (F.col("line_no") + 1).cast("bigint"))


def marker_audit(spark, d):
    """License and copyright lines as markers; labelled documents are the index."""
    index = D.table(spark, d, "documents").join(D.table(spark, d, "labels"), "doc_id").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path")
    )
    return C.marker_problems(_lines(spark, d), r"(?i)(license|copyright)", r"(19|20)[0-9][0-9]", index)


def similar_pairs(spark, d):
    """All pairs of distinct texts with similarity of at least 0.8."""
    docs = spread(D.table(spark, d, "documents"))
    reps = M.distinct_sets(M.shingle_sets(docs, "doc_id", "text", threshold=M.NEAR_COPY))
    pairs = M.similar_sets(reps, texts=docs.select(F.col("doc_id").alias("id"), "text"))
    return pairs.withColumn("similarity", F.round("similarity", 6))


def most_similar_pairs(spark, d):
    out = M.most_similar_pairs(spread(D.table(spark, d, "documents")), 5, "doc_id", "text", store=shared_dir(spark, "sets"))
    return out.withColumn("similarity", F.round("similarity", 6))


def most_similar_200_pairs(spark, d):
    out = M.most_similar_pairs(spread(D.table(spark, d, "documents")), 200, "doc_id", "text", store=shared_dir(spark, "sets"))
    return out.withColumn("similarity", F.round("similarity", 6))


def most_similar_items(spark, d):
    """A table without near copies: the best pairs are far from alike."""
    out = M.most_similar_pairs(D.table(spark, d, "benchmark"), 20, "item_id", "text", store=shared_dir(spark, "sets"))
    return out.withColumn("similarity", F.round("similarity", 6))


def near_copies_found(spark, d):
    return M.has_near_copies(stored(M.shingle_sets(spread(D.table(spark, d, "pages")), "page_id", "html"), shared_dir(spark, "sets")))


PARTS = """p0 AS (SELECT p_partkey AS seq, lower(p_type) AS topic, CASE WHEN p_size < 17 THEN 'simple' WHEN p_size < 34 THEN 'medium' ELSE 'tricky' END AS level,
    replace(p_name, ' ', '_') || '_' || p_size AS fn, CAST(p_partkey % 4 AS INT) AS k, p_size AS size, p_brand AS brand, p_retailprice > 950 AS raising FROM part),
p AS (SELECT *, CASE WHEN brand = 'Brand#3' THEN (k + 1) % 4 ELSE k END AS shape, (['function', 'method', 'generator', 'async'])[k + 1] AS kind FROM p0),
f AS (SELECT *, brand = 'Brand#9' AS bad, CASE WHEN size % 2 = 0 THEN 'ValueError' ELSE 'BadPart' END AS exc,
    2 + size % 43 + CASE WHEN raising THEN 2 ELSE 0 END + CASE WHEN brand = 'Brand#7' THEN 1 ELSE 0 END + 1 AS code_lines,
    (['q,r', 'q', 'q,rest', 'q,key,extra'])[shape + 1] AS params, shape <> 2 AND size % 5 <> 0 AS returns_value FROM p)"""
REASON = """r AS (SELECT *, CASE WHEN bad THEN 'not one valid function: code must be exactly one top-level function' WHEN brand = 'Brand#7' THEN 'already has a docstring'
    WHEN code_lines NOT BETWEEN 5 AND 40 THEN code_lines || ' lines, outside 5-40' WHEN shape <> k THEN 'does not match kind ''' || kind || '''' END AS reason FROM f)"""


def _route(topic: str, stored: str = "") -> str:
    taken = f"AND fn NOT IN ({stored})" if stored else ""
    return f"""{PARTS}, {REASON},
s AS (SELECT *, {topic} AS tp, row_number() OVER (PARTITION BY {topic}, kind, level ORDER BY seq) AS n FROM r),
w AS (SELECT fn, min(seq) AS seq, true AS won FROM s WHERE n <= 2 AND reason IS NULL {taken} GROUP BY fn),
routed AS (SELECT tp || '-' || kind || '-' || level || '-' || printf('%02d', n) AS id, s.seq, CASE WHEN s.reason IS NOT NULL THEN s.reason WHEN won IS NULL THEN 'duplicate function name ''' || s.fn || '''' END AS reason
  FROM s LEFT JOIN w ON w.seq = s.seq WHERE n <= 2),
late AS (SELECT seq, 'beyond the 2 arrivals of its slot' AS reason FROM s WHERE n > 2)"""


CHECK = f"""{PARTS}, dc AS (SELECT *, CASE WHEN brand = 'Brand#5' THEN 'q' WHEN brand = 'Brand#6' THEN params || ',ghost' ELSE params END AS dargs,
    CASE WHEN brand = 'Brand#13' THEN NULL WHEN (raising AND brand <> 'Brand#4') OR brand = 'Brand#10' THEN exc ELSE '' END AS draises, shape = 2 AND brand <> 'Brand#8' AS dyields FROM f),
ck AS (SELECT *, CASE WHEN bad OR brand = 'Brand#13' THEN '' ELSE concat_ws(';', CASE WHEN brand = 'Brand#5' AND length(params) > 1 THEN 'arg ' || replace(substr(params, 3), ',', ';arg ') END,
      CASE WHEN shape = 2 AND NOT dyields THEN 'Yields' END, CASE WHEN raising AND draises = '' THEN 'raises ' || exc END) END AS missing,
    CASE WHEN bad OR brand = 'Brand#13' THEN '' ELSE concat_ws(';', CASE WHEN brand = 'Brand#6' THEN 'arg ghost' END, CASE WHEN NOT raising AND draises <> '' THEN 'raises ' || exc END) END AS invented FROM dc),
lb AS (SELECT *, CASE WHEN bad OR brand = 'Brand#13' THEN 'unparseable' WHEN invented <> '' THEN 'hallucinated' WHEN missing <> '' THEN 'partial' ELSE 'correct' END AS label FROM ck)"""
DOC = """dd AS (SELECT *, CASE WHEN size % 2 = 0 THEN 'ValueError' ELSE 'errors.BadPart' END AS exc9, (['q,r', 'q', 'q,*rest', 'q,key,**extra'])[shape + 1] AS star FROM f),
doc AS (SELECT *, concat_ws(chr(10) || chr(10), 'Handle ' || fn || '.', CASE WHEN size % 4 = 0 THEN 'More about it.' END,
    'Args:' || chr(10) || array_to_string(list_transform(string_split(CASE WHEN brand = 'Brand#5' THEN 'q' WHEN brand = 'Brand#6' THEN star || ',ghost' ELSE star END, ','), lambda a: '    ' || a || ': a value'), chr(10)),
    CASE WHEN returns_value THEN 'Returns:' || chr(10) || '    the value' END, CASE WHEN shape = 2 AND brand <> 'Brand#8' THEN 'Yields:' || chr(10) || '    values' END,
    CASE WHEN (raising AND brand <> 'Brand#4') OR brand = 'Brand#10' THEN 'Raises:' || chr(10) || '    ' || exc9 || ': the part is bad' END) AS body FROM dd),
txt AS (SELECT *, CASE WHEN brand = 'Brand#13' THEN 'Args:' || chr(10) || '    q: alone' ELSE body END AS clean,
    CASE brand WHEN 'Brand#11' THEN '```python' || chr(10) || body || chr(10) || '```' WHEN 'Brand#12' THEN '\"\"\"' || body || chr(10) || '\"\"\"' WHEN 'Brand#13' THEN 'Args:' || chr(10) || '    q: alone' ELSE body END AS docstring FROM doc),
src AS (SELECT *, CASE WHEN bad THEN 'x = 1' || chr(10) ELSE (['def ' || fn || '(q, r=1):', 'def ' || fn || '(self, q):', 'def ' || fn || '(q, *rest):', 'async def ' || fn || '(q, *, key=None, **extra):'])[shape + 1] || chr(10)
    || CASE WHEN brand = 'Brand#7' THEN '    \"\"\"Already documented.\"\"\"' || chr(10) ELSE '' END || '    x = 1' || chr(10) || chr(10)
    || repeat('    x = ' || (['math.sqrt', 'json.dumps', 'text.split'])[size % 3 + 1] || '(q)' || chr(10), size % 43)
    || CASE WHEN raising THEN '    if q is None:' || chr(10) || '        raise ' || exc9 || '(''bad part'')' || chr(10) ELSE '' END
    || CASE WHEN shape = 2 THEN '    yield x' WHEN size % 5 = 0 THEN '    return None' ELSE '    return x' END || chr(10) END AS code FROM txt),
len AS (SELECT *, len(regexp_extract_all(code, '[\\pL\\pN_]+|[^\\pL\\pN_\\s]')) AS code_tokens, len(regexp_extract_all(docstring, '[\\pL\\pN_]+|[^\\pL\\pN_\\s]')) AS docstring_tokens FROM src)"""
GRAMS = """t AS (SELECT {key} AS id, regexp_replace({text}, '[\\s\\x{{85}}\\pZ\\x{{1c}}-\\x{{1f}}]+', ' ', 'g') AS s FROM {src}),
g AS (SELECT id, list_sort(list_distinct(list_transform(range(0, greatest(length(s) - 5, 0) + 1), lambda i: hash(s[i + 1 : i + 5])))) AS grams FROM t),
reps AS (SELECT grams, min(id) AS id, len(any_value(grams)) AS n, list_sort(list(id)) AS ids FROM g GROUP BY grams),
bits AS (SELECT id, bitstring_agg(CAST(h % 8192 AS INT), 0, 8191) AS bits FROM (SELECT id, unnest(grams) AS h FROM reps) GROUP BY id),
near AS MATERIALIZED (SELECT a.id AS p, b.id AS q FROM (SELECT id, n, bits FROM reps JOIN bits USING (id)) a JOIN (SELECT id, n, bits FROM reps JOIN bits USING (id)) b
  ON a.id < b.id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) AND bit_count(xor(a.bits, b.bits)) <= 0.2 / 1.8 * (a.n + b.n) + 0.001),
pairs AS (SELECT p AS a, q AS b, a.ids AS ia, b.ids AS ib, a.n AS an, b.n AS bn, len(list_intersect(a.grams, b.grams)) AS x FROM near JOIN reps a ON a.id = p JOIN reps b ON b.id = q),
sim AS (SELECT *, x / (an + bn - x)::DOUBLE AS s FROM pairs WHERE x / (an + bn - x)::DOUBLE >= 0.8),
every AS (SELECT ids[i] AS a, ids[j] AS b, 1.0::DOUBLE AS s FROM (SELECT ids, unnest(range(1, len(ids) + 1)) AS i FROM reps), LATERAL (SELECT unnest(range(i + 1, len(ids) + 1)) AS j)
  UNION ALL SELECT least(x, y), greatest(x, y), s FROM (SELECT unnest(ia) AS x, ib, s FROM sim), LATERAL (SELECT unnest(ib) AS y))"""
DOC_GRAMS = GRAMS.format(key="doc_id", text="text", src="documents")
SPLIT = """s AS (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY md5('42:' || id), id) AS r, round_even(count(*) OVER (PARTITION BY kind) * 0.1, 0) AS m FROM x),
sp AS (SELECT id, kind, CASE WHEN r <= m THEN 'test' WHEN r <= 2 * m THEN 'val' ELSE 'train' END AS split FROM s)"""
MSG = """m AS (SELECT conv_id, count(*) AS turns, arg_min(role, turn) AS first_role, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS full_text,
    max(CASE WHEN turn = 2 THEN role END) AS third FROM conversations GROUP BY conv_id)"""
WIDE = """ws AS (SELECT doc_id AS id, lang AS kind, (n_chars % 101) / 100.0::DOUBLE AS base_score, length(regexp_replace(text, '[^e]', '', 'g')) / length(text)::DOUBLE AS tuned_score FROM documents),
ls AS (SELECT id, kind, 'base' AS model, base_score AS score FROM ws UNION ALL SELECT id, kind, 'tuned', tuned_score FROM ws)"""
LOG = """lg AS (SELECT c_mktsegment AS run, CAST(round_even(year(o_orderdate) - 1995 + CASE WHEN o_orderkey % 2 = 0 THEN 0.25 ELSE -0.25 END, 0) AS INT) AS epoch, o_orderkey AS step, o_orderstatus AS st, o_totalprice AS v FROM orders JOIN customer ON c_custkey = o_custkey),
lo AS (SELECT run, epoch, arg_max(v, step) FILTER (st = 'F') AS train_loss, arg_max(v, step) FILTER (st = 'O') AS val_loss FROM lg GROUP BY run, epoch HAVING count(*) FILTER (st = 'O') > 0)"""

QUERIES = {
    "code_facts": code_facts,
    "reject_reasons": reject_reasons,
    "routed_functions": routed_functions,
    "routed_with_stored_names": routed_with_stored_names,
    "reject_histogram": reject_histogram,
    "recipe_grid": recipe_grid,
    "open_cells": open_cells,
    "unwrapped_answers": unwrapped_answers,
    "docstring_claims": docstring_claims,
    "checked_docstrings": checked_docstrings,
    "rendered_docstrings": rendered_docstrings,
    "function_name_words": function_name_words,
    "top_name_words": top_name_words,
    "modules_used": modules_used,
    "chat_records": chat_records,
    "orphan_labels": orphan_labels,
    "unlabelled_functions": unlabelled_functions,
    "conversation_messages": conversation_messages,
    "prompt_prefix_check": prompt_prefix_check,
    "stratified_split": stratified_split,
    "split_sizes": split_sizes,
    "token_lengths": token_lengths,
    "described_lengths": described_lengths,
    "length_histogram": length_histogram,
    "topic_kind_crosstab": topic_kind_crosstab,
    "level_counts": level_counts,
    "corpus_funnel": corpus_funnel,
    "label_counts": label_counts,
    "common_errors": common_errors,
    "dropped_examples": dropped_examples,
    "review_sample": review_sample,
    "review_agreement": review_agreement,
    "hallucination_rate": hallucination_rate,
    "rouge_l": rouge_l,
    "rouge_l_documents": rouge_l_documents,
    "score_table": score_table,
    "scores_by_kind": scores_by_kind,
    "epoch_losses": epoch_losses,
    "loss_check": loss_check,
    "answer_share": answer_share,
    "prediction_export": prediction_export,
    "prompt_table": prompt_table,
    "marker_audit": marker_audit,
    "similar_pairs": similar_pairs,
    "most_similar_pairs": most_similar_pairs,
    "most_similar_200_pairs": most_similar_200_pairs,
    "most_similar_items": most_similar_items,
    "near_copies_found": near_copies_found,
}

_WORDS = "wd AS (SELECT seq, unnest(string_split(fn, '_')) AS word, generate_subscripts(string_split(fn, '_'), 1) AS place FROM f WHERE NOT bad)"
_STOP = "'get', 'set', 'to', 'from', 'by', 'of', 'and', 'the', 'for', 'in', 'is', 'a'"

ORACLE = {
    "code_facts": f"""WITH {PARTS} SELECT seq, CASE WHEN NOT bad THEN fn END AS name, CASE WHEN NOT bad THEN params END AS params, CASE WHEN NOT bad THEN shape = 3 END AS is_async, CASE WHEN NOT bad THEN shape = 2 END AS is_generator,
      CASE WHEN NOT bad THEN returns_value END AS returns_value, CASE WHEN NOT bad THEN CASE WHEN raising THEN exc ELSE '' END END AS raises, CASE WHEN NOT bad THEN brand = 'Brand#7' END AS has_docstring, CASE WHEN NOT bad THEN code_lines END AS code_lines,
      CASE WHEN NOT bad THEN CASE WHEN size % 43 = 0 THEN '' WHEN size % 3 = 0 THEN 'math' WHEN size % 3 = 1 THEN 'json' ELSE '' END END AS modules, CASE WHEN bad THEN 'code must be exactly one top-level function' END AS error FROM f""",
    "reject_reasons": f"WITH {PARTS}, {REASON} SELECT seq, reason FROM r",
    "routed_functions": f"WITH {_route('topic || chr(95) || size')} SELECT id, seq, CASE WHEN reason IS NULL THEN 'kept' ELSE 'rejected' END AS status, reason FROM routed UNION ALL SELECT NULL, seq, 'ignored', reason FROM late",
    "routed_with_stored_names": f"""WITH {_route("topic || chr(95) || size", "SELECT replace(p_name, ' ', '_') || '_' || p_size FROM part WHERE p_brand = 'Brand#1'")} SELECT id, CASE WHEN reason IS NULL THEN 'kept' ELSE 'rejected' END AS status, reason FROM routed UNION ALL SELECT NULL, 'ignored', reason FROM late""",
    "reject_histogram": f"""WITH {_route('topic || chr(95) || size')} SELECT trim(regexp_replace(reason, ' ''.*''|: .*|\\d+', '', 'g')) AS reason, count(*) AS functions FROM routed WHERE reason IS NOT NULL GROUP BY 1""",
    "recipe_grid": """SELECT topic, kind, level, n, topic || '-' || kind || '-' || level || '-' || printf('%02d', n) AS id FROM (SELECT DISTINCT lower(p_name) AS topic FROM part)
      CROSS JOIN (VALUES ('function'), ('method'), ('generator'), ('async')) k(kind) CROSS JOIN (VALUES ('simple'), ('medium'), ('tricky')) l(level) CROSS JOIN (VALUES (1), (2)) n(n)""",
    "open_cells": f"""WITH {PARTS} SELECT topic, kind FROM (SELECT DISTINCT lower(p_name) AS topic FROM part) CROSS JOIN (VALUES ('function'), ('method'), ('generator'), ('async')) k(kind)
      EXCEPT SELECT p_name, kind FROM p JOIN part ON p_partkey = seq WHERE size < 20""",
    "unwrapped_answers": f"WITH {PARTS}, {DOC} SELECT seq, clean AS text FROM txt",
    "docstring_claims": f"""WITH {CHECK} SELECT seq, CASE WHEN brand <> 'Brand#13' THEN 'Handle ' || fn || '.' END AS summary, CASE WHEN brand <> 'Brand#13' THEN dargs END AS args,
      CASE WHEN brand <> 'Brand#13' THEN returns_value END AS has_returns, CASE WHEN brand <> 'Brand#13' THEN dyields END AS has_yields, draises AS raises FROM ck""",
    "checked_docstrings": f"WITH {CHECK} SELECT seq, label, missing, invented FROM lb",
    "rendered_docstrings": f"WITH {PARTS}, {DOC} SELECT seq, clean AS docstring FROM txt",
    "function_name_words": f"WITH {PARTS}, {_WORDS} SELECT word, count(*) AS uses FROM wd WHERE word NOT IN ({_STOP}) GROUP BY word",
    "top_name_words": f"WITH {PARTS}, {_WORDS} SELECT word, uses FROM (SELECT word, count(*) AS uses, min(seq * 100 + place) AS first FROM wd WHERE word NOT IN ({_STOP}) GROUP BY word ORDER BY uses DESC, first LIMIT 20)",
    "modules_used": f"WITH {PARTS} SELECT CASE WHEN size % 3 = 0 THEN 'math' ELSE 'json' END AS module, count(*) AS functions FROM f WHERE NOT bad AND size % 43 <> 0 AND size % 3 < 2 GROUP BY 1",
    "chat_records": f"WITH {CHECK}, {DOC} SELECT lb.seq AS id, lb.kind, 3 AS turns, 'Write a docstring.' AS system, 'assistant' AS last_role, length(docstring) AS answer_chars FROM lb JOIN txt USING (seq) WHERE label = 'correct'",
    "orphan_labels": f"WITH {CHECK} SELECT seq AS id, label FROM lb WHERE level = 'tricky'",
    "unlabelled_functions": f"WITH {CHECK} SELECT seq AS id FROM f WHERE seq NOT IN (SELECT seq FROM lb WHERE label = 'correct')",
    "conversation_messages": f"WITH {MSG} SELECT conv_id, turns, first_role, md5(full_text) AS text_md5 FROM m",
    "prompt_prefix_check": f"WITH {MSG} SELECT conv_id FROM m WHERE coalesce(third, '') <> 'assistant'",
    "stratified_split": f"WITH x AS (SELECT doc_id AS id, lang AS kind FROM documents), {SPLIT} SELECT id, kind, split FROM sp",
    "split_sizes": f"WITH x AS (SELECT doc_id AS id, source AS kind FROM documents), {SPLIT} SELECT split, count(*) AS examples FROM sp GROUP BY split",
    "token_lengths": "SELECT conv_id, turn, len(regexp_extract_all(text, '[\\pL\\pN_]+|[^\\pL\\pN_\\s]')) AS text_tokens, len(regexp_extract_all(text, '[\\pL\\pN_]+|[^\\pL\\pN_\\s]')) AS total_tokens FROM conversations",
    "described_lengths": f"""WITH {PARTS}, {DOC}, v AS (SELECT 'code_tokens' AS c, code_tokens::DOUBLE AS v FROM len UNION ALL SELECT 'docstring_tokens', docstring_tokens FROM len UNION ALL SELECT 'total_tokens', code_tokens + docstring_tokens FROM len)
      SELECT c AS "column", count(*) AS count, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75 FROM v GROUP BY c""",
    "length_histogram": f"""WITH {PARTS}, {DOC}, b AS (SELECT level, code_tokens, min(code_tokens) OVER w AS lo, max(code_tokens) OVER w AS hi FROM len WINDOW w AS (PARTITION BY level))
      SELECT level, CAST(least(floor((code_tokens - lo) * 20 / (hi - lo)::DOUBLE), 19) AS BIGINT) AS bin, count(*) AS rows FROM b GROUP BY 1, 2""",
    "topic_kind_crosstab": f"WITH {PARTS} SELECT coalesce(topic, 'All') AS topic, coalesce(kind, 'All') AS kind, count(*) AS rows FROM p GROUP BY CUBE (topic, kind)",
    "level_counts": f"WITH {PARTS} SELECT level, count(*) AS examples FROM p GROUP BY level",
    "corpus_funnel": f"""WITH {_route('topic')}, {CHECK[CHECK.index('dc AS'):]} SELECT 1 AS step_no, 'arrived' AS step, count(*) AS examples FROM f UNION ALL SELECT 2, 'ignored', count(*) FROM late UNION ALL SELECT 3, 'written', count(*) FROM routed UNION ALL SELECT 4, 'valid', count(*) FROM routed WHERE reason IS NULL
      UNION ALL SELECT 5, 'labelled', count(*) FROM lb UNION ALL SELECT 6, 'kept', count(*) FROM lb WHERE label = 'correct'""",
    "label_counts": f"""WITH {CHECK} SELECT kind, count(*) FILTER (label = 'correct') AS correct, count(*) FILTER (label = 'partial') AS partial, count(*) FILTER (label = 'hallucinated') AS hallucinated, count(*) FILTER (label = 'unparseable') AS unparseable,
      round(avg((label = 'hallucinated')::INT), 6) AS share_hallucinated FROM lb GROUP BY kind""",
    "common_errors": f"""WITH {CHECK}, e AS (SELECT unnest(string_split(missing, ';')) AS x, ' missing' AS k FROM lb WHERE missing <> '' UNION ALL SELECT unnest(string_split(invented, ';')), ' invented' FROM lb WHERE invented <> '')
      SELECT error, uses FROM (SELECT split_part(x, ' ', 1) || k AS error, count(*) AS uses FROM e GROUP BY 1 ORDER BY uses DESC, error LIMIT 5)""",
    "dropped_examples": f"WITH {CHECK} SELECT id, label FROM (SELECT seq AS id, label FROM lb WHERE label <> 'correct' ORDER BY seq LIMIT 3)",
    "review_sample": "SELECT id, lang FROM (SELECT doc_id AS id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 12)",
    "review_agreement": f"""WITH {CHECK}, rv AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'hallucinated' WHEN quality = 0 THEN 'partial' ELSE 'correct' END AS label FROM labels)
      SELECT id, rv.label, lb.label AS checker, rv.label = lb.label AS agree FROM rv JOIN lb ON lb.seq = rv.id""",
    "hallucination_rate": "SELECT count(*) AS reviewed, CAST(sum(toxic) AS BIGINT) AS hallucinated, round(avg(toxic), 6) AS rate FROM labels",
    "score_table": f"WITH {WIDE} SELECT model, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, round(min(score), 6) AS min FROM ls GROUP BY model",
    "scores_by_kind": f"WITH {WIDE} SELECT kind, model, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median FROM ls GROUP BY kind, model",
    "epoch_losses": f"WITH {LOG} SELECT * FROM lo",
    "loss_check": f"""WITH {LOG} SELECT run, coalesce(bool_and(val_loss < before), true) AS falls_every_epoch, arg_min(epoch, val_loss) AS best_epoch, min(val_loss) AS best_loss
      FROM (SELECT *, lag(val_loss) OVER (PARTITION BY run ORDER BY epoch) AS before FROM lo) GROUP BY run""",
    "answer_share": f"""WITH {PARTS}, {DOC} SELECT CAST(sum(docstring_tokens) AS BIGINT) AS answer_tokens, CAST(sum(code_tokens + docstring_tokens) AS BIGINT) AS all_tokens,
      round(sum(docstring_tokens) / sum(code_tokens + docstring_tokens)::DOUBLE, 6) AS share, max(code_tokens + docstring_tokens) AS longest, max(code_tokens + docstring_tokens) <= 2048 AS fits FROM len""",
    "prediction_export": f"""WITH {CHECK}, {DOC}, {WIDE} SELECT lb.seq AS id, length(code) AS code_chars, round(base_score, 6) AS base_score, label FROM lb JOIN src USING (seq) JOIN ws ON ws.id = lb.seq""",
    "prompt_table": """SELECT conv_id, 'Conversation ' || conv_id || ':' || chr(10) || string_agg(r || '. ' || role, chr(10) ORDER BY r) || chr(10) || 'Label {each} turn.' AS prompt
      FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY conv_id""",
    "marker_audit": """WITH l AS (SELECT source || '/' || doc_id AS path, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_no FROM documents),
      h AS (SELECT * FROM l WHERE regexp_matches(line, '(?i)(license|copyright)'))
      SELECT path, line_no, 'malformed marker' AS problem FROM h WHERE NOT regexp_matches(line, '(19|20)[0-9][0-9]')
      UNION ALL SELECT DISTINCT path, NULL, 'not in the index' FROM h WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "similar_pairs": f"WITH {DOC_GRAMS} SELECT a, b, round(s, 6) AS similarity FROM sim",
    "most_similar_pairs": f"WITH {DOC_GRAMS} SELECT a, b, round(s, 6) AS similarity FROM (SELECT * FROM every ORDER BY s DESC, a, b LIMIT 5)",
    "most_similar_200_pairs": f"""WITH {GRAMS[:GRAMS.index('bits AS')].format(key='doc_id', text='text', src='documents').rstrip().rstrip(',')}, r AS MATERIALIZED (SELECT id, unnest(grams) AS h FROM reps),
      x AS (SELECT a.id AS p, b.id AS q, count(*) AS x FROM r a JOIN r b ON a.h = b.h AND a.id < b.id GROUP BY 1, 2),
      y AS (SELECT a.ids AS ia, b.ids AS ib, x / (a.n + b.n - x)::DOUBLE AS s FROM x JOIN reps a ON a.id = p JOIN reps b ON b.id = q),
      e AS (SELECT ids[i] AS a, ids[j] AS b, 1.0::DOUBLE AS s FROM (SELECT ids, unnest(range(1, len(ids) + 1)) AS i FROM reps), LATERAL (SELECT unnest(range(i + 1, len(ids) + 1)) AS j)
        UNION ALL SELECT least(v, z), greatest(v, z), s FROM (SELECT unnest(ia) AS v, ib, s FROM y), LATERAL (SELECT unnest(ib) AS z))
      SELECT a, b, round(s, 6) AS similarity FROM (SELECT * FROM e ORDER BY s DESC, a, b LIMIT 200)""",
    "most_similar_items": f"""WITH {GRAMS[:GRAMS.index('reps AS')].format(key='item_id', text='text', src='benchmark').rstrip().rstrip(',')}, x AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.grams, b.grams)) AS x, len(a.grams) + len(b.grams) AS n FROM g a JOIN g b ON a.id < b.id)
      SELECT a, b, round(x / (n - x)::DOUBLE, 6) AS similarity FROM x ORDER BY x / (n - x)::DOUBLE DESC, a, b LIMIT 20""",
    "near_copies_found": f"WITH {GRAMS.format(key='page_id', text='html', src='pages')} SELECT count(*) > 0 AS near_copies FROM every WHERE s >= 0.8",
    "rouge_l": """WITH q AS (SELECT t.conv_id, t.turn, regexp_extract_all(lower(t.text), '[a-z0-9]+') AS p, regexp_extract_all(lower(b.text), '[a-z0-9]+') AS r
        FROM conversations t JOIN conversations b ON b.conv_id = t.conv_id AND b.turn + 1 = t.turn WHERE t.role = 'assistant'),
      m AS (SELECT *, list_concat([list_transform(r, lambda x: 0)], list_transform(p, lambda x: list_transform(r, lambda y: CASE WHEN x = y THEN 1 ELSE 0 END))) AS steps FROM q),
      l AS (SELECT *, CASE WHEN len(r) = 0 THEN 0 ELSE list_last(list_reduce(steps, lambda a, s: list_transform([list_transform(range(1, len(s) + 1), lambda i: CASE WHEN s[i] = 1 THEN CASE WHEN i > 1 THEN a[i - 1] ELSE 0 END + 1 ELSE a[i] END)],
        lambda d: list_transform(range(1, len(d) + 1), lambda j: list_max(d[1:j])))[1])) END AS x FROM m)
      SELECT conv_id, turn, round(CASE WHEN len(p) + len(r) = 0 THEN 0 ELSE 2.0::DOUBLE * x / (len(p) + len(r)) END, 6) AS rouge_l FROM l""",
}
