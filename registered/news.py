"""News and label queries: feeds, recency, duplicates, decisions, fallback, scores, strongest headlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.numbers import ranked_probabilities
from ledgerloom.functions.texts import printf
from ledgerloom.operators import news as N
from ledgerloom.operators import sentiment as S
from ledgerloom.plans import bindings as D
from ledgerloom.sources import feeds


def _headlines(spark, d):
    return D.headlines(spark, d)


def _today(spark, d):
    return F.to_date(_headlines(spark, d).select(F.max("published")).scalar())


def _feed_documents(spark, d):
    """Every page as a one-item RSS document: its title, a date from its number, its host as the source."""
    c = F.col
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    pages = D.table(spark, d, "pages").select(
        "page_id", "url",
        F.regexp_extract("html", r"<title>([\s\S]*?)</title>", 1).alias("title"),
        F.regexp_extract("url", r"://([^/]+)/", 1).alias("host"),
    )
    when = F.timestamp_seconds(F.lit(1704067200) + c("page_id") * 3600)
    date = F.concat(
        F.element_at(F.array(*[F.lit(x) for x in ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")]), F.dayofweek(when)),
        F.lit(", "), F.date_format(when, "dd MMM yyyy HH:mm:ss"),
        F.when(c("page_id") % 4 == 0, " GMT").when(c("page_id") % 4 == 1, " +0000").when(c("page_id") % 4 == 2, " -0500").otherwise(""),
    )
    title = F.when(c("page_id") % 3 == 0, F.concat(c("title"), F.lit(" - "), c("host"))).otherwise(F.concat(F.lit("  "), c("title")))
    xml = F.concat(
        F.lit('<rss version="2.0"><channel><title>x</title><item><title>'), safe(title), F.lit("</title>"),
        F.when(c("page_id") % 10 != 9, F.concat(F.lit("<pubDate>"), date, F.lit("</pubDate>"))).otherwise(F.lit("<pubDate>soon</pubDate>")),
        F.lit("<link>"), safe(c("url")), F.lit('</link><source url="u">'), c("host"), F.lit("</source></item></channel></rss>"),
    )
    text = F.when(c("page_id") % 11 == 10, F.lit("<rss><channel><item>")).otherwise(xml)
    return pages.select(c("page_id").cast("string").alias("ticker"), F.lit(1).alias("feed_rank"), text.alias("xml"))


def feed_headlines(spark, d):
    return feeds.parse_feed(_feed_documents(spark, d))


def skipped_feed_items(spark, d):
    return feeds.skipped_items(_feed_documents(spark, d))


def broken_feeds(spark, d):
    return feeds.broken_feeds(_feed_documents(spark, d)).select("ticker")


def recent_headlines(spark, d):
    return N.recent(_headlines(spark, d), _today(spark, d)).select("ticker", "pos", "published")


def unique_stories(spark, d):
    return N.unique_stories(_headlines(spark, d)).select("ticker", "feed_rank", "pos")


def topped_up_stories(spark, d):
    return N.topped_up(_headlines(spark, d), 20).select("ticker", "feed_rank", "pos")


def newest_headlines(spark, d):
    out = N.collect_headlines(_headlines(spark, d), _today(spark, d), 15)
    return out.select("ticker", "ord", "pos", "feed_rank", "published")


def headline_shortfall(spark, d):
    h = _headlines(spark, d).withColumn("ticker", F.concat_ws("-", "ticker", "publisher"))
    return N.shortfall(N.collect_headlines(h, _today(spark, d), 8), h, 8)


def clamped_counts(spark, d):
    asked = D.table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") * 3 - 5).alias("n"))
    return N.clamped(asked, "n", 1, 50)


def clamped_windows(spark, d):
    asked = D.table(spark, d, "customer").select("c_custkey", F.floor(F.col("c_acctbal") / 20).cast("int").alias("window"))
    return N.clamped(asked, "window", 5, 252)


def search_hits(spark, d):
    raw = D.table(spark, d, "documents").select(
        F.col("source").alias("query"), F.col("doc_id").alias("pos"),
        F.when(F.col("lang") != "de", F.col("lang")).alias("title"),
        F.when(F.col("lang") != "fr", F.concat(F.lit("h"), F.col("doc_id").cast("string"))).alias("href"),
        F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("body"), F.lit(None).cast("string").alias("date"),
    )
    return N.hit_digest(N.search_hits(raw))


def _decisions(spark, d):
    return D.primary_decisions(spark, d)


def checked_decisions(spark, d):
    """Decisions with the ways to be wrong built in by document number."""
    n = F.col("ord")
    flawed = _decisions(spark, d).select(
        "ord",
        F.when(n % 7 == 1, "mixed").otherwise(F.col("choice")).alias("choice"),
        F.when(n % 7 == 2, F.map_filter("probabilities", lambda k, v: k != "neutral"))
        .when(n % 7 == 3, F.transform_values("probabilities", lambda k, v: v * 1.5))
        .otherwise(F.col("probabilities")).alias("probabilities"),
    )
    return S.check_decisions(flawed).select("ord", "problem")


def _scored(spark, d):
    h = _headlines(spark, d).withColumnRenamed("pos", "ord")
    return S.score_headlines(h, _decisions(spark, d), D.secondary_labels(spark, d), ["ord"])


def scored_headlines(spark, d):
    return _scored(spark, d).select("ticker", "ord", "sentiment", "confidence", "scored_by", F.round("score", 4).alias("score"), "brief_reason")


def sentiment_summary(spark, d):
    out = S.summarise(_scored(spark, d), ["ticker"])
    c = F.col("counts")
    return out.select(
        "ticker", "score", "label", "scored", "by_primary", "by_secondary", "failed",
        c["positive"].alias("positive"), c["neutral"].alias("neutral"), c["negative"].alias("negative"),
    )


def publisher_sentiment(spark, d):
    out = S.summarise(_scored(spark, d), ["publisher"])
    return out.select("publisher", "score", "label", "scored", "failed", F.col("counts")["negative"].alias("negative"))


def sentiment_warnings(spark, d):
    out = S.quality_warnings(S.summarise(_scored(spark, d), ["publisher"]), F.col("scored") > 20)
    return out.select("publisher", F.array_join("warnings", " | ").alias("warnings"))


def strongest_headlines(spark, d):
    return S.strongest(_scored(spark, d), ["publisher"], "ord").select("publisher", "rank", "ord", F.round("score", 4).alias("score"))


def strongest_with_sources(spark, d):
    scored = S.strongest(_scored(spark, d), ["ticker"], "ord").select("ticker", "ord", "rank", "sentiment")
    return S.paired_with_sources(scored, _headlines(spark, d).withColumnRenamed("pos", "ord"))


def ranked_probabilities_text(spark, d):
    ranked = F.transform(
        ranked_probabilities("probabilities"), lambda e: printf("%s %.2f", e["key"], e["value"])
    )
    return _decisions(spark, d).select("ord", F.array_join(ranked, ", ").alias("described"))


def _batches(spark, d):
    return D.table(spark, d, "conversations").select(
        F.col("conv_id").alias("batch"), F.col("turn").alias("pos"),
        F.when(F.col("role") == "system", "   ").otherwise(F.col("text")).alias("title"),
    )


def labelled_input(spark, d):
    return S.labelled_input(_batches(spark, d), 3).select("batch", "pos", "part", "index")


def overfull_batches(spark, d):
    return S.overfull_batches(_batches(spark, d), 3)


def batch_labels(spark, d):
    """Two labels per odd turn, none for even ones; the first to arrive wins."""
    base = D.table(spark, d, "conversations").where("role <> 'user'")
    label = lambda k: F.when(F.length("text") % 3 == k, "positive").when(F.length("text") % 3 == (k + 1) % 3, "negative").otherwise("neutral")
    one = base.select(
        F.col("conv_id").alias("batch"), F.floor(F.col("turn") / 20).cast("int").alias("part"), (F.col("turn") % 20 + 1).cast("int").alias("index"), F.lit(1).alias("arrival"),
        label(0).alias("sentiment"), F.lit(0.7).alias("confidence"), F.lit("first").alias("reason"),
    )
    two = base.select(
        F.col("conv_id").alias("batch"), F.floor(F.col("turn") / 20).cast("int").alias("part"), (F.col("turn") % 20 + 1).cast("int").alias("index"), F.lit(2).alias("arrival"),
        label(1).alias("sentiment"), F.lit(0.9).alias("confidence"), F.lit("second").alias("reason"),
    )
    out = S.apply_labels(S.labelled_input(_batches(spark, d)), two.unionByName(one))
    return out.select("batch", (F.col("part") * 20 + F.col("index")).alias("index"), "sentiment", "confidence", "scored_by", "score", "brief_reason")


def caller_scored_headlines(spark, d):
    """A caller's scorer run over Arrow batches: here, one that labels by text length."""

    def scorer(frame):
        n = frame["title"].str.len()
        frame = frame[["ord"]].copy()
        frame["sentiment"] = n.map(lambda x: "positive" if x % 2 else "negative")
        frame["confidence"] = 0.5
        frame["reason"] = "length"
        return frame

    h = _headlines(spark, d).withColumnRenamed("pos", "ord").select("ord", "title")
    return S.run_scorer(h, scorer, "ord bigint, sentiment string, confidence double, reason string")


HEAD = """h AS (SELECT lang AS ticker, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 1 ELSE 2 END AS feed_rank, doc_id AS pos, text AS title, source AS publisher,
    make_timestamp((1704067200 + (n_chars * 977 + doc_id * 7) % 1209600) * 1000000) AS published FROM documents),
today AS (SELECT CAST(max(published) AS DATE) AS t FROM h),
keyed AS (SELECT *, lower(trim(regexp_replace(title, '[\\s\\x{85}\\pZ\\x{1c}-\\x{1f}]+', ' ', 'g'))) AS story FROM h)"""
UNIQ = """uniq AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ticker, story ORDER BY feed_rank, pos) AS rn FROM {src}) WHERE rn = 1),
topped AS (SELECT u.* FROM uniq u JOIN (SELECT ticker, count(*) FILTER (feed_rank = 1) AS first FROM uniq GROUP BY ticker) c USING (ticker) WHERE u.feed_rank = 1 OR first < {n})"""


def _newest(n: int, ticker: str = "ticker") -> str:
    return f"""rec AS (SELECT * REPLACE ({ticker} AS ticker) FROM keyed, today WHERE published >= CAST(t - 7 AS TIMESTAMP)), {UNIQ.format(src='rec', n=n)},
new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY published DESC, feed_rank, pos) AS ord FROM topped) WHERE ord <= {n})"""


FEED = """p AS (SELECT *, regexp_extract(html, '<title>([\\s\\S]*?)</title>', 1) AS raw, regexp_extract(url, '://([^/]+)/', 1) AS host FROM pages),
it AS (SELECT CAST(page_id AS VARCHAR) AS ticker, 1 AS feed_rank, 0 AS pos, page_id, trim(regexp_replace(raw, '[\\s\\x{85}\\pZ\\x{1c}-\\x{1f}]+', ' ', 'g')) AS title, host AS publisher,
    CASE WHEN page_id % 10 <> 9 THEN make_timestamp((1704067200 + page_id * 3600 + CASE WHEN page_id % 4 = 2 THEN 18000 ELSE 0 END) * 1000000) END AS published,
    nullif(trim(url), '') AS url FROM p WHERE page_id % 11 <> 10)"""
DEC = """dec AS (SELECT doc_id AS ord, CASE WHEN toxic = 1 THEN 'negative' WHEN doc_id % 3 = 0 THEN 'neutral' ELSE 'positive' END AS choice, CASE WHEN toxic = 1 THEN 0.8 ELSE 0.7 END AS confidence,
    CAST(CASE WHEN toxic = 1 THEN 0.05 ELSE 0.7 END AS DOUBLE) + (doc_id % 7) * 0.01::DOUBLE AS p_pos, 0.2::DOUBLE - (doc_id % 7) * 0.01::DOUBLE AS p_neu, CAST(CASE WHEN toxic = 1 THEN 0.75 ELSE 0.1 END AS DOUBLE) AS p_neg
  FROM labels WHERE quality = 1),
sec AS (SELECT doc_id AS ord, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS s FROM labels WHERE toxic = 0)"""
SCORED = f"""{DEC}, sc AS (SELECT h.ticker, h.pos AS ord, h.publisher, h.published, coalesce(choice, s, 'neutral') AS sentiment,
    CAST(coalesce(confidence, CASE WHEN s IS NOT NULL THEN 0.6 END, 0) AS DOUBLE) AS confidence,
    CASE WHEN choice IS NOT NULL THEN 'primary' WHEN s IS NOT NULL THEN 'secondary' ELSE 'none' END AS scored_by,
    CASE WHEN choice IS NOT NULL THEN round(p_pos - p_neg, 4) WHEN s = 'positive' THEN 0.6 WHEN s = 'negative' THEN -0.6 WHEN s = 'neutral' THEN 0.0 END AS score,
    CASE WHEN choice IS NOT NULL THEN 'No reason available: the LLM call failed.' WHEN s IS NOT NULL THEN 'tone of the text' ELSE 'Not scored: both scorers failed.' END AS brief_reason
  FROM h LEFT JOIN dec ON dec.ord = h.pos LEFT JOIN sec ON sec.ord = h.pos)"""
S_W = f"WITH {HEAD}, {SCORED}"
_SUM = """round(avg(score), 4) AS score, CASE WHEN round(avg(score), 4) > 0.2 THEN 'positive' WHEN round(avg(score), 4) < -0.2 THEN 'negative' WHEN avg(score) IS NOT NULL THEN 'neutral' END AS label, count(score) AS scored"""
BATCH = """b0 AS (SELECT conv_id AS batch, turn AS pos, CASE WHEN role = 'system' THEN '' ELSE trim(text, ' ') END AS title, role, text FROM conversations),
b AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY pos) AS idx FROM b0 WHERE title <> '')"""

QUERIES = {
    "feed_headlines": feed_headlines,
    "skipped_feed_items": skipped_feed_items,
    "broken_feeds": broken_feeds,
    "recent_headlines": recent_headlines,
    "unique_stories": unique_stories,
    "topped_up_stories": topped_up_stories,
    "newest_headlines": newest_headlines,
    "headline_shortfall": headline_shortfall,
    "clamped_counts": clamped_counts,
    "clamped_windows": clamped_windows,
    "search_hits": search_hits,
    "checked_decisions": checked_decisions,
    "scored_headlines": scored_headlines,
    "sentiment_summary": sentiment_summary,
    "publisher_sentiment": publisher_sentiment,
    "sentiment_warnings": sentiment_warnings,
    "strongest_headlines": strongest_headlines,
    "strongest_with_sources": strongest_with_sources,
    "ranked_probabilities": ranked_probabilities_text,
    "labelled_input": labelled_input,
    "overfull_batches": overfull_batches,
    "batch_labels": batch_labels,
    "caller_scored_headlines": caller_scored_headlines,
}

ORACLE = {
    "feed_headlines": f"WITH {FEED} SELECT ticker, feed_rank, pos, title, publisher, published, url FROM it WHERE title <> '' AND published IS NOT NULL",
    "skipped_feed_items": f"WITH {FEED} SELECT ticker, feed_rank, CASE WHEN title = '' OR published IS NULL THEN 1 ELSE 0 END AS skipped FROM it",
    "broken_feeds": "SELECT CAST(page_id AS VARCHAR) AS ticker FROM pages WHERE page_id % 11 = 10",
    "recent_headlines": f"WITH {HEAD} SELECT ticker, pos, published FROM h, today WHERE published >= CAST(t - 7 AS TIMESTAMP)",
    "unique_stories": f"WITH {HEAD}, {UNIQ.format(src='keyed', n=20)} SELECT ticker, feed_rank, pos FROM uniq",
    "topped_up_stories": f"WITH {HEAD}, {UNIQ.format(src='keyed', n=20)} SELECT ticker, feed_rank, pos FROM topped",
    "newest_headlines": f"WITH {HEAD}, {_newest(15)} SELECT ticker, ord, pos, feed_rank, published FROM new",
    "headline_shortfall": f"""WITH {HEAD}, {_newest(8, "ticker || '-' || publisher")}, k AS (SELECT DISTINCT ticker || '-' || publisher AS ticker FROM h),
      n AS (SELECT k.ticker, count(new.ord) AS headlines FROM k LEFT JOIN new ON new.ticker = k.ticker GROUP BY k.ticker)
      SELECT ticker, headlines, CASE WHEN headlines < 8 THEN 'only ' || headlines || ' headlines for ' || ticker || ' in the last 7 days, below the minimum of 8' END AS warning FROM n""",
    "clamped_counts": """WITH a AS (SELECT s_suppkey, s_nationkey * 3 - 5 AS n FROM supplier) SELECT s_suppkey, least(greatest(n, 1), 50) AS n,
      CASE WHEN n NOT BETWEEN 1 AND 50 THEN 'n=' || n || ' is outside 1..50, using ' || least(greatest(n, 1), 50) END AS n_warning FROM a""",
    "clamped_windows": """WITH a AS (SELECT c_custkey, CAST(floor(c_acctbal / 20) AS INT) AS n FROM customer) SELECT c_custkey, least(greatest(n, 5), 252) AS "window",
      CASE WHEN n NOT BETWEEN 5 AND 252 THEN 'window=' || n || ' is outside 5..252, using ' || least(greatest(n, 5), 252) END AS window_warning FROM a""",
    "search_hits": """SELECT query, hit, title, url, body AS snippet, left(body, 300) AS snippet_preview, NULL::VARCHAR AS published, length(body) AS snippet_chars FROM (
      SELECT source AS query, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS hit, CASE WHEN lang <> 'de' THEN lang ELSE '' END AS title,
        CASE WHEN lang <> 'fr' THEN 'h' || doc_id ELSE 'u' || doc_id END AS url, text AS body FROM documents) WHERE hit <= 5""",
    "checked_decisions": f"""WITH {DEC} SELECT ord, CASE ord % 7 WHEN 1 THEN 'choice ''mixed'' is not one of the options [''positive'', ''neutral'', ''negative'']'
        WHEN 2 THEN 'missing probabilities for [''neutral'']' WHEN 3 THEN printf('probabilities sum to %.2f, not 1', (p_pos + p_neu + p_neg) * 1.5) END AS problem FROM dec""",
    "scored_headlines": f"{S_W} SELECT ticker, ord, sentiment, confidence, scored_by, score, brief_reason FROM sc",
    "sentiment_summary": f"""{S_W} SELECT ticker, {_SUM}, count(*) FILTER (scored_by = 'primary') AS by_primary, count(*) FILTER (scored_by = 'secondary') AS by_secondary, count(*) FILTER (score IS NULL) AS failed,
      count(*) FILTER (score IS NOT NULL AND sentiment = 'positive') AS positive, count(*) FILTER (score IS NOT NULL AND sentiment = 'neutral') AS neutral, count(*) FILTER (score IS NOT NULL AND sentiment = 'negative') AS negative FROM sc GROUP BY ticker""",
    "publisher_sentiment": f"""{S_W} SELECT publisher, {_SUM}, count(*) FILTER (score IS NULL) AS failed, count(*) FILTER (score IS NOT NULL AND sentiment = 'negative') AS negative FROM sc GROUP BY publisher""",
    "sentiment_warnings": f"""{S_W}, g AS (SELECT publisher, count(score) AS n, count(*) FILTER (scored_by = 'secondary') AS s, count(*) FILTER (score IS NULL) AS f FROM sc GROUP BY publisher)
      SELECT publisher, concat_ws(' | ', CASE WHEN n = 0 THEN 'no headline could be scored, so there is no Sentiment score' END,
        CASE WHEN s > 0 THEN 'the primary scorer was unavailable for ' || s || ' headlines, so the secondary labelled them' END,
        CASE WHEN f > 0 THEN f || ' headlines could not be scored and are left out of the Sentiment score' END,
        CASE WHEN n <= 20 THEN 'the Recommendation is a placeholder Hold: no LLM provider answered' END) AS warnings FROM g""",
    "strongest_headlines": f"""{S_W} SELECT publisher, rank, ord, score FROM (SELECT *, row_number() OVER (PARTITION BY publisher ORDER BY abs(score) DESC, ord) AS rank FROM sc WHERE score IS NOT NULL) WHERE rank <= 3""",
    "strongest_with_sources": f"""{S_W} SELECT ticker, ord, rank, sentiment, publisher, published FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY abs(score) DESC, ord) AS rank FROM sc WHERE score IS NOT NULL) WHERE rank <= 3""",
    "ranked_probabilities": f"""WITH {DEC}, l AS (SELECT ord, 'positive' AS k, p_pos AS v FROM dec UNION ALL SELECT ord, 'neutral', p_neu FROM dec UNION ALL SELECT ord, 'negative', p_neg FROM dec)
      SELECT ord, string_agg(k || ' ' || printf('%.2f', v), ', ' ORDER BY v DESC, k) AS described FROM l GROUP BY ord""",
    "labelled_input": f"WITH {BATCH} SELECT batch, pos, CAST((idx - 1) // 3 AS INT) AS part, CAST((idx - 1) % 3 + 1 AS INT) AS index FROM b",
    "overfull_batches": f"WITH {BATCH} SELECT batch, count(*) AS given, count(*) || ' headlines given; they are labelled 3 at a time' AS warning FROM b GROUP BY batch HAVING count(*) > 3",
    "batch_labels": f"""WITH {BATCH}, l AS (SELECT conv_id AS batch, turn + 1 AS idx, CASE length(text) % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS s FROM conversations WHERE role <> 'user')
      SELECT b.batch, b.idx AS index, coalesce(s, 'neutral') AS sentiment, CASE WHEN s IS NULL THEN 0.0 ELSE 0.7 END AS confidence, CASE WHEN s IS NULL THEN 'none' ELSE 'secondary' END AS scored_by,
        CASE s WHEN 'positive' THEN 0.7 WHEN 'negative' THEN -0.7 WHEN 'neutral' THEN 0.0 END AS score, CASE WHEN s IS NULL THEN 'Not scored: no label was returned for this headline.' ELSE 'first' END AS brief_reason
      FROM b LEFT JOIN l ON l.batch = b.batch AND l.idx = b.idx WHERE b.idx <= 20""",
    "caller_scored_headlines": "SELECT doc_id AS ord, CASE WHEN length(text) % 2 = 1 THEN 'positive' ELSE 'negative' END AS sentiment, 0.5 AS confidence, 'length' AS reason FROM documents",
}
