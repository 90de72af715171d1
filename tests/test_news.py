"""Feeds, recency, duplicates, decisions and scores."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.texts import markdown_escaped, rfc822_utc, sentence_count, unwrapped
from ledgerloom.operators import news as N
from ledgerloom.operators import sentiment as S
from ledgerloom.sources import feeds

FEED = """<?xml version="1.0"?><rss version="2.0"><channel><title>news</title>
<item><title>  Shares   rise &amp; fall - The Paper </title><pubDate>Mon, 05 Oct 2026 12:00:00 GMT</pubDate><link> https://x/1 </link><source url="https://p">The Paper</source></item>
<item><title>Up - down</title><pubDate>05 Oct 2026 08:00:00 -0400</pubDate><link> </link></item>
<item><title>No date</title></item>
<item><title>   </title><pubDate>Mon, 05 Oct 2026 12:00:00 GMT</pubDate></item>
<item><title>Bad date</title><pubDate>yesterday</pubDate></item>
</channel></rss>"""


def test_feed_parsing(spark):
    df = spark.createDataFrame([("T", 1, FEED), ("T", 2, "<rss><channel>")], "ticker string, feed_rank int, xml string")
    got = [(r.pos, r.title, r.publisher, r.published, r.url) for r in feeds.parse_feed(df).orderBy("pos").collect()]
    noon = datetime(2026, 10, 5, 12, 0)
    assert got == [(0, "Shares rise & fall", "The Paper", noon, "https://x/1"), (1, "Up - down", None, noon, None)]
    assert feeds.broken_feeds(df).first().feed_rank == 2
    assert feeds.skipped_items(df).first().skipped == 3


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Mon, 05 Oct 2026 12:00:00 GMT", datetime(2026, 10, 5, 12)),
        ("5 Oct 2026 12:00:00 +0200", datetime(2026, 10, 5, 10)),
        ("Mon, 05 Oct 2026 12:00:00 -0000", datetime(2026, 10, 5, 12)),
        ("Mon, 05 Oct 2026 12:00:00", datetime(2026, 10, 5, 12)),
        ("Mon, 05 Oct 2026 12:00:00 EST", datetime(2026, 10, 5, 17)),
        ("soon", None),
        ("", None),
    ],
)
def test_rss_dates(spark, text, want):
    assert spark.range(1).select(rfc822_utc(F.lit(text))).first()[0] == want


def headlines(spark, *data):
    return spark.createDataFrame([("T", rank, pos, title, "p", published) for rank, pos, title, published in data], "ticker string, feed_rank int, pos int, title string, publisher string, published timestamp")


def test_recent_unique_topped_up_newest(spark):
    day = lambda d, h=0, m=0, s=0: datetime(2026, 10, d, h, m, s)
    df = headlines(
        spark,
        (1, 0, "One", day(7)), (1, 1, "Two", day(6)), (1, 2, "too old", datetime(2026, 9, 29, 23, 59, 59)), (1, 3, "edge", datetime(2026, 9, 30)),
        (2, 0, "one", day(7, 5)), (2, 1, "Three", day(7)), (2, 2, "four", day(5)),
    )
    today = F.lit(date(2026, 10, 7))
    all_of = N.collect_headlines(df, today, 15).orderBy("ord").collect()
    assert [r.title for r in all_of] == ["One", "Three", "Two", "four", "edge"]
    assert [r.title for r in N.collect_headlines(df, today, 3).orderBy("ord").collect()] == ["One", "Two", "edge"]
    assert N.collect_headlines(df, today, 4).count() == 4
    short = N.shortfall(N.collect_headlines(df, today, 15), df, 15).first()
    assert short.warning == "only 5 headlines for T in the last 7 days, below the minimum of 10"


def test_clamp_warns_only_when_it_changes(spark):
    got = N.clamped(spark.createDataFrame([(0,), (5,), (99,)], "n int"), "n", 1, 50).collect()
    assert [(r.n, r.n_warning) for r in got] == [(1, "n=0 is outside 1..50, using 1"), (5, None), (50, "n=99 is outside 1..50, using 50")]


def test_fallback_between_scorers_and_the_summary(spark):
    h = spark.createDataFrame([("T", i, f"h{i}") for i in range(5)], "ticker string, ord int, title string")
    p = lambda a, b, c: {"positive": a, "neutral": b, "negative": c}
    primary = spark.createDataFrame(
        [(0, "positive", 0.85, p(0.85, 0.10, 0.05)), (1, "negative", 0.68, p(0.05, 0.27, 0.68)), (2, "neutral", 0.9, p(0.06, 0.90, 0.04)), (3, "positive", 0.9, p(0.9, 0.9, 0.0))],
        "ord int, choice string, confidence double, probabilities map<string,double>",
    )
    secondary = spark.createDataFrame([(3, "negative", 0.5, "why")], "ord int, sentiment string, confidence double, reason string")
    scored = S.score_headlines(h, primary, secondary, ["ord"])
    assert [(r.scored_by, r.score) for r in scored.orderBy("ord").collect()] == [("primary", 0.8), ("primary", -0.63), ("primary", 0.02), ("secondary", -0.5), ("none", None)]
    got = S.summarise(scored.where("ord < 3"), ["ticker"]).first()
    assert (got.score, got.label, got.counts) == (0.0633, "neutral", {"positive": 1, "neutral": 1, "negative": 1})
    top = [r.ord for r in S.strongest(scored, ["ticker"], "ord", 2).orderBy("rank").collect()]
    assert top == [0, 1]


@pytest.mark.parametrize(("score", "label"), [(0.2, "neutral"), (0.2001, "positive"), (-0.2, "neutral"), (-0.2001, "negative"), (None, None)])
def test_label_thresholds_are_strict(spark, score, label):
    assert spark.range(1).select(S.score_label(F.lit(score).cast("double"))).first()[0] == label


def test_strongest_ties_keep_order(spark):
    df = spark.createDataFrame([("b", i, s) for i, s in enumerate([0.9, -0.3, 0.1, -0.9, None, 0.3])], "batch string, ord int, score double")
    assert [r.ord for r in S.strongest(df, ["batch"], "ord").orderBy("rank").collect()] == [0, 3, 1]


def test_batch_labels(spark):
    given = spark.createDataFrame([("b", 0, " "), ("b", 1, " x "), ("b", 2, "y")], "batch string, pos int, title string")
    labels = spark.createDataFrame([("b", 0, 1, 2, "negative", 0.9, "later"), ("b", 0, 1, 1, "positive", 0.8, "first")], "batch string, part int, index int, arrival int, sentiment string, confidence double, reason string")
    got = S.apply_labels(S.labelled_input(given), labels).orderBy("index").collect()
    assert [(r.title, r.sentiment, r.score, r.scored_by) for r in got] == [("x", "positive", 0.8, "secondary"), ("y", "neutral", None, "none")]


def test_text_helpers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(sentence_count(F.lit("Up 4.2% vs. its peer. Then down! Why? end"))) == 3
    assert one(unwrapped(F.lit('```python\n"""Doc."""\n```'))) == "Doc."
    assert one(markdown_escaped(F.lit("a_b*[c]<d`\\"))) == "a\\_b\\*\\[c\\]&lt;d\\`\\\\"
