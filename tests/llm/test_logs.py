"""Chat logs, rollups, empty tables and the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import chat, compression, linededup, oddsketch, packing, pieces, registry, repetition, rollups, secrets, spotsigs

LOG = "conv_id long, seq long, turn long, kind string, role string, text string"


def messages(spark, rows):
    got = chat.fold_turns(spark.createDataFrame(rows, LOG)).orderBy("conv_id", "turn").collect()
    return [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in got]


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, 1, "message", "user", "draft"), (1, 5, 1, "edit", None, "final"), (1, 2, 2, "message", "assistant", ""), (1, 3, 2, "delta", None, "Hel"), (1, 4, 2, "delta", None, "lo"), (1, 4, 2, "delta", None, "lo"),
        (1, 6, 3, "message", "user", "gone"), (1, 7, 2, "regenerate", None, None), (1, 8, 2, "delta", None, "Hi"), (1, 9, 2, "delta", None, "!"), (1, 10, 4, "message", "user", "after"),
        (2, 1, 1, "delta", "assistant", "a"), (2, None, 1, None, "user", "first "), (None, 1, None, "message", None, None),
    ]
    assert messages(spark, rows) == [
        (None, None, "", ""), (1, 1, "user", "final"), (1, 2, "assistant", "Hi!"), (1, 4, "user", "after"), (2, 1, "assistant", "first a"),
    ]


TEXTS = ["</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>\n", "<\\|a <\\\\|b [\\INST] \\<s>", "", "<", "[", "é中😀\n\n", "<<|im_end|>", "a" * 5000]


def test_output_reads_back(spark):
    roles = ["user", "assistant", "sy%0As\ntem", "<|im_end|>%"]
    rows = [(k % 3, k, k, "message", roles[k % 4], t) for k, t in enumerate(TEXTS)]
    table = chat.formatted(spark.createDataFrame(rows, LOG))
    for r in chat.read_back(table).collect():
        own = [(role, t) for c, _, _, _, role, t in rows if c == r["conv_id"]]
        assert [(m["role"], m["text"]) for m in r["messages"]] == own
        assert list(r["trained"]) == [t for role, t in own if role == "assistant"]
        assert r["formatted"].count(chat.START) == r["formatted"].count(chat.END) == len(own)
        for turn, (role, text) in zip(r["turns"], own, strict=True):
            span = r["formatted"][turn["start"] : turn["start"] + turn["length"]]
            assert span.startswith(chat.START) and span.endswith(chat.END)
            if role == "assistant":
                under = r["formatted"][turn["loss_start"] : turn["loss_start"] + turn["loss_length"]]
                assert under.replace("\\", "") == text.replace("\\", "")


def test_escape_is_reversible(spark):
    table = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", chat.unescaped(chat.escaped(F.col("t"))).alias("u"), chat.escaped(F.col("t")).alias("e"))
    for r in table.collect():
        assert r["t"] == r["u"]
        assert not any(mark in r["e"] for mark in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))


SIDE = "struct<source:string,lang:string,tokenizer:string,tokens:long,chars:long>"


def changes(spark, rows):
    return spark.createDataFrame(rows, f"before {SIDE}, after {SIDE}, docs int")


def test_rollup_batches_are_idempotent_and_in_any_order(spark, tmp_path):
    a, b, b2, moved = ("s", "en", "v1", 5, 20), ("s", "en", "v1", 7, 30), ("s", "en", "v1", 9, 31), ("s", "de", "v1", 9, 31)
    odd = (None, None, "v1", None, 4)
    batches = {1: [(None, a, 1), (None, b, 1), (None, b, 1), (None, odd, 1), (None, None, 1)], 2: [(b, b2, 1)], 3: [(a, None, 1), (b2, moved, 1)]}
    want = {("s", "en", "v1", 1, 7, 30), ("s", "de", "v1", 1, 9, 31), (None, None, "v1", 1, 0, 4)}
    path = str(tmp_path / "rollup")
    for k in (2, 1, 3, 1, 3):
        rollups.commit(changes(spark, batches[k]), k, path)
    assert {tuple(r) for r in rollups.totals(spark, path).collect()} == want
    rollups.compact(spark, path)
    for k in (1, 3, 2):  # what is sent again after compaction changes nothing
        rollups.commit(changes(spark, batches[k]), k, path)
    assert {tuple(r) for r in rollups.totals(spark, path).collect()} == want
    rollups.commit(changes(spark, [(None, a, 1)]), 4, path)
    rollups.compact(spark, path)
    rollups.commit(changes(spark, [(None, a, 1)]), 4, path)
    assert {tuple(r) for r in rollups.totals(spark, path).collect()} == want - {("s", "en", "v1", 1, 7, 30)} | {("s", "en", "v1", 2, 12, 50)}


def test_rollup_without_batches(spark, tmp_path):
    assert rollups.totals(spark, str(tmp_path / "none")).collect() == []
    rollups.commit(changes(spark, [(None, None, 1)]), 0, str(tmp_path / "some"))
    assert rollups.totals(spark, str(tmp_path / "some")).collect() == []


def test_a_failed_commit_leaves_the_former(spark, tmp_path):
    """Folders that Spark has not marked complete don't count."""
    path = str(tmp_path / "rollup")
    row = ("s", "en", "v1", 5, 20)
    rollups.commit(changes(spark, [(None, row, 1)]), 7, path)
    half = f"{path}/batch=7/{rollups._new_name()}"
    rollups.deltas(changes(spark, [(None, row, 1), (None, row, 1)])).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(half)
    assert [r["docs"] for r in rollups.totals(spark, path).collect()] == [1]


def test_rollup_follows_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        changes(spark, [(None, ("s", "en", "v1", k, 1), 1)]).write.mode("append").parquet(source)
    stream = spark.readStream.schema(f"before {SIDE}, after {SIDE}, docs int").option("maxFilesPerTrigger", 1).parquet(source)
    rollups.follow(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r) for r in rollups.totals(spark, str(tmp_path / "out")).collect()] == [("s", "en", "v1", 3, 3, 3)]


def plain_totals(docs):
    """Token counts by the libraries of the two tokenizers."""
    import sentencepiece
    from tokenizers import Tokenizer

    words, library = Tokenizer.from_file(packing.tokenizer_file()), sentencepiece.SentencePieceProcessor(model_file=pieces.model_file())
    out = {}
    for r in docs:
        text = r["text"] or ""
        for name, n in (("word_bpe_49k", len(words.encode(text, add_special_tokens=False).ids)), ("piece_bpe_32k", len(library.encode(text)))):
            key = (r["source"], r["lang"], name)
            out[key] = [x + y for x, y in zip(out.get(key, (0, 0, 0)), (1, n, len(text)), strict=True)]
    return {(*k, *v) for k, v in out.items()}


def test_token_counts_of_a_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {tuple(r) for r in rollups.op2_token_counts(spark, sf).collect()} == plain_totals(docs.collect())


def test_token_counts_of_odd_rows(spark, odd_docs, tmp_path):
    """Null, empty and long texts, repeated rows and null ids; columns of clashing names are not read."""
    odd = odd_docs.withColumns({"tokenizer": F.lit("x"), "tokens": F.lit("y"), "chars": F.lit("z"), "copy": F.lit(0), "source": F.expr("if(doc_id = 1, null, source)")})
    odd.unionByName(odd.filter("doc_id = 9")).write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in rollups.op2_token_counts(spark, str(tmp_path)).collect()}
    assert got == plain_totals(spark.read.parquet(str(tmp_path / "documents.parquet")).collect())


def test_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = compression.fit(no_docs, labels)
    path = packing.tokenizer_file()
    tables = [
        repetition.repetition(no_docs), packing.packed_documents(no_docs, path), oddsketch.near_duplicates(no_docs), linededup.removed_lines(no_docs), linededup.cleaned(no_docs),
        secrets.redacted(no_docs), secrets.find_spans(no_docs)[1], spotsigs.neighbour_fingerprints(no_docs, 4), *spotsigs.similar(spotsigs.fingerprints(no_docs)),
        compression.with_score(no_docs, model, ["doc_id"]), pieces.encoded(no_docs, pieces.model_file()), rollups.deltas(spark.createDataFrame([], f"before {SIDE}, after {SIDE}")),
        chat.formatted(spark.createDataFrame([], LOG)),
    ]
    assert [t.count() for t in tables] == [0] * len(tables)


def test_pipeline_stages_keep_columns_and_clean_rows(spark, odd_docs, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "minhash_near_dedup", "secret_scans", "best_fit_packing"]
    sf = str(tmp_path)
    docs = odd_docs
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == odd_docs.columns
        out.write.parquet(f"{sf}/{k}")
        docs = spark.read.parquet(f"{sf}/{k}")
    ids = [r["doc_id"] for r in docs.collect()]
    # 7 shares all but its last word with 6, a single long line
    assert sorted(i for i in ids if i is not None) == [1, 2, 2, 3, 4, 5, 6, 8, 9, 11] and ids.count(None) == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.filter("sequence_id is null").isEmpty()
    assert packed.filter("piece = 0").count() == docs.count()


def test_pipeline_runs_on_the_tables(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    fill = got.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert got.count() > 100 and fill.filter("n > 2048").isEmpty()


@pytest.mark.parametrize("n", range(1, 11))
def test_every_operator_has_a_query(n):
    assert [name for name in registry.queries() if name.startswith(f"op{n}_")]


def test_piece_counts_encode_each_run_once_and_are_the_library_s(monkeypatch):
    """Texts with spaces in every place, space marks and nulls, over several slices; repeated words reach the library once a slice."""
    import pyarrow as pa
    import sentencepiece

    from ledgerloom.llm.pieces import model_file

    model = sentencepiece.SentencePieceProcessor(model_file=model_file())
    texts = ["", " ", "  a", "a ", "a  b", "a\nb ", "▁", "a▁b", "\t\tx\r\n y", "é中😀 </s>\n\nwörter", "x y", "\n a", "don't,it's", None, "the river bank " * 50 + "end"]
    for together in (1, 40, 1 << 20):
        monkeypatch.setattr(rollups, "TOGETHER", together)
        got = rollups._counts(model_file(), pa.array(texts * 3, pa.string()))
        assert got == [len(model.encode(t or "")) for t in texts * 3]
    seen = []

    class Watched:
        def encode(self, x):
            seen.extend([x] if isinstance(x, str) else x)
            return model.encode(x)

    monkeypatch.setattr(rollups, "_library", lambda path: Watched())
    assert rollups._counts(model_file(), pa.array(["one two three one"] * 1000)) == [len(model.encode("one two three one"))] * 1000
    assert sorted(seen) == ["one", "three", "two"]
