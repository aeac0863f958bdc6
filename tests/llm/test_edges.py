"""Each operator on nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from papyra.llm import html_text, langid, line_dedup, lm, neighbours, packing, pieces, resampling, simhash, spotsigs
from papyra.llm.common import Scratch
from papyra.llm.graph import connected_components

LONG = "the house of the old man is near a river and it flows " * 6000
ROWS = [
    (1, "The cat sat on the mat.\nA second line of this text.", "en", "s", 5, "clash"),
    (1, "The cat sat on the mat.\nA second line of this text.", "en", "s", 5, "clash"),
    (2, None, None, None, None, None),
    (3, "", "en", "s", 0, ""),
    (4, " \n\t ", "fr", "s", 4, "x"),
    (None, "der die das und ist ein Haus", "de", None, 3, "y"),
    (5, LONG, "en", "s", 9, "z"),
    (6, "12345 !!! ???", None, "s", 1, "q"),
    (7, "naïve 😀 café \x00 ﬁn ▁", "fr", "s", 1, "w"),
]
SCHEMA = "doc_id long, text string, lang string, source string, score long, selected string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_language(spark, docs, none):
    learned = langid.profiles(docs)
    out = {(r.doc_id, r.text): r for r in langid.identify(docs, learned).collect()}
    assert len(out) == len(ROWS) - 1
    for i in (2, 3, 4, 6):
        (r,) = [x for (d, _), x in out.items() if d == i]
        assert (r.lang_pred, r.score) == ("und", 0.0)
    assert out[5, LONG].lang_pred == "en" and out[None, ROWS[5][1]].lang_pred == "de"
    assert all(0 <= r.score <= 1 and r.selected == dict((x[:2], x[5]) for x in ROWS)[k] for k, r in out.items())
    assert langid.identify(none, learned).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.profiles(none)).collect()} == {"und"}


def test_language_ties_go_to_the_first_name(spark):
    docs = spark.createDataFrame([(1, "abc", "b"), (2, "abc", "a")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(docs, langid.profiles(docs)).collect()} == {"a"}


def test_resampling(spark, docs, none):
    ids = spark.createDataFrame([(1,), (5,), (None,), (99,)], "doc_id long")
    out = resampling.resample(docs, ids, k=3)
    rows = out.collect()
    assert len(rows) == len(ROWS) and "text" not in out.columns and out.columns.count("selected") == 1
    assert all(not r.selected for r in rows if r.n_grams == 0)
    twins = [r for r in rows if r.doc_id == 1]
    assert twins[0].key == twins[1].key and twins[0].selected == twins[1].selected
    best = sorted((r.key for r in rows), reverse=True)[:3]
    assert {r.key for r in rows if r.selected} == set(best)
    assert resampling.resample(none, ids, k=3).count() == 0
    assert all(r.selected == (r.n_grams > 0) for r in resampling.resample(docs, ids.limit(0)).collect())


def test_lines(spark, docs, none):
    out = line_dedup.dedup_lines(docs, min_words=4)
    rows = {(r.doc_id, r.source, r.score): r for r in out.collect()}
    assert out.count() == len(ROWS) and out.columns.count("text") == 1
    assert rows[2, None, None].text is None and rows[3, "s", 0].text == ""
    assert rows[5, "s", 9].text == LONG and rows[1, "s", 5].removed == []
    assert line_dedup.dedup_lines(none).count() == 0


def test_simhash(spark, docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {2, 3, 4} and {r.component_id for r in zero} == {2}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 5, 6, 7]
    assert simhash.deduplicate(none).count() == 0


def test_packing(spark, docs, none):
    out = packing.pack(docs, capacity=512)
    rows = out.collect()
    assert sum(r.length for r in rows if r.doc_id == 2) == 1 and sum(1 for r in rows if r.doc_id == 1) == 2
    assert sum(1 for r in rows if r.doc_id == 5) > 100
    _gapless(rows, 512)
    assert packing.pack(none).count() == 0


def _gapless(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity


def test_model(spark, docs, none):
    model = lm.train(docs, Scratch(spark, "t"), ranges=3)
    out = lm.score(docs, model)
    rows = out.collect()
    assert len(rows) == len(ROWS) and out.columns.count("score") == 1
    assert all(r.score < 0 and r.base_score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert lm.score(none, model).count() == 0
    empty = lm.score(docs, lm.train(none, Scratch(spark, "t"), ranges=2)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in empty)


@pytest.mark.parametrize("order", [2, 3])
def test_model_has_ranges_by_the_size_of_its_texts(spark, docs, none, monkeypatch, order):
    rows = lambda model: sorted(((r.doc_id, r.n_tokens, round(r.score, 9)) for r in lm.score(docs, model).collect()), key=repr)
    want = rows(lm.train(docs, Scratch(spark, "t"), ranges=3, order=order))
    monkeypatch.setattr(lm, "RANGE", 40)
    model = lm.train(docs, Scratch(spark, "t"), order=order)
    size = docs.selectExpr("sum(octet_length(text))").first()[0]
    assert model.ranges == max(4, -(-size // 40)) > 4
    assert rows(model) == want
    assert lm.train(none, Scratch(spark, "t"), order=order).ranges == 4


def test_pieces(spark, docs, none):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = pieces.encode(docs.withColumn("whole", F.col("text")))
    for r in out.collect():
        assert r.ids == sp.encode(r.whole or "") and r.lossless == ("▁" not in (r.whole or ""))
    back = pieces.decode(out)
    assert all(r.text == (r.whole or "") for r in back.where("lossless").collect())
    assert pieces.encode(none).count() == 0 and pieces.decode(out.limit(0)).count() == 0


def test_spotsigs(spark, docs, none):
    rows = spotsigs.compare_with_edited(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    twins = [r for r in rows if r.doc_id == 1]
    assert twins[0].fingerprint == twins[1].fingerprint
    assert len({r.fingerprint for r in rows if r.doc_id in (2, 3)}) == 1
    assert spotsigs.compare_with_edited(none).count() == 0
    assert spotsigs.fingerprints(docs.withColumn("fingerprint", F.lit(1))).columns.count("fingerprint") == 1
    found = spotsigs.near_duplicates(docs).collect()
    assert len(found) == len(ROWS) and {r.component_id for r in found if r.doc_id in (2, 3)} == {2}
    assert {r.component_id for r in found if r.doc_id == 1} == {1}
    assert spotsigs.near_duplicates(none).count() == 0
    with pytest.raises(ValueError):
        spotsigs.near_duplicates(docs, 0.0)


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [2.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, None], 1), (10, [1.0], 1), (11, [1.0, 0.0], 2), (12, [1e-200, 1e-202], 1), (13, [], 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    out = sorted(tuple(r) for r in neighbours.near_duplicates(df).collect())
    linked = [(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (3, 4, 1, False)]
    assert out == linked + [(k, 0, k, True) for k in range(4, 12)] + [(12, 4, 1, False), (13, 0, 13, True)]
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_pages(spark):
    model = html_text.train([], n_pages=60)
    rows = [(1, "u", None, "clash"), (1, "u", "", "clash"), (2, None, "plain words only", "c"), (3, "v", "<p>" * 3000 + "deep", "c"), (4, "w", "<article><h1>A &amp; B</h1><p>one  two&#x21;</p><p>unclosed <b", "c"), (4, "w", "<script>var x='<p>no</p>'", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_text.extract(df, model)
    got = out.collect()
    assert len(got) == 6 and out.columns.count("text") == 1 and all(r.n_chars == len(r.text) for r in got)
    assert all(r.text == "" for r in got if r.page_id == 1)
    assert html_text.extract(df.limit(0), model).count() == 0
    assert [b.text for b in html_text.blocks(rows[4][2])] == ["A & B", "one two!", "unclosed"]
    assert html_text.blocks(rows[5][2]) == []


def test_worker_keeps_one_operators_state():
    from papyra.llm import common

    first = common.held("one")
    first["x"] = 1
    assert common.held("one") is first
    assert common.held("two") == {} and common.held("one") == {}


def test_columns_named_like_an_operators_own(spark):
    rows = [(1, "a b c d\ne f g h", 5, 6), (2, "a b c d\ne f g h", 7, 8), (3, "something else", 9, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line_doc int, TEXT_HASH int")
    assert sorted(tuple(r)[2:] for r in simhash.deduplicate(df).collect()) == [(5, 6), (9, 10)]
    assert sorted((r.line_doc, r.TEXT_HASH) for r in line_dedup.dedup_lines(df, 4).collect()) == [(5, 6), (7, 8), (9, 10)]
    marked = df.select("doc_id", "text", df.line_doc.alias("is_target"), df.TEXT_HASH.alias("known_id"))
    got = resampling.resample(marked, spark.createDataFrame([(1,)], "doc_id long"), k=2).collect()
    assert sorted((r.is_target, r.known_id) for r in got) == [(5, 6), (7, 8), (9, 10)]


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from papyra.llm import common

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        common.shared_dir(cluster)


def test_few_links_make_few_files(spark, monkeypatch):
    """A round's tables have as many files as their rows ask for, not one a partition of a shuffle."""
    files, table = {}, Scratch.table

    def counted(self, df, name="t"):
        out = table(self, df, name)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(Scratch, "table", counted)
    monkeypatch.setattr("papyra.llm.graph.TASK_ROWS", 200)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + F.when(F.col("id") % 8 < 7, 1).otherwise(0)).alias("b"))
        got = {(r.node, r.component) for r in connected_components(edges, Scratch(spark, "test")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {(k, k // 8 * 8) for k in range(400)}
    assert max(files["large"] + files["small"]) <= 2 < max(files["edges"])


def test_language_works_on_little_text_at_once(spark, monkeypatch):
    """Two million letters in one Arrow batch: the steps of both passes hold arrays for a part of them only."""
    text = ["".join(x) for x in np.random.default_rng(3).choice(list("abcde "), (500, 4000))]
    docs = spark.createDataFrame([(1, "abcde", "a"), (2, "edcba", "b")], "doc_id long, text string, lang string")
    learned, runs, plain = langid.profiles(docs), [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, *a, **b: runs.append(run) or plain(self, run, *a, **b))
    langid.profiles(docs)
    langid.identify(docs, learned)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(500)), "text": text, "lang": ["a", "b"] * 250})

    def peak(run):
        tracemalloc.start()
        try:
            out = pa.Table.from_batches(run(iter([batch])))
            return out.sort_by([(c, "ascending") for c in out.column_names]), tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    assert len(runs) == 2
    parts = [peak(run) for run in runs]
    assert max(mb for _, mb in parts) < 60, [mb for _, mb in parts]
    monkeypatch.setattr(langid, "SLICE_BYTES", 100_000_000)
    assert [t.to_pydict() for t, _ in parts] == [peak(run)[0].to_pydict() for run in runs]
