from pyspark.sql import functions as F
import pytest

from papyra.functions import dates, stats, text
from papyra.operators import citations, embedding, evaluation, lexical, profile, retrieval, sidecar

EDITION = "act_id long, doc_id long, idx int, is_current boolean, status string, date string, begin_date string, end_date string, end_sentinel string"


@pytest.mark.parametrize(
    "begin, end, sentinel, status, current, want",
    [
        ("2010-01-01", None, "indefinite", "in force", True, "ACDE"),
        ("2010-01-01", None, "null", "in force", True, "CD"),
        ("2005-01-01", "2015-01-01", None, "in force", True, ""),
        ("2018-01-01", "2022-01-01", None, "in force", True, "ACDE"),
        ("2024-01-01", None, "indefinite", "in force", True, ""),
        (None, None, "null", "in force", True, ""),
        ("2010-01-01", "2023-01-01", None, "repealed", True, "DE"),
        ("2010-01-01", "2021-01-01", None, "not current", True, "DE"),
    ],
)
def test_point_in_time_readings(spark, begin, end, sentinel, status, current, want):
    df = spark.createDataFrame([(1, 1, 0, current, status, None, begin, end, sentinel)], EDITION)
    r = profile.pit_readings(df, ("2020-06-01",)).first()
    got = "".join(k for k, c in (("A", "a_strict"), ("C", "c_loose_end"), ("D", "d_no_status"), ("E", "e_any_edition")) if r[c])
    assert got == want


def test_nearest_rank_is_not_percentile(spark):
    df = spark.range(1, 101).withColumnRenamed("id", "x")
    assert [r.value for r in stats.quantiles(df, "x", [0.5, 0.9, 1.0]).orderBy("point").collect()] == [51, 91, 100]
    with pytest.raises(ValueError):
        stats.quantiles(df.limit(0), "x", [0.5])


def test_ordinals(spark):
    rows = [("2010-06-01", None), ("2010", None), ("", None), ("abcd-ef-gh", None), (None, "indefinite"), (None, "null")]
    df = spark.createDataFrame(rows, "d string, s string")
    got = df.select(dates.date_ordinal(F.col("d")).alias("a"), dates.end_ordinal(F.col("d"), F.col("s")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(20100601, 20100601), (None, None), (None, None), (None, None), (None, dates.OPEN_END), (None, None)]


def test_json_presence_tells_absent_from_null(spark):
    df = spark.createDataFrame([('{"a":1,"b":null}',), ('{"a":"","b":[]}',), ('{"a":0}',)], "line string")
    assert {tuple(r) for r in profile.json_presence(df).collect()} == {("a", 3, 2), ("b", 2, 0)}


def test_tokens_keep_codes(spark):
    df = spark.createDataFrame([("Приказ 311-РП и ещё 1.2.3 N 7 в 44-ФЗ",)], "t string")
    assert df.select(text.tokens(F.col("t"), text.WORDS_RU_LATIN)).first()[0] == ["приказ", "рп", "фз", "311-рп", "1.2.3", "44-фз"]


def test_sidecar_violations(spark):
    rows = [(0, 1, 0, 10, 0), (0, 2, 1, 5, 11), (0, 1, 2, 0, 16), (1, 4, 0, 3, 2)]
    df = spark.createDataFrame(rows, "shard int, doc_id long, line_no long, length long, offset long")
    sizes = spark.createDataFrame([(0, 99), (1, 5)], "shard int, size long")
    got = sorted(tuple(r) for r in sidecar.verify(df, sizes).collect())
    assert got == [(0, 1, "contiguity"), (0, 1, "duplicate"), (0, 1, "eof"), (0, 1, "length"), (1, 4, "start")]


def _hits(spark, rows):
    return spark.createDataFrame([(1, c, a, 0.0, r) for r, (c, a) in enumerate(rows, 1)], "query_id long, chunk_id string, act_id long, score double, rank int")


def test_fusion_caps_and_collapse(spark):
    a, b = _hits(spark, [("c1", 1), ("c2", 1), ("c3", 2)]), _hits(spark, [("c3", 2), ("c1", 1), ("c4", 1)])
    fused = retrieval.fuse([a, b])
    order = [r.chunk_id for r in fused.orderBy("rank").collect()]
    assert order == ["c1", "c3", "c2", "c4"]
    assert [r.chunk_id for r in retrieval.cap(fused, 1).orderBy("rank").collect()] == ["c1", "c3"]
    assert retrieval.collapse(fused).count() == 2


def test_metrics_count_misses(spark):
    hits = _hits(spark, [("c1", 1), ("c2", 2)])
    gold = spark.createDataFrame([(1, 2, None), (2, 9, None)], "query_id long, act_id long, chunk_id string")
    queries = spark.createDataFrame([(1, "x"), (2, "x")], "query_id long, type string")
    r = evaluation.metrics(hits, gold, queries).collect()
    assert len(r) == 1 and (r[0].level, r[0].n, r[0].recall_at_1, r[0].recall_at_5, r[0].mrr, r[0].ndcg_at_10) == ("act", 2, 0.0, 0.5, 0.25, 0.3155)


@pytest.mark.parametrize("seed", range(4))
def test_shuffled_gold_always_differs(spark, seed):
    gold = spark.createDataFrame([(q, q // 3) for q in range(15)], "query_id long, act_id long")
    rows = evaluation.shuffled_gold(gold, seed).collect()
    assert len(rows) == 15 and all(r.shuffled is not None and r.shuffled != r.act_id for r in rows)


def test_search_pads_on_request(spark):
    chunks = spark.createDataFrame([(k, f"word{k} common") for k in range(5)], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "word common"), (2, "absent")], "query_id long, query string")
    index = lexical.build(chunks)
    assert lexical.search(index, queries, 3).count() == 3
    assert lexical.search(index, queries, 3, pad_with=chunks).count() == 6


def test_answers(spark):
    docs = spark.createDataFrame([(42, "Alpha beta gamma. Delta.")], "doc_id long, text string")
    rows = [(1, "x [[42:0-10]] [[42:0-10]] [[103271]]", {"[42:0-10]": "Alpha  beta"}), (2, "none", {}), (3, "[[42:0-99]] [[7:0-1]] [[42:5-5]]", {"42:0-99": ""})]
    df = spark.createDataFrame(rows, "answer_id long, answer string, quotes map<string,string>")
    r = {x.answer_id: x for x in citations.verify(df, docs).collect()}
    assert (r[1].citations, r[1].unique_citations, r[1].malformed_citations, r[1].resolvable, r[1].quote_verbatim, r[1].quote_verbatim_share) == (2, 1, 1, 1, 1, 0.5)
    assert r[2].references_total == 0 and r[2].resolvable_share is None
    assert [f.reason for f in r[3].failures] == [citations.OUTSIDE, citations.NO_QUOTE, citations.NO_QUOTE]


def test_windows_resume_whole(spark):
    chunks = spark.createDataFrame([(1, k, f"c{k}", f"text {k}") for k in range(5)], "doc_id long, chunk_index int, chunk_id string, text string")
    windowed = embedding.windows(chunks, 2)
    plan = embedding.resume_plan(windowed, spark.createDataFrame([("c0",), ("c2",), ("c3",)], "chunk_id string"))
    assert sorted((r.chunk_id, r.store) for r in plan.collect()) == [("c0", False), ("c1", True), ("c4", True)]
    made = embedding.embed(plan, chunks, embedding.make_embedder("hash", dim=8))
    assert sorted(r.chunk_id for r in made.collect()) == ["c1", "c4"]
    with pytest.raises(ValueError):
        embedding.make_embedder("nothing")


def test_dense_search_reads_queries_in_blocks(spark, monkeypatch):
    import numpy as np

    from papyra.operators import retrieval

    monkeypatch.setattr(retrieval, "STEP", 3)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 5))
    chunks = spark.createDataFrame([(k, k % 9, v.tolist()) for k, v in enumerate(x)], "chunk_id long, act_id long, v array<double>")
    queries = chunks.where("chunk_id % 2 = 0").selectExpr("chunk_id as query_id", "v")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    want = {(q, int(c), k + 1) for q in range(0, 60, 2) for k, c in enumerate(np.lexsort((np.arange(60), -s[q]))[:4])}
    for size in (7, 29, 30, 100):
        got = [(r.query_id, r.chunk_id, r.rank) for r in retrieval.dense(queries, chunks, 4, max_queries=size).collect()]
        assert len(got) == 120 and set(got) == want


def test_truncation_geometry_of_all_vectors(spark, monkeypatch):
    import numpy as np

    from papyra.operators import retrieval
    from papyra.plans import registry

    monkeypatch.setattr(retrieval, "STEP", 64)
    monkeypatch.setattr(retrieval, "BLOCK", 30)
    sf = "/root/testdata/sf0.001"
    x = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], float)
    at = np.triu_indices(len(x), 1)
    f, c = (np.round((u := y / np.linalg.norm(y, axis=1, keepdims=True)) @ u.T, 9)[at] for y in (x, x[:, :16]))
    (r,) = registry.QUERIES["mrl_geometry_all"](spark, sf).collect()
    assert r.pairs == len(f) > 10_000
    assert abs(r.pearson - np.corrcoef(f, c)[0, 1]) < 2e-6 and abs(r.mean_shift - np.abs(f - c).mean()) < 2e-6


def test_dense_scores_round_as_sql_does(spark):
    """Exact halves of the last digit go away from zero; without letters the score is NaN, before all others."""
    import duckdb

    vectors = {1: [7.0, 24.0], 2: [0.0, 0.0], 3: [-7.0, 24.0], 4: [55.0, 300.0], 5: [1.0, 2.0]} | {k: [float(k % 11), float(k * k % 13)] for k in range(6, 60)}
    chunks = spark.createDataFrame([(k, k, v) for k, v in vectors.items()], "chunk_id long, act_id long, v array<double>")
    asked = {1: [80.0, 18.0], 2: [1.0, 0.0], 3: [3.0, 4.0], 4: [0.0, 0.0]}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, v array<double>")
    con = duckdb.connect()
    con.execute("create table e (k bigint, v double[])")
    con.execute("create table q (k bigint, v double[])")
    con.executemany("insert into e values (?, ?)", list(vectors.items()))
    con.executemany("insert into q values (?, ?)", list(asked.items()))
    for digits in (1, 2, 3, 6):
        want = con.sql(f"select * from (select q.k as q, e.k as e, round(list_cosine_similarity(q.v, e.v), {digits}) as s, row_number() over (partition by q.k order by s desc, e.k) as r from q, e) where r <= 5").fetchall()
        got = [(r.query_id, r.chunk_id, r.score, r["rank"]) for r in retrieval.dense(queries, chunks, 5, digits).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_metrics_round_as_sql_does(spark):
    """Means whose decimal text ends in a half, but whose binary value may be below it."""
    import duckdb

    con = duckdb.connect()
    for n, first in ((200, [50, 100]), (200, [20, 100, 100]), (400, [20, 100])):
        queries = spark.createDataFrame([(k,) for k in range(n)], "query_id long")
        gold = queries.selectExpr("query_id", "query_id as act_id")
        hits = spark.createDataFrame([(k, k, r) for k, r in enumerate(first)], "query_id long, act_id long, rank int")
        want = con.sql(f"select round(avg(x), 4) from (select unnest({[1 / r for r in first] + [0.0] * (n - len(first))}::double[]) as x)").fetchall()[0][0]
        assert evaluation.metrics(hits, gold, queries, ("act_id",)).first().mrr == want
