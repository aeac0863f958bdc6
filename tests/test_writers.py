"""Slices and their sidecars, question sets, whole profiles, chunk summaries, archives without the library."""

import json
import os
import sys

import pytest
from pyspark.sql import functions as F

from papyra.operators import basket, chunking, lexical, profile, slicing
from papyra.plans import surrogate
from papyra.sources import shards, sidecars, stores

SF = "/root/testdata/sf0.001"


def test_slice_with_sidecars(spark, tmp_path):
    rows = [(s, 10 * s + k, k) for s in (0, 3) for k in range(4)]
    lines = spark.createDataFrame([(s, k, json.dumps({"doc_id": d, "text": "é" * k})) for s, d, k in rows], "shard int, line_no long, line string")
    editions = spark.createDataFrame([(d % 3, d, d % 2 == 0, d % 5 == 0, True, f"{d:016x}" if d != 31 else "no hash") for _, d, _ in rows], "act_id long, doc_id long, is_stub boolean, has_contents boolean, is_current boolean, text_hash string")
    chosen = editions.where("act_id <> 1").select("act_id").distinct()
    dest = f"file://{tmp_path}/slice"
    report = {r.shard: (r.records, r.bytes) for r in slicing.write_slice(slicing.slice_rows(lines, chosen, editions), dest).collect()}
    kept = [(s, d, k) for s, d, k in rows if d % 3 != 1]
    assert {s: n for s, (n, _) in report.items()} == {s: sum(x == s for x, *_ in kept) for s in (0, 3)}
    index = {(r.shard, r.doc_id): r for r in sidecars.read(spark, dest).collect()}
    assert set(index) == {(s, d) for s, d, _ in kept}
    for s, d, k in kept:
        r = index[s, d]
        path = f"{tmp_path}/slice/{shards.shard_name(s)}"
        assert json.loads(sidecars.read_line(path, int(r.offset), r.length)) == {"doc_id": d, "text": "é" * k}
        assert r.flags == (d % 2 == 0) + 2 * (d % 5 == 0) + 4 and int(r.text_hash) == (d if d != 31 else 0)
    assert sum(n for _, n in report.values()) == sum(os.path.getsize(f"{tmp_path}/slice/{shards.shard_name(s)}") for s in (0, 3))
    assert not [f for f in os.listdir(f"{tmp_path}/slice") if f.endswith(".part")]


def test_half_written_files_do_not_stay(tmp_path):
    with pytest.raises(ZeroDivisionError), stores.replacing(f"{tmp_path}/x") as sink:
        sink.write(b"a")
        1 / 0
    assert os.listdir(tmp_path) == [] and stores.kind(f"{tmp_path}/x") is None and stores.kind(str(tmp_path)) == "dir"


def test_archive_through_a_program(spark, tmp_path, monkeypatch):
    import io
    import tarfile

    import zstandard

    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for k in range(2):
            body = f'{{"doc_id": {k}}}\n'.encode() * 3
            info = tarfile.TarInfo(f"c/{shards.shard_name(k)}")
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    path = tmp_path / "c.tar.zst"
    path.write_bytes(zstandard.compress(raw.getvalue()))
    program = tmp_path / "unpack"  # stands in for the zstd program
    program.write_text(f"#!{sys.executable}\nimport sys, zstandard\nzstandard.ZstdDecompressor().copy_stream(sys.stdin.buffer, sys.stdout.buffer)\n")
    program.chmod(0o755)
    monkeypatch.setattr(shards, "ZSTD", str(program))
    monkeypatch.setitem(sys.modules, "zstandard", None)
    (got,) = shards.extract(str(path), [shards.shard_name(1)], str(tmp_path / "out"))
    assert open(got).read() == '{"doc_id": 1}\n' * 3


def test_temporal_semantic_queries(spark):
    editions = spark.createDataFrame(
        [(1, 10, "2010-01-01", "2010-12-31"), (1, 11, "2011-01-01", "2011-12-31"), (1, 12, "2012-01-01", None), (2, 20, "2010-01-01", None), (3, 30, "2010-01-01", "2010-02-01"), (3, 31, "2010-02-02", None)],
        "act_id long, doc_id long, begin_date string, end_date string",
    )
    text = "x" * 400
    chunks = spark.createDataFrame([(10, 0, "short"), (10, 1, text), (10, 2, "y" * 500), (11, 0, text), (12, 0, text), (20, 0, text), (30, 0, text), (31, 0, "short")], "doc_id long, chunk_index int, text string")
    pairs = basket.temporal_pairs(editions, chunks, 7)
    assert sorted((r.act_id, r.doc_id, r.which, r.text) for r in pairs.collect()) == [(1, 10, "first", text), (1, 12, "last", text)]  # act 3 lacks a text at one end
    made = spark.createDataFrame([(10, " What holds? "), (12, " ")], "doc_id long, question string")
    (q,) = basket.temporal_semantic(pairs, made, 5).collect()
    assert (q.query_id, q.type, q.act_id, q.doc_id, q.as_of, q.query) == ("tsem-1-0", "temporal_semantic", 1, 10, "2010-07-02", "What holds? (as of 2010-07-02)")
    assert basket.rejected(pairs, made).first()[:] == (2, 1)
    other = spark.createDataFrame([("m-1", "manual", "by hand", 5)], "query_id string, type string, query string, act_id long")
    whole = basket.assembled([other, basket.temporal_semantic(pairs, made, 5)], 7)
    assert {(r.query_id, r.doc_id, r.part) for r in whole.collect()} == {("m-1", None, "test"), ("tsem-1-0", 10, "test")}
    assert {r.type: r.n for r in basket.counts(whole).collect()} == {"manual": 1, "temporal_semantic": 1}


def test_full_pass(spark):
    editions = surrogate.editions(spark, SF)
    out = profile.full_pass(editions, ("1995-06-01",))
    n = editions.count()
    assert out["throughput"].first().records == n and out["totals"].first().records == n and out["throughput"].first().records_per_s > 0
    assert out["pit_readings"].collect() == profile.pit_readings(editions, ("1995-06-01",)).collect()
    out["editions"].unpersist()


def test_chunk_summary_of_nothing(spark):
    docs = spark.createDataFrame([(1, 1, "t", None), (2, 1, "t", "")], "doc_id long, act_id long, title string, text string")
    r = chunking.chunk_summary(chunking.chunk_documents(docs), docs).first()
    assert (r.documents, r.chunks, r.chars_max, r.per_document_max, r.chars_mean, r.coverage_pct) == (2, 0, 0, 0, 0, 0)


def test_index_is_written_and_read(spark, tmp_path):
    rows = [("a", "alpha beta alpha 12"), ("b", "beta"), ("c", ""), ("d", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    built = lexical.build(chunks)
    built.write(str(tmp_path / "index"))
    read = lexical.LexicalIndex.read(spark, str(tmp_path / "index"))
    for name in ("postings", "terms", "stats"):
        assert sorted(map(tuple, getattr(read, name).select(*getattr(built, name).columns).collect())) == sorted(map(tuple, getattr(built, name).collect()))
    assert {tuple(r) for r in read.postings.select("chunk_id", "term", "tf", "dl").collect()} == {("a", "alpha", 2, 4), ("a", "beta", 1, 4), ("a", "12", 1, 4), ("b", "beta", 1, 1)}
    assert read.stats.first()[:] == (4, 5 / 4)
    q = spark.createDataFrame([(1, "alpha beta")], "query_id long, query string")
    assert lexical.search(read, q, 5).collect() == lexical.search(built, q, 5).collect()
    plan = lexical.build(chunks).postings._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange") == 1  # the texts, by chunk


def test_exploded_terms_carry_no_array(spark):
    chunks = spark.createDataFrame([("a", "alpha beta")], "chunk_id string, text string")
    plan = lexical.build(chunks).postings._jdf.queryExecution().optimizedPlan().toString()
    (generate,) = [x for x in plan.splitlines() if "Generate explode" in x]
    assert generate.count("explode") == 1 and plan.count("regexp_extract_all") == 2  # words and codes, once each
    assert "[2]" in generate  # the array is not among the columns that go on


def test_index_is_dealt_by_the_size_of_its_files(spark, tmp_path, monkeypatch):
    """Tasks grow in number, not in size; a chunk's terms are counted inside its row."""
    rows = [(k, f"bb aa bb aa aa 12 {'c' * (k % 7)}" if k % 5 else None) for k in range(200)]
    spark.createDataFrame(rows, "chunk_id long, text string").repartition(3).write.parquet(str(tmp_path / "texts"))
    chunks = spark.read.parquet(str(tmp_path / "texts"))
    size = sum(f.stat().st_size for f in (tmp_path / "texts").glob("*.parquet"))
    monkeypatch.setattr(lexical, "SHARE", 1000)
    built = lexical.build(chunks)
    assert built.postings.rdd.getNumPartitions() == -(-size // 1000) > 1
    assert "Aggregate" not in built.postings._jdf.queryExecution().executedPlan().toString()
    got = {tuple(r) for r in built.postings.collect()}
    want = {(k, 6 + (k % 7 > 1), t, n) for k in range(200) if k % 5 for t, n in (("aa", 3), ("bb", 2), ("12", 1), ("c" * (k % 7), 1)) if len(t) > 1}
    assert got == want
