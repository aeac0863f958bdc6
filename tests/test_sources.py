import io
import json
import tarfile

import pytest
import zstandard

from papyra.operators import embedding
from papyra.sources import files, shards, sidecars
from papyra.streaming import incremental

LINES = {0: ['{"doc_id":3,"t":"Ёж 😀"}', '{"doc_id":1}'], 2: ['{"doc_id":2}', "{}", '{"doc_id":9}']}


@pytest.fixture
def corpus(tmp_path):
    d = tmp_path / "dir"
    d.mkdir()
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        for k, lines in LINES.items():
            raw = "".join(x + "\n" for x in lines).encode()
            (d / shards.shard_name(k)).write_bytes(raw)
            info = tarfile.TarInfo("x/" + shards.shard_name(k))
            info.size = len(raw)
            t.addfile(info, io.BytesIO(raw))
    a = tmp_path / "c.tar.zst"
    a.write_bytes(zstandard.compress(tar.getvalue()))
    return str(d), str(a)


def test_archive_equals_directory(spark, corpus):
    d, a = corpus
    rows = [sorted(map(tuple, shards.read_lines(spark, p, [0, 2]).collect())) for p in (d, a)]
    assert rows[0] == rows[1] and len(rows[0]) == 5
    for shard, _, offset, length, line in rows[0]:
        assert sidecars.read_line(f"{d}/{shards.shard_name(shard)}", offset, length) == line.encode()
    assert shards.read_lines(spark, d).count() == 5
    with pytest.raises(Exception, match="0001"):
        shards.read_lines(spark, a, [1]).count()
    with pytest.raises(ValueError):
        shards.wanted([28])


def test_extract(corpus, tmp_path):
    d, a = corpus
    (out,) = shards.extract(a, ["0002.jsonl"], str(tmp_path / "out"))
    assert open(out).read() == open(f"{d}/0002.jsonl").read()
    with pytest.raises(KeyError, match="0007"):
        shards.extract(a, ["0007.jsonl"], str(tmp_path / "out"))


def test_sidecar_codec(spark, tmp_path):
    rows = [{"offset": 0, "length": 5, "doc_id": 61219, "flags": 5, "text_hash": 2**64 - 1}, {"offset": 5, "length": 7, "doc_id": 61218, "flags": 0, "text_hash": 0}]
    raw = sidecars.pack(rows)
    assert len(raw) == 56 and sidecars.unpack(raw)["doc_id"].tolist() == [61219, 61218]
    with pytest.raises(ValueError):
        sidecars.unpack(raw[:-1])
    with pytest.raises(ValueError):
        sidecars.pack([rows[0] | {"doc_id": 2**32}])
    (tmp_path / "0003.oix").write_bytes(raw)
    read = sidecars.read(spark, str(tmp_path))
    assert {(r.shard, r.line_no, int(r.text_hash)) for r in read.collect()} == {(3, 0, 2**64 - 1), (3, 1, 0)}
    sidecars.write(read.drop("line_no"), str(tmp_path / "again"))
    assert (tmp_path / "again/0003.oix").read_bytes() == raw


def test_jsonl_cache_and_report(spark, tmp_path):
    p = tmp_path / "cache"
    p.mkdir()
    (p / "a.json").write_text('{"chunk_id":"a","v":[1.0]}\n{"chunk_id":"b","v":[2.')
    assert [r.chunk_id for r in files.cached_ids(spark, str(p)).collect()] == ["a"]
    with pytest.raises(Exception):
        files.cached_vectors(spark, str(p)).collect()
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    files.write_jsonl(df, str(tmp_path / "o"), ["a"])
    assert files.read_jsonl(spark, str(tmp_path / "o"), "a long, b string").count() == 2
    files.report(df, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == [{"a": 1, "b": None}, {"a": 2, "b": "x"}]


def test_stream_adds_each_vector_once(spark, tmp_path):
    schema = "doc_id long, chunk_index int, chunk_id string, text string"
    new = lambda ids: spark.createDataFrame([(1, k, f"c{k}", f"t {k}") for k in ids], schema)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for ids in ([0, 1, 2], [2, 3]):
        new(ids).coalesce(1).write.mode("append").parquet(src)
        incremental.embed_new_chunks(spark, src, schema, out, str(tmp_path / "cp"), embedding.HashEmbedder(4)).awaitTermination(60)
    assert sorted(r.chunk_id for r in spark.read.parquet(out).collect()) == ["c0", "c1", "c2", "c3"]


def test_event_windows(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src.replace("/events.parquet", "/event*.parquet"))
    q = incremental.event_counts(stream).writeStream.format("memory").queryName("ev").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from ev").first()[0] == spark.read.parquet(src).count()
