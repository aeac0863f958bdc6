"""Binary sidecars: a 28-byte little-endian row for each record of a shard."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stores
from .shards import shard_name, sidecar_name

# Fixed format: offset u64, length u32, doc_id u32, flags u8, three bytes of padding, text hash u64.
ROW = np.dtype([("offset", "<u8"), ("length", "<u4"), ("doc_id", "<u4"), ("flags", "u1"), ("pad", "V3"), ("text_hash", "<u8")])
SCHEMA = "shard int, line_no long, offset decimal(20,0), length long, doc_id long, flags int, text_hash decimal(20,0)"
LIMITS = {"offset": 2**64, "length": 2**32, "doc_id": 2**32, "flags": 2**8, "text_hash": 2**64}


def pack(rows: Iterable[dict]) -> bytes:
    """Rows as bytes; ValueError for a value beyond its field."""
    rows = list(rows)
    for r in rows:
        for k, limit in LIMITS.items():
            if not 0 <= r[k] < limit:
                raise ValueError(f"{k} {r[k]} is out of range")
    out = np.zeros(len(rows), ROW)
    for k in LIMITS:
        out[k] = np.array([r[k] for r in rows], dtype=out[k].dtype)
    return out.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    """The rows of a sidecar; ValueError if it ends inside a row. Padding is ignored."""
    if len(raw) % ROW.itemsize:
        raise ValueError(f"{len(raw)} bytes are no whole number of {ROW.itemsize}-byte rows")
    return np.frombuffer(raw, ROW)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of every .oix file at path; unsigned 64-bit numbers as decimal(20,0)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.oix").load(path)
    shard = F.regexp_extract("path", r"(\d{4})\.oix$", 1).cast("int")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, raw in zip(b.column("shard").to_pylist(), b.column("content").to_pylist(), strict=True):
                t, n = unpack(raw), len(raw) // ROW.itemsize
                wide = lambda c: pa.array(c, pa.uint64()).cast(pa.decimal128(20, 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, k, np.int32)), pa.array(np.arange(n)), wide(t["offset"]), pa.array(t["length"].astype(np.int64)), pa.array(t["doc_id"].astype(np.int64)), pa.array(t["flags"].astype(np.int32)), wide(t["text_hash"])],
                    ["shard", "line_no", "offset", "length", "doc_id", "flags", "text_hash"],
                )

    return files.select(shard.alias("shard"), "content").mapInArrow(run, SCHEMA)


def _streams(rows: DataFrame, columns: list[str], dest: str, each) -> DataFrame:
    """each(shard, batches) once a shard, in a task that streams the shard's rows in the order of line."""
    dealt = rows.select("shard", *columns).repartition("shard").sortWithinPartitions("shard", columns[0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[int, pa.RecordBatch]]:
            for b in batches:
                shard = b.column("shard").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
                for s, e in zip(cuts, cuts[1:]):
                    if e > s:
                        yield int(shard[s]), b.slice(s, e - s)

        for shard, group in itertools.groupby(parts(), key=lambda x: x[0]):
            n, size = each(shard, (b for _, b in group))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n]), pa.array([size])], ["shard", "records", "bytes"])

    return dealt.mapInArrow(run, "shard int, records long, bytes long")


def _put(batch: Iterable[dict], sink) -> None:
    sink.write(pack({k: int(r[k]) for k in LIMITS} for r in batch))


def write(rows: DataFrame, dest: str) -> None:
    """One .oix file a shard in a folder of any store that pyarrow knows, rows in the order of their offsets."""

    def one(shard: int, batches: Iterable[pa.RecordBatch]) -> tuple[int, int]:
        n = 0
        with stores.replacing(f"{dest}/{sidecar_name(shard)}") as sink:
            for b in batches:
                _put(b.to_pylist(), sink)
                n += b.num_rows
        return n, n * ROW.itemsize

    stores.make(dest)
    _streams(rows, ["offset", *(k for k in LIMITS if k != "offset")], dest, one).collect()  # a row a shard


def write_shards(rows: DataFrame, dest: str) -> DataFrame:
    """(shard, records, bytes) of rows(shard, line_no, line, doc_id, flags, text_hash) written as JSON lines
    with a sidecar each; offsets run from 0 in the order of line_no."""

    def one(shard: int, batches: Iterable[pa.RecordBatch]) -> tuple[int, int]:
        n = at = 0
        with stores.replacing(f"{dest}/{shard_name(shard)}") as text, stores.replacing(f"{dest}/{sidecar_name(shard)}") as index:
            for b in batches:
                entries = []
                for r in b.to_pylist():
                    raw = r["line"].encode() + b"\n"
                    text.write(raw)
                    entries.append({"offset": at, "length": len(raw), "doc_id": r["doc_id"], "flags": r["flags"], "text_hash": r["text_hash"]})
                    at += len(raw)
                _put(entries, index)
                n += b.num_rows
        return n, at

    stores.make(dest)
    out = _streams(rows, ["line_no", "line", "doc_id", "flags", "text_hash"], dest, one)
    return rows.sparkSession.createDataFrame(out.collect(), out.schema)  # a row a shard; the files are written once


def read_line(path: str, offset: int, length: int, keep_newline: bool = False) -> bytes:
    """One record of a shard file; ValueError if the entry does not fit the file."""
    with open(path, "rb") as f:
        f.seek(offset)
        raw = f.read(length)
    if len(raw) != length or not raw.endswith(b"\n"):
        raise ValueError(f"{path}: no line of {length} bytes at {offset}")
    return raw if keep_newline else raw[:-1]
