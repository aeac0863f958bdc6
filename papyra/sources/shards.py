"""Sharded JSONL corpora: a directory of shard files, or one .tar.zst that holds them.

A directory is read by one partition a shard. A zstd frame cannot be entered in its middle, so an archive is
one sequential partition that stops once every wanted shard was seen; `extract` turns it into a directory
(or write the read rows as Parquet) before repeated use.
"""

from __future__ import annotations

import io
import os
import re
import subprocess
import tarfile
import threading
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import stores

#: How many shards a corpus has, and what their files are called.
SHARDS = 28
LINE_SCHEMA = "shard int, line_no long, offset long, length int, line string"
BATCH = 2048
#: The program that unpacks where the zstandard library is missing.
ZSTD = "zstd"


def shard_name(index: int) -> str:
    return f"{index:04d}.jsonl"


def sidecar_name(index: int) -> str:
    return f"{index:04d}.oix"


def shard_index(name: str) -> int | None:
    """The shard of a member or file name; None if it is none."""
    m = re.fullmatch(r"(\d{4})\.jsonl", os.path.basename(name))
    return int(m[1]) if m else None


def wanted(shards: Iterable[int] | None, total: int = SHARDS) -> list[int]:
    """Sorted distinct shards, all by default; raises ValueError beyond the range."""
    out = sorted(set(range(total) if shards is None else shards))
    if out and not 0 <= out[0] <= out[-1] < total:
        raise ValueError(f"shards are numbered 0 to {total - 1}")
    return out


@contextmanager
def _archive(path: str) -> Iterator[tarfile.TarFile]:
    with stores.opened(path) as raw, _plain(raw) as plain, tarfile.open(fileobj=plain, mode="r|") as tar:
        yield tar


@contextmanager
def _plain(raw) -> Iterator:
    """The unpacked stream: by the library, or by the zstd program where that is not installed."""
    try:
        import zstandard
    except ImportError:
        zstandard = None
    if zstandard:
        with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as plain:
            yield io.BufferedReader(plain, 1 << 20)
        return
    with subprocess.Popen([ZSTD, "-dc", "-q"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as program:
        feeder = threading.Thread(target=_feed, args=(raw, program.stdin), daemon=True)
        feeder.start()
        try:
            yield program.stdout
        finally:  # most readers stop early
            program.kill()
            feeder.join()


def _feed(raw, sink) -> None:
    try:
        while part := raw.read(1 << 20):
            sink.write(part)
        sink.close()
    except OSError:  # the reader is done
        pass


def _lines(shard: int, f: Iterable[bytes]) -> Iterator[tuple]:
    at = 0
    for k, raw in enumerate(f):
        yield shard, k, at, len(raw), raw.rstrip(b"\n").decode()
        at += len(raw)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [("shard", pa.int32()), ("line_no", pa.int64()), ("offset", pa.int64()), ("length", pa.int32()), ("line", pa.string())]
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield out()
            held.clear()
    if held:
        yield out()


class _Shard(InputPartition):
    def __init__(self, path: str, shards: list[int]):
        super().__init__(path)
        self.path, self.shards = path, shards


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        text = options.get("shards")
        self.shards = wanted([int(x) for x in text.split(",")] if text else None, int(options.get("total", SHARDS)))
        self.kind = stores.kind(self.path)
        if self.kind is None:
            raise FileNotFoundError(self.path)

    def partitions(self) -> list[InputPartition]:
        if self.kind == "dir":
            there = [(k, f"{self.path}/{shard_name(k)}") for k in self.shards]
            return [_Shard(p, [k]) for k, p in there if stores.kind(p)]
        if not self.path.endswith(".zst"):
            raise ValueError(f"neither a directory nor a .zst archive: {self.path}")
        return [_Shard(self.path, self.shards)]

    def read(self, part: _Shard) -> Iterator[pa.RecordBatch]:
        if part.path.endswith(".jsonl"):
            with stores.opened(part.path) as f:
                yield from _batches(_lines(part.shards[0], io.BufferedReader(f, 1 << 20)))
            return
        left = set(part.shards)
        with _archive(part.path) as tar:
            for member in tar:
                k = shard_index(member.name)
                if k not in left:
                    continue
                yield from _batches(_lines(k, tar.extractfile(member)))
                left.discard(k)
                if not left:
                    return
        raise KeyError(f"not in the archive: {', '.join(map(shard_name, sorted(left)))}")


class ShardSource(DataSource):
    """spark.read.format("papyra_shards").option("shards", "0,3").load(path): LINE_SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "papyra_shards"

    def schema(self) -> str:
        return LINE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_lines(spark: SparkSession, path: str, shards: Iterable[int] | None = None, total: int = SHARDS) -> DataFrame:
    """(shard, line_no, offset, length, line) of a directory or an archive; offsets are bytes."""
    spark.dataSource.register(ShardSource)
    reader = spark.read.format("papyra_shards").option("total", str(total))
    if shards is not None:
        reader = reader.option("shards", ",".join(map(str, wanted(shards, total))))
    return reader.load(path)


def extract(path: str, names: Iterable[str], dest: str) -> list[str]:
    """Members of an archive as files of dest, in one pass; KeyError names those that are missing."""
    left, out = set(names), []
    os.makedirs(dest, exist_ok=True)
    with _archive(path) as tar:
        for member in tar:
            base = os.path.basename(member.name)
            if base in left:
                with open(f"{dest}/{base}", "wb") as f:
                    f.write(tar.extractfile(member).read())
                out.append(f"{dest}/{base}")
                left.discard(base)
                if not left:
                    return out
    raise KeyError(f"not in the archive: {', '.join(sorted(left))}")
