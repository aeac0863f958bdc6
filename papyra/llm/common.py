"""What the operators of this subpackage share: scratch tables, batches and row keys."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.sources.stored import shared_dir

#: Rows that one numpy step takes at most, and the bytes of text that end it earlier.
SLICE_ROWS, SLICE_BYTES = 512, 2_000_000


_held: dict[str, object] = {}


def held(operator: str, make: Callable[[], object] = dict) -> object:
    """What a worker keeps from batch to batch for one operator (tables of bounded size).

    Spark reuses workers, so another operator's state goes when it is asked for: a worker never holds more
    than one, and the sizes of a pipeline's stages do not add up.
    """
    if operator not in _held:
        if _held:
            _held.clear()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # no glibc
                pass
        _held[operator] = make()
    return _held[operator]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


class Scratch:
    """Tables and files of one run, below the shared folder; they go when the JVM ends or by drop()."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/papyra-{label}-{uuid.uuid4().hex}"
        p = self._hadoop(self.path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        self._n = 0
        # Spark 4.1 may take a union as partitioned where adaptive execution has coalesced its inputs
        # differently; an aggregation above then sees a key in two tasks.
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """df, written once: a cut of the lineage that outlives a lost executor."""
        self._n += 1
        path = f"{self.path}/{name}-{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._papyra_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables that nothing reads any more."""
        for t in tables:
            if t is not None and getattr(t, "_papyra_path", None):
                p = self._hadoop(t._papyra_path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def slices(batches: Iterable[pa.RecordBatch], text: str | None, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of SLICE_ROWS rows or about `most` bytes of the text column."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        if text is None:
            sizes = np.zeros(n, np.int64)
        else:
            sizes = pc.binary_length(b.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, total = 0, 0
        for i in range(n):
            total += int(sizes[i])
            if i + 1 - start >= SLICE_ROWS or total >= most or i + 1 == n:
                yield b.slice(start, i + 1 - start)
                start, total = i + 1, 0


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null is an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Each text; a null is an empty text."""
    return [x or "" for x in column.to_pylist()]


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as an empty text."""
    as_text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(as_text, F.lit("")).cast("binary")) % modulus


def parallel(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
