"""Tables that several queries of a session read: built once, below the shared folder, and read from there."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_BUILT: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a new local one where that is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="papyra-")
        spark.conf.set("spark.checkpoint.dir", path)
    return (path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path)).rstrip("/")


def _state(spark: SparkSession, path: str) -> tuple:
    """What changes when the files of path do: their number, bytes and latest time."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    times = [f.getModificationTime() for f in fs.listStatus(p)]
    return path, len(times), fs.getContentSummary(p).getLength(), max(times, default=0)


def stored(spark: SparkSession, label: str, sources: list[str], build: Callable[[str], None]) -> str:
    """The folder that build(folder) filled from the sources, in this session and from their present files."""
    key = (spark.sparkContext.applicationId, label, *(_state(spark, p) for p in sources))
    if key not in _BUILT:
        path = f"{shared_dir(spark)}/papyra-stored-{label}-{uuid.uuid4().hex}"
        build(path)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
        _BUILT[key] = path
    return _BUILT[key]
