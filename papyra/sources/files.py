"""Stage hand-offs as files: JSON lines, vector caches, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """JSON lines of a declared schema; a malformed line raises."""
    out = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return out.limit(limit) if limit else out


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines, nulls included; ordered over the whole set where order is given."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def cached_ids(spark: SparkSession, path: str) -> DataFrame:
    """chunk_ids of a vector cache; a truncated line, as a broken run leaves it, is passed over."""
    rows = spark.read.schema("chunk_id string, v array<double>, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null and chunk_id is not null").select("chunk_id").distinct()


def cached_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, v) of a vector cache; a malformed line raises."""
    return read_jsonl(spark, path, "chunk_id string, v array<double>")


def append_vectors(new: DataFrame, path: str) -> None:
    new.select("chunk_id", F.col("v").cast("array<double>")).write.mode("append").json(path)


def report(df: DataFrame, path: str, most: int = 10_000) -> None:
    """A small result as indented JSON; raises beyond `most` rows."""
    rows = [json.loads(r.j) for r in df.limit(most + 1).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False, indent=2)
