"""Offsets of records in shards: running offsets, lookups and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_offsets(lines: DataFrame, shard: str = "shard", order: str = "line_no", length: str = "length") -> DataFrame:
    """lines with offset, the bytes before each line in its shard."""
    w = Window.partitionBy(shard).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)).cast("long"))


def lookup(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """The entries of the wanted doc_ids; raises if an id is indexed twice."""
    if entries.groupBy("doc_id").count().where("count > 1").limit(1).count():
        raise ValueError("a doc_id is indexed more than once")
    return entries.join(wanted.select("doc_id").distinct(), "doc_id")


def verify(entries: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(shard, doc_id, rule) of every violation: start, length, duplicate, contiguity, eof."""
    place = Window.partitionBy("shard").orderBy("line_no")
    seen = entries.withColumns({
        "nr": F.row_number().over(place),
        "next": F.lead("offset").over(place),
        "copy": F.row_number().over(Window.partitionBy("doc_id").orderBy("shard", "line_no")),
    })
    if sizes is not None:
        seen = seen.join(sizes.select("shard", "size"), "shard", "left")
    else:
        seen = seen.withColumn("size", F.lit(None).cast("long"))
    end = F.col("offset") + F.col("length")
    rules = [
        F.when((F.col("nr") == 1) & (F.col("offset") != 0), F.lit("start")),
        F.when(F.col("length") < 1, F.lit("length")),
        F.when(F.col("copy") > 1, F.lit("duplicate")),
        F.when(F.col("next").isNotNull() & (end != F.col("next")), F.lit("contiguity")),
        F.when(F.col("next").isNull() & (end != F.col("size")), F.lit("eof")),
    ]
    return seen.select("shard", "doc_id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))
