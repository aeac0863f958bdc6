"""Unions that later aggregations can rely on."""

from functools import reduce

from pyspark.sql import DataFrame


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of the frames, by column name.

    Spark 4.1 may take a union of equally partitioned inputs as partitioned itself, although adaptive
    execution coalesced the inputs differently; an aggregation above then sees a key in two tasks. That
    inference is switched off for the session, so the aggregation shuffles as it did before.
    """
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(DataFrame.unionByName, frames)
