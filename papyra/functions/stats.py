"""Shares and nearest-rank quantiles."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, rounded; 0 if whole is 0."""
    return F.coalesce(F.round(part * F.lit(100.0) / F.nullif(whole, F.lit(0)), digits), F.lit(0.0))


def nearest_ranks(n: int, points: list[float]) -> list[int]:
    """0-based ranks min(n - 1, floor(p * n))."""
    return [min(n - 1, int(p * n)) for p in points]


#: Ranges that values are counted in; the driver gets a row each.
BINS = 4096


def quantiles(df: DataFrame, column: str, points: list[float], allow_empty: bool = False) -> DataFrame:
    """(point, value): the value of rank min(n - 1, floor(point * n)) among the sorted non-null whole numbers.

    Values are counted in BINS equal ranges; only the ranges that hold a wanted rank are counted by value and
    put in order, each range by itself, so nothing is ordered over all rows. Raises on an empty column unless
    allow_empty, which gives 0.
    """
    spark = df.sparkSession
    x = df.select(F.col(column).cast("long").alias("x")).where("x is not null")
    n, low, high = x.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if n == 0:
        if allow_empty:
            return spark.createDataFrame([(p, 0) for p in points], "point double, value long")
        raise ValueError("no values")
    width = -(-(high - low + 1) // BINS)
    binned = x.withColumn("bin", F.floor((F.col("x") - low) / width).cast("int"))
    wanted, before, todo = [], 0, sorted(zip(nearest_ranks(n, points), points, strict=True))
    for r in binned.groupBy("bin").agg(F.count("*").alias("n")).orderBy("bin").collect():
        while todo and todo[0][0] < before + r.n:
            rank, point = todo.pop(0)
            wanted.append((r.bin, rank - before, float(point)))
        before += r.n
    asked = spark.createDataFrame(wanted, "bin int, rank long, point double")
    some = binned.where(F.col("bin").isin(sorted({b for b, *_ in wanted}))).groupBy("bin", "x").agg(F.count("*").alias("n"))
    upto = some.withColumn("upto", F.sum("n").over(Window.partitionBy("bin").orderBy("x")))
    hit = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
    return upto.join(F.broadcast(asked), "bin").where(hit).select("point", F.col("x").alias("value"))  # a row a point


def rounded(value: Column, digits: int) -> Column:
    """A value of 0 at least, rounded as SQL's engine does: by its binary value, where F.round goes by its decimal text."""
    scaled = value * 10.0**digits
    return (F.floor(scaled) + F.when(scaled - F.floor(scaled) >= 0.5, 1).otherwise(0)) / 10.0**digits
