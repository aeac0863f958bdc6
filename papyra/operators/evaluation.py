"""Retrieval quality: first matches, recall, MRR and nDCG by level and type, negative controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.stats import rounded
from papyra.functions.union import union_all

#: Queries of a labelled basket at most.
MOST = 1_000_000
#: Depths of recall and nDCG, digits of the report, depths of the overfetch probe.
DEPTHS, NDCG_DEPTH, DIGITS, PROBE = (1, 5, 10, 20), 10, 4, (1, 2, 4, 8, 16)


def first_matches(hits: DataFrame, gold: DataFrame, level: str) -> DataFrame:
    """(query_id, first): the best rank of a hit whose `level` id is in gold(query_id, level id)."""
    return hits.join(gold.select("query_id", level).distinct(), ["query_id", level]).groupBy("query_id").agg(F.min("rank").alias("first"))


def metrics(hits: DataFrame, gold: DataFrame, queries: DataFrame, levels: tuple[str, ...] = ("act_id", "chunk_id"), by: str | None = None) -> DataFrame:
    """(level[, by], n, recall_at_*, mrr, ndcg_at_10), missed queries counting 0.

    A level counts the queries that have gold of that level; one without any is left out. With `by`,
    rows per value and one over all (null) come from one rollup.
    """
    out = []
    for level in levels:
        asked = gold.where(F.col(level).isNotNull()).select("query_id").distinct().join(queries.select("query_id", *([by] if by else [])), "query_id")
        rows = asked.join(first_matches(hits, gold, level), "query_id", "left")
        first = F.col("first")
        share = lambda c: rounded(F.avg(F.coalesce(c, F.lit(0.0))), DIGITS)
        values = [F.count("*").alias("n"), *[share((first <= d).cast("double")).alias(f"recall_at_{d}") for d in DEPTHS], share(1 / first).alias("mrr"), share(F.when(first <= NDCG_DEPTH, 1 / F.log2(first + 1))).alias(f"ndcg_at_{NDCG_DEPTH}")]
        out.append((rows.rollup(by) if by else rows.groupBy()).agg(*values).withColumn("level", F.lit(level.removesuffix("_id"))).where("n > 0"))
    return union_all(out)


def shuffled_gold(gold: DataFrame, seed: int) -> DataFrame:
    """Each query gets the act of the next query, in the cyclic md5(seed:query) order, whose act differs.

    gold(query_id, act_id), one row a query; queries without such another keep none. Candidates are
    the next query's act, or the next other act beyond a run of equal ones, found by windows over runs.
    The order is one over all queries, so a basket holds MOST of them at most; a larger one raises.
    """
    if gold.limit(MOST + 1).count() > MOST:
        raise ValueError(f"more than {MOST} queries are no labelled basket")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("query_id").cast("string")))
    w = Window.orderBy("h", "query_id")  # MOST rows at most
    rows = gold.withColumn("h", order).withColumn("new", F.coalesce((F.col("act_id") != F.lag("act_id").over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("new").over(w))
    runs = rows.groupBy("run").agg(F.any_value("act_id").alias("act"))
    after = Window.orderBy("run").rowsBetween(1, Window.unboundedFollowing)
    first = runs.agg(F.min_by("act", "run").alias("a1"), F.min(F.when(F.col("run") == 2, F.col("act"))).alias("a2"))
    nxt = runs.withColumn("next", F.first("act").over(after)).crossJoin(F.broadcast(first))
    given = F.coalesce("next", F.when(F.col("a1") != F.col("act"), F.col("a1")).otherwise(F.col("a2")))
    return rows.join(nxt.select("run", given.alias("shuffled")), "run").select("query_id", "act_id", "shuffled")


def overfetch_probe(scored: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """(depth, share): how many queries have a gold chunk among the first k * depth, for several depths.

    scored(query_id, chunk_id, rank): unfiltered ranks; wanted(query_id, chunk_id): gold in force."""
    first = scored.join(wanted, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    rows = wanted.select("query_id").distinct().join(first, "query_id", "left").withColumn("depth", F.explode(F.array(*map(F.lit, PROBE))))
    return rows.groupBy("depth").agg(rounded(F.avg(F.coalesce((F.col("first") <= F.col("depth") * k).cast("double"), F.lit(0.0))), DIGITS).alias("share"))
