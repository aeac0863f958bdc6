"""Labelled query baskets from edition chains and chunks, and their split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.dates import midpoint
from papyra.functions.union import union_all

#: Fixed value: a title's type, body, date and number.
TITLE = r"^([А-ЯЁ][а-яё]+)\s+(.+?)\s+от\s+(\d{2}\.\d{2}\.\d{4})(?:\s+N\s+(\S+))?"


def seeded(seed: int, *columns: str) -> Column:
    """A reproducible order, the same in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def metadata(editions: DataFrame, count: int, seed: int, pattern: str = TITLE, title: str = "title") -> DataFrame:
    """Queries by number and attributes: the current edition (else the last) of acts whose title parses.

    pattern's groups are type, body, date and number; a query takes one of three forms in turn.
    """
    pick = Window.partitionBy("act_id").orderBy(F.desc("is_current"), F.desc(F.coalesce("begin_date", F.lit(""))), F.desc("doc_id"))
    one = editions.withColumn("k", F.row_number().over(pick)).where("k = 1")
    group = lambda n: F.regexp_extract(title, pattern, n)
    parsed = one.select("act_id", "doc_id", title, group(1).alias("kind"), group(2).alias("body"), group(3).alias("issued"), group(4).alias("number")).where("number <> ''")
    drawn = parsed.orderBy(seeded(seed, "act_id"), "act_id").limit(count).withColumn("i", F.row_number().over(Window.orderBy(seeded(seed, "act_id"), "act_id")) - 1)
    form = F.col("i") % 3
    text = F.when(form == 0, F.col("number")).when(form == 1, F.concat_ws(" ", F.lower("kind"), "number")).otherwise(F.concat(F.lower("kind"), F.lit(" "), "body", F.lit(" от "), "issued", F.lit(" N "), "number"))
    return drawn.select(F.concat(F.lit("meta-"), "act_id", F.lit("-"), form).alias("query_id"), F.lit("metadata").alias("type"), text.alias("query"), "act_id", "doc_id")


def temporal(editions: DataFrame) -> DataFrame:
    """(act_id, doc_id, as_of, which): the first and the last dated edition of acts that have two or more."""
    dated = editions.where("begin_date is not null")
    w = Window.partitionBy("act_id")
    rows = dated.withColumns({"n": F.count("*").over(w), "up": F.row_number().over(w.orderBy("begin_date", "doc_id")), "down": F.row_number().over(w.orderBy(F.desc("begin_date"), F.desc("doc_id")))})
    both = rows.where("n > 1 and (up = 1 or down = 1)").select("act_id", "doc_id", midpoint(F.col("begin_date"), F.col("end_date")).alias("as_of"), F.when(F.col("up") == 1, "first").otherwise("last").alias("which"))
    return both.where("as_of is not null")


def synthetic_pool(chunks: DataFrame, count: int, seed: int, least_chars: int = 900, per_act: int = 2) -> DataFrame:
    """(act_id, chunk_id, place): current chunks long enough, at most per_act an act, 1.6 * count of them."""
    h = seeded(seed, "chunk_id")
    w = Window.partitionBy("act_id").orderBy("h", "chunk_id")
    pool = chunks.where(F.col("is_current") & (F.length("text") >= least_chars)).select("act_id", "chunk_id", h.alias("h"))
    few = pool.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_act).orderBy("h", "chunk_id").limit(int(1.6 * count))
    return few.select("act_id", "chunk_id", F.row_number().over(Window.orderBy("h", "chunk_id")).alias("place"))


def accepted(pool: DataFrame, made: DataFrame, count: int) -> DataFrame:
    """The first `count` pool chunks, in seeded order, for which made(chunk_id, query) has a question."""
    return pool.join(made.where("query is not null"), "chunk_id").orderBy("place").limit(count)


def split(queries: DataFrame, seed: int, share: float = 0.4) -> DataFrame:
    """queries with part: per type, the first floor(share * n) in seeded order are dev, the others test."""
    w = Window.partitionBy("type")
    k = F.row_number().over(w.orderBy(seeded(seed, "query_id"), "query_id"))
    return queries.withColumn("part", F.when(k <= F.floor(F.lit(share) * F.count("*").over(w)), "dev").otherwise("test"))


def counts(queries: DataFrame) -> DataFrame:
    return queries.groupBy("type").agg(F.count("*").alias("n"))


def temporal_pairs(editions: DataFrame, chunks: DataFrame, seed: int, least_chars: int = 400) -> DataFrame:
    """(act_id, doc_id, as_of, which, place, text): both ends of acts' chains, with what a question is made from.

    The text is the edition's first chunk of least_chars or more; an act goes if either end has none.
    Acts are in seeded order; an act's two editions follow each other.
    """
    text = chunks.where(F.length("text") >= least_chars).groupBy("doc_id").agg(F.min_by("text", "chunk_index").alias("text"))
    rows = temporal(editions).join(text, "doc_id")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("act_id"))).where("n = 2").drop("n")
    return rows.withColumn("place", F.struct(seeded(seed, "act_id").alias("h"), "act_id", "which"))


def temporal_semantic(pairs: DataFrame, made: DataFrame, count: int) -> DataFrame:
    """The first `count` queries, in the pairs' order, for which made(doc_id, question) has a question.

    A query does not name its act: the question and the date find it. rejected() counts the others.
    """
    rows = pairs.join(made.where("trim(question) <> ''"), "doc_id").orderBy("place").limit(count)
    position = F.when(F.col("which") == "first", 0).otherwise(1)
    return rows.select(
        F.concat_ws("-", F.lit("tsem"), "act_id", position).alias("query_id"), F.lit("temporal_semantic").alias("type"),
        F.concat(F.trim("question"), F.lit(" (as of "), "as_of", F.lit(")")).alias("query"), "act_id", "doc_id", "as_of",
    )


def rejected(asked: DataFrame, made: DataFrame, key: str = "doc_id") -> DataFrame:
    """(asked, rejected): how many texts gave no question."""
    answered = made.where("trim(question) <> ''").select(key).distinct().withColumn("ok", F.lit(True))
    return asked.select(key).distinct().join(answered, key, "left").agg(F.count("*").alias("asked"), F.count_if(F.col("ok").isNull()).alias("rejected"))


QUERY = ("query_id", "type", "query", "act_id", "doc_id", "as_of")


def assembled(sets: list[DataFrame], seed: int) -> DataFrame:
    """The union of typed query sets with their part (dev or test); a column that a set lacks is null."""
    kinds = {"query_id": "string", "type": "string", "query": "string", "act_id": "long", "doc_id": "long", "as_of": "string"}
    rows = [s.select(*[(F.col(c) if c in s.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in QUERY]) for s in sets]
    return split(union_all(rows), seed)
