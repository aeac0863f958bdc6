"""A training-corpus pipeline of five stages, each an operator of papyra.llm.

Every stage takes a table with the columns doc_id, text and lang, and any others, under whatever names: those
an operator does not use pass it by under names of their own and come back unchanged. Stages but the last
return the columns that they were given.

Nulls: a null or empty text has no letter and goes at the first stage; given to a later stage it is not
selected (quality), stays as it is (lines), links with all other empty texts (near_copies) or is one end
token (packing). A null doc_id is an id like any other, before all others. Repeated rows are kept alike up to
near_copies, which keeps one of each group; packing packs each row that it gets. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import langid, line_dedup, packing, resampling, simhash
from papyra.llm.common import Scratch, remainder

#: What the stages read; operators may add columns of any other name.
READ = ("doc_id", "text", "lang")


def _like(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs) with docs' columns; those it does not read have names of their own on the way."""
    names = {c: f"passed_{k}" for k, c in enumerate(docs.columns) if c.lower() not in READ}
    out = stage(docs.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns]))
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: no letter, no text, or explained by no profile of the languages learned here (a score below what
    nearly all rows of known language have; every one of them is scored). A null lang is filled in."""
    rows = docs.where(remainder("doc_id", 3) != 1)
    learned = Scratch(spark, "language").table(langid.profiles(rows), "profiles")
    least = langid.least_score(rows, learned)

    def stage(docs: DataFrame) -> DataFrame:
        found = langid.identify(docs, learned).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least))
        return found.withColumn("lang", F.coalesce("lang", "lang_pred"))

    return _like(docs, stage)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: what importance resampling towards documents labelled good and not toxic does not select."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0")
    return _like(docs, lambda docs: resampling.resample(docs, good, keep_text=True).where("selected"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines stay in their first place only; n_chars follows the text."""
    out = _like(docs, line_dedup.dedup_lines)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return _like(docs, simhash.deduplicate)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [("language", language), ("quality", quality), ("lines", lines), ("near_copies", near_copies), ("packing", packed)]

#: The models and the tokenizer are not expressible in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
