"""Corpus profiling: totals, presence, frequencies, edition chains, point-in-time readings, outlines."""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.stats import pct

#: The dates at which the corpus is read, and what the status of an act in force is called.
PIT_DATES = ("2010-06-01", "2015-06-01", "2020-06-01", "2026-08-14")
IN_FORCE = "in force"


def totals(editions: DataFrame) -> DataFrame:
    """Record, stub and character totals; the share of current editions in records and in mass."""
    current = F.col("is_current")
    out = editions.agg(
        F.count("*").alias("records"),
        F.count_if("is_stub").alias("stubs"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"),
        F.count_if(current).alias("current_records"),
        F.coalesce(F.sum(F.when(current, F.col("chars"))), F.lit(0)).alias("current_chars"),
    )
    return out.withColumns({"current_records_pct": pct(F.col("current_records"), F.col("records")), "current_chars_pct": pct(F.col("current_chars"), F.col("chars"))})


def presence(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, filled, filled_pct): rows whose value is neither null nor an empty string or array; one pass."""

    def filled(c: str) -> Column:
        kind = dict(df.dtypes)[c]
        empty = F.col(c) == "" if kind == "string" else F.size(c) == 0 if kind.startswith("array") else F.lit(False)
        return F.count_if(F.col(c).isNotNull() & ~empty).alias(c)

    row = df.agg(F.count("*").alias("n"), *map(filled, columns))
    long = row.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns])).alias("x"))
    return long.select("x.field", "x.filled", pct(F.col("x.filled"), F.col("n")).alias("filled_pct"))


def json_presence(lines: DataFrame, column: str = "line") -> DataFrame:
    """(field, present, filled) over JSON objects, where an absent key and a null differ."""
    spark = lines.sparkSession
    each = spark.sql("select e.key, e.value from {lines} l, lateral variant_explode(parse_json(l.line)) e", lines=lines.select(F.col(column).alias("line")))
    text = F.expr("try_variant_get(value, '$', 'string')")
    return each.groupBy(F.col("key").alias("field")).agg(F.count("*").alias("present"), F.count_if(~F.is_variant_null("value") & ~F.coalesce(text.isin("", "[]"), F.lit(False))).alias("filled"))


def frequencies(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values and their counts; ties by value, null as a value of its own."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(k)


def chains(editions: DataFrame) -> DataFrame:
    """One row of statistics of edition chains (an act's editions)."""
    act = editions.groupBy("act_id").agg(
        F.count("*").alias("n"),
        F.count_if("is_current").alias("current"),
        F.max_by("is_current", "doc_id").alias("last_current"),
        F.max(F.when(F.col("is_current"), F.col("idx"))).alias("current_idx"),
        F.min_by("n_editions", "doc_id").alias("declared"),
        F.countDistinct("shard").alias("shards"),
    )
    multi = F.col("n") > 1
    return act.agg(
        F.count("*").alias("acts"),
        F.count_if(multi).alias("multi_acts"),
        F.coalesce(F.sum(F.when(multi, F.col("n"))), F.lit(0)).alias("records_in_multi"),
        F.count_if(F.col("current") != 1).alias("not_one_current"),
        F.count_if(~F.col("last_current")).alias("last_not_current"),
        F.count_if(F.col("current_idx") != F.col("n") - 1).alias("current_not_last_index"),
        F.count_if(F.col("declared") != F.col("n")).alias("declared_differs"),
        F.count_if(multi & (F.col("shards") > 1)).alias("split_over_shards"),
        F.max("n").alias("longest"),
    )


def duplicates(df: DataFrame, column: str = "text_hash") -> DataFrame:
    """Records beyond the first of each hash; null counts as one value."""
    n = F.count("*") - F.countDistinct(column) - F.max(F.when(F.col(column).isNull(), 1).otherwise(0))
    return df.agg(F.coalesce(n, F.lit(0)).cast("long").alias("duplicates"))


def _read_at(editions: DataFrame, dates: tuple[str, ...]) -> DataFrame:
    d, begin, end = F.col("as_of"), F.col("begin_date"), F.col("end_date")
    begins = F.coalesce((begin != "") & (begin <= d), F.lit(False))
    substituted = F.coalesce(F.coalesce(F.nullif(begin, F.lit("")), F.col("date")) <= d, F.lit(False))
    open_strict = F.coalesce(F.col("end_sentinel") == "indefinite", F.lit(False))
    ends = open_strict | F.coalesce((end != "") & (end >= d), F.lit(False))
    loose = ends | F.coalesce(F.col("end_sentinel") == "null", F.lit(False)) | end.isNull()
    acting = F.coalesce(F.col("status") == IN_FORCE, F.lit(False))
    rows = editions.withColumn("as_of", F.explode(F.array(*map(F.lit, dates))))
    return rows.select(
        "as_of", "act_id",
        (acting & begins & ends).alias("a_strict"),
        (acting & begins & ends & F.col("is_current")).alias("a_and_current"),
        (acting & substituted & ends).alias("b_date_substituted"),
        (acting & begins & loose).alias("c_loose_end"),
        (begins & loose).alias("d_no_status"),
        (begins & ends).alias("e_any_edition"),
        acting.alias("status_only"),
    )


def pit_readings(editions: DataFrame, dates: tuple[str, ...] = PIT_DATES) -> DataFrame:
    """Per date, how many editions each reading of `in force on that date` accepts."""
    rows = _read_at(editions, dates)
    return rows.groupBy("as_of").agg(*[F.count_if(c).alias(c) for c in rows.columns[2:]])


def pit_by_act(editions: DataFrame, dates: tuple[str, ...] = PIT_DATES) -> DataFrame:
    """(as_of, reading, in_force, acts): how many acts have how many editions in force (readings A and E)."""
    rows = _read_at(editions, dates).select("as_of", "act_id", F.explode(F.array(F.struct(F.lit("A").alias("r"), F.col("a_strict").alias("ok")), F.struct(F.lit("E").alias("r"), F.col("e_any_edition").alias("ok")))).alias("x")).where("x.ok")
    each = rows.groupBy("as_of", F.col("x.r").alias("reading"), "act_id").agg(F.count("*").alias("in_force"))
    return each.groupBy("as_of", "reading", "in_force").agg(F.count("*").alias("acts"))


def toc_stats(docs: DataFrame, contents: str = "contents") -> DataFrame:
    """Outline statistics of documents with contents array<struct<level,label,char_start,char_end,parent>>."""
    c = F.col(contents)
    roots = F.size(F.filter(c, lambda x: x["parent"].isNull()))
    return docs.where(F.size(c) > 0).agg(
        F.count("*").alias("documents"),
        F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long").alias("nodes"),
        F.coalesce(F.sum(F.size(F.filter(c, lambda x: x["char_start"] == x["char_end"]))), F.lit(0)).cast("long").alias("zero_span"),
        F.count_if(roots > 1).alias("multi_root"),
        F.coalesce(F.sum(F.size(F.filter(c, lambda x: F.contains(x["label"], F.lit("\x15"))))), F.lit(0)).cast("long").alias("control_labels"),
    )


def label_words(docs: DataFrame, k: int = 15, contents: str = "contents") -> DataFrame:
    """The k most frequent first words of outline labels, lower-cased, without final dots."""
    first = F.rtrim(F.lower(F.split(F.trim("label"), r"\s+")[0]), F.lit("."))
    return frequencies(docs.select(F.explode(f"{contents}.label").alias("label")).where("trim(label) <> ''").select(first.alias("word")), "word", k)


def full_pass(editions: DataFrame, dates: tuple[str, ...] = PIT_DATES, columns: tuple[str, ...] = ("begin_date", "end_date", "status", "text_hash"), k: int = 10) -> dict[str, DataFrame]:
    """Every profile of the editions by name, from one read: only their columns are kept, in memory or on disk.

    throughput is (records, seconds, records_per_s) of filling that projection, the pass over the source.
    The caller unpersists `editions` when done.
    """
    needed = ["act_id", "doc_id", "idx", "n_editions", "shard", "is_current", "is_stub", "chars", "status", "doc_type", "date", "begin_date", "end_date", "end_sentinel", "text_hash"]
    rows = editions.select(*[c for c in needed if c in editions.columns]).persist(StorageLevel.MEMORY_AND_DISK)
    began = time.perf_counter()
    n = rows.count()
    took = time.perf_counter() - began
    out = {
        "totals": totals(rows), "presence": presence(rows, [c for c in columns if c in rows.columns]), "chains": chains(rows),
        "duplicates": duplicates(rows), "pit_readings": pit_readings(rows, dates), "pit_by_act": pit_by_act(rows, dates), "statuses": frequencies(rows, "status", k),
    }
    rate = editions.sparkSession.createDataFrame([(n, round(took, 3), round(n / max(took, 1e-9), 1))], "records long, seconds double, records_per_s double")
    return out | {"throughput": rate, "editions": rows}
