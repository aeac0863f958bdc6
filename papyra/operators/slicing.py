"""Deterministic slices of whole edition chains, with an account of what was dropped."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions.stats import pct
from papyra.functions.union import union_all
from papyra.sources import sidecars

#: Bits of a sidecar row's flags.
FLAG_STUB, FLAG_CONTENTS, FLAG_CURRENT, FLAG_DUPLICATE, FLAG_DIGEST = 1, 2, 4, 8, 16


def exclude_stubs(editions: DataFrame) -> DataFrame:
    """editions without every act that has a stub."""
    return editions.join(editions.where("is_stub").select("act_id").distinct(), "act_id", "left_anti")


def sample_acts(editions: DataFrame, n: int, seed: int, compat: str | None = None) -> DataFrame:
    """(act_id) of n acts: the first by md5(seed:act_id), all if there are no more.

    compat="mt19937" draws with Python's generator from the sorted ids, on the driver.
    """
    acts = editions.select("act_id").distinct()
    if compat == "mt19937":
        ids = sorted(r.act_id for r in acts.collect())
        drawn = ids if n >= len(ids) else sorted(random.Random(seed).sample(ids, n))
        return editions.sparkSession.createDataFrame([(x,) for x in drawn], "act_id long")
    return acts.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("act_id").cast("string"))), "act_id").limit(n)


def account(steps: list[tuple[str, DataFrame]], whole: DataFrame) -> DataFrame:
    """(step, docs, docs_pct, chars, chars_pct): what each step dropped, in documents and in text."""
    total = whole.agg(F.count("*").alias("all_docs"), F.coalesce(F.sum("chars"), F.lit(0)).alias("all_chars"))
    rows = union_all([df.agg(F.lit(k).alias("nr"), F.lit(name).alias("step"), F.count("*").alias("docs"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")) for k, (name, df) in enumerate(steps)])
    out = rows.crossJoin(F.broadcast(total))  # one row
    return out.select("nr", "step", "docs", pct(F.col("docs"), F.col("all_docs"), 3).alias("docs_pct"), "chars", pct(F.col("chars"), F.col("all_chars"), 3).alias("chars_pct"))


def cap_preview(editions: DataFrame, caps: tuple[int, ...] = (500_000, 2_000_000, 8_000_000)) -> DataFrame:
    """(cap, acts, acts_pct, chars_pct): what a cap on an act's text would drop."""
    act = editions.groupBy("act_id").agg(F.sum("chars").alias("chars"))
    rows = act.withColumn("cap", F.explode(F.array(*[F.lit(c).cast("long") for c in caps])))
    over = F.col("chars") > F.col("cap")
    out = rows.groupBy("cap").agg(F.count("*").alias("n"), F.sum("chars").alias("all"), F.count_if(over).alias("acts"), F.coalesce(F.sum(F.when(over, F.col("chars"))), F.lit(0)).alias("chars"))
    return out.select("cap", "acts", pct(F.col("acts"), F.col("n")).alias("acts_pct"), pct(F.col("chars"), F.col("all")).alias("chars_pct"))


def capped(editions: DataFrame, max_chars: int) -> DataFrame:
    """editions of the acts whose whole text is max_chars at most."""
    keep = editions.groupBy("act_id").agg(F.sum("chars").alias("c")).where(F.col("c") <= max_chars)
    return editions.join(keep.select("act_id"), "act_id", "left_semi")


def flags(editions: DataFrame) -> DataFrame:
    """Sidecar columns of a slice: doc_id, flags and the text hash as an unsigned number (0 if malformed)."""
    bits = F.col("is_stub").cast("int") * FLAG_STUB + F.col("has_contents").cast("int") * FLAG_CONTENTS + F.col("is_current").cast("int") * FLAG_CURRENT
    number = F.when(F.col("text_hash").rlike("^[0-9a-fA-F]{1,16}$"), F.conv("text_hash", 16, 10)).otherwise("0")
    return editions.select("doc_id", "act_id", bits.alias("flags"), number.cast("decimal(20,0)").alias("hash"))


def peek_doc_id(lines: DataFrame, column: str = "line") -> DataFrame:
    """doc_id of each JSON line: the first one in its text, else the one a full parse finds."""
    first = F.regexp_extract(column, r'"doc_id"\s*:\s*([0-9]+)', 1)
    return lines.withColumn("doc_id", F.coalesce(F.nullif(first, F.lit("")).cast("long"), F.get_json_object(column, "$.doc_id").cast("long")))


def verify(written: DataFrame, source: DataFrame) -> DataFrame:
    """Per act of a written slice: exactly one current edition, and as many editions as the source has."""
    mine = written.groupBy("act_id").agg(F.count("*").alias("n"), F.count_if("is_current").alias("current"))
    theirs = source.join(written.select("act_id").distinct(), "act_id", "left_semi").groupBy("act_id").agg(F.count("*").alias("whole"))
    both = mine.join(theirs, "act_id", "full")
    return both.agg(
        F.count("*").alias("acts"),
        F.count_if(F.col("current") == 1).alias("one_current"),
        F.count_if(F.col("n") == F.col("whole")).alias("complete"),
        F.count_if(F.coalesce(F.col("n") != F.col("whole"), F.lit(True))).alias("truncated"),
    )


def mass_profile(editions: DataFrame, top: tuple[int, ...] = (1, 8), marks: tuple[int, ...] = (200_000, 500_000, 1_000_000)) -> DataFrame:
    """One row: how an act's text is distributed; the share of the largest acts and of those up to a size."""
    act = editions.groupBy("act_id").agg(F.sum("chars").alias("chars"))
    largest = act.orderBy(F.desc("chars"), "act_id").limit(max(top)).agg(F.sort_array(F.collect_list("chars"), asc=False).alias("l"))
    row = act.agg(
        F.count("*").alias("acts"), F.sum("chars").alias("all"), F.max("chars").alias("largest"), F.round(F.avg("chars"), 2).alias("mean"),
        *[F.coalesce(F.sum(F.when(F.col("chars") <= m, F.col("chars"))), F.lit(0)).alias(f"c{m}") for m in marks],
    ).crossJoin(F.broadcast(largest))  # one row each; fmt: skip
    first = lambda k: F.aggregate(F.slice("l", 1, k), F.lit(0).cast("long"), lambda a, x: a + x)
    return row.select("acts", "largest", "mean", *[pct(first(k), F.col("all")).alias(f"top{k}_pct") for k in top], *[pct(F.col(f"c{m}"), F.col("all")).alias(f"upto{m}_pct") for m in marks])


def slice_rows(lines: DataFrame, chosen: DataFrame, editions: DataFrame) -> DataFrame:
    """(shard, doc_id, line_no, line, length, flags, text_hash) of all editions of chosen(act_id): a slice's records.

    lines(shard, line_no, line) are the corpus; each record is looked at once, by its peeked id.
    """
    marks = flags(editions.join(chosen.select("act_id").distinct(), "act_id", "left_semi")).select("doc_id", "flags", F.col("hash").alias("text_hash"))
    rows = peek_doc_id(lines.select("shard", "line_no", "line")).join(marks, "doc_id")
    return rows.withColumn("length", F.octet_length("line").cast("long") + 1)


def write_slice(rows: DataFrame, dest: str) -> DataFrame:
    """slice_rows as shard files of JSON lines beside their sidecars in dest; (shard, records, bytes).

    A shard is written by one task that streams its rows in order; neither it nor the driver holds a shard.
    """
    return sidecars.write_shards(rows, dest)
