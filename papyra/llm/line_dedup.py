"""Repeated line runs, deleted in all but their first place; DataFrame functions only.

The corpus is a sequence of line ids, one run of positions per document. Lines that occur once end every
repeated run and drop out at the start. Prefix doubling then names the block of 2, 4, 8, ... lines at each
remaining position from two names of half the length, so a suffix's first 2^k lines are one name. Suffixes
that share the names that cover their first lines, up to min_words words, form an interval of the suffix
order with a longest common prefix of at least that length. Every member of an interval but the first in
document order starts a later copy. As each maximal run is the union of its shortest such prefixes and, read
backwards, suffixes, both are marked, and exactly the lines of later copies go. A line counts one word at
least, so a run is decided within min_words lines and log2(min_words) doublings, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh

NO_ID = -(2**63)


def _keys(docs: DataFrame, d: str = "_d", t: str = "_t") -> DataFrame:
    """docs with d and t, which name a document: its id (null: the least) and its text's hash."""
    return docs.withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(t, F.xxhash64(F.coalesce("text", F.lit(""))))


def words(line: Column) -> Column:
    """Blank-separated words; one at least."""
    text = F.trim(line)
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def later_copies(docs: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """(_d, _t, gone): the positions of the lines that go, for each document that loses any."""
    line = F.col("line")
    lines = _keys(docs).where("text <> ''").select("_d", "_t", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("_d", "_t", "pos", F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"), words(line).cast("int").alias("w"))
    lines = scratch.table(lines, "lines")
    # Written first, so that both sides of the join below are plain shuffles and a hot line's rows can be split.
    often = scratch.table(lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"), "often")
    doc = Window.partitionBy("_d", "_t").orderBy("pos")
    # Dealt by document before equal rows are merged: else the merge would bind the join to its keys.
    known = lines.join(often, ["a", "b"]).repartition("_d", "_t").distinct().withColumn("run", F.col("pos") - F.row_number().over(doc))
    run = Window.partitionBy("_d", "_t", "run").orderBy("pos")
    # A stretch of repeated lines with too few words in all holds no run that goes.
    whole = F.sum("w").over(Window.partitionBy("_d", "_t", "run"))
    known = known.withColumns({"upto": F.sum("w").over(run), "whole": whole}).where(F.col("whole") >= min_words).drop("whole").withColumn("n0", F.struct("a", "b"))
    depth = min_words.bit_length() - 1
    for k in range(depth):
        other = F.lead(f"n{k}", 1 << k).over(run)
        parts = (F.lit(k), F.col(f"n{k}.a"), F.col(f"n{k}.b"), other["a"], other["b"])
        known = known.withColumn(f"n{k + 1}", F.when(other.isNotNull(), F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(-1), *parts).alias("b"))))
    known = known.withColumn("names", F.array(*[f"n{k}" for k in range(depth + 1)])).select("_d", "_t", "run", "pos", "w", "upto", "names")
    known = scratch.table(known, "names")
    scratch.drop(lines, often)

    # The nearest end whose run from here has min_words words; and the nearest start, from an end.
    by = ["_d", "_t", "run"]
    ends = known.select(*by, F.col("upto").alias("v"), F.lit(1).alias("is_bound"), F.col("pos").alias("p"))
    starts = known.select(*by, (F.col("upto") - F.col("w")).alias("v"), F.lit(0).alias("is_bound"), F.col("pos").alias("p"))
    ask_end = starts.withColumn("v", F.col("v") + min_words)
    ask_start = ends.withColumn("v", F.col("v") - min_words)
    ahead = Window.partitionBy(*by).orderBy("v", "is_bound").rowsBetween(0, Window.unboundedFollowing)
    behind = Window.partitionBy(*by).orderBy("v", F.desc("is_bound")).rowsBetween(Window.unboundedPreceding, 0)
    forward = ends.unionByName(ask_end).withColumn("q", F.min(F.when(F.col("is_bound") == 1, F.col("p"))).over(ahead)).where("is_bound = 0 and q is not null").select(*by, F.col("p").alias("s"), F.col("q").alias("e"))
    reverse = starts.withColumn("is_bound", F.lit(1)).unionByName(ask_start.withColumn("is_bound", F.lit(0)))
    backward = reverse.withColumn("q", F.max(F.when(F.col("is_bound") == 1, F.col("p"))).over(behind)).where("is_bound = 0 and q is not null").select(*by, F.col("q").alias("s"), F.col("p").alias("e"))
    spans = forward.unionByName(backward).select("_d", "_t", "s", "e").distinct()
    level = F.floor(F.log2(F.col("e") - F.col("s") + 1)).cast("int")
    spans = spans.withColumn("k", level).withColumn("last", F.expr("e + 1 - shiftleft(1, k)"))

    head = known.select("_d", "_t", F.col("pos").alias("s"), F.col("names").alias("x"))
    tail = known.select("_d", "_t", F.col("pos").alias("last"), F.col("names").alias("y"))
    named = spans.join(head, ["_d", "_t", "s"]).join(tail, ["_d", "_t", "last"])
    named = named.select("_d", "_t", "s", "e", (F.col("e") - F.col("s")).alias("m"), F.col("x")[F.col("k")].alias("x"), F.col("y")[F.col("k")].alias("y"))
    named = scratch.table(named, "spans")
    first = named.groupBy("m", "x", "y").agg(F.min(F.struct("_d", "_t", "s")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Written, so that the join is of two plain shuffles and a hot name's rows can be split.
    first = scratch.table(first, "firsts")
    copies = named.join(first, ["m", "x", "y"]).where(F.struct("_d", "_t", "s") > F.col("first"))
    return copies.groupBy("_d", "_t").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("s", "e")))).alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs with later copies of repeated line runs of min_words words or more deleted from text.

    Adds lines (how many the text had) and removed (their positions, ascending); columns of these names
    are replaced, the others stay. Places are ordered by doc_id (null first) and position; rows equal in
    id and text are one document and lose the same lines. A null text stays null, an empty one empty,
    and a text that loses every line becomes empty. Shorter runs stay, however often they occur.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    columns = [c for c in docs.columns if c not in ("lines", "removed")]
    gone = later_copies(docs.select("doc_id", "text"), min_words, scratch)
    d, t, g, split = fresh(docs, "line_doc", "line_text", "line_gone", "line_split")
    gone = gone.select(F.col("_d").alias(d), F.col("_t").alias(t), F.array_sort("gone").alias(g))
    both = _keys(docs.select(*columns), d, t).join(gone, [d, t], "left").withColumn(split, F.split("text", "\n", -1))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(g)), lambda i: F.get(split, i))
    text = F.when(F.col(g).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = {"text": text, "lines": F.coalesce(F.size(split), F.lit(0)), "removed": F.coalesce(g, F.array().cast("array<int>"))}
    return both.select(*[out[c].alias(c) if c == "text" else c for c in columns], out["lines"].alias("lines"), out["removed"].alias("removed"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs.select("doc_id", "text"))


OP9_SQL = """
with l as (
  select doc_id, unnest(range(len(x)))::int as pos, unnest(x) as line
  from (select doc_id, string_split(text, chr(10)) as x from documents where text <> '')
), w as (
  select *, greatest(1, length(trim(line)) - length(replace(trim(line), ' ', '')) + 1) as w from l
), c as (
  select *, sum(w) over (partition by doc_id order by pos) as upto from w
), spans as (
  select a.doc_id, a.pos as s, min(b.pos) as e from c a join c b on a.doc_id = b.doc_id and b.pos between a.pos and a.pos + 49 and b.upto - a.upto + a.w >= 50 group by 1, 2
  union
  select b.doc_id, max(a.pos) as s, b.pos as e from c a join c b on a.doc_id = b.doc_id and a.pos between b.pos - 49 and b.pos and b.upto - a.upto + a.w >= 50 group by 1, 3
), content as (
  select s.doc_id, s.s, s.e, string_agg(l.line, chr(10) order by l.pos) as t from spans s join l on l.doc_id = s.doc_id and l.pos between s.s and s.e group by 1, 2, 3
), later as (
  select doc_id, s, e from (select *, rank() over (partition by t order by doc_id, s) as k from content) where k > 1
), gone as (
  select distinct doc_id, unnest(range(s, e + 1))::int as pos from later
), removed as (
  select doc_id, list(pos order by pos) as removed from gone group by 1
), kept as (
  select doc_id, string_agg(line, chr(10) order by pos) as t from l anti join gone using (doc_id, pos) group by 1
)
select d.doc_id, case when r.removed is null then d.text else coalesce(k.t, '') end as text,
  case when d.text is null then 0 else len(string_split(d.text, chr(10))) end::int as lines, coalesce(r.removed, []::int[]) as removed
from documents d left join removed r using (doc_id) left join kept k using (doc_id)
"""
