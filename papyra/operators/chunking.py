"""Structure-aware chunking with exact character offsets (code points).

Paragraph spans, outline segments and breadcrumbs are SQL expressions; packing is a fold over a document's
spans. `chunk_documents` runs the whole chunker, whose rules refer to each other, over Arrow batches, one
document at a time: its memory follows one document, and its time the document's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.stats import pct, quantiles
from papyra.functions.text import strip

#: Fixed value: the control character that stands for the section sign in outline labels.
LABEL_CONTROL = "\x15"
SENTENCE_END = re.compile(r"(?<=[.!?;])\s+")


@dataclass(frozen=True)
class ChunkConfig:
    target: int = 2000
    maximum: int = 3000
    overlap: int = 200

    def __post_init__(self) -> None:
        if self.maximum < self.target:
            raise ValueError("maximum is below target")
        if self.overlap >= self.target:
            raise ValueError("overlap is not below target")


def clean_label(label: Column) -> Column:
    return strip(F.replace(F.coalesce(label, F.lit("")), F.lit(LABEL_CONTROL), F.lit("§")))


def paragraph_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' other columns with (para, start, end) of each line that is not empty."""
    others = [c for c in docs.columns if c != text]
    lines = docs.select(*others, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("para", "line"))
    before = Window.partitionBy("doc_id").orderBy("para").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long")
    return lines.withColumn("start", start).withColumn("end", F.col("start") + F.length("line")).where(F.col("end") > F.col("start")).drop("line")


def packed(spans: Column, target: int) -> Column:
    """array<struct<start,end>>: spans (sorted) joined greedily while a piece stays within target."""
    kind = "array<struct<start:bigint,end:bigint>>"
    empty = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e"))
    now = lambda a: F.struct(a["s"].alias("start"), a["e"].alias("end"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["s"].isNotNull() & (x["end"] - acc["s"] <= target)
        done = F.when(acc["s"].isNull() | fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(now(acc))))
        return F.struct(done.alias("done"), F.when(fits, acc["s"]).otherwise(x["start"]).alias("s"), x["end"].alias("e"))

    return F.aggregate(spans, empty, step, lambda a: F.when(a["s"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(now(a)))))


def pack_paragraphs(docs: DataFrame, target: int = 2000, text: str = "text") -> DataFrame:
    """(doc_id, chunk_index, start, end) of each document's paragraphs packed up to target."""
    spans = paragraph_spans(docs.select("doc_id", text), text)
    listed = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return listed.select("doc_id", F.posexplode(packed(F.col("spans"), target)).alias("chunk_index", "x")).select("doc_id", "chunk_index", "x.start", "x.end")


def sentences(text: Column) -> Column:
    """Sentences of a text, without the white space between them."""
    marked = F.regexp_replace(text, r"(?<=[.!?;])[ \t\n\r]+", "\x01")
    return F.filter(F.split(marked, "\x01", -1), lambda x: x != "")


def sliding_windows(start: Column, end: Column, size: int, overlap: int) -> Column:
    """array<struct<start,end>>: windows from start, each size - overlap further, while they begin before end."""
    return F.when(end <= start, F.array().cast("array<struct<start:bigint,end:bigint>>")).otherwise(
        F.transform(F.sequence(start, end - 1, F.lit(size - overlap).cast("long")), lambda p: F.struct(p.alias("start"), F.least(p + size, end).alias("end")))
    )


def breadcrumbs(contents: Column) -> Column:
    """array<array<string>>: labels from the root to each node; a parent that is no earlier node is a root."""

    def step(acc: Column, node: Column) -> Column:
        parent = node["parent"]
        up = F.when(parent.isNotNull() & (parent >= 0) & (parent < F.size(acc)), F.get(acc, parent)).otherwise(F.array().cast("array<string>"))
        label = clean_label(node["label"])
        return F.concat(acc, F.array(F.concat(up, F.when(label == "", F.array().cast("array<string>")).otherwise(F.array(label)))))

    return F.aggregate(contents, F.array().cast("array<array<string>>"), step)


def segments(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, node) of docs(doc_id, text, contents): a segment begins wherever a node does.

    Of several nodes at one place the deepest, then the latest, owns it. Text before the first node is a
    preamble (node -1), and so is a document without contents. All of it happens inside a document's row.
    """
    size = F.length(F.coalesce("text", F.lit(""))).cast("long")
    base = docs.select("doc_id", size.alias("size"), "contents")
    node = lambda start, level, nr: F.struct(start.cast("long").alias("start"), level.cast("int").alias("level"), nr.cast("int").alias("node"))
    nodes = F.transform("contents", lambda x, i: node(F.least(F.greatest(x["char_start"].cast("long"), F.lit(0)), F.col("size")), x["level"], i))
    none = F.array().cast("array<struct<start:bigint,level:int,node:int>>")
    starts = F.sort_array(F.concat(F.coalesce(nodes, none), F.array(node(F.lit(0), F.lit(-1), F.lit(-1)))))
    # Each array is bound to a name of its own, as what stands inside a lambda is computed for every element.
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    following = lambda a, i: F.get(a, i + 1)["start"]
    owned = bound(starts, lambda a: F.filter(a, lambda x, i: following(a, i).isNull() | (following(a, i) != x["start"])))
    cut = bound(owned, lambda a: F.transform(a, lambda x, i: F.struct(x["start"].alias("start"), F.coalesce(following(a, i), F.col("size")).alias("end"), x["node"].alias("node"))))
    return base.select("doc_id", F.explode(cut).alias("x")).where(F.col("x.end") > F.col("x.start")).select("doc_id", "x.start", "x.end", "x.node")


def merge_siblings(segs: DataFrame, target: int) -> DataFrame:
    """(doc_id, start, end, parent_key, merged): neighbours of one parent_key joined while they fit target."""
    kind = "array<struct<start:bigint,end:bigint,parent_key:bigint,merged:int>>"
    listed = segs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.col("parent_key").cast("long").alias("parent_key")))).alias("s"))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        one = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["parent_key"].alias("parent_key"), F.lit(1).alias("merged"))
        joined = F.struct(last["start"].alias("start"), x["end"].alias("end"), x["parent_key"].alias("parent_key"), (last["merged"] + 1).alias("merged"))
        fits = (F.size(acc) > 0) & (last["parent_key"] == x["parent_key"]) & (x["end"] - last["start"] <= target) & (x["end"] - x["start"] < target)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(one)))

    folded = F.aggregate("s", F.array().cast(kind), step)
    return listed.select("doc_id", F.explode(folded).alias("x")).select("doc_id", "x.*")


def _spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    out, at = [], start
    for line in text[start:end].split("\n"):
        if line:
            out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def _greedy(pieces: Iterable[tuple[int, int]], cfg: ChunkConfig, oversized) -> Iterator[tuple[int, int, bool]]:
    """Pieces joined up to the target; one beyond the maximum is cut by `oversized` (last item: it was)."""
    begin = stop = None
    for s, e in pieces:
        large = e - s > cfg.maximum
        if begin is not None and (large or e - begin > cfg.target):
            yield begin, stop, False
            begin = None
        if large:
            yield from ((a, b, True) for a, b in oversized(s, e))
            continue
        begin, stop = s if begin is None else begin, e
    if begin is not None:
        yield begin, stop, False


def _windows(start: int, end: int, cfg: ChunkConfig) -> Iterator[tuple[int, int]]:
    for p in range(start, end, cfg.target - cfg.overlap):
        yield p, min(p + cfg.target, end)


def _cut_paragraph(text: str, start: int, end: int, cfg: ChunkConfig) -> Iterator[tuple[int, int]]:
    marks = [(m.start(), m.end()) for m in SENTENCE_END.finditer(text, start, end)]
    begins, ends = [start, *(b for _, b in marks)], [*(a for a, _ in marks), end]
    whole = [(a, b) for a, b in zip(begins, ends, strict=True) if b > a] or [(start, end)]
    return ((a, b) for a, b, _ in _greedy(whole, cfg, lambda s, e: _windows(s, e, cfg)))


def cut_segment(text: str, start: int, end: int, cfg: ChunkConfig) -> list[tuple[int, int, str]]:
    """(start, end, boundary kind) of a segment's pieces."""
    if end - start <= cfg.maximum:
        return [(start, end, "structural")]
    pieces = [(s, e, "mid_paragraph" if large else "paragraph") for s, e, large in _greedy(_spans(text, start, end), cfg, lambda s, e: _cut_paragraph(text, s, e, cfg))]
    if pieces and pieces[-1][1] >= end - 1 and pieces[-1][2] == "paragraph":
        pieces[-1] = (*pieces[-1][:2], "structural")
    return pieces


def outline(text: str, contents: list[dict]) -> list[tuple[int, int, int, int]]:
    """(start, end, parent key, node) of a document's segments; roots never share a parent key."""
    owner: dict[int, int] = {}
    for k, node in enumerate(contents):
        at = min(max(node["char_start"] or 0, 0), len(text))
        if at not in owner or (node["level"] or 0) >= (contents[owner[at]]["level"] or 0):
            owner[at] = k
    cuts = sorted({0, len(text), *owner})
    out = []
    for s, e in zip(cuts, cuts[1:]):
        k = owner.get(s, -1)
        parent = contents[k]["parent"] if k >= 0 else None
        out.append((s, e, -1 if k < 0 else -(k + 2) if parent is None else parent, k))
    return out


def paths(contents: list[dict]) -> list[list[str]]:
    out: list[list[str]] = []
    for node in contents:
        parent, label = node["parent"], (node["label"] or "").replace(LABEL_CONTROL, "§").strip()
        up = out[parent] if parent is not None and 0 <= parent < len(out) else []
        out.append([*up, label] if label else list(up))
    return out


def cut_document(text: str, contents: list[dict], title: str, cfg: ChunkConfig) -> Iterator[tuple[int, int, str, str, int]]:
    """(start, end, breadcrumb, boundary kind, segments merged) of a document's chunks, stripped."""
    crumbs, groups = paths(contents), []
    for s, e, parent, node in outline(text, contents):
        if groups and groups[-1][2] == parent and e - groups[-1][0] <= cfg.target and e - s < cfg.target:
            groups[-1] = (groups[-1][0], e, parent, groups[-1][3], groups[-1][4] + 1)
        else:
            groups.append((s, e, parent, node, 1))
    for s, e, _, node, merged in groups:
        crumb = " › ".join(x for x in (title, *(crumbs[node] if node >= 0 else [])) if x)
        for a, b, kind in [(s, e, "structural")] if merged > 1 else cut_segment(text, s, e, cfg):
            piece = text[a:b]
            a += len(piece) - len(piece.lstrip())
            b = a + len(piece.strip())
            if b > a:
                yield a, b, crumb, kind, merged


CHUNK = "doc_id long, act_id long, chunk_index int, chunk_id string, char_start long, char_end long, text string, breadcrumb string, boundary_kind string, segments_merged int, has_structure boolean"


def chunk_documents(docs: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of docs(doc_id, act_id, title, text[, contents]); for each, text[char_start:char_end] is its text."""
    if "contents" not in docs.columns:
        docs = docs.withColumn("contents", F.lit(None).cast("array<struct<level:int,label:string,char_start:bigint,char_end:bigint,parent:int>>"))
    node = lambda x: F.struct(*[x[c].cast(t).alias(c) for c, t in (("level", "int"), ("label", "string"), ("char_start", "long"), ("parent", "int"))])
    rows = docs.select(F.col("doc_id").cast("long"), F.col("act_id").cast("long"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), F.transform("contents", node).alias("contents"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CHUNK.split(", ")]
        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
        kinds = [types[c.split()[1]] for c in CHUNK.split(", ")]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out = [
                    (r["doc_id"], r["act_id"], k, f"{r['doc_id']}:{s}-{e}", s, e, r["text"][s:e], crumb, kind, merged, bool(r["contents"]))
                    for r in b.slice(at, 256).to_pylist()
                    for k, (s, e, crumb, kind, merged) in enumerate(cut_document(r["text"], r["contents"] or [], r["title"], cfg))
                ]
                cols = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return rows.mapInArrow(run, CHUNK)


def chunk_stats(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(boundary_kind, chunks, chars, longest, coverage_pct): by kind, and over all where kind is null."""
    total = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("all"))
    out = chunks.rollup("boundary_kind").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).cast("long").alias("chars"), F.max(F.length("text")).alias("longest"))
    return out.crossJoin(F.broadcast(total)).select("boundary_kind", "chunks", "chars", "longest", F.round(F.col("chars") * F.lit(100.0) / F.nullif("all", F.lit(0)), 2).alias("coverage_pct"))


def chunk_summary(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: documents, chunks and characters, coverage, nearest-rank sizes, chunks a document (those
    without any count 0) and groups of merged siblings."""
    size = F.length("text")
    row = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("chars"), F.count_if(F.col("segments_merged") > 1).alias("merged_sibling_groups"))
    whole = docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("chars_in"))
    per = docs.select("doc_id").join(chunks.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    out = row.crossJoin(F.broadcast(whole))  # one row each, as all below
    for name, frame, column, points in (("chars", chunks.select(size.alias("x")), "x", (0.1, 0.5, 0.9, 0.99, 1.0)), ("per_document", per, "n", (0.5, 0.9, 0.99, 1.0))):
        found = quantiles(frame, column, list(points), allow_empty=True).groupBy().pivot("point", list(points)).agg(F.first("value"))
        out = out.crossJoin(F.broadcast(found.select(*[F.col(f"`{p}`").alias(f"{name}_{'max' if p == 1 else f'p{round(100 * p)}'}") for p in points])))
    return out.withColumns({"chars_mean": F.coalesce(F.round(F.col("chars") / F.nullif("chunks", F.lit(0))).cast("long"), F.lit(0)), "coverage_pct": pct(F.col("chars"), F.col("chars_in"))})


def offset_violations(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks whose text is not the document's text at their offsets."""
    whole = docs.select("doc_id", F.col("text").alias("whole"))
    return chunks.join(whole, "doc_id").where(F.expr("substring(whole, char_start + 1, char_end - char_start)") != F.col("text"))
