"""Embedding near-duplicates by NN-descent.

Vectors of one label and content collapse to a node with a count, so copies cost one row. Random
hyperplane orders give each node its first neighbours: every order is dealt by ranges of (label, code), so a
hot label spreads over all tasks, and each vector meets the next few in its order. Rounds of local joins
then refine the graph: a node's neighbours are compared with each other, and each keeps its best K. A list
whose K places are all taken by links is saturated: it is enlarged by places for nodes that are near but no
links, twice as many each round, so that a dense group still looks out to others; rounds go on until no list
changes. Every pair scored on the way that passes the threshold joins its nodes' components before lists are
cut. Links are then counted inside components, in tiles of bounded size that compute all cosines and return
counts, not pairs. An audit compares nodes (all, or a share drawn by hash) with every other of their label:
links that the graph lacks are added, and the recall of the walk is reported.
"""

from __future__ import annotations

import itertools
import logging
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.union import union_all

from .common import Scratch, held, parallel
from .graph import connected_components

log = logging.getLogger(__name__)

NEIGHBOURS, WINDOW, ORDERS, CODE_BITS, TILE = 16, 32, 8, 14, 256
#: How often a saturated list is enlarged at most; parts that a node's neighbours are ranked in before they meet.
ENLARGED, SALT = 3, 16
#: The audit's blocks hold so many numbers; a label of several tiles is dealt to this many blocks at least.
BLOCK_VALUES, SPREAD = 1 << 20, 6
#: Neighbours below this cosine are not kept for the walk; what it then misses is left to the audit.
EXPLORED = 0.8
SCORED = "a long, b long, sim double, joined boolean"


class RecallError(RuntimeError):
    """The walk found too few of the links that an audit of a share of the vectors met."""


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as one matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _runs(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, each of `rows` rows or one run at least (the input is sorted)."""
    rest: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        if rest.num_rows < rows:
            continue
        rest = rest.combine_chunks()
        same = np.all([(c := rest.column(k).to_numpy()) == c[-1] for k in keys], axis=0)
        cut = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
        if cut:
            yield rest.slice(0, cut).combine_chunks()
        rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        c = t.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def nodes_of(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(vec_id, h1, h2) of the rows that may link, and (nid, lab, dim, x, n, first, h1, h2) of their nodes.

    x has unit length. h1, h2 are a 128-bit hash of label and components.
    """
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), x.alias("x")).where(_valid())
    rows = rows.withColumns({"h1": F.xxhash64("label", "x"), "h2": F.xxhash64(F.lit(1), "label", "x")})
    nodes = rows.groupBy("h1", "h2").agg(F.any_value("label").alias("label"), F.any_value("x").alias("x"), F.count("*").alias("n"), F.min("vec_id").alias("first"))
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)))  # scaled first, so that squares neither vanish nor overflow
    nodes = nodes.withColumn("m", norm).withColumn("x", F.transform("x", lambda v: v / F.col("m"))).withColumn("m", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)))
    nodes = nodes.withColumn("x", F.transform("x", lambda v: v / F.col("m")))
    nodes = nodes.select(F.monotonically_increasing_id().alias("nid"), F.xxhash64("label", F.size("x")).alias("lab"), "x", "n", "first", "h1", "h2")
    return rows.select("vec_id", "h1", "h2"), scratch.table(nodes, "nodes")


def _valid():
    return F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)


def first_neighbours(nodes: DataFrame, seed: int, threshold: float) -> DataFrame:
    """SCORED: for each node the nearest among the next WINDOW of each random order, and what all links among
    these join."""
    n = parallel(nodes.sparkSession)

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(b.column("x").offsets.to_numpy())
            for dim in np.unique(sizes):
                some = b.filter(pa.array(sizes == dim))
                x = _matrix(some.column("x"))
                rng = np.random.default_rng([seed, int(dim)])
                for t in range(ORDERS):
                    p = x @ rng.standard_normal((int(dim), CODE_BITS + 1))
                    code = ((p[:, :-1] > 0) << np.arange(CODE_BITS)[::-1]).sum(axis=1)
                    order = code + 1 / (1 + np.exp(-p[:, -1]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), some.column("lab"), pa.array(order), some.column("nid"), some.column("x")], ["t", "lab", "place", "nid", "x"])

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            old = tail.num_rows if tail is not None else 0
            t = t if tail is None else pa.concat_tables([tail, t])
            tail = t.slice(max(0, t.num_rows - WINDOW))
            t = t.combine_chunks()
            lab, order, nid = (t.column(k).to_numpy() for k in ("lab", "t", "nid"))
            x = t.column("x").chunk(0)
            flat, ends = x.values.to_numpy(), x.offsets.to_numpy()
            found: list[tuple[np.ndarray, ...]] = []
            for s in range(1, WINDOW + 1):
                i = np.flatnonzero((lab[:-s] == lab[s:]) & (order[:-s] == order[s:]) & (np.arange(s, len(lab)) >= old))
                if len(i):
                    dim = np.diff(ends)[i]
                    for d in np.unique(dim):
                        k = i[dim == d]
                        at = np.arange(d)
                        sim = np.einsum("ij,ij->i", flat[ends[k][:, None] + at], flat[ends[k + s][:, None] + at])
                        near = sim >= min(EXPLORED, threshold)
                        found.append((nid[k[near]], nid[k[near] + s], sim[near]))
            if found:
                yield _scored(*map(np.concatenate, zip(*found, strict=True)), threshold, NEIGHBOURS)

    rows = nodes.select("nid", "lab", "x").mapInArrow(keyed, "t int, lab long, place double, nid long, x array<double>")
    return rows.repartitionByRange(n, "t", "lab", "place").sortWithinPartitions("t", "lab", "place").mapInArrow(compared, SCORED)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the pairs beside the smallest that it can reach, where that is another: as few pairs as a
    spanning forest has."""
    ids, at = np.unique(np.append(a, b), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while ((above := root[root]) != root).any():
            root = above
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def _scored(a: np.ndarray, b: np.ndarray, sim: np.ndarray, threshold: float, room: int) -> pa.RecordBatch:
    """Both directions of the pairs: of each first node the NEIGHBOURS best links and the `room` best others;
    and, joined, the stars of all links, whether a list has room for them or not."""
    u, v = _stars(a[sim >= threshold], b[sim >= threshold])
    a, b, sim = np.append(a, b), np.append(b, a), np.append(sim, sim)
    order = np.lexsort((b, -sim, a))
    a, b, sim = a[order], b[order], sim[order]
    again = np.append(False, (a[1:] == a[:-1]) & (b[1:] == b[:-1])) if len(a) else np.zeros(0, bool)
    a, b, sim = a[~again], b[~again], sim[~again]
    link = sim >= threshold  # first in each node's run
    new = np.append(True, (a[1:] != a[:-1]) | (link[1:] != link[:-1])) if len(a) else np.zeros(0, bool)
    rank = np.arange(len(a)) - np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    top = rank < np.where(link, NEIGHBOURS, room)
    joined = np.arange(top.sum() + len(u)) >= top.sum()
    return pa.RecordBatch.from_arrays([pa.array(np.append(a[top], u)), pa.array(np.append(b[top], v)), pa.array(np.append(sim[top], np.ones(len(u)))), pa.array(joined)], ["a", "b", "sim", "joined"])


def _lists(pairs: DataFrame, threshold: float, room: int) -> DataFrame:
    """(a, b, sim, full): the NEIGHBOURS best neighbours of each node; of one that has as many links (full), also
    the `room` best that are none. Neighbours are ranked in SALT parts first, so that a node which many
    others have near does not bring all of them to one task."""
    once = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("link", F.col("sim") >= threshold)
    most = F.when(F.col("link"), NEIGHBOURS).otherwise(max(NEIGHBOURS, room))
    part = Window.partitionBy("a", "link", F.pmod(F.xxhash64("b"), F.lit(SALT))).orderBy(F.desc("sim"), "b")
    few = once.withColumn("k", F.row_number().over(part)).where(F.col("k") <= most)
    best = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    links = F.count_if("link").over(Window.partitionBy("a"))
    ranked = few.withColumns({"k": F.row_number().over(best), "links": links})
    fits = F.when(F.col("link") | (F.col("links") < NEIGHBOURS), F.col("k") <= NEIGHBOURS).otherwise(F.col("k") <= F.col("links") + room)
    return ranked.where(fits).select("a", "b", "sim", (F.col("links") >= NEIGHBOURS).alias("full"))


def local_join(lists: DataFrame, nodes: DataFrame, threshold: float, room: int) -> DataFrame:
    """SCORED: pairs among each node's neighbours, both ways round, that are near."""
    back = lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")
    around = _lists(lists.select("a", "b", "sim").unionByName(back), threshold, room).select("a", "b")
    with_x = around.join(nodes.select(F.col("nid").alias("b"), "x"), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["a"]):
            cuts, ids = _starts(t, ["a"]), t.column("b").to_numpy()
            x = t.column("x").chunk(0)
            out = []
            for s, e in itertools.pairwise(cuts.tolist()):
                m = _matrix(x.slice(s, e - s))
                i, j = np.nonzero(np.triu(m @ m.T >= min(EXPLORED, threshold), 1))
                out.append((ids[s + i], ids[s + j], np.einsum("ij,ij->i", m[i], m[j])))
            yield _scored(*map(np.concatenate, zip(*out, strict=True)), threshold, room)

    return with_x.repartition("a").sortWithinPartitions("a").mapInArrow(run, SCORED)


def audit(nodes: DataFrame, parts: DataFrame, threshold: float, share: float = 1.0) -> DataFrame:
    """(a, b, links, missed): a share of the vectors (drawn by hash) is compared with every other of their
    label, in tiles of two blocks of bounded size. Rows with a and b name components that are linked but were
    not joined; rows without count a tile's links, and those between components.

    The cost is share times the square of a label. Only the whole share, 1, proves that no link is missing, as
    one that no order and no list came upon is found in no other way; a small one measures the recall.
    """
    drawn = F.pmod(F.xxhash64(F.lit(2), "nid"), F.lit(1_000_000)) < round(1_000_000 * share)
    named = nodes.join(parts.withColumnRenamed("node", "nid"), "nid", "left").select("nid", "lab", "x", F.coalesce("component", "nid").alias("component"), drawn.alias("drawn"))
    sizes = nodes.groupBy("lab").agg(F.count("*").alias("size"), F.max(F.size("x")).alias("dim"))
    blocks = F.greatest(F.ceil(F.col("size") * F.col("dim") / BLOCK_VALUES), F.least(F.lit(SPREAD), F.ceil(F.col("size") / TILE)))
    rows = (
        named.join(sizes, "lab")
        .withColumn("blocks", blocks.cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("lab", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "component", "x", "drawn")
    )
    keys = ["lab", "i", "j"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, keys):
            i, j, mine, part = (t.column(k).to_numpy() for k in ("i", "j", "mine", "component"))
            x, asked = t.column("x").chunk(0), t.column("drawn").to_numpy()
            for s, e in itertools.pairwise(_starts(t, keys).tolist()):
                m, one = _matrix(x.slice(s, e - s)), i[s] == j[s]
                left = np.arange(e - s) if one else np.flatnonzero(mine[s:e] == i[s])
                right = left if one else np.flatnonzero(mine[s:e] == j[s])
                c, mark = part[s:e], asked[s:e]
                links, found = 0, []
                # Drawn ones meet all others; across blocks, the left's others meet the right's drawn ones too.
                meet = [(left[mark[left]], right)] if one else [(left[mark[left]], right), (left[~mark[left]], right[mark[right]])]
                for rows, others in meet:
                    for p in range(0, len(rows) if len(others) else 0, TILE):
                        some = rows[p : p + TILE]
                        u, v = np.nonzero(m[some] @ m[others].T >= threshold)
                        u, v = some[u], others[v]
                        if one:
                            once = (u < v) | ~mark[v]
                            u, v = u[once], v[once]
                        links += len(u)
                        apart = c[u] != c[v]
                        found.append((*_stars(c[u[apart]], c[v[apart]]), int(apart.sum())))
                a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]).astype(np.int64) for k in (0, 1))
                a, b = _stars(a, b)
                n = len(a)
                ends = [pa.array([*k.tolist(), None], pa.int64()) for k in (a, b)]
                yield pa.RecordBatch.from_arrays([*ends, pa.array([0] * n + [links]), pa.array([0] * n + [sum(f[2] for f in found)])], ["a", "b", "links", "missed"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long, links long, missed long")


def link_counts(nodes: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """(nid, links): over all nodes of its component, how many vectors each node links with."""
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    rows = nodes.select("nid", "lab", "x", "n").join(parts.withColumnRenamed("node", "nid"), "nid").join(sizes, "component")
    rows = (
        rows.withColumn("chunks", F.ceil(F.col("size") / TILE).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("nid"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "nid", "x", "n")
    )
    keys = ["component", "i", "j"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, keys):
            nid, mine, n = (t.column(k).to_numpy() for k in ("nid", "mine", "n"))
            one, x = t.column("i").to_numpy() == t.column("j").to_numpy(), t.column("x").chunk(0)
            links = np.zeros(t.num_rows, np.int64)
            for s, e in itertools.pairwise(_starts(t, keys).tolist()):
                m = _matrix(x.slice(s, e - s))
                near = m @ m.T >= threshold
                near &= ~np.eye(e - s, dtype=bool) if one[s] else mine[s:e][:, None] != mine[s:e][None, :]
                links[s:e] = near @ n[s:e]
            yield pa.RecordBatch.from_arrays([pa.array(nid), pa.array(links)], ["nid", "links"])

    counted = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "nid long, links long")
    return counted.groupBy("nid").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, rounds: int = 2, audit_share: float = 1.0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label).

    Rows link if their labels are equal and not null and the cosine is threshold or more. A null or zero
    vector, or one with a null or non-finite component, links with nothing, nor do vectors of different
    length. Repeated rows are vectors of their own and link with each other. Other columns are ignored.
    rounds is how many follow the first at least; more follow while a saturated list changes, ENLARGED at most.
    """
    return audited(vectors, threshold, rounds, audit_share)[0]


def audited(vectors: DataFrame, threshold: float = 0.98, rounds: int = 2, audit_share: float = 1.0, least_recall: float = 0.9) -> tuple[DataFrame, dict]:
    """near_duplicates and its audit: links met, links between components that the walk missed, recall.

    Missed links are added. With audit_share 1 none is left; with less, RecallError is raised where the walk's
    recall over the drawn share is below least_recall.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows, nodes = nodes_of(vectors, scratch)
    scored = scratch.table(first_neighbours(nodes, 0, threshold), "scored")
    joins, pair = [scored.where("joined").select("a", "b")], ["a", "b", "sim"]
    grown = scratch.table(_lists(scored.where("not joined").select(*pair), threshold, NEIGHBOURS), "lists")
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    before = grown.agg(F.count("*"), total, F.coalesce(F.bool_or("full"), F.lit(False))).first()
    for r in range(max(rounds, ENLARGED)):
        room = NEIGHBOURS << min(r, ENLARGED)
        scored = scratch.table(local_join(grown, nodes, threshold, room), "scored")
        joins.append(scored.where("joined").select("a", "b"))
        better = scratch.table(_lists(grown.select(*pair).unionByName(scored.where("not joined").select(*pair)), threshold, room), "lists")
        now = better.agg(F.count("*"), total, F.coalesce(F.bool_or("full"), F.lit(False))).first()
        scratch.drop(grown)
        grown, (same, full), before = better, (now[:2] == before[:2], now[2]), now
        if same or (r + 1 >= rounds and not full):
            break
    edges = union_all(joins)
    parts = scratch.table(connected_components(edges, scratch), "parts")
    seen = scratch.table(audit(nodes, parts, threshold, audit_share), "audit")
    links, missed = seen.agg(F.coalesce(F.sum("links"), F.lit(0)), F.coalesce(F.sum("missed"), F.lit(0))).first()
    recall = 1 - missed / max(1, links)
    log.info("links of distinct vectors: %d; between components before the audit: %d; recall of the walk's components: %.6f", links, missed, recall)
    if audit_share < 1 and recall < least_recall:
        raise RecallError(f"the walk joined {recall:.4f} of {links} audited links; {least_recall} is asked")
    if missed:
        parts = scratch.table(connected_components(edges.unionByName(seen.where("a is not null").select("a", "b")), scratch), "parts")
    counts = link_counts(nodes, parts, threshold)
    whole = nodes.select("nid", "n", "first", "h1", "h2").join(parts.withColumnRenamed("node", "nid"), "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    firsts = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    named = whole.join(firsts, "component").join(counts, "nid", "left").select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.join(scratch.table(named, "named"), ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    x = vectors.select(F.col("vec_id").cast("long"), F.col("label"), F.col("embedding").cast("array<double>").alias("x"))
    alone = x.where(~F.coalesce(_valid(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    return out, {"links": links, "missed": missed, "recall": recall}


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Links by all cosines of a label, components as the closure of links.
OP3_SQL = """
with recursive e as (
  select vec_id, label, embedding::double[] as v from embeddings
), ok as (
  select * from e where label is not null and v is not null and len(v) > 0
    and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.98
), reach as (
  select vec_id, vec_id as r from e
  union
  select l.a, x.r from reach x join l on l.b = x.vec_id
), c as (
  select vec_id, min(r) as component_id from reach group by 1
)
select c.vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, c.vec_id = component_id as kept
from c left join (select a, count(*) as n from l group by 1) n on n.a = c.vec_id
"""
