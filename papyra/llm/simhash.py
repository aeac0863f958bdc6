"""SimHash near-duplicates: fingerprints of word shingles, links by pivot distance tables.

Fingerprints are made in Arrow batches (xxhash and numpy). Equal fingerprints collapse to one node at
once, so a group of exact copies costs one row. Two fingerprints of up to four differing bits agree in at
least two of six bit blocks (three of seven, ...: by the size of the corpus), so each fingerprint is dealt to
the fifteen buckets named by two blocks;
inside a bucket every fingerprint has a table of Hamming distances to reference fingerprints (pivots), a
pair is discarded where one coordinate differs by more than the threshold (triangle inequality), and the
survivors are verified bit by bit. Large buckets are split into tiles of bounded size. Each tile emits
a spanning forest of its links, never all pairs; components are then joined up in DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, held, slices, texts_as_bytes
from .graph import connected_components

SEED, TILE = 42, 256
#: Unlike fingerprints that share a bucket by chance at most, as far as five blocks reach.
FULL = 32


def fingerprint(text: bytes, width: int = 4) -> int:
    """Majority of the XXH64 bits of the word shingles, repeats included; no word: 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined, h = b" ".join(words), xxhash.xxh64_intdigest
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: 1 - width].tolist()
        hashes = [h(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    n = len(hashes)
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 255):  # 255 ones still fit a byte
        ones += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, *also: str) -> DataFrame:
    """(doc_id, fp long) and the long columns in `also` per row of docs; a null text has no words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("simhash")
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(x, width) for x in texts_as_bytes(b.column("text"))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps), *(b.column(c) for c in also)], ["doc_id", "fp", *also])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *also)
    return rows.mapInArrow(run, "doc_id long, fp long" + "".join(f", {c} long" for c in also))


def pivots(count: int = 24, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, count, dtype=np.uint64)


def linked(key: np.ndarray, side: np.ndarray, fp: np.ndarray, max_bits: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within max_bits among rows of one key (rows sorted by key).

    side: 0 for rows of a tile's one chunk, 1 for the other; chunks of different number meet only
    across (pairs inside a chunk belong to its own tile). 2 for rows of a tile of one chunk.
    """
    nodes, at = np.unique(fp, return_inverse=True)
    table = np.bitwise_count(nodes[:, None] ^ refs[None, :]).astype(np.int16)
    root = np.arange(len(nodes))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left, a_out, b_out = np.arange(len(key)), [], []
    step = 1
    while True:
        left = left[left + step < len(key)]
        left = left[key[left] == key[left + step]]
        if not len(left):
            break
        i, j = at[left], at[left + step]
        live = (root[i] != root[j]) & ((side[left] == 2) | (side[left] != side[left + step]))
        i, j = i[live], j[live]
        for p in range(len(refs)):  # the largest coordinate difference bounds the distance from below
            if not len(i):
                break
            near = np.abs(table[i, p] - table[j, p]) <= max_bits
            i, j = i[near], j[near]
        if len(i):
            near = np.bitwise_count(nodes[i] ^ nodes[j]) <= max_bits
            for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True):
                rx, ry = find(x), find(y)
                if rx != ry:
                    root[max(rx, ry)] = min(rx, ry)
                    a_out.append(x)
                    b_out.append(y)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
        step += 1
    return nodes[np.array(a_out, np.int64)], nodes[np.array(b_out, np.int64)]


def equal_blocks(n: int, max_bits: int = 4) -> int:
    """How many blocks a key is made of, so that a bucket of n fingerprints holds FULL by chance at most."""
    equal = 2
    while equal < 5 and n > FULL << (64 * equal // (max_bits + equal)):
        equal += 1
    return equal


def near_links(fps: DataFrame, max_bits: int = 4, n_pivots: int = 24, equal: int | None = None) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp) within max_bits of each other.

    Not every linked pair is an edge, but every linked pair is connected by edges. With max_bits + equal
    blocks, `equal` of them are the same in both; the tables and their bit fields follow from that. More equal
    blocks mean longer keys and more tables; equal_blocks chooses by the number of fingerprints.
    """
    equal = equal or equal_blocks(fps.count(), max_bits)
    blocks = max_bits + equal
    bounds = [round(k * 64 / blocks) for k in range(blocks + 1)]

    def field(k: int):
        lo, n = bounds[k], bounds[k + 1] - bounds[k]
        return F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << n) - 1))

    def named(table: int, chosen: tuple[int, ...]):
        key = F.lit(0).cast("long")
        for k in chosen:
            key = F.shiftleft(key, bounds[k + 1] - bounds[k]) + field(k)
        return F.lit(table << 54) + key

    keys = [named(t, chosen) for t, chosen in enumerate(combinations(range(blocks), equal))]
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    tiled = (
        dealt.join(sizes, "key")
        .withColumn("chunks", F.ceil(F.col("n") / TILE).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"), "fp")
    )
    refs = pivots(n_pivots)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("simhash")
        rest: pa.Table | None = None

        def out(t: pa.Table) -> pa.RecordBatch:
            k = [t.column(c).to_numpy() for c in ("key", "i", "j")]
            new = np.ones(t.num_rows, bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in k], axis=0)
            a, b = linked(np.cumsum(new), t.column("side").to_numpy(), t.column("fp").to_numpy().view(np.uint64), max_bits, refs)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.concat_tables([rest, pa.Table.from_batches([b])]).combine_chunks() if rest is not None else pa.Table.from_batches([b])
            k = [t.column(c).to_numpy() for c in ("key", "i", "j")]
            same = np.all([x == x[-1] for x in k], axis=0)
            cut = t.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield out(t.slice(0, cut).combine_chunks())
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield out(rest.combine_chunks())

    return tiled.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def _components(prints: DataFrame, max_bits: int, scratch: Scratch) -> DataFrame:
    """(fp, component, component_id) of prints(doc_id, fp); component is a fingerprint of the group."""
    nodes = scratch.table(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    parts = connected_components(near_links(nodes.select("fp"), max_bits), scratch).withColumnRenamed("node", "fp")
    whole = nodes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    return scratch.table(whole.join(firsts, "component").select("fp", "component", "component_id"), "named")


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and link like any other. Repeated rows and ids keep one
    row each and share a component. An empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.table(fingerprints(docs, width), "prints")
    named = _components(prints, max_bits, scratch)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """docs without all but one document of each group: the one of the smallest doc_id (null first, equal
    ids by the text's hash). Of rows equal in doc_id and text one stays. All columns stay."""
    scratch = Scratch(docs.sparkSession, "simhash")
    t, d, k = fresh(docs, "text_hash", "kept_id", "kept_hash")
    keyed = docs.withColumn(t, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    prints = scratch.table(fingerprints(keyed, width, t), "prints")
    named = _components(prints, max_bits, scratch)
    kept = prints.join(named, "fp").groupBy("component").agg(F.min(F.struct("doc_id", t)).alias("least")).select(F.col("least.doc_id").alias(d), F.col("least")[t].alias(k))
    out = keyed.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(t) == F.col(k)), "left_semi")
    if prints.groupBy("doc_id", t).count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", t])
    return out.drop(t)


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
