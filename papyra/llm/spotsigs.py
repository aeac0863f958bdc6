"""SpotSigs document fingerprints: chains of content words that follow common-word anchors.

Anchors are the words that most documents have, counted over the whole corpus. Each anchor is followed by the
next `chain` words that are no anchors; anchor and chain make one signature, also where the text ends before
the chain is whole. A text without an anchor is signed by its runs of chain + 1 words. A fingerprint is the sorted
set of a text's 32-bit signatures.

The join over a corpus partitions the sets by length: two sets whose Jaccard reaches the threshold are of the
same or of neighbouring partitions. Within one, sets meet under a shared signature of their prefixes (the
rarest signatures first, as many as a similar set cannot miss all of), are pruned by their lengths and by how
many signatures are left to share, and are then compared. Tiles are bounded and return spanning forests.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain as chained, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held, parallel, slices, texts
from .graph import connected_components

#: How many anchors are learned, and the share of documents that an anchor is in at least.
N_ANCHORS, LEAST_SHARE = 128, 0.005
PUNCTUATION = "".join(c for c in map(chr, range(0x2100)) if not c.isalnum() and not c.isspace())
#: Words that a worker remembers at most, and their letters; words that a partition counts before it sends them on.
REMEMBERED, LONGEST, COUNTED = 300_000, 64, 300_000
#: Sets of one key that a tile compares at most.
TILE = 128
MIX = np.uint64(0x9E3779B97F4A7C15)


def learn_anchors(docs: DataFrame, count: int = N_ANCHORS, share: float = LEAST_SHARE) -> list[str]:
    """The `count` words that most of docs' texts have, of those in `share` of the rows or more; ties by word.

    Null texts are empty; repeated rows count each; no rows, no anchors. The driver gets `count` rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("spotsigs anchors")
        seen: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for b in slices(batches, "text"):
            for x in texts(b.column("text")):
                # An anchor is written without capitals and stands between blanks somewhere in most texts.
                seen.update(w for w in set(x.lower().split()) if len(w) <= LONGEST)
            if len(seen) > COUNTED:
                yield rows()
                seen.clear()
        yield rows()

    text = docs.select(F.col("text").cast("string").alias("text"))
    least = share * docs.count()
    words = text.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = words.where(F.col("word").rlike(r"^\p{L}[\p{L}'’]*$"))
    return [r.word for r in words.orderBy(F.desc("n"), "word").limit(count).collect()]


class _Words(dict):
    """Word to hash, lowest bit set for anchors; 0 for what has no letter or digit at its ends."""

    def __init__(self, anchors: frozenset[str]):
        super().__init__()
        self.anchors = anchors

    def __missing__(self, word: str) -> int:
        core = word.strip(PUNCTUATION)
        h = (xxhash.xxh64_intdigest(core.encode("utf-8", "surrogatepass")) & ~1 | (core in self.anchors) or 2) if core else 0
        if len(word) <= LONGEST:
            self[word] = h
        return h


def signatures(batch: list[str], anchors: Iterable[str], chain: int = 2) -> np.ndarray:
    """Sorted (document << 32 | signature) of a batch, each once; a text without words has one, of the whole text."""
    anchors = frozenset(anchors)
    table = held(f"spotsigs {hash(anchors)}", lambda: _Words(anchors))
    if len(table) > REMEMBERED:
        table.clear()
    split = [x.lower().split() for x in batch]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    h = np.fromiter(map(table.__getitem__, chained.from_iterable(split)), np.uint64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(batch)), sizes)
    real = h != 0
    h, doc = h[real], doc[real]
    anchor = (h & np.uint64(1)).astype(bool)
    without = np.ones(len(batch), bool)
    without[doc[anchor]] = False
    at, rest = np.flatnonzero(anchor), np.flatnonzero(~anchor)
    k, spot = np.searchsorted(rest, at), h[at]
    near = np.append(doc[rest], np.full(chain, -1))
    word = np.append(h[rest], np.zeros(chain, np.uint64))
    loose = np.flatnonzero(without[doc])  # texts without an anchor: each word with those after it
    every, own = np.append(h, np.zeros(chain, np.uint64)), np.append(doc, np.full(chain, -1))
    run = h[loose]
    for c in range(chain):
        spot = (spot ^ np.where(near[k + c] == doc[at], word[k + c], 0)) * MIX
        spot ^= spot >> np.uint64(31)
        run = (run ^ np.where(own[loose + 1 + c] == doc[loose], every[loose + 1 + c], 0)) * MIX
        run ^= run >> np.uint64(31)
    of, sig = np.append(doc[at], doc[loose]), np.append(spot, run)
    keys = (of.astype(np.uint64) << np.uint64(32)) | (sig >> np.uint64(32))
    none = np.setdiff1d(np.arange(len(batch)), of)
    alone = [d << 32 | xxhash.xxh32_intdigest(batch[d].encode("utf-8", "surrogatepass")) for d in none.tolist()]
    return np.unique(np.concatenate([keys, np.array(alone, np.uint64)]))


def _cuts(keys: np.ndarray, n: int) -> np.ndarray:
    return np.append(0, np.searchsorted(keys, np.arange(1, n + 1, dtype=np.uint64) << np.uint64(32)))


def fingerprint_strings(keys: np.ndarray, n: int) -> list[str]:
    """base64 of each document's sorted little-endian 32-bit signatures."""
    raw = (keys & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
    return [base64.b64encode(raw[4 * s : 4 * e]).decode() for s, e in pairwise(_cuts(keys, n).tolist())]


def likeness(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Jaccard of document k of a with document k of b, for k below n."""
    count = lambda x: np.bincount((x >> np.uint64(32)).astype(np.int64), minlength=n)
    both = count(np.intersect1d(a, b, assume_unique=True))
    return both / np.maximum(1, count(a) + count(b) - both)


def fingerprints(docs: DataFrame, anchors: list[str] | None = None, chain: int = 2) -> DataFrame:
    """docs with the column fingerprint, by anchors learned from docs unless given; a null text counts as
    empty, a column of that name is replaced, other columns stay."""
    columns = [c for c in docs.columns if c != "fingerprint"]
    anchors = learn_anchors(docs) if anchors is None else anchors

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            prints = fingerprint_strings(signatures(texts(b.column("text")), anchors, chain), b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(prints)], [*columns, "fingerprint"])

    return docs.select(*columns).mapInArrow(run, docs.select(*columns).withColumn("fingerprint", F.lit("")).schema)


def _similar(size: np.ndarray, guest: np.ndarray, place: np.ndarray, pair: np.ndarray | None, sets: list[np.ndarray], node: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of one tile that reach the threshold. place: where the shared signature
    is in each set's order; pair: chunk of each row in a tile of two (pairs inside a chunk have their own tile)."""
    order = np.lexsort((node, size))
    size, guest, place, node = size[order], guest[order], place[order], node[order]
    pair = pair[order] if pair is not None else None
    sets = [sets[k] for k in order.tolist()]
    root = list(range(len(order)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in range(len(order)):
        # Sizes ascend: beyond size / threshold no later set can be similar.
        last = int(np.searchsorted(size, int(size[i] / threshold + 1e-9), "right"))
        j = np.arange(i + 1, last)
        need = np.ceil(threshold / (1 + threshold) * (size[i] + size[j]) - 1e-9)
        left = np.minimum(size[i] - place[i], size[j] - place[j])  # what is shared if this one is the first
        live = (left >= need) & ~(guest[i] & guest[j])
        if pair is not None:
            live &= pair[j] != pair[i]
        for k, least in zip(j[live].tolist(), need[live].tolist(), strict=True):
            a, b = find(i), find(k)
            if a == b or node[i] == node[k]:
                continue
            if len(np.intersect1d(sets[i], sets[k], assume_unique=True)) >= least:
                root[max(a, b)] = min(a, b)
                out.append((int(node[i]), int(node[k])))
    return out


def near_duplicates(docs: DataFrame, threshold: float = 0.8, anchors: list[str] | None = None, chain: int = 2) -> DataFrame:
    """(doc_id, n_signatures, component_id) per row of docs: fingerprints with a Jaccard of threshold or more
    link; component_id is the smallest doc_id that links reach, the row's own included (nulls after all ids).

    A null text is empty; texts without words link if they are equal. Repeated rows keep a row each and share a
    component. An empty table gives no rows; other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and 1 at most")
    scratch = Scratch(docs.sparkSession, "spotsigs")
    anchors = learn_anchors(docs) if anchors is None else anchors

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            keys = signatures(texts(b.column("text")), anchors, chain)
            sigs = pa.ListArray.from_arrays(pa.array(_cuts(keys, b.num_rows), pa.int32()), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), sigs], ["doc_id", "sigs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, sigs array<long>")
    rows = scratch.table(rows.withColumns({"h1": F.xxhash64("sigs"), "h2": F.xxhash64(F.lit(1), "sigs")}), "sets")
    nodes = rows.groupBy("h1", "h2").agg(F.any_value("sigs").alias("sigs"), F.min("doc_id").alias("first"))
    nodes = scratch.table(nodes.select(F.monotonically_increasing_id().alias("node"), "sigs", F.size("sigs").alias("size"), "first", "h1", "h2"), "nodes")
    each = nodes.select("node", "size", F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")  # what is in one set only starts no pair
    ranked = each.join(often, "sig", "left").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "sig"))).alias("order"))
    prefix = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9).cast("int") + 1
    heads = ranked.select("node", "size", F.posexplode(F.slice("order", 1, prefix)).alias("place", "x")).where("x.df > 1").select("node", "size", "place", "x.sig")
    part = F.floor(F.ln("size") / F.lit(float(np.log(1 / threshold) if threshold < 1 else 1.0)) + 1e-9).cast("int") if threshold < 1 else F.col("size")
    native = heads.withColumns({"part": part, "guest": F.lit(False)})
    dealt = native.unionByName(native.withColumns({"part": F.col("part") - 1, "guest": F.lit(True)})) if threshold < 1 else native
    dealt = scratch.table(dealt, "heads")
    counted = dealt.groupBy("part", "sig").agg(F.count("*").alias("n"), F.count_if(~F.col("guest")).alias("natives")).where("n > 1 and natives > 0").drop("natives")
    chunks = F.ceil(F.col("n") / TILE).cast("int")
    tiled = (
        dealt.join(counted, ["part", "sig"])
        .withColumn("mine", F.pmod(F.xxhash64("node"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select("part", "sig", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "size", "place", "guest")
        .join(nodes.select("node", "sigs"), "node")
    )
    keys = ["part", "sig", "i", "j"]

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("spotsigs join")
        for t in _tiles(batches, keys):
            at = {c: t.column(c).to_numpy() for c in ("size", "place", "mine", "node")}
            one, guest = t.column("i")[0] == t.column("j")[0], t.column("guest").to_numpy(zero_copy_only=False)
            sets = [np.asarray(x.values) for x in t.column("sigs")]
            found = _similar(at["size"], guest, at["place"], None if one else at["mine"], sets, at["node"], threshold)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    links = tiled.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compared, "a long, b long")
    named = nodes.join(connected_components(links, scratch), "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = scratch.table(named.join(firsts, "component").select("h1", "h2", "component_id"), "named")
    return rows.select("doc_id", F.size("sigs").alias("n_signatures"), "h1", "h2").join(named, ["h1", "h2"]).select("doc_id", "n_signatures", "component_id")


def _tiles(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Each run of rows with equal keys as one batch; the input is sorted by them."""
    rest: list[pa.RecordBatch] = []

    def key(b: pa.RecordBatch, row: int) -> tuple:
        return tuple(b.column(c)[row].as_py() for c in keys)

    for b in batches:
        if not b.num_rows:
            continue
        new = np.any([np.diff(b.column(c).to_numpy()) != 0 for c in keys], axis=0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        if rest and key(rest[-1], 0) != key(b, 0):
            yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
            rest = []
        for s, e in itertools.pairwise(cuts):
            if s:
                yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
                rest = []
            rest.append(b.slice(s, e - s))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, guest, doc_id, text): rows by descending doc_id, dealt by ranges, each bucket's rows in
    order and closed by a guest, the first row of the next bucket (after the last bucket: of the first).

    Boundaries are approximate quantiles of the ids, one a partition, so what the driver gets does not grow
    with the rows. Equal ids are ordered by text; null ids come last.
    """
    spark = docs.sparkSession
    n = parallel(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000)).first()[0] or [])) if n > 1 else []
    low = F.array(*map(F.lit, bounds)).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    bucket = (F.lit(len(bounds)) - F.size(F.filter(low, lambda x: x <= F.col("doc_id")))).cast("int")
    docs = docs.withColumn("bucket", bucket)
    firsts = docs.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).orderBy("bucket").collect()
    to = {(r.bucket, r.doc_id): firsts[k - 1].bucket for k, r in enumerate(firsts)}
    guests = spark.createDataFrame([(b, d, t) for (b, d), t in to.items()], "bucket int, head long, dealt int")
    guests = docs.join(F.broadcast(guests), (docs.bucket == guests.bucket) & docs.doc_id.eqNullSafe(guests["head"])).select(F.col("dealt").alias("bucket"), F.lit(True).alias("guest"), "doc_id", "text")
    rows = docs.select("bucket", F.lit(False).alias("guest"), "doc_id", "text").unionByName(guests)
    return rows.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), "text")


def compare_with_edited(docs: DataFrame, anchors: list[str] | None = None, chain: int = 2, share: int = 3) -> DataFrame:
    """Fingerprints of every text, of its edited text (the last 1/share of its code points replaced by as
    many first ones of the next document) and how like the text's fingerprint is to the edited text's and
    to the next document's. Null texts are empty; repeated rows each have a row; no rows, none."""
    anchors = learn_anchors(docs) if anchors is None else anchors

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for b in slices(batches, "text"):
            rows = list(zip(b.column("bucket").to_pylist(), b.column("guest").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True))
            if last is not None:
                rows.insert(0, last)
            last = rows[-1]
            own = [k for k in range(len(rows) - 1) if not rows[k][1]]
            if not own:
                continue
            n = len(own)  # rows 0 to n - 1; row n follows the last of them, and the rest are guests
            batch = [r[3] for r in rows[: n + 1]]
            edited = [x[: len(x) - len(x) // share] + y[: len(x) // share] for x, y in pairwise(batch)]
            a, e = signatures(batch, anchors, chain), signatures(edited, anchors, chain)
            z = a[np.searchsorted(a, 1 << 32) :] - np.uint64(1 << 32)
            a = a[: np.searchsorted(a, n << 32)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[k][2] for k in own], pa.int64()),
                    pa.array(list(map(len, batch[:n])), pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                    pa.array(fingerprint_strings(a, n)),
                    pa.array(fingerprint_strings(e, n)),
                    pa.array(likeness(a, e, n)),
                    pa.array(likeness(a, z, n)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8_spotsigs_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
