"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Words and marks of a text, and their pairs, are hashed into a fixed number of buckets. Two bags of buckets
are counted: one over all target texts, one over all texts. A document's log weight is the sum of its
n-grams' log ratios target / raw. Adding Gumbel noise and taking the k largest draws k documents without
replacement in proportion to their weights. Where the target rows set k, they do so by cross-validation: each
part of them is judged by a model of the others. The models have `buckets` numbers each, whatever the corpus;
the k-th largest key is found by counting in ever finer bins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, held, slices, texts

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|\n")
#: Tokens that a worker remembers at most, and their letters.
REMEMBERED, LONGEST = 300_000, 64
BUCKETS = 1 << 16
#: Parts of the target rows, by hash of the id; a part is judged by the model of the others.
HOLD = 4
#: Target ids that are broadcast at most; more are joined by a shuffle of the texts.
BROADCAST_IDS = 1_000_000


class _Tokens(dict):
    def __missing__(self, token: str) -> int:
        h = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        if len(token) <= LONGEST:
            self[token] = h
        return h


def hashed_ngrams(batch: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every token and every pair of neighbours, in no order."""
    table = held("resampling", _Tokens)
    if len(table) > REMEMBERED:
        table.clear()
    found = [TOKEN.findall(x.lower()) for x in batch]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    h = np.fromiter(map(table.__getitem__, chain.from_iterable(found)), np.uint64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(batch)), sizes)
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(24)
    same = doc[:-1] == doc[1:]
    n = np.uint64(buckets)
    return np.concatenate([doc, doc[:-1][same]]), np.concatenate([h % n, pair[same] % n]).astype(np.int64)


def gumbel(doc_ids: list, seed: int) -> np.ndarray:
    """Standard Gumbel noise fixed by seed and id, so a repeated task draws the same."""
    u = np.array([xxhash.xxh64_intdigest(str(x), seed) >> 11 for x in doc_ids], np.float64)
    return -np.log(-np.log((u + 0.5) / 2.0**53))


def log_ratios(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), add-one, from docs(text, part): part is a target row's part,
    from 0, and HOLD for all other rows. Row p has the target without part p, row HOLD the whole target."""
    parts = [f"part_{p}" for p in range(HOLD)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((HOLD + 1, buckets), np.int64)
        for b in slices(batches, "text"):
            doc, k = hashed_ngrams(texts(b.column("text")), buckets)
            counts += np.bincount(b.column("part").to_numpy()[doc] * buckets + k, minlength=counts.size).reshape(counts.shape)
        raw = counts.sum(axis=0)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, raw[some], *counts[:HOLD, some])], ["bucket", "raw", *parts])

    counts = docs.select("text", F.col("part").cast("long").alias("part")).mapInArrow(run, ", ".join(f"{c} long" for c in ("bucket", "raw", *parts)))
    counts = counts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("raw", *parts)]).toArrow()  # at most `buckets` rows
    raw, target = np.ones(buckets), np.zeros((HOLD, buckets))
    at = counts.column("bucket").to_numpy()
    raw[at] += counts.column("raw").to_numpy()
    for p, c in enumerate(parts):
        target[p, at] = counts.column(c).to_numpy()
    target = 1 + target.sum(axis=0) - np.concatenate([target, np.zeros((1, buckets))])
    return np.log(target / target.sum(axis=1, keepdims=True)) - np.log(raw / raw.sum())


def log_weights(docs: DataFrame, ratios: np.ndarray, seed: int = 0, others: dict[str, np.ndarray] | None = None) -> DataFrame:
    """docs with n_grams, log_weight and key (log_weight plus noise); no n-gram: both minus infinity. others adds
    the keys by other ratios under names of their own."""
    shared = docs.sparkSession.sparkContext.broadcast((ratios, others or {}))
    columns = [c for c in docs.columns if c not in ("n_grams", "log_weight", "key")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, others = shared.value
        for b in slices(batches, "text"):
            doc, k = hashed_ngrams(texts(b.column("text")), len(ratios))
            n = np.bincount(doc, minlength=b.num_rows)
            noise = gumbel(b.column("doc_id").to_pylist(), seed)
            weight = np.where(n > 0, np.bincount(doc, ratios[k], b.num_rows), -np.inf)
            out = {"n_grams": n, "log_weight": weight, "key": weight + noise}
            out |= {c: np.where(n > 0, np.bincount(doc, r[k], b.num_rows), -np.inf) + noise for c, r in others.items()}
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *map(pa.array, out.values())], [*columns, *out])

    extra = {"n_grams": F.lit(0).cast("long")} | {c: F.lit(0.0) for c in ("log_weight", "key", *(others or {}))}
    rows = docs.select(*columns)
    return rows.mapInArrow(run, rows.withColumns(extra).schema)


def kth_largest(keys: DataFrame, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The k-th largest finite value of column key, minus infinity if there are fewer; by bins that narrow."""
    keys = keys.where(F.col("key") > F.lit(-math.inf)).select("key")
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if k > n:
        return -math.inf
    if k <= 0:
        return math.inf
    while n > few and low < high:
        part = keys.where(F.col("key").between(low, high))
        at = F.least(F.lit(bins - 1), F.floor((F.col("key") - low) / (high - low) * bins))
        rows = part.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("bin")).collect()
        for r in rows:
            if k <= r.n:
                break
            k -= r.n
        if (r.low, r.high, r.n) == (low, high, n):
            break
        low, high, n = r.low, r.high, r.n
    if low == high:
        return low
    return keys.where(F.col("key").between(low, high)).orderBy(F.desc("key")).limit(k).agg(F.min("key")).first()[0]


def quantile(keys: DataFrame, share: float) -> float | None:
    """The quantile of column key, between two values as F.percentile has it, but by kth_largest: no task holds
    all values. No rows: None."""
    n = keys.count()
    if not n:
        return None
    at = int(share * (n - 1))
    low, over = kth_largest(keys, n - at), share * (n - 1) - at
    return low + over * (kth_largest(keys, n - at - 1) - low) if over and low > -math.inf else low


def resample(docs: DataFrame, target_ids: DataFrame, k: int | None = None, recall: float = 0.998, seed: int = 0, buckets: int = BUCKETS, keep_text: bool = False) -> DataFrame:
    """docs (without text unless keep_text), plus n_grams, log_weight, key and selected.

    target_ids(doc_id) names target rows, each of which is in one of HOLD parts by hash of its id. k rows are
    selected, more only where keys tie with the k-th; the target model is then fitted on all parts but the first,
    whose rows stay unseen. Without k it is fitted on all target rows, and all of them set k: for each part, the
    number of rows that a model without it must select to have the share `recall` of that part; k is the mean.
    Without any target row nothing is known against a document and every text that has an n-gram is selected.
    A null or empty text is never selected. Repeated rows share their noise. Columns of the names added are
    replaced.
    """
    scratch = Scratch(docs.sparkSession, "resampling")
    known, *judged = fresh(docs, "known_id", *(f"key_without_{p}" for p in range(HOLD)))
    part = F.pmod(F.xxhash64(F.lit(1), F.col(known)), F.lit(HOLD))
    ids = scratch.table(target_ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias(known)).distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    marked = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col(known), "left")
    ratios = log_ratios(marked.select("text", F.when(F.col(known).isNotNull(), part).otherwise(HOLD).alias("part")), buckets)
    scored = log_weights(docs, ratios[HOLD], seed, dict(zip(judged, ratios, strict=False))) if k is None else log_weights(docs, ratios[0], seed)
    scored = scratch.table(scored.drop(*() if keep_text else ("text",)), "keys")
    if k is None:
        targets = scored.join(ids, F.col("doc_id") == F.col(known)).select(part.alias("part"), *judged)
        targets = scratch.table(targets, "targets")
        floors = {c: quantile(targets.where(F.col("part") == p).select(F.col(c).alias("key")), 1 - recall) for p, c in enumerate(judged)}
        counted = [F.count_if(F.col(c) >= floor) for c, floor in floors.items() if floor is not None]
        k = round(np.mean(scored.agg(*counted).first())) if counted else None
    least = kth_largest(scored, k) if k is not None else -math.inf
    return scored.drop(*judged).withColumn("selected", (F.col("key") >= least) & (F.col("n_grams") > 0))


def op4_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample(docs, labels.where("quality = 1 and toxic = 0"))
