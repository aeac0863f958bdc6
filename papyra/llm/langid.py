"""Language identification by rank-order profiles of character n-grams (out-of-place distance).

A text is lower-cased, runs of non-letters become one blank, and its 1- to 3-grams (blanks mark word
ends) are counted over the whole text. Profiles are the most frequent n-grams of all training texts of a
language, ranked. A document's most frequent n-grams are compared with every profile: the distance is the
sum of rank differences, an absent n-gram costs the profile's size. Counting is numpy over Arrow batches;
only (language, n-gram, count) rows are shuffled, aggregated on both sides. The profiles sent to the
workers hold languages x size rows; the number of languages is bounded by max_languages.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import resampling, sql
from .common import Scratch, held, remainder, slices, texts

ORDERS = (1, 2, 3)
#: An n-gram is a number: its code points, CODE_BITS each, the first highest, zeros after a short one. Numbers
#: order n-grams as texts are ordered.
CODE_BITS = 21
#: (language, n-gram) counts that a partition holds before it sends them on.
HELD = 400_000
#: Bytes of text that are counted at once: arrays of some hundred bytes for each letter stand beside it.
SLICE_BYTES = 250_000
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def gram_counts(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, count) of a batch, sorted by document and n-gram."""
    codes = np.frombuffer("\0".join([*(x.lower() for x in batch), ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = codes == 0
    # A text's own NUL would shift the documents; such texts are cleaned first (rare).
    if int(ends.sum()) != len(batch):
        return gram_counts([x.replace("\0", " ") for x in batch])
    letter = _letters()[codes]
    doc = np.cumsum(ends) - ends
    first = np.empty(len(codes), bool)
    first[0], first[1:] = True, ends[:-1]
    keep = letter | np.append(True, letter[:-1]) | first
    code, doc = np.where(letter, codes, 32)[keep], doc[keep].astype(np.uint64)
    # Within a batch its few different code points are numbered, in their order, so that sorting keys stay short.
    known = np.unique(code)
    number = np.zeros(int(known[-1]) + 1, np.uint64)
    number[known] = np.arange(1, len(known) + 1)
    code = number[code]
    blank = number[32]
    bits = np.uint64(int(len(known)).bit_length())
    top = max(ORDERS)
    out = []
    for n in ORDERS:
        if len(code) < n:
            continue
        g = doc[: len(code) - n + 1]
        inside = g == doc[n - 1 :]
        if n == 1:
            inside = inside & (code != blank)
        for k in range(n):
            g = g << bits | code[k : len(code) - n + 1 + k]
        out.append(g[inside] << bits * np.uint64(top - n))
    keys, counts = np.unique(np.concatenate(out), return_counts=True)
    gram, part = np.zeros(len(keys), np.int64), np.uint64((1 << int(bits)) - 1)
    known = np.append(0, known).astype(np.int64)
    for k in range(top):
        gram = gram << CODE_BITS | known[(keys >> bits * np.uint64(top - 1 - k) & part).astype(np.int64)]
    return (keys >> bits * np.uint64(top)).astype(np.int64), gram, counts


def ranked(doc: np.ndarray, gram: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, rank from 0) of the size most frequent n-grams of each document; ties by n-gram."""
    order = np.lexsort((gram, -count, doc))
    doc, gram = doc[order], gram[order]
    new = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    rank = np.arange(len(doc)) - start
    top = rank < size
    return doc[top], gram[top], rank[top]


class _Counts:
    """Counts of n-grams by language, in arrays."""

    def __init__(self):
        self.parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, name: str, gram: np.ndarray, count: np.ndarray) -> None:
        self.parts.setdefault(name, []).append((gram, count))
        self.size += len(gram)

    def merge(self) -> None:
        self.size = 0
        for name, parts in self.parts.items():
            gram, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            count = np.bincount(at, np.concatenate([c for _, c in parts]), len(gram)).astype(np.int64)
            self.parts[name] = [(gram, count)]
            self.size += len(gram)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for name, [(gram, count)] in self.parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram), pa.array(count)], ["lang", "gram", "n"])
        self.parts, self.size = {}, 0


def profiles(docs: DataFrame, size: int = 300, lang: str = "lang") -> DataFrame:
    """(lang, gram, rank) of all rows with a language; one row per language and n-gram, ties by n-gram.

    A null or empty text adds nothing; repeated rows count each; no rows with a language, no profiles.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("langid")
        total = _Counts()
        for b in slices(batches, "text", SLICE_BYTES):
            doc, gram, count = gram_counts(texts(b.column("text")))
            names, at = np.unique(np.array(b.column("lang").to_pylist(), dtype=object), return_inverse=True)
            for k, name in enumerate(names):
                mine = at[doc] == k
                total.add(name, gram[mine], count[mine])
            if total.size > 4 * HELD:
                total.merge()
            if total.size > HELD and all(len(x) == 1 for x in total.parts.values()):
                yield from total.rows()
        yield from total.rows()

    known = docs.where(F.col(lang).isNotNull()).select(F.col("text").cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).select("lang", "gram", "rank")


def identify(docs: DataFrame, profile: DataFrame, size: int = 300, max_languages: int = 1000) -> DataFrame:
    """docs with lang_pred and score (1 - distance / largest distance) for the whole text of each row.

    A null text, or one without a letter, is `und` with score 0; so is every text if no profile was
    learned. Ties go to the first language by name. Columns of docs named lang_pred or score are replaced.
    """
    rows = profile.orderBy("lang", "rank").limit(max_languages * size + 1).toArrow()
    names = sorted(set(rows.column("lang").to_pylist()))
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    at = {x: k for k, x in enumerate(names)}
    grams, inverse = np.unique(rows.column("gram").to_numpy(), return_inverse=True)
    ranks = np.full((len(grams) + 1, max(1, len(names))), -1, np.int32)
    ranks[inverse, [at[x] for x in rows.column("lang").to_pylist()]] = rows.column("rank").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((names, grams, ranks))
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("langid")
        names, grams, ranks = shared.value
        for b in slices(batches, "text", SLICE_BYTES):
            n = b.num_rows
            doc, gram, rank = ranked(*gram_counts(texts(b.column("text"))), size)
            k = np.searchsorted(grams, gram)
            hit = k < len(grams)
            hit[hit] = grams[k[hit]] == gram[hit]
            k = np.where(hit, k, len(grams))
            theirs = ranks[k]
            apart = np.where(theirs < 0, size, np.abs(theirs - rank[:, None]))
            used = np.bincount(doc, minlength=n)
            far = np.stack([np.bincount(doc, apart[:, x], n) for x in range(apart.shape[1])], axis=1)
            best = far.argmin(axis=1)
            known = (used > 0) & (len(names) > 0)
            score = np.where(known, 1 - far[np.arange(n), best] / np.maximum(1, used * size), 0.0)
            pred = [names[x] if y else UNKNOWN for x, y in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(pred), pa.array(score)], [*columns, "lang_pred", "score"])

    schema = StructType([*(docs.schema[c] for c in columns), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.select(*columns).mapInArrow(run, schema)


def least_score(docs: DataFrame, profile: DataFrame, quantile: float = 0.001, share: float = 0.8, most: float = 0.3) -> float:
    """What scores less is explained by no profile: `share` of the score that all but the quantile of docs' rows
    with a language reach, by every one of them that has a letter, and `most` at most. No rows: 0."""
    known = docs.where(F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"))
    scores = identify(known, profile).where(F.col("lang_pred") != UNKNOWN).select(F.col("score").alias("key"))
    found = resampling.quantile(Scratch(docs.sparkSession, "langid").table(scores, "scores"), quantile)
    return min(most, share * found) if found is not None else 0.0


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", remainder("doc_id", 3) == 1)
    learned = profiles(docs.where(~F.col("held_out")))
    out = identify(docs.select("doc_id", "text", "held_out"), learned)
    return out.select("doc_id", "held_out", "lang_pred", "score")


#: Profiles and distances over n-grams as texts.
OP10_SQL = f"""
with s as (
  select doc_id, lang, {sql.crc32("doc_id::varchar")} % 3 = 1 as held_out, regexp_extract_all(regexp_replace(lower(coalesce(text, '')) || ' ', '\\P{{L}}+', ' ', 'g'), '.') as c from documents
), grams as (
  select doc_id, unnest(list_concat(list_filter(c, lambda x: x <> ' '), list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]), list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) as g from s
), counts as (
  select doc_id, g, count(*) as n from grams group by 1, 2
), mine as (
  select * from (select doc_id, g, row_number() over (partition by doc_id order by n desc, g) - 1 as k from counts) where k < 300
), learned as (
  select lang, g, sum(n) as n from counts join s using (doc_id) where not held_out and lang is not null group by 1, 2
), profile as (
  select * from (select lang, g, row_number() over (partition by lang order by n desc, g) - 1 as k from learned) where k < 300
), far as (
  select m.doc_id, l.lang, sum(case when p.k is null then 300 else abs(p.k - m.k) end) as far, count(*) as used
  from mine m cross join (select distinct lang from profile) l left join profile p on p.lang = l.lang and p.g = m.g group by 1, 2
), best as (
  select * from (select *, row_number() over (partition by doc_id order by far, lang) as k from far) where k = 1
)
select s.doc_id, held_out, coalesce(b.lang, 'und') as lang_pred, coalesce(1 - far::double / (used * 300), 0::double) as score from s left join best b using (doc_id)
"""
