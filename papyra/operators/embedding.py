"""Embedding plans: texts, windows, resumption, and the vector table. Models are injected functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.dates import date_ordinal, end_ordinal

#: Chunks a window, characters a token (an estimate), tokens a context window.
WINDOW, CHARS_PER_TOKEN, WINDOW_TOKENS = 40, 2.2, 32_000
QUERY_PREFIX = "Instruct: Given a search query, retrieve relevant passages\nQuery: "


class Embedder(Protocol):
    """Vectors of lists of texts that belong together, and of queries."""

    def embed_documents(self, windows: list[list[str]]) -> list[list[list[float]]]: ...

    def embed_queries(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """A deterministic stand-in without a model: signed word hashes, scaled to length one."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def _one(self, text: str) -> list[float]:
        import zlib

        v = [0.0] * self.dim
        for w in text.lower().split():
            h = zlib.crc32(w.encode())
            v[h % self.dim] += 1.0 if h >> 31 else -1.0
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v] if n else v

    def embed_documents(self, windows: list[list[str]]) -> list[list[list[float]]]:
        return [[self._one(t) for t in w] for w in windows]

    def embed_queries(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]


EMBEDDERS: dict[str, Callable[..., Embedder]] = {"hash": HashEmbedder}


def make_embedder(name: str, **options) -> Embedder:
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedder {name!r}; known: {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[name](**options)


def embed_text(breadcrumb: Column, text: Column) -> Column:
    return F.when(F.coalesce(breadcrumb, F.lit("")) == "", text).otherwise(F.concat(breadcrumb, F.lit("\n\n"), text))


def windows(chunks: DataFrame, size: int = WINDOW) -> DataFrame:
    """chunks with window_nr: consecutive runs of `size` chunks of a document."""
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")) - 1
    return chunks.withColumn("window_nr", F.floor(k / size).cast("int"))


def token_windows(chunks: DataFrame, budget: int = WINDOW_TOKENS, per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """(doc_id, window_nr, first, last, tokens): chunks in order, joined while their estimate fits the budget."""
    tokens = F.greatest(F.lit(1), F.floor(F.length("text") / per_token)).cast("int")
    listed = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", tokens.alias("n")))).alias("l"))
    kind = "array<struct<first:int,last:int,tokens:int>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        new = F.struct(x["chunk_index"].alias("first"), x["chunk_index"].alias("last"), x["n"].alias("tokens"))
        grown = F.struct(last["first"].alias("first"), x["chunk_index"].alias("last"), (last["tokens"] + x["n"]).alias("tokens"))
        fits = (F.size(acc) > 0) & (last["tokens"] + x["n"] <= budget)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(new)))

    folded = F.aggregate("l", F.array().cast(kind), step)
    return listed.select("doc_id", F.posexplode(folded).alias("window_nr", "x")).select("doc_id", "window_nr", "x.*")


def resume_plan(windowed: DataFrame, cache: DataFrame) -> DataFrame:
    """(doc_id, window_nr, chunk_id, store): windows with a missing vector, whole; store marks the missing."""
    seen = windowed.join(cache.select("chunk_id", F.lit(True).alias("cached")).distinct(), "chunk_id", "left")
    missing = F.col("cached").isNull()
    due = F.max(missing).over(Window.partitionBy("doc_id", "window_nr"))
    return seen.select("doc_id", "window_nr", "chunk_id", missing.alias("store"), due.alias("due")).where("due").drop("due")


def embed(plan: DataFrame, chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """(chunk_id, v) of the plan's missing vectors; a window goes to the model as a whole."""
    rows = plan.join(chunks.select("chunk_id", "chunk_index", "text"), "chunk_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_index")
        (vectors,) = embedder.embed_documents([pdf.text.tolist()])
        if len(vectors) != len(pdf):
            raise ValueError(f"{len(vectors)} vectors for {len(pdf)} chunks")
        return pd.DataFrame({"chunk_id": pdf.chunk_id, "v": vectors})[pdf.store.to_numpy()]

    return rows.groupBy("doc_id", "window_nr").applyInPandas(run, "chunk_id string, v array<double>")


def embed_queries(queries: DataFrame, embedder: Embedder, prefix: str = "") -> DataFrame:
    """queries with v."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(v=embedder.embed_queries([prefix + q for q in f["query"]]))

    return queries.mapInPandas(run, queries.withColumn("v", F.array().cast("array<double>")).schema)


def vector_table(vectors: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vector index's rows with interval ordinals, and (orphans): vectors without a chunk."""
    rows = vectors.join(chunks, "chunk_id").withColumns({"begin_ord": date_ordinal(F.col("begin_date")), "end_ord": end_ordinal(F.col("end_date"), F.col("end_sentinel"))})
    return rows, vectors.join(chunks, "chunk_id", "left_anti").agg(F.count("*").alias("orphans"))


def write_vector_table(rows: DataFrame, path: str) -> None:
    """Replaces the table; current editions are a partition of their own, dates are sorted for pruning.

    Rows are dealt by ranges of date and id, so neither half of the table nor a frequent date is one task."""
    rows.repartitionByRange("is_current", "begin_ord", F.xxhash64("chunk_id")).sortWithinPartitions("is_current", "begin_ord").write.mode("overwrite").partitionBy("is_current").parquet(path)


def fixed_pieces(docs: DataFrame, size: int = 2000, least: int = 6) -> DataFrame:
    """Distinct pieces of `size` characters from texts of at least least * size; a last, short one is left."""
    n = F.length("text")
    starts = F.sequence(F.lit(0), n - size - 1, F.lit(size))
    rows = docs.where(n >= least * size).select("text", F.explode(starts).alias("at"))
    return rows.select(F.expr(f"substring(text, at + 1, {size})").alias("piece")).distinct()
