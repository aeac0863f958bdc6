"""Interpolated modified Kneser-Ney model of any order from 2, counted in Spark, stored as sorted hash arrays.

Counting: workers turn whole texts into arrays of word hashes, count words and word pairs of bounded chunks
with numpy and shuffle the counts as packed arrays. Words are dealt by ranges of their hash; pairs by their
first word's hash, but by the pair's for words so frequent that one range would get too many (at most
HOT such words exist, by their share of all tokens). Each range is merged on one task and written as a
sorted array of 64-bit keys beside its counts.

Orders above 2: n-grams of the highest order are counted from the texts and dealt by ranges of their context's
hash. The task that merges a range sends each distinct n-gram's last n - 1 words on, so the next lower order
counts left neighbours; pairs are counted that way too, and are then merged as above.

Storage: files of the shared folder, in key order over all ranges, so a sorted batch of queries meets each
range once. Scoring: workers map the files into memory (from a store that is not a file system they are
copied into an unlinked temporary file first), look up the distinct words and pairs of a batch by binary
search and interpolate. The driver holds totals, counts of counts and one row for each range.
"""

from __future__ import annotations

import functools
import io
import mmap
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sql
from .common import Scratch, held, parallel, remainder, slices, texts_as_bytes

END, START = np.uint64(xxhash.xxh64_intdigest(b" end")), np.uint64(xxhash.xxh64_intdigest(b" start"))  # no word has a blank
CHUNK = 3_000_000
#: Bytes of text for each range, which a task merges in memory.
RANGE = 16_000_000
#: Words that a worker remembers at most, and their bytes.
REMEMBERED, LONGEST = 300_000, 128
#: A word with more than 1 / HOT of all tokens has its pairs dealt by the pair.
HOT = 1000
TOP = np.uint64(0xFFFFFFFFFFFF0000)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= LONGEST:
            self[word] = h
        return h


class _State:
    """What a worker keeps: word hashes, and the mapped arrays of the last model that it used."""

    def __init__(self):
        self.hashes = _Hashes()
        self.uri: str | None = None
        self.arrays: _Arrays | None = None


def tokens(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words, A-Z lower-cased, and one END after each text; and tokens per text."""
    table = held("lm", _State).hashes
    if len(table) > REMEMBERED:
        table.clear()
    words = [x.lower().split() for x in batch]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.empty(int(sizes.sum()) + len(batch), np.uint64)
    ends = np.cumsum(sizes + 1) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = np.fromiter(map(table.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    out[ends] = END
    return out, sizes + 1


def before(tok: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The word before each token; START before a text's first."""
    out = np.empty_like(tok)
    out[1:] = tok[:-1]
    out[np.cumsum(sizes) - sizes] = START
    return out


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x165667B19E3779F9)
    return x ^ (x >> np.uint64(32))


def pair_keys(v: np.ndarray, w: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The key of each pair: ranged by v's hash, by the pair's for hot v; words by their upper 48 bits."""
    v, w = v & TOP, w & TOP
    m = mixed(v, w)
    at = np.searchsorted(hot, v)
    cold = np.ones(len(v), bool) if not len(hot) else hot[np.minimum(at, len(hot) - 1)] != v
    return np.where(cold, (v & np.uint64(0xFFFFFFFF00000000)) | (m >> np.uint64(32)), m)


def gram_keys(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each n-gram's context, and the n-gram's key, whose range is the context's."""
    h = words[0]
    for v in words[1:-1]:
        h = mixed(h, v)
    return h, (h & np.uint64(0xFFFFFFFF00000000)) | (mixed(h, words[-1]) >> np.uint64(32))


def grams(tok: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """The words of each token's n-gram, the token last, by their upper 48 bits."""
    words = [tok]
    for _ in range(order - 1):
        words.insert(0, before(words[0], sizes))
    return [w & TOP for w in words]


def range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def packed(count: np.ndarray) -> bytes:
    """Counts as one byte each; 255 stands for a 64-bit number at the end of the bytes."""
    return np.minimum(count, 255).astype(np.uint8).tobytes() + count[count >= 255].astype("<u8").tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", offset=n).astype(np.int64)
    return out


def six(x: np.ndarray) -> bytes:
    """The upper 48 bits of each number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def summed(keys: list[np.ndarray], *values: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of each list of values."""
    k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    order = np.argsort(k)
    k = k[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return (k[first], *(np.add.reduceat(np.concatenate(v)[order], first) if len(k) else np.zeros(0, np.int64) for v in values))


def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and sizes of about CHUNK tokens at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for b in slices(batches, "text"):
        held.append(tokens(texts_as_bytes(b.column("text"))))
        n += len(held[-1][0])
        if n >= CHUNK:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["at", "kind", "k", "v"])


BLOBS = "at int, kind int, k binary, v binary"
WORDS, LEFT, FOLLOW, HOT_FOLLOW, COUNTS, GRAMS = range(6)


def _by_range(key: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """(range, its slice) of sorted keys."""
    if not len(key):
        return
    r = range_of(key, ranges)
    cut = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
    for s, e in zip(cut.tolist(), np.append(cut[1:], len(r)).tolist(), strict=True):
        yield int(r[s]), slice(s, e)


class Store:
    """Files of a folder that driver and executors share."""

    def __init__(self, uri: str):
        self.uri = uri

    def _local(self) -> str | None:
        return "/" + self.uri.removeprefix("file:").lstrip("/") if self.uri.startswith("file:") else None

    def write(self, name: str, *arrays: np.ndarray) -> None:
        """The arrays one after the other; complete or not there, so a repeated task does no harm."""
        if path := self._local():
            os.makedirs(path, exist_ok=True)
            fd, part = tempfile.mkstemp(dir=path)
            with os.fdopen(fd, "wb") as f:
                for a in arrays:
                    a.tofile(f)
            os.replace(part, f"{path}/{name}")
            return
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.uri)
        store.create_dir(path)
        part = f"{path}/{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            for a in arrays:
                f.write(memoryview(a).cast("B"))
        store.move(part, f"{path}/{name}")

    def map(self, name: str) -> memoryview | mmap.mmap:
        """The file's bytes, mapped."""
        if path := self._local():
            f: io.BufferedIOBase = open(f"{path}/{name}", "rb")  # noqa: SIM115
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(self.uri)
            f = tempfile.TemporaryFile()
            with store.open_input_stream(f"{path}/{name}") as g:
                while part := g.read(1 << 24):
                    f.write(part)
            f.flush()
        with f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.fstat(f.fileno()).st_size else memoryview(b"")


@dataclass
class Layer:
    """One order above 2."""

    order: int
    discounts: np.ndarray
    sizes: list[int]
    context_sizes: list[int]


@dataclass
class Model:
    """Totals, discounts and where the arrays are."""

    uri: str
    ranges: int
    hot: np.ndarray
    total: int  # training tokens
    vocabulary: int
    start: tuple[int, int, int, int]  # the pairs that START begins by count 1, 2, 3 and more, and their sum
    pairs: int
    discounts: np.ndarray  # of pair counts 0, 1, 2, 3+
    lower: np.ndarray  # of left-neighbour counts 0, 1, 2, 3+
    lower_gamma: float
    word_sizes: list[int]
    pair_sizes: list[int]
    layers: list[Layer]  # by order

    def _words(self, r: int) -> tuple[np.ndarray, ...]:
        n = self.word_sizes[r]
        raw = Store(self.uri).map(f"words-{r}") if n else b""  # a range without words has no file
        return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u8", n, 8 * n), np.frombuffer(raw, "<u8", n, 16 * n), np.frombuffer(raw, "<u4", 4 * n, 24 * n).reshape(n, 4)

    def _pairs(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        n = self.pair_sizes[r]
        raw = Store(self.uri).map(f"pairs-{r}") if n else b""
        return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u4", n, 8 * n)

    def _grams(self, at: int, r: int) -> tuple[np.ndarray, np.ndarray]:
        layer, n = self.layers[at], self.layers[at].sizes[r]
        raw = Store(self.uri).map(f"grams{layer.order}-{r}") if n else b""
        return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u4", n, 8 * n)

    def _contexts(self, at: int, r: int) -> tuple[np.ndarray, np.ndarray]:
        layer, n = self.layers[at], self.layers[at].context_sizes[r]
        raw = Store(self.uri).map(f"contexts{layer.order}-{r}") if n else b""
        return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u4", 4 * n, 8 * n).reshape(n, 4)

    def score(self, tok: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per text: known tokens, add-one log10 probability, and the model's log10 probability."""
        arrays = _arrays(self.uri, self)
        v = before(tok, sizes)
        words, at = np.unique(np.append(tok, START), return_inverse=True)
        count, contexts, follow = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros((len(words), 4), np.int64)
        for r, part in _by_range(words, self.ranges):
            keys, c, sums, stats = arrays.words(r)
            k, hit = _found(keys, words[part])
            count[part][hit], contexts[part][hit], follow[part][hit] = c[k], sums[k], stats[k]
        begin = at[-1]
        follow[begin, 1:], contexts[begin] = self.start[:3], self.start[3]
        at = at[:-1]
        before_at = np.append(begin, at[:-1])
        before_at[np.cumsum(sizes) - sizes] = begin
        left = follow[:, 0]
        p1 = self.lower_gamma / (self.vocabulary + 1) + np.maximum(0, left - self.lower[np.minimum(left, 3)]) / max(1, self.pairs)
        gamma = (follow[:, 1:] * self.discounts[1:]).sum(axis=1) / np.maximum(1, contexts)
        gamma[contexts == 0] = 1.0
        key, which = np.unique(pair_keys(v, tok, self.hot), return_inverse=True)
        seen = np.zeros(len(key), np.int64)
        for r, part in _by_range(key, self.ranges):
            keys, c = arrays.pairs(r)
            k, hit = _found(keys, key[part])
            seen[part][hit] = c[k]
        c = seen[which]
        p = gamma[before_at] * p1[at] + np.maximum(0, c - self.discounts[np.minimum(c, 3)]) / np.maximum(1, contexts[before_at])
        for n, layer in enumerate(self.layers):  # each order interpolates with the one below
            h, key = gram_keys(grams(tok, sizes, layer.order))
            h, of = np.unique(h, return_inverse=True)
            stats = np.zeros((len(h), 4), np.int64)
            for r, part in _by_range(h, self.ranges):
                keys, x = arrays.contexts(n, r)
                k, hit = _found(keys, h[part])
                stats[part][hit] = x[k]
            key, which = np.unique(key, return_inverse=True)
            seen = np.zeros(len(key), np.int64)
            for r, part in _by_range(key, self.ranges):
                keys, c = arrays.grams(n, r)
                k, hit = _found(keys, key[part])
                seen[part][hit] = c[k]
            c, sums = seen[which], stats[:, 3]
            rest = np.where(sums > 0, (stats[:, :3] * layer.discounts[1:]).sum(axis=1) / np.maximum(1, sums), 1.0)
            p = rest[of] * p + np.maximum(0, c - layer.discounts[np.minimum(c, 3)]) / np.maximum(1, sums[of])
        base = np.log10((count[at] + 1) / (self.total + self.vocabulary + 1))
        first = np.cumsum(sizes) - sizes
        return np.add.reduceat((count[at] > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)


class _Arrays:
    def __init__(self, model: Model):
        self.words, self.pairs = functools.cache(model._words), functools.cache(model._pairs)
        self.grams, self.contexts = functools.cache(model._grams), functools.cache(model._contexts)


def _arrays(uri: str, model: Model) -> _Arrays:
    state = held("lm", _State)
    if state.uri != uri:
        state.uri, state.arrays = uri, _Arrays(model)
    return state.arrays


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in keys of those asked that are there, and which these are."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(len(asked), bool)
    k = np.searchsorted(keys, asked)
    k[k == len(keys)] = 0
    hit = keys[k] == asked
    return k[hit], hit


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3+ from how many counts are 1, 2, 3 and 4; where a count of counts
    is missing, or a discount falls out of its range, half a count."""
    out = np.array([0.0, 0.5, 0.5, 0.5])
    if all(n):
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k] / n[k - 1]
            if 0 < d < k:
                out[k] = d
    return out


def train(docs: DataFrame, scratch: Scratch, ranges: int | None = None, order: int = 2) -> Model:
    """The model of the order of all texts of docs(text); a null text is empty (one end token), repeated rows
    count each. Without rows the model knows no word: every token then has probability 1, of one unknown word."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    uri = f"{scratch.path}/model"
    text = docs.select(F.col("text").cast("string").alias("text"))
    if not ranges:
        size = text.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        ranges = max(parallel(spark), -(-size // RANGE))

    def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tok, _ in chunks(batches):
            w, c = np.unique(tok, return_counts=True)
            yield _blobs([(r, WORDS, w[s].tobytes(), packed(c[s])) for r, s in _by_range(w, ranges)])

    def merge_words(t: pa.Table) -> pa.Table:
        ks, vs = t.column("k").to_pylist(), t.column("v").to_pylist()
        w, c = summed([np.frombuffer(k, "<u8") for k in ks], [unpacked(v, len(k) // 8) for k, v in zip(ks, vs, strict=True)])
        return pa.table({"at": pa.array([t.column("at")[0].as_py()], pa.int32()), "k": [w.tobytes()], "v": [c.astype("<u8").tobytes()], "n": [len(w)], "total": [int(c.sum())]})

    merged = text.mapInArrow(count_words, BLOBS).groupBy("at").applyInArrow(merge_words, "at int, k binary, v binary, n long, total long")
    merged = scratch.table(merged, "words")
    total, vocabulary = merged.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()

    def frequent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, v in zip(b.column("k").to_pylist(), b.column("v").to_pylist(), strict=True):
                w = np.frombuffer(k, "<u8")[np.frombuffer(v, "<u8") * HOT > total]
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64))], ["w"])

    hot = merged.select("k", "v").mapInArrow(frequent, "w long").toArrow().column("w").to_numpy().view(np.uint64)  # fewer than HOT rows
    hot = np.unique(np.append(hot, START) & TOP)

    def gram_rows(words: list[np.ndarray]) -> list[tuple]:
        """How often each n-gram is there, by range."""
        if len(words) > 2:
            key, at, c = np.unique(gram_keys(words)[1], return_index=True, return_counts=True)
            words = [w[at] for w in words]
            return [(r, GRAMS, b"".join(six(w[s]) for w in words), packed(c[s])) for r, s in _by_range(key, ranges)]
        v, w = words
        key, at, c = np.unique(pair_keys(v, w, hot), return_index=True, return_counts=True)
        v, w = v[at], w[at]
        rows = []
        for r, s in _by_range(key, ranges):
            # runs of one first word are sent once; only hot words' pairs are not neighbours
            new = np.flatnonzero(np.append(True, v[s][1:] != v[s][:-1]))
            runs = np.diff(np.append(new, s.stop - s.start))
            head = np.array([len(new), s.stop - s.start], "<u8").tobytes()
            rows.append((r, GRAMS, head + six(v[s][new]) + six(w[s]), packed(runs) + packed(c[s])))
        return rows

    def count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tok, sizes in chunks(batches):
            yield _blobs(gram_rows(grams(tok, sizes, order)))

    def merge_grams(t: pa.Table) -> pa.Table:
        r = t.column("at")[0].as_py()
        ks, vs = t.column("k").to_pylist(), t.column("v").to_pylist()
        k = t.column("n")[0].as_py()
        sizes = [len(x) // (6 * k) for x in ks]
        words = [np.concatenate([from_six(x[6 * n * i : 6 * n * (i + 1)]) for x, n in zip(ks, sizes, strict=True)]) for i in range(k)]
        c = np.concatenate([unpacked(x, n) for x, n in zip(vs, sizes, strict=True)])
        del ks, vs
        h, key = gram_keys(words)
        key, at, back = np.unique(key, return_index=True, return_inverse=True)
        c = np.bincount(back, c, len(key)).astype(np.int64)
        words, h = [w[at] for w in words], h[at]
        del back
        Store(uri).write(f"grams{k}-{r}", key.astype("<u8"), np.minimum(c, 2**32 - 1).astype("<u4"))
        level = np.minimum(c, 3)
        context, *stats = summed([h], *([(level == x).astype(np.int64)] for x in (1, 2, 3)), [c])
        Store(uri).write(f"contexts{k}-{r}", context.astype("<u8"), np.minimum(np.stack(stats, axis=1), 2**32 - 1).astype("<u4"))
        counts = np.array([len(key), *((c == x).sum() for x in (1, 2, 3, 4)), len(context)], "<u8")
        return pa.Table.from_batches([_blobs([*gram_rows(words[1:]), (r, COUNTS, b"", counts.tobytes())])])

    def merge_pairs(t: pa.Table) -> pa.Table:
        r = t.column("at")[0].as_py()
        vs, ws, cs = [], [], []
        for k, x in zip(t.column("k").to_pylist(), t.column("v").to_pylist(), strict=True):
            n_runs, n = map(int, np.frombuffer(k, "<u8", 2))
            runs = unpacked(x[: n_runs + 8 * int((np.frombuffer(x, np.uint8, n_runs) == 255).sum())], n_runs)
            cs.append(unpacked(x[n_runs + 8 * int((np.frombuffer(x, np.uint8, n_runs) == 255).sum()) :], n))
            vs.append(np.repeat(from_six(k[16 : 16 + 6 * n_runs]), runs))
            ws.append(from_six(k[16 + 6 * n_runs :]))
        v, w, c = np.concatenate(vs), np.concatenate(ws), np.concatenate(cs)
        del vs, ws, cs
        key, at, back = np.unique(pair_keys(v, w, hot), return_index=True, return_inverse=True)
        c = np.bincount(back, c, len(key)).astype(np.int64)
        v, w = v[at], w[at]
        Store(uri).write(f"pairs-{r}", key.astype("<u8"), np.minimum(c, 2**32 - 1).astype("<u4"))
        level = np.minimum(c, 3)
        first, *follow = summed([v], *([(level == k).astype(np.int64)] for k in (1, 2, 3)), [c])
        word, left = summed([w], [np.ones(len(w), np.int64)])
        is_hot = np.isin(first, hot)
        rows = [(q, LEFT, word[s].tobytes(), packed(left[s])) for q, s in _by_range(word, ranges)]
        rows += [(q, FOLLOW, first[~is_hot][s].tobytes(), np.stack(follow, axis=1)[~is_hot][s].astype("<u8").tobytes()) for q, s in _by_range(first[~is_hot], ranges)]
        rows.append((r, HOT_FOLLOW, first[is_hot].tobytes(), np.stack(follow, axis=1)[is_hot].astype("<u8").tobytes()))
        counts = np.array([len(key), *((c == k).sum() for k in (1, 2, 3, 4))], "<u8")
        rows.append((r, COUNTS, b"", counts.tobytes()))
        return pa.Table.from_batches([_blobs(rows)])

    counted, layers, used = text.mapInArrow(count_grams, BLOBS), [], []
    for k in range(order, 2, -1):
        used.append(scratch.table(counted.withColumn("n", F.lit(k)).groupBy("at").applyInArrow(merge_grams, BLOBS), "grams"))
        layer = Layer(k, np.zeros(4), [0] * ranges, [0] * ranges)
        levels = np.zeros(4, np.int64)
        for x in used[-1].where(F.col("kind") == COUNTS).toArrow().to_pylist():  # a row a range
            n = np.frombuffer(x["v"], "<u8").astype(np.int64)
            layer.sizes[x["at"]], layer.context_sizes[x["at"]] = int(n[0]), int(n[5])
            levels += n[1:5]
        layer.discounts = discounts(levels.tolist())
        layers.insert(0, layer)
        counted = used[-1].where(F.col("kind") == GRAMS)
    stats = counted.groupBy("at").applyInArrow(merge_pairs, BLOBS)
    stats = scratch.table(stats, "stats")
    scratch.drop(*used)
    few = stats.where(F.col("kind").isin(HOT_FOLLOW, COUNTS)).toArrow().to_pylist()  # two rows a range
    counts = sum((np.frombuffer(x["v"], "<u8").astype(np.int64) for x in few if x["kind"] == COUNTS), np.zeros(5, np.int64)).tolist()
    pair_sizes = [0] * ranges
    for x in few:
        if x["kind"] == COUNTS:
            pair_sizes[x["at"]] = int(np.frombuffer(x["v"], "<u8")[0])
    mine = [x for x in few if x["kind"] == HOT_FOLLOW]
    hot_stats = [np.frombuffer(x["v"], "<u8").reshape(-1, 4).astype(np.int64) for x in mine]
    hot_word, *hot_follow = summed([np.frombuffer(x["k"], "<u8") for x in mine], *([y[:, k] for y in hot_stats] for k in range(4)))
    hot_follow = np.stack(hot_follow, axis=1) if mine else np.zeros((0, 4), np.int64)

    def finish(t: pa.Table) -> pa.Table:
        r = t.column("at")[0].as_py()
        kinds = t.column("kind").to_pylist()
        parts = list(zip(kinds, t.column("k").to_pylist(), t.column("v").to_pylist(), strict=True))
        word = np.concatenate([np.frombuffer(k, "<u8") for kind, k, _ in parts if kind == WORDS] or [np.zeros(0, np.uint64)])
        count = np.concatenate([np.frombuffer(v, "<u8") for kind, _, v in parts if kind == WORDS] or [np.zeros(0, np.uint64)])
        out, sums = np.zeros((len(word), 4), "<u4"), np.zeros(len(word), "<u8")
        short = word & TOP  # sorted too

        def put(keys: np.ndarray, values: np.ndarray) -> None:
            k, hit = _found(keys, short)
            out[hit, 1:], sums[hit] = np.minimum(values[k, :3], 2**32 - 1), values[k, 3]

        key, left = summed(*zip(*((np.frombuffer(k, "<u8"), unpacked(v, len(k) // 8)) for kind, k, v in parts if kind == LEFT), strict=True)) if LEFT in kinds else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        k, hit = _found(key, short)
        out[hit, 0] = np.minimum(left[k], 2**32 - 1)
        for kind, k, v in parts:
            if kind == FOLLOW:  # a word's pairs are in one range
                put(np.frombuffer(k, "<u8"), np.frombuffer(v, "<u8").reshape(-1, 4))
        put(hot_word, hot_follow)
        Store(uri).write(f"words-{r}", word, count, sums, out)
        n = [int((left == k).sum()) for k in (1, 2, 3, 4)]
        return pa.table({"at": pa.array([r], pa.int32()), "size": [len(word)], "n": pa.array([n], pa.list_(pa.int64()))})

    words = merged.select("at", F.lit(WORDS).alias("kind"), "k", "v")
    rest = stats.where(F.col("kind").isin(LEFT, FOLLOW))
    ends = words.unionByName(rest).groupBy("at").applyInArrow(finish, "at int, size long, n array<bigint>").collect()  # a row a range
    word_sizes = [0] * ranges
    for x in ends:
        word_sizes[x.at] = x.size
    scratch.drop(merged, stats)
    lower_n = [sum(x.n[k] for x in ends) for k in range(4)]
    lower = discounts(lower_n)
    pairs = counts[0]
    left_levels = [lower_n[0], lower_n[1]]
    gamma = (lower[1] * left_levels[0] + lower[2] * left_levels[1] + lower[3] * max(0, vocabulary - sum(left_levels))) / max(1, pairs)
    begin = np.flatnonzero(hot_word == (START & TOP))
    begins = hot_follow[begin[0]].tolist() if len(begin) else [0, 0, 0, 0]
    return Model(uri, ranges, hot, total, vocabulary, tuple(begins), pairs, discounts(counts[1:]), lower, gamma if pairs else 1.0, word_sizes, pair_sizes, layers)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs without text, plus n_tokens, n_known, train_tokens, base_score and score of the whole text.

    A null text is empty: one end token. Columns of these names are replaced, the others stay.
    perplexity is 10 ** (-score / n_tokens).
    """
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    columns = [c for c in docs.columns if c not in ("text", *names)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            tok, sizes = tokens(texts_as_bytes(b.column("text")))
            known, base, own = model.score(tok, sizes)
            new = [sizes, known, np.full(b.num_rows, model.total), base, own]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *map(pa.array, new)], [*columns, *names])

    extra = {c: F.lit(0).cast("long") for c in names[:3]} | {c: F.lit(0.0) for c in names[3:]}
    rows = docs.select(*columns, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, rows.drop("text").withColumns(extra).schema)


def _held_out_scored(spark, sf_dir: str, order: int) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("held_out", remainder("doc_id", 7) == 2)
    model = train(docs.where(~F.col("held_out")), Scratch(spark, "lm"), order=order)
    return score(docs, model)


def op1_kneser_ney(spark, sf_dir: str) -> DataFrame:
    return _held_out_scored(spark, sf_dir, 2)


def lm_trigrams(spark, sf_dir: str) -> DataFrame:
    return _held_out_scored(spark, sf_dir, 3)


_LEVELS = ", ".join(f"count(*) filter (c = {k})::double as n{k}" for k in (1, 2, 3, 4))
_DISCOUNTS = ", ".join(f"case when least(n1, n2, n3, n4) > 0 and {k} - {k + 1} * (n1 / (n1 + 2 * n2)) * n{k + 1} / n{k} between 1e-300 and {k} - 1e-12 then {k} - {k + 1} * (n1 / (n1 + 2 * n2)) * n{k + 1} / n{k} else 0.5 end as d{k}" for k in (1, 2, 3))

#: The bigram model over words as texts; an end has a blank and so is no word.
OP1_SQL = f"""
with d as (
  select doc_id, {sql.crc32("doc_id::varchar")} % 7 = 2 as held_out, list_append({sql.words("text")}, ' end') as w from documents
), tok as (
  select doc_id, held_out, unnest(list_prepend(' start', w[:-2])) as v, unnest(w) as w from d
), seen as (
  select w, count(*) as c from tok where not held_out group by 1
), size as (
  select sum(c)::double as n, count(*)::double as v, sum(c)::bigint as whole from seen
), pairs as (
  select v, w, count(*) as c from tok where not held_out group by 1, 2
), big as (
  select {_DISCOUNTS} from (select {_LEVELS} from pairs)
), lefts as (
  select w, count(*) as c from pairs group by 1
), small as (
  select {_DISCOUNTS} from (select {_LEVELS} from lefts)
), base as (
  select (select count(*) from pairs)::double as p, (select sum(case c when 1 then d1 when 2 then d2 else d3 end) from lefts, small) / (select count(*) from pairs) as gamma
), first as (
  select w, (c - case c when 1 then d1 when 2 then d2 else d3 end) / p as p1 from lefts, small, base
), ctx as (
  select v, sum(c)::double as total, sum(case c when 1 then d1 when 2 then d2 else d3 end) as rest from pairs, big group by 1
), probs as (
  select t.doc_id, t.held_out, coalesce(s.c, 0) as c, coalesce(f.p1, 0) + gamma / (z.v + 1) as p1, x.total, x.rest,
    coalesce(p.c - case p.c when 1 then d1 when 2 then d2 else d3 end, 0) as over_, z.n, z.v, z.whole
  from tok t left join seen s on s.w = t.w left join first f on f.w = t.w left join ctx x on x.v = t.v left join pairs p on p.v = t.v and p.w = t.w, base, size z, big
)
select doc_id, held_out, count(*) as n_tokens, count(*) filter (c > 0) as n_known, any_value(whole) as train_tokens,
  sum(log10((c + 1) / (n + v + 1))) as base_score, sum(log10(case when total is null then p1 else (over_ + rest * p1) / total end)) as score
from probs group by 1, 2
"""
