"""SentencePiece encoding and decoding by suffix-array matching.

A text (blanks as U+2581, one put before it) falls into segments that no piece crosses. The new distinct
segments of a batch are concatenated and indexed by a suffix array as deep as the longest piece; a binary
search of every piece gives its range of occurrences, and with it all edges (start, end, piece). Edges are
sorted by their end and relaxed from left to right over all segments at once: at each end exactly one edge is
the last token of the prefix's encoding, the one that may follow the last token at its start. Two tokens
may be neighbours if merging their joined characters, best score first, gives just the two. A character
without a piece becomes its UTF-8 bytes. The result equals the library's merge order; no vocabulary is made.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, slices, texts

BLANK = "▁"
#: Segments that a worker remembers at most, and their letters; slots of its table of token pairs (a power of two).
REMEMBERED, LONGEST, PAIRS = 300_000, 64, 1 << 21
#: Characters that one suffix array holds at most, but for a longer segment.
INDEXED = 400_000
AT_START, UNKNOWN, NONE = -1, -2, -3
#: Code points and one more, for the separator.
CODES = 0x110001


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, each key's rank among them, and the order that sorts the keys."""
    order = np.argsort(key)
    values = key[order]
    new = np.append(True, values[1:] != values[:-1])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new) - 1
    return values[new], rank, order


class Pieces:
    """The vocabulary, and what a worker remembers of segments and of pairs of tokens."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(k) for k in range(n)]
        plain = [k for k in range(n) if not (sp.is_byte(k) or sp.is_unknown(k) or sp.is_control(k) or sp.is_unused(k))]
        if any(BLANK in self.names[k].lstrip(BLANK) for k in plain):
            raise ValueError("a piece has a blank inside; segments would not be independent")
        self.scores = {self.names[k]: sp.get_score(k) for k in plain}
        self.ids = {self.names[k]: k for k in plain}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        own = [k for k in plain if self.merge(self.names[k]) == [self.names[k]]]
        self.length = np.zeros(n, np.int64)
        self.length[own] = [len(self.names[k]) for k in own]
        self.own = np.array(own)
        self.depth = int(self.length.max())
        self.codes = np.full((len(own), self.depth), -1, np.int64)
        for row, k in enumerate(own):
            self.codes[row, : self.length[k]] = np.frombuffer(self.names[k].encode("utf-32-le"), "<u4")
        self.single = np.zeros(CODES, bool)
        self.single[self.codes[self.length[self.own] == 1, 0]] = True
        # Pieces neither cross a blank nor hold a character without a piece of its own.
        apart = "".join(re.escape(c) for c in "\n\r\t" if not any(c in x for x in self.ids))
        self.segment = re.compile((f"[{apart}]|" if apart else "") + f"{BLANK}+[^{BLANK}{apart}]*|[^{BLANK}{apart}]+")
        self.table: dict[str, bytes] = {}
        self.pair_keys, self.pair_fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.raw = [bytes([int(x[3:5], 16)]) if sp.is_byte(k) else b"" if sp.is_control(k) else " ⁇ ".encode() if sp.is_unknown(k) else x.replace(BLANK, " ").encode() for k, x in enumerate(self.names)]

    def merge(self, text: str) -> list[str]:
        """The characters of text merged by best score, the leftmost first among equals."""
        parts, score = list(text), self.scores.get
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Which pieces may follow the token before them."""
        fit = (before < 0) | (piece < 0)  # a segment's start or an unknown character
        ask = np.flatnonzero(~fit)
        keys = before[ask] * len(self.names) + piece[ask]
        slot = (keys * 0x9E3779B97F4A7C1 >> 20) & (PAIRS - 1)
        known = self.pair_keys[slot] == keys
        fit[ask] = self.pair_fits[slot] & known
        if not known.all():
            new, which = np.unique(keys[~known], return_inverse=True)
            a, b = np.divmod(new, len(self.names))
            own = np.array([self.merge(x + y) == [x, y] for x, y in ((self.names[i], self.names[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True))], bool)
            fit[ask[~known]] = own[which]
            slot = (new * 0x9E3779B97F4A7C1 >> 20) & (PAIRS - 1)
            self.pair_keys[slot], self.pair_fits[slot] = new, own
        return fit

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of every piece in codes, whose separators are -1."""
        present = np.zeros(CODES, bool)
        present[codes] = True  # the separator, -1, is the last one
        letters = np.flatnonzero(present[:-1])
        number = np.zeros(CODES, np.int64)  # 0: the separator
        number[letters] = np.arange(1, len(letters) + 1)
        dense = number[codes]
        bits = int(len(letters) + 1).bit_length()
        per = max(1, min(self.depth, 62 // bits))
        row = number[self.codes]
        use = np.flatnonzero(((row > 0) | (self.codes < 0)).all(axis=1))
        row, ids = row[use], self.own[use]
        size = self.length[ids]
        n = len(codes)
        padded = np.append(dense, np.zeros(self.depth + per, dense.dtype))
        rank, lo, hi = np.zeros(n, np.int64), np.zeros(len(ids), np.int64), np.ones(len(ids), np.int64)
        for d in range(0, self.depth, per):
            part = np.zeros(n, np.int64)
            low, high = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for k in range(d, d + per):
                part = (part << bits) | padded[k : k + n]
                mine = row[:, k] if k < self.depth else np.zeros(len(ids), np.int64)
                inside = k < size
                low = (low << bits) | np.where(inside, mine, 0)
                high = (high << bits) | np.where(inside, mine, (1 << bits) - 1)
            values, part, suffixes = _ranks(part)
            low, high = np.searchsorted(values, low), np.searchsorted(values, high, "right")
            width = int(len(values) + 1).bit_length()
            if d:
                values, rank, suffixes = _ranks((rank << width) | part)
            else:
                values, rank = np.arange(len(values)), part
            longer = size > d
            new_lo = np.searchsorted(values, np.where(longer, (lo << width) | low, lo << width))
            new_hi = np.searchsorted(values, np.where(longer, (lo << width) | high, hi << width))
            dead = longer & (hi - lo != 1)  # its first part does not occur
            lo, hi = new_lo, np.where(dead, new_lo, new_hi)
        firsts = np.append(0, np.cumsum(np.bincount(rank, minlength=len(values))))
        lo, hi = firsts[lo], firsts[np.maximum(lo, hi)]
        count = hi - lo
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        return suffixes[at], np.repeat(ids, count)

    def solve(self, segments: list[str]) -> None:
        """Puts the ids of each segment into the table."""
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        letters = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        codes = np.full(len(letters) + len(segments), -1, np.int64)
        of = np.repeat(np.arange(len(segments)), sizes)
        codes[np.arange(len(letters)) + of] = letters
        start, piece = self.edges(codes)
        alone = np.flatnonzero((codes >= 0) & ~self.single[codes])
        start, piece = np.append(start, alone), np.append(piece, np.full(len(alone), UNKNOWN))
        end = start + np.where(piece < 0, 1, self.length[piece])
        base = np.repeat(begin, sizes + 1)
        offset = end - base[start]
        order = np.argsort(offset.astype(np.uint16) if offset.max(initial=0) < 1 << 16 else offset, kind="stable")
        start, piece, end, offset = start[order], piece[order], end[order], offset[order]
        last = np.full(len(codes) + 1, NONE, np.int64)  # no token ends here
        last[begin] = AT_START
        cuts = np.append(np.flatnonzero(np.append(True, offset[1:] != offset[:-1])), len(offset)).tolist() if len(offset) else []
        # A position's last token is stored at the position after it, which is a letter or the separator.
        for s, e in zip(cuts, cuts[1:]):
            good = last[start[s:e]]
            ok = good != NONE
            ok[ok] = self.fits(good[ok], piece[s:e][ok])
            last[end[s:e][ok]] = piece[s:e][ok]
        at, live = begin + sizes, np.arange(len(segments))
        tokens, where, count = [], [], np.zeros(len(segments), np.int64)
        while len(live):
            t = last[at[live]]
            tokens.append(t)
            where.append(live)
            count[live] += 1
            at[live] -= np.where(t < 0, 1, self.length[t])
            live = live[at[live] > begin[live]]
        token, place = np.empty(int(count.sum()), np.int64), np.cumsum(count)
        for t, live in zip(tokens, where, strict=True):  # the last token was found first
            place[live] -= 1
            token[place[live]] = t
        where = np.repeat(np.arange(len(segments)), count)
        raw, ends = token.astype("<i4").tobytes(), np.cumsum(count) * 4
        for seg, s, e, odd in zip(segments, (ends - count * 4).tolist(), ends.tolist(), np.bincount(where, token < 0, len(segments)).tolist(), strict=True):
            self.table[seg] = raw[s:e] if not odd else self._bytes(seg, np.frombuffer(raw[s:e], "<i4"))

    def _bytes(self, segment: str, token: np.ndarray) -> bytes:
        out, at = [], 0
        for t in token.tolist():
            if t < 0:
                out.append(self.byte_ids[np.frombuffer(segment[at].encode("utf-8", "surrogatepass"), np.uint8)])
                at += 1
            else:
                out.append(np.array([t], np.int32))
                at += int(self.length[t])
        return np.concatenate(out).astype("<i4").tobytes()

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [self.segment.findall(BLANK + x.replace(" ", BLANK)) if x else [] for x in batch]
        seen = set().union(*split)
        if len(self.table) + len(seen) > REMEMBERED:
            self.table.clear()
        new, size = [], 0
        for seg in sorted(seen.difference(self.table)):
            new.append(seg)
            size += len(seg) + 1
            if size >= INDEXED:
                self.solve(new)
                new, size = [], 0
        if new:
            self.solve(new)
        # Long segments (a text without blanks is one) are not remembered, so the table is bounded in bytes.
        rare = {x: self.table.pop(x) for x in seen if len(x) > LONGEST}
        get = (lambda x: rare[x] if x in rare else self.table[x]) if rare else self.table.__getitem__
        return [b"".join(map(get, x)) for x in split]

    def decode(self, ids: list[bytes]) -> list[str]:
        """The texts of ids; a byte sequence that is no UTF-8 gives U+FFFD."""
        get = self.raw.__getitem__
        out = []
        for x in ids:
            t = b"".join(map(get, np.frombuffer(x, "<i4").tolist())).decode("utf-8", "replace")
            out.append(t[1:] if t.startswith(" ") else t)
        return out


def pieces(path: str) -> Pieces:
    return held(f"pieces {path}", lambda: Pieces(path))


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs without text, plus ids, n_tokens, ids_crc32 and lossless (decoding gives the text back).

    A null or empty text has no ids. U+2581 in a text decodes to a blank, so such a text is not lossless.
    Columns of the names added are replaced, the others stay.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    names = ["ids", "n_tokens", "ids_crc32", "lossless"]
    columns = [c for c in docs.columns if c not in ("text", *names)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            batch = texts(b.column("text"))
            raw = pieces(path).encode(batch)
            back = pieces(path).decode(raw)
            ends = np.cumsum([0, *(len(x) // 4 for x in raw)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4").astype(np.int32)))
            new = [ids, pa.array(np.diff(ends)), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array([x == y for x, y in zip(batch, back, strict=True)])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *new], [*columns, *names])

    rows = docs.select(*columns, F.col("text").cast("string").alias("text"))
    extra = {"ids": F.array().cast("array<int>"), "n_tokens": F.lit(0).cast("long"), "ids_crc32": F.lit(0).cast("long"), "lossless": F.lit(True)}
    return rows.mapInArrow(run, rows.drop("text").withColumns(extra).schema)


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """rows with text decoded from ids; null ids give a null text."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    columns = [c for c in rows.columns if c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, None):
            ids = b.column("ids").to_pylist()
            back = pieces(path).decode([np.array(x or [], "<i4").tobytes() for x in ids])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array([None if x is None else y for x, y in zip(ids, back, strict=True)], pa.string())], [*columns, "text"])

    rows = rows.select(*columns)
    return rows.mapInArrow(run, rows.withColumn("text", F.lit("").cast("string")).schema)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
