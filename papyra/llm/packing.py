"""Best-fit packing of tokenised documents into fixed-length training sequences.

Tokenising is a narrow pass: words repeat, so each worker keeps a bounded table from words, and the pre-tokens
of words that have several, to ids; only unknown ones are split, and handed to the tokenizer's merges. Only piece lengths are then dealt into groups of bounded
size; each group runs the online algorithm: a fixed number of open bins, their free space in a bitset, the
tightest bin that fits takes the piece, and when a new bin is needed the fullest open one closes.
"""

from __future__ import annotations

import functools
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Scratch, held, slices, texts

#: Words and pre-tokens that a worker remembers at most in each of two generations, and the letters of those
#: remembered (a longer one is encoded anew in each batch).
REMEMBERED, LONGEST = 350_000, 64
#: Below this code point NFC changes nothing and lower() maps each letter by itself.
PLAIN_END = 0x250
#: White space of Unicode, at which every pre-token ends; what a key of a word with other letters begins with.
WHITE, MARK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"), " "


@functools.cache
def _plain_patterns() -> tuple[re.Pattern, re.Pattern]:
    """What needs the tokenizer's own splitting, as <| does, and its split pattern for all other texts."""
    cats: dict[str, list[str]] = {"L": [], "N": [], "Z": []}
    for c in map(chr, range(PLAIN_END)):
        k = "Z" if c.isspace() else unicodedata.category(c)[0]
        if k in cats:
            cats[k].append(re.escape(c))
    letters, numbers, spaces = ("".join(cats[k]) for k in "LNZ")
    other = re.compile(r"[^\x00-\x1b\x20-ɏ]")
    split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")
    return other, split


@functools.cache
def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(0x100)).difference(own))
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(others)}


class Known(dict):
    """ids by word or pre-token: what is asked for and not known is made by `make` and remembered."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make
        self.older: dict[str, bytes] = {}
        #: Long ones of the batch at hand.
        self.rare: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONGEST:
            if word not in self.rare:
                self.rare[word] = self.make(word)
            return self.rare[word]
        ids = self.older.get(word)
        if ids is None:
            ids = self.make(word)
        if len(self) >= REMEMBERED:
            self.older = {}
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """ids of a text as little-endian 32-bit bytes, equal to the tokenizer's own."""

    def __init__(self, path: str, known: bool = True):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: The tokenizer's own merges, for pre-tokens that are split and normal already.
        self.model = self.tokenizer.model
        self.table = Known(self._learn)
        self.other, self.split = _plain_patterns()
        self.letters = _byte_letters()
        #: The split pattern above is this tokenizer's; any other file is read by the tokenizer alone.
        self.known = known and path.endswith("word_bpe_49k.json")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, word: str) -> bytes:
        if word[0] == MARK:
            return self._whole(word[1:])
        if not word.isalpha() and len(parts := self.split.findall(word)) != 1:
            return b"".join(map(self.table.__getitem__, parts))
        if not word.isascii() or not word.isalpha():  # ASCII letters stand for themselves
            word = word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _words(self, text: str) -> list[str]:
        """The table's keys of a text: words between white space, which no pre-token crosses, in small letters;
        of a word with other letters MARK (in no other key) and the word."""
        if "<|" not in text and not self.other.search(text):
            return text.lower().split()
        return [MARK + w if "<|" in w or self.other.search(w) else w.lower() for w in WHITE.split(text) if w]

    def encode(self, batch: list[str]) -> list[bytes]:
        get = self.table.__getitem__
        out = [b"".join(map(get, self._words(t))) if self.known else self._whole(t) for t in batch]
        self.table.rare.clear()
        return out


def encoder(path: str) -> Encoder:
    return held(f"packing {path}", lambda: Encoder(path))


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Pieces of each document's ids, an end id last; only documents over the capacity are cut."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, step, enc = int(end_id).to_bytes(4, "little"), 4 * capacity, encoder(tokenizer)
        for b in slices(batches, "text"):
            rows = [
                (d, k, s // 4, len(p := raw[s : s + step]) // 4, zlib.crc32(p), p)
                for d, ids in zip(b.column("doc_id").to_pylist(), enc.encode(texts(b.column("text"))), strict=True)
                for raw in (ids + end,)
                for k, s in enumerate(range(0, len(raw), step))
            ]
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in cols[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in the order given: online best-fit with at most open_bins open."""
    by_free: dict[int, list[int]] = {}
    free_set = bins = opened = 0
    where, offsets = [], []
    for n in lengths:
        fits = free_set >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            bin_ = by_free[free].pop()
            if not by_free[free]:
                free_set &= ~(1 << free)
            opened -= 1
        else:
            if n < capacity and opened == open_bins:
                fullest = (free_set & -free_set).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    free_set &= ~(1 << fullest)
                opened -= 1
            free, bin_ = capacity, bins
            bins += 1
        where.append(bin_)
        offsets.append(capacity - free)
        if free > n:
            by_free.setdefault(free - n, []).append(bin_)
            free_set |= 1 << (free - n)
            opened += 1
    return where, offsets


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1, open_bins: int = 256, group_rows: int = 8192, with_ids: bool = False) -> DataFrame:
    """Every piece of every row of docs with its sequence_id and offset.

    A null text is empty: one piece that holds the end id alone. Repeated rows are packed once each. An
    empty table gives no rows; other columns are ignored. group_rows pieces at a time are packed on
    one task; a group closes its open bins at its end, at most open_bins of them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), capacity, end_id, with_ids)
    cut = scratch.table(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-cut.count() // group_rows))
    dealt = cut.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).repartitionById(groups, "g")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # one group
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by("row")
        where, offsets = best_fit(t.column("length").to_pylist(), capacity, open_bins)
        ids = np.array(where, np.int64) + (t.column("g")[0].as_py() << 32)
        out = t.drop_columns(["g", "row"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets, pa.int64()))
        yield from out.combine_chunks().to_batches()

    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long")


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
