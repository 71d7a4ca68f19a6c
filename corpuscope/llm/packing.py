"""Best-fit packing of token sequences by swap-based local search.

A document's ids are cut into pieces of at most ``capacity`` ids, only where
the document is longer than that.  The pieces are dealt by the hash of a row
key to groups of about ``GROUP`` pieces, whose number follows the input, and
each group is packed by itself, so a group's one bin that is not full is all
that the dealing costs.

Within a group the pieces go, in the order of their keys, to the fullest bin
that takes them.  Local search then works on the bins that are not full: a
piece moves to a fuller bin, or is exchanged for one or for two pieces of
another bin, or two are exchanged for one, wherever that increases the sum of
squared fills.  The emptiest bins lose their pieces until they are empty.  The
search ends at the lower bound, or where no step on any bin is left.

Nulls are the empty text, which has the end id alone.  Repeated rows and null
ids are packed once a row.  Columns other than the id and the text are not
read.  An empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_counts import by_order

#: Pieces packed together.
GROUP = 16_384
#: Words whose ids are put together at once.
SLICE = 1 << 18

#: What the fast path of ``Encoder`` relies on, as the tokenizer's file says it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Tokens that ``Batch`` cuts as ``SPLIT`` does: printable ASCII, lower-case Latin-1 letters, or ASCII and general punctuation.
PLAIN = re.compile(rb"[!-~]+|(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|(?:[!-/:-@\[-`{-~]|\xe2\x80[\x90-\xa7\xaa-\xae\xb0-\xbf])+")
#: Stands for the ids of tokens that are not plain.
ODD = b"odd"
SPACE, LETTER, DIGIT, OTHER = range(4)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CLASS = np.full(256, OTHER, np.uint8)
CLASS[list(map(ord, common.SPACES))] = SPACE
CLASS[97:123] = CLASS[128:] = LETTER
CLASS[48:58] = DIGIT


def cut(data: np.ndarray, starts: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """Tokens of texts that lie one after another in ``data`` (UTF-8) from ``starts`` on, in lower case, and each token's place."""
    data = LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    low = lead[(data[lead + 1] <= 0x9E) & (data[lead + 1] != 0x97)] + 1
    data[low] += 0x20
    kind = CLASS[data]
    lead = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
    third = data[lead + 2]
    lead = lead[(third >= 0x90) & (third != 0xA8) & (third != 0xA9) & (third != 0xAF)]
    for k in range(3):
        kind[lead + k] = OTHER
    first = np.ones(len(data), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    first[starts[starts < len(data)]] = True
    quotes = np.flatnonzero((data[:-1] == 39) & first[:-1] & first[1:] & (kind[1:] == LETTER))
    quotes = quotes[~np.isin(quotes + 1, starts)]
    padded = np.append(data, [0, 0])
    one, two = padded[quotes + 1], padded[quotes + 2]
    ends = np.where(np.isin(one, list(b"stmd")), 2, np.where(np.isin(one, list(b"rv")) & (two == 101) | (one == 108) & (two == 108), 3, 0))
    ends[(ends == 3) & np.isin(quotes + 2, starts)] = 0
    quotes, ends = quotes[ends > 0], ends[ends > 0]
    first[quotes + 1] = False
    after = quotes + ends
    first[after[after < len(data)]] = True
    first &= kind != SPACE
    kept = kind != SPACE
    at = np.flatnonzero(first)
    offsets = np.append((np.cumsum(kept) - 1)[at], int(kept.sum())).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])]), at


def byte_letters() -> dict[int, str]:
    """The visible character that byte-level tokenizers put for each byte."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers.

    Where the tokenizer's file shows that it lowers letters and lets no token
    hold white space, a batch is cut into the tokenizer's own pre-tokens, each
    distinct one is encoded by itself, and byte-bounded caches keep what
    recurs.  Texts with characters that the cutting does not know are encoded
    word by word; any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        said = json.loads(self.tokenizer.to_str())
        model, split = said["model"], {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
        self.by_words = (
            (said["normalizer"] or {}).get("normalizers") == [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
            and (said["pre_tokenizer"] or {}).get("pretokenizers", [None])[0] == split
            and [(p["type"], p.get("add_prefix_space"), p.get("use_regex")) for p in said["pre_tokenizer"]["pretokenizers"][1:]] == [("ByteLevel", False, False)]
            and model["type"] == "BPE"
            and not any(model.get(x) for x in ("unk_token", "dropout", "continuing_subword_prefix", "ignore_merges"))
            and all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not re.search(r"\s", t["content"]) for t in said["added_tokens"])
        )
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.words = common.ByteCache(32 << 20)
        self.pieces = common.ByteCache(96 << 20)

    def piece_ids(self, piece: bytes) -> bytes:
        """Ids of a plain token."""
        if not PLAIN.fullmatch(piece):
            return ODD
        ids = [t.id for t in self.model.tokenize(piece.decode() if piece.isascii() else piece.decode("latin1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def word_ids(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def by_word(self, text: str) -> np.ndarray:
        """A text with odd tokens, word by word; ASCII letters are lowered unless special tokens may be told by their case."""
        words = text.encode()
        words = (words if b"<|" in words else words.lower()).split()
        return np.frombuffer(b"".join(self.words.look_up([w.decode() for w in words], self.word_ids)), "<u4")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_words:
            return [np.array(e.ids, "<u4") for some in by_order(texts) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        raw = [t.encode() for t in texts]
        ends = np.cumsum([len(b) for b in raw])
        starts = ends - [len(b) for b in raw]
        tokens, at = cut(np.frombuffer(b"".join(raw), np.uint8), starts)
        coded = tokens.dictionary_encode()
        table = self.pieces.look_up(values(coded.dictionary), self.piece_ids)
        sizes = np.fromiter(map(len, table), np.int64, len(table))
        odd = sizes % 4 > 0
        sizes //= 4
        ids = np.frombuffer(b"".join(x for x in table if x is not ODD) if odd.any() else b"".join(table), "<u4")
        codes, parts, many = coded.indices.to_numpy(), [], []
        for a in range(0, len(codes), SLICE):
            got, n = gathered(ids, sizes, codes[a : a + SLICE])
            parts.append(got)
            many.append(n)
        flat, many = np.concatenate([np.zeros(0, "<u4"), *parts]), np.concatenate([np.zeros(0, np.int64), *many])
        count = np.diff(np.searchsorted(at, np.append(starts, ends[-1:])))
        strange = segment_sums(odd[codes], count) > 0
        stops = np.cumsum(segment_sums(many, count)).tolist()
        return [self.by_word(t) if x or b"<|" in b else flat[a:z] for t, b, x, a, z in zip(texts, raw, strange.tolist(), [0, *stops], stops)]


def values(array: pa.BinaryArray) -> list[bytes]:
    """What ``to_pylist`` gives, from the buffers."""
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].tolist()
    data = array.buffers()[2].to_pybytes() if len(array) else b""
    return [data[a:b] for a, b in zip(offsets, offsets[1:])]


def gathered(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a table (``flat``, cut by ``sizes``) that ``codes`` name, one after another, and their sizes."""
    many = sizes[codes]
    starts = (np.cumsum(sizes) - sizes)[codes]
    at = np.arange(int(many.sum())) + np.repeat(starts - (np.cumsum(many) - many), many)
    return flat[at], many


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``counts`` successive values each."""
    sums = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids`` of each piece."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    tail = np.array([end_id], "<u4")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, piece, start, length, crc, ids = [], [], [], [], [], []
        for i, found in enumerate(encoder(path).encode(common.texts_of(batch))):
            found = np.concatenate([found, tail])
            for k, a in enumerate(range(0, len(found), capacity)):
                part = found[a : a + capacity].tobytes()
                at.append(i)
                piece.append(k)
                start.append(a)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if keep_ids:
                    ids.append(part)
        out = [batch.column("id").take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        return pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * keep_ids, ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    return common.map_batches(rows, run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: each size, in the order given, goes where the least room is left."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    have = 0  # bit r: some bin has room r
    for i, s in enumerate(sizes.tolist()):
        fits = have >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                have &= ~(1 << r)
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        r -= s
        if r:
            room[r].append(b)
            have |= 1 << r
    return bins


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins."""
    return max(-(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum())) if len(sizes) else 0


class Search:
    """Local search; ``steps`` counts what was done by kind."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int):
        self.sizes, self.capacity = sizes.astype(np.int64), capacity
        self.bins = [list(b) for b in bins]
        self.fill = np.array([int(self.sizes[b].sum()) for b in bins], np.int64)
        self.bin_of = np.empty(len(sizes), np.int64)
        for k, b in enumerate(self.bins):
            self.bin_of[b] = k
        self.steps: Counter[str] = Counter()
        self.by_fill = sorted((f, k) for k, f in enumerate(self.fill.tolist()) if 0 < f < capacity)  # the bins that are not full
        self.order = np.argsort(self.sizes, kind="stable")  # pieces by size
        self.sorted_sizes = self.sizes[self.order]

    def shift(self, items: list[int], to: int) -> None:
        touched = {to, *(int(self.bin_of[i]) for i in items)}
        for k in touched:
            self.unlist(k)
        for i in items:
            k = int(self.bin_of[i])
            self.bins[k].remove(i)
            self.bins[to].append(i)
            self.fill[k] -= self.sizes[i]
            self.fill[to] += self.sizes[i]
            self.bin_of[i] = to
        for k in touched:
            f = int(self.fill[k])
            if 0 < f < self.capacity:
                insort(self.by_fill, (f, k))

    def unlist(self, k: int) -> None:
        f = int(self.fill[k])
        if 0 < f < self.capacity:
            del self.by_fill[bisect_left(self.by_fill, (f, k))]

    def near(self, lo: int, hi: int, a: int) -> np.ndarray:
        """Pieces of ``lo`` to ``hi`` ids in other bins that are not full."""
        i, j = np.searchsorted(self.sorted_sizes, (lo, hi + 1))
        found = self.order[i:j]
        own = self.bin_of[found]
        return found[(own != a) & (self.fill[own] < self.capacity)]

    def best(self, found: np.ndarray, d: np.ndarray, a: int) -> int | None:
        """Which of ``found``, given for ``d`` ids more, increases the squared fills the most."""
        to = self.bin_of[found]
        gain = d * (self.fill[to] - self.fill[a] + d)
        gain[(d <= 0) | (d > self.capacity - self.fill[to])] = 0
        k = int(np.argmax(gain)) if len(gain) else -1
        return k if k >= 0 and gain[k] > 0 else None

    def move(self, a: int, own: list[int]) -> bool:
        for x in own:
            s = int(self.sizes[x])
            at = bisect_left(self.by_fill, (self.capacity - s + 1, -1)) - 1  # the fullest bin with room
            if at >= 0 and self.by_fill[at][1] == a:
                at -= 1
            if at >= 0 and self.by_fill[at][0] + s > self.fill[a]:
                self.shift([x], self.by_fill[at][1])
                return True
        return False

    def one_for_one(self, a: int, own: list[int]) -> bool:
        most = self.capacity - self.by_fill[0][0]
        for x in own:
            s = int(self.sizes[x])
            found = self.near(s - most, s - 1, a)
            k = self.best(found, s - self.sizes[found], a)
            if k is not None:
                y = int(found[k])
                to = int(self.bin_of[y])
                self.shift([x], to)
                self.shift([y], a)
                return True
        return False

    def two_for_one(self, a: int, own: list[int]) -> bool:
        """Two pieces of ``a`` for one of another bin."""
        most = self.capacity - self.by_fill[0][0]
        for i, x in enumerate(own):
            for y in own[i + 1 :]:
                s = int(self.sizes[x] + self.sizes[y])
                found = self.near(s - most, s - 1, a)
                k = self.best(found, s - self.sizes[found], a)
                if k is not None:
                    z = int(found[k])
                    to = int(self.bin_of[z])
                    self.shift([x, y], to)
                    self.shift([z], a)
                    return True
        return False

    def one_for_two(self, a: int, own: list[int]) -> bool:
        """One piece of ``a`` for two of another bin."""
        for x in own:
            s = int(self.sizes[x])
            best, pair = 0, None
            for f, k in reversed(self.by_fill):
                if k == a or not self.bins[k]:
                    continue
                least = sorted(self.bins[k], key=self.sizes.__getitem__)
                lo, hi, room = 0, len(least) - 1, self.capacity - f
                while lo < hi:
                    d = s - int(self.sizes[least[lo]] + self.sizes[least[hi]])
                    if d <= 0:
                        hi -= 1
                        continue
                    gain = d * (f - int(self.fill[a]) + d)
                    if d <= room and gain > best:
                        best, pair = gain, (k, least[lo], least[hi])
                    lo += 1
                if best:
                    break
            if pair:
                self.shift([x], pair[0])
                self.shift([pair[1], pair[2]], a)
                return True
        return False

    def run(self) -> list[list[int]]:
        goal = least_bins(self.sizes, self.capacity)
        left = int((self.fill > 0).sum())
        changed = True
        while changed and left > goal:
            changed = False
            for _, a in list(self.by_fill):  # the emptiest first
                while left > goal and 0 < self.fill[a] < self.capacity:
                    own = sorted(self.bins[a], key=lambda i: -int(self.sizes[i]))
                    kind = next((s for s in (self.move, self.one_for_one, self.two_for_one, self.one_for_two) if s(a, own)), None)
                    if kind is None:
                        break
                    self.steps[kind.__name__] += 1
                    changed = True
                    left -= not self.fill[a]
                if left <= goal:
                    break
        return [b for b in self.bins if b]


def pack_group(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size."""
    bins = Search(sizes, best_fit(sizes, capacity), capacity).run()
    bin_of, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for k, b in enumerate(bins):
        b = np.array(b)
        bin_of[b] = k
        offset[b] = np.cumsum(sizes[b]) - sizes[b]
    return bin_of, offset


def pack(rows: DataFrame, capacity: int = 4096, length_col: str = "length") -> DataFrame:
    """``rows``, each of 1 to ``capacity`` ids, with ``sequence_id`` and ``offset``."""
    key, group = common.free_name(rows, "row_key"), common.free_name(rows, "group")
    kept = common.with_key(rows, key)
    groups = max(1, -(-kept.count() // GROUP))
    light = kept.select(F.col(key).alias("k"), F.pmod(F.xxhash64(key), F.lit(groups)).alias("g"), F.col(length_col).cast("bigint").alias("n"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        bin_of, offset = pack_group(part["n"].to_numpy(), capacity)
        return pd.DataFrame({key: part["k"].to_numpy(), "sequence_id": bin_of + (int(part["g"].iloc[0]) << 32), "offset": offset})

    placed = light.groupBy("g").applyInPandas(run, f"{key} bigint, sequence_id bigint, offset bigint")
    return kept.join(placed, key).drop(key, group)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Where each piece of each document goes, with its ids if asked for."""
    return pack(pieces(docs, path, capacity, end_id, id_col, text_col, keep_ids), capacity).withColumnRenamed("id", id_col)
