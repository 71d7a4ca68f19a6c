"""Removal of every window of units that starts anywhere else too: the plan that both substring operators share.

A unit is a byte or a word, a window ``length`` units of one text.  What decides
is the input alone: a unit goes if some window over it starts at any other
place, in the same text or another one.

1. Each window has a key, the least hash of the ``gram``-unit runs in it.  Equal
   windows have equal keys, and successive windows mostly share one, so a text
   has few.  Keys of one place only are dropped after one pre-aggregated count.
2. Texts that are equal are one text with a count.  The windows of each other
   key, cut out of their text as stretches of successive windows, meet in a
   shard by that key; equal stretches are one with a weight.
3. An operator's own method finds, within each shard, which windows recur.
4. A key whose stretches exceed ``CROWDED`` bytes, as a short passage that many
   texts hold gives, is parted before it comes to shards: by how far into the
   window the run with the least hash stands, in blocks, and by what all
   windows of such a block have in common.  Blocks get smaller until none is
   crowded; at the last, a block is one window.
5. The places come back to their texts, and each row is cut.

Nothing here follows a key, text or group to the driver or into one task
without a bound: counts are pre-aggregated, shards are as many as the bytes ask
for, and the joins are plain ones that adaptive execution can split.

Nulls are the empty text.  Texts of fewer units than a window lose nothing.
Repeated rows are copies of each other.  Null ids stay null.  Other columns are
not read.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Windows whose hashes are held at once.
BLOCK = 1 << 18
#: Bytes of a text whose words are hashed at once; each takes some 50 bytes meanwhile.
PIECE = 1 << 18
#: Bytes of stretches in a shard, on average.
SHARD = 1 << 20
#: Bytes of stretches of one key from which its windows are counted by digest.
CROWDED = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[ord(c) for c in common.SPACES]] = True
ODD = 0x9E3779B97F4A7C15
POWERS = np.cumprod(np.full(4096, ODD, np.uint64))

Finder = Callable[[list[bytes], list[int]], list[list[tuple[int, int]]]]


@dataclass(frozen=True)
class Unit:
    """Bytes or words, the windows' length and that of the hashed runs, in units."""

    words: bool
    length: int
    gram: int


class Text:
    """A text's units."""

    def __init__(self, text: str, unit: Unit):
        self.unit, self.bytes = unit, text.encode()
        self.codes = np.frombuffer(self.bytes, np.uint8)
        if unit.words:
            edges = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[self.codes], [True]])))
            self.starts, self.ends = edges[0::2], edges[1::2]
            self.n = len(self.starts)
        else:
            self.n = len(self.codes)

    @classmethod
    def of_bytes(cls, part: bytes, unit: Unit) -> "Text":
        """A piece of a text that need not be UTF-8 by itself."""
        out = cls("", unit)
        out.bytes, out.codes, out.n = part, np.frombuffer(part, np.uint8), len(part)
        return out

    def values(self, a: int, b: int) -> np.ndarray:
        """A number for each of the units ``a`` to ``b``, the same for equal ones."""
        if not self.unit.words:
            return self.codes[a:b].astype(np.uint64) + np.uint64(1)
        starts, ends = self.starts[a:b], self.ends[a:b]
        lo, hi = int(starts[0]), int(ends[-1])
        if hi - lo <= PIECE:
            return mix(self.sums(starts, starts, hi))
        starts, ends = np.ascontiguousarray(starts), np.ascontiguousarray(ends)
        out = np.zeros(b - a, np.uint64)
        for at in range(lo, hi, PIECE):
            to = min(hi, at + PIECE)
            i, j = np.searchsorted(ends, at, "right"), np.searchsorted(starts, to, "left")
            if i < j:
                out[i:j] += self.sums(starts[i:j], np.maximum(starts[i:j], at), to)
        return mix(out)

    def sums(self, starts: np.ndarray, since: np.ndarray, to: int) -> np.ndarray:
        """What the bytes before ``to``, of each word those from ``since`` on, add to the numbers of the words at ``starts``."""
        lo = since[0]
        part = self.codes[lo:to].astype(np.uint64) + np.uint64(1)
        part[SPACE[self.codes[lo:to]]] = 0
        place = np.arange(lo, to) - np.repeat(starts, np.diff(np.append(since, to)))
        return np.add.reduceat(part * POWERS[place % len(POWERS)], since - lo)

    def part(self, a: int, b: int) -> bytes:
        """Units ``a`` to ``b``; words are joined by one space."""
        if not self.unit.words:
            return self.bytes[a:b]
        return b" ".join(self.bytes[self.starts[a] : self.ends[b - 1]].split()) if a < b else b""


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` successive values, put together from those of powers of two."""
    power, size, step = values, 1, ODD
    out, done = None, 0
    while True:
        if k & size:
            scale = np.uint64(pow(ODD, done, 1 << 64))
            out = power if out is None else out[: len(power) - done] + scale * power[done : done + len(out)]
            done += size
        if done == k:
            break
        power = power[: len(power) - size] + np.uint64(step) * power[size:]
        size, step = 2 * size, step * step % (1 << 64)
    return mix(out[: len(values) - k + 1])


def sliding(x: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """The best of each ``width`` successive numbers."""
    size = 1
    while 2 * size <= width:
        x = best(x[: len(x) - size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def keys_of(text: Text) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """In blocks of windows: the first window, the windows' keys and the hashes of the runs."""
    unit = text.unit
    count, wide = text.n - unit.length + 1, unit.length - unit.gram + 1
    for a in range(0, count, BLOCK):
        b = min(count, a + BLOCK)
        g = gram_hashes(text.values(a, b + unit.length - 1), unit.gram)
        yield a, sliding(g, wide, np.minimum), g


def places(keys: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The hashes of the runs that are the least of some window, one for each such run."""
    wide = len(g) - len(keys) + 1
    pad = np.zeros(wide - 1, np.uint64)
    return g[g == sliding(np.concatenate([pad, keys, pad]), wide, np.maximum)]


def stretches(text: Text, wanted: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Key, first window and number of windows of each run of windows with one of the ``wanted`` keys."""
    most = 2 * text.unit.length
    for at, keys, _ in keys_of(text):
        first = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        last = np.append(first[1:], len(keys))
        where = np.searchsorted(wanted, keys[first]).clip(max=len(wanted) - 1)
        for i in np.flatnonzero(wanted[where] == keys[first]).tolist():
            for a in range(int(first[i]), int(last[i]), most):
                yield int(keys[first[i]]), at + a, min(int(last[i]), a + most) - a


def digest(b: bytes) -> bytes:
    return hashlib.md5(b, usedforsecurity=False).digest()


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """The runs of true flags, end exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]])))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))


def blocks_of(unit: Unit) -> tuple[int, ...]:
    """Sizes of the blocks by which crowded keys are parted, the largest first."""
    return tuple(dict.fromkeys((max(1, unit.length // 6), max(1, unit.length // 40), 1)))


def parted(part: bytes, h: int, block: int, unit: Unit) -> Iterator[tuple[bytes, int, int]]:
    """The windows of a stretch with key ``h`` by blocks: a key, the first window and the number of windows of each.

    A window's place in its block is how far before the first run with the
    least hash it starts.  The key is of what all windows of that block hold,
    so equal windows have equal keys.
    """
    text = Text(part.decode(), unit) if unit.words else Text.of_bytes(part, unit)
    g = gram_hashes(text.values(0, text.n), unit.gram)
    at = np.flatnonzero(g == np.uint64(h))
    count = text.n - unit.length + 1
    first = at[np.searchsorted(at, np.arange(count))]
    number = (first - np.arange(count)) // block
    edges = [0, *(np.flatnonzero((np.diff(first) != 0) | (np.diff(number) != 0)) + 1).tolist(), count]
    for a, b in zip(edges, edges[1:]):
        p, k = int(first[a]), int(number[a])
        core = text.part(p - k * block, p - k * block - block + 1 + unit.length)
        yield digest(f"{h} {k} {block} ".encode() + core), a, b - a


def text_key(text: str = "text"):
    return F.unhex(F.md5(F.col(text).cast("binary")))


def recurring(rows: DataFrame, unit: Unit, find: Finder) -> tuple[DataFrame, list[DataFrame]]:
    """``key`` of a text of ``rows`` (``text``) and ``found``, the first and last-but-one window of each run that recurs; and the stored tables behind it."""

    def anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, hashes, counts = [], [], []
        for t in common.texts_of(batch):
            text = Text(t, unit)
            if text.n >= unit.length:
                h, n = np.unique(np.concatenate([places(k, g) for _, k, g in keys_of(text)]), return_counts=True)
                keys += [digest(text.bytes)] * len(h)
                hashes.append(h)
                counts.append(np.minimum(n, 2))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), signed(np.concatenate([np.zeros(0, np.uint64), *hashes])), pa.array(np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int8), pa.int8())], ["key", "h", "n"])

    seen = common.stored(common.map_batches(rows.select("text"), anchors, "key binary, h bigint, n tinyint"), "keys")
    shared = seen.groupBy("h").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.max("n").alias("n")).where("a != b or n > 1").select("h")
    wanted = seen.select("h", "key").join(shared, "h").groupBy("key").agg(F.collect_set("h").alias("hs"))
    texts = rows.select("text", text_key().alias("key")).groupBy("key").agg(F.first("text").alias("text"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, hashes, starts, parts = [], [], [], []
        for key, t, hs in zip(batch.column("key").to_pylist(), common.texts_of(batch), batch.column("hs"), strict=True):
            text = Text(t, unit)
            for h, a, n in stretches(text, np.sort(hs.values.to_numpy(zero_copy_only=False).view(np.uint64))):
                keys.append(key)
                hashes.append(h)
                starts.append(a)
                parts.append(text.part(a, a + n + unit.length - 1))
        ids = [digest(p) for p in parts]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), signed(np.array(hashes, np.uint64)), pa.array(starts, pa.int64()), pa.array(ids, pa.binary()), pa.array(parts, pa.binary())], ["key", "h", "start", "sid", "part"])

    found = common.stored(common.map_batches(texts.join(wanted, "key").select("key", "text", "hs"), cut, "key binary, h bigint, start bigint, sid binary, part binary"), "stretches")
    common.discard(seen)
    distinct = found.groupBy("h", "sid", "part").agg(F.count("*").alias("weight")).select("h", F.col("h").cast("string").cast("binary").alias("g"), "sid", "part", "weight")
    cells = [common.stored(distinct, "distinct")]
    calm, crowded = settle(cells[0])
    groups, places_of, behind = [calm], [], [found]
    for block in blocks_of(unit):
        if crowded is None:
            break
        cut_up = common.stored(smaller(crowded, block, unit), "blocks")
        places_of.append(cut_up.select("sid", F.col("from").alias("above"), "at"))
        cells.append(common.stored(cut_up.groupBy("h", "g", "sid", "part").agg(F.sum("weight").alias("weight")), "distinct"))
        behind.append(cut_up)
        calm, crowded = settle(cells[-1])
        groups.append(calm)
    every = groups[0]
    for more in groups[1:]:
        every = every.unionByName(more)
    shards = 1 + (every.agg(F.sum(F.length("part"))).first()[0] or 0) // SHARD

    def solve(group: pa.Table) -> pa.Table:
        ids, parts, weights = (group.column(c).to_pylist() for c in ("sid", "part", "weight"))
        hits = [(i, r) for i, r in zip(ids, find(parts, weights), strict=True) if r]
        return pa.table([pa.array([i for i, _ in hits], pa.binary()), pa.array([[x for ab in r for x in ab] for _, r in hits], pa.list_(pa.int32()))], names=["sid", "runs"])

    sharded = every.select(F.pmod(F.xxhash64("g"), F.lit(shards)).alias("shard"), "sid", "part", F.least("weight", F.lit(2)).cast("int").alias("weight"))
    marks = common.stored(sharded.groupBy("shard").applyInArrow(solve, "sid binary, runs array<int>"), "marks")
    behind.append(marks)
    common.discard(*cells)
    for level in range(len(places_of) - 1, -1, -1):  # what blocks have found belongs to what they were cut from
        up = places_of[level].join(marks, "sid").select(F.col("above").alias("sid"), F.transform("runs", lambda x: x + F.col("at")).alias("runs"))
        marks = marks.unionAll(up)
    return found.select("sid", "key", "start").join(marks, "sid").groupBy("key").agg(F.flatten(F.collect_list(F.transform("runs", lambda x: x + F.col("start")))).alias("found")), behind


def settle(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups (``g``) of at most ``CROWDED`` bytes, and the others; none, if there are none."""
    sizes = rows.groupBy("g").agg(F.sum(F.length("part")).alias("size"), F.count("*").alias("n"))
    crowded = common.stored(sizes.where((F.col("size") > CROWDED) & (F.col("n") > 1)).select("g"), "crowded")
    if not crowded.limit(1).count():
        return rows.select("g", "sid", "part", "weight"), None
    return rows.join(crowded, "g", "left_anti").select("g", "sid", "part", "weight"), rows.join(crowded, "g", "left_semi")


def smaller(rows: DataFrame, block: int, unit: Unit) -> DataFrame:
    """Crowded stretches cut into blocks: new ``g``, ``sid`` and ``part``, and where (``from``, ``at``) each was."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for h, sid, part, w in zip(*(batch.column(c).to_pylist() for c in ("h", "sid", "part", "weight")), strict=True):
            cut = Text(part.decode(), unit) if unit.words else Text.of_bytes(part, unit)
            for g, a, n in parted(part, h % (1 << 64), block, unit):
                own = cut.part(a, a + n + unit.length - 1)
                out.append((h, g, digest(g + own), own, w, sid, a))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["h", "g", "sid", "part", "weight", "from", "at"])

    return common.map_batches(rows.select("h", "sid", "part", "weight"), run, "h bigint, g binary, sid binary, part binary, weight bigint, `from` binary, at int")


def merged(found: list[int], length: int, n: int, whole: bool) -> list[tuple[int, int]]:
    """Units to remove, as maximal runs in order."""
    if n < length:
        return []
    if whole:
        return [(0, n)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(found[0::2], found[1::2], strict=True)):
        b += length - 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove(docs: DataFrame, unit: Unit, find: Finder, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``id_col``, ``n_units``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if asked for, ``kept`` (bytes) of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    copies = rows.select(text_key().alias("key")).groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("whole"))
    found, behind = recurring(rows, unit, find)
    marks = common.stored(found.join(copies, "key", "full_outer"), "removals")
    common.discard(*behind)
    out = rows.withColumn("key", text_key()).join(marks, "key", "left").select("id", "text", "found", "whole")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, sums, kept = [], [], []
        for t, found, whole in zip(common.texts_of(batch), batch.column("found"), batch.column("whole").to_pylist(), strict=True):
            text = Text(t, unit)
            gone = merged(found.as_py() or [], unit.length, text.n, bool(whole))
            edges = [0, *(x for ab in gone for x in ab), text.n]
            parts = [text.part(a, b) for a, b in zip(edges[0::2], edges[1::2], strict=True) if a < b]
            left = (b" " if unit.words else b"").join(parts)
            counts.append((text.n, sum(b - a for a, b in gone), len(gone)))
            sums.append(hashlib.sha256(left).hexdigest())
            if keep_text:
                kept.append(left)
        return pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array(sums, pa.string())] + [pa.array(kept, pa.binary())] * keep_text, ["id", "n_units", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text)

    kind = rows.schema["id"].dataType.simpleString()
    return common.map_batches(out, run, f"id {kind}, n_units bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text).withColumnRenamed("id", id_col)
