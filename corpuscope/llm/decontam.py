"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and their white space is collapsed; items
that are equal then are one item, with the smallest id.  An item of m
characters has an error budget of k = floor(RATE * m) edits and is split into
k + 1 pieces; whatever k edits do, one piece stays whole.  Automata find exact
piece hits in every whole text, and Myers' bit-parallel distance decides each
place that a hit points to.  An item without a budget is one piece, which must
stand between white space or the ends of the text.  Null and empty items match
nothing.

The texts are read once, whatever the number of items: these go in blocks of
about ``BLOCK`` characters, each a broadcast value that executors keep on disk,
and a task takes the blocks in turn over each ``TURN`` bytes of texts.  What the
driver and a task hold at once follows the size of a block, and results do not
depend on it.

Null and empty texts match nothing and are clean.  Repeated rows and null ids
give their own rows; an empty table of either kind gives no matches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

RATE = 0.08
BLOCK = 1 << 20
TURN = 16 << 20
#: Blocks whose automata a worker keeps; more are built anew in each turn.
BLOCKS_KEPT = 4


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(m: int, rate: float) -> int:
    return int(m * rate)


def split_pieces(text: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of even length, each with its place."""
    edges = [len(text) * i // (k + 1) for i in range(k + 2)]
    return [(a, text[a:b]) for a, b in zip(edges, edges[1:])]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to any part of ``text``, and where the first such part ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, at = score, j + 1
        ph <<= 1
        pv = ((mh << 1) | ~(xv | ph)) & full
        mv = ph & xv & full
    return best, at


class Matcher:
    """Finds a block of normalised items in normalised texts."""

    def __init__(self, items: tuple[str, ...], rate: float):
        import ahocorasick

        self.items, self.rate = items, rate
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.budgets = [budget(len(t), rate) for t in items]
        for i, t in enumerate(items):
            for a, piece in split_pieces(t, self.budgets[i]):
                where[piece].append((i, a))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.any = bool(where)
        if self.any:
            self.automaton.make_automaton()

    def find(self, text: str, first: bool = False) -> list[tuple[int, int, int]]:
        """Item, distance and end of the best match of each item that matches; only one if ``first``."""
        out: list[tuple[int, int, int]] = []
        if not self.any or not text:
            return out
        starts: dict[int, list[int]] = defaultdict(list)
        for end, (n, at) in self.automaton.iter(text):
            for i, a in at:
                starts[i].append(end + 1 - n - a)
        for i, found in starts.items():
            pattern, k = self.items[i], self.budgets[i]
            m = len(pattern)
            if not k:
                at = next((a for a in found if text[a - 1 : a] in ("", " ") and text[a + m : a + m + 1] in ("", " ")), None)
                if at is not None:
                    out.append((i, 0, at + m))
                    if first:
                        break
                continue
            peq = masks(pattern)
            best, best_end = k + 1, 0
            found.sort()
            at = 0
            while at < len(found):
                lo = hi = found[at]
                while at < len(found) and found[at] <= hi + k:
                    hi = found[at]
                    at += 1
                a = max(0, lo - k)
                d, end = myers(peq, m, text[a : hi + m + k])
                if d < best:
                    best, best_end = d, a + end
                    if not d or first:
                        break
            if best <= k:
                out.append((i, best, best_end))
                if first:
                    break
        return out


@lru_cache(maxsize=BLOCKS_KEPT)
def matcher(items: tuple[str, ...], rate: float) -> Matcher:
    return Matcher(items, rate)


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, tuple[str, ...]]]:
    """Ids and texts of the distinct items, in blocks of about ``BLOCK`` characters, which come to the driver one by one."""
    own = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([normal(t) for t in common.texts_of(batch)], pa.string())], ["id", "text"])

    even = common.map_batches(own, run, own.schema).where("text != ''")
    even = common.stored(even.groupBy("text").agg(F.min("id").alias("id")), "items")
    total = even.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + total // BLOCK
    for k in range(n):
        rows = even.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("id").collect()
        if rows:
            yield [r["id"] for r in rows], tuple(r["text"] for r in rows)


def in_turns(batches: Iterator[pa.RecordBatch], at: int, held: list[Broadcast], rate: float, first: bool) -> Iterator[tuple[list[pa.RecordBatch], list[list[tuple]]]]:
    """Batches of about ``TURN`` bytes and, for each of their rows, what was found: item id, distance, end."""

    def found(some: list[pa.RecordBatch]) -> list[list[tuple]]:
        texts = [normal(str(t or "")) for b in some for t in b.column(at).to_pylist()]
        out: list[list[tuple]] = [[] for _ in texts]
        for block in held:
            ids, items = block.value
            own = matcher(items, rate)
            for i, t in enumerate(texts):
                if not (first and out[i]):
                    out[i] += [(ids[x], d, end) for x, d, end in own.find(t, first)]
            if len(held) > BLOCKS_KEPT:
                block.__dict__.pop("_value", None)  # it is read again from the executor's disk
        return out

    some: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            some.append(batch)
            size += batch.nbytes
        if size >= (TURN if len(held) > BLOCKS_KEPT else 1):
            yield some, found(some)
            some, size = [], 0
    if some:
        yield some, found(some)


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each text and item that match: ``id_col``, ``item_id``, ``distance``, ``match_end``.

    ``match_end`` counts characters of the normalised text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = rows.schema["id"].dataType.simpleString(), items.schema[item_id].dataType
    held = [spark.sparkContext.broadcast(x) for x in blocks(items, item_id, item_text)]  # about BLOCK characters each
    kind = to_arrow_type(kinds[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, found in in_turns(batches, 1, held, rate, first=False):
            hits = [(k, *x) for k, own in enumerate(found) for x in own]
            ids = pa.concat_arrays([b.column(0) for b in some])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([h[0] for h in hits], pa.int64())), pa.array([h[1] for h in hits], kind), pa.array([h[2] for h in hits], pa.int32()), pa.array([h[3] for h in hits], pa.int64())], ["id", "item", "distance", "match_end"])

    common.small_batches(spark)
    out = rows.mapInArrow(run, f"id {kinds[0]}, item {kinds[1].simpleString()}, distance int, match_end bigint")
    return out.withColumnsRenamed({"id": id_col, "item": item_id})


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows in which no item is found, with all their columns, whatever their names."""
    at = docs.columns.index(text_col)
    held = [docs.sparkSession.sparkContext.broadcast(x) for x in blocks(items, item_id, item_text)]  # about BLOCK characters each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, found in in_turns(batches, at, held, rate, first=True):
            start = 0
            for b in some:
                yield b.filter(pa.array([not x for x in found[start : start + b.num_rows]], pa.bool_()))
                start += b.num_rows

    common.small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
