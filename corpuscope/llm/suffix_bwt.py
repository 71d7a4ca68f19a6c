"""Suffix-array dedup by threshold-bounded interval expansion.

Within a shard the stretches' Burrows-Wheeler transform is taken, and the
intervals of its suffix array are extended backwards breadth first.  Level by
level this settles every common-prefix length between neighbours in increasing
order; at the minimum length it stops.  What is not settled by then shares at
least that many bytes: these classes are the recurring windows.

How stretches come to shards, and the cases of nulls, empty, long and repeated
texts, ties and empty tables, are in ``repeats``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import repeats

LENGTH, GRAM = 200, 48
#: Symbols that the first sort compares, of 9 bits each.
PACKED = 7


def suffix_array(codes: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and ranks of all suffixes.

    ``codes``: a byte plus one, or 0 at the end of a stretch; all ends differ,
    an earlier one is less.  ``rest``: how far the end is.
    """
    n = len(codes)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([codes.astype(np.int64), np.zeros(PACKED, np.int64)])
    for j in range(PACKED):
        key = (key << 9) | np.where(rest >= j, padded[j : j + n], 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.ones(n, bool)
    head[1:] = (key[1:] != key[:-1]) | (rest[order[1:]] < PACKED)
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    tied = ~head
    tied[:-1] |= ~head[1:]
    active = np.flatnonzero(tied)
    depth = PACKED
    while len(active):
        at = order[active]
        key = (rank[at] << 32) | rank[at + depth]
        o = np.argsort(key, kind="stable")
        key, at = key[o], at[o]
        order[active] = at
        head = np.ones(len(active), bool)
        head[1:] = key[1:] != key[:-1]
        rank[at] = active[np.maximum.accumulate(np.where(head, np.arange(len(active)), 0))]
        tied = ~head
        tied[:-1] |= ~head[1:]
        active = active[tied]
        depth *= 2
    return order, rank


def settled_below(order: np.ndarray, rank: np.ndarray, codes: np.ndarray, limit: int) -> np.ndarray:
    """Whether each suffix shares fewer than ``limit`` symbols with the one before it.

    Backward extension: the suffixes that start with a symbol before those of an
    interval are an interval too, and where such an interval ends for the first
    time, at level l, the common prefix of its neighbours is l.
    """
    n = len(order)
    before = order - 1  # a suffix that starts the text follows its last end
    before[before < 0] = n - 1
    lf = rank[before]
    symbol = codes[before].astype(np.int64)
    symbol[symbol == 0] = -1 - lf[symbol == 0]  # ends differ
    by = np.empty(n, np.int64)
    by[lf] = np.arange(n)
    same = symbol[by[1:]] == symbol[by[:-1]]
    earlier, later = np.full(n, -1), np.full(n, n)
    earlier[by[1:][same]] = by[:-1][same]
    later[by[:-1][same]] = by[1:][same]
    settled = np.zeros(n + 1, bool)
    lo, hi = np.array([0]), np.array([n])
    for _ in range(limit):
        size = hi - lo
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(lo - (ends - size), size)
        first = earlier[at] < np.repeat(lo, size)
        last = later[at] >= np.repeat(hi, size)
        new_lo, new_hi = np.sort(lf[at[first]]), np.sort(lf[at[last]]) + 1
        new = ~settled[new_hi]
        lo, hi = new_lo[new], new_hi[new]
        settled[hi] = True
        if not len(lo):
            break
    settled[0] = True
    return settled[:n]


def recurring_windows(parts: list[bytes], weights: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each stretch the runs of its windows that occur twice or more in all, by weight."""
    if not parts:
        return []
    lengths = np.array([len(p) for p in parts])
    ends = np.cumsum(lengths + 1) - 1
    codes = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int16) + 1
    codes[ends] = 0
    owner = np.repeat(np.arange(len(parts)), lengths + 1)
    rest = ends[owner] - np.arange(len(codes))
    order, rank = suffix_array(codes, rest)
    kind = np.cumsum(settled_below(order, rank, codes, length)) - 1
    weight = np.bincount(kind, weights=np.array(weights)[owner[order]])
    again = np.empty(len(codes), bool)
    again[order] = weight[kind] > 1
    again &= rest >= length
    starts = ends - lengths
    return [repeats.runs_of(again[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def remove(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Cuts every byte covered by a ``length``-byte string that also starts elsewhere."""
    gram = min(GRAM, max(1, length // 4))
    return repeats.remove(docs, repeats.Unit(False, length, gram), lambda parts, weights: recurring_windows(parts, weights, length), id_col, text_col, keep_text).withColumnRenamed("n_units", "n_bytes")
