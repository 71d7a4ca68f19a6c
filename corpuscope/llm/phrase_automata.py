"""Substring dedup by repeated-phrase automata.

Within a shard, passages of the window's length that recur are confirmed by
their counts, compiled into an Aho-Corasick automaton over the words' numbers,
and the stretches of all documents that come to the shard are streamed through
it; each hit is an occurrence, whichever document holds it.

How stretches come to shards, and the cases of nulls, empty, long and repeated
texts, ties and empty tables, are in ``repeats``.
"""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from . import repeats

LENGTH, GRAM = 35, 8


def confirmed(texts: list[tuple[int, ...]], weights: list[int], length: int) -> set[tuple[int, ...]]:
    """The passages of ``length`` words that start at two places or more."""
    count: dict[tuple[int, ...], int] = defaultdict(int)
    for t, w in zip(texts, weights, strict=True):
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] += w
    return {p for p, n in count.items() if n > 1}


def compiled(passages: set[tuple[int, ...]]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for p in passages:
        automaton.add_word(p)
    automaton.make_automaton()
    return automaton


def recurring_windows(parts: list[bytes], weights: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each stretch the runs of its windows that occur twice or more in all, by weight."""
    number: dict[bytes, int] = {}
    texts = [tuple(number.setdefault(w, len(number)) for w in p.split(b" ")) for p in parts]
    passages = confirmed(texts, weights, length)
    if not passages:
        return [[] for _ in parts]
    automaton = compiled(passages)
    out = []
    for t in texts:
        hit = np.zeros(max(0, len(t) - length + 1), bool)
        for end, _ in automaton.iter(t):
            hit[end - length + 1] = True
        out.append(repeats.runs_of(hit))
    return out


def remove(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Cuts every word covered by a ``length``-word window that also starts elsewhere."""
    gram = min(GRAM, max(1, length // 4))
    return repeats.remove(docs, repeats.Unit(True, length, gram), lambda parts, weights: recurring_windows(parts, weights, length), id_col, text_col, keep_text).withColumnRenamed("n_units", "n_words")
