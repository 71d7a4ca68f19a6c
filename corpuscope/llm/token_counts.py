"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is split at safe boundaries: single spaces and line feeds between two
characters that are not white space.  The byte-level pre-tokenizer starts a new
pre-token at each of these whatever stands around them, and no special token
holds one, so the counts of the parts add up to the count of the whole text.  Parts recur
from text to text; each Python worker encodes every part once, in batches
balanced by bytes, and keeps its count while the bounded cache has room.
SentencePiece models and other libraries get whole texts.

Nulls count as the empty text: 0 bytes and 0 tokens.  Repeated rows and null
ids give a row each.  Columns other than the id and the text are not read.  An
empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of parts, with what the interpreter holds for each, that a worker keeps counts of; beyond it starts anew.
CACHE_BYTES = 96 << 20
#: Longer parts are not kept from batch to batch.
LONGEST = 64
#: Bytes that go to the tokenizer in one call.
CALL_BYTES = 1 << 19
#: A part that is not cut off from its neighbours by safe boundaries.
OPEN = -(1 << 50)
#: A comma or a full stop between a letter and a space or line end is a pre-token, and here a token, of its own.
STOP = re.compile(r"(?<=[A-Za-z])[.,](?=[ \n])")


def by_bytes(parts: Iterable[str], limit: int = CALL_BYTES) -> Iterable[list[str]]:
    """Lists of parts of about ``limit`` bytes of UTF-8 each; a longer part comes alone."""
    return by_order(sorted(parts, key=len), limit)


def by_order(parts: Iterable[str], limit: int = CALL_BYTES) -> Iterable[list[str]]:
    out: list[str] = []
    held = 0
    for p in parts:
        size = 16 + (len(p) if p.isascii() else len(p.encode()))
        if out and held + size > limit:
            yield out
            out, held = [], 0
        out.append(p)
        held += size
    if out:
        yield out


class Counter:
    """Counts tokens; what it keeps is bounded by ``CACHE_BYTES`` and a batch."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pre = self.tokenizer.pre_tokenizer
        self.splits = type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and self.tokenizer.normalizer is None
        self.splits = self.splits and all(len(self.tokenizer.encode(x, add_special_tokens=False)) == 1 for x in ".,\n") and not any(re.search(r"[\s.,]", t.content) or t.lstrip or t.rstrip or t.single_word for t in self.tokenizer.get_added_tokens_decoder().values())
        self.after_space: dict[str, int] = {}
        self.other: dict[str, int] = {}
        self.held = 0

    def encode(self, parts: Iterable[str], lead: str, to: dict[str, int]) -> None:
        for some in by_bytes(parts):
            for p, e in zip(some, self.tokenizer.encode_batch_fast([lead + p for p in some], add_special_tokens=False), strict=True):
                to[p] = len(e)

    def whole_parts(self, text: str) -> list[str]:
        """Joins what no safe boundary separates; each but the first starts with its space."""
        split = text.split(" ")
        out, open_ = [], [split[0]]
        for before, after in zip(split, split[1:]):
            if before and after and not before[-1].isspace() and not after[0].isspace():
                out.append(" ".join(open_))
                open_ = ["", after]
            else:
                open_.append(after)
        return [*out, " ".join(open_)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [len(e) for some in by_order(texts) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        if self.held > CACHE_BYTES:
            self.after_space, self.other, self.held = {}, {}, 0
        cut = []  # heads of lines, what follows a space, tokens that were taken out
        for t in texts:
            t, marks = STOP.subn("", t)
            lines = [x.split(" ") for x in t.split("\n")]
            cut.append(([x[0] for x in lines], [p for x in lines for p in x[1:]], marks + len(lines) - 1))
        long: set[str] = set()
        for k, lead, to in ((0, "", self.other), (1, " ", self.after_space)):
            new: set[str] = set()
            for c in cut:
                new.update(c[k])
            new = new.difference(to)
            self.held += sum(map(len, new)) + 140 * len(new)
            long.update(p for p in new if len(p) > LONGEST)
            unsafe = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
            to.update(dict.fromkeys(unsafe, OPEN))
            self.encode(new - unsafe, lead, to)
        other, after = self.other.__getitem__, self.after_space.__getitem__
        sums = [sum(map(other, heads)) + sum(map(after, tails)) + n for heads, tails, n in cut]
        for to in (self.other, self.after_space):
            for p in [p for p in long if p in to]:
                del to[p]
        slow = [i for i, n in enumerate(sums) if n < 0]
        for i in slow:
            parts = self.whole_parts(texts[i]) if texts[i] else []
            got: dict[str, int] = {}
            self.encode(set(parts), "", got)
            sums[i] = sum(map(got.__getitem__, parts))
        return sums


class Pieces:
    """Counts of a SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for some in by_order(texts) for ids in self.model.encode(some, num_threads=1)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter | Pieces:
    return Pieces(path) if path.endswith(".model") else Counter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (of UTF-8) and ``n_tokens`` of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = common.texts_of(batch)
        n_bytes = [len(t.encode()) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(counter(path).counts(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    return common.map_batches(rows, run, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)
