"""SimHash near-dedup with a byte-position inverted index.

A text's fingerprint has a bit for each bit that is set in over half the XXH64
values of its shingles.  Two fingerprints of 8 bytes that differ in d bits share
at least 8 - d bytes at the same positions.  The positions go into d + 2 blocks,
so such a pair shares two whole blocks: the index has one posting list for each
two blocks and the bytes there.  The pairs of a list tally the positional bytes
they share, those with the guaranteed 8 - d stay, and these are verified by
their differing bits.  A list of over ``LONG`` fingerprints is split, before it
comes to one task, by the bytes at as many further positions as the minimum
still asks for, in every choice of them, which loses no pair.

The index holds distinct fingerprints only, so copies cost nothing, and a split
list has at most 2 ** (8 * d) of them, whatever the corpus.  A list gives the
links of a spanning forest, not its pairs, and components come from alternating
star steps, each written to the shared folder.

Texts without words, null ones included, have fingerprint 0 and link like any
other.  Null ids take part in groups but never give a group its name; a group
without any id has the null name.  Repeated rows link to each other.  Columns
other than the id and the text are not read by ``components``; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, SEED, BITS = 3, 42, 2
#: Fingerprints of a posting list from which it is split by further positions.
LONG = 1024
#: Rows of a list that are tallied against all of it at once.
ROWS = 256


def shingles(text: str, words: int = WORDS) -> list[bytes]:
    """All ``words``-word shingles, A-Z in lower case; the whole sequence if there are fewer words."""
    w = text.encode().lower().split()
    if len(w) < words:
        return [b" ".join(w)] if w else []
    j = b" ".join(w)
    ends = [e + i for i, e in enumerate(accumulate(map(len, w)))]
    starts = [0, *(e + 1 for e in ends[: -words])]
    return [j[a:b] for a, b in zip(starts, ends[words - 1 :], strict=True)]


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    parts = shingles(text, words)
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, seed) for s in parts], "<u8").view(np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(h[a : a + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for a in range(0, len(h), 65536))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``id`` and ``fp``, the fingerprint as a signed number, of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, words) for t in common.texts_of(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp, pa.int64())], ["id", "fp"])

    return common.map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def tally(some: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Shared positional bytes of each of ``some`` with each of ``fps``."""
    a, b = some.view(np.uint8).reshape(-1, 8), fps.view(np.uint8).reshape(-1, 8)
    out = np.zeros((len(a), len(b)), np.uint8)
    for k in range(8):
        out += a[:, k, None] == b[None, :, k]
    return out


def list_links(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest, as (member, least member), of the links within one posting list."""
    fps = np.unique(fps)
    label = np.arange(len(fps))
    for a in range(0, len(fps), ROWS):
        some = fps[a : a + ROWS]
        i, k = np.nonzero(tally(some, fps[a:]) >= 8 - bits)
        near = (np.bitwise_count(some[i] ^ fps[a + k]) <= bits) & (k > i)
        i, k = label[a + i[near]], label[a + k[near]]
        pairs = np.unique(np.stack([np.minimum(i, k), np.maximum(i, k)], axis=1)[i != k], axis=0).tolist()
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                parent[x] = x = parent.get(y, y)
            return x

        for x, y in pairs:
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if parent:
            step = np.arange(len(fps))
            for x in list(parent):
                step[x] = root(x)
            label = step[label]
    return [(int(f), int(fps[r])) for f, r in zip(fps[label != np.arange(len(fps))], label[label != np.arange(len(fps))], strict=True)]


def masked(fp: Column, positions: tuple[int, ...]) -> Column:
    """The bytes of ``fp`` at ``positions``."""
    return fp.bitwiseAND(F.lit(int(np.uint64(sum(0xFF << 8 * i for i in positions)).view(np.int64))))


def postings(fps: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """The index: list (``c``, ``k``) and ``fp``, long lists split; and the stored table that it is made from."""
    edges = [8 * i // (bits + 2) for i in range(bits + 3)]
    blocks = [tuple(range(a, b)) for a, b in zip(edges, edges[1:])]
    lists = [a + b for a, b in combinations(blocks, 2)]
    fp = F.col("fp")
    index = fps.select("fp").distinct().select("fp", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), masked(fp, p).alias("k")) for c, p in enumerate(lists)))).alias("x")).select("x.c", "x.k", "fp")
    index = common.stored(index, "postings")
    long = index.groupBy("c", "k").count().where(F.col("count") > LONG).select("c", "k", F.lit(True).alias("long"))
    sized = index.join(long, ["c", "k"], "left")
    split = F.lit(None).cast("array<struct<c:int,k:bigint>>")
    number = len(lists)
    for c, p in enumerate(lists):
        rest = [i for i in range(8) if i not in p]
        more = list(combinations(rest, max(0, 8 - bits - len(p))))
        split = F.when(F.col("c") == c, F.array(*(F.struct(F.lit(number + i).alias("c"), masked(fp, p + q).alias("k")) for i, q in enumerate(more)))).otherwise(split)
        number += len(more)
    own = F.array(F.struct(F.col("c"), F.col("k")))
    return sized.select("fp", F.explode(F.when(F.col("long"), split).otherwise(own)).alias("x")).select("x.c", "x.k", "fp"), index


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (``u``, ``v``) that connect all distinct ``fp`` within ``bits`` of each other."""
    if not 0 < bits < 7:
        raise ValueError("1 to 6 differing bits")
    made, source = postings(fps, bits)
    index = made.repartition("c", "k").sortWithinPartitions("c", "k", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def found(c: np.ndarray, k: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            edges = np.flatnonzero((c[1:] != c[:-1]) | (k[1:] != k[:-1])) + 1
            starts = np.concatenate([[0], edges])
            ends = np.concatenate([edges, [len(c)]])
            out = [x for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True) for x in list_links(fp[a:b].view(np.uint64), bits)]
            if out:
                u, v = np.array(out, np.uint64).view(np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            c, k, fp = (np.concatenate([r, x.to_numpy(zero_copy_only=False)]) for r, x in zip(rest, batch.columns, strict=True))
            if not len(c):
                continue
            same = np.flatnonzero((c != c[-1]) | (k != k[-1]))
            cut = same[-1] + 1 if len(same) else 0  # the last list may go on in the next batch
            if cut:
                yield from found(c[:cut], k[:cut], fp[:cut])
            rest = [c[cut:], k[cut:], fp[cut:]]
        if len(rest[0]):
            yield from found(*rest)

    common.small_batches(fps.sparkSession)
    out = common.stored(index.mapInArrow(run, "u bigint, v bigint").distinct(), "links")
    common.discard(source)
    return out


def stars(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (``u``, ``v``): ``node`` and ``root``, its least one, for each node with an edge.

    Alternates large-star and small-star steps until they change nothing.  Ids
    compare as signed numbers.
    """
    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    now = common.stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.stored(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        old, now = now, common.stored(small, "stars")
        common.discard(old, large)
        before, seen = seen, mark(now)
        if before == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def groups(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """``fp``, ``root`` and ``component_id``, the least id of its component, of each fingerprint that has a link or several rows."""
    one = common.stored(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "prints")
    found = links(one, bits)
    stable = stars(found)
    roots = common.stored(stable, "roots")
    common.discard(found)
    own = one.join(roots, one["fp"] == roots["node"], "left").where("n > 1 or root is not null").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = own.groupBy("root").agg(F.min("least").alias("component_id"))
    out = common.stored(own.select("fp", "root").join(names, "root"), "groups")
    common.discard(one, roots)
    return out


def components(docs: DataFrame, bits: int = BITS, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` of each row."""
    fps = common.stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    named = groups(fps, bits).select("fp", "component_id", F.lit(True).alias("grouped"))
    out = fps.join(named, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, bits: int = BITS, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all rows of each group but that with the least id (the first of equal ids); all columns stay."""
    key = common.free_name(docs, "row_key")
    rows = common.with_key(docs, key)
    fps = common.stored(fingerprints(rows.select(F.struct(F.col(key).alias("k"), F.col(f"`{id_col}`").alias("i")).alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text", words).select("id.k", F.col("id.i").alias("id"), "fp"), "fingerprints")
    found = groups(fps.select("id", "fp"), bits)
    members = common.stored(fps.join(found.select("fp", "root"), "fp").select("k", "id", "root"), "members")
    common.discard(fps, found)
    stay = members.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "k")).alias("x")).select("x.k")
    gone = members.select("k").join(stay, "k", "left_anti").select(F.col("k").alias(key))
    return rows.join(gone, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
