"""Toxicity by a counterfactual-regularised linear classifier.

Texts are hashed sets of lower-case words.  The classifier is
a logistic one with a sparsity penalty, fitted on a bounded sample of labelled
texts.  For every sentence of these that names a group, a copy with the
identity terms swapped for others of their kind is made, and the squared change
of the score between the two is penalised; a group's name alone then cannot
move a text's score.

``SAMPLE`` bounds the labelled texts fitted on; scoring covers every whole text.
Nulls and empty texts get the score of a text without words.  With no labelled
text of either kind all scores are the share of label 1 (0 without labels).
Repeated rows and null ids give a row each; rows with a null label or id are
not fitted on; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE = 16_000
WIDTH = 1 << 18
STEPS, RATE, SPARSITY, RIDGE, PENALTY = 250, 0.5, 1.5e-4, 1e-6, 2.0
#: Features of fewer labelled texts are left out.
LEAST_TEXTS = 3

#: Identity terms by kind; a term is swapped for each other of its kind.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("she", "he"), ("her", "his"), ("female", "male"), ("lesbian", "gay", "straight", "bisexual", "transgender", "queer", "heterosexual", "homosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "african", "latino", "hispanic", "european", "arab", "indigenous"), ("american", "chinese", "mexican", "german", "french", "spanish", "indian", "russian", "japanese", "polish", "turkish"),
    ("old", "young", "elderly", "teenage"), ("blind", "deaf", "disabled", "autistic"), ("immigrants", "refugees", "foreigners", "citizens", "natives"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"),
)
SWAP = {w: kind for kind in IDENTITIES for w in kind}

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"(?<=[.!?\n])\s+")


def slot(token: str) -> int:
    return zlib.crc32(token.encode()) % WIDTH


class Hasher:
    """Slots of words; a byte-bounded cache."""

    def __init__(self) -> None:
        self.kept = common.ByteCache(48 << 20, 64)

    def words(self, words: list[str]) -> set[int]:
        return set(self.kept.look_up(list(set(words)), slot))


HASHER = Hasher()


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def slots(words: list[str]) -> list[int]:
    """The features that are on; each once, however long the text."""
    return sorted(HASHER.words(words))


def swapped(words: list[str]) -> list[list[str]]:
    """Copies of a sentence with every identity term turned into another of its kind."""
    most = max((len(SWAP[w]) for w in words if w in SWAP), default=0)
    return [[SWAP[w][(SWAP[w].index(w) + k) % len(SWAP[w])] if w in SWAP else w for w in words] for k in range(1, most)]


#: Stands between the two sides of a pair; no slot has these bytes.
MARK = b"\xff\xff\xff\xff"


def packed(numbers: list[int]) -> bytes:
    return np.array(numbers, "<i4").tobytes()


def pairs_of(text: str) -> list[tuple[list[int], list[int]]]:
    out = []
    for s in SENTENCE.split(text):
        words = words_of(s)
        if any(map(SWAP.__contains__, words)):
            own = set(slots(words))
            out += [(sorted(own - other), sorted(other - own)) for other in map(set, map(slots, swapped(words)))]
    return out


class Model:
    """Weights of the slots that have one; what it holds is bounded by ``WIDTH``."""

    def __init__(self, bias: float, weights: dict[int, float], constant: float | None = None):
        self.bias, self.weights, self.constant = bias, weights, constant

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        get = self.weights.get
        z = self.bias + sum(get(i, 0.0) for i in slots(words_of(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(rows: list, labels: list[int], pairs: list[tuple[list[int], list[int]]], times: list[int] | None = None) -> Model:
    """Proximal gradient steps on the log loss, the sparsity penalty and the counterfactual penalty.

    ``rows`` and ``pairs`` are lists of slots; ``times`` says how often each pair occurs.
    """
    if not labels or len(set(labels)) < 2:
        return Model(0.0, {}, float(np.mean(labels)) if labels else 0.0)
    y = np.array(labels, float)
    counts = np.bincount(np.concatenate([np.array(r, np.int64) for r in rows]), minlength=WIDTH)
    used = np.flatnonzero(counts >= LEAST_TEXTS)
    place = np.full(WIDTH, -1)
    place[used] = np.arange(len(used))

    def matrix(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(lists)), [len(r) for r in lists])
        col = place[np.concatenate([np.array(r, np.int64) for r in lists])] if len(row) else np.zeros(0, np.int64)
        return row[col >= 0], col[col >= 0]

    r, c = matrix(rows)
    lost, lost_at = matrix([a for a, _ in pairs])
    won, won_at = matrix([b for _, b in pairs])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    # a diagonal step: features that are on in many texts take smaller ones
    mass = np.bincount(c, weights=weight[r], minlength=len(used)) + 1e-4
    often = np.array(times if times is not None else [1] * len(pairs), float)
    w, b, n = np.zeros(len(used)), 0.0, max(1.0, often.sum())
    fast, before = w.copy(), w.copy()
    pair_mass = (np.bincount(lost_at, often[lost], len(used)) + np.bincount(won_at, often[won], len(used))) / n
    step = RATE / (mass * 8 + 2 * PENALTY * pair_mass * 4)
    for k in range(STEPS):
        z = b + np.bincount(r, weights=fast[c], minlength=len(y))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        e = (p - y) * weight
        g = np.bincount(c, weights=e[r], minlength=len(used)) + RIDGE * fast
        if len(pairs):
            change = often * (np.bincount(lost, fast[lost_at], len(pairs)) - np.bincount(won, fast[won_at], len(pairs)))
            g += 2 * PENALTY / n * (np.bincount(lost_at, weights=change[lost], minlength=len(used)) - np.bincount(won_at, weights=change[won], minlength=len(used)))
        b -= 0.5 * e.sum()
        w = fast - step * g
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * SPARSITY)
        fast = w + k / (k + 3) * (w - before)
        before = w.copy()
    kept = np.flatnonzero(w)
    return Model(float(b), dict(zip(used[kept].tolist(), w[kept].tolist(), strict=True)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most ``SAMPLE`` of ``labels``, those with the smallest hash of their id."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    ids = marked.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    if not ids:
        return Model(0.0, {}, 0.0)
    kind = marked.schema["id"].dataType.simpleString()
    sample = docs.sparkSession.createDataFrame([(r["id"], r["label"]) for r in ids], f"id {kind}, label int")  # at most SAMPLE rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = common.texts_of(batch)
        on = pa.array([packed(slots(words_of(t))) for t in texts], pa.binary())
        swaps = pa.array([[packed(a) + MARK + packed(b) for a, b in pairs_of(t)] for t in texts], pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), on, swaps], ["id", "label", "on", "swaps"])

    found = common.map_batches(texts.select("id", "label", "text"), run, f"id {kind}, label int, on binary, swaps array<binary>")
    one = found.groupBy("id").agg(F.min_by(F.struct("label", "on", "swaps"), F.xxhash64("on", "swaps")).alias("x")).select("id", "x.*")  # a repeated id counts once
    one = common.stored(one, "sample")  # at most SAMPLE rows
    pairs = one.select(F.explode("swaps").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).orderBy("pair").collect()
    both = [tuple(np.frombuffer(x, "<i4") for x in r["pair"].split(MARK)) for r in pairs]
    rows = one.orderBy("id").select("on", "label").collect()
    return train([np.frombuffer(r["on"], "<i4") for r in rows], [r["label"] for r in rows], both, [r["n"] for r in pairs])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the ``score``, 0 to 1, of each row's whole text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([model.score(t) for t in common.texts_of(batch)], pa.float64())], ["id", "score"])

    return common.map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
