"""Quality rules with a line-labelling model.

Fixed rules count words, symbols, repeated lines and repeated three-word
windows of the whole text.  A linear-chain conditional random field over the
text's lines then marks each line as content or boilerplate (Viterbi decoding);
the share of words in content lines decides whether the text stays.

A label says of a text as a whole whether it is good, not which of its lines
are.  The lines' labels are hidden, and training is by proportions: of a good
text at least ``SHARE`` of the words should stand in content lines, of a bad one
at most 1 - ``SHARE``.  Each step takes the distribution over labels nearest to
the field's own that meets this, and moves the field towards it, transitions
between labels included.  The sample is of whole texts: at most ``SAMPLE``, of at
most ``TEXT_LINES`` lines each; scoring reads every line of every text.

Nulls and empty texts have no words, fail the rules and are not kept.  Without
labelled texts of both kinds the model has no say: a text is kept unless the
rules reject it.  Repeated rows and null ids give a row each; rows without a
label, or with a null one, are not fitted on; an empty table gives an empty
table.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled texts to fit on at most, and how many lines such a text may have.
SAMPLE, TEXT_LINES = 3000, 2000
#: Share of a good text's words that are content at least in training.
SHARE = 0.8
EPOCHS, RATE, L2 = 80, 0.3, 1e-3
#: A text whose words are content in such a share stays.
CONTENT_SHARE = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

SYMBOLS = "#*$%&|<>"
STOP_WORDS = frozenset(
    "the of and to in a is that for it was on are as with by this be at from or an not have "
    "der die und das den von zu mit im für ist auf nicht ein eine als auch es an werden aus er "
    "de la le les et des en un une du que est pour qui dans par plus pas au sur ne se "
    "el los y del las por con para su al lo como más pero".split()
)
WORD = re.compile(r"[^\W\d_]+")

#: Cut points of the line features; a feature is on for the interval that its value falls in.
CUTS = {
    "symbols": (0.005, 0.03, 0.08, 0.2),
    "upper": (0.05, 0.2, 0.5, 0.8),
    "digits": (0.01, 0.05, 0.15, 0.4),
    "stop": (0.03, 0.1, 0.2, 0.35),
    "length": (2, 5, 10, 20, 50),
    "word_size": (2.5, 4, 6, 8, 12),
    "shout": (0.01, 0.05, 0.2),
    "distinct": (0.3, 0.5, 0.7, 0.9),
    "seen": (0.5,),
    "ends": (0.5,),
    "bar": (0.5,),
    "link": (0.5,),
}
OFFSETS = np.cumsum([0] + [len(c) + 1 for c in CUTS.values()])
WIDTH = int(OFFSETS[-1])
EDGES = [np.array(c, float) for c in CUTS.values()]


def line_values(line: str, seen: bool) -> tuple[float, ...]:
    n = len(line)
    words = WORD.findall(line)
    letters = sum(map(len, words))
    low = [w.lower() for w in words]
    m = len(words)
    return (
        sum(map(line.count, SYMBOLS)) / n,
        sum(map(str.isupper, line)) / max(1, letters),
        sum(map(str.isdigit, line)) / n,
        sum(map(STOP_WORDS.__contains__, low)) / max(1, m),
        m,
        letters / max(1, m),
        (line.count("!") + line.count("?")) / n,
        len(set(low)) / max(1, m),
        float(seen),
        float(line.rstrip(common.SPACES)[-1:] in ".!?…:;\"'"),
        float("|" in line or "\t" in line),
        float("http" in line or "www." in line or "@" in line),
    )


def features(lines: list[str]) -> np.ndarray:
    """One row a line: the index of the feature that is on, for each kind."""
    seen: set[str] = set()
    rows = []
    for x in lines:
        rows.append(line_values(x, x in seen))
        seen.add(x)
    values = np.array(rows, float).reshape(len(lines), len(CUTS))
    return np.stack([np.searchsorted(e, values[:, k], side="right") + OFFSETS[k] for k, e in enumerate(EDGES)], axis=1)


def lines_of(text: str) -> list[str]:
    """The lines with a word."""
    return [x for x in text.split("\n") if x.strip(common.SPACES)]


class Field:
    """A linear-chain conditional random field of two labels: 0 boilerplate, 1 content."""

    def __init__(self) -> None:
        self.emit = np.zeros((WIDTH, 2))
        self.move = np.zeros((2, 2))

    def scores(self, on: np.ndarray) -> np.ndarray:
        return self.emit[on].sum(axis=1)

    def marginals(self, s: np.ndarray, steps: list[np.ndarray], text: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each line's label, and the expected number of each move, by ``weight`` of its text.

        ``steps`` holds the lines that are first in their text, then the second
        ones and so on, texts in the same order; ``text`` is each line's text.
        """
        fore, back = s.copy(), np.zeros_like(s)
        for before, at in zip(steps, steps[1:]):
            f = fore[before[: len(at)]]
            fore[at] += np.logaddexp(f[:, :1] + self.move[0], f[:, 1:] + self.move[1])
        for before, at in zip(reversed(steps[:-1]), reversed(steps[1:])):
            y = s[at] + back[at]
            back[before[: len(at)]] = np.logaddexp(y[:, :1] + self.move[:, 0], y[:, 1:] + self.move[:, 1])
        z = np.logaddexp(*(fore[steps[0]] + back[steps[0]]).T)
        p = np.exp(fore + back - z[text][:, None])
        if len(steps) < 2:
            return p, np.zeros((2, 2))
        one, two = np.concatenate([b[: len(a)] for b, a in zip(steps, steps[1:])]), np.concatenate(steps[1:])
        pair = np.exp(fore[one][:, :, None] + self.move + (s[two] + back[two])[:, None, :] - z[text[one]][:, None, None])
        return p, np.einsum("n,nij->ij", weight[text[one]], pair)

    def fit(self, texts: list[tuple[np.ndarray, np.ndarray, int]]) -> "Field":
        """From texts as features and words of each line, and the text's label."""
        texts = sorted(texts, key=lambda x: -len(x[0]))
        sizes = np.array([len(x[0]) for x in texts])
        starts = np.cumsum(sizes) - sizes
        steps = [starts[: np.count_nonzero(sizes > k)] + k for k in range(sizes[0])]
        text = np.repeat(np.arange(len(texts)), sizes)
        on, words = np.concatenate([x[0] for x in texts]), np.concatenate([x[1] for x in texts]).astype(float)
        share = words / np.add.reduceat(words, starts)[text]
        pull = share * sizes[text]
        good = np.array([x[2] for x in texts]) == 1
        weight = 1 / sizes / len(texts)
        force = np.zeros(len(texts))
        g_emit, g_move = np.full_like(self.emit, 1e-8), np.full_like(self.move, 1e-8)
        for _ in range(EPOCHS):
            s = self.scores(on)
            p, pair = self.marginals(s, steps, text, weight)
            held = s.copy()
            held[:, 1] += force[text] * pull
            q, moved = self.marginals(held, steps, text, weight)
            got = np.add.reduceat(share * q[:, 1], starts)
            force += 4 * (np.where(good, SHARE, 1 - SHARE) - got)
            force = np.where(good, np.clip(force, 0, 20), np.clip(force, -20, 0))
            d = (q - p) * weight[text][:, None]
            d_emit = np.stack([np.bincount(on.ravel(), np.repeat(d[:, y], on.shape[1]), WIDTH) for y in (0, 1)], axis=1) - L2 * self.emit / len(texts)
            d_move = moved - pair - L2 * self.move / len(texts)
            g_emit += d_emit**2
            g_move += d_move**2
            self.emit += RATE * d_emit / np.sqrt(g_emit)
            self.move += RATE * d_move / np.sqrt(g_move)
        return self

    def decode(self, on: np.ndarray) -> list[int]:
        """The likeliest labels (Viterbi); ties go to content."""
        s = self.scores(on).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = s[0]
        back = []
        for x, y in s[1:]:
            from0 = b + m10 < a + m00
            from1 = b + m11 < a + m01
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = x + (a + m00 if from0 else b + m10), y + (a + m01 if from1 else b + m11)
        at = 1 if b >= a else 0
        out = [at]
        for step in reversed(back):
            at = step[at]
            out.append(at)
        return out[::-1]


def content_share(field: Field | None, text: str) -> float:
    """Share of the words that stand in content lines; 1 without a model, 0 without words."""
    lines = lines_of(text)
    if not lines:
        return 0.0
    if field is None:
        return 1.0
    words = [len(x.encode().split()) for x in lines]
    return sum(n for n, y in zip(words, field.decode(features(lines)), strict=True) if y) / sum(words)


def rules(text: str) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, and words in repeated three-word windows."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, common.SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = lines_of(text) if "\n" in text else []
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        end = 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field | None:
    """A field from at most ``SAMPLE`` labelled texts, those with the smallest hash of their id."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    ids = marked.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    if len({r["label"] for r in ids}) < 2:
        return None
    spark = docs.sparkSession
    sample = spark.createDataFrame([(r["id"], r["label"]) for r in ids], f"id {marked.schema['id'].dataType.simpleString()}, label int")  # at most SAMPLE rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        split = [lines_of(t) for t in common.texts_of(batch)]
        rows = [(i, x) for i, x in enumerate(split) if 0 < len(x) <= TEXT_LINES]
        on = [features(x).astype(np.uint8).tobytes() for _, x in rows]
        words = [np.array([len(y.encode().split()) for y in x], "<i4").tobytes() for _, x in rows]
        return pa.RecordBatch.from_arrays([batch.column(c).take(pa.array([i for i, _ in rows], pa.int32())) for c in ("id", "label")] + [pa.array(on, pa.binary()), pa.array(words, pa.binary())], ["id", "label", "on", "words"])

    found = common.map_batches(texts.join(F.broadcast(sample), "id").select("id", "text", "label"), run, f"id {marked.schema['id'].dataType.simpleString()}, label int, on binary, words binary")
    one = found.groupBy("id").agg(F.min_by(F.struct("label", "on", "words"), F.xxhash64("on", "words")).alias("x")).orderBy("id").collect()  # a repeated id counts once
    rows = [(np.frombuffer(r["x"]["on"], np.uint8).reshape(-1, len(CUTS)).astype(np.int64), np.frombuffer(r["x"]["words"], "<i4"), r["x"]["label"]) for r in one]
    return Field().fit(rows) if len({y for *_, y in rows}) == 2 else None


def measure(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the rules count, the content share and the verdict for each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = common.texts_of(batch)
        counts = [rules(t) for t in texts]
        failed = [base_failed(c) for c in counts]
        share = [content_share(field, t) for t in texts]
        kept = [not f and s >= CONTENT_SHARE for f, s in zip(failed, share, strict=True)]
        out = [batch.column("id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(5)), pa.array(failed), pa.array(kept), pa.array(share)]
        return pa.RecordBatch.from_arrays(out, ["id", *names, "base_failed", "kept", "content_share"])

    kind = rows.schema["id"].dataType.simpleString()
    return common.map_batches(rows, run, f"id {kind}, {', '.join(f'{n} bigint' for n in names)}, base_failed boolean, kept boolean, content_share double").withColumnRenamed("id", id_col)


def base_failed(counts: tuple[int, ...]) -> bool:
    return counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]


def keep_good(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, whatever their names."""
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [str(t or "") for t in batch.column(at).to_pylist()]
        kept = [not base_failed(rules(t)) and content_share(field, t) >= CONTENT_SHARE for t in texts]
        return batch.filter(pc.fill_null(pa.array(kept, pa.bool_()), False))

    return common.map_batches(docs, run, docs.schema)
