"""Text edits: conflicts and application.

An edit is ``file_id``, ``issue`` (its batch), ``start``, ``stop`` (bytes of the
original text), ``new_text`` and ``safety`` (0 safe, 1 potentially unsafe, 2
unsafe).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlapping(edits: DataFrame) -> DataFrame:
    """Whether each edit overlaps one that starts before it in its file, or at the same place.

    An empty edit conflicts only strictly inside another.  A running largest
    end stands for a join of the edits with themselves.
    """
    before = "OVER (PARTITION BY file_id ORDER BY start, stop, issue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    reach = F.expr(f"max(stop) {before}")
    return edits.withColumn("overlaps", F.coalesce(reach > F.col("start"), F.lit(False)))


def apply_edits(contents: bytes, batches: list[list[tuple[int, int, bytes, int]]], most: int = 0) -> tuple[bytes, list[str]]:
    """Applies whole batches in order; the state of each: applied, unsafe, overlap or out_of_bounds."""
    taken: list[tuple[int, int, bytes]] = []
    states = []
    for batch in batches:
        new = sorted((a, b, t) for a, b, t, _ in batch)
        if any(s > most for *_, s in batch):
            states.append("unsafe")
        elif any(not 0 <= a <= b <= len(contents) for a, b, _ in new):
            states.append("out_of_bounds")
        elif any(clash(x, y) for i, x in enumerate(new) for y in taken + new[:i]):
            states.append("overlap")
        else:
            taken += new
            states.append("applied")
    out, at = [], 0
    for a, b, t in sorted(taken, key=lambda e: (e[0], e[1])):
        out += [contents[at:a], t]
        at = b
    return b"".join([*out, contents[at:]]), states


def clash(x: tuple[int, int, bytes], y: tuple[int, int, bytes]) -> bool:
    (a, b), (c, d) = x[:2], y[:2]
    if a == b and c == d:
        return False
    if a == b:
        return c < a < d
    if c == d:
        return a < c < b
    return a < d and c < b


def fixed(files: DataFrame, edits: DataFrame, most: int = 0) -> DataFrame:
    """``file_id``, new ``contents`` and how many batches were ``applied`` of each file that has edits.

    A file's edits are bounded by the file, so a group is one file.
    """
    light = edits.select("file_id", "issue", "start", "stop", F.col("new_text").cast("binary").alias("new_text"), "safety")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"file_id": [], "contents": [], "applied": [], "skipped": []})
        batches = [list(zip(g["start"], g["stop"], g["new_text"], g["safety"], strict=True)) for _, g in right.sort_values(["issue", "start"]).groupby("issue", sort=True)]
        new, states = apply_edits(bytes(left["contents"].iloc[0]), batches, most)
        return pd.DataFrame({"file_id": [key[0]], "contents": [new], "applied": [states.count("applied")], "skipped": [len(states) - states.count("applied")]})

    return files.select("file_id", F.col("contents").cast("binary").alias("contents")).groupBy("file_id").cogroup(light.groupBy("file_id")).applyInPandas(run, "file_id bigint, contents binary, applied int, skipped int")
