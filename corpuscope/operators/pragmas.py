"""Suppression comments and the issues that they take away.

A comment ``@<tool>-ignore category:code,code(N) reason`` lets N issues of each
code go (one where no number stands, any number with ``all``), ``-expect`` wants
them.  A comment on a line of its own covers the lines below it, one behind code
its own line.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = re.compile(r"([A-Za-z][\w-]*):([\w-]+(?:\s*,\s*[\w-]+)*)(?:\((\d+)\))?|\ball\b")


@dataclass
class Pragma:
    kind: str
    category: str
    code: str
    line: int
    own_line: bool
    expected: int
    counted: bool
    matches: int = 0


def parse(text: str, tool: str, categories: tuple[str, ...]) -> list[Pragma]:
    """All pragmas of a text, in order, a line each."""
    start = re.compile(rf"(?P<lead>.*?)(?P<open>//|\#|/\*\*?|^\s*\*)\s*@{re.escape(tool)}-(?P<kind>ignore|expect)\s+(?P<rest>.*)$")
    out = []
    for n, line in enumerate(text.split("\n")):
        m = start.match(line)
        if not m:
            continue
        e = ENTRY.match(m["rest"].strip())
        if not e:
            continue
        own = not m["lead"].strip()
        if e[0] == "all":
            out.append(Pragma(m["kind"], "*", "all", n, own, 0, False))
        elif e[1] in categories and (e[3] is None or int(e[3]) >= 1):
            out += [Pragma(m["kind"], e[1], c.strip(), n, own, int(e[3] or 1), e[3] is not None) for c in e[2].split(",")]
    return out


def reconcile(pragmas: list[Pragma], issues: list[tuple[str, str, int]]) -> tuple[list[bool], list[Pragma]]:
    """Which issues (category, code, line) are taken away, in their order, and the pragmas that have had no use."""
    gone = []
    for category, code, line in issues:
        best = None
        for kind in ("ignore", "expect"):
            fits = [
                (not p.own_line, p.line, -i, p)
                for i, p in enumerate(pragmas)
                if p.kind == kind and (p.code == "all" or p.category == category and p.code == code and p.matches < p.expected) and (p.line < line if p.own_line else p.line == line)
            ]
            if fits:
                best = max(fits, key=lambda f: f[:3])[3]
                break
        if best:
            best.matches += 1
        gone.append(best is not None)
    return gone, [p for p in pragmas if not p.matches]


def suppress(files: DataFrame, issues: DataFrame, tool: str, categories: tuple[str, ...]) -> DataFrame:
    """Issues (``file_id``, ``category``, ``code``, ``line``, ``ordinal``) that stay, and one for each pragma without use.

    Matching depends on order within a file; a group is one file.
    """
    shape = "file_id bigint, category string, code string, line int, ordinal bigint"

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = parse(left["text"].iloc[0] or "", tool, categories) if len(left) else []
        right = right.sort_values("ordinal")
        gone, rest = reconcile(own, list(zip(right["category"], right["code"], right["line"], strict=True)))
        kept = right[[not g for g in gone]][["category", "code", "line", "ordinal"]]
        more = pd.DataFrame([("pragma", "unused-pragma" if p.kind == "ignore" else "unfulfilled-expect", p.line, -1) for p in rest], columns=["category", "code", "line", "ordinal"])
        out = pd.concat([kept, more]) if len(more) and len(kept) else (more if len(more) else kept)
        out = out.assign(file_id=key[0])
        return out[["file_id", "category", "code", "line", "ordinal"]]

    texts = files.select("file_id", F.col("text").cast("string").alias("text"))
    return texts.groupBy("file_id").cogroup(issues.select("file_id", "category", "code", F.col("line").cast("int"), F.col("ordinal").cast("long")).groupBy("file_id")).applyInPandas(run, shape)
