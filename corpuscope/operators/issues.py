"""The issue table: filters, order, counts.

Columns: ``file_id``, ``code`` (may be null), ``level`` (0 note, 1 help, 2
warning, 3 error), ``message``, ``start`` and ``stop`` (bytes of the primary
span, null without one), ``ordinal``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("note", "help", "warning", "error")
NO_CODE = "<unknown>"


def level_name(c: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), c.cast("int") + 1)


def at_least(issues: DataFrame, level: int) -> DataFrame:
    return issues.where(F.col("level") >= level)


def at_most(issues: DataFrame, level: int) -> DataFrame:
    return issues.where(F.col("level") <= level)


def with_codes(issues: DataFrame, codes: list[str]) -> DataFrame:
    """Issues of these codes; those without a code go."""
    return issues.where(F.col("code").isin(codes))


def fixable(issues: DataFrame) -> DataFrame:
    return issues.where(F.size("edits") > 0)


@dataclass(frozen=True)
class Ignore:
    """Drops issues of a code, of a code under some paths, or whose text matches a pattern."""

    code: str | None = None
    paths: tuple[str, ...] = ()
    text: str | None = None


def compiles(pattern: str) -> bool:
    """Whether the engine that runs ``rlike`` takes the pattern."""
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def ignored(entries: list[Ignore], path: Column, texts: list[Column]) -> Column:
    """Whether some entry drops the issue.  Entries with a pattern that does not compile are passed over."""
    out = F.lit(False)
    for e in entries:
        hit = F.lit(True)
        if e.code is not None:
            hit = hit & (F.coalesce(F.col("code"), F.lit("")) == e.code)
        if e.text is not None:
            if not compiles(e.text):
                continue
            any_text = F.lit(False)
            for t in texts:
                any_text = any_text | F.coalesce(t.rlike(e.text), F.lit(False))
            hit = hit & any_text
        if e.paths:
            under = F.lit(False)
            for p in e.paths:
                under = under | (path == p) | path.startswith(p.rstrip("/") + "/")
            hit = hit & F.coalesce(under, F.lit(False))
        out = out | hit
    return out


def without_ignored(issues: DataFrame, entries: list[Ignore], path: str = "file") -> DataFrame:
    """Issues that no entry drops.  Patterns see the message and, where there are such columns, ``help`` and each of ``notes`` and ``annotations``."""
    texts = [F.col(c) for c in ("message", "help") if c in issues.columns]
    texts += [F.array_join(F.col(c), "\n") for c in ("notes", "annotations") if c in issues.columns]
    return issues.where(~ignored(entries, F.col(path), texts))


def in_order(issues: DataFrame) -> DataFrame:
    """Canonical order: level, code (none first), span (none last)."""
    return issues.orderBy("level", F.col("code").asc_nulls_first(), F.col("start").isNull(), "file_id", "start", "stop", "ordinal")


def top(issues: DataFrame, n: int) -> DataFrame:
    """The first ``n`` in canonical order, without a full sort."""
    return in_order(issues).limit(n)


def count_by_level(issues: DataFrame) -> DataFrame:
    return issues.groupBy(level_name(F.col("level")).alias("level")).agg(F.count("*").alias("issues"))


def count_by_code(issues: DataFrame) -> DataFrame:
    return issues.groupBy(F.coalesce("code", F.lit(NO_CODE)).alias("code")).agg(F.count("*").alias("issues"), level_name(F.max("level")).alias("highest"))


def fails(issues: DataFrame, level: int) -> bool:
    """Whether the highest level reaches ``level``."""
    top_level = issues.agg(F.max("level")).first()[0]
    return top_level is not None and top_level >= level


def nth(issues: DataFrame, keys: list[str], order: str = "ordinal") -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(order))
