"""Complexity metrics over node tables, and spans around points.

The definitions are fixed ones and differ from the textbooks': a function's
cyclomatic number has no added 1, and both Halstead products are rounded only
at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted(nodes: DataFrame, weights: dict[str, int], limit: int) -> DataFrame:
    """Owners whose nodes' weights add up to more than ``limit``."""
    w = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("kind")), F.lit(0))
    return nodes.groupBy("owner").agg(F.sum(w).alias("weight")).where(F.col("weight") > limit)


def halstead(rows: DataFrame) -> DataFrame:
    """Volume, difficulty and effort of each owner from its ``operator`` and ``operand`` rows (null: none); all 0 without operands."""
    m = rows.groupBy("owner").agg(F.count("operator").alias("operators"), F.count("operand").alias("operands"), F.countDistinct("operator").alias("n1"), F.countDistinct("operand").alias("n2"))
    volume = (F.col("operators") + F.col("operands")) * F.log2(F.col("n1") + F.col("n2"))
    difficulty = F.col("n1") / 2 * (F.col("operands") / F.col("n2"))
    some = (F.col("n2") > 0) & (F.col("operands") > 0)
    return m.select("owner", "operators", "operands", "n1", "n2", *(F.when(some, F.round(x, 2)).otherwise(F.lit(0.0)).alias(name) for name, x in (("volume", volume), ("difficulty", difficulty), ("effort", volume * difficulty))))


def kan_defect(nodes: DataFrame, limit: float = 1.6) -> DataFrame:
    """Owners whose defect estimate is over ``limit``."""

    def n(*kinds: str):
        return F.count_if(F.col("kind").isin(*kinds))

    score = 0.15 + 0.23 * n("while", "do_while", "foreach") + 0.22 * n("switch", "match") + 0.07 * n("if")
    return nodes.groupBy("owner").agg(F.round(score, 2).alias("defect")).where(F.col("defect") > limit)


def enclosing(points: DataFrame, scopes: DataFrame) -> DataFrame:
    """How many of its file's ``scopes`` (``start``, ``stop``) hold each point (``file_id``, ``point``, ``at``).

    Scopes begun less scopes ended, as a running sum: no join on a range.
    """
    marks = (
        scopes.select("file_id", F.col("start").alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("d"), F.lit(None).cast("long").alias("point"))
        .unionAll(scopes.select("file_id", "stop", F.lit(0), F.lit(-1), F.lit(None).cast("long")))
        .unionAll(points.select("file_id", "at", F.lit(1), F.lit(0), F.col("point").cast("long")))
    )
    held = F.expr("sum(d) OVER (PARTITION BY file_id ORDER BY at, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return marks.withColumn("scopes", held).where("kind = 1").select("file_id", "point", "at", "scopes")
