"""Baselines: recorded issues that reports leave out.

A strict baseline is a set of places ``(file, code, start_line, stop_line)``, a
loose one a bag of counts by ``(file, code, message)``.  Issues without a code
or a span are never recorded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACE = ["file", "code", "start_line", "stop_line"]
TEXT = ["file", "code", "message"]


def recordable(issues: DataFrame) -> DataFrame:
    return issues.where("code is not null and start_line is not null").withColumn("file", F.replace("file", F.lit("\\"), F.lit("/")))


def strict(issues: DataFrame) -> DataFrame:
    return recordable(issues).select(PLACE).distinct()


#: Ordinals that are numbered together.
RANGE = 1 << 16


def loose(issues: DataFrame) -> DataFrame:
    return recordable(issues).groupBy(TEXT).agg(F.count("*").alias("count"))


def strict_filter(issues: DataFrame, baseline: DataFrame) -> DataFrame:
    """All issues at places that the baseline does not hold."""
    return issues.join(baseline.select(PLACE).distinct(), PLACE, "left_anti")


def loose_filter(issues: DataFrame, baseline: DataFrame) -> DataFrame:
    """Issues beyond the recorded count of their text, counted in their order.

    The running number is taken only within texts that the baseline holds, and
    within ranges of ``RANGE`` ordinals, to which the counts of the ranges before
    are added: a text with very many issues is as many tasks' work.
    """
    known = issues.join(baseline, TEXT, "left")
    free = known.where("count is null").drop("count")
    part = F.floor(F.col("ordinal") / RANGE)
    held = known.where("count is not null").withColumn("part", part)
    sums = held.groupBy(*TEXT, "part").agg(F.count("*").alias("own"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy(*TEXT).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(*TEXT, "part").orderBy("ordinal"))
    over = held.withColumn("n", rank).join(sums.select(*TEXT, "part", before.alias("before")), [*TEXT, "part"]).where("before + n > count")
    return free.unionByName(over.drop("part", "n", "before", "count"))


def strict_compare(issues: DataFrame, baseline: DataFrame) -> DataFrame:
    """Places that are new or gone, with ``state``."""
    now, old = strict(issues).withColumn("now", F.lit(1)), baseline.select(PLACE).distinct().withColumn("old", F.lit(1))
    return now.join(old, PLACE, "full_outer").where("now is null or old is null").select(*PLACE, F.when(F.col("old").isNull(), "new").otherwise("removed").alias("state"))


def loose_compare(issues: DataFrame, baseline: DataFrame) -> DataFrame:
    """Texts whose counts differ, with how many are new or gone."""
    now, old = loose(issues).withColumnRenamed("count", "now"), baseline.select(*TEXT, F.col("count").alias("old"))
    delta = F.coalesce("now", F.lit(0)) - F.coalesce("old", F.lit(0))
    return now.join(old, TEXT, "full_outer").withColumn("delta", delta).where("delta != 0").select(*TEXT, F.when(F.col("delta") > 0, "new").otherwise("removed").alias("state"), F.abs("delta").alias("count"))


def strict_prune(baseline: DataFrame, issues: DataFrame) -> DataFrame:
    """Entries that still stand for an issue."""
    return baseline.join(strict(issues), PLACE, "left_semi")


def loose_prune(baseline: DataFrame, issues: DataFrame) -> DataFrame:
    """Entries cut down to what is still there."""
    now = loose(issues).withColumnRenamed("count", "now")
    return baseline.join(now, TEXT).select(*TEXT, F.least("count", "now").alias("count"))


def files_changed(compared: DataFrame) -> DataFrame:
    return compared.agg(F.countDistinct("file").alias("files"))


def rollup(baseline: DataFrame) -> DataFrame:
    """Counts by code and file, by code, and in all; what is summed over is null."""
    return baseline.rollup("code", "file").agg(F.sum("count").alias("count"), F.grouping_id().alias("grouping"))


def ranked(baseline: DataFrame, group: str, member: str, groups: int, members: int) -> DataFrame:
    """The largest groups and within each its largest members, ties by name."""
    parts = baseline.groupBy(group, member).agg(F.sum("count").alias("count"))
    sums = parts.groupBy(group).agg(F.sum("count").alias("group_count")).orderBy(F.desc("group_count"), group).limit(groups)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("count"), member))
    return parts.join(sums, group).withColumn("rank", rank).where(F.col("rank") <= members)
