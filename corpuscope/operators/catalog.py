"""The symbol catalog: merging, patches, inheritance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import iterate


def merge(symbols: DataFrame) -> DataFrame:
    """One definition for each name: own code before patches, these before external and built-in ones, polyfills last, then the smaller span.

    ``constraints`` gathers those of all definitions of the name.  A name's
    definitions are few; the choice is a pre-aggregated least, not a sort.
    """
    order = F.struct(*((1 - F.col(c).cast("int")).alias(c) for c in ("is_own", "is_patch", "is_external", "is_builtin")), F.col("is_polyfill").cast("int").alias("is_polyfill"), "file_id", "start", "stop")
    best = F.min_by(F.struct(*(c for c in symbols.columns if c != "name")), order).alias("best")
    return symbols.groupBy("name").agg(best, F.sort_array(F.collect_set("constraint")).alias("constraints")).select("name", "best.*", "constraints")


def patched(patches: DataFrame, targets: DataFrame) -> DataFrame:
    """Patches with what they patch; ``orphan`` where there is nothing, ``refused`` where own code stands."""
    t = targets.select(F.col("name"), F.col("is_own").alias("target_own"), F.lit(True).alias("found"))
    return patches.join(t, "name", "left").withColumns({"orphan": F.col("found").isNull(), "refused": F.coalesce("target_own", F.lit(False))}).drop("found", "target_own")


def closure(edges: DataFrame, most: int = 64) -> DataFrame:
    """All ``descendant``, ``ancestor`` pairs of ``child``, ``parent`` edges with their least ``depth``.

    Each step puts the pairs that the last one found before all known ones, so
    the steps follow the logarithm of the depth; it keeps those that are new,
    which ends cycles, and a pair's first depth is its least.
    """
    start = edges.where("child is not null and parent is not null and child != parent").select(F.col("child").alias("descendant"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct()

    def step(last: DataFrame, every: DataFrame) -> DataFrame:
        longer = last.alias("a").join(every.alias("b"), F.col("a.ancestor") == F.col("b.descendant")).where("a.descendant != b.ancestor")
        return longer.groupBy("a.descendant", "b.ancestor").agg(F.min(F.col("a.depth") + F.col("b.depth")).alias("depth"))

    return iterate.grown(start, step, ["descendant", "ancestor"], most)


def descendants(pairs: DataFrame) -> DataFrame:
    """Direct and all descendants of each ancestor, counted."""
    return pairs.groupBy("ancestor").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("total"))


def topological(pairs: DataFrame) -> DataFrame:
    """A place for each name by which ancestors come before their descendants: how many ancestors it has.

    A descendant has its ancestors' ancestors and them besides; names of one
    cycle have the same place.  Names without ancestors have place 0.
    """
    places = pairs.select(F.col("descendant").alias("name"), F.lit(1).alias("n")).unionAll(pairs.select("ancestor", F.lit(0)).distinct())
    return places.groupBy("name").agg(F.sum("n").alias("place"))


def nearest_members(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each class and member name the nearest declaration: the class's own or that of its closest ancestor."""
    own = members.select(F.col("owner").alias("class"), "member", F.col("owner").alias("declared_by"), F.lit(0).alias("depth"))
    taken = members.join(pairs, members["owner"] == pairs["ancestor"]).select(F.col("descendant").alias("class"), "member", F.col("owner").alias("declared_by"), "depth")
    return own.unionAll(taken).groupBy("class", "member").agg(F.min(F.struct("depth", "declared_by")).alias("x")).select("class", "member", "x.declared_by", "x.depth")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows define."""
    return rows.groupBy(*keys).agg(F.count("*").alias("definitions")).where("definitions > 1")


def too_many(rows: DataFrame, owner: str, limit: int) -> DataFrame:
    """Owners with more than ``limit`` members."""
    return rows.groupBy(owner).agg(F.count("*").alias("members")).where(F.col("members") > limit)


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n = 1").drop("n")
