"""The reference graph: counts, unused and undefined symbols, changes and what they invalidate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import iterate


def counts(refs: DataFrame) -> DataFrame:
    """References to each symbol, and how many symbols they come from."""
    return refs.groupBy("dst").agg(F.count("*").alias("refs"), F.countDistinct("src").alias("sources"))


def unused(defs: DataFrame, refs: DataFrame) -> DataFrame:
    return defs.join(refs.select(F.col("dst").alias("symbol")).distinct(), "symbol", "left_anti")


def undefined(refs: DataFrame, defs: DataFrame) -> DataFrame:
    return refs.join(defs.select(F.col("symbol").alias("dst")).distinct(), "dst", "left_anti")


def unused_members(members: DataFrame, refs: DataFrame) -> DataFrame:
    """Members (``owner``, ``member``, ``checkable``) that nothing needs.

    First those without a reference; then, until nothing changes, those that
    only such members of their own class refer to.  Members that refer to each
    other in a cycle are not found.  References: ``src_owner``, ``src_member``
    (null: from elsewhere), ``owner``, ``member``.
    """
    can = members.where("checkable").select("owner", "member").distinct()
    used = refs.select("owner", "member", "src_owner", "src_member").distinct()
    start = can.join(used.select("owner", "member").distinct(), ["owner", "member"], "left_anti")

    def step(now: DataFrame) -> DataFrame:
        dead = now.select(F.col("owner").alias("src_owner"), F.col("member").alias("src_member"))
        alive = used.join(dead, ["src_owner", "src_member"], "left_anti").unionByName(used.join(dead, ["src_owner", "src_member"], "left_semi").where("src_owner != owner"))
        return can.join(alive.select("owner", "member").distinct(), ["owner", "member"], "left_anti")

    return iterate.until_stable(start, step, ["owner", "member"], 1000)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """State of each symbol (``symbol``, ``hash``, ``signature_hash``): added, removed, signature, body or keep."""
    o = old.select("symbol", F.col("hash").alias("old_hash"), F.col("signature_hash").alias("old_signature"))
    n = new.select("symbol", F.col("hash").alias("new_hash"), F.col("signature_hash").alias("new_signature"))
    state = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_signature") != F.col("new_signature"), "signature").when(F.col("old_hash") != F.col("new_hash"), "body").otherwise("keep")
    return o.join(n, "symbol", "full_outer").select("symbol", state.alias("state"))


def cascade(changed: DataFrame, refs: DataFrame, most: int | None = 5000) -> DataFrame | None:
    """Symbols that a change of the ``changed`` ones (``symbol``) reaches along references in signatures, and then one step along all.

    None if more than ``most`` symbols are reached: all is to be analysed anew.
    Without ``most`` there is no such bound.
    """
    edges = refs.where("in_signature").select("src", "dst").distinct()

    def step(last: DataFrame, every: DataFrame) -> DataFrame:
        return edges.join(last.withColumnRenamed("symbol", "dst"), "dst").select(F.col("src").alias("symbol")).distinct()

    reached = iterate.grown(changed.select("symbol").distinct(), step, ["symbol"], 200)
    if most is not None and reached.limit(most + 1).count() > most:
        return None
    bodies = refs.join(reached.withColumnRenamed("symbol", "dst"), "dst").select(F.col("src").alias("symbol"))
    return reached.unionAll(bodies).distinct()


def keep_safe(symbols: DataFrame, invalid: DataFrame) -> DataFrame:
    return symbols.join(invalid, "symbol", "left_anti")
