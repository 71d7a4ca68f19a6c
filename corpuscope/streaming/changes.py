"""Change feeds: what a watcher reports, settled and applied.

A change is ``ts``, ``file_id``, ``op`` (add, update, delete) and what else a
file has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Folders whose changes do not count; fixed values.
SKIPPED = ("node_modules", ".git", ".idea", "vendor")


def watched(name: Column, extensions: list[str], explicit: list[str] = ()) -> Column:
    """Whether a changed file counts: of a known extension and in no skipped folder, unless it is named itself."""
    skip = name.rlike("(^|/)(" + "|".join(s.replace(".", "\\.") for s in SKIPPED) + ")/")
    known = F.regexp_extract(name, r"\.([^./]+)$", 1).isin(list(extensions))
    return known & (~skip | name.isin(list(explicit)))


def latest(changes: DataFrame, order: str = "ts") -> DataFrame:
    """The last change of each file; a pre-aggregated greatest, so a busy file costs no more than others."""
    rest = [c for c in changes.columns if c not in ("file_id", order)]
    return changes.groupBy("file_id").agg(F.max(F.struct(order, *rest)).alias("x")).select("file_id", f"x.{order}", *(f"x.{c}" for c in rest))


def applied(state: DataFrame, changes: DataFrame) -> DataFrame:
    """``state`` (``file_id`` and more) after the last change of each file."""
    now = latest(changes)
    columns = [c for c in state.columns if c != "file_id"]
    kept = state.join(now.select("file_id"), "file_id", "left_anti")
    return kept.unionByName(now.where("op != 'delete'").select("file_id", *columns))


def sessions(changes: DataFrame, gap: str = "300 milliseconds", key: str = "file_id") -> DataFrame:
    """Bursts of changes of one ``key``: those with less than ``gap`` between them are one."""
    out = changes.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("changes"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.select(key, "first", "last", "changes")


def keep_up(changes: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Runs ``handle`` on the settled changes of each micro-batch of the stream ``changes``.

    A batch is reduced to one change a file before it is handled; a batch that
    runs again after a failure handles the same changes.
    """

    def each(batch: DataFrame, number: int) -> None:
        handle(latest(batch), number)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Catalog:
    """A table kept in numbered versions in a shared folder; each batch writes the next one whole.

    A version's name follows from the batch number, so that a batch that runs
    again writes the same version again.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{version}")

    def start(self, state: DataFrame) -> None:
        state.write.mode("overwrite").parquet(f"{self.path}/v0")

    def handle(self, changes: DataFrame, batch: int) -> None:
        applied(self.at(batch), changes).write.mode("overwrite").parquet(f"{self.path}/v{batch + 1}")
