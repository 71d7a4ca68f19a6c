"""Fixed points over DataFrames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder of ``spark.checkpoint.dir`` and reads it again.

    Only a local session without that setting gets a temporary folder.
    """
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            where = own.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            where = "file://" + tempfile.mkdtemp(prefix="corpuscope-")
            spark.sparkContext.setCheckpointDir(where)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{where.rstrip('/')}/corpuscope-step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grown(start: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], keys: list[str], most: int = 64) -> DataFrame:
    """``start`` and all that ``step`` makes of the rows found last and of all rows, until it makes no new ``keys``.

    Each step stores its new rows alone; of rows with equal keys the first
    step's stay.
    """
    new = stored(start)
    every = new
    for _ in range(most):
        new = stored(step(new, every).join(every.select(*keys), keys, "left_anti"))
        if not new.limit(1).count():
            return every
        every = every.unionByName(new)
    raise RuntimeError(f"more than {most} steps")


def until_stable(start: DataFrame, step: Callable[[DataFrame], DataFrame], columns: list[str], most: int = 64) -> DataFrame:
    """Applies ``step`` until its rows stay the same; each step is stored."""

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first())

    now = stored(start)
    seen = mark(now)
    for _ in range(most):
        if not seen[0]:
            break
        now = stored(step(now))
        before, seen = seen, mark(now)
        if before == seen:
            return now
    else:
        raise RuntimeError(f"no fixed point within {most} steps")
    return now
