"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words in every contract: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"

#: Python workers get Arrow batches of at most so many bytes (and one row more).
BATCH_BYTES = 2 << 20


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``.  Only in local mode, and only
    where that is unset, a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = own.get()
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpuscope-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: the lineage ends here.

    A lost executor costs no more than the tasks that it ran, since what they
    read is on shared storage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpuscope-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["stored_at"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote for each of ``tables``; nothing that is still to be computed may read them."""
    for df in tables:
        if path := df.__dict__.get("stored_at"):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def with_key(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a row key, stored, so that each reader sees the same keys."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()), name)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A batch's texts; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


class ByteCache:
    """What each key gives, kept while it fits: at most ``limit`` bytes in two generations, the older of which goes first.

    Keys of over ``longest`` bytes are not kept.
    """

    #: What the interpreter holds for an entry besides key and value.
    ENTRY = 180

    def __init__(self, limit: int = 64 << 20, longest: int = 256):
        self.limit, self.longest, self.held = limit, longest, 0
        self.young: dict = {}
        self.old: dict = {}

    def look_up(self, keys: list, make: Callable) -> list:
        out = []
        young, old = self.young, self.old
        for k in keys:
            v = young.get(k)
            if v is None:
                v = old.get(k)
                if v is None:
                    v = make(k)
                size = len(k) + (len(v) if isinstance(v, bytes) else 0)
                if size <= self.longest:
                    young[k] = v
                    self.held += size + self.ENTRY
                    if 2 * self.held > self.limit:
                        self.young, self.old, self.held = {}, young, 0
                        young, old = self.young, self.old
            out.append(v)
        return out


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name if ``df`` has that column already."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
