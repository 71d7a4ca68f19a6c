"""The file table: scanning, tiers, exclusions, lines.

Columns of ``files``: ``file_id`` (hash of the name), ``name`` (relative, with
``/``), ``contents`` (bytes).  Offsets count bytes, lines count from 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import starts
from ..functions.names import glob_regex

GLOB = set("*?[{")
TIERS = ("host", "vendored", "patch")


def scan(spark: SparkSession, root: str, paths: list[str], extensions: list[str], excludes: list[str] = ()) -> DataFrame:
    """Reads the files below ``root`` that ``paths`` name.

    A folder gives its files of these extensions, a pattern what it matches,
    and a file named in full is read whatever its extension.  Names are chosen
    first; only chosen files are read.
    """
    base = root.rstrip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    name = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^\\Q" + base + "\\E/", "").alias("name")
    names = chosen(read.load(base).select("path", name), paths, extensions, list(excludes))
    wanted = [r["path"] for r in names.select("path").collect()]  # Spark's own listing holds as much on the driver
    found = spark.read.format("binaryFile").option("__globPaths__", "false").load(wanted) if wanted else read.load(base).limit(0)
    return found.select(name, F.col("content").alias("contents"), F.col("length").alias("size")).select(F.xxhash64("name").alias("file_id"), "name", "contents", "size")


def has_extension(name: Column, extensions: list[str]) -> Column:
    return F.regexp_extract(name, r"\.([^./]+)$", 1).isin([e.lstrip(".") for e in extensions])


def under(name: Column, path: str) -> Column:
    """Whether ``name`` is ``path`` or below it; a pattern matches whole names."""
    if GLOB & set(path):
        return name.rlike(glob_regex(path))
    path = path.rstrip("/")
    return F.lit(True) if path in ("", ".") else (name == path) | name.startswith(path + "/")


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def excluded(name: Column, excludes: list[str]) -> Column:
    return any_of([under(name, e) for e in excludes])


def chosen(files: DataFrame, paths: list[str], extensions: list[str], excludes: list[str]) -> DataFrame:
    name = F.col("name")
    named = any_of([name == p for p in paths if not GLOB & set(p)])
    below = any_of([under(name, p) for p in paths]) & has_extension(name, extensions)
    return files.where((named | below) & ~excluded(name, excludes))


@dataclass(frozen=True)
class Tier:
    """A path with the tier that it gives its files."""

    path: str
    tier: str


def specificity(name: Column, path: str) -> Column:
    """How exactly ``path`` names the file: a file beats a folder, a folder a pattern; null: not at all.

    The weights are fixed values: 1000 a component for the file itself, 100 for
    a folder, 10 a literal component of a pattern.
    """
    parts = [p for p in PurePosixPath(path).parts if p not in (".", "/")]
    if GLOB & set(path):
        return F.when(under(name, path), 10 * sum(not GLOB & set(p) for p in parts))
    return F.when(name == path.rstrip("/"), 1000 * len(parts)).when(under(name, path), 100 * len(parts))


def with_tier(files: DataFrame, tiers: list[Tier]) -> DataFrame:
    """The tier of each file, null for files in none.

    Vendored wins over own code at equal weight; a patch beats vendored always,
    own code only with a greater weight.
    """
    name = F.col("name")
    best = {}
    for t in TIERS:
        own = [specificity(name, x.path) for x in tiers if x.tier == t]
        best[t] = F.greatest(*own, F.lit(None)) if own else F.lit(None).cast("int")
    host, vendored, patch = (F.coalesce(best[t], F.lit(-1)) for t in TIERS)
    tier = (
        F.when((patch >= 0) & (host <= vendored), "patch")
        .when((patch >= 0) & (patch > host), "patch")
        .when((vendored >= 0) & (vendored >= host), "vendored")
        .when(host >= 0, "host")
    )
    return files.withColumn("tier", tier)


def substituted(files: DataFrame, other: DataFrame) -> DataFrame:
    """``files`` with the contents of ``other`` (``name``, ``contents``) where it has the name."""
    return files.join(other.select("name", F.col("contents").alias("new")), "name", "left").withColumn("contents", F.coalesce("new", "contents")).drop("new")


def line_table(texts: DataFrame, key: str, text: str, one_byte: bool = False) -> DataFrame:
    """``key``, ``line`` (from 0), ``start`` (byte offset) and ``content`` of each line.

    The first line end settles the kind: a bare carriage return splits at
    carriage returns, anything else at line feeds.  With ``one_byte`` each
    character of the text stands for one byte.
    """
    size = F.length if one_byte else F.octet_length
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.regexp_extract(t, "^[^\\r\\n]*(\\r\\n|\\r|\\n)", 1) == "\r"
    parts = F.when(bare, F.split(t, "\\r", -1)).otherwise(F.split(t, "\\n", -1))
    cut = texts.select(F.col(key), parts.alias("parts"))
    return cut.select(key, F.posexplode(F.arrays_zip(starts(F.transform("parts", lambda x: size(x).cast("bigint") + 1)).alias("start"), F.col("parts")))).select(key, F.col("pos").alias("line"), F.col("col.start").alias("start"), F.col("col.parts").alias("content"))


def line_of(lines: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """The line and column of each byte ``offset`` of ``points``: the last line that starts at or before it.

    A running last value over lines and points together, by file, instead of a
    join on a range.
    """
    both = lines.select(key, F.col("start").alias("at"), F.lit(0).alias("kind"), F.col("line"), F.lit(None).cast("long").alias("point")).unionByName(
        points.select(key, F.col("offset").cast("bigint").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("line"), F.col("point").cast("long"))
    )
    window = f"OVER (PARTITION BY {key} ORDER BY at, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    filled = both.select(key, "at", "kind", "point", F.expr(f"last(line, true) {window}").alias("line"), F.expr(f"last(CASE WHEN kind = 0 THEN at END, true) {window}").alias("start"))
    return filled.where("kind = 1").select(key, "point", F.col("at").alias("offset"), "line", (F.col("at") - F.col("start")).alias("column"))
