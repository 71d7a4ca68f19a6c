"""What a workspace says of itself: its manifest and what is staged for commit."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, description string, type string, require map<string,string>, `require-dev` map<string,string>, autoload struct<`psr-4`: map<string,string>, classmap: array<string>, files: array<string>>, `autoload-dev` struct<`psr-4`: map<string,string>, classmap: array<string>, files: array<string>>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Package manifests, one row a file; what is missing is null."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def namespaces(manifests: DataFrame) -> DataFrame:
    """``namespace`` and ``path`` of what the manifests load, and whether for development only."""
    out = None
    for column, dev in (("autoload", False), ("autoload-dev", True)):
        one = manifests.select(F.explode(F.col(f"`{column}`.`psr-4`")).alias("namespace", "path"), F.lit(dev).alias("dev"))
        out = one if out is None else out.unionAll(one)
    return out


def requirements(manifests: DataFrame) -> DataFrame:
    """``package``, ``constraint`` and whether for development only."""
    return manifests.select(F.explode("require").alias("package", "constraint"), F.lit(False).alias("dev")).unionAll(manifests.select(F.explode("`require-dev`").alias("package", "constraint"), F.lit(True).alias("dev")))


def staged(root: str) -> list[str]:
    """Paths that are staged for commit and not deleted, below ``root``."""
    run = subprocess.run(["git", "-C", root, "diff", "--cached", "--name-only", "--diff-filter=ACMR", "-z"], capture_output=True, text=True, check=True)
    return [p for p in run.stdout.split("\0") if p]


def only_staged(files: DataFrame, root: str) -> DataFrame:
    """Files of the table that are staged; the list is as long as a commit."""
    return files.where(F.col("name").isin(staged(root)))
