"""Array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 512


def starts(lengths: Column) -> Column:
    """Sum of all lengths before each one.  Sums run chunk by chunk, so the work follows the number of lengths."""
    kind = "array<bigint>"

    def inner(acc: Column, n: Column) -> Column:
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def outer(lengths: Column, acc: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(lengths, k * CHUNK + 1, F.least(F.lit(CHUNK), F.size(lengths) - k * CHUNK)), F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out")), inner)
        return F.struct(part["at"].alias("at"), F.concat(acc["out"], F.array(part["out"])).cast(f"array<{kind}>").alias("out"))

    def whole(lengths: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int"))
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.when(F.size(lengths) > 0, F.aggregate(chunks, start, lambda acc, k: outer(lengths, acc, k), lambda acc: F.flatten(acc["out"]))).otherwise(F.array().cast(kind))

    return F.transform(F.array(lengths), whole)[0]  # the array binds the lengths, which are then made once
