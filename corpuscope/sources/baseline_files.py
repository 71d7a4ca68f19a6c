"""Baselines as TOML files and as DataFrames.

A file holds a variant and its entries; it is as large as what a team has put
off, and is read and written by the driver.
"""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import DataFrame, SparkSession

STRICT = "file string, code string, start_line int, stop_line int"
LOOSE = "file string, code string, message string, count bigint"


def loads(spark: SparkSession, text: str) -> tuple[str, DataFrame]:
    """The variant, and its entries."""
    data = tomllib.loads(text)
    if data.get("variant") == "loose":
        return "loose", spark.createDataFrame([(i["file"], i["code"], i["message"], i["count"]) for i in data.get("issues", [])], LOOSE)
    rows = [(f, i["code"], i["start_line"], i["end_line"]) for f, e in data.get("entries", {}).items() for i in e.get("issues", [])]
    return "strict", spark.createDataFrame(rows, STRICT)


def dumps(entries: DataFrame, variant: str) -> str:
    """Entries in a fixed order, so that a file changes only where its entries do."""
    quote = lambda s: json.dumps(s, ensure_ascii=False)  # noqa: E731  a basic TOML string
    out = [f'variant = "{variant}"', ""]
    if variant == "loose":
        for r in entries.orderBy("file", "code", "message").collect():
            out += ["[[issues]]", f"file = {quote(r['file'])}", f"code = {quote(r['code'])}", f"message = {quote(r['message'])}", f"count = {r['count']}", ""]
    else:
        for r in entries.orderBy("file", "start_line", "stop_line", "code").collect():
            out += [f"[[entries.{quote(r['file'])}.issues]]", f"code = {quote(r['code'])}", f"start_line = {r['start_line']}", f"end_line = {r['stop_line']}", ""]
    return "\n".join(out)
