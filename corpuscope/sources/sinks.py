"""Report formats: each gives the text lines of a report as a DataFrame with a ``value``.

Issues have ``file``, ``line`` and ``column`` (from 0), ``code``, ``level`` (0 to
3), ``message``.  Formats that a program reads give a frame even without issues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.issues import NO_CODE, count_by_code, count_by_level, level_name

#: What the other side of each format calls the four levels; fixed values.
GITHUB = ("notice", "notice", "warning", "error")
GITLAB = ("info", "info", "minor", "major")
SARIF = ("note", "note", "warning", "error")
CHECKSTYLE = ("info", "info", "warning", "error")


def _named(names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.col("level").cast("int") + 1)


def _code() -> Column:
    return F.coalesce("code", F.lit(NO_CODE))


def _line(n: int = 1) -> Column:
    return (F.coalesce("line", F.lit(0)) + n).cast("string")


def _column(n: int = 1) -> Column:
    return (F.coalesce("column", F.lit(0)) + n).cast("string")


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def short(issues: DataFrame) -> DataFrame:
    return issues.select(F.concat(F.col("file"), F.lit(":"), _line(), F.lit(":"), _column(), F.lit(": "), level_name(F.col("level")), F.lit("["), _code(), F.lit("]: "), F.col("message")).alias("value"))


def medium(issues: DataFrame) -> DataFrame:
    return issues.select(F.concat(level_name(F.col("level")), F.lit("["), _code(), F.lit("]: "), F.col("message"), F.lit("\n  at "), F.col("file"), F.lit(":"), _line(), F.lit(":"), _column()).alias("value"))


def rich(issues: DataFrame) -> DataFrame:
    """With the source line and a mark below it; issues also have ``content``."""
    gutter = F.repeat(F.lit(" "), F.length(_line()))
    mark = F.concat(F.repeat(F.lit(" "), F.coalesce("column", F.lit(0)).cast("int")), F.lit("^"))
    head = F.concat(level_name(F.col("level")), F.lit("["), _code(), F.lit("]: "), F.col("message"))
    return issues.select(F.concat_ws("\n", head, F.concat(gutter, F.lit(" --> "), F.col("file"), F.lit(":"), _line(), F.lit(":"), _column()), F.concat(_line(), F.lit(" | "), F.col("content")), F.concat(gutter, F.lit(" | "), mark)).alias("value"))


def github(issues: DataFrame) -> DataFrame:
    return issues.select(F.concat(F.lit("::"), _named(GITHUB), F.lit(" file="), F.col("file"), F.lit(",line="), _line(), F.lit(",col="), _column(), F.lit(",title="), _code(), F.lit("::"), _escaped(F.col("message"))).alias("value"))


def emacs(issues: DataFrame) -> DataFrame:
    return issues.select(F.concat(F.col("file"), F.lit(":"), _line(), F.lit(":"), _column(), F.lit(":"), level_name(F.col("level")), F.lit(" - "), F.col("message")).alias("value"))


def json_rows(issues: DataFrame) -> DataFrame:
    return issues.select(F.to_json(F.struct(level_name(F.col("level")).alias("level"), "code", "message", "file", "line", "column")).alias("value"))


def gitlab(issues: DataFrame) -> DataFrame:
    where = F.struct(F.col("file").alias("path"), F.struct((F.coalesce("line", F.lit(0)) + 1).alias("begin")).alias("lines"))
    key = F.md5(F.concat_ws("|", "file", _code(), _line(), "message"))
    return issues.select(F.to_json(F.struct(F.col("message").alias("description"), _code().alias("check_name"), key.alias("fingerprint"), _named(GITLAB).alias("severity"), where.alias("location"))).alias("value"))


def sarif(issues: DataFrame) -> DataFrame:
    region = F.struct((F.coalesce("line", F.lit(0)) + 1).alias("startLine"), (F.coalesce("column", F.lit(0)) + 1).alias("startColumn"))
    place = F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    return issues.select(F.to_json(F.struct(_code().alias("ruleId"), _named(SARIF).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"))).alias("value"))


def checkstyle(issues: DataFrame) -> DataFrame:
    """One element a file; what a file gathers is bounded by the file."""
    one = F.concat(F.lit('<error line="'), _line(), F.lit('" column="'), _column(), F.lit('" severity="'), _named(CHECKSTYLE), F.lit('" message="'), _xml(F.col("message")), F.lit('" source="'), _xml(_code()), F.lit('"/>'))
    parts = issues.select("file", F.struct(F.coalesce("line", F.lit(0)).alias("l"), F.coalesce("column", F.lit(0)).alias("c"), one.alias("x")).alias("e"))
    return parts.groupBy("file").agg(F.sort_array(F.collect_list("e")).alias("es")).select(F.concat(F.lit('<file name="'), _xml(F.col("file")), F.lit('">'), F.array_join(F.transform("es", lambda e: e["x"]), ""), F.lit("</file>")).alias("value"))


def count(issues: DataFrame) -> DataFrame:
    return count_by_level(issues).select(F.concat("level", F.lit(": "), F.col("issues").cast("string")).alias("value"))


def code_count(issues: DataFrame) -> DataFrame:
    return count_by_code(issues).select(F.concat("highest", F.lit("["), "code", F.lit("]: "), F.col("issues").cast("string")).alias("value"))


FORMATS = {f.__name__.removesuffix("_rows"): f for f in (short, medium, rich, github, emacs, json_rows, gitlab, sarif, checkstyle, count, code_count)}
#: What stands before and after the rows, and between them, where a program reads the whole.
FRAMES = {
    "json": ('{"issues":[', "]}", ","),
    "gitlab": ("[", "]", ","),
    "sarif": ('{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"corpuscope"}},"results":[', "]}]}", ","),
    "checkstyle": ('<?xml version="1.0" encoding="UTF-8"?><checkstyle>', "</checkstyle>", ""),
}


def write(issues: DataFrame, form: str, path: str) -> None:
    """Writes the rows of a report as text parts, in parallel; ``whole`` frames a small one."""
    FORMATS[form](issues).write.mode("overwrite").text(path)


def whole(issues: DataFrame, form: str) -> str:
    """The report as one text, for a terminal; its size is the report's."""
    rows = [r["value"] for r in FORMATS[form](issues).collect()]
    head, tail, between = FRAMES.get(form, ("", "", "\n"))
    return head + between.join(rows) + tail
