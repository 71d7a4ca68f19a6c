"""The command line: ``python -m corpuscope COMMAND ...``.

Commands: ``lint``, ``check`` (legality of each file), ``analyze`` (the whole
project), ``guard``, ``list-files``, ``cst``, ``inspect-baseline``, ``list-rules``.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frontend import analysis, lint, semantics, syntax, tables
from .frontend.tokens import tokens
from .operators import baseline, guard, issues, pragmas
from .operators.iterate import stored
from .plans.project import Project
from .sources import baseline_files, files, sinks


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="corpuscope")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("lint", "check", "analyze", "guard", "list-files"):
        c = sub.add_parser(name)
        c.add_argument("paths", nargs="*", default=["."])
        c.add_argument("--workspace", default=".")
        c.add_argument("--extension", action="append")
        c.add_argument("--exclude", action="append", default=[])
        if name != "list-files":
            c.add_argument("--only", action="append")
            c.add_argument("--pedantic", action="store_true")
            c.add_argument("--pragmas", metavar="TOOL", help="heed comments @TOOL-ignore and @TOOL-expect")
            if name == "analyze":
                c.add_argument("--include", action="append", help="what of the workspace is known and not reported on, as stubs and libraries are")
            if name == "guard":
                c.add_argument("--config", required=True, help="a JSON file with the guard's rules")
            c.add_argument("--reporting-format", choices=sorted(sinks.FORMATS), default="medium")
            c.add_argument("--output", help="a folder for the report's rows, written in parallel, in place of the terminal")
            c.add_argument("--minimum-report-level", choices=issues.LEVELS, default="note")
            c.add_argument("--minimum-fail-level", choices=issues.LEVELS, default="error")
            c.add_argument("--retain-code", action="append")
            c.add_argument("--baseline")
            c.add_argument("--generate-baseline", action="store_true")
            c.add_argument("--loose", action="store_true")
            c.add_argument("--remove-outdated-baseline-entries", action="store_true")
    c = sub.add_parser("cst")
    c.add_argument("file")
    c.add_argument("--tokens", action="store_true")
    c.add_argument("--names", action="store_true")
    c = sub.add_parser("inspect-baseline")
    c.add_argument("--baseline", required=True)
    c.add_argument("--group", choices=("code", "file"), default="code")
    c.add_argument("--limit", type=int, default=10)
    c = sub.add_parser("list-rules")
    c.add_argument("--json", action="store_true")
    return p.parse_args(argv)


def placed(found: DataFrame, source: DataFrame) -> DataFrame:
    """Issues with a key ``point``, ``line``, ``column`` and ``content`` of their start, and the lines that they span."""
    lines = line_texts(source)
    keyed = stored(found.withColumn("point", F.monotonically_increasing_id()))
    at = files.line_of(lines, keyed.select("file_id", "point", F.col("start").alias("offset")).unionAll(keyed.select("file_id", (-1 - F.col("point")).alias("point"), F.col("stop").alias("offset"))), "file_id")
    begin = at.where("point >= 0").select("point", "line", "column")
    end = at.where("point < 0").select((-1 - F.col("point")).alias("point"), F.col("line").alias("stop_line"))
    text = lines.select("file_id", "line", "content")
    return keyed.join(begin, "point").join(end, "point").withColumn("start_line", F.col("line")).join(text, ["file_id", "line"], "left")


def line_texts(source: DataFrame) -> DataFrame:
    """The lines of source files by byte offsets, whatever their encoding; what is no UTF-8 is replaced in ``content``."""
    lines = files.line_table(source.select("file_id", F.decode("contents", "iso-8859-1").alias("text")), "file_id", "text", one_byte=True)
    return lines.withColumn("content", F.make_valid_utf8(F.encode("content", "iso-8859-1").cast("string")))


#: What pragmas call the issues of each command.
CATEGORIES = {"lint": "lint", "check": "semantics", "analyze": "analysis", "guard": "guard"}


def suppressed(found: DataFrame, source: DataFrame, tool: str, category: str, leftovers: bool) -> DataFrame:
    """Issues that no pragma of ``tool`` takes away and, with ``leftovers``, one for each pragma without use."""
    texts = source.select("file_id", F.decode("contents", "iso-8859-1").alias("text"))
    marks = stored(pragmas.suppress(texts, found.select("file_id", F.lit(category).alias("category"), "code", "line", F.col("point").alias("ordinal")), tool, (category,)))
    kept = found.join(marks.where("ordinal >= 0").select(F.col("ordinal").alias("point")), "point", "left_semi")
    if not leftovers:
        return kept
    unused = F.col("code") == "unused-pragma"
    rest = marks.where("ordinal < 0").join(line_texts(source), ["file_id", "line"]).join(source.select("file_id", F.col("name").alias("file")), "file_id")
    rest = rest.select(
        "file_id", "file", "code", F.when(unused, 0).otherwise(2).alias("level"), F.when(unused, "No issue is ignored here.").otherwise("What is expected here is not found.").alias("message"),
        F.col("start").cast("int").alias("start"), (F.col("start") + F.octet_length("content")).cast("int").alias("stop"), "ordinal", F.lit(None).cast("bigint").alias("point"),
        "line", F.lit(0).cast("bigint").alias("column"), F.col("line").alias("start_line"), F.col("line").alias("stop_line"), "content",
    )
    return kept.select(*rest.columns).unionByName(rest)


def guarded(source: DataFrame, config: str) -> DataFrame:
    """Issues of the architecture guard that a JSON text configures.

    Its keys are ``rules`` (``namespace``, ``permit``), ``layers`` (pairs of a
    name and a namespace), ``restrictions`` (``target``, ``allow_from``,
    ``deny_from``) and ``shapes`` (the fields of ``guard.Shape``).
    """

    def frozen(x):
        return tuple(map(frozen, x)) if isinstance(x, list) else x

    def made(kind, rows):
        return tuple(kind(**{k: frozen(v) for k, v in r.items()}) for r in rows)

    c = json.loads(config)
    rules = guard.Guard(made(guard.Rule, c.get("rules", ())), frozen(list(c.get("layers", ()))), made(guard.Restriction, c.get("restrictions", ())))
    refs = tables.reference_table(source).where("vector != 'use'")
    message = F.concat("source", F.lit(" depends on "), "target", F.lit("."))
    found = guard.perimeter(refs, rules).select("file_id", F.col("reason").alias("code"), message.alias("message"), "start", "stop")
    if shapes := list(made(guard.Shape, c.get("shapes", ()))):
        symbols = tables.symbol_table(source).where("owner is null").withColumns({f"is_{f}": F.array_contains("flags", f) for f in ("final", "abstract", "readonly")})
        flaws = guard.structural(symbols, shapes, carry=("file_id", "start", "stop"))
        found = found.unionByName(flaws.select("file_id", F.col("flaw").alias("code"), F.concat("name", F.lit(" breaks "), "flaw", F.lit(".")).alias("message"), "start", "stop"))
    named = found.join(source.select("file_id", F.col("name").alias("file")), "file_id")
    return named.select("file_id", "file", "code", F.lit(3).alias("level"), "message", "start", "stop", F.col("start").cast("bigint").alias("ordinal"))


def report(spark: SparkSession, a: argparse.Namespace, source: DataFrame) -> int:
    if a.command == "lint":
        found = lint.lint_files(source, set(a.only) if a.only else None, a.pedantic)
    elif a.command == "check":
        found = semantics.check_files(source)
    elif a.command == "guard":
        found = guarded(source, Path(a.config).read_text())
    else:
        context = files.scan(spark, str(Path(a.workspace).resolve()), a.include, a.extension or ["php"]) if a.include else source.limit(0)
        known = context.join(source.select("file_id"), "file_id", "left_anti")
        found = Project(source.unionByName(known.select(*source.columns))).all().join(source.select("file_id", F.col("name").alias("file")), "file_id").withColumn("ordinal", F.col("start").cast("bigint"))
        own = analysis.analyze_files(source)
        found = own.unionByName(found.select(*own.columns))
    if a.only and a.command != "lint":
        found = found.where(F.col("code").isin(a.only))
    found = placed(found, source)
    if a.pragmas:
        found = suppressed(found, source, a.pragmas, CATEGORIES[a.command], leftovers=not a.only)
    found = found.drop("point")
    if a.retain_code:
        found = issues.with_codes(found, a.retain_code)
    path = Path(a.baseline) if a.baseline else None
    if path and a.generate_baseline:
        variant = "loose" if a.loose else "strict"
        path.write_text(baseline_files.dumps(getattr(baseline, variant)(found), variant))
        return 0
    if path and path.exists():
        variant, entries = baseline_files.loads(spark, path.read_text())
        if a.remove_outdated_baseline_entries:
            prune = baseline.loose_prune if variant == "loose" else baseline.strict_prune
            path.write_text(baseline_files.dumps(prune(entries, found), variant))
        found = (baseline.loose_filter if variant == "loose" else baseline.strict_filter)(found, entries)
    found = issues.at_least(found, issues.LEVELS.index(a.minimum_report_level)).cache()
    ordered = found if a.reporting_format in ("count", "code_count", "checkstyle") else issues.in_order(found)
    if a.output:
        sinks.write(ordered, a.reporting_format, Path(a.output).resolve().as_uri())
    else:
        print(sinks.whole(ordered, a.reporting_format))
    return int(issues.fails(found, issues.LEVELS.index(a.minimum_fail_level)))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv)
    if a.command == "list-rules":
        lint.load()
        rules = [{"code": r.code, "level": issues.LEVELS[r.level], "default": r.on} for r in lint.RULES.values()]
        print(json.dumps(rules) if a.json else "\n".join(f"{r['code']} {r['level']} {'on' if r['default'] else 'off'}" for r in rules))
        return 0
    if a.command == "cst":
        source = Path(a.file).read_bytes()
        root, parser = syntax.parse(source)
        text = source.decode("latin-1")
        if a.tokens:
            rows = [{"kind": k, "start": s, "stop": e, "value": text[s:e]} for k, s, e in tokens(text)]
        elif a.names:
            rows = [dict(zip(("start", "stop", "fqn", "kind", "imported"), r, strict=True)) for r in tables.name_rows(root)]
        else:
            rows = [dict(zip(("node_id", "parent_id", "ordinal", "kind", "start", "stop", "value", "depth"), r, strict=False)) for r in tables.node_rows(root)]
        print(json.dumps(rows))
        return int(bool(parser.errors))
    spark = spark or SparkSession.builder.appName("corpuscope").getOrCreate()
    if a.command == "inspect-baseline":
        variant, entries = baseline_files.loads(spark, Path(a.baseline).read_text())
        if variant == "strict":
            entries = entries.groupBy("file", "code").agg(F.count("*").alias("count"))
        other = "file" if a.group == "code" else "code"
        for r in baseline.ranked(entries, a.group, other, a.limit, a.limit).orderBy(F.desc("group_count"), a.group, "rank").collect():
            print(r[a.group], r["group_count"], r[other], r["count"])
        return 0
    source = files.scan(spark, str(Path(a.workspace).resolve()), a.paths, a.extension or ["php"], a.exclude)
    if a.command == "list-files":
        print("\n".join(r["name"] for r in source.select("name").orderBy("name").collect()))
        return 0
    return report(spark, a, source)


if __name__ == "__main__":
    sys.exit(main())
