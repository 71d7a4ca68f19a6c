"""Operators beyond SQL, and what SQL does not reach."""

import json
import random
from xml.etree import ElementTree

from pyspark.sql import functions as F

from corpuscope.frontend import tables
from corpuscope.functions import names
from corpuscope.operators import catalog, edits, guard, issues, metrics, pragmas, references
from corpuscope.sources import files, sinks
from corpuscope.streaming import changes

ISSUES = "file string, code string, level int, message string, line int, column int, content string"


def test_reports(spark):
    df = spark.createDataFrame([("a.x", "c1", 3, 'say "no" & <go>\n100%', 4, 2, "abc"), ("a.x", None, 0, "plain", None, None, "abc"), ("b.x", "c1", 2, "m", 0, 0, "abc")], ISSUES)
    assert sinks.whole(df.limit(1), "github") == '::error file=a.x,line=5,col=3,title=c1::say "no" & <go>%0A100%25'
    assert len(json.loads(sinks.whole(df, "json"))["issues"]) == 3 and len(json.loads(sinks.whole(df, "gitlab"))) == 3
    assert len(json.loads(sinks.whole(df, "sarif"))["runs"][0]["results"]) == 3
    found = ElementTree.fromstring(sinks.whole(df, "checkstyle"))
    assert [f.get("name") for f in found] in (["a.x", "b.x"], ["b.x", "a.x"]) and any(e.get("message") == 'say "no" & <go>\n100%' or e.get("message") == 'say "no" & <go> 100%' for e in found.iter("error"))
    for form in sinks.FRAMES:
        assert sinks.whole(df.limit(0), form)
    assert sinks.whole(df.limit(0), "short") == ""
    assert "5 | abc\n  |   ^" in sinks.whole(df.limit(1), "rich")
    assert issues.fails(df, 3) and not issues.fails(df.where("level < 3"), 3) and not issues.fails(df.limit(0), 0)


def test_apply_edits():
    r = random.Random(0)
    for _ in range(300):
        text = bytes(r.choices(b"abcdef", k=12))
        batches = [[(a, a + r.randint(0, 3), r.choice([b"", b"X", b"YY"]), r.choice([0, 0, 1])) for a in [r.randint(0, 12)]] for _ in range(4)]
        new, states = edits.apply_edits(text, batches)
        taken = [b[0] for b, s in zip(batches, states) if s == "applied"]
        want = text
        for a, b, t, _ in sorted(taken, key=lambda e: (e[0], e[1]), reverse=True):
            want = want[:a] + t + want[b:]
        assert len(new) == len(text) + sum(len(t) - (b - a) for a, b, t, _ in taken) and all(s != "applied" or b[0][3] == 0 for b, s in zip(batches, states))
        for i, x in enumerate(taken):
            assert not any(edits.clash(x, y) for y in taken[:i])
    assert edits.apply_edits(b"hello", [[(0, 1, b"J", 0)], [(0, 2, b"", 0)], [(4, 9, b"", 0)], [(5, 5, b"!", 2)]]) == (b"Jello", ["applied", "overlap", "out_of_bounds", "unsafe"])


def test_fixed_files(spark):
    f = spark.createDataFrame([(1, b"hello"), (2, b"same"), (3, None)], "file_id bigint, contents binary")
    e = spark.createDataFrame([(1, 1, 0, 1, "J", 0), (1, 2, 0, 2, "", 0), (9, 1, 0, 1, "", 0)], "file_id bigint, issue bigint, start int, stop int, new_text string, safety int")
    assert [(r.file_id, bytes(r.contents), r.applied, r.skipped) for r in edits.fixed(f, e).collect()] == [(1, b"Jello", 1, 1)]


TEXT = """code // @tool-ignore lint:a
// @tool-ignore lint:b(2)
x
y
z
# @tool-expect lint:c
w
// @tool-ignore all
// @tool-ignore other:a
// @tool-ignore lint:unused,d
"""


def test_pragmas(spark):
    own = pragmas.parse(TEXT, "tool", ("lint",))
    assert [(p.kind, p.code, p.line, p.own_line, p.expected) for p in own] == [("ignore", "a", 0, False, 1), ("ignore", "b", 1, True, 2), ("expect", "c", 5, True, 1), ("ignore", "all", 7, True, 0), ("ignore", "unused", 9, True, 1), ("ignore", "d", 9, True, 1)]
    found = [("lint", "a", 0), ("lint", "a", 0), ("lint", "b", 2), ("lint", "b", 3), ("lint", "b", 4), ("lint", "c", 6), ("lint", "q", 8), ("lint", "d", 12)]
    gone, rest = pragmas.reconcile(own, found)
    assert gone == [True, False, True, True, False, True, True, True] and [p.code for p in rest] == ["unused"]
    f = spark.createDataFrame([(1, TEXT), (2, None)], "file_id bigint, text string")
    i = spark.createDataFrame([(1, *x, n) for n, x in enumerate(found)] + [(2, "lint", "a", 0, 0)], "file_id bigint, category string, code string, line int, ordinal bigint")
    assert sorted((r.file_id, r.code, r.line) for r in pragmas.suppress(f, i, "tool", ("lint",)).collect()) == [(1, "a", 0), (1, "b", 4), (1, "unused-pragma", 9), (2, "a", 0)]


def test_unused_members(spark):
    members = [("A", m, True) for m in "abcdef"] + [("B", "x", True), ("A", "pub", False)]
    refs = [("A", "b", "A", "a"), ("A", "c", "A", "b"), ("A", "d", "A", "e"), ("A", "e", "A", "d"), ("A", "f", "A", "pub"), ("B", "x", "A", "a")]
    m = spark.createDataFrame(members, "owner string, member string, checkable boolean")
    r = spark.createDataFrame(refs, "owner string, member string, src_owner string, src_member string")
    assert sorted(x.member for x in references.unused_members(m, r).collect()) == ["a", "b", "c"]


def test_closure_of_cycles_and_deep_chains(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "x")] + [(f"n{i}", f"n{i + 1}") for i in range(150)], "child string, parent string")
    got = {(r.descendant, r.ancestor): r.depth for r in catalog.closure(df).collect()}
    assert got["a", "c"] == 2 and ("x", "x") not in got and got["n0", "n150"] == 150 and len([k for k in got if k[0][0] == "n"]) == 150 * 151 // 2
    assert catalog.closure(df.limit(0)).count() == 0


def test_cascade_gives_up(spark):
    refs = spark.createDataFrame([(f"s{i + 1}", f"s{i}", True) for i in range(20)] + [("body", "s20", False)], "src string, dst string, in_signature boolean")
    changed = spark.createDataFrame([("s0",)], "symbol string")
    assert references.cascade(changed, refs, 10) is None and references.cascade(changed, refs).count() == 22


def test_namespace_patterns(spark):
    import re

    for pattern, yes, no in (("A\\*", ["A\\B", "a\\b"], ["A", "A\\B\\C"]), ("A\\**", ["A", "A\\B\\C"], ["B"]), ("A\\*Test", ["A\\MyTest"], ["A\\MyTests"]), ("{A,B}\\C", ["A\\C", "B\\C"], ["C\\C"]), ("**\\X", ["X", "A\\B\\X"], ["X\\A"])):
        regex = names.namespace_regex(pattern)
        assert all(re.match(regex, y) for y in yes), (pattern, regex)
        assert not any(re.match(regex, y) for y in no), (pattern, regex)
    assert re.match(names.namespace_regex("A", prefix=True), "A\\B") and not re.match(names.namespace_regex("A", prefix=True), "AB")
    for glob, yes, no in (("src/**/*.x", ["src/a.x", "src/a/b.x"], ["src/a.y", "b/src/a.x"]), ("*.[xy]", ["a.x"], ["a.z", "b/a.x"]), ("a/{b,c}/?", ["a/b/d"], ["a/d/e"])):
        assert all(re.match(names.glob_regex(glob), y) for y in yes) and not any(re.match(names.glob_regex(glob), y) for y in no)


def test_guard_over_parsed_sources(spark):
    src = b"<?php namespace App\\Ui; use App\\Db\\Pool; class Page extends Base { function f(Pool $p): \\App\\Core\\Item { return new \\App\\Core\\Item(); } }"
    edges = tables.reference_table(spark.createDataFrame([(1, src)], "file_id bigint, contents binary"))
    found = guard.perimeter(edges, guard.Guard(rules=(guard.Rule("App\\Ui", ("@self", "App\\Core")),))).collect()
    assert {(r.target, r.reason) for r in found} == {("App\\Db\\Pool", "forbidden_by_rule")}


def test_scan(spark, tmp_path):
    for name in ("src/a.php", "src/b/c.php", "src/b/d.txt", "src/vendor/e.php", "one.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    got = files.scan(spark, str(tmp_path), ["src", "one.txt"], ["php"], ["src/vendor"])
    assert {r.name: bytes(r.contents).decode() for r in got.collect()} == {n: n for n in ("src/a.php", "src/b/c.php", "one.txt")}


def test_lines_of_each_convention(spark):
    df = spark.createDataFrame([(1, "a\nb\r\nc"), (2, "a\rb\rc\nd"), (3, ""), (4, None), (5, "é\n")], "k bigint, t string")
    got: dict = {}
    for r in files.line_table(df, "k", "t").collect():
        got.setdefault(r.k, []).append((r.line, r.start, r.content))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(0, 0, "a"), (1, 2, "b\r"), (2, 5, "c")], 2: [(0, 0, "a"), (1, 2, "b"), (2, 4, "c\nd")], 3: [(0, 0, "")], 4: [(0, 0, "")], 5: [(0, 0, "é"), (1, 3, "")]}


def test_kan_defect_and_halstead_without_operands(spark):
    nodes = spark.createDataFrame([("f", "while")] * 7 + [("g", "if")], "owner string, kind string")
    assert [tuple(r) for r in metrics.kan_defect(nodes).collect()] == [("f", 1.76)]
    rows = spark.createDataFrame([("f", "binary", None)], "owner string, operator string, operand string")
    assert metrics.halstead(rows).first()["volume"] == 0.0


def test_change_stream(spark, tmp_path):
    feed = tmp_path / "feed"
    shape = "ts timestamp, file_id bigint, op string, payload string"

    def put(rows):
        spark.createDataFrame(rows, "ts string, file_id bigint, op string, payload string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(feed))

    own = changes.Catalog(spark, str(tmp_path / "catalog"))
    own.start(spark.createDataFrame([(1, "one"), (2, "two")], "file_id bigint, payload string"))
    for rows in ([("2024-01-01 00:00:01", 1, "update", "ONE"), ("2024-01-01 00:00:02", 3, "add", "three"), ("2024-01-01 00:00:00", 1, "delete", None)], [("2024-01-01 00:00:05", 2, "delete", None)]):
        put(rows)
        query = changes.keep_up(spark.readStream.schema(shape).parquet(str(feed)), own.handle, str(tmp_path / "check"))
        assert query.awaitTermination(120)
    assert {r.file_id: r.payload for r in own.at(2).collect()} == {1: "ONE", 3: "three"}
    assert spark.createDataFrame([("a/vendor/x.php",), ("a/x.php",), ("a/x.txt",)], "n string").where(changes.watched(F.col("n"), ["php"])).count() == 1


def test_loose_baseline_numbers_issues_across_ranges(spark, monkeypatch):
    from corpuscope.operators import baseline

    monkeypatch.setattr(baseline, "RANGE", 7)
    rows = [("a", "c", "m", i) for i in range(40)] + [("a", "c", "other", i) for i in range(100, 103)] + [("b", "c", "m", i * 5) for i in range(20)]
    found = spark.createDataFrame(rows, "file string, code string, message string, ordinal bigint")
    held = spark.createDataFrame([("a", "c", "m", 25), ("b", "c", "m", 18)], "file string, code string, message string, count bigint")
    got = sorted((r.file, r.message, r.ordinal) for r in baseline.loose_filter(found, held).collect())
    assert got == sorted([("a", "m", i) for i in range(25, 40)] + [("a", "other", i) for i in range(100, 103)] + [("b", "m", 90), ("b", "m", 95)])


def test_grown_ends_on_cycles_and_keeps_the_first_step(spark):
    from corpuscope.operators import catalog

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", "x"), (None, "a")], "child string, parent string")
    got = {(r.descendant, r.ancestor): r.depth for r in catalog.closure(edges).collect()}
    assert got[("a", "b")] == 1 and got[("a", "c")] == 1 and got[("b", "a")] == 2 and ("x", "x") not in got
