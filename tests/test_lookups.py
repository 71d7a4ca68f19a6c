"""Catalog look-ups, the reference table and extension points."""

from collections import Counter

from pyspark.sql import functions as F

from corpuscope.frontend import tables
from corpuscope.functions.names import ascii_lower
from corpuscope.operators import catalog, lookups
from corpuscope.plans.extensions import Registry

SOURCE = rb"""<?php namespace App;
interface I { const K = 1; function m(); } abstract class B implements I { protected $p; final public function n() {} private function q() {} }
final class C extends B { public function m() {} public function N2() {} } trait T {} enum E { case One; } function f() {} const LIMIT = 3; function strlen() {}"""


def made(spark):
    files = spark.createDataFrame([(1, SOURCE), (2, b"<?php function g() {}")], "file_id bigint, contents binary")
    symbols = tables.symbol_table(files).cache()
    edges = tables.class_edges(symbols).select(ascii_lower(F.col("child")).alias("child"), ascii_lower(F.col("parent")).alias("parent"))
    return lookups.Catalog(symbols, catalog.closure(edges))


def test_catalog(spark):
    c = made(spark)

    def ask(*names):
        return spark.createDataFrame([(n,) for n in names], "name string")

    def yes(df):
        return sorted(r["name"] for r in df.collect() if r["exists"])

    assert yes(c.exists(ask("app\\c", "\\App\\B", "App\\I", "Gone"), "class")) == ["\\App\\B", "app\\c"]
    assert yes(c.class_like_exists(ask("App\\I", "App\\T", "App\\E", "App\\f"))) == ["App\\E", "App\\I", "App\\T"]
    assert yes(c.exists(ask("app\\LIMIT", "App\\limit"), "constant")) == ["app\\LIMIT"]
    assert yes(c.namespace_exists(ask("APP", "App\\C", "Other"))) == ["APP"]
    assert {r["name"]: r["full_name"] for r in c.get_function(ask("App\\f", "App\\g", "App\\strlen", "h")).collect()} == {"App\\f": "App\\f", "App\\g": "g", "App\\strlen": "App\\strlen"}
    assert [r["full_name"] for r in c.get(ask("APP\\e"), "enum").collect()] == ["App\\E"]
    m = spark.createDataFrame([("App\\C", "n"), ("App\\C", "M"), ("App\\C", "gone"), ("App\\B", "m")], "name string, member string")
    got = {(r["name"], r["member"]): (r["declared_by"], r["depth"]) for r in c.get_member(m).collect()}
    assert got == {("App\\C", "n"): ("app\\b", 1), ("App\\C", "M"): ("app\\c", 0), ("App\\B", "m"): ("app\\i", 1)}
    assert [r["exists"] for r in c.member_exists(spark.createDataFrame([("App\\C", "$p")], "name string, member string"), "property").collect()] == [True]
    own = c.members("method")
    assert {r["member"] for r in own.where(c.is_final(F.col("flags"))).collect()} == {"n"} and own.where((c.visibility(F.col("flags")) == "private") & (F.col("class") == "app\\b")).count() == 1
    assert {(r["owner"], r["member"]) for r in c.overriding().collect()} == {("app\\c", "m")}
    pairs = spark.createDataFrame([("App\\C", "App\\I"), ("App\\I", "App\\C"), ("App\\T", "App\\T")], "name string, other string")
    assert sorted((r["name"], r["is_instance"]) for r in c.is_instance_of(pairs).collect()) == [("App\\C", True), ("App\\I", False), ("App\\T", True)]
    assert {r["ancestor"] for r in c.ancestors(ask("App\\C")).collect()} == {"app\\b", "app\\i"} and {r["descendant"] for r in c.descendants(ask("App\\I")).collect()} == {"app\\b", "app\\c"}
    assert {r["name"] for r in c.inheritable().collect()} == {"App\\B"}


def test_reference_table(spark):
    shape = "file_id bigint, src string, src_member string, dst string, dst_member string, kind string, in_signature boolean"
    refs = spark.createDataFrame([(1, "A", "m", "B", "p", "write", False), (1, "A", "m", "B", "q", "read", False), (2, "C", None, "B", None, "symbol", True), (2, "C", "x", "B", "p", "write", False)], shape)
    assert {(r["dst"], r["dst_member"]) for r in lookups.write_only(refs).collect()} == {("B", "p")}
    assert lookups.extend(refs, refs).count() == 4 and lookups.to_symbol(refs, "b").count() == 4
    changed = spark.createDataFrame([(1,)], "file_id bigint")
    assert lookups.without_files(refs, changed).count() == 2 == lookups.of_files(refs, changed).count()
    c = spark.createDataFrame([("C",)], "src string")
    assert lookups.without_invalid(refs, c).count() == 2 and lookups.without_bodies(refs, c).count() == 3
    assert lookups.restored(lookups.without_invalid(refs, c), refs, c).count() == 4


class Kinds:
    def start(self):
        return Counter()

    def collect(self, state, root):
        return state + Counter(n.kind for n in root.walk() if n.kind in ("class", "function"))

    def merge(self, a, b):
        return a + b

    def finish(self, state):
        return sorted((k, 0, str(n)) for k, n in state.items())


def test_extensions(spark):
    from pyspark import cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    files = spark.createDataFrame([(i, SOURCE) for i in range(40)], "file_id bigint, contents binary").repartition(7)
    r = Registry()

    @r.on_nodes("calls", "class")
    def _(nodes):
        return nodes.select("file_id", F.lit("seen-class").alias("code"), F.lit(1).alias("level"), F.col("value").alias("message"), "start", "stop")

    r.file_hooks["short"] = lambda root, c: [("short-file", 0, "short", 0, len(c))] if len(root.children) < 20 else []
    r.filters["no-b"] = lambda issues: issues.where("message != 'B'")
    r.provide("return", "Trim", lambda calls: ["string" if c == ["string"] else "mixed" for c in calls])
    r.reducers["kinds"] = Kinds()
    found = r.filtered(r.run_node_hooks(tables.node_table(files)))
    assert found.count() == 40 and r.run_file_hooks(files).count() == 40
    calls = spark.createDataFrame([("trim", ["string"]), ("TRIM", ["int"]), ("other", [])], "target string, arguments array<string>")
    assert sorted((x["target"], x["provided"]) for x in r.provided(calls, "return").collect()) == [("TRIM", "mixed"), ("other", None), ("trim", "string")]
    assert [tuple(x) for x in r.reduced(files, "kinds", width=3).collect()] == [("class", 0, "80"), ("function", 0, "80")]


def test_ignore_entries_see_all_texts_and_skip_broken_patterns(spark):
    from corpuscope.operators import issues

    rows = [(1, "a", "plain", "try this", ["one", "two"]), (2, "a", "plain", None, ["one", "other"]), (3, None, "gone", None, None)]
    df = spark.createDataFrame(rows, "n int, code string, message string, help string, notes array<string>").withColumn("file", F.lit("f"))

    def left(*texts):
        return {r["n"] for r in issues.without_ignored(df, [issues.Ignore(text=t) for t in texts]).collect()}

    assert left("try") == {2, 3} and left("^two$|(?m)^two$") == {2, 3} and left("other", "gone") == {1}
    assert left("(?P<x>plain)", "(broken") == {1, 2, 3}
