"""Literals, versions and the workspace."""

import json
import subprocess
from decimal import Decimal

from pyspark.sql import functions as F

from corpuscope.functions import literals
from corpuscope.sources import workspace


def test_numbers(spark):
    cases = {"0": 0, "1_000": 1000, "0x1F": 31, "0b101": 5, "0o17": 15, "017": 15, "00": 0, "18446744073709551615": 2**64 - 1, "18446744073709551616": None, "0xFFFFFFFFFFFFFFFF": 2**64 - 1, "0x1FFFFFFFFFFFFFFFF": None, "089": None, "x": None, "1777777777777777777777": 10**21 and None, "01777777777777777777777": 2**64 - 1}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.v for r in df.select("t", literals.integer_literal(F.col("t")).alias("v")).collect()}
    assert got == {k: None if v is None else Decimal(v) for k, v in cases.items()}
    floats = {"1.5": 1.5, ".5": 0.5, "1e3": 1000.0, "1_0.2_5": 10.25, "1.": 1.0, "abc": None}
    df = spark.createDataFrame([(k,) for k in floats], "t string")
    assert {r.t: r.v for r in df.select("t", literals.float_literal(F.col("t")).alias("v")).collect()} == floats


def test_texts(spark):
    cases = {"'a\\'b\\\\c\\n'": "a'b\\c\\n", '"a\\n\\x41\\101\\u{e9}\\q"': "a\nAAé\\q", 'b"x"': "x", "plain": None, "''": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.v for r in df.select("t", literals.decoded(F.col("t")).alias("v")).collect()} == cases
    df = spark.createDataFrame([(b"a\x00\xff\n\\",)], "t binary")
    assert df.select(literals.printable(F.col("t"))).first()[0] == "a\\x00\\xff\\n\\\\"


def test_versions(spark):
    df = spark.createDataFrame([("8.1",), ("8.10.2",), ("7.4.33-dev",), ("x",)], "v string")
    assert [r[0] for r in df.select(literals.version_number(F.col("v"))).collect()] == [literals.version("8.1"), literals.version("8.10.2"), literals.version("7.4.33"), None]
    assert [r.v for r in df.where(literals.in_versions(F.col("v"), "8.0", "8.5")).collect()] == ["8.1"]


def test_workspace(spark, tmp_path):
    (tmp_path / "composer.json").write_text(json.dumps({"name": "a/b", "require": {"x/y": "^1"}, "require-dev": {"t/u": "*"}, "autoload": {"psr-4": {"App\\": "src/"}}, "autoload-dev": {"psr-4": {"Tests\\": "tests/"}}}))
    m = workspace.manifest(spark, str(tmp_path / "composer.json"))
    assert sorted(tuple(r) for r in workspace.namespaces(m).collect()) == [("App\\", "src/", False), ("Tests\\", "tests/", True)]
    assert sorted(tuple(r) for r in workspace.requirements(m).collect()) == [("t/u", "*", True), ("x/y", "^1", False)]
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / "a.php").write_text("<?php")
    (tmp_path / "b.php").write_text("<?php")
    subprocess.run(["git", "-C", str(tmp_path), "add", "a.php"], check=True)
    files = spark.createDataFrame([("a.php",), ("b.php",)], "name string")
    assert [r.name for r in workspace.only_staged(files, str(tmp_path)).collect()] == ["a.php"]
