"""Semantics, whole-project checks and types."""

import random

import pytest

from corpuscope.frontend.semantics import semantics
from corpuscope.functions import types
from corpuscope.plans.project import Project

CASES = [
    ("break;", "while ($a) { break; }"), ("while ($a) { break 2; }", "while ($a) { while ($b) { break 2; } }"), ("goto x;", "x: goto x;"), ("try { f(); }", "try { f(); } finally { g(); }"), ("switch ($a) { default: default: }", "switch ($a) { default: }"), ("$this = 1;", "$a = 1;"), ("f() = 1;", "$a->b = 1;"),
    ("[] = $a;", "[$x] = $a;"), ("['a' => $x, $y] = $a;", "['a' => $x] = $a;"), ("f(a: 1, 2);", "f(2, a: 1);"), ("f(a: 1, a: 2);", "f(a: 1, b: 2);"), ("f(...$a, $b);", "f($b, ...$a);"), ("function f($a, $a) {}", "function f($a, $b) {}"), ("function f(...$a, $b) {}", "function f($b, ...$a) {}"),
    ("class A { function f(private $a) {} }", "class A { function __construct(private $a) {} }"), ("function f(void $a) {}", "function f(mixed $a) {}"), ("function f(?int|string $a) {}", "function f(int|string|null $a) {}"), ("function f(int|int $a) {}", "function f(int|float $a) {}"), ("function f(): void { return 1; }", "function f(): void { return; }"),
    ("function f(): never { return; }", "function f(): never { throw $e; }"), ("function f(): int { return; }", "function f(): int { return 1; }"), ("$f = function() use ($a, $a) {};", "$f = function() use ($a, $b) {};"), ("const A = f();", "const A = 1 + 2;"), ("class self {}", "class A {}"), ("abstract final class A {}", "final class A {}"),
    ("class A extends B, C {}", "interface A extends B, C {}"), ("class A { function f() {} function F() {} }", "class A { function f() {} function g() {} }"), ("class A { public $a; public $a; }", "class A { public $a; public $b; }"), ("enum A { case B = 1; }", "enum A: int { case B = 1; }"), ("enum A: int { case B; }", "enum A { case B; }"),
    ("enum A: int { case B = 1; case C = 1; }", "enum A: int { case B = 1; case C = 2; }"), ("interface A { function f() {} }", "interface A { function f(); }"), ("class A { abstract function f(); }", "abstract class A { abstract function f(); }"), ("class A { function f(); }", "class A { function f() {} }"), ("class A { function __get() {} }", "class A { function __get($a) {} }"),
    ("class A { readonly $a; }", "class A { readonly int $a; }"), ("class A { readonly int $a = 1; }", "class A { public int $a = 1; }"), ("$a = 089;", "$a = 077;"), ("use A\\B; use C\\B;", "use A\\B; use C\\B as D;"), ("isset(f());", "isset($a);"), ("$f = static fn() => $this;", "$f = fn() => $this;"), ("declare(foo=1);", "declare(ticks=1);"), ("$a; declare(strict_types=1);", "declare(strict_types=1); $a;"),
]


@pytest.mark.parametrize("bad,good", CASES)
def test_semantics(bad, good):
    assert [i for i in semantics("<?php " + bad) if i[0] == "semantics"]
    assert not semantics("<?php " + good)


def test_project(spark):
    sources = [
        "<?php namespace A; interface I { function m(); } abstract class B implements I { abstract function n(); } class C extends B { function n() {} } final class D {} class E extends D { use T; } trait T {}",
        "<?php namespace A; class C {} function f() { new B(); new Gone(); missing(); strlen('x'); f(); } class X extends Y {} class Y extends X {} class K implements D {}",
    ]
    files = spark.createDataFrame([(i, s.encode()) for i, s in enumerate(sources)], "file_id bigint, contents binary")
    known = spark.createDataFrame([("strlen", "function")], "name string, kind string")
    found = {(r.code, r.message) for r in Project(files, known).all().collect()}
    assert found == {
        ("non-existent-class-like", "No class A\\Gone."), ("non-existent-function", "No function A\\missing."), ("duplicate-definition", "A\\C is defined already."), ("extend-final-class", "A\\D is final."), ("abstract-instantiation", "A\\B cannot be made."),
        ("unimplemented-abstract-method", "A\\C lacks m."), ("circular-inheritance", "A\\X is its own ancestor."), ("circular-inheritance", "A\\Y is its own ancestor."), ("invalid-parent-kind", "A\\D is of kind class."),
    }


ATOMS = ["int", "string", "bool", "true", "false", "float", "null", "void", "never", "mixed", "int(1)", "int(2)", "int<0,5>", "int<6,max>", "string(a)", "list<int>", "array<string,int>", "array", "scalar", "App\\A"]


def test_combine_laws():
    r = random.Random(1)
    for _ in range(2000):
        some = r.choices(ATOMS, k=r.randint(0, 6))
        one = types.combine(some)
        shuffled = r.sample(some, len(some))
        assert types.combine(shuffled) == one == types.combine(one)
        assert types.union_contained([a for a in some if a not in ("void", "never")], one) or "mixed" in one


@pytest.mark.parametrize(
    "atoms,union",
    [([], ["never"]), (["never", "int"], ["int"]), (["void"], ["void"]), (["void", "int"], ["int", "null"]), (["true", "false"], ["bool"]), (["int", "float", "string", "bool"], ["scalar"]), (["int<0,5>", "int<6,max>"], ["int<0,max>"]), (["int(1)", "int(2)"], ["int(1)", "int(2)"]), ([f"int({i})" for i in range(200)], ["int"]), (["string(a)", "string"], ["string"]), (["int", "mixed"], ["mixed"])],
)
def test_combine(atoms, union):
    assert types.combine(atoms) == union


def test_containment():
    up = {"app\\b": {"app\\a"}}
    for a, c, yes in (("int(3)", "int", True), ("int<0,5>", "int<0,9>", True), ("int", "int<0,9>", False), ("true", "bool", True), ("list<int(1)>", "array<int,int>", True), ("array<string,int>", "list<int>", False), ("App\\B", "App\\A", True), ("App\\A", "App\\B", False), ("null", "mixed", True), ("App\\A", "object", True)):
        assert types.contained(a, c, up) is yes, (a, c)
    assert types.union_contained(["bool"], ["true", "false"]) and not types.union_contained(["int", "string"], ["int"])
    assert types.overlap(["int<0,5>"], ["int<5,9>"]) and not types.overlap(["int(1)"], ["string"])


def test_native_combine(spark):
    plain = [a for a in ATOMS if "(" not in a and "<" not in a]
    r = random.Random(2)
    rows = [(i, r.choices(plain, k=r.randint(0, 5))) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, a array<string>")
    got = {x.k: x.u for x in df.select("k", types.combined_scalars(df["a"]).alias("u")).collect()}
    assert all(got[i] == types.combine(a) for i, a in rows)
