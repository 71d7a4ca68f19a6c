"""Findings within one file."""

import pytest

from corpuscope.frontend.analysis import analyze, analyze_files

CASES = {
    "duplicate-array-key": ("$a = ['x' => 1, 'x' => 2];", "$a = ['x' => 1, 'y' => 2];"), "duplicate-switch-case": ("switch ($a) { case 1: f(); case 1: g(); }", "switch ($a) { case 1: f(); case 2: g(); }"), "duplicate-caught-type": ("try { f(); } catch (A $e) { g(); } catch (A $e) { g(); }", "try { f(); } catch (A $e) { g(); } catch (B $e) { g(); }"),
    "avoid-catching-error": ("try { f(); } catch (\\Error $e) { g(); }", "try { f(); } catch (\\Exception $e) { g(); }"), "duplicate-enum-case-value": ("enum A: int { case B = 1; case C = 1; }", "enum A: int { case B = 1; case C = 2; }"), "duplicate-named-argument": ("f(a: 1, a: 2);", "f(a: 1, b: 2);"),
    "unused-function-call": ("strlen($a);", "$b = strlen($a);"), "empty-match-expression": ("$a = match ($b) {};", "$a = match ($b) { 1 => 2 };"), "match-expression-only-default-arm": ("$a = match ($b) { default => 2 };", "$a = match ($b) { 1 => 3, default => 2 };"), "match-arm-always-true": ("$a = match (true) { true => 1, $b => 2 };", "$a = match (true) { $c => 1, $b => 2 };"),
    "unevaluated-code": ("function f() { return 1; g(); }", "function f() { if ($GLOBALS) { return 1; } g(); }"), "missing-return-statement": ("function f(int $a): int { if ($a) { return 1; } }", "function f(int $a): int { if ($a) { return 1; } else { throw new E(); } }"), "unused-statement": ("$a + 1;", "$a += 1;"), "impossible-condition": ("if (1 === 2) { f(); }", "if ($a === 2) { f(); }"),
    "redundant-condition": ("if (true) { f(); }", "if ($a) { f(); }"), "redundant-comparison": ("if ($a === $a) { f(); }", "if ($a === $b) { f(); }"), "redundant-logical-operation": ("if ($a && $a) { f(); }", "if ($a && $b) { f(); }"), "redundant-cast": ("$a = (int) 1;", "$a = (int) '1';"), "clone-inside-loop": ("while ($a) { $b = clone $c; }", "$b = clone $c;"),
    "undefined-variable": ("function f() { return $x; }", "function f() { $x = 1; return $x; }"), "undefined-variable-in-closure-use": ("function f() { return function() use ($x) { return $x; }; }", "function f($x) { return function() use ($x) { return $x; }; }"), "unused-parameter": ("function f($a) { return 1; }", "function f($a) { return $a; }"),
    "missing-parameter-type": ("function f($a) { return $a; }", "function f(int $a) { return $a; }"), "missing-property-type": ("class A { public $a; }", "class A { public int $a; }"), "missing-return-type": ("function f() {}", "function f(): void {}"), "self-outside-class-scope": ("self::f();", "class A { function g() { self::f(); } }"), "invalid-parent-type": ("class A { function g() { parent::g(); } }", "class A extends B { function g() { parent::g(); } }"),
    "yield-outside-function": ("yield 1;", "function f() { yield 1; }"), "assignment-to-this": ("$this = 1;", "$a = 1;"), "spread-in-destructuring": ("[...$a] = $b;", "[$a] = $b;"), "invalid-break": ("break;", "while ($a) { break; }"), "never-return": ("function f(): never { return; }", "function f(): never { throw $GLOBALS; }"),
}


@pytest.mark.parametrize("code", list(CASES))
def test_code(code):
    bad, good = CASES[code]
    assert code in {i[0] for i in analyze("<?php " + bad)}
    assert not {code, "syntax"} & {i[0] for i in analyze("<?php " + good)}


def test_variables_in_all_their_forms():
    fine = """function f(array $in): int {
        foreach ($in as $k => [$a, 'x' => $b]) { echo $k, $a, $b; }
        try { g(); } catch (E $e) { echo $e; }
        [$c, , $d] = h(); list($i) = h(); static $n = 0; global $conf; preg_match('/x/', $c, $m); $z = fn($q) => $q + $d; $arr[] = $m; $arr['k'] = $n;
        if (isset($maybe)) { return $i + $conf; } $w = $perhaps ?? 1; for ($j = 0; $j < 3; $j++) { echo "$j {$w}"; } return $z($arr);
    }"""
    assert not [i for i in analyze("<?php " + fine) if i[0].startswith("undefined")]


def test_files(spark):
    files = spark.createDataFrame([(1, "a.php", b"<?php function f() { return $x; }"), (2, "b.php", None)], "file_id bigint, name string, contents binary")
    assert {r.code for r in analyze_files(files).collect()} == {"undefined-variable", "missing-return-type"}
