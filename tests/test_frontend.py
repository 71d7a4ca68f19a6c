"""The front end on sources of our own."""

import pytest

from corpuscope.frontend import lint as lint_module
from corpuscope.frontend import tables
from corpuscope.frontend.lint import lint
from corpuscope.frontend.syntax import parse
from corpuscope.frontend.tokens import tokens

SOURCE = r"""<?php
declare(strict_types=1);
namespace App\Models;
use Lib\{Base, Tool as Kit}; use function strlen; use const X\Y;
#[Attr(1, name: 2)]
final class Item extends Base implements One, Two { use T1, T2 { T1::x insteadof T2; } const int Z = 1, W = 2;
 public function __construct(private readonly int $a = 3, public ?string $b = null, string ...$rest) {}
 protected static ?array $p = [1, 2, 'a' => [3]]; public string $h { get => $this->h; set(string $v) { $this->h = $v; } }
 abstract public function foo(int|string $x, A&B $y, &$z): static; }
enum Suit: string { case Hearts = 'H'; public static function f(): self { return self::Hearts; } }
function run($x) { if ($x > 1 && !$y) { return $x ?? 2; } elseif ($z) { echo "a $b {$c}"; } else { throw new \Exception('e'); }
 foreach ($a as $k => [$m, $n]) { $t .= $k ? 'x' : 'y'; $i++; } for ($i = 0, $j = 1; $i < 10; ++$i): print $i; endfor;
 switch ($x) { case 1: break; default: return; } while (true) do { $x--; } while ($x);
 try { g(...); h(?, x: ?); $o?->m()->n['a'][] = static fn(int $q): int => $q * 2 ** 3; } catch (E|F $e) { } finally { unset($a, $b); }
 return match(true) { $a, $b => 1, default => fn() => yield $x, }; }
$f = function() use (&$x, $y) { return yield from g(); };
$z = new class(1) extends Base { }; list($a, , $b) = $c; [$a, 'k' => $b] = $d; $x = <<<EOT
hi $name
EOT;
$y = (int) $x instanceof Foo; @foo(); `ls`; goto end; end: echo 1 <=> 2; $$v = ${'a'.'b'}; A::$p; A::{$m}(); static::foo(); new ($x)(1); $a->{'x'} = -1; isset($a['b']) and die('x');
?><html><?= $x ?>
"""


def kinds(n):
    return [c.kind for c in n.walk()]


def test_tokens_cover_every_byte():
    for text in (SOURCE, "", "no code", "<?php", "<?php 'open", "<?php /* open", "<?= 1 ?>\nx<?php // c ?>y", "<?php $a = <<<'X'\n a\n X;"):
        at = 0
        for _, a, b in tokens(text):
            assert a == at < b
            at = b
        assert at == len(text)


def test_everything_parses():
    root, parser = parse(SOURCE)
    assert not parser.errors and len(kinds(root)) > 300
    for n in root.walk():
        assert all(n.start <= c.start <= c.stop <= n.stop for c in n.children), n.kind


@pytest.mark.parametrize(
    "code,shape",
    [
        ("1 + 2 * 3;", "binary+ integer binary* integer integer"),
        ("-2 ** 2;", "prefix- binary** integer integer"),
        ("!$a instanceof B;", "prefix! binaryinstanceof variable name"),
        ("$a = $b ?: $c ?? $d;", "assignment= variable ternary variable binary?? variable variable"),
        ("$a . $b + $c;", "binary. variable binary+ variable variable"),
        ("$a and $b = $c or $d;", "binaryor binaryand variable assignment= variable variable variable"),
        ("$a[0]->b::$c['d'](1)++;", None),
    ],
)
def test_precedence(code, shape):
    root, parser = parse("<?php " + code)
    assert not parser.errors
    if shape:
        e = root.children[-1].role("expression")
        assert " ".join(n.kind + (n.value if n.kind in ("binary", "prefix", "assignment") else "") for n in e.walk()) == shape


def test_broken_code_gives_errors_and_goes_on():
    root, parser = parse("<?php $a = ; function f() { $b = 1; } class { } $c = 2; if (")
    assert len(parser.errors) >= 2 and "function" in kinds(root)
    for bad in ("<?php {", "<?php )", "<?php class A {", "<?php function", "<?php " + "(" * 50000, "<?php \x00\xff"):
        parse(bad)


CASES = {
    "combine-consecutive-issets": ("isset($a) && isset($b);", "isset($a, $b);"), "loop-does-not-iterate": ("while ($a) { break; }", "while ($a) { f(); }"), "no-ini-set": ("ini_set('a', 'b');", "f();"),
    "no-sprintf-concat": ("$a = 'x' . sprintf('%s', 1);", "$a = sprintf('x%s', 1);"), "prefer-arrow-function": ("$f = function($x) { return $x; };", "$f = fn($x) => $x;"), "prefer-early-continue": ("foreach ($a as $b) { if ($b) { f(); } }", "foreach ($a as $b) { f(); g(); }"),
    "prefer-first-class-callable": ("$f = fn($x) => $o->m($x);", "$f = $o->m(...);"), "prefer-while-loop": ("for (; $a;) { f(); }", "while ($a) { f(); }"), "use-compound-assignment": ("$a = $a + 1;", "$a += 1;"), "single-class-per-file": ("class A {} class B {}", "class A {}"),
    "explicit-octal": ("$a = 0755;", "$a = 0o755;"), "literal-named-argument": ("f($a, 1);", "f($a, b: 1);"), "no-empty": ("empty($a);", "$a === [];"), "no-isset": ("isset($a);", "$a !== null;"), "no-multi-assignments": ("$a = $b = 1;", "$a = 1;"), "no-nested-ternary": ("$a = $b ? 1 : ($c ? 2 : 3);", "$a = $b ? 1 : 2;"),
    "no-shorthand-ternary": ("$a = $b ?: 1;", "$a = $b ?? 1;"), "no-variable-variable": ("$$a;", "$a;"), "readable-literal": ("$a = 1000000;", "$a = 1_000_000;"), "str-contains": ("strpos($a, $b) !== false;", "str_contains($a, $b);"), "str-starts-with": ("strpos($a, $b) === 0;", "str_starts_with($a, $b);"),
    "tagged-todo": ("// TODO later", "// TODO(#12) later"), "tagged-fixme": ("// FIXME later", "// FIXME(me) later"), "no-hash-comment": ("# x", "// x"), "no-empty-comment": ("/* */", "/* x */"), "no-trailing-space": ("// x  \n$a;", "// x\n$a;"), "array-style": ("array(1);", "[1];"), "block-statement": ("if ($a) f();", "if ($a) { f(); }"),
    "braced-string-interpolation": ('"a $b";', '"a {$b}";'), "class-name": ("class foo_bar {}", "class FooBar {}"), "constant-name": ("const foo = 1;", "const FOO = 1;"), "function-name": ("function Foo_Bar() {}", "function foo_bar() {}"), "lowercase-keyword": ("IF ($a) { f(); }", "if ($a) { f(); }"), "lowercase-type-hint": ("function f(INT $a) {}", "function f(int $a) {}"),
    "no-alias-function": ("join(',', $a);", "implode(',', $a);"), "no-php-tag-terminator": ("$a ?><?php $b;", "$a; $b;"), "assert-description": ("assert($a);", "assert($a, 'why');"), "identity-comparison": ("$a == $b;", "$a === $b;"), "no-assign-in-condition": ("if ($a = f()) { g(); }", "if ($a) { g(); }"),
    "no-empty-catch-clause": ("try { f(); } catch (E $e) { }", "try { f(); } catch (E $e) { g(); }"), "no-missing-format-argument": ("sprintf('%s %d', $a);", "sprintf('%s %d%%', $a, $b);"), "strict-types": ("$a;", "declare(strict_types=1); $a;"), "strict-behavior": ("in_array($a, $b);", "in_array($a, $b, true);"), "suspicious-explode-arguments": ("explode($a, ',');", "explode(',', $a);"),
    "deprecated-cast": ("(integer) $a;", "(int) $a;"), "deprecated-switch-semicolon": ("switch ($a) { case 1; f(); }", "switch ($a) { case 1: f(); }"), "explicit-nullable-param": ("function f(int $a = null) {}", "function f(?int $a = null) {}"), "optional-param-order": ("function f($a = 1, $b) {}", "function f($a, $b = 1) {}"), "no-goto": ("a: goto a;", "$a;"),
    "excessive-parameter-list": ("function f($a, $b, $c, $d, $e, $f) {}", "function f($a, $b, $c, $d, $e) {}"), "no-else-clause": ("if ($a) { f(); } else { g(); }", "if ($a) { f(); }"), "constant-condition": ("if (true) { f(); }", "if ($a) { f(); }"), "no-closing-tag": ("$a; ?>", "$a;"), "no-empty-loop": ("while ($a) { }", "while ($a) { f(); }"), "no-noop": ("$a;;", "$a;"),
    "no-redundant-continue": ("while ($a) { f(); continue; }", "while ($a) { f(); }"), "no-redundant-final": ("final class A { final function f() {} }", "class A { final function f() {} }"), "no-redundant-math": ("$a * 1;", "$a * 2;"), "no-redundant-method-override": ("class A extends B { function f($x) { return parent::f($x); } }", "class A extends B { function f($x) { return parent::f(1); } }"),
    "no-redundant-parentheses": ("$a = ($b + 1);", "$a = ($b + 1) * 2;"), "no-redundant-string-concat": ("'a' . 'b';", "'a' . $b;"), "no-redundant-use": ("use A\\B; $a;", "use A\\B; new B();"), "no-self-assignment": ("$a = $a;", "$a = $b;"), "no-error-control-operator": ("@f();", "f();"), "no-eval": ("eval($a);", "f($a);"), "no-global": ("function f() { global $a; }", "function f() { }"),
    "no-request-variable": ("$_REQUEST['a'];", "$_GET['a'];"), "no-shell-execute-string": ("`ls`;", "f();"), "no-unsafe-finally": ("try { f(); } finally { return 1; }", "try { f(); } finally { g(); }"), "no-debug-symbols": ("var_dump($a);", "f($a);"), "no-insecure-comparison": ("$password === $b;", "$a === $b;"), "no-literal-password": ("$password = 'abc';", "$password = f();"), "require-preg-quote-delimiter": ("preg_quote($a);", "preg_quote($a, '/');"),
    "sensitive-parameter": ("function f($password) {}", "function f(#[\\SensitiveParameter] $password) {}"), "tainted-data-to-sink": ("echo $_GET['a'];", "echo f($_GET['a']);"), "inline-variable-return": ("function f() { $a = 1; return $a; }", "function f() { return 1; }"), "no-duplicate-match-arm": ("match ($a) { 1 => 2, 3 => 2 };", "match ($a) { 1 => 2, 3 => 4 };"),
    "no-redundant-isset": ("isset($a, $a['b']);", "isset($a['b']);"), "no-protected-in-final": ("final class A { protected $a; }", "class A { protected $a; }"), "no-dead-store": ("function f() { $a = 1; $a = 2; return $a; }", "function f() { $a = 1; g($a); $a = 2; return $a; }"), "no-redundant-variable": ("function f() { $a = 1; }", "function f() { $a = 1; g($a); }"),
    "switch-continue-to-break": ("switch ($a) { case 1: continue; }", "switch ($a) { case 1: break; }"), "psl-string-functions": ("strlen($a);", "f($a);"), "no-direct-db-query": ("$wpdb->query($a);", "$db->query($a);"), "strict-assertions": ("$this->assertEquals(1, $a);", "$this->assertSame(1, $a);"), "no-only": ("test('a', f())->only();", "test('a', f());"),
}


@pytest.mark.parametrize("code", list(CASES))
def test_rule(code):
    bad, good = CASES[code]
    assert code in {i[0] for i in lint("<?php " + bad, everything=True)}
    assert code not in {i[0] for i in lint("<?php " + good, everything=True)} - {"syntax"}
    assert "syntax" not in {i[0] for i in lint("<?php " + good) + lint("<?php " + bad)}


def test_metrics():
    body = " ".join(f"if ($a{i}) {{ f(); }}" for i in range(16))
    assert "cyclomatic-complexity" in {i[0] for i in lint(f"<?php function f() {{ {body} }}")}
    assert "cyclomatic-complexity" not in {i[0] for i in lint(f"<?php function f() {{ {body[: body.rfind('if')]} }}")}
    n = next(c for c in parse("<?php function f($x) { $a = $x + 1; return $a; }")[0].walk() if c.kind == "function")
    assert lint_module.halstead(n) == (round(7 * __import__("math").log2(6), 2), round(3 / 2 * 4 / 3, 2), round(7 * __import__("math").log2(6) * 2, 2))


def test_tables(spark):
    files = spark.createDataFrame([(1, "a.php", SOURCE.encode()), (2, "b.php", b""), (3, "c.php", b"<?php class {"), (4, "d.php", None)], "file_id bigint, name string, contents binary")
    nodes = tables.node_table(files)
    assert nodes.where("parent_id is null").count() == 4 and nodes.where("file_id = 1").count() == len(kinds(parse(SOURCE)[0]))
    assert nodes.alias("n").join(nodes.alias("p"), "file_id").where("n.parent_id = p.node_id and n.depth != p.depth + 1").count() == 0
    assert tables.token_table(files).where("file_id = 1").count() == len(tokens(SOURCE))
    assert tables.error_table(files).select("file_id").distinct().collect()[0][0] == 3
    symbols = {(r.name, r.kind, r.owner) for r in tables.symbol_table(files).collect()}
    assert {("App\\Models\\Item", "class", None), ("foo", "method", "App\\Models\\Item"), ("$a", "property", "App\\Models\\Item"), ("Hearts", "enum_case", "App\\Models\\Suit"), ("App\\Models\\run", "function", None)} <= symbols
    edges = {(r.child, r.edge_kind, r.parent) for r in tables.class_edges(tables.symbol_table(files)).collect()}
    assert ("App\\Models\\Item", "extends", "Lib\\Base") in edges and ("App\\Models\\Item", "implements", "App\\Models\\Two") in edges
    refs = {(r.source, r.target, r.vector) for r in tables.reference_table(files).collect()}
    assert {("App\\Models\\run", "Exception", "instantiation"), ("App\\Models\\Item", "Lib\\Base", "extends"), ("App\\Models\\Item::foo", "App\\Models\\B", "parameter_type")} <= refs
    assert {(r.fqn, r.imported) for r in tables.name_table(files).collect()} >= {("Lib\\Base", True), ("Exception", False)}
    issues = lint_module.lint_files(files).collect()
    assert {i.file_id for i in issues} >= {1, 3} and all(i.file == "a.php" for i in issues if i.file_id == 1)


def test_signatures_follow_what_they_should():
    def of(body, sign="int $a", note=""):
        return {(s, m): (h, g) for s, m, h, g in tables.signature_rows(f"<?php {note} class A {{ function f({sign}) {{ {body} }} }}".encode())}

    a, same, body, sign = of("return 1;"), of("return  1 ;", note="/* x */"), of("return 2;"), of("return 1;", "int $b")
    key = ("a", "f")
    assert a == same and a[key][1] == body[key][1] and a[key][0] != body[key][0] and a[key][1] != sign[key][1]


def test_structural_fingerprints(spark):
    one = b"<?php namespace A; use B\\C as D; use function B\\g;\nclass X extends D { /** @return D */ public function m(D|int $x): D { return g(new D, 'Some Text', D::Z); } #[D(1)] private ?D $p; }"
    same = b"<?php\nnamespace A;\nuse B\\C;\nuse B;\n// a note\nCLASS X extends C {\n  public function m(\\B\\c|int $x): B\\C { /* why */ return \\B\\g(new C, 'Some Text', C::Z); }\n #[C(1)] private ?C $p; }"
    text, body, other = one.replace(b"Some Text", b"some text"), one.replace(b"new D,", b"new D, 1,"), one.replace(b"B\\C as D", b"B\\E as D")
    files = spark.createDataFrame(list(enumerate([one, same, text, body, other])), "file_id bigint, contents binary")
    table = tables.fingerprint_table(files)
    got = {(r.file_id, r.member): (r.fingerprint, r.signature_fingerprint) for r in table.collect()}
    assert len({m for _, m in got}) == 3
    for m in {m for _, m in got}:
        assert got[0, m] == got[1, m] and got[0, m][0] != got[4, m][0]
    for m in (None, "m"):
        assert len({got[i, m][0] for i in (0, 2, 3, 4)}) == 4 and got[0, m][1] == got[2, m][1] == got[3, m][1] != got[4, m][1]
    documented = {(r.file_id, r.member): r.fingerprint for r in tables.fingerprint_table(files, docblocks=True).collect()}
    assert documented[0, "m"] != documented[1, "m"]
    assert {(r.copies, r.file_id, r.member) for r in tables.structural_duplicates(table.where("file_id < 2")).collect()} == {(2, 0, m) for _, m in got}
