"""One bad and one good source for each lint rule that ``test_frontend`` does not hold already."""

import pytest

from corpuscope.frontend import lint as lint_module
from corpuscope.frontend.lint import lint

CASES = {
    "final-controller": ("class UserController {}", "final class UserController {}"),
    "no-array-accumulation-in-loop": ("foreach ($a as $b) { $r = array_merge($r, $b); }", "foreach ($a as $b) { $r[] = $b; }"),
    "no-parameter-shadowing": ("function f($a) { foreach ($x as $a) { g(); } }", "function f($a) { foreach ($x as $b) { g(); } }"),
    "no-side-effects-with-declarations": ("function f() {} g();", "function f() {}"),
    "prefer-array-spread": ("$a = array_merge($b, $c);", "$a = [...$b, ...$c];"),
    "prefer-early-return": ("function f($a) { if ($a) { g(); h(); } }", "function f($a) { if (!$a) { return; } g(); }"),
    "prefer-explode-over-preg-split": ("preg_split('/,/', $a);", "preg_split('/[,;]/', $a);"),
    "prefer-pre-increment": ("$a++;", "++$a;"),
    "prefer-self-return-type": ("class A { function f(): A {} }", "class A { function f(): self {} }"),
    "prefer-static-closure": ("$f = fn($a) => g($a);", "$f = static fn($a) => g($a);"),
    "require-namespace": ("function f() {}", "namespace A; function f() {}"),
    "sorted-integer-keys": ("$a = [2 => 'b', 1 => 'a'];", "$a = [1 => 'a', 2 => 'b'];"),
    "yoda-conditions": ("$a === 1;", "1 === $a;"),
    "instanceof-stringable": ("is_object($a) && method_exists($a, '__toString');", "$a instanceof \\Stringable;"),
    "missing-docs": ("function f() {}", "/** Says what. */ function f() {}"),
    "no-negated-ternary": ("$a = !$b ? 1 : 2;", "$a = $b ? 2 : 1;"),
    "no-short-bool-cast": ("$a = !!$b;", "$a = (bool) $b;"),
    "no-hash-emoji": ("#️⃣[Attr]\n$a;", "#[Attr]\nfunction f() {}"),
    "valid-docblock": ("/** {@see A */ $a;", "/** {@see A} */ $a;"),
    "ambiguous-function-call": ("namespace A; f();", "namespace A; use function f; f();"),
    "enum-name": ("enum foo_bar {}", "enum FooBar {}"),
    "interface-name": ("interface foo_bar {}", "interface FooBar {}"),
    "trait-name": ("trait foo_bar {}", "trait FooBar {}"),
    "method-name": ("class A { function Foo_Bar() {} }", "class A { function fooBar() {} }"),
    "property-name": ("class A { public $Foo_Bar; }", "class A { public $fooBar; }"),
    "variable-name": ("$Foo_Bar = 1;", "$fooBar = 1;"),
    "no-alternative-syntax": ("if ($a): f(); endif;", "if ($a) { f(); }"),
    "no-fully-qualified-global-class-like": ("new \\Foo();", "new Foo();"),
    "no-fully-qualified-global-constant": ("$a = \\FOO;", "$a = FOO;"),
    "no-fully-qualified-global-function": ("\\strlen($a);", "strlen($a);"),
    "psl-array-functions": ("array_map($f, $a);", "f($a);"),
    "psl-data-structures": ("new \\SplStack();", "new Stack();"),
    "psl-datetime": ("time();", "now();"),
    "psl-math-functions": ("abs($a);", "f($a);"),
    "psl-output": ("printf('%s', $a);", "f($a);"),
    "psl-randomness-functions": ("mt_rand(1, 2);", "f(1, 2);"),
    "psl-regex-functions": ("preg_match('/a/', $a);", "f('/a/', $a);"),
    "psl-sleep-functions": ("usleep(5);", "f(5);"),
    "use-wp-functions": ("json_encode($a);", "wp_json_encode($a);"),
    "no-db-schema-change": ("$wpdb->query('DROP TABLE a');", "$wpdb->query('SELECT 1');"),
    "prepared-sql": ('$wpdb->query("SELECT {$a}");', "$wpdb->query('SELECT 1');"),
    "no-roles-as-capabilities": ("current_user_can('administrator');", "current_user_can('edit_posts');"),
    "no-unescaped-output": ("echo $a;", "echo esc_html($a);"),
    "nonce-verification": ("function f() { return $_POST['a']; }", "function f() { wp_verify_nonce($_POST['n']); return $_POST['a']; }"),
    "validated-sanitized-input": ("f($_POST['a']);", "f(absint($_POST['a']));"),
    "middleware-in-routes": ("class AController { function f() { $this->middleware('auth'); } }", "class A { function f() { $this->middleware('auth'); } }"),
    "no-implicit-model-query": ("use App\\Models\\User; User::where('a', 1);", "use App\\Models\\User; User::query()->where('a', 1);"),
    "prefer-anonymous-migration": ("class A extends Migration {}", "return new class extends Migration {};"),
    "prefer-casts-method": ("class A extends Model { protected $casts = []; }", "class A extends Model { protected function casts() { return []; } }"),
    "prefer-fake-helper": ("class A extends Factory { function f() { return $this->faker; } }", "class A extends Factory { function f() { return fake(); } }"),
    "prefer-array-validation-rules": ("$r->validate(['a' => 'required|string']);", "$r->validate(['a' => ['required', 'string']]);"),
    "prefer-view-array": ("view('a')->with('b', $b);", "view('a', ['b' => $b]);"),
    "no-request-all": ("$request->all();", "$request->only('a');"),
    "prefer-dedicated-status-assertion": ("$r->assertStatus(404);", "$r->assertNotFound();"),
    "prefer-interface": ("function f(DateTimeImmutable $a) {}", "function f(DateTimeInterface $a) {}"),
    "prefer-datetimeimmutable-create-from-timestamp": ("new DateTimeImmutable('@' . $t);", "DateTimeImmutable::createFromTimestamp($t);"),
    "prefer-test-attribute": ("class A { public function testIt() {} }", "class A { #[Test] public function it() {} }"),
    "assertion-style": ("$this->assertSame(1, $a);", "static::assertSame(1, $a);"),
    "use-specific-assertions": ("$this->assertSame(null, $a);", "$this->assertNull($a);"),
    "use-dedicated-expectation": ("expect(is_array($a))->toBeTrue();", "expect($a)->toBeArray();"),
    "use-simpler-expectation": ("expect($a === 1)->toBeTrue();", "expect($a)->toBe(1);"),
    "use-specific-expectations": ("expect($a)->toBe(true);", "expect($a)->toBeTrue();"),
    "no-assign-in-argument": ("f($a = 1);", "f(1);"),
    "no-unused-closure-capture": ("$f = function() use ($a) { g(); };", "$f = function() use ($a) { g($a); };"),
    "no-unused-global": ("function f() { global $a; }", "function f() { global $a; g($a); }"),
    "no-unused-static": ("function f() { static $a = 1; }", "function f() { static $a = 1; return $a; }"),
    "deprecated-shell-execute-string": ("`ls`;", "shell_exec('ls');"),
    "no-underscore-class": ("class _ {}", "class A {}"),
    "no-void-reference-return": ("function &f(): void {}", "function f(): void {}"),
    "halstead": ("function f() { " + "".join(f"$a{i} = $b{i} + {i};" for i in range(80)) + " }", "function f() { $a = 1; }"),
    "kan-defect": ("function f() { " + "while ($a) { g(); } " * 7 + "}", "function f() { while ($a) { g(); } }"),
    "excessive-nesting": ("if ($a) { " * 8 + "f();" + " }" * 8, "if ($a) { " * 7 + "f();" + " }" * 7),
    "too-many-methods": ("class A { " + "".join(f"function m{i}() {{}} " for i in range(11)) + "}", "class A { " + "".join(f"function m{i}() {{}} function getM{i}() {{}} " for i in range(10)) + "}"),
    "too-many-properties": ("class A { " + "".join(f"public $p{i}; " for i in range(11)) + "}", "class A { " + "".join(f"public $p{i}; " for i in range(10)) + "}"),
    "too-many-enum-cases": ("enum A { " + "".join(f"case C{i}; " for i in range(21)) + "}", "enum A { " + "".join(f"case C{i}; " for i in range(20)) + "}"),
    "no-boolean-flag-parameter": ("function f(bool $a) {}", "function f(int $a) {}"),
    "no-redundant-block": ("{ f(); }", "if ($a) { f(); }"),
    "no-redundant-else": ("function f() { if ($a) { return 1; } else { g(); } }", "function f() { if ($a) { g(); } else { h(); } }"),
    "no-redundant-file": (";", "f();"),
    "no-redundant-label": ("a: f();", "a: goto a;"),
    "no-redundant-readonly": ("readonly class A { public readonly int $a; }", "class A { public readonly int $a; }"),
    "no-redundant-yield-from": ("function f() { yield from [1]; }", "function f() { yield from [1, 2]; }"),
    "redundant-static": ("final class A { function f() { return new static(); } }", "class A { function f() { return new static(); } }"),
    "no-ffi": ("\\FFI::cdef('');", "A::cdef('');"),
    "no-is-null": ("is_null($a);", "$a === null;"),
    "no-iterator-to-array-in-foreach": ("foreach (iterator_to_array($a) as $b) { f(); }", "foreach ($a as $b) { f(); }"),
    "no-null-property-init": ("class A { public $a = null; }", "class A { public ?int $a = null; }"),
    "no-redundant-binary-string-prefix": ("$a = b'x';", "$a = 'x';"),
    "no-redundant-literal-return": ("function f($a) { if ($a === null) { return null; } return $a; }", "function f($a) { if ($a === null) { return 1; } return $a; }"),
    "no-redundant-nullsafe": ("$a?->b ?? 1;", "$a->b ?? 1;"),
    "no-redundant-write-visibility": ("class A { public public(set) int $a; }", "class A { public private(set) int $a; }"),
    "string-style": ("$a = 'x' . $b;", '$a = "x{$b}";'),
    "ambiguous-constant-access": ("namespace A; $a = FOO;", "namespace A; use const FOO; $a = FOO;"),
    "no-literal-namespace-string": ("$a = 'App\\\\Models\\\\User';", "$a = 'plain text';"),
    "no-service-state-mutation": ("class AService { function f() { $this->a = 1; } }", "class AService { function __construct() { $this->a = 1; } }"),
}


def codes(source, name="", opening="<?php "):
    """Codes of a source's issues."""
    return {i[0] for i in lint((opening + source).encode(), name, everything=True)}


@pytest.mark.parametrize("code", list(CASES))
def test_rule(code):
    bad, good = CASES[code]
    assert "syntax" not in codes(bad) | codes(good)
    assert code in codes(bad)
    assert code not in codes(good)


def test_rules_on_tags_and_text_outside_of_code():
    assert "no-inline" in codes("text <?php $a;", opening="") and "no-inline" not in codes("$a;")
    assert "invalid-open-tag" in codes("<php $a;", opening="") and "invalid-open-tag" not in codes("<p>text</p>", opening="")
    assert "no-short-opening-tag" in codes("$a;", opening="<? ") and "no-short-opening-tag" not in codes("$a;")


def test_rule_on_file_names():
    assert "file-name" in codes("class A {}", "src/B.php") and "file-name" not in codes("class A {}", "src/A.php")


def test_configured_bans(monkeypatch):
    from corpuscope.frontend import lint_flow

    source = "exec('ls'); new \\Old();"
    assert not {"disallowed-functions", "disallowed-type-instantiation"} & codes(source)
    monkeypatch.setattr(lint_flow, "BANNED", {"functions": {"exec"}, "types": {"old"}})
    assert {"disallowed-functions", "disallowed-type-instantiation"} <= codes(source)


def test_every_rule_has_a_case():
    from test_frontend import CASES as others

    elsewhere = {"no-inline", "invalid-open-tag", "no-short-opening-tag", "file-name", "disallowed-functions", "disallowed-type-instantiation", "cyclomatic-complexity"}
    lint_module.load()
    assert set(lint_module.RULES) == set(CASES) | set(others) | elsewhere
