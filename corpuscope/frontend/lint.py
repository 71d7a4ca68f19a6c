"""Lint rules over one file's tree, and their application to a file table.

A rule is a function of a context and a node of the kinds that it is registered
for; it yields issues.  Each file is parsed and walked once for all rules.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .syntax import Node, Parser, parse

NOTE, HELP, WARNING, ERROR = range(4)


@dataclass
class Rule:
    code: str
    level: int
    kinds: tuple[str, ...]
    on: bool
    check: Callable[["Context", Node], Iterator[tuple[Node, str]]]


@dataclass
class Context:
    root: Node
    parser: Parser
    name: str = ""
    parents: dict[int, Node] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for n in self.root.walk():
            for c in n.children:
                self.parents[id(c)] = n

    def text(self, n: Node) -> str:
        return self.parser.text[n.start : n.stop]

    def up(self, n: Node) -> Iterator[Node]:
        while (n := self.parents.get(id(n))) is not None:
            yield n

    def inside(self, n: Node, *kinds: str) -> Node | None:
        return next((p for p in self.up(n) if p.kind in kinds), None)


RULES: dict[str, Rule] = {}
FUNCTIONS = ("function", "method", "closure", "arrow_function")
CLASSES = ("class", "interface", "trait", "enum", "anonymous_class")
LOOPS = ("for", "foreach", "while", "do_while")
LITERALS = ("integer", "float", "string")


def rule(code: str, level: int, *kinds: str, on: bool = True):
    def add(f):
        RULES[code] = Rule(code, level, kinds, on, f)
        return f

    return add


# Shared looks at nodes.


def bare(n: Node | None) -> Node | None:
    while n is not None and n.kind == "parenthesized":
        n = n.role("expression")
    return n


def called(n: Node) -> str:
    """The lower-case name of a function call, without a leading separator."""
    return n.value.lower().lstrip("\\") if n.kind == "call" else ""


def args(n: Node) -> list[Node]:
    return [c for c in n.children if c.kind == "argument"]


def arg(n: Node, i: int) -> Node | None:
    a = args(n)
    return a[i].role("value_") if i < len(a) else None


def statements(n: Node | None) -> list[Node]:
    if n is None:
        return []
    return [c for c in n.children if c.kind != "noop"] if n.kind in ("block", "colon_block", "program") else [n]


def own(n: Node, *stop: str) -> Iterator[Node]:
    """What stands below a node, not below nested functions and classes."""
    stop = stop or FUNCTIONS + CLASSES
    stack = list(reversed(n.children))
    while stack:
        c = stack.pop()
        yield c
        if c.kind not in stop:
            stack += reversed(c.children)


def literal(n: Node | None) -> bool:
    n = bare(n)
    return n is not None and (n.kind in LITERALS or (n.kind == "name" and n.value.lower() in ("true", "false", "null")) or (n.kind == "prefix" and n.value in "+-" and literal(n.role("operand"))))


def string_value(n: Node | None) -> str | None:
    return n.value.lstrip("bB")[1:-1] if n is not None and n.kind == "string" and not n.value.startswith("<<<") else None


def ends_flow(n: Node | None) -> bool:
    body = statements(n)
    if not body:
        return False
    x = body[-1]
    if x.kind in ("return", "break", "continue", "goto"):
        return True
    e = x.role("expression") if x.kind == "expression_statement" else None
    if e is not None and e.kind in ("throw", "exit"):
        return True
    if x.kind == "if" and x.role("other"):
        return all(ends_flow(b.role("then")) for b in [x, x.role("other"), *(c for c in x.children if c.kind == "elseif")])
    return x.kind == "block" and ends_flow(x)


def calls_of(code: str, level: int, names: frozenset[str] | set[str], message: str, on: bool = True):
    @rule(code, level, "call", on=on)
    def check(ctx, n):
        if called(n) in names:
            yield n, message.format(called(n))

    return check


# Best practices.


@rule("combine-consecutive-issets", WARNING, "binary")
def _(ctx, n):
    if n.value in ("&&", "and") and all(bare(n.role(r)) is not None and bare(n.role(r)).kind == "isset" for r in ("left", "right")):
        yield n, "Consecutive isset calls can be one."


@rule("loop-does-not-iterate", WARNING, *LOOPS)
def _(ctx, n):
    body = statements(n.role("then"))
    if body and body[0].kind in ("break", "return") and not any(c.kind in ("continue",) for c in own(n)):
        yield n, "The loop leaves before its first round ends."


@rule("no-array-accumulation-in-loop", WARNING, "assignment", on=False)
def _(ctx, n):
    t, v = n.role("target"), bare(n.role("value_"))
    if n.value == "=" and t is not None and v is not None and called(v) in ("array_merge", "array_merge_recursive") and arg(v, 0) is not None and ctx.text(arg(v, 0)) == ctx.text(t) and ctx.inside(n, *LOOPS):
        yield n, "Merging into an array in a loop copies it each time."


calls_of("no-ini-set", WARNING, {"ini_set", "ini_alter"}, "Settings are not to be changed by {}.")


@rule("no-inline", ERROR, "inline", on=False)
def _(ctx, n):
    if ctx.text(n).strip():
        yield n, "Text outside of code."


@rule("no-parameter-shadowing", WARNING, *FUNCTIONS, on=False)
def _(ctx, n):
    names = {p.value for p in (n.role("parameters").children if n.role("parameters") else [])}
    for c in own(n):
        new = [c.role("value_"), c.role("key")] if c.kind == "foreach" else [c.role("variable")] if c.kind == "catch" else c.children if c.kind in ("global", "static_variables") else []
        for v in new:
            v = v.role("target") if v is not None and v.kind == "assignment" else v
            if v is not None and v.kind == "variable" and v.value in names:
                yield v, f"{v.value} hides a parameter."


@rule("no-side-effects-with-declarations", WARNING, "program", on=False)
def _(ctx, n):
    top = [c for s in n.children for c in (statements(s.role("body")) if s.kind == "namespace" and s.role("body") else [s])]
    declares = [c for c in top if c.kind in ("function", "constant", *CLASSES)]
    effects = [c for c in top if c.kind in ("echo", "expression_statement", "unset", "global", *LOOPS, "switch", "inline", "echo_tag") and called(c.role("expression") or c) not in ("class_alias", "class_exists")]
    if declares and effects:
        yield effects[0], "A file declares symbols or has effects, not both."


@rule("no-sprintf-concat", WARNING, "binary")
def _(ctx, n):
    if n.value == "." and any(called(bare(n.role(r)) or n) == "sprintf" for r in ("left", "right")):
        yield n, "The text can be part of the format."


@rule("prefer-array-spread", WARNING, "call", on=False)
def _(ctx, n):
    if called(n) == "array_merge" and args(n):
        yield n, "Spread arrays in place of array_merge."


@rule("prefer-arrow-function", HELP, "closure")
def _(ctx, n):
    body = statements(n.role("body"))
    if len(body) == 1 and body[0].kind == "return" and body[0].role("value_") is not None and not any(c.kind == "capture" and "reference" in c.flags for c in n.children):
        yield n, "A closure that only returns can be an arrow function."


@rule("prefer-early-continue", HELP, *LOOPS)
def _(ctx, n):
    body = statements(n.role("then"))
    if len(body) == 1 and body[0].kind == "if" and not body[0].role("other") and not any(c.kind == "elseif" for c in body[0].children) and len(statements(body[0].role("then"))) > 0:
        yield body[0], "Continue early in place of one large condition."


@rule("prefer-early-return", HELP, "function", "method", "closure", on=False)
def _(ctx, n):
    body = statements(n.role("body"))
    if len(body) == 1 and body[0].kind == "if" and not body[0].role("other") and not any(c.kind == "elseif" for c in body[0].children):
        yield body[0], "Return early in place of one large condition."


@rule("prefer-explode-over-preg-split", WARNING, "call", on=False)
def _(ctx, n):
    p = string_value(arg(n, 0)) if called(n) == "preg_split" else None
    if p and len(p) > 2 and p[0] == p[-1] and not p[0].isalnum() and not re.search(r"[.\\+*?\[\]^$(){}|#]", p[1:-1]):
        yield n, "The pattern is a plain text."


@rule("prefer-first-class-callable", WARNING, "arrow_function", "closure")
def _(ctx, n):
    body = n.role("body")
    if n.kind == "closure":
        inner = statements(body)
        body = inner[0].role("value_") if len(inner) == 1 and inner[0].kind == "return" else None
    if body is not None and body.kind in ("method_call", "static_call"):
        own_names = [p.value for p in n.role("parameters").children]
        given = [a.role("value_").value if a.role("value_").kind == "variable" and not a.value and "spread" not in a.flags else None for a in args(body)]
        if own_names and own_names == given:
            yield n, "The call can be passed as it is."


@rule("prefer-pre-increment", HELP, "postfix", on=False)
def _(ctx, n):
    p = ctx.parents.get(id(n))
    if p is not None and p.kind in ("expression_statement", "for_part"):
        yield n, "Count before the value is used."


@rule("prefer-self-return-type", HELP, "method", on=False)
def _(ctx, n):
    c, hint = ctx.inside(n, *CLASSES), n.role("returns")
    if c is not None and c.value and hint is not None and hint.value.lstrip("?").lower() == c.value.lower():
        yield hint, "The class can name itself self."


@rule("prefer-static-closure", HELP, "closure", "arrow_function")
def _(ctx, n):
    if "static" not in n.flags and not any(c.kind == "variable" and c.value == "$this" or c.kind == "name" and c.value.lower() == "parent" or "$this" in c.value and c.kind == "template" for c in n.walk()):
        yield n, "The closure does not use $this and can be static."


@rule("prefer-while-loop", NOTE, "for")
def _(ctx, n):
    if not n.role("first").children and not n.role("step").children:
        yield n, "A for loop with a condition only is a while loop."


@rule("require-namespace", WARNING, "program", on=False)
def _(ctx, n):
    if not any(c.kind == "namespace" for c in n.children) and (d := next((c for c in n.children if c.kind in ("function", "constant", *CLASSES)), None)):
        yield d, "Declarations belong into a namespace."


@rule("single-class-per-file", WARNING, "program")
def _(ctx, n):
    found = [c for c in n.walk() if c.kind in CLASSES[:4]]
    if len(found) > 1:
        yield found[1], "A file holds one class."


@rule("sorted-integer-keys", HELP, "array", "legacy_array", on=False)
def _(ctx, n):
    keys = [e.role("key") for e in n.children]
    if len(keys) > 1 and all(k is not None and k.kind == "integer" for k in keys):
        values = [integer(k.value) for k in keys]
        if values != sorted(values):
            yield n, "Integer keys are out of order."


@rule("use-compound-assignment", HELP, "assignment")
def _(ctx, n):
    v = n.role("value_")
    if n.value == "=" and v is not None and v.kind == "binary" and v.value in ("+", "-", "*", "/", ".", "%", "**", "&", "|", "^", "<<", ">>", "??") and ctx.text(v.role("left")) == ctx.text(n.role("target")):
        yield n, f"Assign with {v.value}=."


@rule("yoda-conditions", HELP, "binary", on=False)
def _(ctx, n):
    if n.value in ("==", "===", "!=", "!==", "<>") and bare(n.role("left")) is not None and bare(n.role("left")).kind in ("variable", "property_access", "array_access") and literal(n.role("right")):
        yield n, "The literal comes first."


@rule("final-controller", ERROR, "class")
def _(ctx, n):
    if n.value.endswith("Controller") and not n.flags & {"final", "abstract"}:
        yield n, "Controllers are final."


# Clarity.


def integer(t: str) -> int:
    t = t.replace("_", "").lower()
    return int(t, 0) if t[:2] in ("0x", "0b", "0o") else int(t, 8) if len(t) > 1 and t[0] == "0" and t.isdigit() and not set(t) & {"8", "9"} else int(float(t))


@rule("explicit-octal", WARNING, "integer")
def _(ctx, n):
    if re.fullmatch(r"0[0-7_]+", n.value) and n.value.strip("0_"):
        yield n, "Octal numbers start with 0o."


@rule("instanceof-stringable", WARNING, "binary")
def _(ctx, n):
    a, b = bare(n.role("left")), bare(n.role("right"))
    if n.value in ("&&", "and") and called(a or n) == "is_object" and called(b or n) == "method_exists" and (string_value(arg(b, 1)) or "").lower() == "__tostring" and arg(a, 0) is not None and ctx.text(arg(a, 0)) == ctx.text(arg(b, 0)):
        yield n, "Test for Stringable."


@rule("literal-named-argument", WARNING, "call", "method_call", "static_call", "nullsafe_call", "new")
def _(ctx, n):
    for i, a in enumerate(args(n)):
        if i and not a.value and "spread" not in a.flags and literal(a.role("value_")):
            yield a, "Literals are passed by name."


@rule("missing-docs", HELP, "function", on=False)
def _(ctx, n):
    before = [t for t in ctx.parser.all if t[2] <= n.start and t[0] != "space"]
    if not before or before[-1][0] != "comment" or not ctx.parser.text[before[-1][1] :].startswith("/**"):
        yield n, "A declaration has no description."


@rule("no-empty", ERROR, "empty")
def _(ctx, n):
    yield n, "empty() takes too much for empty."


@rule("no-isset", WARNING, "isset")
def _(ctx, n):
    yield n, "isset() hides what is tested."


@rule("no-multi-assignments", WARNING, "assignment")
def _(ctx, n):
    v = bare(n.role("value_"))
    if v is not None and v.kind == "assignment":
        yield n, "One assignment a statement."


@rule("no-negated-ternary", HELP, "ternary", on=False)
def _(ctx, n):
    t = bare(n.role("test"))
    if n.role("then") is not None and t is not None and (t.kind == "prefix" and t.value == "!" or t.kind == "binary" and t.value in ("!=", "!==", "<>")):
        yield n, "Turn the condition and the branches round."


@rule("no-nested-ternary", WARNING, "ternary")
def _(ctx, n):
    if any(bare(n.role(r)) is not None and bare(n.role(r)).kind == "ternary" for r in ("test", "then", "other")):
        yield n, "Ternaries do not nest."


@rule("no-short-bool-cast", HELP, "prefix", on=False)
def _(ctx, n):
    o = n.role("operand")
    if n.value == "!" and o is not None and o.kind == "prefix" and o.value == "!":
        yield n, "Cast to bool by name."


@rule("no-shorthand-ternary", WARNING, "ternary")
def _(ctx, n):
    if n.value == "short":
        yield n, "Write the ternary out."


@rule("no-variable-variable", WARNING, "variable_variable")
def _(ctx, n):
    yield n, "Variables named by variables are hard to follow."


@rule("readable-literal", WARNING, "integer", "float")
def _(ctx, n):
    whole = n.value.split(".")[0]
    if whole.isdigit() and len(whole) >= 6:
        yield n, "Part the digits with underscores."


def compared_strpos(n: Node) -> tuple[Node, Node] | None:
    for a, b in (("left", "right"), ("right", "left")):
        x, y = bare(n.role(a)), bare(n.role(b))
        if called(x or n) == "strpos" and y is not None and len(args(x)) == 2:
            return x, y
    return None


@rule("str-contains", WARNING, "binary")
def _(ctx, n):
    if n.value in ("===", "!==", "!=", "==") and (f := compared_strpos(n)) and f[1].value.lower() == "false":
        yield n, "Use str_contains."


@rule("str-starts-with", WARNING, "binary")
def _(ctx, n):
    if n.value in ("===", "!==") and (f := compared_strpos(n)) and f[1].value == "0":
        yield n, "Use str_starts_with."


def comment_rule(code: str, level: int, message: str, on: bool = True):
    def add(test):
        @rule(code, level, "program", on=on)
        def check(ctx, n):
            for k, a, b in ctx.parser.all:
                if k == "comment" and test(ctx.parser.text[a:b]):
                    yield Node("comment", a, b), message

        return check

    return add


comment_rule("tagged-todo", WARNING, "A TODO names who or what.")(lambda t: re.search(r"(?i)\btodo\b(?!\s*\()(?!.*#\d)", t) is not None and not re.search(r"(?i)\btodo\b[^\n]*(#\d+|@\w+)", t))
comment_rule("tagged-fixme", WARNING, "A FIXME names who or what.")(lambda t: re.search(r"(?i)\bfixme\b(?!\s*\()", t) is not None and not re.search(r"(?i)\bfixme\b[^\n]*(#\d+|@\w+)", t))
comment_rule("no-hash-comment", WARNING, "Comments start with two slashes.")(lambda t: t.startswith("#"))
comment_rule("no-trailing-space", NOTE, "White space at a line's end.")(lambda t: re.search(r"[ \t]+(\r?\n|$)", t) is not None and re.search(r"[ \t]+(?=\r?\n)|[ \t]+$", t.rstrip("\r\n")) is not None)
comment_rule("no-empty-comment", NOTE, "The comment says nothing.")(lambda t: not re.sub(r"^(//|#|/\*+)|\*+/$|[\s*]", "", t).strip("/*# \t\r\n"))
comment_rule("no-hash-emoji", WARNING, "An emoji stands for a hash.")(lambda t: "#\xef\xb8\x8f\xe2\x83\xa3" in t)
comment_rule("valid-docblock", NOTE, "A block tag does not close.")(lambda t: t.startswith("/**") and t.count("{@") > len(re.findall(r"\{@[^{}]*\}", t)))


# Consistency.

PASCAL = re.compile(r"_?[A-Z][A-Za-z0-9\x80-\xff]*$")
CAMEL = re.compile(r"[a-z][A-Za-z0-9]*$")
SNAKE = re.compile(r"[a-z][a-z0-9]*(_[a-z0-9]+)*$")


def naming(code: str, kind: str, on: bool = True):
    @rule(code, HELP, kind, on=on)
    def check(ctx, n):
        if n.value and not PASCAL.match(n.value):
            yield n, f"{n.value} is not in Pascal case."


for _kind in ("class", "enum", "interface", "trait"):
    naming(f"{_kind}-name", _kind)


@rule("constant-name", HELP, "constant", "class_constant")
def _(ctx, n):
    for c in n.children:
        if c.kind == "constant_item" and not re.fullmatch(r"[A-Z][A-Z0-9]*(_[A-Z0-9]+)*", c.value):
            yield c, f"{c.value} is not in upper case."


@rule("function-name", HELP, "function")
def _(ctx, n):
    if not SNAKE.match(n.value.lstrip("_")) and not CAMEL.match(n.value.lstrip("_")):
        yield n, f"{n.value} is neither in camel nor in snake case."


@rule("method-name", HELP, "method", on=False)
def _(ctx, n):
    if not n.value.startswith("__") and not CAMEL.match(n.value):
        yield n, f"{n.value} is not in camel case."


@rule("property-name", HELP, "property_item", on=False)
def _(ctx, n):
    if not CAMEL.match(n.value[1:].lstrip("_")):
        yield n, f"{n.value} is not in camel case."


@rule("variable-name", HELP, "assignment", "parameter", on=False)
def _(ctx, n):
    v = n if n.kind == "parameter" else n.role("target")
    if v is not None and v.kind in ("variable", "parameter") and not v.value.isupper() and not (CAMEL.match(v.value[1:].lstrip("_")) or SNAKE.match(v.value[1:].lstrip("_")) or not v.value[1:].strip("_")):
        yield v, f"{v.value} is neither in camel nor in snake case."


@rule("array-style", NOTE, "legacy_array", "list")
def _(ctx, n):
    if n.kind == "legacy_array":
        yield n, "Use brackets."


@rule("block-statement", NOTE, "if", "else", "elseif", *LOOPS)
def _(ctx, n):
    t = n.role("then")
    if t is not None and t.kind not in ("block", "colon_block") and not (n.kind == "else" and t.kind == "if"):
        yield t, "Put the body into braces."


@rule("braced-string-interpolation", NOTE, "template")
def _(ctx, n):
    if re.search(r"(?<![\\{])\$[A-Za-z_]", n.value):
        yield n, "Put interpolated variables into braces."


@rule("file-name", WARNING, "program")
def _(ctx, n):
    found = [c for c in n.walk() if c.kind in CLASSES[:4]]
    if ctx.name and len(found) == 1 and ctx.name.rsplit("/", 1)[-1].rsplit(".", 1)[0] != found[0].value:
        yield found[0], "The file is not named after its class."


@rule("lowercase-keyword", HELP, "program")
def _(ctx, n):
    for k, a, b in ctx.parser.all:
        if k == "keyword" and not ctx.parser.text[a:b].islower() and ctx.parser.text[a:b].lower() not in ("enum", "match", "readonly"):
            yield Node("keyword", a, b), "Keywords are in lower case."


TYPES = frozenset("int float string bool array object mixed void never null false true iterable callable self static parent".split())


@rule("lowercase-type-hint", HELP, "type")
def _(ctx, n):
    for w in re.findall(r"[A-Za-z_\\]+", n.value):
        if w.lower() in TYPES and not w.islower():
            yield n, f"{w} is written in lower case."


#: Functions that are other names of functions.
ALIASES = dict(
    x.split(":")
    for x in "chop:rtrim close:closedir die:exit diskfreespace:disk_free_space doubleval:floatval fputs:fwrite ini_alter:ini_set is_double:is_float is_integer:is_int is_long:is_int is_writeable:is_writable join:implode key_exists:array_key_exists magic_quotes_runtime:set_magic_quotes_runtime pos:current set_file_buffer:stream_set_write_buffer show_source:highlight_file sizeof:count strchr:strstr user_error:trigger_error".split()
)


@rule("no-alias-function", NOTE, "call")
def _(ctx, n):
    if called(n) in ALIASES:
        yield n, f"Call {ALIASES[called(n)]}."


@rule("no-alternative-syntax", WARNING, "colon_block", on=False)
def _(ctx, n):
    yield n, "Use braces."


@rule("no-php-tag-terminator", NOTE, "program")
def _(ctx, n):
    t = ctx.parser.all
    for (a, s, _), (b, _, e) in zip(t, t[1:]):
        if a == "close" and b == "open":
            yield Node("tag", s, e), "Tags do not end statements."


for _what, _kinds in (("class-like", ("new", "extends", "implements")), ("constant", ("name",)), ("function", ("call",))):

    @rule(f"no-fully-qualified-global-{_what}", HELP, *_kinds, on=False)
    def _(ctx, n, what=_what):
        for c in [n.role("target")] if n.kind in ("new", "call") else n.children if n.kind != "name" else [n]:
            if c is not None and c.kind == "name" and c.value.startswith("\\") and c.value.count("\\") == 1:
                p = ctx.parents.get(id(c))
                if what != "constant" or p is not None and p.kind not in ("new", "call", "extends", "implements", "static_call", "class_constant_access", "static_property"):
                    yield c, "Import what is global."


@rule("ambiguous-function-call", HELP, "call", on=False)
def _(ctx, n):
    if n.value and "\\" not in n.value and in_namespace(ctx) and called(n) not in imported(ctx, "function"):
        yield n, "The call may be of the namespace or global."


def in_namespace(ctx: Context) -> bool:
    return any(c.kind == "namespace" and c.value for c in ctx.root.children)


def use_items(ctx: Context) -> list[tuple[Node, str, str, str]]:
    out = []
    for n in ctx.root.walk():
        if n.kind == "use_item":
            kind, name, alias = n.value.split("|")
            out.append((n, kind, name, alias or name.rsplit("\\", 1)[-1]))
    return out


def imported(ctx: Context, kind: str) -> set[str]:
    return {alias.lower() for _, k, _, alias in use_items(ctx) if k == kind}


# Correctness.


@rule("assert-description", WARNING, "call")
def _(ctx, n):
    if called(n) == "assert" and len(args(n)) == 1:
        yield n, "An assertion says what it expects."


@rule("identity-comparison", WARNING, "binary")
def _(ctx, n):
    if n.value in ("==", "!=", "<>"):
        yield n, f"Compare by identity, not {n.value}."


@rule("invalid-open-tag", NOTE, "inline")
def _(ctx, n):
    if re.search(r"<(php\?|\?hp\b|\?pp\b|php\b)", ctx.text(n)):
        yield n, "The opening tag is misspelt."


@rule("no-assign-in-argument", WARNING, "argument", on=False)
def _(ctx, n):
    v = bare(n.role("value_"))
    if v is not None and v.kind == "assignment":
        yield v, "Assignments do not stand in arguments."


@rule("no-assign-in-condition", WARNING, "if", "elseif", "while", "do_while")
def _(ctx, n):
    for c in [n.role("test"), *own(n.role("test"))]:
        if c.kind == "assignment":
            yield c, "Assignments do not stand in conditions."


@rule("no-empty-catch-clause", WARNING, "catch")
def _(ctx, n):
    b = n.role("body")
    if b is not None and not statements(b) and not any(k == "comment" and b.start <= a < b.stop for k, a, _ in ctx.parser.all):
        yield n, "An exception is swallowed."


@rule("no-missing-format-argument", ERROR, "call")
def _(ctx, n):
    at = {"sprintf": 0, "printf": 0, "fprintf": 1}.get(called(n))
    text = string_value(arg(n, at)) if at is not None else None
    if text is not None and not any("spread" in a.flags for a in args(n)):
        found = re.findall(r"%(?:%|(?:(\d+)\$)?[-+ 0']*(?:\*|\d+)?(?:\.\d+)?[bcdeEfFgGosuxX])", text)
        marks = len(re.findall(r"%(?!%)(?:\d+\$)?[-+ 0]*(?:'.)?\d*(?:\.\d+)?[bcdeEfFgGhHosuxX]", text.replace("%%", "")))
        most = max([int(f) for f in found if f], default=0) or marks
        if most > len(args(n)) - at - 1:
            yield n, "The format wants more values."


@rule("strict-types", WARNING, "program")
def _(ctx, n):
    d = [c for c in n.children if c.kind == "declare"]
    items = [i for x in d for i in x.children if i.kind == "constant_item" and i.value.lower() == "strict_types"]
    if any(c.kind not in ("inline", "opening_tag", "closing_tag") for c in n.children) and not items:
        yield Node("program", n.start, min(n.stop, 5)), "The file does not declare strict types."
    for i in items:
        if i.role("value_") is not None and i.role("value_").value == "0":
            yield i, "Strict types are switched off."


#: Functions with a strict parameter, and its place.
STRICT = {"in_array": 2, "array_search": 2, "base64_decode": 1, "array_keys": 2}


@rule("strict-behavior", WARNING, "call")
def _(ctx, n):
    at = STRICT.get(called(n))
    if at is not None and not any(a.value == "strict" for a in args(n)) and len(args(n)) <= at and not (called(n) == "array_keys" and len(args(n)) < 2):
        yield n, "Ask for strict comparison."


@rule("suspicious-explode-arguments", WARNING, "call")
def _(ctx, n):
    if called(n) == "explode" and len(args(n)) >= 2:
        a, b = string_value(arg(n, 0)), string_value(arg(n, 1))
        if b is not None and a is None and len(b) <= 10:
            yield n, "The separator comes first."


@rule("no-unused-closure-capture", WARNING, "closure", on=False)
def _(ctx, n):
    names = Counter(c.value for c in n.role("body").walk() if c.kind == "variable")
    quoted = " ".join(c.value for c in n.role("body").walk() if c.kind in ("template", "shell"))
    for c in n.children:
        if c.kind == "capture" and not names[c.value] and c.value[1:] not in quoted:
            yield c, f"{c.value} is captured and not used."


@rule("no-unused-global", WARNING, "global", on=False)
def _(ctx, n):
    scope = ctx.inside(n, *FUNCTIONS)
    for v in n.children:
        if scope is not None and v.kind == "variable" and sum(c.kind == "variable" and c.value == v.value for c in own(scope)) < 2:
            yield v, f"{v.value} is not used."


# Deprecation.


@rule("deprecated-cast", ERROR, "cast")
def _(ctx, n):
    if n.value in ("integer", "boolean", "double", "binary", "real"):
        yield n, f"The cast {n.value} is deprecated."


@rule("deprecated-shell-execute-string", ERROR, "shell")
def _(ctx, n):
    yield n, "Call shell_exec by name."


@rule("deprecated-switch-semicolon", ERROR, "switch_case", "switch_default")
def _(ctx, n):
    end = n.role("value_").stop if n.role("value_") is not None else n.start + len("default")
    if ctx.parser.text[end:].lstrip()[:1] == ";":
        yield n, "A case ends with a colon."


@rule("explicit-nullable-param", WARNING, "parameter")
def _(ctx, n):
    h, d = n.role("hint"), n.role("default")
    if h is not None and d is not None and d.kind == "name" and d.value.lower() == "null" and not h.value.startswith("?") and not re.search(r"(?i)\b(null|mixed)\b", h.value):
        yield n, "Say that null is allowed."


@rule("optional-param-order", WARNING, "parameters")
def _(ctx, n):
    seen = False
    for p in n.children:
        if p.role("default") is not None:
            seen = True
        elif seen and "variadic" not in p.flags:
            yield p, "A needed parameter follows an optional one."


@rule("no-underscore-class", WARNING, "class", "interface", "trait", "enum")
def _(ctx, n):
    if n.value == "_":
        yield n, "A class is not named by an underscore."


@rule("no-void-reference-return", WARNING, "function", "method", "closure")
def _(ctx, n):
    h = n.role("returns")
    if h is not None and h.value.lower() == "void" and re.match(r"(?is)(?:[a-z\s]*)function\s*&", ctx.text(n)):
        yield n, "Nothing is returned by reference."


# Maintainability: the metrics' definitions are fixed and not the textbooks'.

WEIGHT = {"if": 1, "elseif": 1, "for": 1, "foreach": 1, "while": 1, "do_while": 1, "catch": 1, "ternary": 1, "switch_default": 1}
LOGICAL = {"&&": 1, "||": 1, "and": 1, "or": 1, "xor": 1, "??": 1, "<=>": 2}
MANY = {"methods": 10, "properties": 10, "cases": 20, "parameters": 5}


def cyclomatic(n: Node) -> int:
    return sum(WEIGHT.get(c.kind, 0) + (LOGICAL.get(c.value, 0) if c.kind == "binary" else 0) for c in own(n))


@rule("cyclomatic-complexity", ERROR, "function", "closure", *CLASSES)
def _(ctx, n):
    if n.kind in CLASSES:
        total = sum(cyclomatic(m) for m in n.children if m.kind == "method" and not re.match(r"[gs]et[A-Z]", m.value))
    else:
        total = cyclomatic(n)
    if total > 15:
        yield n, f"The complexity is {total}."


def halstead(n: Node) -> tuple[float, float, float]:
    import math

    kinds = ("binary", "assignment", "if", "elseif", "for", "switch", "catch", "return", "while", "do_while", "cast")
    ops = [c.kind for c in own(n) if c.kind in kinds]
    vals = [c.value for c in own(n) if c.kind in ("variable", "integer", "float", "string")]
    n1, n2 = len(set(ops)), len(set(vals))
    if not n2 or not vals:
        return 0.0, 0.0, 0.0
    v, d = (len(ops) + len(vals)) * math.log2(n1 + n2), n1 / 2 * len(vals) / n2
    return round(v, 2), round(d, 2), round(v * d, 2)


@rule("halstead", WARNING, *FUNCTIONS)
def _(ctx, n):
    for name, value, most in zip(("volume", "difficulty", "effort"), halstead(n), (1000, 12, 5000)):
        if value > most:
            yield n, f"The {name} is {value}."


@rule("kan-defect", ERROR, *CLASSES[:4], "function")
def _(ctx, n):
    c = Counter(x.kind for x in n.walk())
    score = 0.15 + 0.23 * (c["while"] + c["do_while"] + c["foreach"]) + 0.22 * (c["switch"] + c["match"]) + 0.07 * c["if"]
    if score > 1.6:
        yield n, f"The defect estimate is {score:.2f}."


@rule("excessive-nesting", WARNING, "block")
def _(ctx, n):
    if sum(p.kind == "block" for p in ctx.up(n)) == 7:
        yield n, "Blocks nest too deep."


@rule("excessive-parameter-list", ERROR, "parameters")
def _(ctx, n):
    if len(n.children) > MANY["parameters"]:
        yield n, f"{len(n.children)} parameters are too many."


@rule("too-many-methods", ERROR, *CLASSES)
def _(ctx, n):
    count = sum(m.kind == "method" and not re.match(r"([gs]et|is|has)[A-Z]", m.value) for m in n.children)
    if count > MANY["methods"]:
        yield n, f"{count} methods are too many."


@rule("too-many-properties", ERROR, *CLASSES)
def _(ctx, n):
    count = sum(len([i for i in m.children if i.kind == "property_item"]) for m in n.children if m.kind == "property")
    if count > MANY["properties"]:
        yield n, f"{count} properties are too many."


@rule("too-many-enum-cases", ERROR, "enum")
def _(ctx, n):
    if sum(m.kind == "enum_case" for m in n.children) > MANY["cases"]:
        yield n, "An enum has too many cases."


@rule("no-boolean-flag-parameter", HELP, "parameter")
def _(ctx, n):
    owner = next(ctx.up(ctx.parents[id(n)]), None)
    if n.role("hint") is not None and n.role("hint").value.lower().lstrip("?") == "bool" and owner is not None and owner.kind in ("function", "method") and owner.value != "__construct":
        yield n, "A flag makes two functions of one."


@rule("no-else-clause", HELP, "else")
def _(ctx, n):
    yield n, "Return early in place of else."


@rule("no-goto", NOTE, "goto", "label")
def _(ctx, n):
    yield n, "No jumps."


# Redundancy.


@rule("constant-condition", HELP, "if", "elseif")
def _(ctx, n):
    if literal(n.role("test")):
        yield n, "The condition does not change."


@rule("no-closing-tag", HELP, "program")
def _(ctx, n):
    t = [x for x in ctx.parser.all if x[0] != "space"]
    if t and (t[-1][0] == "close" or len(t) > 1 and t[-2][0] == "close" and t[-1][0] == "inline" and not ctx.parser.text[t[-1][1] :].strip()):
        yield Node("tag", *next(x for x in reversed(t) if x[0] == "close")[1:]), "The last closing tag is not needed."


@rule("no-empty-loop", NOTE, *LOOPS)
def _(ctx, n):
    t = n.role("then")
    if t is not None and (t.kind == "noop" or t.kind in ("block", "colon_block") and not statements(t)):
        yield n, "The loop does nothing."


@rule("no-noop", HELP, "noop")
def _(ctx, n):
    p = ctx.parents.get(id(n))
    if p is not None and p.kind in ("block", "program", "colon_block"):
        yield n, "A semicolon too many."


@rule("no-redundant-block", HELP, "block")
def _(ctx, n):
    p = ctx.parents.get(id(n))
    if p is not None and p.kind in ("block", "program"):
        yield n, "The braces do nothing."


@rule("no-redundant-continue", HELP, *LOOPS)
def _(ctx, n):
    body = statements(n.role("then"))
    if body and body[-1].kind == "continue" and body[-1].role("value_") is None:
        yield body[-1], "The loop goes on anyway."


@rule("no-redundant-else", HELP, "if", on=False)
def _(ctx, n):
    if n.role("other") is not None and not any(c.kind == "elseif" for c in n.children) and ends_flow(n.role("then")):
        yield n.role("other"), "Nothing comes here but by the else."


@rule("no-redundant-file", HELP, "program")
def _(ctx, n):
    if all(c.kind in ("opening_tag", "closing_tag", "noop", "declare", "namespace", "use") and not (c.role("body") and statements(c.role("body"))) or c.kind == "inline" and not ctx.text(c).strip() for c in n.children):
        yield Node("program", 0, 0), "The file holds nothing."


@rule("no-redundant-final", HELP, "method")
def _(ctx, n):
    c = ctx.inside(n, *CLASSES)
    if "final" in n.flags and c is not None and (c.kind == "enum" or "final" in c.flags):
        yield n, "Nothing can override it anyway."


@rule("no-redundant-label", HELP, "label")
def _(ctx, n):
    if not any(c.kind == "goto" and c.value == n.value for c in ctx.root.walk()):
        yield n, "Nothing jumps here."


@rule("no-redundant-math", HELP, "binary")
def _(ctx, n):
    a, b = bare(n.role("left")), bare(n.role("right"))
    if a is not None and b is not None:
        right = {"*": "1", "/": "1", "+": "0", "-": "0", "%": "1", "**": "1", "|": "0", "^": "0", "<<": "0", ">>": "0"}.get(n.value)
        left = {"*": "1", "+": "0", "|": "0", "^": "0"}.get(n.value)
        if b.kind == "integer" and b.value == right or a.kind == "integer" and a.value == left:
            yield n, "The sum or product is one of its parts."


@rule("no-redundant-method-override", HELP, "method")
def _(ctx, n):
    body = statements(n.role("body"))
    e = body[0].role("value_") or body[0].role("expression") if len(body) == 1 and body[0].kind in ("return", "expression_statement") else None
    if e is not None and e.kind == "static_call" and e.role("target").value.lower() == "parent" and e.value.lower() == n.value.lower():
        if [p.value for p in n.role("parameters").children] == [a.role("value_").value for a in args(e)]:
            yield n, "The method only calls its parent's."


@rule("no-redundant-parentheses", HELP, "parenthesized")
def _(ctx, n):
    p = ctx.parents.get(id(n))
    if p is not None and (p.kind in ("expression_statement", "return", "echo", "argument", "parenthesized", "constant_item") or p.kind == "assignment" and p.role("value_") is n or n.role("expression").kind in (*LITERALS, "variable")):
        yield n, "The parentheses do nothing."


@rule("no-redundant-readonly", HELP, "property", "parameter")
def _(ctx, n):
    c = ctx.inside(n, *CLASSES)
    if "readonly" in n.flags and c is not None and "readonly" in c.flags:
        yield n, "The class is readonly."


@rule("no-redundant-string-concat", HELP, "binary")
def _(ctx, n):
    a, b = n.role("left"), n.role("right")
    if n.value == "." and a is not None and b is not None and a.kind == b.kind == "string" and a.value[0] == b.value[0] and "\n" not in ctx.parser.text[a.stop : b.start]:
        yield n, "Two texts can be one."


@rule("no-redundant-use", WARNING, "program")
def _(ctx, n):
    names = defaultdict(int)
    for c in n.walk():
        if c.kind in ("name", "type", "attribute"):
            for w in re.findall(r"\\?[A-Za-z_\x80-\xff][\w\x80-\xff]*(?:\\[\w\x80-\xff]+)*", c.value):
                names[w.split("\\")[0].lower()] += 1
    docs = " ".join(ctx.parser.text[a:b] for k, a, b in ctx.parser.all if k == "comment").lower()
    ns = next((c.value.lower() for c in n.children if c.kind == "namespace"), "")
    for item, kind, name, alias in use_items(ctx):
        if not names[alias.lower()] and not re.search(rf"\b{re.escape(alias.lower())}\b", docs):
            yield item, f"{alias} is imported and not used."
        elif not kind and alias == name.rsplit("\\", 1)[-1] and name.lower().rpartition("\\")[0].lstrip("\\") == ns and ns:
            yield item, f"{alias} is of this namespace."


@rule("no-redundant-yield-from", HELP, "yield_from")
def _(ctx, n):
    o = n.role("operand")
    if o is not None and o.kind in ("array", "legacy_array") and len(o.children) == 1 and "spread" not in o.children[0].flags:
        yield n, "Yield the value."


@rule("no-self-assignment", WARNING, "assignment")
def _(ctx, n):
    if n.value == "=" and n.role("value_") is not None and ctx.text(n.role("target")) == ctx.text(n.role("value_")) and n.role("target").kind in ("variable", "property_access", "array_access", "static_property"):
        yield n, "Assigned to itself."


@rule("redundant-static", HELP, "name", on=False)
def _(ctx, n):
    c = ctx.inside(n, *CLASSES)
    if n.value.lower() == "static" and c is not None and "final" in c.flags:
        yield n, "In a final class static is self."


# Safety and security.


@rule("no-error-control-operator", ERROR, "prefix")
def _(ctx, n):
    if n.value == "@":
        yield n, "Errors are not to be hidden."


@rule("no-eval", ERROR, "eval")
def _(ctx, n):
    yield n, "Code is not made from text."


@rule("no-ffi", ERROR, "static_call", "new", "name")
def _(ctx, n):
    t = n if n.kind == "name" else None
    if t is not None and t.value.lstrip("\\").split("\\")[0].lower() == "ffi":
        yield n, "No foreign functions."


@rule("no-global", ERROR, "global", "variable")
def _(ctx, n):
    if n.kind == "global" or n.value == "$GLOBALS":
        yield n, "No global variables."


@rule("no-request-variable", ERROR, "variable")
def _(ctx, n):
    if n.value == "$_REQUEST":
        yield n, "Say where the input comes from."


@rule("no-shell-execute-string", ERROR, "shell")
def _(ctx, n):
    yield n, "No shell commands in back quotes."


@rule("no-unsafe-finally", ERROR, "finally")
def _(ctx, n):
    for c in own(n):
        if c.kind in ("return", "throw") or c.kind in ("break", "continue") and not any(p.kind in (*LOOPS, "switch") for p in ctx.up(c) if p.start > n.start):
            yield c, "Control does not leave from finally."


#: Functions that print what is looked for while debugging.
DEBUG = frozenset("var_dump print_r debug_zval_refcount debug_backtrace debug_print_backtrace var_export xdebug_info dd dump ray phpinfo".split())
calls_of("no-debug-symbols", NOTE, DEBUG, "{} is for debugging.")

PASSWORD = re.compile(r"(?i)(password|passwd|pwd|secret|token|api_?key|private_?key|passphrase)")


def secret_name(n: Node | None) -> bool:
    n = bare(n)
    return n is not None and (n.kind in ("variable", "property_access", "static_property") and PASSWORD.search(n.value.split("->")[-1]) is not None)


@rule("no-insecure-comparison", ERROR, "binary")
def _(ctx, n):
    if n.value in ("==", "!=", "===", "!==", "<>"):
        a, b = n.role("left"), n.role("right")
        if (secret_name(a) and not literal(b)) or (secret_name(b) and not literal(a)):
            yield n, "Compare secrets in constant time."


@rule("no-literal-password", ERROR, "assignment", "property_item", "constant_item", "element", "parameter")
def _(ctx, n):
    name, value = n.value, n.role("value_") or n.role("default")
    if n.kind == "assignment":
        name = ctx.text(n.role("target"))
    if n.kind == "element":
        name = string_value(n.role("key")) or ""
    if value is not None and value.kind == "string" and len(value.value) > 2 and PASSWORD.search(name):
        yield n, "A secret stands in the code."


@rule("no-short-opening-tag", WARNING, "opening_tag")
def _(ctx, n):
    if n.value == "<?":
        yield n, "Open with the long tag."


@rule("require-preg-quote-delimiter", WARNING, "call")
def _(ctx, n):
    if called(n) == "preg_quote" and len(args(n)) == 1:
        yield n, "Name the delimiter."


@rule("sensitive-parameter", ERROR, "parameter")
def _(ctx, n):
    if PASSWORD.search(n.value) and not any("sensitiveparameter" in a.value.lower() for c in n.children if c.kind == "attribute_list" for a in c.children):
        yield n, f"Mark {n.value} as sensitive."


USER_INPUT = ("$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_FILES", "$_SERVER")


@rule("tainted-data-to-sink", ERROR, "echo", "print", "echo_tag")
def _(ctx, n):
    for c in own(n, "call", "method_call", "static_call", "cast", *FUNCTIONS):
        if c.kind == "variable" and c.value in USER_INPUT:
            yield c, "Input is printed as it came."


def load() -> None:
    """Registers the rules of the other modules."""
    from . import lint_flow, lint_libraries  # noqa: F401


def lint(source: bytes | str, name: str = "", codes: set[str] | None = None, everything: bool = False) -> list[tuple[str, int, str, int, int]]:
    """Code, level, message, start and stop of each issue, by place."""
    load()
    root, parser = parse(source)
    ctx = Context(root, parser, name)
    by: dict[str, list[Rule]] = defaultdict(list)
    for r in RULES.values():
        if (r.code in codes) if codes is not None else (r.on or everything):
            for k in r.kinds:
                by[k].append(r)
    out = [("syntax", ERROR, e.value, e.start, e.stop) for e in parser.errors]
    for n in root.walk():
        for r in by.get(n.kind, ()):
            out += [(r.code, r.level, message, x.start, x.stop) for x, message in r.check(ctx, n)]
    return sorted(out, key=lambda i: (i[3], i[4], i[0]))


ISSUE = "file_id bigint, file string, code string, level int, message string, start int, stop int, ordinal bigint"


def lint_files(files: DataFrame, codes: set[str] | None = None, everything: bool = False) -> DataFrame:
    """Issues of a file table (``file_id``, ``name``, ``contents``)."""
    rows = files.select(F.col("file_id").cast("bigint"), F.col("name").cast("string"), F.col("contents").cast("binary"))

    def run(batches):
        for batch in batches:
            out = []
            for i, name, contents in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                out += [(i, name, *issue, n) for n, issue in enumerate(lint(contents or b"", name or "", codes, everything))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["file_id", "file", "code", "level", "message", "start", "stop", "ordinal"])

    return rows.mapInArrow(run, ISSUE)
