"""Findings within one file that need no other: variables, reachability, duplicates, matches.

Codes are those of the whole-program analyzer; what needs types beyond literals
is not here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lint import CLASSES, ERROR, FUNCTIONS, HELP, ISSUE, LOOPS, WARNING, Context, args, bare, called, integer, literal, own, statements
from .syntax import Node, parse

Found = Iterator[tuple[str, int, Node, str]]
#: Variables that are always there, and functions whose call does nothing but give a value.
GIVEN = frozenset("$this $GLOBALS $_GET $_POST $_REQUEST $_COOKIE $_FILES $_SERVER $_ENV $_SESSION $argc $argv $http_response_header $php_errormsg".split())
PURE = frozenset("strlen count strtolower strtoupper trim ltrim rtrim substr strpos str_replace implode explode array_merge array_map array_filter array_keys array_values in_array is_null is_int is_string is_array is_bool abs max min round floor ceil sprintf json_encode md5 sha1 array_key_exists str_contains str_starts_with str_ends_with".split())
BY_REFERENCE = frozenset("preg_match preg_match_all sscanf exec openssl_sign similar_text getopt str_replace settype parse_str array_push array_pop array_shift array_unshift sort rsort usort ksort krsort asort arsort uasort uksort shuffle end reset next prev current key array_splice array_multisort list each".split())


def key_of(n: Node | None) -> object:
    n = bare(n)
    if n is None:
        return None
    if n.kind == "integer":
        return integer(n.value)
    if n.kind == "string" and not n.value.startswith("<<<"):
        t = n.value.lstrip("bB")[1:-1]
        return int(t) if re.fullmatch(r"0|-?[1-9]\d{0,17}", t) else t
    if n.kind == "name" and n.value.lower() in ("true", "false", "null"):
        return {"true": 1, "false": 0, "null": ""}[n.value.lower()]
    return None


def duplicates(ctx: Context, n: Node) -> Found:
    if n.kind in ("array", "legacy_array"):
        seen = set()
        for e in n.children:
            k = key_of(e.role("key"))
            if k is not None and k in seen:
                yield "duplicate-array-key", ERROR, e, f"Key {k!r} stands twice."
            seen.add(k)
    elif n.kind == "switch":
        seen = set()
        for c in n.children:
            v = c.role("value_") if c.kind == "switch_case" else None
            if v is not None and literal(v):
                t = ctx.text(v)
                if t in seen:
                    yield "duplicate-switch-case", ERROR, c, f"Case {t} stands twice."
                seen.add(t)
    elif n.kind == "try":
        seen = set()
        for c in n.children:
            for t in re.findall(r"[\w\\]+", c.role("types").value) if c.kind == "catch" else ():
                if t.lower() in seen:
                    yield "duplicate-caught-type", WARNING, c, f"{t} is caught already."
                seen.add(t.lower())
                if t.lstrip("\\") in ("Error", "Throwable"):
                    yield "avoid-catching-error", WARNING, c, "Errors are not to be caught."
    elif n.kind == "enum":
        seen = set()
        for c in n.children:
            k = key_of(c.role("value_")) if c.kind == "enum_case" else None
            if k is not None and k in seen:
                yield "duplicate-enum-case-value", ERROR, c, f"Value {k!r} stands twice."
            seen.add(k)
    elif n.kind == "closure":
        seen = set()
        for c in n.children:
            if c.kind == "capture":
                if c.value in seen:
                    yield "duplicate-closure-use-variable", ERROR, c, f"{c.value} is captured twice."
                seen.add(c.value)


def calls(ctx: Context, n: Node) -> Found:
    if n.kind not in ("call", "method_call", "static_call", "nullsafe_call", "new"):
        return
    seen, named = set(), False
    for a in args(n):
        if a.value:
            if a.value in seen:
                yield "duplicate-named-argument", ERROR, a, f"Argument {a.value} stands twice."
            seen.add(a.value)
            named = True
        elif named and "spread" not in a.flags:
            yield "named-argument-after-positional", ERROR, a, "A positional argument follows a named one."
    p = ctx.parents.get(id(n))
    if n.kind == "call" and called(n) in PURE and p is not None and p.kind == "expression_statement":
        yield "unused-function-call", WARNING, n, f"The value of {called(n)} is not used."
    if n.kind == "static_call" and n.role("member") is not None and n.role("member").kind == "variable":
        yield "dynamic-static-method-call", WARNING, n, "The method is not known by name."


def matches(ctx: Context, n: Node) -> Found:
    if n.kind != "match":
        return
    arms = [c for c in n.children if c.kind == "match_arm"]
    default = next((c for c in n.children if c.kind == "match_default"), None)
    if not arms and default is None:
        yield "empty-match-expression", ERROR, n, "A match has arms."
    elif not arms:
        yield "match-expression-only-default-arm", WARNING, n, "Only the default decides."
    subject = bare(n.role("test"))
    seen: set[str] = set()
    for i, a in enumerate(arms):
        for c in a.children:
            if c is a.role("result"):
                continue
            t = ctx.text(c)
            if literal(c) and t in seen:
                yield "unreachable-match-arm", WARNING, a, f"{t} is matched before."
            seen.add(t)
            if literal(subject) and literal(c) and ctx.text(subject) == t:
                yield "match-arm-always-true", WARNING, a, "This arm always matches."
                if i + 1 < len(arms):
                    yield "unreachable-match-arm", WARNING, arms[i + 1], "An arm before always matches."
                if default is not None:
                    yield "unreachable-match-default-arm", WARNING, default, "An arm always matches."


def flow(ctx: Context, n: Node) -> Found:
    """Statements that nothing reaches, and functions that end without their value."""
    if n.kind in ("block", "program", "colon_block", "switch_case", "switch_default"):
        body = [c for c in n.children if c.kind not in ("noop", "function", *CLASSES, "label", "inline", "opening_tag", "closing_tag", "use", "constant", "halt_compiler", "namespace") and c is not n.role("value_")]
        for a, b in zip(body, body[1:]):
            if leaves(a):
                yield "unevaluated-code", HELP, b, "Nothing comes here."
                break
    if n.kind in ("function", "method", "closure") and n.role("returns") is not None and n.role("body") is not None:
        kind = n.role("returns").value.lower()
        generator = any(c.kind in ("yield", "yield_from") for c in own(n.role("body")))
        if kind not in ("void", "never", "mixed", "null") and not generator and not kind.startswith("?") and not ends(n.role("body")):
            yield "missing-return-statement", ERROR, n, f"{n.value or 'The closure'} may end without a value."
        if kind == "never" and any(c.kind == "return" for c in own(n.role("body"))):
            yield "never-return", ERROR, n, "It never returns."
    if n.kind == "expression_statement":
        e = bare(n.role("expression"))
        if e is not None and e.kind in ("variable", "integer", "float", "string", "template", "property_access", "array_access", "class_constant_access", "array", "closure", "arrow_function", "isset", "empty") or e is not None and e.kind == "binary" and e.value not in ("&&", "||", "and", "or", "??", "|>"):
            yield "unused-statement", WARNING, n, "The value is not used."
    if n.kind in ("if", "elseif", "while", "ternary") and n.role("test") is not None:
        t = bare(n.role("test"))
        v = t.value.lower() if t.kind == "name" else ""
        if t.kind == "binary" and t.value in ("===", "==") and literal(t.role("left")) and literal(t.role("right")):
            v = "true" if ctx.text(t.role("left")) == ctx.text(t.role("right")) else "false"
        if v == "true" and n.kind != "while":
            yield "redundant-condition", WARNING, t, "It is always true."
        if v == "false":
            yield "impossible-condition", WARNING, t, "It is never true."
    if n.kind == "binary" and n.value in ("===", "!==", "==", "!=", "<", ">", "<=", ">=", "<=>") and n.role("left").kind == n.role("right").kind == "variable" and n.role("left").value == n.role("right").value:
        yield "redundant-comparison", WARNING, n, "Both sides are the same."
    if n.kind == "binary" and n.value in ("&&", "||", "and", "or") and ctx.text(n.role("left")) == ctx.text(n.role("right")):
        yield "redundant-logical-operation", WARNING, n, "Both sides are the same."
    if n.kind == "cast":
        o = bare(n.role("operand"))
        if o is not None and (n.value, o.kind) in {("int", "integer"), ("string", "string"), ("float", "float"), ("array", "array"), ("string", "template")}:
            yield "redundant-cast", HELP, n, f"It is {n.value} already."
    if n.kind == "clone" and ctx.inside(n, *LOOPS, *FUNCTIONS) is not None and ctx.inside(n, *LOOPS, *FUNCTIONS).kind in LOOPS:
        yield "clone-inside-loop", WARNING, n, "Each round makes a copy."


def leaves(s: Node) -> bool:
    """Whether control goes elsewhere from a statement, always."""
    if s.kind in ("return", "break", "continue", "goto"):
        return True
    e = s.role("expression") if s.kind == "expression_statement" else None
    if e is not None and e.kind in ("throw", "exit"):
        return True
    if s.kind in ("block", "colon_block"):
        return any(leaves(c) for c in statements(s))
    if s.kind == "if":
        parts = [s, *(c for c in s.children if c.kind == "elseif")]
        return s.role("other") is not None and all(leaves(p.role("then")) for p in [*parts, s.role("other")])
    return False


def ends(b: Node) -> bool:
    """Whether a body never comes to its end: it returns, throws or loops for ever."""
    for s in statements(b):
        if s.kind == "return" or s.kind == "goto":
            return True
        e = s.role("expression") if s.kind == "expression_statement" else None
        if e is not None and e.kind in ("throw", "exit"):
            return True
        if s.kind in ("block", "colon_block") and ends(s):
            return True
        if s.kind == "if":
            parts = [s, *(c for c in s.children if c.kind == "elseif")]
            if s.role("other") is not None and all(ends(p.role("then")) for p in [*parts, s.role("other")]):
                return True
        if s.kind == "try":
            last = s.role("last")
            if last is not None and ends(last.role("body")):
                return True
            if ends(s.role("body")) and all(ends(c.role("body")) for c in s.children if c.kind == "catch"):
                return True
        if s.kind in ("while", "do_while", "for"):
            t = s.role("test")
            endless = t is not None and (t.kind == "name" and t.value.lower() == "true" or t.kind == "integer" and t.value == "1" or t.kind == "for_part" and not t.children)
            if endless and not any(c.kind == "break" for c in own(s)):
                return True
        if s.kind == "switch" and any(c.kind == "switch_default" for c in s.children) and not any(c.kind == "break" for c in own(s)):
            groups = [c for c in s.children if c.kind in ("switch_case", "switch_default")]
            last_body = groups[-1]
            if all(not [x for x in g.children if x is not g.role("value_")] or any(leaves(x) for x in g.children if x is not g.role("value_")) for g in groups) and any(leaves(x) for x in last_body.children if x is not last_body.role("value_")):
                return True
    return False


def writes(n: Node) -> Iterator[str]:
    """Variables that a node may set."""
    if n.kind == "assignment":
        yield from targets(n.role("target"))
    elif n.kind == "foreach":
        for r in ("key", "value_"):
            if n.role(r) is not None:
                yield from targets(n.role(r))
    elif n.kind in ("global", "static_variables"):
        for c in n.children:
            yield from targets(c.role("target") if c.kind == "assignment" else c)
    elif n.kind == "catch" and n.role("variable") is not None:
        yield n.role("variable").value
    elif n.kind in ("call", "method_call", "static_call", "new", "nullsafe_call"):
        known = called(n)
        for a in args(n):
            v = a.role("value_")
            if v is not None and v.kind in ("variable", "array_access", "append") and (n.kind != "call" or known in BY_REFERENCE or known not in PURE):
                yield from targets(v)
    elif n.kind == "prefix" and n.value == "&" or n.kind in ("capture", "parameter") or n.kind == "assignment" and "reference" in n.flags:
        for c in n.children:
            yield from targets(c)


def targets(t: Node | None) -> Iterator[str]:
    t = bare(t)
    if t is None:
        return
    if t.kind == "variable":
        yield t.value
    elif t.kind in ("array_access", "append", "property_access"):
        yield from targets(t.role("target"))
    elif t.kind in ("array", "list", "legacy_array"):
        for e in t.children:
            if e.kind == "element":
                yield from targets(e.role("value_"))


def variables(ctx: Context, n: Node) -> Found:
    """Variables that a function reads and nothing in it sets, and parameters that it does not read."""
    if n.kind not in ("function", "method", "closure") or n.role("body") is None:
        return
    body = n.role("body")
    inside = list(own(body, "function", "method", *CLASSES, "closure"))
    if any(c.kind in ("variable_variable", "include", "eval") or called(c) in ("extract", "parse_str", "get_defined_vars") for c in inside):
        return
    params = {p.value for p in n.role("parameters").children}
    known = set(params) | GIVEN | {c.value for c in n.children if c.kind == "capture"}
    for c in inside:
        known |= set(writes(c))
        if c.kind == "arrow_function":
            known |= {p.value for p in c.role("parameters").children}
        if c.kind == "closure":
            known |= {x.value for x in c.children if x.kind == "capture" and "reference" in x.flags}
    read = set()
    guarded = {id(v) for c in inside if c.kind in ("isset", "empty", "unset") or c.kind == "binary" and c.value == "??" for v in c.walk() if v.kind == "variable"}
    for c in inside:
        if c.kind == "variable":
            read.add(c.value)
            p = ctx.parents.get(id(c))
            if c.value not in known and id(c) not in guarded and not (p is not None and p.kind == "static_property" and p.role("member") is c):
                yield "undefined-variable", ERROR, c, f"{c.value} is not defined."
        elif c.kind in ("template", "shell"):
            read |= {"$" + w for w in re.findall(r"\$\{?([A-Za-z_]\w*)", c.value)}
        elif c.kind == "closure":
            for x in c.children:
                if x.kind == "capture":
                    read.add(x.value)
                    if x.value not in known:
                        yield "undefined-variable-in-closure-use", ERROR, x, f"{x.value} is not defined."
        elif called(c) == "compact":
            read |= {"$" + a.role("value_").value[1:-1] for a in args(c) if a.role("value_").kind == "string"}
        elif called(c) in ("func_get_args", "func_get_arg"):
            read |= params
    owner = ctx.inside(n, *CLASSES)
    free = n.kind != "method" or owner is not None and ("private" in n.flags or "final" in n.flags and owner.role("extends") is None and owner.role("implements") is None) or n.value == "__construct"
    for p in n.role("parameters").children:
        if free and p.value not in read and not p.flags & {"public", "protected", "private", "readonly"} and not p.value.startswith("$_"):
            yield "unused-parameter", HELP, p, f"{p.value} is not used."


def hints(ctx: Context, n: Node) -> Found:
    if n.kind == "parameter" and n.role("hint") is None:
        owner = ctx.parents.get(id(ctx.parents.get(id(n))))
        if owner is not None and owner.kind in ("function", "method"):
            yield "missing-parameter-type", WARNING, n, f"{n.value} has no type."
    elif n.kind == "property" and n.role("hint") is None:
        yield "missing-property-type", WARNING, n, "A property has no type."
    elif n.kind in ("function", "method") and n.role("returns") is None and n.value.lower() not in ("__construct", "__destruct", "__clone"):
        yield "missing-return-type", WARNING, n, f"{n.value} has no return type."


def scopes(ctx: Context, n: Node) -> Found:
    if n.kind == "name" and n.value.lower() in ("self", "static", "parent"):
        c = ctx.inside(n, *CLASSES)
        low = n.value.lower()
        if c is None and not any(p.kind in ("closure", "arrow_function") for p in ctx.up(n)):
            yield f"{low}-outside-class-scope", ERROR, n, f"{low} is outside of a class."
        elif low == "parent" and c is not None and c.kind in ("class", "anonymous_class") and c.role("extends") is None:
            yield "invalid-parent-type", ERROR, n, "The class has no parent."
    elif n.kind in ("yield", "yield_from") and ctx.inside(n, *FUNCTIONS, "hook") is None:
        yield "yield-outside-function", ERROR, n, "Only functions yield."
    elif n.kind == "assignment" and bare(n.role("target")) is not None:
        t = bare(n.role("target"))
        if t.value == "$this" and t.kind == "variable":
            yield "assignment-to-this", ERROR, n, "$this is not assigned to."
        elif t.kind in ("name", "class_constant_access"):
            yield "assignment-to-constant", ERROR, n, "Constants are not assigned to."
        elif t.kind in ("array", "list", "legacy_array"):
            elements = [e for e in t.children if e.kind == "element"]
            if any("spread" in e.flags for e in elements):
                yield "spread-in-destructuring", ERROR, t, "Lists do not spread."
            if any(e.kind == "missing_element" for e in t.children) and any(e.role("key") is not None for e in elements):
                yield "skip-in-keyed-destructuring", ERROR, t, "Lists with keys skip nothing."
    elif n.kind == "append":
        p = ctx.parents.get(id(n))
        if p is not None and p.kind in ("binary", "echo", "return", "ternary", "argument") and p.kind != "argument":
            yield "array-append-in-read-context", ERROR, n, "An empty index is not read."
    elif n.kind in ("break", "continue"):
        depth = 0
        for p in ctx.up(n):
            if p.kind in (*FUNCTIONS, *CLASSES):
                break
            depth += p.kind in (*LOOPS, "switch")
        v = n.role("value_")
        if depth < (int(v.value) if v is not None and v.kind == "integer" and v.value.isdigit() else 1):
            yield f"invalid-{n.kind}", ERROR, n, f"{n.kind} is not within a loop."


PASSES = (duplicates, calls, matches, flow, variables, hints, scopes)


def analyze(source: bytes | str) -> list[tuple[str, int, str, int, int]]:
    root, parser = parse(source)
    ctx = Context(root, parser)
    out = {("syntax", ERROR, e.value, e.start, e.stop) for e in parser.errors}
    for n in root.walk():
        for p in PASSES:
            out |= {(code, level, message, x.start, x.stop) for code, level, x, message in p(ctx, n)}
    return sorted(out, key=lambda i: (i[3], i[4], i[0]))


def analyze_files(files: DataFrame) -> DataFrame:
    """Issues of a file table (``file_id``, ``name``, ``contents``)."""
    rows = files.select(F.col("file_id").cast("bigint"), F.col("name").cast("string"), F.col("contents").cast("binary"))

    def run(batches):
        for batch in batches:
            out = [(i, name, *issue, n) for i, name, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for n, issue in enumerate(analyze(c or b""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["file_id", "file", "code", "level", "message", "start", "stop", "ordinal"])

    return rows.mapInArrow(run, ISSUE)
