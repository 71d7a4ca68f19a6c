"""Lint rules about variables' use, redundancy and configured bans."""

from __future__ import annotations

import re

from .lint import CLASSES, FUNCTIONS, HELP, LOOPS, NOTE, WARNING, Context, args, bare, called, in_namespace, literal, own, rule, statements, string_value, use_items
from .syntax import Node


@rule("switch-continue-to-break", WARNING, "continue", on=False)
def _(ctx, n):
    inner = ctx.inside(n, "switch", *LOOPS, *FUNCTIONS)
    if inner is not None and inner.kind == "switch" and n.role("value_") is None:
        yield n, "In a switch continue means break."


@rule("inline-variable-return", WARNING, "block", "program", "colon_block")
def _(ctx, n):
    body = statements(n)
    for a, b in zip(body, body[1:]):
        e = a.role("expression") if a.kind == "expression_statement" else None
        v = b.role("value_") if b.kind == "return" else None
        if e is not None and e.kind == "assignment" and e.value == "=" and "reference" not in e.flags and v is not None and v.kind == "variable" and e.role("target").kind == "variable" and e.role("target").value == v.value:
            yield a, f"Return the value of {v.value} at once."


@rule("no-duplicate-match-arm", NOTE, "match")
def _(ctx, n):
    seen: set[str] = set()
    for a in n.children:
        r = a.role("result") if a.kind == "match_arm" else None
        if r is not None:
            t = " ".join(ctx.text(r).split())
            if t in seen:
                yield a, "Two arms give the same result."
            seen.add(t)


@rule("no-is-null", NOTE, "call", on=False)
def _(ctx, n):
    if called(n) == "is_null":
        yield n, "Compare with null."


@rule("no-iterator-to-array-in-foreach", WARNING, "foreach", on=False)
def _(ctx, n):
    if called(bare(n.role("over")) or n) == "iterator_to_array":
        yield n.role("over"), "A loop goes over the iterator itself."


@rule("no-null-property-init", HELP, "property", on=False)
def _(ctx, n):
    for i in n.children:
        v = i.role("value_") if i.kind == "property_item" else None
        if n.role("hint") is None and v is not None and v.kind == "name" and v.value.lower() == "null":
            yield i, "A property without a type is null at first."


@rule("no-protected-in-final", HELP, "method", "property", "class_constant")
def _(ctx, n):
    c = ctx.inside(n, *CLASSES)
    if "protected" in n.flags and c is not None and (c.kind == "enum" or "final" in c.flags and c.role("extends") is None):
        yield n, "Nothing extends the class: make it private."


@rule("no-redundant-binary-string-prefix", HELP, "string", "template")
def _(ctx, n):
    if n.value[:1] in "bB" and n.value[1:2] in "\"'<":
        yield n, "The prefix does nothing."


@rule("no-redundant-isset", HELP, "isset")
def _(ctx, n):
    texts = [ctx.text(a) for a in args(n)]
    for i, t in enumerate(texts):
        if any(o != t and o.startswith(t) and o[len(t) : len(t) + 1] in ("[", "-", "?") for o in texts):
            yield args(n)[i], f"{t} is tested with what it holds."


@rule("no-redundant-literal-return", WARNING, "block")
def _(ctx, n):
    body = statements(n)
    for a, b in zip(body, body[1:]):
        t = bare(a.role("test")) if a.kind == "if" and a.role("other") is None else None
        inner = statements(a.role("then")) if t is not None else []
        if t is not None and t.kind == "binary" and t.value == "===" and len(inner) == 1 and inner[0].kind == "return" and b.kind == "return" and b.role("value_") is not None and inner[0].role("value_") is not None:
            x, y = t.role("left"), t.role("right")
            x, y = (y, x) if literal(x) else (x, y)
            if literal(y) and ctx.text(inner[0].role("value_")) == ctx.text(y) and ctx.text(b.role("value_")) == ctx.text(x):
                yield a, "Both ways return the same."


@rule("no-redundant-nullsafe", HELP, "binary", "isset", "empty")
def _(ctx, n):
    inside = [n.role("left")] if n.kind == "binary" and n.value == "??" else args(n) if n.kind != "binary" else []
    for a in inside:
        for c in [a, *own(a)]:
            if c.kind == "nullsafe_property":
                yield c, "Null is taken care of anyway."


@rule("no-redundant-write-visibility", HELP, "property", "parameter")
def _(ctx, n):
    for v in ("public", "protected", "private"):
        if f"{v}(set)" in n.flags and (v in n.flags or v == "public" and not n.flags & {"protected", "private"}):
            yield n, "Writing is as visible as reading."


@rule("string-style", NOTE, "binary", on=False)
def _(ctx, n):
    if n.value == "." and {n.role("left").kind, n.role("right").kind} & {"string"} and {n.role("left").kind, n.role("right").kind} & {"variable", "property_access"}:
        yield n, "Interpolate in place of joining."


@rule("ambiguous-constant-access", HELP, "name", on=False)
def _(ctx, n):
    p = ctx.parents.get(id(n))
    if p is None or "\\" in n.value or n.value.lower() in ("true", "false", "null", "self", "static", "parent") or not in_namespace(ctx):
        return
    if p.kind in ("call", "new", "extends", "implements", "static_call", "static_property", "class_constant_access", "trait_use") or p.kind == "binary" and p.value == "instanceof":
        return
    if n.value not in {a for _, k, _, a in use_items(ctx) if k == "const"}:
        yield n, "The constant may be of the namespace or global."


@rule("no-literal-namespace-string", WARNING, "string", on=False)
def _(ctx, n):
    t = string_value(n)
    if t and re.fullmatch(r"\\{0,2}[A-Z]\w*(\\{1,2}[A-Z]\w*)+", t):
        yield n, "Name the class by ::class."


# Use of variables within one function.


def uses(ctx: Context, scope: Node) -> list[tuple[int, str, str]]:
    """Place, name and kind (read, write) of each simple variable of a function, in order of evaluation."""
    out = []
    for c in own(scope, "function", "method", *CLASSES):
        if c.kind in ("template", "shell", "string") and c.kind != "string":
            out += [(c.start, "$" + w, "read") for w in re.findall(r"\$\{?([A-Za-z_]\w*)", c.value)]
        if c.kind == "capture":
            out.append((c.start, c.value, "read"))
        if c.kind == "variable":
            p = ctx.parents.get(id(c))
            if p is not None and p.kind == "assignment" and p.role("target") is c and p.value == "=" and "reference" not in p.flags:
                out.append((p.stop, c.value, "write"))
            else:
                out.append((c.start, c.value, "read"))
    return sorted(out)


def simple(scope: Node) -> bool:
    """Whether nothing in the function hides what is read: no variable variables, references, extract or compact."""
    return not any(c.kind in ("variable_variable", "global", "static_variables", "include", "goto") or called(c) in ("extract", "compact", "get_defined_vars", "parse_str") or "reference" in c.flags for c in own(scope))


@rule("no-redundant-variable", WARNING, "function", "method", "closure", on=False)
def _(ctx, n):
    if n.role("body") is None or not simple(n):
        return
    found = uses(ctx, n.role("body"))
    read = {v for _, v, k in found if k == "read"}
    params = {p.value for p in (n.role("parameters").children if n.role("parameters") else []) if "reference" in p.flags}
    for c in own(n.role("body")):
        if c.kind == "assignment" and c.value == "=" and c.role("target").kind == "variable" and c.role("target").value not in read | params | {"$this"}:
            yield c, f"{c.role('target').value} is never read."


@rule("no-dead-store", WARNING, "block", on=False)
def _(ctx, n):
    scope = ctx.inside(n, *FUNCTIONS)
    if scope is None or not simple(scope):
        return
    last: dict[str, Node] = {}
    for s in statements(n):
        e = s.role("expression") if s.kind == "expression_statement" else None
        plain = e is not None and e.kind == "assignment" and e.value == "=" and e.role("target").kind == "variable"
        read = {v for _, v, k in uses(ctx, s) if k == "read"} if not plain else {v for _, v, k in uses(ctx, e) if k == "read"}
        for v in read:
            last.pop(v, None)
        if plain:
            v = e.role("target").value
            if v in last:
                yield last[v], f"{v} is overwritten before it is read."
            last[v] = e
        elif s.kind not in ("expression_statement", "echo"):
            last.clear()


@rule("no-unused-static", WARNING, "static_variables", on=False)
def _(ctx, n):
    scope = ctx.inside(n, *FUNCTIONS)
    for c in n.children:
        v = c.role("target") if c.kind == "assignment" else c
        if scope is not None and v.kind == "variable" and sum(x.kind == "variable" and x.value == v.value for x in own(scope)) < 2:
            yield v, f"{v.value} is not used."


#: What the configured rules ban; set from outside.
BANNED: dict[str, set[str]] = {"functions": set(), "types": set()}


@rule("disallowed-functions", WARNING, "call")
def _(ctx, n):
    if called(n) in BANNED["functions"]:
        yield n, f"{called(n)} is banned."


@rule("disallowed-type-instantiation", WARNING, "new", on=False)
def _(ctx, n):
    t = n.role("target")
    if t is not None and t.kind == "name" and t.value.lstrip("\\").lower() in BANNED["types"]:
        yield n, f"{t.value} is not made here."


@rule("no-service-state-mutation", WARNING, "assignment", on=False)
def _(ctx, n):
    t, m, c = n.role("target"), ctx.inside(n, "method"), ctx.inside(n, *CLASSES)
    if t is not None and t.kind == "property_access" and t.role("target").value == "$this" and m is not None and m.value.lower() not in ("__construct", "reset", "__set") and c is not None and c.value.endswith("Service"):
        yield n, "A service keeps no state."
