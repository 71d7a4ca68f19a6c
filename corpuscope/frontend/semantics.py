"""Legality of one file: what a compiler refuses without knowing other files."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lint import CLASSES, ERROR, FUNCTIONS, ISSUE, LOOPS, Context, args, bare, own
from .syntax import Node, parse

VISIBILITY = ("public", "protected", "private")
#: Names that classes do not take, and methods with a shape of their own.
RESERVED = frozenset("self static parent int float bool string true false null void never iterable object mixed array callable".split())
MAGIC_ARGUMENTS = {"__get": 1, "__set": 2, "__isset": 1, "__unset": 1, "__call": 2, "__callstatic": 2, "__tostring": 0, "__clone": 0, "__destruct": 0, "__sleep": 0, "__wakeup": 0, "__serialize": 0, "__unserialize": 1, "__set_state": 1, "__debuginfo": 0}
MAGIC_STATIC = {"__callstatic": True, "__set_state": True, "__get": False, "__set": False, "__isset": False, "__unset": False, "__call": False, "__tostring": False, "__construct": False, "__destruct": False, "__clone": False}
CHECKS: dict[str, list] = defaultdict(list)


def check(*kinds: str):
    def add(f):
        for k in kinds:
            CHECKS[k].append(f)
        return f

    return add


Found = Iterator[tuple[Node, str]]


@check("namespace")
def namespaces(ctx: Context, n: Node) -> Found:
    before = [c for c in ctx.root.children if c.start < n.start and c.kind not in ("opening_tag", "declare", "namespace", "noop", "inline", "halt_compiler", "closing_tag") or c.kind == "inline" and c.start < n.start and ctx.text(c).strip() and not ctx.text(c).startswith("#!")]
    others = [c for c in ctx.root.children if c.kind == "namespace" and c is not n]
    if not others and before:
        yield n, "A namespace stands before all else."
    if any((o.role("body") is None) != (n.role("body") is None) for o in others):
        yield n, "Namespaces with and without braces do not mix."
    if ctx.parents.get(id(n)) is not ctx.root:
        yield n, "Namespaces do not nest."


@check("declare")
def declares(ctx: Context, n: Node) -> Found:
    for i in n.children:
        if i.kind == "constant_item":
            name, v = i.value.lower(), i.role("value_")
            if name not in ("strict_types", "ticks", "encoding"):
                yield i, f"Unknown directive {i.value}."
            elif name == "strict_types":
                if v is None or v.value not in ("0", "1"):
                    yield i, "strict_types is 0 or 1."
                first = next((c for c in ctx.root.children if c.kind not in ("opening_tag", "noop", "inline")), None)
                if first is not n and (first is None or first.kind != "declare"):
                    yield n, "strict_types is declared first."
            elif v is not None and v.kind not in ("integer", "string"):
                yield i, f"{i.value} takes a literal."


@check("break", "continue")
def loops(ctx: Context, n: Node) -> Found:
    v = n.role("value_")
    depth = 0
    for p in ctx.up(n):
        if p.kind in (*FUNCTIONS, *CLASSES):
            break
        depth += p.kind in (*LOOPS, "switch")
    if v is not None and (v.kind != "integer" or v.value == "0"):
        yield n, f"{n.kind} takes a positive number."
    elif depth < int(v.value if v is not None else 1):
        yield n, f"{n.kind} is not within enough loops."


@check("goto")
def gotos(ctx: Context, n: Node) -> Found:
    if not any(c.kind == "label" and c.value == n.value for c in ctx.root.walk()):
        yield n, f"No label {n.value}."


@check("program", "function", "method", "closure")
def labels(ctx: Context, n: Node) -> Found:
    count: Counter = Counter()
    for c in own(n):
        if c.kind == "label":
            count[c.value] += 1
            if count[c.value] == 2:
                yield c, f"Label {c.value} stands twice."


@check("try")
def tries(ctx: Context, n: Node) -> Found:
    if not any(c.kind in ("catch", "finally") for c in n.children):
        yield n, "A try has a catch or a finally."


@check("switch", "match")
def defaults(ctx: Context, n: Node) -> Found:
    found = [c for c in n.children if c.kind in ("switch_default", "match_default")]
    if len(found) > 1:
        yield found[1], "One default is enough."


@check("assignment")
def assignments(ctx: Context, n: Node) -> Found:
    t = n.role("target")
    while t is not None and t.kind == "parenthesized":
        t = t.role("expression")
    if t is not None and t.kind == "variable" and t.value == "$this":
        yield n, "$this is not assigned to."
    elif t is not None and t.kind in ("integer", "float", "string", "template", "binary", "call", "new", "closure", "match", "name", "class_constant_access", "ternary", "cast") or t is not None and t.kind in ("nullsafe_property", "nullsafe_call"):
        yield t, "This cannot be assigned to."
    elif t is not None and t.kind in ("array", "list", "legacy_array"):
        yield from destructured(t)


def destructured(t: Node) -> Found:
    items = [c for c in t.children if c.kind == "element"]
    if not items:
        yield t, "An empty list cannot be assigned to."
    if any("spread" in c.flags for c in items):
        yield t, "Lists do not spread."
    if len({c.role("key") is None for c in items}) > 1:
        yield t, "Lists have keys or none."


@check("array", "legacy_array", "list")
def holes(ctx: Context, n: Node) -> Found:
    p = ctx.parents.get(id(n))
    target = p is not None and (p.kind == "assignment" and p.role("target") is n or p.kind == "foreach" or p.kind == "element")
    if n.kind != "list" and not target and any(c.kind == "missing_element" for c in n.children):
        yield n, "An element is missing."


@check("call", "method_call", "static_call", "nullsafe_call", "new")
def argument_lists(ctx: Context, n: Node) -> Found:
    named = spread = False
    seen: set[str] = set()
    for a in args(n):
        if a.value:
            if a.value in seen:
                yield a, f"Argument {a.value} stands twice."
            seen.add(a.value)
            named = True
            if "spread" in a.flags:
                yield a, "A spread argument has no name."
        else:
            if named and "spread" not in a.flags:
                yield a, "A positional argument follows a named one."
            if spread and "spread" not in a.flags:
                yield a, "A positional argument follows a spread one."
        spread |= "spread" in a.flags
    if n.kind == "new" and any(c.kind == "placeholder" for c in n.children):
        yield n, "Constructors are not taken as values."
    if n.kind == "nullsafe_call" and any(c.kind == "placeholder" for c in n.children):
        yield n, "A call that may not happen is not taken as a value."


@check("parameters")
def parameter_lists(ctx: Context, n: Node) -> Found:
    seen: set[str] = set()
    owner = ctx.parents[id(n)]
    for i, p in enumerate(n.children):
        if p.value in seen:
            yield p, f"Parameter {p.value} stands twice."
        seen.add(p.value)
        if p.value == "$this":
            yield p, "$this is not a parameter."
        if "variadic" in p.flags:
            if i < len(n.children) - 1:
                yield p, "A variadic parameter is the last."
            if p.role("default") is not None:
                yield p, "A variadic parameter has no default."
        promoted = p.flags & {*VISIBILITY, "readonly"}
        if promoted:
            if owner.value.lower() != "__construct":
                yield p, "Only constructors promote parameters."
            elif owner.role("body") is None:
                yield p, "An abstract constructor promotes nothing."
            if "variadic" in p.flags:
                yield p, "A variadic parameter is not promoted."
            if "readonly" in p.flags and p.role("hint") is None:
                yield p, "A readonly property has a type."
        hint = p.role("hint")
        if hint is not None and hint.value.lower().lstrip("?") in ("void", "never", "static"):
            yield hint, f"{hint.value} is not a parameter's type."


@check("type")
def types(ctx: Context, n: Node) -> Found:
    parts = [w for w in re.split(r"[|()&\s]+", n.value) if w]
    low = [w.lower().lstrip("?") for w in parts]
    if "|" in n.value:
        if n.value.startswith("?"):
            yield n, "A union says null by name."
        if "mixed" in low or "void" in low or "never" in low:
            yield n, "This type stands alone."
        if "&" not in n.value and len(set(low)) < len(low):
            yield n, "A type stands twice."
        if {"true", "false"} <= set(low) or "bool" in low and set(low) & {"true", "false"}:
            yield n, "The union is bool."
    elif n.value.startswith("?") and low and low[0] in ("mixed", "null", "void", "never"):
        yield n, "This type does not take a question mark."
    elif "&" in n.value and set(low) & (RESERVED - {"self", "static", "parent"}):
        yield n, "Intersections are of classes."


@check("function", "method", "closure", "arrow_function")
def returns(ctx: Context, n: Node) -> Found:
    hint = n.role("returns")
    kind = hint.value.lower() if hint is not None else ""
    body = n.role("body")
    if body is None or n.kind == "arrow_function":
        return
    found = list(own(body))
    for r in found:
        if r.kind == "return":
            if kind == "never":
                yield r, "Nothing returns from never."
            if kind == "void" and r.role("value_") is not None:
                yield r, "Nothing is returned from void."
            generator = any(c.kind in ("yield", "yield_from") for c in found)
            if kind not in ("", "void", "never") and r.role("value_") is None and not generator:
                yield r, "A value is to be returned."
    if kind in ("void", "never", "int", "string", "bool", "array", "float") and any(c.kind in ("yield", "yield_from") for c in found):
        yield hint, "A generator does not return this."


@check("yield", "yield_from", "return")
def outside(ctx: Context, n: Node) -> Found:
    if n.kind != "return" and ctx.inside(n, *FUNCTIONS, "hook") is None:
        yield n, "Only functions yield."


@check("closure")
def captures(ctx: Context, n: Node) -> Found:
    params = {p.value for p in n.role("parameters").children}
    seen: set[str] = set()
    for c in n.children:
        if c.kind == "capture":
            if c.value == "$this":
                yield c, "$this is there without capture."
            if c.value in params:
                yield c, f"{c.value} is a parameter too."
            if c.value in seen:
                yield c, f"{c.value} is captured twice."
            seen.add(c.value)


@check("array_access", "append")
def appends(ctx: Context, n: Node) -> Found:
    p = ctx.parents.get(id(n))
    if n.kind == "append" and p is not None and p.kind in ("binary", "echo", "return", "postfix", "ternary"):
        yield n, "An empty index is not read."


@check("constant", "class_constant")
def constants(ctx: Context, n: Node) -> Found:
    for i in n.children:
        if i.kind == "constant_item":
            if n.kind == "class_constant" and i.value.lower() == "class":
                yield i, "A constant is not named class."
            for c in i.walk():
                if c.kind in ("variable", "call", "method_call", "closure", "assignment", "match") and not (c.kind == "closure" and "static" in c.flags) and not (c.kind == "call" and any(x.kind == "placeholder" for x in c.children)):
                    yield c, "A constant is not computed like this."
                    break
    if n.kind == "class_constant":
        bad = n.flags & {"static", "abstract", "readonly", "var"}
        if bad:
            yield n, f"A constant is not {sorted(bad)[0]}."
        if {"private", "final"} <= n.flags:
            yield n, "A private constant is not final."


@check("class", "interface", "trait", "enum", "anonymous_class")
def classes(ctx: Context, n: Node) -> Found:
    if n.value.lower() in RESERVED:
        yield n, f"A class is not named {n.value}."
    if {"abstract", "final"} <= n.flags:
        yield n, "A class is not abstract and final."
    ext, imp = n.role("extends"), n.role("implements")
    if ext is not None:
        if n.kind in ("trait", "enum"):
            yield ext, f"A {n.kind} extends nothing."
        if n.kind != "interface" and len(ext.children) > 1:
            yield ext, "A class extends one class."
    if imp is not None and n.kind in ("interface", "trait"):
        yield imp, f"A {n.kind} implements nothing."
    for part in (ext, imp):
        low = [c.value.lower() for c in part.children] if part is not None else []
        if len(set(low)) < len(low):
            yield part, "A name stands twice."
        if n.value and n.value.lower() in low:
            yield part, "A class is not its own parent."
    methods: Counter = Counter()
    members: Counter = Counter()
    for m in n.children:
        if m.kind == "method":
            methods[m.value.lower()] += 1
            if methods[m.value.lower()] == 2:
                yield m, f"Method {m.value} stands twice."
        names = [i.value for i in m.children if i.kind in ("property_item", "constant_item")] + ([m.value] if m.kind == "enum_case" else [])
        for name in names:
            members[name] += 1
            if members[name] == 2:
                yield m, f"{name} stands twice."
    if n.kind == "enum":
        backed = n.role("backing") is not None
        if backed and n.role("backing").value.lower() not in ("int", "string"):
            yield n.role("backing"), "An enum is backed by int or string."
        values: set[str] = set()
        for m in n.children:
            if m.kind == "property":
                yield m, "An enum has no properties."
            if m.kind == "enum_case":
                v = m.role("value_")
                if backed and v is None:
                    yield m, "A backed case has a value."
                if not backed and v is not None:
                    yield m, "The enum is not backed."
                if v is not None and v.kind in ("string", "integer"):
                    if v.value in values:
                        yield m, "Two cases have one value."
                    values.add(v.value)
            if m.kind == "method" and m.value.lower() in ("cases", "from", "tryfrom", "__construct", "__destruct", "__clone", "__get", "__set", "__tostring"):
                yield m, f"An enum has no {m.value} of its own."
    else:
        for m in n.children:
            if m.kind == "enum_case":
                yield m, "Only enums have cases."
    if n.kind == "interface":
        for m in n.children:
            if m.kind == "trait_use":
                yield m, "An interface uses no traits."
            if m.kind == "property" and m.role("hooks") is None:
                yield m, "An interface has no plain properties."


@check("method")
def methods(ctx: Context, n: Node) -> Found:
    c = ctx.inside(n, *CLASSES)
    kind, low = c.kind if c is not None else "class", n.value.lower()
    if len(n.flags & set(VISIBILITY)) > 1:
        yield n, "One visibility a member."
    if n.flags & {"readonly", "var"}:
        yield n, "A method is not readonly."
    if {"abstract", "final"} <= n.flags or {"abstract", "private"} <= n.flags and kind != "trait":
        yield n, "An abstract method is to be overridden."
    has_body = n.role("body") is not None
    if kind == "interface":
        if has_body:
            yield n, "An interface's methods have no bodies."
        if n.flags & {"private", "protected", "final", "abstract"}:
            yield n, "An interface's methods are public."
    elif "abstract" in n.flags:
        if has_body:
            yield n, "An abstract method has no body."
        if kind in ("class", "anonymous_class") and "abstract" not in (c.flags if c is not None else ()):
            yield n, "Only abstract classes have abstract methods."
        if kind == "enum":
            yield n, "An enum has no abstract methods."
    elif not has_body:
        yield n, "A method has a body."
    if low in MAGIC_ARGUMENTS and len(n.role("parameters").children) != MAGIC_ARGUMENTS[low]:
        yield n, f"{n.value} takes {MAGIC_ARGUMENTS[low]} arguments."
    if low in MAGIC_STATIC and ("static" in n.flags) != MAGIC_STATIC[low]:
        yield n, f"{n.value} is {'' if MAGIC_STATIC[low] else 'not '}static."
    if low in ("__construct", "__destruct", "__clone") and n.role("returns") is not None and not (low == "__clone" and n.role("returns").value.lower() == "void"):
        yield n.role("returns"), f"{n.value} has no return type."


@check("property")
def properties(ctx: Context, n: Node) -> Found:
    if len(n.flags & set(VISIBILITY)) > 1:
        yield n, "One visibility a member."
    if "readonly" in n.flags:
        if n.role("hint") is None:
            yield n, "A readonly property has a type."
        if "static" in n.flags:
            yield n, "A readonly property is not static."
        for i in n.children:
            if i.kind == "property_item" and i.role("value_") is not None:
                yield i, "A readonly property has no default."
    if "abstract" in n.flags and n.role("hooks") is None:
        yield n, "Only properties with hooks are abstract."
    if "var" in n.flags and n.flags & set(VISIBILITY):
        yield n, "var is public."
    h = n.role("hint")
    if h is not None and h.value.lower().lstrip("?") in ("void", "never", "callable", "static"):
        yield h, f"{h.value} is not a property's type."
    hooks = n.role("hooks")
    if hooks is not None:
        count: Counter = Counter(x.value.lower() for x in hooks.children)
        for x in hooks.children:
            if x.value.lower() not in ("get", "set"):
                yield x, f"No hook {x.value}."
            elif count[x.value.lower()] > 1:
                yield x, f"Hook {x.value} stands twice."
        if "readonly" in n.flags:
            yield n, "A property with hooks is not readonly."


@check("integer")
def numbers(ctx: Context, n: Node) -> Found:
    if n.value.endswith("_") or "__" in n.value or re.fullmatch(r"0[0-9]*[89][0-9]*", n.value):
        yield n, "The number is malformed."


@check("use")
def imports(ctx: Context, n: Node) -> Found:
    p = ctx.parents.get(id(n))
    if p is not None and p is not ctx.root and p.kind != "block":
        yield n, "Imports stand at the top."
    if p is not None and p.kind == "block" and ctx.parents[id(p)].kind != "namespace":
        yield n, "Imports stand at the top."


@check("program")
def import_names(ctx: Context, n: Node) -> Found:
    seen: set[tuple[int, str, str]] = set()
    space = 0
    for c in n.walk():
        if c.kind == "namespace":
            space = c.start
        if c.kind == "use_item":
            kind, name, alias = c.value.split("|")
            alias = alias or name.rsplit("\\", 1)[-1]
            key = space, kind, alias if kind == "const" else alias.lower()
            if key in seen:
                yield c, f"{alias} is imported twice."
            seen.add(key)
            if not kind and alias.lower() in RESERVED:
                yield c, f"{alias} is not a name for an import."


@check("variable")
def this(ctx: Context, n: Node) -> Found:
    if n.value == "$this":
        f = next((p for p in ctx.up(n) if p.kind in ("function", "method", "closure", "arrow_function") and "static" in p.flags or p.kind in ("function", "method", *CLASSES)), None)
        if f is not None and "static" in f.flags and f.kind in ("closure", "arrow_function"):
            yield n, "A static closure has no $this."


@check("unset", "isset")
def on_places(ctx: Context, n: Node) -> Found:
    for a in args(n):
        v = bare(a.role("value_"))
        if v is not None and v.kind not in ("variable", "array_access", "property_access", "nullsafe_property", "static_property", "variable_variable", "class_constant_access") or n.kind == "unset" and v is not None and v.value == "$this":
            yield a, f"{n.kind} takes variables."


def semantics(source: bytes | str) -> list[tuple[str, int, str, int, int]]:
    root, parser = parse(source)
    ctx = Context(root, parser)
    out = [("syntax", ERROR, e.value, e.start, e.stop) for e in parser.errors]
    for n in root.walk():
        for f in CHECKS.get(n.kind, ()):
            out += [("semantics", ERROR, message, x.start, x.stop) for x, message in f(ctx, n)]
    return sorted(set(out), key=lambda i: (i[3], i[4], i[2]))


def check_files(files: DataFrame) -> DataFrame:
    """Issues of a file table (``file_id``, ``name``, ``contents``)."""
    rows = files.select(F.col("file_id").cast("bigint"), F.col("name").cast("string"), F.col("contents").cast("binary"))

    def run(batches):
        for batch in batches:
            out = [(i, name, *issue, n) for i, name, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for n, issue in enumerate(semantics(c or b""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["file_id", "file", "code", "level", "message", "start", "stop", "ordinal"])

    return rows.mapInArrow(run, ISSUE)
