"""The tables that the front end gives of a file table: tokens, nodes, names, symbols, references.

A file is parsed within one Arrow batch; a file that breaks gives what parses.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import Scope, scope_at, scopes
from .syntax import Node, parse
from .tokens import tokens

CLASS_KINDS = ("class", "interface", "trait", "enum")
TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


def per_file(files: DataFrame, rows_of: Callable[[bytes], list[tuple]], columns: str) -> DataFrame:
    """``file_id`` and what ``rows_of`` gives of each file's contents."""
    fields = [c.strip().rsplit(" ", 1) for c in re.split(r",(?![^<]*>)", columns)]

    def run(batches):
        for batch in batches:
            out = [(i, *r) for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in rows_of(c or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[k + 1] for r in out], TYPES[t]) for k, (_, t) in enumerate(fields))], ["file_id", *(n for n, _ in fields)])

    return files.select(F.col("file_id").cast("bigint"), F.col("contents").cast("binary")).mapInArrow(run, f"file_id bigint, {columns}")


def token_table(files: DataFrame) -> DataFrame:
    def rows(c: bytes) -> list[tuple]:
        t = c.decode("latin-1")
        return [(k, i, a, b, t[a:b]) for i, (k, a, b) in enumerate(tokens(t))]

    return per_file(files, rows, "kind string, ordinal int, start int, stop int, value string")


def trivia_table(files: DataFrame) -> DataFrame:
    return token_table(files).where("kind in ('comment', 'space')")


def node_rows(root: Node) -> list[tuple]:
    out: list[tuple] = []
    stack: list[tuple[Node, int | None, int, tuple[int, ...]]] = [(root, None, 0, ())]
    while stack:
        n, parent, ordinal, above = stack.pop()
        own = len(out)
        out.append((own, parent, ordinal, n.kind, n.start, n.stop, n.value, len(above), list(above)))
        stack += [(c, own, i, (*above, own)) for i, c in reversed(list(enumerate(n.children)))]
    return out


def node_table(files: DataFrame) -> DataFrame:
    return per_file(files, lambda c: node_rows(parse(c)[0]), "node_id int, parent_id int, ordinal int, kind string, start int, stop int, value string, depth int, ancestors array<int>")


def error_table(files: DataFrame) -> DataFrame:
    return per_file(files, lambda c: [(e.value, e.start, e.stop) for e in parse(c)[1].errors], "message string, start int, stop int")


def type_names(hint: Node | None, scope: Scope) -> list[str]:
    if hint is None:
        return []
    return [scope.resolve(w)[0] for w in re.findall(r"\\?[A-Za-z_\x80-\xff][\w\x80-\xff]*(?:\\[\w\x80-\xff]+)*", hint.value)]


def name_rows(root: Node) -> list[tuple]:
    found, out = scopes(root), []
    parents = {id(c): n for n in root.walk() for c in n.children}
    for n in root.walk():
        if n.kind == "name":
            p = parents.get(id(n))
            kind = "function" if p is not None and p.kind == "call" and p.role("target") is n else "" if p is not None and p.kind in ("new", "extends", "implements", "trait_use", "static_call", "static_property", "class_constant_access") or p is not None and p.kind == "binary" and p.value == "instanceof" else "const"
            full, imported = scope_at(found, n.start).resolve(n.value, kind)
            out.append((n.start, n.stop, full, kind or "class", imported))
    return out


def name_table(files: DataFrame) -> DataFrame:
    return per_file(files, lambda c: name_rows(parse(c)[0]), "start int, stop int, fqn string, kind string, imported boolean")


def symbol_rows(root: Node) -> list[tuple]:
    """Name, kind, owner, flags, parents by relation and place of each symbol."""
    found, out = scopes(root), []
    for n in root.walk():
        s = scope_at(found, n.start)

        def names(role: str, n: Node = n, s: Scope = s) -> list[str]:
            return [s.resolve(c.value)[0] for c in (n.role(role).children if n.role(role) else [])]

        if n.kind in CLASS_KINDS:
            full = s.qualify(n.value)
            traits = [s.resolve(x.value)[0] for m in n.children if m.kind == "trait_use" for x in m.children if x.kind == "name"]
            out.append((full, n.kind, None, sorted(n.flags), names("extends"), names("implements"), traits, n.start, n.stop))
            for m in n.children:
                flags = sorted(m.flags)
                if m.kind == "method":
                    out.append((m.value, "method", full, flags, [], [], [], m.start, m.stop))
                    for p in (m.role("parameters").children if m.value.lower() == "__construct" else []):
                        if p.flags & {"public", "protected", "private", "readonly"}:
                            out.append((p.value, "property", full, sorted(p.flags), [], [], [], p.start, p.stop))
                elif m.kind in ("property", "class_constant"):
                    kind = "property" if m.kind == "property" else "class_constant"
                    out += [(i.value, kind, full, flags, [], [], [], i.start, i.stop) for i in m.children if i.kind in ("property_item", "constant_item")]
                elif m.kind == "enum_case":
                    out.append((m.value, "enum_case", full, flags, [], [], [], m.start, m.stop))
        elif n.kind == "function":
            out.append((s.qualify(n.value), "function", None, [], [], [], [], n.start, n.stop))
        elif n.kind == "constant":
            out += [(s.qualify(i.value), "constant", None, [], [], [], [], i.start, i.stop) for i in n.children if i.kind == "constant_item"]
        elif n.kind == "call" and n.value.lower().lstrip("\\") == "define":
            a = next((c.role("value_") for c in n.children if c.kind == "argument"), None)
            if a is not None and a.kind == "string":
                out.append((a.value[1:-1].lstrip("\\"), "constant", None, [], [], [], [], n.start, n.stop))
    return out


def symbol_table(files: DataFrame) -> DataFrame:
    return per_file(files, lambda c: symbol_rows(parse(c)[0]), "name string, kind string, owner string, flags array<string>, extends array<string>, implements array<string>, uses array<string>, start int, stop int")


def class_edges(symbols: DataFrame) -> DataFrame:
    """``child``, ``parent`` and ``edge_kind`` of the class hierarchy."""
    kinds = F.array(*(F.struct(F.lit(k).alias("edge_kind"), F.col(c).alias("parents")) for k, c in (("extends", "extends"), ("implements", "implements"), ("uses", "uses"))))
    return symbols.where(F.col("kind").isin(*CLASS_KINDS)).select(F.col("name").alias("child"), F.explode(kinds).alias("x")).select("child", "x.edge_kind", F.explode("x.parents").alias("parent"))


def reference_rows(root: Node) -> list[tuple]:
    """Source symbol, target, vector, whether in a signature, and place: the dependency edges of a file."""
    found, out = scopes(root), []
    stack: list[tuple[Node, str]] = [(root, "")]
    while stack:
        n, source = stack.pop()
        s = scope_at(found, n.start)
        here = source or s.namespace

        def add(target: str, vector: str, kind: str = "", n: Node = n, s: Scope = s, here: str = here) -> None:
            full, _ = s.resolve(target, kind)
            if full and full.lower() not in ("self", "static", "parent", "int", "float", "string", "bool", "array", "object", "mixed", "void", "never", "null", "false", "true", "iterable", "callable"):
                out.append((here, full, vector, vector in ("extends", "implements", "trait_use", "property_type", "parameter_type", "return_type", "attribute"), n.start, n.stop))

        if n.kind in CLASS_KINDS:
            source = s.qualify(n.value)
        elif n.kind == "function":
            source = s.qualify(n.value)
        elif n.kind == "method" and source:
            source = f"{source.split('::')[0]}::{n.value}"
        here = source or s.namespace
        if n.kind in ("extends", "implements", "trait_use"):
            for c in n.children:
                if c.kind == "name":
                    add(c.value, n.kind, n=c, here=here)
        elif n.kind == "use":
            for c in n.children:
                out.append((here, c.value.split("|")[1].lstrip("\\"), "use", False, c.start, c.stop))
        elif n.kind == "attribute":
            add(n.value, "attribute", here=here)
        elif n.kind in ("property", "parameter", "method", "function", "closure", "arrow_function"):
            role, vector = ("returns", "return_type") if n.kind not in ("property", "parameter") else ("hint", f"{n.kind}_type")
            for t in type_names(n.role(role), s):
                if t.lower() not in ("self", "static", "parent"):
                    add("\\" + t, vector, n=n.role(role), here=here)
        elif n.kind == "catch" and n.role("types"):
            for t in type_names(n.role("types"), s):
                add("\\" + t, "catch", here=here)
        elif n.kind in ("new", "static_call", "static_property", "class_constant_access") and n.role("target") is not None and n.role("target").kind == "name":
            add(n.role("target").value, {"new": "instantiation", "static_call": "static_call", "static_property": "static_property", "class_constant_access": "class_constant"}[n.kind], here=here)
        elif n.kind == "call" and n.value:
            add(n.value, "function_call", "function", here=here)
        stack += [(c, source) for c in reversed(n.children)]
    return out


def reference_table(files: DataFrame) -> DataFrame:
    return per_file(files, lambda c: reference_rows(parse(c)[0]), "source string, target string, vector string, in_signature boolean, start int, stop int")


def symbol_spans(root: Node) -> list[tuple[str, str | None, int, int, int]]:
    """Name, member, start, end of the signature and end of each symbol."""
    found, out = scopes(root), []

    def add(n: Node, name: str, member: str | None) -> None:
        body = n.role("body")
        out.append((name, member, n.start, body.start if body is not None else n.stop, n.stop))

    for n in root.walk():
        s = scope_at(found, n.start)
        if n.kind in CLASS_KINDS:
            full = s.qualify(n.value).lower()
            first = min([m.start for m in n.children if m.kind not in ("extends", "implements", "type", "attribute_list")], default=n.stop)
            out.append((full, None, n.start, first, n.stop))
            for m in n.children:
                if m.kind == "method":
                    add(m, full, m.value.lower())
                elif m.kind in ("property", "class_constant"):
                    for i in m.children:
                        if i.kind in ("property_item", "constant_item"):
                            out.append((full, i.value, m.start, m.stop, m.stop))
        elif n.kind == "function":
            add(n, s.qualify(n.value).lower(), None)
    return out


def signature_rows(source: bytes) -> list[tuple]:
    """A hash of each symbol's whole text and one of its signature, neither of which white space or comments change."""
    import hashlib

    root, parser = parse(source)

    def mark(a: int, b: int) -> int:
        text = "\x1f".join(w for (_, s, e), w in zip(parser.toks, parser.words, strict=True) if a <= s and e <= b)
        return int.from_bytes(hashlib.md5(text.encode("latin-1"), usedforsecurity=False).digest()[:8], "little", signed=True)

    return [(name, member, mark(a, b), mark(a, c)) for name, member, a, c, b in symbol_spans(root)]


def signature_table(files: DataFrame) -> DataFrame:
    return per_file(files, signature_rows, "symbol string, member string, hash bigint, signature_hash bigint")


def fingerprint_rows(source: bytes, docblocks: bool = False) -> list[tuple]:
    """A structural fingerprint of each symbol and one of its signature.

    Hashed are the tokens, each with its length before it: names as what they
    stand for, whatever their case, keywords in lower case, all else as written.
    White space, comments and how a name is imported do not count; with
    ``docblocks``, documentation comments with an ``@`` before a symbol do.
    """
    import hashlib

    root, parser = parse(source)
    found = scopes(root)
    full = {a: name.lower() for a, _, name, _, _ in name_rows(root)}
    attributes = {n.start for n in root.walk() if n.kind == "attribute"}
    types = {n.start: n.stop for n in root.walk() if n.kind == "type"}
    words: list[tuple[int, int, str]] = []
    inside = 0
    for (kind, a, b), low, word in zip(parser.toks, parser.low, parser.words, strict=True):
        inside = max(inside, types.get(a, 0))
        if a in full:
            word = full[a]
        elif kind == "name" and (a < inside or a in attributes):
            word = scope_at(found, a).resolve(word)[0].lower()
        elif kind == "keyword":
            word = low
        words.append((a, b, word))
    before: dict[int, str] = {}
    doc = ""
    for kind, a, b in parser.all:
        if kind == "comment":
            doc = parser.text[a:b] if parser.text.startswith("/**", a) and "@" in parser.text[a:b] else doc
        elif kind != "space":
            if doc:
                before[a] = doc
            doc = ""

    def mark(a: int, b: int) -> int:
        h = hashlib.md5(usedforsecurity=False)
        for at, to, word in words:
            if a <= at and to <= b:
                for w in (*([before[at]] if docblocks and at in before else []), word):
                    h.update(b"%d:" % len(w) + w.encode("latin-1"))
        return int.from_bytes(h.digest()[:8], "little", signed=True)

    return [(name, member, mark(a, b), mark(a, c)) for name, member, a, c, b in symbol_spans(root)]


def fingerprint_table(files: DataFrame, docblocks: bool = False) -> DataFrame:
    return per_file(files, lambda c: fingerprint_rows(c, docblocks), "symbol string, member string, fingerprint bigint, signature_fingerprint bigint")


def structural_duplicates(fingerprints: DataFrame, by: str = "fingerprint") -> DataFrame:
    """``by`` and ``copies`` of each fingerprint that stands more than once, with the least file and symbol that has it."""
    at = F.struct("file_id", "symbol", "member")
    return fingerprints.groupBy(by).agg(F.count("*").alias("copies"), F.min(at).alias("first")).where("copies > 1").select(by, "copies", "first.*")
