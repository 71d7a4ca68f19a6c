"""Documentation comments: their text, their tags, and the types in the tags."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .tables import per_file
from .tokens import tokens

#: Tags that start with a type, and those that start with a name.
TYPED = frozenset("param return var throws property property-read property-write method mixin extends implements use template-extends template-implements template-use require-extends require-implements assert assert-if-true assert-if-false param-out self-out this-out type psalm-type phpstan-type import-type".split())
TEMPLATES = frozenset("template template-covariant template-contravariant template-invariant".split())
VENDOR = re.compile(r"^(psalm|phpstan|phan)-")


@dataclass
class Tag:
    name: str
    value: str
    start: int
    type: str | None = None
    variable: str | None = None
    description: str = ""


@dataclass
class Docblock:
    text: str
    tags: list[Tag] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def content(comment: str) -> list[tuple[int, str]]:
    """Lines without the comment's frame, each with its place in the comment."""
    out = []
    at = 0
    for n, line in enumerate(comment.split("\n")):
        inner, start = line.rstrip("\r"), at
        if n == 0 and inner.startswith("/**"):
            inner, start = inner[3:], at + 3
        if n == comment.count("\n") and inner.rstrip().endswith("*/"):
            inner = inner.rstrip()[:-2]
        m = re.match(r"\s*\*? ?" if n else r" ?", inner)
        out.append((start + m.end(), inner[m.end() :].rstrip()))
        at += len(line) + 1
    return out


def docblock(comment: str) -> Docblock:
    out, text, now = Docblock(""), [], None
    fenced = False
    for start, line in content(comment):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        m = None if fenced else re.match(r"\s*@([A-Za-z][\w:\\-]*)[ \t]*(.*)$", line)
        if m:
            now = Tag(m[1], m[2], start + m.start(1) - 1)
            out.tags.append(now)
        elif now is not None:
            now.value += "\n" + line
        else:
            text.append(line)
    out.text = "\n".join(text).strip()
    for t in out.tags:
        t.value = t.value.strip()
        read_tag(t, out.errors)
    if fenced:
        out.errors.append("A code block does not close.")
    if len(re.findall(r"\{@", comment)) > len(re.findall(r"\{@[^{}]*\}", comment)):
        out.errors.append("An inline tag does not close.")
    return out


def read_tag(t: Tag, errors: list[str]) -> None:
    name = VENDOR.sub("", t.name)
    rest = t.value
    if name in TEMPLATES:
        m = re.match(r"([A-Za-z_]\w*)(?:\s+(?:of|as|super)\s+)?", rest)
        if not m:
            errors.append(f"@{t.name} names nothing.")
            return
        t.variable, rest = m[1], rest[m.end() :]
        if m.end() > len(m[1]) and rest:
            p = Types(rest)
            if p.ok():
                t.type, rest = str(p.result), rest[p.at :]
        t.description = rest.strip()
        return
    if name not in TYPED:
        t.description = rest
        return
    if re.match(r"(?:&?(?:\.\.\.)?\$\w+)", rest) and name in ("param", "var", "property"):
        pass  # a variable without a type
    else:
        p = Types(rest[1:] if name.startswith("assert") and rest.startswith("!") else rest)
        if not p.ok():
            errors.append(f"@{t.name} has no type that can be read.")
            t.description = rest
            return
        t.type, rest = str(p.result), (rest[1:] if name.startswith("assert") and rest.startswith("!") else rest)[p.at :]
    m = re.match(r"\s*(&?(?:\.\.\.)?)(\$\w+)", rest)
    if m:
        t.variable, rest = m[2], rest[m.end() :]
    t.description = rest.strip()


@dataclass
class Type:
    """A type: a name with arguments, a union, an intersection, a shape, a callable or a literal."""

    kind: str
    name: str = ""
    parts: list["Type"] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)

    def __str__(self) -> str:
        p = [str(x) for x in self.parts]
        if self.kind in ("union", "intersection"):
            mark = "|" if self.kind == "union" else "&"
            return mark.join(f"({s})" if x.kind in ("union", "intersection", "conditional") else s for x, s in zip(self.parts, p, strict=True))
        if self.kind == "nullable":
            return f"?{p[0]}"
        if self.kind == "slice":
            return f"({p[0]})[]" if self.parts[0].kind in ("union", "intersection", "nullable") else f"{p[0]}[]"
        if self.kind == "generic":
            return f"{self.name}<{', '.join(p)}>"
        if self.kind == "shape":
            return f"{self.name}{{{', '.join(f'{k}: {s}' if k else s for k, s in zip(self.keys, p, strict=True))}}}"
        if self.kind == "callable":
            return f"{self.name}({', '.join(s + k for k, s in zip(self.keys, p[:-1], strict=True))}): {p[-1]}"
        if self.kind == "conditional":
            return f"({p[0]} is {p[1]} ? {p[2]} : {p[3]})"
        return self.name


class Types:
    """Reads one type from the start of a text; ``at`` is where it ends."""

    LEX = re.compile(r"\s*(?:(?P<name>\$this|\$\w+|\\?[A-Za-z_][\w-]*(?:\\[A-Za-z_][\w-]*)*(?:::[\w*]+)?)|(?P<number>-?\d[\d_]*(?:\.\d+)?)|(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<op>\.\.\.|[|&<>{}()\[\],:?=*]))", re.S)

    def __init__(self, text: str):
        self.text, self.at, self.result = text, 0, None
        try:
            self.result = self.union()
        except (ValueError, RecursionError):
            self.result = None

    def ok(self) -> bool:
        return self.result is not None

    def peek(self) -> tuple[str, str, int]:
        m = self.LEX.match(self.text, self.at)
        return (m.lastgroup, m[m.lastgroup], m.end()) if m else ("", "", self.at)

    def eat(self, op: str, close: bool = True) -> bool:
        kind, w, end = self.peek()
        if kind == "op" and w == op and (close or self.text[self.at : self.at + 1] == op):
            self.at = end
            return True
        return False

    def need(self, op: str) -> None:
        if not self.eat(op):
            raise ValueError(op)

    def union(self) -> Type:
        parts, kind = [self.single()], ""
        while True:
            k, w, end = self.peek()
            if k == "op" and w in "|&" and len(w) == 1 and not (w == "&" and re.match(r"\s*&\s*(\.\.\.)?\$(?!this\b)", self.text[self.at :])):
                if kind and kind != w:
                    parts = [Type("union" if kind == "|" else "intersection", parts=parts)] if w == "|" else [*parts[:-1], Type("intersection", parts=[parts[-1], self.step(end)])]
                    if w == "&":
                        continue
                kind = w
                parts.append(self.step(end))
                continue
            break
        return parts[0] if len(parts) == 1 else Type("union" if kind == "|" else "intersection", parts=parts)

    def step(self, end: int) -> Type:
        self.at = end
        return self.single()

    def single(self) -> Type:
        kind, w, end = self.peek()
        if kind == "op" and w == "?":
            self.at = end
            return Type("nullable", parts=[self.single()])
        if kind == "op" and w == "(":
            self.at = end
            t = self.union()
            k, is_word, e = self.peek()
            if k == "name" and is_word == "is":
                self.at = e
                other = self.union()
                self.need("?")
                yes = self.union()
                self.need(":")
                t = Type("conditional", parts=[t, other, yes, self.union()])
            self.need(")")
        elif kind in ("number", "text"):
            self.at = end
            t = Type("literal", w)
        elif kind == "op" and w == "*":
            self.at = end
            t = Type("name", "mixed")
        elif kind == "name" and (not w.startswith("$") or w == "$this" or self.at):
            self.at = end
            t = self.named(w)
        else:
            raise ValueError(w)
        while self.text[self.at : self.at + 1] == "[":
            m = re.match(r"\[\s*\]", self.text[self.at :])
            if not m:
                break
            self.at += m.end()
            t = Type("slice", parts=[t])
        return t

    def named(self, w: str) -> Type:
        low = w.lower()
        follow = self.text[self.at : self.at + 1]
        if follow == "<":
            self.need("<")
            parts = [self.union()]
            while self.eat(","):
                if self.eat(">"):
                    return Type("generic", w, parts)
                parts.append(self.union())
            self.need(">")
            return Type("generic", w, parts)
        if follow == "{" and low in ("array", "list", "object", "non-empty-array", "non-empty-list"):
            self.need("{")
            parts, keys = [], []
            while not self.eat("}"):
                if self.eat("..."):
                    keys.append("")
                    parts.append(Type("name", "..."))
                    self.eat(",")
                    continue
                m = re.match(r"\s*('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[\w:\\-]+)(\??)\s*:(?!:)", self.text[self.at :])
                if m:
                    self.at += m.end()
                    keys.append(m[1] + m[2])
                else:
                    keys.append("")
                parts.append(self.union())
                if not self.eat(","):
                    self.need("}")
                    break
            return Type("shape", w, parts, keys)
        if follow == "(" and low.lstrip("\\") in ("callable", "closure", "pure-callable", "pure-closure"):
            self.need("(")
            parts, keys = [], []
            while not self.eat(")"):
                parts.append(self.union())
                m = re.match(r"\s*(&?)(\.\.\.|=)?(\s*&?(?:\.\.\.)?\$\w+)?(=)?", self.text[self.at :])
                self.at += m.end()
                keys.append("".join((m[2] or "", m[4] or "")))
                if not self.eat(","):
                    self.need(")")
                    break
            back = self.single() if self.eat(":") else Type("name", "mixed")
            return Type("callable", w, [*parts, back], keys)
        return Type("name", w)


def docblock_rows(source: bytes) -> list[tuple]:
    """Each tag of each documentation comment, with what it says."""
    text = source.decode("latin-1")
    out = []
    for kind, a, b in tokens(text):
        if kind == "comment" and text.startswith("/**", a) and b - a > 4:
            d = docblock(text[a:b])
            out += [(a, b, t.name, t.type, t.variable, t.description, a + t.start) for t in d.tags] or [(a, b, None, None, None, d.text, a)]
    return out


def docblock_table(files: DataFrame) -> DataFrame:
    return per_file(files, docblock_rows, "start int, stop int, tag string, type string, variable string, description string, tag_start int")
