"""The template language: tokens, a parser for its statements and expressions, and a node table."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .tables import per_file

#: How tightly binary operators bind, and which bind to the right.
BINDING = {
    "or": 10, "xor": 12, "and": 15, "b-or": 16, "b-xor": 17, "b-and": 18, "==": 20, "!=": 20, "<=>": 20, "<": 20, ">": 20, ">=": 20, "<=": 20, "===": 20, "!==": 20, "not in": 20, "in": 20, "matches": 20, "starts with": 20, "ends with": 20, "has some": 20, "has every": 20,
    "..": 25, "+": 30, "-": 30, "~": 40, "*": 60, "/": 60, "//": 60, "%": 60, "is": 100, "is not": 100, "**": 200, "??": 300,
}
RIGHT = {"**", "??"}
UNARY = {"not": 50, "-": 500, "+": 500}

LEX = re.compile(
    r"""\s*(?:(?P<name>[A-Za-z_\x7f-\U0010ffff][\w\x7f-\U0010ffff]*)|(?P<number>\d+(?:_\d+)*(?:\.\d+)?(?:[Ee][+-]?\d+)?)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
|(?P<op><=>|===|!==|==|!=|<=|>=|=>|\?\?|\?\.|\?:|\.\.\.|\.\.|\*\*|//|[-+*/%~<>=?:.,|()\[\]{}]))""",
    re.X | re.S,
)


class Broken(Exception):
    def __init__(self, message: str, at: int):
        super().__init__(message)
        self.at = at


@dataclass
class Item:
    kind: str
    start: int
    stop: int = 0
    value: str = ""
    children: list["Item"] = field(default_factory=list)

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


OPEN = re.compile(r"\{\{|\{%|\{\#")
VERBATIM = re.compile(r"\{%[-~]?\s*verbatim\s*[-~]?%\}(.*?)\{%[-~]?\s*endverbatim\s*[-~]?%\}", re.S)


def pieces(text: str) -> list[tuple[str, int, int]]:
    """Text, prints, tags, comments and verbatim parts with the places of what is in them; all of the text is in one of them."""
    out, at = [], 0
    while at < len(text):
        m = OPEN.search(text, at)
        if not m:
            out.append(("text", at, len(text)))
            break
        if m.start() > at:
            out.append(("text", at, m.start()))
        if v := VERBATIM.match(text, m.start()):
            out.append(("verbatim", m.start(), v.end()))
            at = v.end()
            continue
        if m[0] == "{#":
            end = text.find("#}", m.end())
            if end < 0:
                raise Broken("A comment does not close.", m.start())
            out.append(("comment", m.start(), end + 2))
            at = end + 2
            continue
        kind, close = ("print", "}}") if m[0] == "{{" else ("tag", "%}")
        out.append((kind, m.start(), ending(text, m.end(), close)))
        at = out[-1][2]
    return out


def ending(text: str, at: int, close: str) -> int:
    """Where a print or tag ends; quotes and brackets hide the mark."""
    depth = 0
    while at < len(text):
        c = text[at]
        if c in "'\"":
            m = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", re.S).match(text, at)
            if not m:
                raise Broken("A text does not close.", at)
            at = m.end()
            continue
        if not depth and text.startswith(close, at):
            return at + 2
        depth += (c in "([{") - (c in ")]}")
        if depth < 0:
            raise Broken(f"Unexpected {c}.", at)
        at += 1
    raise Broken(f"No {close}.", at)


class Expressions:
    """Reads expressions of one print or tag."""

    def __init__(self, text: str, start: int, stop: int):
        self.text, self.stop = text, stop
        self.toks: list[tuple[str, str, int, int]] = []
        at = start
        while text[at:stop].strip():
            m = LEX.match(text, at, stop)
            if not m:
                raise Broken(f"Unexpected {text[at:stop].strip()[:1]}.", at)
            self.toks.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup), m.end()))
            at = m.end()
        self.at = 0

    def peek(self, n: int = 0) -> tuple[str, str]:
        return self.toks[self.at + n][:2] if self.at + n < len(self.toks) else ("end", "")

    def place(self) -> int:
        return self.toks[self.at][2] if self.at < len(self.toks) else self.stop

    def eat(self, *words: str) -> bool:
        if self.peek()[1] in words and self.peek()[0] in ("op", "name"):
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.eat(word):
            raise Broken(f"Expected {word}.", self.place())

    def name(self) -> str:
        kind, w = self.peek()
        if kind != "name":
            raise Broken("Expected a name.", self.place())
        self.at += 1
        return w

    def done(self) -> None:
        if self.peek()[0] != "end":
            raise Broken(f"Unexpected {self.peek()[1]}.", self.place())

    def node(self, kind: str, start: int, value: str = "", children: list[Item] | None = None) -> Item:
        return Item(kind, start, self.toks[self.at - 1][3] if self.at else start, value, children or [])

    def operator(self) -> tuple[str, int] | None:
        kind, w = self.peek()
        two = f"{w} {self.peek(1)[1]}"
        if kind == "name" and two in BINDING:
            return two, 2
        return (w, 1) if kind in ("op", "name") and w in BINDING else None

    def expression(self, least: int = 0) -> Item:
        start = self.place()
        left = self.unary()
        while (op := self.operator()) and BINDING[op[0]] >= least:
            self.at += op[1]
            if op[0] in ("is", "is not"):
                name = self.name()
                if self.peek()[0] == "name" and f"{name} {self.peek()[1]}" in ("divisible by", "same as"):
                    name += f" {self.name()}"
                args = self.arguments() if self.peek()[1] == "(" else [self.expression(BINDING["is"] + 1)] if name in ("divisible by", "same as") else []
                left = self.node("test", start, f"{op[0]} {name}", [left, *args])
                continue
            right = self.expression(BINDING[op[0]] + (op[0] not in RIGHT))
            left = self.node("binary", start, op[0], [left, right])
        if not least and self.peek() == ("op", "?") or not least and self.peek() == ("op", "?:"):
            short = self.peek()[1] == "?:"
            self.at += 1
            if short:
                return self.node("conditional", start, "short", [left, self.expression()])
            yes = self.expression()
            no = [self.expression()] if self.eat(":") else []
            return self.node("conditional", start, "", [left, yes, *no])
        return left

    def unary(self) -> Item:
        start, (kind, w) = self.place(), self.peek()
        if w in UNARY and kind in ("op", "name"):
            self.at += 1
            return self.postfix(self.node("unary", start, w, [self.expression(UNARY[w])]), start)
        return self.postfix(self.primary(), start)

    def primary(self) -> Item:
        start, (kind, w) = self.place(), self.peek()
        if kind == "name":
            if self.peek(1) == ("op", "=>"):
                self.at += 2
                return self.node("arrow", start, w, [self.expression()])
            self.at += 1
            if self.peek() == ("op", "("):
                return self.node("call", start, w, self.arguments())
            return self.node("constant" if w.lower() in ("true", "false", "none", "null") else "name", start, w)
        if kind in ("number", "string"):
            self.at += 1
            return self.node(kind, start, w)
        if w == "(":
            self.at += 1
            names = []
            save = self.at
            while self.peek()[0] == "name":
                names.append(self.name())
                if not self.eat(","):
                    break
            if names and self.eat(")") and self.eat("=>"):
                return self.node("arrow", start, ",".join(names), [self.expression()])
            self.at = save
            if self.eat(")"):
                self.need("=>")
                return self.node("arrow", start, "", [self.expression()])
            e = self.expression()
            self.need(")")
            return self.node("group", start, "", [e])
        if w == "[":
            self.at += 1
            items = []
            while not self.eat("]"):
                self.eat("...")
                items.append(self.expression())
                if not self.eat(","):
                    self.need("]")
                    break
            return self.node("array", start, "", items)
        if w == "{":
            self.at += 1
            items = []
            while not self.eat("}"):
                if self.eat("..."):
                    items.append(self.expression())
                else:
                    k, word = self.peek()
                    if k not in ("name", "string", "number") and word != "(":
                        raise Broken("Expected a key.", self.place())
                    key = self.primary()
                    items += [key] + ([self.expression()] if self.eat(":") else [])
                if not self.eat(","):
                    self.need("}")
                    break
            return self.node("hash", start, "", items)
        raise Broken(f"Unexpected {w or 'end'}.", self.place())

    def arguments(self) -> list[Item]:
        self.need("(")
        out = []
        while not self.eat(")"):
            s = self.place()
            self.eat("...")
            if self.peek()[0] == "name" and self.peek(1)[1] in ("=", ":") and self.peek(1)[0] == "op":
                n = self.name()
                self.at += 1
                out.append(self.node("argument", s, n, [self.expression()]))
            else:
                e = self.expression()
                out.append(self.node("argument", s, "", [e]))
            if not self.eat(","):
                self.need(")")
                break
        return out

    def postfix(self, left: Item, start: int) -> Item:
        while True:
            if self.eat(".", "?."):
                kind, w = self.peek()
                if kind == "op" and w == "(":
                    self.at += 1
                    e = self.expression()
                    self.need(")")
                    parts = [left, e]
                    w = ""
                elif kind in ("name", "number"):
                    self.at += 1
                    parts = [left]
                else:
                    raise Broken("Expected an attribute.", self.place())
                if self.peek() == ("op", "("):
                    parts += self.arguments()
                left = self.node("attribute", start, w, parts)
            elif self.eat("["):
                first = [] if self.peek()[1] == ":" else [self.expression()]
                if self.eat(":"):
                    first += [] if self.peek()[1] == "]" else [self.expression()]
                self.need("]")
                left = self.node("index", start, "", [left, *first])
            elif self.eat("|"):
                left = self.node("filter", start, self.name(), [left, *(self.arguments() if self.peek() == ("op", "(") else [])])
            elif self.peek() == ("op", "(") and left.kind in ("attribute", "group"):
                left = self.node("call", start, "", [left, *self.arguments()])
            else:
                return left


class Template:
    """Parses a whole template; raises ``Broken`` where it is none."""

    def __init__(self, text: str):
        self.text, self.parts, self.at = text, pieces(text), 0
        self.blocks: set[str] = set()
        self.root = Item("template", 0, len(text), children=self.body(()))

    def inner(self, a: int, b: int) -> tuple[int, int]:
        a, b = a + 2, b - 2
        return a + (self.text[a : a + 1] in "-~" and a < b), b - (self.text[b - 1 : b] in "-~" and a < b)

    def tag(self) -> tuple[str, Expressions]:
        _, a, b = self.parts[self.at]
        e = Expressions(self.text, *self.inner(a, b))
        return e.name(), e

    def body(self, ends: tuple[str, ...]) -> list[Item]:
        out = []
        while self.at < len(self.parts):
            kind, a, b = self.parts[self.at]
            if kind in ("text", "comment", "verbatim"):
                out.append(Item(kind, a, b))
                self.at += 1
            elif kind == "print":
                e = Expressions(self.text, *self.inner(a, b))
                out.append(Item("print", a, b, children=[e.expression()]))
                e.done()
                self.at += 1
            else:
                name, e = self.tag()
                if name in ends:
                    return out
                self.at += 1
                out.append(self.statement(name, e, a))
        if ends:
            raise Broken(f"Expected {' or '.join(ends)}.", len(self.text))
        return out

    def until(self, *ends: str) -> tuple[str, Expressions, list[Item]]:
        inside = self.body(ends)
        name, e = self.tag()
        self.at += 1
        return name, e, inside

    def statement(self, name: str, e: Expressions, start: int) -> Item:
        n = Item(name, start)
        if name == "if":
            n.children.append(e.expression())
            e.done()
            seen_else = False
            while True:
                end, e, inside = self.until(*(("endif",) if seen_else else ("elseif", "else", "endif")))
                n.children += inside
                if end == "elseif":
                    n.children.append(e.expression())
                seen_else |= end == "else"
                e.done()
                if end == "endif":
                    break
        elif name == "for":
            n.value = e.name()
            if e.eat(","):
                n.value += "," + e.name()
            e.need("in")
            n.children.append(e.expression())
            e.done()
            end, e, inside = self.until("else", "endfor")
            n.children += inside
            e.done()
            if end == "else":
                _, e, inside = self.until("endfor")
                n.children += inside
                e.done()
        elif name == "set":
            names = [e.name()]
            while e.eat(","):
                names.append(e.name())
            n.value = ",".join(names)
            if e.eat("="):
                values = [e.expression()]
                while e.eat(","):
                    values.append(e.expression())
                if len(values) != len(names):
                    raise Broken("As many values as names.", start)
                n.children += values
                e.done()
            else:
                if len(names) > 1:
                    raise Broken("A captured text has one name.", start)
                e.done()
                _, e, inside = self.until("endset")
                n.children += inside
                e.done()
        elif name == "block":
            n.value = e.name()
            if n.value in self.blocks:
                raise Broken(f"Block {n.value} stands twice.", start)
            self.blocks.add(n.value)
            if e.peek()[0] != "end":
                n.children.append(e.expression())
                e.done()
            else:
                self.closed(n, "endblock")
        elif name == "macro":
            n.value = e.name()
            e.need("(")
            while not e.eat(")"):
                e.name()
                if e.eat("=", ":"):
                    n.children.append(e.expression())
                if not e.eat(","):
                    e.need(")")
                    break
            e.done()
            self.closed(n, "endmacro")
        elif name in ("extends", "include", "embed", "import", "from", "use"):
            n.children.append(e.expression())
            if name in ("include", "embed"):
                if e.eat("ignore"):
                    e.need("missing")
                if e.eat("with"):
                    n.children.append(e.expression())
                e.eat("only")
            elif name == "import":
                e.need("as")
                n.value = e.name()
            elif name == "from" or name == "use" and e.eat("with"):
                if name == "from":
                    e.need("import")
                while True:
                    e.name()
                    if e.eat("as"):
                        e.name()
                    if not e.eat(","):
                        break
            e.done()
            if name == "embed":
                outer, self.blocks = self.blocks, set()
                self.closed(n, "endembed")
                self.blocks = outer
        elif name == "apply":
            n.value = e.name()
            n.children += e.arguments() if e.peek() == ("op", "(") else []
            while e.eat("|"):
                n.value += "|" + e.name()
                n.children += e.arguments() if e.peek() == ("op", "(") else []
            e.done()
            self.closed(n, "endapply")
        elif name == "with":
            if e.peek()[0] != "end" and e.peek()[1] != "only":
                n.children.append(e.expression())
            e.eat("only")
            e.done()
            self.closed(n, "endwith")
        elif name in ("autoescape", "cache", "sandbox"):
            if e.peek()[0] != "end":
                n.children.append(e.expression())
            while name == "cache" and e.peek()[0] == "name":
                e.name()
                n.children += e.arguments()
            e.done()
            self.closed(n, f"end{name}")
        elif name == "guard":
            n.value = f"{e.name()} {e.name()}"
            e.done()
            end, e, inside = self.until("else", "endguard")
            n.children += inside
            if end == "else":
                n.children += self.until("endguard")[2]
        elif name == "do" or name == "deprecated":
            n.children.append(e.expression())
            while e.peek()[0] == "name" and e.peek(1)[1] == "=":
                e.name(), e.need("=")
                n.children.append(e.expression())
            e.done()
        elif name == "flush":
            e.done()
        elif name == "types":
            while e.peek()[0] != "end":
                e.at += 1
        else:
            raise Broken(f"Unknown tag {name}.", start)
        n.stop = self.parts[self.at - 1][2]
        return n

    def closed(self, n: Item, end: str) -> None:
        _, e, inside = self.until(end)
        n.children += inside
        if e.peek()[0] == "name" and n.value:
            if e.name() != n.value:
                raise Broken(f"{end} names another.", n.start)
        e.done()


def template_rows(source: bytes) -> list[tuple]:
    """Nodes of a template, or one ``error`` node."""
    text = source.decode("utf-8", "replace")
    try:
        root = Template(text).root
    except (Broken, RecursionError) as e:
        at = getattr(e, "at", 0)
        return [(0, None, 0, "error", at, at, str(e))]
    out: list[tuple] = []
    stack: list[tuple[Item, int | None, int]] = [(root, None, 0)]
    while stack:
        n, parent, ordinal = stack.pop()
        own = len(out)
        out.append((own, parent, ordinal, n.kind, n.start, n.stop, n.value))
        stack += [(c, own, i) for i, c in reversed(list(enumerate(n.children)))]
    return out


def template_table(files: DataFrame) -> DataFrame:
    return per_file(files, template_rows, "node_id int, parent_id int, ordinal int, kind string, start int, stop int, value string")
