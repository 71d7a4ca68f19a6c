"""A recursive-descent parser from tokens to a tree of nodes.

Broken code gives ``error`` nodes and never an exception: a statement that does
not parse is skipped up to the next semicolon or brace.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .tokens import Token, tokens

#: How tightly binary operators bind, and which bind to the right.
BINDING = {
    "or": 1, "xor": 2, "and": 3, "??": 7, "||": 8, "&&": 9, "|": 10, "^": 11, "&": 12, "==": 13, "!=": 13, "===": 13, "!==": 13, "<>": 13, "<=>": 13, "<": 14, "<=": 14, ">": 14, ">=": 14,
    "|>": 15, ".": 16, "<<": 17, ">>": 17, "+": 18, "-": 18, "*": 19, "/": 19, "%": 19, "instanceof": 21, "**": 22,
}
RIGHT = {"??", "**"}
ASSIGN = {"=", "+=", "-=", "*=", "/=", ".=", "%=", "**=", "&=", "|=", "^=", "<<=", ">>=", "??="}
ASSIGN_LEVEL, TERNARY_LEVEL, UNARY_LEVEL = 4, 6, 20
MODIFIERS = {"public", "protected", "private", "static", "abstract", "final", "readonly", "var"}


@dataclass
class Node:
    kind: str
    start: int
    stop: int = 0
    value: str = ""
    children: list["Node"] = field(default_factory=list)
    roles: dict[str, "Node | None"] = field(default_factory=dict)
    flags: frozenset[str] = frozenset()

    def role(self, name: str) -> "Node | None":
        return self.roles.get(name)

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += reversed(n.children)


class Broken(Exception):
    pass


class Parser:
    def __init__(self, text: str):
        self.text = text
        self.all: list[Token] = tokens(text)
        self.toks = [t for t in self.all if t[0] not in ("space", "comment")]
        self.words = [text[a:b] if k != "cast" else text[a:b].replace(" ", "").replace("\t", "").lower() for k, a, b in self.toks]
        self.low = [w.lower() if k in ("keyword", "name") else w for (k, _, _), w in zip(self.toks, self.words, strict=True)]
        self.at = 0
        self.errors: list[Node] = []

    # Tokens.

    @property
    def kind(self) -> str:
        return self.toks[self.at][0] if self.at < len(self.toks) else "end"

    @property
    def word(self) -> str:
        return self.low[self.at] if self.at < len(self.toks) else ""

    def ahead(self, n: int = 1) -> str:
        return self.low[self.at + n] if self.at + n < len(self.toks) else ""

    def is_op(self, *ops: str) -> bool:
        return self.word in ops and self.kind in ("operator", "keyword", "attribute")

    def start(self) -> int:
        return self.toks[self.at][1] if self.at < len(self.toks) else len(self.text)

    def last(self) -> int:
        return self.toks[min(self.at, len(self.toks)) - 1][2] if self.at and self.toks else 0

    def take(self) -> str:
        self.at += 1
        return self.words[self.at - 1] if self.at <= len(self.words) else ""

    def eat(self, *ops: str) -> bool:
        if self.is_op(*ops):
            self.at += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.eat(op):
            raise Broken(f"expected {op}")

    def done(self, n: Node) -> Node:
        n.stop = max(self.last(), n.start)
        return n

    def node(self, kind: str, start: int, value: str = "", **roles) -> Node:
        n = Node(kind, start, value=value)
        for name, x in roles.items():
            if isinstance(x, list):
                n.children += x
            elif x is not None:
                n.children.append(x)
                n.roles[name] = x
        n.children.sort(key=lambda c: c.start)
        return self.done(n)

    # Statements.

    def program(self) -> Node:
        n = Node("program", 0)
        while self.kind != "end":
            n.children.append(self.guarded())
        n.stop = len(self.text)
        return n

    def guarded(self) -> Node:
        """A statement, or an error up to where one may start again."""
        at, start = self.at, self.start()
        try:
            return self.statement()
        except (Broken, IndexError, RecursionError) as e:
            self.at = max(self.at, at)
            depth = 0
            while self.kind != "end":
                w = self.word if self.kind in ("operator", "close") else ""
                self.at += 1
                if w == "{":
                    depth += 1
                elif w == "}":
                    depth -= 1
                    if depth <= 0:
                        break
                elif w == ";" and depth <= 0:
                    break
            bad = self.done(Node("error", start, value=str(e)))
            self.errors.append(bad)
            return bad

    def end_statement(self) -> None:
        if self.kind == "close":
            self.at += 1
        elif self.kind != "end":
            self.need(";")

    def block(self) -> Node:
        start = self.start()
        self.need("{")
        body = []
        while not self.is_op("}"):
            if self.kind == "end":
                raise Broken("expected }")
            body.append(self.guarded())
        self.need("}")
        return self.node("block", start, body=body)

    def body(self, *ends: str) -> Node:
        """A statement, or the alternative form from a colon up to one of ``ends``."""
        if self.is_op(":") and ends:
            start = self.start()
            self.take()
            inner = []
            while not (self.word in ends and self.kind == "keyword"):
                if self.kind == "end":
                    raise Broken("expected end of block")
                inner.append(self.guarded())
            return self.node("colon_block", start, body=inner)
        return self.statement()

    def paren(self) -> Node:
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def statement(self) -> Node:
        start, k, w = self.start(), self.kind, self.word
        if k == "inline":
            self.at += 1
            return self.node("inline", start)
        if k == "open":
            tag = self.take()
            if tag == "<?=":
                values = self.expressions()
                self.end_statement()
                return self.node("echo_tag", start, values=values)
            return self.node("opening_tag", start, tag)
        if k == "close":
            self.at += 1
            return self.node("closing_tag", start)
        if k == "attribute":
            attributes = self.attributes()
            n = self.statement()
            n.children = attributes + n.children
            n.start = start
            return n
        if self.is_op("{"):
            return self.block()
        if self.is_op(";"):
            self.take()
            return self.node("noop", start)
        if k == "keyword":
            handler = getattr(self, f"on_{w}", None)
            if w == "static" and (self.ahead() in ("::", "function", "fn", "(") or self.toks[self.at + 1][0] != "variable"):
                handler = None
            if w == "enum" and (self.at + 1 >= len(self.toks) or self.toks[self.at + 1][0] != "name"):
                handler = None
            if w in ("function", "fn") and (self.ahead() == "(" or (self.ahead() == "&" and self.ahead(2) == "(") or w == "fn"):
                handler = None
            if w in ("abstract", "final", "readonly", "class"):
                return self.class_like(start)
            if w == "namespace" and self.ahead() == "\\":
                handler = None
            if handler:
                return handler(start)
        if k == "name" and self.ahead() == ":" and self.ahead(2) != ":" and self.toks[self.at + 1][0] == "operator":
            name = self.take()
            self.take()
            return self.node("label", start, name)
        e = self.expression()
        self.end_statement()
        return self.node("expression_statement", start, expression=e)

    def expressions(self) -> list[Node]:
        out = [self.expression()]
        while self.eat(","):
            out.append(self.expression())
        return out

    def on_echo(self, start: int) -> Node:
        self.take()
        values = self.expressions()
        self.end_statement()
        return self.node("echo", start, values=values)

    def on_if(self, start: int) -> Node:
        self.take()
        test = self.paren()
        alt = self.is_op(":")
        then = self.body("elseif", "else", "endif")
        clauses = []
        other = None
        while self.is_op("elseif") or (self.is_op("else") and self.ahead() == "if" and not alt):
            s = self.start()
            if self.take().lower() == "else":
                self.take()
            t = self.paren()
            clauses.append(self.node("elseif", s, test=t, then=self.body("elseif", "else", "endif")))
        if self.is_op("else"):
            s = self.start()
            self.take()
            other = self.node("else", s, then=self.body("endif"))
        if alt:
            self.need("endif")
            self.end_statement()
        return self.node("if", start, test=test, then=then, clauses=clauses, other=other)

    def on_while(self, start: int) -> Node:
        self.take()
        test = self.paren()
        alt = self.is_op(":")
        then = self.body("endwhile")
        if alt:
            self.need("endwhile")
            self.end_statement()
        return self.node("while", start, test=test, then=then)

    def on_do(self, start: int) -> Node:
        self.take()
        then = self.statement()
        self.need("while")
        test = self.paren()
        self.end_statement()
        return self.node("do_while", start, then=then, test=test)

    def on_for(self, start: int) -> Node:
        self.take()
        self.need("(")
        parts = []
        for end in (";", ";", ")"):
            s = self.start()
            some = [] if self.is_op(end) else self.expressions()
            parts.append(self.node("for_part", s, values=some))
            self.need(end)
        alt = self.is_op(":")
        then = self.body("endfor")
        if alt:
            self.need("endfor")
            self.end_statement()
        n = self.node("for", start, parts=parts, then=then)
        n.roles |= dict(zip(("first", "test", "step"), parts, strict=True))
        return n

    def on_foreach(self, start: int) -> Node:
        self.take()
        self.need("(")
        over = self.expression()
        self.need("as")
        self.eat("&")
        key, value = None, self.expression()
        if self.eat("=>"):
            self.eat("&")
            key, value = value, self.expression()
        self.need(")")
        alt = self.is_op(":")
        then = self.body("endforeach")
        if alt:
            self.need("endforeach")
            self.end_statement()
        return self.node("foreach", start, over=over, key=key, value_=value, then=then)

    def on_switch(self, start: int) -> Node:
        self.take()
        test = self.paren()
        alt = self.eat(":")
        if not alt:
            self.need("{")
        self.eat(";")
        cases = []
        while not (self.is_op("endswitch") if alt else self.is_op("}")):
            s = self.start()
            if self.kind == "end" or not self.is_op("case", "default"):
                raise Broken("expected case")
            which = self.take().lower()
            value = self.expression() if which == "case" else None
            if not self.eat(":"):
                self.need(";")
            inner = []
            while not self.is_op("case", "default", "}", "endswitch"):
                if self.kind == "end":
                    raise Broken("expected }")
                inner.append(self.guarded())
            cases.append(self.node("switch_case" if which == "case" else "switch_default", s, value_=value, body=inner))
        self.take()
        if alt:
            self.end_statement()
        return self.node("switch", start, test=test, cases=cases)

    def on_try(self, start: int) -> Node:
        self.take()
        body = self.block()
        catches, last = [], None
        while self.is_op("catch"):
            s = self.start()
            self.take()
            self.need("(")
            kinds = self.type_hint()
            var = None
            if self.kind == "variable":
                v = self.start()
                name = self.take()
                var = self.node("variable", v, name)
            self.need(")")
            catches.append(self.node("catch", s, types=kinds, variable=var, body=self.block()))
        if self.is_op("finally"):
            s = self.start()
            self.take()
            last = self.node("finally", s, body=self.block())
        return self.node("try", start, body=body, catches=catches, last=last)

    def simple(self, kind: str, start: int) -> Node:
        self.take()
        value = None if self.is_op(";") or self.kind in ("close", "end") else self.expression()
        self.end_statement()
        return self.node(kind, start, value_=value)

    def on_return(self, start: int) -> Node:
        return self.simple("return", start)

    def on_break(self, start: int) -> Node:
        return self.simple("break", start)

    def on_continue(self, start: int) -> Node:
        return self.simple("continue", start)

    def on_goto(self, start: int) -> Node:
        self.take()
        name = self.take()
        self.end_statement()
        return self.node("goto", start, name)

    def on_global(self, start: int) -> Node:
        self.take()
        values = self.expressions()
        self.end_statement()
        return self.node("global", start, values=values)

    def on_static(self, start: int) -> Node:
        self.take()
        values = self.expressions()
        self.end_statement()
        return self.node("static_variables", start, values=values)

    def on_unset(self, start: int) -> Node:
        self.take()
        args = self.arguments()
        self.end_statement()
        return self.node("unset", start, arguments=args)

    def on_const(self, start: int) -> Node:
        self.take()
        items = self.constant_items()
        self.end_statement()
        return self.node("constant", start, items=items)

    def constant_items(self) -> list[Node]:
        out = []
        while True:
            s = self.start()
            name = self.take()
            self.need("=")
            out.append(self.node("constant_item", s, name, value_=self.expression()))
            if not self.eat(","):
                return out

    def on_declare(self, start: int) -> Node:
        self.take()
        self.need("(")
        items = self.constant_items()
        self.need(")")
        then = None
        if not self.is_op(";"):
            alt = self.is_op(":")
            then = self.body("enddeclare")
            if alt:
                self.need("enddeclare")
                self.end_statement()
        else:
            self.take()
        return self.node("declare", start, items=items, then=then)

    def on_namespace(self, start: int) -> Node:
        self.take()
        name = self.take() if self.kind == "name" else ""
        if self.is_op("{"):
            return self.node("namespace", start, name, body=self.block())
        self.end_statement()
        return self.node("namespace", start, name)

    def on_use(self, start: int) -> Node:
        self.take()
        what = self.take().lower() if self.word in ("function", "const") else ""
        items = []
        while True:
            s = self.start()
            name = self.take()
            if self.is_op("\\") and self.ahead() == "{":
                self.take()
            if self.eat("{"):
                while not self.is_op("}"):
                    s2 = self.start()
                    kind = self.take().lower() if self.word in ("function", "const") else what
                    inner = self.take()
                    alias = (self.take(), self.take())[1] if self.is_op("as") else ""
                    items.append(Node("use_item", s2, self.last(), f"{kind}|{name.rstrip(chr(92))}\\{inner}|{alias}"))
                    if not self.eat(","):
                        break
                self.need("}")
            else:
                alias = (self.take(), self.take())[1] if self.is_op("as") else ""
                items.append(Node("use_item", s, self.last(), f"{what}|{name}|{alias}"))
            if not self.eat(","):
                break
        self.end_statement()
        return self.node("use", start, items=items)

    def on___halt_compiler(self, start: int) -> Node:
        self.at = len(self.toks)
        return self.node("halt_compiler", start)

    # Declarations.

    def attributes(self) -> list[Node]:
        out = []
        while self.kind == "attribute":
            s = self.start()
            self.take()
            items = []
            while not self.is_op("]"):
                a = self.start()
                name = self.take()
                items.append(self.node("attribute", a, name, arguments=self.arguments() if self.is_op("(") else []))
                if not self.eat(","):
                    break
            self.need("]")
            out.append(self.node("attribute_list", s, items=items))
        return out

    def type_hint(self) -> Node:
        s = self.start()
        depth = 0
        while True:
            if self.is_op("?", "("):
                depth += self.word == "("
                self.take()
                continue
            if self.kind == "cast":  # a parenthesised lone type looks like a cast
                self.take()
            elif self.kind in ("name", "keyword"):
                self.take()
            else:
                raise Broken("expected a type")
            while depth and self.is_op(")"):
                depth -= 1
                self.take()
            if self.is_op("|") or (self.is_op("&") and not (self.at + 1 < len(self.toks) and (self.toks[self.at + 1][0] == "variable" or self.ahead() in ("...", "&")))):
                self.take()
                continue
            break
        return self.node("type", s, self.text[s : self.last()])

    def parameters(self) -> Node:
        s = self.start()
        self.need("(")
        out = []
        while not self.is_op(")"):
            p = self.start()
            attributes = self.attributes()
            flags = set()
            while self.word in MODIFIERS and self.kind == "keyword":
                flags.add(self.take().lower())
                if self.is_op("("):
                    self.take(), self.take(), self.need(")")
            hint = None if self.kind == "variable" or self.is_op("&", "...") else self.type_hint()
            if self.eat("&"):
                flags.add("reference")
            if self.eat("..."):
                flags.add("variadic")
            if self.kind != "variable":
                raise Broken("expected a parameter")
            name = self.take()
            default = self.expression() if self.eat("=") else None
            n = self.node("parameter", p, name, attributes=attributes, hint=hint, default=default)
            if self.is_op("{"):
                n.children.append(self.hooks())
                self.done(n)
            n.flags = frozenset(flags)
            out.append(n)
            if not self.eat(","):
                break
        self.need(")")
        return self.node("parameters", s, items=out)

    def on_function(self, start: int) -> Node:
        self.take()
        self.eat("&")
        name = self.take()
        params = self.parameters()
        hint = self.type_hint() if self.eat(":") else None
        return self.node("function", start, name, parameters=params, returns=hint, body=self.block())

    def class_like(self, start: int) -> Node:
        flags = set()
        while self.word in ("abstract", "final", "readonly") and self.kind == "keyword":
            flags.add(self.take().lower())
        if not self.is_op("class"):
            raise Broken("expected class")
        return self.declared("class", start, frozenset(flags))

    def on_interface(self, start: int) -> Node:
        return self.declared("interface", start)

    def on_trait(self, start: int) -> Node:
        return self.declared("trait", start)

    def on_enum(self, start: int) -> Node:
        return self.declared("enum", start)

    def name_list(self) -> list[Node]:
        out = []
        while True:
            s = self.start()
            if self.kind not in ("name", "keyword"):
                raise Broken("expected a name")
            name = self.take()
            out.append(self.node("name", s, name))
            if not self.eat(","):
                return out

    def declared(self, kind: str, start: int, flags: frozenset[str] = frozenset()) -> Node:
        self.take()
        name = self.take()
        n = self.class_body(kind, start, name)
        n.flags = flags
        return n

    def class_body(self, kind: str, start: int, name: str = "") -> Node:
        backing = self.type_hint() if kind == "enum" and self.eat(":") else None
        s = self.start()
        extends = self.node("extends", s, names=self.name_list()) if self.eat("extends") else None
        s = self.start()
        implements = self.node("implements", s, names=self.name_list()) if self.eat("implements") else None
        self.need("{")
        members = []
        while not self.is_op("}"):
            if self.kind == "end":
                raise Broken("expected }")
            members.append(self.member())
        self.need("}")
        return self.node(kind, start, name, backing=backing, extends=extends, implements=implements, members=members)

    def member(self) -> Node:
        start = self.start()
        attributes = self.attributes()
        flags = set()
        while self.word in MODIFIERS and self.kind == "keyword":
            w = self.take().lower()
            if self.is_op("(") and self.ahead() == "set":
                self.take(), self.take(), self.need(")")
                w += "(set)"
            flags.add(w)
        if self.eat("use"):
            names = self.name_list()
            if self.eat("{"):
                while not self.is_op("}"):
                    if self.kind == "end":
                        raise Broken("expected }")
                    self.take()
                self.take()
            else:
                self.end_statement()
            n = self.node("trait_use", start, names=names)
        elif self.is_op("const"):
            self.take()
            if self.ahead() != "=":
                self.type_hint()
            items = self.constant_items()
            self.end_statement()
            n = self.node("class_constant", start, attributes=attributes, items=items)
        elif self.is_op("case"):
            self.take()
            name = self.take()
            value = self.expression() if self.eat("=") else None
            self.end_statement()
            n = self.node("enum_case", start, name, attributes=attributes, value_=value)
        elif self.is_op("function"):
            self.take()
            self.eat("&")
            name = self.take()
            params = self.parameters()
            hint = self.type_hint() if self.eat(":") else None
            body = self.block() if self.is_op("{") else self.end_statement()
            n = self.node("method", start, name, attributes=attributes, parameters=params, returns=hint, body=body)
        else:
            hint = None if self.kind == "variable" else self.type_hint()
            items = []
            while True:
                s = self.start()
                if self.kind != "variable":
                    raise Broken("expected a property")
                name = self.take()
                items.append(self.node("property_item", s, name, value_=self.expression() if self.eat("=") else None))
                if not self.eat(","):
                    break
            hooks = self.hooks() if self.is_op("{") else self.end_statement()
            n = self.node("property", start, attributes=attributes, hint=hint, items=items, hooks=hooks)
        n.flags = frozenset(flags)
        return n

    def hooks(self) -> Node:
        s = self.start()
        self.need("{")
        out = []
        while not self.is_op("}"):
            a = self.start()
            self.attributes()
            while self.word in MODIFIERS and self.kind == "keyword":
                self.take()
            self.eat("&")
            name = self.take()
            params = self.parameters() if self.is_op("(") else None
            if self.eat("=>"):
                body = self.expression()
                self.end_statement()
            else:
                body = self.block() if self.is_op("{") else self.end_statement()
            out.append(self.node("hook", a, name, parameters=params, body=body))
        self.need("}")
        return self.node("hooks", s, items=out)

    # Expressions.

    def expression(self, least: int = 0) -> Node:
        start = self.start()
        left = self.unary()
        while True:
            w = self.word
            if self.kind not in ("operator", "keyword"):
                break
            if w in ASSIGN:
                self.take()
                by_reference = w == "=" and self.eat("&")
                left = self.node("assignment", start, w, target=left, value_=self.expression(ASSIGN_LEVEL))
                left.flags = frozenset({"reference"} if by_reference else ())
                continue
            if w in ("?", "?:") and TERNARY_LEVEL >= least:
                self.take()
                then = None
                if w == "?" and not self.eat(":"):
                    then = self.expression(ASSIGN_LEVEL)
                    self.need(":")
                left = self.node("ternary", start, "" if then else "short", test=left, then=then, other=self.expression(TERNARY_LEVEL + 1))
                continue
            level = BINDING.get(w)
            if level is None or level < least:
                break
            self.take()
            right = self.expression(level if w in RIGHT else level + 1)
            left = self.node("binary", start, w, left=left, right=right)
        return left

    def unary(self) -> Node:
        start, k, w = self.start(), self.kind, self.word
        if k == "cast":
            self.take()
            return self.node("cast", start, w.strip("()"), operand=self.expression(UNARY_LEVEL))
        if k == "operator" and w in ("!", "+", "-", "~", "@", "&", "++", "--"):
            self.take()
            return self.node("prefix", start, w, operand=self.expression(UNARY_LEVEL if w != "!" else UNARY_LEVEL))
        if k == "keyword":
            if w in ("print", "include", "include_once", "require", "require_once"):
                self.take()
                return self.node("print" if w == "print" else "include", start, w, operand=self.expression(ASSIGN_LEVEL))
            if w == "throw":
                self.take()
                return self.node("throw", start, operand=self.expression())
            if w == "clone":
                self.take()
                return self.node("clone", start, operand=self.expression(UNARY_LEVEL))
            if w == "yield":
                self.take()
                if self.kind == "name" and self.word == "from":
                    self.take()
                    return self.node("yield_from", start, operand=self.expression(ASSIGN_LEVEL))
                if self.is_op(";", ")", ",", "]"):
                    return self.node("yield", start)
                value = self.expression(ASSIGN_LEVEL)
                key = None
                if self.eat("=>"):
                    key, value = value, self.expression(ASSIGN_LEVEL)
                return self.node("yield", start, key=key, value_=value)
            if w == "new":
                return self.postfix(self.new(start), start)
        return self.postfix(self.primary(), start)

    def new(self, start: int) -> Node:
        self.take()
        attributes = self.attributes()
        s = self.start()
        flags = set()
        while self.word == "readonly":
            flags.add(self.take())
        if self.is_op("class"):
            self.take()
            args = self.arguments() if self.is_op("(") else []
            body = self.class_body("anonymous_class", s)
            return self.node("new", start, arguments=attributes + args, target=body)
        if self.is_op("("):
            target = self.paren()
        elif self.kind in ("name", "keyword"):
            target = self.node("name", s, self.take())
        else:
            target = self.primary()
            while self.is_op("->", "::", "[", "?->"):
                target = self.access(target, s, calls=False)
        n = self.node("new", start, arguments=self.arguments() if self.is_op("(") else [], target=target)
        return n

    def arguments(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.is_op(")"):
            s = self.start()
            if self.is_op("...") and self.ahead() == ")":
                self.take()
                out.append(self.node("placeholder", s, "..."))
                break
            named = self.ahead() == ":" and self.kind in ("name", "keyword") and self.ahead(2) == "?" and self.ahead(3) in (",", ")")
            if named or (self.is_op("?") and self.ahead() in (",", ")")):
                name = self.take() if named else ""
                if named:
                    self.take()
                self.take()
                out.append(self.node("placeholder", s, name))
                if not self.eat(","):
                    break
                continue
            spread = self.eat("...")
            name = ""
            if self.kind in ("name", "keyword") and self.ahead() == ":" and self.toks[self.at + 1][0] == "operator" and self.ahead(2) != ":":
                name = self.take()
                self.take()
            n = self.node("argument", s, name, value_=self.expression())
            n.flags = frozenset({"spread"} if spread else ())
            out.append(n)
            if not self.eat(","):
                break
        self.need(")")
        return out

    def elements(self, end: str) -> list[Node]:
        out = []
        while not self.is_op(end):
            s = self.start()
            if self.is_op(","):
                self.take()
                out.append(Node("missing_element", s, s))
                continue
            spread = self.eat("...")
            self.eat("&")
            value, key = self.expression(), None
            if self.eat("=>"):
                self.eat("&")
                key, value = value, self.expression()
            n = self.node("element", s, key=key, value_=value)
            n.flags = frozenset({"spread"} if spread else ())
            out.append(n)
            if not self.eat(","):
                break
        self.need(end)
        return out

    def primary(self) -> Node:
        start, k, w = self.start(), self.kind, self.word
        if k == "variable":
            return self.node("variable", start, self.take())
        if k == "number":
            t = self.take()
            real = re.fullmatch(r"0[xXbBoO].*|[0-9_]+", t) is None
            return self.node("float" if real else "integer", start, t)
        if k in ("single", "double", "heredoc", "shell"):
            t = self.take()
            inside = k != "single" and not re.match(r"[bB]?<<<\s*'", t) and re.search(r"(?<!\\)(?:\\\\)*(\$[A-Za-z_{]|\{\$)", t)
            return self.node("shell" if k == "shell" else "template" if inside else "string", start, t)
        if self.is_op("("):
            self.take()
            e = self.expression()
            self.need(")")
            return self.node("parenthesized", start, expression=e)
        if self.is_op("["):
            self.take()
            return self.node("array", start, items=self.elements("]"))
        if self.is_op("$"):
            self.take()
            if self.eat("{"):
                e = self.expression()
                self.need("}")
            else:
                e = self.primary()
            return self.node("variable_variable", start, expression=e)
        if k == "attribute":
            attributes = self.attributes()
            e = self.primary()
            e.children = attributes + e.children
            return e
        if k == "keyword":
            if w in ("array", "list") and self.ahead() == "(":
                self.take(), self.take()
                return self.node("legacy_array" if w == "array" else "list", start, items=self.elements(")"))
            if w in ("isset", "empty", "eval"):
                self.take()
                return self.node(w, start, arguments=self.arguments())
            if w in ("exit", "die"):
                self.take()
                return self.node("exit", start, w, arguments=self.arguments() if self.is_op("(") else [])
            if w == "static" and self.ahead() in ("function", "fn"):
                self.take()
                n = self.closure(start)
                n.flags = n.flags | {"static"}
                return n
            if w in ("function", "fn"):
                return self.closure(start)
            if w == "match" and self.ahead() == "(":
                return self.match(start)
            if w == "new":
                return self.new(start)
            return self.node("name", start, self.take())
        if k == "name":
            return self.node("name", start, self.take())
        raise Broken(f"unexpected {w or 'end'}")

    def closure(self, start: int) -> Node:
        arrow = self.take().lower() == "fn"
        reference = self.eat("&")
        params = self.parameters()
        uses = []
        if not arrow and self.eat("use"):
            self.need("(")
            while not self.is_op(")"):
                s = self.start()
                by = self.eat("&")
                n = self.node("capture", s, self.take())
                n.flags = frozenset({"reference"} if by else ())
                uses.append(n)
                if not self.eat(","):
                    break
            self.need(")")
        hint = self.type_hint() if self.eat(":") else None
        if arrow:
            self.need("=>")
            n = self.node("arrow_function", start, parameters=params, returns=hint, body=self.expression(ASSIGN_LEVEL))
        else:
            n = self.node("closure", start, parameters=params, captures=uses, returns=hint, body=self.block())
        n.flags = frozenset({"reference"} if reference else ())
        return n

    def match(self, start: int) -> Node:
        self.take()
        test = self.paren()
        self.need("{")
        arms = []
        while not self.is_op("}"):
            s = self.start()
            if self.is_op("default"):
                self.take()
                self.eat(",")
                conditions = []
            else:
                conditions = [self.expression()]
                while self.eat(",") and not self.is_op("=>"):
                    conditions.append(self.expression())
            self.need("=>")
            arms.append(self.node("match_arm" if conditions else "match_default", s, conditions=conditions, result=self.expression()))
            if not self.eat(","):
                break
        self.need("}")
        return self.node("match", start, test=test, arms=arms)

    def access(self, left: Node, start: int, calls: bool = True) -> Node:
        w = self.word
        self.take()
        if w == "[":
            if self.eat("]"):
                return self.node("append", start, target=left)
            e = self.expression()
            self.need("]")
            return self.node("array_access", start, target=left, index=e)
        s = self.start()
        if self.eat("{"):
            member = self.expression()
            self.need("}")
        elif self.kind == "variable":
            member = self.node("variable", s, self.take())
        elif self.is_op("$"):
            member = self.primary()
        elif self.kind in ("name", "keyword"):
            member = self.node("identifier", s, self.take())
        else:
            raise Broken("expected a member")
        static, safe = w == "::", w == "?->"
        if calls and self.is_op("("):
            kind = "static_call" if static else "nullsafe_call" if safe else "method_call"
            return self.node(kind, start, member.value, target=left, member=member, arguments=self.arguments())
        kind = ("static_property" if member.kind == "variable" else "class_constant_access") if static else "nullsafe_property" if safe else "property_access"
        return self.node(kind, start, member.value, target=left, member=member)

    def postfix(self, left: Node, start: int) -> Node:
        while True:
            if self.is_op("->", "?->", "::", "["):
                left = self.access(left, start)
            elif self.is_op("(") and left.kind not in ("integer", "float"):
                left = self.node("call", start, left.value if left.kind == "name" else "", target=left, arguments=self.arguments())
            elif self.is_op("++", "--"):
                w = self.take()
                left = self.node("postfix", start, w, operand=left)
            else:
                return left


def parse(source: bytes | str) -> tuple[Node, Parser]:
    text = source.decode("latin-1") if isinstance(source, bytes) else source
    p = Parser(text)
    return p.program(), p
