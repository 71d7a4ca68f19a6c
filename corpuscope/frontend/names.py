"""Resolved names: what a name in the source stands for."""

from __future__ import annotations

from .syntax import Node

#: Names that stand for themselves; fixed values.
BUILT_IN = frozenset("int float string bool array object mixed void never null false true iterable callable self static parent".split())


class Scope:
    """A namespace and what is imported into it."""

    def __init__(self, namespace: str = ""):
        self.namespace = namespace.strip("\\")
        self.imports: dict[tuple[str, str], str] = {}

    def use(self, item: Node) -> None:
        kind, name, alias = item.value.split("|")
        alias = alias or name.rsplit("\\", 1)[-1]
        self.imports[kind, alias if kind == "const" else alias.lower()] = name.lstrip("\\")

    def qualify(self, name: str) -> str:
        return f"{self.namespace}\\{name}" if self.namespace else name

    def resolve(self, name: str, kind: str = "") -> tuple[str, bool]:
        """The full name, and whether an import decided it.

        Functions and constants without an import keep the namespace's name;
        whether the global one is meant shows only against a catalog.
        """
        if name.startswith("\\"):
            return name[1:], False
        head, _, rest = name.partition("\\")
        if head.lower() == "namespace" and rest:
            return self.qualify(rest), False
        if rest:
            to = self.imports.get(("", head.lower()))
            return (f"{to}\\{rest}", True) if to else (self.qualify(name), False)
        to = self.imports.get((kind, name if kind == "const" else name.lower()))
        if to:
            return to, True
        if name.lower() in (("true", "false", "null") if kind else BUILT_IN):
            return name.lower(), False
        return self.qualify(name), False


def scopes(root: Node) -> list[tuple[int, int, Scope]]:
    """The scopes of a file with the places where they start and end."""
    out: list[tuple[int, int, Scope]] = []
    now, start = Scope(), 0
    for n in root.children:
        if n.kind == "namespace":
            out.append((start, n.start, now))
            now, start = Scope(n.value), n.start
            body = n.role("body")
            if body is not None:
                for u in body.children:
                    if u.kind == "use":
                        for i in u.children:
                            now.use(i)
                out.append((n.start, n.stop, now))
                now, start = Scope(), n.stop
        elif n.kind == "use":
            for i in n.children:
                now.use(i)
    return [*out, (start, root.stop + 1, now)]


def scope_at(found: list[tuple[int, int, Scope]], at: int) -> Scope:
    return next((s for a, b, s in reversed(found) if a <= at < b), Scope())
