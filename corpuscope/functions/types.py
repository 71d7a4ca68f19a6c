"""Types as data: unions of atoms as sorted arrays of strings, joined and compared.

An atom is a scalar (``int``, ``string`` …), a literal (``int(3)``,
``string(a)``), an integer range (``int<0,5>``), ``array<k,v>``, ``list<v>``, a
class name or one of ``mixed never null void``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How many literals of a kind a union keeps before it widens; fixed values.
MOST = {"string": 128, "int": 128, "array": 32}
SCALARS = ("bool", "float", "int", "string")
LITERAL = re.compile(r"(int|string|float)\((.*)\)$", re.S)
RANGE = re.compile(r"int<(-?\d+|min),(-?\d+|max)>$")


def parse_range(a: str) -> tuple[float, float] | None:
    if m := RANGE.match(a):
        return (float("-inf") if m[1] == "min" else int(m[1])), (float("inf") if m[2] == "max" else int(m[2]))
    if (m := LITERAL.match(a)) and m[1] == "int":
        return int(m[2]), int(m[2])
    return (float("-inf"), float("inf")) if a == "int" else None


def show_range(lo: float, hi: float) -> str:
    if lo == float("-inf") and hi == float("inf"):
        return "int"
    return f"int({int(lo)})" if lo == hi else f"int<{'min' if lo == float('-inf') else int(lo)},{'max' if hi == float('inf') else int(hi)}>"


def combine(atoms: list[str]) -> list[str]:
    """The union of ``atoms``: idempotent, and the same whatever their order.

    ``mixed`` takes in everything, ``never`` goes if there is anything else,
    ``void`` is null beside others, ``true`` and ``false`` are ``bool``, the
    four scalars are ``scalar``, ranges that touch are one, and literals widen
    past their threshold.
    """
    found = sorted(set(atoms))
    if not found:
        return ["never"]
    if len(found) == 1:
        return found
    if "mixed" in found:
        return ["mixed"]
    kept = set(found) - {"never"}
    if len(kept) == 1:
        return sorted(kept)
    if "void" in kept:
        kept = kept - {"void"} | {"null"}
    if {"true", "false"} <= kept or "bool" in kept:
        kept = kept - {"true", "false"} | {"bool"}
    if "scalar" in kept:
        kept = {a for a in kept if a not in SCALARS and not LITERAL.match(a) and not RANGE.match(a)}
    for kind in ("string", "float"):
        own = {a for a in kept if a.startswith(f"{kind}(")}
        if kind in kept or len(own) > MOST.get(kind, 128):
            kept = kept - own | ({kind} if own else set())
    numbers = sorted(r for a in kept if (r := parse_range(a)))
    kept = {a for a in kept if parse_range(a) is None}
    literals = [r for r in numbers if r[0] == r[1]]
    if any(r[0] != r[1] for r in numbers) or len(set(literals)) > MOST["int"]:
        if len(set(literals)) > MOST["int"]:
            numbers = [(float("-inf"), float("inf"))]
        joined: list[list[float]] = []
        for lo, hi in numbers:
            if joined and lo <= joined[-1][1] + 1:
                joined[-1][1] = max(joined[-1][1], hi)
            else:
                joined.append([lo, hi])
        kept |= {show_range(lo, hi) for lo, hi in joined}
    else:
        kept |= {show_range(*r) for r in literals}
    if set(SCALARS) <= kept:
        kept = kept - set(SCALARS) | {"scalar"}
    arrays = {a for a in kept if a.startswith(("array<", "list<"))}
    if len(arrays) > MOST["array"] or "array" in kept and arrays:
        kept = kept - arrays | {"array"}
    return sorted(kept)


def contained(atom: str, container: str, ancestors: dict[str, set[str]] | None = None) -> bool:
    """Whether every value of ``atom`` is one of ``container``."""
    if atom == container or container == "mixed" or atom == "never":
        return True
    if container in ("bool",) and atom in ("true", "false"):
        return True
    if container == "scalar":
        return atom in (*SCALARS, "true", "false") or bool(LITERAL.match(atom)) or bool(RANGE.match(atom))
    if container == "object":
        return bool(re.match(r"[A-Z\\]", atom))
    if container == "iterable" and atom.startswith(("array", "list")):
        return True
    m = LITERAL.match(atom)
    if m and m[1] == container:
        return True
    a, c = parse_range(atom), parse_range(container)
    if a and c:
        return c[0] <= a[0] and a[1] <= c[1]
    if container == "array" and atom.startswith(("array<", "list<")):
        return True
    if atom.startswith("list<") and container.startswith("list<"):
        return union_contained(split(atom[5:-1]), split(container[5:-1]), ancestors)
    if atom.startswith("list<") and container.startswith("array<"):
        k, v = pair(container)
        return union_contained(["int"], split(k), ancestors) and union_contained(split(atom[5:-1]), split(v), ancestors)
    if atom.startswith("array<") and container.startswith("array<"):
        (k, v), (x, y) = pair(atom), pair(container)
        return union_contained(split(k), split(x), ancestors) and union_contained(split(v), split(y), ancestors)
    return container.lower() in {x.lower() for x in (ancestors or {}).get(atom.lower(), ())}


def parts(text: str, mark: str) -> list[str]:
    out, depth, now = [], 0, ""
    for ch in text:
        depth += (ch in "<(") - (ch in ">)")
        if ch == mark and not depth:
            out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now]


def split(union: str) -> list[str]:
    return parts(union, "|")


def pair(a: str) -> tuple[str, str]:
    inner = parts(a[a.index("<") + 1 : -1], ",")
    return (inner[0], inner[1]) if len(inner) == 2 else ("int|string", inner[0])


def union_contained(atoms: list[str], container: list[str], ancestors: dict[str, set[str]] | None = None) -> bool:
    """Every atom is in the container, alone or, as ``bool`` and numbers can, in several of its parts."""
    if set(atoms) <= set(container):
        return True
    whole = combine(container)
    for a in atoms:
        if a == "bool" and "bool" not in whole:
            return union_contained(["true"], container, ancestors) and union_contained(["false"], container, ancestors)
        if not any(contained(a, c, ancestors) for c in [*container, *whole]):
            return False
    return True


def overlap(a: list[str], b: list[str]) -> bool:
    """Whether some value is of both unions."""
    return any(contained(x, y) or contained(y, x) or bool((p := parse_range(x)) and (q := parse_range(y)) and max(p[0], q[0]) <= min(p[1], q[1])) for x in a for y in b)


def combined_scalars(c: Column) -> Column:
    """``combine`` for arrays of plain atoms without literals or ranges, in Spark's own functions."""
    s = F.array_sort(F.array_distinct(c))
    s = F.when(F.size(s) > 1, F.array_remove(s, F.lit("never"))).otherwise(s)
    s = F.when(F.array_contains(s, "void") & (F.size(s) > 1), F.array_distinct(F.array_append(F.array_remove(s, F.lit("void")), F.lit("null")))).otherwise(s)
    both = F.array_contains(s, "bool") | (F.array_contains(s, "true") & F.array_contains(s, "false"))
    s = F.when(both, F.array_distinct(F.array_append(F.array_except(s, F.array(F.lit("true"), F.lit("false"))), F.lit("bool")))).otherwise(s)
    four = F.array(*map(F.lit, SCALARS))
    all_four = F.size(F.array_intersect(s, four)) == 4
    s = F.when(F.array_contains(s, "scalar") | all_four, F.array_distinct(F.array_append(F.array_except(s, four), F.lit("scalar")))).otherwise(s)
    s = F.when(F.array_contains(s, "mixed"), F.array(F.lit("mixed"))).when(F.size(s) == 0, F.array(F.lit("never"))).otherwise(s)
    return F.array_sort(s)
