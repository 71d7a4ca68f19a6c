"""Formulas in conjunctive normal form over assertions on variables.

A literal says that an assertion holds of a variable, or that it does not; a
clause is a set of literals of which one is true, a formula a list of clauses
that are all true.  The empty formula says nothing, the empty clause is false.
A clause that is not ``reconcilable`` is kept as it stands: it takes no part in
what is concluded.

All functions are bounded: each has a limit on the work that it may cause, and
a defined result beyond it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import product
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: Limits; fixed values.
SATURATION, DISJUNCTION, NEGATION, CONSENSUS = 8192, 4096, 4096, 256


class Literal(NamedTuple):
    variable: str
    assertion: str
    holds: bool = True

    def negated(self) -> "Literal":
        return self._replace(holds=not self.holds)


@dataclass(frozen=True)
class Clause:
    literals: frozenset[Literal]
    reconcilable: bool = True
    #: Made by an operation, not written in the source.
    generated: bool = False

    def tautology(self) -> bool:
        return any(x.holds and x.negated() in self.literals for x in self.literals)


def clause(*literals: Literal, **marks: bool) -> Clause:
    return Clause(frozenset(literals), **marks)


def _unit_propagated(clauses: set[frozenset[Literal]]) -> set[frozenset[Literal]]:
    """Literals that stand alone make their clauses true and their negations go."""
    known: set[Literal] = set()
    while units := {next(iter(c)) for c in clauses if len(c) == 1} - known:
        known |= units
        against = {x.negated() for x in known}
        clauses = {c if len(c) == 1 and c <= known and not c & against else c - against for c in clauses if len(c) == 1 or not c & known}
    return clauses


def _merged(clauses: set[frozenset[Literal]]) -> set[frozenset[Literal]]:
    """Two clauses that differ in the sign of one literal are the clause of what they share."""
    while True:
        found = next((c - {x} for c in clauses for x in c if (c - {x}) | {x.negated()} in clauses), None)
        if found is None:
            return clauses
        clauses = {c for c in clauses if not found <= c} | {found}


def _absorbed(clauses: set[frozenset[Literal]]) -> set[frozenset[Literal]]:
    """Without clauses that hold all of another one."""
    kept: list[frozenset[Literal]] = []
    for c in sorted(clauses, key=len):
        if not any(k <= c for k in kept):
            kept.append(c)
    return set(kept)


def _without_consensus(clauses: set[frozenset[Literal]]) -> set[frozenset[Literal]]:
    """Without clauses that two others imply by what is left when a literal of theirs meets its negation."""
    for c in sorted(clauses, key=lambda c: (-len(c), sorted(c))):
        rest = clauses - {c}
        pairs = ((a, x) for a in rest for x in a if a - {x} <= c)
        if any(x.negated() in b and b - {x.negated()} <= c for a, x in pairs for b in rest):
            clauses = rest
    return clauses


def saturated(formula: Iterable[Clause], limit: int = SATURATION, consensus: int = CONSENSUS) -> list[Clause]:
    """An equal formula without what follows from the rest of it.

    Tautologies, repeated and absorbed clauses go, single literals propagate,
    and clauses that differ in one sign are one.  Of at most ``consensus``
    clauses those go too that two others imply.  Beyond ``limit`` clauses the
    result is the empty formula: nothing is known.
    """
    formula = list(dict.fromkeys(formula))
    if len(formula) > limit:
        return []
    fixed = [c for c in formula if not c.reconcilable]
    own = {c.literals: c for c in reversed(formula) if c.reconcilable}
    now = {c.literals for c in own.values() if not c.tautology()}
    while True:
        before = now
        now = _absorbed(_merged(_unit_propagated(now)))
        if now == before:
            break
    if len(now) <= consensus:
        now = _without_consensus(now)
    order = {x: i for i, x in enumerate(dict.fromkeys(c.literals for c in formula))}
    made = sorted(now, key=lambda x: (order.get(x, len(order)), sorted(x)))
    return fixed + [own.get(x, Clause(x, generated=True)) for x in made]


def disjoined(one: Iterable[Clause], other: Iterable[Clause], limit: int = DISJUNCTION) -> list[Clause]:
    """Either formula: each clause of the one with each of the other; nothing is known beyond ``limit`` pairs."""
    one, other = list(one), list(other)
    if len(one) * len(other) > limit:
        return []
    out = [Clause(a.literals | b.literals, a.reconcilable and b.reconcilable, True) for a, b in product(one, other)]
    return [c for c in dict.fromkeys(out) if not c.tautology()]


def negated(formula: Iterable[Clause], limit: int = NEGATION) -> list[Clause] | None:
    """Not the formula: one literal of each clause is chosen and turned, in every way.

    Clauses that are not reconcilable are left out.  None beyond ``limit``
    choices.  The negation of what says nothing is false.
    """
    clauses = [c for c in formula if c.reconcilable]
    choices = 1
    for c in clauses:
        choices *= len(c.literals)
        if choices > limit:
            return None
    out = [Clause(frozenset(x.negated() for x in chosen), generated=True) for chosen in product(*(sorted(c.literals) for c in clauses))]
    return saturated((c for c in out if not c.tautology()), limit)


AssertionSet = list[list[Literal]]


def known_of(formula: Iterable[Clause]) -> dict[str, AssertionSet]:
    """What each variable is known to fulfil: the clauses on it alone, all of which hold, of literals one of which does."""
    out: dict[str, AssertionSet] = {}
    for c in formula:
        names = {x.variable for x in c.literals}
        if c.reconcilable and len(names) == 1:
            out.setdefault(names.pop(), []).append(sorted(c.literals))
    return out


# Assertion sets of one variable: lists of alternatives, all of which hold.


def with_alternative(known: AssertionSet, literal: Literal) -> AssertionSet:
    """Either ``known`` or ``literal``."""
    return [some if literal in some else [*some, literal] for some in known]


def with_literal(known: AssertionSet, literal: Literal) -> AssertionSet:
    """``known`` and ``literal``."""
    return with_alternatives(known, [literal])


def with_alternatives(known: AssertionSet, some: list[Literal]) -> AssertionSet:
    """``known`` and one of ``some``."""
    return known if any(set(some) == set(k) for k in known) else [*known, list(some)]


def both(one: AssertionSet, other: AssertionSet) -> AssertionSet:
    for some in other:
        one = with_alternatives(one, some)
    return one


def negated_set(known: AssertionSet, limit: int = NEGATION) -> AssertionSet | None:
    """Not ``known``; None beyond ``limit`` choices."""
    found = negated((clause(*some) for some in known), limit)
    return None if found is None else [sorted(c.literals) for c in found]


# Columns of formulas.


def read(rows: list[list[str]]) -> list[Clause]:
    """A formula of lists of texts ``variable assertion``; ``!`` before a text negates it."""
    return [clause(*(Literal(*x.removeprefix("!").split(" ", 1), not x.startswith("!")) for x in c)) for c in rows]


def written(formula: Iterable[Clause]) -> list[list[str]]:
    return [sorted(("" if x.holds else "!") + f"{x.variable} {x.assertion}" for x in c.literals) for c in formula]


def transformed(df: DataFrame, column: str, fn: Callable[[list[Clause]], list[Clause] | None] = saturated) -> DataFrame:
    """``df`` with ``fn`` of the formulas in ``column`` (array<array<string>>, see ``read``) in their place; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            out = []
            for rows in batch.column(at).to_pylist():
                made = None if rows is None else fn(read(rows))
                out.append(None if made is None else written(made))
            yield batch.set_column(at, column, pa.array(out, pa.list_(pa.list_(pa.string()))))

    return df.mapInArrow(run, df.schema)
