"""The architecture guard: which namespaces may depend on which, and what symbols must be like.

Rules are configuration, not data: they are compiled into expressions, so a
check is one pass over the dependency edges without a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import namespace_regex


@dataclass(frozen=True)
class Rule:
    """From ``namespace`` and below, dependencies on any of ``permit`` are allowed.

    An operand is a namespace pattern, ``@all``, ``@self`` (the rule's own
    namespace), ``@global`` (names without namespace) or ``@layer:name``.
    """

    namespace: str
    permit: tuple[str, ...] = ()


@dataclass(frozen=True)
class Restriction:
    """What only ``allow_from`` may depend on, and ``deny_from`` never."""

    target: str
    allow_from: tuple[str, ...] = ()
    deny_from: tuple[str, ...] = ()


@dataclass(frozen=True)
class Guard:
    rules: tuple[Rule, ...] = ()
    layers: tuple[tuple[str, str], ...] = ()  # name and namespace, the innermost first
    restrictions: tuple[Restriction, ...] = ()
    separator: str = "\\"

    def matches(self, c: Column, pattern: str, own: str = "") -> Column:
        if pattern == "@all":
            return F.lit(True)
        if pattern == "@global":
            return ~c.contains(self.separator)
        if pattern == "@self":
            pattern = own
        if pattern.startswith("@layer:"):
            pattern = dict(self.layers)[pattern.removeprefix("@layer:")]
        return c.rlike(namespace_regex(pattern, self.separator, prefix=True))

    def layer(self, c: Column) -> Column:
        """Number of the layer that ``c`` is in; null: none."""
        out = F.lit(None).cast("int")
        for i in range(len(self.layers) - 1, -1, -1):
            out = F.when(self.matches(c, self.layers[i][1]), i).otherwise(out)
        return out

    def verdict(self, source: Column, target: Column) -> Column:
        """Why the edge breaks the rules; null: allowed."""
        restricted = F.lit(False)
        for r in self.restrictions:
            denied = allowed = F.lit(False)
            for p in r.deny_from:
                denied = denied | self.matches(source, p)
            for p in r.allow_from:
                allowed = allowed | self.matches(source, p)
            restricted = restricted | self.matches(target, r.target) & (denied | (~allowed if r.allow_from else F.lit(False)))
        chosen = F.lit(None).cast("boolean")
        for r in sorted(self.rules, key=lambda r: len(r.namespace)):  # the longest namespace decides, the last one at equal length
            permitted = F.lit(False)
            for p in r.permit:
                permitted = permitted | self.matches(target, p, r.namespace)
            chosen = F.when(self.matches(source, r.namespace), permitted).otherwise(chosen)
        a, b = self.layer(source), self.layer(target)
        layered = (a.isNotNull() & b.isNotNull()) if self.layers else F.lit(False)
        out = F.when(restricted, "restricted").when(F.coalesce(chosen, F.lit(False)), None)
        if self.layers:
            out = out.when(layered, F.when(a >= b, F.lit(None)).otherwise("layering"))
        if not self.rules and not self.layers:
            return out.otherwise(F.lit(None))
        return out.when(chosen.isNull(), "no_matching_rule").otherwise("forbidden_by_rule")


def perimeter(edges: DataFrame, guard: Guard) -> DataFrame:
    """Edges (``source``, ``target``) that break the rules, with ``reason``."""
    return edges.withColumn("reason", guard.verdict(F.col("source"), F.col("target"))).where("reason is not null")


@dataclass(frozen=True)
class Shape:
    """What symbols whose name matches ``on`` must be like."""

    on: str
    not_on: str | None = None
    kinds: tuple[str, ...] = ()
    must_be: tuple[str, ...] = ()
    must_be_named: str | None = None
    must_be_final: bool | None = None
    must_be_abstract: bool | None = None
    must_be_readonly: bool | None = None
    must_extend: tuple[tuple[str, ...], ...] = ()  # any of these groups, all of its names
    must_implement: tuple[tuple[str, ...], ...] = ()
    must_use_trait: tuple[tuple[str, ...], ...] = ()


def structural(symbols: DataFrame, shapes: list[Shape], separator: str = "\\", carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each flaw of a symbol (``name``, ``kind``, flags, ``extends``, ``implements``, ``uses``), with its columns ``carry``."""
    flaws = []
    name = F.col("name")
    own = F.element_at(F.split(name, "\\Q" + separator + "\\E"), -1)

    def inherits(groups: tuple[tuple[str, ...], ...], parents: str) -> Column:
        out = F.lit(False)
        for g in groups:
            all_of = F.lit(True)
            for p in g:
                all_of = all_of & holds(parents, namespace_regex(p, separator))
            out = out | all_of
        return out

    def holds(parents: str, regex: str) -> Column:
        return F.exists(parents, lambda x: x.rlike(regex))

    for i, s in enumerate(shapes):
        on = name.rlike(namespace_regex(s.on, separator))
        if s.not_on:
            on = on & ~name.rlike(namespace_regex(s.not_on, separator))
        if s.kinds:
            on = on & F.col("kind").isin(*s.kinds)
        checks: list[tuple[str, Column]] = []
        if s.must_be:
            checks.append(("must_be", F.col("kind").isin(*s.must_be)))
        if s.must_be_named:
            checks.append(("must_be_named", own.rlike(namespace_regex(s.must_be_named, separator))))
        for flag in ("final", "abstract", "readonly"):
            if (want := getattr(s, f"must_be_{flag}")) is not None:
                checks.append((f"must_be_{flag}" if want else f"must_not_be_{flag}", F.col(f"is_{flag}") == want))
        for what, parents in (("must_extend", "extends"), ("must_implement", "implements"), ("must_use_trait", "uses")):
            if groups := getattr(s, what):
                checks.append((what, inherits(groups, parents)))
        flaws += [F.when(on & ~ok, F.struct(F.lit(i).alias("rule"), F.lit(k).alias("flaw"))) for k, ok in checks]
    return symbols.select("name", "kind", *carry, F.explode(F.array_compact(F.array(*flaws))).alias("x")).select("name", "kind", *carry, "x.rule", "x.flaw")
