"""Formulas against their truth tables."""

from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscope.functions import logic
from corpuscope.functions.logic import Clause, Literal, clause

LITERALS = [Literal(v, a, s) for v in "xy" for a in ("null", "int") for s in (True, False)]
FORMULAS = st.lists(st.frozensets(st.sampled_from(LITERALS), min_size=1, max_size=4).map(Clause), max_size=6)
KEYS = sorted({x[:2] for x in LITERALS})


def table(formula):
    out = []
    for values in product((False, True), repeat=len(KEYS)):
        world = dict(zip(KEYS, values, strict=True))
        out.append(all(any(world[x[:2]] == x.holds for x in c.literals) for c in formula))
    return out


@settings(max_examples=400, deadline=None)
@given(FORMULAS)
def test_saturated_is_equal_and_no_longer(formula):
    made = logic.saturated(formula)
    assert table(made) == table(formula) and len(made) <= len(set(formula))
    assert logic.saturated(made) == made


@settings(max_examples=300, deadline=None)
@given(FORMULAS)
def test_negated(formula):
    made = logic.negated(formula, 10**6)
    assert table(made) == [not x for x in table(formula)]


@settings(max_examples=300, deadline=None)
@given(FORMULAS, FORMULAS)
def test_disjoined(one, other):
    assert table(logic.disjoined(one, other)) == [a or b for a, b in zip(table(one), table(other), strict=True)]


def test_limits_and_fixed_clauses():
    x, y, z = (Literal(v, "null") for v in "xyz")
    many = [clause(Literal("x", str(i)), Literal("y", str(i))) for i in range(20)]
    assert logic.saturated(many, limit=19) == [] and logic.disjoined(many, many, 399) == [] and logic.negated(many) is None
    odd = clause(x.negated(), reconcilable=False)
    assert logic.saturated([clause(x), odd]) == [odd, clause(x)] and logic.negated([clause(x), odd]) == [clause(x.negated(), generated=True)]
    assert logic.saturated([clause(x, y), clause(x.negated(), z), clause(y, z)]) == [clause(x, y), clause(x.negated(), z)]
    assert logic.known_of([clause(x), clause(x, y), clause(y, Literal("y", "int"))]) == {"x": [[x]], "y": [[Literal("y", "int"), y]]}


def test_assertion_sets():
    a, b, c = (Literal("x", k) for k in ("null", "int", "string"))
    assert logic.with_alternative([[a], [b]], c) == [[a, c], [b, c]] and logic.with_alternative([[a]], a) == [[a]]
    assert logic.with_literal([[a]], b) == [[a], [b]] and logic.with_alternatives([[a, b]], [b, a]) == [[a, b]]
    assert logic.both([[a]], [[a], [b, c]]) == [[a], [b, c]]
    assert logic.negated_set([[a, b]]) == [[a.negated()], [b.negated()]] or logic.negated_set([[a, b]]) == [[b.negated()], [a.negated()]]


def test_columns(spark):
    rows = [(1, [["x null", "y int"], ["!x null", "y int"]]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "id int, f array<array<string>>")
    assert {r["id"]: r["f"] for r in logic.transformed(df, "f").collect()} == {1: [["y int"]], 2: [], 3: None}
    assert {r["id"]: r["f"] for r in logic.transformed(df, "f", logic.negated).collect()} == {1: [["!y int"]], 2: [[]], 3: None}
