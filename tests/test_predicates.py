"""Predicates against a plain model of their definition, over all combinations of cells."""

import itertools
import operator
import random

import pytest
from pyspark.sql import functions as F

from tarnframe.functions.predicates import Predicates
from tarnframe.plans.ast import And, Compare, Literal, Name, Not, Or, text_of
from tarnframe.plans.binder import BindError, check
from tarnframe.plans.fold import fold
from tarnframe.plans.types import ColumnType as C
from tarnframe.plans.types import Field

FIELDS = (Field("b", C.BOOLEAN), Field("c", C.BOOLEAN), Field("i", C.INTEGER), Field("f", C.FLOAT), Field("s", C.VARCHAR), Field("n", C.NULL))
CELLS = [(True, False, None), (True, False, None), (1, 5, None), (1.0, 2.5, float("nan"), None), ("x", "y", None), (None,)]
ROWS = list(itertools.product(*CELLS))
LACKING = object()
ORDERINGS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def kind_of(v):
    return "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "text"


def value(e, row):
    """True, False, a cell (None if NULL), or LACKING."""
    match e:
        case Literal(v):
            return v
        case Name(_, ordinal):
            return row[ordinal]
        case Not(x):
            v = value(x, row)
            return (not v) if isinstance(v, bool) else LACKING
        case And(a, b) | Or(a, b):
            x, y = value(a, row), value(b, row)
            if not isinstance(x, bool) or not isinstance(y, bool):
                return LACKING
            return (x and y) if isinstance(e, And) else (x or y)
        case Compare(op, a, b):
            x, y = value(a, row), value(b, row)
            if x is LACKING or y is LACKING:
                return LACKING
            if op in ("=", "!="):
                equal = x is None and y is None if x is None or y is None else kind_of(x) == kind_of(y) and x == y
                return equal if op == "=" else not equal
            if x is None or y is None or kind_of(x) != kind_of(y) or kind_of(x) == "bool":
                return False
            return ORDERINGS[op](x, y)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, *row) for k, row in enumerate(ROWS)]
    return spark.createDataFrame(data, "k int, _0 boolean, _1 boolean, _2 bigint, _3 double, _4 string, _5 bigint").cache()


def agree(rows, expressions):
    """All expressions in one job."""
    compiler = Predicates([F.col(f"_{i}") for i in range(6)], FIELDS)
    conditions = [F.coalesce(compiler.condition(fold(e)), F.lit(False)).alias(f"e{k}") for k, e in enumerate(expressions)]
    found = {r.k: r[1:] for r in rows.select("k", *conditions).collect()}
    for k, e in enumerate(expressions):
        folded = fold(e)
        expected = [value(folded, row) is True for row in ROWS]
        got = [found[i][k] for i in range(len(ROWS))]
        assert got == expected, (text_of(e), [(ROWS[i], g, x) for i, (g, x) in enumerate(zip(got, expected)) if g != x][:3])


NAMES = [Name(f.name, i) for i, f in enumerate(FIELDS)]
LITERALS = [Literal(v) for v in (True, False, None, 5, 1, 2.5, "x", "")]


def test_every_comparison(rows):
    leaves = NAMES + LITERALS
    made = []
    for op in ("=", "!=", ">", ">=", "<", "<="):
        for a, b in itertools.product(leaves, leaves):
            e = Compare(op, a, b)
            try:
                check(e, FIELDS)
            except BindError:
                continue
            made += [e, Not(e)]
    for at in range(0, len(made), 150):
        agree(rows, made[at : at + 150])


def test_truth_tables(rows):
    b, c, i = NAMES[0], NAMES[1], NAMES[2]
    t, f = Literal(True), Literal(False)
    sides = [b, c, t, f, Literal(None), i, Literal(5), Not(b), Compare(">", i, Literal(2)), Compare("=", b, t), Compare("=", Not(b), c)]
    made = [node(x, y) for node in (And, Or) for x, y in itertools.product(sides, sides)]
    agree(rows, made + [Not(x) for x in sides] + sides)
    agree(rows, [Not(x) for x in made])


def test_random_expressions(rows):
    rng = random.Random(11)

    def tree(depth):
        if depth == 0 or rng.random() < 0.15:
            return rng.choice(NAMES + LITERALS)
        kind = rng.randrange(4)
        if kind == 0:
            return Not(tree(depth - 1))
        if kind == 1:
            return Compare(rng.choice(["=", "!=", ">", ">=", "<", "<="]), tree(depth - 1), tree(depth - 1))
        return (And, Or)[kind - 2](tree(depth - 1), tree(depth - 1))

    made = []
    while len(made) < 400:
        e = tree(4)
        try:
            check(e, FIELDS)
        except BindError:
            continue
        made.append(e)
    for at in range(0, len(made), 50):
        agree(rows, made[at : at + 50])


@pytest.mark.parametrize(
    "e, folded",
    [
        (And(Literal(True), NAMES[0]), NAMES[0]), (And(NAMES[0], Literal(True)), NAMES[0]), (And(NAMES[0], Literal(False)), Literal(False)), (And(Literal(False), NAMES[0]), Literal(False)),
        (Or(Literal(False), NAMES[0]), NAMES[0]), (Or(NAMES[0], Literal(True)), Literal(True)), (Or(Literal(True), NAMES[0]), Literal(True)), (Or(NAMES[0], Literal(False)), NAMES[0]),
        (Not(Not(NAMES[0])), NAMES[0]), (Not(Not(Not(NAMES[0]))), Not(NAMES[0])), (Not(Literal(True)), Literal(False)), (Not(Not(Not(Not(NAMES[0])))), NAMES[0]),
        (Compare("=", Literal(1), Literal(1)), Literal(True)), (Compare("<", Literal("a"), Literal("b")), Literal(True)), (Compare(">", Literal(1.5), Literal(2.5)), Literal(False)),
        (Compare("=", Literal(None), Literal(None)), Literal(False)), (Compare("!=", Literal(None), Literal(None)), Literal(True)),
        (Compare(">", Literal(None), Literal(None)), Compare(">", Literal(None), Literal(None))), (Compare("=", Literal(1), Literal(1.0)), Compare("=", Literal(1), Literal(1.0))),
        (Compare("<", Literal(True), Literal(False)), Compare("<", Literal(True), Literal(False))), (Compare("=", Literal(True), Literal(True)), Literal(True)),
        (And(Compare("=", Literal(1), Literal(1)), Not(Compare("=", Literal(2), Literal(3)))), Literal(True)), (NAMES[0], NAMES[0]),
    ],
)
def test_folding(e, folded):
    assert fold(e) == folded
