"""Compile bound, folded predicates to native columns.

Comparisons are two-valued: a NULL cell equals NULL and nothing else, and no
ordering holds for it.  AND, OR and NOT have no value at all over an operand that
isn't true or false, and neither has anything built on them; SQL's NULL stands for
that, and a filter drops it.  No UDF is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.ast import And, Compare, Expression, Literal, Name, Not, Or
from ..plans.types import ColumnType, Field, comparable, type_of_literal


@dataclass(frozen=True)
class Compiled:
    column: Column
    type: ColumnType
    #: whether it may have no value at all (as opposed to a NULL cell)
    may_lack: bool = False
    literal: bool = False


def _no_value() -> Column:
    return F.lit(None).cast("boolean")


def _literal(value: int | float | str | bool | None) -> Compiled:
    kind = type_of_literal(value)
    column = F.lit(value)
    if kind is ColumnType.INTEGER:
        column = column.cast("bigint")
    elif kind is ColumnType.NULL:
        column = F.lit(None)
    return Compiled(column, kind, literal=True)


def _not_nan(*operands: Compiled) -> list[Column]:
    """Conditions that floats are numbers: NaN compares as in IEEE arithmetic, unlike Spark's."""
    return [F.coalesce(~F.isnan(x.column), F.lit(True)) for x in operands if x.type is ColumnType.FLOAT and not x.literal]


def _numbers_in_order(op: str, left: Compiled, right: Compiled) -> list[Column]:
    """Conditions that the operands of an ordering are numbers.

    Spark puts NaN above infinity, so against a literal only the larger side can be
    NaN wrongly, and a bound says that it isn't; unlike isnan, it reaches the reader's filters.
    """
    if not (left.literal or right.literal):
        return _not_nan(left, right)
    larger = left if op in (">", ">=") else right
    return [] if larger.literal or larger.type is not ColumnType.FLOAT else [larger.column <= float("inf")]


def _ordering(op: str, a: Column, b: Column) -> Column:
    return {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def _compare(op: str, left: Compiled, right: Compiled, at_root: bool) -> Column:
    """A comparison whose operands have values; at the root NULL may stand for false."""
    a, b = left.column, right.column
    if not comparable(left.type, right.type):
        both = a.isNull() & b.isNull()
        return {"=": both, "!=": ~both}.get(op, F.lit(False))
    if op in ("=", "!="):
        if ColumnType.NULL in (left.type, right.type):
            equal = a.isNull() & b.isNull()
        elif op == "=" and at_root and (left.literal or right.literal):
            return a == b  # the plain form reaches the reader's filters; a literal is never NaN
        else:
            numbers = [] if left.literal or right.literal else _not_nan(left, right)
            equal = reduce(Column.__and__, numbers, a.eqNullSafe(b))
        return equal if op == "=" else ~equal
    if left.type in (ColumnType.BOOLEAN, ColumnType.NULL) or right.type is ColumnType.NULL:
        return F.lit(False)
    holds = _ordering(op, a, b)
    return reduce(Column.__and__, _numbers_in_order(op, left, right), holds if at_root else F.coalesce(holds, F.lit(False)))


class Predicates:
    """Compiles expressions over columns given by ordinal."""

    def __init__(self, columns: Sequence[Column], fields: Sequence[Field]) -> None:
        self.columns = columns
        self.fields = fields

    def condition(self, e: Expression) -> Column:
        """The filter that keeps exactly the rows for which ``e`` is true."""
        if isinstance(e, And):
            return self.condition(e.left) & self.condition(e.right)
        if isinstance(e, Or) and self._surely(e):
            # both sides have a value, so NULL may stand for false in each: plain forms reach the reader's filters
            return self.condition(e.left) | self.condition(e.right)
        if isinstance(e, Compare):
            left, right = self.compile(e.left), self.compile(e.right)
            if not (left.may_lack or right.may_lack):
                return _compare(e.op, left, right, at_root=True)
        compiled = self.compile(e)
        return compiled.column if compiled.type is ColumnType.BOOLEAN else F.lit(False)

    def _surely(self, e: Expression) -> bool:
        """Whether ``e`` is true or false for every row."""
        if isinstance(e, (And, Or)):
            return self._surely(e.left) and self._surely(e.right)
        return self._truth(e)[1]

    def compile(self, e: Expression) -> Compiled:
        match e:
            case Literal(value):
                return _literal(value)
            case Name(_, ordinal):
                return Compiled(self.columns[ordinal], self.fields[ordinal].type)
            case Not(operand):
                column, sure = self._truth(operand)
                return Compiled(~column, ColumnType.BOOLEAN, may_lack=not sure)
            case And(left, right) | Or(left, right):
                (a, sure_a), (b, sure_b) = self._truth(left), self._truth(right)
                both = a & b if isinstance(e, And) else a | b
                if sure_a and sure_b:
                    return Compiled(both, ColumnType.BOOLEAN)
                return Compiled(F.when(a.isNotNull() & b.isNotNull(), both), ColumnType.BOOLEAN, may_lack=True)
            case Compare(op, left_e, right_e):
                left, right = self.compile(left_e), self.compile(right_e)
                column = _compare(op, left, right, at_root=False)
                lacking = [x.column.isNotNull() for x in (left, right) if x.may_lack]
                if lacking:
                    column = F.when(reduce(Column.__and__, lacking), column)
                return Compiled(column, ColumnType.BOOLEAN, may_lack=bool(lacking))
        raise TypeError(e)

    def _truth(self, e: Expression) -> tuple[Column, bool]:
        """An operand of AND, OR or NOT, and whether it surely has a value."""
        compiled = self.compile(e)
        if compiled.type is not ColumnType.BOOLEAN:
            return _no_value(), False
        sure = compiled.literal or (isinstance(e, (Compare, And, Or, Not)) and not compiled.may_lack)
        return compiled.column, sure
