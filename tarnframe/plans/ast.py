"""The query as parsed: plain immutable values."""

from __future__ import annotations

from dataclasses import dataclass

EQ, NE, GT, GE, LT, LE = "=", "!=", ">", ">=", "<", "<="


@dataclass(frozen=True)
class Literal:
    value: int | float | str | bool | None


@dataclass(frozen=True)
class Name:
    """A column by name; binding gives its ordinal and type."""

    name: str
    ordinal: int | None = None


@dataclass(frozen=True)
class Compare:
    op: str
    left: Expression
    right: Expression


@dataclass(frozen=True)
class And:
    left: Expression
    right: Expression


@dataclass(frozen=True)
class Or:
    left: Expression
    right: Expression


@dataclass(frozen=True)
class Not:
    operand: Expression


Expression = Literal | Name | Compare | And | Or | Not


@dataclass(frozen=True)
class Everything:
    """``*``"""


@dataclass(frozen=True)
class Count:
    """``COUNT(*)``, or ``COUNT(column)`` if a name is given."""

    name: str | None = None
    ordinal: int | None = None

    @property
    def label(self) -> str:
        return "count_star" if self.name is None else f"count_{self.name}"


Item = Everything | Name | Count


@dataclass(frozen=True)
class Query:
    items: tuple[Item, ...]
    file: str
    where: Expression | None = None
    limit: int | None = None
    offset: int | None = None


def text_of(e: Expression) -> str:
    """An expression as text, fully parenthesised."""
    match e:
        case Literal(value):
            if value is None:
                return "NULL"
            return f"'{value}'" if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)
        case Name(name):
            return name
        case Compare(op, left, right):
            return f"({text_of(left)} {op} {text_of(right)})"
        case And(left, right):
            return f"({text_of(left)} AND {text_of(right)})"
        case Or(left, right):
            return f"({text_of(left)} OR {text_of(right)})"
        case Not(operand):
            return f"(NOT {text_of(operand)})"
    raise TypeError(e)
