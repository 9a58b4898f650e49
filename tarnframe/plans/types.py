"""The engine's five column types, and what they may be compared with."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class ColumnType(Enum):
    INTEGER = "Integer"
    FLOAT = "Float"
    BOOLEAN = "Boolean"
    VARCHAR = "Varchar"
    NULL = "Null"
    #: a Parquet type outside the five: may be selected and counted, compared only with NULL
    OTHER = "Other"


@dataclass(frozen=True)
class Field:
    name: str
    type: ColumnType


def comparable(left: ColumnType, right: ColumnType) -> bool:
    numbers = {ColumnType.INTEGER, ColumnType.FLOAT}
    if ColumnType.NULL in (left, right):
        return True
    if ColumnType.OTHER in (left, right):
        return False
    return left == right or {left, right} == numbers


def type_of_literal(value: int | float | str | bool | None) -> ColumnType:
    if value is None:
        return ColumnType.NULL
    if isinstance(value, bool):
        return ColumnType.BOOLEAN
    if isinstance(value, int):
        return ColumnType.INTEGER
    return ColumnType.FLOAT if isinstance(value, float) else ColumnType.VARCHAR
