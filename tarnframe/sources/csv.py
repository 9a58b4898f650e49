"""CSV files: header and types from the first lines, cells converted without errors.

Every column is read as text and converted by native expressions; a cell that
doesn't have its column's type is NULL.  Types come from at most 20 lines, so no
scan is spent on them, and files are split over tasks as usual.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.binder import BindError
from ..plans.types import ColumnType, Field
from . import Relation, positional

SAMPLE_LINES = 20
#: Lines in which the sampled records are looked for if records may have several.
MULTI_LINES = 1000

#: What counts as a whole or a floating-point number.
_INTEGER = r"^[+-]?[0-9]+$"
_FLOAT = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"
_I64 = range(-(1 << 63), 1 << 63)


def cells(line: str) -> list[str]:
    return [c.strip() for c in next(csv.reader(line.splitlines(keepends=True)), [])]


def infer_type(values: list[str]) -> ColumnType:
    """The first type that all values have; empty and ``null`` cells don't count."""
    known = [v for v in values if v and v.lower() != "null"]
    if not known:
        return ColumnType.NULL
    if all(re.match(_INTEGER, v) and int(v) in _I64 for v in known):
        return ColumnType.INTEGER
    if all(re.match(_FLOAT, v) for v in known):
        return ColumnType.FLOAT
    if all(v.lower() in ("true", "false") for v in known):
        return ColumnType.BOOLEAN
    return ColumnType.VARCHAR


def infer_fields(lines: list[str], has_header: bool = True) -> tuple[Field, ...]:
    """Fields of a file that begins with ``lines``.

    A file of one line gives text columns only, with or without a header.
    """
    if not lines:
        raise BindError("CSV file is empty")
    first = cells(lines[0])
    names = first if has_header else [f"column{i + 1}" for i in range(len(first))]
    if len(lines) < 2:
        return tuple(Field(name, ColumnType.VARCHAR) for name in names)
    sample = [cells(line) for line in (lines[1:] if has_header else lines)[:SAMPLE_LINES]]
    return tuple(Field(name, infer_type([row[i] for row in sample if i < len(row)])) for i, name in enumerate(names))


def converted(cell: Column, kind: ColumnType) -> Column:
    """A text cell as its column's type; what isn't of the type is NULL."""
    value = F.nullif(F.trim(cell), F.lit(""))
    if kind is ColumnType.INTEGER:
        return F.when(value.rlike(_INTEGER), value.try_cast("bigint"))
    if kind is ColumnType.FLOAT:
        return F.when(value.rlike(_FLOAT), value.try_cast("double"))
    if kind is ColumnType.BOOLEAN:
        lowered = F.lower(value)
        return F.when(lowered == "true", True).when(lowered == "false", False)
    if kind is ColumnType.NULL:
        return F.lit(None).cast("bigint")
    return value


def whole_records(lines: list[str]) -> list[str]:
    """Lines put together to records, where a quoted cell holds line breaks; an unfinished last one is left out."""
    out, quotes = [""], 0
    for line in lines:
        out[-1] += ("\n" if out[-1] else "") + line
        quotes += line.count('"')
        if quotes % 2 == 0:
            out.append("")
    return out[:-1]


def relation(spark: SparkSession, path: str, has_header: bool = True, multi_line: bool = False) -> Relation:
    """The file's rows.

    By default a line is a record and a file is split over tasks.  With ``multi_line``
    a quoted cell may hold line breaks, and each file is read by one task.
    """
    lines = [r[0].rstrip("\r") for r in spark.read.text(path, lineSep="\n").take(MULTI_LINES if multi_line else SAMPLE_LINES + 1)]
    fields = infer_fields(whole_records(lines)[: SAMPLE_LINES + 1] if multi_line else lines, has_header)
    names = positional(len(fields))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.csv(
        path, schema=schema, header=has_header, mode="PERMISSIVE", enforceSchema=True, multiLine=multi_line,
        escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
    )
    return Relation(path, fields, raw.select(*(converted(F.col(n), f.type).alias(n) for n, f in zip(names, fields))))
