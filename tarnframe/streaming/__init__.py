"""The query language over streams: the same filter, projection and counts on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import operators
from ..plans.binder import bind
from ..plans.parser import parse
from ..sources import Relation, positional
from ..sources.parquet import _TYPES
from ..plans.types import ColumnType, Field


def over_stream(sql: str, stream: DataFrame) -> DataFrame:
    """Apply a query to ``stream`` in place of the file that its FROM names.

    LIMIT and OFFSET need an end of input, so Spark allows them only in complete mode.
    """
    query = parse(sql)
    fields = tuple(Field(f.name, _TYPES.get(type(f.dataType), ColumnType.OTHER)) for f in stream.schema.fields)
    return operators.build(Relation(query.file, fields, stream.toDF(*positional(len(fields)))), bind(query, fields))
