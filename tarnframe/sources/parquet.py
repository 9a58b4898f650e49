"""Parquet tables: the schema is the file's own."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..plans.types import ColumnType, Field
from . import Relation, positional

_TYPES = {
    T.ByteType: ColumnType.INTEGER,
    T.ShortType: ColumnType.INTEGER,
    T.IntegerType: ColumnType.INTEGER,
    T.LongType: ColumnType.INTEGER,
    T.FloatType: ColumnType.FLOAT,
    T.DoubleType: ColumnType.FLOAT,
    T.BooleanType: ColumnType.BOOLEAN,
    T.StringType: ColumnType.VARCHAR,
}


def relation(spark: SparkSession, path: str) -> Relation:
    rows = spark.read.parquet(path)
    fields = tuple(Field(f.name, _TYPES.get(type(f.dataType), ColumnType.OTHER)) for f in rows.schema.fields)
    return Relation(path, fields, rows.toDF(*positional(len(fields))))
