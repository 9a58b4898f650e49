"""Where rows come from: one CSV file or one Parquet table, by path."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..plans.binder import BindError
from ..plans.types import Field


@dataclass(frozen=True)
class Relation:
    """A file's fields, and its rows as columns named by ordinal (``_0``, ``_1``, …)."""

    path: str
    fields: tuple[Field, ...]
    rows: DataFrame


def positional(n: int) -> list[str]:
    return [f"_{i}" for i in range(n)]


def resolve(spark: SparkSession, file: str) -> str:
    """The path of an existing file or table; a relative one starts at the working directory.

    Existence is asked of the file system that the path names, so stores that only
    Spark reads work as well.
    """
    path = file if "://" in file or os.path.isabs(file) else os.path.abspath(file)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        raise BindError(f"File not found: {path}")
    return path


def open_relation(spark: SparkSession, file: str, has_header: bool = True, multi_line: bool = False) -> Relation:
    from . import csv, parquet

    path = resolve(spark, file)
    if path.rstrip("/").endswith(".parquet"):
        return parquet.relation(spark, path)
    return csv.relation(spark, path, has_header, multi_line)
