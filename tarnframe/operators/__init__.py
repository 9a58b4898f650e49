"""The five operators: scan, filter, projection, aggregate and limit, each as DataFrame calls."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import Predicates
from ..plans.ast import Count, Expression, Name
from ..plans.binder import Bound
from ..plans.fold import fold
from ..sources import Relation, open_relation, positional


def scan(spark: SparkSession, file: str, has_header: bool = True, multi_line: bool = False) -> Relation:
    """The file's rows, lazily; Catalyst prunes what isn't used."""
    return open_relation(spark, file, has_header, multi_line)


def filter_rows(rows: DataFrame, where: Expression, bound: Bound) -> DataFrame:
    """Rows for which the folded predicate is true."""
    columns = [F.col(n) for n in positional(len(bound.fields))]
    return rows.where(Predicates(columns, bound.fields).condition(fold(where)))


def project(rows: DataFrame, names: list[Name]) -> DataFrame:
    """Columns by ordinal in the order asked for; repeats stay."""
    return rows.select(*(F.col(f"_{n.ordinal}") for n in names)).toDF(*(n.name for n in names))


def aggregate(rows: DataFrame, counts: list[Count]) -> DataFrame:
    """One row of counts: all rows, or those where a column isn't NULL."""
    made = [F.count(F.lit(1) if c.name is None else F.col(f"_{c.ordinal}")).alias(f"_{i}") for i, c in enumerate(counts)]
    return rows.agg(*made).toDF(*(c.label for c in counts))


def skip_rows(rows: DataFrame, n: int) -> DataFrame:
    """All but the first n rows, each left where it is.

    Spark's own OFFSET without a LIMIT moves every row to one task.  Rows of a scan
    have a fixed place (partition, number in it), so it is enough to count the
    partitions' rows and to drop the rows before the n-th place.
    """
    if rows.isStreaming or rows.rdd.getNumPartitions() == 1:
        return rows.offset(n)
    place = F.monotonically_increasing_id()  # the partition's number above bit 33, the row's below
    counts = rows.select(F.shiftright(place, 33).alias("part")).groupBy("part").count().collect()
    before = 0
    for part, count in sorted(counts):
        if before + count > n:
            return rows.withColumn("_place", place).where(F.col("_place") >= (part << 33) + n - before).drop("_place")
        before += count
    return rows.limit(0)


#: Rows up to which those before the end of a LIMIT are brought to one task.
FEW_ROWS = 10_000


def placed(rows: DataFrame) -> DataFrame:
    """The rows of a scan with their place in the table, ``_place``: file by name, split of the file, number.

    Spark reads larger files first and gathers the rows of tasks in any order, so neither
    its partitions nor the order of arrival tell which rows are the first ones.
    """
    file = rows.metadataColumn("_metadata")
    place = F.struct(file.file_path.alias("file"), file.file_block_start.alias("split"), F.monotonically_increasing_id().alias("row"))
    return rows.withColumn("_place", place)


def head(rows: DataFrame, n: int) -> DataFrame:
    """Rows with their place, among them the first n of the table.

    The splits of a single file are read in order, so each task stops after n rows.  Of
    several files only the first ones by name are read, as many as have n rows.
    """
    files = sorted(re.sub("^file:/+", "file:/", f) for f in rows.inputFiles())
    taken = 1
    while taken < len(files):
        file = rows.metadataColumn("_metadata").file_path
        first = rows.where(file == files[0] if taken == 1 else file <= files[taken - 1])
        if first.limit(n).count() >= n:
            break
        taken *= 4
    else:
        first = rows
    if len(files) > 1 and taken > 1:
        return placed(first)
    plan = placed(first).limit(n)._jdf.logicalPlan().child()  # the limit of each task without the one of all
    spark = rows.sparkSession
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def between(rows: DataFrame, start: int, end: int | None) -> DataFrame:
    """The rows from the start-th to before the end-th place, each left where it is; only the rows of each split are counted."""
    found = rows.groupBy("_place.file", "_place.split").agg(F.min("_place.row"), F.count(F.lit(1))).collect()
    splits = sorted(tuple(r) for r in found)

    def edge(n: int) -> Column | None:
        before = 0
        for file, split, first, count in splits:
            if before + count > n:
                return F.struct(F.lit(file).alias("file"), F.lit(split).alias("split"), F.lit(first + n - before).alias("row"))
            before += count
        return None

    lower, upper = edge(start), None if end is None else edge(end)
    if lower is None:
        return rows.limit(0)
    rows = rows.where(F.col("_place") >= lower)
    return rows if upper is None else rows.where(F.col("_place") < upper)


def limit_rows(rows: DataFrame, limit: int | None, offset: int | None) -> DataFrame:
    """Skip, then take, in the order of the table's files; where many rows are concerned they are dropped where they are.

    A LIMIT with an OFFSET past ``FEW_ROWS`` counts in the order in which Spark reads the files (``skip_rows``).
    """
    if rows.isStreaming or limit == 0:
        rows = rows.offset(offset) if offset else rows
        return rows if limit is None else rows.limit(limit)
    if limit is None:
        return between(placed(rows), offset, None).drop("_place") if offset else rows
    end = limit + (offset or 0)
    if end <= FEW_ROWS:
        return head(rows, end).orderBy("_place").limit(end).offset(offset or 0).drop("_place")
    if offset:
        return skip_rows(rows, offset).limit(limit)
    return between(head(rows, end), 0, end).drop("_place")


def build(relation: Relation, bound: Bound) -> DataFrame:
    """The whole query over its relation."""
    query, rows = bound.query, relation.rows
    if query.where is not None:
        rows = filter_rows(rows, query.where, bound)
    if bound.counts:
        counted = aggregate(rows, bound.counts)
        if query.offset:
            counted = counted.offset(query.offset)
        return counted if query.limit is None else counted.limit(query.limit)
    return project(limit_rows(rows, query.limit, query.offset), bound.names)
