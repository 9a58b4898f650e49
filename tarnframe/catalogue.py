"""The engine's registered queries, one or more for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .plans.ast import Everything
from .plans.binder import BindError
from .repl import run_query
from .storage import scratch_path


@dataclass(frozen=True)
class Case:
    """A query in the engine's language over a table; the same rows in plain SQL."""

    select: str
    table: str
    rest: str = ""
    oracle: str = ""


def _same(select: str, table: str, rest: str = "") -> Case:
    return Case(select, table, rest, f"SELECT {select} FROM {table} {rest}")


_LINE_COLUMNS = "l_orderkey, l_quantity, l_extendedprice, l_discount, l_returnflag"
_BENCH_LIMIT = "WHERE l_quantity > 30 AND l_quantity < 45 AND l_returnflag = 'R' AND l_extendedprice > 50000.0 LIMIT 1000"
_BENCH_SCAN = "WHERE l_quantity > 10 AND l_quantity < 45 AND l_returnflag = 'R' AND l_extendedprice > 5000.0 AND NOT (l_linestatus = 'O') AND NOT NOT (l_quantity > 5)"

CASES: dict[str, Case] = {
    "scan_star": _same("*", "region"),
    "project_cols": _same("n_name, n_regionkey", "nation"),
    "project_reorder": _same("s_acctbal, s_name, s_suppkey", "supplier"),
    "project_paren": Case("(n_name), (n_nationkey)", "nation", "", "SELECT n_name, n_nationkey FROM nation"),
    "filter_eq_str": _same("*", "orders", "WHERE o_orderstatus = 'F'"),
    "filter_ne": _same("o_orderkey, o_orderpriority", "orders", "WHERE o_orderpriority != '1-URGENT'"),
    "filter_gt": _same("l_orderkey, l_linenumber, l_quantity", "lineitem", "WHERE l_quantity > 45"),
    "filter_ge": _same("l_orderkey, l_linenumber, l_quantity", "lineitem", "WHERE l_quantity >= 45"),
    "filter_lt": _same("l_orderkey, l_linenumber, l_extendedprice", "lineitem", "WHERE l_extendedprice < 2000.5"),
    "filter_le": _same("l_orderkey, l_linenumber, l_tax", "lineitem", "WHERE l_tax <= 0.01"),
    "filter_and": _same(_LINE_COLUMNS, "lineitem", "WHERE l_quantity > 30 AND l_returnflag = 'R'"),
    "filter_or": _same(_LINE_COLUMNS, "lineitem", "WHERE l_quantity > 48 OR l_discount = 0.1"),
    "filter_not": _same(_LINE_COLUMNS, "lineitem", "WHERE NOT l_returnflag = 'N'"),
    "filter_nested": _same(_LINE_COLUMNS, "lineitem", "WHERE (l_quantity > 40 OR l_discount < 0.02) AND NOT (l_returnflag = 'R' OR l_tax > 0.05)"),
    "filter_int_float": _same("p_partkey, p_size", "part", "WHERE p_size > 10.5"),
    "filter_float_int": _same("l_orderkey, l_linenumber, l_quantity", "lineitem", "WHERE l_quantity >= 30 AND l_quantity < 32"),
    "filter_str_range": _same("n_name", "nation", "WHERE n_name >= 'J'"),
    "filter_col_col": _same("l_orderkey, l_linenumber", "lineitem", "WHERE l_discount > l_tax"),
    "filter_null_ne": Case("o_orderkey", "orders", "WHERE o_orderpriority != NULL", "SELECT o_orderkey FROM orders WHERE o_orderpriority IS NOT NULL"),
    "filter_null_eq": Case("o_orderkey", "orders", "WHERE o_orderpriority = NULL", "SELECT o_orderkey FROM orders WHERE o_orderpriority IS NULL"),
    "filter_chained": Case("l_orderkey, l_linenumber", "lineitem", "WHERE l_quantity > 40 = true", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 40) = true"),
    "filter_bare": Case("n_name", "nation", "WHERE true", "SELECT n_name FROM nation"),
    "filter_bare_number": Case("n_name", "nation", "WHERE n_nationkey", "SELECT n_name FROM nation WHERE false"),
    "fold_true": Case("n_name", "nation", "WHERE 1 = 1 AND n_regionkey = 2", "SELECT n_name FROM nation WHERE n_regionkey = 2"),
    "fold_false": Case("n_name", "nation", "WHERE NULL = NULL", "SELECT n_name FROM nation WHERE false"),
    "fold_not_not": Case("n_name", "nation", "WHERE NOT NOT (n_regionkey >= 3)", "SELECT n_name FROM nation WHERE n_regionkey >= 3"),
    "count_star": Case("COUNT(*)", "lineitem", "", "SELECT count(*) AS count_star FROM lineitem"),
    "count_star_filter": Case("COUNT(*)", "lineitem", "WHERE l_discount > 0.05", "SELECT count(*) AS count_star FROM lineitem WHERE l_discount > 0.05"),
    "count_col": Case("COUNT(l_quantity)", "lineitem", "", "SELECT count(l_quantity) AS count_l_quantity FROM lineitem"),
    "count_col_filter": Case("COUNT(l_tax)", "lineitem", "WHERE l_returnflag = 'A'", "SELECT count(l_tax) AS count_l_tax FROM lineitem WHERE l_returnflag = 'A'"),
    "count_multi": Case("COUNT(*), COUNT(o_orderdate)", "orders", "", "SELECT count(*) AS count_star, count(o_orderdate) AS count_o_orderdate FROM orders"),
    "count_mixed": Case("l_returnflag, COUNT(*)", "lineitem", "", "SELECT count(*) AS count_star FROM lineitem"),
    "limit_n": _same("*", "nation", "LIMIT 7"),
    "limit_zero": _same("*", "nation", "LIMIT 0"),
    "offset_n": _same("*", "nation", "OFFSET 20"),
    "limit_offset": _same("*", "nation", "LIMIT 5 OFFSET 10"),
    "limit_filter": _same("n_nationkey, n_name", "nation", "WHERE n_regionkey >= 2 LIMIT 4 OFFSET 1"),
    "limit_over_count": Case("COUNT(*)", "nation", "LIMIT 0", "SELECT count(*) AS count_star FROM nation LIMIT 0"),
    "offset_over_count": Case("COUNT(*)", "nation", "OFFSET 1", "SELECT count(*) AS count_star FROM nation OFFSET 1"),
    "bench_limit": _same(_LINE_COLUMNS, "lineitem", _BENCH_LIMIT),
    "bench_scan": _same(_LINE_COLUMNS, "lineitem", _BENCH_SCAN),
    "bench_count": Case("COUNT(*)", "lineitem", "", "SELECT count(*) AS count_star FROM lineitem"),
    "bench_count_filter": Case("COUNT(l_quantity)", "lineitem", "WHERE l_quantity > 30 AND l_returnflag = 'R'", "SELECT count(l_quantity) AS count_l_quantity FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'"),
}


def statement(case: Case, path: str) -> str:
    return f"SELECT {case.select} FROM '{path}' {case.rest}"


def _run(case: Case, spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).sql(statement(case, f"{sf_dir}/{case.table}.parquet"))


def csv_copy(spark: SparkSession, sf_dir: str, table: str) -> str:
    """The table as CSV files with a header each, in a shared folder; the path of the copy."""
    path = scratch_path(spark, f"{table}-csv")
    spark.read.parquet(f"{sf_dir}/{table}.parquet").write.csv(path, header=True)
    return path


def _csv_query(table: str, select: str, rest: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).sql(f"SELECT {select} FROM '{csv_copy(spark, sf_dir, table)}' {rest}")


def fixture(spark: SparkSession, name: str, lines: list[str]) -> str:
    """A small text file in a shared folder; its path."""
    path = scratch_path(spark, name)
    spark.createDataFrame([("\n".join(lines),)], "line string").coalesce(1).write.text(path)
    return path


def csv_bad_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells past the sampled lines that don't have their column's type are NULL."""
    rows = ["id,score"] + [f"{i},{i}.5" for i in range(20)] + ["x,1.5", "21,y", ",", "null,null", "3.5,7"]
    return Engine(spark).sql(f"SELECT score FROM '{fixture(spark, 'bad-cells-csv', rows)}' WHERE id = NULL")


NULL_LINES = ["id,b,i,f,s", "1,true,1,1.5,a", "2,false,2,2.5,b", "3,,3,,c", "4,true,,4.5,", "5,,,,", "6,false,5,-1.5,null", "7,true,-3,0.5,d"]
_NULL_ROWS = """(VALUES (1::BIGINT, true, 1::BIGINT, 1.5::DOUBLE, 'a'), (2, false, 2, 2.5, 'b'), (3, NULL, 3, NULL, 'c'), (4, true, NULL, 4.5, NULL),
(5, NULL, NULL, NULL, NULL), (6, false, 5, -1.5, 'null'), (7, true, -3, 0.5, 'd')) t(id, b, i, f, s)"""
#: What is selected, the predicate in the engine's language, and the same in plain SQL.
NULL_CASES = {
    "null_equals_null": ("id", "i = NULL", "i IS NULL"),
    "null_differs_from_value": ("id, i", "i != 2", "i IS DISTINCT FROM 2"),
    "null_orders_with_nothing": ("id, f", "f <= 1.5", "f <= 1.5"),
    "null_column_equals_column": ("id", "i = f", "i IS NOT DISTINCT FROM f"),
    "null_under_and": ("id", "i != 2 AND f > 0", "i IS DISTINCT FROM 2 AND f > 0"),
    "null_under_or": ("id", "i > 2 OR f > 2", "coalesce(i > 2, false) OR coalesce(f > 2, false)"),
    "null_under_not": ("id", "NOT (i > 1)", "NOT coalesce(i > 1, false)"),
    "no_value_under_and": ("id", "b AND i != 2", "b IS NOT NULL AND b AND i IS DISTINCT FROM 2"),
    "no_value_under_or": ("id", "b OR i = 3", "b IS NOT NULL AND (b OR i IS NOT DISTINCT FROM 3)"),
    "no_value_under_not": ("id", "NOT b", "b IS NOT NULL AND NOT b"),
    "bare_boolean_column": ("id", "b", "b IS TRUE"),
    "negative_integer": ("id, i", "i = -3", "i = -3"),
    "negative_float": ("id, f", "f < -1.25", "f < -1.25"),
    "null_text": ("id, s", "s = 'null'", "s = 'null'"),
    "boolean_never_orders": ("id", "b > false OR id = 1", "id = 1"),
}


def _null_query(select: str, where: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).sql(f"SELECT {select} FROM '{fixture(spark, 'nulls-csv', NULL_LINES)}' WHERE {where}")


def count_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COUNT of columns with NULLs."""
    return Engine(spark).sql(f"SELECT COUNT(*), COUNT(i), COUNT(b), COUNT(f) FROM '{fixture(spark, 'nulls-csv', NULL_LINES)}'")


def count_nulls_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COUNT of a column over the selected rows only."""
    return Engine(spark).sql(f"SELECT COUNT(f), COUNT(*) FROM '{fixture(spark, 'nulls-csv', NULL_LINES)}' WHERE i != 2")


def project_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column selected twice; the second is named apart here."""
    return Engine(spark).sql(f"SELECT n_name, n_name FROM '{sf_dir}/nation.parquet'").toDF("n_name", "n_name_again")


def _fields(spark: SparkSession, fields: tuple) -> DataFrame:
    return spark.createDataFrame([(i, f.name, f.type.value) for i, f in enumerate(fields)], "position int, name string, type string")


def validate_headerless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema of a file without a header."""
    path = fixture(spark, "headerless-csv", ["1,Alice,30.5,true", "2,Bob,25,false"])
    return _fields(spark, Engine(spark).validate(path, False, (Everything(),))[1])


def validate_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema of a file with a header."""
    return _fields(spark, Engine(spark).validate(fixture(spark, "nulls-csv", NULL_LINES), True, (Everything(),))[1])


def csv_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted cells with line breaks are one record each, if asked for."""
    path = fixture(spark, "breaks-csv", ["id,note", '1,"a', 'b"', '2,"c ""d"""', '3,"e', "", 'f, g"'])
    return Engine(spark, multi_line=True).sql(f"SELECT id, note FROM '{path}' WHERE id >= 1")


def _many_parts(rest: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that lie in several partitions, all alike, as their order isn't fixed."""
    path = scratch_path(spark, "parts") + ".parquet"
    spark.range(0, 40_000, 1, 7).selectExpr("7L AS v").write.parquet(path)
    return Engine(spark).sql(f"SELECT v FROM '{path}' {rest}")


#: Queries that are refused, and what is said.
REFUSED = {
    "SELECT missing FROM '{path}'": "Column 'missing' not found in schema",
    "SELECT ID FROM '{path}'": "Column 'ID' not found in schema",
}


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors of queries that don't fit their file."""
    path, out = fixture(spark, "nulls-csv", NULL_LINES), []
    for query in REFUSED:
        try:
            Engine(spark).sql(query.format(path=path))
            out.append((query, "none"))
        except BindError as error:
            out.append((query, str(error)))
    return spark.createDataFrame(out, "query string, error string")


def shell_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that the shell prints for a query, but for the one with the time."""
    answer = run_query(Engine(spark), f"SELECT id, b, s FROM '{fixture(spark, 'nulls-csv', NULL_LINES)}' WHERE id > 5")
    return spark.createDataFrame(list(enumerate(answer.split("\n")[:-1])), "line long, text string")


_SHELL_TABLE = ["+----+-------+------+", "| id | b     | s    |", "+====+=======+======+", "| 6  | false | null |", "| 7  | true  | d    |", "+----+-------+------+"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = "l_quantity > 30 AND l_quantity < 45 AND l_returnflag = 'R' AND NOT (l_discount > 0.05)"
    return Engine(spark).sql(f"SELECT {_LINE_COLUMNS} FROM '{sf_dir}/lineitem.parquet' WHERE {where}")


_CSV_CASES = {
    "csv_infer": ("customer", "c_custkey, c_name, c_acctbal", "WHERE c_acctbal > 5000 AND c_nationkey < 10"),
    "csv_count": ("supplier", "COUNT(*), COUNT(s_acctbal)", "WHERE s_acctbal >= 0.0"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: partial(_run, case) for name, case in CASES.items()}
    found |= {name: partial(_csv_query, *parts) for name, parts in _CSV_CASES.items()}
    found |= {name: partial(_null_query, select, where) for name, (select, where, _) in NULL_CASES.items()}
    found |= {"offset_many_parts": partial(_many_parts, "OFFSET 39000"), "limit_far_offset": partial(_many_parts, "LIMIT 300 OFFSET 25000")}
    more = (csv_bad_cells, count_nulls, count_nulls_where, project_twice, validate_headerless, validate_header, csv_line_breaks, refused, shell_table, flagship)
    return found | {f.__name__: f for f in more}


def oracle_sql() -> dict[str, str]:
    where = "l_quantity > 30 AND l_quantity < 45 AND l_returnflag = 'R' AND NOT (l_discount > 0.05)"
    nulls = {name: f"SELECT {select} FROM {_NULL_ROWS} WHERE {where}" for name, (select, _, where) in NULL_CASES.items()}
    errors = ", ".join("('{}', '{}')".format(query.replace("'", "''"), error.replace("'", "''")) for query, error in REFUSED.items())
    lines = ", ".join(f"({i}::BIGINT, '{line}')" for i, line in enumerate(_SHELL_TABLE))
    return {name: case.oracle for name, case in CASES.items()} | nulls | {
        "count_nulls": f"SELECT count(*) AS count_star, count(i) AS count_i, count(b) AS count_b, count(f) AS count_f FROM {_NULL_ROWS}",
        "count_nulls_where": f"SELECT count(f) AS count_f, count(*) AS count_star FROM {_NULL_ROWS} WHERE i IS DISTINCT FROM 2",
        "project_twice": "SELECT n_name, n_name AS n_name_again FROM nation",
        "validate_headerless": "SELECT * FROM (VALUES (0, 'column1', 'Integer'), (1, 'column2', 'Varchar'), (2, 'column3', 'Float'), (3, 'column4', 'Boolean')) t(position, name, type)",
        "validate_header": "SELECT * FROM (VALUES (0, 'id', 'Integer'), (1, 'b', 'Boolean'), (2, 'i', 'Integer'), (3, 'f', 'Float'), (4, 's', 'Varchar')) t(position, name, type)",
        "csv_line_breaks": "SELECT * FROM (VALUES (1::BIGINT, 'a' || chr(10) || 'b'), (2, 'c \"d\"'), (3, 'e' || chr(10) || chr(10) || 'f, g')) t(id, note)",
        "offset_many_parts": "SELECT 7::BIGINT AS v FROM range(1000)",
        "limit_far_offset": "SELECT 7::BIGINT AS v FROM range(300)",
        "refused": f"SELECT * FROM (VALUES {errors}) t(query, error)",
        "shell_table": f"SELECT * FROM (VALUES {lines}) t(line, text)",
        "csv_infer": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_nationkey < 10",
        "csv_count": "SELECT count(*) AS count_star, count(s_acctbal) AS count_s_acctbal FROM supplier WHERE s_acctbal >= 0.0",
        "csv_bad_cells": "SELECT CAST(score AS DOUBLE) AS score FROM (VALUES (1.5), (NULL), (NULL), (7.0)) v(score)",
        "flagship": f"SELECT {_LINE_COLUMNS} FROM lineitem WHERE {where}",
    }
