import shutil

import pytest

from tarnframe import repl
from tarnframe.engine import Engine, duration
from tarnframe.streaming import over_stream


@pytest.fixture
def sql(spark, tmp_path):
    """Run a query whose file is given as text under the name ``t``."""

    def run(text, query):
        path = tmp_path / "t.csv"
        path.write_text(text)
        return Engine(spark).sql(query.replace(" FROM t", f" FROM '{path}'"))

    return run


def rows(df):
    return [tuple(r) for r in df.collect()]


PEOPLE = "id,name,age\n1,Alice,30\n2,Bob,25\n3,Charlie,35\n4,Diana,28\n"
TYPED = "id,name,salary,active\n1,Alice,50000.5,true\n2,Bob,60000.25,false\n"
NULLS = "id,name,age\n1,A,30\n2,B,\n3,C,35\n4,D,\n5,E,28\n"


@pytest.mark.parametrize(
    "query, expected",
    [
        ("SELECT * FROM t WHERE age > 28", [(1, "Alice", 30), (3, "Charlie", 35)]),
        ("SELECT name FROM t", [("Alice",), ("Bob",), ("Charlie",), ("Diana",)]),
        ("SELECT age, id FROM t WHERE name = 'Bob'", [(25, 2)]),
        ("SELECT id FROM t WHERE name >= 'C'", [(3,), (4,)]),
        ("SELECT id, id FROM t LIMIT 1", [(1, 1)]),
        ("SELECT id FROM t WHERE age > 25 AND age < 35", [(1,), (4,)]),
        ("SELECT id FROM t WHERE age = 25 OR name = 'Diana'", [(2,), (4,)]),
        ("SELECT id FROM t WHERE NOT (age > 28)", [(2,), (4,)]),
        ("SELECT id FROM t WHERE age >= 27.5 AND age <= 30.0", [(1,), (4,)]),
        ("SELECT id FROM t LIMIT 2 OFFSET 1", [(2,), (3,)]),
        ("SELECT id FROM t OFFSET 3", [(4,)]),
        ("SELECT id FROM t LIMIT 0", []),
        ("SELECT id FROM t LIMIT 10 OFFSET 10", []),
        ("SELECT id FROM t WHERE age > 25 LIMIT 1 OFFSET 1", [(3,)]),
        ("SELECT COUNT(*) FROM t", [(4,)]),
        ("SELECT COUNT(*), COUNT(age) FROM t WHERE age > 100", [(0, 0)]),
        ("SELECT name, COUNT(*) FROM t", [(4,)]),
        ("SELECT COUNT(*) FROM t LIMIT 0", []),
        ("SELECT COUNT(*) FROM t OFFSET 1", []),
        ("SELECT id FROM t WHERE 1 = 1 AND age = 25", [(2,)]),
        ("SELECT id FROM t WHERE 'a' = 'b'", []),
    ],
)
def test_queries(sql, query, expected):
    assert rows(sql(PEOPLE, query)) == expected


def test_types(sql):
    df = sql(TYPED, "SELECT * FROM t WHERE active = true")
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("salary", "double"), ("active", "boolean")] and rows(df) == [(1, "Alice", 50000.5, True)]
    assert rows(sql(TYPED, "SELECT id FROM t WHERE active")) == [(1,)]
    assert rows(sql(TYPED, "SELECT id FROM t WHERE salary > 55000")) == [(2,)]


def test_counts_of_nulls(sql):
    assert rows(sql(NULLS, "SELECT COUNT(age) FROM t")) == [(3,)]
    assert rows(sql(NULLS, "SELECT COUNT(age), COUNT(*) FROM t WHERE id = 2 OR id = 4")) == [(0, 2)]
    assert rows(sql("id,age\n1,\n2,null\n", "SELECT COUNT(age) FROM t")) == [(0,)]
    assert rows(sql("id,name,age\n", "SELECT COUNT(*) FROM t")) == [(0,)]
    assert sql(NULLS, "SELECT COUNT(*), COUNT(age) FROM t").columns == ["count_star", "count_age"]


def test_null_comparisons(sql):
    assert rows(sql(NULLS, "SELECT id FROM t WHERE age = NULL")) == [(2,), (4,)]
    assert rows(sql(NULLS, "SELECT id FROM t WHERE age != NULL")) == [(1,), (3,), (5,)]
    assert rows(sql(NULLS, "SELECT id FROM t WHERE age != 30")) == [(2,), (3,), (4,), (5,)]
    assert rows(sql(NULLS, "SELECT id FROM t WHERE NOT (age > 29)")) == [(2,), (4,), (5,)]


def test_cells_past_the_sample(sql):
    text = "v\n" + "\n".join(map(str, range(20))) + "\nx\n3.5\n\n  \nnull\n 77 \n+5\n99999999999999999999\n"
    assert [r[0] for r in rows(sql(text, "SELECT v FROM t OFFSET 20"))] == [None, None, None, 77, 5, None]
    late = "a,b\n" + "1,\n" * 20 + "2,9\n"
    assert rows(sql(late, "SELECT b FROM t WHERE a = 2")) == [(None,)]


def test_text_null_stays_text(sql):
    assert rows(sql("a,b\nx,1\nnull,2\nNULL,3\n,4\n", "SELECT a FROM t")) == [("x",), ("null",), ("NULL",), (None,)]


def test_ragged_and_quoted(sql):
    assert rows(sql("a,b\n1\n2,x,extra\n\n3,y\n", "SELECT * FROM t")) == [(1, None), (2, "x"), (3, "y")]
    assert rows(sql('n,"k,1"\n"a,b",1\n"say ""hi""",2\n', "SELECT n FROM t")) == [("a,b",), ('say "hi"',)]


def test_duplicate_headers(sql):
    df = sql("a,A,a\n1,2,3\n", "SELECT * FROM t")
    assert df.columns == ["a", "A", "a"] and rows(df) == [(1, 2, 3)]
    assert rows(sql("a,A,a\n1,2,3\n", "SELECT A, a FROM t")) == [(2, 1)]


def test_nan(sql):
    text = "f,g\n1.5,1.5\nNaN,NaN\ninf,2.5\n"
    assert rows(sql(text, "SELECT COUNT(*) FROM t WHERE f = g")) == [(1,)]
    assert rows(sql(text, "SELECT COUNT(*) FROM t WHERE f != g")) == [(2,)]
    assert rows(sql(text, "SELECT COUNT(*) FROM t WHERE f > 2.0")) == [(1,)]
    assert rows(sql(text, "SELECT COUNT(*) FROM t WHERE NOT (f > 2.0)")) == [(2,)]


def test_many_rows(sql):
    text = "id,value\n" + "".join(f"{i},{2 * i}\n" for i in range(10_000))
    assert rows(sql(text, "SELECT COUNT(*), COUNT(value) FROM t WHERE value >= 10000")) == [(5000, 5000)]
    assert rows(sql(text, "SELECT id FROM t WHERE id > 9996 LIMIT 3")) == [(9997,), (9998,), (9999,)]


def test_files_in_several_splits(spark, sql):
    text = "id,value\n" + "".join(f"{i},{'x' * (i % 50)}\n" for i in range(20_000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        df = sql(text, "SELECT id FROM t")
        assert df.rdd.getNumPartitions() > 4 and sorted(r[0] for r in rows(df)) == list(range(20_000))
        for n in (1, 9_000, 19_999, 20_000, 30_000):
            assert sorted(r[0] for r in rows(sql(text, f"SELECT id FROM t OFFSET {n}"))) == list(range(n, 20_000))
        skipped = sql(text, "SELECT id FROM t WHERE id > 4999 OFFSET 100")
        assert sorted(r[0] for r in rows(skipped)) == list(range(5100, 20_000)) and skipped.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_parquet_pruning_and_pushdown(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(100).selectExpr("id", "id * 1.5D AS x", "cast(id AS string) AS s", "timestamp_seconds(id) AS day").write.parquet(path)
    engine = Engine(spark)
    plan = engine.sql(f"SELECT s FROM '{path}' WHERE x > 30.0 AND id = 40")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,x:double,s:string>" in plan and "GreaterThan(x,30.0)" in plan and "EqualTo(id,40)" in plan
    assert "Python" not in plan
    assert rows(engine.sql(f"SELECT s FROM '{path}' WHERE x > 30.0 AND id = 40")) == [("40",)]
    assert rows(engine.sql(f"SELECT COUNT(day) FROM '{path}' WHERE day != NULL")) == [(100,)]


def test_explain_and_breakdown(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text(PEOPLE)
    query = f"SELECT name FROM '{path}' WHERE 1 = 1 AND NOT NOT (age > 26) LIMIT 2"
    text = Engine(spark).explain(query)
    assert "Filter ((1 = 1) AND (NOT (NOT (age > 26))))" in text and "Filter (age > 26)" in text and "Physical Plan" in text
    out = Engine(spark).breakdown(query)
    assert list(out.seconds) == ["parse", "bind", "build", "plan", "execute"] and out.rows == [("Alice",), ("Charlie",)] and "execute" in str(out)
    assert [duration(s) for s in (5e-5, 0.0123, 2.5)] == ["50µs", "12.30ms", "2.50s"]


def test_shell(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("a,b\n1,\n2,true\n")
    engine = Engine(spark)
    shown = repl.handle(engine, f" SELECT * FROM '{path}' ")
    assert "| 1 | NULL |" in shown and "| 2 | true |" in shown and "(2 rows in" in shown
    assert "(1 row in" in repl.handle(engine, f"SELECT a FROM '{path}' LIMIT 1 OFFSET 1")
    assert repl.handle(engine, ".exit") is None and repl.handle(engine, ".quit") is None
    assert ".help" in repl.handle(engine, ".help") and "Unknown command" in repl.handle(engine, ".x") and repl.handle(engine, " ") == ""
    assert repl.handle(engine, "SELECT").startswith("Error: Parse error") and "File not found" in repl.handle(engine, "SELECT a FROM 'gone'")


def test_over_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(50).selectExpr("id", "id % 3 AS k").write.parquet(folder)
    stream = spark.readStream.schema("id long, k long").parquet(folder)
    out = over_stream("SELECT id FROM events WHERE k = 1 AND id > 10", stream)
    started = out.writeStream.format("memory").queryName("over_stream").start()
    started.processAllAvailable()
    started.stop()
    assert sorted(r[0] for r in spark.sql("SELECT * FROM over_stream").collect()) == [i for i in range(11, 50) if i % 3 == 1]


def test_or_reaches_the_reader(spark):
    from tarnframe.catalogue import CASES, statement

    for name, pushed in (("filter_or", "Or(GreaterThan("), ("filter_nested", "Or(GreaterThan(")):
        plan = Engine(spark).sql(statement(CASES[name], "/root/testdata/sf0.001/lineitem.parquet"))._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan.split("PushedFilters")[1].replace("And(", ""), plan


def test_far_offsets_leave_rows_where_they_are(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(0, 60_000, 1, 6).write.parquet(path)
    found = Engine(spark).sql(f"SELECT id FROM '{path}' LIMIT 5 OFFSET 50000")
    assert "Limit 50005" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 5
    whole = [r[0] for r in spark.read.parquet(path).collect()]
    assert [r[0] for r in found.collect()] == whole[50_000:50_005]
    assert Engine(spark).sql(f"SELECT id FROM '{path}' LIMIT 5 OFFSET 70000").collect() == []


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,note\n1,"a\nb"\n2,c\n3,"d\n\ne, f"\n')
    assert rows(Engine(spark, multi_line=True).sql(f"SELECT COUNT(*) FROM '{path}'")) == [(3,)]
    assert rows(Engine(spark, multi_line=True).sql(f"SELECT id, note FROM '{path}'")) == [(1, "a\nb"), (2, "c"), (3, "d\n\ne, f")]


def test_limits_take_the_first_rows_of_the_files_by_name(spark, tmp_path):
    path, ends = tmp_path / "t.parquet", [0, 20_000, 80_000, 100_000, 300_000, 310_000]
    path.mkdir()
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        spark.range(a, b).coalesce(1).write.parquet(f"{tmp_path}/part")
        next((tmp_path / "part").glob("*.parquet")).rename(path / f"{k}.parquet")
        shutil.rmtree(tmp_path / "part")

    def found(rest):
        query = Engine(spark).sql(f"SELECT id FROM '{path}' {rest}")
        query.write.mode("overwrite").parquet(f"{tmp_path}/out")
        kept = sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").collect())
        assert kept == sorted(r[0] for r in query.collect())
        return kept

    assert found("LIMIT 1000") == list(range(1000))
    assert found("LIMIT 70 OFFSET 150") == list(range(150, 220))
    assert found("WHERE id >= 19990 LIMIT 30 OFFSET 5") == list(range(19_995, 20_025))
    assert found("WHERE id >= 299990 LIMIT 30") == list(range(299_990, 300_020))
    assert found("LIMIT 85000") == list(range(85_000))
    assert found("LIMIT 400000") == list(range(310_000))
    assert found("OFFSET 299995") == list(range(299_995, 310_000))
    assert found("WHERE id < 5 LIMIT 10 OFFSET 5") == [] == found("OFFSET 310000")


def test_limits_of_one_file_of_many_splits(spark, sql):
    text, size = "id\n" + "".join(f"{i}\n" for i in range(60_000)), "spark.sql.files.maxPartitionBytes"
    spark.conf.set(size, "20000")
    try:
        for rest, expected in (("LIMIT 9000", range(9000)), ("WHERE id > 30000 LIMIT 50 OFFSET 3", range(30_004, 30_054)), ("LIMIT 25000", range(25_000)), ("OFFSET 59000", range(59_000, 60_000))):
            assert sorted(r[0] for r in rows(sql(text, f"SELECT id FROM t {rest}"))) == list(expected)
    finally:
        spark.conf.unset(size)
