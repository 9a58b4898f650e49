import os

import pytest

from tarnframe.engine import Engine
from tarnframe.plans.ast import Count, Everything, Name
from tarnframe.plans.binder import BindError, bind
from tarnframe.plans.parser import parse
from tarnframe.plans.types import ColumnType as C
from tarnframe.plans.types import Field
from tarnframe.sources.csv import infer_fields, infer_type

FIELDS = (Field("id", C.INTEGER), Field("name", C.VARCHAR), Field("score", C.FLOAT), Field("ok", C.BOOLEAN), Field("none", C.NULL), Field("day", C.OTHER), Field("ID", C.INTEGER), Field("id", C.VARCHAR))


def bound(rest, select="id"):
    return bind(parse(f"SELECT {select} FROM t {rest}"), FIELDS)


@pytest.mark.parametrize(
    "values, kind",
    [
        (["1", "-2", "+3", "007"], C.INTEGER), (["1", "2.5"], C.FLOAT), (["1e5", ".5", "5.", "inf", "NaN", "-Infinity"], C.FLOAT), (["9223372036854775808"], C.FLOAT),
        (["true", "FALSE"], C.BOOLEAN), (["yes", "no"], C.VARCHAR), (["1", "0"], C.INTEGER), (["Alice", "3"], C.VARCHAR), (["", "null", "NULL"], C.NULL),
        (["", "4"], C.INTEGER), (["0x1F"], C.VARCHAR), (["5L"], C.VARCHAR), (["1.0d"], C.VARCHAR), ([], C.NULL), (["true", "1"], C.VARCHAR), (["2024-01-01"], C.VARCHAR),
    ],
)
def test_inference(values, kind):
    assert infer_type(values) is kind


def test_headers():
    assert infer_fields([" a , b", "1,x", "2"]) == (Field("a", C.INTEGER), Field("b", C.VARCHAR))
    assert infer_fields(['"x,y",z', '"1,2",3']) == (Field("x,y", C.VARCHAR), Field("z", C.INTEGER))
    assert [f.type for f in infer_fields(["id,name,age"])] == [C.VARCHAR] * 3
    assert infer_fields(["1,Ann,30", "2,Bob,25"], has_header=False) == (Field("column1", C.INTEGER), Field("column2", C.VARCHAR), Field("column3", C.INTEGER))
    assert infer_fields(["1,2"], has_header=False) == (Field("column1", C.VARCHAR), Field("column2", C.VARCHAR))
    with pytest.raises(BindError, match="CSV file is empty"):
        infer_fields([])


def test_only_twenty_lines_are_sampled():
    assert infer_fields(["a", *["1"] * 20, "x"])[0].type is C.INTEGER
    assert infer_fields(["a", *["1"] * 19, "x"])[0].type is C.VARCHAR


def test_names_are_exact_and_first():
    assert [n.ordinal for n in bound("", "id, ID, id").names] == [0, 6, 0]
    assert [n.ordinal for n in bound("", "*").names] == list(range(8))
    for text in ("Name", "nope"):
        with pytest.raises(BindError, match=f"Column '{text}' not found in schema"):
            bound("", text)
    with pytest.raises(BindError, match="Column 'zz' not found"):
        bound("", "COUNT(zz)")
    with pytest.raises(BindError, match="Column 'zz' not found"):
        bound("WHERE ok AND NOT zz = 1")


@pytest.mark.parametrize("text", ["id = 2.5", "score > 3", "name = 'x'", "ok = true", "id = NULL", "none = 'x'", "day = NULL", "none > 5", "id = score", "(id = 'x') = true", "id", "NOT name", "id AND ok", "NULL"])
def test_accepted(text):
    bound(f"WHERE {text}")


@pytest.mark.parametrize("text, left, right", [("id = 'x'", "Integer", "Varchar"), ("name > 5", "Varchar", "Integer"), ("ok = 1", "Boolean", "Integer"), ("score = true", "Float", "Boolean"), ("day = 'x'", "Other", "Varchar"), ("NOT (ok AND 1 = 'a')", "Integer", "Varchar"), ("day = day", "Other", "Other")])
def test_types_must_match(text, left, right):
    with pytest.raises(BindError, match=f"Cannot compare {left} and {right} - types must match"):
        bound(f"WHERE {text}")


def test_output_names():
    assert bound("", "name, COUNT(*), COUNT(id)").output_names == ["count_star", "count_id"]
    assert bound("", "name, name").output_names == ["name", "name"]


def test_validate(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("1,Ann,30\n2,Bob,25\n")
    engine = Engine(spark)
    found, fields, columns = engine.validate(str(path), False, (Everything(), Name("column2"), Count()))
    assert found == str(path) and [f.type for f in fields] == [C.INTEGER, C.VARCHAR, C.INTEGER] and len(columns) == 5
    with pytest.raises(BindError, match="types must match"):
        engine.validate(str(path), False, (Everything(),), parse("SELECT a FROM t WHERE column1 = 'x'").where)


def test_paths(spark, tmp_path, monkeypatch):
    (tmp_path / "users").write_text("a\n1\n2\n")
    monkeypatch.chdir(tmp_path)
    assert Engine(spark).sql("SELECT a FROM users").count() == 2
    with pytest.raises(BindError, match=f"File not found: {os.path.join(tmp_path, 'gone.csv')}"):
        Engine(spark).sql("SELECT a FROM 'gone.csv'")
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(BindError, match="CSV file is empty"):
        Engine(spark).sql("SELECT a FROM 'empty.csv'")
