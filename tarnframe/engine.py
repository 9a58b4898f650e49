"""The engine: SQL text in, a lazy DataFrame out."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import operators
from .plans.ast import Expression, Item, Query
from .plans.binder import Bound, bind, bind_items, check
from .plans.explain import plan_text
from .plans.parser import parse
from .plans.types import Field
from .sources import Relation


@dataclass
class Breakdown:
    """Seconds of each phase of a query, its plans and its rows."""

    seconds: dict[str, float] = field(default_factory=dict)
    schema: tuple[Field, ...] = ()
    before: str = ""
    after: str = ""
    physical: str = ""
    columns: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)

    def __str__(self) -> str:
        lines = [f"{phase}: {duration(s)}" for phase, s in self.seconds.items()]
        lines += ["", "schema: " + ", ".join(f"{f.name} {f.type.value}" for f in self.schema)]
        lines += ["", "plan:", self.before, "", "folded plan:", self.after, "", "physical plan:", self.physical, f"{len(self.rows)} rows"]
        return "\n".join(lines)


def duration(seconds: float) -> str:
    """A time in the unit that suits it."""
    if seconds < 1e-3:
        return f"{seconds * 1e6:.0f}µs"
    return f"{seconds * 1e3:.2f}ms" if seconds < 1 else f"{seconds:.2f}s"


class Engine:
    """Queries over single files, on a Spark session that stays the caller's.

    ``multi_line``: quoted CSV cells may hold line breaks; such files aren't split over tasks.
    """

    def __init__(self, spark: SparkSession, multi_line: bool = False) -> None:
        self.spark = spark
        self.multi_line = multi_line

    def parse(self, sql: str) -> Query:
        return parse(sql)

    def bind(self, query: Query) -> tuple[Relation, Bound]:
        relation = operators.scan(self.spark, query.file, multi_line=self.multi_line)
        return relation, bind(query, relation.fields)

    def sql(self, sql: str) -> DataFrame:
        """The query's result.

        Nothing but the first lines of a CSV file is read yet, with two exceptions: a LIMIT
        over several files finds out how many of the first ones have its rows, and an OFFSET
        without a LIMIT, or either past ``operators.FEW_ROWS``, counts the rows of each split.
        """
        return operators.build(*self.bind(self.parse(sql)))

    def validate(self, file: str, has_header: bool, items: tuple[Item, ...], where: Expression | None = None) -> tuple[str, tuple[Field, ...], list]:
        """(path, schema, selected columns) if the parts of a query fit the file, without running anything."""
        relation = operators.scan(self.spark, file, has_header, self.multi_line)
        chosen = bind_items(items, relation.fields)
        if where is not None:
            check(where, relation.fields)
        return relation.path, relation.fields, chosen

    def explain(self, sql: str) -> str:
        """The bound plan, the folded plan, and Spark's plans."""
        relation, bound = self.bind(self.parse(sql))
        plans = operators.build(relation, bound)._jdf.queryExecution().toString()
        return f"{plan_text(bound)}\n\n{plan_text(bound, folded=True)}\n\n{plans}"

    def breakdown(self, sql: str) -> Breakdown:
        """Run a query, timing each phase."""
        out, began = Breakdown(), time.perf_counter()

        def lap(phase: str) -> None:
            nonlocal began
            now = time.perf_counter()
            out.seconds[phase] = now - began
            began = now

        query = self.parse(sql)
        lap("parse")
        relation, bound = self.bind(query)
        lap("bind")
        out.schema, out.before, out.after = bound.fields, plan_text(bound), plan_text(bound, folded=True)
        rows = operators.build(relation, bound)
        lap("build")
        out.physical = rows._jdf.queryExecution().executedPlan().toString()
        lap("plan")
        out.columns, out.rows = rows.columns, [tuple(r) for r in rows.collect()]
        lap("execute")
        return out
