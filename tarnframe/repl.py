"""An interactive shell: ``python -m tarnframe.repl``."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession

from .engine import Engine, duration
from .plans.binder import BindError
from .plans.parser import ParseError

PROMPT = "tarnframe> "
HELP = """\
.help          show this text
.exit, .quit   leave (so does Ctrl-D)
SELECT … FROM 'file' [WHERE …] [LIMIT n] [OFFSET m]   run a query; Ctrl-C stops it"""


def format_cell(value: object) -> str:
    if value is None:
        return "NULL"
    return str(value).lower() if isinstance(value, bool) else str(value)


def format_table(columns: list[str], rows: list[tuple]) -> str:
    """Rows in a frame of ASCII signs."""
    body = [[format_cell(v) for v in row] for row in rows]
    widths = [max([len(c), *(len(row[i]) for row in body)]) for i, c in enumerate(columns)]

    def line(cells: list[str]) -> str:
        return "| " + " | ".join(c.ljust(w) for c, w in zip(cells, widths)) + " |"

    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    return "\n".join([rule, line(columns), rule.replace("-", "="), *map(line, body), rule])


def run_query(engine: Engine, sql: str) -> str:
    """What the shell prints for a query."""
    began = time.perf_counter()
    try:
        result = engine.sql(sql)
        rows = [tuple(r) for r in result.collect()]
    except (ParseError, BindError) as error:
        return f"Error: {error}"
    table = format_table(result.columns, rows)
    return f"{table}\n({len(rows)} row{'s' * (len(rows) != 1)} in {duration(time.perf_counter() - began)})"


def handle(engine: Engine, line: str) -> str | None:
    """The answer to one line of input; None ends the shell."""
    line = line.strip()
    if line in (".exit", ".quit"):
        return None
    if line == ".help":
        return HELP
    if line.startswith("."):
        return f"Unknown command: {line} (.help lists all)"
    return run_query(engine, line) if line else ""


def main() -> None:
    try:
        import readline  # noqa: F401  line editing and history
    except ImportError:
        pass
    spark = SparkSession.builder.appName("tarnframe").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    engine = Engine(spark)
    print("Ctrl-D leaves, .help lists the commands")
    while True:
        try:
            answer = handle(engine, input(PROMPT))
        except EOFError:
            break
        except KeyboardInterrupt:
            spark.sparkContext.cancelAllJobs()
            print()
            continue
        if answer is None:
            break
        if answer:
            print(answer)
    spark.stop()


if __name__ == "__main__":
    main()
