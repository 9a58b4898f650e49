"""Bound plans as text."""

from __future__ import annotations

from .ast import Literal, text_of
from .binder import Bound
from .fold import fold


def plan_text(bound: Bound, folded: bool = False) -> str:
    """One line for each operator, outermost first."""
    query, lines = bound.query, []
    where = query.where if query.where is None or not folded else fold(query.where)
    if query.limit is not None or query.offset is not None:
        lines.append(f"Limit limit={query.limit} offset={query.offset}")
    if bound.counts:
        lines.append("Aggregate " + ", ".join(f"COUNT({c.name or '*'})" for c in bound.counts))
    else:
        lines.append("Projection " + ", ".join(f"{n.name}#{n.ordinal}" for n in bound.names))
    if where is not None and not (folded and isinstance(where, Literal) and where.value is True):
        lines.append(f"Filter {text_of(where)}")
    lines.append(f"Get {query.file} [" + ", ".join(f"{f.name}:{f.type.value}" for f in bound.fields) + "]")
    return "\n".join("  " * depth + line for depth, line in enumerate(lines))
