"""A contract check as a Markdown report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from keystrata.functions.values import contract
from keystrata.sources.schema import TableSchema


def schema_problems(frame: DataFrame, schema: TableSchema) -> list[str]:
    """How a frame's columns differ from a schema's in number, order, name or type."""
    given, want = frame.schema.fields, schema.fields
    out = [] if len(given) == len(want) else [f"{len(given)} columns instead of {len(want)}"]
    for i, (g, w) in enumerate(zip(given, want, strict=False)):
        if g.name != w.name:
            out.append(f"column {i} is {g.name}, not {w.name}")
        elif type(g.dataType) is not type(w.data_type):
            out.append(f"{g.name} is {g.dataType.simpleString()}, not {w.data_type.simpleString()}")
    return out


def markdown(name: str, frame: DataFrame, schema: TableSchema, rules: dict[str, Column]) -> tuple[bool, str]:
    """Whether the frame keeps its contract, and the report; one pass over the rows."""
    problems = schema_problems(frame, schema)
    lines = [f"# {name}", "", "| check | result |", "|-|-|", f"| columns | {'; '.join(problems) or 'ok'} |"]
    good = not problems
    if good:
        counts = contract(frame, schema.key, rules).first().asDict()
        rows = counts.pop("rows")
        counts.pop("distinct_keys")
        lines.append(f"| rows | {rows} |")
        for what, n in counts.items():
            lines.append(f"| {what} | {'ok' if n == 0 else n} |")
            good = good and n == 0
    lines += ["", f"Result: {'PASS' if good else 'FAIL'}", ""]
    return good, "\n".join(lines)
