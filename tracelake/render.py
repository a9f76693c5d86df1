"""Small results as text: JSON, or tables with aligned columns."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame


def rows_of(df: DataFrame) -> list[dict]:
    """Rows as plain dictionaries; for results that a limit or a grouping keeps small."""
    return [r.asDict(recursive=True) for r in df.collect()]


def shown(value) -> str:
    if value is None:
        return "-"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, list):
        return ", ".join(map(shown, value))
    if isinstance(value, dict):
        return ", ".join(f"{k} {shown(v)}" for k, v in sorted(value.items()))
    return str(value)


def table(rows: list[dict]) -> str:
    if not rows:
        return "(none)"
    names = list(rows[0])
    cells = [names, *([shown(r[n]).replace("\n", " ") for n in names] for r in rows)]
    widths = [max(len(c[i]) for c in cells) for i in range(len(names))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(line, widths, strict=True)).rstrip() for line in cells)


def render(result: DataFrame | Mapping[str, DataFrame], format_: str = "table") -> str:
    """JSON when asked for by name; any other format is a table."""
    parts = {k: rows_of(v) for k, v in result.items()} if isinstance(result, Mapping) else rows_of(result)
    if format_ == "json":
        return json.dumps(parts, indent=2, default=str, ensure_ascii=False)
    return "\n\n".join(f"{k}\n{table(v)}" for k, v in parts.items()) if isinstance(parts, dict) else table(parts)
