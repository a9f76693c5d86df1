"""Filters on runs as one conjunctive predicate, which Catalyst pushes to the scan where it can."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RunFilters:
    """Optional predicates; ``limit`` applies to searches only."""

    project: str | None = None
    worktree: str | None = None
    session: str | None = None
    tool: str | None = None
    command_contains: str | None = None
    error_contains: str | None = None
    file_path: str | None = None
    min_duration: int | None = None
    max_duration: int | None = None
    min_read_lines: int | None = None
    status: str | None = None
    since: str | None = None
    limit: int | None = field(default=None, compare=False)


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def of_session(session: str) -> Column:
    """Runs of a session by its own, its external or its parent's id."""
    return (F.col("session_id") == session) | (F.col("external_session_id") == session) | (F.col("parent_session_id") == session)


def predicate(f: RunFilters) -> Column | None:
    """All given predicates together, or None; to be used as a filter, where what is unknown fails.

    A missing duration counts as 0; missing texts and line counts fail; ``since``
    compares the text of the start, which is empty where there is none.  Columns
    are compared bare, so that a scan of Parquet files takes the comparisons.
    """
    parts: list[Column] = []
    for name, column in (("project", "project_alias"), ("worktree", "worktree_name"), ("tool", "tool_name"), ("status", "status")):
        if (value := getattr(f, name)) is not None:
            parts.append(F.col(column) == value)
    if f.session is not None:
        parts.append(of_session(f.session))
    for name, column in (("command_contains", "command"), ("error_contains", "error_content")):
        if (value := getattr(f, name)) is not None:
            parts.append(F.col(column).contains(value))
    if f.file_path is not None:
        in_paths = F.exists("file_paths", lambda p: p.contains(f.file_path))
        parts.append(in_paths | F.col("command").contains(f.file_path) | F.col("input_summary").contains(f.file_path))
    duration = F.col("duration_ms")
    if f.min_duration is not None:
        long_enough = duration >= f.min_duration
        parts.append(long_enough if f.min_duration > 0 else long_enough | duration.isNull())
    if f.max_duration is not None:
        short_enough = duration <= f.max_duration
        parts.append(short_enough if f.max_duration < 0 else short_enough | duration.isNull())
    if f.min_read_lines is not None:
        parts.append(F.col("read_lines") >= f.min_read_lines)
    if f.since:
        parts.append(F.col("started_at") >= f.since)
    return reduce(lambda a, b: a & b, parts) if parts else None


def filtered(runs: DataFrame, f: RunFilters | None) -> DataFrame:
    condition = predicate(f) if f else None
    return runs if condition is None else runs.where(condition)


def stored_order() -> list[Column]:
    """By start (none first), ordinal (none first) and id."""
    return [F.coalesce("started_at", F.lit("")).asc(), F.col("start_ordinal").asc_nulls_first(), F.col("tool_use_id").asc()]


def sequence_order() -> list[Column]:
    """By ordinal (none last) and id."""
    return [F.col("start_ordinal").asc_nulls_last(), F.col("tool_use_id").asc()]
