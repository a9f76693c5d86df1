"""Error patterns, their categories, and how sequences of calls recover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.errors import category, preventability
from ..functions.text import error_fingerprint, scaled_round, truncated
from ..plans.filters import RunFilters, filtered, sequence_order
from .windows import over_sessions

LOOK_AHEAD = 5
SESSIONS_SHOWN = 3
#: Parts that the sessions of a pattern are dealt to.
PARTS = 64


def patterns(runs: DataFrame, f: RunFilters | None = None, top: int | None = 20, classify: bool = False) -> DataFrame:
    """Errors by tool and fingerprint, the most frequent first.

    Sample and last-seen time are those of the last run by start and id, the
    first-seen time that of the first; runs without a start come first.
    """
    matching = filtered(runs, f)
    failed = matching.where(F.col("status") == "error").withColumn("error_content", F.coalesce("error_content", F.lit("")))
    order = ("started_at", "tool_use_id")
    # By session first, and then by salted parts of a pattern, so that none of its groups holds all of its sessions: each keeps the least SESSIONS_SHOWN.
    by_session = failed.withColumn("fingerprint", error_fingerprint(F.col("error_content"))).groupBy("tool_name", "fingerprint", "session_id").agg(
        F.count("*").alias("_n"), F.min(F.struct(*order, "error_content")).alias("_first"), F.max(F.struct(*order, "error_content")).alias("_last")
    )
    part = F.pmod(F.xxhash64("session_id"), F.lit(PARTS))
    least = by_session.withColumn("_turn", F.row_number().over(Window.partitionBy("tool_name", "fingerprint", part).orderBy("session_id")))
    shown = F.when(F.col("_turn") <= SESSIONS_SHOWN, F.col("session_id"))  # collect_list skips the NULLs
    grouped = least.groupBy("tool_name", "fingerprint").agg(
        F.sum("_n").alias("count"), F.min("_first")["started_at"].alias("first_seen"), F.max("_last")["started_at"].alias("last_seen"),
        F.max("_last")["error_content"].alias("last_error"), F.slice(F.array_sort(F.collect_list(shown)), 1, SESSIONS_SHOWN).alias("sample_sessions"),
    )
    out = grouped.withColumn("sample", truncated(F.col("last_error"), 300))
    if classify:
        tool_totals = matching.groupBy("tool_name").agg(F.count("*").alias("tool_total"))
        out = out.join(tool_totals, "tool_name", "left").withColumn("category", category(F.col("last_error")))
        out = out.withColumns({"preventability": preventability(F.col("category")), "error_rate": scaled_round(F.col("count") / F.col("tool_total") * 100, 2)})
    else:
        out = out.selectExpr("*", "cast(null as bigint) tool_total", "cast(null as string) category", "cast(null as string) preventability", "cast(null as double) error_rate")
    out = out.drop("last_error").orderBy(F.desc("count"), "tool_name", "fingerprint")
    return out if top is None else out.limit(top)


def summary(runs: DataFrame, f: RunFilters | None = None) -> DataFrame:
    """One row: all matching calls, errors among them and distinct patterns."""
    failed = F.col("status") == "error"
    key = F.when(failed, F.struct("tool_name", error_fingerprint(F.coalesce("error_content", F.lit("")))))
    return filtered(runs, f).agg(F.count("*").alias("total_tool_calls"), F.count(F.when(failed, 1)).alias("total_errors"), F.count_distinct(key).alias("pattern_count"))


def with_next(rows: DataFrame, name: str, what: Column, first: int, last: int) -> DataFrame:
    """``rows`` with the list ``name`` of what the rows ``first`` to ``last`` places on in their session have."""

    def told(some: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*sequence_order()).rowsBetween(first, last)
        return some.withColumn(name, F.collect_list(what).over(w))

    return over_sessions(rows, told, sequence_order(), ahead=last)


def recovery(runs: DataFrame, f: RunFilters | None = None) -> DataFrame:
    """By category of error: how often the same tool was tried again at once, and how often that worked.

    Of the next five runs those count that use the same tool without another one
    between; rates are shares of errors (retried) and of retried errors (recovered).
    """
    seen = with_next(filtered(runs, f), "_next", F.struct("tool_name", "status"), 1, LOOK_AHEAD)
    failed = seen.where(F.col("status") == "error")
    other = F.array_position(F.transform("_next", lambda r: r["tool_name"] == F.col("tool_name")), F.lit(False))
    retries = F.when(other == 0, F.col("_next")).otherwise(F.slice("_next", F.lit(1), (other - 1).cast("int")))
    rows = failed.select(category(F.coalesce("error_content", F.lit(""))).alias("category"), retries.alias("_retries"))
    rows = rows.select("category", F.size("_retries").alias("n"), F.exists("_retries", lambda r: r["status"] == "completed").alias("ok"))
    grouped = rows.groupBy("category").agg(
        F.count("*").alias("total"), F.count(F.when(F.col("n") > 0, 1)).alias("retried"), F.count(F.when(F.col("ok"), 1)).alias("recovered"), F.sum("n").alias("retries")
    )
    share = lambda a, b: F.when(b > 0, scaled_round(a / b * 100, 1)).otherwise(F.lit(0.0))
    return grouped.select(
        "category", "total", "retried", "recovered", share(F.col("retried"), F.col("total")).alias("retry_rate"),
        share(F.col("recovered"), F.col("retried")).alias("recovery_rate"),
        F.when(F.col("retried") > 0, scaled_round(F.col("retries") / F.col("retried"), 1)).otherwise(F.lit(0.0)).alias("avg_retries"),
    ).orderBy("category")


def retries(runs: DataFrame, f: RunFilters | None = None, min_occurrences: int = 2, top: int = 20) -> DataFrame:
    """Adjacent pairs of a failed call and another of the same tool, by tool and hint of the error."""
    hint = truncated(error_fingerprint(F.coalesce("error_content", F.lit(""))), 60)
    rows = with_next(filtered(runs, f), "_then", F.col("tool_name"), 1, 1)
    rows = rows.where((F.col("status") == "error") & (F.get("_then", F.lit(0)) == F.col("tool_name")))
    rows = rows.select(F.concat("tool_name", F.lit(" ("), hint, F.lit(") -> "), "tool_name").alias("pattern"))
    counted = rows.groupBy("pattern").agg(F.count("*").alias("count")).where(F.col("count") >= min_occurrences)
    return counted.orderBy(F.desc("count"), "pattern").limit(top)


def ngrams(runs: DataFrame, f: RunFilters | None = None, shortest: int = 2, longest: int = 4, min_occurrences: int = 2, top: int = 20) -> DataFrame:
    """Recurring contiguous sequences of tool names within sessions."""
    rows = filtered(runs, f)
    seen = with_next(rows.select("session_id", "start_ordinal", "tool_use_id", "tool_name"), "_then", F.col("tool_name"), 0, max(longest, 1) - 1)
    grams = [F.when(F.size("_then") >= n, F.slice("_then", 1, n)) for n in range(max(1, shortest), longest + 1)]
    found = seen.select(F.explode(F.array_compact(F.array(*grams))).alias("pattern"))
    if shortest <= 0:  # the empty sequence stands before each call and after the last one
        empty = rows.groupBy("session_id").count().select(F.explode(F.array_repeat(F.array().cast("array<string>"), (F.col("count") + 1).cast("int"))).alias("pattern"))
        found = found.union(empty)
    counted = found.groupBy("pattern").agg(F.count("*").alias("count")).where(F.col("count") >= min_occurrences)
    return counted.orderBy(F.desc("count"), "pattern").limit(top)
