"""Search, session groups, inspection, comparison and aggregation of tool runs."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import error_fingerprint, scaled_round, truncated
from ..plans.filters import RunFilters, filtered, holds, sequence_order, stored_order
from .windows import over_sessions

TOP_ERRORS = 10


def search(runs: DataFrame, f: RunFilters | None = None) -> DataFrame:
    """Matching runs in stored order, the first ``limit`` of them."""
    out = filtered(runs, f).orderBy(*stored_order())
    return out if f is None or f.limit is None else out.limit(f.limit)


def session_groups(runs: DataFrame, f: RunFilters | None = None) -> DataFrame:
    """Matches by session, in the sessions' order: how many, the range of ordinals and the ids in sequence."""
    seq = F.struct(F.col("start_ordinal").isNull().alias("none"), "start_ordinal", "tool_use_id", "external_session_id", "project_alias", "worktree_name")
    low, high = F.min(F.least("start_ordinal", "end_ordinal")), F.max(F.greatest("start_ordinal", "end_ordinal"))  # they skip NULLs
    grouped = filtered(runs, f).groupBy("session_id").agg(
        F.count("*").alias("matches"), low.alias("low"), high.alias("high"), F.array_sort(F.collect_list(seq)).alias("seq")
    )
    return grouped.select(
        "session_id", F.col("seq")[0]["external_session_id"].alias("external_session_id"), F.col("seq")[0]["project_alias"].alias("project_alias"),
        F.col("seq")[0]["worktree_name"].alias("worktree_name"), "matches",
        F.coalesce(F.concat("low", F.lit("-"), "high"), F.lit("n/a")).alias("ordinal_range"),
        F.transform("seq", lambda s: s["tool_use_id"]).alias("tool_use_ids"),
    ).orderBy("session_id")


def runs_of_session(runs: DataFrame, session_id: str, is_subagent: bool = False) -> DataFrame:
    """Runs of a session and, unless it is a subagent itself, of its subagents."""
    own = F.col("session_id") == session_id
    return runs.where(own if is_subagent else own | (F.col("parent_session_id") == session_id))


def inspect(
    runs: DataFrame, session_id: str, is_subagent: bool = False, tool_use_id: str | None = None, status: str | None = None, context: int | None = None
) -> DataFrame:
    """Runs of a session in sequence; by tool id or status with ``context`` runs on both sides of each hit.

    A tool id overrides a status.
    """
    own = runs_of_session(runs, session_id, is_subagent)
    if tool_use_id is not None:
        hit, context = F.col("tool_use_id") == tool_use_id, context or 0
    elif status is not None:
        hit = F.col("status") == status
    else:
        return own.orderBy(*sequence_order())
    if not context:
        return own.where(hit).orderBy(*sequence_order())
    return near_hits(own.withColumn("_all", F.lit(session_id)), hit, context, "_all").drop("_all").orderBy(*sequence_order())


def context_windows(runs: DataFrame, hit: Column, context: int) -> DataFrame:
    """Runs within ``context`` places of a hit, in every session at once."""
    return near_hits(runs, holds(hit), context, "session_id")


def near_hits(runs: DataFrame, hit: Column, context: int, key: str) -> DataFrame:
    """Runs within ``context`` places of a hit with the same ``key``."""

    def told(some: DataFrame, keys: list[str]) -> DataFrame:
        around = Window.partitionBy(*keys).orderBy(*sequence_order()).rowsBetween(-context, context)
        return some.withColumn("_near", F.max(hit.cast("int")).over(around))

    return over_sessions(runs, told, sequence_order(), context, context, key).where(F.col("_near") == 1).drop("_near")


def context_messages(messages: DataFrame, runs: DataFrame) -> DataFrame:
    """Messages from one before the first to the last ordinal of the runs of each session.

    The ranges, one for each session, are joined on the session's id.
    """
    spans = runs.groupBy("session_id").agg(
        F.coalesce(F.min("start_ordinal") - 1, F.lit(0)).alias("low"), F.max(F.greatest("start_ordinal", "end_ordinal")).alias("high")
    )
    spans = spans.select("session_id", "low", F.coalesce("high", "low").alias("high"))
    inside = messages.join(spans, "session_id").where(F.col("ordinal").between(F.col("low"), F.col("high")))
    return inside.select("session_id", "ordinal", "record_type", "role", "timestamp", truncated(F.col("search_text"), 240).alias("snippet")).orderBy("session_id", "ordinal")


def cohort(ids: Iterable[str]) -> Column:
    """Runs of any of the sessions, by own, external or parent id."""
    ids = list(ids)
    return F.col("session_id").isin(ids) | F.col("external_session_id").isin(ids) | holds(F.col("parent_session_id").isin(ids))


GROUP_KEYS = {"tool_name": "tool_name", "status": "status", "project": "project_alias", "project_alias": "project_alias", "worktree": "worktree_name", "worktree_name": "worktree_name", "agent_id": "agent_id"}


def group_value(key: str) -> Column:
    return F.coalesce(GROUP_KEYS[key], F.lit("")) if key in GROUP_KEYS else F.lit(f"unsupported:{key}")


def compare(runs: DataFrame, left: Iterable[str], right: Iterable[str], key: str = "tool_name", f: RunFilters | None = None) -> DataFrame:
    """Count and truncated mean duration by key of two cohorts; a run may be in both."""
    sides = F.array_compact(F.array(F.when(cohort(left), "left"), F.when(cohort(right), "right")))
    rows = filtered(runs, f).select(F.explode(sides).alias("side"), group_value(key).alias("key"), "duration_ms")
    mean = F.expr("sum(duration_ms) div nullif(count(duration_ms), 0)")
    return rows.groupBy("side", "key").agg(F.count("*").alias("count"), mean.alias("avg_duration_ms")).orderBy("side", "key")


#: Different durations that one task ranks, at most (17 minutes of milliseconds).
CHUNK = 1 << 20
PERCENTILES = {"p50_duration_ms": 0.5, "p95_duration_ms": 0.95}
#: Estimated bytes of (keys, duration) up to which all durations of a group may meet in one task.
LIGHT = 64 << 20


def light(rows: DataFrame) -> bool:
    """Whether Spark's estimate of ``rows``, that by which it also chooses broadcasts, is LIGHT at most."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= LIGHT


def percentile(column: str, share: float) -> Column:
    """Nearest rank among the values there are."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})").cast("long")


def counted_groups(rows: DataFrame, names: list[str]) -> DataFrame:
    """``count``, ``errors`` and nearest ranks of ``duration_ms`` by group, ranks by counting.

    Rows are counted by group and duration, and durations are dealt to chunks.
    Sizes of chunks tell in which one a rank lies, and only these are ranked
    duration by duration: no task holds all durations of a group.  Both steps
    read the same counts (so ``error`` is a key, and keys are compared as they
    are, NULL or not), which are shuffled once.
    """
    counts = rows.groupBy(*names, "error", "duration_ms").agg(F.count("*").alias("n")).withColumn("_chunk", F.floor(F.col("duration_ms") / CHUNK))
    sizes = counts.groupBy(*names, "_chunk").agg(F.sum("n").alias("_n"), F.sum(F.when(F.col("error"), F.col("n")).otherwise(0)).alias("_failed"))
    timed = F.when(F.col("_chunk").isNotNull(), F.col("_n")).otherwise(0)
    group = Window.partitionBy(*names)
    sizes = sizes.withColumns(
        {
            "_until": F.sum(timed).over(group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)),
            "_timed": F.sum(timed).over(group), "count": F.sum("_n").over(group), "errors": F.sum("_failed").over(group),
        }
    )
    rank = lambda share: F.greatest(F.ceil(F.col("_timed") * share), F.lit(1))
    ranks = [F.struct(F.lit(name).alias("name"), rank(share).alias("rank")) for name, share in PERCENTILES.items()]
    places = sizes.withColumn("_at", F.explode(F.array(*ranks))).withColumn("_rank", F.col("_at.rank") - F.col("_until") + F.col("_n"))
    # The chunk of a rank, or that of rows without a duration where there are no others.
    places = places.where(F.when(F.col("_chunk").isNotNull(), F.col("_rank").between(1, F.col("_n"))).otherwise(F.col("_timed") == 0))
    places = places.select(*[F.col(c).alias(f"_p{c}") for c in (*names, "_chunk")], "count", "errors", F.col("_at.name").alias("_name"), "_rank")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_p{c}")) for c in (*names, "_chunk")])
    inside = Window.partitionBy(*names, "_chunk", "_name").orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(places, same).withColumn("_seen", F.sum("n").over(inside))
    reached = lambda name: F.min(F.when((F.col("_name") == name) & (F.col("_seen") >= F.col("_rank")), F.col("duration_ms")))
    return ranked.groupBy(*names).agg(F.first("count").alias("count"), F.first("errors").alias("errors"), *[reached(name).alias(name) for name in PERCENTILES])


def aggregate_groups(runs: DataFrame, keys: Iterable[str] = ("tool_name",), f: RunFilters | None = None) -> DataFrame:
    """Counts, errors and duration percentiles by group, the largest first; keys in the order of their names.

    Few rows are aggregated in one step; of many no task holds all durations of a group.
    """
    names = sorted(set(keys))
    rows = filtered(runs, f).select(*[group_value(k).alias(k) for k in names], (F.col("status") == "error").alias("error"), "duration_ms")
    share = scaled_round(F.col("errors") / F.col("count") * 100, 1)
    if light(rows):
        failed = F.count(F.when(F.col("error"), 1))
        groups = rows.groupBy(*names).agg(F.count("*").alias("count"), failed.alias("errors"), *[percentile("duration_ms", s).alias(name) for name, s in PERCENTILES.items()])
    else:
        groups = counted_groups(rows, names)
    out = groups.withColumns({"error_pct": share, "avg_duration_ms": F.col("p50_duration_ms")})
    columns = [*names, "count", "errors", "error_pct", *PERCENTILES, "avg_duration_ms"]
    return out.select(*columns).orderBy(F.desc("count"), *names)


def top_errors(runs: DataFrame, f: RunFilters | None = None, top: int = TOP_ERRORS) -> DataFrame:
    """The most frequent error fingerprints; tool and sample are those of the first run in stored order."""
    failed = filtered(runs, f).where(F.col("status") == "error").withColumn("error_content", F.coalesce("error_content", F.lit("")))
    order = F.struct(F.coalesce("started_at", F.lit("")).alias("s"), "start_ordinal", "tool_use_id", "session_id")
    rows = failed.select(error_fingerprint(F.col("error_content")).alias("fingerprint"), order.alias("o"), F.struct("tool_name", "error_content").alias("v"))
    out = rows.groupBy("fingerprint").agg(F.count("*").alias("count"), F.min_by("v", "o").alias("v"))
    out = out.select("fingerprint", "count", F.col("v.tool_name").alias("tool_name"), truncated(F.col("v.error_content"), 200).alias("sample"))
    return out.orderBy(F.desc("count"), "tool_name", "fingerprint").limit(top)


def totals(runs: DataFrame, f: RunFilters | None = None) -> DataFrame:
    """One row: runs and distinct sessions that match."""
    return filtered(runs, f).agg(F.count("*").alias("total"), F.count_distinct("session_id").alias("session_count"))


def aggregate(runs: DataFrame, keys: Iterable[str] = ("tool_name",), f: RunFilters | None = None) -> dict[str, DataFrame]:
    return {"groups": aggregate_groups(runs, keys, f), "top_errors": top_errors(runs, f), "totals": totals(runs, f)}
