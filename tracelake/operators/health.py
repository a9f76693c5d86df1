"""Token and cache health of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import instant
from .windows import over_sessions

#: Detector thresholds (fixed values).
JUMP_TOKENS = 5_000
MISS_CONTEXT, MISS_DROP, MISS_GAP_SECONDS = 200_000, 0.80, 300
CONTINUED_RATIO = 0.80
#: Cache tiers by the key that a payload names, in order of precedence, with idle seconds (fixed values).
TIERS = (("ephemeral_5m_input_tokens", "5m cache", 300), ("ephemeral_1h_input_tokens", "1h cache", 3_600))
DEFAULT_TIER = ("legacy 5m fallback", 300)


def cache_tier(payload: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, tier, _ in reversed(TIERS):
        out = F.when(payload.contains(key), tier).otherwise(out)
    return out


def usage(messages: DataFrame) -> DataFrame:
    """Messages with token counts; the payload is reduced to the tier it names, so it isn't shuffled."""
    count = lambda c: F.coalesce(c, F.lit(0))
    return messages.where(F.col("input_tokens").isNotNull()).select(
        "session_id", "ordinal", "timestamp", "model", cache_tier(F.col("raw_payload")).alias("tier"),
        count("output_tokens").alias("output_tokens"), count("cache_read_input_tokens").alias("cache_read"), count("cache_creation_input_tokens").alias("cache_creation"),
        (count("input_tokens") + count("cache_creation_input_tokens") + count("cache_read_input_tokens")).alias("context"),
    )


def observed(messages: DataFrame) -> DataFrame:
    """Usage with the previous message's context and cache reads; one sort by session serves all detectors."""
    before = {"context_before": F.lag("context", 1, 0), "cache_before": F.lag("cache_read"), "time_before": F.lag("timestamp"), "position": F.row_number()}

    def told(some: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("ordinal")
        return some.withColumns({name: c.over(w) for name, c in before.items()})

    rows = over_sessions(usage(messages), told, [F.col("ordinal")], behind=1, ordinal="ordinal")  # of positions only the first one is told apart
    seconds = F.floor((F.unix_micros(instant(F.col("timestamp"))) - F.unix_micros(instant(F.col("time_before")))) / 1_000_000)
    gap = F.coalesce(F.greatest(seconds, F.lit(0)), F.lit(0)).cast("long")
    drop = (F.col("cache_before") - F.col("cache_read")) / F.col("cache_before")
    missed = (F.col("position") > 1) & (F.col("context") >= MISS_CONTEXT) & (F.col("cache_before") > 0) & (F.col("context_before") != 0)
    missed = missed & (F.when(F.col("cache_before") > 0, drop).otherwise(0.0) > MISS_DROP) & (gap >= MISS_GAP_SECONDS)
    delta = F.col("context") - F.col("context_before")
    return rows.withColumns(
        {"gap_seconds": gap, "delta": delta, "is_jump": delta >= JUMP_TOKENS, "is_post_compaction": F.col("context_before") == 0, "is_miss": F.coalesce(missed, F.lit(False))}
    )


def jumps(messages: DataFrame) -> DataFrame:
    """Messages whose context is larger than the one before by JUMP_TOKENS or more."""
    return observed(messages).where("is_jump").select(
        "session_id", "ordinal", "timestamp", "delta", "context_before", F.col("context").alias("context_after"), "is_post_compaction", "model"
    )


def cache_misses(messages: DataFrame) -> DataFrame:
    """Messages with a large context whose cache reads fell away after a pause."""
    return observed(messages).where("is_miss").select(
        "session_id", "ordinal", "timestamp", "gap_seconds", F.col("context").alias("context_size"),
        F.col("cache_before").alias("cache_read_before"), F.col("cache_read").alias("cache_read_after"),
    )


def sessions(messages: DataFrame) -> DataFrame:
    """One row for each session with usage: counts, totals, peaks, waste and the cache window."""
    first = F.min_by(F.struct("context", "cache_read"), "ordinal")
    tier = F.max_by(F.when(F.col("tier").isNotNull(), F.col("tier")), F.when(F.col("tier").isNotNull(), F.col("ordinal")))
    out = observed(messages).groupBy("session_id").agg(
        F.count("*").alias("message_count"), F.count(F.when(F.col("is_miss"), 1)).alias("cache_misses"), F.count(F.when(F.col("is_jump"), 1)).alias("jumps"),
        tier.alias("tier"), F.max_by("context", "ordinal").alias("total_input"), F.sum("output_tokens").alias("total_output"),
        F.sum("cache_read").alias("total_cache_read"), F.sum("cache_creation").alias("total_cache_creation"), F.max("context").alias("peak_context"),
        F.max("cache_read").alias("peak_cache_read"), F.max("cache_creation").alias("peak_cache_creation"), first.alias("first"),
        F.coalesce(F.sum(F.when(F.col("is_jump") & ~F.col("is_post_compaction"), F.col("delta"))), F.lit(0)).alias("total_waste"),
    )
    ratio = F.when(F.col("first.context") != 0, F.col("first.cache_read") / F.col("first.context")).otherwise(0.0)
    idle = F.lit(DEFAULT_TIER[1])
    for _, name, seconds in TIERS:
        idle = F.when(F.col("tier") == name, seconds).otherwise(idle)
    return out.withColumns(
        {
            "startup_context": F.col("first.context"),
            "is_continued": ratio >= CONTINUED_RATIO,
            "idle_window_seconds": idle.cast("long"),
            "cache_window": F.coalesce("tier", F.lit(DEFAULT_TIER[0])),
        }
    ).drop("first", "tier")


NUMBERS = ("message_count", "cache_misses", "jumps", "total_input", "total_output", "total_cache_read", "total_cache_creation", "peak_context", "peak_cache_read", "peak_cache_creation", "total_waste", "startup_context")


def project_sessions(session_rows: DataFrame, messages: DataFrame, project: str | None = None, since: str | None = None) -> DataFrame:
    """Health of each session of a project, the latest start first; sessions without usage have zeros."""
    chosen = session_rows
    if project is not None:
        chosen = chosen.where(F.col("project_alias") == project)
    if since is not None:
        chosen = chosen.where(F.coalesce("started_at", F.lit("")) >= since)
    ids = chosen.select(F.col("id").alias("session_id"), "external_session_id", "project_alias", "started_at")
    out = ids.join(sessions(messages.join(ids.select("session_id"), "session_id", "left_semi")), "session_id", "left")
    out = out.fillna(0, list(NUMBERS)).fillna({"is_continued": False, "cache_window": DEFAULT_TIER[0], "idle_window_seconds": DEFAULT_TIER[1]})
    return out.orderBy(F.desc("started_at"), "session_id")


def project_totals(health: DataFrame) -> DataFrame:
    """One row of totals over all sessions of ``project_sessions``."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    peak = lambda c: F.coalesce(F.max(c), F.lit(0))
    return health.agg(
        F.count("*").alias("session_count"), total("cache_misses").alias("total_cache_misses"), total("jumps").alias("total_jumps"),
        total("total_waste").alias("total_waste_tokens"), peak("peak_context").alias("peak_context"), total("total_cache_read").alias("total_cache_read_tokens"),
        total("total_cache_creation").alias("total_cache_creation_tokens"), peak("peak_cache_read").alias("peak_cache_read_tokens"),
        peak("peak_cache_creation").alias("peak_cache_creation_tokens"),
    )


def project(session_rows: DataFrame, messages: DataFrame, alias: str | None = None, since: str | None = None, limit: int = 50) -> dict[str, DataFrame]:
    health = project_sessions(session_rows, messages, alias, since)
    return {"totals": project_totals(health), "sessions": health.limit(limit)}
