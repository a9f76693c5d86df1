"""Runs, messages and transcripts made of plain event and conversation tables.

Deterministic mappings, so that every operator can be run and checked on tables
that hold no transcripts.  ``RUNS_SQL`` and the other texts say the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import rfc3339

#: Sample error texts; %k and %i stand for numbers.
SAMPLES = (
    "User doesn't want to proceed with /srv/app/f%k.rs at line %i",
    "Sibling tool call errored after %i ms",
    "Hook /srv/hooks/pre%k blocked the call %i",
    "File has not been read yet: /srv/app/f%k.rs",
    "File modified since read: /srv/app/f%k.rs at %i",
    "No such file /srv/app/f%k.rs (%i)",
    "EISDIR: illegal operation on /srv/app/d%k",
    "Output of %i tokens exceeds maximum allowed tokens",
    "MCP error -%i: closed",
    "lefthook failed on /srv/app/f%k.rs",
    "Exit code %k",
    "Something odd: path does not matter %i",
)
TOOLS = ("Bash", "Edit", "Grep", "Read", "WebFetch")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Events with their place in the user's sequence and the number in their properties; in ``parts`` partitions, or as many as Spark finds fit."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events")
    return (rows.repartition(parts, "user_id") if parts else rows).select(
        "event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"), (F.row_number().over(order) - 1).cast("long").alias("n"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tool run for each event; a session for each user."""
    k, tool = F.col("k"), F.col("tool_name")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "ongoing").when(F.col("event_type") == "purchase", "orphan")
    duration = F.when(F.col("event_type").isin("signup", "purchase"), None).otherwise(F.round(F.col("value") * 100).cast("long"))
    base = events(spark, sf_dir).withColumns(
        {"status": status.otherwise("completed"), "duration_ms": duration, "tool_name": F.array(*map(F.lit, TOOLS))[(k % 5).cast("int")]}
    )
    session, orphan = text("user-", F.col("user_id").cast("string")), F.col("status") == "orphan"
    sub = F.col("user_id") % 10 == 0
    command = F.when(tool == "Bash", text("cargo test /srv/app/mod", (k % 7).cast("string"), " --jobs ", (k % 4).cast("string")))
    tree = F.when(k % 3 == 0, text("/srv/app/.claude/worktrees/wt", (k % 4).cast("string"), "/src/f")).otherwise(F.lit("/srv/app/src/f"))
    path = F.when(tool.isin("Read", "Edit"), text(tree, (k % 11).cast("string"), ".rs")).when(tool == "Bash", text("/srv/app/mod", (k % 7).cast("string")))
    sample = F.array(*map(F.lit, SAMPLES))[(k % 12).cast("int")]
    sample = F.replace(F.replace(sample, F.lit("%k"), k.cast("string")), F.lit("%i"), (F.col("event_id") % 7).cast("string"))
    reading = F.when(tool == "Read", F.lit(True))
    ended = F.when(F.col("status") == "ongoing", None).otherwise(F.timestamp_micros(F.unix_micros("ts") + F.coalesce("duration_ms", F.lit(0)) * 1000))
    return base.select(
        text("ev-", F.lpad(F.col("event_id").cast("string"), 10, "0")).alias("tool_use_id"), session.alias("session_id"), session.alias("external_session_id"),
        F.when(sub, text("user-", (F.col("user_id") - 1).cast("string"))).alias("parent_session_id"), sub.alias("is_subagent"),
        F.when(sub, text("a", F.col("user_id").cast("string"))).alias("agent_id"), "tool_name", command.alias("command"),
        F.when(tool == "Bash", "cargo").alias("command_program"),
        F.coalesce(F.slice(F.split(command, " "), 2, 9), F.array().cast("array<string>")).alias("command_args"),
        F.when(tool == "Bash", text("cargo test <path>/ --jobs ", (k % 4).cast("string"))).alias("command_fingerprint"),
        F.when(tool == "Bash", text("command=", command)).when(tool.isin("Read", "Edit"), text("file_path=", path)).alias("input_summary"),
        (k * 3).alias("input_size"), (k * 5).alias("output_size"), F.array_compact(F.array(path)).alias("file_paths"), "status",
        F.when(~orphan, rfc3339(F.col("ts"))).alias("started_at"), rfc3339(ended).alias("finished_at"), "duration_ms",
        F.when(~orphan, F.col("n") * 2).alias("start_ordinal"), F.when(F.col("status") != "ongoing", F.col("n") * 2 + 1).alias("end_ordinal"),
        F.when(sub, text("subagent:a", F.col("user_id").cast("string"))).otherwise("main").alias("source_scope"),
        F.when(F.col("status") == "error", sample).alias("error_content"), text("p", (F.col("user_id") % 4).cast("string")).alias("project_alias"),
        F.when(F.col("user_id") % 3 != 0, text("wt", (F.col("user_id") % 3).cast("string"))).alias("worktree_name"), F.lit("/srv/app").alias("canonical_cwd"),
        F.when(reading, k * 30).alias("read_total_lines"), F.when(reading, k * 20).alias("read_lines"), F.when(reading, k % 2 == 0).alias("read_truncated"),
    )


def usage_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message with token counts for each event; the payload names a cache tier by ``k``."""
    k = F.col("k")
    small = k % 10 < 7
    payload = F.when(k % 3 == 0, '{"usage":{"ephemeral_5m_input_tokens":1}}').when(k % 3 == 1, '{"usage":{"ephemeral_1h_input_tokens":1}}').otherwise("{}")
    return events(spark, sf_dir).select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("session_id"), F.col("n").alias("ordinal"), rfc3339(F.col("ts")).alias("timestamp"),
        F.lit("model-a").alias("model"), payload.alias("raw_payload"), F.when(small, k * 100).otherwise(250_000 + k).alias("input_tokens"), (k * 7).alias("output_tokens"),
        F.when(small, 200_000 + k * 1000).otherwise(k * 10).alias("cache_read_input_tokens"), (k * 50).alias("cache_creation_input_tokens"),
    )


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each user of the events."""
    session = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.col("ts").cast("timestamp")).alias("ts"), F.count("*").alias("message_count")).select(
        session.alias("id"), session.alias("external_session_id"), F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("project_alias"),
        rfc3339(F.col("ts")).alias("started_at"), "message_count",
    )


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages: a session for each conversation, ordinals by turn."""
    label = F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("system")
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("session_id"), F.col("turn").alias("ordinal"), label.alias("record_type"), "role",
        F.lit(None).cast("string").alias("timestamp"), F.col("text").alias("search_text"),
    )


def chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("message_count")).select(
        conv.alias("id"), conv.alias("external_session_id"), F.concat(F.lit("p"), (F.col("conv_id") % 4).cast("string")).alias("project_alias"), "message_count"
    )


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two transcript records for each event, its call and (but for signups) its result, as JSON lines."""
    k = F.col("k")
    ident = F.concat(F.lit("ev-"), F.lpad(F.col("event_id").cast("string"), 10, "0"))
    tool = F.array(*map(F.lit, TOOLS))[(k % 5).cast("int")]
    path = F.concat(F.lit("/srv/app/src/f"), (k % 11).cast("string"), F.lit(".rs"))
    stamp = lambda c: F.replace(rfc3339(c), F.lit("+00:00"), F.lit("Z"))
    ended = F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 100).cast("long") * 1000)
    head = lambda kind, at: [F.lit(kind).alias("type"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("sessionId"), stamp(at).alias("timestamp"), F.lit("/srv/app").alias("cwd")]
    call = F.struct(F.lit("tool_use").alias("type"), ident.alias("id"), tool.alias("name"), F.struct(path.alias("file_path"), F.concat(F.lit("job "), path).alias("command")).alias("input"))
    answer = F.struct(F.lit("tool_result").alias("type"), ident.alias("tool_use_id"), F.concat(F.lit("result "), k.cast("string")).alias("content"), (F.col("event_type") == "error").alias("is_error"))
    asked = F.to_json(F.struct(*head("assistant", F.col("ts")), F.struct(F.lit("assistant").alias("role"), F.array(call).alias("content")).alias("message")))
    told = F.to_json(F.struct(*head("user", ended), F.struct(F.lit("user").alias("role"), F.array(answer).alias("content")).alias("message")))
    called = F.when(F.col("event_type") != "purchase", F.struct((F.col("n") * 2).alias("ordinal"), asked.alias("value")))
    result = F.when(F.col("event_type") != "signup", F.struct((F.col("n") * 2 + 1).alias("ordinal"), told.alias("value")))
    file = F.concat(F.lit("/transcripts/user-"), F.col("user_id").cast("string"), F.lit(".jsonl")).alias("file_path")
    # Parsing lines costs far more than moving events, so small inputs keep all cores busy too.
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return events(spark, sf_dir, parts).select(file, F.inline(F.array_compact(F.array(called, result))))


# The same in SQL, for DuckDB.

EVENTS_SQL = """
    e AS (
        SELECT event_id, user_id, event_type, ts, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n
        FROM events
    )"""


def stamp_sql(micros: str) -> str:
    """RFC 3339 text of microseconds since 1970."""
    return (
        f"strftime(make_timestamp({micros}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ({micros}) % 1000000 = 0 THEN '' "
        f"WHEN ({micros}) % 1000 = 0 THEN printf('.%03d', (({micros}) % 1000000) // 1000) ELSE printf('.%06d', ({micros}) % 1000000) END || '+00:00'"
    )


def runs_sql() -> str:
    quoted = ", ".join("'" + s.replace("'", "''") + "'" for s in SAMPLES)
    return f"""{EVENTS_SQL},
    b AS (
        SELECT *, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'ongoing' WHEN 'purchase' THEN 'orphan' ELSE 'completed' END AS status,
               CASE WHEN event_type NOT IN ('signup', 'purchase') THEN CAST(round(value * 100) AS BIGINT) END AS duration_ms,
               ['Bash', 'Edit', 'Grep', 'Read', 'WebFetch'][k % 5 + 1] AS tool_name, epoch_us(ts) AS us
        FROM e
    ), c AS (
        SELECT *, CASE WHEN tool_name = 'Bash' THEN 'cargo test /srv/app/mod' || k % 7 || ' --jobs ' || k % 4 END AS command,
               CASE WHEN tool_name IN ('Read', 'Edit') THEN CASE WHEN k % 3 = 0 THEN '/srv/app/.claude/worktrees/wt' || k % 4 || '/src/f' ELSE '/srv/app/src/f' END || k % 11 || '.rs'
                    WHEN tool_name = 'Bash' THEN '/srv/app/mod' || k % 7 END AS path
        FROM b
    ), runs AS (
        SELECT 'ev-' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS tool_use_id, 'user-' || user_id AS session_id, 'user-' || user_id AS external_session_id,
               CASE WHEN user_id % 10 = 0 THEN 'user-' || (user_id - 1) END AS parent_session_id, user_id % 10 = 0 AS is_subagent,
               CASE WHEN user_id % 10 = 0 THEN 'a' || user_id END AS agent_id, tool_name, command,
               CASE WHEN tool_name = 'Bash' THEN 'command=' || command WHEN tool_name IN ('Read', 'Edit') THEN 'file_path=' || path END AS input_summary,
               CASE WHEN path IS NULL THEN [] ELSE [path] END AS file_paths, status, duration_ms,
               CASE WHEN status <> 'orphan' THEN {stamp_sql("us")} END AS started_at,
               CASE WHEN status <> 'orphan' THEN n * 2 END AS start_ordinal, CASE WHEN status <> 'ongoing' THEN n * 2 + 1 END AS end_ordinal,
               CASE WHEN status = 'error' THEN replace(replace([{quoted}][k % 12 + 1], '%k', CAST(k AS VARCHAR)), '%i', CAST(event_id % 7 AS VARCHAR)) END AS error_content,
               'p' || user_id % 4 AS project_alias, CASE WHEN user_id % 3 <> 0 THEN 'wt' || user_id % 3 END AS worktree_name,
               CASE WHEN tool_name = 'Read' THEN k * 20 END AS read_lines, us
        FROM c
    )"""
