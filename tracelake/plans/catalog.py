"""Queries of this library by name, over plain tables, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import content, errors, health, runs
from ..sources import adapters, transcripts
from .filters import RunFilters, filtered, stored_order

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NOW = "2024-06-01T00:00:00Z"
EVERY_FILTER = RunFilters(project="p1", tool="Bash", command_contains="mod", file_path="/srv/app", min_duration=100, max_duration=9_000, status="completed", since="2024-01-01")
LEFT, RIGHT = [f"user-{i}" for i in range(0, 60, 2)], [f"user-{i}" for i in range(0, 90, 3)]
SESSION = "user-9"


def query(sql: str):
    def register(make: Callable[[SparkSession, str], DataFrame]):
        QUERIES[make.__name__] = make
        ORACLE_SQL[make.__name__] = sql
        return make

    return register


def joined(column: str):
    return F.array_join(column, "|").alias(column)


RUNS = "WITH" + adapters.runs_sql()
FINGERPRINT = r"""(SELECT CASE WHEN length(f) > 120 THEN substr(f, 1, 120) || '...' ELSE f END
    FROM (SELECT regexp_replace(regexp_replace(coalesce(error_content, ''), '/[^\s:]+/[^\s:]+', '<path>', 'g'), '\d+', 'N', 'g') AS f))"""


def category_sql(text: str) -> str:
    """The rules by hand, so that a wrong one in the code shows."""
    return f"""(SELECT CASE
        WHEN t LIKE '%doesn''t want to proceed%' OR t LIKE '%was rejected%' THEN 'user_rejected'
        WHEN t LIKE '%sibling tool call errored%' THEN 'sibling_errored'
        WHEN t LIKE '%hook%' AND (t LIKE '%blocked%' OR t LIKE '%denied%') THEN 'hook_blocked'
        WHEN t LIKE '%has not been read yet%' THEN 'file_not_read_first'
        WHEN t LIKE '%modified since read%' THEN 'file_modified_since_read'
        WHEN t LIKE '%does not exist%' OR t LIKE '%no such file%' OR t LIKE '%enoent%' THEN 'file_not_found'
        WHEN t LIKE '%eisdir%' THEN 'path_error'
        WHEN t LIKE '%exceeds maximum allowed tokens%' THEN 'token_limit_exceeded'
        WHEN t LIKE '%mcp error%' THEN 'mcp_error'
        WHEN t LIKE '%precommit failed%' OR t LIKE '%pre-commit%' OR t LIKE '%lefthook%' THEN 'pre_commit_failed'
        WHEN t LIKE '%exit code%' THEN 'exit_code' ELSE 'other' END FROM (SELECT lower({text}) AS t))"""


def preventability_sql(name: str) -> str:
    return f"""(SELECT CASE
        WHEN c IN ('file_not_read_first', 'file_modified_since_read', 'file_not_found', 'path_error', 'token_limit_exceeded') THEN 'preventable'
        WHEN c IN ('user_rejected', 'hook_blocked') THEN 'user_driven' WHEN c = 'sibling_errored' THEN 'cascading'
        WHEN c IN ('exit_code', 'mcp_error', 'pre_commit_failed') THEN 'systemic' ELSE 'other' END FROM (SELECT {name} AS c))"""


def placed(df: DataFrame) -> DataFrame:
    """``df`` with the place of each row in it, so that its order shows; for results of a session or a limit."""
    rows = df.withColumn("_at", F.monotonically_increasing_id())
    return rows.withColumn("place", F.row_number().over(Window.orderBy("_at"))).drop("_at")


SHOWN = ("tool_use_id", "session_id", "tool_name", "status", "duration_ms", "start_ordinal", "end_ordinal", "started_at", "error_content", "project_alias", "worktree_name")
SHOWN_SQL = ", ".join(SHOWN)
STORED = "ORDER BY coalesce(started_at, ''), start_ordinal NULLS FIRST, tool_use_id"
SEQUENCE = "start_ordinal NULLS LAST, tool_use_id"


@query(f"{RUNS} SELECT {SHOWN_SQL} FROM runs WHERE tool_name = 'Read' AND contains(file_paths[1], 'src/f3') {STORED} LIMIT 50")
def search_runs(spark, sf_dir):
    return runs.search(adapters.runs(spark, sf_dir), RunFilters(tool="Read", file_path="src/f3", limit=50)).select(*SHOWN)


@query(f"""{RUNS} SELECT {SHOWN_SQL} FROM runs WHERE project_alias = 'p1' AND tool_name = 'Bash' AND contains(command, 'mod') AND contains(command, '/srv/app')
    AND coalesce(duration_ms, 0) >= 100 AND coalesce(duration_ms, 0) <= 9000 AND status = 'completed' AND coalesce(started_at, '') >= '2024-01-01'""")
def run_filters_all(spark, sf_dir):
    return filtered(adapters.runs(spark, sf_dir), EVERY_FILTER).select(*SHOWN)


@query(f"""{RUNS} SELECT {SHOWN_SQL} FROM runs
    WHERE (session_id = '{SESSION}' OR parent_session_id = '{SESSION}') AND read_lines >= 400 AND worktree_name IS NULL AND coalesce(duration_ms, 0) <= 5000""")
def run_filters_session(spark, sf_dir):
    rows = filtered(adapters.runs(spark, sf_dir), RunFilters(session=SESSION, min_read_lines=400, max_duration=5_000))
    return rows.where(F.col("worktree_name").isNull()).select(*SHOWN)


@query(f"""{RUNS} SELECT session_id, arg_min(external_session_id, start_ordinal) AS external_session_id, min(project_alias) AS project_alias, min(worktree_name) AS worktree_name,
    count(*) AS matches, min(least(start_ordinal, end_ordinal)) || '-' || max(greatest(start_ordinal, end_ordinal)) AS ordinal_range,
    string_agg(tool_use_id, '|' ORDER BY {SEQUENCE}) AS tool_use_ids FROM runs WHERE status = 'error' GROUP BY session_id""")
def search_group_by_session(spark, sf_dir):
    return runs.session_groups(adapters.runs(spark, sf_dir), RunFilters(status="error")).withColumn("tool_use_ids", F.array_join("tool_use_ids", "|"))


@query(f"{RUNS} SELECT {SHOWN_SQL} FROM runs WHERE session_id = '{SESSION}' OR parent_session_id = '{SESSION}'")
def inspect_session(spark, sf_dir):
    return runs.inspect(adapters.runs(spark, sf_dir), SESSION).select(*SHOWN)


NEAR = f"(ORDER BY {SEQUENCE} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query(f"""{RUNS}, s AS (SELECT *, max(CAST(status = 'error' AS INT)) OVER {NEAR} AS near FROM runs WHERE session_id = '{SESSION}' OR parent_session_id = '{SESSION}')
    SELECT {SHOWN_SQL} FROM s WHERE near = 1""")
def inspect_status_context(spark, sf_dir):
    return runs.inspect(adapters.runs(spark, sf_dir), SESSION, status="error", context=2).select(*SHOWN)


@query(f"""{RUNS}, s AS (SELECT *, max(CAST(status = 'error' AND tool_name = 'Bash' AS INT)) OVER (PARTITION BY session_id {NEAR[1:]} AS near FROM runs)
    SELECT {SHOWN_SQL} FROM s WHERE near = 1""")
def inspect_context_window(spark, sf_dir):
    hit = (F.col("status") == "error") & (F.col("tool_name") == "Bash")
    return runs.context_windows(adapters.runs(spark, sf_dir), hit, 2).select(*SHOWN)


CHAT = """m AS (SELECT 'conv-' || conv_id AS session_id, conv_id, turn AS ordinal, role,
    CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'system' END AS record_type, CAST(NULL AS VARCHAR) AS timestamp, text AS search_text FROM conversations)"""
SNIPPET = "CASE WHEN length(search_text) > {0} THEN substr(search_text, 1, {0}) || '...' ELSE search_text END AS snippet"


@query(f"""WITH {CHAT}, r AS (SELECT session_id, min(ordinal) - 1 AS low, max(ordinal) AS high FROM m WHERE role = 'assistant' GROUP BY session_id)
    SELECT m.session_id, ordinal, record_type, role, timestamp, {SNIPPET.format(240)} FROM m JOIN r USING (session_id) WHERE ordinal BETWEEN low AND high""")
def inspect_messages(spark, sf_dir):
    messages = adapters.chat_messages(spark, sf_dir)
    spans = messages.where(F.col("role") == "assistant").select("session_id", F.col("ordinal").alias("start_ordinal"), F.col("ordinal").alias("end_ordinal"))
    return runs.context_messages(messages, spans)


@query(f"{RUNS} SELECT row_number() OVER ({STORED}) AS place, tool_use_id, session_id FROM runs WHERE tool_name = 'Bash' QUALIFY place <= 200")
def search_order(spark, sf_dir):
    """Places of the first matches in stored order."""
    return placed(runs.search(adapters.runs(spark, sf_dir), RunFilters(tool="Bash", limit=200)).select("tool_use_id", "session_id"))


@query(f"{RUNS} SELECT row_number() OVER (ORDER BY {SEQUENCE}) AS place, tool_use_id, session_id FROM runs WHERE session_id = '{SESSION}' OR parent_session_id = '{SESSION}'")
def inspect_order(spark, sf_dir):
    """Places of the runs of a session and its subagents in sequence."""
    return placed(runs.inspect(adapters.runs(spark, sf_dir), SESSION).select("tool_use_id", "session_id"))


@query(f"""{RUNS}, s AS (SELECT *, max(CAST(status = 'error' AS INT)) OVER {NEAR} AS near FROM runs WHERE session_id = '{SESSION}' OR parent_session_id = '{SESSION}')
    SELECT row_number() OVER (ORDER BY {SEQUENCE}) AS place, tool_use_id FROM s WHERE near = 1""")
def inspect_context_order(spark, sf_dir):
    """Places of a session's failed runs and of two on both sides of each."""
    return placed(runs.inspect(adapters.runs(spark, sf_dir), SESSION, status="error", context=2).select("tool_use_id"))


@query(f"""WITH {CHAT}, r AS (SELECT session_id, min(ordinal) - 1 AS low, max(ordinal) AS high FROM m WHERE role = 'assistant' AND conv_id % 10 = 3 GROUP BY session_id)
    SELECT row_number() OVER (ORDER BY m.session_id, ordinal) AS place, m.session_id, ordinal FROM m JOIN r USING (session_id) WHERE ordinal BETWEEN low AND high""")
def inspect_messages_order(spark, sf_dir):
    """Places of the messages around the runs of some sessions."""
    messages = adapters.chat_messages(spark, sf_dir)
    some = (F.col("role") == "assistant") & F.col("session_id").endswith("3")
    spans = messages.where(some).select("session_id", F.col("ordinal").alias("start_ordinal"), F.col("ordinal").alias("end_ordinal"))
    return placed(runs.context_messages(messages, spans).select("session_id", "ordinal"))


def quoted(ids):
    return ", ".join(f"'{i}'" for i in ids)


def side(name, ids):
    return f"""SELECT '{name}' AS side, tool_name AS key, count(*) AS count, CAST(sum(duration_ms) // count(duration_ms) AS BIGINT) AS avg_duration_ms
        FROM runs WHERE session_id IN ({quoted(ids)}) OR coalesce(parent_session_id IN ({quoted(ids)}), false) GROUP BY tool_name"""


@query(f"{RUNS} {side('left', LEFT)} UNION ALL {side('right', RIGHT)}")
def compare_cohorts(spark, sf_dir):
    return runs.compare(adapters.runs(spark, sf_dir), LEFT, RIGHT)


def groups_sql(keys):
    return f"""{RUNS} SELECT {keys}, count(*) AS count, count(*) FILTER (status = 'error') AS errors,
        round(count(*) FILTER (status = 'error') / count(*) * 100 * 10) / 10 AS error_pct, quantile_disc(duration_ms, 0.5) AS p50_duration_ms,
        quantile_disc(duration_ms, 0.95) AS p95_duration_ms, quantile_disc(duration_ms, 0.5) AS avg_duration_ms FROM runs GROUP BY ALL"""


@query(groups_sql("tool_name"))
def aggregate_by_tool(spark, sf_dir):
    return runs.aggregate_groups(adapters.runs(spark, sf_dir))


@query(groups_sql("status, tool_name"))
def aggregate_by_tool_status(spark, sf_dir):
    return runs.aggregate_groups(adapters.runs(spark, sf_dir), ["tool_name", "status"])


@query(groups_sql("coalesce(agent_id, '') AS agent_id, project_alias AS project, coalesce(worktree_name, '') AS worktree"))
def aggregate_by_project_worktree_agent(spark, sf_dir):
    return runs.aggregate_groups(adapters.runs(spark, sf_dir), ["project", "worktree", "agent_id"])


@query(f"{RUNS} SELECT count(*) AS total, count(DISTINCT session_id) AS session_count FROM runs WHERE tool_name = 'Edit'")
def aggregate_totals(spark, sf_dir):
    return runs.totals(adapters.runs(spark, sf_dir), RunFilters(tool="Edit"))


@query(f"""{RUNS}, f AS (SELECT *, {FINGERPRINT} AS fingerprint, row_number() OVER ({STORED}, session_id) AS turn FROM runs WHERE status = 'error')
    SELECT fingerprint, count(*) AS count, arg_min(tool_name, turn) AS tool_name, arg_min(error_content, turn) AS sample
    FROM f GROUP BY fingerprint ORDER BY count DESC, tool_name, fingerprint LIMIT 10""")
def aggregate_top_errors(spark, sf_dir):
    return runs.top_errors(adapters.runs(spark, sf_dir))


PATTERNS = f"""{RUNS}, f AS (
        SELECT *, {FINGERPRINT} AS fingerprint, row_number() OVER (ORDER BY started_at NULLS FIRST, tool_use_id) AS turn FROM runs WHERE status = 'error'
    ), g AS (
        SELECT tool_name, fingerprint, count(*) AS count, arg_min(started_at, turn) AS first_seen, arg_max(started_at, turn) AS last_seen,
               arg_max(error_content, turn) AS sample, array_to_string(list_sort(list(DISTINCT session_id))[1:3], '|') AS sample_sessions
        FROM f GROUP BY tool_name, fingerprint
    ), t AS (SELECT tool_name, count(*) AS n FROM runs GROUP BY tool_name)
    SELECT g.*, """
TOP = "ORDER BY count DESC, tool_name, fingerprint"


@query(f"{PATTERNS} CAST(NULL AS BIGINT) AS tool_total, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS preventability, CAST(NULL AS DOUBLE) AS error_rate FROM g {TOP} LIMIT 20")
def errors_patterns(spark, sf_dir):
    return errors.patterns(adapters.runs(spark, sf_dir)).withColumn("sample_sessions", F.array_join("sample_sessions", "|"))


@query(f"""{PATTERNS} t.n AS tool_total, {category_sql("sample")} AS category, {preventability_sql(category_sql("sample"))} AS preventability,
    round(g.count / t.n * 100 * 100) / 100 AS error_rate FROM g JOIN t USING (tool_name)""")
def errors_classified(spark, sf_dir):
    return errors.patterns(adapters.runs(spark, sf_dir), top=None, classify=True).withColumn("sample_sessions", F.array_join("sample_sessions", "|"))


@query(f"""{RUNS} SELECT count(*) AS total_tool_calls, count(*) FILTER (status = 'error') AS total_errors,
    count(DISTINCT CASE WHEN status = 'error' THEN tool_name || chr(1) || {FINGERPRINT} END) AS pattern_count FROM runs""")
def errors_summary(spark, sf_dir):
    return errors.summary(adapters.runs(spark, sf_dir))


USAGE = f"""WITH{adapters.EVENTS_SQL}, u AS (
        SELECT 'user-' || user_id AS session_id, user_id, n AS ordinal, epoch_us(ts) AS us, k * 7 AS output_tokens, k * 50 AS cache_creation,
               CASE WHEN k % 10 < 7 THEN k * 100 ELSE 250000 + k END + k * 50 + CASE WHEN k % 10 < 7 THEN 200000 + k * 1000 ELSE k * 10 END AS context,
               CASE WHEN k % 10 < 7 THEN 200000 + k * 1000 ELSE k * 10 END AS cache_read,
               CASE k % 3 WHEN 0 THEN '5m cache' WHEN 1 THEN '1h cache' END AS tier
        FROM e
    ), l AS (
        SELECT *, lag(context, 1, 0) OVER w AS context_before, lag(cache_read) OVER w AS cache_before,
               coalesce(greatest((us - lag(us) OVER w) // 1000000, 0), 0) AS gap_seconds
        FROM u WINDOW w AS (PARTITION BY session_id ORDER BY ordinal)
    ), o AS (
        SELECT *, context - context_before AS delta, context - context_before >= 5000 AS is_jump, context_before = 0 AS is_post_compaction,
               coalesce(context >= 200000 AND cache_before > 0 AND context_before <> 0 AND (cache_before - cache_read) / cache_before > 0.8 AND gap_seconds >= 300, false) AS is_miss
        FROM l
    )"""


@query(f"{USAGE} SELECT session_id, ordinal, delta, context_before, context AS context_after, is_post_compaction FROM o WHERE is_jump")
def health_token_jumps(spark, sf_dir):
    return health.jumps(adapters.usage_messages(spark, sf_dir)).drop("timestamp", "model")


@query(f"{USAGE} SELECT session_id, ordinal, gap_seconds, context AS context_size, cache_before AS cache_read_before, cache_read AS cache_read_after FROM o WHERE is_miss")
def health_cache_misses(spark, sf_dir):
    return health.cache_misses(adapters.usage_messages(spark, sf_dir)).drop("timestamp")


HEALTH = """SELECT session_id, count(*) AS message_count, count(*) FILTER (is_miss) AS cache_misses, count(*) FILTER (is_jump) AS jumps,
    arg_max(context, ordinal) AS total_input, CAST(sum(output_tokens) AS BIGINT) AS total_output, CAST(sum(cache_read) AS BIGINT) AS total_cache_read,
    CAST(sum(cache_creation) AS BIGINT) AS total_cache_creation, max(context) AS peak_context, max(cache_read) AS peak_cache_read, max(cache_creation) AS peak_cache_creation,
    CAST(coalesce(sum(delta) FILTER (is_jump AND NOT is_post_compaction), 0) AS BIGINT) AS total_waste, arg_min(context, ordinal) AS startup_context,
    coalesce(arg_min(cache_read, ordinal) / nullif(arg_min(context, ordinal), 0) >= 0.8, false) AS is_continued,
    CAST(CASE arg_max(tier, ordinal) FILTER (tier IS NOT NULL) WHEN '1h cache' THEN 3600 ELSE 300 END AS BIGINT) AS idle_window_seconds,
    coalesce(arg_max(tier, ordinal) FILTER (tier IS NOT NULL), 'legacy 5m fallback') AS cache_window FROM o {} GROUP BY session_id"""


@query(f"{USAGE} {HEALTH.format('')}")
def health_sessions(spark, sf_dir):
    return health.sessions(adapters.usage_messages(spark, sf_dir))


@query(f"""{USAGE}, h AS ({HEALTH.format("WHERE user_id % 4 = 1")}) SELECT count(*) AS session_count, CAST(sum(cache_misses) AS BIGINT) AS total_cache_misses, CAST(sum(jumps) AS BIGINT) AS total_jumps,
    CAST(sum(total_waste) AS BIGINT) AS total_waste_tokens, max(peak_context) AS peak_context, CAST(sum(total_cache_read) AS BIGINT) AS total_cache_read_tokens,
    CAST(sum(total_cache_creation) AS BIGINT) AS total_cache_creation_tokens, max(peak_cache_read) AS peak_cache_read_tokens, max(peak_cache_creation) AS peak_cache_creation_tokens FROM h""")
def health_project(spark, sf_dir):
    return health.project_totals(health.project_sessions(adapters.user_sessions(spark, sf_dir), adapters.usage_messages(spark, sf_dir), project="p1"))


GRAMS = " UNION ALL ".join(
    f"SELECT array_to_string(p, '|') AS pattern FROM (SELECT list(tool_name) OVER (PARTITION BY session_id ORDER BY {SEQUENCE} ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS p FROM runs) WHERE len(p) = {n}"
    for n in (2, 3, 4)
)


@query(f"{RUNS} SELECT pattern, count(*) AS count FROM ({GRAMS}) GROUP BY pattern HAVING count(*) >= 2 ORDER BY count DESC, pattern LIMIT 20")
def sequences_ngrams(spark, sf_dir):
    return errors.ngrams(adapters.runs(spark, sf_dir)).withColumn("pattern", F.array_join("pattern", "|"))


@query(f"""{RUNS}, s AS (SELECT *, lead(tool_name) OVER (PARTITION BY session_id ORDER BY {SEQUENCE}) AS after, {FINGERPRINT} AS f FROM runs)
    SELECT tool_name || ' (' || CASE WHEN length(f) > 60 THEN substr(f, 1, 60) || '...' ELSE f END || ') -> ' || tool_name AS pattern, count(*) AS count
    FROM s WHERE status = 'error' AND after = tool_name GROUP BY 1 HAVING count(*) >= 2 ORDER BY count DESC, pattern LIMIT 20""")
def sequences_retries(spark, sf_dir):
    return errors.retries(adapters.runs(spark, sf_dir))


@query(f"""{RUNS}, s AS (
        SELECT *, list({{'t': tool_name, 's': status}}) OVER (PARTITION BY session_id ORDER BY {SEQUENCE} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead FROM runs
    ), r AS (
        SELECT {category_sql("coalesce(error_content, '')")} AS category,
               ahead[1:coalesce(nullif(list_position(list_transform(ahead, lambda x: x.t = tool_name), false), 0) - 1, len(ahead))] AS retries
        FROM s WHERE status = 'error'
    ), q AS (SELECT category, coalesce(len(retries), 0) AS n, coalesce(list_contains(list_transform(retries, lambda x: x.s), 'completed'), false) AS ok FROM r)
    SELECT category, count(*) AS total, count(*) FILTER (n > 0) AS retried, count(*) FILTER (ok) AS recovered,
           round(count(*) FILTER (n > 0) / count(*) * 100 * 10) / 10 AS retry_rate,
           coalesce(round(count(*) FILTER (ok) / nullif(count(*) FILTER (n > 0), 0) * 100 * 10) / 10, 0.0) AS recovery_rate,
           coalesce(round(sum(n) / nullif(count(*) FILTER (n > 0), 0) * 10) / 10, 0.0) AS avg_retries FROM q GROUP BY category""")
def sequences_recovery(spark, sf_dir):
    return errors.recovery(adapters.runs(spark, sf_dir))


@query(f"""{RUNS}, r AS (
        SELECT regexp_replace(unnest(file_paths), '/\\.claude/worktrees/[^/]+/', '/', 'g') AS path, started_at,
               coalesce(pow(0.5::DOUBLE, greatest((epoch_us(TIMESTAMP '2024-06-01') - us) // 1000000, 0)::DOUBLE / 86400::DOUBLE / 14::DOUBLE), 0) AS w, started_at IS NOT NULL AS timed
        FROM runs WHERE tool_name = 'Read'
    )
    SELECT path, round(sum(CASE WHEN timed THEN w ELSE 0 END) * 100) / 100 AS score, count(*) AS reads, max(started_at) AS last_read FROM r GROUP BY path""")
def read_scores(spark, sf_dir):
    return content.read_scores(adapters.runs(spark, sf_dir), NOW)


@query(f"""WITH {CHAT} SELECT session_id, session_id AS external_session_id, 'p' || conv_id % 4 AS project_alias, ordinal, record_type, role, timestamp, {SNIPPET.format(180)}
    FROM m WHERE contains(lower(search_text), 'tion the') ORDER BY session_id, ordinal LIMIT 50""")
def content_search(spark, sf_dir):
    return content.search_content(adapters.chat_messages(spark, sf_dir), adapters.chat_sessions(spark, sf_dir), " Tion THE ")


@query(f"""WITH {CHAT} SELECT session_id, session_id AS external_session_id, 'p' || conv_id % 4 AS project_alias, ordinal, record_type, role, timestamp, {SNIPPET.format(180)}
    FROM m WHERE contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower(search_text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), ' ') || ' ', ' of the ')""")
def content_search_phrase(spark, sf_dir):
    return content.search_content(adapters.chat_messages(spark, sf_dir), adapters.chat_sessions(spark, sf_dir), "Of, the", None, "phrase")


@query(f"WITH {CHAT} SELECT session_id, record_type, count(*) AS count FROM m GROUP BY ALL")
def audit_types(spark, sf_dir):
    return content.type_histogram(adapters.chat_messages(spark, sf_dir))


@query("""WITH u AS (SELECT user_id, count(*) FILTER (event_type <> 'purchase') AS calls, count(*) FILTER (event_type <> 'signup') AS results FROM events GROUP BY user_id)
    SELECT '/transcripts/user-' || user_id || '.jsonl' AS file_path, calls + results AS jsonl_lines, calls + results AS parsed_messages, calls AS assistant, results AS "user" FROM u""")
def audit_files(spark, sf_dir):
    lines = adapters.transcript_lines(spark, sf_dir)
    out = content.audit(lines, transcripts.messages(transcripts.parsed(lines)))
    types = [F.coalesce(F.try_element_at("jsonl_types", F.lit(t)), F.lit(0)).alias(t) for t in ("assistant", "user")]
    return out.select("file_path", "jsonl_lines", "parsed_messages", *types)


@query(f"""WITH{adapters.EVENTS_SQL} SELECT 'ev-' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS tool_use_id, 'user-' || user_id AS session_id,
    CASE WHEN event_type = 'purchase' THEN 'Unknown' ELSE ['Bash', 'Edit', 'Grep', 'Read', 'WebFetch'][k % 5 + 1] END AS tool_name,
    CASE event_type WHEN 'purchase' THEN 'orphan' WHEN 'signup' THEN 'ongoing' WHEN 'error' THEN 'error' ELSE 'completed' END AS status,
    CASE WHEN event_type NOT IN ('purchase', 'signup') THEN CAST(round(value * 100) AS BIGINT) END AS duration_ms,
    CASE WHEN event_type <> 'purchase' THEN n * 2 END AS start_ordinal, CASE WHEN event_type <> 'signup' THEN n * 2 + 1 END AS end_ordinal,
    CASE WHEN event_type = 'error' THEN 'result ' || k END AS error_content, CASE WHEN event_type <> 'purchase' THEN {adapters.stamp_sql("epoch_us(ts)")} END AS started_at,
    CASE WHEN event_type <> 'purchase' THEN '/srv/app/src/f' || k % 11 || '.rs' ELSE '' END AS file_paths,
    CASE WHEN event_type <> 'purchase' THEN 'job <path>/' END AS command_fingerprint, 'app' AS project_alias,
    CAST(CASE WHEN event_type <> 'purchase' THEN 33 + 2 * length('/srv/app/src/f' || k % 11 || '.rs') END AS BIGINT) AS input_size,
    CAST(CASE WHEN event_type <> 'signup' THEN 9 + length(CAST(k AS VARCHAR)) END AS BIGINT) AS output_size FROM e""")
def derive_runs_roundtrip(spark, sf_dir):
    """Transcript records through parsing, validation and derivation; ordinals are those of the lines."""
    loaded = transcripts.load(adapters.transcript_lines(spark, sf_dir), with_messages=False)
    return loaded.runs.select(
        "tool_use_id", "session_id", "tool_name", "status", "duration_ms", "start_ordinal", "end_ordinal", "error_content", "started_at",
        joined("file_paths"), "command_fingerprint", "project_alias", "input_size", "output_size",
    )


@query("""WITH p(alias, path) AS (VALUES ('all', '/c'), ('ones', '/c/1'), ('deep', '/c/1/x'), ('twin', '/c/1')), d AS (SELECT DISTINCT '/c/' || c_custkey % 20 || '/x' || c_nationkey AS cwd FROM customer),
    m AS (SELECT cwd, alias, row_number() OVER (PARTITION BY cwd ORDER BY length(path) DESC, alias DESC) AS turn FROM d LEFT JOIN p ON cwd = path OR starts_with(cwd, path || '/'))
    SELECT cwd, coalesce(alias, regexp_extract(cwd, '[^/]+$')) AS project_alias FROM m WHERE turn = 1""")
def project_alias_match(spark, sf_dir):
    cwds = adapters.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("/c/"), (F.col("c_custkey") % 20).cast("string"), F.lit("/x"), F.col("c_nationkey").cast("string")).alias("cwd")
    )
    projects = spark.createDataFrame([("all", "/c"), ("ones", "/c/1"), ("deep", "/c/1/x"), ("twin", "/c/1")], "alias string, path string")
    return transcripts.with_alias(cwds.distinct(), projects)


@query("WITH d AS (SELECT DISTINCT user_id FROM events) SELECT 'user-' || user_id AS id, 'user-' || user_id AS external_session_id, 'p' || user_id % 4 AS project_alias FROM d")
def sessions_listing(spark, sf_dir):
    return adapters.user_sessions(spark, sf_dir).orderBy(F.desc("started_at"), "id").select("id", "external_session_id", "project_alias")


@query(f"{RUNS} SELECT tool_use_id, session_id, started_at FROM runs")
def runs_listing(spark, sf_dir):
    return adapters.runs(spark, sf_dir).orderBy(*stored_order()).select("tool_use_id", "session_id", "started_at")


@query(f"{RUNS} SELECT {SHOWN_SQL} FROM runs WHERE worktree_name = 'wt2' AND contains(error_content, 'f1') AND status = 'error'")
def run_filters_worktree_error(spark, sf_dir):
    return filtered(adapters.runs(spark, sf_dir), RunFilters(worktree="wt2", error_contains="f1", status="error")).select(*SHOWN)


from . import files  # noqa: E402,F401  registers its queries here
