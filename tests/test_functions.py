import pytest
from pyspark.sql import functions as F

from tracelake.functions import errors, text
from tracelake.operators import errors as error_ops
from tracelake.operators import runs as run_ops
from tracelake.plans.filters import RunFilters, filtered, stored_order

RUN = """tool_use_id string, session_id string, external_session_id string, parent_session_id string, tool_name string, status string, duration_ms long,
    start_ordinal long, end_ordinal long, started_at string, error_content string, command string, input_summary string, file_paths array<string>,
    project_alias string, worktree_name string, read_lines long, agent_id string"""
DEFAULTS = dict(session_id="s", external_session_id="s", parent_session_id=None, tool_name="Bash", status="completed", duration_ms=None, start_ordinal=None, end_ordinal=None,
                started_at=None, error_content=None, command=None, input_summary=None, file_paths=[], project_alias="p", worktree_name=None, read_lines=None, agent_id=None)


def runs_of(spark, *rows):
    full = [{"tool_use_id": f"t{i}", **DEFAULTS, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in RUN.replace("\n", " ").split(",")) for r in full], RUN)


def one(spark, make, *values, type_="string"):
    return spark.createDataFrame([values], ", ".join(f"c{i} {type_}" for i in range(len(values)))).select(make(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize(("value", "n", "want"), [("abc", 3, "abc"), ("abcd", 3, "abc..."), ("é😀xy", 2, "é😀..."), (None, 2, None), ("", 0, "")])
def test_truncation_counts_code_points(spark, value, n, want):
    assert one(spark, lambda c: text.truncated(c, n), value) == want


@pytest.mark.parametrize(("value", "digits", "want"), [(1.005, 2, 1.0), (2.5, 0, 3.0), (-0.25, 1, -0.3), (33.333, 1, 33.3)])
def test_rounding_scales_first(spark, value, digits, want):
    assert one(spark, lambda c: text.scaled_round(c, digits), value, type_="double") == want


def test_fingerprints(spark):
    assert one(spark, text.error_fingerprint, "At /a/b.rs:12 and /single ٣ times") == "At <path>:N and /single N times"
    assert one(spark, text.error_fingerprint, "x" * 130) == "x" * 120 + "..."
    assert one(spark, text.command_fingerprint, "  ls   /a/b  -l ") == "ls <path>/ -l"
    assert one(spark, text.folded_worktree, "/r/.claude/worktrees/w1/src/a") == "/r/src/a"


def test_time_stamps(spark):
    for value, want in [("2026-02-10T12:00:00Z", "2026-02-10T12:00:00+00:00"), ("2026-02-10T12:00:00.120Z", "2026-02-10T12:00:00.120+00:00"),
                        ("2026-02-10T13:00:00.000001+01:00", "2026-02-10T12:00:00.000001+00:00"), ("2026-02-10", None), ("12", None), (None, None)]:
        assert one(spark, lambda c: text.rfc3339(text.instant(c)), value) == want
    between = lambda a, b: text.millis_between(text.instant(a), text.instant(b))
    assert one(spark, between, "2026-02-10T12:00:00.0019Z", "2026-02-10T12:00:00Z") == -1


@pytest.mark.parametrize(("content", "name", "who"), [
    ("User rejected tool use", "other", "other"), ("The user DOESN'T want to proceed", "user_rejected", "user_driven"), ("was rejected", "user_rejected", "user_driven"),
    ("Sibling tool call errored", "sibling_errored", "cascading"), ("hook denied", "hook_blocked", "user_driven"), ("hook", "other", "other"),
    ("File has not been read yet", "file_not_read_first", "preventable"), ("modified since read", "file_modified_since_read", "preventable"),
    ("path does not exist", "file_not_found", "preventable"), ("EISDIR", "path_error", "preventable"), ("exceeds maximum allowed tokens", "token_limit_exceeded", "preventable"),
    ("MCP error -32000", "mcp_error", "systemic"), ("lefthook", "pre_commit_failed", "systemic"), ("Exit code 1", "exit_code", "systemic"), ("Kelvin hooK blocked", "other", "other"),
])
def test_categories(spark, content, name, who):
    assert one(spark, errors.category, content) == name
    assert one(spark, lambda c: errors.preventability(errors.category(c)), content) == who


def test_filter_quirks(spark):
    runs = runs_of(spark, {"duration_ms": None}, {"duration_ms": 50, "started_at": "2026-02-10T12:00:00+00:00"}, {"worktree_name": "w", "parent_session_id": "x"})
    ids = lambda **f: sorted(r["tool_use_id"] for r in filtered(runs, RunFilters(**f)).collect())
    assert ids(max_duration=10) == ["t0", "t2"] and ids(min_duration=0) == ["t0", "t1", "t2"] and ids(min_duration=1) == ["t1"]
    assert ids(since="2026-02-10T12:00:00Z") == [] and ids(since="2026-02-10T12:00:00+00:00") == ["t1"] and ids(since="") == ["t0", "t1", "t2"]
    assert ids(worktree="w") == ["t2"] and ids(session="x") == ["t2"] and ids(command_contains="") == [] and ids() == ["t0", "t1", "t2"]
    assert ids(min_read_lines=0) == [] and ids(tool="bash") == []


def test_orders_and_limits(spark):
    runs = runs_of(spark, {"started_at": "b"}, {"start_ordinal": 1}, {"start_ordinal": None}, {"started_at": "b", "start_ordinal": 0})
    assert [r["tool_use_id"] for r in runs.orderBy(*stored_order()).collect()] == ["t2", "t1", "t0", "t3"]
    assert [r["tool_use_id"] for r in run_ops.search(runs, RunFilters(limit=2)).collect()] == ["t2", "t1"]
    assert run_ops.search(runs, RunFilters(limit=0)).count() == 0


def test_groups_and_percentiles(spark):
    runs = runs_of(spark, *[{"duration_ms": d} for d in (10, 20, 30, 40)], {"status": "error", "agent_id": "a"})
    row = run_ops.aggregate_groups(runs).first()
    assert (row["count"], row["errors"], row["error_pct"], row["p50_duration_ms"], row["p95_duration_ms"]) == (5, 1, 20.0, 20, 40)
    assert [r["nonsense"] for r in run_ops.aggregate_groups(runs, ["nonsense"]).collect()] == ["unsupported:nonsense"]
    empty = run_ops.aggregate_groups(runs.where("status = 'error'"), ["agent_id", "agent_id"]).first()
    assert empty["agent_id"] == "a" and empty["p50_duration_ms"] is None
    assert run_ops.aggregate_groups(runs.limit(0)).count() == 0
    assert [(r["side"], r["key"], r["count"], r["avg_duration_ms"]) for r in run_ops.compare(runs, ["s"], ["s"]).collect()] == [("left", "Bash", 5, 25), ("right", "Bash", 5, 25)]


def test_error_patterns(spark):
    runs = runs_of(spark, {"status": "error", "error_content": "fail 1", "started_at": None}, {"status": "error", "error_content": "fail 22", "started_at": "2026"}, {"status": "error"}, {}, {"status": "orphan", "error_content": "fail 3"})
    first, second = error_ops.patterns(runs, classify=True).collect()
    assert (first["fingerprint"], first["count"], first["first_seen"], first["last_seen"], first["sample"]) == ("fail N", 2, None, "2026", "fail 22")
    assert (first["tool_total"], first["error_rate"], first["category"]) == (5, 40.0, "other") and second["fingerprint"] == ""
    assert tuple(error_ops.summary(runs).first()) == (5, 3, 2)
    plain = error_ops.patterns(runs, top=1).collect()
    assert len(plain) == 1 and plain[0]["category"] is None and plain[0]["error_rate"] is None
    assert [(r["fingerprint"], r["count"]) for r in run_ops.top_errors(runs).collect()] == [("fail N", 2), ("", 1)]


def test_recovery_looks_at_five_runs_of_the_same_tool(spark):
    steps = [("Bash", "error"), ("Bash", "error"), ("Read", "completed"), ("Bash", "error")] + [("Bash", "ongoing")] * 5 + [("Bash", "completed")]
    runs = runs_of(spark, *[{"tool_name": t, "status": s, "start_ordinal": i, "error_content": "exit code 1" if s == "error" else None} for i, (t, s) in enumerate(steps)])
    row = error_ops.recovery(runs).first()
    assert (row["category"], row["total"], row["retried"], row["recovered"], row["retry_rate"], row["recovery_rate"], row["avg_retries"]) == ("exit_code", 3, 2, 0, 66.7, 0.0, 3.0)
    assert [(r["pattern"], r["count"]) for r in error_ops.retries(runs, min_occurrences=1).collect()] == [("Bash (exit code N) -> Bash", 2)]


def test_ngrams(spark):
    runs = runs_of(spark, *[{"tool_name": t, "start_ordinal": i} for i, t in enumerate("ABAB")], {"session_id": "z", "tool_name": "A"})
    grams = {tuple(r["pattern"]): r["count"] for r in error_ops.ngrams(runs, shortest=2, longest=3, min_occurrences=1).collect()}
    assert grams == {("A", "B"): 2, ("B", "A"): 1, ("A", "B", "A"): 1, ("B", "A", "B"): 1}
    assert {tuple(r["pattern"]): r["count"] for r in error_ops.ngrams(runs, shortest=0, longest=1, min_occurrences=1).collect()}[()] == 7


def test_inspection(spark):
    runs = runs_of(spark, *[{"start_ordinal": i, "status": "error" if i == 4 else "completed"} for i in range(8)], {"session_id": "kid", "parent_session_id": "s", "start_ordinal": 100})
    ids = lambda **k: [r["tool_use_id"] for r in run_ops.inspect(runs, "s", **k).collect()]
    assert ids() == [f"t{i}" for i in range(9)] and ids(is_subagent=True) == [f"t{i}" for i in range(8)]
    assert ids(status="error") == ["t4"] and ids(status="error", context=1) == ["t3", "t4", "t5"] and ids(tool_use_id="t1", status="error", context=2) == ["t0", "t1", "t2", "t3"]
    messages = spark.createDataFrame([("s", i, "user", None, None, "m") for i in range(6)], "session_id string, ordinal long, record_type string, role string, timestamp string, search_text string")
    assert [r["ordinal"] for r in run_ops.context_messages(messages, runs_of(spark, {"start_ordinal": 2, "end_ordinal": 3})).collect()] == [1, 2, 3]
    assert [r["ordinal"] for r in run_ops.context_messages(messages, runs_of(spark, {"end_ordinal": 1})).collect()] == [0, 1]
    group = run_ops.session_groups(runs_of(spark, {"start_ordinal": 5, "end_ordinal": 3}, {"session_id": "n"})).collect()
    assert [(r["matches"], r["ordinal_range"]) for r in group] == [(1, "n/a"), (1, "3-5")]
