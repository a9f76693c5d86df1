"""Long sessions in chunks against one window by session, and other plans that must not gather a group."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.operators import errors, health, runs, windows
from tracelake.plans.filters import sequence_order
from tracelake.sources import transcripts


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def calls(spark):
    rng, rows = random.Random(3), []
    for s, n in (("a", 60), ("b", 1), ("c", 25)):
        for i in range(n):
            ordinal = None if rng.random() < 0.1 else rng.choice([rng.randrange(40), 1000 + i])
            rows.append((s, s, None, f"{s}{i:03d}", rng.choice(["Bash", "Read"]), rng.choice(["error", "completed", "ongoing"]), rng.choice(["Exit code 1", "No such file", None]), ordinal, ordinal and ordinal + 1, f"t{rng.randrange(5)}"))
    schema = "session_id string, external_session_id string, parent_session_id string, tool_use_id string, tool_name string, status string, error_content string, start_ordinal long, end_ordinal long, started_at string"
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture
def in_chunks(monkeypatch):
    def shrink(chunk):
        monkeypatch.setattr(windows, "LONG_SESSION", 10)
        monkeypatch.setattr(windows, "CHUNK", chunk)

    return shrink


@pytest.mark.parametrize("chunk", [1, 4, 500])
def test_chunks_give_the_same_rows(calls, in_chunks, chunk):
    ask = lambda: [
        rows_of(errors.recovery(calls)), rows_of(errors.retries(calls, min_occurrences=1)), rows_of(errors.ngrams(calls, None, 0, 5, 1, 1000)),
        rows_of(runs.context_windows(calls, F.col("status") == "error", 2)), rows_of(runs.inspect(calls, "a", status="ongoing", context=3)), rows_of(runs.inspect(calls, "a", tool_use_id="a007", context=7)),
    ]
    want = ask()
    in_chunks(chunk)
    assert ask() == want and all(want)


def test_chunks_of_messages(spark, in_chunks):
    rng = random.Random(5)
    rows = [(s, o, f"2026-01-01T00:{rng.randrange(60):02d}:00Z", "m", "{}", rng.choice([0, 300_000, None]), 1, rng.choice([0, 250_000]), 2) for s, n in (("a", 90), ("b", 3)) for o in rng.sample(range(400), n)]
    messages = spark.createDataFrame(rows, "session_id string, ordinal long, timestamp string, model string, raw_payload string, input_tokens long, output_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long")
    ask = lambda: [rows_of(f(messages)) for f in (health.jumps, health.cache_misses, health.sessions)]
    want = ask()
    in_chunks(7)
    assert ask() == want and all(want)


def test_each_chunk_sees_its_guests_and_no_more(calls, in_chunks):
    in_chunks(5)
    rows = windows.chunked(calls.where("session_id = 'a'"), "session_id", "start_ordinal", sequence_order(), 2, 3).collect()
    by = {}
    for r in rows:
        by.setdefault(r["_chunk"], []).append(r["_guest"])
    assert len(by) > 10 and max(map(len, by.values())) < 25  # a chunk holds its own rows and five guests at most
    assert all(sum(g) <= 5 for g in by.values()) and sum(not r["_guest"] for r in rows) == 60


def test_patterns_keep_the_least_sessions_of_all_parts(spark, monkeypatch):
    rows = [(f"s{i:03d}", f"t{i}", "Bash", "error", "Exit code 1", str(i)) for i in range(300)]
    frame = spark.createDataFrame(rows, "session_id string, tool_use_id string, tool_name string, status string, error_content string, started_at string")
    for parts in (1, 64):
        monkeypatch.setattr(errors, "PARTS", parts)
        found = errors.patterns(frame).first()
        assert (found["count"], found["sample_sessions"], found["sample"]) == (300, ["s000", "s001", "s002"], "Exit code 1")
    window = next(x for x in errors.patterns(frame)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x)
    assert "_w0" in window  # by tool, fingerprint and part


def test_aliases_meet_paths_by_equality(spark):
    cwds = spark.createDataFrame([("/w/app/sub/",), ("rel/x",), ("",), ("/",), ("//odd/x",)], "cwd string")
    projects = spark.createDataFrame([("a", "/w/app/"), ("r", "rel"), ("root", "/")], "alias string, path string")
    out = transcripts.with_alias(cwds, projects)
    assert {r["cwd"]: r["project_alias"] for r in out.collect()} == {"/w/app/sub/": "a", "rel/x": "r", "": "unknown", "/": "root", "//odd/x": "root"}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_plain_window_is_kept_for_short_sessions(calls):
    told = lambda rows, keys: rows.withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    assert "_chunk" not in windows.over_sessions(calls, told, sequence_order()).columns


@pytest.mark.parametrize("chunk", [1, 50, 1 << 20])
def test_ranks_by_counting_are_those_of_percentile_disc(spark, monkeypatch, chunk):
    rows = spark.range(3_000).select(
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 7 == 0, "none").when(F.col("id") == 1, "one").otherwise("b").alias("tool_name"),
        F.when(F.col("id") % 5 == 0, "error").when(F.col("id") % 11 == 0, None).otherwise("completed").alias("status"),
        F.when((F.col("id") % 3 != 0) & (F.col("id") % 7 == 0), None).when(F.col("id") % 4 == 0, 77).when(F.col("id") % 9 != 0, F.pmod(F.xxhash64("id"), F.lit(400)) - 100).alias("duration_ms"),
    )
    for some, keys in ((rows, ["tool_name"]), (rows, ["tool_name", "status"]), (rows.limit(0), ["tool_name"]), (rows, ["no such key"])):
        monkeypatch.setattr(runs, "LIGHT", 1 << 40)
        want = runs.aggregate_groups(some, keys)
        monkeypatch.setattr(runs, "LIGHT", -1)
        monkeypatch.setattr(runs, "CHUNK", chunk)
        got = runs.aggregate_groups(some, keys)
        assert got.columns == want.columns and got.collect() == want.collect()
        assert "percentile" not in got._jdf.queryExecution().executedPlan().toString()
