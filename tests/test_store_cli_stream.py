import json
import os

import pytest
from pyspark.sql import functions as F

from tests.transcript_files import call, day, record, result, usage, write
from tracelake import cli, schemas
from tracelake.config import BadConfig, Config
from tracelake.operators import content, health, runs
from tracelake.plans.filters import RunFilters
from tracelake.sources.store import NewerStore, Store
from tracelake.sources.transcripts import load, read_lines
from tracelake.streaming.ingest import follow, token_rates


def test_store_replaces_sessions_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 4)
    a = write(tmp_path / "in/a.jsonl", day())
    b = write(tmp_path / "in/b.jsonl", [call(1, "t0", more={"session": "s2"})])
    store.replace(load(read_lines(spark, a, b)))
    assert (store.sessions.count(), store.messages.count(), store.runs.count()) == (2, 24, 6)
    first = store.content_hash()
    store.replace(load(read_lines(spark, a)))
    assert store.content_hash() == first
    write(tmp_path / "in/a.jsonl", day()[:3])
    store.replace(load(read_lines(spark, a)))
    assert (store.sessions.count(), store.messages.count(), store.runs.count()) == (2, 4, 2)
    assert store.content_hash() != first
    assert store.find_session("s2").first()["id"] == "s2" and store.find_session("no").first() is None
    assert [line.split(":")[0] for line in store.schema_text().split("\n")] == ["sessions", "messages", "runs"]


def test_newer_store_is_refused_and_older_columns_read_as_null(spark, tmp_path):
    path = tmp_path / "store"
    store = Store(spark, str(path))
    assert store.version() == schemas.STORE_VERSION
    old = spark.createDataFrame([("t", "s", 0)], "tool_use_id string, session_id string, bucket int")
    old.write.partitionBy("bucket").parquet(f"{path}/runs")
    row = Store(spark, str(path)).runs.first()
    assert row["tool_use_id"] == "t" and row["read_lines"] is None
    spark.createDataFrame([(json.dumps({"version": 99}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/version")
    with pytest.raises(NewerStore):
        Store(spark, str(path))


def ask(spark, tmp_path, *words):
    return cli.run(["--store", str(tmp_path / "store"), "--config", str(tmp_path / "config.toml"), *words], spark)


def test_command_line(spark, tmp_path):
    a = write(tmp_path / "in/s1.jsonl", day())
    assert ask(spark, tmp_path, "projects", "list") == "(none)"
    assert ask(spark, tmp_path, "projects", "add", "named", "/work") == "saved"
    with pytest.raises(SystemExit):
        ask(spark, tmp_path, "transcripts", "sync")
    assert ask(spark, tmp_path, "transcripts", "sync", "--file", a) == "1 sessions stored"
    write(tmp_path / "in/bad.jsonl", ["{nope"])
    with pytest.raises(SystemExit, match="bad.jsonl"):
        ask(spark, tmp_path, "transcripts", "sync", "--root", str(tmp_path / "in"))
    for verb in (
        ["search", "--tool", "Bash"], ["inspect", "s1", "--status", "completed", "--context", "1"], ["compare", "--left", "s1", "--right", "s1"], ["aggregate"],
        ["errors", "--classify"], ["health"], ["health", "--session", "s1"], ["sequences", "--min-occurrences", "1", "--recovery"],
        ["search", "--content-contains", "STEP 3"], ["search", "--group-by-session"],
    ):
        stored = json.loads(ask(spark, tmp_path, "transcripts", *verb, "--format", "json"))
        scanned = json.loads(ask(spark, tmp_path, "scan", *verb, "--file", a, "--format", "json"))
        assert stored == scanned and stored, verb
    runs = json.loads(ask(spark, tmp_path, "scan", "search", "--file", a, "--format", "json"))
    assert len(runs) == 5 and {r["project_alias"] for r in runs} == {"named"}
    audit = json.loads(ask(spark, tmp_path, "transcripts", "audit", "--format", "json"))
    assert [(r["jsonl_lines"], r["imported_messages"], r["missing"]) for r in audit] == [(23, 23, 0)]
    assert json.loads(ask(spark, tmp_path, "transcripts", "audit", "--session", "s1", "--project", "named", "--format", "json")) == audit
    with pytest.raises(SystemExit, match="nothing stored"):
        ask(spark, tmp_path, "transcripts", "audit", "--project", "none")
    assert "Bash" in ask(spark, tmp_path, "transcripts", "aggregate")
    reads = json.loads(ask(spark, tmp_path, "scan", "read-scores", "--file", a, "--now", "2025-07-03T09:00:00Z"))
    assert reads["totals"] == [{"file_count": 1, "total_reads": 1}]
    assert ask(spark, tmp_path, "transcripts").startswith("transcripts: sync")
    with pytest.raises(SystemExit, match="Session not found"):
        ask(spark, tmp_path, "transcripts", "inspect", "nobody")


def test_init_names_working_directories(spark, tmp_path):
    write(tmp_path / "in/a.jsonl", [record(0, cwd="/x/one")])
    write(tmp_path / "in/b.jsonl", [record(0, cwd="/x/two")])
    assert "/x/two" in ask(spark, tmp_path, "init", "--root", str(tmp_path / "in"))
    assert ask(spark, tmp_path, "init", "--root", str(tmp_path / "in"), "--choose", "2,2", "--yes") == "1 projects saved"
    assert Config.read(tmp_path / "config.toml").projects == {"two": "/x/two"}
    with pytest.raises(SystemExit):
        ask(spark, tmp_path, "init", "--root", str(tmp_path / "in"), "--choose", "3", "--yes")


def test_config(tmp_path, monkeypatch):
    from tracelake import config

    c = Config.read(tmp_path / "none.toml")
    c.add("a", '/q"uote')
    c.add("b", "/b")
    c.rename("a", "z")
    for wrong in (lambda: c.rename("z", "b"), lambda: c.rename("no", "n"), lambda: c.remove("no")):
        with pytest.raises(BadConfig):
            wrong()
    c.write()
    assert Config.read(c.path).projects == {"b": "/b", "z": '/q"uote'}
    c.path.write_text("projects = 3")
    with pytest.raises(BadConfig):
        Config.read(c.path)
    monkeypatch.setenv("XDG_DATA_HOME", "/data")
    assert config.store_path() == "/data/tracelake/store" and config.store_path("/flag") == "/flag"
    monkeypatch.setenv("TRACELAKE_STORE", "/env")
    assert config.store_path() == "/env"
    assert os.fspath(config.config_path("/c")) == "/c"


def stored(store):
    """All rows of a store's content, without the time a load made them."""
    return [sorted(map(str, store.table(name).collect())) for name in ("sessions", "messages", "runs")]


def test_stream_follows_files_that_come_grow_shrink_move_and_go(spark, tmp_path):
    root, store = tmp_path / "in", Store(spark, str(tmp_path / "store"), 2)
    talk = lambda session, n: [r for i in range(n) for r in (call(2 * i, f"c{i}", more={"session": session}), result(2 * i + 1, f"c{i}", more={"session": session}))]

    def caught_up():
        follow(spark, str(root), store, str(tmp_path / "check"), files_per_load=3).awaitTermination(300)
        fresh = Store(spark, str(tmp_path / f"fresh-{len(list(tmp_path.iterdir()))}"), 2)
        with load(read_lines(spark, str(root))) as loaded:
            fresh.replace(loaded)
        assert stored(store) == stored(fresh)
        return sorted(r["id"] for r in store.sessions.collect())

    write(root / "a.jsonl", talk("a", 2))
    write(root / "a/subagents/agent-x.jsonl", [call(1, "w", "WebFetch", {"session": "a"})])
    write(root / "b.jsonl", talk("b", 4))
    write(root / "twin1.jsonl", talk("twin", 1))
    write(root / "twin2.jsonl", talk("twin", 3))
    write(root / "bad.jsonl", ["{no"])
    write(root / "move.jsonl", [{"type": "user", "content": "named by its file"}])
    assert caught_up() == ["a", "a:agent:x", "b", "move", "twin"]
    write(root / "a.jsonl", talk("a", 3))  # grown: its subagent keeps its parent
    write(root / "b.jsonl", talk("b", 1))  # shrunk
    (root / "twin2.jsonl").unlink()  # the other file of the session counts now
    (root / "move.jsonl").rename(root / "moved.jsonl")
    write(root / "bad.jsonl", talk("good", 1))  # mended
    write(root / "late.jsonl", talk("late", 1))
    assert caught_up() == ["a", "a:agent:x", "b", "good", "late", "moved", "twin"]
    assert store.sessions.where("id = 'a:agent:x'").first()["parent_session_id"] == "a" and store.messages.where("session_id = 'b'").count() == 2
    (root / "a.jsonl").unlink()  # its subagent stays, without a parent
    write(root / "late.jsonl", ["{spoiled"])
    write(root / "twin0.jsonl", talk("twin", 5))  # a later file of the session is there already
    assert caught_up() == ["a:agent:x", "b", "good", "moved", "twin"]
    assert store.sessions.where("id = 'twin'").first()["transcript_path"].endswith("twin1.jsonl")
    before = store._pointer()[0]
    assert caught_up() == ["a:agent:x", "b", "good", "moved", "twin"] and store._pointer()[0] == before  # nothing has changed, nothing is written


def test_audit_finds_files_that_are_gone(spark, tmp_path):
    paths = [write(tmp_path / f"in/{name}.jsonl", [record(i, session=name) for i in range(n)]) for name, n in (("one", 2), ("two", 3), ("three", 4))]
    ask(spark, tmp_path, "transcripts", "sync", "--root", str(tmp_path / "in"))
    os.remove(paths[1])
    write(tmp_path / "in/three.jsonl", [record(i, session="three") for i in range(6)])
    told = lambda *words: {r["external_session_id"]: (r["jsonl_lines"], r["imported_messages"], r["missing"]) for r in json.loads(ask(spark, tmp_path, "transcripts", "audit", *words, "--format", "json"))}
    assert told() == {"one": (2, 2, 0), "two": (0, 3, -3), "three": (6, 4, 2)}
    assert told("--session", "two") == {"two": (0, 3, -3)} and told("--file", paths[1]) == {"two": (0, 3, -3)} and told("--file", paths[0]) == {"one": (2, 2, 0)}
    with pytest.raises(SystemExit, match="nothing stored"):
        told("--file", str(tmp_path / "in/never.jsonl"))


def test_token_rates(spark):
    rows = spark.createDataFrame([("2026-02-10 12:01:00", "m", 1, 2), ("2026-02-10 12:09:00", "m", 3, 4), ("2026-02-10 12:11:00", "m", 5, 6)], "t string, model string, input_tokens long, output_tokens long")
    out = token_rates(rows.withColumn("stamp", F.to_timestamp("t"))).orderBy("window").collect()
    assert [(r["messages"], r["input_tokens"], r["output_tokens"]) for r in out] == [(2, 4, 6), (1, 5, 6)]


def messages_of(spark, tmp_path, records):
    return load(read_lines(spark, write(tmp_path / "s1.jsonl", records))).messages


def test_health_of_a_short_session(spark, tmp_path):
    records = [record(0, usage=usage(10, 6000, 0)), record(1, usage=usage(10, 230_000, 0)), record(2, usage=usage(1, 0, 0))]
    messages = messages_of(spark, tmp_path, records)
    h = health.sessions(messages).first()
    assert (h["startup_context"], h["peak_context"], h["total_input"], h["total_waste"], h["cache_misses"], h["jumps"], h["is_continued"]) == (6010, 230_010, 1, 224_000, 0, 2, True)
    assert [(r["delta"], r["is_post_compaction"]) for r in health.jumps(messages).orderBy("ordinal").collect()] == [(6010, True), (224_000, False)]
    assert (h["cache_window"], h["idle_window_seconds"]) == ("5m cache", 300)


def test_cache_miss_and_tiers(spark, tmp_path):
    records = [record(0, usage=usage(0, 210_000, tier=None)), record(1, usage=usage(0, 11_000, 0, tier=None)), record(400, usage=usage(205_000, 1_000, tier=None))]
    messages = messages_of(spark, tmp_path, records)
    assert [(r["ordinal"], r["gap_seconds"], r["context_size"]) for r in health.cache_misses(messages).collect()] == [(2, 399, 206_000)]
    assert health.sessions(messages).first()["cache_window"] == "legacy 5m fallback"
    hour = messages_of(spark, tmp_path / "h", [record(0, usage=usage(1, tier="ephemeral_1h_input_tokens")), record(1, usage=usage(1, tier=None))])
    assert health.sessions(hour).first()["cache_window"] == "1h cache"


def test_content_search_modes(spark):
    messages = spark.createDataFrame([("s", 0, "user", "user", None, "Find the Needle, here"), ("s", 1, "user", "user", None, "needles x" * 40), ("s", 2, "user", "user", None, None)],
                                     "session_id string, ordinal long, record_type string, role string, timestamp string, search_text string")
    sessions = spark.createDataFrame([("s", "s", "p")], "id string, external_session_id string, project_alias string")
    find = lambda *a, **k: [r["ordinal"] for r in content.search_content(messages, sessions, *a, **k).collect()]
    assert find(" NEEDLE ") == [0, 1] and find("the needle", mode="phrase") == [0] and find("needle", mode="phrase") == [0]
    assert find("  ") == [] and find("needle", limit=0) == [] and find("needle", limit=1) == [0]
    assert len(content.search_content(messages, sessions, "needles").first()["snippet"]) == 183


def written_bytes(path, before):
    return sum(f.stat().st_size for f in path.rglob("*.parquet") if f not in before)


def test_buckets_split_with_their_bytes(spark, tmp_path):
    path = tmp_path / "store"
    store = Store(spark, str(path), 2, 20_000)
    talk = lambda name, n=30: [r for i in range(n) for r in (call(2 * i, f"{name}-{i}", more={"session": name}), result(2 * i + 1, f"{name}-{i}", more={"session": name}))]
    names, cost = [], []
    for size in (6, 24):
        fresh = [f"s{i}" for i in range(len(names), size)]
        names += fresh
        store.replace(load(read_lines(spark, *[write(tmp_path / f"in/{name}.jsonl", talk(name)) for name in fresh])))
        before = set(path.rglob("*.parquet"))
        store.replace(load(read_lines(spark, write(tmp_path / "in/s1.jsonl", talk("s1", 31)))))
        cost.append(written_bytes(path, before))
    buckets = store._pointer()[1]["messages"]
    assert sum(1 for g in buckets.values() if g) > 4 and None in buckets.values() and cost[1] < 2 * cost[0]
    plain = Store(spark, str(tmp_path / "plain"), 2)
    plain.replace(load(read_lines(spark, str(tmp_path / "in"))))
    assert stored(store) == stored(plain) and len(names) == 24
    again = Store(spark, str(path), 16)  # keeps its own number of buckets
    again.vacuum()
    again.discard(spark.createDataFrame([("s1",), ("s2",)], "id string"))
    assert again.buckets == 2 and sorted(r["id"] for r in again.sessions.collect()) == sorted({*names} - {"s1", "s2"})
    assert again.messages.count() == 22 * 60 and again.family("runs", "s3").count() == 30 and again.family("runs", "s1").count() == 0


def test_a_bucket_of_one_session_is_not_split(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 1, 1_000)
    for _ in range(2):
        store.replace(load(read_lines(spark, write(tmp_path / "in/a.jsonl", day()))))
    assert set(store._pointer()[1]["messages"]) == {"0"} and store.messages.count() == 23


def test_inspection_reads_the_buckets_of_a_family_and_prunes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 16)
    for name in ("a", "b", "c", "d", "e"):
        write(tmp_path / f"in/{name}.jsonl", [call(1, f"t-{name}", more={"session": name}), result(2, f"t-{name}", more={"session": name})])
    write(tmp_path / "in/a/subagents/agent-x.jsonl", [call(1, "w", "WebFetch", {"session": "a"})])
    store.replace(load(read_lines(spark, str(tmp_path / "in"))))
    found = store.family("runs", "a")
    assert sorted(r["tool_use_id"] for r in found.collect()) == ["t-a", "w"]
    assert len(found.inputFiles()) < len(store.runs.inputFiles()) and {"t-a", "w"} == {r["tool_use_id"] for r in runs.inspect(found, "a").collect()}
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = runs.search(store.runs, RunFilters(tool="Bash", min_duration=5, since="2024", session="a"))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert all(word in pushed for word in ("EqualTo(tool_name,Bash)", "GreaterThanOrEqual(duration_ms,5)", "GreaterThanOrEqual(started_at,2024)", "EqualTo(parent_session_id,a)"))
    assert "EqualTo(session_id,a)" in store.family("runs", "a")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
