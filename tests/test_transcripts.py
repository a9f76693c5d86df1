import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.transcript_files import call, day, record, result, write
from tracelake import schemas
from tracelake.plans.files import BLOCK_TASKS, small_blocks
from tracelake.sources import transcripts
from tracelake.sources.transcripts import load, parsed, read_lines
from tracelake.sources.writer import delete_files, write_files


def lines_of(spark, *files):
    rows = [(p, i, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for p, records in files for i, v in enumerate(records)]
    return spark.createDataFrame(rows, "file_path string, ordinal long, value string")


def runs_of(spark, records, path="/t/s1.jsonl"):
    return {r["tool_use_id"]: r for r in load(lines_of(spark, (path, records))).runs.collect()}


def test_a_day_of_calls(spark, tmp_path):
    path = write(tmp_path / "s1.jsonl", day())
    loaded = load(read_lines(spark, path))
    assert loaded.messages.count() == 23
    runs = loaded.runs.orderBy("start_ordinal").collect()
    assert [r["tool_name"] for r in runs] == ["Glob", "Write", "Bash", "Read", "Bash"]
    assert {r["duration_ms"] for r in runs} == {2000} and {r["status"] for r in runs} == {"completed"}
    third = runs[2]
    assert third["command_program"] == "make" and third["command_args"] == ["check", "/srv/app"] and third["command_fingerprint"] == "make check <path>/"
    assert third["input_summary"] == "command=make check /srv/app" and third["file_paths"] == ["/srv/app"] and third["project_alias"] == "app"
    assert third["started_at"] == "2025-07-03T08:30:10+00:00" and third["input_size"] == len('{"command":"make check /srv/app"}') and third["output_size"] == 4
    session = loaded.sessions.first()
    assert (session["id"], session["message_count"], session["is_subagent"]) == ("s1", 23, False)
    assert {r["record_type"]: r["count"] for r in loaded.messages.groupBy("record_type").count().collect()} == {"assistant": 11, "progress": 6, "user": 6}


def test_statuses_and_last_wins(spark):
    runs = runs_of(spark, [
        call(1, "a", command="x"), result(2, "a", [{"type": "text", "text": "bad"}, {"type": "text", "text": ""}, "worse"], True),
        call(3, "b"), result(4, "c", "lost", True, {"totalLines": 5}), call(9, "d"), result(5, "d"), result(6, "d", "later"),
        call(7, "e", "Read"), result(8, "e", file={"totalLines": 3000, "numLines": 200, "truncatedByTokenCap": True}),
    ])
    assert {k: r["status"] for k, r in runs.items()} == {"a": "error", "b": "ongoing", "c": "orphan", "d": "completed", "e": "completed"}
    assert runs["a"]["error_content"] == "bad\nworse" and runs["c"]["error_content"] == "lost" and runs["c"]["tool_name"] == "Unknown"
    assert runs["c"]["start_ordinal"] is None and runs["c"]["read_total_lines"] is None and runs["b"]["duration_ms"] is None
    assert runs["d"]["duration_ms"] == -3000 and runs["d"]["output_size"] == len('"later"')
    assert (runs["e"]["read_total_lines"], runs["e"]["read_lines"], runs["e"]["read_truncated"]) == (3000, 200, True)


def test_summaries_paths_and_truncation(spark):
    long = "run " + "é" * 600
    runs = runs_of(spark, [call(1, "a", command=long), call(2, "b", "Grep", pattern="p" * 90, file_path="/z", description=3),
                           call(3, "c", command="cat '/a/b', (https://x.y/z) \"c/d\"; /e/f:")])
    assert len(runs["a"]["command"]) == 503 and runs["a"]["command"].endswith("...")
    assert runs["b"]["input_summary"] == f"file_path=/z, pattern={'p' * 80}..., description=3"
    assert runs["c"]["file_paths"] == ["/a/b", "/e/f", "c/d"]
    assert runs["c"]["command_fingerprint"].startswith("cat '<path>/ (https:<path>/ ")


def test_strict_values_and_content_forms(spark):
    records = [
        record(1, content="plain"), record(2, content=[{"type": "text", "text": "t"}]), {"type": "odd", "content": {"text": "own"}, "timestamp": "2025-07-03"},
        {"type": "user", "message": {"content": None}, "content": "shadowed", "isSidechain": "true"}, {"type": "human", "toolUseId": "x", "uuid": 5},
        '{"type":"user","type":"assistant","content":"twice"}',
    ]
    loaded = load(lines_of(spark, ("/t/stem.jsonl", records)))
    rows = loaded.messages.orderBy("ordinal").collect()
    assert [r["search_text"] for r in rows] == ["plain", '{"blocks":[{"text":"t","type":"text"}]}', "own", "", "", "twice"]
    assert [r["record_type"] for r in rows] == ["assistant", "assistant", "system", "user", "user", "assistant"]
    assert rows[2]["timestamp"] is None and rows[3]["content"] == "null" and rows[3]["is_sidechain"] is False
    assert rows[4]["tool_use_id"] == "x" and rows[4]["uuid"] is None


def test_ordinals_count_blank_lines_over_splits(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", [record(i % 3000, content="x" * 50) if i % 7 else "" for i in range(3000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = read_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 0
        rows = lines.orderBy("ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["ordinal"] for r in rows] == list(range(3000))
    assert all((r["value"] == "") == (r["ordinal"] % 7 == 0) for r in rows)


def test_number_of_tasks_does_not_follow_small_blocks(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", [record(i, content="x" * 50) if i % 7 else "" for i in range(3000)])
    with small_blocks(spark, "1k"):
        raw = spark.read.text(path)
        blocks = raw.select("_metadata.file_block_start").distinct().count()
        assert blocks > 500 and raw.rdd.getNumPartitions() <= 2 * BLOCK_TASKS * spark.sparkContext.defaultParallelism < blocks
        rows = read_lines(spark, path).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == list(range(3000))
    assert all((r["value"] == "") == (r["ordinal"] % 7 == 0) for r in rows)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abcdefgXYZ_", min_size=3, max_size=9).map(lambda k: "zz" + k), min_size=5, max_size=5))
def test_unknown_keys_are_refused_at_every_level(spark, keys):
    def spoiled(level):
        r = record(1, usage={"input_tokens": 1, "cache_creation": {}, "server_tool_use": {}})
        place = r
        for name in level.split(".") if level != "top-level" else []:
            place = place[name]
        place[keys[0]] = 1
        return r

    files = [(f"/t/{level}.jsonl", [record(0), spoiled(level)]) for level, _, _ in transcripts.LEVELS] + [("/t/good.jsonl", [record(0)])]
    loaded = load(lines_of(spark, *files))
    found = {r["level"]: (r["ordinal"], r["reason"]) for r in loaded.errors.collect()}
    assert found == {level: (1, f"unknown field {keys[0]}") for level, _, _ in transcripts.LEVELS}
    assert [r["transcript_path"] for r in loaded.sessions.collect()] == ["/t/good.jsonl"]


def test_bad_lines_reject_their_file(spark, tmp_path):
    write(tmp_path / "bad.jsonl", [record(0, session="bad"), "{not-json", "[1]"])
    write(tmp_path / "good.jsonl", day())
    (tmp_path / "bytes.jsonl").write_bytes(b'{"type":"user","content":"\xff"}\n')
    lines = read_lines(spark, str(tmp_path))
    loaded = load(lines)
    assert {(r["file_path"].rsplit("/", 1)[1], r["level"]) for r in loaded.errors.collect()} == {("bad.jsonl", "decode"), ("bad.jsonl", "top-level"), ("bytes.jsonl", "encoding")}
    assert loaded.runs.count() == 5 and loaded.sessions.count() == 1
    with pytest.raises(transcripts.BadTranscripts, match="bad.jsonl:2"):
        load(lines, fail_fast=True)


def test_subagents_are_linked_by_path(spark, tmp_path):
    write(tmp_path / "p1.jsonl", [call(0, "t", "Task", {"session": "p1"})])
    write(tmp_path / "p1/subagents/agent-abc.jsonl", [call(1, "w", "WebFetch", {"session": "p1", "isSidechain": True})])
    write(tmp_path / "p1/workflows/journal.jsonl", [record(0)])
    write(tmp_path / "solo.jsonl", [call(2, "r", "Read", {"session": "solo", "agentId": "zz"})])
    by = {r["id"]: r for r in load(read_lines(spark, str(tmp_path))).sessions.collect()}
    assert set(by) == {"p1", "p1:agent:abc", "solo:agent:zz"}
    assert by["p1:agent:abc"]["parent_session_id"] == "p1" and by["p1:agent:abc"]["is_subagent"]
    assert by["solo:agent:zz"]["parent_session_id"] is None and by["solo:agent:zz"]["is_subagent"]
    apart = load(read_lines(spark, str(tmp_path)), link_subagents=False).sessions
    assert apart.where("parent_session_id is not null").count() == 0
    assert read_lines(spark, str(tmp_path), subagents=False).select("file_path").distinct().count() == 2
    runs = {r["tool_use_id"]: r for r in load(read_lines(spark, str(tmp_path))).runs.collect()}
    assert runs["w"]["source_scope"] == "subagent:abc" and runs["t"]["source_scope"] == "main"


def test_one_session_in_two_files_and_one_tool_id_in_two_sessions(spark):
    loaded = load(lines_of(spark, ("/t/a.jsonl", [call(1, "x", session_marker=1)]), ("/t/b.jsonl", [call(2, "x"), call(3, "y")]), ("/t/c.jsonl", [call(4, "x", more={"session": "s2"})])))
    assert {(r["session_id"], r["tool_use_id"]) for r in loaded.runs.collect()} == {("s1", "x"), ("s1", "y"), ("s2", "x")}
    assert {r["transcript_path"] for r in loaded.sessions.collect()} == {"/t/b.jsonl", "/t/c.jsonl"}


def test_facts_come_from_the_first_ten_messages(spark):
    records = [{"type": "user", "timestamp": "2025-07-03T08:30:09Z"}] * 10 + [record(1, session="late", cwd="/late")]
    s = load(lines_of(spark, ("/t/stem.jsonl", records))).sessions.first()
    assert (s["id"], s["cwd"], s["project_alias"]) == ("stem", None, "unknown")
    assert (s["started_at"], s["ended_at"]) == ("2025-07-03T08:30:09+00:00", "2025-07-03T08:30:01+00:00")


def test_aliases_prefer_the_deepest_component_prefix(spark):
    cwds = spark.createDataFrame([("/w/app",), ("/w/app/sub/x",), ("/w/apple",), ("/",), ("/elsewhere/y/",)], "cwd string")
    projects = spark.createDataFrame([("a", "/w/app"), ("b", "/w/app/"), ("s", "/w/app/sub")], "alias string, path string")
    assert {r["cwd"]: r["project_alias"] for r in transcripts.with_alias(cwds, projects).collect()} == {
        "/w/app": "b", "/w/app/sub/x": "s", "/w/apple": "apple", "/": "unknown", "/elsewhere/y/": "y"
    }


def test_discovered_projects(spark):
    lines = lines_of(spark, ("/a", ["", "{bad", record(1, cwd="/x")]), ("/b", [record(1, cwd="/x")]), ("/c", ["{}"] * 20 + [record(1, cwd="/y")]))
    assert [r["cwd"] for r in transcripts.discovered_projects(lines).collect()] == ["/x"]


def test_empty_input(spark):
    loaded = load(spark.createDataFrame([], "file_path string, ordinal long, value string"))
    assert [df.count() for df in (loaded.sessions, loaded.messages, loaded.runs, loaded.errors)] == [0, 0, 0, 0]
    assert sorted(loaded.runs.columns) == sorted(c.split()[0] for c in schemas.RUNS.replace("\n", " ").split(",") if c.strip())
    assert parsed(loaded.errors.select("file_path", "ordinal", F.lit("").alias("value"))).count() == 0


def plain_text(value):
    """The text of a content value, by recursion."""
    if isinstance(value, list):
        return "\n".join(t for t in map(plain_text, value) if t)
    if isinstance(value, dict) and isinstance(value.get("text"), str):
        return value["text"]
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))


def test_error_texts_nested_to_any_depth(spark):
    rng, bodies = random.Random(4), {}
    for i, depth in enumerate([0, 1, 5, 6, 7, 8, 13, 40, 100]):
        body = rng.choice(["x", {"type": "text", "text": "t"}, {"a": [[1, [2]]]}])
        for k in range(depth):
            body = [body, *rng.choices(["", None, f"s{k}", {"text": f"o{k}"}, 7, [], [["deep", []]]], k=rng.randint(0, 2))]
        bodies[f"t{i}"] = body
    records = [r for i, (ident, body) in enumerate(bodies.items()) for r in (call(2 * i, ident), result(2 * i + 1, ident, body, True))]
    records += [call(40, "fine"), result(41, "fine", [[[[[[[["not an error"]]]]]]]])]
    runs = runs_of(spark, records)
    assert {k: r["error_content"] for k, r in runs.items()} == {k: plain_text(b) for k, b in bodies.items()} | {"fine": None}


def test_listing_names_files_that_exist(spark, tmp_path):
    write(tmp_path / "p/a.jsonl", [record(0)])
    write(tmp_path / "p/workflows/journal.jsonl", ["{"])
    (tmp_path / "p/note.txt").write_text("x")
    rows = transcripts.listing(spark, str(tmp_path / "p"), str(tmp_path / "none")).collect()
    assert [(r["file_path"], r["length"]) for r in rows] == [(str(tmp_path / "p/a.jsonl"), (tmp_path / "p/a.jsonl").stat().st_size)]
    assert transcripts.listing(spark, str(tmp_path / "none")).collect() == []


def test_files_are_written_whole_and_deleted(spark, tmp_path):
    rows = [(f"d{i % 3}/f{i % 7}.jsonl", i, f"line {i} é".encode()) for i in range(500)] + [("bytes.jsonl", 0, b"\xff"), ("bytes.jsonl", 1, b"")]
    lines = spark.createDataFrame(rows, "file string, ordinal long, value binary").repartition(4)
    wrote = {r["file"]: (r["lines"], r["bytes"]) for r in write_files(lines, str(tmp_path / "out")).collect()}
    want = {}
    for file, _, value in sorted(rows, key=lambda r: r[1]):
        want[file] = want.get(file, b"") + value + b"\n"
    assert {f: (tmp_path / "out" / f).read_bytes() for f in want} == want
    assert wrote == {f: (w.count(b"\n"), len(w)) for f, w in want.items()}
    assert not [p for p in (tmp_path / "out").rglob("_*")]
    names = spark.createDataFrame([("bytes.jsonl",), ("none.jsonl",)], "file string")
    assert [r["file"] for r in delete_files(names, str(tmp_path / "out")).collect()] == ["bytes.jsonl"] and not (tmp_path / "out/bytes.jsonl").exists()


def test_files_read_whole_give_the_lines_that_blocks_give(spark, tmp_path, monkeypatch):
    texts = {"a": b"\xef\xbb\xbf{}\n\n x\r\n\n", "b": b"one\ntwo", "c": b"", "d": b"\n", "e": b'ok\n"\xff\xc3\xa9"\n\xe2\x82\xac\n', "f": b"\xff\xfe\n\xef\xbb\xbf1", "g": b"x\x00y\x0bz\x85\xe2\x80\xa8w\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.jsonl").write_bytes(text)

    def rows():
        found = read_lines(spark, str(tmp_path)).select("file_path", "ordinal", F.hex(F.col("value").cast("binary")).alias("value"))
        return sorted(map(tuple, found.collect()))

    whole = rows()
    monkeypatch.setattr(transcripts, "WHOLE_BYTES", -1)
    assert whole == rows() and len(whole) == 13


def test_only_wanted_columns_are_loaded(spark, tmp_path):
    lines = lines_of(spark, ("/t/s1.jsonl", day()), ("/t/s2.jsonl", ["{oops"]))
    wanted = ("session_id", "ordinal", "search_text", "input_tokens")
    part, full = load(lines, with_messages=wanted, with_runs=False), load(lines)
    written = set(spark.read.parquet(part.paths[0]).columns)
    assert not written & {"content", "raw_payload", "blocks", "read_file", "deep"} and written >= {*wanted[1:]}
    assert part.messages.columns == list(wanted) and part.runs.columns == full.runs.columns and part.runs.count() == 0
    for name in ("messages", "sessions", "errors"):
        assert sorted(map(str, getattr(part, name).collect())) == sorted(map(str, getattr(full, name).select(*getattr(part, name).columns).collect()))
    assert load(lines, with_messages=wanted).runs.count() == full.runs.count() > 0
    with pytest.raises(ValueError, match="no column texts"):
        load(lines, with_messages=("texts",))


def test_tasks_read_what_sparks_sources_read_and_the_driver_holds_no_names(spark, tmp_path):
    rng, start = random.Random(7), b"\xef\xbb\xbf"
    for i in range(130):
        lines = [rng.choice([b"", b"x" * rng.randint(1, 40), b'{"a":1}', b"\xff", b" \r"]) for _ in range(rng.randint(0, 12))]
        at = tmp_path / rng.choice(["p", "p/s1/subagents", "q r%", "_no", ".no", "w/workflows/run"]) / rng.choice([f"f{i}.jsonl", f"f {i}#.jsonl", f"f{i}.txt", f"_f{i}.jsonl", "journal.jsonl"])
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(rng.choice([b"", start]) + b"\n".join(lines) + rng.choice([b"", b"\n"]) if lines else b"")
    rows = lambda df: sorted(tuple(r) for r in df.select("file_path", "ordinal", F.hex(F.col("value").cast("binary")).alias("value")).collect())
    read = read_lines(spark, str(tmp_path))
    want = rows(transcripts.source_lines(spark, (str(tmp_path),), 1 << 20))
    assert rows(read) == want and len({file for file, _, _ in want}) > 20
    assert not [f for f in read.inputFiles() if f.endswith(".jsonl")]
    roots = transcripts.reader.local_roots(spark, (f"file://{tmp_path}",))
    for step in (1, 5, 64):
        assert rows(transcripts.reader.read_files(spark, roots, ".jsonl", step, ~F.col("file_path").rlike(transcripts.JOURNAL))) == want
    some = sorted({file for file, _, _ in want})[::3]
    only = spark.createDataFrame([(file,) for file in some], "file_path string")
    assert rows(read_lines(spark, str(tmp_path), only=only)) == [r for r in want if r[0] in some]
    assert {r["file_path"] for r in transcripts.listing(spark, str(tmp_path)).collect()} >= {file for file, _, _ in want}


def test_only_lines_that_need_it_are_trimmed(spark):
    texts = ["x", " x", "x\t", "\n\x0bx y\f\r", "", " \r ", "\u00a0x\u00a0", "é "]
    rows = spark.createDataFrame([(t,) for t in texts], "value string").select("value", transcripts.stripped(F.col("value")).alias("s")).collect()
    assert {r["value"]: r["s"] for r in rows} == {t: t.strip(transcripts.WHITE) for t in texts}
