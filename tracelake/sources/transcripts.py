"""Session transcripts: JSON lines to messages, sessions and tool runs.

``read_lines`` gives one row per physical line with its place in the file;
``parsed`` decodes and validates records against the closed world of
``schemas``; ``messages`` normalises them; ``load`` puts sessions and runs on
top.  One bad line rejects its whole file, whose errors are reported instead.

Records are held as VARIANT while in flight.  Strings, numbers and flags are read
strictly: a value of another type counts as missing.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import command_fingerprint, command_paths, instant, last_component, millis_between, rfc3339, tokens, truncated
from . import reader
from .shared import files_of, packed, remove, settings, size_setting, written

#: Messages from whose first ones a session's facts are taken.
FACT_MESSAGES = 10
#: Arrays within each other that are opened at once; deeper ones take another round.
LEVELS_AT_ONCE = 6
#: Bytes of a file that one row holds.
WHOLE_BYTES = 16 << 20
#: White space around a record.
WHITE = " \t\n\x0b\f\r"
#: Files that are no transcripts.
JOURNAL = r"/workflows/(?:.*/)?journal\.jsonl$"
LEVELS = (
    ("top-level", "$", schemas.TOP_LEVEL_FIELDS),
    ("message", "$.message", schemas.MESSAGE_FIELDS),
    ("message.usage", "$.message.usage", schemas.USAGE_FIELDS),
    ("message.usage.cache_creation", "$.message.usage.cache_creation", schemas.CACHE_CREATION_FIELDS),
    ("message.usage.server_tool_use", "$.message.usage.server_tool_use", schemas.SERVER_TOOL_USE_FIELDS),
)


# Files.


def read_lines(spark: SparkSession, *paths: str, subagents: bool = True, only: DataFrame | None = None) -> DataFrame:
    """(file_path, ordinal, value) of the lines of all ``*.jsonl`` files below the paths, or of those in ``only`` (file_path) alone.

    Blank lines keep their place in the count.  Workflow journals are no
    transcripts; files below ``subagents`` are left out on request.

    A file of one block, and of WHOLE_BYTES at most, is read whole and its lines
    are numbered there, so its text is not shuffled.  Longer ones are read in
    blocks.  Where the executors mount the files, tasks list and read them (see
    ``reader``); else Spark's sources do, whose names and blocks the driver holds.
    """
    longest = min(WHOLE_BYTES, size_setting(spark, "spark.sql.files.maxPartitionBytes"))
    if (roots := reader.local_roots(spark, paths)) is not None:
        kept = ~F.col("file_path").rlike(JOURNAL)
        return reader.read_files(spark, roots, ".jsonl", longest, kept if subagents else kept & ~is_subagent_path(F.col("file_path")), only)
    lines = source_lines(spark, paths, longest, subagents)
    return lines if only is None else lines.join(only, "file_path", "left_semi")


def source_lines(spark: SparkSession, paths: tuple[str, ...], longest: int, subagents: bool = True) -> DataFrame:
    """``read_lines`` by Spark's own sources; see ``numbered``."""
    source = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    with settings(spark, listing_tasks(spark)):
        whole = source.text(list(paths), wholetext=True).select("value", "_metadata.file_path", "_metadata.file_size")
        raw = source.text(list(paths), lineSep="\n").select("value", "_metadata.file_path", "_metadata.file_size", "_metadata.file_block_start")
    path = F.regexp_replace("file_path", "^file:/+", "/")
    kept = ~F.col("file_path").rlike(JOURNAL)
    if not subagents:
        kept &= ~is_subagent_path(F.col("file_path"))
    short = split_lines(whole.where(F.col("file_size") <= longest).withColumn("file_path", path).where(kept))
    rows = raw.where(F.col("file_size") > longest).drop("file_size").withColumns({"file_path": path, "_id": F.monotonically_increasing_id()})
    return short.unionByName(numbered(rows.where(kept)))


def listing_tasks(spark: SparkSession) -> dict[str, object]:
    """Folders are listed by a few tasks a core, not by one task each."""
    return {"spark.sql.sources.parallelPartitionDiscovery.parallelism": 4 * spark.sparkContext.defaultParallelism}


def split_lines(files: DataFrame) -> DataFrame:
    """(file_path, ordinal, value) of rows that hold a whole file: what Spark's reader of lines gives, without the mark that a file may begin with."""
    text = F.when(F.startswith("value", F.lit("\ufeff")), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))
    # A split goes by Java strings, which would replace bytes that are no UTF-8; there each byte is taken for a sign.
    by_bytes = F.transform(F.split(F.decode(F.col("_text").cast("binary"), "ISO-8859-1"), "\n"), lambda line: F.encode(line, "ISO-8859-1").cast("string"))
    parts = F.when(F.is_valid_utf8("_text"), F.split("_text", "\n")).otherwise(by_bytes)
    rows = files.withColumn("_text", text).select("file_path", parts.alias("_parts"), (F.endswith("_text", F.lit("\n")) | (F.col("_text") == "")).cast("int").alias("_ended"))
    rows = rows.select("file_path", F.posexplode(F.slice("_parts", F.lit(1), F.size("_parts") - F.col("_ended"))).alias("ordinal", "value"))
    return rows.select("file_path", F.col("ordinal").cast("long").alias("ordinal"), "value")


def listing(spark: SparkSession, *paths: str) -> DataFrame:
    """(file_path, length, modified) of the ``*.jsonl`` files below those of the paths that exist; no content is read."""
    there = [p for p in paths if (at := files_of(spark, p)) and at[0].exists(at[1])]
    if not there:
        return spark.createDataFrame([], "file_path string, length bigint, modified timestamp")
    if (roots := reader.local_roots(spark, tuple(there))) is not None:
        found = reader.files_below(spark, roots, ".jsonl")
        return found.where(~F.col("file_path").rlike(JOURNAL)).select("file_path", "length", "modified")
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    path = F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("file_path")
    with settings(spark, listing_tasks(spark)):
        files = source.load(there)
    rows = files.select(path, F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("modified"))
    return rows.where(~F.col("file_path").rlike(JOURNAL))


def numbered(rows: DataFrame) -> DataFrame:
    """(file_path, ordinal, value) of rows with ``file_block_start`` and ``_id``, which orders a block's lines.

    Lines are numbered within their block; the lines of the blocks before are
    added to that, so no task sorts more than a block of a large file.
    """
    block = Window.partitionBy("file_path", "file_block_start").orderBy("_id")
    before = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("file_path", "file_block_start").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("file_path", "file_block_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_at", F.row_number().over(block) - 1).join(offsets, ["file_path", "file_block_start"])
    return placed.select("file_path", (F.col("_at") + F.col("_before")).cast("long").alias("ordinal"), "value")


def is_subagent_path(path: Column) -> Column:
    return path.rlike("/subagents/")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def discovered_projects(lines: DataFrame, head: int = 20) -> DataFrame:
    """Distinct working directories: of each file the first one named in its first ``head`` lines that aren't blank."""
    place = Window.partitionBy("file_path").orderBy("ordinal")
    named = lines.where(F.trim("value") != "").select("file_path", "ordinal", F.get_json_object("value", "$.cwd").alias("cwd"))  # texts stay where they are
    near = named.withColumn("_n", F.row_number().over(place)).where((F.col("_n") <= head) & F.col("cwd").isNotNull())
    found = near.groupBy("file_path").agg(F.min_by("cwd", "ordinal").alias("cwd"))
    return found.select("cwd").distinct().orderBy("cwd")


# Records.


def at(v: Column, path: str) -> Column:
    """What a record holds at a path; a JSON null is not the same as nothing."""
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def text(v: Column, path: str) -> Column:
    return F.when(kind(at(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def whole(v: Column, path: str) -> Column:
    return F.when(kind(at(v, path)) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def flag(v: Column, path: str) -> Column:
    return F.when(kind(at(v, path)) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def fields(v: Column, path: str = "$") -> Column:
    """An object's values by key; NULL for anything else."""
    return F.try_variant_get(v, path, "map<string,variant>")


def keys(v: Column, path: str) -> Column:
    """An object's keys; NULL for anything else.  Its values are read as arrays of flags, as making them would cost far more than the keys."""
    return F.map_keys(F.try_variant_get(v, path, "map<string,array<boolean>>"))


def unnamed(found: Column, allowed: tuple[str, ...]) -> Column:
    return F.filter(found, lambda key: ~key.isin(*allowed))


def items(v: Column, path: str = "$") -> Column:
    """An array's values; NULL for anything else."""
    return F.try_variant_get(v, path, "array<variant>")


def is_object(v: Column) -> Column:
    return fields(v).isNotNull()


def is_array(v: Column) -> Column:
    return items(v).isNotNull()


def json(v: Column) -> Column:
    """Compact JSON text; nothing is ``null``."""
    return F.coalesce(F.to_json(v), F.lit("null"))


def refusals(lines: DataFrame) -> DataFrame:
    """``ingest_errors`` of lines whose records nobody needs: a filter would judge each line twice, before and after it."""
    return judged(lines).select("file_path", "ordinal", F.inline(F.array_compact(F.array("_fault"))))


def parsed(lines: DataFrame) -> DataFrame:
    """Lines that aren't blank with their record ``v``, and ``level`` and ``reason`` where one is refused."""
    return judged(lines).select(
        "file_path", "ordinal", "v", many_arrays(F.col("_trimmed")).alias("deep"), F.col("_fault.level").alias("level"), F.col("_fault.reason").alias("reason"),
        F.col("_keys1").isNotNull().alias("has_message"), F.col("_keys2").isNotNull().alias("has_usage"),
    )


def stripped(line: Column) -> Column:
    """A line without white space at its ends.  Spark's trim walks the whole text sign by sign, so it is left to lines that need it."""
    edged = functools.reduce(or_, [test(line, F.lit(sign)) for sign in WHITE for test in (F.startswith, F.endswith)])
    return F.when(edged, F.btrim(line, F.lit(WHITE))).otherwise(line)


def judged(lines: DataFrame) -> DataFrame:
    """Lines that aren't blank with their record ``v``, the keys of its levels, and what is wrong with it."""
    spark = lines.sparkSession
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # the last of equal keys counts
    rows = lines.withColumn("_trimmed", stripped(F.col("value"))).where(F.col("_trimmed") != "")
    rows = rows.select("file_path", "ordinal", "_trimmed", F.is_valid_utf8("value").alias("_valid"), F.try_parse_json("_trimmed").alias("v"))
    rows = rows.withColumns({f"_keys{i}": keys(F.col("v"), path) for i, (_, path, _) in enumerate(LEVELS)})  # NULL where there is no object
    found = []
    for i, (name, _, allowed) in enumerate(LEVELS):
        unknown = F.array_min(unnamed(F.col(f"_keys{i}"), allowed))
        found.append(F.when(unknown.isNotNull(), F.struct(F.lit(name).alias("level"), F.concat(F.lit("unknown field "), unknown).alias("reason"))))
    fault = lambda level, reason: F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"))
    first = (
        F.when(~F.col("_valid"), fault("encoding", "not UTF-8")).when(F.col("v").isNull(), fault("decode", "not JSON"))
        .when(F.col("_keys0").isNull(), fault("top-level", "unknown field <non-object>")).otherwise(F.coalesce(*found))
    )
    return rows.withColumn("_fault", first)


def many_arrays(line: Column) -> Column:
    """Whether the text of an error may hold arrays deeper than one round opens; the key can be written with escapes."""
    return (line.contains('"is_error"') | line.contains("\\u")) & (F.length(line) - F.length(F.replace(line, F.lit("["))) > LEVELS_AT_ONCE)


def ingest_errors(records: DataFrame) -> DataFrame:
    return records.where(F.col("level").isNotNull()).select("file_path", "ordinal", "level", "reason")


def record_type(raw: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in schemas.RECORD_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, raw), F.lit("system"))


def flat_leaf(v: Column) -> Column:
    """A string itself, an object's text or else its JSON, nothing for null, JSON for the rest."""
    nothing = v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(True))
    own = F.when(is_object(v), text(v, "$.text"))
    return F.when(nothing, "").when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.coalesce(own, json(v)))


def held(v: Column) -> Column:
    """The items of an array, or else the value alone."""
    return F.coalesce(items(v), F.array(v))


def opened(items: Column, levels: int = LEVELS_AT_ONCE) -> Column:
    """Values, in order, with the arrays among them replaced by their items, ``levels`` times."""
    for _ in range(levels):
        items = F.flatten(F.transform(items, held))
    return items


def flat_text(items: Column) -> Column:
    """The texts of values without arrays, joined by line feeds, empty ones dropped."""
    return F.array_join(F.filter(F.transform(items, flat_leaf), lambda p: p != ""), "\n")


def all_opened(rows: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """``rows`` whose array of values ``name`` has no array left in it, and the paths that hold them.

    Each round opens LEVELS_AT_ONCE levels and writes the rows, so arrays may lie
    in each other as deep as they like.
    """
    paths: list[str] = []
    while True:
        rows, at = written(rows.withColumn(name, opened(F.col(name))), "opened")
        paths.append(at)
        if not rows.where(F.exists(name, is_array)).limit(1).count():
            return rows, paths


def messages(records: DataFrame) -> DataFrame:
    """Normalised messages of accepted records."""
    return normalised(records).where(F.col("level").isNull())


def normalised(records: DataFrame) -> DataFrame:
    """Records as messages, with what derivation needs of them (``blocks``, ``read_file``); refused ones keep ``level`` and ``reason``."""
    v = F.col("v")
    content = F.coalesce(F.when(F.col("has_message"), at(v, "$.message.content")), at(v, "$.content"))
    usage = lambda name: F.when(F.col("has_usage"), whole(v, f"$.message.usage.{name}"))
    rows = records.withColumn("_c", content).withColumns({"_items": items(F.col("_c")), "_json": F.to_json("_c")})
    c, form = F.col("_c"), F.substring("_json", 1, 1)
    wrapped = F.when(form == '"', F.concat(F.lit('{"text":'), "_json", F.lit("}"))).when(form == "[", F.concat(F.lit('{"blocks":'), "_json", F.lit("}"))).otherwise(F.coalesce("_json", F.lit("null")))
    blocks = F.coalesce("_items", items(c, "$.blocks"))
    plain = F.when(form == '"', F.try_variant_get(c, "$", "string")).when(form == "{", F.coalesce(text(c, "$.text"), "_json")).when(form == "[", wrapped)
    searched = plain.otherwise(F.when(F.coalesce("_json", F.lit("null")) == "null", "").otherwise(F.col("_json")))
    stamp = instant(text(v, "$.timestamp"))
    return rows.select(
        "file_path", "ordinal", "level", "reason", text(v, "$.uuid").alias("uuid"), text(v, "$.parentUuid").alias("parent_uuid"), text(v, "$.message.id").alias("message_id"),
        record_type(text(v, "$.type")).alias("record_type"), text(v, "$.message.role").alias("role"), wrapped.alias("content"),
        searched.alias("search_text"), F.to_json(v).alias("raw_payload"), stamp.alias("stamp"), rfc3339(stamp).alias("timestamp"),
        F.coalesce(flag(v, "$.isSidechain"), F.lit(False)).alias("is_sidechain"), text(v, "$.agentId").alias("agent_id"),
        F.coalesce(text(v, "$.toolUseID"), text(v, "$.toolUseId")).alias("tool_use_id"), F.coalesce(text(v, "$.parentToolUseID"), text(v, "$.parentToolUseId")).alias("parent_tool_use_id"),
        usage("input_tokens").alias("input_tokens"), usage("output_tokens").alias("output_tokens"), usage("cache_read_input_tokens").alias("cache_read_input_tokens"),
        usage("cache_creation_input_tokens").alias("cache_creation_input_tokens"), text(v, "$.message.model").alias("model"),
        text(v, "$.sessionId").alias("record_session_id"), text(v, "$.slug").alias("slug"), text(v, "$.cwd").alias("cwd"), text(v, "$.gitBranch").alias("git_branch"), text(v, "$.version").alias("version"),
        blocks.alias("blocks"), at(v, "$.toolUseResult.file").alias("read_file"), "deep",
    )


# Sessions.


def with_alias(cwds: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """(cwd, project_alias) of distinct ``cwd``s: the deepest configured path above it, or else its last component.

    Each ``cwd`` is taken apart into all paths above it, which meet those of
    ``projects`` (alias, path) by equality; of equal paths the last alias counts.
    """
    own = F.coalesce(last_component(F.col("cwd")), F.lit("unknown"))
    if projects is None:
        return cwds.select("cwd", own.alias("project_alias"))
    path = F.when(F.col("path") == "/", "/").otherwise(F.regexp_replace("path", "/+$", ""))
    named = projects.select("alias", path.alias("path"))
    parts = F.split("cwd", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    above = F.transform(heads, lambda p: F.when((p == "") & F.col("cwd").startswith("/"), "/").otherwise(p))
    found = cwds.select("cwd", F.explode(F.array_distinct(F.array_append(above, F.col("cwd")))).alias("path")).join(named, "path")
    best = found.groupBy("cwd").agg(F.max_by("alias", F.struct(F.length("path"), "alias")).alias("alias"))
    return cwds.join(best, "cwd", "left").select("cwd", F.coalesce("alias", own).alias("project_alias"))


def sessions(msgs: DataFrame, projects: DataFrame | None = None, link_subagents: bool = True) -> DataFrame:
    """One session for each session id, of whose files the last by path counts."""
    return last_files(file_sessions(file_facts(msgs), projects, link_subagents))


def last_files(found: DataFrame) -> DataFrame:
    last = found.groupBy("id").agg(F.max_by(F.struct(*[c for c in found.columns if c != "id"]), "transcript_path").alias("s"))
    return last.select("id", "s.*")


def file_facts(msgs: DataFrame) -> DataFrame:
    """What the messages of each file say of its session."""
    place = Window.partitionBy("file_path").orderBy("ordinal")
    rows = msgs.withColumn("_n", F.row_number().over(place))
    first = lambda c: F.min_by(c, F.when((F.col("_n") <= FACT_MESSAGES) & F.col(c).isNotNull(), F.col("ordinal")))
    timed = F.when(F.col("timestamp").isNotNull(), F.col("ordinal"))
    return rows.groupBy("file_path").agg(
        *[first(c).alias(c) for c in ("record_session_id", "agent_id", "cwd", "slug", "git_branch", "version")],
        F.min_by("timestamp", timed).alias("started_at"), F.max_by("timestamp", timed).alias("ended_at"), F.count("*").alias("message_count"),
    )


def file_sessions(facts: DataFrame, projects: DataFrame | None = None, link_subagents: bool = True) -> DataFrame:
    """One session for each file of ``file_facts``."""
    subagent = is_subagent_path(F.col("file_path"))
    facts = facts.withColumns(
        {
            "agent_id": F.coalesce("agent_id", F.when(subagent, F.regexp_replace(stem(F.col("file_path")), "^agent-", ""))),
            "external_session_id": F.coalesce("record_session_id", stem(F.col("file_path"))),
        }
    )
    named = lambda child: F.when(child, F.concat("external_session_id", F.lit(":agent:"), F.coalesce("agent_id", F.lit("unknown")))).otherwise(F.col("external_session_id"))
    if link_subagents:
        parents = facts.select(F.col("file_path").alias("_parent"), named(F.col("agent_id").isNotNull()).alias("parent_session_id"))
        facts = facts.withColumn("_parent", F.when(subagent, F.regexp_replace("file_path", "/subagents/.*$", ".jsonl"))).join(parents, "_parent", "left")
    else:
        facts = facts.withColumn("parent_session_id", F.lit(None).cast("string"))
    child = F.col("parent_session_id").isNotNull() | F.col("agent_id").isNotNull()
    aliases = with_alias(facts.select("cwd").where(F.col("cwd").isNotNull()).distinct(), projects)
    return facts.join(aliases, "cwd", "left").select(
        named(child).alias("id"), "external_session_id", "parent_session_id", child.alias("is_subagent"), "agent_id", F.coalesce("project_alias", F.lit("unknown")).alias("project_alias"),
        F.col("file_path").alias("transcript_path"), "cwd", "slug", "git_branch", "version", "started_at", "ended_at", "message_count",
    )


# Runs.


def input_summary(v: Column) -> Column:
    parts = []
    for key in ("file_path", "pattern", "command", "description"):
        value = at(v, f"$.{key}")
        shown = F.coalesce(text(v, f"$.{key}"), F.to_json(value))
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"{key}="), truncated(shown, 80))))
    kept = F.array_compact(F.array(*parts))
    return F.when(is_object(v) & (F.size(kept) > 0), truncated(F.array_join(kept, ", "), 200))


def tool_parts(msgs: DataFrame) -> DataFrame:
    """(file_path, tool_use_id, u, r): the call and the result of each id; of several the last by place counts.

    Calls and results meet in one aggregation, which is their full outer join.
    The texts of errors with deeply nested arrays are made apart.
    """
    rows = part_rows(msgs.where(~F.col("deep")), None)
    if msgs.where("deep").limit(1).count():
        rows = rows.unionByName(part_rows(msgs.where("deep"), deep_texts(msgs.where("deep"))))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c)
    return rows.groupBy("file_path", "tool_use_id").agg(last("u"), last("r"))


def deep_texts(msgs: DataFrame) -> DataFrame:
    """(file_path, ordinal, pos, text): the flat texts of the contents of errors."""
    b = F.col("b")
    told = msgs.select("file_path", "ordinal", F.posexplode("blocks").alias("pos", "b")).where(F.coalesce(flag(b, "$.is_error"), F.lit(False)) & (text(b, "$.type") == "tool_result"))
    rows, _ = all_opened(told.select("file_path", "ordinal", "pos", F.array(at(b, "$.content")).alias("items")), "items")
    return rows.select("file_path", "ordinal", "pos", flat_text(F.col("items")).alias("text"))


def part_rows(msgs: DataFrame, texts: DataFrame | None) -> DataFrame:
    """(file_path, tool_use_id, place, u, r) of each block that is a call or a result; ``texts`` are flat texts made before."""
    scope = F.when(is_subagent_path(F.col("file_path")), F.concat(F.lit("subagent:"), F.coalesce("agent_id", F.regexp_replace(stem(F.col("file_path")), "^agent-", "")))).otherwise("main")
    blocks = msgs.select("file_path", "ordinal", "stamp", "agent_id", scope.alias("scope"), "read_file", F.posexplode("blocks").alias("pos", "b"))
    blocks = blocks.withColumn("text", F.lit(None).cast("string")) if texts is None else blocks.join(texts, ["file_path", "ordinal", "pos"], "left")
    b = F.col("b")
    blocks = blocks.withColumn("_type", text(b, "$.type")).where(F.col("_type").isin("tool_use", "tool_result"))
    is_use, is_result = F.col("_type") == "tool_use", F.col("_type") == "tool_result"
    error, body = F.coalesce(flag(b, "$.is_error"), F.lit(False)), at(b, "$.content")
    use = F.struct("ordinal", "stamp", F.col("agent_id").alias("agent"), "scope", text(b, "$.name").alias("name"), F.to_json(at(b, "$.input")).alias("input"))
    result = F.struct(
        "ordinal", "stamp", error.alias("error"), F.when(error, truncated(F.coalesce("text", flat_text(opened(F.array(body)))), 2000)).alias("error_content"), F.octet_length(json(body)).cast("long").alias("size"),
        whole(F.col("read_file"), "$.totalLines").alias("total"), whole(F.col("read_file"), "$.numLines").alias("lines"), flag(F.col("read_file"), "$.truncatedByTokenCap").alias("cut"),
    )
    return blocks.select(
        "file_path", F.when(is_use, text(b, "$.id")).otherwise(text(b, "$.tool_use_id")).alias("tool_use_id"), F.struct("ordinal", "pos").alias("place"),
        F.when(is_use, use).alias("u"), F.when(is_result, result).alias("r"),
    ).where(F.col("tool_use_id").isNotNull())


def derived_runs(msgs: DataFrame, session_rows: DataFrame) -> DataFrame:
    """Tool runs: each call with its result, calls without one (ongoing), results without a call (orphan)."""
    both = tool_parts(msgs).withColumn("i", F.try_parse_json("u.input"))
    used, told, i = F.col("u").isNotNull(), F.col("r").isNotNull(), F.col("i")
    rows = both.withColumn("command", truncated(text(i, "$.command"), 500))
    words = tokens(F.col("command"))
    none = F.array().cast("array<string>")
    named = F.array_compact(F.array(text(i, "$.file_path"), text(i, "$.path")))
    paths = F.array_sort(F.array_distinct(F.concat(named, F.coalesce(command_paths(F.col("command")), none))))
    status = F.when(~used, "orphan").when(~told, "ongoing").when(F.col("r.error"), "error").otherwise("completed")
    read = lambda c: F.when(used, F.col(f"r.{c}"))
    facts = session_rows.select(
        F.col("transcript_path").alias("file_path"), F.col("id").alias("session_id"), "external_session_id", "parent_session_id", "is_subagent",
        F.col("agent_id").alias("_agent"), "project_alias", "cwd",
    )
    return rows.join(facts, "file_path").select(
        "tool_use_id", "session_id", "external_session_id", "parent_session_id", "is_subagent", F.coalesce("u.agent", "_agent").alias("agent_id"),
        F.coalesce("u.name", F.lit("Unknown")).alias("tool_name"), "command", F.try_element_at(words, F.lit(1)).alias("command_program"),
        F.coalesce(F.slice(words, 2, 2**31 - 1), none).alias("command_args"), command_fingerprint(F.col("command")).alias("command_fingerprint"),
        input_summary(i).alias("input_summary"), F.when(used, F.octet_length(F.coalesce("u.input", F.lit("null"))).cast("long")).alias("input_size"), F.col("r.size").alias("output_size"),
        F.coalesce(paths, none).alias("file_paths"), status.alias("status"), rfc3339(F.col("u.stamp")).alias("started_at"), rfc3339(F.col("r.stamp")).alias("finished_at"),
        F.when(used & told, millis_between(F.col("u.stamp"), F.col("r.stamp"))).alias("duration_ms"), F.col("u.ordinal").alias("start_ordinal"), F.col("r.ordinal").alias("end_ordinal"),
        F.col("u.scope").alias("source_scope"), F.col("r.error_content").alias("error_content"), "project_alias", last_component(F.col("cwd")).alias("worktree_name"), F.col("cwd").alias("canonical_cwd"),
        read("total").alias("read_total_lines"), read("lines").alias("read_lines"), read("cut").alias("read_truncated"),
    )


@dataclass(frozen=True)
class Loaded:
    """What transcripts hold; ``errors`` names what was refused, and its files are missing from the rest.

    ``files`` (file_path, id) has each accepted file with its session, also where another file of that session counts.

    All of it reads one snapshot in the shared folder, which ``close`` (or the
    end of a ``with`` block) removes.
    """

    sessions: DataFrame
    messages: DataFrame
    runs: DataFrame
    errors: DataFrame
    files: DataFrame
    paths: tuple[str, ...]

    def __enter__(self) -> Loaded:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        for path in self.paths:
            remove(self.errors.sparkSession, path)


class BadTranscripts(ValueError):
    """Raised on request when a file is refused."""


#: What sessions and runs are made of; the other columns of messages are left out where nobody asks for them.
NARROW = (
    "file_path", "ordinal", "level", "reason", "stamp", "timestamp", "agent_id", "record_session_id", "slug", "cwd", "git_branch", "version", "blocks", "read_file", "deep",
)
#: Those of them that runs alone are made of.
OF_RUNS = ("stamp", "blocks", "read_file", "deep")


def load(
    lines: DataFrame, projects: DataFrame | None = None, link_subagents: bool = True, fail_fast: bool = False, with_messages: bool | tuple[str, ...] = True, with_runs: bool = True
) -> Loaded:
    """Sessions, messages and runs of transcript lines (file_path, ordinal, value).

    Files are read and records parsed once: the normalised ones are written to
    a new path of the shared folder, and so are the sessions, which are few.
    All results read them there: they agree with each other also when a file
    grows meanwhile, a lost executor costs nothing, and the next ``load`` reads
    the files anew.  Only what is asked for is made and written: ``with_messages``
    is False, or names the columns of messages that are wanted; runs are empty
    where ``with_runs`` is False.
    """
    spark = lines.sparkSession
    stored = tuple(c.split()[0] for c in schemas.MESSAGES.replace("\n", " ").split(",") if c.strip())
    wanted = stored if with_messages is True else tuple(with_messages or ())
    if unknown := sorted(set(wanted) - set(stored)):
        raise ValueError(f"messages have no column {', '.join(unknown)}")
    needed = {*wanted, *NARROW} - (set() if with_runs else {*OF_RUNS} - {*wanted})
    fresh = normalised(parsed(lines))
    records, at = packed(fresh.select(*[c for c in fresh.columns if c in needed]), "records")
    errors = ingest_errors(records)
    if fail_fast and (first := errors.orderBy("file_path", "ordinal").first()):
        remove(spark, at)
        raise BadTranscripts(f"{first['file_path']}:{first['ordinal'] + 1}: {first['level']}: {first['reason']}")
    bad = errors.select("file_path").distinct()
    msgs = records.join(bad, "file_path", "left_anti") if errors.limit(1).count() else records
    facts, facts_at = packed(file_facts(msgs), "facts")
    all_files, sessions_at = packed(file_sessions(facts, projects, link_subagents), "sessions")
    remove(spark, facts_at)
    session_rows = last_files(all_files)
    named = session_rows.select(F.col("id").alias("session_id"), F.col("transcript_path").alias("file_path"))
    message_rows = msgs.join(named, "file_path").select(*wanted) if wanted else spark.createDataFrame([], schemas.MESSAGES)
    run_rows = derived_runs(msgs, session_rows) if with_runs else spark.createDataFrame([], schemas.RUNS)
    files = all_files.select(F.col("transcript_path").alias("file_path"), "id")
    return Loaded(session_rows, message_rows, run_rows, errors, files, (at, sessions_at))
