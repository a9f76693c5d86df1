"""Command line over stored transcripts (``transcripts``) or files read on the spot (``scan``)."""

from __future__ import annotations

import argparse
import signal
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as configuration
from .operators import content, errors, health, runs
from .plans.filters import RunFilters
from .render import render
from .sources import transcripts
from .sources.store import Store

FILTERS = ("project", "worktree", "session", "tool", "command_contains", "error_contains", "file_path", "status", "since")
NUMBERS = ("min_duration", "max_duration", "min_read_lines")


def with_filters(parser: argparse.ArgumentParser, limit: int | None = None) -> None:
    for name in FILTERS:
        parser.add_argument(f"--{name.replace('_', '-')}")
    for name in NUMBERS:
        parser.add_argument(f"--{name.replace('_', '-')}", type=int)
    if limit is not None:
        parser.add_argument("--limit", type=int, default=limit)


def filters_of(args: argparse.Namespace) -> RunFilters:
    return RunFilters(**{n: getattr(args, n, None) for n in (*FILTERS, *NUMBERS, "limit")})


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracelake", description=__doc__)
    top.add_argument("--store")
    top.add_argument("--config")
    areas = top.add_subparsers(dest="area", required=True)

    projects = areas.add_parser("projects").add_subparsers(dest="verb", required=True)
    projects.add_parser("list")
    for verb, names in (("add", ("alias", "path")), ("remove", ("alias",)), ("alias", ("old", "new"))):
        sub = projects.add_parser(verb)
        for n in names:
            sub.add_argument(n)
    init = areas.add_parser("init")
    init.add_argument("--root", help="folder of transcripts; the first default one if not given")
    init.add_argument("--yes", action="store_true")
    init.add_argument("--choose", default="all", help="all, or numbers from 1, comma-separated")

    for area in ("transcripts", "scan"):
        verbs = areas.add_parser(area).add_subparsers(dest="verb")

        def verb(name: str, area: str = area, verbs=verbs) -> argparse.ArgumentParser:
            sub = verbs.add_parser(name)
            sub.add_argument("--format", default="json" if name == "read-scores" else "table")
            if area == "scan":
                sub.add_argument("--file", action="append", default=[])
                sub.add_argument("--root", action="append", default=[])
                sub.add_argument("--no-subagents", action="store_true")
            return sub

        if area == "transcripts":
            sync = verbs.add_parser("sync")
            sync.add_argument("--file", action="append", default=[])
            sync.add_argument("--root", action="append", default=[])
            sync.add_argument("--configured", action="store_true")
            sync.add_argument("--session")
        search = verb("search")
        with_filters(search, 50)
        search.add_argument("--content-contains")
        search.add_argument("--mode", choices=("substring", "phrase"), default="substring")
        search.add_argument("--group-by-session", action="store_true")
        inspect = verb("inspect")
        inspect.add_argument("session_id")
        inspect.add_argument("--tool-use-id")
        inspect.add_argument("--status")
        inspect.add_argument("--context", type=int)
        inspect.add_argument("--messages", action="store_true")
        compare = verb("compare")
        compare.add_argument("--left", required=True)
        compare.add_argument("--right", required=True)
        compare.add_argument("--group-by", default="tool_name")
        with_filters(compare)
        aggregate = verb("aggregate")
        aggregate.add_argument("--group-by", default="tool_name")
        with_filters(aggregate)
        audit = verb("audit")
        audit.add_argument("--limit", type=int, default=20)
        if area == "transcripts":
            for name in ("file", "session", "project"):
                audit.add_argument(f"--{name}")
        failures = verb("errors")
        failures.add_argument("--top", type=int, default=20)
        failures.add_argument("--classify", action="store_true")
        with_filters(failures)
        state = verb("health")
        state.add_argument("--session")
        state.add_argument("--project")
        state.add_argument("--since")
        state.add_argument("--limit", type=int, default=50)
        sequences = verb("sequences")
        for name, value in (("min-length", 2), ("max-length", 4), ("min-occurrences", 2)):
            sequences.add_argument(f"--{name}", type=int, default=value)
        sequences.add_argument("--recovery", action="store_true")
        with_filters(sequences)
        if area == "scan":
            reads = verb("read-scores")
            reads.add_argument("--under")
            reads.add_argument("--ext")
            reads.add_argument("--half-life-days", type=float, default=14.0)
            reads.add_argument("--now")
            reads.add_argument("--limit", type=int)
    return top


class Failure(SystemExit):
    """A message for the user and exit code 1."""


def one_session(sessions: DataFrame, wanted: str):
    found = sessions.where((F.col("id") == wanted) | (F.col("external_session_id") == wanted)).orderBy("is_subagent", "id").first()
    if found is None:
        raise Failure(f"Session not found: {wanted}")
    return found


def analyse(args: argparse.Namespace, sessions: DataFrame, messages: DataFrame, rows: DataFrame, lines: DataFrame | None, listing: DataFrame | None = None):
    """The result of a verb."""
    f = filters_of(args)
    if args.verb == "search":
        if args.content_contains is not None:
            return content.search_content(messages, sessions, args.content_contains, args.limit, args.mode)
        return runs.session_groups(runs.search(rows, f)) if args.group_by_session else runs.search(rows, f)
    if args.verb == "inspect":
        s = one_session(sessions, args.session_id)
        found = runs.inspect(rows, s["id"], s["is_subagent"], args.tool_use_id, args.status, args.context)
        return {"runs": found, "messages": runs.context_messages(messages, found)} if args.messages else found
    if args.verb == "compare":
        return runs.compare(rows, args.left.split(","), args.right.split(","), args.group_by, f)
    if args.verb == "aggregate":
        return runs.aggregate(rows, args.group_by.split(","), f)
    if args.verb == "errors":
        return {"summary": errors.summary(rows, f), "patterns": errors.patterns(rows, f, args.top, args.classify)}
    if args.verb == "health":
        if args.session:
            s = one_session(sessions, args.session)
            own = messages.where(F.col("session_id") == s["id"])
            return {"summary": health.sessions(own), "jumps": health.jumps(own), "cache_misses": health.cache_misses(own)}
        return health.project(sessions, messages, args.project, args.since, args.limit)
    if args.verb == "sequences":
        out = {
            "frequent_sequences": errors.ngrams(rows, f, args.min_length, args.max_length, args.min_occurrences),
            "retry_patterns": errors.retries(rows, f, args.min_occurrences),
        }
        return out | ({"recovery_stats": errors.recovery(rows, f)} if args.recovery else {})
    if args.verb == "read-scores":
        now = args.now or rows.sparkSession.range(1).select(F.current_timestamp().cast("string")).first()[0]
        scores = content.read_scores(rows, now, args.half_life_days, args.under, args.ext)
        return {"totals": content.read_totals(scores), "files": scores if args.limit is None else scores.limit(args.limit)}
    if args.verb == "audit":
        stored = sessions if args.area == "transcripts" else None
        return content.audit(lines, transcripts.messages(transcripts.parsed(lines)), stored, listing).limit(args.limit)
    raise Failure(f"unknown verb {args.verb}")


def audit_stored(args: argparse.Namespace, spark: SparkSession, store: Store):
    """Audit of one file by name, one session's, a project's, or the first ones stored; only files that are still there are read."""
    chosen = store.sessions
    if args.file:
        chosen = chosen.where(F.col("transcript_path") == args.file)
    if args.session:
        chosen = chosen.where(F.col("id") == one_session(chosen, args.session)["id"])
    if args.project:
        chosen = chosen.where(F.col("project_alias") == args.project)
    chosen = chosen.orderBy("transcript_path").limit(args.limit)
    paths = [args.file] if args.file else [r["transcript_path"] for r in chosen.select("transcript_path").collect()]  # `limit` at most
    listing = transcripts.listing(spark, *paths)
    there = [r["file_path"] for r in listing.select("file_path").collect()]
    if not paths or args.file and not there and not chosen.count():
        raise Failure("nothing stored that matches")
    lines = transcripts.read_lines(spark, *there) if there else spark.createDataFrame([], "file_path string, ordinal bigint, value string")
    return analyse(args, chosen, store.messages, store.runs, lines, listing)


def paths_of(args: argparse.Namespace, cfg: configuration.Config) -> list[str]:
    """Files and folders given, or else the folders of transcripts that are configured or usual."""
    return sorted({*args.file, *args.root}) or sorted(cfg.transcript_roots())


def sync(args: argparse.Namespace, spark: SparkSession, store: Store, cfg: configuration.Config) -> str:
    if args.file or args.root:
        paths = paths_of(args, cfg)
    elif args.configured or args.session:
        paths = sorted(cfg.transcript_roots())
    else:
        paths = []
    if not paths:
        raise Failure("nothing to sync: give --file, --root or --configured, or configure transcript_roots")
    lines = transcripts.read_lines(spark, *paths)
    if args.session:
        lines = lines.where(transcripts.stem(F.col("file_path")) == args.session)
    projects = cfg.frame(spark)
    if projects is not None:
        store.save_projects(projects)
    with transcripts.load(lines, projects, fail_fast=bool(args.file) and not args.root) as loaded:
        store.replace(loaded)
        failed = render(loaded.errors.dropDuplicates(["file_path"]).orderBy("file_path"))
        stored = loaded.sessions.count()
    if args.session and not stored and failed == "(none)":
        raise Failure(f"Session not found: {args.session}")
    said = f"{stored} sessions stored"
    if failed != "(none)":
        raise Failure(f"{said}; refused:\n{failed}")
    return said


def manage(args: argparse.Namespace, cfg: configuration.Config) -> str:
    if args.verb == "list":
        return "\n".join(f"{a}  {p}" for a, p in sorted(cfg.projects.items())) or "(none)"
    {"add": lambda: cfg.add(args.alias, args.path), "remove": lambda: cfg.remove(args.alias), "alias": lambda: cfg.rename(args.old, args.new)}[args.verb]()
    cfg.write()
    return "saved"


def initialise(args: argparse.Namespace, spark: SparkSession, cfg: configuration.Config) -> str:
    """Name the working directories that the transcripts below a root come from."""
    roots = [args.root] if args.root else cfg.transcript_roots()[:1]
    if not roots:
        raise Failure("no folder of transcripts: give --root")
    found = [r["cwd"] for r in transcripts.discovered_projects(transcripts.read_lines(spark, *roots)).collect()]
    if args.choose == "all":
        chosen = found
    else:
        numbers = list(dict.fromkeys(int(n) for n in args.choose.split(",")))
        if not all(1 <= n <= len(found) for n in numbers):
            raise Failure(f"choose numbers from 1 to {len(found)}")
        chosen = [found[n - 1] for n in numbers]
    if not args.yes:
        return "\n".join(f"{i}  {p}" for i, p in enumerate(found, 1)) or "(none)"
    cfg.roots = cfg.roots or roots
    for cwd in chosen:
        cfg.add(cwd.rstrip("/").rsplit("/", 1)[-1] or "root", cwd)
    cfg.write()
    return f"{len(chosen)} projects saved"


def reads_messages(args: argparse.Namespace) -> bool:
    """Whether a verb looks at messages, not at runs and sessions alone."""
    return args.verb == "health" or getattr(args, "messages", False) or getattr(args, "content_contains", None) is not None


def run(argv: Sequence[str], spark: SparkSession | None = None) -> str:
    args = parser().parse_args(argv)
    cfg = configuration.Config.read(configuration.config_path(args.config))
    if args.area == "projects":
        return manage(args, cfg)
    if args.area in ("transcripts", "scan") and args.verb is None:
        verbs = "search inspect compare aggregate audit errors health sequences"
        return f"{args.area}: {'sync ' if args.area == 'transcripts' else ''}{verbs}{' read-scores' if args.area == 'scan' else ''}"
    spark = spark or SparkSession.builder.appName("tracelake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    signal.signal(signal.SIGINT, lambda *_: spark.sparkContext.cancelAllJobs())
    if args.area == "init":
        return initialise(args, spark, cfg)
    if args.area == "scan":
        if not (paths := paths_of(args, cfg)):
            raise Failure("give --file or --root")
        lines = transcripts.read_lines(spark, *paths, subagents=not args.no_subagents)
        with transcripts.load(lines, cfg.frame(spark), with_messages=reads_messages(args)) as loaded:
            refused = render(loaded.errors.orderBy("file_path", "ordinal"))
            if refused != "(none)":
                print(refused, file=sys.stderr)
            return render(analyse(args, loaded.sessions, loaded.messages, loaded.runs, lines), args.format)
    store = Store(spark, configuration.store_path(args.store))
    if args.verb == "sync":
        return sync(args, spark, store, cfg)
    if args.verb == "audit":
        return render(audit_stored(args, spark, store), args.format)
    messages, rows = store.messages, store.runs
    if wanted := args.session_id if args.verb == "inspect" else args.session if args.verb == "health" else None:
        s = one_session(store.sessions, wanted)
        messages, rows = store.family("messages", s["id"]), store.family("runs", s["id"])
    return render(analyse(args, store.sessions, messages, rows, None), args.format)


def main() -> None:
    print(run(sys.argv[1:]))


if __name__ == "__main__":
    main()
