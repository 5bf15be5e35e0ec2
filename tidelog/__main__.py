"""Command line: run, replay, query, summary, generate, memory, config validate, hooks test."""

from __future__ import annotations

import argparse
import dataclasses
import sys
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import config, memory
from .operators import alerts, query, replay
from .session import local_session, prepare, stored
from .sources import corpus, hooks, targets
from .streaming import live

#: Exit codes.
OK, FAILED, USAGE, BAD_CONFIG = 0, 1, 2, 3


def show(rows: DataFrame) -> None:
    for row in rows.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def report(rows: list) -> None:
    for r in rows:
        if r.failed:
            print(f"tidelog: {r.hook}: {r.failed} of {r.sent + r.failed} alerts didn't arrive ({r.why})", file=sys.stderr)


def do_run(args: argparse.Namespace, settings: config.Settings, lines: DataFrame) -> None:
    """Follow a target and print alerts as they come, until it is stopped; with --once, until what is there is done."""
    how = {"trigger": {"availableNow": True}, "flush_s": 0.0} if args.once else {}  # what is there ends with whole records
    query = live.run(lines, args.state, settings, emit=lambda out: show(out.select("payload")), **how)
    query.awaitTermination()


def do_replay(args: argparse.Namespace, settings: config.Settings, events: DataFrame) -> None:
    """Each target alone, as JSON lines."""
    out = replay.replay(events, settings)
    show(out.select("explain" if args.explain else "payload"))
    if settings.hooks:
        report(hooks.deliveries(out, list(settings.hooks)).collect())
    if args.suggest is not None:
        span = events.agg((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6).first()[0]
        show(alerts.suggested_thresholds(out, span or 0.0, args.suggest))


def do_query(args: argparse.Namespace, settings: config.Settings, events: DataFrame) -> None:
    given = dict(p.split("=", 1) for p in args.where)
    found = query.execute(events, query.parse_query(given))
    if args.by:
        show(query.top_n(query.aggregate(found, args.by), args.limit))
    elif args.bucket:
        show(query.bars(query.histogram(found, args.bucket)).orderBy("bucket"))
    else:
        show(query.last_n(found, args.limit).orderBy("seq").select("ts", "level", "source", "message"))


def do_summary(args: argparse.Namespace, settings: config.Settings, events: DataFrame) -> None:
    """Totals, shares, alerts of the whole, and the most frequent templates."""
    events = stored(events, "events")
    show(query.totals(events))
    show(query.report(events, replay.replay(events, dataclasses.replace(settings, hooks=(), baseline_path=""))))
    show(query.summary(events, args.limit))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("tidelog")
    top.add_argument("--config")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("replay", "query", "summary"):
        p = sub.add_parser(name)
        p.add_argument("targets", nargs="+")
        p.add_argument("--spool", help="shared folder for standard input")
        p.add_argument("--limit", type=int, default=20)
    p = sub.add_parser("run")
    p.add_argument("targets", nargs=1)
    p.add_argument("--spool", help="shared folder for standard input")
    p.add_argument("--state", required=True, help="shared folder for lines, alerts and checkpoints")
    p.add_argument("--once", action="store_true")
    sub.choices["replay"].add_argument("--suggest", type=float, metavar="PER_HOUR")
    sub.choices["replay"].add_argument("--explain", action="store_true")
    sub.choices["query"].add_argument("--where", action="append", default=[], metavar="NAME=VALUE")
    sub.choices["query"].add_argument("--by")
    sub.choices["query"].add_argument("--bucket", type=float)
    p = sub.add_parser("generate")
    p.add_argument("folder")
    p.add_argument("--lines", type=int, default=100_000)
    p.add_argument("--seed", type=int, default=7)
    p = sub.add_parser("memory")
    p.add_argument("logs", help="Spark's event logs of a run")
    p.add_argument("--ceiling-mb", type=int, default=600)
    sub.add_parser("config").add_argument("action", choices=["validate"])
    sub.add_parser("hooks").add_argument("action", choices=["test"])
    return top


ACTIONS: dict[str, Callable] = {"replay": do_replay, "query": do_query, "summary": do_summary}


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else OK
    try:
        settings = config.load(args.config) if args.config else config.Settings()
    except (config.ConfigError, OSError) as e:
        print(f"tidelog: {e}", file=sys.stderr)
        return BAD_CONFIG
    if args.command == "config":
        return OK
    if args.command == "hooks":
        return FAILED if any(hooks.attempt(hooks.dry(h), '{"schema": "tidelog.alert/1", "detector": "test"}') for h in settings.hooks) else OK
    spark = prepare(local_session())
    try:
        if args.command == "memory":
            show(memory.peaks(spark, args.logs).orderBy("executor", "metric"))
            if not memory.above(spark, args.logs, args.ceiling_mb << 20).isEmpty():
                print(f"tidelog: more than {args.ceiling_mb} MB of heap", file=sys.stderr)
                return FAILED
        elif args.command == "generate":
            made = corpus.Corpus(args.lines, args.seed)
            corpus.generate(spark, made).select("source", F.col("text").alias("value")).write.partitionBy("source").text(f"{args.folder}/lines")
            corpus.labels(spark, made).write.json(f"{args.folder}/labels")
        else:
            for target in args.targets:
                what, spool = targets.Target.parse(target), args.spool or tempfile.mkdtemp(prefix="tidelog-stdin-")
                if args.command == "run":
                    do_run(args, settings, targets.stream(spark, what, spool, args.once))
                else:
                    ACTIONS[args.command](args, settings, replay.events_of(targets.read(spark, what, spool), settings))
    except (query.QueryError, OSError, ValueError) as e:
        print(f"tidelog: {e}", file=sys.stderr)
        return USAGE if isinstance(e, query.QueryError) else FAILED
    return OK


if __name__ == "__main__":
    sys.exit(main())
