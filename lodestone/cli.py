"""The command line: check, index, search, graph, init and refine, with lines or JSON, and exit codes 0 and 1."""

from __future__ import annotations

import argparse
import datetime
import json
import sys
import warnings
from collections.abc import Sequence
from pathlib import Path

VERSION = "0.2.0"
SCOPED = ("backlinks", "links", "descendants", "ancestors", "related")


def _whole(value: str) -> int:
    if not value.lstrip("+").isdigit() or int(value) < 1:
        raise argparse.ArgumentTypeError(f"must be a positive integer, not {value}")
    return int(value)


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    for name, says in (("config", "configuration file"), ("vault", "folder of notes"), ("root", "folder that code references start from"), ("index", "folder of the index (default: .lodestone/index in the vault)")):
        shared.add_argument(f"--{name}", help=says)
    shared.add_argument("--json", action="store_true", help="one JSON value instead of lines")
    top = argparse.ArgumentParser(prog="lodestone", description="Check, index, search and query a vault of notes.")
    top.add_argument("--version", action="version", version=VERSION)
    verbs = top.add_subparsers(dest="verb")
    verbs.add_parser("check", parents=[shared], help="validate the vault (what is done without a verb)")
    for name in ("index", "search-index"):
        one = verbs.add_parser(name, parents=[shared], help="build the index and the files beside the notes")
        one.add_argument("--full", action="store_true", help="reuse nothing of the last index")
    one = verbs.add_parser("search", parents=[shared], help="search the index")
    one.add_argument("query")
    one.add_argument("--mode", choices=("fts", "vector", "hybrid"))
    one.add_argument("--limit", type=_whole)
    one.add_argument("--status")
    one.add_argument("--tag", action="append", default=[])
    one.add_argument("--audience", action="append", default=[])
    one.add_argument("--rebuild", action="store_true", help="build the index first if it is behind")
    one = verbs.add_parser("graph", parents=[shared], help="query links, hierarchy and code references")
    one.add_argument("command", choices=(*SCOPED, "orphans", "impact", "cycles"))
    one.add_argument("note", nargs="?")
    for name in ("limit", "depth"):
        one.add_argument(f"--{name}", type=_whole)
    for name in ("file", "symbol"):
        one.add_argument(f"--{name}")
    one = verbs.add_parser("init", parents=[shared], help="write a vault to start from")
    one.add_argument("--owner", default="team")
    refine = verbs.add_parser("refine", help="keep records of what notes should change").add_subparsers(dest="step", required=True)
    one = refine.add_parser("stage", parents=[shared])
    one.add_argument("--source", required=True)
    one.add_argument("--title", required=True)
    one.add_argument("--summary")
    one.add_argument("--stdin", action="store_true", help="read the summary from standard input")
    one.add_argument("--evidence", action="append", default=[])
    one.add_argument("--related", action="append", default=[])
    one = refine.add_parser("list", parents=[shared])
    one.add_argument("--status", choices=("staged", "promoted", "rejected", "all"), default="all")
    one = refine.add_parser("promote", parents=[shared])
    one.add_argument("id")
    one.add_argument("--note", action="append", default=[])
    one = refine.add_parser("reject", parents=[shared])
    one.add_argument("id")
    one.add_argument("--reason", required=True)
    return top


def _graph_options(a: argparse.Namespace) -> dict:
    given = {"limit": a.limit, "depth_limit": a.depth, "file": a.file, "symbol": a.symbol}
    takes = {"backlinks": ("limit",), "links": ("limit",), "related": ("limit",), "cycles": ("limit",), "orphans": (), "descendants": ("depth_limit",), "ancestors": ("depth_limit",), "impact": ("file", "symbol")}[a.command]
    return {k: v for k, v in given.items() if k in takes and v is not None}


def run(a: argparse.Namespace, spark, say, complain) -> int:
    """spark: a function that gives a session, called by verbs that need one."""
    from .plans import verbs
    from .sources import config as configuration

    def show(value: object, *lines: str) -> None:
        for line in [json.dumps(value, default=str, ensure_ascii=False)] if a.json else lines:
            say(line)

    now = datetime.datetime.now(datetime.UTC)
    if a.verb == "init":
        files = verbs.init(Path.cwd(), now.date(), a.vault or "vault", a.owner)
        show({"files": [str(f) for f in files]}, f"wrote {len(files)} files in {Path.cwd()}")
        return 0
    config = configuration.load(".", a.config, a.vault, a.root)
    path = a.index or config.vault / ".lodestone/index"
    if a.verb in (None, "check"):
        errors, notes = verbs.checked(spark(), config, now.date())
        show({"errors": errors, "noteCount": notes}, *([] if errors else [f"ok ({notes} notes)"]))
        if errors and not a.json:
            complain(f"{len(errors)} problem(s)")
            for e in errors:
                complain(f"  - {e}")
        return 1 if errors else 0
    if a.verb in ("index", "search-index"):
        built = verbs.index(spark(), config, path, force=a.full)
        if built is None:
            show({"index": None, "listing": config.listing, "codeRefs": config.code_refs_file}, f"search is off: wrote {config.listing} and {config.code_refs_file}")
        else:
            count = {r.change: r["count"] for r in built.changes.groupBy("change").count().collect()}
            out = {"mode": "full" if built.full else "incremental", "ftsOnly": built.vectors is None, "indexed": count.get("added", 0) + count.get("changed", 0), "removed": count.get("removed", 0), "noteCount": built.meta.notes, "index": str(path)}
            show(out, f"{out['mode']}{' (full-text only)' if out['ftsOnly'] else ''}: {out['indexed']} indexed, {out['removed']} removed, {out['noteCount']} notes in {path}")
    elif a.verb == "search":
        got = verbs.search(spark(), config, path, a.query, a.mode, a.limit, rebuild=a.rebuild, status=a.status, tags=a.tag, audience=a.audience)
        hits = [r.asDict() for r in got["hits"].collect()]
        if got["rebuilt"]:
            complain("the index was built again first")
        if got["stale"]:
            complain("the index is behind the vault; hits may be missing")
        show({**got, "hits": hits}, *(f"{h['score']:.4f}\t{h['note_id']}\t{h['title']}\t{h['heading_path']}" for h in hits), f'{len(hits)} hit(s) for "{a.query}" ({got["mode"]})')
    elif a.verb == "graph":
        rows = [r.asDict(True) for r in verbs.query(spark(), path, a.command, a.note, config, **_graph_options(a)).collect()]
        show({"command": a.command, "hits": rows}, *(json.dumps(r, default=str, ensure_ascii=False) for r in rows), f"{len(rows)} result(s)")
    elif a.step == "stage":
        summary = sys.stdin.read() if a.stdin else a.summary
        if not summary:
            raise ValueError("a summary is needed: --summary or --stdin")
        record = verbs.stage(config, a.source, a.title, summary, now, a.evidence, a.related)
        show(record, f"staged {record['id']}")
    elif a.step == "list":
        records, errors = verbs.refinement_files(config, a.status)
        if errors:
            raise ValueError("records are not in order:\n" + "\n".join(errors))
        show(records, *(f"- {r['id']} [{r['status']}] {r['title']}" for r in records), *([] if records else ["no records"]))
    elif a.step == "promote":
        record = verbs.promote(spark(), config, a.id, a.note, now, path)
        show(record, f"promoted {record['id']} and wrote {config.listing}")
    else:
        record = verbs.reject(config, a.id, a.reason, now)
        show(record, f"rejected {record['id']}")
    return 0


def session():
    from pyspark.sql import SparkSession

    made = SparkSession.builder.appName("lodestone").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


def main(args: Sequence[str] | None = None, spark=session) -> int:
    args = list(sys.argv[1:] if args is None else args)
    complain = lambda line: print(line, file=sys.stderr)
    if args[:1] == ["help"]:
        args = [*args[1:2], "--help"]
    if not args or args[0].startswith("--") and args[0] not in ("--help", "--version"):
        args = ["check", *args]
    try:
        a = parser().parse_args(args)
    except SystemExit as e:
        return 1 if e.code else 0
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always", UserWarning)
        try:
            return run(a, spark, print, complain)
        except Exception as e:  # what went wrong is the message; the trace is of no use here
            complain(str(e))
            return 1
        finally:
            for w in said:
                if issubclass(w.category, UserWarning):
                    complain(str(w.message))
