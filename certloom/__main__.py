"""Command line: python -m certloom ROOT COMMAND ...; exit codes as in errors.py."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone

from certloom.errors import EngineError
from certloom.functions.text import plural
from certloom.operators.query import parse_bar
from certloom.sources import sample
from certloom.sources.export import lines, text_of
from certloom.sources.loglist import find_log, read_log_list

#: Rows of a terminal table without a limit of the user's.
TABLE_ROWS = 100


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="certloom", description=__doc__)
    p.add_argument("root")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    s = sub.add_parser("search", help="the query bar's text, e.g. 'example.com kind:final since:2026'")
    s.add_argument("query")
    for name in ("group", "sort", "export"):
        s.add_argument(f"--{name}", default="" if name != "group" else "names")
    s.add_argument("--fields", default="")
    s.add_argument("--limit", type=int, default=0)
    s.add_argument("--as-of", type=int, default=0)
    s.add_argument("--format", default="table", choices=("table", "md", "csv", "json"))
    s.add_argument("--force", action="store_true")
    f = sub.add_parser("fetch")
    f.add_argument("key")
    f.add_argument("--format", default="pem", choices=("pem", "der", "text", "json"))
    f.add_argument("--with-chain", action="store_true")
    f.add_argument("--with-entries", action="store_true")
    u = sub.add_parser("update", help="ingest what a log has beyond the last batch")
    u.add_argument("log")
    u.add_argument("url", nargs="?", default="", help="of a log that is not followed")
    u.add_argument("--kind", default="", choices=("", "rfc6962", "tiled"))
    u.add_argument("--until", type=int)
    u.add_argument("--follow", metavar="INTERVAL", help="keep on, e.g. '10 minutes'")
    sub.add_parser("stats")
    v = sub.add_parser("verify")
    v.add_argument("--full", action="store_true")
    v.add_argument("--as-of", type=int, default=0)
    v.add_argument("--json", action="store_true")
    r = sub.add_parser("rebuild")
    r.add_argument("table")
    r.add_argument("version", type=int)
    r.add_argument("--in-place", action="store_true")
    sub.add_parser("gc")
    sub.add_parser("recover")
    x = sub.add_parser("explain-error")
    x.add_argument("code")
    c = sub.add_parser("sample", help="capture, verify or measure a sample of a followed log")
    c.add_argument("action", choices=("capture", "verify", "measure"))
    c.add_argument("folder", help="of all samples to capture, else of one sample")
    c.add_argument("--log", default="")
    c.add_argument("--kind", default="canonical", choices=("canonical", "representative"))
    c.add_argument("--entries", type=int, default=sample.LEAST)
    c.add_argument("--start", default="0", help="an index, or 'head' for the last whole window")
    p2 = sub.add_parser("repair", help="write a batch's part of a table again from its certificates")
    p2.add_argument("table")
    p2.add_argument("commit_seq", type=int)
    h = sub.add_parser("explore", help="hold a search and print one of its pages")
    h.add_argument("query")
    h.add_argument("--group", default="names")
    h.add_argument("--sort", default="")
    h.add_argument("--page", type=int, default=0)
    h.add_argument("--size", type=int, default=200)
    g = sub.add_parser("logs", help="the followed logs; add one of a log list, or show one of it")
    g.add_argument("action", nargs="?", default="list", choices=("list", "add", "info"))
    g.add_argument("name", nargs="?", default="")
    g.add_argument("--list", dest="log_list", default="", help="a log list (v3) in JSON")
    return p


def run(spark, a: argparse.Namespace, out) -> None:
    """One command; its text goes to the binary stream out."""
    from certloom.engine import Engine

    say = lambda text: out.write((text + "\n").encode())
    if a.command == "explain-error":
        for family, text in Engine.explain_error(a.code) or [("", "no such code")]:
            say(f"{a.code} ({family}): {text}" if family else text)
        return
    e = Engine(spark, a.root, create=a.command == "init")
    if a.command == "search":
        q = parse_bar(a.query)
        q.group, q.sort, q.limit = a.group, a.sort, a.limit
        q.fields = [c for c in a.fields.split(",") if c]
        if a.export:
            say(json.dumps(e.export(q, a.export, a.format if a.format != "table" else "csv", a.as_of, a.force)))
            return
        if a.format == "table" and not q.limit:
            q.limit = TABLE_ROWS
        rows = e.search(q, a.as_of)
        for line in lines(a.format, rows.columns, (tuple(r) for r in rows.toLocalIterator())):
            say(line)
    elif a.command == "fetch":
        out.write(e.fetch(a.key, a.format, a.with_chain, a.with_entries))
    elif a.command == "update":
        e.update(a.log, a.url, a.kind, a.until, a.follow).awaitTermination()
    elif a.command == "stats":
        say(json.dumps(e.stats(datetime.now(timezone.utc).replace(tzinfo=None)), indent=2, default=text_of))
    elif a.command == "verify":
        found = e.verify(a.full, a.as_of).collect()
        if a.json:
            say(json.dumps([r.asDict() for r in found], indent=2))
        for r in [] if a.json else found:
            say(f"{r['status']:7} {r['check']}" + f": {plural(r['n'], 'problem')}, {r['examples'][:10]}" * bool(r["n"]))
        if any(r["n"] for r in found):
            from certloom.errors import VerificationError

            raise VerificationError("the dataset does not verify")
    elif a.command == "rebuild":
        say(f"{e.rebuild(a.table, a.version, a.in_place)} batches left")
    elif a.command in ("gc", "recover"):
        for name in e.gc() if a.command == "gc" else e.recover():
            say(name)
    elif a.command == "sample":
        if a.action == "capture":
            say(e.capture(a.folder, a.log, a.kind, a.entries, None if a.start == "head" else int(a.start)))
        elif a.action == "verify":
            say(f"{plural(sample.load(spark, a.folder).count(), 'entry', 'entries')} verified")
        else:
            say(json.dumps(sample.measure(sample.load(spark, a.folder)), indent=2, default=text_of))
    elif a.command == "repair":
        e.repair(a.table, a.commit_seq)
        say(f"{a.table} of commit {a.commit_seq} is written again")
    elif a.command == "explore":
        held = e.hold(parse_bar(a.query), group=a.group, sort=a.sort)
        for line in lines("table", held.query.columns, held.page(a.page, a.size)):
            say(line)
        say(plural(held.total, "row"))
        held.close()
    elif a.command == "logs":
        if a.action == "list":
            say(json.dumps(e.logs.all(), indent=2))
            return
        if a.action == "info" and not a.log_list:
            say(json.dumps(e.logs.get(a.name), indent=2))
            return
        found = find_log(read_log_list(spark, a.log_list), a.name)
        if a.action == "add":
            e.logs.add(found)
        say(json.dumps(found, indent=2))


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("certloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, a, sys.stdout.buffer)
        return 0
    except EngineError as e:
        print(f"certloom: {e}", file=sys.stderr)
        return e.exit_code
    finally:
        sys.stdout.flush()


if __name__ == "__main__":
    sys.exit(main())
