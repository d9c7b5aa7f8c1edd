"""Command line: python -m vellum <command>. Commands work on the store at or above --store (the working folder)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from vellum import sync as exchange
from vellum.check import check
from vellum.server import Server
from vellum.session import Engine
from vellum.sources.store import Store


def spark_session() -> SparkSession:
    made = SparkSession.builder.appName("vellum").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vellum", description=__doc__)
    p.add_argument("--store", default=".")
    p.add_argument("--mode", choices=("journal", "audit"), default="journal")
    p.add_argument("--durability", choices=("full", "normal", "off"), default="full")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init", help="make a store")
    sub.add_parser("status", help="the version and what differs from it")
    d = sub.add_parser("diff", help="changed tables, or rows of a table")
    d.add_argument("table", nargs="?")
    c = sub.add_parser("commit", help="fold the journal into a version")
    c.add_argument("-m", "--message", default="checkpoint")
    k = sub.add_parser("check", help="check integrity")
    k.add_argument("version", nargs="?")
    k.add_argument("--all", action="store_true")
    e = sub.add_parser("enable", help="name a peer directory")
    e.add_argument("peer")
    sub.add_parser("sync", help="exchange versions with the peer")
    sub.add_parser("conflicts", help="conflicts that wait")
    r = sub.add_parser("resolve", help="resolve a conflict")
    r.add_argument("id")
    r.add_argument("choice", choices=("local", "remote", "base", "delete"))
    w = sub.add_parser("start", help="serve sessions on a port until interrupted")
    w.add_argument("--host", default="127.0.0.1")
    w.add_argument("--port", type=int, default=7433)
    w.add_argument("--read-only", action="store_true")
    q = sub.add_parser("sql", help="run statements, separated by semicolons at line ends")
    q.add_argument("text")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    a, out = parser().parse_args(argv), out or sys.stdout
    say = lambda *x: print(*x, file=out)
    if a.command == "init":
        say(Store.init(a.store, a.durability).ref("data"))
        return 0
    store = Store.discover(a.store, a.durability)
    if a.command == "conflicts":
        for c in exchange.conflicts(store):
            say(c["id"], c.get("rows", ""))
        return 0
    engine = Engine(store, spark or spark_session(), a.mode)
    if a.command == "status":
        say("version", store.ref("data"))
        for t, change in engine.diff().items():
            say(change, t)
    elif a.command == "diff":
        if a.table:
            for r in engine.diff_rows(a.table).toLocalIterator():
                say(r["change"], r["old"], r["new"])
        else:
            for t, change in engine.diff().items():
                say(change, t)
    elif a.command == "commit":
        say(engine.checkpoint(a.message))
    elif a.command == "check":
        found = check(engine, a.version, a.all)
        for x in found.problems:
            say("problem:", x)
        for x in found.warnings:
            say("warning:", x)
        say(f"{found.versions} versions, {found.files} files, {len(found.problems)} problems")
        return 0 if found.ok else 1
    elif a.command == "enable":
        exchange.enable(engine, a.peer)
    elif a.command in ("sync", "resolve"):
        result = exchange.sync(engine) if a.command == "sync" else exchange.resolve(engine, a.id, a.choice)
        say(result.state, result.version)
        for c in result.conflicts:
            say("conflict", c["id"])
        return 0 if not result.conflicts else 2
    elif a.command == "start":
        with Server(engine, a.host, a.port, a.read_only) as server:
            say(f"serving {store.root} on {a.host}:{server.port}")
            try:
                server.serve_forever()
            except KeyboardInterrupt:
                return 0
    elif a.command == "sql":
        session = engine.session()
        for text in [t.strip() for t in a.text.split(";\n") if t.strip()]:
            if text.split()[0].upper() in ("SELECT", "WITH", "SHOW", "DESCRIBE", "DESC", "EXPLAIN", "VALUES"):
                df = session.query(text)
                say("\t".join(df.columns))
                for r in df.toLocalIterator():
                    say("\t".join("NULL" if v is None else str(v) for v in r))
            else:
                say(session.execute(text), "rows")
        session.commit()
    return 0
