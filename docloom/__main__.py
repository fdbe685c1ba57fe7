"""python -m docloom: capabilities, inspect, query, explain, project, convert, materialize, edit, plan, apply, conformance.

Documents are read and answered as tables; edit, plan and apply work on files of this machine. Every command prints JSON
lines and returns the exit class of the worst failure.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from hashlib import sha256

from docloom.plans.algebra import InvalidQuery, from_wire
from docloom.plans.catalog import DOMAINS
from docloom.sources.scan import PROFILES

TABLES = ("inspect", "query", "explain", "project", "convert")


def _say(row: dict) -> None:
    print(json.dumps(row, default=str, ensure_ascii=False))


def exit_of(code: str | None) -> int:
    """The exit class of a failure code: the same rule as source.exit_class has for tables."""
    if code is None or code in ("Ok", "completed"):
        return 0
    if "resource-limit" in code or "depth" in code:
        return 5
    if code.startswith("core.query"):
        return 3
    if ".parse." in code or "encoding" in code:
        return 2
    return 4 if code.startswith("core.conversion") or "projection" in code or "materialization" in code else 1


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _materialize(a) -> int:
    from docloom.functions.materialize import Unrepresentable, materialize
    from docloom.functions.values import from_transport

    try:
        out = materialize(from_transport(_read(a.path).decode()), a.style)
    except Unrepresentable as e:
        _say({"status": e.code})
        return exit_of(e.code)
    _say({"status": "Ok", "text": out.hex() if isinstance(out, bytes) else out})
    return 0


def _requests(path: str) -> list[tuple[str, int, dict]]:
    return [(r["operation"], r["node_id"], r.get("args", {})) for r in json.loads(_read(path))]


def _planned(path: str, profile: str, requests) -> dict:
    from docloom.functions.edits import commit

    r = commit(_read(path).decode("utf-8", "strict"), profile, requests)
    return {"path": path, "status": "planned" if r["status"] == "Ok" else "failed", "code": None if r["status"] == "Ok" else r["status"], "base_digest": r["base_digest"], "target_digest": r["target_digest"], "target": r["text"]}


def _edit(a) -> int:
    """One file: planned and, unless it is a dry run, written at once."""
    entry = _planned(a.path, a.profile, _requests(a.requests))
    if entry["status"] == "planned" and not a.dry_run:
        from docloom.sources.files import write_one

        entry["status"] = write_one(os.path.dirname(os.path.abspath(a.path)), os.path.basename(a.path), entry["target"].encode())
    _say({k: v for k, v in entry.items() if k != "target"} | ({"target": entry["target"]} if a.dry_run else {}))
    return exit_of(entry["code"] or (None if entry["status"] in ("planned", "completed") else entry["status"]))


def _plan(a) -> int:
    """Files of a folder (or one file) to a plan file; nothing else is written."""
    paths = [a.path] if os.path.isfile(a.path) else sorted(os.path.join(d, f) for d, _, names in os.walk(a.path) for f in names)
    requests = _requests(a.requests)
    entries = [_planned(p, a.profile, requests) for p in paths]
    _persist(a.output, {"contract": "core.batch-plan@1", "files": entries})
    for e in entries:
        _say({k: e[k] for k in ("path", "status", "code")})
    return max((exit_of(e["code"]) for e in entries), default=0)


def _persist(path: str, record: dict) -> None:
    from docloom.sources.files import write_one

    status = write_one(os.path.dirname(os.path.abspath(path)), os.path.basename(path), json.dumps(record, ensure_ascii=False).encode())
    if status != "completed":
        raise SystemExit(f"{status}: {path}")


def _apply(a) -> int:
    """A plan file: the result file says pending for every entry before the first write, and is rewritten after each."""
    from docloom.sources.files import write_one

    plan = json.loads(_read(a.path))
    if plan.get("contract") != "core.batch-plan@1":
        raise SystemExit("cli.data.invalid-request@1: not a plan")
    results = [{"path": e["path"], "status": "pending", "code": None} for e in plan["files"]]
    save = lambda: _persist(a.output, {"contract": "core.batch-result@1", "files": results})
    save()
    for entry, result in zip(plan["files"], results):
        try:
            now = sha256(_read(entry["path"])).hexdigest()
        except OSError:
            now = None
        if entry["status"] != "planned":
            result.update(status="failed", code=entry["code"])
        elif now == entry["target_digest"]:
            result["status"] = "completed"
        elif now is None:
            result.update(status="failed", code="core.source.unreadable@1")
        elif now != entry["base_digest"]:
            result.update(status="skipped-stale", code="core.edit.precondition-failed@1")
        elif sha256(entry["target"].encode()).hexdigest() != entry["target_digest"]:
            result.update(status="failed", code="core.edit.precondition-failed@1")
        else:
            status = write_one(os.path.dirname(os.path.abspath(entry["path"])), os.path.basename(entry["path"]), entry["target"].encode())
            result.update(status="completed" if status == "completed" else "failed", code=None if status == "completed" else status)
        save()
        _say(result)
    return max((exit_of(r["code"]) for r in results), default=0)


def _conformance(a) -> int:
    """The registered queries against their SQL over a folder of tables."""
    import duckdb
    from pyspark.sql import SparkSession

    from docloom import registry
    from docloom.session import ship

    spark, duck, bad = ship(SparkSession.builder.getOrCreate()), duckdb.connect(), 0
    for name in sorted(os.listdir(a.path)):
        if name.endswith(".parquet"):
            path = f"{a.path}/{name}" + ("/*.parquet" if os.path.isdir(f"{a.path}/{name}") else "")
            duck.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path}'")
    for name, sql in sorted(registry.oracle_sql().items()):
        if a.only and a.only not in name:
            continue
        got, want = registry.queries()[name](spark, a.path).toPandas(), duck.sql(sql).df()
        rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).values.tolist()))
        same = sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
        bad += not same
        _say({"case": name, "status": "passed" if same else "failed"})
    return 1 if bad else 0


def _tables(a) -> int:
    from pyspark.sql import SparkSession

    from docloom.functions.convert import convert, project
    from docloom.plans.inline import query_documents
    from docloom.session import ship
    from docloom.sources.files import read_documents
    from docloom.sources.scan import scan

    spark = ship(SparkSession.builder.getOrCreate())
    docs = read_documents(spark, a.path)
    if a.command in ("query", "explain"):
        try:
            query = from_wire(a.query)
        except InvalidQuery as e:
            _say({"status": e.code})
            return 3
        found = query_documents(query, docs, a.profile).ordered("role", "kind", "name", "text", "start_byte", "end_byte")
        if a.command == "explain":
            found.explain("formatted")
            return 0
    elif a.command == "convert":
        found = convert(docs, a.profile, a.style, a.policy)
    elif a.command == "project":
        found = project(docs, a.profile, a.policy)
    else:
        found = scan(docs, a.profile).groupBy("doc_id", "role", "kind").count()
    worst = 0
    for row in found.toLocalIterator():
        _say(row.asDict(True))
        worst = max(worst, exit_of(row["status"]) if "status" in row else 0)
    return worst


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docloom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("capabilities")
    for name in (*TABLES, "materialize", "edit", "plan", "apply", "conformance"):
        s = sub.add_parser(name)
        s.add_argument("path")
        if name in (*TABLES, "edit", "plan"):
            s.add_argument("--profile", required=True, choices=PROFILES)
        if name in ("query", "explain"):
            s.add_argument("--query", required=True, help="wire form of a query")
        if name in ("convert", "materialize"):
            s.add_argument("--style", required=True, help="style to write")
        if name in ("convert", "project"):
            s.add_argument("--policy", choices=("Reject", "FirstWins", "LastWins"))
        if name in ("edit", "plan"):
            s.add_argument("--requests", required=True, help="a JSON file: a list of operation, node_id, args")
        if name == "edit":
            s.add_argument("--dry-run", action="store_true")
        if name in ("plan", "apply"):
            s.add_argument("--output", required=True, help="the plan or result file")
        if name == "conformance":
            s.add_argument("--only", help="cases whose name holds this")
    a = p.parse_args(args)
    if a.command == "capabilities":
        from docloom.functions.materialize import STYLES

        print(json.dumps({"profiles": PROFILES, "styles": sorted(STYLES), "domains": {k: [o.name for o in v[1]] for k, v in DOMAINS.items()}}, indent=1))
        return 0
    if a.command in TABLES:
        return _tables(a)
    return {"materialize": _materialize, "edit": _edit, "plan": _plan, "apply": _apply, "conformance": _conformance}[a.command](a)


if __name__ == "__main__":
    sys.exit(main())
