"""Command line: validate, lint, compile, check, schema, import, function."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from datetime import datetime, timezone
from pathlib import Path

import yaml

from .compiler import compile_contract, schema_from_expose
from .document import Document, json_schema, read
from .errors import ContractError
from .functions.registry import Registry, signature
from .lint import lint
from .operators.governed import Caller, differential, failing_report, query_time_guarantees, refusal_detail, refusals, rule_counts, validate
from .plans.export import substrait, validation_sql
from .sources.artifact import to_bytes
from .sources.io import read_data, read_schema
from .sources.odcs import import_odcs
from .types import parse_type


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def load(a) -> tuple[Document, object, str]:
    """The compiled contract and where its column types come from: a schema file,
    the data at the binding, or what is exposed."""
    path = Path(a.contract)
    doc = read(path.read_text())
    siblings = {}
    for p in path.parent.glob("*.y*ml"):
        if p != path:
            try:
                other = read(p.read_text())
                siblings[other.contract] = other
            except ContractError:
                continue
    hints = dict(x.split("=", 1) for x in a.type or [])
    place = str((doc.binding or {}).get("parquet", "")).removeprefix("file://")
    if a.schema:
        raw = yaml.safe_load(Path(a.schema).read_text())
        source, origin = {k: parse_type(v) for k, v in (raw if isinstance(raw, dict) else {c["name"]: c["type"] for c in raw}).items()}, a.schema
    elif getattr(a, "data", None):
        source, origin = read_schema(session(), a.data, hints), a.data
    elif place and Path(place).exists():
        source, origin = read_schema(session(), place, hints), place
    else:
        source, origin = schema_from_expose(doc) | {k: parse_type(v) for k, v in hints.items()}, "expose"
    registry = Registry()
    for f in a.function or []:
        module, manifest = f.split("=", 1)
        m = yaml.safe_load(Path(manifest).read_text())
        registry.add(m["signature"], Path(module).read_text().strip(), doc.owner or "", m.get("deterministic", True))
    return compile_contract(doc, source, registry, siblings.get), doc, origin


def load_caller(path: str) -> Caller:
    d = yaml.safe_load(Path(path).read_text())
    if isinstance(d.get("now"), str):
        d["now"] = datetime.fromisoformat(d["now"].replace("Z", "+00:00"))
    return Caller(**d)


def check(a, c) -> tuple[dict, int]:
    spark = session()
    df = read_data(spark, a.data, dict(x.split("=", 1) for x in a.type or []))
    v = validate(df, c)
    read_at = datetime.now(timezone.utc)
    callers = [load_caller(p) for p in a.caller or []] or [Caller()]
    diff = differential(df, c, callers, a.sample)
    out: dict = {"verdict": asdict(v), "differential": {"evaluations": diff["evaluations"], "mismatches": len(diff["mismatches"])}, "callers": []}
    for caller in callers:
        no = [r for r, x in refusals(c, caller) if x]
        one: dict = {"caller": caller.id, "refused_by": no, "because": {r: refusal_detail(c, caller, r) for r in no}}
        if not no:
            n = one["counts"] = rule_counts(df, c, caller).first().asDict()
            one["pass_percent"] = {k.split("__", 1)[1]: 100.0 * x / n["total"] if n["total"] else 100.0 for k, x in n.items() if k.startswith(("admit__", "pass__"))}
            one["visible_percent"] = 100.0 * n["visible"] / n["total"] if n["total"] else 100.0
        # what is read when queries run: data read now count as written now
        one["query_time"] = query_time_guarantees(c, v, read_at, caller)
        out["callers"].append(one)
    bad = [i for i, n in v.failures.items() if n]
    out["failing"] = failing_report(df, c, bad)
    return out, int(not v.valid or bool(diff["mismatches"]))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="cmd", required=True)

    def contract(name: str, **kw):
        s = sub.add_parser(name, **kw)
        s.add_argument("contract")
        s.add_argument("--schema")
        s.add_argument("--type", action="append", metavar="COL=TYPE")
        s.add_argument("--function", action="append", metavar="BODY=MANIFEST")
        s.add_argument("--json", action="store_true")
        return s

    contract("validate")
    contract("lint").add_argument("--deny-warnings", action="store_true")
    s = contract("compile")
    s.add_argument("-o")
    s.add_argument("--sql", metavar="DIALECT")
    s.add_argument("--table", default="data")
    s.add_argument("--substrait", metavar="FILE")
    s = contract("check")
    s.add_argument("--data", required=True)
    s.add_argument("--caller", action="append")
    s.add_argument("--sample", type=int, default=1000)
    sub.add_parser("schema")
    s = sub.add_parser("import")
    s.add_argument("format", choices=["odcs"])
    s.add_argument("file")
    s.add_argument("--object")
    s.add_argument("-o")
    s = sub.add_parser("function")
    s.add_argument("action", choices=["verify"])
    s.add_argument("module")
    s.add_argument("--manifest", required=True)
    s.add_argument("--owner", required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return run(a)
    except ContractError as e:
        if getattr(a, "json", False):
            print(json.dumps({"ok": False, "problems": [asdict(p) for p in e.problems]}))
        else:
            print(e, file=sys.stderr)
        return 2


def run(a) -> int:
    if a.cmd == "schema":
        print(json.dumps(json_schema(), indent=2))
        return 0
    if a.cmd == "import":
        doc, notes = import_odcs(Path(a.file).read_text(), a.object)
        text = yaml.safe_dump(doc, sort_keys=False, allow_unicode=True)
        Path(a.o).write_text(text) if a.o else print(text)
        print("\n".join(notes), file=sys.stderr)
        return 0
    if a.cmd == "function":
        m = yaml.safe_load(Path(a.manifest).read_text())
        name, args, result = signature(m["signature"])
        f = Registry().add(m["signature"], Path(a.module).read_text().strip(), a.owner, m.get("deterministic", True))
        print(f"{name}({', '.join(args)}) -> {result} {f.pin}")
        return 0
    c, doc, origin = load(a)
    if a.cmd == "validate":
        counts: dict[str, int] = {}
        for r in c.doc.rules:
            counts[r.op] = counts.get(r.op, 0) + 1
        out = {"ok": True, "contract": doc.contract, "rules": counts, "exposed": len(c.expose), "columns": len(c.source), "types_from": origin, "hash": c.hash}
        print(json.dumps(out) if a.json else f"{doc.contract}: valid; {', '.join(f'{n} {k}' for k, n in counts.items())}; {len(c.expose)} of {len(c.source)} columns exposed; types from {origin}")
        return 0
    if a.cmd == "lint":
        found = lint(c)
        place = str(c.doc.binding.get("parquet", "")).removeprefix("file://")
        rows = [asdict(f) for f in found]
        if place and not Path(place).exists():
            rows.append({"lint": "binding-not-found", "severity": "note", "message": f"nothing is at {place}", "rule": "", "line": 0})
        print(json.dumps(rows) if a.json else "\n".join(f"{f['severity']}: {f['lint']} {f['rule']}: {f['message']}" for f in rows))
        return int(a.deny_warnings and any(f["severity"] == "warning" for f in rows))
    if a.cmd == "compile":
        if a.substrait:
            Path(a.substrait).write_bytes(substrait(c, a.table))
            return 0
        if a.o:
            Path(a.o).write_bytes(to_bytes(c))
        if a.sql:
            sql, warnings = validation_sql(c, a.sql, a.table)
            print(sql)
            print("\n".join(warnings), file=sys.stderr)
        elif a.json:
            print(json.dumps({"hash": c.hash, "tiers": c.tiers, "stored": list(c.stored), "bloom": c.bloom}))
        elif not a.o:
            print("\n".join(f"{t['id']:24} {t['op']:10} {t['tier']:12} {t['reason']}" for t in c.tiers))
        return 0
    out, code = check(a, c)
    print(json.dumps(out, default=str) if a.json else yaml.safe_dump(json.loads(json.dumps(out, default=str)), sort_keys=False))
    return code


if __name__ == "__main__":
    sys.exit(main())
