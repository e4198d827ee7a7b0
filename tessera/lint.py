"""What compiles but is likely not meant."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .compiler import Compiled
from .functions.checker import Node, show


@dataclass
class Finding:
    lint: str
    severity: str  # warning or note
    message: str
    rule: str = ""
    line: int = 0


def conjuncts(n: Node) -> list[Node]:
    return [x for a in n.args for x in conjuncts(a)] if n.op == "bin" and n.value == "&&" else [n]


def allowed(n: Node) -> dict[str, set]:
    """Caller fields that a test confines to constants."""
    out: dict[str, set] = {}
    for x in conjuncts(n):
        if x.op == "bin" and x.value == "==":
            for a, b in (x.args, x.args[::-1]):
                if a.op == "ctx" and b.op == "lit":
                    out[a.value] = out.get(a.value, {b.value[0]}) & {b.value[0]}
        if x.op == "in" and x.args[0].op == "ctx" and x.args[1].op == "list" and all(y.op == "lit" for y in x.args[1].args):
            values = {y.value[0] for y in x.args[1].args}
            out[x.args[0].value] = out.get(x.args[0].value, values) & values
    return out


def lint(c: Compiled) -> list[Finding]:
    out: list[Finding] = []
    line = {r.id: r.line for r in c.doc.rules}
    add = lambda lint, sev, msg, rule="": out.append(Finding(lint, sev, msg, rule, line.get(rule, 0)))
    tests = [(i, n) for i, n in c.decisions + c.admits] + [(i, n) for i, n, _ in c.asserts + c.guarantees]
    seen: dict[tuple, str] = {}
    for i, n in tests:
        if "row" not in n.ns and any(i == a for a, _ in c.admits):
            add("admit-reads-only-ctx", "warning", "it reads the caller alone; a decide rule refuses outright", i)
        if not n.ns:
            add("constant-rule", "warning", "it reads nothing and is always the same", i)
        op = next(r.op for r in c.doc.rules if r.id == i)
        key = (op, show(n))
        if key in seen:
            add("duplicate-condition", "warning", f"it repeats `{seen[key]}`", i)
        seen.setdefault(key, i)
    confined: dict[str, set] = {}
    for i, n in c.decisions:
        for f, values in allowed(n).items():
            confined[f] = confined.get(f, values) & values
            if not confined[f]:
                add("unsatisfiable-callers", "warning", f"no ctx.{f} passes all decide rules", i)
    text = " ".join([r.expr + " " + r.unless for r in c.doc.rules] + [e["expr"] for e in c.doc.enrich])
    for space, fields in c.doc.extensions.items():
        for f in fields:
            if not re.search(rf"\b{space}\.other\.{f}\b", text):
                add("unused-extension", "warning", f"{space}.other.{f} is declared and never read")
    if not c.decisions and not c.admits:
        add("open-access", "note", "every caller sees every row")
    if not c.doc.owner:
        add("no-owner", "note", "the contract names no owner")
    if not re.fullmatch(r"[a-z0-9_-]+(/[a-z0-9_-]+)+", c.doc.contract):
        add("contract-name", "note", "contract names are like domain/name")
    return sorted(out, key=lambda f: (f.severity != "warning", f.line))
