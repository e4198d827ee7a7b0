"""Contract documents: YAML or JSON to checked plain records with line numbers,
versions, residency, and inheritance that only narrows."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from functools import lru_cache
from importlib import resources
from pathlib import Path
from typing import Any

import yaml

from .errors import ContractError, Problem, fail, suggest
from .types import parse_type

#: fixed values: the keys of a document and the fields of each kind of rule
TOP = "contract version owner inherits binding residency expose rules extensions enrich dataset_other".split()
RULES = {
    "decide": (["expr"], ["message"]), "admit": (["expr"], ["message"]), "assert": (["expr", "on_fail"], ["message"]), "guarantee": (["expr", "on_fail"], ["message"]),
    "transform": (["column", "expr"], ["message"]), "shape": (["operator"], ["column", "params", "unless", "message"]),
}
ON_FAIL = {"assert": ("drop", "deny", "report"), "guarantee": ("deny", "annotate")}
SHAPES = {"noise": ("sensitivity", "epsilon", "budget", "at"), "suppress": ("k",), "sample": ("fraction", "key")}


@dataclass
class Rule:
    id: str
    op: str
    expr: str = ""
    on_fail: str = ""
    column: str = ""
    operator: str = ""
    params: dict = field(default_factory=dict)
    unless: str = ""
    message: str = ""
    line: int = 0
    layer: int = 0  # 0 is the oldest ancestor


@dataclass
class Document:
    contract: str
    version: str
    owner: str | None = None
    inherits: str | None = None
    binding: dict = field(default_factory=dict)
    residency: dict | None = None
    expose: list[dict] | None = None
    rules: list[Rule] = field(default_factory=list)
    extensions: dict = field(default_factory=dict)
    enrich: list[dict] = field(default_factory=list)
    dataset_other: list[dict] = field(default_factory=list)
    layers: list[list[dict]] = field(default_factory=list)  # exposed columns by layer, oldest first

    def plain(self) -> dict:
        rules = [{k: v for k, v in vars(r).items() if v not in ("", {}, None) and k not in ("line", "layer")} for r in self.rules]
        out = {k: v for k, v in vars(self).items() if k not in ("rules", "layers") and v not in (None, [], {})}
        return out | ({"rules": rules} if rules else {})

    @property
    def hash(self) -> str:
        return digest(self.plain())

    def permits(self, code: str) -> bool:
        """Whether data may be placed in a country or zone; without terms, nowhere."""
        return code in (self.residency or {}).get("jurisdictions", ())

    @property
    def output_may_leave(self) -> bool:
        """Whether approved output may go elsewhere than the data."""
        return bool((self.residency or {}).get("approved_output_may_leave"))


@lru_cache
def jurisdictions() -> frozenset[str]:
    """Two-letter country codes of the time zone database's list, and the zone EU."""
    try:
        text = resources.files("tzdata").joinpath("zoneinfo", "iso3166.tab").read_text("utf-8")
    except (ImportError, FileNotFoundError):
        text = Path("/usr/share/zoneinfo/iso3166.tab").read_text("utf-8")
    return frozenset(["EU", *(line[:2] for line in text.splitlines() if line[:1] != "#" and line[2:3] == "\t")])


def digest(value: Any) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()


def version(v: Any) -> str:
    """``N`` or ``N.N.N`` as three numbers."""
    s = str(v)
    if isinstance(v, float) or not re.fullmatch(r"\d+(\.\d+\.\d+)?", s):
        raise fail("document", f"not a version: {s}", help="write 3 or 3.1.0")
    return s if "." in s else f"{s}.0.0"


class Reader:
    """Collects every structural problem before it gives up."""

    def __init__(self, text: str):
        self.problems: list[Problem] = []
        self.lines: dict[tuple, int] = {}
        try:
            root = yaml.compose(text, Loader=yaml.SafeLoader)
            self.data = yaml.safe_load(text)
        except yaml.YAMLError as e:
            mark = getattr(e, "problem_mark", None)
            raise fail("document", f"not YAML: {getattr(e, 'problem', e)}", line=mark.line + 1 if mark else 0) from None
        if root is not None:
            self.mark(root, ())

    def mark(self, n, path):
        self.lines[path] = n.start_mark.line + 1
        if isinstance(n, yaml.MappingNode):
            for k, v in n.value:
                self.mark(v, (*path, k.value))
        elif isinstance(n, yaml.SequenceNode):
            for i, v in enumerate(n.value):
                self.mark(v, (*path, i))

    def bad(self, message: str, *path, code: str = "document", help: str = "", rule: str = ""):
        at = next((self.lines[path[:i]] for i in range(len(path), -1, -1) if path[:i] in self.lines), 0)
        self.problems.append(Problem(code, message, rule, at, help))

    def keys(self, d, known, *path) -> bool:
        if not isinstance(d, dict):
            self.bad(f"{'.'.join(map(str, path)) or 'the document'} is not a mapping", *path)
            return False
        for k in d:
            if k not in known:
                self.bad(f"unknown field `{k}`", *path, k, help=suggest(str(k), known))
        return True

    def document(self) -> Document:
        d = self.data
        if not self.keys(d, TOP):
            raise ContractError(*self.problems)
        out = Document("", "")
        if not isinstance(d.get("contract"), str) or not d.get("contract"):
            self.bad("`contract` names the contract")
        else:
            out.contract = d["contract"]
        try:
            out.version = version(d.get("version", "missing"))
        except ContractError as e:
            self.bad(e.problems[0].message, "version", help=e.problems[0].help)
        out.owner, out.inherits = d.get("owner"), d.get("inherits")
        for k in ("binding", "expose"):
            if not d.get(k) and not out.inherits:
                self.bad(f"`{k}` is missing", help="only a contract that inherits may leave it away")
        b = d.get("binding") or {}
        if self.keys(b, ("parquet", "iceberg", "partitioned_by"), "binding") and b:
            if ("parquet" in b) == ("iceberg" in b):
                self.bad("a binding names either parquet or iceberg", "binding")
            if "iceberg" in b and not re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)+", str(b["iceberg"])):
                self.bad(f"not a table: `{b['iceberg']}`", "binding", "iceberg", help="write namespace.table")
            out.binding = b
        if d.get("residency") is not None:
            out.residency = self.residency(d["residency"])
        if d.get("expose") is not None:
            out.expose = self.columns(d["expose"])
        for i, r in enumerate(d.get("rules") or []):
            self.rule(out, r, i)
        x = d.get("extensions") or {}
        if self.keys(x, ("row", "ctx", "dataset"), "extensions"):
            out.extensions = {k: dict(v or {}) for k, v in x.items()}
            for k, v in out.extensions.items():
                for n, t in v.items():
                    self.type(t, "extensions", k, n)
        for i, e in enumerate(d.get("enrich") or []):
            if self.keys(e, ("field", "expr"), "enrich", i):
                out.enrich.append(e)
        for i, e in enumerate(d.get("dataset_other") or []):
            if self.keys(e, ("field", "value", "expr"), "dataset_other", i):
                if ("value" in e) == ("expr" in e):
                    self.bad("a dataset_other field has either value or expr", "dataset_other", i)
                out.dataset_other.append(e)
        if self.problems:
            raise ContractError(*self.problems)
        return out

    def residency(self, r) -> dict | None:
        """Terms of placement; a bare list is its jurisdictions."""
        r = {"jurisdictions": r} if isinstance(r, list) else r
        if not self.keys(r, ("jurisdictions", "approved_output_may_leave"), "residency"):
            return None
        codes, leave = r.get("jurisdictions"), r.get("approved_output_may_leave", False)
        if not isinstance(codes, list) or not codes:
            self.bad("residency names at least one jurisdiction", "residency", code="residency")
            return None
        for x in codes:
            if x not in jurisdictions():
                self.bad(f"unknown jurisdiction `{x}`", "residency", code="residency", help="write a two-letter country code, or EU")
        if not isinstance(leave, bool):
            self.bad("approved_output_may_leave is true or false", "residency", code="residency")
        return {"jurisdictions": sorted(set(map(str, codes)))} | ({"approved_output_may_leave": True} if leave is True else {})

    def type(self, t, *path):
        try:
            return parse_type(str(t))
        except ContractError as e:
            self.bad(e.problems[0].message, *path, code="bad_type", help=e.problems[0].help)

    def columns(self, cols) -> list[dict]:
        out, seen = [], set()
        for i, c in enumerate(cols if isinstance(cols, list) else []):
            if not self.keys(c, ("name", "type", "description"), "expose", i):
                continue
            if "name" not in c or "type" not in c:
                self.bad("an exposed column has a name and a type", "expose", i)
                continue
            if c["name"] in seen:
                self.bad(f"`{c['name']}` is exposed twice", "expose", i, code="duplicate_expose")
            seen.add(c["name"])
            self.type(c["type"], "expose", i)
            out.append({"name": c["name"], "type": c["type"]})
        return out

    def rule(self, out: Document, r, i: int) -> None:
        path = ("rules", i)
        if not isinstance(r, dict) or r.get("op") not in RULES:
            self.bad(f"unknown rule operation `{r.get('op') if isinstance(r, dict) else r}`", *path, help=suggest(str((r or {}).get("op") if isinstance(r, dict) else ""), RULES))
            return
        need, may = RULES[r["op"]]
        self.keys(r, ["id", "op", *need, *may], *path)
        for k in ("id", *need):
            if r.get(k) in (None, ""):
                self.bad(f"{r['op']} needs `{k}`", *path, rule=str(r.get("id", "")))
        rid = str(r.get("id", ""))
        if not re.fullmatch(r"[a-z][a-z0-9_]*", rid):
            self.bad(f"`{rid}` is not a rule id", *path, code="invalid_rule_id", help="use " + (re.sub(r"[^a-z0-9_]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", rid).lower()).strip("_0123456789") or "a_name"))
        if any(o.id == rid for o in out.rules):
            self.bad(f"two rules are called `{rid}`", *path, code="duplicate_rule_id")
        if r["op"] in ON_FAIL and r.get("on_fail") and r["on_fail"] not in ON_FAIL[r["op"]]:
            self.bad(f"{r['op']} takes on_fail {', '.join(ON_FAIL[r['op']])}", *path, "on_fail", help=suggest(str(r["on_fail"]), ON_FAIL[r["op"]]))
        out.rules.append(Rule(**{k: v for k, v in r.items() if k in Rule.__dataclass_fields__ and v is not None}, line=self.lines.get(path, 0)))


def read(text: str) -> Document:
    return Reader(text).document()


def resolve(doc: Document, lookup) -> Document:
    """Flatten a chain: ``lookup(name)`` gives a parent's document.  A child narrows
    what its parent exposes, keeps its binding and adds rules."""
    chain, names = [doc], [doc.contract]
    while chain[0].inherits:
        name = chain[0].inherits
        if name in names:
            raise fail("inheritance", f"contracts inherit in a circle: {' -> '.join([*names, name])}")
        parent = lookup(name)
        if parent is None:
            raise fail("inheritance", f"there is no contract `{name}`")
        names.append(name)
        chain.insert(0, parent)
    out = Document(doc.contract, doc.version, doc.owner or chain[0].owner, None, chain[0].binding, chain[0].residency, chain[0].expose)
    for level, d in enumerate(chain):
        if level:
            if d.binding and d.binding != out.binding:
                raise fail("inheritance", f"`{d.contract}` binds other data than its parent")
            if d.residency is not None:
                wide = [] if out.residency is None else [r for r in d.residency["jurisdictions"] if not out.permits(r)]
                if wide or out.residency is not None and d.output_may_leave and not out.output_may_leave:
                    raise fail("inheritance", f"`{d.contract}` allows {', '.join(wide) or 'approved output to leave'}, which its parent does not")
                out.residency = d.residency
            if d.expose is not None:
                have = {c["name"]: c["type"] for c in out.expose}
                for c in d.expose:
                    if have.get(c["name"]) != c["type"]:
                        raise fail("inheritance", f"`{d.contract}` exposes `{c['name']}`, which its parent does not expose so", help=suggest(c["name"], have))
                out.expose = d.expose
        for r in d.rules:
            if any(o.id == r.id for o in out.rules):
                raise fail("inheritance", f"rule `{r.id}` is in `{d.contract}` and in an ancestor")
            r.layer = level
            out.rules.append(r)
        for k in ("extensions", "enrich", "dataset_other"):
            if getattr(d, k):
                if getattr(out, k):
                    raise fail("inheritance", f"`{k}` stands in `{d.contract}` and in an ancestor")
                setattr(out, k, getattr(d, k))
        out.layers.append(out.expose)
    return out


def json_schema() -> dict:
    """JSON Schema of documents."""
    text, expr = {"type": "string"}, {"type": "string", "minLength": 1}
    rules = []
    for op, (need, may) in RULES.items():
        props: dict = {k: dict(expr) for k in (*need, *may)} | {"id": {"type": "string", "pattern": "^[a-z][a-z0-9_]*$"}, "op": {"const": op}}
        if op in ON_FAIL:
            props["on_fail"] = {"enum": list(ON_FAIL[op])}
        if op == "shape":
            props |= {"operator": {"enum": list(SHAPES)}, "params": {"type": "object"}}
        rules.append({"type": "object", "properties": props, "required": ["id", "op", *need], "additionalProperties": False})
    column = {"type": "object", "properties": {"name": text, "type": text, "description": text}, "required": ["name", "type"], "additionalProperties": False}
    bind = {"type": "object", "properties": {"parquet": text, "iceberg": text, "partitioned_by": {"type": "array", "items": text}}, "additionalProperties": False}
    part = {"type": "object", "additionalProperties": text}
    codes = {"type": "array", "minItems": 1, "items": {"type": "string", "pattern": "^[A-Z]{2}$"}}
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema", "title": "Contract", "type": "object", "required": ["contract", "version"], "additionalProperties": False,
        "properties": {
            "contract": text, "version": {"type": ["integer", "string"]}, "owner": text, "inherits": text, "binding": bind, "residency": {"anyOf": [codes, {"type": "object", "properties": {"jurisdictions": codes, "approved_output_may_leave": {"type": "boolean"}}, "required": ["jurisdictions"], "additionalProperties": False}]},
            "expose": {"type": "array", "items": column}, "rules": {"type": "array", "items": {"oneOf": rules}}, "extensions": {"type": "object", "properties": {k: part for k in ("row", "ctx", "dataset")}, "additionalProperties": False},
            "enrich": {"type": "array", "items": {"type": "object", "properties": {"field": text, "expr": expr}, "required": ["field", "expr"], "additionalProperties": False}},
            "dataset_other": {"type": "array", "items": {"type": "object", "properties": {"field": text, "expr": expr, "value": {}}, "required": ["field"], "additionalProperties": False}},
        },
    }
