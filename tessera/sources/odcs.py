"""Import of Open Data Contract Standard (v3) documents."""

from __future__ import annotations

import re

import yaml

from ..errors import fail

#: fixed values: types of the standard and of physical columns, by the type they become
LOGICAL = {"string": "utf8", "integer": "int64", "number": "float64", "boolean": "bool", "date": "date32", "timestamp": "timestamp"}
PHYSICAL = {
    "utf8": ["varchar", "text", "string", "char", "nvarchar", "uuid"], "int64": ["bigint", "int8", "long"], "int32": ["int", "integer", "int4"],
    "int16": ["smallint", "int2"], "float64": ["double", "float8", "double precision"], "float32": ["real", "float", "float4"], "bool": ["boolean", "bool"],
    "date32": ["date"], "timestamp": ["timestamp", "timestamptz", "timestamp_ntz", "timestamp_ltz", "datetime"], "binary": ["bytea", "binary", "varbinary", "blob"],
}
CARRIED = {"apiVersion", "kind", "id", "name", "version", "status", "domain", "tenant", "description", "schema"}


def column_type(p: dict) -> str:
    """The physical type decides where it is a known one, the logical type else; nested
    objects and times of day have no type of ours and are refused."""
    phys = str(p.get("physicalType") or "").strip().lower()
    if m := re.match(r"(?:decimal|numeric)\s*\((\d+)\s*,\s*(\d+)\)", phys):
        return f"decimal({m[1]},{m[2]})"
    for ours, theirs in PHYSICAL.items():
        if phys.split("(")[0] in theirs:
            return ours
    logical = p.get("logicalType") or "string"
    if logical == "array":
        return f"list<{column_type(p['items']) if p.get('items') else 'utf8'}>"
    if logical not in LOGICAL:
        raise fail("document", f"`{p.get('name', 'items')}`: logicalType `{logical}` has no type here")
    return LOGICAL[logical]


def carried_rules(q: dict) -> list | None:
    """Rules under a custom entry's ``implementation``: a rule, a list or YAML text of either."""
    made = q.get("implementation") if q.get("type") == "custom" or q.get("engine") else None
    if isinstance(made, str):
        try:
            made = yaml.safe_load(made)
        except yaml.YAMLError:
            return None
    made = [made] if isinstance(made, dict) else made
    good = isinstance(made, list) and made and all(isinstance(r, dict) and {"id", "op"} <= set(r) for r in made)
    return made if good else None


def rule_id(s: str) -> str:
    return re.sub(r"[^a-z0-9_]+", "_", s.lower()).strip("_") or "rule"


def import_odcs(text: str, obj: str | None = None) -> tuple[dict, list[str]]:
    """(contract as plain record, notes on what did not carry over)."""
    d = yaml.safe_load(text)
    tables = d.get("schema") if isinstance(d, dict) else None
    if not tables:
        raise fail("document", "the document has no schema")
    pick = [t for t in tables if obj in (None, t.get("name"))]
    if not pick:
        raise fail("document", f"there is no object `{obj}`")
    table, notes = pick[0], [f"{k} is not carried over" for k in d if k not in CARRIED]
    if len(tables) > 1 and obj is None:
        notes.append(f"only the first of {len(tables)} objects is imported")
    rules, expose = [], []

    def quality(items, where: str):
        for q in items or []:
            if found := carried_rules(q):
                rules.extend(found)
            else:
                notes.append(f"{where}: quality {q.get('rule') or q.get('metric') or q.get('name') or ''} ({q.get('type', 'library')}) is not carried over")

    for p in table.get("properties") or []:
        name = p["name"]
        expose.append({"name": name, "type": column_type(p)})
        key = p.get("primaryKey")
        if p.get("required") or key:
            rules.append({"id": f"{rule_id(name)}_present", "op": "assert", "expr": f"has(row.{name})", "on_fail": "deny"})
        if p.get("unique") or key:
            rules.append({"id": f"{rule_id(name)}_unique", "op": "guarantee", "expr": f"dataset.{name}.distinct_count == dataset.row_count", "on_fail": "deny"})
        for k in ("classification", "encryptedName", "transformLogic", "criticalDataElement"):
            if p.get(k):
                notes.append(f"{name}.{k} is not carried over")
        quality(p.get("quality"), name)
    quality(table.get("quality"), table.get("name", "object"))
    out = {"contract": f"{rule_id(d.get('domain') or 'imported')}/{rule_id(d.get('name') or table.get('name') or 'contract')}", "version": str(d.get("version", "1")), "binding": {"parquet": f"{table.get('physicalName') or table.get('name')}/"}, "expose": expose, "rules": rules}
    if not re.fullmatch(r"\d+(\.\d+\.\d+)?", out["version"]):
        notes.append(f"version {out['version']} is replaced by 1")
        out["version"] = "1"
    if d.get("tenant"):
        out["owner"] = rule_id(d["tenant"])
    return out, notes
