"""Validation of a contract as one SQL query for other engines."""

from __future__ import annotations

from ..compiler import Compiled
from ..errors import fail
from ..operators.governed import aggregates, derived, statistics
from .render import Renderer


def validation_sql(c: Compiled, dialect: str = "duckdb", table: str = "data") -> tuple[str, list[str]]:
    """SQL that returns the verdict row over ``table``, and warnings."""
    r = Renderer(dialect)
    source = ".".join(r.name(x) for x in table.split("."))
    if c.enrich:
        done: dict[tuple, str] = {}
        for name, n in c.enrich:
            done["other", name] = f"({Renderer(dialect, columns=dict(done)).transform(n)})"
        r.columns = dict(done)
    first = ",\n  ".join(f"{e} AS {r.name(k)}" for k, e in aggregates(c, r).items())
    rates, held, deny = derived(c, r)
    more = lambda d: "".join(f", {e} AS {r.name(k)}" for k, e in d.items())
    valid = " AND ".join(f"NOT ({e})" for _, e in deny) or "true"
    if deny:
        breached = "concat_ws(',', " + ", ".join(f"CASE WHEN {e} THEN '{i}' END" for i, e in deny) + ")"
    else:
        breached = "''"
    hidden = {f"{p[0]}__nulls" for p, (_, k) in statistics(c).items() if k in ("null_count", "null_rate")}
    cols = [k for k in [*aggregates(c, Renderer(dialect, columns=dict(r.columns))), *rates, *held] if k not in hidden]
    out = ", ".join(r.name(k) for k in cols)
    sql = f"SELECT {out}, {valid} AS valid, {breached} AS breached FROM (\n SELECT *{more(held)} FROM (\n  SELECT *{more(rates)} FROM (\n  SELECT {first}\n  FROM {source}) a) b) c"
    return sql, sorted(r.warnings)


def substrait(c: Compiled, table: str = "data") -> bytes:
    raise fail("unsupported", "no Substrait producer is installed; export SQL instead")
