"""Contracts on data: the governed view of a caller, the one-row verdict, counts
for reports, and comparison with the interpreter.  All of it is plans of built-in
expressions; one aggregation job gives a verdict, however many rules there are."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..compiler import Compiled
from ..errors import fail
from ..functions.checker import Node, show, value_reads
from ..plans.interpreter import EvalError, Interpreter
from ..plans.render import Renderer
from ..types import is_decimal, spark_type


@dataclass
class Caller:
    id: str = "check"
    tenant: str = ""
    purpose: str = "analytics"
    tier: str = ""
    clearance: int = 0
    classification: str = ""
    roles: list = field(default_factory=list)
    now: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    other: dict = field(default_factory=dict)

    def interpreter(self, **more) -> Interpreter:
        return Interpreter(ctx={k: v for k, v in vars(self).items() if k != "other"}, ctx_other=self.other, **more)


@dataclass
class Verdict:
    valid: bool
    breached: list[str]
    row_count: int
    failures: dict[str, int]
    guarantees: dict[str, bool]
    stats: dict[str, object]


class Refused(Exception):
    def __init__(self, rule: str, message: str = ""):
        self.rule = rule
        super().__init__(message or f"the caller is refused by `{rule}`")


def require_session(spark) -> None:
    """Overflow, bad casts and division by zero must raise; times are UTC."""
    if spark.conf.get("spark.sql.ansi.enabled") != "true" or spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z"):
        raise fail("unsupported", "rules need spark.sql.ansi.enabled=true and spark.sql.session.timeZone=UTC")


def conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Columns by name, cast; a missing one is an error."""
    gone = [c for c in schema if c not in df.columns]
    if gone:
        raise fail("unknown_column", f"the data has no column {', '.join(gone)}")
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in schema.items()])


def enrich(df: DataFrame, c: Compiled) -> DataFrame:
    """``_other``: a struct of derived fields, earlier ones inlined in later ones."""
    if not c.enrich or "_other" in df.columns:
        return df
    done: dict[tuple, str] = {}
    for name, n in c.enrich:
        done["other", name] = f"({Renderer(columns=dict(done)).transform(n)})"
    return df.withColumn("_other", F.struct(*[F.expr(done["other", name]).cast(spark_type(n.type)).alias(name) for name, n in c.enrich]))


def renderer(c: Compiled, caller: Caller | None = None, stored: bool = False) -> Renderer:
    literal = caller.interpreter().eval if caller else None
    r = Renderer(literal=literal)
    if stored:
        by = {show(n): name for name, n in c.stored.items()}
        plain = r.sql
        r.sql = lambda n: r.name(by[show(n)]) if by and n.op not in ("lit", "row") and show(n) in by else plain(n)
    return r


def refusals(c: Compiled, caller: Caller) -> list[tuple[str, bool]]:
    """Each decide rule and whether it refuses; an error refuses."""
    out = []
    for rule, n in c.decisions:
        try:
            out.append((rule, caller.interpreter().eval(n) is not True))
        except EvalError:
            out.append((rule, True))
    return out


def refusal_detail(c: Compiled, caller: Caller, rule: str) -> list[str]:
    """The caller's fields that a decide rule reads, as ``ctx.f = value``, in the
    rule's order; a field that the caller lacks is absent."""
    n = next(n for i, n in c.decisions if i == rule)
    out = []
    for x in n.walk():
        if x.op.startswith("ctx"):
            try:
                value = caller.interpreter().eval(x)
                text = f"{show(x)} = {json.dumps(value, default=str, ensure_ascii=False)}"
            except EvalError:
                text = f"{show(x)} is absent"
            if text not in out:
                out.append(text)
    return out


def active_shapes(c: Compiled, caller: Caller) -> list:
    return [s for s in c.shapes if s.unless is None or caller.interpreter().eval(s.unless) is not True]


BUCKETS = 1_000_000


def sample_bucket(column: str, t: str) -> str:
    """FNV-1a, 64 bits, of the value's text, modulo a million.  The state is kept in
    32-bit halves, so that products stay below 2**63; the prime is 2**40 + 435."""
    s = f"CAST(CAST({column} AS string) AS binary)"
    byte = f"conv(hex(substring({s}, i, 1)), 16, 10)"
    lo = f"((s.lo ^ CAST({byte} AS bigint)) * 435L)"
    step = f"named_struct('hi', (s.hi * 435L + ((s.lo ^ CAST({byte} AS bigint)) << 8) + shiftright({lo}, 32)) & 4294967295L, 'lo', {lo} & 4294967295L)"
    zero = "named_struct('hi', 3421674724L, 'lo', 2216829733L)"
    last = f"((s.hi * {2**32 % BUCKETS}L) % {BUCKETS}L + s.lo) % {BUCKETS}L"
    # an empty text has no bytes to step through
    return f"aggregate(CASE WHEN octet_length({s}) = 0 THEN array() ELSE sequence(1, octet_length({s})) END, {zero}, (s, i) -> {step}, s -> {last})"


def laplace(value, scale: float):
    """``value`` plus Laplace noise from the operating system's generator."""
    import os

    import numpy as np
    import pandas as pd

    def noise(v: pd.Series) -> pd.Series:
        raw = np.frombuffer(os.urandom(8 * len(v)), np.uint64)
        u = ((raw >> np.uint64(11)).astype(float) + 0.5) / 2**53 - 0.5
        return v - scale * np.sign(u) * np.log1p(-2 * np.abs(u))

    noise.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return F.pandas_udf(noise, "double").asNondeterministic()(value.cast("double"))


def visible(c: Compiled, r: Renderer) -> list[str]:
    """What a row must satisfy to be seen: admits, then asserts that drop."""
    return [r.predicate(n) for _, n in c.admits] + [r.predicate(n) for _, n, act in c.asserts if act == "drop"]


def view(df: DataFrame, c: Compiled, caller: Caller, stored: bool = False) -> DataFrame:
    """The data as the caller may see them: refused, filtered, projected, sampled
    and noised by row.  Shapes over the caller's own plan are in ``shapes.govern``."""
    require_session(df.sparkSession)
    for rule, no in refusals(c, caller):
        if no:
            raise Refused(rule, c.messages.get(rule, ""))
    r = renderer(c, caller, stored)
    df = enrich(df, c)
    for p in visible(c, r):
        df = df.where(p)
    shapes = active_shapes(c, caller)
    for s in shapes:
        if s.operator == "sample":
            key = s.params["key"]
            df = df.where(f"{sample_bucket(r.name(key), '')} < {round(s.params['fraction'] * BUCKETS)}")
    noised = {s.column: s for s in shapes if s.operator == "noise" and s.params["at"] == "row"}
    out = []
    for name, rule, spark in c.expose:
        x = F.expr(r.transform(c.transforms[name])) if name in c.transforms else F.col(f"`{name}`")
        x = x.cast(spark)
        if name in noised:
            s = noised[name]
            x = laplace(x, s.params["sensitivity"] / s.params["epsilon"])
            x = (F.round(x) if rule in ("int", "uint") else x).cast(spark)
        out.append(x.alias(name))
    return df.select(*out)


# ------------------------------------------------------------------ verdict


def statistics(c: Compiled) -> dict[tuple, tuple[str, str]]:
    """Data-set statistics that guarantees read: path -> (verdict column, kind)."""
    out: dict[tuple, tuple[str, str]] = {}
    for _, n, _ in c.guarantees:
        for x in n.walk():
            if x.op == "data" and x.value[0] not in ("row_count", "written_at", "contract_hash", "other", "assertions") and len(x.value) == 2:
                out[x.value] = ("__".join(x.value), x.value[1])
            if x.op == "data" and x.value[0] == "assertions":
                out[x.value] = (f"{x.value[1]}__pass_rate", "pass_rate")
    return out


def aggregates(c: Compiled, r: Renderer) -> dict[str, str]:
    """First layer: counts, sums and extrema in one pass."""
    spark = r.spark
    agg = {"row_count": "count(1)"}
    one = lambda p: f"count_if({p})" if spark else f"CAST(coalesce(sum(CASE WHEN {p} THEN 1 ELSE 0 END), 0) AS {r.type('int')})"
    for rule, n, _ in c.asserts:
        agg[f"fail__{rule}"] = one(f"NOT ({r.predicate(n)})")
    for path, (name, kind) in statistics(c).items():
        if kind == "pass_rate":
            continue
        col = path[0]
        t = c.source[col][0]
        x = r.read("row", col, t)
        if kind in ("null_count", "null_rate"):
            agg[f"{col}__nulls"] = one(f"{r.name(col)} IS NULL")
        elif kind == "distinct_count":
            agg[name] = f"count(DISTINCT {x})"
        else:
            agg[name] = f"{kind}({x})"
    for f, t, how, x, v in c.data_other:
        e = r.transform(x) if x is not None else ""
        if how == "value":
            agg[f"other__{f}"] = r.value(v, t)
        elif how == "count":
            agg[f"other__{f}"] = "count(1)"
        elif how == "count_distinct":
            agg[f"other__{f}"] = f"count(DISTINCT {e})"
        elif how == "median":
            agg[f"other__{f}"] = f"median(CAST({e} AS {r.type('double')}))"
        else:
            agg[f"other__{f}"] = f"CAST({how}({e}) AS {r.type(t)})"
    return agg


def derived(c: Compiled, r: Renderer) -> tuple[dict[str, str], dict[str, str], list[tuple[str, str]]]:
    """Second layer: rates; third: guarantees; and what makes the data invalid."""
    rates = {}
    where: dict[tuple, str] = {("data", ("row_count",)): "row_count"}
    dbl = r.type("double")
    for path, (name, kind) in statistics(c).items():
        if kind == "null_count":
            rates[name] = r.name(f"{path[0]}__nulls")
        elif kind == "null_rate":
            rates[name] = f"CASE WHEN row_count > 0 THEN CAST({r.name(path[0] + '__nulls')} AS {dbl}) / CAST(row_count AS {dbl}) ELSE CAST(0 AS {dbl}) END"
        elif kind == "pass_rate":
            rates[name] = f"CASE WHEN row_count > 0 THEN CAST(1 AS {dbl}) - CAST({r.name('fail__' + path[1])} AS {dbl}) / CAST(row_count AS {dbl}) ELSE CAST(1 AS {dbl}) END"
        where["data", path] = r.name(name)
    for f, *_ in c.data_other:
        where["data", ("other", f)] = r.name(f"other__{f}")
    r.columns = {**r.columns, **where}
    held, deny = {}, []
    for rule, n, act in c.guarantees:
        if not c.query_time(n):
            held[f"guarantee__{rule}"] = f"coalesce({r.sql(n)}, false)"
            if act == "deny":
                deny.append((rule, f"NOT {r.name('guarantee__' + rule)}"))
    deny = [(rule, f"{r.name('fail__' + rule)} > 0") for rule, _, act in c.asserts if act == "deny"] + deny
    return rates, held, deny


def verdict_frame(df: DataFrame, c: Compiled) -> DataFrame:
    """row_count, fail__*, statistics, guarantee__*, valid, breached: one row."""
    require_session(df.sparkSession)
    r = Renderer()
    df = enrich(df, c)
    out = df.agg(*[F.expr(e).alias(name) for name, e in aggregates(c, r).items()])
    rates, held, deny = derived(c, r)
    out = out.select("*", *[F.expr(e).alias(name) for name, e in rates.items()])
    out = out.select("*", *[F.expr(e).alias(name) for name, e in held.items()])
    valid = F.expr(" AND ".join(f"NOT ({e})" for _, e in deny) or "true")
    breached = F.concat_ws(",", *[F.expr(f"CASE WHEN {e} THEN '{rule}' END") for rule, e in deny]) if deny else F.lit("")
    hidden = [f"{p[0]}__nulls" for p, (_, k) in statistics(c).items() if k in ("null_count", "null_rate")]
    return out.select("*", valid.alias("valid"), breached.alias("breached")).drop(*hidden)


def validate(df: DataFrame, c: Compiled) -> Verdict:
    row = verdict_frame(df, c).first().asDict()
    pick = lambda p: {k[len(p) :]: v for k, v in row.items() if k.startswith(p)}
    rest = {k: v for k, v in row.items() if not k.startswith(("fail__", "guarantee__")) and k not in ("row_count", "valid", "breached")}
    return Verdict(row["valid"], [x for x in row["breached"].split(",") if x], row["row_count"], pick("fail__"), pick("guarantee__"), rest)


def dataset_record(c: Compiled, v: Verdict, written_at: datetime) -> dict:
    """The data set as guarantees read it at query time."""
    out: dict[str, object] = {"row_count": v.row_count, "written_at": written_at, "contract_hash": c.doc.hash}
    for path, (name, _) in statistics(c).items():
        out[".".join(path)] = v.stats.get(name)
    out.update({f"other.{f}": v.stats.get(f"other__{f}") for f, *_ in c.data_other})
    return out


def query_time_guarantees(c: Compiled, v: Verdict, written_at: datetime, caller: Caller) -> dict[str, bool]:
    """Guarantees that need the time or the caller; an error does not hold."""
    data = dataset_record(c, v, written_at)

    def holds(n: Node) -> bool:
        try:
            return caller.interpreter(data=data).eval(n) is True
        except EvalError:
            return False

    return {rule: holds(n) for rule, n, _ in c.guarantees if c.query_time(n)}


# ------------------------------------------------------------------- counts


def selectivity(df: DataFrame, c: Compiled, caller: Caller) -> int:
    r = renderer(c, caller)
    df = enrich(df, c)
    for p in visible(c, r):
        df = df.where(p)
    return df.count()


def rule_counts(df: DataFrame, c: Compiled, caller: Caller) -> DataFrame:
    """One row: total, visible, admit__*, pass__*, changed__*, in one job."""
    r = renderer(c, caller)
    df = enrich(df, c)
    cols = [F.count(F.lit(1)).alias("total"), F.expr(f"count_if({' AND '.join(f'({p})' for p in visible(c, r)) or 'true'})").alias("visible")]
    cols += [F.expr(f"count_if({r.predicate(n)})").alias(f"admit__{i}") for i, n in c.admits]
    cols += [F.expr(f"count_if({r.predicate(n)})").alias(f"pass__{i}") for i, n, _ in c.asserts]
    for name, n in c.transforms.items():
        t = next(s for e, _, s in c.expose if e == name)
        raw = F.col(f"`{name}`")
        cols.append(F.count_if(~F.expr(r.transform(n)).cast(t).cast("string").eqNullSafe(raw.cast("string"))).alias(f"changed__{c.transform_ids[name]}"))
    return df.agg(*cols)


def failing_values(df: DataFrame, c: Compiled, rule: str, top: int = 3) -> DataFrame:
    """The commonest values among rows that fail an assertion."""
    n = next(n for i, n, _ in c.asserts if i == rule)
    r = Renderer()
    reads = sorted({x.value for x in n.walk() if x.op == "row"})
    bad = enrich(df, c).where(f"NOT ({r.predicate(n)})")
    return bad.groupBy(*[F.col(f"`{x}`") for x in reads]).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *[F.col(f"`{x}`") for x in reads]).limit(top)


def failing_report(df: DataFrame, c: Compiled, rules: list[str], top: int = 3) -> dict[str, list[dict]]:
    """``failing_values`` of several assertions in one job: their rows are told apart by
    rule and travel as JSON, as the rules read different columns."""
    out: dict[str, list[dict]] = {i: [] for i in rules}
    parts = [failing_values(df, c, i, top).select(F.lit(i).alias("rule"), "n", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")) for i in rules]
    if parts:
        for r in sorted(reduce(DataFrame.unionAll, parts).collect(), key=lambda r: (-r.n, r.row)):
            out[r.rule].append(json.loads(r.row))
    return out


# ------------------------------------------------------------- differential


def agree(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or a != a and b != b or abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(agree, a, b))
    if isinstance(a, datetime) and isinstance(b, datetime):
        strip = lambda x: (x.astimezone(timezone.utc) if x.tzinfo else x).replace(tzinfo=None)
        return strip(a) == strip(b)
    return a == b or a is None and b is None


def differential(df: DataFrame, c: Compiled, callers: list[Caller], sample: int = 1000) -> dict:
    """Both evaluators over the first ``sample`` rows: evaluations, mismatches."""
    df = enrich(df.limit(sample), c)
    made = 0
    wrong: list[tuple] = []
    rules: list[tuple[str, Node, bool]] = [(i, n, True) for i, n in c.admits] + [(i, n, True) for i, n, _ in c.asserts] + [(c.transform_ids[k], n, False) for k, n in c.transforms.items()]
    for caller in callers:
        r = renderer(c, caller)
        got = df.select(F.struct(*[F.col(f"`{x}`") for x in df.columns]).alias("row"), *[F.expr(r.predicate(n) if test else r.transform(n)).alias(f"r{k}") for k, (_, n, test) in enumerate(rules)]).collect()
        for row in got:
            rec = row["row"].asDict(recursive=True)
            rec = {k: bytes(v) if isinstance(v, bytearray) else v.replace(tzinfo=timezone.utc) if isinstance(v, datetime) and v.tzinfo is None else v for k, v in rec.items()}
            run = caller.interpreter(row=rec)
            for k, (rule, n, test) in enumerate(rules):
                made += 1
                try:
                    want = run.predicate(n) if test else run.transform(n)
                except EvalError as e:
                    want = f"error: {e}"
                have = row[f"r{k}"]
                if isinstance(have, bytearray):
                    have = bytes(have)
                if not agree(want, have):
                    wrong.append((rule, caller.id, want, have))
    return {"evaluations": made, "mismatches": wrong}


__all__ = ["Caller", "Refused", "Verdict", "differential", "is_decimal", "selectivity", "validate", "value_reads", "verdict_frame", "view"]
