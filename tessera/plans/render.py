"""Typed nodes as SQL text, for Spark and other engines.

The null rule's guard is written out; its coalesce is left away where the body
cannot be null under the guard, so that plain comparisons reach the file reader.
Subtrees that read the caller alone are given as literals."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from decimal import Decimal

from ..errors import fail
from ..functions.checker import Node, pattern, value_reads
from ..types import is_decimal, is_list, item, scale, spark_type
from .interpreter import micros

DIALECTS = ("spark", "duckdb", "postgres", "mysql", "sqlite", "bigquery", "snowflake", "default")
FIELDS = {"getFullYear": ("year", 0), "getMonth": ("month", 1), "getDayOfMonth": ("day", 1), "getDayOfWeek": ("dow", 0), "getDayOfYear": ("doy", 1), "getHours": ("hour", 0), "getMinutes": ("minute", 0), "getSeconds": ("second", 0)}
SPARK_FIELDS = {"year": "year", "month": "month", "day": "day", "dow": "dayofweek", "doy": "dayofyear", "hour": "hour", "minute": "minute", "second": "second"}
#: functions whose meaning has been verified beyond Spark and DuckDB
VERIFIED = {"size", "startsWith", "contains"}


class Renderer:
    """``columns`` prints row fields; ``literal`` gives values of caller-only nodes."""

    def __init__(self, dialect: str = "spark", literal=None, other: str = "_other", columns=None):
        if dialect not in DIALECTS:
            raise fail("unsupported", f"unknown dialect `{dialect}`")
        self.d, self.literal, self.other = dialect, literal, other
        self.columns = columns or {}
        self.warnings: set[str] = set()

    @property
    def spark(self) -> bool:
        return self.d == "spark"

    def name(self, s: str) -> str:
        q = "`" if self.d in ("spark", "mysql", "bigquery") else '"'
        return q + s.replace(q, q * 2) + q

    def text(self, s: str) -> str:
        if self.spark:
            s = s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
            return f"'{s}'"
        return "'" + s.replace("'", "''") + "'"

    def type(self, t: str) -> str:
        if self.spark:
            return spark_type(t)
        if is_list(t):
            return self.type(item(t)) + "[]"
        return {"bool": "BOOLEAN", "int": "BIGINT", "uint": "DECIMAL(20,0)" if self.d != "duckdb" else "UBIGINT", "double": "DOUBLE" if self.d != "postgres" else "DOUBLE PRECISION", "string": "VARCHAR", "bytes": "BLOB", "timestamp": "TIMESTAMP", "duration": "INTERVAL"}.get(t, t)

    def value(self, v, t: str) -> str:
        if v is None:
            return f"CAST(NULL AS {self.type(t)})"
        if is_list(t):
            xs = ", ".join(self.value(x, item(t)) for x in v)
            open_, close = ("array(", ")") if self.spark else ("ARRAY[", "]") if self.d == "postgres" else ("[", "]")
            return f"{open_}{xs}{close}" if v else f"CAST({open_}{close} AS {self.type(t)})"
        if t == "bool":
            return "true" if v else "false"
        if t in ("int", "uint"):
            if self.spark and v == -(2**63):
                return "(-9223372036854775807L - 1L)"
            return f"{v}L" if self.spark and t == "int" else f"CAST({v} AS {self.type(t)})"
        if t == "double":
            if v != v or v in (float("inf"), float("-inf")):
                return f"CAST('{'NaN' if v != v else 'Infinity' if v > 0 else '-Infinity'}' AS {self.type(t)})"
            return f"{v!r}D" if self.spark else f"CAST({v!r} AS {self.type(t)})"
        if is_decimal(t):
            return f"CAST('{Decimal(v):f}' AS decimal(18,{scale(t)}))"
        if t == "bytes":
            return f"X'{bytes(v).hex()}'" if self.spark else f"from_hex('{bytes(v).hex()}')"
        if isinstance(v, datetime):
            v = v.astimezone(timezone.utc) if v.tzinfo else v
            return f"TIMESTAMP '{v:%Y-%m-%d %H:%M:%S.%f}'"
        if isinstance(v, timedelta):
            return f"make_dt_interval(0, 0, 0, CAST({Decimal(micros(v)) / 1_000_000} AS decimal(18,6)))" if self.spark else f"INTERVAL '{micros(v)} microseconds'"
        return self.text(str(v))

    def read(self, op: str, name: str, t: str | None = None) -> str:
        if op == "other":
            got = self.columns.get((op, name)) or f"{self.other}.{self.name(name)}"
        else:
            got = self.columns.get((op, name)) or self.name(name)
        return got if t is None or t == "?" or t.startswith(("embedding", "list")) else f"CAST({got} AS {self.type(t)})"

    # ---- the null rule

    def guards(self, n: Node) -> list[str]:
        types = {(x.op, x.value): x.type for x in n.walk() if x.op in ("row", "other")}
        out = []
        for r in sorted(value_reads(n)):
            c = self.read(*r)
            out.append(f"{c} IS NOT NULL")
            if is_list(types[r]):
                out.append(f"NOT exists({c}, x -> x IS NULL)" if self.spark else f"list_count({c}) = len({c})")
        return out

    def nullable(self, n: Node) -> bool:
        """Whether the body can be null although nothing that it reads is."""
        if self.is_caller(n):
            return False
        own = n.op in ("null", "macro", "data") or n.op == "call" and not isinstance(n.value, str) and n.value.owner != "core" or n.op == "in" and n.args[1].op != "list"
        return own or any(self.nullable(a) for a in n.args)

    def is_caller(self, n: Node) -> bool:
        return self.literal is not None and n.ns == frozenset(["ctx"]) and not any(x.op == "var" for x in n.walk())

    def predicate(self, n: Node) -> str:
        body = self.sql(n)
        if self.nullable(n):
            body = f"coalesce({body}, false)"
        return " AND ".join(["(" + g + ")" for g in self.guards(n)] + [f"({body})"])

    def transform(self, n: Node) -> str:
        g = self.guards(n)
        return f"CASE WHEN {' AND '.join(g)} THEN {self.sql(n)} END" if g else self.sql(n)

    # ---- expressions

    def sql(self, n: Node) -> str:
        if self.is_caller(n):
            return self.value(self.literal(n), n.type)
        a = n.args
        if n.op == "lit":
            return self.value(n.value[0], n.type)
        if n.op == "null":
            return self.value(None, n.type)
        if n.op in ("row", "other"):
            return self.read(n.op, n.value, n.type)
        if n.op == "data":
            return self.columns[n.op, n.value]
        if n.op == "var":
            return n.value
        if n.op == "has":
            return f"({self.read(a[0].op, a[0].value)} IS NOT NULL)"
        x = [self.sql(y) for y in a]
        if n.op == "list":
            return (f"array({', '.join(x)})" if self.spark else f"[{', '.join(x)}]")
        if n.op == "not":
            return f"(NOT {x[0]})"
        if n.op == "neg":
            return f"(- {x[0]})"
        if n.op == "cond":
            return f"(CASE WHEN {x[0]} THEN {x[1]} ELSE {x[2]} END)"
        if n.op == "in":
            if a[1].op == "list":
                return f"({x[0]} IN ({', '.join(self.sql(y) for y in a[1].args)}))"
            return f"array_contains({x[1]}, {x[0]})" if self.spark else f"list_contains({x[1]}, {x[0]})"
        if n.op == "bin":
            return self.binary(n, *x)
        if n.op == "macro":
            kind, var = n.value
            if self.spark:
                return f"{ {'exists': 'exists', 'all': 'forall', 'filter': 'filter', 'map': 'transform'}[kind]}({x[0]}, {var} -> {x[1]})"
            inner = f"list_{'transform' if kind == 'map' else 'filter'}({x[0]}, lambda {var}: {x[1] if kind != 'all' else f'NOT ({x[1]})'})"
            return f"(len({inner}) {'>' if kind == 'exists' else '='} 0)" if kind in ("exists", "all") else inner
        return self.call(n, x)

    def binary(self, n: Node, x: str, y: str) -> str:
        op, t = n.value, n.args[0].type
        word = {"&&": "AND", "||": "OR", "==": "=", "!=": "<>"}.get(op, op)
        if op == "+" and t == "string":
            return f"({x} || {y})"
        if op == "/" and t in ("int", "uint"):
            return f"({x} div {y})" if self.spark else f"({x} // {y})" if self.d == "duckdb" else f"CAST(trunc({x} / {y}) AS {self.type(t)})"
        if op == "/" and t == "double" and self.spark:
            # IEEE results where Spark would raise
            return f"(CASE WHEN {y} <> 0 THEN {x} / {y} WHEN {x} = 0 OR isnan({x}) THEN double('NaN') WHEN ({x} > 0) = (string({y}) NOT LIKE '-%') THEN double('Infinity') ELSE double('-Infinity') END)"
        out = f"({x} {word} {y})"
        if t == "double" and word in ("<", "<=", ">", ">=", "=", "<>") and self.d in ("spark", "duckdb"):
            # engines hold NaN equal to itself and above all numbers; rules do not
            lit = [a.op == "lit" for a in n.args]
            if word in (">", ">=") and not lit[0] or word == "=" and not any(lit):
                out = f"({out} AND NOT isnan({x}))"
            elif word in ("<", "<=") and not lit[1]:
                out = f"({out} AND NOT isnan({y}))"
            elif word == "<>" and not any(lit):
                out = f"({out} OR isnan({x}))"
        if is_decimal(n.type) and op in ("+", "-", "*"):
            return f"CAST({out} AS decimal(18,{scale(n.type)}))"
        if n.type == "uint" and op in ("+", "-", "*") and self.spark:
            return f"(CASE WHEN {out} BETWEEN 0 AND 18446744073709551615 THEN CAST({out} AS decimal(20,0)) ELSE raise_error('uint overflow') END)"
        return out

    def call(self, n: Node, x: list[str]) -> str:
        name, t = n.value, n.args[0].type
        if not isinstance(name, str):
            return self.function(name, x)
        if self.d not in ("spark", "duckdb") and name not in VERIFIED:
            self.warnings.add(f"`{name}` has not been verified for {self.d}")
        s = self.spark
        if name == "size":
            if t == "string":
                return f"CAST({'char_length' if s else 'length'}({x[0]}) AS {self.type('int')})"
            if t == "bytes":
                return f"CAST(octet_length({x[0]}) AS {self.type('int')})"
            return f"CAST({'size' if s else 'len'}({x[0]}) AS {self.type('int')})"
        if name in ("startsWith", "endsWith", "contains"):
            return f"{ {'startsWith': ('startswith', 'starts_with'), 'endsWith': ('endswith', 'ends_with'), 'contains': ('contains', 'contains')}[name][not s]}({x[0]}, {x[1]})"
        if name == "matches":
            p = pattern(n.args[1].value[0])
            if s:
                return f"regexp_like({x[0]}, {self.text('(?dU)' + p)})"
            return f"{'regexp_matches' if self.d == 'duckdb' else 'regexp_like'}({x[0]}, {self.text(p)})"
        if name in FIELDS:
            part, off = FIELDS[name]
            if s:
                off += part == "dow"
                got = f"CAST({SPARK_FIELDS[part]}({x[0]}) AS bigint)"
            else:
                got = f"CAST(extract({part} FROM {x[0]}) AS BIGINT)"
            return f"({got} - {off})" if off else got
        if name == "int" and t == "string" and s or name == "uint" and t == "string" and s:
            return f"CAST(CASE WHEN rlike({x[0]}, '^[+-]?[0-9]+\\\\z') THEN {x[0]} ELSE raise_error('not a number') END AS {self.type(name)})"
        if name == "int" and t in ("double",) and not s:
            return f"CAST(trunc({x[0]}) AS {self.type(name)})"
        if name == "uint" and s:
            return f"CAST(CASE WHEN {x[0]} >= 0 AND {x[0]} < 18446744073709551616D THEN {'floor(' + x[0] + ')' if t == 'double' else x[0]} ELSE raise_error('uint overflow') END AS decimal(20,0))"
        return f"CAST({x[0]} AS {self.type(name)})"

    def function(self, f, x: list[str]) -> str:
        if f.owner != "core":
            if not f.body:
                raise fail("untranslatable", f"`{f.name}` has no SQL body")
            body = f.body
            for i, v in enumerate(x):
                body = body.replace(f"${i + 1}", v)
            return f"(CASE WHEN {' AND '.join(f'{v} IS NOT NULL' for v in x) or 'true'} THEN {body} END)"
        s = self.spark
        if self.d not in ("spark", "duckdb"):
            self.warnings.add(f"`{f.name}` has not been verified for {self.d}")
        if f.name == "hash_sha256":
            return f"sha2({x[0]}, 256)" if s else f"sha256({x[0]})"
        if f.name == "redact":
            return "'***'"
        if f.name == "partial":
            return f"(CASE WHEN {x[1]} >= 0 AND {'char_length' if s else 'length'}({x[0]}) > {x[1]} THEN '***' || right({x[0]}, CAST({x[1]} AS int)) ELSE '***' END)"
        p = {"is_msisdn": r"^254[17][0-9]{8}\z", "is_email": r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"}[f.name]
        return f"regexp_like({x[0]}, {self.text(p)})" if s else f"{'regexp_matches' if self.d == 'duckdb' else 'regexp_like'}({x[0]}, {self.text(p)})"
