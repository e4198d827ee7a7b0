"""Column types that documents name, and the types that rules compute with.

A rule type is text: bool int uint double string bytes timestamp duration,
decimal(18,s), list<T>, embedding<N>.  Physical types that have none (date and
precise decimals) may be exposed but not read by rules.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

from .errors import fail, suggest

#: fixed values: type names by rule type and Spark type
NAMES = {
    **{n: ("bool", "boolean") for n in ("bool", "boolean")},
    "int8": ("int", "tinyint"), "int16": ("int", "smallint"), "int32": ("int", "int"), "int64": ("int", "bigint"),
    "uint8": ("uint", "smallint"), "uint16": ("uint", "int"), "uint32": ("uint", "bigint"), "uint64": ("uint", "decimal(20,0)"),
    "float32": ("double", "float"), "float64": ("double", "double"), "double": ("double", "double"),
    **{n: ("string", "string") for n in ("utf8", "string", "large_utf8")}, **{n: ("bytes", "binary") for n in ("binary", "bytes")},
    **{n: ("timestamp", "timestamp") for n in ("timestamp", *(f"timestamp[{u}]" for u in ("s", "ms", "us", "ns")))},
    **{n: ("duration", "interval day to second") for n in ("duration", *(f"duration[{u}]" for u in ("s", "ms", "us", "ns")))},
    "date32": (None, "date"), "date": (None, "date"),
}
FOREIGN = {"integer": "int64", "int": "int64", "bigint": "int64", "varchar": "utf8", "text": "utf8", "char": "utf8", "float": "float64", "number": "float64", "numeric": "decimal(18,2)", "datetime": "timestamp", "uint": "uint64", "blob": "binary"}
SPARK = {"bool": "boolean", "int": "bigint", "uint": "decimal(20,0)", "double": "double", "string": "string", "bytes": "binary", "timestamp": "timestamp", "duration": "interval day to second"}
ORDERED = {"int", "uint", "double", "string", "bytes", "timestamp", "duration"}


def parse_type(name: str) -> tuple[str | None, str]:
    """(rule type or None, Spark type) of a type name."""
    name = name.strip()
    if name in NAMES:
        return NAMES[name]
    if m := re.fullmatch(r"decimal\(\s*(\d+)\s*,\s*(\d+)\s*\)", name):
        p, s = int(m[1]), int(m[2])
        if not 1 <= p <= 38 or s > p:
            raise fail("bad_type", f"decimal({p},{s}) is out of range")
        return (f"decimal(18,{s})" if p <= 18 else None), f"decimal({p},{s})"
    if m := re.fullmatch(r"fixed_size_list<\s*float32\s*,\s*(\d+)\s*>", name):
        if int(m[1]) < 1:
            raise fail("bad_type", "an embedding has at least one component")
        return f"embedding<{int(m[1])}>", "array<float>"
    if m := re.fullmatch(r"list<(.+)>", name):
        rule, spark = parse_type(m[1])
        return (f"list<{rule}>" if rule else None), f"array<{spark}>"
    hint = f"use `{FOREIGN[name.lower()]}`" if name.lower() in FOREIGN else suggest(name, NAMES)
    raise fail("bad_type", f"unknown type `{name}`", help=hint)


def of_spark(t: T.DataType, meta: dict | None = None) -> str | None:
    """Rule type of a Spark type.  Field metadata ``logical`` restores what Spark
    types cannot say (unsigned integers, embeddings)."""
    if meta and meta.get("logical"):
        return meta["logical"]
    if isinstance(t, T.DecimalType):
        return f"decimal(18,{t.scale})" if t.precision <= 18 else None
    if isinstance(t, T.ArrayType):
        item = of_spark(t.elementType)
        return f"list<{item}>" if item else None
    names = {T.BooleanType: "bool", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "int", T.FloatType: "double", T.DoubleType: "double", T.StringType: "string", T.BinaryType: "bytes", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp", T.DayTimeIntervalType: "duration"}
    return names.get(type(t))


def spark_type(rule: str) -> str:
    if rule.startswith("list<"):
        return f"array<{spark_type(rule[5:-1])}>"
    if rule.startswith("embedding<"):
        return "array<float>"
    return SPARK.get(rule, rule)


def item(rule: str) -> str:
    return rule[5:-1]


def is_list(rule: str) -> bool:
    return rule.startswith("list<")


def is_decimal(rule: str) -> bool:
    return rule.startswith("decimal")


def scale(rule: str) -> int:
    return int(rule[rule.index(",") + 1 : -1])


def exposable(raw_rule: str | None, raw_spark: str, rule: str | None, spark: str) -> bool:
    """Whether a raw column may be shown under a declared type without a transform."""
    if raw_spark == spark or rule is not None and raw_rule == rule:
        return True
    stamps = ("timestamp", "timestamp_ntz")
    return raw_spark in stamps and spark in stamps
