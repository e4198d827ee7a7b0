"""Reading bindings and writing governed data."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..compiler import Compiled
from ..errors import fail, suggest
from ..operators.governed import enrich, validate
from ..plans.render import Renderer
from ..types import parse_type


def read_schema(spark: SparkSession, path: str, hints: dict[str, str] | None = None) -> T.StructType:
    """Column types without rows; ``hints`` name types of CSV columns, or logical
    ones (unsigned integers, embeddings) that Spark types cannot say."""
    csv = path.lower().rstrip("/").endswith(".csv")
    got = (spark.read.csv(path, header=True, inferSchema=True) if csv else spark.read.parquet(path)).schema
    names = [f.name for f in got.fields]
    for c in hints or {}:
        if c not in names:
            raise fail("unknown_column", f"--type names `{c}`, which the data do not have", help=suggest(c, names))
    fields = []
    for f in got.fields:
        if hints and f.name in hints:
            rule, name = parse_type(hints[f.name])
            meta = {"logical": rule} if rule and (rule == "uint" or rule.startswith("embedding")) else {}
            f = T.StructField(f.name, spark.sql(f"SELECT CAST(NULL AS {name}) c").schema[0].dataType if csv else f.dataType, True, meta)
        fields.append(f)
    return T.StructType(fields)


def read_data(spark: SparkSession, path: str, hints: dict[str, str] | None = None) -> DataFrame:
    schema = read_schema(spark, path, hints)
    if path.lower().rstrip("/").endswith(".csv"):
        return spark.read.schema(schema).csv(path, header=True)
    return spark.read.parquet(path)


def bound(spark: SparkSession, c: Compiled) -> DataFrame:
    """The data set that the contract binds: a Parquet place, or a catalogue's table."""
    b = c.doc.binding
    return spark.table(b["iceberg"]) if "iceberg" in b else spark.read.parquet(b["parquet"])


def write(df: DataFrame, c: Compiled, path: str) -> dict:
    """Rows with their assert flags (``_c_<id>``) and stored subtrees
    (``_d_<hash>``), laid out for pruning; returns the manifest, written beside
    the data.  A denied write leaves nothing."""
    verdict = validate(df, c)
    if not verdict.valid:
        raise fail("document", f"the data breach {', '.join(verdict.breached)}")
    r = Renderer()
    df = enrich(df, c)
    flags = {f"_c_{i}": F.expr(r.predicate(n)) for i, n, _ in c.asserts}
    extra = {name: F.expr(r.transform(n)) for name, n in c.stored.items()}
    cluster = [f"_c_{i}" for i, _, act in c.asserts if act == "drop"]
    by = c.doc.binding.get("partitioned_by") or []
    out = df.withColumns({**flags, **extra})
    if by:
        out = out.repartition(*by)
    if cluster:
        out = out.sortWithinPartitions(*by, *cluster)
    w = out.write
    for col in c.bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{col}", "true")
    (w.partitionBy(*by) if by else w).parquet(path)
    manifest = {"contract": c.doc.contract, "contract_hash": c.doc.hash, "compilation_hash": c.hash, "written_at": datetime.now(timezone.utc).isoformat(), "row_count": verdict.row_count, "failures": verdict.failures, "guarantees": verdict.guarantees, "stats": {k: str(v) for k, v in verdict.stats.items()}, "layout": {"cluster_by": cluster, "partition_by": by, "bloom": c.bloom}}
    df.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(path.rstrip("/") + "_manifest")
    return manifest
