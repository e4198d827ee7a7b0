"""Queries of the contract engine over the driver's tables, with SQL to check them."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .compiler import Compiled, compile_contract
from .document import read
from .operators.governed import Caller, conform, differential, failing_values, refusals, rule_counts, selectivity, verdict_frame, view
from .operators.shapes import govern
from .plans.export import validation_sql

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)
ADMIN = Caller("a", "acme", roles=["admin"], now=NOW, clearance=3)
PLAIN = Caller("b", "acme", tier="F", roles=["reader", "R"], now=NOW)
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def session(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.ansi.enabled", "true")


def contract(df: DataFrame, expose: dict[str, str], *rules: dict, **more) -> Compiled:
    doc = {"contract": "driver/table", "version": 1, "binding": {"parquet": "data/"}, "expose": [{"name": k, "type": v} for k, v in expose.items()], "rules": list(rules), **more}
    return compile_contract(read(json.dumps(doc)), df.schema)


def admit(expr: str, id: str = "rows") -> dict:
    return {"id": id, "op": "admit", "expr": expr}


def shows(column: str, expr: str) -> dict:
    return {"id": f"t_{column}", "op": "transform", "column": column, "expr": expr}


def must(id: str, expr: str, on_fail: str = "report") -> dict:
    return {"id": id, "op": "assert", "expr": expr, "on_fail": on_fail}


def query(table: str, oracle: str | None = None):
    """Register ``f(df)`` over a table, under the function's name."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            session(spark)
            return f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[f.__name__] = run
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return wrap


def simple(name: str, table: str, expose: dict[str, str], rules: list, oracle: str, caller: Caller = PLAIN, columns: dict | None = None) -> None:
    """A governed view as a query; ``columns`` are derived before the contract."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session(spark)
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        df = df.withColumns({k: F.expr(v) for k, v in (columns or {}).items()})
        return view(df, contract(df, expose, *rules), caller)

    QUERIES[name], ORACLE[name] = run, oracle


ORDERS = {"o_orderkey": "int64", "o_orderstatus": "utf8", "o_totalprice": "float64"}
LINES = {"l_orderkey": "int64", "l_linenumber": "int32"}

# ---- access
simple("admit_ctx_eq", "orders", ORDERS, [admit("row.o_orderstatus == ctx.tier")], "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
simple("admit_in_list", "orders", ORDERS, [admit("row.o_orderstatus in ['F', 'P']")], "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F','P')")
simple("admit_roles_any", "lineitem", LINES, [admit("row.l_returnflag in ctx.roles")], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
simple("admit_exists_macro", "lineitem", LINES, [admit("ctx.roles.exists(r, r == row.l_returnflag)")], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
simple("view_expose_mask", "customer", {"c_custkey": "int64", "c_name": "utf8"}, [shows("c_name", "'admin' in ctx.roles ? row.c_name : hash_sha256(row.c_name)")], "SELECT c_custkey, sha256(c_name) AS c_name FROM customer")
simple("view_partial", "customer", {"c_custkey": "int64", "c_name": "utf8"}, [shows("c_name", "partial(row.c_name, 4)")], "SELECT c_custkey, '***' || right(c_name, 4) AS c_name FROM customer")
simple("view_redact_null_branch", "customer", {"c_custkey": "int64", "c_name": "utf8"}, [shows("c_name", "row.c_acctbal > 0.0 ? redact(row.c_name) : null")], "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN '***' END AS c_name FROM customer")
simple("assert_drop_filters", "lineitem", LINES, [must("small", "row.l_quantity < 25.0", "drop"), admit("row.l_linestatus == 'O'")], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 25 AND l_linestatus = 'O'")
simple("retype_transform", "orders", {"o_orderkey": "utf8", "o_custkey": "int64"}, [shows("o_orderkey", "'k' + string(row.o_orderkey)")], "SELECT 'k' || CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_custkey FROM orders")

# ---- expressions
simple("expr_arith_int", "lineitem", {"l_orderkey": "int64", "l_partkey": "int64", "l_suppkey": "int64"}, [shows("l_partkey", "(row.l_partkey - 700) / 3 + row.l_linenumber * 2"), shows("l_suppkey", "(row.l_suppkey - 50) % 7")], "SELECT l_orderkey, (l_partkey - 700) // 3 + l_linenumber * 2 AS l_partkey, (l_suppkey - 50) % 7 AS l_suppkey FROM lineitem")
simple("expr_double", "lineitem", {"l_orderkey": "int64", "l_extendedprice": "float64"}, [shows("l_extendedprice", "row.l_extendedprice * (1.0 - row.l_discount) / 2")], "SELECT l_orderkey, l_extendedprice * (1.0::double - l_discount) / 2 AS l_extendedprice FROM lineitem")
simple("expr_strings", "part", {"p_partkey": "int64", "p_name": "utf8"}, [admit("row.p_name.contains('a') && !row.p_brand.startsWith('Brand#1') && !row.p_type.endsWith('Z') && size(row.p_name) > 3"), shows("p_name", "row.p_brand + '/' + row.p_name")], "SELECT p_partkey, p_brand || '/' || p_name AS p_name FROM part WHERE contains(p_name, 'a') AND NOT starts_with(p_brand, 'Brand#1') AND NOT ends_with(p_type, 'Z') AND length(p_name) > 3")
simple("expr_regex", "customer", {"c_custkey": "int64", "c_name": "utf8"}, [admit("row.c_name.matches('[0-9]*[13579]$')")], "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[0-9]*[13579]$')")
simple("expr_cond", "orders", {"o_orderkey": "int64", "o_orderpriority": "utf8"}, [shows("o_orderpriority", "row.o_totalprice > 100000.0 ? 'big' : (row.o_totalprice > 1000.0 ? 'mid' : 'small')")], "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' WHEN o_totalprice > 1000 THEN 'mid' ELSE 'small' END AS o_orderpriority FROM orders")
simple("expr_conversions", "lineitem", {"l_orderkey": "int64", "l_partkey": "int64", "l_tax": "float64"}, [shows("l_partkey", "int(row.l_extendedprice) + int(string(row.l_suppkey))"), shows("l_tax", "double(row.l_linenumber) + double('0.5')")], "SELECT l_orderkey, CAST(trunc(l_extendedprice) AS BIGINT) + l_suppkey AS l_partkey, l_linenumber + 0.5::double AS l_tax FROM lineitem")
simple("expr_ts_accessors", "orders", {"o_orderkey": "int64", "o_custkey": "int64"}, [shows("o_custkey", "row.o_orderdate.getFullYear() * 1000000 + row.o_orderdate.getMonth() * 10000 + row.o_orderdate.getDayOfMonth() * 100 + row.o_orderdate.getDayOfWeek() + row.o_orderdate.getDayOfYear() + row.o_orderdate.getHours() + row.o_orderdate.getMinutes() + row.o_orderdate.getSeconds()")], "SELECT o_orderkey, year(o_orderdate) * 1000000 + (month(o_orderdate) - 1) * 10000 + (day(o_orderdate) - 1) * 100 + dayofweek(o_orderdate) + dayofyear(o_orderdate) - 1 + hour(o_orderdate) + minute(o_orderdate) + second(o_orderdate) AS o_custkey FROM orders")
simple("expr_ts_minus_duration", "events", {"event_id": "int64"}, [admit("row.ts - duration('36h') > timestamp('2024-01-10T00:00:00Z')")], "SELECT event_id FROM events WHERE ts - INTERVAL 36 HOUR > TIMESTAMP '2024-01-10'")
simple("expr_decimal", "lineitem", {"l_orderkey": "int64", "d": "decimal(18,4)"}, [shows("d", "row.d * 1.05 - row.e"), admit("row.d >= 1000.50")], "SELECT l_orderkey, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 1.05 AS DECIMAL(18,4)) - CAST(l_tax AS DECIMAL(18,4)) AS d FROM lineitem WHERE CAST(l_extendedprice AS DECIMAL(12,2)) >= 1000.50", columns={"d": "CAST(l_extendedprice AS decimal(12,2))", "e": "CAST(l_tax AS decimal(18,4))"})
simple("list_exists", "embeddings", {"vec_id": "int64"}, [admit("row.e.exists(x, x > 0.35)")], "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x::double > 0.35)) > 0", columns={"e": "CAST(embedding AS array<double>)"})
simple("list_all", "embeddings", {"vec_id": "int64"}, [admit("row.e.all(x, x < 0.3)")], "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: NOT (x::double < 0.3))) = 0", columns={"e": "CAST(embedding AS array<double>)"})
simple("list_filter_map", "embeddings", {"vec_id": "int64", "label": "int64"}, [shows("label", "row.e.filter(x, x > 0.1).map(x, x * 2.0).filter(y, y < 0.4).size()")], "SELECT vec_id, len(list_filter(embedding, lambda x: x::double > 0.1 AND x::double * 2 < 0.4)) AS label FROM embeddings", columns={"e": "CAST(embedding AS array<double>)"})

# ---- the null rule: nulls in every seventh order
HOLES = {"s": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END"}
simple("null_rule_predicate", "orders", {"o_orderkey": "int64"}, [admit("row.s != 'F' || row.o_orderkey > 0")], "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0 AND (o_orderstatus <> 'F' OR o_orderkey > 0)", columns=HOLES)
simple("null_rule_has", "orders", {"o_orderkey": "int64"}, [admit("!has(row.s) && row.o_orderkey > 10")], "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey > 10", columns=HOLES)
simple("null_rule_has_and_value", "orders", {"o_orderkey": "int64"}, [admit("!has(row.s) || row.s != ''")], "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0", columns=HOLES)
simple("null_rule_transform", "orders", {"o_orderkey": "int64", "s": "utf8"}, [shows("s", "row.o_orderkey > 50 ? 'high' : row.s")], "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey > 50 THEN 'high' ELSE o_orderstatus END AS s FROM orders", columns=HOLES)

# ---- shapes
simple("sample_orders", "orders", {"o_orderkey": "int64"}, [{"id": "some", "op": "shape", "operator": "sample", "params": {"fraction": 0.25, "key": "o_orderkey"}}], """SELECT o_orderkey FROM orders WHERE list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(o_orderkey::VARCHAR) + 1), lambda i: ascii(substr(o_orderkey::VARCHAR, i, 1))::HUGEINT)), lambda h, b: (((CAST(h % 18446744073709551616 AS UBIGINT)) | CAST(b AS UBIGINT)) - ((CAST(h % 18446744073709551616 AS UBIGINT)) & CAST(b AS UBIGINT)))::HUGEINT * 1099511628211 % 18446744073709551616) % 1000000 < 250000""")


def governed_sql(name: str, table: str, expose: dict, rules: list, sql: str, oracle: str, caller: Caller = PLAIN):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session(spark)
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        c = contract(df, expose, *rules)
        v = view(df, c, caller)
        v.createOrReplaceTempView(f"v_{name}")
        for t in ("orders", "customer", "nation"):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"t_{t}")
        return govern(sql.replace("VIEW", f"v_{name}"), v, c, caller)[0]

    QUERIES[name], ORACLE[name] = run, oracle


ITEM = {"l_orderkey": "int64", "l_linenumber": "int64", "l_returnflag": "utf8", "l_linestatus": "utf8", "l_quantity": "float64"}
SMALL = {"id": "cells", "op": "shape", "operator": "suppress", "params": {"k": 40}}
OPEN = [admit("row.l_returnflag != 'N'"), SMALL]
L = "(SELECT * FROM lineitem WHERE l_returnflag <> 'N')"
governed_sql("suppress_groupby", "lineitem", ITEM, OPEN, "SELECT l_orderkey % 1000 AS k, count(*) AS n, sum(l_quantity) AS q FROM VIEW GROUP BY 1", f"SELECT l_orderkey % 1000 AS k, count(*) AS n, sum(l_quantity) AS q FROM {L} GROUP BY 1 HAVING count(*) >= 40")
governed_sql("suppress_having_order", "lineitem", ITEM, OPEN, "SELECT l_orderkey % 300 AS k, max(l_quantity) AS q FROM VIEW GROUP BY 1 HAVING min(l_quantity) < 3 ORDER BY k", f"SELECT l_orderkey % 300 AS k, max(l_quantity) AS q FROM {L} GROUP BY 1 HAVING count(*) >= 40 AND min(l_quantity) < 3")
governed_sql("suppress_cube", "lineitem", ITEM, OPEN, "SELECT l_linestatus, l_orderkey % 400 AS k, count(*) AS n FROM VIEW GROUP BY CUBE(l_linestatus, l_orderkey % 400)", f"SELECT l_linestatus, l_orderkey % 400 AS k, count(*) AS n FROM {L} GROUP BY CUBE(l_linestatus, l_orderkey % 400) HAVING count(*) >= 40")
governed_sql("suppress_union", "lineitem", ITEM, OPEN, "SELECT l_orderkey % 1000 AS k, count(*) AS n FROM VIEW GROUP BY 1 UNION ALL SELECT l_linenumber, count(*) FROM VIEW GROUP BY 1", f"SELECT l_orderkey % 1000 AS k, count(*) AS n FROM {L} GROUP BY 1 HAVING count(*) >= 40 UNION ALL SELECT l_linenumber, count(*) FROM {L} GROUP BY 1 HAVING count(*) >= 40")
governed_sql("suppress_in_subquery", "lineitem", ITEM, OPEN, "SELECT o_orderkey FROM t_orders WHERE o_orderkey % 1000 IN (SELECT l_orderkey % 1000 FROM VIEW GROUP BY 1)", f"SELECT o_orderkey FROM orders WHERE o_orderkey % 1000 IN (SELECT l_orderkey % 1000 FROM {L} GROUP BY 1 HAVING count(*) >= 40)")
governed_sql("suppress_ungrouped", "lineitem", ITEM, [admit("row.l_orderkey < 5"), SMALL], "SELECT l_orderkey FROM VIEW", "SELECT l_orderkey FROM lineitem WHERE l_orderkey < 5 AND (SELECT count(*) FROM lineitem WHERE l_orderkey < 5) >= 40")
governed_sql("caller_join", "lineitem", ITEM, OPEN[:1], "SELECT o_orderstatus, count(*) AS n, sum(l_quantity) AS q FROM VIEW JOIN t_orders ON l_orderkey = o_orderkey GROUP BY 1", f"SELECT o_orderstatus, count(*) AS n, sum(l_quantity) AS q FROM {L} JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
governed_sql("caller_semi_anti", "lineitem", ITEM, OPEN[:1], "SELECT count(*) AS n FROM t_orders WHERE o_orderkey IN (SELECT l_orderkey FROM VIEW) AND NOT EXISTS (SELECT 1 FROM VIEW WHERE l_orderkey = o_orderkey AND l_quantity > 45)", f"SELECT count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM {L}) AND NOT EXISTS (SELECT 1 FROM {L} WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
governed_sql("caller_window", "lineitem", ITEM, OPEN[:1], "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_linestatus) AS rn, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS q FROM VIEW", f"SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_linestatus) AS rn, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS q FROM {L}")
governed_sql("caller_rollup", "lineitem", ITEM, OPEN[:1], "SELECT l_returnflag, l_linestatus, count(*) AS n FROM VIEW GROUP BY ROLLUP(l_returnflag, l_linestatus)", f"SELECT l_returnflag, l_linestatus, count(*) AS n FROM {L} GROUP BY ROLLUP(l_returnflag, l_linestatus)")
governed_sql("caller_setops", "lineitem", ITEM, OPEN[:1], "SELECT l_orderkey FROM VIEW INTERSECT SELECT o_orderkey FROM t_orders EXCEPT SELECT c_custkey FROM t_customer", f"SELECT l_orderkey FROM {L} INTERSECT SELECT o_orderkey FROM orders EXCEPT SELECT c_custkey FROM customer")
governed_sql("caller_recursive", "lineitem", ITEM, OPEN[:1], "WITH RECURSIVE r(k, d) AS (SELECT CAST(1 AS bigint), 0 UNION ALL SELECT k * 2, d + 1 FROM r WHERE d < 8) SELECT d, k, (SELECT count(*) FROM VIEW WHERE l_orderkey < 256) AS n FROM r", f"WITH RECURSIVE r(k, d) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT k * 2, d + 1 FROM r WHERE d < 8) SELECT d, k, (SELECT count(*) FROM {L} WHERE l_orderkey < 256) AS n FROM r")
NOISE = {"id": "n", "op": "shape", "operator": "noise", "column": "l_quantity", "params": {"sensitivity": 10, "epsilon": 1.0, "budget": "b"}}


def noised(name: str, sql: str, oracle: str) -> None:
    """A query with noise on its column ``q`` beside the same query without: what is exact, that
    every ``q`` has moved, and none by more than 40 times the scale (10, a chance of e^-40)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session(spark)
        df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        c = contract(df, ITEM, NOISE)
        v = view(df, c, PLAIN)
        v.createOrReplaceTempView(f"v_{name}")
        df.createOrReplaceTempView(f"raw_{name}")
        out, charges = govern(sql.replace("VIEW", f"v_{name}"), v, c, PLAIN)
        raw = spark.sql(sql.replace("VIEW", f"raw_{name}")).withColumnRenamed("q", "raw")
        keys = [k for k in out.columns if k != "q"]
        both = out.alias("o").join(raw.alias("r"), [F.col(f"o.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
        moved = F.abs(F.col("q") - F.col("raw"))
        return both.select(*[f"o.{k}" for k in keys], (moved > 0).alias("changed"), (moved < 400).alias("near"), F.lit(charges.get("b")).alias("charged"))

    QUERIES[name], ORACLE[name] = run, f"SELECT *, true AS changed, true AS near, 1.0::DOUBLE AS charged FROM ({oracle})"


noised("agg_noise_bounds", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM VIEW GROUP BY 1", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
noised("agg_noise_cte", "WITH t AS (SELECT l_linestatus AS s, l_quantity * 1.0 AS z FROM VIEW WHERE l_orderkey > 7) SELECT s, count(*) AS n, avg(z) AS q FROM t GROUP BY s", "SELECT l_linestatus AS s, count(*) AS n FROM lineitem WHERE l_orderkey > 7 GROUP BY 1")
noised("agg_noise_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM VIEW GROUP BY ROLLUP(l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)")


@query("lineitem", "SELECT 'all' AS reads, 0.5::DOUBLE AS charged UNION ALL SELECT 'another', NULL UNION ALL SELECT 'grouped', 0.5")
def charges_wide(df):
    """Budgets charged over a view of many columns, by what a query reads."""
    df = df.withColumns({f"w{i}": F.col("l_orderkey") + i for i in range(30)})
    rule = {"id": "n", "op": "shape", "operator": "noise", "column": "w25", "params": {"sensitivity": 1, "epsilon": 0.5, "budget": "b", "at": "row"}}
    c = contract(df, {f"w{i}": "int64" for i in range(30)}, rule)
    v = view(df, c, PLAIN)
    v.createOrReplaceTempView("v_charges_wide")
    asked = {"all": "SELECT * FROM v_charges_wide", "another": "SELECT w24 FROM v_charges_wide", "grouped": "SELECT w1, max(w25) AS m FROM v_charges_wide GROUP BY w1"}
    return df.sparkSession.createDataFrame([(k, govern(q, v, c, PLAIN)[1].get("b")) for k, q in asked.items()], "reads string, charged double")


governed_sql("suppress_agg_subquery", "lineitem", ITEM, OPEN, "SELECT l_linestatus, count(*) AS n, sum(l_linenumber + (SELECT count(*) FROM (SELECT l_orderkey % 1000 AS k FROM VIEW GROUP BY 1))) AS s FROM VIEW GROUP BY 1", f"SELECT l_linestatus, count(*) AS n, CAST(sum(l_linenumber + (SELECT count(*) FROM (SELECT l_orderkey % 1000 AS k FROM {L} GROUP BY 1 HAVING count(*) >= 40) HAVING count(*) >= 40)) AS BIGINT) AS s FROM {L} GROUP BY 1 HAVING count(*) >= 40")
governed_sql("suppress_intersect", "lineitem", ITEM, OPEN, "SELECT l_orderkey % 1000 AS k FROM VIEW INTERSECT SELECT o_orderkey % 500 FROM t_orders", f"SELECT l_orderkey % 1000 AS k FROM {L} GROUP BY 1 HAVING count(*) >= 40 INTERSECT SELECT o_orderkey % 500 FROM orders")
governed_sql("suppress_distinct", "lineitem", ITEM, OPEN, "SELECT DISTINCT l_orderkey % 700 AS k, l_linestatus FROM VIEW", f"SELECT l_orderkey % 700 AS k, l_linestatus FROM {L} GROUP BY 1, 2 HAVING count(*) >= 40")

# ---- callers' own joins, windows and grouping sets
governed_sql("caller_range_join", "lineitem", ITEM, OPEN[:1], "SELECT n_nationkey, count(*) AS n FROM VIEW JOIN t_nation ON l_quantity BETWEEN n_nationkey AND n_nationkey + 5 GROUP BY 1", f"SELECT n_nationkey, count(*) AS n FROM {L} JOIN nation ON l_quantity BETWEEN n_nationkey AND n_nationkey + 5 GROUP BY 1")
governed_sql("caller_outer_join", "lineitem", ITEM, OPEN[:1], "SELECT o_orderstatus, count(*) AS n, count(l_linenumber) AS lines FROM t_orders LEFT JOIN VIEW ON o_orderkey = l_orderkey AND l_quantity > 30 GROUP BY 1", f"SELECT o_orderstatus, count(*) AS n, count(l_linenumber) AS lines FROM orders LEFT JOIN {L} ON o_orderkey = l_orderkey AND l_quantity > 30 GROUP BY 1")
SORTED = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_linestatus"
FRAMES = f"SELECT l_orderkey, l_linenumber, lag(l_quantity) OVER (w) AS before, lead(l_quantity, 2, -1) OVER (w) AS after, first_value(l_quantity) OVER (w) AS first, sum(l_quantity) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, rank() OVER (w) AS r, dense_rank() OVER (w) AS d, ntile(3) OVER (w) AS t".replace("(w", f"({SORTED}")
governed_sql("caller_window_frames", "lineitem", ITEM, OPEN[:1], f"{FRAMES} FROM VIEW", f"{FRAMES} FROM {L}")
SETS = "SELECT l_returnflag, l_linestatus, count(*) FILTER (WHERE l_quantity > 10) AS n, count(DISTINCT l_linenumber) AS lines, sum(l_quantity) AS q"
governed_sql("caller_grouping_sets", "lineitem", ITEM, OPEN[:1], f"{SETS} FROM VIEW GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", f"{SETS} FROM {L} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
simple("expr_unary_uint", "lineitem", {"l_orderkey": "int64", "l_partkey": "int64"}, [shows("l_partkey", "-row.l_partkey + int(uint(row.l_linenumber))"), admit("uint(row.l_linenumber) >= uint(3) && row.l_orderkey in [-1, 1, 2, 3, 32, 33, 34, 35]")], "SELECT l_orderkey, -l_partkey + l_linenumber AS l_partkey FROM lineitem WHERE l_linenumber >= 3 AND l_orderkey IN (-1, 1, 2, 3, 32, 33, 34, 35)")
simple("expr_formats", "customer", {"c_custkey": "int64"}, [admit("(is_email(row.mail) || is_msisdn(row.tel)) && size(row.mail) > 12")], "SELECT c_custkey FROM customer WHERE (c_custkey % 3 = 0 OR c_custkey % 2 = 0) AND length('c' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '@' ELSE ' ' END || 'mail.example') > 12", columns={"mail": "'c' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '@' ELSE ' ' END || 'mail.example'", "tel": "CASE WHEN c_custkey % 2 = 0 THEN '2547' ELSE '2537' END || lpad(string(c_custkey), 8, '0')"})


# ---- quality
RULES = [
    must("cheap", "row.o_totalprice < 200000.0"), must("keyed", "has(row.o_orderkey)", "deny"), must("known", "row.o_orderstatus in ['F', 'O']", "deny"),
    {"id": "many", "op": "guarantee", "expr": "dataset.row_count > 10 && dataset.o_custkey.null_rate < 0.01", "on_fail": "deny"},
    {"id": "rated", "op": "guarantee", "expr": "dataset.assertions.cheap.pass_rate >= 0.999", "on_fail": "annotate"},
    {"id": "spread", "op": "guarantee", "expr": "dataset.o_custkey.distinct_count > 5 && dataset.o_totalprice.max > dataset.o_totalprice.min && dataset.o_totalprice.null_count == 0", "on_fail": "annotate"},
]
VERDICT = """SELECT n AS row_count, cheap AS fail__cheap, 0::BIGINT AS fail__keyed, known AS fail__known, nd AS o_custkey__distinct_count, hi AS o_totalprice__max, lo AS o_totalprice__min,
 0::BIGINT AS o_totalprice__null_count, 0::DOUBLE AS o_custkey__null_rate, 1 - cheap::DOUBLE / n AS cheap__pass_rate, n > 10 AS guarantee__many, 1 - cheap::DOUBLE / n >= 0.999 AS guarantee__rated, nd > 5 AND hi > lo AS guarantee__spread,
 known = 0 AND n > 10 AS valid, concat_ws(',', CASE WHEN known > 0 THEN 'known' END, CASE WHEN n <= 10 THEN 'many' END) AS breached
 FROM (SELECT count(*) n, count(*) FILTER (NOT o_totalprice < 200000) cheap, count(*) FILTER (o_orderstatus NOT IN ('F','O')) known, count(DISTINCT o_custkey) nd, max(o_totalprice) hi, min(o_totalprice) lo FROM orders)"""


@query("orders", VERDICT)
def verdict_orders(df):
    return verdict_frame(df, contract(df, ORDERS, *RULES))


@query("orders", """SELECT 0::BIGINT AS row_count, 0::BIGINT AS fail__cheap, 0::BIGINT AS fail__keyed, 0::BIGINT AS fail__known, 0::BIGINT AS o_custkey__distinct_count, NULL::DOUBLE AS o_totalprice__max, NULL::DOUBLE AS o_totalprice__min,
 0::BIGINT AS o_totalprice__null_count, 0::DOUBLE AS o_custkey__null_rate, 1::DOUBLE AS cheap__pass_rate, false AS guarantee__many, true AS guarantee__rated, false AS guarantee__spread, false AS valid, 'many' AS breached""")
def empty_dataset_verdict(df):
    return verdict_frame(df.where("false"), contract(df, ORDERS, *RULES))


@query("lineitem", """SELECT count(*) AS row_count, count(*) FILTER (NOT l_quantity > 2) AS fail__r0, count(*) FILTER (NOT l_discount < 0.09) AS fail__r1, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'O') AS fail__r2,
 CAST(sum(l_quantity) AS DOUBLE) AS other__total, avg(l_tax) AS other__mean, median(l_extendedprice) AS other__mid, count(DISTINCT l_suppkey) AS other__suppliers, min(l_shipdate)::TIMESTAMP AS other__first, count(*) AS other__n, 'driver' AS other__src, true AS valid, '' AS breached FROM lineitem""")
def verdict_lineitem_other(df):
    fields = {"total": "float64", "mean": "float64", "mid": "float64", "suppliers": "int64", "first": "timestamp", "n": "int64", "src": "utf8"}
    made = [{"field": f, "expr": e} for f, e in (("total", "sum(row.l_quantity)"), ("mean", "avg(row.l_tax)"), ("mid", "median(row.l_extendedprice)"), ("suppliers", "count_distinct(row.l_suppkey)"), ("first", "min(row.l_shipdate)"), ("n", "count()"))] + [{"field": "src", "value": "driver"}]
    rules = [must("r0", "row.l_quantity > 2.0"), must("r1", "row.l_discount < 0.09"), must("r2", "!(row.l_returnflag == 'A' && row.l_linestatus == 'O')")]
    return verdict_frame(df, contract(df, LINES, *rules, extensions={"dataset": fields}, dataset_other=made))


@query("orders", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def failing_values_top3(df):
    return failing_values(df, contract(df, ORDERS, must("open", "row.o_orderstatus == 'O'")), "open")


@query("orders", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 1000) AS visible, count(*) FILTER (o_orderstatus = 'F') AS admit__rows, count(*) FILTER (o_totalprice > 1000) AS pass__big, count(*) FILTER (o_totalprice > 50000) AS changed__t_o_orderstatus FROM orders")
def report_counts(df):
    c = contract(df, ORDERS, admit("row.o_orderstatus == ctx.tier"), must("big", "row.o_totalprice > 1000.0", "drop"), shows("o_orderstatus", "row.o_totalprice > 50000.0 ? redact(row.o_orderstatus) : row.o_orderstatus"))
    return rule_counts(df, c, PLAIN)


@query("orders", "SELECT 'admin' AS caller, count(*) AS n FROM orders UNION ALL SELECT 'plain', count(*) FILTER (o_orderstatus = 'F') FROM orders")
def selectivity_by_caller(df):
    c = contract(df, ORDERS, admit("row.o_orderstatus == ctx.tier || 'admin' in ctx.roles"))
    return df.sparkSession.createDataFrame([("admin", selectivity(df, c, ADMIN)), ("plain", selectivity(df, c, PLAIN))], "caller string, n long")


@query("orders", "SELECT 'admins' AS rule, true AS refused UNION ALL SELECT 'purposes', false")
def decide_refusal(df):
    c = contract(df, ORDERS, {"id": "admins", "op": "decide", "expr": "'admin' in ctx.roles"}, {"id": "purposes", "op": "decide", "expr": "ctx.purpose in ['analytics']"})
    return df.sparkSession.createDataFrame(refusals(c, PLAIN), "rule string, refused boolean")


@query("orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE (CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'low' END) = 'low' AND o_totalprice < 90000")
def enrich_other(df):
    more = {"extensions": {"row": {"band": "utf8", "flag": "bool"}, "ctx": {"limit": "float64"}}, "enrich": [{"field": "band", "expr": "row.o_totalprice > 150000.0 ? 'high' : 'low'"}, {"field": "flag", "expr": "row.other.band == 'low'"}]}
    c = contract(df, {"o_orderkey": "int64", "o_totalprice": "float64"}, admit("row.other.flag && row.o_totalprice < ctx.other.limit"), **more)
    return view(df, c, Caller(other={"limit": 90000.0}))


@query("customer", "SELECT c_custkey, sha256(sha256(c_name) || '!') AS c_name FROM customer WHERE c_acctbal > 0")
def child_view(df):
    parent = read(json.dumps({"contract": "a/base", "version": 1, "binding": {"parquet": "c/"}, "expose": [{"name": "c_custkey", "type": "int64"}, {"name": "c_name", "type": "utf8"}, {"name": "c_acctbal", "type": "float64"}], "rules": [admit("row.c_acctbal > 0.0", "funded"), {"id": "hashed", "op": "transform", "column": "c_name", "expr": "hash_sha256(row.c_name)"}]}))
    child = read(json.dumps({"contract": "a/child", "version": 2, "inherits": "a/base", "expose": [{"name": "c_custkey", "type": "int64"}, {"name": "c_name", "type": "utf8"}], "rules": [{"id": "again", "op": "transform", "column": "c_name", "expr": "hash_sha256(row.c_name + '!')"}]}))
    return view(df, compile_contract(child, df.schema, lookup={"a/base": parent}.get), PLAIN)


@query("customer", "SELECT c_custkey, CASE WHEN regexp_matches(c_name, '[02468]$') THEN sha256(c_name) ELSE c_name END AS c_name FROM customer WHERE regexp_matches(c_name, '#0')")
def split_stored_equals_live(df):
    c = contract(df, {"c_custkey": "int64", "c_name": "utf8"}, admit("row.c_name.matches('#0')"), shows("c_name", "row.c_name.matches('[02468]$') ? hash_sha256(row.c_name) : row.c_name"))
    from .plans.render import Renderer

    stored = df.withColumns({k: F.expr(Renderer().transform(n)) for k, n in c.stored.items()})
    return view(stored, c, PLAIN, stored=True)


@query("orders", "SELECT 0::BIGINT AS mismatches, true AS enough")
def differential_mismatches(df):
    c = contract(df, ORDERS, admit("row.o_orderstatus == ctx.tier || 'admin' in ctx.roles"), must("m", "row.o_orderkey % 7 / 2 == 1 || row.o_orderpriority.contains('URGENT')"), must("y", "row.o_orderdate.getMonth() < 6 && row.o_orderdate > timestamp('1995-01-01T00:00:00Z')"), shows("o_orderstatus", "partial(row.o_orderpriority, 3) + string(row.o_custkey)"))
    d = differential(df.orderBy("o_orderkey"), c, [ADMIN, PLAIN], 300)
    return df.sparkSession.createDataFrame([(len(d["mismatches"]), d["evaluations"] > 1000)], "mismatches long, enough boolean")


@query("orders", None)
def conform_cast(df):
    return conform(df, {"o_orderkey": "string", "o_totalprice": "decimal(18,2)", "o_orderdate": "timestamp"})


ORACLE["conform_cast"] = "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate FROM orders"


def row_noise_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    session(spark)
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    c = contract(df, ORDERS, {"id": "n", "op": "shape", "operator": "noise", "column": "o_totalprice", "params": {"sensitivity": 100, "epsilon": 1.0, "budget": "b", "at": "row"}})
    both = view(df, c, PLAIN).join(df.select("o_orderkey", F.col("o_totalprice").alias("raw")), "o_orderkey")
    d = F.abs(F.col("o_totalprice") - F.col("raw"))
    return both.agg(F.count(F.lit(1)).alias("n"), (F.avg((d > 0).cast("double")) > 0.99).alias("changed"), F.avg(d).between(80, 120).alias("near_scale"))


QUERIES["row_noise_bounds"] = row_noise_bounds
ORACLE["row_noise_bounds"] = "SELECT count(*) AS n, true AS changed, true AS near_scale FROM orders"


def exported() -> str:
    """Our own exported SQL, run by the other engine as the check."""
    from .types import parse_type

    doc = {"contract": "driver/orders", "version": 1, "binding": {"parquet": "data/"}, "expose": [{"name": k, "type": v} for k, v in ORDERS.items()], "rules": RULES}
    c = compile_contract(read(json.dumps(doc)), {k: parse_type(v) for k, v in {**ORDERS, "o_custkey": "int64"}.items()})
    return validation_sql(c, "duckdb", "orders")[0]


QUERIES["duckdb_sql_roundtrip"] = QUERIES["verdict_orders"]
ORACLE["duckdb_sql_roundtrip"] = exported()
