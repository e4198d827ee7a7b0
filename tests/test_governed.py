import json
from datetime import datetime, timezone

import pytest

from tessera import cli
from tessera.compiler import compile_contract
from tessera.document import read
from tessera.errors import ContractError
from tessera.operators.governed import Caller, Refused, differential, query_time_guarantees, validate, view
from tessera.operators.shapes import govern
from tessera.sources.io import read_data, write
from tessera.streaming.enforce import Counters

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


def make(df, expose, rules, **more):
    d = {"contract": "a/b", "version": 1, "binding": {"parquet": "x/"}, "expose": [{"name": k, "type": v} for k, v in expose.items()], "rules": rules, **more}
    return compile_contract(read(json.dumps(d)), df.schema)


@pytest.fixture(scope="module")
def gauges(spark):
    """River gauges: each column has nulls, and edges of its type."""
    utc = lambda *a: datetime(*a, tzinfo=timezone.utc)
    rows = [
        (10, "Weir 7", 2.25, 14, "north", utc(2023, 6, 30, 6, 0, 1), ["weir", "low"], [4, 8, 15], b"\x01\x02\x03"),
        (11, None, -0.0, 0, "south", None, [], [16], b""),
        (12, "crue-été", float(2**60), -12, None, utc(2025, 3, 31, 23, 0, 0), ["north", None], [], None),
        (13, "", None, None, "north", utc(1985, 5, 17, 17, 45, 9), None, None, b"gauge"),
        (14, "tab\tend\n", -8.5, -2147483648, "east", utc(2024, 12, 30, 0, 0, 0), ["e"], [23, -42], b"\xfe"),
        (15, "ab'c\"d", 0.125, 77, "south", utc(2000, 2, 29, 12, 0, 0), ["ford", "high", "south"], [1, 1], b"0"),
        (16, "254700000001", 1e-300, 5, "south", utc(2024, 1, 1, 9, 30, 0), ["ford"], [2], b"zz"),
    ]
    return spark.createDataFrame(rows, "id long, label string, level double, hits int, basin string, seen timestamp, marks array<string>, runs array<long>, raw binary")


TESTS = [
    "row.hits >= 5 || row.level < 0.0", "row.hits / 3 * 3 + row.hits % 3 == row.hits", "-row.id < -12 && row.label != 'y'", "row.label.endsWith('7') || row.label.contains('été')", "size(row.label) <= 6",
    "row.label.matches('^[a-zA-Z]+[ -]')", "row.label.matches('d$')", "'ford' in row.marks", "row.marks.exists(m, m == row.basin)", "row.marks.all(m, size(m) > 1)", "row.runs.filter(r, r > 3).map(r, r + 1).size() == 2",
    "row.basin in ['north', 'east']", "has(row.runs) || has(row.raw)", "has(row.basin) && row.basin != 'east'", "row.seen.getFullYear() < 2024 || row.seen.getDayOfWeek() == 0", "row.seen.getMonth() == 11", "row.seen.getDayOfYear() < 100",
    "row.seen - duration('24h') < timestamp('2024-06-01T00:00:00Z')", "row.seen - timestamp('2000-01-01T00:00:00Z') > duration('90m')", "row.level / 0.0 < 0.0", "double(row.hits) * 0.25 < 2.0", "string(row.id) + row.label == '15'", "hash_sha256(row.raw) == hash_sha256(row.raw)",
    "size(row.raw) == 1", "is_msisdn(row.label) || is_email('a@b.org')", "(row.level > 1.0 ? row.basin : null) == 'north'", "int(row.level) == 2", "int(string(row.hits)) > 0", "size([row.id, 3, 4]) == 3",
]


def test_differential(gauges):
    gauges = gauges.where("level is null or abs(level) < 1e18")  # int() of more is an error in both
    rules = [{"id": f"a{i}", "op": "assert", "expr": e, "on_fail": "report"} for i, e in enumerate(TESTS)]
    rules += [{"id": "t", "op": "transform", "column": "label", "expr": "row.hits < 10 ? partial(row.label, 3) : (ctx.tenant == 'north' ? redact(row.label) : null)"}, {"id": "m", "op": "admit", "expr": "row.basin == ctx.tenant || 'warden' in ctx.roles"}]
    c = make(gauges, {"label": "utf8"}, rules)
    d = differential(gauges, c, [Caller("p", "north", now=NOW), Caller("q", "east", roles=["warden"], now=NOW)])
    assert d["mismatches"] == []
    assert d["evaluations"] == 2 * 6 * (len(TESTS) + 2)


def test_view_refuses_and_filters(gauges):
    rules = [{"id": "who", "op": "decide", "expr": "ctx.purpose == 'analytics'", "message": "not for this"}, {"id": "own", "op": "admit", "expr": "row.basin == ctx.tenant"}]
    c = make(gauges, {"id": "int64"}, rules)
    assert [r.id for r in view(gauges, c, Caller(tenant="south")).orderBy("id").collect()] == [11, 15, 16]
    with pytest.raises(Refused, match="not for this"):
        view(gauges, c, Caller(purpose="sale"))


def test_pushdown(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(100).selectExpr("id", "id * 2 AS b", "string(id % 3) AS t", "id AS unused").write.parquet(path)
    df = spark.read.parquet(path)
    c = make(df, {"id": "int64"}, [{"id": "r", "op": "admit", "expr": "row.t == ctx.tenant && row.b > 10"}])
    plan = view(df, c, Caller(tenant="1"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(t,1)" in plan and "GreaterThan(b,10)" in plan and "unused" not in plan.split("ReadSchema")[1]


def test_missing_caller_field_fails_closed(gauges):
    c = make(gauges, {"id": "int64"}, [{"id": "r", "op": "decide", "expr": "ctx.other.x == 'y'"}], extensions={"ctx": {"x": "utf8"}})
    with pytest.raises(Refused):
        view(gauges, c, Caller())


def test_verdict_and_query_time_guarantee(spark):
    df = spark.range(100).selectExpr("id", "CASE WHEN id % 20 = 0 THEN NULL ELSE id * 10 - 50 END AS amount")
    c = make(df, {"id": "int64"}, [{"id": "positive", "op": "assert", "expr": "row.amount > 0", "on_fail": "deny"}, {"id": "fresh", "op": "guarantee", "expr": "dataset.written_at > ctx.now - duration('72h')", "on_fail": "annotate"}])
    v = validate(df, c)
    bad = sum(1 for i in range(100) if i % 20 == 0 or i * 10 - 50 <= 0)
    assert not v.valid and v.breached == ["positive"] and v.failures == {"positive": bad} and v.row_count == 100
    assert query_time_guarantees(c, v, NOW, Caller(now=NOW)) == {"fresh": True}
    k = Counters(c)
    k(df, 1)
    k(df, 1)
    assert k.rows == 100 and k.failures == {"positive": bad}


@pytest.fixture(scope="module")
def stays(spark):
    """Hospital stays: four wards of about equal size and one of 15 stays."""
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 200 = 7 THEN 'burns' ELSE concat('ward-', pmod(hash(id), 4)) END AS ward", "1 + id % 23 AS nights", "120.5 + cast(id AS double) AS cost")
    free = {"unless": "'auditor' in ctx.roles"}
    rules = [
        {"id": "part", "op": "shape", "operator": "sample", "params": {"fraction": 0.5, "key": "id"}, **free},
        {"id": "blur", "op": "shape", "operator": "noise", "column": "nights", "params": {"sensitivity": 30, "epsilon": 2.0, "budget": "stays", "at": "row"}, **free},
        {"id": "sums", "op": "shape", "operator": "noise", "column": "cost", "params": {"sensitivity": 500, "epsilon": 0.25, "budget": "money"}, **free},
        {"id": "few", "op": "shape", "operator": "suppress", "params": {"k": 25}, **free},
    ]
    return df, make(df, {"id": "int64", "ward": "utf8", "nights": "int64", "cost": "float64"}, rules)


def test_shapes(spark, stays):
    df, c = stays
    assert view(df, c, Caller(roles=["auditor"])).count() == 3000
    v = view(df, c, Caller())
    assert 1350 < v.count() < 1650
    v.createOrReplaceTempView("stays")
    q, charges = govern("SELECT ward, avg(cost) AS mean, count(*) AS n FROM stays GROUP BY ward", v, c, Caller())
    got = {r.ward: r.mean for r in q.collect()}
    assert sorted(got) == [f"ward-{i}" for i in range(4)] and charges == {"money": 0.25}
    true = {r.ward: r.mean for r in spark.sql("SELECT ward, avg(cost) AS mean FROM stays GROUP BY ward").collect()}
    assert all(got[w] != true[w] for w in got)
    assert govern("SELECT ward, min(nights) AS m FROM stays GROUP BY ward", v, c, Caller())[1] == {"stays": 2.0}
    assert govern("SELECT ward, id FROM stays WHERE id < 20", v, c, Caller())[0].count() == 0
    assert govern("SELECT id FROM stays", v, c, Caller())[0].count() == v.count()
    for bad in ("SELECT id, cost FROM stays", "SELECT cost FROM stays GROUP BY cost", "SELECT ward FROM stays WHERE cost < 200", "SELECT max(cost) FROM stays UNION SELECT cost FROM stays", "SELECT min(cost) OVER (PARTITION BY ward) FROM stays"):
        with pytest.raises(ContractError):
            govern(bad, v, c, Caller())


def test_shapes_enter_every_node(spark, stays):
    df = stays[0]  # without noise by row: a query that is not deterministic cannot stand in an aggregate
    rules = [{"id": "sums", "op": "shape", "operator": "noise", "column": "cost", "params": {"sensitivity": 500, "epsilon": 0.25, "budget": "money"}}, {"id": "few", "op": "shape", "operator": "suppress", "params": {"k": 25}}]
    c = make(df, {"id": "int64", "ward": "utf8", "nights": "int64", "cost": "float64"}, rules)
    v = view(df, c, Caller())
    v.createOrReplaceTempView("stays")
    rows = lambda q: govern(q, v, c, Caller())[0].collect()
    wards = {f"ward-{i}" for i in range(4)}
    bins = "CASE WHEN id % 200 = 7 THEN 99 ELSE id % 30 END"  # one of 31 is small
    few = f"(SELECT count(*) FROM (SELECT {bins} FROM stays GROUP BY {bins}))"
    assert {r.n for r in rows(f"SELECT ward, max({few}) AS n FROM stays GROUP BY ward")} == {30}
    assert len(rows(f"SELECT s.ward FROM (SELECT DISTINCT ward FROM stays) s JOIN (SELECT ward FROM stays GROUP BY ward) t ON s.ward = t.ward AND {few} = 30")) == 4
    assert len(rows(f"SELECT ward FROM stays GROUP BY ward ORDER BY {few}, ward")) == 4
    assert {r.ward for r in rows("SELECT ward FROM stays INTERSECT SELECT ward FROM stays")} == wards
    assert {r.ward for r in rows("SELECT ward FROM stays EXCEPT SELECT 'ward-0'")} == wards - {"ward-0"}
    assert {r.ward for r in govern(v.select("id", "ward").dropDuplicates(["ward"]), v, c, Caller())[0].collect()} == wards
    twice = "WITH t AS (SELECT ward, cost * 2 AS z FROM stays) SELECT a.ward, a.m, b.m AS w FROM (SELECT ward, sum(z) AS m FROM t GROUP BY ward) a JOIN (SELECT ward, max(z) AS m FROM t GROUP BY ward) b ON a.ward = b.ward"
    q, charges = govern(twice, v, c, Caller())
    true = {r.ward: (r.m, r.w) for r in spark.sql(twice).collect()}
    got = {r.ward: (r.m, r.w) for r in q.collect()}
    assert set(got) == wards and charges == {"money": 0.25}
    assert all(x != y and abs(x - y) < 80_000 for k in wards for x, y in zip(got[k], true[k]))
    cube = rows("SELECT ward, id % 2 AS b, sum(cost) AS s FROM stays GROUP BY CUBE(ward, id % 2)")
    assert len(cube) == 15
    assert govern("WITH t AS (SELECT count(*) AS n FROM stays) SELECT n FROM t", v, c, Caller())[1] == {}
    for bad in ("WITH t AS (SELECT cost FROM stays) SELECT cost FROM t", "SELECT ward, sum(nights) AS n FROM stays GROUP BY CUBE(ward, cost)"):
        with pytest.raises(ContractError):
            govern(bad, v, c, Caller())


def test_charges_of_wide_and_foreign_columns(spark, tmp_path):
    spark.range(60).selectExpr("id", *[f"id * {i} AS w{i}" for i in range(40)]).write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    noise = {"id": "n", "op": "shape", "operator": "noise", "column": "w35", "params": {"sensitivity": 1, "epsilon": 0.5, "budget": "b", "at": "row"}}
    c = make(df, {x: "int64" for x in df.columns}, [noise])
    v = view(df, c, Caller())
    v.createOrReplaceTempView("wide")
    spark.range(60).selectExpr("id", "id AS w35").write.parquet(str(tmp_path / "other"))
    spark.read.parquet(str(tmp_path / "other")).createOrReplaceTempView("other")
    charge = lambda q: govern(q, v, c, Caller())[1]
    assert charge("SELECT * FROM wide") == {"b": 0.5}
    assert charge("SELECT w34, sum(w35) AS s FROM wide GROUP BY w34") == {"b": 0.5}
    assert charge("SELECT w34 FROM wide WHERE id IN (SELECT id FROM wide WHERE w35 > 3)") == {"b": 0.5}
    assert charge("SELECT w34, w36 FROM wide") == {} and charge("SELECT count(*) FROM wide") == {}
    assert charge("WITH t AS (SELECT id, w35 AS z FROM wide) SELECT max(z) FROM t") == {"b": 0.5}
    assert charge("SELECT id FROM wide UNION ALL SELECT w35 FROM wide") == {"b": 0.5}
    assert charge("SELECT z.id FROM wide z JOIN wide y ON z.id = y.w35") == {"b": 0.5}
    assert charge("SELECT other.w35 FROM wide JOIN other ON wide.id = other.id") == {}


def test_write_and_read_back(spark, tmp_path):
    df = spark.range(50).selectExpr("id", "string(id % 2) AS t", "'x' || id AS name")
    c = make(df, {"id": "int64", "name": "utf8"}, [{"id": "low", "op": "assert", "expr": "row.id < 40", "on_fail": "drop"}, {"id": "own", "op": "admit", "expr": "row.t == ctx.tenant && row.name.matches('1')"}])
    m = write(df, c, str(tmp_path / "w"))
    back = spark.read.parquet(str(tmp_path / "w"))
    assert m["row_count"] == 50 and "_c_low" in back.columns and set(c.stored) <= set(back.columns)
    live = sorted(r.id for r in view(df, c, Caller(tenant="1")).collect())
    assert live == sorted(r.id for r in view(back, c, Caller(tenant="1"), stored=True).collect())


def test_streaming(spark, tmp_path):
    df = spark.range(20).selectExpr("id", "string(id % 2) AS t")
    df.write.parquet(str(tmp_path / "in"))
    c = make(df, {"id": "int64"}, [{"id": "own", "op": "admit", "expr": "row.t == ctx.tenant"}])
    stream = view(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), c, Caller(tenant="1"))
    q = stream.writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 10


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "d.csv").write_text("order_id,supplier,amount\n1,globex,120\n2,initech,80\n3,globex,-5\n")
    (tmp_path / "c.yaml").write_text("contract: a/b\nversion: 1\nowner: o\nbinding: {parquet: x/}\nexpose: [{name: order_id, type: int64}, {name: amount, type: int64}]\nrules:\n  - {id: own, op: admit, expr: row.supplier == ctx.tenant}\n  - {id: pos, op: assert, expr: row.amount > 0, on_fail: report}\n")
    (tmp_path / "me.yaml").write_text("id: a\ntenant: globex\npurpose: analytics\n")
    assert cli.main(["check", str(tmp_path / "c.yaml"), "--data", str(tmp_path / "d.csv"), "--type", "order_id=int64", "--type", "amount=int64", "--caller", str(tmp_path / "me.yaml"), "--json"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["verdict"]["failures"] == {"pos": 1} and out["callers"][0]["counts"]["visible"] == 2
    assert cli.main(["validate", str(tmp_path / "c.yaml")]) == 2  # the exposed columns do not name `supplier`
    assert cli.main(["validate", str(tmp_path / "c.yaml"), "--type", "supplier=utf8"]) == 0
    assert cli.main(["compile", str(tmp_path / "c.yaml"), "--type", "supplier=utf8", "--sql", "duckdb", "-o", str(tmp_path / "o")]) == 0
    assert cli.main(["lint", str(tmp_path / "c.yaml"), "--type", "supplier=utf8", "--deny-warnings"]) == 0
    assert read_data(spark, str(tmp_path / "d.csv")).count() == 3


def test_check_report(spark, tmp_path, capsys):
    (tmp_path / "d.csv").write_text("id,weight,place\n1,5,a\n2,,b\n3,-1,b\n4,-1,b\n")
    rules = [
        "{id: trusted, op: decide, expr: ctx.clearance >= 2 && ctx.purpose != 'resale'}",
        "{id: heavy, op: assert, expr: row.weight > 0, on_fail: report}",
        "{id: placed, op: assert, expr: row.place == 'b', on_fail: report}",
        "{id: sure, op: assert, expr: row.id > 0, on_fail: report}",
        "{id: fresh, op: guarantee, expr: dataset.written_at > ctx.now - duration('1h'), on_fail: annotate}",
    ]
    (tmp_path / "c.yaml").write_text("contract: a/b\nversion: 1\nowner: o\nbinding: {parquet: x/}\nexpose: [{name: id, type: int64}]\nrules:\n" + "".join(f"  - {r}\n" for r in rules))
    (tmp_path / "low.yaml").write_text("id: low\nclearance: 1\n")
    (tmp_path / "high.yaml").write_text("id: high\nclearance: 3\n")
    cli.main(["check", str(tmp_path / "c.yaml"), "--data", str(tmp_path / "d.csv"), "--type", "id=int64", "--type", "weight=int64", "--caller", str(tmp_path / "low.yaml"), "--caller", str(tmp_path / "high.yaml"), "--json"])
    out = json.loads(capsys.readouterr().out)
    low, high = out["callers"]
    assert low["refused_by"] == ["trusted"] and low["because"] == {"trusted": ["ctx.clearance = 1", 'ctx.purpose = "analytics"']}
    assert high["because"] == {} and high["query_time"] == {"fresh": True}
    assert high["pass_percent"] == {"heavy": 25.0, "placed": 75.0, "sure": 100.0} and high["visible_percent"] == 100.0
    assert out["failing"] == {"heavy": [{"weight": -1, "n": 2}, {"weight": None, "n": 1}], "placed": [{"place": "a", "n": 1}]}
