import json

import pytest

from tessera.compiler import compile_contract
from tessera.document import json_schema, read, version
from tessera.errors import ContractError
from tessera.functions.checker import Checker, Scope, show
from tessera.functions.registry import BUILTIN, Registry
from tessera.lint import lint
from tessera.plans.export import substrait, validation_sql
from tessera.sources.artifact import from_bytes, to_bytes
from tessera.sources.odcs import import_odcs
from tessera.types import parse_type

COLUMNS = {"order_id": "int64", "email": "utf8", "tenant": "utf8", "qty": "int32", "big": "uint64", "price": "float64", "amount": "decimal(18,2)", "tags": "list<utf8>", "vec": "fixed_size_list<float32, 3>", "day": "date32", "at": "timestamp"}
SOURCE = {k: parse_type(v) for k, v in COLUMNS.items()}


def doc(*rules, **more):
    base = {"contract": "a/b", "version": 1, "owner": "o", "binding": {"parquet": "x/"}, "expose": [{"name": "order_id", "type": "int64"}, {"name": "email", "type": "utf8"}]}
    return read(json.dumps(base | {"rules": list(rules)} | more))


def code(*rules, **more):
    with pytest.raises(ContractError) as e:
        compile_contract(doc(*rules, **more), SOURCE)
    return e.value.problems[0].code


def rule(op, expr, **more):
    return {"id": "a", "op": op, "expr": expr, **more}


@pytest.mark.parametrize(
    ("r", "want"),
    [
        (rule("decide", "row.qty > 1"), "namespace"),
        (rule("assert", "row.tenant == ctx.tenant", on_fail="drop"), "namespace"),
        (rule("guarantee", "dataset.row_count > 0 && ctx.tenant == 'x'", on_fail="deny"), "namespace"),
        (rule("admit", "dataset.row_count > 0"), "namespace"),
        (rule("admit", "row.nope > 1"), "unknown_column"),
        (rule("admit", "ctx.team == 'x'"), "unknown_field"),
        (rule("admit", "qty > 1"), "unknown_identifier"),
        (rule("guarantee", "dataset.assertions.nope.pass_rate > 0.5", on_fail="deny"), "unknown_field"),
        (rule("admit", "row.amount / 2 > 0.00"), "outside_profile"),
        (rule("admit", "row.amount > 1.005"), "type_mismatch"),
        (rule("admit", "row.qty > 1.5"), "type_mismatch"),
        (rule("admit", "row.qty + 1"), "type_mismatch"),
        (rule("admit", "row.email.startsWith(1)"), "no_matching_overload"),
        (rule("admit", "hash_sha256(row.qty) == 'x'"), "no_matching_overload"),
        (rule("admit", "nosuch(row.qty)"), "unknown_function"),
        (rule("admit", "row.day == row.day"), "unreadable_column"),
        (rule("admit", "row.email == null"), "outside_profile"),
        (rule("admit", "row.tags == row.tags"), "outside_profile"),
        (rule("admit", "row.tags[0] == 'a'"), "outside_profile"),
        (rule("admit", "row.tags.exists_one(t, t == 'a')"), "outside_profile"),
        (rule("admit", "row.email matches 'a'"), "parse"),
        (rule("admit", "row.email.matches('(?=a)')"), "outside_profile"),
        (rule("transform", "row.qty", column="email"), "type_mismatch"),
        (rule("transform", "row.email", column="qty"), "transform_target"),
        ({"id": "a", "op": "shape", "operator": "blur"}, "unknown_shape_operator"),
        ({"id": "a", "op": "shape", "operator": "suppress", "params": {"k": 0}}, "shape_params"),
        ({"id": "a", "op": "shape", "operator": "suppress", "params": {"k": 5}, "unless": "row.qty > 1"}, "namespace"),
    ],
)
def test_rejections(r, want):
    assert code(r) == want


@pytest.mark.parametrize("text", ["row.qty = 1", "row.email and true", "row.email is null", "row.email like 'x'"])
def test_habits_get_a_hint(text):
    with pytest.raises(ContractError) as e:
        compile_contract(doc(rule("admit", text)), SOURCE)
    assert e.value.problems[0].help


def test_all_structural_problems_are_told():
    with pytest.raises(ContractError) as e:
        read("contract: a/b\nversion: 1.5\nbindin: x\nrules:\n  - {id: Bad Id, op: admit}\n  - {id: b, op: asert}\n")
    assert len(e.value.problems) >= 5 and any("binding" in p.help for p in e.value.problems) and all(p.line for p in e.value.problems)


def test_canonical_text():
    c = Checker(Scope(row={k: v[0] for k, v in SOURCE.items()}, functions=BUILTIN))
    assert show(c.check("hash_sha256(row.email)+'!'+'?'")) == '((hash_sha256(row.email) + "!") + "?")'
    assert c.check("row.big > 3").args[1].type == "uint"
    assert c.check("row.amount * 1.5").type == "decimal(18,3)"
    assert c.check("size(row.vec)").type == "int"


def test_versions_and_residency():
    assert version(3) == "3.0.0" and version("1.2.3") == "1.2.3"
    with pytest.raises(ContractError):
        version(1.5)
    d = doc(residency={"jurisdictions": ["KE", "EU"], "approved_output_may_leave": True})
    assert d.permits("EU") and d.permits("KE") and not d.permits("DE") and not d.permits("*") and not doc().permits("KE")
    assert d.output_may_leave and not doc(residency=["KE"]).output_may_leave
    assert len({d.hash, doc().hash, doc(residency=["EU", "KE"]).hash}) == 3 and doc(residency=["KE", "EU"]).hash == doc(residency=["EU", "KE"]).hash
    for bad in (["ZZ"], ["*"], ["ke"], [], {"jurisdictions": []}, {"jurisdictions": ["KE"], "other": 1}, {"jurisdictions": ["KE"], "approved_output_may_leave": "yes"}, "KE"):
        with pytest.raises(ContractError):
            doc(residency=bad)


def test_inheritance_only_narrows():
    parent = doc(rule("admit", "row.qty > 0"))
    child = lambda **m: read(json.dumps({"contract": "a/c", "version": 1, "inherits": "a/b"} | m))
    ok = compile_contract(child(expose=[{"name": "email", "type": "utf8"}], rules=[{"id": "b", "op": "admit", "expr": "row.qty < 9"}]), SOURCE, lookup={"a/b": parent}.get)
    assert [i for i, _ in ok.admits] == ["a", "b"]
    for bad in ({"expose": [{"name": "tenant", "type": "utf8"}]}, {"binding": {"parquet": "y/"}}, {"rules": [rule("admit", "true")]}, {"inherits": "a/c"}):
        with pytest.raises(ContractError) as e:
            compile_contract(child(**bad), SOURCE, lookup={"a/b": parent}.get)
        assert e.value.problems[0].code == "inheritance"


def test_artifact_round_trip_and_refusals():
    r = Registry()
    r.add("twice(int) -> int", "$1 * 2", "o")
    c = compile_contract(doc(rule("admit", "twice(row.qty) > 2")), SOURCE, r)
    data = to_bytes(c)
    assert to_bytes(from_bytes(data, r)) == data
    other = Registry()
    other.add("twice(int) -> int", "$1 * 3", "o")
    for bad, reg in ((data, other), (data.replace(b"tessera-compiled/1", b"tessera-compiled/9"), r), (data.replace(b"row.qty", b"row.big"), r)):
        with pytest.raises(ContractError):
            from_bytes(bad, reg)


def test_functions_are_seen_by_their_owner():
    r = Registry()
    r.add("twice(int) -> int", "$1 * 2", "someone")
    with pytest.raises(ContractError):
        compile_contract(doc(rule("admit", "twice(row.qty) > 2")), SOURCE, r)


def test_lint():
    c = compile_contract(doc(rule("admit", "ctx.tenant == 'a'"), {"id": "b", "op": "decide", "expr": "ctx.tier == 'x'"}, {"id": "d", "op": "decide", "expr": "ctx.tier == 'y'"}, {"id": "e", "op": "assert", "expr": "true", "on_fail": "report"}, extensions={"ctx": {"z": "utf8"}}), SOURCE)
    assert {"admit-reads-only-ctx", "unsatisfiable-callers", "constant-rule", "unused-extension"} <= {f.lint for f in lint(c)}


def test_export_and_schema():
    c = compile_contract(doc(rule("assert", "row.email.endsWith('x')", on_fail="deny")), SOURCE)
    assert "ends_with" in validation_sql(c, "duckdb", "t")[0]
    assert validation_sql(c, "postgres", "s.t")[1]
    with pytest.raises(ContractError):
        substrait(c)
    assert json_schema()["properties"]["rules"]


def test_odcs():
    text = "apiVersion: v3.0.2\nkind: DataContract\nname: pay\ndomain: sell\nversion: 1.1.0\nservers: []\nschema:\n- name: t\n  properties:\n  - {name: id, logicalType: string, primaryKey: true, classification: x}\n  - {name: amount, logicalType: number, physicalType: 'decimal(18,2)'}\n"
    d, notes = import_odcs(text)
    assert [r["id"] for r in d["rules"]] == ["id_present", "id_unique"] and d["expose"][1]["type"] == "decimal(18,2)"
    assert any("servers" in n for n in notes) and any("id.classification" in n for n in notes)
    compile_contract(read(json.dumps(d)), {"id": parse_type("utf8"), "amount": parse_type("decimal(18,2)")})
    with pytest.raises(ContractError):
        import_odcs(text, "nope")
    table = lambda props, **m: json.dumps({"name": "x", "schema": [{"name": "t", "properties": props, **m}]})
    kinds = {"bigint": "int64", "int": "int32", "SMALLINT": "int16", "float": "float32", "varchar(20)": "utf8", "bytea": "binary", "timestamptz": "timestamp", "numeric(9, 2)": "decimal(9,2)"}
    d, _ = import_odcs(table([{"name": f"c{i}", "logicalType": "number", "physicalType": k} for i, k in enumerate(kinds)] + [{"name": "l", "logicalType": "array", "items": {"logicalType": "integer"}}]))
    assert [c["type"] for c in d["expose"]] == [*kinds.values(), "list<int64>"]
    for bad in ("object", "time"):
        with pytest.raises(ContractError):
            import_odcs(table([{"name": "c", "logicalType": bad}]))
    one = {"id": "a", "op": "admit", "expr": "row.c > 0"}
    for made in (one, [one, one | {"id": "b"}], "- {id: a, op: admit, expr: row.c > 0}\n"):
        d, notes = import_odcs(table([{"name": "c", "logicalType": "integer"}], quality=[{"type": "custom", "engine": "e", "implementation": made}]))
        assert d["rules"][0] == one and not notes
    assert import_odcs(table([], quality=[{"type": "custom", "engine": "e", "implementation": "a: ["}]))[1]
