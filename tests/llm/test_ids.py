"""Ids over 2**53 beside nulls and negative ones, and extra columns of clashing names, through every operator and stage."""

import pytest

from tessera.llm import bpe, chat, decontaminate, neardup, secrets, suffix, tokenfile, toxicity, warc
from tessera.llm.kit import Scratch

BIG = 2**60 + 1
IDS = [BIG, BIG + 1, None, -3, 7]
TEXT = "plain words that no other text of these holds, number"
EXTRA = {"key": "k0", "cut": "c0", "id_": "i0", "new_": "n0", "row": "r0", "id": "d0", "by": "b0", "new": "w0"}


def docs(spark):
    rows = [(i, f"{TEXT} {n} {n * 7919} {'xyz' * n}", "en", f"s{n}", 1, *EXTRA.values()) for n, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)).coalesce(1)


def model(spark, d):
    return toxicity.train(spark, d, spark.createDataFrame([(BIG, 1), (BIG + 1, 0), (None, 1)], "doc_id long, toxic int"))


def tokens(spark, d):
    tmp = Scratch(spark, "t")
    tokenfile.write_tokens(d, tmp.path("f"), bpe.vocabulary("word_bpe_49k.json"))
    return tokenfile.read_tokens(spark, tmp.made[-1], tmp)


def archives(spark, d):
    tmp = Scratch(spark, "w")
    path = tmp.path("w")
    warc.archive_pages(spark, d.selectExpr("doc_id AS page_id", "source AS url", "text AS html"), path, tmp)
    return warc.read_archives(spark, path).withColumnRenamed("page_id", "doc_id")


OPERATORS = {
    "op1": archives,
    "op2": suffix.repeats,
    "op3": lambda spark, d: chat.unpack(chat.pack(spark, d.selectExpr("doc_id AS conv_id", "0 AS turn", "'user' AS role", "text"))).withColumnRenamed("conv_id", "doc_id"),
    "op4": neardup.near_duplicates,
    "op5": lambda spark, d: secrets.secrets(spark, d, Scratch(spark, "s")),
    "op7": lambda spark, d: toxicity.toxicity(spark, d, model(spark, d)),
    "op8": lambda spark, d: bpe.round_trip(spark, d, bpe.vocabulary("byte_bpe_50k.json")),
    "op9": tokens,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_keep_ids(spark, name):
    got = [r.doc_id for r in OPERATORS[name](spark, docs(spark)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, IDS))


def test_searches_keep_ids(spark):
    bench = spark.createDataFrame([(BIG, TEXT), (BIG + 1, TEXT), (None, TEXT)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark, docs(spark), bench, Scratch(spark, "d")).collect()}
    assert got == {(i, j) for i in IDS for j in (BIG, BIG + 1)}


def test_stages_keep_ids_and_columns(spark, tmp_path):
    d = docs(spark)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(BIG, 0), (-3, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "words that are in none of them")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted(map(str, d.collect()))
    for stage in (toxicity.keep_civil, neardup.keep_one, decontaminate.drop_leaks):
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns and sorted(map(str, out.collect())) == want, stage
    token = spark.createDataFrame([(BIG, "password=hunter2hunter2x", "en", "s", 24, *EXTRA.values())], d.schema)
    out = secrets.redact(spark, d.union(token), str(tmp_path))
    assert out.columns == d.columns and {r.text: r.n_chars for r in out.collect()}["[SECRET]"] == 8
    assert {tuple(r[c] for c in EXTRA) for r in out.collect()} == {tuple(EXTRA.values())} and out.where("text <> '[SECRET]'").count() == len(IDS)
