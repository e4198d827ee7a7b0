"""Secret scan with corpus-wide ownership, in DataFrame operations only.

Base spans are found by pattern (leftmost, non-overlapping per kind; a match that
fails its length test is dropped).  Candidate values - what an assignment
assigns, access keys, hexadecimal runs and further long tokens of letters and
digits - are hashed and counted over the corpus by distinct owners and repositories
(an owner's repository; copies within one repository count once).  A value copied
among ``OWNERS`` owners is an example, and so is one of fewer owners, two at
least, that is in ``OWNERS`` repositories an owner on average.  Every other value
is owner-specific: live-looking if it has at least ``LETTERS`` different characters,
else dull.  The method adds spans of the candidates' values, kinds ``example``,
``live`` and ``dull``; base spans stay.  Positions are code points.

Positions come from splitting at the pattern: gap lengths and match lengths,
summed in order.  Counts are aggregated by (value, repository, owner) first, so
a value that fills a third of the corpus is combined before it moves, and joined
back by shuffle, where adaptive execution splits it.  Spans are gathered by
document only.

Cases: an empty table gives no rows; a very long text is scanned whole; null text is empty; rows that repeat a doc_id are scanned each; null
source or lang counts as one owner or repository of its own; documents without
spans get zero counts and empty lists; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kit import Scratch, column, unused

# fixed values: the base patterns and the lengths that matches must have
BASE = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{16,}",
}
LEAST = {"assign": 12, "access": 18, "hex": 16}
TOKEN = r"[A-Za-z0-9+/_-]{20,}"  # whole runs, kept if they have a letter and a digit
OWNERS = 3  # owners from which on a value counts as a widely copied example
LETTERS = 6  # different characters of a value that looks live


def pieces(text: Column, kind: str, pattern: str) -> Column:
    """Matches with the code points before each since the match before it."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else hits
    one = F.arrays_zip(hits.alias("hit"), F.transform(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), F.length).alias("gap"), values.alias("value"))
    none = F.array().cast("array<struct<hit:string,gap:int,value:string>>")
    return F.when(text.rlike(pattern), one).otherwise(none)


def scan(spark: SparkSession, docs: DataFrame, tmp: Scratch, owner: str = "source", repo: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows have row id, doc_id and key; spans have row, kind,
    start, end, base (bool), in no order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = {**BASE, "token": TOKEN}
    found = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("key"), F.col(owner).alias("owner"), F.col(repo).alias("repo"),
        F.map_from_arrays(F.array(*[F.lit(k) for k in kinds]), F.array(*[pieces(text, k, p) for k, p in kinds.items()])).alias("found"),
    )
    found = tmp.park(found, "found")
    each = found.select("row", "owner", "repo", F.explode("found").alias("kind", "list")).select("row", "owner", "repo", "kind", F.posexplode("list").alias("i", "m"))
    each = each.select("row", "owner", "repo", "kind", "i", F.col("m.gap").alias("gap"), F.length("m.hit").alias("len"), "m.value")
    order = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(order)).withColumn("start", F.col("end") - F.col("len"))
    size = F.when(F.col("kind") == "access", F.col("len")).otherwise(F.length("value"))
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in LEAST.items()], F.lit(20))
    # the value is the end of its match
    each = each.where((size >= least) & ((F.col("kind") != "token") | F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")))
    varied = F.size(F.array_distinct(F.split("value", ""))) >= LETTERS
    each = each.select("row", "owner", "repo", "kind", "start", "end", (F.col("end") - F.length("value")).alias("from"), varied.alias("varied"), F.sha2("value", 256).alias("value"))
    each = tmp.park(each, "each")
    held = each.select("value", "owner", "repo").distinct()
    held = held.groupBy("value").agg(F.countDistinct(F.coalesce(F.concat(F.lit("="), "owner"), F.lit("-"))).alias("owners"), F.count(F.lit(1)).alias("repos"))
    wide = (F.col("owners") >= OWNERS) | ((F.col("owners") > 1) & (F.col("repos") >= OWNERS * F.col("owners")))
    label = F.when(wide, "example").when(F.col("varied"), "live").otherwise("dull")
    said = each.join(held, "value").select("row", label.alias("kind"), F.col("from").alias("start"), "end").distinct()
    base = each.where(F.col("kind").isin(*BASE)).select("row", "kind", "start", "end", F.lit(True).alias("base"))
    return found.select("row", "doc_id", "key"), base.union(said.withColumn("base", F.lit(False)))


def rank() -> Column:
    """Place of a span's kind in the order of kinds."""
    return F.array_position(F.array(*[F.lit(k) for k in (*BASE, "live", "dull", "example")]), F.col("kind"))


def secrets(spark: SparkSession, docs: DataFrame, tmp: Scratch) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; a row per document row."""
    rows, spans = scan(spark, docs, tmp)
    text = F.concat_ws(":", "kind", "start", "end")
    per = spans.groupBy("row").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE],
        F.sort_array(F.collect_list(F.struct("start", rank().alias("rank"), "end", "base", text.alias("text")))).alias("all"),
    )
    out = rows.select("row", "doc_id").join(per, "row", "left")
    joined = lambda a: F.coalesce(F.array_join(F.transform(a, lambda x: x["text"]), ","), F.lit(""))
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in BASE], F.sha2(joined(F.filter("all", lambda x: x["base"])), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "secrets"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays; base spans and live-looking values
    in its text are replaced by ``[SECRET]`` and n_chars is counted anew."""
    tmp = Scratch(spark, "redact")
    rows, spans = scan(spark, docs, tmp)
    id_, key, by, cut, new = unused(docs, "id", "key", "by", "cut", "new")
    spots = spans.where("base or kind = 'live'").groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(cut))
    spots = rows.join(spots, "row").select(F.col("doc_id").alias(id_), F.col("key").alias(key), cut).dropDuplicates([id_, key])
    spots = tmp.park(spots, "cut")
    state = "struct<at:bigint,out:array<string>>"
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda s, c: F.when(c["end"] <= s["at"], s).otherwise(
        F.struct(F.greatest(s["at"], c["end"]).alias("at"), F.when(c["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], F.array(F.substring(F.col("text"), s["at"] + 1, c["start"] - s["at"]), F.lit("[SECRET]")))).alias("out")).cast(state)
    )
    whole = F.aggregate(cut, zero, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    marked = docs.withColumn(by, F.xxhash64("text"))
    marked = marked.join(spots, column("doc_id").eqNullSafe(spots[id_]) & (marked[by] == spots[key]), "left")
    marked = marked.withColumn(new, F.when(F.col(cut).isNull(), F.col("text")).otherwise(whole))
    out = {"text": F.col(new), "n_chars": F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length(new)).cast("long")}
    return marked.select(*[out[c].alias(c) if c in out else column(c) for c in docs.columns])
