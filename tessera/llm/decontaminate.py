"""Benchmark decontamination by canonical templates.

Words are runs outside ASCII white space and punctuation, case-folded.
Numbers, units that follow a number and names (capitalised words that do not
begin a sentence) become typed placeholders; the words they replace are slots.
Windows of five template words of documents and benchmark items are joined on
their hash.  A match is an alignment of document and item (difference of word
positions); its slots must be consistent: each item value stands for one document
value and the other way round, so re-parameterised questions match and chance
fillings do not.  Beside them, windows of the five plain words, without
placeholders, find copies whose capitals differ (an upper-cased passage is all
names).  An item leaks into a document if windows of one of the two kinds, on
consistent alignments, cover at least 0.8 of the places of the item's windows of
that kind; its coverage is the better of the two.  Items of three or four words are
found by windows of so many plain words, those of one or two where they are a whole
text.

Benchmark windows up to ``SMALL`` rows are broadcast (checked by count) to drop
unmatched document windows where they arise; beyond that all windows are joined
by shuffle.  Cases: null or word-free texts and items have no windows and never
match; template windows of fewer than two plain words are left out; repeated
documents and items are each reported; rows without doc_id are searched and reported
with a null doc_id, items without item_id are left out; empty tables give no rows; a
very long text is searched whole; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kit import Scratch, blocks, bound_batches, checked_small, column, frames, mix, runs, unused
from .toxicity import Tokens

W, SHARE, SMALL = 5, 0.8, 500_000
UNITS = "mm cm m km in ft mi g kg mg lb lbs oz l ml s ms min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years usd eur dollar dollars euro euros cent cents percent mph kmh kph meter meters metre metres litre litres liter liters gram grams kilogram kilograms mile miles inch inches foot feet degree degrees c f k w kw v a hz khz mhz ghz b kb mb gb tb"
NUM, UNIT, NAME, PLAIN = (np.uint64(x) for x in (0x4E554D, 0x554E4954, 0x4E414D45, 0x504C41494E))
_units = np.sort(Tokens([UNITS]).h)


def template(t: Tokens, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Template words and whether each is a slot; ``h`` are the hashes of the
    case-folded words."""
    if not len(h):
        return h, np.zeros(0, bool)
    digit = (t.raw[t.at] >= 48) & (t.raw[t.at] <= 57)
    upper = (t.raw[t.at] >= 65) & (t.raw[t.at] <= 90)
    # a sentence begins with the text or after . ! ? or a line end
    ends = np.zeros(256, bool)
    ends[[10, 13, 33, 46, 63]] = True
    marks = np.concatenate([[0], np.cumsum(ends[t.raw])])
    prev = np.concatenate([[0], t.to[:-1]])
    same = np.concatenate([[False], t.doc[1:] == t.doc[:-1]])
    opens = ~same | (marks[t.at] > marks[prev])
    out = h.copy()
    place = np.searchsorted(_units, h)
    unit = same & np.concatenate([[False], digit[:-1]]) & (_units[np.minimum(place, len(_units) - 1)] == h)
    name = upper & ~opens & ~unit
    out[digit], out[unit], out[name] = NUM, UNIT, NAME
    return out, digit | unit | name


def windows(texts, known=None, short=(), items=False) -> pd.DataFrame:
    """row, plain (kind of window), at (word), h, slots (of template windows:
    hashes of replaced words, 0 for plain words), words (of the window).  ``short`` are the lengths of items
    under W words to look for; of ``items``, each is of its own length only."""
    # folding neither parts nor joins words, so both have the same ones
    t, f = Tokens(texts), Tokens([(x or "").casefold() for x in texts])
    words, slot = template(t, f.h)
    n = max(0, len(words) - W + 1)
    whole = np.flatnonzero(t.doc[:n] == t.doc[W - 1 :][:n]) if n else np.zeros(0, int)
    count = np.concatenate([[0], np.cumsum(~slot)])
    first = np.searchsorted(t.doc, np.arange(t.n))
    value = np.where(slot, f.h, np.uint64(0)).view(np.int64)
    out = []
    for plain in (False, True):
        # plain windows are hashed apart from template windows of the same words
        h = mix(runs(f.h, f.doc, W)[0] + PLAIN) if plain else runs(words, t.doc, W)[0]
        keep = np.ones(len(h), bool) if plain else count[whole + W] - count[whole] >= 2
        if known is not None and len(h):
            keep &= known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else False
        at, h = whole[keep], h[keep]
        d = t.doc[at]
        slots = [None] * len(at) if plain else [value[a : a + W] for a in at]
        out.append(pd.DataFrame({"row": d, "plain": plain, "at": at - first[d], "h": h.view(np.int64), "slots": pd.Series(slots, dtype=object), "words": W}))
    count = np.bincount(t.doc, minlength=t.n)
    for n in short:
        h, d = runs(f.h, f.doc, n)
        at = np.flatnonzero(f.doc[: max(0, len(f.doc) - n + 1)] == f.doc[n - 1 :])
        keep = count[d] == n if items or n < 3 else np.ones(len(h), bool)
        h = mix(h + PLAIN + np.uint64(n))
        if known is not None and len(h):
            keep &= known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else False
        d, at, h = d[keep], at[keep], h[keep]
        out.append(pd.DataFrame({"row": d, "plain": True, "at": at - first[d], "h": h.view(np.int64), "slots": pd.Series([None] * len(at), dtype=object), "words": n}))
    return pd.concat(out, ignore_index=True)


def leaks(spark: SparkSession, docs: DataFrame, bench: DataFrame, tmp: Scratch, share: float = SHARE) -> DataFrame:
    """doc_id, key (hash of the text), item_id, coverage: one row for each
    document and item found in it."""
    bound_batches(spark)

    def items(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for i, j in blocks(texts):
                w = windows(texts[i:j], short=range(1, W), items=True)
                yield w.assign(item_id=pdf["item_id"].array[i:j][w.pop("row").to_numpy()])

    ref = frames(bench.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text"), items, "item_id long, plain boolean, at long, h long, slots array<long>, words long")
    ref = tmp.park(ref, "items")
    small = ref.count() <= SMALL
    known = spark.sparkContext.broadcast(np.unique(ref.select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)) if small else None)
    short = sorted(r.words for r in ref.where(F.col("words") < W).select("words").distinct().collect())  # four at most

    def seek(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for i, j in blocks(texts):
                w = windows(texts[i:j], known.value, short)
                r = w.pop("row").to_numpy()
                yield w.assign(**{c: pdf[c].array[i:j][r] for c in ("doc_id", "none", "key")})

    # null ids are told by a flag, so that joins keep them
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("key"), "text")
    found = frames(docs, seek, "doc_id long, none boolean, key long, at long, h long, slots array<long>")
    doc = ["doc_id", "none", "key"]
    side = ref.select("item_id", "plain", F.col("at").alias("item_at"), "h", F.col("slots").alias("item_slots"))
    hits = found.join(checked_small(side) if small else side, "h").select(*doc, "item_id", "plain", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", F.arrays_zip(F.col("item_slots").alias("x"), F.col("slots").alias("y")).alias("z"))
    hits = tmp.park(hits.dropDuplicates([*doc, "item_id", "plain", "shift", "item_at"]), "hits")
    line = [*doc, "item_id", "plain", "shift"]
    filled = hits.select(*line, F.explode("z").alias("z")).where("z.x <> 0").select(*line, "z.x", "z.y").distinct()
    off = filled.groupBy(*line).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("x").alias("nx"), F.countDistinct("y").alias("ny")).where("n <> nx or n <> ny")
    total = ref.groupBy("item_id", "plain").agg(F.countDistinct("at").alias("total"))
    good = hits.join(off.select(*line), line, "left_anti").groupBy(*doc, "item_id", "plain").agg(F.countDistinct("item_at").alias("n"))
    best = good.join(total, ["item_id", "plain"]).groupBy(*doc, "item_id").agg(F.max(F.least(F.lit(1.0), F.col("n") / F.col("total"))).alias("coverage"))
    return best.where(F.col("coverage") >= share).select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "key", "item_id", "coverage")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp = Scratch(spark, "decontaminate")
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(spark, docs, bench, tmp).select("doc_id", "item_id", "coverage").distinct()


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    tmp = Scratch(spark, "decontaminate")
    id_, key, by = unused(docs, "id", "key", "by")
    bad = leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), tmp).select(F.col("doc_id").alias(id_), F.col("key").alias(key)).distinct()
    bad = checked_small(tmp.park(bad, "bad"))
    out = docs.withColumn(by, F.xxhash64("text")).join(bad, column("doc_id").eqNullSafe(bad[id_]) & (column(by) == bad[key]), "left_anti")
    return out.select([column(c) for c in docs.columns])
