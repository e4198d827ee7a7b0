"""Shared pieces of the training-data operators: scratch storage that survives
lost executors, vectorised word hashing over whole texts, and distributed
connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# ------------------------------------------------------------------ storage


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.  Where it is
    unset, a folder of our own, in one-process runs only (tests); a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Scratch:
    """Written tables under the shared folder.  ``park`` cuts lineage by writing
    and rereading Parquet; ``drop`` frees what later steps no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made: list[str] = []

    def path(self, tag: str) -> str:
        self.made.append(f"{self.root}/{len(self.made)}-{tag}")
        return self.made[-1]

    def park(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.path(tag)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        """Delete the named tables, or all of them when none is named."""
        jvm = self.spark._jvm
        for path in list(self.made):
            if not tags or path.rsplit("-", 1)[-1] in tags:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
                self.made.remove(path)


#: Bytes of an Arrow batch of texts on its way to a Python worker.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, not by 10,000 rows alone: those are tens of MB of
    text, held in the JVM's direct buffers and again in the worker.  The setting
    stays with the session, as lazy results are computed later; a text beyond the
    bound is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterable[pd.DataFrame]], schema: str) -> DataFrame:
    """``mapInPandas`` whose 64-bit integers stay integers beside nulls (``Int64``
    columns, ``pd.NA``): pandas' own would turn a batch with a null id to floats,
    which cannot tell ids over 2**53 apart."""
    want = StructType.fromDDL(schema)
    arrow = to_arrow_schema(want)

    def inner(batches):
        given = (b.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get) for b in batches)
        for out in run(given):
            if len(out):
                yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    return df.mapInArrow(inner, want)


def table(rows: list[tuple], columns: list[str], *ids: str) -> pd.DataFrame:
    """A frame of rows, those columns of ``ids`` as integers beside nulls."""
    cols = dict(zip(columns, zip(*rows))) if rows else dict.fromkeys(columns, ())
    return pd.DataFrame({c: pd.array(list(v), dtype="Int64") if c in ids else list(v) for c, v in cols.items()})


def parts_of(df: DataFrame, size: int) -> int:
    """Partitions of about ``size`` stored bytes each, the session's shuffle
    partitions at least; those alone where Spark knows no size (no file behind)."""
    stored = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(stored // size, 100_000) if stored < 1 << 60 else 0)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n in have:
            n += "_"
        have.add(n)
        out.append(n)
    return out


def column(name: str):
    """A column by its plain name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Rows of a slim table (two or three longs) up to which a join may broadcast it: under 10 MB.
SMALL_ROWS = 100_000


def checked_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` (a parked table, so counting reads footers only) with a broadcast
    hint if it has at most ``rows`` rows; larger ones are joined by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


# ------------------------------------------------------------- word hashing

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_pow = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64."""
    global _pow
    if len(_pow) < n:
        _pow = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 1024), BASE, np.uint64))])
    return _pow[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` (or runs outside another table of ``gap``
    bytes) of a list of texts, A-Z lower-cased, as 64-bit hashes.  ``doc[i]`` is the text of word i; ``at[i]:to[i]`` its bytes in
    ``buf``; ``base[d]`` is where text d begins in ``buf``."""

    def __init__(self, texts: list[str | None], gap: np.ndarray = SPACE):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        raw = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
        self.raw = raw
        self.buf = buf = LOWER[raw]
        gap = gap[buf]
        self.at = at = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        self.to = to = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        lens = to - at
        self.base = np.concatenate([[1], 1 + np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))])
        self.doc = np.searchsorted(self.base, at, "right") - 1
        self.n = len(parts)
        if not len(at):
            self.h = self.terms = np.zeros(0, np.uint64)
            self.first = np.zeros(0, np.int64)
            return
        inside = np.flatnonzero(~gap)
        place = inside - np.repeat(at, lens)
        terms = BYTE[buf[inside]] * powers(int(lens.max()))[place]
        self.terms, self.first = terms, np.concatenate([[0], np.cumsum(lens)[:-1]])
        self.h = mix(np.add.reduceat(terms, self.first))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k-word runs and the text of each, in order; runs never cross texts."""
        return runs(self.h, self.doc, k)


def runs(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - k + 1
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s = s * np.uint64(0xA24BAED4963EE407) + h[j : j + n]
    keep = doc[:n] == doc[k - 1 :]
    return mix(s[keep]), doc[:n][keep]


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; with fewer
    words the whole sequence is one shingle; without words the set is empty."""
    w = Words(texts)
    s, d = w.shingles(k)
    ends = np.searchsorted(d, np.arange(w.n + 1))
    word_ends = np.searchsorted(w.doc, np.arange(w.n + 1))
    out = []
    for i in range(w.n):
        if ends[i] < ends[i + 1]:
            out.append(np.unique(s[ends[i] : ends[i + 1]]))
        elif word_ends[i] < word_ends[i + 1]:
            n = int(word_ends[i + 1] - word_ends[i])
            out.append(runs(w.h[word_ends[i] : word_ends[i + 1]], np.zeros(n, np.int64), n)[0] + np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def blocks(texts: Iterable[str | None], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Slices of about ``most`` characters, at least one text each, so that the
    arrays made from a batch stay bounded."""
    begin = size = 0
    end = -1
    for end, t in enumerate(texts):
        n = len(t or "") + 1
        if size and size + n > most:
            yield begin, end
            begin, size = end, 0
        size += n
    if size:
        yield begin, end + 1


# ------------------------------------------------------ connected components


#: Edges (four longs each) up to which one task finds their components: 32 MB, no more than a task's share of a scan.
FEW_EDGES = 1_000_000


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Per node 0 .. n-1 the smallest node of its component over the edges (a, b):
    each root hooks to the smallest root next to it, paths are halved till they are
    flat, and edges within a tree are left out of the next round."""
    root = np.arange(n)
    while True:
        a, b = root[a], root[b]
        open_ = a != b
        if not open_.any():
            return root
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges at once, a component for each of their nodes."""
    ends = [np.column_stack([b.column(i).to_numpy() for i in range(4)]) for b in batches]
    both = np.concatenate(ends).reshape(-1, 2) if ends else np.zeros((0, 2), np.int64)
    del ends
    order = np.lexsort((both[:, 1], both[:, 0]))
    node = both[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]).any(axis=1)
    at = np.empty(len(node), np.int64)
    at[order] = np.cumsum(new) - 1
    node = node[new]
    top = node[roots_of(at[::2], at[1::2], len(node))]
    for i in range(0, len(node), 50_000):
        x, y = node[i : i + 50_000], top[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (x[:, 0], x[:, 1], y[:, 0], y[:, 1])], ["x0", "x1", "y0", "y1"])


#: Nodes (four bytes each) up to which one task holds the forest of numbered nodes: 128 MB.
MANY_NODES = 1 << 25
PLACE = 33  # bits of a node's place within its partition, as monotonically_increasing_id has it


def hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Edges (a, b) into the forest ``root``, whose trees have their smallest node as
    root; only paths from the edges' ends are halved, so the work is that of the edges."""
    while len(a):
        ends = np.concatenate([a, b])
        while ((up := root[root[ends]]) != root[ends]).any():
            root[ends] = up
        a, b = root[a], root[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))


def _forest(count: np.ndarray):
    """Per node the smallest of its component, from edges of numbered nodes, of
    which each partition has ``count``; edges pass by and are not held."""
    base = np.concatenate([[0], np.cumsum(count)])

    def dense(col):
        x = col.to_numpy()
        return base[x >> PLACE] + (x & ((1 << PLACE) - 1))

    def given(at):
        part = np.searchsorted(base, at, "right") - 1
        return pa.array((part << PLACE) + at - base[part])

    def run(batches):
        root = np.arange(base[-1], dtype=np.int32)
        for batch in batches:
            hook(root, dense(batch.column(0)), dense(batch.column(1)))
        for i in range(0, len(root), 50_000):
            # what comes before is flat
            x = root[i : i + 50_000]
            while (x != (up := root[x])).any():
                x[:] = up
            yield pa.RecordBatch.from_arrays([given(np.arange(i, i + len(x))), given(x.astype(np.int64))], ["id", "top"])

    return run


def _numbered(edges: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Components by way of ``nodes`` (node, id), numbered in ascending order."""
    found = {r.part: r["count"] for r in nodes.groupBy(F.shiftright("id", PLACE).alias("part")).count().collect()}
    count = np.array([found.get(i, 0) for i in range(max(found) + 1)], np.int64)
    named = lambda node, id_: nodes.select(F.col("node").alias(node), F.col("id").alias(id_))
    ends = scratch.park(edges.join(named("u", "x"), "u").join(named("v", "y"), "v").select("x", "y"), "ends")
    top = scratch.park(ends.coalesce(1).mapInArrow(_forest(count), "id long, top long"), "tops")
    scratch.drop("ends")
    return nodes.join(top, "id").join(named("component", "top"), "top").select("node", "component")


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: structs of two longs, no
    nulls), component = smallest node.  Up to FEW_EDGES distinct edges are one task's
    work.  Of more, the nodes are numbered, and one task holds a number for each node
    while the edges pass by.  Beyond MANY_NODES nodes, large-star and small-star steps
    alternate; each step is two grouped
    minima and a join, so no group is gathered and nothing reaches the driver
    but three counts.  Each step is several jobs that the driver plans, compiles and
    keeps records of: those, not rows, are what fills its memory.  The large-star's minima are parked, so that the join of a hot
    centre's edges to them broadcasts (at most SMALL_ROWS) or can be split."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.park(edges, tag)
    if edges.count() <= FEW_EDGES:
        names = edges.schema["u"].dataType.names
        ends = edges.select(*(F.col(e)[n].alias(f"{e}{i}") for e in "uv" for i, n in enumerate(names))).coalesce(1)
        out = ends.mapInArrow(_whole, "x0 long, x1 long, y0 long, y1 long")
        struct = lambda e: F.struct(*(F.col(f"{e}{i}").alias(n) for i, n in enumerate(names)))
        return out.select(struct("x").alias("node"), struct("y").alias("component"))
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    nodes = scratch.park(nodes.repartitionByRange("node").sortWithinPartitions("node").select("node", F.monotonically_increasing_id().alias("id")), "nodes")
    if nodes.count() <= MANY_NODES:
        return _numbered(edges, nodes, scratch)
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.park(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.join(checked_small(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.park(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), tag)
        scratch.drop("low")
        # stable once a step changes nothing
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)
