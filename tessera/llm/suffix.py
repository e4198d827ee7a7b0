"""Repeated byte strings of whole texts by hash-compared suffix sort.

Every string of ``SPAN`` bytes that also starts earlier is found, exactly, and the
bytes that such strings cover are removed.  Texts are laid end to end in chunks.

1. Anchors.  Of the ``GRAM``-byte grams in each SPAN-byte window the one of least
   hash (all of them, on ties) is an anchor; equal windows have equal anchors at
   equal places, and about one position in 30 is an anchor.
2. Anchors are counted by gram hash.  Of those of one chunk with equal surroundings
   (what windows through them can reach; bytes are compared) the first stands for all.
3. Anchors of repeated grams are sent on with their surroundings.  The suffixes from
   the anchors are sorted by a mergesort whose comparisons find the common extension
   by binary search over prefix polynomial hashes; neighbours are then compared byte by
   byte, and if a hash was wrong, bytes are sorted instead.  Anchors whose whole
   surroundings came earlier mark all their windows.  For those left and each offset,
   windows are equal if they are joined by common extensions of at least SPAN - offset
   and by equal hashes to the left; each is compared byte by byte with its first
   occurrence, and if they differ, windows are grouped by their bytes.
4. Marks return to the chunks, where spans are merged and texts put together.

The number of groups grows with the input (``PART`` stored bytes each); those anchors
of one gram whose surroundings differ meet in one group.  Order is by doc_id, then
place.  Cases: null text is empty; texts under SPAN bytes are untouched; a very long
text is a chunk of its own, held whole by a worker; rows that repeat a doc_id are
texts in the order of their chunks; null doc_ids come last; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kit import BASE, BYTE, Scratch, frames, mix, parts_of, powers

SPAN, GRAM, CHUNK, PART = 100, 40, 3_000_000, 8 << 20
REACH = SPAN - GRAM  # an anchor is at most so far into its window
U = np.uint64
_inverse = U(pow(int(BASE), -1, 2**64))
LAST = np.iinfo(np.int64).max


def slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over x[i : i + width] for each i that has so many."""
    have, out = 1, x
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


class Chunk:
    """Texts laid end to end: text d is data[base[d]:base[d + 1]]."""

    def __init__(self, row):
        ids, lens, data = row.ids, row.lens, row.data
        self.ids = np.frombuffer(ids, np.int64)
        self.lens = np.frombuffer(lens, np.int64)
        self.data = np.frombuffer(data, np.uint8)
        self.base = np.concatenate([[0], np.cumsum(self.lens)])

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, at, "right") - 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, hashes of grams and of surroundings (see ``around``), ascending by place."""
        n = len(self.data)
        out, hs, keys = [], [], []
        # pieces of whole texts, so that a very long text alone is large
        cut = [0]
        for d in range(len(self.lens)):
            if self.base[d + 1] - cut[-1] > 1 << 18:
                cut.append(int(self.base[d + 1]))
        if cut[-1] < n:
            cut.append(n)
        for lo, hi in zip(cut, cut[1:]):
            if hi - lo < SPAN:
                continue
            x = BYTE[self.data[lo:hi]]
            p = np.concatenate([[U(0)], np.cumsum(x * powers(hi - lo))])
            inverse = inverse_powers(hi - lo)
            h = mix((p[GRAM:] - p[:-GRAM]) * inverse[: hi - lo - GRAM + 1]) | U(1)
            least = slide(h, REACH + 1, np.minimum)  # by window
            ends = self.base[(self.base > lo) & (self.base < hi)] - lo
            for e in ends:  # windows over an end are none
                least[max(0, e - SPAN + 1) : e] = 0
            wide = np.concatenate([np.zeros(REACH, U), least, np.zeros(REACH, U)])
            best = slide(wide, REACH + 1, np.maximum)[: len(h)]
            at = np.flatnonzero(h == best)
            out.append(at + lo)
            hs.append(h[at])
            left, right = self.reach(at + lo)
            bytes_ = (p[at + right] - p[at - left]) * inverse[at - left]
            keys.append(mix(mix(bytes_) + (left << 8 | right).astype(U)))
        return (np.concatenate(out), np.concatenate(hs), np.concatenate(keys)) if out else (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U))

    def reach(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the text within reach before and after anchors."""
        d = self.doc(at)
        return np.minimum(at - self.base[d], REACH), np.minimum(self.base[d + 1] - at, SPAN)

    def around(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes within reach of anchors (REACH before, SPAN after), and how many
        before and after belong to the text; others are 0."""
        left, right = self.reach(at)
        j = np.arange(-REACH, SPAN)
        idx = np.clip(at[:, None] + j, 0, len(self.data) - 1)
        ctx = np.where((j >= -left[:, None]) & (j < right[:, None]), self.data[idx], 0).astype(np.uint8)
        return ctx, left.astype(np.uint8), right.astype(np.uint8)


_inv = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _inv
    if len(_inv) < n:
        _inv = np.concatenate([[U(1)], np.cumprod(np.full(n, _inverse, U))])
    return _inv[:n]


def chunks(batches):
    part, no = TaskContext.get().partitionId(), 0
    ids, none, lens, data, size = [], [], [], [], 0

    def row():
        return pd.DataFrame([{"chunk": (part << 32) + no, "ids": np.array(ids, np.int64).tobytes(), "none": np.array(none, bool).tobytes(), "lens": np.array(lens, np.int64).tobytes(), "data": b"".join(data)}])

    for pdf in batches:
        for i, t in zip(pdf["doc_id"], pdf["text"]):
            raw = (t or "").encode("utf-8", "surrogatepass")
            none.append(pd.isna(i))
            ids.append(LAST if pd.isna(i) else int(i))
            lens.append(len(raw))
            data.append(raw)
            size += len(raw)
            if size >= CHUNK:
                yield row()
                no, ids, none, lens, data, size = no + 1, [], [], [], [], 0
    if ids:
        yield row()


def same_as_before(c: Chunk, at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of these anchors have the surroundings (hashed in key) of an earlier one of the chunk."""
    did = c.ids[c.doc(at)] if len(at) else np.zeros(0, np.int64)
    order = np.lexsort((at, did, key))
    out = np.zeros(len(at), bool)
    twin = np.flatnonzero(key[order][1:] == key[order][:-1]) + 1
    for i in range(0, len(twin), 20_000):
        some = twin[i : i + 20_000]
        one, two = c.around(at[order[some]]), c.around(at[order[some - 1]])
        out[order[some]] = (one[0] == two[0]).all(1) & (one[1] == two[1]) & (one[2] == two[2])
    return out


def _emit(parts: int):
    """Rows (part, chunk, h, at, own): a chunk's anchors by gram; the first of those
    with equal surroundings stands for all, the others are in ``own``."""

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                c = Chunk(row)
                at, h, key = c.anchors()
                twin = same_as_before(c, at, key)
                own, at, h = at[twin], at[~twin], h[~twin]
                to = (mix(h) % U(parts)).astype(np.int64)
                by = np.argsort(to, kind="stable")
                out = [(int(p), row.chunk, h[i].tobytes(), at[i].astype("<u4").tobytes(), b"") for p, i in zip(*groups(to[by], by))]
                if len(own):
                    out.append((int(row.chunk % parts), row.chunk, b"", b"", own.astype("<u4").tobytes()))
                yield pd.DataFrame(out, columns=["part", "chunk", "h", "at", "own"])

    return run


def groups(key: np.ndarray, *cols: np.ndarray):
    """Distinct values of an ascending key, and each column cut accordingly."""
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    return (key[cut], *[np.split(x, cut[1:]) if len(cut) else [] for x in cols])


def cat(col, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(col), dtype)


def _repeats(pdf: pd.DataFrame) -> pd.DataFrame:
    """By chunk, anchors that are marked already (full) and those whose gram another has too (check)."""
    h, at = cat(pdf["h"], U), cat(pdf["at"], "<u4")
    chunk = np.repeat(pdf["chunk"].to_numpy(), [len(x) // 8 for x in pdf["h"]])
    by = np.argsort(h, kind="stable")
    same = h[by][1:] == h[by][:-1]
    many = np.zeros(len(h), bool)
    many[by[1:][same]] = many[by[:-1][same]] = True
    at, chunk = at[many], chunk[many]
    by = np.argsort(chunk, kind="stable")
    out = [(int(r.chunk), r.own, b"") for r in pdf.itertuples() if len(r.own)]
    out += [(int(k), b"", a.tobytes()) for k, a in zip(*groups(chunk[by], at[by]))]
    return pd.DataFrame(out, columns=["chunk", "full", "check"])


def _contexts(parts: int):
    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                at = np.sort(cat(row.check, "<u4").astype(np.int64))
                if not len(at):
                    continue
                c = Chunk(row)
                ctx, left, right = c.around(at)
                p = np.zeros(len(at), U)
                for k in range(GRAM):
                    p = p * BASE + BYTE[ctx[:, REACH + k]]
                did = c.ids[c.doc(at)]
                to = (mix(p) % U(parts)).astype(np.int64)
                by = np.argsort(to, kind="stable")
                out = [(int(k), row.chunk, did[i].tobytes(), at[i].astype("<u4").tobytes(), ctx[i].tobytes(), left[i].tobytes(), right[i].tobytes()) for k, i in zip(*groups(to[by], by))]
                yield pd.DataFrame(out, columns=["part", "chunk", "did", "at", "ctx", "left", "right"])

    return run


def suffix_sort(text: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``text`` (row i has ``lens[i]`` bytes) and the common
    extension of each with the one before it in that order; both are held against
    the bytes.  Of rows whose hash is that of another, one is sorted."""
    lens = lens.astype(np.int64)
    h = np.zeros(len(text), U)
    for j in range(text.shape[1]):
        h = h * BASE + BYTE[text[:, j]]
    by = np.lexsort((lens, h))
    new = np.ones(len(by), bool)
    new[1:] = (h[by][1:] != h[by][:-1]) | (lens[by][1:] != lens[by][:-1])
    one = by[new]  # the first of each, as lexsort is stable
    place = np.empty(len(one), np.int64)
    place[merge_sort(text[one], lens[one])] = np.arange(len(one))
    order = by[np.argsort(place[np.cumsum(new) - 1], kind="stable")]
    lcp, right = extensions(text, lens, order)
    if not right:  # a hash stood for two strings
        rows = np.column_stack([text, lens.astype(np.uint8)])
        order = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), kind="stable")
        lcp, _ = extensions(text, lens, order)
    return order, lcp


def merge_sort(text: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Order of distinct rows by prefix hashes; wrong, but a permutation, if a hash stands for two strings."""
    m, w = text.shape
    h = np.zeros((w + 1, m), U)
    for j in range(w):
        h[j + 1] = h[j] * BASE + BYTE[text[:, j]]
    key = np.zeros(m, U)  # the first eight bytes, which settle most comparisons
    for j in range(8):
        key = key << U(8) | (np.where(j < lens, text[:, j], 0).astype(U) if j < w else U(0))

    def common(a, b):
        lo, hi = np.zeros(len(a), np.int64), np.minimum(lens[a], lens[b])
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            eq = h[mid, a] == h[mid, b]
            lo, hi = np.where(eq, mid, lo), np.where(eq, hi, mid - 1)
        return lo

    def less(a, b, or_equal):
        x, y = key[a], key[b]
        out, tie = x < y, np.flatnonzero(x == y)
        out[tie] = less_by_hash(a[tie], b[tie], or_equal)
        return out

    def less_by_hash(a, b, or_equal):
        k = common(a, b)
        ea, eb = k == lens[a], k == lens[b]
        at = np.minimum(k, w - 1)
        out = np.where(ea | eb, ea & ~eb, text[a, at] < text[b, at])
        return out | (ea & eb) if or_equal else out

    order, run = np.arange(m), 1
    spot = np.arange(m)
    while run < m:
        left = (spot // run) % 2 == 0
        begin = (spot // (2 * run)) * 2 * run
        lo0 = np.where(left, begin + run, begin)
        lo, hi = np.minimum(lo0, m), np.minimum(lo0 + run, m)
        lo0 = lo.copy()
        # how many of the sibling run go before each item; equals of the left run go first
        while True:
            go = np.flatnonzero(lo < hi)
            if not len(go):
                break
            mid = (lo[go] + hi[go]) >> 1
            before = np.zeros(len(go), bool)
            le = left[go]
            before[le] = less(order[mid[le]], order[go[le]], False)
            before[~le] = less(order[mid[~le]], order[go[~le]], True)
            lo[go] = np.where(before, mid + 1, lo[go])
            hi[go] = np.where(before, hi[go], mid)
        place = np.where(left, spot, spot - run) + (lo - lo0)
        new = order.copy()  # wrong hashes may leave places open
        new[place] = order
        order, run = new, 2 * run
    return order if (np.bincount(order, minlength=m) == 1).all() else np.arange(m)


def extensions(text: np.ndarray, lens: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, bool]:
    """Common extension of each row with the one before it, by bytes, and whether
    the order is right."""
    lcp, right = np.zeros(len(order), np.int64), True
    for i in range(1, len(order), 20_000):
        a, b = order[i - 1 : i + 19_999], order[i : i + 20_000]
        a = a[: len(b)]
        differ = text[a] != text[b]
        k = np.where(differ.any(1), differ.argmax(1), text.shape[1])
        k = np.minimum(k, np.minimum(lens[a], lens[b]))
        lcp[i : i + 20_000] = k
        at = np.minimum(k, text.shape[1] - 1)
        right = right and bool(np.where(k == lens[a], True, (k < lens[b]) & (text[a, at] < text[b, at])).all())
    return lcp, right


def first_of(keys: tuple[np.ndarray, ...], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have the keys of another of lower rank, and that of lowest rank."""
    by = np.lexsort((rank, *keys))
    new = np.ones(len(by), bool)
    new[1:] = np.logical_or.reduce([k[by][1:] != k[by][:-1] for k in keys])
    head = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))] if len(by) else by
    return by[~new], head[~new]


def equal(ctx: np.ndarray, a: np.ndarray, b: np.ndarray, lo: int, hi: int) -> np.ndarray:
    out = np.ones(len(a), bool)
    for i in range(0, len(a), 50_000):
        out[i : i + 50_000] = (ctx[a[i : i + 50_000], lo:hi] == ctx[b[i : i + 50_000], lo:hi]).all(1)
    return out


def _resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per chunk, anchors whose surroundings came earlier (full) and starts of
    windows that did."""
    did, at = cat(pdf["did"], np.int64), cat(pdf["at"], "<u4").astype(np.int64)
    chunk = np.repeat(pdf["chunk"].to_numpy(), [len(x) // 8 for x in pdf["did"]])
    ctx = cat(pdf["ctx"], np.uint8).reshape(len(did), -1)
    left, right = cat(pdf["left"], np.uint8).astype(np.int64), cat(pdf["right"], np.uint8).astype(np.int64)
    rank = np.empty(len(did), np.int64)
    rank[np.lexsort((at, chunk, did))] = np.arange(len(did))
    order, lcp = suffix_sort(np.ascontiguousarray(ctx[:, REACH:]), right)

    # equal surroundings lie together but for what is left of them
    whole = np.empty(len(did), np.int64)
    alike = np.concatenate([[False], (lcp[1:] == right[order[1:]]) & (right[order[1:]] == right[order[:-1]])])[: len(did)]
    whole[order] = np.cumsum(~alike)
    before = left.astype(U)
    for off in range(1, REACH + 1):
        before = before * BASE + BYTE[ctx[:, REACH - off]]
    twin, head = first_of((left, before, whole), rank)
    twin = twin[equal(ctx, twin, head, 0, ctx.shape[1])]
    rest = np.ones(len(did), bool)
    rest[twin] = False
    full = (chunk[twin], at[twin])

    # of grams with differing surroundings one anchor for each is left
    gram = np.empty(len(did), np.int64)
    gram[order] = np.cumsum(lcp < GRAM)
    rest &= np.bincount(gram, rest)[gram] > 1 if len(did) else rest
    kept = np.flatnonzero(rest[order])
    lcp = np.minimum.reduceat(lcp, np.concatenate([[0], kept[:-1] + 1])) if len(kept) else lcp[:0]
    pick = order[kept]
    chunk, at, ctx, left, right, rank = chunk[pick], at[pick], ctx[pick], left[pick], right[pick], rank[pick]
    hl = np.zeros(len(pick), U)
    found: list[tuple] = [(chunk[:0], at[:0])]
    for off in range(REACH + 1):
        if off:
            hl = mix(hl * BASE + BYTE[ctx[:, REACH - off]])
        ok = np.flatnonzero((left >= off) & (right >= SPAN - off))
        lo, hi = REACH - off, REACH - off + SPAN
        twin, head = first_of((hl[ok], np.cumsum(lcp < SPAN - off)[ok]), rank[ok])
        twin, head = ok[twin], ok[head]
        if not equal(ctx, twin, head, lo, hi).all():  # a hash stood for two strings
            names = np.unique(np.ascontiguousarray(ctx[ok, lo:hi]).view(f"V{SPAN}").ravel(), return_inverse=True)[1]
            twin = ok[first_of((names,), rank[ok])[0]]
        found.append((chunk[twin], at[twin] - off))
    out = []
    for (ch, st), which in ((full, 0), (tuple(np.concatenate(x) for x in zip(*found)), 1)):
        by = np.lexsort((st, ch))
        for k, x in zip(*groups(ch[by], st[by])):
            x = np.unique(x).astype("<u4").tobytes()
            out.append((int(k), b"" if which else x, x if which else b""))
    return pd.DataFrame(out, columns=["chunk", "full", "starts"])


def _apply(batches):
    for pdf in batches:
        for row in pdf.itertuples():
            c = Chunk(row)
            n = len(c.data)
            mark = np.zeros(n + 1, np.int32)
            full = cat(row.full, "<u4").astype(np.int64) if row.full is not None else np.zeros(0, np.int64)
            d = c.doc(full)
            lo, hi = np.maximum(c.base[d], full - REACH), np.minimum(full, c.base[d + 1] - SPAN)
            lo, hi = lo[lo <= hi], hi[lo <= hi]
            np.add.at(mark, lo, 1)
            np.add.at(mark, hi + SPAN, -1)
            starts = cat(row.starts, "<u4").astype(np.int64) if row.starts is not None else np.zeros(0, np.int64)
            np.add.at(mark, starts, 1)
            np.add.at(mark, starts + SPAN, -1)
            gone = np.cumsum(mark[:-1]) > 0
            # a run that ends one text and begins the next is two
            edge = gone & ~np.concatenate([[False], gone[:-1]])
            begins = c.base[:-1][c.lens > 0]
            edge[begins] = gone[begins]
            total, runs = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(edge)])
            a, b = c.base[:-1], c.base[1:]
            kept = c.data[~gone].tobytes()
            at = np.concatenate([[0], np.cumsum(c.lens - (total[b] - total[a]))])
            yield pd.DataFrame({
                "doc_id": c.ids,
                "n_bytes": c.lens, "n_removed": total[b] - total[a], "n_spans": runs[b] - runs[a],
                "kept_sha256": [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(at, at[1:])], "none": np.frombuffer(row.none, bool),
            })


def repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row per input row."""
    tmp = Scratch(spark, "suffix")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = 2 * parts_of(docs, 2 * PART)
    table = f"tessera_{uuid.uuid4().hex}"
    # written bucketed, so that marks come to the chunks and texts never move again
    frames(docs, chunks, "chunk long, ids binary, none binary, lens binary, data binary").write.bucketBy(parts, "chunk").option("compression", "zstd").saveAsTable(table)
    try:
        data = spark.table(table)
        emitted = data.mapInPandas(_emit(parts), "part int, chunk long, h binary, at binary, own binary")
        marks = tmp.park(emitted.groupBy("part").applyInPandas(_repeats, "chunk long, full binary, check binary"), "marks")
        check = marks.where("octet_length(check) > 0").groupBy("chunk").agg(F.collect_list("check").alias("check"))
        sent = data.join(check.hint("shuffle_merge"), "chunk").select(*data.columns, "check").mapInPandas(_contexts(parts), "part int, chunk long, did binary, at binary, ctx binary, left binary, right binary")
        more = tmp.park(sent.groupBy("part").applyInPandas(_resolve, "chunk long, full binary, starts binary"), "starts")
        full = marks.where("octet_length(full) > 0").select("chunk", "full", F.lit(b"").alias("starts")).union(more)
        full = full.groupBy("chunk").agg(F.collect_list("full").alias("full"), F.collect_list("starts").alias("starts"))
        out = data.join(full.hint("shuffle_merge"), "chunk", "left").select(*data.columns, "full", "starts")
        out = out.mapInPandas(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, none boolean")
        return tmp.park(out.select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256"), "result")
    finally:
        spark.sql(f"drop table if exists {table}")
        tmp.drop("marks", "starts")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
