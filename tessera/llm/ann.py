"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Rows are dealt to shards of about ``SHARD`` by hash; a shard's distinct directions
are nodes.  A node's top level is drawn geometrically from a hash of its smallest id,
one in ``M`` rising a level.  Nodes are numbered from the highest level down, so each
level's graph is a flat array of neighbours over a prefix of the nodes.  Nodes are
inserted in batches no larger than what stands: a beam search from the level above
finds candidates, batch mates are added, and links are chosen by the small-world
heuristic - a candidate is linked if no link is nearer to it than the node is - and
filled up with the nearest; links back are chosen anew by the same rule.  A search
descends from the top with a narrow beam and widens it on the lowest level; many
queries advance in step.  Every vector of the directions found is scored in double
precision.  The shards' results are merged by score and id.

Queries travel to shards in packets; a shard's graph is shuffled once.  Hash-dealt
shards must all be asked, so work is queries times shards.

Cases: vectors that are null, zero, or hold null or non-finite components take no
part, as queries or candidates; vectors are compared only with those of equal
length; a query never finds rows of its own vec_id; equal scores go by smaller
vec_id, and copies of one vector count as so many rows; scaled copies are one
direction, all scored; components whose squares overflow are scaled by powers of two
first; null ids take no part; fewer candidates than k are all returned; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kit import Scratch, mix

SHARD, M, BEAM, MAKING, DOWN, STEP = 8192, 16, 128, 64, 16, 4
MATES, BATCH = 16, 512  # batch mates among the candidates; nodes inserted at once
QUERIES, PACKET = 256, 4096  # queries that advance in step; queries that travel together


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows by powers of two, so that their largest component is in [0.5, 1); exact."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


def levels(ids: np.ndarray) -> np.ndarray:
    u = (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53
    return np.floor(-np.log(np.maximum(u, 2.0**-53)) / np.log(M)).astype(np.int64)


def widen(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search over one level: nodes for each query from its ``entry`` nodes
    (-1 none), nearest first, -1 where none, and their similarities."""
    nq, n = len(q), len(links)
    rows = np.arange(nq)[:, None]
    beam = max(1, min(beam, n))
    pad = np.vstack([x[:n], np.zeros((1, x.shape[1]), x.dtype)])
    flat = np.vstack([np.where(links < 0, n, links), np.full((1, links.shape[1]), n, links.dtype)])
    seen = np.zeros((nq, n + 1), bool)
    node = np.where(entry < 0, n, entry)
    seen[rows, node] = seen[:, [n]] = True
    sim = np.where(node == n, -3, np.einsum("qkd,qd->qk", pad[node], q))
    done = node == n
    while not done.all():
        pick = np.argsort(np.where(done, 9, -sim), axis=1)[:, :STEP]
        open_ = ~np.take_along_axis(done, pick, 1)
        np.put_along_axis(done, pick, True, 1)
        new = flat[np.where(open_, np.take_along_axis(node, pick, 1), n)].reshape(nq, -1)
        new = np.where(seen[rows, new], n, new)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        new = new[:, : max(1, int((new < n).sum(1).max()))]
        seen[rows, new] = True
        ns = np.where(new == n, -3, np.einsum("qkd,qd->qk", pad[new], q))
        node, sim, done = np.hstack([node, new]), np.hstack([sim, ns]), np.hstack([done, new == n])
        if node.shape[1] > beam:
            keep = np.argpartition(-sim, beam - 1, axis=1)[:, :beam]
            node, sim, done = (np.take_along_axis(z, keep, 1) for z in (node, sim, done))
    order = np.argsort(-sim, axis=1, kind="stable")
    node, sim = np.take_along_axis(node, order, 1), np.take_along_axis(sim, order, 1)
    return np.where(node == n, -1, node), sim


def descend(x: np.ndarray, graph: list[np.ndarray], q: np.ndarray) -> np.ndarray:
    """Entry nodes for the level below ``graph`` (from the top level down)."""
    entry = np.zeros((len(q), 1), np.int64)
    for links in graph:
        entry = widen(x, links, q, entry, DOWN)[0]
    return entry


def choose(x: np.ndarray, node: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Links among candidates (-1 none), by the small-world heuristic."""
    order = np.argsort(np.where(node < 0, 9, -sim), axis=1, kind="stable")
    node, sim = np.take_along_axis(node, order, 1), np.take_along_axis(sim, order, 1)
    r, c = node.shape
    took, best = np.zeros((r, c), bool), np.full((r, c), -2, np.float32)
    each = x[np.maximum(node, 0)]
    between = each @ each.transpose(0, 2, 1)
    for k in range(c):
        take = (node[:, k] >= 0) & (sim[:, k] > best[:, k]) & (took.sum(1) < most)
        took[:, k] = take
        best[take] = np.maximum(best[take], between[take, k])
    rank = np.argsort(np.where(took, 0, np.where(node < 0, 2, 1)), axis=1, kind="stable")[:, :most]
    out = np.full((r, most), -1, np.int32)
    out[:, : rank.shape[1]] = np.take_along_axis(node, rank, 1)
    return out


def build(x: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
    """Neighbours by level, from the top down, for unit vectors ``x`` in
    descending order of ``level``."""
    graph: list[np.ndarray] = []
    above = 0
    for lev in range(int(level.max(initial=0)), -1, -1):
        n, most = int((level >= lev).sum()), M if lev else 2 * M
        links = np.full((n, most), -1, np.int32)
        at = min(n, 1)
        while at < n:
            end = min(n, at + min(at, BATCH), above if at < above else n)
            q = x[at:end]
            # nodes of the level above come first, while their entries may not stand yet
            entry = descend(x, graph, q) if at >= above else np.zeros((end - at, 1), np.int64)
            node, sim = widen(x, links[:at], q, entry, MAKING)
            mates = q @ q.T
            np.fill_diagonal(mates, -2)
            near = np.argsort(-mates, axis=1, kind="stable")[:, : min(MATES, end - at - 1)]
            node, sim = np.hstack([node, near + at]), np.hstack([sim, np.take_along_axis(mates, near, 1)])
            links[at:end] = choose(x, node, sim, most)
            back(x, links, at, end)
            at = end
        graph.append(links)
        above = n
    return graph


def back(x: np.ndarray, links: np.ndarray, at: int, end: int) -> None:
    """Link those that nodes at:end chose back to them."""
    most = links.shape[1]
    src, dst = np.repeat(np.arange(at, end), most), links[at:end].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    sim = np.einsum("pd,pd->p", x[src], x[dst])
    order = np.lexsort((-sim, dst))
    src, dst = src[order], dst[order]
    to, first = np.unique(dst, return_index=True)
    place = np.arange(len(dst)) - np.repeat(first, np.diff(np.append(first, len(dst))))
    ok = place < most
    new = np.full((len(to), most), -1, np.int64)
    new[np.searchsorted(to, dst[ok]), place[ok]] = src[ok]
    new[(new[:, :, None] == links[to][:, None, :]).any(2)] = -1  # linked already
    for i in range(0, len(to), BATCH):
        some = to[i : i + BATCH]
        node = np.hstack([links[some].astype(np.int64), new[i : i + BATCH]])
        links[some] = choose(x, node, np.einsum("rcd,rd->rc", x[np.maximum(node, 0)], x[some]), most)


def search(x: np.ndarray, graph: list[np.ndarray], q: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Nodes found for each of the unit queries ``q``, nearest first, -1 where none."""
    return widen(x, graph[-1], q, descend(x, graph[:-1], q), beam)[0]


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return df.where(F.col(id_col).isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim"))


def index(spark: SparkSession, df: DataFrame, tmp: Scratch, shard: int = SHARD) -> DataFrame:
    """One row per shard: dim, shard, of the dim's shards; unit vectors of the
    nodes and neighbours by level (sizes are nodes and links a node); the distinct
    vectors of nodes and the ids of vectors, with where each node's and vector's end."""
    sizes = F.broadcast(df.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard).alias("of")))  # a row per vector length

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ids = pdf["id"].to_numpy()
        v, at, own = np.unique(np.array(pdf["v"].tolist(), np.float64), axis=0, return_index=True, return_inverse=True)
        u, node = np.unique(unit(v), axis=0, return_inverse=True)
        node = node.ravel()
        least = np.full(len(u), np.iinfo(np.int64).max)
        np.minimum.at(least, node, ids[at])
        level = levels(least)
        order = np.lexsort((least, -level))  # nodes from the highest level down
        rank = np.empty(len(u), np.int64)
        rank[order] = np.arange(len(u))
        graph = build(np.ascontiguousarray(u[order]), level[order])
        by = np.argsort(rank[node], kind="stable")  # vectors by node
        spot = np.empty(len(v), np.int64)
        spot[by] = np.arange(len(v))
        mine = spot[own.ravel()]
        ends = lambda key, n: np.cumsum(np.bincount(key, minlength=n)).astype(np.int64).tobytes()
        return pd.DataFrame([{
            "dim": int(pdf["dim"].iloc[0]), "shard": int(pdf["shard"].iloc[0]), "of": int(pdf["of"].iloc[0]), "units": u[order].tobytes(), "sizes": [z for g in graph for z in g.shape],
            "links": b"".join(g.tobytes() for g in graph), "vectors": v[by].tobytes(), "vector_ends": ends(rank[node], len(u)), "ids": ids[np.lexsort((ids, mine))].tobytes(), "id_ends": ends(mine, len(v)),
        }])

    dealt = df.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("of")))
    made = dealt.groupBy("dim", "of", "shard").applyInPandas(run, "dim int, shard long, of long, units binary, sizes array<long>, links binary, vectors binary, vector_ends binary, ids binary, id_ends binary")
    return tmp.park(made, "index")


class Shard:
    """A row of the index, to be asked."""

    def __init__(self, r, dim: int):
        self.dim = dim
        self.units = np.frombuffer(r["units"], np.float32).reshape(-1, dim)
        sizes, flat, at, self.graph = np.reshape(list(r["sizes"]), (-1, 2)).tolist(), np.frombuffer(r["links"], np.int32), 0, []
        for n, most in sizes:
            self.graph.append(flat[at : at + n * most].reshape(n, most))
            at += n * most
        self.vectors = scaled(np.frombuffer(r["vectors"]).reshape(-1, dim))
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.vector_ends = np.concatenate([[0], np.frombuffer(r["vector_ends"], np.int64)])
        self.ids, self.id_ends = np.frombuffer(r["ids"], np.int64), np.concatenate([[0], np.frombuffer(r["id_ends"], np.int64)])

    def ask(self, qids: np.ndarray, qs: np.ndarray, k: int, beam: int) -> list[tuple[int, int, float]]:
        """(query, id, score) of the k nearest found for each query."""
        out, qs = [], scaled(qs)
        uq = unit(qs)
        for i in range(0, len(qs), QUERIES):
            for qid, q, nodes in zip(qids[i : i + QUERIES].tolist(), qs[i : i + QUERIES], search(self.units, self.graph, uq[i : i + QUERIES], beam)):
                nodes = nodes[nodes >= 0]
                at = np.concatenate([np.arange(self.vector_ends[n], self.vector_ends[n + 1]) for n in nodes])
                # row sums do not depend on what else is scored, so copies in other shards score alike
                score = (self.vectors[at] * q).sum(1) / (self.norms[at] * np.sqrt((q * q).sum()))
                rows = []
                # every vector that may be among the k nearest, ties and the query's own row included
                least = np.partition(score, -k - 1)[-k - 1] if len(score) > k + 1 else -9
                for v in np.flatnonzero(score >= least):
                    ids = self.ids[self.id_ends[at[v]] : self.id_ends[at[v] + 1]][: k + 1]
                    rows += [(-score[v], c) for c in ids.tolist() if c != qid]  # of equal vectors the k smallest ids suffice
                out += [(qid, c, -s) for s, c in sorted(rows)[:k]]
        return out


def nearest(spark: SparkSession, idx: DataFrame, queries: DataFrame, tmp: Scratch, k: int = 5, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query."""

    def block(batches):
        for pdf in batches:
            for _, part in pdf.groupby("dim"):
                for i in range(0, len(part), PACKET):
                    p = part.iloc[i : i + PACKET]
                    yield pd.DataFrame([{"dim": int(p["dim"].iloc[0]), "qids": p["id"].to_numpy(np.int64).tobytes(), "qs": np.array(p["v"].tolist(), np.float64).tobytes()}])

    packets = -(-queries.count() // PACKET)
    blocks = tmp.park(queries.repartition(max(1, packets)).mapInPandas(block, "dim int, qids binary, qs binary"), "queries")
    of = idx.groupBy("dim").agg(F.max("of").alias("of"))  # a row per vector length
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = blocks.join(F.broadcast(of), "dim").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("shard"), "qids", "qs")

    def run(batches):
        held, shard = None, None
        for pdf in batches:
            for r in pdf.to_dict("records"):
                if held != (name := (r["dim"], r["shard"])):
                    held, shard = name, Shard(r, r["dim"])
                out = shard.ask(np.frombuffer(r["qids"], np.int64), np.frombuffer(r["qs"]).reshape(-1, r["dim"]), k, beam)
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    # both sides dealt by shard: the join moves nothing again, and equal shards follow each other
    part = asked.repartition(parts, "dim", "shard").hint("merge").join(idx.drop("of").repartition(parts, "dim", "shard"), ["dim", "shard"]).mapInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp = Scratch(spark, "ann")
    rows = vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return nearest(spark, index(spark, rows, tmp), rows.where("id % 50 = 0"), tmp)
