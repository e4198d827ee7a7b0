"""Toxic spans by a linear-chain conditional random field.

Tokens are maximal runs of bytes other than ASCII white space and punctuation,
A-Z lower-cased; a token's features are hashes of the word and of its first 4, 5
and 6 bytes.  Document labels are turned into token labels: a token of a toxic
training document is toxic if one of its features is found nearly only in toxic
documents, and more often than by chance.  The chain (two tags, free transitions)
is fitted by gradient ascent on the exact conditional likelihood over windows of
tokens; forward-backward marginals of whole texts give spans and, through a
one-variable logistic fit, the document's score.

Fitting reads a bounded sample of labelled rows: ``SAMPLE`` ids of each class, texts
of at most ``LONGEST`` characters, one text an id, and of their tokens at most
``WINDOWS`` training windows round toxic and clean ones.  Scoring reads every whole
text, however long, in one piece.  Cases: an empty table of documents gives no rows;
null or empty text scores as a text without toxic tokens; no labelled rows, or
one class only, gives a model that scores everything 0; repeated rows are scored
each; labels, lang, source and doc_id are no features.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kit
from .kit import Words, blocks, frames, mix, shingle_sets

SAMPLE, LONGEST, WINDOWS = 2500, 20_000, (6000, 9000)
BITS = 20  # of a feature's hash, to rule out most unknown features by one look-up
PREFIXES = (4, 5, 6)
CUT = 0.7
EVIDENCE = 14  # bits by which a feature must exceed chance to mark tokens
SIDE = 15  # tokens on each side of a training window's centre


class Tokens(Words):
    """Words parted at punctuation too."""

    GAP = kit.SPACE.copy()
    GAP[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

    def __init__(self, texts):
        super().__init__(texts, gap=self.GAP)

    def features(self) -> np.ndarray:
        """tokens x features, 64-bit hashes; 0 for a prefix longer than its token."""
        lens = self.to - self.at
        cols, acc = [self.h], np.zeros(len(self.h), np.uint64)
        for j in range(max(PREFIXES, default=0)):
            ok = lens > j
            acc[ok] += self.terms[self.first[ok] + j]
            if j + 1 in PREFIXES:
                cols.append(mix(acc + np.uint64(j + 1)) * ok)
        return np.stack(cols, 1)


def chain(score: np.ndarray, trans: np.ndarray, start: float, lens: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Marginals of tag 1 for the tokens of many texts at once.  ``score`` are log
    odds of tag 1 by emission, ``trans`` a 2x2 matrix of potentials; text d has
    ``lens[d]`` tokens from ``offs[d]``.  Works on ratios tag 1 : tag 0."""
    order = np.argsort(-lens, kind="stable")
    lens, offs = lens[order], offs[order]
    e = np.exp(np.clip(score, -30, 30))
    fwd = np.empty(len(e))
    (a00, a01), (a10, a11) = trans
    live = np.searchsorted(-lens, -np.arange(1, (lens[0] if len(lens) else 0) + 1), "right")
    r = None
    for t, n in enumerate(live):
        at = offs[:n] + t
        r = e[at] * (start if t == 0 else (a01 + a11 * r[:n]) / (a00 + a10 * r[:n]))
        np.clip(r, 1e-30, 1e30, out=r)
        fwd[at] = r
    out = np.empty(len(e))
    b = np.ones(len(lens))  # ratio of the backward messages
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        at = offs[:n] + t
        post = fwd[at] * b[:n]
        out[at] = post / (1 + post)
        x = e[at] * b[:n]
        b[:n] = np.clip((a10 + a11 * x) / (a00 + a01 * x), 1e-30, 1e30)
    return out


class Model:
    def __init__(self):
        self.know(np.zeros(0, np.uint64), np.zeros(0))
        self.trans = np.ones((2, 2))
        self.start, self.bias, self.cal = 1e-9, 0.0, (0.0, -10.0)

    def know(self, keys: np.ndarray, w: np.ndarray) -> None:
        """Weights by feature; ``keys`` ascending."""
        self.keys, self.w = keys, w
        self.maybe = np.zeros(2**BITS, bool)
        self.maybe[keys >> np.uint64(64 - BITS)] = True

    def emission(self, f: np.ndarray) -> np.ndarray:
        out = np.zeros(len(f))
        row, col = np.nonzero(self.maybe[f >> np.uint64(64 - BITS)])
        if len(row):
            h = f[row, col]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            np.add.at(out, row, np.where(self.keys[at] == h, self.w[at], 0.0))
        return out

    def marginals(self, texts):
        t = Tokens(texts)
        lens = np.bincount(t.doc, minlength=t.n).astype(np.int64)
        offs = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
        if not len(t.h):
            return t, np.zeros(0), lens, offs
        return t, chain(self.bias + self.emission(t.features()), self.trans, self.start, lens, offs), lens, offs

    def mass(self, texts):
        """Per text minus the log probability that no token is toxic, by marginals."""
        t, p, lens, _ = self.marginals(texts)
        return np.bincount(t.doc, -np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=t.n), t, p

    def scores(self, texts):
        s, t, p = self.mass(texts)
        a, b = self.cal
        return 1 / (1 + np.exp(-np.clip(a * np.log1p(s) + b, -30, 30))), t, p


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 30) -> Model:
    model = Model()
    toxic = np.asarray(toxic).astype(bool)
    if toxic.all() or not toxic.any():
        return model
    # copies and near copies would make their chance words look toxic
    seen: set[int] = set()
    alone = []
    for i, j in blocks(texts):
        for d, x in enumerate(shingle_sets(texts[i:j], 2), i):
            least = {int(mix(x ^ np.uint64(k * 7919)).min()) ^ k for k in range(1, 6)} if len(x) else set()
            alone.append(not least & seen)
            seen |= least
    texts, toxic = [x for x, ok in zip(texts, alone) if ok], toxic[np.array(alone)]
    if toxic.all() or not toxic.any():
        return model
    t = Tokens(texts)
    f = t.features()
    # token labels from document counts of features
    names, f = np.unique(f, return_inverse=True)
    f = f.reshape(len(t.h), -1).astype(np.int32)
    bad, all_ = np.zeros(len(names), np.int32), np.zeros(len(names), np.int32)
    for c in range(f.shape[1]):
        seen = np.unique(t.doc.astype(np.int64) * len(names) + f[:, c])
        d, k = np.divmod(seen, len(names))
        np.add.at(all_, k, 1)
        np.add.at(bad, k[toxic[d]], 1)
    q, r = toxic.mean(), bad / np.maximum(all_, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = all_ * np.nan_to_num(r * np.log2(r / q) + np.where(r < 1, (1 - r) * np.log2((1 - r) / (1 - q)), 0))
    sure = (r >= 0.9) & (bits >= EVIDENCE) & (names != 0)  # too rare to come about by chance
    y = sure[f].any(1) & toxic[t.doc]
    # windows round toxic tokens, and as many again from clean texts
    rng = np.random.default_rng(7)
    hit = np.flatnonzero(y)
    clean = np.flatnonzero(~toxic[t.doc])
    if not len(hit):
        return model
    mid = np.concatenate([rng.permutation(hit)[: WINDOWS[0]], rng.choice(clean, min(WINDOWS[1], len(clean)), replace=False)])
    at = np.clip(mid[:, None] + np.arange(-SIDE, SIDE + 1), 0, len(y) - 1)
    ok = t.doc[at] == t.doc[mid][:, None]
    fx, yy = f[at], y[at] & ok
    # features of one or two training texts say nothing about others
    used, fx = np.unique(np.where((all_ >= 4) & (names != 0), np.arange(len(names)), -1)[fx], return_inverse=True)
    fx = fx.reshape(*at.shape, -1)
    w = np.zeros(len(used))
    lt = np.zeros((2, 2))
    ls, w0 = 0.0, -2.0
    m = [np.zeros_like(w), np.zeros(6)]
    v = [np.zeros_like(w), np.zeros(6)]
    n = len(at)
    for step in range(1, rounds + 1):
        s = np.where(ok, w0 + np.where(used < 0, 0, w)[fx].sum(2), -30.0)
        a = np.exp(lt)
        e = np.stack([np.ones_like(s), np.exp(np.clip(s, -30, 30))], 2)
        T = s.shape[1]
        al, be = np.empty((T, n, 2)), np.ones((T, n, 2))
        al[0] = e[:, 0] * [1, np.exp(ls)]
        al[0] /= al[0].sum(1, keepdims=True)
        for i in range(1, T):
            al[i] = (al[i - 1] @ a) * e[:, i]
            al[i] /= al[i].sum(1, keepdims=True)
        for i in range(T - 2, -1, -1):
            be[i] = (be[i + 1] * e[:, i + 1]) @ a.T
            be[i] /= be[i].sum(1, keepdims=True)
        post = al * be
        post /= post.sum(2, keepdims=True)
        g = yy - post[:, :, 1].T * ok
        gw = np.bincount(fx.ravel(), np.repeat(g.ravel(), fx.shape[2]), minlength=len(used)) - 0.3 * w
        pair = np.zeros((2, 2))
        for i in range(1, T):
            x = al[i - 1][:, :, None] * a * (be[i] * e[:, i])[:, None, :]
            pair -= (x / x.sum((1, 2), keepdims=True)).sum(0)
            pair += np.bincount(2 * yy[:, i - 1] + yy[:, i], minlength=4).reshape(2, 2)
        gt = np.append(pair.ravel(), (yy[:, 0] - post[0, :, 1]).sum()) / n
        gt = np.append(gt, g.sum() / n)
        for k, (grad, rate_) in enumerate(((gw, 0.25), (gt, 0.1))):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad**2
            move = rate_ * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            if k == 0:
                w += move
            else:
                lt += move[:4].reshape(2, 2)
                ls += move[4]
                w0 += move[5]
    w[used < 0] = 0
    model.bias = float(w0)
    keep = np.abs(w) > 0.02
    model.know(names[used[keep]], w[keep])
    model.trans, model.start = np.exp(lt), float(np.exp(ls))
    # one-variable logistic fit of document labels
    x = np.log1p(np.concatenate([model.mass(texts[i:j])[0] for i, j in blocks(texts)]))
    a, b = 1.0, -2.0
    weight = np.where(toxic, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((toxic - p) * weight * x).sum() - 0.5 * a, ((toxic - p) * weight).sum()])
        h = weight * p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 0.5, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(hess, g), -3, 3)
    model.cal = (float(a), float(b))
    return model


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rows of each class outside the held-out third."""
    lab = labels.where("doc_id is not null and toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1").select(F.col("doc_id").cast("long"), (F.col("toxic") > 0).alias("toxic"))
    docs = docs.where(F.length("text") <= LONGEST).select(F.col("doc_id").cast("long"), "text")
    # ids first, so that no text is shuffled; rows of one id are one text each
    here = lab.distinct().join(docs.select("doc_id"), "doc_id", "left_semi")
    few = None
    for kind in (True, False):
        part = here.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        few = part if few is None else few.union(part)
    # at most 2 * sample ids, so the broadcast is bounded
    found = docs.join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = found.orderBy(~F.col("toxic"), F.xxhash64("doc_id"), "doc_id").toPandas()
    return fit(found["text"].tolist(), found["toxic"].to_numpy(bool)) if len(found) else Model()


def _score(model, spans: bool):
    def run(batches):
        m = model.value
        for pdf in batches:
            texts = pdf["text"].tolist()
            for i, j in blocks(texts):
                s, t, p = m.scores(texts[i:j])
                part = pdf.iloc[i:j].drop(columns="text").assign(score=s)
                if spans:
                    hot = np.flatnonzero(p >= 0.5)
                    found = [[] for _ in range(i, j)]
                    for k in hot:
                        d, lo, hi = t.doc[k], t.at[k] - t.base[t.doc[k]], t.to[k] - t.base[t.doc[k]]
                        found[d].append({"start": int(lo), "end": int(hi), "p": float(p[k])})
                    part["spans"] = pd.Series(found, index=part.index, dtype=object)
                yield part

    return run


def toxicity(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, key (hash of the text), score, spans (byte offsets in UTF-8 of
    offending tokens with their marginals), one row per input row."""
    kit.bound_batches(spark)
    given = spark.sparkContext.broadcast(model)  # 4 MB, whatever the data
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text")
    return frames(docs, _score(given, True), "doc_id long, key long, score double, spans array<struct<start:long,end:long,p:double>>")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity(spark, docs, train(spark, docs, labels))
    held = F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the model rejects go."""
    model = train(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kit.bound_batches(spark)
    given = spark.sparkContext.broadcast(model)

    def run(batches):
        # whole Arrow rows pass or go, so no other column is touched
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in blocks(texts):
                s, _, _ = given.value.scores(texts[i:j])
                yield batch.slice(i, j - i).filter(pa.array(s < CUT))

    return docs.mapInArrow(run, docs.schema)
