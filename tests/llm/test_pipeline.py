"""The pipeline as a whole against brute-force versions of its stages."""

import hashlib
import random
import re

import numpy as np

import corpus_pipeline
from tessera.llm import bpe, toxicity

from test_operators import ODD, documents, near_brute, words

ITEM = "On the table John Smith put 12 apples and 5 kg of pears before John Smith left the old house"
BAD = ["moron", "idiot", "scum", "losera", "loserb", "loserc"]
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def corpus():
    """(id, text) rows and (id, toxic) labels: toxic texts, copies, near copies, leaks and secrets among clean ones."""
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(400):
        w = words(60, 2000 + i)
        if i % 4 == 0:
            for _ in range(4):
                w.insert(rng.randrange(60), rng.choice(BAD))
        texts.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    filler = lambda k: " ".join(words(70, 9000 + k))
    more = [
        (1000, texts[1][1]), (1001, texts[2][1].rsplit(" ", 2)[0] + " other end"), (1002, texts[4][1]), (1003, f"{filler(1)}. {ITEM}. {filler(2)}"), (1004, ITEM),
        (1005, f"{filler(3)} password: hunter2hunter2x {filler(4)} token=short"), (1006, f"é {filler(5)} api_key='zzzzyyyyxxxxwwww' tail"),
    ]
    return texts + more + ODD[1:], labels


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    texts, labels = corpus()
    docs, marks = documents(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, ITEM, 0), (8, None, 0)], "item_id long, text string, at long").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    rude = {r.doc_id for r in toxicity.toxicity(spark, docs, toxicity.train(spark, docs, marks)).collect() if r.score >= toxicity.CUT}
    planted = {i for i, t in texts if t and set(t.split()) & set(BAD)}
    assert rude <= planted and len(rude) >= 0.95 * len(planted)
    kept = [(i, t) for i, t in texts if i not in rude]
    group = near_brute(kept, 5, 80)
    kept = [(i, t) for i, t in kept if group[i][1] == i and ITEM not in (t or "")]
    kept = [(i, ASSIGN.sub(lambda m: "[SECRET]" if len(m[2]) >= 12 else m[0], t or "")) for i, t in kept]
    assert {1000, 1001, 1003, 1004}.isdisjoint(i for i, _ in kept) and sum("[SECRET]" in t for _, t in kept) == 2
    lib = Tokenizer.from_file(bpe.vocabulary("byte_bpe_50k.json"))
    want = set()
    for i, t in kept:
        ids = lib.encode(t, add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == want


def test_pipeline_of_nothing(spark, tmp_path):
    docs = documents(spark, [(1, "x")]).where("false")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
