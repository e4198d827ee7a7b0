"""Byte-level BPE by prefix-sharing trie traversal.

The distinct words of a batch form a trie, walked depth-first in sorted order.
A node stands for a prefix and holds the last token of the prefix's encoding and
where it begins, which is the node of what precedes it.  The last token of a longer prefix is the suffix token whose
junction with the encoding of what precedes it no merge would cross; so each
shared prefix is encoded once, and a word's encoding is read off along its nodes.
Memory is in proportion to the longest word.

A junction of tokens (x, y) stays closed unless some token on the right edge of x
and some token on the left edge of y merge before either is merged into its
parent.  Merges are ranked by the id of the token that they make.

Cases: an empty table gives no rows; null text is empty, no tokens; the special token's string in a text is its
id, as the library does; repeated rows are encoded each; texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kit import blocks, bound_batches, frames

#: fixed value: how byte-level BPE parts words
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 30
LONG = 100  # longer words are not kept
KEPT = 150_000  # words of each of two generations, some 200 bytes each

# characters that every version of Unicode classes alike: ASCII, Latin, dashes and quotes
USUAL = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x250), *range(0x2010, 0x2028)]
ODD = re.compile(f"[^\\x09-\\x0D\\x20{''.join(re.escape(chr(c)) for c in USUAL)}]|<\\|")  # <| may open a special token


def usual(kind: str) -> str:
    """Those of the usual characters whose category begins so, as part of a character class."""
    # lower-casing U+0130 leaves U+0307
    return "".join(re.escape(chr(c)) for c in [*USUAL, 0x307] if unicodedata.category(chr(c)).startswith(kind))


#: PATTERN within the usual characters, for the quicker library
WORDS = re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{usual('L')}{usual('N')}]").replace(r"\p{L}", f"[{usual('L')}]").replace(r"\p{N}", f"[{usual('N')}]"))


def byte_letters() -> dict[str, int]:
    """The letter that vocabulary files write for each byte: printable Latin-1
    stands for itself, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.id = {raw(s): i for s, i in vocab.items() if s not in self.special}
        self.bytes = {i: b for b, i in self.id.items()} | {i: s.encode() for s, i in self.special.items()}
        self.made, self.parts = {}, {}
        for m in spec["model"]["merges"]:
            x, y = m if isinstance(m, list) else m.split(" ")
            i = vocab[x + y]
            self.made[vocab[x], vocab[y]] = i
            self.parts.setdefault(i, (vocab[x], vocab[y]))
        #: by the last three bytes of a prefix, the longest token that can end it
        self.reach: dict[bytes, int] = {}
        for b in self.id:
            self.reach[b[-3:]] = max(self.reach.get(b[-3:], 0), len(b))
        self.edges: tuple[dict, dict] = ({}, {})
        self.closed: dict[int, bool] = {}
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.words = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def edge(self, t: int, side: int) -> list[tuple[int, int]]:
        """Tokens on the left (0) or right (1) edge of t, each with the rank at
        which it is merged away within t."""
        got = self.edges[side].get(t)
        if got is None:
            got, gone, x = [], NEVER, t
            while True:
                got.append((x, gone))
                if x not in self.parts:
                    break
                gone, x = x, self.parts[x][side]
            self.edges[side][t] = got
        return got

    def fits(self, x: int, y: int) -> bool:
        key = x << 20 | y
        got = self.closed.get(key)
        if got is None:
            got = True
            for a, a_gone in self.edge(x, 1):
                for b, b_gone in self.edge(y, 0):
                    rank = self.made.get((a, b))
                    # of equal ranks the leftmost merge comes first
                    if rank is not None and rank < a_gone and rank <= b_gone:
                        got = False
            if len(self.closed) > 300_000:
                self.closed.clear()
            self.closed[key] = got
        return got

    def walk(self, words: Iterable[str]) -> dict[str, bytes]:
        """Encodings (little-endian 32-bit ids) of distinct words."""
        out = {}
        coded = sorted((w.encode("utf-8", "surrogatepass"), w) for w in words)
        # of each prefix on the current path: its last token, and where that begins
        last: list[int] = [0]
        from_: list[int] = [0]
        before, number = b"", int.from_bytes
        ids, fits, closed, reach = self.id, self.fits, self.closed, self.reach
        for raw, word in coded:
            n = len(raw)
            m = min(len(before), n)  # as numbers, two prefixes of m bytes differ below the common part
            depth = m - ((number(before[:m]) ^ number(raw[:m])).bit_length() + 7 >> 3)
            del last[depth + 1 :], from_[depth + 1 :]
            for end in range(depth + 1, n + 1):
                most = reach.get(raw[max(0, end - 3) : end], 2)
                for begin in range(max(0, end - most), end):
                    t = ids.get(raw[begin:end])
                    if t is not None:
                        if begin == 0:
                            break
                        ok = closed.get(last[begin] << 20 | t)
                        if fits(last[begin], t) if ok is None else ok:
                            break
                last.append(t)
                from_.append(begin)
            before = raw
            tokens, at = array("I"), n
            while at:
                tokens.append(last[at])
                at = from_[at]
            tokens.reverse()
            out[word] = tokens.tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = []
        for t in texts:
            row, at = [], 0
            if self.split is not None and "<|" in t:
                for m in self.split.finditer(t):
                    row += [self.words.findall(t[at : m.start()]), m.group()]
                    at = m.end()
            words = self.words if ODD.search(t) else WORDS
            row.append(words.findall(t[at:] if at else t))
            parts.append(row)
        if len(self.known) > KEPT:  # words that are met again stay
            self.older, self.known = self.known, {}
        new = set()
        for row in parts:
            for p in row:
                if not isinstance(p, str):
                    new.update(p)
        new.difference_update(self.known)
        again = new.intersection(self.older)
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        fresh = self.walk(new - again)
        self.known.update(fresh)
        get = self.known.__getitem__
        out = [b"".join([self.special[p].to_bytes(4, "little") if isinstance(p, str) else b"".join(map(get, p)) for p in row]) for row in parts]
        for w in fresh:
            if len(w) > LONG:
                del self.known[w]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def load(path: str) -> Bpe:
    return Bpe(path)


def round_trip(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; ``path`` is the vocabulary
    file, present on every machine."""
    bound_batches(spark)

    def run(batches):
        bpe = load(path)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for i, j in blocks(texts):
                ids = bpe.encode(texts[i:j])
                yield pd.DataFrame({
                    "doc_id": pdf["doc_id"].array[i:j],
                    "n_tokens": [len(x) // 4 for x in ids],
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids],
                })

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return frames(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"))


def encode_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the corpus as token ids, with digests."""
    return round_trip(spark, docs, vocabulary("byte_bpe_50k.json"))
