"""Token-id files: an adaptive range coder over independently reset blocks.

A file is a run of blocks, each followed by a line feed.  A block is::

    b"TOK2"  u32 documents  u32 ids  u32 lanes  u32 size  u32 crc32 of the rest
    documents x (i64 doc_id, u8 null doc_id, u32 ids in this block, u8 goes on)
    lanes x u16 words, then their words (u16)

Its ids form ``lanes`` equal stretches, each coded by a range coder of its own; the
coders advance in step, so that one array operation codes an id of every lane.
An id's probability is a mixture of three models: the order-0 frequencies of ids so
far, all mass on the id that last followed the id before it (order 1), and all mass
on the one that last followed the two before it (order 2).  The mixture's weights
are learned for each pair of confidences of both predictions.  All tables start anew
in each block, and learn after 1, 2, 4, ... ids of a lane, then every ``STEP``.

Files hold what a range of ``PART`` input bytes gives, so that readers, which take
files whole, have bounded work.  Cases: null text is empty and has the end id only;
an empty table gives no rows; equal doc_ids are ordered by text; null doc_ids come
first; a document may span blocks, never files (so one document's ids must fit in a
worker); repeated rows are written each; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import LONG, ODD, byte_letters, usual, vocabulary
from .kit import Scratch, blocks, bound_batches, checked_small, frames, parts_of, table

HEAD = struct.Struct("<4s5I")
DOCS = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4"), ("more", "u1")])
IDS, LANES, STEP = 1 << 20, 4096, 32
PART = 64 << 20  # bytes of stored input a file
SHIFT0, SHARES = 20, 64  # an order-0 total of 1 << SHIFT0; weights of models are 64ths
TOTAL = SHIFT0 + SHARES.bit_length() - 1
BITS, WORD = 48, 16  # of a coder's state and of what it puts out
LEAST, MASK = 1 << BITS - WORD, (1 << BITS) - 1


def pick(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``table[at]`` for places that it has; numpy is twice as quick where it need not raise."""
    return table.take(at, mode="clip")


class Mixer:
    """The models of one block and their mixture, the same for writer and reader.
    A prediction's table holds id + (confidence << 16)."""

    def __init__(self):
        self.last1, self.last2 = np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)
        self.right = np.tile(np.array([2, 1, 1]), (32, 1))  # by context: neither right, order 1, order 2
        self.count = np.zeros(1 << 16, np.int64)
        self.refresh()

    def refresh(self):
        free = (1 << SHIFT0) - (1 << 16)
        freq = 1 + self.count * free // max(1, self.count.sum())
        freq[freq.argmax()] += (1 << SHIFT0) - freq.sum()
        self.freq, self.place = freq.astype(np.int32), (np.cumsum(freq) - freq).astype(np.int32)
        share = self.right * (SHARES - 3) // self.right.sum(1, keepdims=True) + 1
        share[1::2, 2] += share[1::2, 1]  # both predict the same id
        share[1::2, 1] = 0
        share = share.astype(np.int32)
        self.mass1, self.mass2 = share[:, 1] << SHIFT0, share[:, 2] << SHIFT0
        self.share0 = SHARES - share[:, 1] - share[:, 2]

    @staticmethod
    def key(b, a):
        # of products, 26 bits count, so those of 32 do
        return (((b.astype(np.uint32) * 40503 + a.astype(np.uint32)) * 2654435761 >> 8) & 0x3FFFF).astype(np.intp)

    def guess(self, b, a):
        """After ids b, a: ids predicted by orders 1 and 2, the context, and what ``learn``
        needs of them: the key of b, a and both entries."""
        k = self.key(b, a)
        g1, g2 = pick(self.last1, a.astype(np.intp)), pick(self.last2, k)
        p1, p2 = g1 & 0xFFFF, g2 & 0xFFFF
        return p1, p2, (g2 >> 16) * 8 + (g1 >> 16) * 2 + (p1 == p2), k, g1, g2

    def shares(self, context):
        context = context.astype(np.intp)
        return pick(self.share0, context), pick(self.mass1, context), pick(self.mass2, context)

    def span(self, y, w):
        """Place and size of id y in the order-0 part of the mixture."""
        y = y.astype(np.intp)
        return w * pick(self.place, y), w * pick(self.freq, y)

    def interval(self, y, p1, p2, w, m1, m2):
        """Place and size of id y in the mixture's cumulative distribution; all are under 2**31."""
        at, size = self.span(y, w)
        return at + m1 * (y > p1) + m2 * (y > p2), size + m1 * (y == p1) + m2 * (y == p2)

    def symbols(self):
        """Id by place in the order-0 distribution."""
        return np.repeat(np.arange(1 << 16, dtype=np.int32), self.freq)

    def find(self, v, p1, p2, w, m1, m2, symbols):
        """The id whose interval holds v, and the interval's place and size."""
        # where both predict the same id, m1 is 0 and the second has all
        (at1, size1), (at2, size2) = self.span(p1, w), self.span(p2, w)
        at1 += m2 * (p1 > p2)
        at2 += m1 * (p2 > p1)
        past1, past2 = v >= at1 + size1 + m1, v >= at2 + size2 + m2
        hit1, hit2 = (v >= at1) > past1, (v >= at2) > past2
        low = m1 * past1 + m2 * past2
        # exact, as both are under 2**32; ids of predictions are put right below
        y = pick(symbols, ((v - low) / w).astype(np.intp))
        y += (p1 - y) * hit1  # choices by masks take longer than sums
        y += (p2 - y) * hit2
        at, size = self.span(y, w)
        at += low
        size += m1 * hit1 + m2 * hit2
        return y, at, size

    def learn(self, a, y, p1, p2, context, k, g1, g2):
        for i in range(0, len(y), LANES * 4):  # as much as stays in a cache
            some = slice(i, i + LANES * 4)
            right1, right2 = p1[some] == y[some], p2[some] == y[some]
            for table, at, now, right in ((self.last2, k, g2[some], right2), (self.last1, a, g1[some], right1)):
                sure = now >> 16
                # right: surer, up to 3; wrong: less sure, or replaced
                up, down, new = right & (sure < 3), right < (sure > 0), right < (sure == 0)
                table[at[some].astype(np.intp)] = now + ((up.view(np.int8) - down.view(np.int8)).astype(np.int32) << 16) + (y[some] - now) * new
            seen = np.bincount(context[some] * 4 + right2 * np.int32(2) + right1, minlength=128).reshape(32, 4)
            self.right += seen[:, :3]
            self.right[:, 2] += seen[:, 3]
        self.count += np.bincount(y, minlength=1 << 16)
        self.refresh()


class Coder:
    """Range coders in step: each lane has an interval of at most 2**48 and puts
    out words of 16 bits, into rows of a word a lane.  The writer's carries are added
    to words put out before and settled at the end."""

    def __init__(self, lanes: int, words: np.ndarray | None = None):
        self.lanes, self.range, self.at = lanes, np.full(lanes, MASK), np.arange(lanes)  # at: place in words
        self.low = np.zeros(lanes, np.int64)  # the reader's: code less low
        self.words = np.zeros(64 * lanes, np.int64) if words is None else words.ravel()
        self.writes = words is None
        if not self.writes:
            for _ in range(BITS // WORD):
                self.low = self.low << WORD | pick(self.words, self.at)
                self.at += lanes

    @property
    def pos(self) -> np.ndarray:
        """Words of each lane so far."""
        return self.at // self.lanes

    def grow(self, at):
        if at.max() + self.lanes >= len(self.words):
            self.words = np.concatenate([self.words, np.zeros_like(self.words)])

    def narrow(self, at, size):
        """To the interval from ``at`` of 2**TOTAL, of ``size``."""
        unit = self.range >> TOTAL
        if self.writes:
            self.low += unit * at
            over = np.flatnonzero(self.low > MASK)
            self.words[pick(self.at, over) - self.lanes] += 1
            self.low[over] &= MASK
        else:
            self.low -= unit * at
        self.range = unit * size
        few = np.flatnonzero(self.range < LEAST)
        while len(few):
            to, low = pick(self.at, few), pick(self.low, few)
            if self.writes:
                self.grow(to)
                self.words[to] = low >> BITS - WORD
                self.low[few] = low << WORD & MASK
            else:
                self.low[few] = low << WORD | pick(self.words, to)
            self.at[few] = to + self.lanes
            self.range[few] = wide = pick(self.range, few) << WORD
            few = few[wide < LEAST]

    def seek(self):
        """Where in 2**TOTAL each lane's code lies; exact, as both numbers are under 2**49."""
        return np.minimum((self.low / (self.range >> TOTAL)).astype(np.int32), (1 << TOTAL) - 1)

    def close(self) -> np.ndarray:
        """Words by place and lane; the reader takes those past a lane's end as zeros."""
        self.grow(self.at)
        # one word more picks the only multiple of 2**32 that the interval must hold
        self.words[self.at] = (self.low + LEAST - 1) >> BITS - WORD
        self.at += self.lanes
        words = self.words.reshape(-1, self.lanes)[: self.pos.max()]
        for i in range(len(words) - 1, 0, -1):
            words[i - 1] += words[i] >> WORD
            words[i] &= (1 << WORD) - 1
        return words


def steps(width: int):
    """Stretches of columns after which the models learn."""
    at, size = 0, 1
    while at < width:
        yield at, min(width, at + size)
        at, size = at + size, min(STEP, 2 * size)


def encode_ids(ids: np.ndarray) -> tuple[int, bytes]:
    n = len(ids)
    lanes = min(LANES, max(1, n // 256))
    width = -(-n // lanes)
    full = np.zeros(lanes * width, np.int32)
    full[:n] = ids
    x = np.zeros((width + 2, lanes), np.int32)
    x[2:] = full.reshape(lanes, width).T
    m, c = Mixer(), Coder(lanes)
    for t, e in steps(width):
        b, a, y = x[t:e], x[t + 1 : e + 1], x[t + 2 : e + 2]
        p1, p2, context, *rest = m.guess(b, a)
        at, size = m.interval(y, p1, p2, *m.shares(context))
        for j in range(e - t):
            c.narrow(at[j], size[j])
        m.learn(*(z.ravel() for z in (a, y, p1, p2, context, *rest)))
    words = c.close().astype("<u2").T
    return lanes, c.pos.astype("<u2").tobytes() + words[np.arange(words.shape[1]) < c.pos[:, None]].tobytes()


def decode_ids(n: int, lanes: int, data: bytes) -> np.ndarray:
    size = np.frombuffer(data, "<u2", lanes).astype(np.int64)
    flat = np.frombuffer(data, "<u2", offset=2 * lanes)
    words = np.zeros((lanes, int(size.max()) + 4), np.int64)
    words[np.arange(words.shape[1]) < size[:, None]] = flat
    width = -(-n // lanes)
    x = np.zeros((width + 2, lanes), np.int32)
    m, c = Mixer(), Coder(lanes, np.ascontiguousarray(words.T))
    for t, e in steps(width):
        symbols, seen = m.symbols(), []
        for j in range(t, e):
            p1, p2, context, *rest = m.guess(x[j], x[j + 1])
            seen.append((p1, p2, context, *rest))
            x[j + 2], at, size = m.find(c.seek(), p1, p2, *m.shares(context), symbols)
            c.narrow(at, size)
        m.learn(x[t + 1 : e + 1].ravel(), x[t + 2 : e + 2].ravel(), *(np.concatenate(z) for z in zip(*seen)))
    return x[2:].T.ravel()[:n]


def pack(docs: list[tuple], ids: np.ndarray) -> bytes:
    """A block from (doc_id, ids here, goes on) and the ids."""
    table = np.array([(0 if d is None else d, d is None, n, more) for d, n, more in docs], DOCS).tobytes()
    lanes, body = encode_ids(ids)
    rest = table + body
    return HEAD.pack(b"TOK2", len(docs), len(ids), lanes, len(rest), zlib.crc32(rest)) + rest


def unpack(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = 0
    while at < len(data):
        magic, nd, n, lanes, size, crc = HEAD.unpack_from(data, at)
        rest = data[at + HEAD.size : at + HEAD.size + size]
        if magic != b"TOK2" or len(rest) != size or zlib.crc32(rest) != crc:
            raise ValueError(f"damaged block at byte {at}")
        yield np.frombuffer(rest, DOCS, nd), decode_ids(n, lanes, rest[nd * DOCS.itemsize :])
        at += HEAD.size + size + 1


#: The letter of each byte.
LETTERS = "".join(sorted(byte_letters(), key=byte_letters().get))

#: fixed value: what the tokenizer takes as one piece, within the usual characters
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{usual('L')}]+|[{usual('N')}]|[^\\s{usual('L')}{usual('N')}]+")


class Known(dict):
    """What ``of`` gives, asked once for each key of up to ``LONG`` bytes; what ``older`` holds is taken over when met."""

    def __init__(self, of, older):
        self.of, self.older = of, older

    def __missing__(self, key):
        got = self.older.get(key)
        if got is None:
            got = self.of(key)
        if len(key) <= LONG:
            self[key] = got
        return got


#: What a byte of UTF-8 is: a comma for ASCII's marks, ``o`` for what may begin other characters than those of U+00C0 to U+023F
KINDS = bytes(0x20 if chr(c).isalnum() or c in b"\t\n\v\f\r " else 0x2C for c in range(128)) + bytes(0x20 if c < 0xC0 or 0xC3 <= c <= 0xC8 else 0x6F for c in range(128, 256))


#: Marks among those letters, and the capital whose small letter ends in one
AMONG = ["×".encode(), "÷".encode(), "İ".encode()]


def words(text: str) -> list[bytes]:
    """Texts parted at ASCII's white space (bytes split at no other), and at commas and full stops if no mark
    adjoins another, so that each is a piece.  ASCII's capitals are made small, unless special tokens or capitals
    with combining marks may be there."""
    raw = text.encode()
    kinds = raw.translate(KINDS)
    if b"o" in kinds or b"<|" in raw:
        return raw.split()
    if b",," in kinds or any(x in raw for x in AMONG):
        return raw.lower().split()
    return raw.lower().replace(b",", b" , ").replace(b".", b" . ").split()


class Encoder:
    """The tokenizers library, asked once for each distinct piece.  The tokenizer
    lower-cases, parts texts into pieces, drops white space, and joins nothing over
    the ends of pieces; so texts are split at white space, and only words not met
    before are parted, their pieces going to its model one by one.  Words with other
    characters than the usual ones, or with what may be a special token, go to the
    tokenizer whole."""

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        self.model = self.t.model
        if max(self.t.get_vocab().values()) >= 1 << 16:
            raise ValueError("ids of over 16 bits")
        self.known = Known(self.ids, {})
        self.most = most  # words of each of two generations, some 200 bytes each

    def ids(self, word: bytes) -> bytes:
        if word.isalpha():
            return self.piece(word.lower())
        w = word.decode()
        low = w.lower()
        if low.isalpha() and b"o" not in word.translate(KINDS):  # letters alone are one piece
            return self.piece(low.encode())
        if ODD.search(w) or ODD.search(low):
            return array("H", self.t.encode(w, add_special_tokens=False).ids).tobytes()
        pieces = [p.encode() for p in PIECE.findall(low)]
        return self.piece(pieces[0]) if len(pieces) == 1 else b"".join([self.known[p] for p in pieces])

    def piece(self, piece: bytes) -> bytes:
        return array("H", [x.id for x in self.model.tokenize(charmap_decode(piece, "strict", LETTERS)[0])]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """16-bit ids per text."""
        if len(self.known) > self.most:  # words that are met again stay
            self.known.older = {}
            self.known = Known(self.ids, self.known)
        known = self.known.__getitem__
        return [b"".join(map(known, words(x))) for x in texts]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    return encoder(path).encode(texts)


def write_tokens(docs: DataFrame, path: str, vocab: str, end: int = 1) -> None:
    """Files of blocks under ``path``, documents in ascending doc_id order."""
    bound_batches(docs.sparkSession)
    tail = np.array([end], "<u2").tobytes()

    def run(batches):
        docs_, parts, size = [], [], 0
        for pdf in batches:
            texts = [x or "" for x in pdf["text"]]
            for i, j in blocks(texts):
                for d, raw in zip(pdf["doc_id"].iloc[i:j], encode_texts(texts[i:j], vocab)):
                    d = None if pd.isna(d) else int(d)
                    ids = np.frombuffer(raw + tail, "<u2")
                    while len(ids):
                        part, ids = ids[: IDS - size], ids[IDS - size :]
                        docs_.append((d, len(part), len(ids) > 0))
                        parts.append(part)
                        size += len(part)
                        if size == IDS:
                            yield pd.DataFrame({"block": [pack(docs_, np.concatenate(parts))]})
                            docs_, parts, size = [], [], 0
        if size:
            yield pd.DataFrame({"block": [pack(docs_, np.concatenate(parts))]})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    docs = docs.repartitionByRange(parts_of(docs, PART), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    frames(docs, run, "block binary").select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read_tokens(spark: SparkSession, path: str, tmp: Scratch) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files under ``path``."""

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                name = name.rsplit("/", 1)[-1]
                at = begun = crc = 0
                for docs, ids in unpack(bytes(data)):
                    raw, i, out = ids.astype("<u4").tobytes(), 0, []
                    for d, null, n, more in docs.tolist():
                        crc = zlib.crc32(raw[4 * i : 4 * (i + n)], crc)
                        i += n
                        at += n
                        if not more:
                            out.append((name, None if null else d, begun, at - begun, crc))
                            begun, crc = at, 0
                    yield table(out, ["file", "doc_id", "at", "n_tokens", "ids_crc32"], "doc_id")

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    rows = tmp.park(frames(files, run, "file string, doc_id long, at long, n_tokens long, ids_crc32 long"), "rows")
    # one row per file: its place follows from the number in its name
    part = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("no", F.regexp_extract("file", r"part-(\d+)", 1).cast("long"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("no", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = tmp.park(part.select("file", before.alias("base")), "base")
    return rows.join(checked_small(base), "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp = Scratch(spark, "tokens")
    path = tmp.path("files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary("word_bpe_49k.json"))
    return read_tokens(spark, path, tmp)
