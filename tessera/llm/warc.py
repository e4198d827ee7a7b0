"""Legacy web archives (ARC) to WARC.

``read_arc`` parses ARC files: the version block names the version, whose header
lines have five fields (version 1) or ten (version 2), and each record has as
many bytes as its line declares.  Addresses and types with blanks in them are told
apart from the right.  Where no header line stands, or fewer bytes follow than it
declares, the damage is reported and parsing goes on at the next line that is a
header.  Header fields of HTTP may end in CRLF or LF.  ``to_warc`` makes the equivalent WARC record:
identifier, W3C date, type and digests are synthesised.  Archives are written by
Spark's text writer with the four bytes that end a WARC record as line
separator, so they go to any store that Spark can write.  Rows of that writer hold
records of ``ROW`` bytes together and files ``ROWS`` rows, so files are bounded by
bytes; they are read back whole, gzip or plain, and parsed by declared lengths.

Of records with equal payloads the one of the largest page_id is the response and
the others revisit it.  Digests are counted by partial aggregation; only those
with several records are joined back (broadcast if few, checked, else shuffled
and split by adaptive execution).

Cases: null html is an empty payload; a null url is ``urn:x-none``, white space
in urls is percent-encoded; rows that repeat a page_id with equal payloads are
all of its type, with record identifiers of their own, and the last row of them is
the one referred to; a record of null page_id is a revisit if a numbered one has its
payload; an empty table gives no rows; a very long html is one record, held whole by
a worker; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kit import Scratch, checked_small, frames, table

END = b"\r\n\r\n"
ROW, ROWS = 2_000_000, 32
#: fixed values: the field lists of both ARC versions
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
LINE = {
    1: re.compile(rb"(\S.*) (\S+) (\d{4,14}) (.*) (\d+)\r?\n"),
    2: re.compile(rb"(\S.*) (\S+) (\d{4,14}) (.*) (\S+) \S+ \S+ \S+ \S+ (\d+)\r?\n"),
}
BLANK = re.compile(rb"\r?\n\r?\n")


@dataclass
class Record:
    url: str
    ip: str
    date: str  # 14 digits
    mime: str
    block: bytes
    version: int = 1
    status: str = "200"


def write_arc(records: list[Record], version: int, name: str = "part.arc") -> bytes:
    info = f"{version} 0 tessera\n{FIELDS[version]}\n".encode()

    def line(r: Record, size: int) -> bytes:
        mid = "" if version == 1 else f"{r.status} - - 0 {name} "
        return f"{r.url} {r.ip} {r.date} {r.mime} {mid}{size}\n".encode()

    head = Record(f"filedesc://{name}", "0.0.0.0", "19960923142103", "text/plain", info)
    return b"".join(line(r, len(r.block)) + r.block + b"\n" for r in [head, *records])


def read_arc(data: bytes, damage: list[str] | None = None) -> Iterator[Record]:
    """Records of an ARC file, without its version block.  Damage is noted in
    ``damage``, or raises ValueError where none is given."""

    def note(text: str) -> None:
        if damage is None:
            raise ValueError(text)
        damage.append(text)

    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        m = LINE[version or 1].match(data, at)
        size = int(m.groups()[-1]) if m else 0
        if not version:
            block = data[m.end() : m.end() + size] if m else b""
            word = block.split(b" ", 1)[0]
            if not data.startswith(b"filedesc:") or word not in (b"1", b"2"):
                note(f"no ARC version block: {data[:40]!r}")
                return
            at, version = m.end() + size, int(word)
            continue
        if not m or len(data) - m.end() < size:
            note(f"ARC record at byte {at} declares {size} bytes; {len(data) - m.end()} follow" if m else f"no ARC version {version} header line at byte {at}")
            while (at := data.find(b"\n", at) + 1) and not LINE[version].match(data, at):
                pass
            if not at:
                return
            continue
        f = [x.decode("utf-8", "surrogateescape") for x in m.groups()]
        yield Record(*f[:4], data[m.end() : m.end() + size], version, f[4] if version == 2 else "200")
        at = m.end() + size


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    m = BLANK.search(block)
    return (block[: m.end()], block[m.end() :]) if m else (block, b"")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def to_warc(r: Record, ident: str = "", refers: str = "") -> bytes:
    """WARC/1.1 record without its final four bytes.  ``refers`` names the record
    with the same payload; then only the HTTP header is kept."""
    http, payload = split_http(r.block)
    block = http if refers else r.block
    d = f"{r.date:0<14}"
    when = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    kind = "revisit" if refers else "response" if http else "resource"
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{ident or uuid.uuid5(uuid.NAMESPACE_URL, f'{r.url} {r.date} {digest(r.block)}').urn}>",
        "WARC-Date": when,
        "WARC-Target-URI": r.url,
        "WARC-IP-Address": r.ip,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
    }
    if refers:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{refers}>", "X-Payload-Length": str(len(payload))}
    head |= {"Content-Type": "application/http; msgtype=response" if http else r.mime, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogateescape") for k, v in head.items()) + b"\r\n" + block


def read_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(END, at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if data[end + 4 + size : end + 8 + size] != END:
            raise ValueError(f"WARC record at byte {at} has not the length that it declares")
        yield head, block
        at = end + 8 + size


def convert(spark: SparkSession, path: str) -> DataFrame:
    """ARC files under ``path`` as WARC records: file, record (binary), and a row
    with damage (string) instead of a record for each place that is none."""

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                damage, out, size = [], [], 0
                for r in read_arc(bytes(data), damage):
                    out.append(to_warc(r))
                    size += len(out[-1])
                    if size > ROW:
                        yield pd.DataFrame({"file": name, "record": out, "damage": None})
                        out, size = [], 0
                yield pd.DataFrame({"file": name, "record": out + [None] * len(damage), "damage": [None] * len(out) + damage})

    return frames(spark.read.format("binaryFile").load(path).select("path", "content"), run, "file string, record binary, damage string")


def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of the column ``record``, joined to rows of about ``ROW`` bytes."""
    part, size = [], 0
    for pdf in batches:
        for r in pdf["record"]:
            if part and size + len(r) > ROW:
                yield pd.DataFrame({"record": [END.join(part)]})
                part, size = [], 0
            part.append(r)
            size += len(r)
    if part:
        yield pd.DataFrame({"record": [END.join(part)]})


def write_records(df: DataFrame, path: str, run=iter) -> None:
    """WARC records (without their last four bytes) as archives; ``run`` makes them,
    in a column ``record``, from batches of ``df``."""
    df = frames(df, lambda batches: packed(run(batches)), "record binary")
    df.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", ROWS).text(path)


def url_of(u) -> str:
    return re.sub(r"[\s\x00-\x20]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), u) if u else "urn:x-none"


def archive_pages(spark: SparkSession, pages: DataFrame, path: str, tmp: Scratch) -> None:
    """Pages as ARC records, those converted, and the WARC records written."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row")).withColumn("sha", F.sha1("html"))
    numbered = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))
    many = pages.groupBy("sha").agg(F.max(numbered).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", F.col("first.page_id").alias("first"), F.col("first.row").alias("first_row"))
    many = tmp.park(many, "many")

    def run(batches):
        for version, pdf in enumerate(batches):
            version = 1 + version % 2  # both versions in turn
            group, size = [], 0
            rows = list(zip(*(pdf[c].tolist() for c in ("page_id", "row", "url", "html", "first", "first_row"))))
            for k, (page, row, url, html, first, first_row) in enumerate(rows):
                page = "" if pd.isna(page) else page
                body = html.encode("utf-8", "surrogatepass")
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nX-Page-Id: {page}\r\n\r\n"
                ref = "" if pd.isna(first) or page == first else f"urn:x-page:{first}:{first_row}"
                group.append((Record(url_of(url), "0.0.0.0", "20000101000000", "text/html", http.encode() + body), f"urn:x-page:{page}:{row}", ref))
                size += len(body)
                if size > ROW or k == len(rows) - 1:
                    arc = write_arc([g[0] for g in group], version)
                    yield pd.DataFrame({"record": [to_warc(r, i, ref) for r, (_, i, ref) in zip(read_arc(arc), group)]})
                    group, size = [], 0

    planned = pages.join(checked_small(many), "sha", "left").select("page_id", "row", "url", "html", "first", "first_row")
    write_records(planned, path, run)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of the records under ``path``."""

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                out = []
                for head, block in read_warc(bytes(data)):
                    http, payload = split_http(block)
                    revisit = head["WARC-Type"] == "revisit"
                    want = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and digest(payload) != want or head["WARC-Block-Digest"] != f"sha1:{digest(block)}":
                        raise ValueError(f"digest of {head['WARC-Record-ID']} does not hold")
                    page = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", http)
                    ref = re.search(r"urn:x-page:(-?\d+)", head.get("WARC-Refers-To", ""))
                    out.append((int(page[1]) if page else None, int(head["X-Payload-Length"]) if revisit else len(payload), want, head["WARC-Type"], int(ref[1]) if ref else None, head["WARC-Target-URI"]))
                    if len(out) == 5000:
                        yield frame(out)
                        out = []
                yield frame(out)

    def frame(rows):
        return table(rows, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"], "page_id", "refers_to")

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return frames(files, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp = Scratch(spark, "warc")
    path = tmp.path("archives")
    archive_pages(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), path, tmp)
    return read_archives(spark, path).drop("url")
