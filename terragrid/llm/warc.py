"""WARC archives of pages with a two-level capture index.

Writing: one gzip member per record, one file per task in the shared folder.
Of pages with equal payloads of at least ``min_bytes``, the one with the largest
id is a response record; the others are revisit records that refer to it and
keep only the HTTP head, with the full payload's length and digest.

Index, first level: lines "key time id file offset length", key being the URL
with its host reversed, sorted over all shards, in gzip blocks of ``BLOCK`` lines.
Second level: a sparse directory with each block's first key, file, offset and
length.  A lookup binary-searches the directory, range-reads one block, binary-
searches its lines and range-reads the records.

File names are unique to the attempt that wrote them and only names that a
finished task has returned are ever read, so lost or repeated tasks do no harm.

Nulls: null html is an empty payload; a null URL has an empty key; a null id is
never the largest.  Rows with equal ids and payloads are all responses if their
id is the largest.  Empty tables make empty archives.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import fan, new_path, settle

BLOCK = 512
#: payloads with more than this part of all copies are few
SPLIT = 4096
DATE = "2020-01-01T00:00:00Z"
_URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?(.*)$", re.S)


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, lower case: com,example,www)/path."""
    if not url:
        return ""
    m = _URL.match(url.strip())
    if not m:
        return re.sub(r"\s", "%20", url.strip().lower())
    host = ",".join(reversed(m[1].lower().removeprefix("www.").split(".")))
    return re.sub(r"\s", "%20", f"{host}{m[2] or ''}){m[3].partition('#')[0] or '/'}".lower())


def _open(root: str):
    return pyarrow.fs.FileSystem.from_uri(root)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    """A gzip member with a response or revisit record."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    text = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(text + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> dict:
    """Fields of a record; a response's length and digest come from its payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda name: int(x) if (x := fields.get(name, "<urn:page:>")[10:-1]) else None
    out = {"page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI", ""), "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To"), "payload": None}
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if out["record_type"] == "response":
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload digest of record {out['page_id']} is wrong")
        return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest}
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return out | {"payload_bytes": length, "payload_digest": digest}


def write_archives(pages: DataFrame, root: str, min_bytes: int = 1000) -> DataFrame:
    """Write WARC files below ``root``; (key, page_id, file, offset, length), a row per record."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    copies = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("c")).where("c > 1")
    copies = settle(copies, "copies")
    # payloads with more than a SPLIT-th of all copies are at most SPLIT: their pages stay where they are;
    # other pages meet theirs by the size of the table, and are spread by their own digests if it is large
    many = F.col("c") > (copies.agg(F.sum("c")).first()[0] or 0) / SPLIT
    hot = copies.where(many).select("digest", F.col("last").alias("hot"))
    cold = copies.where(~many).select(F.col("digest").alias("key"), F.col("last").alias("cold"))
    rows = rows.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), "digest", "left")
    key = F.when(F.col("is_hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("key", key).join(cold, "key", "left").withColumn("last", F.coalesce("hot", "cold")).drop("key", "hot", "cold", "is_hot")
    rows = rows.withColumn("revisit", F.col("last").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("last"), F.lit(False)))

    def write(batch_iter):
        fs, base = _open(root)
        name, out, at = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batch_iter:
            rows = []
            for r in batch.to_pylist():
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data = record(r["page_id"], r["url"], r["payload"], r["digest"], r["last"], r["revisit"])
                out.write(data)
                rows.append((url_key(r["url"]), r["page_id"], name, at, len(data)))
                at += len(data)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], ["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return settle(rows.mapInArrow(write, "key string, page_id long, file string, offset long, length long"), "captures")


def write_index(captures: DataFrame, root: str, block: int = BLOCK) -> DataFrame:
    """Write sorted, compressed index blocks below ``root``; the directory, a row per block."""
    rows = captures.repartitionByRange(fan(captures), "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")

    def write(batch_iter):
        fs, base = _open(root)
        name, out, at, held, rows = f"index-{uuid.uuid4().hex}.gz", None, 0, [], []

        def flush():
            nonlocal out, at
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            data = gzip.compress("".join(line for _, line in held).encode(), 6, mtime=0)
            out.write(data)
            rows.append((held[0][0], held[-1][0], name, at, len(data), len(held)))
            at += len(data)
            held.clear()

        for batch in batch_iter:
            for r in batch.to_pylist():
                page = "" if r["page_id"] is None else r["page_id"]
                held.append((r["key"], f"{r['key']} {DATE} {page} {r['file']} {r['offset']} {r['length']}\n"))
                if len(held) >= block:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], ["first", "last", "file", "offset", "length", "lines"])

    return settle(rows.mapInArrow(write, "first string, last string, file string, offset long, length long, lines long"), "directory")


class Reader:
    """Range reads of index blocks and records below a folder."""

    def __init__(self, root: str, most_open: int = 64):
        self.fs, self.base = _open(root)
        self.files, self.most = {}, most_open

    def range(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.files:
            if len(self.files) >= self.most:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.fs.open_input_file(f"{self.base}/{name}")
        return self.files[name].read_at(length, offset)

    def lines(self, block: dict) -> list[list[str]]:
        """[key, date, page id, file, offset, length] of each line of a block."""
        text = gzip.decompress(self.range(block["file"], block["offset"], block["length"])).decode()
        return [line.split(" ") for line in text.split("\n")[:-1]]

    def record(self, line: list[str]) -> dict:
        return parse(self.range(line[3], int(line[4]), int(line[5])))

    def lookup(self, directory: list[dict], url: str) -> list[dict]:
        """All records of a URL; ``directory``: blocks in order of their first keys."""
        key = url_key(url)
        at = max(0, bisect.bisect_left(directory, key, key=lambda b: b["first"]) - 1)
        found = []
        for block in directory[at:]:
            if block["first"] > key:
                break
            lines = self.lines(block)
            i = bisect.bisect_left(lines, key, key=lambda x: x[0])
            while i < len(lines) and lines[i][0] == key:
                found.append(self.record(lines[i]))
                i += 1
        return found


def read_archives(directory: DataFrame, root: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, through the index."""

    def read(batch_iter):
        reader = Reader(root)
        for batch in batch_iter:
            for block in batch.to_pylist():
                found = [reader.record(line) for line in sorted(reader.lines(block), key=lambda x: (x[3], int(x[4])))]
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")} for r in found], pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return directory.repartition(fan(directory)).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def through_archives(pages: DataFrame) -> DataFrame:
    root = new_path(pages.sparkSession, "warc")
    return read_archives(write_index(write_archives(pages, root), root), root)
