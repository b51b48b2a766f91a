"""Token ids in Parquet files that allow selective reads.

Format, one row per document, documents in ascending id order over files and rows:

* ``shard`` int: number of the file's part; ``row`` long: the document's place in it
* ``id``: the document's id; ``n_tokens`` long: ids with the end id
* ``start_in_shard`` long: ids before the document in its shard
* ``tokens`` list<int>: the ids and, last, the end id

``shard``, ``row``, ``n_tokens`` and ``start_in_shard`` are delta-encoded or run-
length-encoded, ``tokens`` dictionary-encoded, all by data pages of version 2
with column and offset indexes.  Row groups and pages have fixed sizes, so a
reader of some documents' tokens, or of metadata only, reads only the pages and
columns it asks for; Spark and Arrow both prune them.

Files are written through Spark's own committer: a task that is lost or runs
twice leaves one file.  Global positions come from the shards' totals.

Nulls: a null text is empty (the end id alone); null ids come first.  Ties of
ids are ordered by text hash.  An empty table makes no shard.
"""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import fan, new_path, small_batches
from .words import U64, hash_spans, spread

ROW_GROUP, PAGE = 16 << 20, 256 << 10
#: bytes of text encoded at a time
PART = 2 << 20
VOCABULARY = "byte_bpe_50k.json"


def _tokenizer(path: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path if "/" in path else public_tokenizers.path(path))


class Encoder:
    """Ids of many texts, each distinct piece encoded once by the tokenizer.

    A byte-level BPE never joins bytes across its pre-tokens.  A single space or
    line feed after a Latin letter, comma or full stop and before a Latin letter
    begins a pre-token, which the space shares with the letters; so does such a
    comma or full stop after a letter.  Texts are cut there, so the tokenizer's
    ids of a text are the ids of its pieces in order.  A piece of Latin letters,
    with a space before them or not, is one pre-token, which the tokenizer's
    model encodes as it is; some ``KNOWN`` of them are remembered.  All others go
    through the whole tokenizer.
    """

    KNOWN = 1 << 20

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.alphabet = np.array([b if b in printable else 256 + sum(x not in printable for x in range(b)) for b in range(256)], "<u2")
        self.ascii = np.zeros(256, bool)
        self.ascii[[*range(65, 91), *range(97, 123)]] = True
        self._forget()

    def _forget(self):
        self.hash, self.first, self.n, self.ids = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _letters(self, buf: np.ndarray) -> np.ndarray:
        """Bytes of ASCII letters and of the letters from U+00C0 to U+00FF."""
        flag = self.ascii[buf]
        if len(buf) > 1:
            pair = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] < 0xC0) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
            flag[:-1] |= pair
            flag[1:] |= pair
        return flag

    def _encode(self, buf, letters, start, end):
        """Numbers of ids and ids of some pieces, and which of them are plain."""
        plain = (letters[end] - letters[start] == end - start - (buf[start] == 0x20)) & (letters[end] > letters[start])
        ids, n = array("I"), np.zeros(len(start), np.int64)
        one, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        spelt = self.alphabet[buf].tobytes().decode("utf-16-le")
        tokenize = self.model.tokenize
        for i, a, b in zip(one.tolist(), start[one].tolist(), end[one].tolist(), strict=True):
            got = [t.id for t in tokenize(spelt[a:b])]
            n[i] = len(got)
            ids.extend(got)
        raw = buf.tobytes()
        for some in range(0, len(rest), 256):
            part = rest[some : some + 256]
            for i, e in zip(part, self.tokenizer.encode_batch([raw[start[i] : end[i]].decode() for i in part], add_special_tokens=False), strict=True):
                ids.extend(e.ids)
                n[i] = len(e.ids)
        order = np.concatenate((one, rest))
        first = np.zeros(len(n), np.int64)
        first[order] = np.cumsum(n[order]) - n[order]
        return first, n, np.frombuffer(ids, np.uint32), plain

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        buf = np.frombuffer(b"".join(texts), np.uint8)
        size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        ends = np.cumsum(size)
        if not len(buf):
            return [np.zeros(0, np.uint32) for _ in texts]
        letter = self._letters(buf)
        stop, feed = (buf == 44) | (buf == 46), buf == 10
        cuts = np.zeros(len(buf) + 1, bool)
        if len(buf) > 2:
            np.logical_and(((buf == 0x20) | feed)[1:-1] & letter[2:], (letter | stop)[:-2], out=cuts[1:-2])
            cuts[1:-2] |= cuts[2:-1] & stop[1:-1] & letter[:-2]
            cuts[2:-1] |= cuts[1:-2] & feed[1:-1]
        cuts = cuts[:-1]
        cuts[(ends - size)[size > 0]] = True
        start = np.flatnonzero(cuts)
        end = np.append(start[1:], len(buf))
        h, one, inverse = np.unique(hash_spans(buf, start, end), return_index=True, return_inverse=True)
        if len(self.hash) > self.KNOWN:
            self._forget()
        at = np.searchsorted(self.hash, h).clip(max=max(0, len(self.hash) - 1))
        new = self.hash[at] != h if len(self.hash) else np.ones(len(h), bool)
        first, n, pool = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), self.ids
        first[~new], n[~new] = self.first[at[~new]], self.n[at[~new]]
        if new.any():
            letters = np.zeros(len(buf) + 1, np.int32)
            np.cumsum(letter, out=letters[1:])
            f, m, ids, plain = self._encode(buf, letters, start[one[new]], end[one[new]])
            first[new], n[new] = f + len(self.ids), m
            pool = np.concatenate((self.ids, ids))
            # plain pieces come first, so what is remembered of the ids is a run
            some = np.flatnonzero(new)[plain]
            to = np.searchsorted(self.hash, h[some])
            self.hash, self.first, self.n = (np.insert(old, to, more[some]) for old, more in ((self.hash, h), (self.first, first), (self.n, n)))
            self.ids = pool[: len(self.ids) + int(m[plain].sum())].copy()
        first, n = first[inverse], n[inverse]
        out = pool[spread(first, n)]
        run = np.append(0, np.cumsum(n))
        begin = run[np.searchsorted(start, ends - size)]
        return np.split(out, begin[1:])


#: one encoder for each vocabulary and Python worker, which outlives tasks
_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = 0) -> None:
    """Encode every text of ``docs`` and write the token files to the folder ``path``."""
    key = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    tie = F.xxhash64("t")
    rows = key.repartitionByRange(fan(docs), F.col("id"), tie).sortWithinPartitions(F.col("id"), tie).select(F.spark_partition_id().alias("shard"), "id", "t")
    kind = rows.schema["id"].dataType.simpleString()

    def encode(batch_iter):
        encoder, row, start = encoder_for(vocabulary), 0, 0
        for batch in batch_iter:
            size = np.nan_to_num(np.asarray(pc.binary_length(batch.column(2).cast(pa.binary())).cast(pa.float64()))) + 1
            run, done = np.cumsum(size), 0
            while done < len(run):
                to = max(done + 1, int(np.searchsorted(run, run[done] + PART, "right")))
                part = batch.column(2).slice(done, to - done).cast(pa.binary()).to_pylist()
                ids = [np.append(x, np.uint32(end_id)).astype(np.int32) for x in encoder(part)]
                n = np.array([len(x) for x in ids], np.int64)
                before = start + np.cumsum(n) - n
                offsets = np.append(0, np.cumsum(n)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(part)), pa.array(np.arange(row, row + len(part)), pa.int64()), batch.column(1).slice(done, len(part)), pa.array(n), pa.array(before, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))],
                    ["shard", "row", "id", "n_tokens", "start_in_shard", "tokens"],
                )
                row, start, done = row + len(part), start + int(n.sum()), to

    tokens = rows.mapInArrow(encode, f"shard int, row long, id {kind}, n_tokens long, start_in_shard long, tokens array<int>")
    writer = tokens.write.option("compression", "zstd").option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "true")
    with small_batches(docs.sparkSession):
        writer.option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE).option("parquet.page.row.count.limit", 1000).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, tokens): start counts the ids of all documents before."""
    files = spark.read.parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    # one row for each shard; the window holds as many rows as there are files
    base = totals.select("shard", (F.sum("total").over(W.orderBy("shard")) - F.col("total")).alias("base"))
    # a row for each file: broadcast, so that no tokens are shuffled
    return files.join(F.broadcast(base), "shard").select("id", (F.col("base") + F.col("start_in_shard")).alias("start"), "n_tokens", "tokens")


def token_digests(table: DataFrame, id_col: str) -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of a table of ``read_tokens``."""
    kind = table.schema["id"].dataType.simpleString()

    def digest(batch_iter):
        for batch in batch_iter:
            lists = batch["tokens"]
            values = np.asarray(lists.values).astype("<u4")
            offsets = np.asarray(lists.offsets)
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["start"], batch["n_tokens"], pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return table.mapInArrow(digest, f"id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def through_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Write the token files of ``docs`` into the shared folder, read them back and digest them."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, id_col, text_col, vocabulary)
    return token_digests(read_tokens(docs.sparkSession, path), id_col)
