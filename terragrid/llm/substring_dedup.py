"""Substring dedup: windows of k words that occur more than once are removed.

A count-min sketch of all windows comes first; a second pass groups exactly, by
128 bits of hash, only those windows whose estimated count is two or more.  A
window is repeated if its word sequence starts at any other place of any text.

The documents are chunks of some megabytes from end to end: a chunk sends each
different window it has once, by hash to a bucket, and gets back which are
repeated.  Texts go with their chunk, never by content, so that copies stay as
spread as they came.  A bucket has a window at most once for each chunk.

Nulls: a null text has no words.  Rows with equal texts each keep their row;
all their windows are repeated.  Texts under k words have no window.  An empty
table gives an empty result.  Columns of the input that are named like one of
the outputs (``n_words n_removed kept_text``) are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import free_name, text_bytes
from .sketch import Sketch, chunked, each_chunk, rows_of, texts_of, with_levels
from .words import U64, Words

#: bytes of text for each bucket of windows, and the fewest buckets
BUCKET, BUCKETS = 32 << 20, 32
OUTPUTS = ("n_words", "n_removed", "kept_text")


def _equal(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of 128-bit values, and whether each, in that order, differs from the one before."""
    order = np.argsort(h, kind="stable")
    a, b = h[order], g[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((g, h))
        a, b = h[order], g[order]
        same = a[1:] == a[:-1]
    return order, np.append(np.ones(min(1, len(h)), bool), ~(same & (b[1:] == b[:-1])))


def repeated_windows(docs: DataFrame, text_col: str = "text", k: int = 35) -> tuple[DataFrame, DataFrame]:
    """Chunks of ``docs`` (chunk, data), and (chunk, found): binary little-endian uint32, the chunk's words at which repeated windows begin."""
    size = text_bytes(docs, text_col)
    sketch, buckets = Sketch(size / 6), max(BUCKETS, -(-size // BUCKET))
    chunks = chunked(docs, text_col, sketch)

    def hashes(rows):
        return Words(texts_of(rows, text_col)).windows(k)[1]

    def candidates(batch_iter):
        for chunk, rows, told in each_chunk(batch_iter):
            w = Words(texts_of(rows, text_col))
            at, h = w.windows(k)
            maybe = sketch.levels(h, told) > 0
            at, h = at[maybe], h[maybe]
            if not len(at):
                continue
            g = w.second(at, k)
            order, first = _equal(h, g)
            at, h, g = at[order].astype(np.uint32), h[order], g[order]
            twice = np.append(~first[1:], False)[first]
            # what the chunk has again is repeated for sure
            known = at[~first]
            at, h, g = at[first], h[first], g[first]
            bucket = (h % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at, h, g, twice, bucket = at[order], h[order], g[order], twice[order], bucket[order]
            cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)).tolist()
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            columns = [pa.array(bucket[cut[:-1]]), pa.array([chunk] * len(spans), pa.int64())]
            columns += [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (h, g, at)]
            columns += [pa.array([np.packbits(twice[a:b]).tobytes() for a, b in spans], pa.binary())]
            columns += [pa.array([known.tobytes() if i == 0 else b"" for i in range(len(spans))], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "h", "g", "at", "twice", "known"])

    def decide(table):
        whole = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
        h, g, at = whole("h", U64), whole("g", U64), whole("at", np.uint32)
        n = np.array([len(x) // 4 for x in table["at"].to_pylist()])
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=c) for t, c in zip(table["twice"].to_pylist(), n.tolist(), strict=True)]) != 0
        order, first = _equal(h, g)
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(h)))
        yes = np.zeros(len(h), bool)
        yes[order] = np.repeat((size > 1) | np.bitwise_or.reduceat(twice[order], start), size)
        ends = np.cumsum(n)
        found = [at[b - c : b][yes[b - c : b]].tobytes() + sure for b, c, sure in zip(ends.tolist(), n.tolist(), table["known"].to_pylist(), strict=True)]
        return pa.table([table["chunk"], pa.array(found, pa.binary())], ["chunk", "found"])

    told = with_levels(chunks, hashes, sketch)
    sent = told.mapInArrow(candidates, "bucket long, chunk long, h binary, g binary, at binary, twice binary, known binary")
    return chunks, sent.groupBy("bucket").applyInArrow(decide, "chunk long, found binary")


def remove_repeats(docs: DataFrame, text_col: str = "text", k: int = 35) -> DataFrame:
    """The rows of ``docs`` with n_words, n_removed (long) and kept_text (kept words joined by one space)."""
    kept = [f for f in docs.schema.fields if f.name not in OUTPUTS]
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    text = text_col if any(f.name == text_col and f.dataType == T.StringType() for f in kept) else free_name(docs, "__text")
    columns = [F.col(f"`{f.name}`") for f in kept]
    docs = docs.select(*columns, *([] if text == text_col else [F.col(f"`{text_col}`").cast("string").alias(text)]))
    chunks, found = repeated_windows(docs, text, k)
    found = found.groupBy("chunk").agg(F.collect_list("found").alias("found"))

    def strip(batch_iter):
        for batch in batch_iter:
            for data, parts in zip(batch["data"], batch["found"].to_pylist(), strict=True):
                rows = rows_of(data.as_py())
                texts = [t.split() for t in texts_of(rows, text)]
                n = np.array([len(t) for t in texts], np.int64)
                first = np.cumsum(n) - n
                edge = np.zeros(int(n.sum()) + 1, np.int64)
                at = np.frombuffer(b"".join(parts or ()), np.uint32).astype(np.int64)
                edge[at] += 1
                np.add.at(edge, at + k, -1)
                keep = np.cumsum(edge[:-1]) == 0
                n_left = np.add.reduceat(np.append(keep, False), first, dtype=np.int64) * (n > 0) if len(n) else n
                out = [b" ".join(t if c == len(t) else [t[i] for i in np.flatnonzero(keep[a : a + len(t)])]).decode() for t, a, c in zip(texts, first.tolist(), n_left.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(rows[f.name] for f in kept), pa.array(n), pa.array(n - n_left), pa.array(out, pa.string())], schema.names)

    return chunks.join(found, "chunk", "left").select("data", "found").mapInArrow(strip, schema)
