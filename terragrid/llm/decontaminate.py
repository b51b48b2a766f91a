"""Benchmark decontamination with suffix arrays of the training texts.

Each task sorts the suffixes of its documents, shard after shard, by words
(prefix doubling, no deeper than the longest benchmark item), then binary-
searches every suffix of every benchmark item in the shard: one search per item
word and depth, all suffixes at once, until no training suffix shares more
words.  That gives the longest verbatim match of each test suffix in the shard
and the run of the suffix array, hence the places, where it stands.  Equal runs
are taken once, and places are marked run by run: the work grows with the words
of the shard, whatever the number of equal item windows.

A window is ``k`` consecutive words of an item; an item of fewer words, but not
none, is one window.  Words are lower-cased (A-Z) runs of digits, ASCII letters
and non-ASCII characters; they are compared by 64-bit hashes.

The benchmark is searched in blocks of ``BLOCK`` bytes of text, all of them in
one pass over each shard's suffix array.  A task holds the whole benchmark as 16
bytes a word: the broadcast grows with the benchmark, not with the documents.

Nulls: a null text has no words, on either side; a null item id counts as the
empty string.  Rows with equal texts get equal results.  Empty tables: an empty
benchmark hits nothing; no documents give no rows.  Columns of the input that
are named like an output (``n_words n_hit items spans longest``) are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import free_name
from .words import ALNUM, Words, batches, spread

#: bytes of benchmark text searched at a time
BLOCK = 16 << 20
#: bytes of training text in a shard's suffix array
SHARD = 4 << 20
OUTPUTS = ("n_words", "n_hit", "items", "spans", "longest")


def suffix_array(rank: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``rank`` (0 ends a text) by their first ``depth`` items at least.

    Prefix doubling; only suffixes still tied are sorted again.
    """
    n = len(rank)
    sa = np.argsort(rank, kind="stable")
    r = rank.astype(np.int64)
    r = np.append(r, np.zeros(2 * depth + 2, np.int64))
    first = np.append(True, np.diff(rank[sa]) != 0) if n else np.zeros(0, bool)
    group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    if n:
        r[sa] = group + 1
        r[:n][rank == 0] = 0
    step = 1
    while step < depth and n:
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, n))
        tied = np.repeat((size > 1) & (r[sa[start]] != 0), size)
        at = np.flatnonzero(tied)
        if not len(at):
            break
        sub = sa[at]
        key = (r[sub] << 32) | r[sub + step]
        order = np.argsort(key, kind="stable")
        sub, key = sub[order], key[order]
        sa[at] = sub
        new = np.append(True, key[1:] != key[:-1])
        first[at] = new
        r[sub] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))] + 1
        step *= 2
    return sa


class Block:
    """Suffixes of some benchmark items, as words' hashes."""

    def __init__(self, ids: list[str], texts: list[bytes], k: int):
        w = Words(texts, ALNUM, lower=True)
        self.ids, self.k, self.hash, self.item = ids, k, w.hash, w.doc.astype(np.int32)
        self.first = w.first
        self.depth = int(np.diff(w.first).max()) if len(w) else 0

    def measures(self):
        """Of each suffix, its words, and those of the window that begins it (0: none does)."""
        pos = np.arange(len(self.hash)) - self.first[self.item]
        left = self.first[self.item + 1] - np.arange(len(self.hash))
        n = left + pos
        return left, np.where(left >= self.k, self.k, np.where((n < self.k) & (pos == 0), n, 0))


def search(block: Block, rank: np.ndarray, values: np.ndarray, sa: np.ndarray):
    """Longest match of each suffix; (suffix, first, end) in ``sa`` of the windows found; the same of the longest matches of these.

    rank: of the training words, 0 between texts; values: the hash of rank i + 1.
    """
    left, need = block.measures()
    q = np.searchsorted(values, block.hash)
    known = (q < len(values)) & (values[np.minimum(q, max(0, len(values) - 1))] == block.hash) if len(values) else np.zeros(len(q), bool)
    q = np.where(known, q + 1, -1)
    n, m = len(sa), len(q)
    q = np.append(q, np.full(block.depth + 1, -1))
    padded = np.append(rank, np.zeros(block.depth + 2, rank.dtype))
    lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
    live, longest = np.arange(m), np.zeros(m, np.int64)
    found = [np.zeros((3, 0), np.int64)]
    for d in range(block.depth):
        live = live[(left[live] > d) & (q[live + d] >= 0)]
        if not len(live):
            break
        want, a, b = q[live + d], lo[live].copy(), hi[live].copy()
        ends = []
        for right in (False, True):
            x, y = a.copy(), b.copy()
            while True:
                open_ = np.flatnonzero(x < y)
                if not len(open_):
                    break
                mid = (x[open_] + y[open_]) >> 1
                have = padded[sa[mid] + d]
                go = have <= want[open_] if right else have < want[open_]
                x[open_[go]] = mid[go] + 1
                y[open_[~go]] = mid[~go]
            ends.append(x)
        ok = ends[0] < ends[1]
        live = live[ok]
        lo[live], hi[live] = ends[0][ok], ends[1][ok]
        longest[live] = d + 1
        hit = live[need[live] == d + 1]
        found.append(np.stack((hit, lo[hit], hi[hit])))
    windows = np.concatenate(found, axis=1)
    return longest, windows, np.stack((windows[0], lo[windows[0]], hi[windows[0]]))


def matches_in(texts: list[bytes], blocks: list[Block]):
    """Of each text: its words, the hit spans (first word, words), the ids of items with windows in it, and the words of the longest match."""
    w = Words(texts, ALNUM, lower=True)
    n = np.diff(w.first)
    spans: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    top = np.zeros(len(texts), np.int64)
    depth = max((b.depth for b in blocks), default=0)
    if len(w) and depth:
        values, inverse = np.unique(w.hash, return_inverse=True)
        rank = np.zeros(len(w) + len(texts), np.int64)
        rank[np.arange(len(w)) + w.doc] = inverse + 1
        sa = suffix_array(rank, depth)
        base = w.first[:-1] + np.arange(len(texts))
        text_at = np.searchsorted(base, sa, "right") - 1
        edge = np.zeros(len(rank) + 1, np.int64)
        for block in blocks:
            longest, windows, ends = search(block, rank, values, sa)
            if not windows.shape[1]:
                continue
            _, need = block.measures()
            # equal windows have one run of the suffix array
            runs, which = np.unique(np.stack((windows[1], windows[2], need[windows[0]])), axis=1, return_inverse=True)
            size = runs[1] - runs[0]
            places = sa[spread(runs[0], size)]
            edge += np.bincount(places, minlength=len(edge)) - np.bincount(places + np.repeat(runs[2], size), minlength=len(edge))
            # texts of each run, items of each run
            seen = np.unique(np.repeat(np.arange(len(size)), size) * len(texts) + text_at[spread(runs[0], size)])
            of_run = np.unique(which.ravel() * len(block.ids) + block.item[windows[0]])
            cut = np.searchsorted(of_run, np.arange(len(size) + 1) * len(block.ids))
            for x in seen.tolist():
                r, t = divmod(x, len(texts))
                items[t].update(block.ids[i % len(block.ids)] for i in of_run[cut[r] : cut[r + 1]].tolist())
            # runs of longer matches lie inside those of shorter ones: shortest first
            best = np.zeros(len(sa), np.int64)
            deep = np.unique(np.stack((longest[ends[0]], ends[1], ends[2])), axis=1)
            for d, a, b in deep.T.tolist():
                best[a:b] = d
            np.maximum.at(top, text_at[best > 0], best[best > 0])
        inside = np.append(np.cumsum(edge[:-1]) > 0, False)
        first = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
        last = np.flatnonzero(~inside & np.append(False, inside[:-1]))
        of = np.searchsorted(base, first, "right") - 1
        for t, a, b in zip(of.tolist(), (first - base[of]).tolist(), (last - base[of]).tolist(), strict=True):
            spans[t].append((a, b - a))
    return n, spans, items, top


def find_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", k: int = 10) -> DataFrame:
    """The rows of ``docs`` with n_words, n_hit (long), items (sorted ids with windows in the text), spans (hit words:
    first, number) and longest (words of the longest verbatim match that begins with a window, long)."""
    spark = docs.sparkSession
    text = free_name(docs, "__text")
    kept = [f for f in docs.schema.fields if f.name not in OUTPUTS]
    rows = docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text_col}`").cast("string").alias(text))
    blocks, ids, texts, size = [], [], [], 0
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    for i, t in items.toLocalIterator():
        ids.append(i)
        texts.append(t.encode())
        size += len(texts[-1])
        if size >= BLOCK:
            blocks.append(Block(ids, texts, k))
            ids, texts, size = [], [], 0
    if texts:
        blocks.append(Block(ids, texts, k))
    held = spark.sparkContext.broadcast(blocks)
    span = pa.list_(pa.struct([("doc_pos", pa.int32()), ("length", pa.int32())]))

    def run(batch_iter):
        for batch in batch_iter:
            texts = [t or b"" for t in batch[text].cast(pa.binary()).to_pylist()]
            done = 0
            for part in batches(texts, SHARD):
                n, spans, found, top = matches_in(part, held.value)
                columns = [batch[f.name].slice(done, len(part)) for f in kept]
                columns += [pa.array(n, pa.int64()), pa.array([sum(m for _, m in s) for s in spans], pa.int64()), pa.array([sorted(x, key=str.encode) for x in found], pa.list_(pa.string()))]
                columns += [pa.array([[{"doc_pos": a, "length": m} for a, m in s] for s in spans], span), pa.array(top, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)
                done += len(part)

    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("doc_pos", T.IntegerType()), T.StructField("length", T.IntegerType())]))), T.StructField("longest", T.LongType())])
    return rows.mapInArrow(run, schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", k: int = 10) -> DataFrame:
    """The rows of ``docs`` that no benchmark window occurs in, with the columns of ``docs``."""
    marked = find_matches(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").alias("t")), benchmark, "t", k)
    return marked.where(F.col("n_hit") == 0).select("row.*")
