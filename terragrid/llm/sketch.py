"""Count-min sketches of hashes that stay spread over the cluster, however large the corpus.

A sketch has ``rows`` rows of at least four times as many cells as there are
hashes, so hashes that occur once are seldom taken for repeated ones, at any size.  Nobody
holds it whole: it is cut into blocks of cells.  The documents are written as
chunks of some megabytes.  A chunk sends to each block the cells that its hashes
fall into, sorted, as gaps in a Rice code, with counts; the block adds up what all chunks sent
and answers each chunk with a level for each of its cells, a bit for each
threshold.  The answers join the chunk, which makes its hashes again and takes,
for each, the least level of its rows.  Estimates are never too low: nothing that
occurs twice is estimated to occur once.

A chunk and a block exchange at most one message.  The number of blocks is fixed
up to ``2**MAX_BLOCK`` cells in one; beyond that chunks grow with the corpus, so
that messages grow with the hashes, not with their square.  A hash that occurs
everywhere is one cell of each chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import settle
from .words import U64, mix

#: bytes of text in a chunk
CHUNK, MAX_CHUNK = 4 << 20, 64 << 20
#: log2 of the blocks of a row, and of the cells of a block
BLOCKS, MIN_BLOCK, MAX_BLOCK = 9, 20, 27
ROWS = 2
#: counts are kept up to here
MOST = 255


class Sketch:
    """The measures of a sketch of so many hashes."""

    def __init__(self, items: float, thresholds: tuple[int, ...] = (2,), rows: int = ROWS):
        self.items, self.thresholds, self.rows = items, thresholds, rows
        #: log2 of a row's cells: the power of two at or above four times the number of hashes
        self.bits = int(max(MIN_BLOCK, np.ceil(np.log2(max(2.0, 4 * items)))))
        #: cells of a block
        self.size = 1 << min(max(self.bits - BLOCKS, MIN_BLOCK), MAX_BLOCK)
        #: bytes of text in a chunk
        self.chunk = int(min(MAX_CHUNK, max(CHUNK, CHUNK * 2.0 ** (self.bits - MAX_BLOCK - BLOCKS))))

    def cells(self, hashes: np.ndarray, row: int) -> np.ndarray:
        return (mix(hashes, row + 1) >> U64(64 - self.bits)).astype(np.int64)

    def levels(self, hashes: np.ndarray, told: list | None) -> np.ndarray:
        """Of each of a chunk's hashes, how many thresholds its estimated count reaches."""
        n = len(self.thresholds)
        out = np.full(len(hashes), n, np.int8)
        answer = {m["block"]: np.frombuffer(m["levels"], np.uint8) for m in told or ()}
        for r in range(self.rows):
            cells, where = np.unique(self.cells(hashes, r), return_inverse=True)
            block, level = cells // self.size, np.zeros(len(cells), np.int8)
            cut = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(cells))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                planes = answer[int(block[a]) + (r << 48)].reshape(n, -1)
                level[a:b] = np.unpackbits(planes, axis=1, count=b - a).sum(axis=0)
            out = np.minimum(out, level[where])
        return out


def pack(values: np.ndarray, low: int) -> bytes:
    """Numbers as ``low`` bits each, end to end, and what is above in unary (Rice code)."""
    high = values >> low
    bits = np.zeros(len(values) * (low + 1) + int(high.sum()), np.uint8)
    for k in range(low):
        bits[k : len(values) * low : low] = (values >> k) & 1
    bits[len(values) * low + np.cumsum(high + 1) - 1] = 1
    return np.packbits(bits).tobytes()


def unpack(data: bytes, low: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    high = np.diff(np.flatnonzero(bits[n * low :])[:n], prepend=-1) - 1
    values = high.astype(np.int64) << low
    for k in range(low):
        values |= bits[k : n * low : low].astype(np.int64) << k
    return values


def chunked(docs: DataFrame, text_col: str, sketch: Sketch) -> DataFrame:
    """(chunk, data): the rows of ``docs`` in chunks of some megabytes of text, as Arrow streams; written once."""
    size = sketch.chunk

    def cut(batch_iter):
        held, total, n, part = [], 0, 0, TaskContext.get().partitionId() << 32

        def send():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in held:
                    out.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([part + n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "data"])

        for batch in batch_iter:
            bytes_ = np.nan_to_num(np.asarray(pc.binary_length(batch[text_col].cast(pa.binary())).cast(pa.float64()))) + 8
            run, done = np.cumsum(bytes_), 0
            while done < len(run):
                before = run[done - 1] if done else 0
                to = max(done + 1, int(np.searchsorted(run, before + size - total, "right")))
                held.append(batch.slice(done, to - done))
                total += run[to - 1] - before
                done = to
                if total >= size or done < len(run):
                    yield send()
                    held, total, n = [], 0, n + 1
        if held:
            yield send()

    # partitions under a chunk are put together
    least = max(1, int(np.ceil(sketch.items * 6 / size)))
    return settle(docs.coalesce(least).mapInArrow(cut, "chunk long, data binary"), "chunks", 4 * size)


def rows_of(data: bytes) -> pa.RecordBatch:
    """The rows of a chunk."""
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def texts_of(rows: pa.RecordBatch, column: str) -> list[bytes]:
    return [t or b"" for t in rows[column].cast(pa.binary()).to_pylist()]


def with_levels(chunks: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], sketch: Sketch) -> DataFrame:
    """``chunks`` with ``told``, from which ``Sketch.levels`` takes how many thresholds the count of each of a chunk's hashes reaches."""
    size, thresholds = sketch.size, sketch.thresholds

    def send(batch_iter):
        for batch in batch_iter:
            for chunk, data in zip(batch["chunk"].to_pylist(), batch["data"].to_pylist(), strict=True):
                h = hashes(rows_of(data))
                for r in range(sketch.rows):
                    cells, n = np.unique(sketch.cells(h, r), return_counts=True)
                    block = cells // size
                    cut = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(cells))
                    if len(cut) < 2:
                        continue
                    gap = np.diff(cells, prepend=0)
                    gap[cut[:-1]] = cells[cut[:-1]] % size
                    many = n > 1
                    values = gap * 2 + many
                    more, run = n[many].clip(max=MOST).astype(np.uint8), np.append(0, np.cumsum(many))
                    low = max(1, int(np.log2(sketch.size * len(cut) / len(cells))))
                    message = [pack(values[a:b], low) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    counts = [more[run[a] : run[b]].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    to = (block[cut[:-1]] + (r << 48)).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array([chunk] * len(to), pa.int64()), pa.array([low] * len(to), pa.int32()), pa.array(np.diff(cut), pa.int32()), pa.array(message, pa.binary()), pa.array(counts, pa.binary())], ["block", "chunk", "low", "n", "cells", "counts"])

    def merge(table):
        total, parts = np.zeros(size, np.uint16), []
        for low, n, data, counts in zip(*(table[c].to_pylist() for c in ("low", "n", "cells", "counts")), strict=True):
            values = unpack(data, low, n)
            cells, n = np.cumsum(values >> 1), np.ones(len(values), np.uint16)
            n[values & 1 != 0] = np.frombuffer(counts, np.uint8)
            total[cells] = np.minimum(total[cells] + n, MOST)
            parts.append(cells.astype(np.uint32))
        answer = [b"".join(np.packbits(total[c] >= t).tobytes() for t in thresholds) for c in parts]
        return pa.table([table["chunk"], table["block"], pa.array(answer, pa.binary())], ["chunk", "block", "levels"])

    sent = chunks.mapInArrow(send, "block long, chunk long, low int, n int, cells binary, counts binary")
    answers = sent.groupBy("block").applyInArrow(merge, "chunk long, block long, levels binary")
    told = answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("block", "levels"))).alias("told"))
    return chunks.join(told, "chunk", "left")


def each_chunk(batch_iter: Iterator[pa.RecordBatch]):
    """(chunk, rows, told) of each row of ``with_levels``."""
    for batch in batch_iter:
        for i in range(len(batch)):
            yield batch["chunk"][i].as_py(), rows_of(batch["data"][i].as_py()), batch["told"][i].as_py()
