"""Words, word hashes and window hashes of many texts at once, as NumPy arrays.

Texts are laid end to end as UTF-8 in one byte array; a table of 256 flags says
which bytes belong to words.  Since no byte of a multi-byte character is below
0x80, classes of ASCII characters can be told from bytes alone.

Hashes are polynomial over bytes (or over word hashes), modulo 2**64, followed
by a mixing step, so that any window's hash is the difference of two running
sums: one pass costs the same for windows of 3 words and of 35.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: bytes hashed in one go; bounds the memory of the running sums (8 bytes each)
SLICE = 1 << 20


def byte_class(chars: bytes, invert: bool = False) -> np.ndarray:
    """256 flags: True for word bytes, the bytes in ``chars`` (or all others)."""
    flags = np.zeros(256, bool)
    flags[list(chars)] = True
    return ~flags if invert else flags


#: words are runs of anything but ASCII white space: [^\x20\x09-\x0D]+
NOT_SPACE = byte_class(b" \t\n\x0b\x0c\r", invert=True)
#: words are runs of digits, lower-case letters and non-ASCII characters
ALNUM = byte_class(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))

_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
#: tables for a second, independent hash
_BYTE2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE2, _WORD_BASE2 = 0xA24BAED4963EE407, 0x9FB21C651E98DF25


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective finalizer on 64 bits."""
    with np.errstate(over="ignore"):
        h = h + U64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, U64(b))
                steps[0] = 1
                with np.errstate(over="ignore"):
                    setattr(self, name, np.cumprod(steps, dtype=U64))
        return self.up, self.down


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(_WORD_BASE)
_BYTE_POWERS2, _WORD_POWERS2 = _Powers(_BASE2), _Powers(_WORD_BASE2)


class Words:
    """Words of a list of texts.

    ``start`` and ``end``: byte positions in ``buf``; ``doc``: the text's number;
    ``first[i] : first[i + 1]``: the words of text i; ``hash``: 64 bits a word.
    """

    def __init__(self, texts: list[bytes], word_bytes: np.ndarray = NOT_SPACE, lower: bool = False):
        joined = b" ".join(texts) + b" "
        if lower:
            joined = joined.lower()
        self.buf = buf = np.frombuffer(joined, np.uint8)
        size = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 1
        self.offset = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(size, out=self.offset[1:])
        inside = word_bytes[buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.offset)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self._hash = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hash_spans(self.buf, self.start, self.end)
        return self._hash

    def second(self, at: np.ndarray, k: int) -> np.ndarray:
        """Another hash, from other words' hashes, of the windows of k words that begin at ``at``."""
        if not len(at):
            return np.zeros(0, U64)
        h = hash_spans(self.buf, self.start, self.end, _BYTE2, _BYTE_POWERS2)
        up, down = _WORD_POWERS2.get(len(h) + 1)
        run = np.zeros(len(h) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(h * up[: len(h)], out=run[1:])
            return mix((run[at + k] - run[at]) * down[at] + U64(k))

    def windows(self, k: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window of k words inside one text.

        whole: a text of fewer words, but not none, is one window.
        """
        h = window_hashes(self.hash, k)
        at = np.flatnonzero(self.doc[: len(h)] == self.doc[k - 1 :]) if len(h) else np.zeros(0, np.int64)
        h = h[at]
        if whole:
            n = np.diff(self.first)
            short = np.flatnonzero((n > 0) & (n < k))
            if len(short):
                extra = np.array([window_hashes(self.hash[self.first[i] : self.first[i + 1]], int(n[i]))[0] for i in short], U64)
                at, h = np.concatenate((at, self.first[short])), np.concatenate((h, extra))
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
        return at, h


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _BYTE, powers: _Powers = _BYTE_POWERS) -> np.ndarray:
    """A hash of each byte span; spans are in order and don't overlap."""
    out = np.empty(len(start), U64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            base = start[i]
            j = max(i + 1, int(np.searchsorted(end, base + SLICE, "right")))
            part = buf[base : end[j - 1]]
            up, down = powers.get(len(part) + 1)
            run = np.zeros(len(part) + 1, U64)
            np.cumsum(table[part] * up[: len(part)], out=run[1:])
            s, e = start[i:j] - base, end[i:j] - base
            out[i:j] = mix((run[e] - run[s]) * down[s] + (e - s).astype(U64))
            i = j
    return out


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive items of ``h``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = _WORD_POWERS.get(len(h) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(h) + 1, U64)
        np.cumsum(h * up[: len(h)], out=run[1:])
        return mix((run[k:] - run[:n]) * down[:n] + U64(k))


def batches(rows: list, size: int = 4 << 20, length=len):
    """Runs of rows of about ``size`` bytes; a larger row comes alone."""
    part, total = [], 0
    for row in rows:
        part.append(row)
        total += length(row)
        if total >= size:
            yield part
            part, total = [], 0
    if part:
        yield part


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (n[0] numbers), first[1], ... as one array."""
    if not len(n):
        return np.zeros(0, np.int64)
    ends = np.cumsum(n)
    return np.arange(ends[-1]) + np.repeat(first - (ends - n), n)
