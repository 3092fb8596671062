"""Words of texts as arrays: cut with byte tables, hashed with 64 bits.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z, which in UTF-8 is a property of single bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes and texts cut at once: a worker's arrays take some 60 times the bytes. A longer text is a chunk of its own, hashed in segments of SEGMENT bytes.
CHUNK, ROWS, SEGMENT = 1_000_000, 512, 1 << 20

BYTE = np.zeros(256, np.uint8)
BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
BYTE[0x41:0x5B] = BYTE[0x61:0x7B]
_rng = np.random.default_rng(20240607)
_VALUE = _rng.integers(1, 2**64, 256, np.uint64)
_VALUE[0] = 0
_BASE, _STEP = (np.uint64(int(x) | 1) for x in _rng.integers(1, 2**63, 2, np.uint64))
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


_POWER, _INVERSE = _powers(_BASE, SEGMENT), _powers(_BASE_INVERSE, SEGMENT)


class Words:
    """The words of some texts: hash, first byte and one past the last byte of each; text k has words bounds[k] to bounds[k+1]."""

    def __init__(self, texts: list[bytes]):
        joined = b" ".join(texts) + b" "
        self.low = BYTE[np.frombuffer(joined, np.uint8)]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        ends_of_texts = np.cumsum(sizes)
        is_word = self.low != 0
        edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
        if is_word[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.bounds = np.concatenate([[0], np.searchsorted(self.start, ends_of_texts)])
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """A word's hash is the sum of its bytes' values times powers of the base, counted from its start; modulo 2^64, so segments of the text add up."""
        sums = np.zeros(len(self.start), np.uint64)
        back = np.ones(len(self.start), np.uint64)
        for lo in range(0, len(self.low), SEGMENT):
            part = self.low[lo : lo + SEGMENT]
            a, b = np.searchsorted(self.end, lo, "right"), np.searchsorted(self.start, lo + len(part))
            if a == b:
                continue
            segment = lo // SEGMENT
            shift, unshift = (np.uint64(pow(int(x), lo, 2**64)) for x in (_BASE, _BASE_INVERSE))
            first = np.maximum(self.start[a:b] - lo, 0)
            # Between words all values are 0.
            sums[a:b] += np.add.reduceat(_VALUE[part] * _POWER[: len(part)], first) * shift
            own = np.flatnonzero(self.start[a:b] >= segment * SEGMENT) + a
            back[own] = _INVERSE[self.start[own] - lo] * unshift
        return mix(sums * back + (self.end - self.start).astype(np.uint64))

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; those that leave their text are to be masked by the caller."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * _STEP + self.hash[j : j + n]
        return mix(out + np.uint64(k))

    def word(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()

    def words(self, lo: int, hi: int) -> bytes:
        return b" ".join(self.word(i) for i in range(lo, hi))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Among:
    """Membership in a set of hashes: a bitmap first, then a search."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.bits = np.uint64(64 - max(16, int(len(self.sorted) * 16).bit_length()))
        self.bitmap = np.zeros(1 << int(64 - self.bits), bool)
        self.bitmap[(self.sorted >> self.bits).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `hashes` of members, and the members' places in `sorted`."""
        if not len(self.sorted) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        some = np.flatnonzero(self.bitmap[(hashes >> self.bits).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.sorted, hashes[some]), len(self.sorted) - 1)
        same = self.sorted[at] == hashes[some]
        return some[same], at[same]


def raw_texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def batch_parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about CHUNK bytes of its text column and at most ROWS rows, so that no more of it is ever unpacked at once."""
    for s in _slices(pc.binary_length(batch.column(text)).to_pylist()):
        yield batch.slice(s.start, s.stop - s.start)


def _slices(sizes: Iterable[int]) -> Iterator[slice]:
    lo = held = i = 0
    for i, n in enumerate(sizes, 1):
        held += n + 1
        if held >= CHUNK or i - lo >= ROWS:
            yield slice(lo, i)
            lo, held = i, 0
    if lo < i:
        yield slice(lo, i)
