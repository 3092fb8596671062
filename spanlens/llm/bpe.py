"""Byte-level BPE encoding and decoding (operator 3).

Each match of the pre-tokenising pattern is encoded on its own. Over its byte
positions stands a segment tree whose leaf i holds the rank of the pair that
starts at live position i, with i in the low bits, so that the root is the
leftmost pair of least rank. A merge removes one position and changes at most
three leaves (the merged one, its live neighbour to the left and the removed
one); each change walks up one path of the tree.

Distinct pre-tokens of a batch are encoded together: many trees of one size are
rows of one array and take a merge each in lockstep. Long pre-tokens have a tree
of their own, so their cost is n log n. A task keeps the ids of the pre-tokens
it has met, up to CACHE bytes, and lets them go when it ends.

Null texts count as empty; empty texts have no ids. Rows are independent: there
is no shuffle, repeated rows give repeated results, other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_or_empty, tidy_batches
from .words import batch_parts

#: Bytes of pre-tokens that a task remembers before it starts anew, counted with what Python adds to each.
CACHE, ENTRY = 30_000_000, 200
#: Byte length from which a pre-token gets a tree of its own.
LONG = 512
_NONE = np.int64(1) << 62


class BytePairs:
    """Ranks as tables: bytes of each id, and the id that a pair of ids merges to."""

    def __init__(self, ranks: dict[bytes, int]):
        self.vocab = [b"" for _ in range(max(ranks.values()) + 1)]
        for b, i in ranks.items():
            self.vocab[i] = b
        self.whole = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for b, i in ranks.items():
            for cut in range(1, len(b)):
                left, right = ranks.get(b[:cut]), ranks.get(b[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair merges to nothing."""
        key = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def encode_long(self, piece: bytes) -> list[int]:
        """One piece with its own tree."""
        n, none = len(piece), int(_NONE)
        known: dict[int, int] = {}  # of the pairs met in this piece

        def get(pair: int) -> int:
            if pair not in known:
                known[pair] = int(self.rank(np.int64(pair >> 32), np.int64(pair & 0xFFFFFFFF)))
            return known[pair]

        bits = max(1, (n - 1).bit_length())
        size, mask = 1 << bits, (1 << bits) - 1
        ids = [int(self.byte_id[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def leaf(i: int) -> int:
            if i < 0 or after[i] >= n:
                return none
            rank = get(ids[i] << 32 | ids[after[i]])
            return none if rank < 0 else rank << bits | i

        tree = [none] * (2 * size)
        tree[size : size + n] = [leaf(i) for i in range(n)]
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                least = min(tree[k], tree[k ^ 1])
                k >>= 1
                if tree[k] == least:
                    break
                tree[k] = least

        while (root := tree[1]) != none:
            i = root & mask
            j = after[i]
            ids[i] = root >> bits
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode_together(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Pieces of at most `LONG` bytes and of one tree size, a merge each per step."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        bits = max(1, int(lengths.max() - 1).bit_length())
        size, many = 1 << bits, len(pieces)
        mask = np.int64(size - 1)
        column = np.arange(size, dtype=np.int64)
        live = column < lengths[:, None]
        ids = np.full((many, size + 1), -1, np.int64)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        ids[:, :size][live] = self.byte_id[flat]
        # Position `size` stands for "no neighbour"; what is written there is never read as a pair.
        after = np.where(column + 1 < lengths[:, None], column + 1, size)
        after = np.concatenate([after, np.full((many, 1), size)], 1)
        before = np.concatenate([np.broadcast_to(np.where(column > 0, column - 1, size), (many, size)), np.full((many, 1), size)], 1).copy()
        tree = np.full((many, 2 * size), _NONE, np.int64)
        has = np.nonzero(column + 1 < lengths[:, None])
        ranks = self.rank(ids[has], ids[has[0], has[1] + 1])
        tree[has[0], size + has[1]] = np.where(ranks >= 0, ranks << np.int64(bits) | has[1], _NONE)
        for level in range(bits - 1, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            k = size + at
            tree[rows, k] = value
            for _ in range(bits):
                k = k >> 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

        def leaf(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            right = after[rows, at]
            rank = np.where((at < size) & (right < size), self.rank(ids[rows, at], ids[rows, right]), -1)
            return np.where(rank >= 0, rank << np.int64(bits) | at, _NONE)

        rows = np.nonzero(tree[:, 1] != _NONE)[0]
        while len(rows):
            root = tree[rows, 1]
            i = root & mask
            j = after[rows, i]
            ids[rows, i] = root >> np.int64(bits)
            beyond = after[rows, j]
            after[rows, i] = beyond
            before[rows, beyond] = i
            live[rows, j] = False
            put(rows, j, np.full(len(rows), _NONE))
            put(rows, i, leaf(rows, i))
            left = before[rows, i]
            some = left < size
            put(rows[some], left[some], leaf(rows[some], left[some]))
            rows = rows[tree[rows, 1] != _NONE]
        kept = ids[:, :size][live].astype("<u4")
        return np.split(kept, np.cumsum(live.sum(1))[:-1])

    def encode_pieces(self, pieces: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct pieces as little-endian unsigned 32-bit integers."""
        out: dict[bytes, bytes] = {}
        sizes: dict[int, list[bytes]] = {}
        for p in pieces:
            if p in self.whole:  # by definition a piece that is a token needs no merges
                out[p] = self.whole[p].to_bytes(4, "little")
            elif len(p) > LONG:
                out[p] = np.array(self.encode_long(p), "<u4").tobytes()
            elif p:
                sizes.setdefault((len(p) - 1).bit_length(), []).append(p)
        for bits, group in sizes.items():
            step = max(1, 4_000_000 >> max(1, bits))
            for lo in range(0, len(group), step):
                some = group[lo : lo + step]
                out.update((p, ids.tobytes()) for p, ids in zip(some, self.encode_together(some), strict=True))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Lines of base64 bytes and a rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(2)
def tables(path: str) -> BytePairs:
    """Of a vocabulary file that every machine has; kept by the worker."""
    with open(path, "rb") as f:
        return BytePairs(read_ranks(f))


#: Members of the classes below U+0100, for the standard matcher.
LATIN_1 = {"\\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ÿ", "\\p{N}": "0-9²³¹¼½¾", "\\s": "\\t-\\r \\x85\\xa0"}


def for_latin_1(pattern: str) -> str:
    """The pattern with its Unicode classes spelt out for texts of Latin-1 characters."""
    inside = False

    def member(m: re.Match) -> str:
        nonlocal inside
        token = m[0]
        if token in LATIN_1:
            return LATIN_1[token] if inside else f"[{LATIN_1[token]}]"
        if token == "\\S":
            return f"[^{LATIN_1['\\s']}]"
        inside = token == "[" or inside and token != "]"
        return token

    return re.sub(r"\\p\{\w\}|\\.|.", member, pattern, flags=re.S)


@lru_cache(2)
def splitter(pattern: str):
    """findall of the pattern; texts of Latin-1 characters go to the faster standard matcher."""
    general, quick = regex.compile(pattern).findall, re.compile(for_latin_1(pattern)).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return general(text)
        return quick(text)

    return split


class Encoder:
    """Texts to ids, with the pre-tokens met so far."""

    def __init__(self, path: str, pattern: str):
        self.pairs, self.split, self.known, self.held = tables(path), splitter(pattern), {}, 0

    def forget(self) -> None:
        self.known, self.held = {}, 0

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [self.split(t) for t in texts]
        new = set().union(*words).difference(self.known) if words else set()
        size = sum(map(len, new)) + ENTRY * len(new)
        if self.held + size > CACHE:
            self.forget()
            new = set().union(*words)
            size = sum(map(len, new)) + ENTRY * len(new)
        if new:
            self.held += size
            raw = {w: w.encode() for w in new}
            ids = self.pairs.encode_pieces(raw.values())
            self.known.update((w, ids[b]) for w, b in raw.items())
        get = self.known.__getitem__
        return [b"".join(map(get, w)) for w in words]


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", with_ids: bool = True) -> DataFrame:
    """`keep` columns, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int) for each row."""
    ship(df.sparkSession)
    ids_type = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            for part in batch_parts(batch, batch.num_columns - 1):
                ids = coder.encode(part.column(part.num_columns - 1).to_pylist())
                fields = part.columns[:-1]
                fields.append(pa.array([len(x) // 4 for x in ids], pa.int64()))
                fields.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids]))
                fields.append(pa.array([hashlib.sha256(coder.pairs.decode(x)).hexdigest() for x in ids]))
                if with_ids:
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                    fields.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))).cast(ids_type))
                yield pa.RecordBatch.from_arrays(fields, names)
        coder.forget()

    inner = df.select(*(F.col(f"`{c}`") for c in keep), text_or_empty(text).alias("__text"))
    out = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1])
    names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    return inner.mapInArrow(tidy_batches(run), f"{schema}, {out}" if schema else out)
