"""Benchmark decontamination by a prefix-filtered set join (operator 7).

A window is WINDOW consecutive words of a benchmark item, or the whole item if
that has fewer. It is contained in a document exactly if all its shingles are,
so with the shingles ordered by rarity a prefix of one is enough: a window can
only begin where its rarest shingle does. The first pass over the documents
counts every shingle of the benchmark in them. The second joins each document
position to the windows whose rarest shingle stands there, applies the length
and positional bounds (the window has to fit between the document's ends), and
verifies the window word by word.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. In
UTF-8 that is a property of single bytes, so texts are cut with byte tables.

Benchmark windows go to the tasks in blocks of at most BLOCK windows; a larger
benchmark costs two more passes over the documents for each further block,
written to the shared folder between them. Documents are never shuffled, so
neither copies nor hot sources gather anywhere.

Null or wordless texts have no words and are not contaminated; null or wordless
items have no windows; a null item_id counts as the empty string; repeated rows
come out as often as they went in; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship, text_or_empty, tidy_batches
from .words import Among, Words, batch_parts, raw_texts

WINDOW = 13
#: Words of a shingle (all words of a shorter window).
SHINGLE = 4
#: Windows that one pass carries to the tasks: about 30 MB there.
BLOCK = 100_000

class Block:
    """Windows of a part of the benchmark, with their shingles."""

    def __init__(self, windows: list[bytes], items: list[str]):
        self.windows, self.items = windows, items
        w = Words(windows)
        self.size = np.diff(w.bounds)
        self.hashes = np.zeros((len(windows), WINDOW), np.uint64)
        self.shingle: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by words: hash, window, offset
        inside = np.arange(WINDOW) < self.size[:, None]
        self.hashes[inside] = w.hash
        for k in sorted({min(SHINGLE, int(n)) for n in self.size}):
            rows = np.flatnonzero(self.size == k if k < SHINGLE else self.size >= k)
            count = self.size[rows] - k + 1
            window = np.repeat(rows, count)
            offset = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
            self.shingle[k] = w.shingles(k)[w.bounds[window] + offset], window, offset
        self.rarest: dict[int, tuple[Among, np.ndarray, np.ndarray, np.ndarray]] = {}

    def shingle_sets(self) -> dict[int, Among]:
        return {k: Among(h) for k, (h, _, _) in self.shingle.items()}

    def order(self, counts: dict[int, int]) -> None:
        """Keep the rarest shingle of each window, the leftmost of equals."""
        for k, (h, window, offset) in self.shingle.items():
            n = np.array([counts.get(int(x), 0) for x in h.view(np.int64)], np.int64)
            first = np.lexsort((offset, n, window))
            first = first[np.unique(window[first], return_index=True)[1]]
            first = first[np.argsort(h[first], kind="stable")]
            among = Among(h[first])
            begins = np.searchsorted(h[first], among.sorted)
            self.rarest[k] = among, np.append(begins, len(first)), window[first], offset[first]
        self.shingle = {}

    def occurrences(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of each occurrence in the texts of `w`."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k, (among, begins, window, offset) in self.rarest.items():
            at, member = among.find(w.shingles(k))
            many = begins[member + 1] - begins[member]
            entry = np.repeat(begins[member], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            which = window[entry]
            start = np.repeat(at, many) - offset[entry]
            text = np.searchsorted(w.bounds, np.repeat(at, many), "right") - 1
            fits = (start >= w.bounds[text]) & (start + self.size[which] <= w.bounds[text + 1])
            start, which = start[fits], which[fits]
            for j in range(WINDOW):  # by hash, then exactly
                here = j < self.size[which]
                same = ~here | (w.hash[np.minimum(start + j, len(w.hash) - 1)] == self.hashes[which, j])
                start, which = start[same], which[same]
            exact = np.fromiter((w.words(s, s + self.size[x]) == self.windows[x] for s, x in zip(start.tolist(), which.tolist(), strict=True)), bool, len(start))
            found.append((start[exact], which[exact]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
            w = Words([text])
            n = len(w.hash)
            for lo in range(0, max(1, n - WINDOW + 1) if n else 0, 10_000):
                windows = [w.words(i, min(n, i + WINDOW)) for i in range(lo, min(lo + 10_000, max(1, n - WINDOW + 1)))]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(windows), pa.string()), pa.array(windows, pa.binary())], ["item", "window"])


def _count_shingles(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = block.value.shingle_sets()
        totals: dict[int, np.ndarray] = {k: np.zeros(len(a.sorted), np.int64) for k, a in sets.items()}
        for batch in batches:
            for part in batch_parts(batch, 0):
                w = Words(raw_texts(part.column(0)))
                for k, among in sets.items():
                    at, member = among.find(w.shingles(k))
                    text = np.searchsorted(w.bounds, at, "right") - 1
                    member = member[at + k <= w.bounds[text + 1]]
                    totals[k] += np.bincount(member, minlength=len(among.sorted))
        for k, among in sets.items():
            seen = np.flatnonzero(totals[k])
            yield pa.RecordBatch.from_arrays([pa.array(among.sorted[seen].view(np.int64)), pa.array(totals[k][seen])], ["shingle", "n"])

    return tidy_batches(run)


def _hits(block, names: list[str], later: bool):
    def merged(spans: list[tuple[int, int]]) -> list[int]:
        out: list[int] = []
        for s, e in sorted(spans):
            if out and s <= out[-1]:
                out[-1] = max(out[-1], e)
            else:
                out += [s, e]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        for part in (p for batch in batches for p in batch_parts(batch, batch.schema.get_field_index("__text"))):
            column = dict(zip(part.schema.names, part.columns, strict=True))
            w = Words(raw_texts(column["__text"]))
            n_words = np.diff(w.bounds).tolist()
            start, which = b.occurrences(w)
            text = np.searchsorted(w.bounds, start, "right") - 1
            of: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
            for t, s, x in zip(text.tolist(), (start - w.bounds[text]).tolist(), which.tolist(), strict=True):
                of[t].append((s, s + int(b.size[x]), b.items[x]))
            spans = [merged([x[:2] for x in of.get(t, ())]) for t in range(part.num_rows)]
            items = [sorted({x[2] for x in of.get(t, ())}) for t in range(part.num_rows)]
            if later:
                was_spans, was_items = column["__spans"].to_pylist(), column["__items"].to_pylist()
                spans = [merged([*zip(a[::2], a[1::2], strict=True), *zip(c[::2], c[1::2], strict=True)]) for a, c in zip(spans, was_spans, strict=True)]
                items = [sorted({*a, *c}) for a, c in zip(items, was_items, strict=True)]
            hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            arrays = [column[n] for n in names]
            arrays += [pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "__n_words", "__n_hit", "__spans", "__items"])

    return tidy_batches(run)


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """All columns of `docs`, and n_words, n_hit, hit_spans (word offsets from, to, from, to, ...), items (sorted ids as strings), which replace columns of the same names."""
    spark = docs.sparkSession
    ship(spark)
    windows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_or_empty().alias("text"))
    windows = materialise(windows.mapInArrow(_item_windows, "item string, window binary").distinct(), "windows")
    blocks = max(1, -(-windows.count() // block))
    # Input columns are renamed by position, so that none can clash with the new ones.
    names = [f"__c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)
    df = docs.toDF(*names).withColumn("__text", text_or_empty(names[at]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    new = "__n_words bigint, __n_hit bigint, __spans array<int>, __items array<string>"
    for k in range(blocks):
        # Bounded: about `block` rows of at most WINDOW words.
        rows = windows.filter(F.pmod(F.xxhash64("item", "window"), F.lit(blocks)) == k).collect()
        part = Block([bytes(r.window) for r in rows], [r.item for r in rows])
        shared = spark.sparkContext.broadcast(part)
        counts = df.select("__text").mapInArrow(_count_shingles(shared), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
        part.order({r.shingle: r.n for r in counts.collect()})
        shared = spark.sparkContext.broadcast(part)
        if k:
            df = materialise(df, "hits")
        df = df.mapInArrow(_hits(shared, [*names, "__text"], k > 0), f"{fields}, {new}")
    own = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in ("n_words", "n_hit", "hit_spans", "items")]
    return df.select(*own, F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.col("__spans").alias("hit_spans"), F.col("__items").alias("items"))


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least a twentieth of the words are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that aren't contaminated, with their own columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = hits(docs.toDF(*names), benchmark, text=names[docs.columns.index("text")])
    return found.filter(~contaminated()).select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
