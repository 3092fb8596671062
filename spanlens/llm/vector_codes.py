"""Vector codes by product quantisation in whole numbers (operator 12).

A component x becomes floor(4096 x); a vector is cut into `parts` consecutive
parts, each coded by the nearest entry of that position's codebook. The kept
vectors are written once to the shared folder as part blocks: at most BLOCK rows
as one number array, a component after another, in the narrowest type that holds
them. A round is one treeAggregate of the RDD of these blocks. Within a block,
distances to all entries accumulate dimension by dimension, np.add.at puts
each part onto the sums and counts of its nearest entry, and these int64 tensors
(parts x entries x width, whatever the number of rows) merge through a tree of
reductions. The driver only divides them. All arithmetic is exact, so neither
the split into blocks nor a task that runs again changes a code. The last
pass codes each block, and errors are summed by label before they meet the rows.

Codebooks begin as the parts of the vectors of the `entries` smallest ids; the
rows of one id are ordered by their numbers, and null ids come last. Where there
are fewer vectors, codebooks are that much smaller. Null vectors, and those with
a null or non-finite component, are dropped. All others must have as many
components as most of the first vectors by id; vectors of another length are
dropped too, since no codebook fits them. Where `parts` doesn't divide that
number, the first parts are one component wider. Where a block or a codebook
holds numbers beyond WIDE, the arithmetic goes on in Python's integers and stays
exact; an error beyond a long comes back as the largest long. Repeated rows
are coded as often as they come; an empty table gives no rows. Columns other than
the id, the vector and the label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship, tidy_batches

SCALE = 4096
#: Rows of a block.
BLOCK = 4096
#: Up to here squares of differences of 1,000 components, and sums of 2^36 of them, fit in 64 bits.
WIDE = 1 << 25
LARGEST = (1 << 63) - 1

BLOCK_SCHEMA = "ids array<bigint>, labels array<bigint>, kind string, width int, numbers binary"


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE x), in the narrowest type that holds it."""
    x = np.floor(x.astype(np.float64) * SCALE)
    if not x.size or np.abs(x).max() < 2**62:
        x = x.astype(np.int64)
        for kind in (np.int16, np.int32):
            if not x.size or (np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max):
                return x.astype(kind)
        return x
    return np.frompyfunc(int, 1, 1)(x)


def _pack(numbers: np.ndarray) -> tuple[str, bytes]:
    if numbers.dtype == object:
        return "text", ",".join(map(str, numbers.ravel())).encode()
    return numbers.dtype.name, numbers.tobytes()


def _unpack(kind: str, width: int, raw: bytes) -> np.ndarray:
    """Components x rows."""
    flat = np.array([int(x) for x in raw.decode().split(",")], object) if kind == "text" else np.frombuffer(raw, kind)
    return flat.reshape(width, -1)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Rows x width of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _to_blocks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("kind", pa.string()), ("width", pa.int32()), ("numbers", pa.binary())])
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                kind, raw = _pack(_whole(_vectors(part.column(2), width)).T)
                yield pa.RecordBatch.from_pylist([{"ids": part.column(0).to_pylist(), "labels": part.column(1).to_pylist(), "kind": kind, "width": width, "numbers": raw}], kinds)

    return tidy_batches(run)


class Codebooks:
    """The entries of each part position: entry[p] is entries x width of that part."""

    def __init__(self, first: np.ndarray, parts: int):
        cuts = [len(c) for c in np.array_split(np.arange(first.shape[1]), parts)]
        self.begin = np.concatenate([[0], np.cumsum(cuts)]).tolist()
        self.entry = [first[:, a:b] for a, b in zip(self.begin, self.begin[1:], strict=False)]

    def __len__(self) -> int:
        return len(self.entry[0])

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for e in self.entry for x in e.ravel()).encode()).hexdigest()

    def nearest(self, columns: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Entry and squared distance of each part position for each row; columns: components x rows."""
        widest = max([int(np.abs(columns).max(initial=0)) if columns.dtype != object else max(map(abs, columns.flat), default=0), *(int(np.abs(e).max(initial=0)) for e in self.entry)])
        kind = np.int64 if widest < WIDE else object
        codes, errors = [], []
        for p, entry in enumerate(self.entry):
            far = np.zeros((len(entry), columns.shape[1]), kind)
            for d, at in enumerate(range(self.begin[p], self.begin[p + 1])):
                off = columns[at].astype(kind)[None, :] - entry[:, d].astype(kind)[:, None]
                far += off * off
            code = far.argmin(axis=0).astype(np.int64)  # the first of equals
            codes.append(code)
            errors.append(far[code, np.arange(len(code))])
        return codes, errors

    def totals(self, columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Sums (entries x width by part) and counts (parts x entries) of the parts nearest to each entry."""
        codes, errors = self.nearest(columns)
        counts = np.zeros((len(self.entry), len(self)), np.int64)
        sums = []
        for p, (code, error) in enumerate(zip(codes, errors, strict=True)):
            part = columns[self.begin[p] : self.begin[p + 1]].T.astype(error.dtype)
            total = np.zeros(self.entry[p].shape, error.dtype)
            np.add.at(total, code, part)
            np.add.at(counts[p], code, 1)
            sums.append(total)
        return sums, counts

    def moved(self, sums: list[np.ndarray], counts: np.ndarray) -> Codebooks:
        """Entries at the floored means of their parts; unused ones stay."""
        out = Codebooks.__new__(Codebooks)
        out.begin = self.begin
        out.entry = []
        for p, (total, entry) in enumerate(zip(sums, self.entry, strict=True)):
            new = total // np.maximum(counts[p], 1)[:, None].astype(total.dtype)  # numpy's and Python's // both go down
            out.entry.append(np.where(counts[p][:, None] > 0, new, entry))
        return out


def _merge(a, b):
    """Of two results of totals, either of which may be None."""
    if a is None or b is None:
        return a if b is None else b
    return [x + y for x, y in zip(a[0], b[0], strict=True)], a[1] + b[1]


def _add_block(books: Codebooks):
    return lambda held, row: _merge(held, books.totals(_unpack(row.kind, row.width, row.numbers)))


def _code(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, kind, width, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes, errors = books.nearest(_unpack(kind, width, raw))
                names = ["".join(f"{c:02x}" for c in row) for row in zip(*(c.tolist() for c in codes), strict=True)]
                total = [min(int(x), LARGEST) for x in sum(e.astype(object) for e in errors)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(names, pa.string()), pa.array(total, pa.int64())], ["id", "label", "code", "error"])

    return tidy_batches(run)


def _kept(vectors: DataFrame, vector_id: str, vector: str, label: str) -> DataFrame:
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col(f"`{vector_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & finite)


def fit(blocks: DataFrame, first: np.ndarray, parts: int, rounds: int) -> Codebooks:
    """Codebooks after `rounds` of assignment and means over all blocks."""
    books = Codebooks(first, parts)
    packed = blocks.select("kind", "width", "numbers").rdd
    for _ in range(rounds):
        totals = packed.treeAggregate(None, _add_block(books), _merge, depth=3)
        books = books.moved(*totals)
    return books


def codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, vector_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vector_id, label, code (two hex digits a part), error (long), label_error (errors summed over equal labels, nulls together), codebooks_sha256."""
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("one to 256 entries, one part or more")
    spark = vectors.sparkSession
    ship(spark)
    kept = _kept(vectors, vector_id, vector, label)
    # Bounded: `entries` rows.
    head = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    schema = f"`{vector_id}` bigint, `{label}` bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"
    if not head:
        return spark.createDataFrame([], schema)
    lengths = [len(r.v) for r in head]
    width = max(lengths, key=lambda n: (lengths.count(n), n))
    if width < parts:
        raise ValueError(f"{parts} parts of {width} components")
    same = kept.filter(F.size("v") == width)
    if len(set(lengths)) > 1:
        head = same.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    blocks = materialise(same.select("id", "label", "v").mapInArrow(_to_blocks(width), BLOCK_SCHEMA), "vector-blocks")
    first = _whole(np.array([r.v for r in head], np.float64))
    books = fit(blocks, first.astype(np.int64) if first.dtype != object else first, parts, rounds)
    coded = materialise(blocks.mapInArrow(_code(books), "id bigint, label bigint, code string, error bigint"), "vector-codes")
    # A long too small for the sum gives the largest long, as in a row.
    by_label = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    by_label = by_label.withColumnRenamed("label", "of_label")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")), "left")
    return joined.select(F.col("id").alias(vector_id), F.col("label").alias(label), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
