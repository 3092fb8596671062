"""Stupid-backoff scores of every document under the whole corpus (operator 2).

Documents are dealt to splits of about SPLIT bytes by a hash of doc_id and text,
so a task that runs again meets the same documents; rows alike in both travel as
one with a number wherever a batch holds several. A split counts its distinct
unigrams and bigrams and sends them to count tables partitioned by hash: one row
of packed, sorted (n-gram, count) for each split and part. A part adds up what
all splits sent and joins the totals back to each split's own n-grams, in the
order they came. With those totals a split sums, for each document,

    log S(w | v), S = c(v w) / c(v) if c(v w) > 0, else BACKOFF * c(w) / N, else BACKOFF^2 / N,

and so on for longer n-grams (`order`), where c leaves out the document's own occurrences, so that a text is not known
from itself, and N counts the words of all other documents. A frequent n-gram
is at most one entry for each split, never one for each document, so no part
grows with it, and every number covers all documents.

Words are lower-cased runs of letters, digits and non-ASCII bytes. Null and
empty texts have no words and a null score. Repeated rows are documents of
their own. The first word is scored by its unigram. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_or_empty, tidy, tidy_batches
from .words import CHUNK, Words, batch_parts, mix, raw_texts

#: Bytes of text of a split, the factor of a step back, and the words of the longest n-gram.
SPLIT, BACKOFF, ORDER = 8_000_000, 0.4, 2


class Grams:
    """Words of the texts of a split, and for each order n the hash of the n words that end at each word, where a text has as many."""

    def __init__(self, texts: list[bytes], order: int):
        hashes, sizes, lo, held = [], [], 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held > CHUNK or i + 1 == len(texts):
                w = Words(texts[lo : i + 1])
                hashes.append(w.hash)
                sizes.append(np.diff(w.bounds))
                lo, held = i + 1, 0
        word = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.text = np.repeat(np.arange(len(texts)), self.size)
        place = np.arange(len(word)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.hash, self.valid = {1: word}, {1: np.ones(len(word), bool)}
        for n in range(2, order + 1):
            self.hash[n] = np.zeros(len(word), np.uint64)
            self.hash[n][1:] = mix(self.hash[n - 1][:-1] * np.uint64(0xD6E8FEB86659FD93) + word[1:])
            self.valid[n] = place >= n - 1

    def distinct(self, n: int, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams and how often each occurs, a text as often as it has copies."""
        text = self.text[self.valid[n]]
        grams, at, counts = np.unique(self.hash[n][self.valid[n]], return_inverse=True, return_counts=True)
        if (copies != 1).any():
            counts = np.bincount(at, copies[text], len(grams)).astype(np.int64)
        return grams, counts


def _parts(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the parts in sorted hashes."""
    part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1))


def pack(grams: np.ndarray) -> bytes:
    """Sorted hashes as their first and six-byte differences, which hold for all but very few hashes; else as they are."""
    if not len(grams):
        return b""
    grams = grams.astype("<u8")
    gaps = np.diff(grams)
    if len(gaps) and int(gaps.max()) >= 1 << 48:
        return b"\x08" + grams.tobytes()
    return b"\x06" + grams[:1].tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, "<u8")
    if packed[0] == 8:
        return np.frombuffer(packed, "<u8", offset=1)
    gaps = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, 6)
    wide = np.zeros((len(gaps), 8), np.uint8)
    wide[:, :6] = gaps
    return np.cumsum(np.concatenate([np.frombuffer(packed, "<u8", 1, 1), wide.view("<u8").ravel()]), dtype="<u8")


def _counts(values: np.ndarray) -> bytes:
    """Four bytes each if that is enough for all, else eight."""
    return values.astype("<u4" if not len(values) or int(values.max()) < 1 << 32 else "<u8").tobytes()


def _request(parts: int, order: int):
    def run(table: pa.Table) -> pa.Table:
        g = Grams(raw_texts(table.column("text").combine_chunks()), order)
        split = table.column("split")[0].as_py()
        out: dict[str, list] = {"split": [], "n": [], "part": [], "grams": [], "counts": [], "words": []}
        copies = table.column("copies").to_numpy()
        for n in range(1, order + 1):
            grams, counts = g.distinct(n, copies)
            bounds = _parts(grams, parts)
            for p in range(parts):
                a, b = bounds[p], bounds[p + 1]
                row = (split, n, p, pack(grams[a:b]), _counts(counts[a:b]), int((g.size * copies).sum()))
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
        return pa.table(out, schema=_REQUEST)

    return run


_REQUEST = pa.schema([("split", pa.int32()), ("n", pa.int32()), ("part", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary()), ("words", pa.int64())])


def _totals(table: pa.Table) -> pa.Table:
    """One part: for each split's row, the corpus-wide count of each of its n-grams."""
    grams = [unpack(x) for x in table.column("grams").to_pylist()]
    counts = [np.frombuffer(x, "<u4" if len(x) == 4 * len(g) else "<u8") for x, g in zip(table.column("counts").to_pylist(), grams, strict=True)]
    _, at = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts)).astype("<u8") if len(at) else np.zeros(0, "<u8")
    back = np.split(total[at], np.cumsum([len(x) for x in grams])[:-1])
    words = sum(table.column("words").to_pylist())
    return pa.table(
        {
            "split": table.column("split"),
            "n": table.column("n"),
            "part": table.column("part"),
            "totals": pa.array([_counts(x) for x in back], pa.binary()),
            "size": pa.array([len(x) for x in back], pa.int64()),
            "words": pa.array([words] * len(grams), pa.int64()),
        }
    )


def _own(text: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """For each occurrence, how often its n-gram (by its place among the distinct) is in the same text."""
    _, at, n = np.unique(text * (int(gram.max(initial=0)) + 1) + gram, return_inverse=True, return_counts=True)
    return n[at]


def _score(order: int):
    def run(docs: pa.Table, totals: pa.Table) -> pa.Table:
        g = Grams(raw_texts(docs.column("text").combine_chunks()), order)
        many = docs.num_rows
        if not many:
            return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64()), "n_backoff": pa.array([], pa.int64())})
        totals = totals.sort_by([("n", "ascending"), ("part", "ascending")])
        rest = {}  # for each word, how often the n words that end there occur outside its text
        for n in range(1, order + 1):
            parts = [np.frombuffer(x, "<u4" if len(x) == 4 * size else "<u8") for x, size, k in zip(*(totals.column(c).to_pylist() for c in ("totals", "size", "n")), strict=True) if k == n]
            total = np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
            here = g.valid[n]
            at = np.unique(g.hash[n][here], return_inverse=True)[1]
            rest[n] = np.zeros(len(here), np.int64)
            if len(at):
                rest[n][here] = total[at] - _own(g.text[here], at)
        others = np.maximum(totals.column("words")[0].as_py() - g.size, 1).astype(float)[g.text]
        one = rest[1].astype(float)
        log = np.where(one > 0, np.log(np.maximum(one, 1) / others), np.log(BACKOFF / others))
        back = np.zeros(len(log), bool)
        for n in range(2, order + 1):
            back[g.valid[n]] = rest[n][g.valid[n]] <= 0
            log[g.valid[n]] += np.log(BACKOFF)
            hit = np.flatnonzero(rest[n] > 0)
            # What comes before its last word is known too: outside the text it occurs at least as often.
            log[hit] = np.log(rest[n][hit] / rest[n - 1][hit - 1])
        out = pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "n_words": pa.array(g.size, pa.int64()),
                "log_score": pa.array(np.bincount(g.text, log, many), pa.float64(), mask=g.size == 0),
                "n_backoff": pa.array(np.bincount(g.text[back], minlength=many), pa.int64()),
            }
        )
        return out.take(pa.array(np.repeat(np.arange(many), docs.column("copies").to_numpy())))

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows alike in doc_id and text once for each batch, with their number."""
    for batch in batches:
        for part in batch_parts(batch, 1):
            first: dict[tuple, int] = {}
            copies: list[int] = []
            places = []
            for n, row in enumerate(zip(part.column(0).to_pylist(), raw_texts(part.column(1)), strict=True)):
                at = first.setdefault(row, len(copies))
                if at == len(copies):
                    copies.append(0)
                    places.append(n)
                copies[at] += 1
            yield pa.RecordBatch.from_arrays([*part.take(pa.array(places, pa.int64())).columns, pa.array(copies, pa.int64())], ["doc_id", "text", "copies"])


def score(docs: DataFrame, text: str = "text", split: int = SPLIT, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score (sum of log S; null without words), n_backoff (words whose longest n-gram is unknown) for each row."""
    ship(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text_or_empty(text)) + 50).alias("b")).first().b or 0
    splits = max(1, -(-size // split))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", text_or_empty(text).alias("text")).mapInArrow(tidy_batches(_counted), f"doc_id {kind}, text string, copies bigint")
    dealt = counted.withColumn("split", F.pmod(F.xxhash64("doc_id", "text"), F.lit(splits)).cast("int")).repartition(splits, "split")
    requests = dealt.groupBy("split").applyInArrow(tidy(_request(splits, order)), "split int, n int, part int, grams binary, counts binary, words bigint")
    totals = requests.groupBy("n", "part").applyInArrow(tidy(_totals), "split int, n int, part int, totals binary, size bigint, words bigint")
    return dealt.groupBy("split").cogroup(totals.groupBy("split")).applyInArrow(_score(order), f"doc_id {kind}, n_words bigint, log_score double, n_backoff bigint")
