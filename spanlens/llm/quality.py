"""Quality classifier from weak labels (operator 6).

Overlapping heuristic labellers vote good (1), bad (0) or abstain (-1) on each
whole text. Vote patterns are counted over all texts, and expectation-
maximisation on those counts (a table of at most 3^labellers rows, whatever the
input) estimates each labeller's accuracies and the posterior of every pattern.
The posteriors train a linear scorer over hashed features of a bounded sample
(about SAMPLE of the distinct texts, by a hash of the text; all of them if
there are no more, and copies never lower the number): the relative
frequencies of character-class trigrams and binned statistics. It scores every
whole text; rows under a half are rejected.

Null and empty texts, and very short ones, get abstentions and therefore about
the prior, so they stay. Copies score alike. An empty table gives no rows. Rows
are never shuffled with their texts; other columns are ignored or, in `good`,
returned as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship, text_or_empty, tidy_batches
from .words import SEGMENT, Words, batch_parts, raw_texts

#: Distinct texts that the scorer is fitted on, hash buckets of its features.
SAMPLE, BUCKETS = 8_000, 1024
#: Rounds of expectation-maximisation, steps, rate and decay of the fit.
ROUNDS, STEPS, RATE, DECAY = 60, 200, 0.1, 1e-5
LABELLERS = ("repeats", "runs", "variety", "symbols", "bars", "capitals", "exclamations", "beyond_prose")

_CLASS = np.arange(256) % 64 + 64  # symbols and controls: each its own class
_CLASS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[[0x20, 0x09]] = 4
_CLASS[[0x0A, 0x0D]] = 5
_PROSE = np.zeros(256, bool)  # what prose is made of besides letters and digits
_PROSE[[*b" \t\n\r.,;:?'\"()-"]] = True
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
_LETTER = _UPPER | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_BEYOND = ~(_LETTER | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | _PROSE)
_BAR, _EXCLAMATION = _BYTES == 0x7C, _BYTES == 0x21


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


class Statistics:
    """Statistics of each text, and votes and features from them. Bytes are looked at SEGMENT at a time, so a long text needs no long arrays."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts)
        n = self.words = np.diff(w.bounds)
        many = len(texts)
        text = np.repeat(np.arange(many), n)
        same = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (text[1:] == text[:-1]))
        mixed = np.sort((w.hash >> np.uint64(20)) | (text.astype(np.uint64) << np.uint64(44)))
        new = np.ones(len(text), bool)
        new[1:] = mixed[1:] != mixed[:-1]
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.size)
        by_byte = np.zeros((many, 256), np.int64)
        for raw, of in self.segments():
            by_byte += np.bincount(of * 256 + raw, minlength=many * 256).reshape(many, 256)
        count = lambda mask: by_byte[:, mask].sum(1)
        # A run of three like words begins where two words on end repeat their predecessor.
        thrice = same[1:][(np.diff(same) == 1) & (text[same[1:] + 1] == text[same[:-1]])]
        self.letters = count(_LETTER)
        self.repeats = _ratio(np.bincount(text[same + 1], minlength=many), n)
        self.variety = _ratio(np.bincount((mixed[new] >> np.uint64(44)).astype(np.int64), minlength=many), n)
        self.runs = _ratio(np.bincount(text[thrice], minlength=many), n)
        self.symbols = _ratio(count(_BEYOND & ~_BAR & ~_EXCLAMATION), n)
        self.bars = _ratio(count(_BAR), n)
        self.capitals = _ratio(count(_UPPER), self.letters)
        self.exclamations = _ratio(count(_EXCLAMATION), n)
        self.beyond_prose = _ratio(count(_BEYOND), self.size)

    def segments(self, more: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Bytes and the text of each, in pieces that overlap by `more` bytes."""
        for lo in range(0, len(self.raw), SEGMENT):
            at = np.arange(lo, min(lo + SEGMENT + more, len(self.raw)))
            yield self.raw[lo : lo + len(at)], np.searchsorted(self.ends, at, "right")

    def votes(self) -> np.ndarray:
        """labellers x texts."""
        n = self.words

        def vote(enough: np.ndarray, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
            return np.where(enough & bad, 0, np.where(enough & good, 1, -1))

        return np.stack(
            [
                vote(n >= 8, self.repeats > 0.2, self.repeats < 0.05),
                vote(n >= 8, self.runs > 0.1, self.runs < 0.01),
                vote((n >= 30) & (n <= 400), self.variety < 0.3, self.variety > 0.5),
                vote(n >= 4, self.symbols > 0.25, self.symbols < 0.05),
                vote(n >= 4, self.bars > 0.1, self.bars < 0.02),
                vote(self.letters >= 30, self.capitals > 0.4, self.capitals < 0.2),
                vote(n >= 8, self.exclamations > 0.25, self.exclamations < 0.05),
                vote(self.size >= 12, self.beyond_prose > 0.05, self.beyond_prose < 0.02),
            ]
        )

    def features(self) -> np.ndarray:
        """texts x BUCKETS: as many rows as a chunk has (at most ROWS)."""
        many = len(self.size)
        flat = np.zeros(many * BUCKETS, np.int32)
        for raw, of in self.segments(2):
            c = _CLASS[raw]
            code = (c[:-2] * 128 + c[1:-1]) * 128 + c[2:]
            inside = of[:-2] == of[2:]
            bucket = (code * 2654435761 >> 7) % BUCKETS
            flat += np.bincount(of[:-2][inside] * BUCKETS + bucket[inside], minlength=many * BUCKETS).astype(np.int32)
        out = np.sqrt(flat.reshape(many, BUCKETS) / np.maximum(self.size[:, None] - 2, 1)).astype(np.float32)
        for k, name in enumerate(LABELLERS):
            value = np.log1p(getattr(self, name) * 20)
            slot = (k * 97 + np.minimum(value * 4, 30).astype(np.int64)) * 2654435761 % BUCKETS
            np.add.at(out, (np.arange(many), slot), np.where(self.words >= 8, 0.5, 0).astype(np.float32))
        return out


def posteriors(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """patterns x labellers of votes and how often each occurs: P(good) of each pattern, accuracies (labeller x class x vote), P(good).

    Starts from the belief that a text with any bad vote is probably bad.
    """
    one_hot = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    voted = (patterns >= 0).any(1)
    good = np.where((patterns == 0).any(1), 0.1, np.where(voted, 0.95, 0.8))
    total = max(counts.sum(), 1)
    prior, table = 0.5, np.full((patterns.shape[1], 2, 3), 1 / 3)
    for _ in range(ROUNDS):
        mass = np.stack([(1 - good) * counts, good * counts])
        prior = np.clip(mass[1].sum() / total, 0.01, 0.99)
        table = np.einsum("cp,pjv->jcv", mass, one_hot) + 0.01 * np.sqrt(total) / 3
        table /= table.sum(2, keepdims=True)
        # Length, not quality, decides who abstains: votes alone speak.
        spoken = np.log(table[:, :, 1:] / table[:, :, 1:].sum(2, keepdims=True))
        like = np.einsum("pjv,jcv->pc", one_hot[:, :, 1:], spoken) + np.log([1 - prior, prior])
        good = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -50, 50)))
    return good, table, float(prior)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -40, 40)))


def fit(x: np.ndarray, target: np.ndarray) -> Scorer:
    """Logistic regression on soft targets, all rows in each step."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0  # the rows' own type: a product with another would copy them
    if not len(x):
        return Scorer(w, 40.0)
    moments = np.zeros((2, len(w) + 1))
    for t in range(1, STEPS + 1):
        error = ((1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40))) - target) / len(x)).astype(np.float32)
        grad = np.append(error @ x + DECAY * w, error.sum())
        moments = moments * [[0.9], [0.99]] + np.stack([0.1 * grad, 0.01 * grad**2])
        step = RATE * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    return Scorer(w, float(b))


def _pattern_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = 3 ** np.arange(len(LABELLERS))
    for batch in batches:
        for part in batch_parts(batch, 0):
            code, n = np.unique(((Statistics(raw_texts(part.column(0))).votes() + 1) * base[:, None]).sum(0), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), pa.array(n, pa.int64())], ["pattern", "n"])


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a text, whatever its copies in this task; the bar bounds the keys held."""
    base, met = 3 ** np.arange(len(LABELLERS)), set()
    for batch in batches:
        keys, new = batch.column(0).to_pylist(), []
        for k, key in enumerate(keys):
            if key not in met:
                met.add(key)
                new.append(k)
        for part in batch_parts(batch.take(pa.array(new, pa.int64())), 1):
            s = Statistics(raw_texts(part.column(1)))
            code = ((s.votes() + 1) * base[:, None]).sum(0)
            rows = [r.tobytes() for r in s.features().astype("<f2")]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(code, pa.int32()), pa.array(rows, pa.binary())], ["key", "pattern", "features"])


def train(docs: DataFrame, text: str = "text") -> tuple[Scorer, dict[int, float]]:
    """The scorer, and P(good) of each vote pattern."""
    ship(docs.sparkSession)
    body = docs.select(text_or_empty(text).alias("text"))
    counts = body.mapInArrow(tidy_batches(_pattern_counts), "pattern int, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    codes = np.array(sorted(r.pattern for r in counts), np.int64)
    n = {r.pattern: r.n for r in counts}
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1
    good, _, _ = posteriors(patterns, np.array([n[c] for c in codes.tolist()], float))
    belief = dict(zip(codes.tolist(), good.tolist(), strict=True))
    keyed = body.select(F.xxhash64("text").alias("key"), "text")
    # Texts below a bar on their hash: about SAMPLE of the distinct ones; copies are one.
    distinct = keyed.select("key").distinct().count()
    share = min(1.0, SAMPLE / max(distinct, 1))
    some = keyed.filter(F.pmod(F.col("key"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else keyed
    features = some.mapInArrow(tidy_batches(_sample_rows), "key bigint, pattern int, features binary").groupBy("key").agg(F.min("pattern").alias("pattern"), F.min("features").alias("features"))
    sample = materialise(features, "quality-sample").orderBy("key").limit(SAMPLE + SAMPLE // 4).collect()
    if n and not sample:
        raise ValueError("the fit's sample is empty although the table has rows")
    x = np.zeros((len(sample), BUCKETS), np.float32)
    target = np.array([belief[r.pattern] for r in sample])
    for k in range(len(sample)):
        x[k] = np.frombuffer(bytes(sample[k].features), "<f2")
        sample[k] = None
    return fit(x, target), belief


def score(docs: DataFrame, model: tuple[Scorer, dict[int, float]], text: str = "text") -> DataFrame:
    """All columns of `docs`, and weak_label (posterior of the votes), score, good (score >= 0.5), which replace columns of the same names."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights, a number for each pattern met
    names = [f"c{i}" for i in range(len(docs.columns))]
    base = 3 ** np.arange(len(LABELLERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, belief = shared.value
        for batch in batches:
            for part in batch_parts(batch, batch.num_columns - 1):
                s = Statistics(raw_texts(part.column(part.num_columns - 1)))
                weak = [belief.get(c, 0.5) for c in ((s.votes() + 1) * base[:, None]).sum(0).tolist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(weak, pa.float64()), pa.array(scorer.score(s.features()), pa.float64())], [*names, "weak_label", "score"])

    inner = docs.toDF(*names)
    inner = inner.withColumn("__text", text_or_empty(names[docs.columns.index(text)]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1])
    scored = inner.mapInArrow(tidy_batches(run), f"{fields}, weak_label double, score double")
    new = ("weak_label", "score", "good")
    return scored.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in new), "weak_label", "score", (F.col("score") >= 0.5).alias("good"))


def good(docs: DataFrame) -> DataFrame:
    """The rows that aren't rejected, with their own columns."""
    names = [f"d{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = names[docs.columns.index("text")]
    kept = score(plain, train(plain, at), at).filter("good")
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
