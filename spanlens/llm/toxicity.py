"""Toxicity by non-negative positive-unlabelled learning (operator 4).

The positives are the confirmed toxic rows of the training folds. The unlabelled
text is a sample of all documents of those folds, whatever `labels` says of
them; labels of rows that are not toxic are never looked at. The class prior is
estimated from the two samples (`estimate_prior`) unless it is given. Each of
CLASSIFIERS linear classifiers over hashed words minimises

    prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)]),

stepping back along the second term whenever it turns negative, each with its
own part of the unlabelled rows. A score is the mean of their probabilities.

Only the fit is on bounded samples: at most UNLABELLED documents and POSITIVES
confirmed ones, and FEATURES feature entries of both, first by a hash of doc_id.
Scoring reads every whole text. The ids of the samples are broadcast; texts are
not shuffled.

Null and empty texts get the score of no words; a null doc_id is in no held-out
fold and in no sample; rows of `labels` with a null id or label are unlabelled,
and one toxic row makes an id toxic; without any positive row all scores are 0
but for rounding. Repeated rows come out as often as they went in; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship, text_or_empty, tidy_batches
from .words import Words, batch_parts, raw_texts

#: Documents, confirmed ones and feature entries that a fit may use.
UNLABELLED, POSITIVES, FEATURES = 14_000, 6_000, 12_000_000
#: Hash buckets, folds, classifiers.
BUCKETS, FOLDS, CLASSIFIERS = 1 << 18, 5, 3
#: Standard errors by which a bucket's share of the positives must leave its share of the unlabelled rows to be a feature.
TELLING = 4.0
#: Rounds of the prior's estimate, rows of either kind under which it is GUESS.
ROUNDS, FEW, GUESS = 3, 80, 0.1
#: Steps, rate and decay of the fit.
STEPS, RATE, DECAY = 200, 0.2, 1e-5


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def buckets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each distinct word bucket of each text."""
    text = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    pair = np.unique(text.astype(np.int64) * BUCKETS + (w.hash >> np.uint64(64 - 18)).astype(np.int64))
    return pair // BUCKETS, pair % BUCKETS


@dataclass
class Model:
    weights: np.ndarray  # classifiers x buckets
    bias: np.ndarray

    def score(self, w: Words) -> np.ndarray:
        text, bucket = buckets(w)
        n = len(w.bounds) - 1
        f = np.stack([np.bincount(text, row[bucket], n) for row in self.weights]) + self.bias[:, None]
        return (1 / (1 + np.exp(-np.clip(f, -40, 40)))).mean(0)


def frequencies(rows: list[np.ndarray]) -> np.ndarray:
    """Share of the rows that have each bucket."""
    return np.bincount(np.concatenate(rows), minlength=BUCKETS) / len(rows) if rows else np.zeros(BUCKETS)


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Buckets whose share of the positives leaves that of the unlabelled rows."""
    p, u = frequencies(positive), frequencies(unlabelled)
    spread = (u + 1 / len(unlabelled)) * (1 - u + 1 / len(unlabelled))
    return np.flatnonzero(np.abs(p - u) >= TELLING * np.sqrt(spread * (1 / len(positive) + 1 / len(unlabelled))))


def _ratio(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The least ratio of the unlabelled rows' share to the positives' share above a threshold, over thresholds that half to 95 in a hundred of the positives pass.

    Above any threshold the unlabelled rows hold at least prior times the
    positives' share; where only positives score high, they hold no more.
    """
    positive, unlabelled = np.sort(positive), np.sort(unlabelled)
    n = len(positive)
    above = np.arange(n // 2, int(0.95 * n) + 1)
    share = (len(unlabelled) - np.searchsorted(unlabelled, positive[n - above]) + 1) / len(unlabelled)
    return float((share * n / above).min())


def estimate_prior(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> float:
    """Share of positives in the unlabelled text. Scores are learned on every other row and measured on the rest, then the other way round: first log ratios of the telling buckets' shares, then ROUNDS times a classifier fitted with the prior found before."""
    if len(positive) < FEW or len(unlabelled) < FEW:
        return GUESS
    prior = None
    for _ in range(ROUNDS + 1):
        found = []
        for k in (0, 1):
            p, u = positive[k::2], unlabelled[k::2]
            if prior is None:
                weight, kept = np.zeros(BUCKETS), telling(p, u)
                weight[kept] = np.log((frequencies(p)[kept] + 1 / len(p)) / (frequencies(u)[kept] + 1 / len(u)))
            else:
                weight = fit(p, u, prior, 1).weights[0]
            rest = [np.array([weight[r].sum() / (max(len(r), 1) if prior is None else 1) for r in rows[1 - k :: 2]]) for rows in (positive, unlabelled)]
            found.append(_ratio(*rest))
        prior = float(min(max(np.mean(found), 1e-4), 0.9))
    return prior


def risk(f_positive: np.ndarray, f_unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two terms of the risk, and the slopes by each score of what a step goes down: the risk, or the second term turned round where it is negative."""
    up_p, up_u = (1 / (1 + np.exp(-np.clip(f, -40, 40))) for f in (f_positive, f_unlabelled))  # slope of l(-f); that of l(f) is one less
    first = prior * np.logaddexp(0, -f_positive).mean()
    second = np.logaddexp(0, f_unlabelled).mean() - prior * np.logaddexp(0, f_positive).mean()
    slope_p, slope_u = -prior * up_p / len(f_positive), up_u / len(f_unlabelled)
    if second < 0:
        return first, second, -slope_p, -slope_u
    return first, second, slope_p + prior * (up_p - 1) / len(f_positive), slope_u


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float | None = None, classifiers: int = CLASSIFIERS, seed: int = 11) -> Model:
    """positive, unlabelled: the distinct buckets of each text."""
    if not positive or not unlabelled:
        return Model(np.zeros((1, BUCKETS), np.float32), np.full(1, -40.0))
    prior = estimate_prior(positive, unlabelled) if prior is None else prior
    kept = telling(positive, unlabelled)
    place = np.full(BUCKETS, -1)
    place[kept] = np.arange(len(kept))

    def entries(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        column = place[np.concatenate(rows)]
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return row[column >= 0], column[column >= 0]

    p_row, p_column = entries(positive)
    rng = np.random.default_rng(seed)
    weights, biases = [], []
    for _ in range(classifiers):
        some = np.flatnonzero(rng.random(len(unlabelled)) < 0.7)
        mine = [unlabelled[i] for i in (some if len(some) else range(len(unlabelled)))]
        u_row, u_column = entries(mine)
        w, b = np.zeros(len(kept)), np.log(prior / (1 - prior))
        moments = np.zeros((2, len(kept) + 1))
        for t in range(1, STEPS + 1):
            _, _, g_p, g_u = risk(np.bincount(p_row, w[p_column], len(positive)) + b, np.bincount(u_row, w[u_column], len(mine)) + b, prior)
            grad = np.bincount(p_column, g_p[p_row], len(kept)) + np.bincount(u_column, g_u[u_row], len(kept)) + DECAY * w
            grad = np.append(grad, g_p.sum() + g_u.sum())
            moments = moments * [[0.9], [0.99]] + np.stack([0.1 * grad, 0.01 * grad**2])
            step = RATE * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-6)
            w, b = w - step[:-1], b - step[-1]
        full = np.zeros(BUCKETS, np.float32)
        full[kept] = w
        weights.append(full)
        biases.append(b)
    return Model(np.stack(weights), np.array(biases))


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batch_parts(batch, 2):
            text, bucket = buckets(Words(raw_texts(part.column(2))))
            cuts = np.searchsorted(text, np.arange(part.num_rows + 1))
            packed = bucket.astype("<i4")
            out = [packed[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], ["doc_id", "part", "buckets"])


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Model:
    """Fit on confirmed toxic rows and a sample of documents, both of the training folds."""
    ship(docs.sparkSession)
    place = F.xxhash64("doc_id", F.lit(4))
    known = labels.filter(F.col("doc_id").isNotNull() & (F.col("toxic").cast("int") > 0) & ~held_out()).select("doc_id").distinct()
    pool = docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id").distinct()
    # At most POSITIVES and UNLABELLED ids.
    ids = known.orderBy(place, "doc_id").limit(POSITIVES).select("doc_id", F.lit(1).alias("p"), F.lit(0).alias("u")).union(pool.orderBy(place, "doc_id").limit(UNLABELLED).select("doc_id", F.lit(0), F.lit(1)))
    ids = ids.groupBy("doc_id").agg((F.max("p") * 2 + F.max("u")).alias("part"))
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "part", "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    features = texts.mapInArrow(tidy_batches(_sample_features), f"doc_id {kind}, part int, buckets binary")
    # An id's rows with several texts count once, by the least features.
    one = materialise(features.groupBy("doc_id").agg(F.min(F.struct("part", "buckets")).alias("x")).select(place.alias("place"), "x.*"), "toxicity-sample")
    size, last = 0, None
    for r in one.select("place", (F.length("buckets") / 4).alias("n")).orderBy("place").collect():  # at most the samples' ids
        size += r.n
        if size > FEATURES and last is not None:
            break
        last = r.place
    chosen = one.filter(F.col("place") <= F.lit(last)).collect() if last is not None else []
    chosen.sort(key=lambda r: (r.place, bytes(r.buckets)))
    rows = [(r.part, np.frombuffer(bytes(r.buckets), "<i4").astype(np.int64)) for r in chosen]
    return fit([x for part, x in rows if part & 2], [x for part, x in rows if part & 1], prior)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep` columns and `score` for each row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CLASSIFIERS x BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_parts(batch, batch.num_columns - 1):
                scores = shared.value.score(Words(raw_texts(part.column(part.num_columns - 1))))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores)], [*keep, "score"])

    inner = docs.select(*(F.col(f"`{c}`") for c in keep), text_or_empty(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1])
    return inner.mapInArrow(tidy_batches(run), f"{fields}, score double")
