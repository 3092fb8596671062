"""Learned scorers on Spark ML: out-of-fold logistic regression on features and on TF-IDF text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.feature import IDF, PCA, ElementwiseProduct, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..shipping import ship
from ..sources import kept
from .resample import numbered


def folds(df: DataFrame, key: str, y: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Adds fold: stratified by the label, dealt round by a hash order in each class, range of the hash by range."""
    placed = numbered(df.withColumn("__k", F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"))), "__k", [y])
    return placed.withColumn("fold", F.pmod("i", F.lit(k)).cast("int")).select(*df.columns, "fold")


def _balanced(df: DataFrame, y: str) -> DataFrame:
    """Adds __w: n / (classes * n of the class)."""
    n = df.groupBy(y).agg(F.count("*").alias("__c"))
    total = n.agg(F.sum("__c").alias("__t"), F.count("*").alias("__k"))
    weights = n.crossJoin(F.broadcast(total)).select(y, (F.col("__t") / (F.col("__k") * F.col("__c"))).alias("__w"))
    return df.join(F.broadcast(weights), y)  # one row a class


def fit_logistic(df: DataFrame, features: Sequence[str], y: str, balanced: bool = True, reg: float = 1e-6) -> PipelineModel:
    rows = df.withColumn("__y", F.col(y).cast("double"))
    rows = _balanced(rows, "__y") if balanced else rows.withColumn("__w", F.lit(1.0))
    stages = [VectorAssembler(inputCols=list(features), outputCol="__v"), StandardScaler(inputCol="__v", outputCol="__x", withMean=True), LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", probabilityCol="__prob", predictionCol="__pred", rawPredictionCol="__raw", regParam=reg, maxIter=100)]
    return Pipeline(stages=stages).fit(rows)


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds __p, the probability of class 1."""
    out = model.transform(df).withColumn("__p", vector_to_array("__prob")[1])
    return out.drop("__v", "__x", "__prob", "__pred", "__raw")


def oof_logistic(df: DataFrame, key: str, features: Sequence[str], y: str, k: int = 5, seed: int = 0) -> DataFrame:
    """key, y, fold, score: each row scored by a fit (scaler included) on the other folds; fewer folds if a class is small, none under two rows."""
    least = df.groupBy(y).count().agg(F.min("count").alias("m"), F.count("*").alias("c")).first()
    k = min(k, least.m or 0) if least.c == 2 else 0
    if k < 2:
        return df.select(key, y, F.lit(None).cast("int").alias("fold"), F.lit(None).cast("double").alias("score"))
    rows = kept(folds(df.select(key, y, *features), key, y, k, seed), "folds")
    parts = []
    for f in range(k):
        model = fit_logistic(rows.filter(F.col("fold") != f), features, y)
        parts.append(predict(model, rows.filter(F.col("fold") == f), features).select(key, y, "fold", F.col("__p").alias("score")))
    return reduce(DataFrame.union, parts)


def oof_targets(df: DataFrame, key: str, features: Sequence[str], targets: Sequence[str], k: int = 5, seed: int = 0) -> DataFrame:
    """target, n, n_pos, auc of out-of-fold scores for several targets, all on the folds of the first."""
    from .rank import auc

    rows = kept(folds(df.select(key, *targets, *features), key, targets[0], k, seed), "folds")
    parts = []
    for t in targets:
        scored = [predict(fit_logistic(rows.filter(F.col("fold") != f), features, t), rows.filter(F.col("fold") == f), features).select(F.col(t).alias("y"), F.col("__p").alias("s")) for f in range(k)]
        parts.append(auc(reduce(DataFrame.union, scored), "s", ["y"]).select(F.lit(t).alias("target"), "n", F.col("n_y").alias("n_pos"), F.round("auc_y", 3).alias("auc")))
    return reduce(DataFrame.union, parts)


#: Words that a task counts at a time; a longer text is counted alone.
BLOCK_WORDS = 1 << 20
#: Of such a block, the terms that are reported for each one of a vocabulary; terms beyond that have a bound.
REPORTED = 4
#: Terms that are counted again, at most.
AGAIN = 200_000


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Runs of rows of up to `most` words, the words, and the row of each word."""
    for batch in batches:
        n = pc.list_value_length(batch.column("__one")).to_numpy(zero_copy_only=False).astype("int64")
        ends, at = np.cumsum(n), 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + most, "right")))
            part = batch.slice(at, to - at)
            yield part, part.column("__one").flatten(), np.repeat(np.arange(to - at), n[at:to])
            at = to


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of `keys` in order, and how often each is there."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[starts], np.diff(np.r_[starts, len(keys)])


def _reported(rows: DataFrame, k: int, most: int | None) -> DataFrame:
    """a, b, c0 ... c(k-1), cut: words (b is empty) and pairs of neighbours, and how often each is in the texts of a fold.

    A block reports about its `most` most frequent words and pairs; the others are not more frequent there than its cut.
    cut sums the cuts of the blocks that report a term; those of all blocks are in two rows more, whose a is empty.
    """
    block = BLOCK_WORDS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, row in _blocks(batches, block):
            coded = words.dictionary_encode()
            code, known, fold = coded.indices.to_numpy().astype("int64"), coded.dictionary, part.column("fold").to_numpy()[row]
            near = row[1:] == row[:-1]
            for two, term in ((False, code), (True, (code[:-1] * len(known) + code[1:])[near])):
                found, n = _runs(term * k + (fold[1:][near] if two else fold))
                terms, place = np.unique(found // k, return_inverse=True)
                counts = np.zeros((k, len(terms)), "int64")
                counts[found % k, place] = n
                total, cut = counts.sum(0), 0
                if most is not None and len(terms) > most:
                    cut = int(np.partition(total, -most)[-most])
                    terms, counts = terms[total > cut], counts[:, total > cut]
                a, b = (known.take(pa.array(terms // len(known))), known.take(pa.array(terms % len(known)))) if two else (known.take(pa.array(terms)), pa.array([""] * len(terms), pa.string()))
                yield pa.RecordBatch.from_pydict({"a": a, "b": b} | {f"c{f}": counts[f] for f in range(k)} | {"cut": np.full(len(terms), cut, "int64")})
                yield pa.RecordBatch.from_pydict({"a": pa.array([""]), "b": pa.array(["*" if two else ""])} | {f"c{f}": pa.array([0]) for f in range(k)} | {"cut": pa.array([cut])})

    sums = [*(f"c{f}" for f in range(k)), "cut"]
    made = rows.select("fold", "__one").mapInArrow(counted, "a string, b string, " + ", ".join(f"{c} bigint" for c in sums))
    return made.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in sums))


def _lookup(terms: Sequence[tuple[str, str]]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words of `terms`, the place in `terms` of each or -1, the pairs' codes in order and their places."""
    known = sorted({w for t in terms for w in t if w})
    place, alone = {w: i for i, w in enumerate(known)}, np.full(len(known) + 1, -1)
    for slot, (a, b) in enumerate(terms):
        if not b:
            alone[place[a]] = slot
    pairs = sorted((place[a] * len(known) + place[b], slot) for slot, (a, b) in enumerate(terms) if b)
    codes, slots = np.array([(-1, -1), *pairs], "int64").T
    return pa.array(known, pa.string()), alone, codes, slots


def _places(words: pa.Array, row: np.ndarray, lookup: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The row and the place of each word and pair of neighbours that the lookup knows."""
    known, alone, codes, slots = lookup
    word = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype("int64")
    both = np.flatnonzero((row[1:] == row[:-1]) & (word[1:] >= 0) & (word[:-1] >= 0))
    code = word[both] * len(known) + word[both + 1]
    at = np.searchsorted(codes, code, "right") - 1
    slot = np.r_[alone[word], np.where(codes[at] == code, slots[at], -1)]
    return np.r_[row, row[both]][slot >= 0], slot[slot >= 0]


def _counts(rows: DataFrame, terms: Sequence[tuple[str, str]], k: int) -> np.ndarray:
    """How often each of `terms` is in the texts of each fold."""
    block, size, shared = BLOCK_WORDS, len(terms), rows.sparkSession.sparkContext.broadcast(_lookup(terms))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size * k, "int64")
        for part, words, row in _blocks(batches, block):
            row, slot = _places(words, row, shared.value)
            sums += np.bincount(slot * k + part.column("fold").to_numpy()[row], minlength=size * k)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"at": found, "n": sums[found]})

    found = rows.select("fold", "__one").mapInArrow(counted, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most k * AGAIN rows
    sums = np.zeros(size * k, "int64")
    sums[found["at"].to_numpy()] = found["n"].to_numpy()
    return sums.reshape(size, k)


def _vocabularies(rows: DataFrame, k: int, most: int, reported: int | None = REPORTED) -> list[set[tuple[str, str]]]:
    """For each fold the `most` words and the `most` pairs of neighbours that are most frequent in the other folds, of equally frequent ones the first in the alphabet.

    Blocks report their frequent terms. The sums are at most a term's count, and with the cuts of the blocks that did not
    report it at least that; terms that can be among the most frequent ones by these bounds are counted again. Where the
    bounds leave too many terms open, blocks report all, and the sums are the counts.
    """
    counts = _reported(rows, k, reported and reported * most).persist(StorageLevel.DISK_ONLY)
    try:
        of = [reduce(Column.__add__, (F.col(f"c{g}") for g in range(k) if g != f), F.lit(0)) for f in range(k)]
        kinds = [(F.col("a") != "") & (F.col("b") == ""), (F.col("a") != "") & (F.col("b") != "")]
        tops = [counts.filter(kind & (n > 0)).orderBy(n.desc(), "a", "b").limit(most).select(F.lit(f).alias("fold"), "a", "b", n.alias("n")) for kind in kinds for f, n in enumerate(of)]
        best = reduce(DataFrame.union, tops).collect()  # at most 2 * k * most rows
        cuts = {r.b != "": r.cut for r in counts.filter("a = ''").collect()}  # two rows
        bounded, maybe, again = True, F.lit(False), []
        for two, cut in cuts.items():
            for f in range(k if cut else 0):
                n = [r.n for r in best if r.fold == f and (r.b != "") == two]
                bounded &= len(n) == most and min(n) > cut  # else a term that no block reports may belong there
                maybe |= kinds[two] & (of[f] + cut - F.col("cut") >= min(n, default=0))
        if bounded and any(cuts.values()):
            again = sorted((r.a, r.b) for r in counts.filter(maybe).select("a", "b").limit(AGAIN + 1).collect())
    finally:
        counts.unpersist()
    if not bounded or len(again) > AGAIN:
        return _vocabularies(rows, k, most, None)
    out = [{(r.a, r.b) for r in best if r.fold == f and not cuts[r.b != ""]} for f in range(k)]
    if again:
        n = _counts(rows, again, k)
        for f in range(k):
            order = np.argsort(n[:, f] - n.sum(1), kind="stable")
            for two in (two for two, cut in cuts.items() if cut):
                out[f].update([t for t in (again[i] for i in order) if (t[1] != "") == two][:most])
    return out


def _vectors(rows: DataFrame, terms: Sequence[tuple[str, str]]) -> DataFrame:
    """`rows` with __c, how often each of `terms` is in a text, for its words."""
    names = [c for c in rows.columns if c != "__one"]
    block, size, shared = BLOCK_WORDS, max(1, len(terms)), rows.sparkSession.sparkContext.broadcast(_lookup(terms))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, row in _blocks(batches, block):
            row, slot = _places(words, row, shared.value)
            found, n = _runs(row * size + slot)
            ends = pa.array(np.searchsorted(found, np.arange(part.num_rows + 1) * size).astype("int32"))
            lists = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((found % size).astype("int32"), n.astype("float64")))
            sparse = pa.StructArray.from_arrays([pa.array(np.full(part.num_rows, x, kind)) for x, kind in ((0, "int8"), (size, "int32"))] + list(lists), names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), sparse], names=[*names, "__c"])

    return rows.mapInArrow(counted, StructType([*(rows.schema[c] for c in names), StructField("__c", VectorUDT())]))


def oof_text(df: DataFrame, key: str, text: str, y: str, k: int = 5, vocabulary: int = 10_000, seed: int = 0) -> DataFrame:
    """key, y, fold, score of TF-IDF unigrams and bigrams into a logistic regression, out of fold; score is null where the other folds have no word.

    Texts are cut once for all folds, and the vocabularies of all folds come from the same counts by fold. Then the terms
    that any fold knows are counted in each row, once; a fold's rows are written apart, and its fit reads the other
    folds' rows, with a weight of 0 for the terms that it does not know.
    """
    ship(df.sparkSession)
    cut = RegexTokenizer(inputCol="text", outputCol="__one", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2)
    rows = folds(df.select(key, y, F.coalesce(text, F.lit("")).alias("text")), key, y, k, seed).withColumn("__y", F.col(y).cast("double"))
    rows = kept(cut.transform(rows).drop("text"), "folds")
    known = _vocabularies(rows, k, vocabulary)
    terms = sorted(set().union(*known))
    held = [kept(_vectors(rows.filter(F.col("fold") == f), terms), "counts") for f in range(k)]
    parts = []
    for f in range(k):
        if not known[f]:
            parts.append(held[f].select(key, y, "fold", F.lit(None).cast("double").alias("score")))
            continue
        others = reduce(DataFrame.union, (held[g] for g in range(k) if g != f))
        idf = IDF(inputCol="__c", outputCol="__i").fit(others).idf.toArray()
        weigh = ElementwiseProduct(scalingVec=Vectors.dense(np.where([t in known[f] for t in terms], idf, 0.0)), inputCol="__c", outputCol="__x")
        learn = LogisticRegression(featuresCol="__x", labelCol="__y", probabilityCol="__prob", regParam=1e-3, maxIter=50)
        model = Pipeline(stages=[weigh, learn]).fit(others)
        parts.append(model.transform(held[f]).select(key, y, "fold", vector_to_array("__prob")[1].alias("score")))
    return reduce(DataFrame.union, parts)


def probe(df: DataFrame, key: str, features: Sequence[str], label: str, k: int = 5, least: int = 5, seed: int = 0) -> DataFrame:
    """rows, classes, balanced_accuracy of an out-of-fold one-vs-rest probe; classes under `least` rows are left out."""
    classes = df.groupBy(label).agg(F.count("*").alias("c")).filter(F.col("c") >= least).orderBy(label).collect()  # one row a class
    place = F.create_map(*(F.lit(x) for i, r in enumerate(classes) for x in (r[0], float(i))))
    rows = kept(folds(df.select(key, label, *features).withColumn("__y", place[F.col(label)]).dropna(subset=["__y"]), key, "__y", k, seed), "folds")
    parts = []
    for f in range(k):
        stages = [VectorAssembler(inputCols=list(features), outputCol="__v"), StandardScaler(inputCol="__v", outputCol="features", withMean=True), OneVsRest(classifier=LogisticRegression(maxIter=50, regParam=1e-3), labelCol="__y", predictionCol="__said")]
        model = Pipeline(stages=stages).fit(rows.filter(F.col("fold") != f))
        parts.append(model.transform(rows.filter(F.col("fold") == f)).select("__y", "__said"))
    said = reduce(DataFrame.union, parts)
    per = said.groupBy("__y").agg(F.count("*").alias("n"), F.avg((F.col("__y") == F.col("__said")).cast("double")).alias("recall"))
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"), F.avg("recall").alias("balanced_accuracy"))


def project(df: DataFrame, features: Sequence[str], k: int = 2) -> DataFrame:
    """Adds pc1 ... pck."""
    model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__v"), PCA(k=k, inputCol="__v", outputCol="__pc")]).fit(df)
    out = model.transform(df).withColumn("__a", vector_to_array("__pc"))
    return out.select(*df.columns, *(F.col("__a")[i].alias(f"pc{i + 1}") for i in range(k)))
