"""Pair distances (higher: more disagreement): TF-IDF families, counts, hashing, sets, embeddings, sequences.

Pairs come as (pair, a, b) with text sides. Sparse vectors are long tables
(pair, side, term, weight); the two sides meet in one aggregate by (pair, term)
instead of a self-join.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import body, hashed, tokens
from ..shipping import ship
from ..sources import kept

#: Characters of a task that counts terms; terms of a vocabulary that is broadcast, and of one with its deviates.
CHARS_A_TASK, BROADCAST_TERMS, PROJECTED_TERMS = 1 << 21, 1_000_000, 20_000
#: Characters of the words that are cut into n-grams together.
CHARS_A_BLOCK = 1 << 20


def word_grams(text: Column, two: bool = True) -> Column:
    """Words of two characters or more, and their pairs."""
    t = tokens(text)
    n = F.size(t)
    if not two:
        return t
    pairs = F.when(n > 1, F.zip_with(F.slice(t, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(t, F.coalesce(pairs, F.array().cast("array<string>")))


def spaced_words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(body(text)), r"\s+"), lambda w: w != "")


def char_grams(text: Column, lo: int, hi: int, in_words: bool = True) -> Column:
    """Character n-grams, within words padded by a space on each side, or over the whole text."""
    words = F.transform(spaced_words(text), lambda w: F.concat(F.lit(" "), w, F.lit(" "))) if in_words else F.array(F.lower(body(text)))

    def of(w: Column) -> Column:
        parts = []
        for n in range(lo, hi + 1):
            many = F.length(w) - n + 1
            grams = _grams(w, n, many)
            parts.append(F.coalesce(grams, F.array().cast("array<string>")))
        short = F.when((F.length(w) < lo) & (F.length(w) > 0), F.array(w)).otherwise(F.array().cast("array<string>"))
        return F.concat(*parts, short)

    return F.flatten(F.transform(words, of))


def _grams(w: Column, n: int, many: Column) -> Column:
    def one(i: Column) -> Column:
        return F.substring(w, i, F.lit(n))

    return F.when(many > 0, F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), one))


def term_counts(pairs: DataFrame, grams: Callable[[Column], Column] = word_grams) -> DataFrame:
    """pair, term, ta, tb: counts on either side, partitioned by pair.

    Texts are dealt by pair before they are cut into terms, so that the counts
    and whatever is summed by pair from them need no shuffle of (pair, term) rows.
    As many tasks as keep a task's terms in memory: one number is read ahead.
    """
    chars = pairs.agg(F.sum(F.length(body("a")) + F.length(body("b"))).alias("n")).first().n or 0
    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // CHARS_A_TASK))
    sides = pairs.repartition(tasks, "pair").select("pair", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("t")), F.struct(F.lit(1).alias("side"), F.col("b").alias("t")))).alias("x")).select("pair", "x.side", "x.t")
    terms = sides.select("pair", "side", F.explode(grams(F.col("t"))).alias("term"))
    return terms.groupBy("pair", "term").agg(F.count_if(F.col("side") == 0).alias("ta"), F.count_if(F.col("side") == 1).alias("tb"))


def cosine(pairs: DataFrame, weighted: DataFrame) -> DataFrame:
    """pair, distance: 1 - cosine of (wa, wb) by pair; 1 if a side has no weight."""
    return _distance(pairs, weighted.groupBy("pair").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"), F.sum(F.col("wa") * F.col("wa")).alias("aa"), F.sum(F.col("wb") * F.col("wb")).alias("bb")))


def _distance(pairs: DataFrame, sums: DataFrame) -> DataFrame:
    return pairs.select("pair").join(sums.select("pair", _near().alias("near")), "pair", "left").select("pair", (1 - F.coalesce("near", F.lit(0.0))).alias("distance"))


def _near() -> Column:
    return F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("dot") / F.sqrt(F.col("aa")) / F.sqrt(F.col("bb"))).otherwise(F.lit(0.0))


def vocabulary(counts: DataFrame, most: int | None = 10_000, min_df: int = 1) -> DataFrame:
    """term, df: documents with the term (a side is a document); the `most` terms of largest count, ties by term."""
    t = counts.groupBy("term").agg(F.sum(F.col("ta") + F.col("tb")).alias("tf"), F.sum((F.col("ta") > 0).cast("int") + (F.col("tb") > 0).cast("int")).alias("df"))
    return _most_frequent(t, most, min_df)


def _most_frequent(terms: DataFrame, most: int | None, min_df: int) -> DataFrame:
    t = terms.filter(F.col("df") >= min_df)
    return t.orderBy(F.desc("tf"), "term").limit(most) if most else t


def tfidf_weights(pairs: DataFrame, grams: Callable[[Column], Column] = word_grams, most: int | None = 10_000, min_df: int = 1, sublinear: bool = True, fit_on: DataFrame | None = None) -> DataFrame:
    """pair, term, wa, wb by idf = ln((1 + N) / (1 + df)) + 1 and, if sublinear, 1 + ln(tf). `fit_on`: other pairs to learn terms from."""
    counts = term_counts(pairs, grams)
    fitted = counts if fit_on is None else term_counts(fit_on, grams)
    return _weighted(counts, _idf(fitted, pairs if fit_on is None else fit_on, most, min_df), sublinear)


def _idf(counts: DataFrame, pairs: DataFrame, most: int | None, min_df: int) -> DataFrame:
    """term, idf of the vocabulary, written once."""
    return _with_idf(vocabulary(counts, most, min_df), pairs)


def _with_idf(vocab: DataFrame, pairs: DataFrame) -> DataFrame:
    n = pairs.agg((F.count("*") * 2).alias("docs"))
    vocab = vocab.crossJoin(F.broadcast(n))  # one row
    idf = F.log((1 + F.col("docs")) / (1 + F.col("df")).cast("double")) + 1
    return kept(vocab.select("term", idf.alias("idf")), "vocabulary")


def _weighted(counts: DataFrame, vocab: DataFrame, sublinear: bool) -> DataFrame:
    """The counts' columns by pair and term of the vocabulary, weighted; vocabularies of up to BROADCAST_TERMS terms go to the counts, beyond that both are shuffled by term."""
    if vocab.count() <= BROADCAST_TERMS:
        vocab = F.broadcast(vocab)

    def weight(t: str) -> Column:
        tf = 1 + F.log(F.col(t).cast("double")) if sublinear else F.col(t).cast("double")
        return F.when(F.col(t) > 0, tf * F.col("idf")).otherwise(F.lit(0.0))

    rest = [c for c in vocab.columns if c not in ("term", "idf")]
    return counts.join(vocab, "term").select("pair", "term", weight("ta").alias("wa"), weight("tb").alias("wb"), *rest)


def tfidf(pairs: DataFrame, grams: Callable[[Column], Column] = word_grams, most: int | None = 10_000, min_df: int = 1, sublinear: bool = True, fit_on: DataFrame | None = None) -> DataFrame:
    """pair, distance of the TF-IDF weights."""
    return cosine(pairs, tfidf_weights(pairs, grams, most, min_df, sublinear, fit_on))


def char_tfidf(pairs: DataFrame, lo: int, hi: int, most: int | None = 10_000, min_df: int = 1, sublinear: bool = True) -> DataFrame:
    """pair, distance as `tfidf` gives it with `char_grams(text, lo, hi)`.

    The pairs are written once and read twice, for the vocabulary and for the sums; a row
    has both texts of its pair, so neither reading deals them anew. Only rows of a pair that
    has several meet by pair, as counts of words. Tasks count the words of a block of pairs,
    cut each different one into n-grams once and add up the n-grams of a pair in arrays.
    What is shuffled is a row a task and n-gram for the vocabulary, and the numbers of pairs.
    A pair is held whole. Vocabularies of up to BROADCAST_TERMS terms go to all tasks;
    beyond that counts by pair and n-gram become rows and meet them in a join.
    """
    spark, kind = pairs.sparkSession, pairs.schema["pair"].dataType.simpleString()
    ship(spark)
    pairs = kept(pairs.select("pair", body("a").alias("a"), body("b").alias("b")), "pairs", compression="zstd")
    repeated = kept(pairs.groupBy("pair").count().filter("count > 1").select("pair"), "repeated")
    several = not repeated.isEmpty()
    if several:
        one, more = pairs.join(repeated, "pair", "left_anti"), pairs.join(repeated, "pair", "left_semi")
        words = _words(one).unionByName(term_counts(more, spaced_words).sortWithinPartitions("pair"))
    else:
        words = _words(pairs)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _whole_pairs(batches):
            _, terms, _, term, ta, tb = _gram_counts(block, lo, hi)
            count = lambda n: np.bincount(term, n, len(terms)).astype("int64")
            yield pa.RecordBatch.from_pydict({"term": terms, "tf": count(ta + tb), "df": count((ta > 0) + (tb > 0).astype("int64"))})

    terms = words.mapInArrow(found, "term string, tf bigint, df bigint").groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    vocab = _with_idf(_most_frequent(terms, most, min_df), pairs)
    if vocab.count() > BROADCAST_TERMS:

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _whole_pairs(batches):
                ids, terms, pair, term, ta, tb = _gram_counts(block, lo, hi)
                yield pa.RecordBatch.from_pydict({"pair": ids.take(pa.array(pair)), "term": terms.take(pa.array(term)), "ta": ta, "tb": tb})

        return cosine(pairs, _weighted(words.mapInArrow(rows, f"pair {kind}, term string, ta bigint, tb bigint"), vocab, sublinear))
    shared = spark.sparkContext.broadcast(vocab.toArrow())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf = shared.value["term"].combine_chunks(), shared.value["idf"].to_numpy()
        for block in _whole_pairs(batches):
            ids, _, pair, term, ta, tb = _gram_counts(block, lo, hi, known)
            a, b = (np.where(n > 0, 1 + np.log(np.maximum(n, 1)) if sublinear else n, 0.0) * idf[term] for n in (ta, tb))
            yield pa.RecordBatch.from_pydict({"pair": ids, **{c: np.bincount(pair, x, len(ids)).astype("float64") for c, x in (("dot", a * b), ("aa", a * a), ("bb", b * b))}})

    near = words.mapInArrow(sums, f"pair {kind}, dot double, aa double, bb double")
    return _distance(pairs, near) if several else near.select("pair", (1 - _near()).alias("distance"))


def _words(texts: DataFrame) -> DataFrame:
    """pair, term, ta, tb: a row a word of either side, and one without a term for a side that has none; the rows of a pair follow each other."""
    sides = texts.select("pair", F.explode(F.array(F.struct(F.lit(1).alias("ta"), F.lit(0).alias("tb"), F.col("a").alias("t")), F.struct(F.lit(0).alias("ta"), F.lit(1).alias("tb"), F.col("b").alias("t")))).alias("x"))
    return sides.select("pair", F.explode_outer(spaced_words(F.col("x.t"))).alias("term"), F.col("x.ta").cast("bigint").alias("ta"), F.col("x.tb").cast("bigint").alias("tb"))


def _whole_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows, those of a pair together, in blocks of some CHARS_A_BLOCK characters of terms and their ends; no pair is divided."""

    def size(batch: pa.RecordBatch) -> int:
        return batch.num_rows + (pc.sum(pc.utf8_length(batch["term"])).as_py() or 0)

    held, chars, limit = [], 0, CHARS_A_BLOCK
    for batch in batches:
        held.append(batch)
        chars += size(batch)
        if chars >= limit:
            block = pa.Table.from_batches(held)
            pair = _coded(block, "pair").indices.to_numpy()
            last = int(np.searchsorted(pair, pair[-1]))
            if last:
                yield block.slice(0, last)
            held, block = block.slice(last).to_batches(), None
            chars = sum(map(size, held))
            limit = max(CHARS_A_BLOCK, 2 * chars)  # a pair beyond a block is not put together at each batch
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _coded(block: pa.Table, column: str) -> pa.DictionaryArray:
    return block[column].combine_chunks().dictionary_encode("encode")


def _gram_counts(block: pa.Table, lo: int, hi: int, known: pa.Array | None = None) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and n-grams, then by different (pair, n-gram) in the order of pairs: their places and ta, tb. `known`: the n-grams that count, else all of the block."""
    pairs, said = _coded(block, "pair"), pc.is_valid(block["term"])
    some = said.to_numpy()
    words = _coded(block.filter(said), "term")
    many = max(len(words.dictionary), 1)
    key, order = _ordered(pairs.indices.to_numpy()[some].astype("int64") * many + words.indices.to_numpy())
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    na, nb = (np.add.reduceat(block[c].to_numpy()[some][order], starts) for c in ("ta", "tb"))
    own, of = key[starts] // many, key[starts] % many  # a row a different (pair, word)
    terms, word, term = _cut(words.dictionary.to_pylist(), lo, hi)
    if known is not None:
        place = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy()[term]
        terms, word, term = known, word[place >= 0], place[place >= 0]
    term = term[np.argsort(word, kind="stable")].astype("int64")
    size = np.bincount(word, minlength=len(words.dictionary))
    row = np.repeat(np.arange(len(of)), size[of])
    at = np.arange(len(row)) + np.repeat((np.cumsum(size) - size)[of] - (np.cumsum(size[of]) - size[of]), size[of])
    key, order = _ordered(own[row] * len(terms) + term[at])
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    ta, tb = (np.add.reduceat(n[row[order]], starts) for n in (na, nb))
    return pairs.dictionary, terms, key[starts] // max(len(terms), 1), key[starts] % max(len(terms), 1), ta, tb


def _ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys from 0 on in order, and where each stood; key and place are sorted as one number if they fit."""
    bits = len(key).bit_length()
    if int(key.max(initial=0)) >> (63 - bits):
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = np.sort(key << bits | np.arange(len(key)))
    return both >> bits, both & ((1 << bits) - 1)


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the different keys, and the number of each key among them."""
    ordered, order = _ordered(key)
    new = np.diff(ordered, prepend=-1) != 0
    number = np.empty(len(key), "int64")
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _cut(words: list[str], lo: int, hi: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different n-grams of different words, padded by a space on each side; for each place of one, its word and which it is.

    An n-gram is numbered by the number of the one that it lengthens and its last character. Words below `lo` are their own.
    """
    text = "".join(f" {w} " for w in words)
    size = np.fromiter(map(len, words), "int64", len(words)) + 2
    letter = np.frombuffer(text.encode("utf-32-le"), "<u4").astype("int64")
    word = np.repeat(np.arange(len(words)), size)
    left = np.cumsum(size)[word] - np.arange(len(word))
    number, terms, words_of, terms_of = np.zeros(len(word), "int64"), [], [], []
    for n in range(1, hi + 1):
        at = np.flatnonzero(left >= n)
        first, number[at] = _numbered((number[at] << 21) + letter[at + n - 1])
        kinds = number[at]
        if n < lo:
            at = at[size[word[at]] == n]
            first, kinds = _numbered(number[at])
        words_of.append(word[at])
        terms_of.append(kinds + len(terms))
        terms += [text[p : p + n] for p in at[first].tolist()]
    return pa.array(terms, pa.string()), np.concatenate(words_of), np.concatenate(terms_of)


def held_out_tfidf(pairs: DataFrame, fold: Column, folds: int, grams: Callable[[Column], Column] = word_grams, most: int = 10_000, min_df: int = 1) -> DataFrame:
    """pair, distance of every pair, by terms and idf of the pairs in other folds; 1 where these have none of its terms. `fold`: 0 to `folds` - 1, from `pair`."""
    counts = term_counts(pairs, grams).withColumn("fold", fold.cast("int"))
    own = counts.groupBy("term", "fold").agg(F.sum(F.col("ta") + F.col("tb")).alias("tf"), F.sum((F.col("ta") > 0).cast("int") + (F.col("tb") > 0).cast("int")).alias("df"))
    # A row a term, which all folds read: its totals, and of these the share of each fold.
    terms = own.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("tf", "df")))).alias("own"))
    parts = []
    for k in range(folds):
        here = F.col("own")[F.lit(k)]
        others = terms.select("term", (F.col("tf") - F.coalesce(here["tf"], F.lit(0))).alias("tf"), (F.col("df") - F.coalesce(here["df"], F.lit(0))).alias("df"))
        parts.append(others.filter(F.col("df") >= max(min_df, 1)).orderBy(F.desc("tf"), "term").limit(most).select(F.lit(k).alias("fold"), "term", "df"))
    sizes = pairs.agg(*((F.count_if(fold != k) * 2).alias(f"n{k}") for k in range(folds)))  # one row
    docs = F.element_at(F.array(*(f"n{k}" for k in range(folds))), F.col("fold") + 1)
    vocab = reduce(DataFrame.unionAll, parts).crossJoin(F.broadcast(sizes))
    vocab = F.broadcast(vocab.select("fold", "term", (F.log((1 + docs) / (1 + F.col("df")).cast("double")) + 1).alias("idf")))  # at most `most` rows a fold

    def weight(t: str) -> Column:
        return F.when(F.col(t) > 0, (1 + F.log(F.col(t).cast("double"))) * F.col("idf")).otherwise(F.lit(0.0))

    return cosine(pairs, counts.join(vocab, ["fold", "term"]).select("pair", weight("ta").alias("wa"), weight("tb").alias("wb")))


def count_cosine(pairs: DataFrame, grams: Callable[[Column], Column] = word_grams) -> DataFrame:
    return cosine(pairs, term_counts(pairs, grams).select("pair", F.col("ta").cast("double").alias("wa"), F.col("tb").cast("double").alias("wb")))


def hashed_cosine(pairs: DataFrame, grams: Callable[[Column], Column] = word_grams, features: int = 1 << 16) -> DataFrame:
    """Counts in buckets of an MD5 hash, without signs."""
    t = term_counts(pairs, grams).groupBy("pair", F.pmod(hashed("term"), F.lit(features)).alias("slot")).agg(F.sum("ta").cast("double").alias("wa"), F.sum("tb").cast("double").alias("wb"))
    return cosine(pairs, t)


def subspace(pairs: DataFrame, grams: Callable[[Column], Column], keep: Column) -> DataFrame:
    """pair, distance, energy: the distance on the terms that `keep` selects, and their share of the squared mass of both sides."""
    t = term_counts(pairs, grams).withColumn("in", keep)
    mass = F.col("ta") * F.col("ta") + F.col("tb") * F.col("tb")
    energy = t.groupBy("pair").agg((F.sum(F.when(F.col("in"), mass).otherwise(0)) / F.sum(mass)).alias("energy"))
    inside = t.filter("in").select("pair", F.col("ta").cast("double").alias("wa"), F.col("tb").cast("double").alias("wb"))
    return cosine(pairs, inside).join(energy, "pair", "left")


def embedding_distance(a: Column, b: Column) -> Column:
    """1 - inner product, in double."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    return 1 - F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, p: acc + p)


def projected_distance(pairs: DataFrame, seed: int | str, width: int = 384, grams: Callable[[Column], Column] = word_grams, most: int | None = 10_000) -> DataFrame:
    """Cosine distance after a random projection of the TF-IDF weights to `width` coordinates by normal deviates, which come from a hash of (term, coordinate).

    The deviates of a vocabulary of up to PROJECTED_TERMS terms are one matrix that
    all tasks read; a task sums its pairs' terms, in the order of pairs, batch by
    batch. Without such a bound they are rows by term and coordinate.
    """
    counts = term_counts(pairs, grams)
    vocab = _idf(counts, pairs, most, 1)
    if most is None or most > PROJECTED_TERMS:
        weighted = _weighted(counts, vocab, True)
        deviates = vocab.select("term", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("slot")).withColumn("r", normal_deviate(seed, F.col("term"), F.col("slot")))
        spread = weighted.join(deviates, "term").select("pair", "slot", "wa", "wb", "r")
        low = spread.groupBy("pair", "slot").agg(F.sum(F.col("r") * F.col("wa")).alias("wa"), F.sum(F.col("r") * F.col("wb")).alias("wb"))
        return cosine(pairs, low)
    spark = pairs.sparkSession
    placed = kept(vocab.withColumn("place", F.row_number().over(W.orderBy("term")) - 1), "places")  # at most `most` rows
    made = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).select("place", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda slot: normal_deviate(seed, F.col("term"), slot)).alias("r")).toArrow()
    matrix = np.zeros((made.num_rows, width))
    matrix[made["place"].to_numpy()] = made["r"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    shared = spark.sparkContext.broadcast(matrix)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deviates, open_pair, open_sums = shared.value, None, None

        def closed(ids: list, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"pair": pa.array(ids, pa.int64()), "dot": (a * b).sum(1), "aa": (a * a).sum(1), "bb": (b * b).sum(1)})

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids, place, wa, wb = (part.column(c).to_numpy() for c in ("pair", "place", "wa", "wb"))
                starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                r = deviates[place]
                a, b, ids = np.add.reduceat(r * wa[:, None], starts), np.add.reduceat(r * wb[:, None], starts), ids[starts]
                if open_pair == ids[0]:
                    a[0] += open_sums[0]
                    b[0] += open_sums[1]
                elif open_pair is not None:
                    yield closed([open_pair], *(x[None] for x in open_sums))
                if len(ids) > 1:
                    yield closed(list(ids[:-1]), a[:-1], b[:-1])
                open_pair, open_sums = ids[-1], (a[-1], b[-1])
        if open_pair is not None:
            yield closed([open_pair], *(x[None] for x in open_sums))

    # Terms without weight on a side count as zeros there.
    rows = _weighted(counts, placed, True).select(F.col("pair").cast("long").alias("pair"), "place", "wa", "wb").sortWithinPartitions("pair")
    return _distance(pairs, rows.mapInArrow(sums, "pair long, dot double, aa double, bb double"))


def normal_deviate(seed: int | str, *parts: Column) -> Column:
    """Box-Muller from two hashes."""
    u = lambda name: (hashed(F.lit(f"{seed}{name}"), *parts) + 0.5) / F.lit(4294967296.0)
    return F.sqrt(-2 * F.log(u("u"))) * F.cos(F.lit(6.283185307179586) * u("v"))


def composite(z: Column, marker: Column, share: float) -> Column:
    """share * z + (1 - share) * marker."""
    return share * z + (1 - share) * marker.cast("double")


def entailment_gap(a: Column, b: Column) -> Column:
    """|a - b| of two entailment scores that a model gave before; null with a null."""
    return F.abs(a - b)


def sequence_distance(a: Column, b: Column) -> Column:
    """1 - ratio of matching blocks; both empty: 0. Row logic that no built-in has, in Arrow batches."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([1 - difflib.SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)])

    return ratio(a, b)


def title_match(a: Column, b: Column, least: float = 0.82) -> Column:
    from ..functions.text import plain

    return sequence_distance(plain(a), plain(b)) <= 1 - least
