"""Queries of text distances against plain Python on the smallest tables."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanlens import sources
from spanlens.functions import text as tx
from spanlens.operators import distance
from spanlens.plans import registry, texts
from spanlens.plans.contracts import turn_pairs

D = "/root/testdata/sf0.001"


def char_wb(text):
    """Grams of 3 to 5 characters within padded words, as the reference's vectoriser cuts them."""
    out = []
    for w in text.lower().split():
        w = f" {w} "
        for n in range(3, 6):
            out += [w[i : i + n] for i in range(len(w) - n + 1)]
    return Counter(out)


def tfidf(rows, most, min_df, sublinear):
    sides = [(char_wb(r.a), char_wb(r.b)) for r in rows]
    tf, df = Counter(), Counter()
    for c in (c for s in sides for c in s):
        tf.update(c)
        df.update(c.keys())
    terms = sorted((t for t in tf if df[t] >= min_df), key=lambda t: (-tf[t], t.encode()))[:most]
    idf = {t: math.log((1 + 2 * len(rows)) / (1 + df[t])) + 1 for t in terms}
    out = {}
    for r, s in zip(rows, sides, strict=True):
        x, y = ({t: (1 + math.log(n) if sublinear else n) * idf[t] for t, n in c.items() if t in idf} for c in s)
        size = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
        out[r.pair] = 1 - (sum(v * y.get(t, 0) for t, v in x.items()) / size if size else 0)
    return out


@pytest.mark.parametrize(("name", "most", "min_df", "sublinear"), [("char_tfidf_all_terms", None, 2, False), ("char_tfidf_sublinear", 20_000, 1, True)])
def test_char_tfidf_is_the_reference_form(spark, name, most, min_df, sublinear):
    got = {r.pair: r.distance for r in registry.QUERIES[name](spark, D).collect()}
    assert got == pytest.approx(tfidf(turn_pairs(spark, D).collect(), most, min_df, sublinear), abs=1e-8)


def test_held_out_vocabulary_scores_every_pair_by_other_folds(spark):
    p = turn_pairs(spark, D)
    got = {r.pair: r.distance for r in registry.QUERIES["held_out_vocabulary"](spark, D).collect()}
    assert set(got) == {r.pair for r in p.collect()}
    fold = F.pmod(tx.hashed(F.floor(F.col("pair") / 1000)), F.lit(texts.FOLDS))
    expected = {}
    for k in range(texts.FOLDS):
        expected |= {r.pair: r.distance for r in distance.tfidf(p.filter(fold == k), fit_on=p.filter(fold != k)).collect()}
    assert got == pytest.approx(expected, abs=1e-8)


def test_held_out_cut_and_folds(spark):
    """The cut of terms counts other folds only, and pairs of even numbers alone have a vocabulary."""
    p = spark.createDataFrame([(0, "xx yy yy yy", "xx yy"), (2, "xx xx zz", "xx zz"), (4, "zz xx", "zz")], "pair long, a string, b string")
    fold = F.col("pair") / 2
    for most in (1, 2, 10_000):
        got = {r.pair: r.distance for r in distance.held_out_tfidf(p, fold, 3, most=most).collect()}
        expected = {}
        for k in range(3):
            expected |= {r.pair: r.distance for r in distance.tfidf(p.filter(fold == k), fit_on=p.filter(fold != k), most=most).collect()}
        assert got == pytest.approx(expected) and len(got) == 3


def test_counts_of_terms_are_not_shuffled(spark):
    p = spark.createDataFrame([(1, "a bb ccc", "bb dd"), (2, "ccc bb", ""), (3, None, None)], "pair int, a string, b string")
    plan = distance.tfidf(p, lambda c: distance.char_grams(c, 3, 5), most=None, min_df=2)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "hashpartitioning(pair" in x and "term" in x]


@pytest.mark.parametrize(("lo", "hi", "most", "min_df", "sublinear"), [(3, 5, None, 2, False), (3, 4, 6, 1, True), (4, 6, 40, 1, True)])
@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_grams_of_words_are_those_of_texts(spark, monkeypatch, lo, hi, most, min_df, sublinear, broadcast):
    """Repeated and empty pairs, one-letter words, letters beyond 16 bits, white space of all kinds; a vocabulary too large to send."""
    monkeypatch.setattr(distance, "BROADCAST_TERMS", broadcast)
    rows = [(1, "A bb\tCCC ccc", "bb\u00a0dd \U0001f600\U0001f601x"), (2, "ccc bb bb", ""), (2, "dd", "bb ccc"), (3, None, None), (4, " \n", "a"), (5, "\u4e2d\u6587\u5b57 ccc a", "\u4e2d\u6587 ccc"), (6, "aaaa " * 40, "aaaaaaa" * 30)]
    p = spark.createDataFrame(rows, "pair int, a string, b string")
    got = sorted(map(tuple, distance.char_tfidf(p, lo, hi, most, min_df, sublinear).collect()))
    expected = sorted(map(tuple, distance.tfidf(p, lambda c: distance.char_grams(c, lo, hi), most, min_df, sublinear).collect()))
    assert [x for x, _ in got] == [x for x, _ in expected] and [x for _, x in got] == pytest.approx([x for _, x in expected], abs=1e-12)


def test_blocks_hold_whole_pairs(monkeypatch):
    import pyarrow as pa

    ids = [1] * 3 + [2] + [3] * 9 + [4, 5, 5, 5]
    rows = pa.table({"pair": ids, "term": [f"w{i}" for i in range(len(ids))]})
    for chars, size in ((1, 1), (1, 4), (7, 2), (1 << 20, 3)):
        monkeypatch.setattr(distance, "CHARS_A_BLOCK", chars)
        blocks = list(distance._whole_pairs(iter(rows.to_batches(max_chunksize=size))))
        assert pa.concat_tables(blocks).equals(rows)
        assert sum(len(set(b["pair"].to_pylist())) for b in blocks) == 5 and (len(blocks) > 1) == (chars < 1 << 20)
    assert not list(distance._whole_pairs(iter([])))


def test_keys_and_places_too_large_for_one_number():
    import numpy as np

    for key in ([], [5, 3, 5, 0], [1 << 62, 3, 1 << 62, 0, 3]):
        first, number = distance._numbered(np.array(key, "int64"))
        _, expected, numbers = np.unique(np.array(key, "int64"), return_index=True, return_inverse=True)
        assert first.tolist() == expected.tolist() and number.tolist() == numbers.tolist()


@pytest.mark.parametrize("name", ["char_tfidf_distance", "char_tfidf_all_terms", "char_tfidf_sublinear"])
def test_no_row_is_made_of_an_n_gram_of_a_text(spark, name):
    plan = registry.QUERIES[name](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "sequence(" not in plan


@pytest.mark.parametrize("name", ["char_tfidf_distance", "char_tfidf_all_terms", "char_tfidf_sublinear"])
def test_texts_of_pairs_are_not_dealt_anew(spark, name):
    """Written pairs are whole rows: their words go to the sums without an exchange or a join."""
    plan = registry.QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("rows", [[(1, "", None), (2, " ", "\n")], [(1, "aa bb aa", "bb"), (2, None, "aa")], [(1, "aa bb", "bb"), (2, "", ""), (1, "", "bb aa"), (3, "bb", "aa bb"), (2, None, " "), (1, "aa", "aa")]])
def test_pairs_without_words_and_of_several_rows(spark, rows):
    p = spark.createDataFrame(rows, "pair int, a string, b string")
    got = sorted(map(tuple, distance.char_tfidf(p, 3, 5, None, 1, False).collect()))
    expected = sorted(map(tuple, distance.tfidf(p, lambda c: distance.char_grams(c, 3, 5), None, 1, False).collect()))
    assert len(got) == len(rows) and [x for x, _ in got] == [x for x, _ in expected] and [x for _, x in got] == pytest.approx([x for _, x in expected], abs=1e-12)


def test_pairs_are_written_once_and_tightly(spark, monkeypatch):
    """One table of texts, in zstd files; both readings are of it."""
    written = []

    def kept(df, name, **how):
        out = sources.kept(df, name, **how)
        written.append((name, out))
        return out

    monkeypatch.setattr(distance, "kept", kept)
    p = spark.createDataFrame([(i, f"aa bb{i} cc", f"bb{i} dd") for i in range(40)], "pair int, a string, b string")
    out = distance.char_tfidf(p, 3, 4, 20, 2, False)
    texts_of = [t for name, t in written if "a" in t.columns]
    assert len(texts_of) == 1 and texts_of[0].count() == out.count() == 40
    assert set(out.inputFiles()) == set(texts_of[0].inputFiles()) and all(f.endswith(".zstd.parquet") for f in out.inputFiles())


def test_projection_sums_pairs_across_batches(spark):
    """A pair of more terms than a batch of sums has, empty pairs and one-sided ones; no rows by coordinate."""
    import numpy as np

    many = " ".join(f"w{i}" for i in range(2600))
    rows = [(1, many, many + " zz"), (2, "w1 w2 zz", "w3 zz"), (3, "", ""), (4, "w5 w6", None), (5, "w1 w2", "w1 w2")]
    p = spark.createDataFrame(rows, "pair int, a string, b string")
    out = distance.projected_distance(p, 5, width=16)
    assert "slot" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.pair: r.distance for r in out.collect()}
    w = distance.tfidf_weights(p).withColumn("r", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda s: distance.normal_deviate(5, F.col("term"), s))).toPandas()
    for k in (1, 2, 5):
        t = w[w.pair == k]
        r = np.stack(t.r)
        a, b = t.wa.to_numpy() @ r, t.wb.to_numpy() @ r
        assert abs(got[k] - (1 - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))) < 1e-9
    assert got[3] == got[4] == 1


def test_judgements_of_repeated_texts_are_made_once(monkeypatch):
    import pandas as pd

    from spanlens.functions import mathtext

    calls = []

    def judge(a, b):
        calls.append((a, b))
        return None if a is None else a == b

    batch = (pd.Series(["1", "2", "1", None], dtype=object), pd.Series(["1", "3", "1", "x"], dtype=object))
    got = [list(s) for s in mathtext.judged_once(judge)(iter([batch, batch]))]
    assert got[0] == got[1] and got[0][:3] == [True, False, True] and got[0][3] is pd.NA
    assert len(calls) == 3
    monkeypatch.setattr(mathtext, "KEPT_TEXTS", 1)
    again = [list(s) for s in mathtext.judged_once(judge)(iter([batch, batch]))]
    assert [x[:3] for x in again] == [x[:3] for x in got] and len(calls) > 6
