"""Every query that has SQL against that SQL, at the smallest scale."""

import pytest

from spanlens.plans import registry
from tests import oracle

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    cols, rows = oracle.rows_of(registry.QUERIES[name](spark, D))
    names, expected = oracle.rows_of_sql(registry.ORACLES[name], D)
    assert cols == names
    assert len(rows) == len(expected)
    assert all(oracle.close(a, b) for a, b in zip(rows, expected, strict=True))


@pytest.mark.parametrize("name", ["sequence_ratio", "projection", "platt_calibration", "oof_logistic"])
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, D).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_learned_scorers_find_what_is_there(spark):
    """Out-of-fold scores of a text that names its class, and a probe of features that give it away."""
    from pyspark.sql import functions as F

    from spanlens.operators import learned

    rows = spark.range(120).select(F.col("id"), (F.col("id") % 2).alias("y"), F.when(F.col("id") % 2 == 1, F.lit("bad news today")).otherwise(F.lit("good news today")).alias("text"), (F.col("id") % 3).alias("kind"))
    scored = learned.oof_text(rows, "id", "text", "y", k=3, vocabulary=50)
    assert scored.count() == 120 and scored.filter("y = 1").agg(F.min("score")).first()[0] > scored.filter("y = 0").agg(F.max("score")).first()[0]
    assert scored.groupBy("fold").count().count() == 3
    named = rows.select("id", "kind", *((F.col("kind") == k).cast("double").alias(f"f{k}") for k in range(3)))
    assert learned.probe(named, "id", ["f0", "f1", "f2"], "kind", k=2).first().balanced_accuracy == 1.0
    both = learned.oof_targets(rows.select("id", "y", (1 - F.col("y")).alias("not_y"), F.col("y").cast("double").alias("f")), "id", ["f"], ["y", "not_y"], k=2)
    assert {r.target: r.auc for r in both.collect()} == {"y": 1.0, "not_y": 1.0}


def test_texts_are_cut_once_for_all_folds(spark, monkeypatch):
    from pyspark.sql import functions as F

    from spanlens.operators import learned

    written, keep = [], learned.kept

    def noted(df, name):
        written.append((name, set(df.columns)))
        return keep(df, name)

    monkeypatch.setattr(learned, "kept", noted)
    rows = spark.range(24).select("id", (F.col("id") % 2).alias("y"), F.when(F.col("id") % 2 == 1, F.lit("bad news")).otherwise(F.lit("good news")).alias("text"))
    scored = learned.oof_text(rows, "id", "text", "y", k=2, vocabulary=9)
    assert [n for n, _ in written] == ["folds", "counts", "counts"] and not any("text" in c for _, c in written)
    assert scored.filter("y = 1").agg(F.min("score")).first()[0] > scored.filter("y = 0").agg(F.max("score")).first()[0]


def test_rows_are_counted_once_for_all_folds(spark, monkeypatch):
    from pyspark.sql import functions as F

    from spanlens.operators import learned

    written, keep = [], learned.kept

    def noted(df, name):
        written.append((name, keep(df, name)))
        return written[-1][1]

    monkeypatch.setattr(learned, "kept", noted)
    rows = spark.range(24).select("id", (F.col("id") % 2).alias("y"), F.when(F.col("id") % 2 == 1, F.lit("bad news")).otherwise(F.lit("good news")).alias("text"))
    assert learned.oof_text(rows, "id", "text", "y", k=3, vocabulary=9).count() == 24
    assert sum(df.count() for name, df in written if name == "counts") == 24


def test_text_scores_do_not_depend_on_how_rows_lie(spark):
    """Of equally frequent terms at the cut the first in the alphabet stay."""
    from pyspark.sql import functions as F

    from spanlens.operators import learned

    texts = [(i, i % 2, f"{'red' if i % 2 else 'blue'}{i % 7} {chr(97 + i % 13)}{chr(97 + i % 5)} tail{i % 11}") for i in range(60)]
    lie = [spark.createDataFrame(t, "id int, y int, text string").repartition(n) for t, n in ((texts, 1), (texts[::-1], 7))]
    one, other = ({r.id: r.score for r in learned.oof_text(df, "id", "text", "y", k=2, vocabulary=5).collect()} for df in lie)
    assert len(one) == 60 and all(abs(one[i] - other[i]) < 1e-6 for i in one)
    rows = spark.createDataFrame([(0, ["bb", "aa", "cc"]), (1, ["bb", "dd"]), (1, ["aa"]), (1, [])], "fold int, __one array<string>")
    assert learned._vocabularies(rows, 2, 2) == [{("aa", ""), ("bb", ""), ("bb", "dd")}, {("aa", ""), ("bb", ""), ("aa", "cc"), ("bb", "aa")}]
    counts = {r.fold: r["__c"].toArray().tolist() for r in learned._vectors(rows.filter("size(__one) > 1"), [("aa", ""), ("bb", ""), ("bb", "aa")]).collect()}
    assert counts == {0: [1.0, 1.0, 1.0], 1: [0.0, 1.0, 0.0]}


def test_text_scores_without_words(spark):
    from pyspark.sql import functions as F

    from spanlens.operators import learned

    rows = spark.range(6).select("id", (F.col("id") % 2).alias("y"), F.lit(None).cast("string").alias("text"))
    assert [r.score for r in learned.oof_text(rows, "id", "text", "y", k=2, vocabulary=9).collect()] == [None] * 6


def test_vocabularies_by_bounds_are_those_of_all_counts(spark, monkeypatch):
    from collections import Counter

    from pyspark.sql import functions as F

    from spanlens.operators import learned

    def vocabularies(texts, most):
        counted, counts, found = [], learned._counts, [Counter() for _ in range(3)]
        monkeypatch.setattr(learned, "_counts", lambda rows, terms, k: counted.append(len(terms)) or counts(rows, terms, k))
        rows = spark.createDataFrame(texts, "fold int, text string").repartition(3).select("fold", F.split("text", " ").alias("__one"))
        for fold, text in texts:
            w = text.split(" ")
            found[fold].update([*((x, "") for x in w), *zip(w, w[1:])])
        want = []
        for f in range(3):
            n = sum((found[g] for g in range(3) if g != f), Counter())
            want.append({t for two in (False, True) for t in sorted((t for t in n if (t[1] != "") == two), key=lambda t: (-n[t], t))[:most]})
        assert learned._vocabularies(rows, 3, most) == want
        monkeypatch.setattr(learned, "_counts", counts)
        return counted, sum(map(len, found)) / 3

    monkeypatch.setattr(learned, "BLOCK_WORDS", 400)
    skewed = [(i % 3, " ".join(f"w{int(300 / (1 + (i * 37 + j * 101 + i * j * 7) % 299))}x{(i * j) % 2}" for j in range(60))) for i in range(300)]
    counted, there = vocabularies(skewed, 4)
    assert len(counted) == 1 and counted[0] < there  # some terms were counted again, not all
    flat = [(i % 3, " ".join(f"f{(i * 61 + j * 17) % 997}" for j in range(40))) for i in range(150)]
    assert vocabularies(flat, 5)[0] == []  # the bounds are too weak: all terms were reported
