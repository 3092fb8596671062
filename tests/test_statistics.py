"""Fixtures with known values, and properties."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlens.functions import mathtext, stats
from spanlens.functions import text as tx
from spanlens.operators import agree, align, calibrate, distance, learned, multiplicity, rank, resample, simulate
from spanlens.operators import verdict as vd

F1 = [(1, "a", 0.9, 1, 1, 0), (2, "a", 0.8, 0, 1, 1), (3, "a", 0.8, 1, 0, 0), (4, "a", 0.6, 0, 1, 0), (5, "b", 0.5, 1, 0, 1), (6, "b", 0.5, 0, 0, 0), (7, "b", 0.3, 0, 0, 1), (8, "b", 0.1, 0, 0, 0)]


@pytest.fixture(scope="module")
def f1(spark):
    return spark.createDataFrame(F1, "id int, grp string, s double, y int, z int, zc int").persist()


def test_rank_statistics(f1):
    r = rank.auc(f1, "s", ["y", "z", "zc"]).first()
    assert (r.auc_y, r.auc_z, r.auc_zc) == pytest.approx((0.8, 0.9, 0.4))
    assert rank.average_precision(f1, "s", "y").first().ap == pytest.approx(0.7222222222)
    assert rank.average_precision(f1, "s", "z").first().ap == pytest.approx(0.8055555556)
    w = rank.within_auc(f1, "s", "y", "grp").first()
    assert (w.within, w.within_weighted, w.lam, w.cross) == pytest.approx((0.8541666667, 0.8571428571, 0.4666666667, 0.75))
    assert w.lam * w.within_weighted + (1 - w.lam) * w.cross == pytest.approx(w.pooled)
    assert rank.exact_within_null(f1, "s", "y", "grp").first().null_mean == pytest.approx(0.6333333333)
    assert {r.grp: r.auc_y for r in rank.auc(f1, "s", ["y"], ["grp"]).collect()} == pytest.approx({"a": 0.875, "b": 0.8333333333})


def test_agreement(f1):
    assert agree.kappa(f1, "z", "y").first().kappa == pytest.approx(-0.0666666667)
    assert agree.kappa(f1, "y", "z").first().kappa == pytest.approx(-0.0666666667)
    assert agree.separation(f1.withColumn("m", -F.col("s")), "m", "y").first().d == pytest.approx(1.0880270295)
    spark = f1.sparkSession
    t = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (0, 0, 0), (1, 0, 0)], "a int, b int, c int")
    assert agree.fleiss(t, ["a", "b", "c"]).first().fleiss_kappa == pytest.approx(1 / 3)


def test_exits(spark):
    ones = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int")
    assert rank.auc(ones, "s", ["y"]).first().auc_y is None
    assert rank.average_precision(ones, "s", "y").first().ap == 1
    flat = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 0), (0.5, 0)], "s double, y int")
    assert rank.auc(flat, "s", ["y"]).first().auc_y == 0.5
    assert rank.average_precision(flat, "s", "y").first().ap == 0.25
    empty = flat.filter("s > 1")
    assert rank.auc(empty, "s", ["y"]).first().auc_y is None
    odd = spark.createDataFrame([(float("nan"), 1), (None, 0), (0.3, 0), (0.4, 1), (0.2, None)], "s double, y int")
    assert rank.auc(odd, "s", ["y"]).first().auc_y == 1


def test_two_level_sums_equal_windows(spark):
    t = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(997)).cast("double").alias("s"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0).cast("int").alias("y"), F.lit(1).alias("g"))
    assert rank.auc(t, "s", ["y"]).first().auc_y == pytest.approx(rank.auc(t, "s", ["y"], ["g"]).first().auc_y)
    assert rank.auc(t.withColumn("s", F.exp(F.col("s") / 100)), "s", ["y"]).first().auc_y == pytest.approx(rank.auc(t, "s", ["y"]).first().auc_y)
    assert rank.auc(t.withColumn("s", -F.col("s")), "s", ["y"]).first().auc_y == pytest.approx(1 - rank.auc(t, "s", ["y"]).first().auc_y)


def test_intervals(spark):
    one = spark.range(1)
    lo, hi = stats.wilson(F.lit(5), F.lit(38))
    assert tuple(one.select(lo, hi).first()) == pytest.approx((0.0575386765, 0.2732685958))
    se, lo, hi = stats.hanley_mcneil(F.lit(0.8), F.lit(3), F.lit(5))
    assert tuple(one.select(lo, hi).first()) == pytest.approx((0.4429506933, 1.1570493067))
    assert one.select(stats.normal_tail(F.lit(1.0))).first()[0] == pytest.approx(0.5 * math.erfc(1 / math.sqrt(2)), abs=2e-7)
    t = spark.createDataFrame([(p,) for p in (0.001, 0.008, 0.039, 0.041, 0.042, 0.06)], "p double")
    got = [r.adjusted for r in multiplicity.benjamini_hochberg(t, "p").orderBy("p").collect()]
    assert got == pytest.approx([0.006, 0.024, 0.0504, 0.0504, 0.0504, 0.06])


def test_budgets():
    assert rank.budgets("10,0.05,1", 100, 7) == [5, 7, 10, 100]
    with pytest.raises(ValueError):
        rank.budgets("-1", 10, 1)


def test_resampling(f1):
    rows = resample.numbered(f1, "id")
    per = resample.weights(rows, 20, 1).groupBy("draw").agg(F.sum("w").alias("n")).collect()
    assert len(per) == 20 and all(r.n == 8 for r in per)
    same = [sorted(map(tuple, resample.bootstrap_auc(f1.repartition(n), "id", "s", "y", 5, 1).collect()), key=str) for n in (1, 5)]
    assert same[0] == same[1]
    assert resample.stratified_null(f1, "id", "s", "z", "y", 10, 1).count() == 10
    assert resample.adversarial_swap(f1, "id", "s", "y", [0]).first().auc == pytest.approx(0.8)
    assert resample.downsample(f1, "id", "s", "y", 2, "random").count() == 7
    assert resample.interval(f1.filter("id <= 4"), "s").first().draws == 4
    lo = resample.order_interval(f1, "s", 0.5).first()
    assert (lo.draws, lo.lo, lo.hi) == (8, 0.5, 0.8)
    p = resample.tail_p(f1, "s", 0.8).first()
    assert p.p == pytest.approx(4 / 9)
    assert resample.poisson_weights(rows, 50, 1).agg(F.avg("w")).first()[0] > 1


def test_verdict_ladder(spark):
    cases = [
        ((True, 0.6, 0.7, True, None, True, 0.2), "UNDECIDABLE"),
        ((False, 0.3, 0.4, True, None, True, 0.2), "SCORE NOT EVIDENCE"),
        ((False, 0.46, 0.54, True, None, True, 0.2), "SCORE NOT EVIDENCE"),
        ((False, 0.46, 0.54, False, None, True, 0.2), "UNDECIDABLE"),
        ((False, 0.4, 0.7, True, None, True, 0.2), "UNDECIDABLE"),
        ((False, 0.6, 0.7, True, 0.5, True, 0.2), "ALIGNED"),
        ((False, 0.6, 0.7, True, 0.1, False, 0.2), "ALIGNED"),
        ((False, 0.6, 0.7, True, 0.1, True, 0.15), "MISMATCH"),
        ((False, 0.6, 0.7, True, None, True, 0.1), "CAUTION"),
        ((False, 0.6, 0.7, True, None, True, 0.05), "ALIGNED"),
    ]
    t = spark.createDataFrame([(*c, v) for c, v in cases], "blocked boolean, lo double, hi double, ranked boolean, k double, beats boolean, d double, expected string")
    v, reason = vd.verdict_v2(*(F.col(c) for c in ("blocked", "lo", "hi", "ranked", "k", "beats", "d")))
    assert t.filter(v != F.col("expected")).count() == 0
    assert t.select(reason.alias("r")).distinct().count() >= 8


def test_labels_and_joins(spark):
    t = spark.createDataFrame([("Yes",), ("0",), (None,), ("2.5",), (" refuses ",)], "x string")
    assert [r[0] for r in t.select(align.parse_bool("x")).collect()] == [True, False, None, True, True]
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("maybe",)], "x string").select(align.parse_bool("x")).collect()
    twice = spark.createDataFrame([("a", 1), ("a", 2)], "id string, v int")
    with pytest.raises(Exception, match="duplicate"):
        align.assert_unique(twice, "id").collect()
    assert align.keep_last(twice, "id", "v").first().v == 2
    with pytest.raises(ValueError, match="no common"):
        align.inner([twice, twice.withColumn("id", F.lit("b"))], "id")
    assert {r.id for r in align.union_prompts([("f", twice.limit(1)), ("g", twice.limit(1))]).collect()} == {"a", "g_a"}


def test_text(spark):
    t = spark.createDataFrame([("I CANNOT do that",)], "x string")
    assert t.select(tx.any_of("x"), tx.any_of(tx.prefix("x", 5))).first() == (True, False)
    assert spark.range(1).select(tx.complement(F.lit("x" * 49), 50)).first()[0] == ""
    rest, n = tx.strip_openings("x", (r"thinking process[:\s]*", r"i cannot help with[^\.]*\.?\s*"), 5)
    s = spark.createDataFrame([("Thinking Process: I cannot help with X. Sure",)], "x string").select(rest, n).first()
    assert tuple(s) == ("Sure", 2)
    tagged = spark.createDataFrame([("<reasoning>r</reasoning><final>f</final>",), ("Final answer: 7",), ("<final>abc",), ("x",)], "x string")
    assert [r[0].status for r in tagged.select(tx.parse_tagged("x")).collect()] == ["exact", "fallback_final_heading", "fallback_truncated_final", "missing_final"]
    judge = spark.createDataFrame([('{"refusal": true}',), ('bad {"refusal": false, "rationale":"x"} z',), ("no json",)], "x string")
    assert [r[0] for r in judge.select(tx.parse_judgement("x")).collect()] == [True, False, None]
    j = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(tx.jaccard_distance(tx.tokens("a", "[a-z0-9']+"), tx.tokens("b", "[a-z0-9']+"))).first()[0]
    assert j("", "") == 0 and j("a b", "b c") == pytest.approx(2 / 3)
    five = spark.range(1).select(tx.step_prefix(F.array(*map(F.lit, "abcde")), 0.5).alias("c"), tx.step_prefix(F.array(*map(F.lit, "abcde")), 0.5, True).alias("d")).first()
    assert (len(five.c), len(five.d)) == (2, 3)
    assert spark.createDataFrame([("one line",)], "x string").select(tx.drop_first_line("x")).first()[0] == ""


def test_mathematics():
    assert mathtext.same_answer("so \\boxed{\\frac{1}{2}}", "0.5") and mathtext.same_answer("1,000", "1000") and not mathtext.same_answer("2", "3")
    assert mathtext.boxed("\\boxed{a{b}c}") == "a{b}c" and mathtext.boxed("none") is None
    assert mathtext.arithmetic_false("2 + 2 = 4") is False and mathtext.arithmetic_false("2 + 2 = 5") is True and mathtext.arithmetic_false("nothing") is None
    assert mathtext.arithmetic_false("1 + 2 * 3 = 9") is False  # left to right
    assert mathtext.number("9^999") is None and mathtext.number("1/0") is None


def test_distances(spark):
    p = spark.createDataFrame([(1, "alpha beta", "alpha beta"), (2, "alpha beta", "gamma delta"), (3, "", "x yy"), (4, None, None)], "pair int, a string, b string")
    d = {r.pair: r.distance for r in distance.tfidf(p).collect()}
    assert d == pytest.approx({1: 0, 2: 1, 3: 1, 4: 1}, abs=1e-9)
    assert {r.pair: r.distance for r in distance.hashed_cosine(p).collect()} == pytest.approx(d, abs=1e-9)
    assert spark.range(1).select(distance.embedding_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))).first()[0] == 0


def test_simulated_truth(spark):
    t = simulate.latent_contracts(spark, 1500, [0.0, 0.9])
    a = {r.alpha: r for r in rank.auc(t, "s", ["z_comp", "y"], ["alpha"]).collect()}
    gap = {k: abs(r.auc_z_comp - 0.5) - abs(r.auc_y - 0.5) for k, r in a.items()}
    assert gap[0.9] < gap[0.0]


def test_learned(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal() + (i % 2)), float(rng.normal()), i % 2) for i in range(120)]
    t = spark.createDataFrame(rows, "id int, a double, b double, y int")
    out = learned.oof_logistic(t, "id", ["a", "b"], "y", 3)
    assert out.count() == 120 and rank.auc(out, "score", ["y"]).first().auc_y > 0.65
    one = learned.oof_logistic(t.filter("y = 1"), "id", ["a"], "y")
    assert one.filter("score IS NOT NULL").count() == 0
    curve = calibrate.reliability(out, "score", "y", 4)
    assert calibrate.calibration_error(curve).first().n == 120


def test_streaming(spark, tmp_path):
    from spanlens import streaming

    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "id string, v string").write.json(src)
    done = str(tmp_path / "done")
    for k in range(2):
        q = streaming.judge_once(spark.readStream.schema("id string, v string").json(src), "id", done, str(tmp_path / f"cp{k}"), lambda b: b.withColumn("label", F.lit(True)))
        q.awaitTermination()
    assert spark.read.parquet(done).count() == 2


def test_sources(spark, tmp_path):
    from spanlens import sources

    (tmp_path / "w.json").write_text('{"phase": "p", "records": [{"id": 1, "trace": null}, {"id": 2, "trace": "t"}]}')
    rows = sources.read_rows(spark, str(tmp_path / "w.json"))
    assert sources.traces(rows).orderBy("id").collect()[0].text == "" and "phase" in rows.columns
    (tmp_path / "r.csv").write_text("id,score\n1,0.5\n")
    assert sources.read_rows(spark, str(tmp_path / "r.csv")).first().score == "0.5"
    with pytest.raises(ValueError):
        sources.read_rows(spark, "x.pkl")
    j = spark.createDataFrame([(1, True, None), (2, None, None), (3, False, "e")], "id int, refusal_judge boolean, error string")
    assert sources.judgements(j).count() == 2 and sources.judgements(j, null_policy="zero").count() == 3 and sources.judgements(j, errors=True).count() == 1
    assert "| 0.500 | - |" in sources.markdown(spark.createDataFrame([(0.5, None)], "a double, b string"))


def test_a_frequent_join_key_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(align, "BLOCK", 4)
    monkeypatch.setattr(align, "LINKS_A_TASK", 20)
    a = spark.createDataFrame([(i, "A b" if i < 30 else f"k{i}") for i in range(40)] + [(0, "A b"), (99, "")], "x int, s string")
    b = spark.createDataFrame([(i, "a-B" if i < 9 else f"K {i + 22}") for i in range(14)] + [(98, None)], "y int, t string")
    out = align.join_on(a, b, tx.plain("s"), tx.plain("t"))
    expected = [(x, y) for x, s in [(r.x, r.s) for r in a.collect()] for y, t in [(r.y, r.t) for r in b.collect()] if (s, t) == ("A b", "a-B") or (t and s[1:] == t[2:] and s[0] == "k")]
    assert out.columns == ["x", "s", "y", "t"]
    assert sorted((r.x, r.y) for r in out.collect()) == sorted(expected)
    assert out.filter("t = 'a-B'").select(F.spark_partition_id()).distinct().count() > 1


def test_draws_hold_no_row_for_each_pick(spark):
    df = spark.createDataFrame([(str(i), i % 7, i % 2, int(i % 3 == 0)) for i in range(60)], "id string, s int, z int, y int")
    out = resample.paired_gap(df, "id", "s", "z", "y", 5, "s")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"keys=\[draw#\d+L?, i#", plan)
    rows = resample.numbered(df, "id")
    old = resample.weighted_auc(resample.weights(rows, 5, "s").join(rows, "i"), "s", "y", "w", ["draw"])
    assert {r.draw: round(r.auc_y, 9) for r in out.collect()} == {r.draw: round(r.auc, 9) for r in old.collect()}
    old_null = sorted((r.draw, r.auc) for r in resample.bootstrap_auc(df.filter("y = 1"), "id", "s", "y", 3, "s").collect())
    assert old_null == [(0, None), (1, None), (2, None)]


def test_within_group_draws_are_the_same_however_large_groups_are(spark, monkeypatch):
    df = spark.createDataFrame([(str(i), i * 7 % 11, int(i % 3 == 0), f"g{i % 4 if i % 5 else 9}") for i in range(80)] + [("n", 3, 1, "one"), ("m", 2, 0, "none")], "id string, s int, y int, g string")
    mixed = resample.permuted(df.select(F.col("id").alias("k"), "s", F.col("y").alias("z"), "g"), "k", "z", 6, "g", ["g"]).withColumn("w", F.lit(1))
    expected = {r.draw: round(r.auc, 9) for r in resample.weighted_auc(mixed, "s", "zp", "w", ["draw"]).collect()}
    for most in (1, 17, 4096):
        monkeypatch.setattr(resample, "GROUP", most)
        assert {r.draw: round(r.auc, 9) for r in resample.within_null(df, "id", "s", "y", "g", 6, "g").collect()} == expected
    assert [r.auc for r in resample.within_null(df.filter("y = 0"), "id", "s", "y", "g", 2, "g").collect()] == [None, None]
