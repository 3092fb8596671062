"""Rules and small operators on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from spanlens.functions import rules
from spanlens.functions import text as tx
from spanlens.operators import align, rank, resample


def one(spark, col, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(col).first()[0]


def test_golds_and_numbers(spark):
    offset = rules.gold_offset(F.col("t"), F.col("g"))
    assert one(spark, offset, t="A cat. The Cat", g="cat") == 2
    assert one(spark, offset, t="concatenate", g="cat") is None
    assert one(spark, offset, t="f(x) = 2", g="f(x)") == 0
    assert one(spark, offset, t="x", g="") is None
    number = rules.has_number(F.col("t"), F.col("g"))
    assert one(spark, number, t="it is 1,200.", g="1200") is True
    assert one(spark, number, t="12000", g="1200") is False
    assert one(spark, number, t="3.14", g="3.1") is False
    assert one(spark, tx.has_gold(F.col("t"), F.col("g")), t="anything", g="") is True


def test_openings_and_masks(spark):
    family = rules.opening_family(F.col("t"))
    assert [one(spark, family, t=t) for t in ("Thinking process: x", "I cannot help", "Hello")] == ["thinking", "direct_refusal", "other"]
    masked = tx.mask_words(F.col("t"), F.col("q"), F.col("k"))
    assert one(spark, masked, t="The river flows past Paris", q="Which river is it in Paris?", k="Paris") == "The xxxxx flows past Paris"
    assert one(spark, tx.visible_response(F.col("t")), t="<think>a</think> b") == "b"
    assert one(spark, F.length(tx.excise(F.col("t"), F.lit(3), F.lit(1))), t="abcdefghij") == 7
    assert one(spark, tx.tail(F.col("t"), 0), t="abc") == "abc"


def test_scores_of_steps(spark):
    v = F.array(F.lit(0.5), F.lit(0.4), F.lit(0.9))
    assert [one(spark, rules.prefix_score(v, F.lit(2), how)) for how in ("product", "mean", "min", "last")] == pytest.approx([0.2, 0.45, 0.4, 0.4])
    assert one(spark, tx.steps(F.lit("Step 1: a +\nStep 2: b -\nStep 3: c +"))[1]["sign"]) == "-"
    assert one(spark, tx.steps(F.lit("Step 1: a +\nStep 2: b -"))) is None
    assert one(spark, tx.steps(F.lit("Step 1: a +\nno\nStep 3: c +"))) is None


def test_spans_and_ties(spark):
    t = spark.createDataFrame([(50, 0.2), (100, 0.1), (200, -0.1)], "span int, gap double")
    assert rank.zero_crossing(t, "span", "gap").first().crossing == pytest.approx(150)
    assert rank.first_clear(t, "span", "gap").first().first_clear == 200
    ties = spark.createDataFrame([(1, 0.9, 1), (2, 0.5, 1), (3, 0.5, 0), (4, 0.1, 0)], "id int, s double, y int")
    r = rank.tie_exposure(ties, "s", "y", 2).first()
    assert (r.surely, r.tied, r.places, r.expected) == (1, 2, 1, 1.5)
    assert [tuple(r)[:3] for r in rank.budget_sweep(ties, "s", "y", "id", [1, 2]).orderBy("budget").collect()] == [(1, 1, 1), (2, 2, 2)]


def test_nested_pairs(spark):
    c = spark.createDataFrame([("q", [("m1", "a"), ("m2", "b")], '{"m1,m2": "A wins"}')], "id string, candidates array<struct<model string, text string>>, cmp string")
    r = align.keyed_pairs(c, "id", "cmp", "candidates").first()
    assert (r.a.text, r.b.text, r.verdict) == ("a", "b", "A wins")
    assert resample.verdict_shares(spark.createDataFrame([("A",), ("A",), ("B",)], "verdict string")).orderBy("verdict").first().share == pytest.approx(2 / 3)
    null = resample.label_shuffle(spark.createDataFrame([(i, float(i), i % 2) for i in range(20)], "id int, s double, y int"), "id", "s", "y", 5, 1)
    assert null.count() == 5


def test_math_answers():
    from spanlens.functions.mathtext import boxed, same_answer

    assert boxed(r"so \boxed 5 ends") == "5" and boxed(r"\boxed{a{b}}") == "a{b}" and boxed("none") is None
    same = [(r"\sqrt{9}", "3"), (r"2\sqrt{2}", r"\sqrt 8"), (r"\frac{\pi}{2}", r"0.5\pi"), (r"\sqrt[3]{27}", "3"), ("x+1", "1+x"), ("2x", r"x\cdot 2"), ("(a+b)^2", "a^2+2*a*b+b^2"), (r"50\%", "0.5")]
    other = [("x+1", "x+2"), ("x", "y"), ("north", "thorn"), ("2", "3"), (r"\sqrt{2}", "1.4")]
    assert all(same_answer(a, b) for a, b in same)
    assert not any(same_answer(a, b) for a, b in other)


def test_pickled_frames(spark, tmp_path):
    import pandas as pd

    from spanlens import sources

    pd.DataFrame({"a": [1, 2], "b": ["x", None]}).to_pickle(tmp_path / "f.pkl")
    assert sorted((r.a, r.b or "") for r in sources.pickled(spark, str(tmp_path / "f.pkl"), "a long, b string").collect()) == [(1, "x"), (2, "")]


def test_masked_words_and_lists(spark):
    assert one(spark, tx.list_items(F.col("t")), t="['a, b', \"c\", 4]") == ["a, b", "c", "4"]
    assert one(spark, tx.list_items(F.col("t")), t="[broken") == ["[broken"] and one(spark, tx.list_items(F.col("t")), t="[]") == []
