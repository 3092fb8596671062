"""Draws on cells, spans, label noise, contracts: against exact distributions and brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlens.operators import cells, contracts, noise, rank, spans
from spanlens.plans import registry
from tests import oracle


def auc(s, y):
    pos, neg = [a for a, b in zip(s, y, strict=True) if b], [a for a, b in zip(s, y, strict=True) if not b]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)) if pos and neg else None


def least(pmf, lo, hi, u):
    f = 0.0
    for k in range(lo, hi + 1):
        f += pmf(k)
        if f >= u:
            return k
    return hi


def test_inverse_distributions(spark):
    """The column's, the arrays' and the exact inverse are one."""
    rng = random.Random(1)
    b, h = [], []
    for _ in range(60):
        n = rng.choice([0, 1, 5, 60, 900])
        c = rng.randint(0, n)
        b.append((n, c, rng.random()))
        h.append((n, c, rng.randint(0, n), rng.random()))
    g = math.comb
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(b)], "i int, n long, c long, u double").select("i", cells.binomial(F.col("n"), F.when(F.col("n") > 0, F.col("c") / F.col("n")).otherwise(0.5), F.col("u")).alias("k")).orderBy("i").collect()
    for (n, c, u), r in zip(b, got, strict=True):
        p = c / n if n else 0.5
        assert r.k == least(lambda k, n=n, p=p: g(n, k) * p**k * (1 - p) ** (n - k), 0, n, u)
        if n and 0 < c:
            assert cells._binomials(np.array([n]), c, n, np.array([u]))[0] == r.k
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(h)], "i int, n long, c long, t long, u double").select("i", cells.hypergeometric(F.col("n"), F.col("c"), F.col("t"), F.col("u")).alias("k")).orderBy("i").collect()
    for (n, c, t, u), r in zip(h, got, strict=True):
        assert r.k == least(lambda k, n=n, c=c, t=t: g(c, k) * g(n - c, t - k) / g(n, t), max(0, t - (n - c)), min(t, c), u)
        if n:
            assert cells._hypergeometrics(n, c, np.array([t]), np.array([u]))[0] == r.k


def test_deals(spark):
    """Draws hold as many rows as they should, average to the counts, and depend on no partitioning."""
    rows = [(k, s, c) for k, m in (("a", 5), ("b", 300)) for s in range(m) for c in [1 + (s * 7) % 11]]
    t = spark.createDataFrame(rows, "k string, s int, c long")
    size = Counter()
    for k, _, c in rows:
        size[k] += c
    for take in (None, 20):
        df = t if take is None else t.withColumn("take", F.lit(take))
        one, many = ({tuple(r) for r in cells.deal(df.repartition(n), ["s"], 80, "x", ["k"], take and "take").collect()} for n in (1, 5))
        assert one == many
        total, mean = Counter(), Counter()
        for k, draw, s, w in one:
            total[k, draw] += w
            mean[k, s] += w / 80
        assert all(total[k, d] == (take or size[k]) for k in size for d in range(80))
        for k, s, c in rows:
            expected = c * (take or size[k]) / size[k]
            assert abs(mean[k, s] - expected) < 5 * math.sqrt(expected / 80) + 0.05
    whole = cells.deal(t.withColumn("take", F.lit(10_000)), ["s"], 2, "x", ["k"], "take")
    assert {(r.k, r.s, r.w) for r in whole.collect()} == set(rows)  # no more than there are
    assert cells.deal(t.limit(0), ["s"], 3, "x").count() == 0


def test_weighted_aucs(spark):
    rng = random.Random(2)
    rows = [(d, rng.randint(0, 9) / 2, rng.randint(0, 1), rng.randint(1, 4)) for d in range(3) for _ in range(60)] + [(9, 1.0, 1, 1)]
    t = cells.ranged(spark.createDataFrame(rows, "d int, s double, y int, w long"), "s", ["d"])
    got = {r.d: r.auc_y for r in cells.aucs(t, "s", ["y"], ["d"]).collect()}
    for d in range(3):
        s, y = zip(*((s, y) for e, s, y, w in rows for _ in range(w) if e == d), strict=True)
        assert got[d] == pytest.approx(auc(s, y))
    assert got[9] is None


def test_offsets_say_what_spans_hold(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 25))) for _ in range(120)] + ["", "ab", "é ab"]
    cues = ["ab", "cca"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", *spans.offset_index(F.col("t"), cues))
    for r in df.collect():
        for k in range(27):
            assert (r.first_end is not None and r.first_end <= k) == any(c in texts[r.i][:k] for c in cues)
            assert (r.last_start is not None and r.last_start >= k) == any(c in texts[r.i][k:] for c in cues)


def test_walk_reads_the_texts_once(spark):
    """Beyond the cells, the walk's plan scans nothing but what was written."""
    p = spark.range(300).select((F.col("id") % 7).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.when(F.col("id") % 5 > 0, F.col("id") % 40).alias("first_end"), F.when(F.col("id") % 5 > 0, F.col("id") % 60).alias("last_start"))
    seen = spark.sparkContext.accumulator(0)
    rows = p.filter(F.udf(lambda _: seen.add(1) or True, "boolean")("s"))
    walked = spans.walk(rows, "s", "y", (5, 10, 20, 39), 20, "w")
    out = walked.orderBy("i").collect()
    assert seen.value == 300 and [r.span for r in out] == [5, 10, 20, 39] and len({r.auc_z for r in out}) == 4
    flat = spans.closure(spark.createDataFrame([(i, s, g, c, st) for i, (s, g, c, st) in enumerate([(10, 0.3, 0.1, "coupled"), (20, 0.1, 0.2, "coupled"), (30, 0.0, 0.4, "no proxy variation"), (40, -0.1, 0.6, "clear"), (50, 0.2, 0.7, "coupled")])], "i int, span int, gap double, coverage double, status string")).first()
    assert (flat.last_coupled, flat.first_clear, flat.closure) == (20, 40, 30.0) and flat.zero_crossing == pytest.approx(30.0) and flat.coverage == pytest.approx(0.4)


@pytest.mark.parametrize("seed", [0, 1])
def test_least_swaps_by_trying_all(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randint(0, 12), rng.randint(0, 1)) for i in range(70)]
    asked = [0.2, 0.5, 0.6, 0.75, 0.9, 0.999, 1.1]
    got = {r.target: r for r in noise.swap_targets(spark.createDataFrame(rows, "i int, s int, y int"), "s", "y", asked).collect()}
    lows = [i for i, s, y in sorted(rows, key=lambda r: (r[1], r[0])) if y]
    highs = [i for i, s, y in sorted(rows, key=lambda r: (-r[1], r[0])) if not y]
    curve = []
    for t in range(min(len(lows), len(highs)) + 1):
        flipped = {*lows[:t], *highs[:t]}
        curve.append(auc([s for _, s, _ in rows], [1 - y if i in flipped else y for i, _, y in rows]))
    for x in asked:
        best = next((t for t, v in enumerate(curve) if v >= x - 1e-9), None)
        assert got[x].min_swaps == best
        if best is not None:
            assert got[x].auc_at == pytest.approx(curve[best]) and got[x].min_flips == 2 * best
    none = noise.swap_targets(spark.createDataFrame([(1, 1, 1)], "i int, s int, y int"), "s", "y", [0.5]).first()
    assert none.auc is None and none.min_swaps is None


def test_worst_flips_by_hand(spark):
    rows = [(1, 5, 1), (2, 4, 1), (3, 3, 0), (4, 2, 0), (5, 1, 0)]
    got = {(r.down, r.up): r.auc for r in noise.worst_flips(spark.createDataFrame(rows, "i int, s int, y int"), "s", "y", [(0, 0), (1, 0), (0, 1), (1, 1), (9, 9)]).collect()}
    assert got == {(0, 0): 1.0, (1, 0): auc([5, 4, 3, 2, 1], [0, 1, 0, 0, 0]), (0, 1): auc([5, 4, 3, 2, 1], [1, 1, 0, 0, 1]), (1, 1): auc([5, 4, 3, 2, 1], [0, 1, 0, 0, 1]), (9, 9): 0.0}



def test_shuffles_know_both_sides(spark):
    df = spark.range(200).select(F.col("id").alias("s"), (F.col("id") < 60).cast("int").alias("low"), (F.col("id") % 3 == 0).cast("int").alias("even"))
    low, even = (noise.shuffle_p(df, "s", y, 200, "t").first() for y in ("low", "even"))
    assert low.auc == 0.0 and low.p_one == 1.0 and low.p_two == 0.0
    assert 0.3 < even.p_two <= 1 and abs(even.null_mean - 0.5) < 0.02


def test_a_frequent_score_is_no_hot_key(spark):
    """Half of the rows on one score: ranks are those of one sort, and no range holds the half."""
    df = spark.range(4000).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, F.lit(0.44)).otherwise(F.col("id") / 4000).alias("s"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = rank.numbered(df, [F.desc("s"), F.asc("k")]).cache()
        per = [r["count"] for r in got.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()]
        ranks = {r.k: r.rk for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        got.unpersist()
    expected = sorted(((-(0.44 if k % 2 == 0 else k / 4000), k) for k in range(4000)))
    assert [ranks[k] for _, k in expected] == list(range(1, 4001))
    assert max(per) < 1500


def test_thinned_contracts(spark):
    grid = spark.createDataFrame([(s, y, s % 2, 1 - s % 2, 1, 0, 4) for s in range(10) for y in (0, 1)], "s long, y int, z int, z_comp int, z_ext int, empty int, c long")
    thin = contracts.thinned(grid, [], 7, 5, "t")
    by = {r.draw: (r.n, r.ones) for r in thin.groupBy("draw").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("y")).alias("ones")).collect()}
    assert by == {d: (80, 7) for d in range(5)}


def test_verdicts_are_reached():
    """The contracts reach every verdict of the second rule, every reason but one, and every exit of the final one; no new oracle is empty."""
    rows = oracle.rows_of_sql(registry.ORACLES["verdict_grid"], "/root/testdata/sf0.01")
    at = {c: {r[i] for r in rows[1]} for i, c in enumerate(rows[0])}
    assert at["v2"] == {"UNDECIDABLE", "SCORE NOT EVIDENCE", "ALIGNED", "MISMATCH", "CAUTION"}
    assert len(at["reason"]) >= 8 and len(at["final"]) >= 10 and len(at["frozen"]) >= 7 and len(at["external"]) == 4 and len(at["earlier"]) == 5
    for name in ("six_way_join", "span_walk", "span_closure_walk", "swap_target", "nested_stability", "bh_contracts", "verdict_tally", "published_versions"):
        assert oracle.rows_of_sql(registry.ORACLES[name], "/root/testdata/sf0.01")[1], name
    walked = oracle.rows_of_sql(registry.ORACLES["span_walk"], "/root/testdata/sf0.01")
    assert len({r[walked[0].index("status")] for r in walked[1]}) >= 3
    shares = oracle.rows_of_sql(registry.ORACLES["nested_stability"], "/root/testdata/sf0.01")
    assert len({r[shares[0].index("verdict")] for r in shares[1]}) >= 3
