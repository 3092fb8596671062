"""Agreement: contingency tables, kappas, rater matrices, effect sizes, correlations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats


def cells(a: str, b: str) -> dict[str, Column]:
    """The four counts of two 0/1 columns as aggregates; rows with a null are left out."""
    x, y = F.col(a).cast("int"), F.col(b).cast("int")
    return {f"n{i}{j}": F.count_if((x == i) & (y == j)) for i in (1, 0) for j in (1, 0)}


def contingency(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*(c.alias(n) for n, c in cells(a, b).items()))


def kappa(df: DataFrame, a: str, b: str, keys: Sequence[str] = (), least: int = 1) -> DataFrame:
    """keys, n, agreement, kappa; groups under `least` rows are left out."""
    t = contingency(df, a, b, keys)
    n11, n10, n01, n00 = (F.col(c) for c in ("n11", "n10", "n01", "n00"))
    n = n11 + n10 + n01 + n00
    return t.select(*keys, n.alias("n"), ((n11 + n00) / n).alias("agreement"), stats.kappa(n11, n10, n01, n00).alias("kappa")).filter(F.col("n") >= least)


def confusion(df: DataFrame, truth: str, said: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, tp, fp, fn, tn, accuracy, precision, recall, fpr, fnr, mcc, mutual_information (null or 0 where a margin is empty)."""
    t = contingency(df, truth, said, keys).withColumnsRenamed({"n11": "tp", "n10": "fn", "n01": "fp", "n00": "tn"})
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    return t.select(
        *keys, "tp", "fp", "fn", "tn",
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(fp, fp + tn).alias("fpr"), ratio(fn, fn + tp).alias("fnr"), stats.mcc(tp, fn, fp, tn).alias("mcc"),
        stats.mutual_information(tp, fn, fp, tn).alias("mutual_information"),
    )


def fleiss(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """n, mean_agreement, fleiss_kappa of complete 0/1 ratings."""
    k = len(raters)
    ones = sum((F.col(r).cast("int") for r in raters[1:]), F.col(raters[0]).cast("int"))
    t = df.dropna(subset=list(raters)).select(ones.alias("c"))
    t = t.groupBy("c").agg(F.count("*").alias("m"))
    own = (F.col("c") * F.col("c") + (k - F.col("c")) * (k - F.col("c")) - k) / F.lit(float(k * (k - 1)))
    agg = t.agg(F.sum("m").alias("n"), (F.sum(own * F.col("m")) / F.sum("m")).alias("mean_agreement"), (F.sum(F.col("c") * F.col("m")) / (F.sum("m") * k)).alias("p1"))
    expected = F.col("p1") * F.col("p1") + (1 - F.col("p1")) * (1 - F.col("p1"))
    return agg.select("n", "mean_agreement", F.when(expected < 1, (F.col("mean_agreement") - expected) / (1 - expected)).alias("fleiss_kappa"))


def rater_pairs(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """rater_a, rater_b, n, agreement, kappa of each pair, from one pass."""
    pairs = [(a, b) for i, a in enumerate(raters) for b in raters[i + 1 :]]
    one = df.agg(*(c.alias(f"{p}_{n}") for p, (a, b) in enumerate(pairs) for n, c in cells(a, b).items()))
    rows = F.array(*(F.struct(F.lit(a).alias("rater_a"), F.lit(b).alias("rater_b"), *(F.col(f"{p}_{n}").alias(n) for n in ("n11", "n10", "n01", "n00"))) for p, (a, b) in enumerate(pairs)))
    t = one.select(F.explode(rows).alias("r")).select("r.*")
    n11, n10, n01, n00 = (F.col(c) for c in ("n11", "n10", "n01", "n00"))
    n = n11 + n10 + n01 + n00
    return t.select("rater_a", "rater_b", n.alias("n"), ((n11 + n00) / n).alias("agreement"), stats.kappa(n11, n10, n01, n00).alias("kappa"))


def cohens_d(df: DataFrame, s: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n1, n0, d of `s` between the two classes."""
    one, zero = F.col(y).cast("int") == 1, F.col(y).cast("int") == 0
    v = F.col(s).cast("double")
    t = df.groupBy(*keys).agg(
        *(f(F.when(c, v)).alias(f"{n}{k}") for k, c in ((1, one), (0, zero)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count)))
    )
    return t.select(*keys, "n1", "n0", stats.cohens_d(F.col("m1"), F.col("v1"), F.col("n1"), F.col("m0"), F.col("v0"), F.col("n0")).alias("d"))


def separation(df: DataFrame, similarity: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cohen's d of a similarity, the alike pairs (y = 0) minus the differing ones."""
    return cohens_d(df, similarity, y, keys).withColumn("d", -F.col("d"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, rho: correlation of the mid-ranks, each from the table of distinct values. Rows meet the ranks as counts of value pairs, so a frequent value is no hot key."""
    from .rank import running

    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("k"))
    ranked = pairs
    for c in ("a", "b"):
        t = running(pairs.groupBy(c).agg(F.sum("k").alias("n")), c, ["n"])
        ranked = ranked.join(t.select(c, (F.col("before_n") + (F.col("n") + 1) / F.lit(2.0)).alias(f"rank_{c}")), c)
    x, y, k = F.col("rank_a"), F.col("rank_b"), F.col("k")
    sums = ranked.agg(F.coalesce(F.sum(k), F.lit(0)).alias("n"), F.sum(k * x * y).alias("xy"), F.sum(k * x * x).alias("xx"), F.sum(k * y * y).alias("yy"))
    off = F.col("n") * (F.col("n") + 1) * (F.col("n") + 1) / F.lit(4.0)  # n times the squared mean of the ranks
    spread = (F.col("xx") - off) * (F.col("yy") - off)
    return sums.select("n", F.when(spread > 0, (F.col("xy") - off) / F.sqrt(spread)).alias("rho"))


def zscore(df: DataFrame, s: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds z_<s>: by the population deviation, 0 where that is 0. The moments are an aggregate joined back, not a window."""
    m = df.groupBy(*keys).agg(F.avg(s).alias("__m"), F.stddev_pop(s).alias("__d"))
    joined = df.join(m, list(keys)) if keys else df.crossJoin(F.broadcast(m))  # without keys one row
    return joined.withColumn(f"z_{s}", F.when(F.col("__d") > 0, (F.col(s) - F.col("__m")) / F.col("__d")).otherwise(F.lit(0.0))).drop("__m", "__d")


def resolve(first: Column, second: Column, third: Column) -> Column:
    """Two raters: what they agree on, the one that is there, else the adjudicator's choice."""
    return F.when(first == second, first).when(first.isNull(), second).when(second.isNull(), first).otherwise(third)


def moving_queue(df: DataFrame, a: str, b: str, tie: str, size: int) -> DataFrame:
    """n, both, overlap of the first `size` rows by `a` and by `b`."""
    from .rank import ranked

    one = ranked(df, a, tie, most=size).select(tie)
    two = ranked(df, b, tie, most=size).select(tie)
    return one.join(two, tie).agg(F.count("*").alias("both")).select("both", (F.col("both") / F.lit(float(size))).alias("overlap"))


def union_ids(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of any of the tables, each once."""
    return reduce(DataFrame.union, tables).distinct()


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, only_in: keys of the first that the second lacks, and the other way round, from one shuffle."""
    both = a.select(key, F.lit(1).alias("s")).union(b.select(key, F.lit(2).alias("s"))).groupBy(key).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return both.filter(F.col("lo") == F.col("hi")).select(key, F.when(F.col("lo") == 1, "first").otherwise("second").alias("only_in"))


def rank_moves(df: DataFrame, a: str, b: str, tie: str) -> DataFrame:
    """rows, moved: how many stand at another rank by `b` than by `a` (ties by `tie`). Ranks come from ranges of the whole order, so a frequent score is no hot key."""
    from .rank import numbered

    rows = df.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(tie).alias("k"))
    for c in ("a", "b"):
        rows = numbered(rows, [F.desc(c), F.asc("k")], f"r_{c}")
    return rows.agg(F.count("*").alias("rows"), F.count_if(F.col("r_a") != F.col("r_b")).alias("moved"))
