"""Multiple testing: Benjamini-Hochberg and interval-to-p."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import normal_tail


def benjamini_hochberg(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """Adds rank, adjusted (running minimum from the largest p), rejected. Tests are a small table: one ordered window."""
    tests = df.filter(F.col(p).isNotNull())
    n = F.count("*").over(W.partitionBy(F.lit(0)))
    up = W.partitionBy(F.lit(0)).orderBy(F.asc(p))
    last = F.rank().over(up) + F.count("*").over(W.partitionBy(p)) - 1  # ties share the largest rank
    t = tests.withColumn("rank", last).withColumn("raw", F.col(p) * n / F.col("rank"))
    down = W.partitionBy(F.lit(0)).orderBy(F.desc(p)).rangeBetween(W.unboundedPreceding, W.currentRow)
    return t.withColumn("adjusted", F.least(F.min("raw").over(down), F.lit(1.0))).withColumn("rejected", F.col("adjusted") <= alpha).drop("raw")


def interval_p(estimate: Column, lo: Column, hi: Column) -> Column:
    """Two-sided p of zero from a 95 % interval, by the normal approximation."""
    se = (hi - lo) / (2 * 1.959964)
    return F.when(se > 0, F.least(2 * normal_tail(F.abs(estimate) / se), F.lit(1.0)))
