"""Calibration and threshold sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_p, rate: bins by exact quantile edges, equal edges merged; a value on an edge belongs to the bin above."""
    cuts = [k / bins for k in range(1, bins)]
    edges = df.agg(F.array_distinct(F.percentile(p, F.array(*map(F.lit, cuts)))).alias("edges"))  # one row
    binned = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col(p))))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def calibration_error(curve: DataFrame) -> DataFrame:
    """n, ece: bins' |mean_p - rate| weighted by rows."""
    return curve.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def brier(df: DataFrame, p: str, y: str) -> DataFrame:
    """n, brier, skill against the base rate."""
    one = F.col(y).cast("double")
    t = df.agg(F.count("*").alias("n"), F.avg((F.col(p) - one) * (F.col(p) - one)).alias("brier"), F.avg(one).alias("rate"))
    base = F.col("rate") * (1 - F.col("rate"))
    return t.select("n", "brier", F.when(base > 0, 1 - F.col("brier") / base).alias("skill"))


def threshold_sweep(df: DataFrame, s: str, y: str, cuts: Sequence[float]) -> DataFrame:
    """cut, flagged, precision, recall, f1 of s >= cut: conditional sums in one pass, no row is multiplied."""
    one = F.col(y).cast("int")
    aggs = [F.sum(one).alias("pos")]
    for k, c in enumerate(cuts):
        hit = F.col(s) >= c
        aggs += [F.count_if(hit).alias(f"f{k}"), F.count_if(hit & (one == 1)).alias(f"t{k}")]
    t = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(float(c)).alias("cut"), F.col(f"f{k}").alias("flagged"), F.col(f"t{k}").alias("tp"), F.col("pos").alias("pos")) for k, c in enumerate(cuts)))
    r = t.select(F.explode(rows).alias("r")).select("r.*")
    precision, recall = F.when(F.col("flagged") > 0, F.col("tp") / F.col("flagged")), F.when(F.col("pos") > 0, F.col("tp") / F.col("pos"))
    return r.select("cut", "flagged", precision.alias("precision"), recall.alias("recall"), F.when(F.col("flagged") + F.col("pos") > 0, 2 * F.col("tp") / (F.col("flagged") + F.col("pos"))).alias("f1"))


def platt(df: DataFrame, s: str, y: str) -> DataFrame:
    """Adds p: the score through a one-feature logistic regression."""
    from .learned import fit_logistic, predict

    return predict(fit_logistic(df, [s], y, balanced=False), df, [s]).withColumnRenamed("__p", "p")
