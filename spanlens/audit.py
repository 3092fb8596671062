"""The audit of record files in one call: files in, fields found, one report out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources
from .functions import stats
from .operators import agree, align, rank
from .operators import verdict as vd

# Names under which files may have their fields, in the order in which they are looked for.
PAIR_FIELDS = ("disagreement", "surface_disagreement", "semantic_disagreement", "label", "y")
SIDE_A_FIELDS = ("label_a", "a_label", "surface_a", "semantic_a", "refusal_a", "model_a_label")
SIDE_B_FIELDS = ("label_b", "b_label", "surface_b", "semantic_b", "refusal_b", "model_b_label")
SCORE_FIELDS = ("score", "disagreement_score", "route_score", "distance", "similarity")


def _known(c: str) -> Column:
    """A label as 0 or 1; a missing one is an error, as an unreadable one is."""
    return F.coalesce(align.parse_bool(c), F.raise_error(F.lit(f"no label in {c}")).cast("boolean")).cast("int")


def labels(rows: DataFrame, key: str, name: str, field: str | None = None) -> DataFrame:
    """key, name (whether the sides differ), name_a, name_b: from a field on the pair, where there is one (then the sides are null), else from both sides' labels."""
    found = field or next((f for f in PAIR_FIELDS if f in rows.columns), None)
    if found:
        none = F.lit(None).cast("int")
        return rows.select(key, _known(found).alias(name), none.alias(f"{name}_a"), none.alias(f"{name}_b"))
    sides = rows.select(key, _known(align.choose_field(rows, SIDE_A_FIELDS)).alias(f"{name}_a"), _known(align.choose_field(rows, SIDE_B_FIELDS)).alias(f"{name}_b"))
    return sides.withColumn(name, (F.col(f"{name}_a") != F.col(f"{name}_b")).cast("int")).select(key, name, f"{name}_a", f"{name}_b")


def contract(spark: SparkSession, outputs: str, surface: str, semantic: str, scores: str, key: str = "id", score_field: str | None = None, surface_field: str | None = None, semantic_field: str | None = None, lower: bool = False) -> DataFrame:
    """key, raw, metric, surface and semantic with their sides: what the four files have in common. Missing and repeated keys are errors, and so is no common key."""
    read = lambda path: align.assert_unique(sources.read_rows(spark, path), key)
    scored = read(scores)
    raw = F.col(score_field or align.choose_field(scored, SCORE_FIELDS)).cast("double")
    parts = [read(outputs).select(key), labels(read(surface), key, "surface", surface_field), labels(read(semantic), key, "semantic", semantic_field), scored.select(key, raw.alias("raw"))]
    return sources.kept(align.inner(parts, key).withColumn("metric", -F.col("raw") if lower else F.col("raw")), "audit")


def summary(rows: DataFrame, fail_auc: float = 0.15, warn_auc: float = 0.10, warn_ap: float = 0.10, low_kappa: float = 0.20) -> DataFrame:
    """One row: n, positives, AUC and AP of either label, gaps, kappas of the pair and of each side, their mean, status."""
    a = rank.auc(rows, "metric", ["surface", "semantic"])
    for y in ("surface", "semantic"):
        a = a.crossJoin(rank.average_precision(rows, "metric", y).select(F.col("ap").alias(f"ap_{y}")))  # single rows throughout
    for side in ("", "_a", "_b"):
        counts = rows.agg(*(c.alias(n) for n, c in agree.cells(f"surface{side}", f"semantic{side}").items()))
        a = a.crossJoin(counts.select(stats.kappa(*(F.col(c) for c in ("n11", "n10", "n01", "n00"))).alias(f"kappa{side or '_pair'}")))
    ks = F.array_compact(F.array("kappa_a", "kappa_b"))
    mean = F.when(F.size(ks) > 0, F.aggregate(ks, F.lit(0.0), lambda x, k: x + k) / F.size(ks))
    gap, ap = F.col("auc_surface") - F.col("auc_semantic"), F.col("ap_surface") - F.col("ap_semantic")
    a = a.withColumn("kappa_sides", mean).withColumn("auc_gap", gap).withColumn("ap_gap", ap)
    return a.withColumn("status", vd.screen(F.col("auc_gap"), F.col("ap_gap"), F.coalesce("kappa_sides", "kappa_pair"), fail_auc, warn_auc, warn_ap, low_kappa))


def routed(rows: DataFrame, key: str, sizes: Sequence[int]) -> DataFrame:
    """budget, routed, n_semantic, n_surface, n_both, n_neither, mean_metric of the first rows by score, ties by key."""
    states = rows.withColumns({"both": ((F.col("semantic_a") == 1) & (F.col("semantic_b") == 1)).cast("int"), "neither": ((F.col("semantic_a") == 0) & (F.col("semantic_b") == 0)).cast("int")})
    top = rank.composition(states, "metric", key, ["semantic", "surface", "both", "neither"], sizes)
    return top.withColumnRenamed("mean_score", "mean_metric")


def audit(spark: SparkSession, outputs: str, surface: str, semantic: str, scores: str, out: str | None = None, budgets: str = "10,0.05", key: str = "id", **how) -> tuple[DataFrame, DataFrame]:
    """(summary, routed) of four record files; with `out`, both are written there as JSON reports. `how`: the fields and direction of `contract`."""
    rows = contract(spark, outputs, surface, semantic, scores, key, **how)
    n = rows.agg(F.count("*").alias("n"), F.sum("semantic").alias("p")).first()  # one row
    one, many = summary(rows), routed(rows, key, rank.budgets(budgets, n.n, n.p))
    if out:
        sources.write_report(one, f"{out}/summary.json", {"audit": "surface and semantic labels"})
        sources.write_report(many, f"{out}/routed.json", {"audit": "first rows by score"})
    return one, many
