"""Queries of deterministic resampling, and of models and simulations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agree, learned, rank, resample
from .contracts import auc_sql, kappa_sql, pairs, pairs_sql, r9
from .registry import query

#: Draws of queries that list them, and of those that take an interval.
DRAWS, MANY = 50, 200
P = "WITH " + pairs_sql()
_HASH = "CAST(('0x' || substring(md5({t}), 1, 8)) AS BIGINT)"


def _hash(*parts: str) -> str:
    return _HASH.format(t=" || '-' || ".join(f"CAST({p} AS VARCHAR)" for p in parts))


_SLOT = f"{_hash(chr(39) + 'slot' + chr(39), 'id')}, id"
_ROWS = f"n AS (SELECT *, row_number() OVER (ORDER BY {_SLOT}) - 1 AS i, count(*) OVER () AS size FROM pair), " + "dr AS (SELECT unnest(range(0, {k})) AS draw)"
_WEIGHTS = f"w AS (SELECT draw, {_hash(chr(39) + 's' + chr(39), 'draw', 'i')} % size AS i, count(*) AS w FROM n, dr GROUP BY ALL)"


def _weighted(src: str, s: str, y: str) -> str:
    """(draw, auc)."""
    return f"""(SELECT draw, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN sum(p * (below + q / CAST(2 AS DOUBLE))) / (CAST(sum(p) AS DOUBLE) * sum(q)) END AS auc FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY draw ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT draw, {s} AS s, sum(w * {y}) AS p, sum(w * (1 - {y})) AS q FROM {src} GROUP BY draw, {s})) GROUP BY draw)"""


_DRAWN = f"{_ROWS.format(k=DRAWS)}, {_WEIGHTS}, x AS (SELECT w.draw, w.w, n.s, n.y, n.z_comp FROM w JOIN n USING (i))"
_INTERVAL = _DRAWN.replace(f"range(0, {DRAWS})", f"range(0, {MANY})")


@query(f"{P}, {_DRAWN} SELECT draw, round(auc, 9) AS auc FROM {_weighted('x', 's', 'y')}")
def bootstrap_auc(spark: SparkSession, d: str) -> DataFrame:
    return resample.bootstrap_auc(pairs(spark, d), "id", "s", "y", DRAWS, "s").select("draw", r9(F.col("auc")).alias("auc"))


@query(
    f"{P}, {_INTERVAL}, g AS (SELECT draw, abs(a.auc - 0.5) - abs(b.auc - 0.5) AS g FROM {_weighted('x', 's', 'z_comp')} a JOIN {_weighted('x', 's', 'y')} b USING (draw)) "
    "SELECT count(g) AS draws, round(avg(g), 9) AS mean, round(stddev_samp(g), 9) AS sd, round(quantile_cont(g, 0.025), 9) AS lo, round(quantile_cont(g, 0.975), 9) AS hi FROM g"
)
def paired_gap_interval(spark: SparkSession, d: str) -> DataFrame:
    g = resample.paired_gap(pairs(spark, d), "id", "s", "z_comp", "y", MANY, "s")
    return resample.interval(g, "robust_gap").select("draws", *(r9(F.col(c)).alias(c) for c in ("mean", "sd", "lo", "hi")))


def _permuted(z: str, seed: str, strata: str, k: int = DRAWS) -> str:
    """dr, pm: each draw's rows with zp, the permuted z: 1 for the least hashes of a stratum."""
    by = f"PARTITION BY draw{strata}"
    return f"dr AS (SELECT unnest(range(0, {k})) AS draw), pm AS (SELECT *, CAST(row_number() OVER ({by} ORDER BY {_hash(chr(39) + seed + chr(39), 'draw', 'id')}, id) <= sum({z}) OVER ({by}) AS INT) AS zp, 1 AS w FROM pair, dr)"


@query(f"{P}, {_permuted('z_comp', 'n', ', y')} SELECT draw, round(auc, 9) AS auc FROM {_weighted('pm', 's', 'zp')}")
def stratified_null(spark: SparkSession, d: str) -> DataFrame:
    return resample.stratified_null(pairs(spark, d), "id", "s", "z_comp", "y", DRAWS, "n").select("draw", r9(F.col("auc")).alias("auc"))


_SWAP = f"{_hash(chr(39) + 'w' + chr(39), 'draw', 'id')} % 2 = 1"


@query(f"{P}, dr AS (SELECT unnest(range(0, {DRAWS})) AS draw), x AS (SELECT draw, s, 1 AS w, CASE WHEN {_SWAP} THEN y ELSE z_comp END AS z, CASE WHEN {_SWAP} THEN z_comp ELSE y END AS y FROM pair, dr) SELECT draw, round(a.auc - b.auc, 9) AS gap FROM {_weighted('x', 's', 'z')} a JOIN {_weighted('x', 's', 'y')} b USING (draw)")
def label_swap(spark: SparkSession, d: str) -> DataFrame:
    return resample.label_swap(pairs(spark, d), "id", "s", "z_comp", "y", DRAWS, "w").select("draw", r9(F.col("gap")).alias("gap"))


@query(
    f"{P}, c AS (SELECT source, row_number() OVER (ORDER BY {_hash(chr(39) + 'slot' + chr(39), 'source')}, source) - 1 AS i, count(*) OVER () AS size FROM (SELECT DISTINCT source FROM pair)), dr AS (SELECT unnest(range(0, {DRAWS})) AS draw), "
    f"w AS (SELECT draw, {_hash(chr(39) + 'c' + chr(39), 'draw', 'i')} % size AS i, count(*) AS w FROM c, dr GROUP BY ALL), x AS (SELECT draw, w, s, y FROM w JOIN c USING (i) JOIN pair USING (source)) SELECT draw, round(auc, 9) AS auc FROM {_weighted('x', 's', 'y')}"
)
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    drawn = resample.cluster_weights(p, "source", DRAWS, "c").join(p, "source")
    return resample.weighted_auc(drawn, "s", "y", "w", ["draw"]).select("draw", r9(F.col("auc")).alias("auc"))


@query(f"{P}, k AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY s DESC, id) AS r FROM pair WHERE y = 1) WHERE r <= 20), x AS (SELECT s, y FROM k UNION ALL SELECT s, y FROM pair WHERE y = 0) SELECT n, n_pos, round(auc, 9) AS auc FROM {auc_sql('x', 's', 'y')}")
def rate_control_subsample(spark: SparkSession, d: str) -> DataFrame:
    kept = resample.downsample(pairs(spark, d), "id", "s", "y", 20, "favourable")
    return rank.auc(kept, "s", ["y"]).select("n", F.col("n_y").alias("n_pos"), r9(F.col("auc_y")).alias("auc"))


_STEPS = (0, 5, 10, 20)


@query(
    f"{P}, r AS (SELECT *, CASE WHEN y = 1 THEN row_number() OVER (PARTITION BY y ORDER BY s, id) ELSE row_number() OVER (PARTITION BY y ORDER BY s DESC, id) END AS r FROM pair), "
    f"x AS (SELECT v.t AS draw, s, CASE WHEN r <= v.t THEN 1 - y ELSE y END AS y, 1 AS w FROM r, (VALUES {', '.join(f'({t})' for t in _STEPS)}) AS v(t)) SELECT draw AS t, round(auc, 9) AS auc FROM {_weighted('x', 's', 'y')}"
)
def adversarial_swap(spark: SparkSession, d: str) -> DataFrame:
    return resample.adversarial_swap(pairs(spark, d), "id", "s", "y", _STEPS).select("t", r9(F.col("auc")).alias("auc"))


_U = f"({_hash(chr(39) + 'f' + chr(39), 'id')} / CAST(4294967296 AS DOUBLE))"


@query(f"{P}, f AS (SELECT *, CASE WHEN y = 0 THEN CAST({_U} < 0.05 AS INT) ELSE CAST({_U} >= 0.2 AS INT) END AS noisy FROM pair) SELECT CAST(sum(noisy) AS BIGINT) AS noisy_pos, round({kappa_sql('noisy', 'y')}, 9) AS kappa FROM f")
def label_noise(spark: SparkSession, d: str) -> DataFrame:
    f = resample.noise(pairs(spark, d), "id", "y", 0.05, 0.2, "f")
    k = agree.kappa(f, "noisy", "y").select(r9(F.col("kappa")).alias("kappa"))
    return f.agg(F.sum("noisy").cast("bigint").alias("noisy_pos")).crossJoin(k)


_E = "e AS (SELECT user_id AS g, event_id AS id, value AS s, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM events)"


@query(
    f"WITH {_E}, dr AS (SELECT unnest(range(0, 10)) AS draw), o AS (SELECT *, row_number() OVER (PARTITION BY draw, g ORDER BY {_hash(chr(39) + 'b' + chr(39), 'draw', 'id')}, id) AS o FROM e, dr), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY draw, g ORDER BY s DESC, id) AS k FROM o WHERE o <= 4), p AS (SELECT draw, g, max(CASE WHEN k = 1 THEN y END) AS picked, avg(CAST(y AS DOUBLE)) AS base FROM t GROUP BY draw, g) "
    "SELECT draw, count(*) AS groups, round(avg(picked), 9) AS picked_rate, round(avg(base), 9) AS base_rate FROM p GROUP BY draw"
)
def best_of_n_draws(spark: SparkSession, d: str) -> DataFrame:
    from .audits import _purchases

    out = resample.best_of_n(_purchases(spark, d), "id", "g", "s", "y", 4, 10, "b")
    return out.select("draw", "groups", r9(F.col("picked_rate")).alias("picked_rate"), r9(F.col("base_rate")).alias("base_rate"))


@query()
def oof_logistic(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).select("id", "y", *(F.col(c).cast("double").alias(c) for c in ("s", "z_ext", "len", "q")))
    return learned.oof_logistic(p, "id", ["s", "z_ext", "len", "q"], "y").select("id", "y", "fold", F.round("score", 6).alias("score"))


@query(
    f"{P}, {_permuted('y', 'q', '', 200)}, r AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS ra, row_number() OVER (ORDER BY len DESC, id) AS rb FROM pair) "
    "SELECT draw, CAST(sum(CASE WHEN ra <= 50 THEN zp ELSE 0 END) - sum(CASE WHEN rb <= 50 THEN zp ELSE 0 END) AS BIGINT) AS diff FROM pm JOIN r USING (id) WHERE ra <= 50 OR rb <= 50 GROUP BY draw"
)
def queue_difference(spark: SparkSession, d: str) -> DataFrame:
    return resample.queue_difference(pairs(spark, d), "id", "s", "len", "y", 50, 200, "q")


@query(f"{P}, {_DRAWN.replace('n.z_comp FROM', 'n.z_comp, n.len FROM')} SELECT draw, round(a.auc, 9) AS auc_before, round(b.auc, 9) AS auc_after, round(b.auc - a.auc, 9) AS change FROM {_weighted('x', 's', 'y')} a JOIN {_weighted('x', 'len', 'y')} b USING (draw)")
def paired_change(spark: SparkSession, d: str) -> DataFrame:
    out = resample.paired_change(pairs(spark, d), "id", "s", "len", "y", DRAWS, "s")
    return out.select("draw", *(r9(F.col(c)).alias(c) for c in ("auc_before", "auc_after", "change")))
