"""Queries of rank statistics, agreement, gates and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as tx
from ..operators import agree, calibrate, cells, contracts, multiplicity, rank, resample
from ..operators import verdict as vd
from ..sources import table
from .contracts import auc_sql, kappa_sql, pairs, pairs_sql, r9
from .ladders import chain_sql
from .registry import query
from .resampling import MANY

P = "WITH " + pairs_sql()


@query(f"{P} SELECT n, n_pos, round(auc, 9) AS auc FROM {auc_sql('pair', 's', 'y')}")
def auc_doc_toxic(spark: SparkSession, d: str) -> DataFrame:
    return rank.auc(pairs(spark, d), "s", ["y"]).select("n", F.col("n_y").alias("n_pos"), r9(F.col("auc_y")).alias("auc"))


@query(f"{P} SELECT lang, n, n_pos, round(auc, 9) AS auc FROM {auc_sql('(SELECT lang, z_ext, floor(s / 10) AS s FROM pair)', 's', 'z_ext', 'lang')}")
def auc_ties(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).withColumn("s", F.floor(F.col("s") / 10))
    return rank.auc(p, "s", ["z_ext"], ["lang"]).select("lang", "n", F.col("n_z_ext").alias("n_pos"), r9(F.col("auc_z_ext")).alias("auc"))


_AP = """t AS (SELECT s, count(*) AS n, sum(CAST({y} AS INT)) AS p FROM pair GROUP BY s), c AS (SELECT s, n, p, sum(n) OVER (ORDER BY s DESC) AS cn, sum(p) OVER (ORDER BY s DESC) AS cp FROM t)"""


@query(f"{P}, {_AP.format(y='y')} SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS n_pos, round(sum(p * cp / CAST(cn AS DOUBLE)) / sum(p), 9) AS ap FROM c")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return rank.average_precision(pairs(spark, d), "s", "y").select("n", "n_pos", r9(F.col("ap")).alias("ap"))


@query(f"{P}, {_AP.format(y='q')} SELECT round(sum(p * cp / CAST(cn AS DOUBLE)) / sum(p) / (CAST(sum(p) AS DOUBLE) / sum(n)), 9) AS lift FROM c")
def ap_lift(spark: SparkSession, d: str) -> DataFrame:
    return rank.average_precision(pairs(spark, d), "s", "q").select(r9(F.col("ap") / (F.col("n_pos") / F.col("n"))).alias("lift"))


_TOP = "r AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) AS rk FROM pair)"


@query(f"{P}, {_TOP} SELECT k, count(*) AS n_top, round(avg(CAST(y AS DOUBLE)), 9) AS precision FROM r, (VALUES (5), (20), (50)) AS v(k) WHERE rk <= k GROUP BY k")
def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    return rank.precision_at(pairs(spark, d), "s", "y", "id", [5, 20, 50]).withColumn("precision", r9(F.col("precision")))


@query(
    f"{P}, {_TOP}, {_AP.format(y='y')}, m AS (SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM pair) "
    f"SELECT m.n AS n, m.n_pos AS n_pos, round(CAST(m.n_pos AS DOUBLE) / m.n, 9) AS prevalence, (SELECT round(auc, 9) FROM {auc_sql('pair', 's', 'y')}) AS auc, "
    "(SELECT round(sum(p * cp / CAST(cn AS DOUBLE)) / sum(p), 9) FROM c) AS ap, (SELECT round(avg(CAST(y AS DOUBLE)), 9) FROM r WHERE rk <= m.n_pos) AS precision_at_pos FROM m"
)
def metric_bundle(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    n_pos = p.agg(F.sum("y")).first()[0] or 1
    a = rank.auc(p, "s", ["y"]).select("n", F.col("n_y").alias("n_pos"), r9(F.col("n_y") / F.col("n")).alias("prevalence"), r9(F.col("auc_y")).alias("auc"))
    ap = rank.average_precision(p, "s", "y").select(r9(F.col("ap")).alias("ap"))
    top = rank.precision_at(p, "s", "y", "id", [n_pos]).select(r9(F.col("precision")).alias("precision_at_pos"))
    return a.crossJoin(ap).crossJoin(top)  # single rows


@query(f"{P}, {_TOP} SELECT b AS budget, count(*) AS routed, CAST(sum(y) AS BIGINT) AS n_y, CAST(sum(z_ext) AS BIGINT) AS n_z_ext, CAST(sum(1 - q) AS BIGINT) AS n_low, round(avg(CAST(s AS DOUBLE)), 9) AS mean_score FROM r, (VALUES (10), (40), (100)) AS v(b) WHERE rk <= b GROUP BY b")
def routed_composition(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).withColumn("low", 1 - F.col("q"))
    return rank.composition(p, "s", "id", ["y", "z_ext", "low"], [10, 40, 100]).withColumn("mean_score", r9(F.col("mean_score")))


@query(f"{P}, m AS (SELECT count(*) AS n, sum(y) AS p FROM pair) SELECT DISTINCT CAST(least(greatest(v, 1), n) AS BIGINT) AS budget FROM (SELECT n, unnest([10, CAST(round_even(0.05 * n, 0) AS BIGINT), n, p]) AS v FROM m)")
def budget_resolution(spark: SparkSession, d: str) -> DataFrame:
    m = pairs(spark, d).agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    return spark.createDataFrame([(b,) for b in rank.budgets("10,0.05,1", m.n, m.p or 0)], "budget bigint")


@query(f"{P} SELECT lang, count(*) AS n, round(avg(CASE WHEN z_ext = y THEN 1.0 ELSE 0.0 END), 9) AS agreement, round({kappa_sql('z_ext', 'y')}, 9) AS kappa FROM pair GROUP BY lang")
def pair_kappa(spark: SparkSession, d: str) -> DataFrame:
    return agree.kappa(pairs(spark, d), "z_ext", "y", ["lang"]).select("lang", "n", r9(F.col("agreement")).alias("agreement"), r9(F.col("kappa")).alias("kappa"))


@query(f"{P}, k AS (SELECT {kappa_sql('z', 'z_ext')} AS a, {kappa_sql('z_comp', 'z_ext')} AS b FROM pair) SELECT round((a + b) / 2, 9) AS mean_kappa FROM k")
def side_kappa_mean(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    t = p.agg(*(c.alias(f"{s}{n}") for s in ("z", "z_comp") for n, c in agree.cells(s, "z_ext").items()))
    k = lambda s: stats.kappa(*(F.col(f"{s}{n}") for n in ("n11", "n10", "n01", "n00")))
    return t.select(r9((k("z") + k("z_comp")) / 2).alias("mean_kappa"))


@query(
    f"{P}, c AS (SELECT z_ext + y + (1 - q) AS c FROM pair), a AS (SELECT count(*) AS n, avg((c * c + (3 - c) * (3 - c) - 3) / CAST(6 AS DOUBLE)) AS m, sum(c) / (3 * CAST(count(*) AS DOUBLE)) AS p FROM c) "
    "SELECT n, round(m, 9) AS mean_agreement, round((m - (p * p + (1 - p) * (1 - p))) / (1 - (p * p + (1 - p) * (1 - p))), 9) AS fleiss_kappa FROM a"
)
def fleiss_kappa(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).withColumn("low", 1 - F.col("q"))
    return agree.fleiss(p, ["z_ext", "y", "low"]).select("n", r9(F.col("mean_agreement")).alias("mean_agreement"), r9(F.col("fleiss_kappa")).alias("fleiss_kappa"))


_RATERS = {"z_ext": "z_ext", "y": "y", "low": "(1 - q)"}
_RATER_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS rater_a, '{b}' AS rater_b, count(*) AS n, round(avg(CASE WHEN {x} = {y} THEN 1.0 ELSE 0.0 END), 9) AS agreement, round({kappa_sql(x, y)}, 9) AS kappa FROM pair"
    for i, (a, x) in enumerate(_RATERS.items())
    for b, y in list(_RATERS.items())[i + 1 :]
)


@query(f"{P} {_RATER_SQL}")
def rater_pair_matrix(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).withColumn("low", 1 - F.col("q"))
    return agree.rater_pairs(p, list(_RATERS)).withColumns({c: r9(F.col(c)) for c in ("agreement", "kappa")})


_CONF = "c AS (SELECT count(*) FILTER (y = 1 AND z_ext = 1) AS tp, count(*) FILTER (y = 0 AND z_ext = 1) AS fp, count(*) FILTER (y = 1 AND z_ext = 0) AS fn, count(*) FILTER (y = 0 AND z_ext = 0) AS tn FROM pair)"


@query(f"{P}, {_CONF} SELECT tp, fp, fn, tn, round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 9) AS accuracy, round(tp / CAST(tp + fp AS DOUBLE), 9) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 9) AS recall, round(fp / CAST(fp + tn AS DOUBLE), 9) AS fpr, round(fn / CAST(fn + tp AS DOUBLE), 9) AS fnr FROM c")
def confusion_fpr_fnr(spark: SparkSession, d: str) -> DataFrame:
    c = agree.confusion(pairs(spark, d), "y", "z_ext")
    return c.select("tp", "fp", "fn", "tn", *(r9(F.col(x)).alias(x) for x in ("accuracy", "precision", "recall", "fpr", "fnr")))


def _cell(c: str, row: str, col: str) -> str:
    return f"CASE WHEN {c} > 0 THEN {c} / n * ln({c} * n / (CAST({row} AS DOUBLE) * ({col}))) ELSE 0 END"


@query(
    f"{P}, {_CONF}, e AS (SELECT *, CAST(tp + tn + fp + fn AS DOUBLE) AS n FROM c) SELECT round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc, "
    f"round({_cell('tp', '(tp + fn)', 'tp + fp')} + {_cell('fn', '(tp + fn)', 'fn + tn')} + {_cell('fp', '(fp + tn)', 'tp + fp')} + {_cell('tn', '(fp + tn)', 'fn + tn')}, 9) AS mutual_information FROM e"
)
def mcc_mutual_info(spark: SparkSession, d: str) -> DataFrame:
    c = agree.confusion(pairs(spark, d), "y", "z_ext")
    return c.select(r9(F.col("mcc")).alias("mcc"), r9(F.col("mutual_information")).alias("mutual_information"))


@query(
    f"{P}, g AS (SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, avg(s) FILTER (y = 1) AS m1, avg(s) FILTER (y = 0) AS m0, var_samp(s) FILTER (y = 1) AS v1, var_samp(s) FILTER (y = 0) AS v0 FROM pair) "
    "SELECT n1, n0, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 9) AS d FROM g"
)
def cohens_d(spark: SparkSession, d: str) -> DataFrame:
    return agree.cohens_d(pairs(spark, d), "s", "y").withColumn("d", r9(F.col("d")))


@query(f"{P} SELECT round(corr(len, z_ext), 9) AS length_proxy, round(corr(len, y), 9) AS length_construct, round(corr(len, s), 9) AS length_score FROM pair")
def pearson_length(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return p.agg(*(r9(F.corr(F.col("len").cast("double"), F.col(c).cast("double"))).alias(f"length_{n}") for c, n in (("z_ext", "proxy"), ("y", "construct"), ("s", "score"))))


_MID = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / CAST(2 AS DOUBLE)"


@query(f"{P}, r AS (SELECT {_MID.format(c='s')} AS a, {_MID.format(c='len')} AS b FROM pair) SELECT count(*) AS n, round(corr(a, b), 9) AS rho FROM r")
def spearman_rank(spark: SparkSession, d: str) -> DataFrame:
    return agree.spearman(pairs(spark, d), "s", "len").withColumn("rho", r9(F.col("rho")))


@query(f"{P}, m AS (SELECT avg(s) AS a, stddev_pop(s) AS v FROM pair) SELECT id, round(0.7 * (s - a) / v + 0.3 * z_ext, 9) AS score FROM pair, m")
def zscore_composite(spark: SparkSession, d: str) -> DataFrame:
    return agree.zscore(pairs(spark, d), "s").select("id", r9(0.7 * F.col("z_s") + 0.3 * F.col("z_ext")).alias("score"))


@query(f"{P}, v AS (SELECT lang, s, count(*) AS c FROM pair GROUP BY lang, s) SELECT lang, CAST(sum(c) AS BIGINT) AS n, count(*) AS distinct_scores, round(max(c) / CAST(sum(c) AS DOUBLE), 9) AS modal_share FROM v GROUP BY lang")
def modal_mass(spark: SparkSession, d: str) -> DataFrame:
    return rank.modal(pairs(spark, d), "s", ["lang"]).withColumn("modal_share", r9(F.col("modal_share")))


@query("SELECT lang, count(*) AS n, round(quantile_cont(n_chars, 0.025), 9) AS lo, round(quantile_cont(n_chars, 0.5), 9) AS median, round(quantile_cont(n_chars, 0.975), 9) AS hi FROM documents GROUP BY lang")
def length_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = lambda p: r9(F.percentile("n_chars", F.lit(p)))
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), q(0.025).alias("lo"), q(0.5).alias("median"), q(0.975).alias("hi"))


@query(
    f"{P}, t AS (SELECT c, count(*) FILTER (s >= c) AS flagged, count(*) FILTER (s >= c AND y = 1) AS tp, CAST(sum(y) AS BIGINT) AS pos FROM pair, (VALUES (20.0), (30.0), (40.0)) AS v(c) GROUP BY c) "
    "SELECT CAST(c AS DOUBLE) AS cut, flagged, round(CASE WHEN flagged > 0 THEN tp / CAST(flagged AS DOUBLE) END, 9) AS precision, round(tp / CAST(pos AS DOUBLE), 9) AS recall, round(2 * tp / CAST(flagged + pos AS DOUBLE), 9) AS f1 FROM t"
)
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.threshold_sweep(pairs(spark, d), "s", "y", [20, 30, 40]).withColumns({c: r9(F.col(c)) for c in ("precision", "recall", "f1")})


def _arms(spark: SparkSession, d: str, span: int = 50) -> DataFrame:
    """One row: counts, AUCs and gaps of the contract's arms, agreement of the complement with the construct, shares."""
    p = pairs(spark, d, span)
    a = rank.auc(p, "s", ["z", "z_ext", "z_comp", "y"])
    side = p.agg(F.avg((F.col("len") <= span).cast("double")).alias("empty_share"), *(c.alias(n) for n, c in agree.cells("z_comp", "y").items()))
    on_span = agree.kappa(p, "z", "y").select(F.col("kappa").alias("kappa_z_y"))
    both = a.crossJoin(side).crossJoin(on_span).crossJoin(rank.modal(p, "s").select("modal_share"))  # single rows
    gap = lambda z: stats.robust_gap(F.col(f"auc_{z}"), F.col("auc_y"))
    se, lo, hi = stats.hanley_mcneil(F.col("auc_y"), F.col("n_y"), F.col("n") - F.col("n_y"))
    return both.select(
        "*", (F.col("auc_z") - F.col("auc_y")).alias("d_auc"), gap("z").alias("d_same"), gap("z_ext").alias("d_ext"), gap("z_comp").alias("d_dis"),
        stats.kappa(F.col("n11"), F.col("n10"), F.col("n01"), F.col("n00")).alias("kappa_zc_y"), se.alias("se_y"), lo.alias("lo_y"), hi.alias("hi_y"),
    )


def _arms_sql(span: int = 50) -> str:
    hm = "(auc_y * (1 - auc_y) + (n_y - 1) * (auc_y / (2 - auc_y) - auc_y * auc_y) + (n - n_y - 1) * (2 * auc_y * auc_y / (1 + auc_y) - auc_y * auc_y)) / (CAST(n_y AS DOUBLE) * (n - n_y))"
    one = ", ".join(f"(SELECT n_pos FROM {auc_sql('pair', 's', z)}) AS n_{z}, (SELECT auc FROM {auc_sql('pair', 's', z)}) AS auc_{z}" for z in ("z", "z_ext", "z_comp", "y"))
    return f"""WITH {pairs_sql(span)}, a AS (SELECT count(*) AS n, {one}, avg(CASE WHEN len <= {span} THEN 1.0 ELSE 0.0 END) AS empty_share, {kappa_sql('z_comp', 'y')} AS kappa_zc_y, {kappa_sql('z', 'y')} AS kappa_z_y,
        (SELECT max(c) / CAST(sum(c) AS DOUBLE) FROM (SELECT count(*) AS c FROM pair GROUP BY s)) AS modal_share FROM pair),
        b AS (SELECT *, auc_z - auc_y AS d_auc, abs(auc_z - 0.5) - abs(auc_y - 0.5) AS d_same, abs(auc_z_ext - 0.5) - abs(auc_y - 0.5) AS d_ext, abs(auc_z_comp - 0.5) - abs(auc_y - 0.5) AS d_dis, sqrt({hm}) AS se_y FROM a),
        arms AS (SELECT *, auc_y - 1.96 * se_y AS lo_y, auc_y + 1.96 * se_y AS hi_y FROM b)"""


#: Contracts of the driver's tables: spans of the proxy.
_CONTRACTS = (50, 200)
_CELL = ["s", "y", "z", "z_comp", "z_ext", "empty"]


def _chain(spark: SparkSession, d: str, spans: tuple[int, ...] = (50,), ends: bool = True) -> DataFrame:
    """Contract rows of spans, with (for rules that read them) bootstrap intervals of the construct's AUC and of the off-span gap, and the null of that gap with z_comp permuted within the construct's strata: all from one table of cells."""
    rows = [pairs(spark, d, k).select(F.lit(k).alias("span"), "s", "y", "z", "z_comp", "z_ext", (F.col("len") <= k).cast("int").alias("empty")) for k in spans]
    return contracts.chain(cells.cells(reduce(DataFrame.union, rows), _CELL, ["span"]), ["span"], MANY, ends)


def _chain_sql(spans: tuple[int, ...] = (50,)) -> str:
    rows = " UNION ALL ".join(f"SELECT * FROM (WITH {pairs_sql(k)} SELECT {k} AS span, CAST(s AS BIGINT) AS s, y, z, z_comp, z_ext, CAST(len <= {k} AS INT) AS empty FROM pair)" for k in spans)
    return f"WITH src AS MATERIALIZED (SELECT *, count(*) AS c FROM ({rows}) GROUP BY ALL), {chain_sql(('span',), MANY)}"


_DOUBLES = ("auc_z", "auc_z_ext", "auc_z_comp", "auc_y", "d_auc", "d_same", "d_ext", "d_dis", "kappa_zc_y", "empty_share", "modal_share")


@query(_arms_sql() + " SELECT n, n_z, n_z_comp, n_y, " + ", ".join(f"round({c}, 9) AS {c}" for c in _DOUBLES) + " FROM arms")
def complement_arms(spark: SparkSession, d: str) -> DataFrame:
    return _arms(spark, d).select("n", "n_z", "n_z_comp", "n_y", *(r9(F.col(c)).alias(c) for c in _DOUBLES))


@query("SELECT k AS span, round(avg(CASE WHEN length(coalesce(text, '')) <= k THEN 1.0 ELSE 0.0 END), 9) AS empty_share FROM documents, (VALUES (50), (200), (800)) AS v(k) GROUP BY k")
def empty_complement_share(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").agg(*(F.avg((F.length(tx.body("text")) <= k).cast("double")).alias(str(k)) for k in (50, 200, 800)))
    return t.select(F.explode(F.array(*(F.struct(F.lit(k).alias("span"), r9(F.col(str(k))).alias("empty_share")) for k in (50, 200, 800)))).alias("r")).select("r.*")


@query(_arms_sql(200) + " SELECT round(d_same, 9) AS d_same, round(d_ext, 9) AS d_ext, round(d_dis, 9) AS d_dis FROM arms")
def orientation_gap(spark: SparkSession, d: str) -> DataFrame:
    return _arms(spark, d, 200).select(*(r9(F.col(c)).alias(c) for c in ("d_same", "d_ext", "d_dis")))


@query(_arms_sql() + " SELECT round(auc_y, 9) AS auc, round(se_y, 9) AS se, round(lo_y, 9) AS lo, round(hi_y, 9) AS hi, CASE WHEN hi_y < 0.5 THEN 'reversed' WHEN lo_y > 0.5 THEN 'forward' ELSE 'unranked' END AS orientation FROM arms")
def hanley_mcneil(spark: SparkSession, d: str) -> DataFrame:
    a = _arms(spark, d)
    return a.select(r9(F.col("auc_y")).alias("auc"), r9(F.col("se_y")).alias("se"), r9(F.col("lo_y")).alias("lo"), r9(F.col("hi_y")).alias("hi"), vd.orientation(F.col("lo_y"), F.col("hi_y")).alias("orientation"))


_Z = stats.Z95


@query(
    f"{P}, c AS (SELECT lang, CAST(sum(y) AS BIGINT) AS k, count(*) AS n FROM pair GROUP BY lang), w AS (SELECT *, k / CAST(n AS DOUBLE) AS p FROM c) "
    f"SELECT lang, k, n, round((p + {_Z * _Z} / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4 * CAST(n AS DOUBLE) * n))) / (1 + {_Z * _Z} / n), 9) AS lo, round((p + {_Z * _Z} / (2 * n) + {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4 * CAST(n AS DOUBLE) * n))) / (1 + {_Z * _Z} / n), 9) AS hi FROM w"
)
def wilson_interval(spark: SparkSession, d: str) -> DataFrame:
    t = pairs(spark, d).groupBy("lang").agg(F.sum("y").cast("bigint").alias("k"), F.count("*").alias("n"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return t.select("lang", "k", "n", r9(lo).alias("lo"), r9(hi).alias("hi"))


@query(f"{P} SELECT source, count(*) AS n, CAST(sum(y) AS BIGINT) AS y_pos, CAST(sum(z_comp) AS BIGINT) AS z_pos, sum(y) < 10 OR count(*) - sum(y) < 10 AS underpowered, sum(z_comp) < 10 OR count(*) - sum(z_comp) < 10 AS proxy_underpowered FROM pair GROUP BY source")
def power_gate(spark: SparkSession, d: str) -> DataFrame:
    t = pairs(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum("y").cast("bigint").alias("y_pos"), F.sum("z_comp").cast("bigint").alias("z_pos"))
    return t.withColumn("underpowered", vd.underpowered(F.col("y_pos"), F.col("n"))).withColumn("proxy_underpowered", vd.underpowered(F.col("z_pos"), F.col("n")))


@query(f"{P}, v AS (SELECT source, s, count(*) AS c, count(*) FILTER (y = 1) AS p FROM pair GROUP BY source, s) SELECT source, round(max(c) / CAST(sum(c) AS DOUBLE), 9) AS modal_share, count(*) FILTER (p > 0) AS distinct_at_positives, max(c) / CAST(sum(c) AS DOUBLE) > 0.5 OR count(*) FILTER (p > 0) <= 1 AS coarse FROM v GROUP BY source")
def resolution_gate(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    at = p.groupBy("source", "s").agg(F.count("*").alias("c"), F.count_if(F.col("y") == 1).alias("p"))
    t = at.groupBy("source").agg((F.max("c") / F.sum("c")).alias("m"), F.count_if(F.col("p") > 0).alias("distinct_at_positives"))
    return t.select("source", r9(F.col("m")).alias("modal_share"), "distinct_at_positives", vd.coarse(F.col("m"), F.col("distinct_at_positives")).alias("coarse"))


_SCREEN = "CASE WHEN coalesce(d_auc >= 0.15 AND kappa <= 0.2, false) THEN 'FAIL' WHEN coalesce(d_auc >= 0.1, false) OR coalesce(d_ap >= 0.1, false) THEN 'WARN' ELSE 'PASS' END"


def _ap_sql(y: str) -> str:
    """(lang, ap)."""
    return f"(SELECT lang, CASE WHEN sum(p) > 0 THEN sum(p * cp / CAST(cn AS DOUBLE)) / sum(p) END AS ap FROM (SELECT lang, n, p, sum(n) OVER w AS cn, sum(p) OVER w AS cp FROM (SELECT lang, s, count(*) AS n, sum({y}) AS p FROM pair GROUP BY lang, s) WINDOW w AS (PARTITION BY lang ORDER BY s DESC)) GROUP BY lang)"


@query(
    f"{P}, a AS (SELECT lang, auc AS az FROM {auc_sql('pair', 's', 'z_ext', 'lang')}), b AS (SELECT lang, auc AS ay FROM {auc_sql('pair', 's', 'y', 'lang')}), k AS (SELECT lang, {kappa_sql('z_ext', 'y')} AS kappa FROM pair GROUP BY lang), "
    f"pz AS (SELECT lang, ap AS pz FROM {_ap_sql('z_ext')}), py AS (SELECT lang, ap AS py FROM {_ap_sql('y')}), g AS (SELECT lang, az - ay AS d_auc, pz - py AS d_ap, kappa FROM a JOIN b USING (lang) JOIN k USING (lang) JOIN pz USING (lang) JOIN py USING (lang)) "
    f"SELECT lang, round(d_auc, 9) AS d_auc, round(d_ap, 9) AS d_ap, round(kappa, 9) AS kappa, {_SCREEN} AS status, CASE WHEN {_SCREEN} = 'FAIL' THEN 'MISMATCH' WHEN {_SCREEN} = 'WARN' THEN 'CAUTION' ELSE 'ALIGNED' END AS repair FROM g"
)
def cli_screen(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    a = rank.auc(p, "s", ["z_ext", "y"], ["lang"]).join(agree.kappa(p, "z_ext", "y", ["lang"]).select("lang", "kappa"), "lang")
    for y in ("z_ext", "y"):
        a = a.join(rank.average_precision(p, "s", y, ["lang"]).select("lang", F.col("ap").alias(f"ap_{y}")), "lang")
    gap, ap = F.col("auc_z_ext") - F.col("auc_y"), F.col("ap_z_ext") - F.col("ap_y")
    return a.select("lang", r9(gap).alias("d_auc"), r9(ap).alias("d_ap"), r9(F.col("kappa")).alias("kappa"), vd.screen(gap, ap, F.col("kappa")).alias("status"), vd.repair(gap, ap, F.col("kappa")).alias("repair"))


_POWER, _COMPLEMENT, _COARSE = "(n_y < 10 OR n - n_y < 10)", "empty_share > 0.15", "modal_share > 0.5"
_BLOCKED = f"({_POWER} OR {_COMPLEMENT} OR n_z_comp = 0 OR n_z_comp = n)"
_V2 = """CASE WHEN {b} THEN 'UNDECIDABLE' WHEN hi_y < 0.5 THEN 'SCORE NOT EVIDENCE' WHEN lo_y >= 0.45 AND hi_y <= 0.55 AND abs(auc_z_comp - 0.5) >= 0.1 THEN 'SCORE NOT EVIDENCE'
    WHEN lo_y >= 0.45 AND hi_y <= 0.55 THEN 'UNDECIDABLE' WHEN NOT (lo_y > 0.5) THEN 'UNDECIDABLE' WHEN coalesce(kappa_zc_y >= {k}, false) THEN 'ALIGNED' WHEN NOT beats THEN 'ALIGNED'
    WHEN d_dis >= {m} THEN 'MISMATCH' WHEN d_dis >= {c} THEN 'CAUTION' ELSE 'ALIGNED' END"""


def _gates() -> tuple:
    c = F.col
    flat = (c("n_z_comp") == 0) | (c("n_z_comp") == c("n")) | (c("n_y") == 0) | (c("n_y") == c("n"))
    return vd.underpowered(c("n_y"), c("n")), vd.degenerate_complement(c("empty_share")), vd.coarse(c("modal_share")), flat


def _verdict_v2(mismatch: float = 0.15, caution: float = 0.10, gated: bool = True) -> tuple:
    """By the Hanley-McNeil interval, as that rule has it, and the permutation null."""
    power, complement, _, flat = _gates()
    blocked = power | complement | flat if gated else F.lit(False)
    return vd.verdict_v2(blocked, F.col("lo_y"), F.col("hi_y"), F.abs(F.col("auc_z_comp") - 0.5) >= 0.1, F.col("kappa_zc_y"), F.col("beats"), F.col("d_dis"), mismatch, caution)


def _each(spark: SparkSession, d: str, what, ends: bool = True) -> DataFrame:
    return _chain(spark, d, _CONTRACTS, ends).select("span", *what)


def _each_sql(what: str) -> str:
    return f"{_chain_sql(_CONTRACTS)} SELECT span, {what} FROM chain"


_ENDS = ("d_dis", "lo95", "hi95", "lo90", "hi90", "d_lo", "d_hi", "null_p95", "p_perm", "p_boot")
_REMOVED = {f"removed_by_{n}": (f"CASE WHEN d_auc > 0 THEN 1 - (auc_{z} - auc_y) / d_auc END", z) for n, z in (("ext", "z_ext"), ("comp", "z_comp"))}


@query(_each_sql("n, n_y, n_z_comp, valid, beats, " + ", ".join(f"round({c}, 9) AS {c}" for c in _ENDS) + ", " + ", ".join(f"round({q}, 9) AS {n}" for n, (q, _) in _REMOVED.items()) + ", round(n_z_comp / CAST(n AS DOUBLE), 9) AS prevalence, d_lo > 0 AND NOT " + _BLOCKED + " AS survives, lo90 >= 0.45 AND hi90 <= 0.55 AS at_chance"))
def contract_row(spark: SparkSession, d: str) -> DataFrame:
    """Arms, intervals, null and gates of a contract: everything that the verdicts are read off."""
    c = F.col
    power, complement, _, flat = _gates()
    removed = {n: F.when(c("d_auc") > 0, 1 - (c(f"auc_{z}") - c("auc_y")) / c("d_auc")) for n, (_, z) in _REMOVED.items()}
    return _each(spark, d, ["n", "n_y", "n_z_comp", "valid", "beats", *(r9(c(x)).alias(x) for x in _ENDS), *(r9(v).alias(n) for n, v in removed.items()), r9(c("n_z_comp") / c("n")).alias("prevalence"), vd.survives(~power, ~flat, ~complement, c("d_lo")).alias("survives"), vd.equivalent(c("lo90"), c("hi90")).alias("at_chance")])


_REASON = "CASE WHEN {b} THEN 'precondition' WHEN hi_y < 0.5 THEN 'ranks the construct backwards' WHEN lo_y >= 0.45 AND hi_y <= 0.55 AND abs(auc_z_comp - 0.5) >= 0.1 THEN 'at chance, proxy ranked' WHEN lo_y >= 0.45 AND hi_y <= 0.55 THEN 'at chance, nothing ranked' WHEN NOT (lo_y > 0.5) THEN 'interval too wide to decide' WHEN coalesce(kappa_zc_y >= 0.4, false) THEN 'proxy has become the construct' WHEN NOT beats THEN 'within the null' WHEN d_dis >= 0.1 THEN 'gap' ELSE 'no gap' END".format(b=_BLOCKED)


@query(_each_sql(f"round(d_dis, 9) AS d_dis, {_V2.format(b=_BLOCKED, k=0.4, m=0.15, c=0.1)} AS verdict, {_REASON} AS reason"))
def verdict_v2(spark: SparkSession, d: str) -> DataFrame:
    v, reason = _verdict_v2()
    return _each(spark, d, [r9(F.col("d_dis")).alias("d_dis"), v.alias("verdict"), reason.alias("reason")], ends=False)


_CUTS = [(0.05, 0.02), (0.10, 0.05), (0.15, 0.10), (0.20, 0.15)]


@query(_chain_sql() + " " + " UNION ALL ".join(f"SELECT CAST({m} AS DOUBLE) AS mismatch, CAST({c} AS DOUBLE) AS caution, {_V2.format(b='false', k=0.4, m=m, c=c)} AS verdict FROM chain" for m, c in _CUTS))
def cutoff_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = [F.struct(F.lit(m).alias("mismatch"), F.lit(c).alias("caution"), _verdict_v2(m, c, gated=False)[0].alias("verdict")) for m, c in _CUTS]
    return _chain(spark, d, ends=False).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


_TOST, _COVERS = "(lo90 >= 0.45 AND hi90 <= 0.55)", "(lo95 <= 0.5 AND hi95 >= 0.5)"
_FLAT = "(n_z_comp = 0 OR n_z_comp = n OR n_y = 0 OR n_y = n)"
_TAIL = "WHEN NOT beats AND d_same >= 0.15 THEN 'CONTAINMENT' WHEN NOT beats THEN '{a}' WHEN d_dis >= 0.15 THEN '{m}' WHEN d_dis >= 0.1 THEN 'CAUTION' ELSE '{a}' END"
_FINAL = (
    "CASE WHEN {p} AND " + _POWER + " THEN 'UNDECIDABLE (power)' WHEN {c} AND " + _COMPLEMENT + " THEN 'UNDECIDABLE (complement)' WHEN {r} AND " + _COARSE + " THEN 'UNDECIDABLE (resolution)' "
    f"WHEN {_FLAT} THEN 'UNDECIDABLE (degenerate arm)' WHEN {_TOST} AND abs(auc_z_comp - 0.5) >= 0.1 THEN 'SCORE FAILURE' WHEN {_TOST} THEN 'CONTAINMENT' WHEN {_COVERS} THEN 'UNDECIDABLE (equivalence)' WHEN coalesce(kappa_zc_y >= 0.4, false) THEN 'ALIGNED' " + _TAIL.format(a="ALIGNED", m="MISMATCH")
)
_SWITCHES = [(True, True, True), (False, True, True), (True, False, True), (True, True, False), (False, False, False)]


@query(_chain_sql((200,)) + " " + " UNION ALL ".join(f"SELECT {p} AS power, {c} AS complement, {r} AS resolution, {_FINAL.format(p=p, c=c, r=r)} AS verdict FROM chain" for p, c, r in _SWITCHES))
def gate_ablation(spark: SparkSession, d: str) -> DataFrame:
    """The final rule with gates switched off."""
    col = F.col
    gates = _gates()
    rule = lambda p, c, r: vd.final_rule(*gates, vd.equivalent(col("lo90"), col("hi90")), col("auc_z_comp"), col("lo95"), col("hi95"), col("kappa_zc_y"), col("beats"), col("d_dis"), col("d_same"), p, c, r)
    rows = [F.struct(F.lit(p).alias("power"), F.lit(c).alias("complement"), F.lit(r).alias("resolution"), rule(p, c, r).alias("verdict")) for p, c, r in _SWITCHES]
    return _chain(spark, d, (200,)).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query(
    f"{P}, x AS (SELECT source, count(*) AS n, count(*) FILTER (y = 1 AND z_ext = 1) AS a, sum(y) AS y, sum(z_ext) AS z FROM pair GROUP BY source), "
    "p AS (SELECT source, round(CASE WHEN z = 0 THEN 1.0 ELSE 1 - a / CAST(z AS DOUBLE) END, 9) AS p FROM x), q AS (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r FROM p) "
    "SELECT source, p, CAST(r AS BIGINT) AS rank, round(least(min(p * m / r) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING), 1.0), 9) AS adjusted, least(min(p * m / r) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING), 1.0) <= 0.9 AS rejected FROM q"
)
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    t = pairs(spark, d).groupBy("source").agg(F.count_if((F.col("y") == 1) & (F.col("z_ext") == 1)).alias("a"), F.sum("z_ext").alias("z"))
    p = t.select("source", F.round(F.when(F.col("z") == 0, 1.0).otherwise(1 - F.col("a") / F.col("z")), 9).alias("p"))
    out = multiplicity.benjamini_hochberg(p, "p", 0.9)
    return out.select("source", "p", F.col("rank").cast("bigint").alias("rank"), r9(F.col("adjusted")).alias("adjusted"), "rejected")


_WITHIN = f"""e AS (SELECT user_id AS g, value AS s, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM events), w AS (SELECT * FROM {auc_sql('e', 's', 'y', 'g')})"""


@query(f"WITH {_WITHIN} SELECT count(auc) AS groups, CAST(sum(n) AS BIGINT) AS n, round(avg(auc), 9) AS within, round(sum(auc * n_pos * (n - n_pos)) / sum(CAST(n_pos AS DOUBLE) * (n - n_pos)), 9) AS within_weighted FROM w")
def within_group_auc(spark: SparkSession, d: str) -> DataFrame:
    return rank.within_auc(_purchases(spark, d), "s", "y", "g").select("groups", "n", r9(F.col("within")).alias("within"), r9(F.col("within_weighted")).alias("within_weighted"))


def _purchases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("g"), F.col("value").alias("s"), (F.col("event_type") == "purchase").cast("int").alias("y"), F.col("event_id").alias("id"))


@query(
    f"WITH {_WITHIN}, p AS (SELECT auc, CAST(n_pos AS DOUBLE) * (n - n_pos) AS a FROM {auc_sql('e', 's', 'y')}), o AS (SELECT sum(CAST(n_pos AS DOUBLE) * (n - n_pos)) AS own, sum(auc * n_pos * (n - n_pos)) / sum(CAST(n_pos AS DOUBLE) * (n - n_pos)) AS ww FROM w) "
    "SELECT round(auc, 9) AS pooled, round(ww, 9) AS within_weighted, round(own / a, 9) AS lam, round((auc - own / a * ww) / (1 - own / a), 9) AS cross FROM p, o"
)
def lambda_decomposition(spark: SparkSession, d: str) -> DataFrame:
    return rank.within_auc(_purchases(spark, d), "s", "y", "g").select(*(r9(F.col(c)).alias(c) for c in ("pooled", "within_weighted", "lam", "cross")))


@query(
    f"WITH {_WITHIN}, r AS (SELECT g, y, {_MID.format(c='s')} AS rk FROM e), m AS (SELECT g, avg(rk) AS m, sum(y) AS p, count(*) AS c FROM r GROUP BY g) "
    "SELECT CAST(sum(c) AS BIGINT) AS n, round((sum(m * p) - sum(p) * (sum(p) + 1) / CAST(2 AS DOUBLE)) / (CAST(sum(p) AS DOUBLE) * (sum(c) - sum(p))), 9) AS null_mean FROM m"
)
def exact_within_null_mean(spark: SparkSession, d: str) -> DataFrame:
    return rank.exact_within_null(_purchases(spark, d), "s", "y", "g").withColumn("null_mean", r9(F.col("null_mean")))


@query("SELECT user_id AS g, event_id AS id, value AS s, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events WHERE value IS NOT NULL) WHERE k = 1")
def best_of_n_argmax(spark: SparkSession, d: str) -> DataFrame:
    return rank.best_of_group(_purchases(spark, d), "s", "id", "g").select("g", "id", "s", "y")


@query(f"{P}, a AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS x, row_number() OVER (ORDER BY len DESC, id) AS w FROM pair) SELECT count(*) AS both, round(count(*) / CAST(60 AS DOUBLE), 9) AS overlap FROM a WHERE x <= 60 AND w <= 60")
def queue_overlap(spark: SparkSession, d: str) -> DataFrame:
    return agree.moving_queue(pairs(spark, d), "s", "len", "id", 60).withColumn("overlap", r9(F.col("overlap")))


@query(f"{P}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY s DESC, id) AS rk FROM pair), b AS (SELECT lang, avg(CAST(y AS DOUBLE)) AS base FROM pair GROUP BY lang) SELECT r.lang AS lang, count(*) AS routed, round(avg(CAST(y AS DOUBLE)) - max(base), 9) AS penetration FROM r JOIN b ON r.lang = b.lang WHERE rk <= 20 GROUP BY r.lang")
def penetration_by_pair(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    base = p.groupBy("lang").agg(F.avg(F.col("y").cast("double")).alias("base"))
    top = rank.precision_at(p, "s", "y", "id", [20], ["lang"])
    return top.join(base, "lang").select("lang", F.col("n_top").alias("routed"), r9(F.col("precision") - F.col("base")).alias("penetration"))


_SPANS = (50, 200, 800)


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {pairs_sql(k)} SELECT {k} AS span, round(a.auc, 9) AS auc_z_comp, round(b.auc, 9) AS auc_y, round(abs(a.auc - 0.5) - abs(b.auc - 0.5), 9) AS gap FROM {auc_sql('pair', 's', 'z_comp')} a, {auc_sql('pair', 's', 'y')} b)" for k in _SPANS))
def span_closure(spark: SparkSession, d: str) -> DataFrame:
    """The complement's gap at each span, from one pass over the texts."""
    t = tx.body("text")
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    head = tx.prefix(t, 200)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("span"), F.contains(tx.complement(t, k), F.lit("!")).cast("int").alias("z_comp")) for k in _SPANS)))
    p = docs.select(F.col("toxic").alias("y"), (F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))).alias("s"), each.alias("x")).select("s", "y", "x.*")
    a = rank.auc(p, "s", ["z_comp", "y"], ["span"])
    return a.select("span", r9(F.col("auc_z_comp")).alias("auc_z_comp"), r9(F.col("auc_y")).alias("auc_y"), r9(stats.robust_gap(F.col("auc_z_comp"), F.col("auc_y"))).alias("gap"))


@query(f"{P}, e AS (SELECT list_sort([quantile_cont(s, 0.2), quantile_cont(s, 0.4), quantile_cont(s, 0.6), quantile_cont(s, 0.8)]) AS e FROM pair), b AS (SELECT len(list_filter(list_distinct(e), lambda x: x <= s)) AS bin, s, y FROM pair, e) SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(avg(s), 9) AS mean_p, round(avg(CAST(y AS DOUBLE)), 9) AS rate FROM b GROUP BY bin")
def reliability_curve(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.reliability(pairs(spark, d).withColumn("s", F.col("s").cast("double")), "s", "y", 5).withColumns({c: r9(F.col(c)) for c in ("mean_p", "rate")})


@query(
    f"{P}, m AS (SELECT max(s) AS m FROM pair), p AS (SELECT s / CAST(m AS DOUBLE) AS p, y FROM pair, m), e AS (SELECT list_distinct(list_transform(range(1, 10), lambda k: k)) AS ks FROM m), "
    "c AS (SELECT [" + ", ".join(f"quantile_cont(p, {k / 10})" for k in range(1, 10)) + "] AS e FROM p), b AS (SELECT len(list_filter(list_distinct(c.e), lambda x: x <= p)) AS bin, p, y FROM p, c), "
    "g AS (SELECT bin, count(*) AS n, abs(avg(p) - avg(CAST(y AS DOUBLE))) AS d FROM b GROUP BY bin), s AS (SELECT avg((p - y) * (p - y)) AS brier, avg(CAST(y AS DOUBLE)) AS r FROM p) "
    "SELECT round(sum(n * d) / sum(n), 9) AS ece, round(max(brier), 9) AS brier, round(1 - max(brier) / (max(r) * (1 - max(r))), 9) AS skill FROM g, s"
)
def reliability_curve_ece(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    p = p.crossJoin(F.broadcast(p.agg(F.max("s").alias("m")))).withColumn("p", F.col("s") / F.col("m"))  # one row
    ece = calibrate.calibration_error(calibrate.reliability(p, "p", "y"))
    return ece.crossJoin(calibrate.brier(p, "p", "y").drop("n")).select(r9(F.col("ece")).alias("ece"), r9(F.col("brier")).alias("brier"), r9(F.col("skill")).alias("skill"))


@query(f"{P} SELECT lang, count(*) FILTER (z_ext = 1 AND y = 1) AS both, count(*) FILTER (z_ext = 1 AND y = 0) AS proxy_only, count(*) FILTER (z_ext = 0 AND y = 1) AS construct_only, count(*) FILTER (z_ext = 0 AND y = 0) AS neither FROM pair GROUP BY lang")
def subset_four_cell(spark: SparkSession, d: str) -> DataFrame:
    return agree.contingency(pairs(spark, d), "z_ext", "y", ["lang"]).select("lang", F.col("n11").alias("both"), F.col("n10").alias("proxy_only"), F.col("n01").alias("construct_only"), F.col("n00").alias("neither"))


_GRADES = (("strong", 0.92, 0.75, 0.80, 0.05, 0.07), ("defensive", 0.85, 0.65, 0.75, 0.07, 0.10), ("required", 0.85, 0.60, 0.70, 0.10, 0.15))
_NOISY = "CASE WHEN CAST(('0x' || substring(md5('j-' || lang || '-' || id), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) < CASE lang WHEN 'en' THEN 0.03 WHEN 'fr' THEN 0.06 WHEN 'de' THEN 0.09 ELSE 0.3 END THEN 1 - q ELSE q END"


@query(
    f"{P}, j AS (SELECT lang, source, q, {_NOISY} AS said FROM pair), w AS (SELECT lang, min(acc) AS worst FROM (SELECT lang, source, avg(CASE WHEN said = q THEN 1.0 ELSE 0.0 END) AS acc FROM j GROUP BY lang, source HAVING count(*) >= 10) GROUP BY lang), "
    f"g AS (SELECT lang, count(*) AS n, avg(CASE WHEN said = q THEN 1.0 ELSE 0.0 END) AS acc, {kappa_sql('said', 'q')} AS k, count(*) FILTER (q = 0 AND said = 1) / CAST(nullif(count(*) FILTER (q = 0), 0) AS DOUBLE) AS fpr, count(*) FILTER (q = 1 AND said = 0) / CAST(nullif(count(*) FILTER (q = 1), 0) AS DOUBLE) AS fnr FROM j GROUP BY lang HAVING count(*) >= 5) "
    "SELECT lang, n, round(acc, 9) AS accuracy, round(k, 9) AS kappa, round(worst, 9) AS worst, CASE " + " ".join(f"WHEN acc >= {a} AND k >= {k} AND worst >= {w} AND fpr <= {fp} AND fnr <= {fn} THEN '{n}'" for n, a, k, w, fp, fn in _GRADES) + " ELSE 'below_required' END AS grade FROM g LEFT JOIN w USING (lang)"
)
def judge_validation(spark: SparkSession, d: str) -> DataFrame:
    """A judge of quality whose errors differ by language, graded by accuracy, kappa, its worst source and its error rates."""
    p = pairs(spark, d)
    rate = F.when(F.col("lang") == "en", 0.03).when(F.col("lang") == "fr", 0.06).when(F.col("lang") == "de", 0.09).otherwise(0.3)
    j = p.select("lang", "source", "q", F.when(resample.draw_hash("j", F.col("lang"), F.col("id")) / F.lit(4294967296.0) < rate, 1 - F.col("q")).otherwise(F.col("q")).alias("said"))
    by = agree.confusion(j, "q", "said", ["lang", "source"]).filter("tp + fp + fn + tn >= 10").groupBy("lang").agg(F.min("accuracy").alias("worst"))
    c = agree.confusion(j, "q", "said", ["lang"]).join(agree.kappa(j, "said", "q", ["lang"], least=5).select("lang", "n", "kappa"), "lang").join(by, "lang", "left")
    grade = vd.judge_grade(F.col("accuracy"), F.col("kappa"), F.col("worst"), F.col("fpr"), F.col("fnr"))
    return c.select("lang", "n", r9(F.col("accuracy")).alias("accuracy"), r9(F.col("kappa")).alias("kappa"), r9(F.col("worst")).alias("worst"), grade.alias("grade"))


_EXITS = f"WHEN {_TOST} AND abs(auc_z_comp - 0.5) >= 0.1 THEN 'SCORE FAILURE' "
_FAMILY = {
    "frozen": f"CASE WHEN n_y < 10 THEN 'UNDECIDABLE (minimum-positive-count)' WHEN {_COMPLEMENT} THEN 'UNDECIDABLE (complement)' WHEN {_COARSE} THEN 'UNDECIDABLE (resolution)' {_EXITS} WHEN {_TOST} AND d_same >= 0.15 THEN 'CONTAINMENT' WHEN {_TOST} THEN 'UNDECIDABLE (no signal)' WHEN {_COVERS} THEN 'UNDECIDABLE (equivalence)' " + _TAIL.format(a="NO RESIDUAL FLAG", m="DIVERGENCE"),
    "synthetic": f"CASE WHEN {_POWER} OR {_COARSE} THEN 'UNDECIDABLE' {_EXITS} WHEN {_TOST} THEN 'CONTAINMENT' WHEN {_COVERS} THEN 'UNDECIDABLE' WHEN coalesce(kappa_zc_y >= 0.4, false) THEN 'ALIGNED' " + _TAIL.format(a="ALIGNED", m="DIVERGENCE"),
    "baseline": f"CASE WHEN {_POWER} THEN 'UNDECIDABLE (power)' WHEN {_COMPLEMENT} THEN 'UNDECIDABLE (complement)' WHEN {_COARSE} THEN 'UNDECIDABLE (resolution)' WHEN {_TOST} THEN 'FLAG: not evidence' WHEN {_COVERS} THEN 'UNDECIDABLE (equivalence)' WHEN kappa_z_y < 0.4 THEN 'FLAG: label' ELSE 'NO FLAG' END",
    "baseline_short": f"CASE WHEN {_POWER} THEN 'UNDECIDABLE' WHEN {_TOST} THEN 'FLAG: not evidence' WHEN {_COVERS} THEN 'UNDECIDABLE' WHEN kappa_z_y < 0.4 THEN 'FLAG: label' ELSE 'NO FLAG' END",
    "cheap": f"CASE WHEN kappa_z_y IS NULL THEN 'n/a' WHEN {_COVERS} AND kappa_z_y <= 0.2 THEN 'MISMATCH' WHEN kappa_z_y <= 0.2 THEN 'CAUTION' ELSE 'ALIGNED' END",
    "earlier": f"CASE WHEN {_COVERS} AND abs(auc_z - 0.5) < 0.1 THEN 'NULL' WHEN d_auc >= 0.15 AND coalesce(kappa_z_y <= 0.2, true) THEN 'MISMATCH' WHEN d_auc >= 0.1 THEN 'CAUTION' ELSE 'ALIGNED' END",
    "encoder": f"CASE WHEN {_POWER} THEN 'UNDECIDABLE (power)' WHEN {_COMPLEMENT} THEN 'UNDECIDABLE (complement)' WHEN {_COARSE} THEN 'UNDECIDABLE (resolution)' WHEN {_TOST} AND abs(auc_z_comp - 0.5) > 0.05 THEN 'SCORE FAILURE' WHEN {_TOST} THEN 'CONTAINMENT' WHEN {_COVERS} THEN 'UNDECIDABLE (equivalence)' WHEN coalesce(kappa_zc_y >= 0.4, false) THEN 'ALIGNED (proxy merged with construct)' " + _TAIL.format(a="ALIGNED", m="MISMATCH"),
    "reoriented": "hi95 < 0.5",
    "external": f"CASE WHEN {_BLOCKED} OR {_COARSE} THEN 'UNDECIDABLE' WHEN d_lo > 0 AND d_dis >= 0.15 THEN 'MISMATCH' WHEN d_lo > 0 AND d_dis >= 0.1 THEN 'CAUTION' ELSE 'ALIGNED' END",
}


@query(_each_sql(", ".join(f"{q} AS {n}" for n, q in _FAMILY.items())))
def verdict_family(spark: SparkSession, d: str) -> DataFrame:
    """The other rules on the same contract rows."""
    c = F.col
    power, complement, coarse, flat = _gates()
    tost, ranked = vd.equivalent(c("lo90"), c("hi90")), (c("lo95") > 0.5) | (c("hi95") < 0.5)
    encoder, reoriented = vd.encoder_rule(power, complement, coarse, tost, c("lo95"), c("hi95"), c("auc_z_comp"), c("kappa_zc_y"), c("beats"), c("d_dis"), c("d_same"))
    rules = {
        "frozen": vd.frozen_rule(c("n_y") < 10, complement, c("modal_share"), tost, c("auc_z_comp"), c("lo95"), c("hi95"), c("beats"), c("d_dis"), c("d_same")),
        "synthetic": vd.synthetic_rule(power, coarse, tost, c("auc_z_comp"), c("lo95"), c("hi95"), c("kappa_zc_y"), c("beats"), c("d_dis"), c("d_same"), kappa_exit=True),
        "baseline": vd.baseline(power, complement, coarse, tost, c("lo95"), c("hi95"), c("kappa_z_y")),
        "baseline_short": vd.baseline_power_only(power, tost, c("lo95"), c("hi95"), c("kappa_z_y")),
        "cheap": vd.cheap_rule(ranked, c("kappa_z_y")),
        "earlier": vd.earlier_verdict(c("d_auc"), c("kappa_z_y"), ranked, F.abs(c("auc_z") - 0.5) >= 0.1),
        "encoder": encoder,
        "reoriented": reoriented,
        "external": vd.external(power | complement | flat | coarse, vd.survives(~power, ~flat, ~complement, c("d_lo")), c("d_dis")),
    }
    return _each(spark, d, [v.alias(n) for n, v in rules.items()])


@query(f"{P}, g AS (SELECT source, CASE WHEN n < 5 THEN 'UNDECIDABLE' WHEN k >= 0.15 THEN 'MISMATCH' WHEN k >= 0.05 THEN 'CAUTION' ELSE 'ALIGNED' END AS verdict, round(1 - k, 9) AS p FROM (SELECT source, count(*) AS n, avg(CAST(z_ext <> y AS INT)) AS k FROM pair GROUP BY source)), d AS (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r FROM g WHERE verdict <> 'UNDECIDABLE'), c AS (SELECT max(p) AS crit FROM d WHERE p <= 0.85 * r / m), a AS (SELECT source, verdict, p, coalesce(p <= crit, false) AS survives_bh FROM d, c UNION ALL SELECT source, verdict, p, NULL FROM g WHERE verdict = 'UNDECIDABLE') SELECT *, CASE WHEN survives_bh = false AND verdict IN ('MISMATCH', 'CAUTION') THEN 'ALIGNED (fails BH)' ELSE verdict END AS verdict_bh FROM a")
def bh_regrade(spark: SparkSession, d: str) -> DataFrame:
    """Cells (sources) with a verdict and a p-value, graded again under a false discovery rate."""
    k = F.col("k")
    t = pairs(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.avg((F.col("z_ext") != F.col("y")).cast("int")).alias("k"))
    cells = t.select("source", vd.ladder((F.col("n") < 5, "UNDECIDABLE"), (k >= 0.15, "MISMATCH"), (k >= 0.05, "CAUTION"), otherwise="ALIGNED").alias("verdict"), r9(1 - k).alias("p"))
    return vd.regrade(cells, "verdict", "p", 0.85)


@query(_each_sql("round(d_lo, 9) AS bootstrap_lo, round(null_p95, 9) AS null_p95"))
def bar_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The bootstrap's bar for a gap beside that of the permutation null."""
    return _each(spark, d, [r9(F.col("d_lo")).alias("bootstrap_lo"), r9(F.col("null_p95")).alias("null_p95")])


_KEPT = f"""{P}, dr AS (SELECT unnest(range(0, 30)) AS draw), k AS (SELECT *, row_number() OVER (PARTITION BY draw, y ORDER BY CAST(('0x' || substring(md5('v-' || CAST(draw AS VARCHAR) || '-' || id), 1, 8)) AS BIGINT), id) AS r FROM pair, dr), x AS (SELECT draw, s, y, z_comp FROM k WHERE y = 0 OR r <= 12),
    v AS (SELECT a.draw AS draw, b.auc AS auc_y, abs(a.auc - 0.5) - abs(b.auc - 0.5) AS d, sqrt((b.auc * (1 - b.auc) + (b.n_pos - 1) * (b.auc / (2 - b.auc) - b.auc * b.auc) + (b.n - b.n_pos - 1) * (2 * b.auc * b.auc / (1 + b.auc) - b.auc * b.auc)) / (CAST(b.n_pos AS DOUBLE) * (b.n - b.n_pos))) AS se
        FROM {auc_sql('x', 's', 'z_comp', 'draw')} a JOIN {auc_sql('x', 's', 'y', 'draw')} b USING (draw)),
    w AS (SELECT CASE WHEN auc_y + 1.96 * se < 0.5 THEN 'SCORE NOT EVIDENCE' WHEN NOT coalesce(auc_y - 1.96 * se > 0.5, false) THEN 'UNDECIDABLE' WHEN d >= 0.15 THEN 'MISMATCH' WHEN d >= 0.1 THEN 'CAUTION' ELSE 'ALIGNED' END AS verdict FROM v)"""


@query(f"{_KEPT} SELECT verdict, round(count(*) / CAST((SELECT count(*) FROM w) AS DOUBLE), 9) AS share FROM w GROUP BY verdict")
def verdict_stability(spark: SparkSession, d: str) -> DataFrame:
    """The verdict again on constructs thinned to twelve positives at random, and how often each comes out."""
    p = pairs(spark, d).select("id", "s", "y", "z_comp")
    ones = p.filter("y = 1").crossJoin(F.broadcast(resample.draws(spark, 30))).withColumn("h", resample.draw_hash("v", F.col("draw"), F.col("id")))
    kept = rank.ranked(ones.withColumn("h", -F.col("h")), "h", "id", ["draw"], 12)
    rows = kept.select("draw", "s", "y", "z_comp").union(p.filter("y = 0").crossJoin(F.broadcast(resample.draws(spark, 30))).select("draw", "s", "y", "z_comp"))
    a = rank.auc(rows, "s", ["z_comp", "y"], ["draw"])
    _, lo, hi = stats.hanley_mcneil(F.col("auc_y"), F.col("n_y"), F.col("n") - F.col("n_y"))
    gap = stats.robust_gap(F.col("auc_z_comp"), F.col("auc_y"))
    verdict = vd.ladder((hi < 0.5, "SCORE NOT EVIDENCE"), (~F.coalesce(lo > 0.5, F.lit(False)), "UNDECIDABLE"), *vd.bands(gap), otherwise="ALIGNED")
    return resample.verdict_shares(a.select(verdict.alias("verdict"))).withColumn("share", r9(F.col("share")))


_EVIDENCE = "SELECT doc_id, contains(coalesce(text, ''), 'license') AS q, contains(coalesce(text, ''), '@') AS o, CASE WHEN doc_id % 50 = 0 THEN 'BOTH' END AS fixed FROM documents"


@query(f"WITH e AS ({_EVIDENCE}) SELECT doc_id, coalesce(fixed, CASE WHEN q AND o THEN 'BOTH' WHEN q THEN 'QUERY' WHEN o THEN 'OUTPUT' ELSE 'UNCLEAR' END) AS locus, CASE WHEN q THEN 'RELEASED' WHEN doc_id % 3 > 0 THEN 'NOT RELEASED' ELSE 'UNDETERMINED' END AS release FROM e")
def coding_ladders(spark: SparkSession, d: str) -> DataFrame:
    """Codes from evidence in a text, before which a table of overrides stands."""
    t = table(spark, d, "documents").select("doc_id", "text")
    overrides = t.filter("doc_id % 50 = 0").select("doc_id", F.lit("BOTH").alias("fixed"))
    has = lambda x: F.contains(tx.body("text"), F.lit(x))
    coded = t.join(overrides, "doc_id", "left")
    return coded.select("doc_id", vd.locus(has("license"), has("@"), F.col("fixed")).alias("locus"), vd.release(has("license"), F.col("doc_id") % 3 > 0).alias("release"))


_CELLS = [(z, k) for z in ("z", "z_comp", "z_ext") for k in ("s", "len")]


@query(
    P + " " + " UNION ALL ".join(
        f"SELECT '{z}' AS proxy, '{s}' AS score, round(a.auc, 9) AS auc_proxy, CASE WHEN a.n_pos < 10 OR a.n - a.n_pos < 10 THEN 'UNDERPOWERED' WHEN coalesce(a.auc - b.auc >= 0.15 AND k.k <= 0.2, false) THEN 'MISMATCH_CANDIDATE' WHEN coalesce(a.auc - b.auc >= 0.1, false) THEN 'CAUTION' ELSE 'ALIGNED' END AS status "
        f"FROM {auc_sql('pair', s, z)} a, {auc_sql('pair', s, 'y')} b, (SELECT {kappa_sql(z, 'y')} AS k FROM pair) k"
        for z, s in _CELLS
    )
)
def screening_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every proxy against every score, scores as keys of one pass."""
    p = pairs(spark, d)
    both = p.withColumn("x", F.explode(F.array(*(F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("v")) for s in ("s", "len"))))).select("*", "x.*")
    a = rank.auc(both, "v", ["z", "z_comp", "z_ext", "y"], ["score"])
    kap = p.agg(*(c.alias(f"{z}_{n}") for z in ("z", "z_comp", "z_ext") for n, c in agree.cells(z, "y").items()))
    rows = []
    for z in ("z", "z_comp", "z_ext"):
        k = stats.kappa(*(F.col(f"{z}_{n}") for n in ("n11", "n10", "n01", "n00")))
        rows.append(F.struct(F.lit(z).alias("proxy"), r9(F.col(f"auc_{z}")).alias("auc_proxy"), vd.screening(F.col(f"n_{z}"), F.col("n"), F.col(f"auc_{z}") - F.col("auc_y"), k).alias("status")))
    return a.crossJoin(F.broadcast(kap)).select("score", F.explode(F.array(*rows)).alias("r")).select("r.proxy", "score", "r.auc_proxy", "r.status")


@query(f"{P}, {_TOP} SELECT b AS budget, count(*) AS routed, CAST(sum(y) AS BIGINT) AS hits, round(avg(CAST(y AS DOUBLE)), 9) AS precision, round(sum(y) / CAST((SELECT sum(y) FROM pair) AS DOUBLE), 9) AS recall FROM r, (VALUES (10), (40), (160)) AS v(b) WHERE rk <= b GROUP BY b")
def budget_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rank.budget_sweep(pairs(spark, d), "s", "y", "id", [10, 40, 160]).withColumns({c: r9(F.col(c)) for c in ("precision", "recall")})


@query(
    f"{P}, t AS (SELECT s, count(*) AS n, sum(y) AS p FROM pair GROUP BY s), c AS (SELECT s, n, p, coalesce(sum(n) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bn, coalesce(sum(p) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bp FROM t) "
    "SELECT s AS cut, CAST(bn AS BIGINT) AS surely, n AS tied, CAST(40 - bn AS BIGINT) AS places, CAST(bp AS BIGINT) AS pos_in, CAST(p AS BIGINT) AS pos_tied, round(bp + (40 - bn) * p / CAST(n AS DOUBLE), 9) AS expected FROM c WHERE bn < 40 AND bn + n >= 40"
)
def tie_exposure(spark: SparkSession, d: str) -> DataFrame:
    return rank.tie_exposure(pairs(spark, d), "s", "y", 40).withColumn("expected", r9(F.col("expected")))


@query(f"{P} SELECT lang, count(*) AS n, round(avg(CASE WHEN y = 0 THEN CASE WHEN z_ext = 1 THEN 1.0 ELSE 0.0 END END), 9) AS p_false_pos, round(avg(CASE WHEN y = 1 THEN CASE WHEN z_ext = 0 THEN 1.0 ELSE 0.0 END END), 9) AS p_false_neg FROM pair GROUP BY lang")
def error_model(spark: SparkSession, d: str) -> DataFrame:
    return rank.error_model(pairs(spark, d), "y", "z_ext", "lang").withColumns({c: r9(F.col(c)) for c in ("p_false_pos", "p_false_neg")})


@query(
    "WITH o AS (SELECT l_orderkey, list(1 - l_discount ORDER BY l_linenumber, l_discount) AS v, sum(1 - l_discount) / count(*) AS r FROM lineitem GROUP BY l_orderkey), w AS (SELECT r, list_product(v) AS p, list_min(v) AS mn, list_avg(v) AS m, v[-1] AS l FROM o) "
    "SELECT 'product' AS how, count(*) AS n, round(corr(p, r), 6) AS corr, round(max(abs(p - r)), 6) AS max_gap FROM w UNION ALL SELECT 'min', count(*), round(corr(mn, r), 6), round(max(abs(mn - r)), 6) FROM w UNION ALL SELECT 'mean', count(*), round(corr(m, r), 6), round(max(abs(m - r)), 6) FROM w UNION ALL SELECT 'last', count(*), round(corr(l, r), 6), round(max(abs(l - r)), 6) FROM w"
)
def aggregator_check(spark: SparkSession, d: str) -> DataFrame:
    steps = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_discount"))), lambda x: 1 - x["l_discount"])
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(steps.alias("v"), (F.sum(1 - F.col("l_discount")) / F.count("*")).alias("r"))
    return rank.aggregator_check(t, "v", "r").withColumns({c: F.round(c, 6) for c in ("corr", "max_gap")})


@query(f"{P} SELECT id, CAST(z_ext <> y AS INT) AS differs, CAST(greatest(z_ext, y, q) <> least(z_ext, y, q) AS INT) AS any_differs, z_ext = 1 AND y = 1 AS both, z_ext = 0 AND y = 0 AS neither FROM pair")
def disagreement_labels(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import rules

    p = pairs(spark, d)
    joint = rules.joint_states(F.col("z_ext"), F.col("y"))
    return p.select("id", rules.disagree(F.col("z_ext"), F.col("y")).alias("differs"), rules.any_disagree([F.col(c) for c in ("z_ext", "y", "q")]).alias("any_differs"), joint["both"].alias("both"), joint["neither"].alias("neither"))


@query("WITH m AS (SELECT lang, quantile_cont(n_chars, 0.5) AS m FROM documents GROUP BY lang) SELECT doc_id, CAST(n_chars > m AS INT) AS above FROM documents JOIN m USING (lang)")
def above_median(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import rules

    return rules.above_median(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "n_chars", ["lang"]).select("doc_id", "above")
