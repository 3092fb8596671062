"""Queries of further pair scores, learned scorers and simulations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, stats
from ..functions import text as tx
from ..operators import agree, calibrate, distance, learned, multiplicity, rank, resample, simulate
from ..sources import kept, table
from .contracts import TURNS_SQL, auc_sql, kappa_sql, pairs, pairs_sql, r9, turn_pairs
from .draws_sql import hash_sql, hypergeometric_sql
from .registry import query
from .resampling import _permuted, _weighted
from .texts import _COS, _VOC

P = "WITH " + pairs_sql()
_HASH = "CAST(('0x' || substring(md5({t}), 1, 8)) AS BIGINT)"

_SHORT = """tok AS (SELECT pair, 0 AS side, lower(substring(a, 1, 40)) AS t FROM tp UNION ALL SELECT pair, 1, lower(substring(b, 1, 40)) FROM tp),
    g AS (SELECT pair, side, unnest(list_concat(string_split(t, ''), CASE WHEN length(t) > 1 THEN list_transform(range(1, length(t)), lambda i: substring(t, i, 2)) ELSE [] END)) AS term FROM tok WHERE t <> ''),
    tc AS (SELECT pair, term, count(*) FILTER (side = 0) AS ta, count(*) FILTER (side = 1) AS tb FROM g WHERE term <> '' GROUP BY pair, term)"""


@query(f"WITH {TURNS_SQL}, {_SHORT}, {_VOC.format(having='', most='ALL')}, w AS (SELECT pair, ta * idf AS wa, tb * idf AS wb FROM tc JOIN i USING (term)), {_COS}")
def char_pair_distance(spark: SparkSession, d: str) -> DataFrame:
    """Characters and pairs of them, for short answers: here the first 40 characters, the span that is scored."""
    p = turn_pairs(spark, d).select("pair", tx.prefix("a", 40).alias("a"), tx.prefix("b", 40).alias("b"))
    out = distance.tfidf(p, lambda c: distance.char_grams(c, 1, 2, in_words=False), most=None, sublinear=False)
    return out.withColumn("distance", r9(F.col("distance")))


_LAMBDAS = (0.5, 0.7, 0.9)


@query(
    f"{P}, m AS (SELECT avg(s) AS m, stddev_pop(s) AS sd FROM pair) SELECT id, " + ", ".join(f"round({w} * (s - m) / sd + (1 - {w}) * z_comp, 9) AS composite_{int(w * 10)}" for w in _LAMBDAS)
    + ", round((s + len + z) / CAST(3 AS DOUBLE), 9) AS mean_score, least(s, len, z) AS min_score, greatest(s, len, z) AS max_score, CASE WHEN z_ext = 1 THEN abs(s - len) END AS entailment FROM pair, m"
)
def composite_scores(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a standardised score and a marker; mean, least and greatest of several; the gap of two model scores given as columns."""
    p = agree.zscore(pairs(spark, d), "s")
    many = rules.ensemble([F.col("s"), F.col("len"), F.col("z")])
    given = F.when(F.col("z_ext") == 1, F.col("len"))
    return p.select("id", *(r9(distance.composite(F.col("z_s"), F.col("z_comp"), w)).alias(f"composite_{int(w * 10)}") for w in _LAMBDAS), r9(many["mean"]).alias("mean_score"), many["min"].alias("min_score"), many["max"].alias("max_score"), distance.entailment_gap(F.col("s"), given).alias("entailment"))


@query(f"{P}, w AS (SELECT lang, auc AS a FROM {auc_sql('pair', 's', 'y', 'lang')}), l AS (SELECT lang, auc AS b FROM {auc_sql('pair', 'len', 'y', 'lang')}), m AS (SELECT lang, 's' AS metric, a AS auc FROM w UNION ALL SELECT lang, 'len', b FROM l) SELECT metric, count(*) AS settings, round(avg(auc), 9) AS mean_auc FROM m WHERE auc IS NOT NULL GROUP BY metric")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means over settings (languages) by metric, without settings whose AUC is null."""
    p = pairs(spark, d)
    both = p.select("lang", "y", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in ("s", "len")))).alias("x")).select("lang", "y", "x.*")
    a = rank.auc(both, "v", ["y"], ["metric", "lang"]).select("metric", F.col("auc_y").alias("auc"))
    return rank.summary(a, "metric", ["auc"]).withColumn("mean_auc", r9(F.col("mean_auc")))


_BOOT = f"{P}, n AS (SELECT *, row_number() OVER (ORDER BY {_HASH.format(t=chr(39) + 'slot-' + chr(39) + ' || id')}, id) - 1 AS i, count(*) OVER () AS size FROM pair), w AS (SELECT draw, {_HASH.format(t=chr(39) + 'b-' + chr(39) + ' || CAST(draw AS VARCHAR) || ' + chr(39) + '-' + chr(39) + ' || CAST(i AS VARCHAR)')} % size AS i, count(*) AS w FROM n, (SELECT unnest(range(0, 50)) AS draw) GROUP BY ALL)"


def _queue(s: str) -> str:
    return f"SELECT draw, sum(greatest(least(w, 50 - before), 0) * y) AS hits FROM (SELECT w.draw AS draw, w, y, coalesce(sum(w) OVER (PARTITION BY w.draw ORDER BY {s} DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w JOIN n USING (i)) GROUP BY draw"


@query(f"{_BOOT} SELECT a.draw AS draw, CAST(a.hits - b.hits AS BIGINT) AS diff FROM ({_queue('s')}) a JOIN ({_queue('len')}) b USING (draw)")
def queue_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Positives among the first 50 by one score less those by another, in resamples."""
    return resample.queue_bootstrap(pairs(spark, d), "id", "s", "len", "y", 50, 50, "b")


@query(f"{_BOOT}, x AS (SELECT w.draw AS draw, w.w AS w, n.y AS y, n.s AS s, n.len AS c1, n.len * (1 + n.z_ext) AS c2 FROM w JOIN n USING (i)) SELECT a.draw AS draw, round((b.auc + c.auc) / 2 - a.auc, 9) AS change FROM {_weighted('x', 's', 'y')} a JOIN {_weighted('x', 'c1', 'y')} b USING (draw) JOIN {_weighted('x', 'c2', 'y')} c USING (draw)")
def control_change(spark: SparkSession, d: str) -> DataFrame:
    """The change to a matched control whose AUC is the mean over its seeds: here two."""
    p = pairs(spark, d).withColumn("c2", F.col("len") * (1 + F.col("z_ext")))
    return resample.paired_change(p, "id", "s", ["len", "c2"], "y", 50, "b").select("draw", r9(F.col("change")).alias("change"))


@query(f"{P}, n AS (SELECT count(*) AS n FROM pair) SELECT f AS share, greatest(1, CAST(round_even(f * n, 0) AS INT)) AS half_even, CAST(floor(f * n) AS INT) AS down FROM n, (VALUES (0.001::DOUBLE), (0.05), (0.5)) AS v(f)")
def budget_rounding(spark: SparkSession, d: str) -> DataFrame:
    """A share of the rows as a count, rounded half-even (one at least) and down."""
    n = pairs(spark, d).agg(F.count("*").alias("n"))
    return n.select(F.explode(F.array(*map(F.lit, (0.001, 0.05, 0.5)))).alias("share"), "n").select("share", rank.budget_of(F.col("share"), F.col("n")).alias("half_even"), rank.budget_of(F.col("share"), F.col("n"), "floor").alias("down"))


@query(f"{P}, r AS (SELECT row_number() OVER (ORDER BY s DESC, id) AS a, row_number() OVER (ORDER BY len DESC, id) AS b FROM pair) SELECT count(*) AS rows, count(*) FILTER (a <> b) AS moved FROM r")
def rank_moves(spark: SparkSession, d: str) -> DataFrame:
    return agree.rank_moves(pairs(spark, d), "s", "len", "id")


_GAPS = "g AS (SELECT lang, p AS k, 3.2 - p * (1 + length(lang) % 2) * 0.4 - (ascii(lang) - 100) * 0.15 AS v FROM (SELECT DISTINCT lang FROM documents), (VALUES (1), (2), (4), (8)) AS v(p))"


@query(
    f"WITH {_GAPS}, s AS (SELECT *, lag(k) OVER w AS a0, lag(v) OVER w AS v0 FROM g WINDOW w AS (PARTITION BY lang ORDER BY k)) "
    "SELECT lang, round(min(CASE WHEN v0 > 0 AND v <= 0 THEN a0 + (k - a0) * v0 / (v0 - v) END), 9) AS crossing, min(CASE WHEN v <= 0 THEN k END) AS first_clear FROM s GROUP BY lang"
)
def span_crossing(spark: SparkSession, d: str) -> DataFrame:
    """Where a gap that falls with the span crosses zero, and the first span at which it doesn't clear it."""
    g = table(spark, d, "documents").select("lang").distinct().select("lang", F.explode(F.array(*map(F.lit, (1, 2, 4, 8)))).alias("at"))
    g = g.withColumn("v", 3.2 - F.col("at") * (1 + F.length("lang") % 2) * 0.4 - (F.ascii("lang") - 100) * 0.15)
    both = rank.zero_crossing(g, "at", "v", ["lang"]).join(rank.first_clear(g, "at", "v", ["lang"]), "lang")
    return both.select("lang", r9(F.col("crossing")).alias("crossing"), "first_clear")


@query(f"{P} SELECT CAST(row_number() OVER (ORDER BY s DESC, id) AS INT) AS rk, id, s, CASE WHEN z = 1 AND z_comp = 0 THEN 'span' WHEN z_comp = 1 AND z = 0 THEN 'rest' ELSE 'both_or_neither' END AS side FROM pair WHERE z_ext = 1")
def positive_cases(spark: SparkSession, d: str) -> DataFrame:
    """The proxy's positives by falling score, with the side that has the mark."""
    side = F.when((F.col("z") == 1) & (F.col("z_comp") == 0), "span").when((F.col("z_comp") == 1) & (F.col("z") == 0), "rest").otherwise("both_or_neither")
    return rank.cases(pairs(spark, d).filter("z_ext = 1").withColumn("side", side), "s", "id").select("rk", "id", "s", "side")


_EXACT = "t AS (SELECT s, count(*) AS n, sum(y) AS p FROM pair GROUP BY s), c AS (SELECT s, n, p, coalesce(sum(n) OVER o, 0) AS bn, coalesce(sum(p) OVER o, 0) AS bp FROM t WINDOW o AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), k AS (SELECT s, bp, 40 - bn AS places FROM c WHERE bn < 40 AND bn + n >= 40)"


@query(f"{P}, {_EXACT}, x AS (SELECT draw, bp, places, CAST(n AS BIGINT) AS tied, CAST(p AS BIGINT) AS pos FROM c JOIN k USING (s, bp), (SELECT unnest(range(0, 50)) AS draw)) SELECT draw, CAST(bp + {hypergeometric_sql('tied', 'pos', 'CAST(places AS BIGINT)', '((' + hash_sql(repr('t'), 'draw') + ' + 0.5) / CAST(4294967296 AS DOUBLE))')} AS BIGINT) AS hits FROM x")
def tie_draws(spark: SparkSession, d: str) -> DataFrame:
    """Positives among the first 40 when ties at the cut fall at random."""
    return resample.tie_draws(pairs(spark, d), "s", "y", 40, 50, "t")


_AUCS = f"WITH {pairs_sql()}, a AS (SELECT lang, auc, n, n_pos FROM {auc_sql('pair', 's', 'y', 'lang')})"
_HM = "sqrt(greatest((auc * (1 - auc) + (n_pos - 1) * (auc / (2 - auc) - auc * auc) + (n - n_pos - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (CAST(n_pos AS DOUBLE) * (n - n_pos)), 0))"


@query(f"{_AUCS} SELECT lang, round(1.96 * {_HM}, 9) AS half_width, CAST(ceil(n_pos * (1.96 * {_HM} / 0.15) * (1.96 * {_HM} / 0.15)) AS BIGINT) AS pos_needed FROM a")
def power_table(spark: SparkSession, d: str) -> DataFrame:
    a = rank.auc(pairs(spark, d), "s", ["y"], ["lang"]).withColumn("neg", F.col("n") - F.col("n_y"))
    return simulate.power(a, "auc_y", "n_y", "neg").select("lang", r9(F.col("half_width")).alias("half_width"), F.col("pos_needed").cast("bigint").alias("pos_needed"))


_T = "(1 / (1 + 0.3275911 * z / sqrt(2.0)))"
_TAIL = f"0.5 * {_T} * (0.254829592 + {_T} * (-0.284496736 + {_T} * (1.421413741 + {_T} * (-1.453152027 + {_T} * 1.061405429)))) * exp(-z * z / 2)"


@query(f"{_AUCS}, z AS (SELECT lang, abs(auc - 0.5) / ((2 * 1.96 * {_HM}) / (2 * 1.959964)) AS z FROM a) SELECT lang, round(least(2 * {_TAIL}, 1.0), 6) AS p FROM z WHERE z IS NOT NULL")
def interval_p(spark: SparkSession, d: str) -> DataFrame:
    """A p-value from an interval, by the normal approximation."""
    a = rank.auc(pairs(spark, d), "s", ["y"], ["lang"])
    _, lo, hi = stats.hanley_mcneil(F.col("auc_y"), F.col("n_y"), F.col("n") - F.col("n_y"))
    return a.select("lang", F.round(multiplicity.interval_p(F.col("auc_y") - 0.5, lo - 0.5, hi - 0.5), 6).alias("p")).filter("p IS NOT NULL")


def _uniform(seed: str, *parts: str) -> str:
    t = " || '-' || ".join([f"'{seed}'", *(f"CAST({p} AS VARCHAR)" for p in parts)])
    return f"((CAST(('0x' || substring(md5({t}), 1, 8)) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE))"


def _normal(seed: str, *parts: str) -> str:
    return f"(sqrt(-2 * ln({_uniform(seed + 'u', *parts)})) * cos(CAST(6.283185307179586 AS DOUBLE) * {_uniform(seed + 'v', *parts)}))"


_GRID = (
    "g AS (SELECT i AS id, CAST(alpha AS DOUBLE) AS alpha FROM (SELECT unnest(range(0, 2000)) AS i), (VALUES (0.0), (0.3), (0.6), (0.9)) AS v(alpha)), "
    f"m AS (SELECT alpha, {_normal('1-u', 'id', 'alpha')} AS u, {_normal('1-v', 'id', 'alpha')} AS v, {_normal('1-e', 'id', 'alpha')} AS e FROM g), "
    "l AS (SELECT alpha, u + 0.3 * e AS s, u AS lz, 0.5 * u + 0.8660254 * e AS lc, alpha * u + sqrt(1 - alpha * alpha) * v AS ly FROM m), "
    "c AS (SELECT alpha, quantile_cont(lz, 0.7) AS cz, quantile_cont(lc, 0.7) AS cc, quantile_cont(ly, 0.7) AS cy FROM l GROUP BY alpha), "
    "x AS (SELECT l.alpha AS alpha, s, CAST(lz > cz AS INT) AS z, CAST(lc > cc AS INT) AS z_comp, CAST(ly > cy AS INT) AS y FROM l JOIN c USING (alpha))"
)


@query(f"WITH {_GRID} SELECT a.alpha AS alpha, a.n AS n, round(a.auc, 9) AS auc_z, round(b.auc, 9) AS auc_z_comp, round(k.auc, 9) AS auc_y, round(abs(b.auc - 0.5) - abs(k.auc - 0.5), 9) AS d_dis FROM {auc_sql('x', 's', 'z', 'alpha')} a JOIN {auc_sql('x', 's', 'z_comp', 'alpha')} b USING (alpha) JOIN {auc_sql('x', 's', 'y', 'alpha')} k USING (alpha)")
def synthetic_grid(spark: SparkSession, d: str) -> DataFrame:
    t = simulate.latent_contracts(spark, 2000, [0.0, 0.3, 0.6, 0.9])
    a = rank.auc(t, "s", ["z", "z_comp", "y"], ["alpha"])
    return a.select("alpha", "n", *(r9(F.col(f"auc_{c}")).alias(f"auc_{c}") for c in ("z", "z_comp", "y")), r9(stats.robust_gap(F.col("auc_z_comp"), F.col("auc_y"))).alias("d_dis"))


def _case(k: str) -> str:
    return _normal(f"7-{k}", "kase", "id")


_CASES = (
    "g AS (SELECT kase, i AS id FROM (SELECT unnest(['valid', 'containment', 'mismatch', 'spillover', 'score_failure', 'high_kappa', 'mixed']) AS kase), (SELECT unnest(range(0, 1500)) AS i)), "
    "b AS (SELECT kase, id, " + ", ".join(f"{_case(k)} AS {k}" for k in ("q", "a", "v", "m", *(f"e{i}" for i in range(8)))) + f", {_uniform('7-flip', 'kase', 'id')} AS flip FROM g), "
    "t AS (SELECT *, 0.30 * q + sqrt(1 - 0.09) * e0 AS qs, 0.80 * v + sqrt(1 - 0.64) * e1 AS vs, 0.80 * v + sqrt(1 - 0.64) * e2 AS vo, 0.80 * m + sqrt(1 - 0.64) * e3 AS ms, 0.80 * m + sqrt(1 - 0.64) * e4 AS mo, 0.7 * q + sqrt(1 - 0.49) * e6 AS q1, 0.7 * q + sqrt(1 - 0.49) * e7 AS q2, CAST(q > 0 AS INT) AS y, CASE WHEN flip < 0.20 THEN 1 - CAST(q > 0 AS INT) ELSE CAST(q > 0 AS INT) END AS merged FROM b), "
    "r AS (SELECT kase, y, CASE kase WHEN 'valid' THEN 0.7 * qs + 0.3 * e5 WHEN 'containment' THEN 0.55 * a + 0.25 * qs WHEN 'mismatch' THEN 0.35 * qs + 0.55 * ms WHEN 'spillover' THEN 0.25 * qs + 0.55 * vs WHEN 'score_failure' THEN 0.55 * a + 0.55 * vs WHEN 'high_kappa' THEN merged + 0.05 * e5 ELSE 0.55 * a + 0.35 * qs + 0.4 * ms END AS s, "
    "CASE kase WHEN 'valid' THEN q1 WHEN 'containment' THEN a WHEN 'mismatch' THEN ms WHEN 'spillover' THEN vs WHEN 'score_failure' THEN a + vs WHEN 'high_kappa' THEN merged ELSE 0.5 * a + 0.5 * ms END AS lz, CASE kase WHEN 'valid' THEN q2 WHEN 'containment' THEN e6 WHEN 'mismatch' THEN mo WHEN 'high_kappa' THEN merged WHEN 'mixed' THEN mo ELSE vo END AS lc FROM t), "
    "c AS (SELECT kase, quantile_cont(lz, 0.5) AS cz, quantile_cont(lc, 0.5) AS cc FROM r GROUP BY kase), "
    "x AS (SELECT r.kase AS kase, s, CASE WHEN r.kase = 'high_kappa' THEN CAST(lz AS INT) ELSE CAST(lz > cz AS INT) END AS z, CASE WHEN r.kase = 'high_kappa' THEN CAST(lc AS INT) ELSE CAST(lc > cc AS INT) END AS z_comp, y FROM r JOIN c USING (kase))"
)


@query(f'WITH {_CASES} SELECT a.kase AS "case", a.n AS n, round(a.auc, 6) AS auc_z, round(b.auc, 6) AS auc_z_comp, round(k.auc, 6) AS auc_y FROM {auc_sql("x", "s", "z", "kase")} a JOIN {auc_sql("x", "s", "z_comp", "kase")} b USING (kase) JOIN {auc_sql("x", "s", "y", "kase")} k USING (kase)')
def named_cases(spark: SparkSession, d: str) -> DataFrame:
    """The seven named synthetic cases."""
    a = rank.auc(simulate.named_cases(spark, 1500), "s", ["z", "z_comp", "y"], ["case"])
    return a.select("case", "n", *(F.round(f"auc_{c}", 6).alias(f"auc_{c}") for c in ("z", "z_comp", "y")))


_PAIR = (
    "g AS (SELECT i AS id, CAST(error AS DOUBLE) AS error FROM (SELECT unnest(range(0, 5000)) AS i), (VALUES (0.02), (0.05), (0.1), (0.2)) AS v(error)), "
    f"t AS (SELECT error, CAST({_uniform('2-a', 'id', 'error')} < 0.3 AS INT) AS a, CAST({_uniform('2-b', 'id', 'error')} < 0.3 AS INT) AS b, {_uniform('2-h', 'id', 'error')} < {{shared}} AS hard, {_uniform('2-fa', 'id', 'error')} AS fa, {_uniform('2-fb', 'id', 'error')} AS fb FROM g), "
    "j AS (SELECT error, a, b, CASE WHEN fa < CASE WHEN hard THEN 0.5 ELSE error END THEN 1 - a ELSE a END AS ja, CASE WHEN fb < CASE WHEN hard THEN 0.5 ELSE error END THEN 1 - b ELSE b END AS jb FROM t), "
    "p AS (SELECT *, CAST(a <> b AS INT) AS pr, CAST(ja <> jb AS INT) AS jp FROM j)"
)


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {_PAIR.format(shared=sh)} SELECT CAST({sh} AS DOUBLE) AS shared, error, round({kappa_sql('a', 'ja')}, 9) AS side_kappa, round({kappa_sql('pr', 'jp')}, 9) AS pair_kappa FROM p GROUP BY error)" for sh in (0.0, 0.2)))
def pair_kappa_sim(spark: SparkSession, d: str) -> DataFrame:
    """How judges' errors compound in a pair's label, independent and with a share of cases that are hard for both sides."""
    parts = []
    for shared in (0.0, 0.2):
        t = simulate.pair_kappa(spark, 5000, [0.02, 0.05, 0.1, 0.2], shared=shared)
        side = agree.kappa(t, "a", "ja", ["error"]).select("error", F.col("kappa").alias("side_kappa"))
        both = side.join(agree.kappa(t, "pair", "judged_pair", ["error"]).select("error", F.col("kappa").alias("pair_kappa")), "error")
        parts.append(both.select(F.lit(shared).alias("shared"), "error", r9(F.col("side_kappa")).alias("side_kappa"), r9(F.col("pair_kappa")).alias("pair_kappa")))
    return parts[0].union(parts[1])


_PER = f"g AS (SELECT source, auc AS a FROM {auc_sql('pair', 's', 'z_ext', 'source')}), h AS (SELECT source, auc AS b FROM {auc_sql('pair', 's', 'y', 'source')}), per AS (SELECT source, a, b FROM g FULL JOIN h USING (source))"


@query(
    f"{P}, {_PER}, l AS (SELECT source, 'a' AS label, a AS v FROM per WHERE a IS NOT NULL UNION ALL SELECT source, 'b', b FROM per WHERE b IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_HASH.format(t=chr(39) + 'slot-' + chr(39) + ' || source')}, source) - 1 AS i, count(*) OVER (PARTITION BY label) AS size FROM l), "
    f"w AS (SELECT draw, label, {_HASH.format(t=chr(39) + 'g-' + chr(39) + ' || label || ' + chr(39) + '-' + chr(39) + ' || CAST(draw AS VARCHAR) || ' + chr(39) + '-' + chr(39) + ' || CAST(i AS VARCHAR)')} % size AS i FROM n, (SELECT unnest(range(0, 50)) AS draw)), "
    "m AS (SELECT draw, avg(v) FILTER (label = 'a') AS a, avg(v) FILTER (label = 'b') AS b FROM w JOIN n USING (label, i) GROUP BY draw) SELECT draw, round(a - b, 9) AS gap, round(abs(a - 0.5) - abs(b - 0.5), 9) AS robust_gap FROM m"
)
def group_gap(spark: SparkSession, d: str) -> DataFrame:
    """Mean within-source AUCs against two labels, sources resampled for each on their own."""
    per = rank.auc(pairs(spark, d), "s", ["z_ext", "y"], ["source"])
    return resample.group_gap(per, "source", "auc_z_ext", "auc_y", 50, "g").select("draw", r9(F.col("gap")).alias("gap"), r9(F.col("robust_gap")).alias("robust_gap"))


_ONE = _permuted("z_comp", "o", "", 50)
_E = "pair AS (SELECT CAST(user_id AS VARCHAR) AS g, CAST(event_id AS VARCHAR) AS id, value AS s, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM events)"


@query(f"{P}, {_ONE}, d AS (SELECT auc - 0.4 AS v FROM {_weighted('pm', 's', 'zp')} WHERE auc IS NOT NULL), o AS (SELECT list(v ORDER BY v) AS v, count(*) AS m FROM d) SELECT m AS draws, round(v[CAST(floor(m * 0.025) AS INT) + 1], 9) AS lo, round(v[greatest(CAST(floor(m * 0.975) AS INT), 1)], 9) AS hi, round((SELECT (count(*) FILTER (v <= 0) + 1) / CAST(count(*) + 1 AS DOUBLE) FROM d), 9) AS p, (SELECT count(*) >= 400 FROM d) AS enough FROM o")
def shuffle_interval(spark: SparkSession, d: str) -> DataFrame:
    """Labels shuffled over all rows: an interval by order statistics, a one-sided p, and whether a run of 1,600 draws of which only these are valid would be void."""
    null = resample.label_shuffle(pairs(spark, d), "id", "s", "z_comp", 50, "o")
    v = null.select((F.col("auc") - 0.4).alias("v"))
    both = resample.order_interval(v, "v").crossJoin(resample.one_sided(v, "v", 50).select("p")).crossJoin(resample.one_sided(v, "v", 1600).select(F.col("p").isNotNull().alias("enough")))  # single rows
    return both.select("draws", r9(F.col("lo")).alias("lo"), r9(F.col("hi")).alias("hi"), r9(F.col("p")).alias("p"), "enough")


@query(f"WITH {_E}, {_permuted('y', 'g', ', g', 20)} SELECT draw, round(auc, 9) AS auc FROM {_weighted('pm', 's', 'zp')}")
def within_group_null(spark: SparkSession, d: str) -> DataFrame:
    """Labels permuted within users: the simulated half beside the exact mean."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("g"), F.col("event_id").cast("string").alias("id"), F.col("value").alias("s"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    return resample.within_null(e, "id", "s", "y", "g", 20, "g").select("draw", r9(F.col("auc")).alias("auc"))


_WAYS = {"random": f"{_HASH.format(t=chr(39) + '3-' + chr(39) + ' || id')}, id", "adversarial": "s, id", "favourable": "s DESC, id"}
_KEEP = "least(round_even(0.05 * (SELECT count(*) FROM pair WHERE y = 0) / CAST(0.95 AS DOUBLE), 0), (SELECT count(*) FROM pair WHERE y = 1))"


@query(P + " " + " UNION ALL ".join(f"SELECT '{how}' AS how, n, n_pos, round(auc, 9) AS auc FROM (WITH x AS (SELECT s, y FROM pair WHERE y = 0 UNION ALL SELECT s, y FROM (SELECT s, y, row_number() OVER (ORDER BY {order}) AS r FROM pair WHERE y = 1) WHERE r <= {_KEEP}) SELECT * FROM {auc_sql('x', 's', 'y')})" for how, order in _WAYS.items()))
def rate_targeted_subsamples(spark: SparkSession, d: str) -> DataFrame:
    """Positives thinned to five in a hundred: at random, the lowest scores, the highest."""
    p, parts = pairs(spark, d), []
    for how in _WAYS:
        kept = resample.at_rate(p, "id", "s", "y", 0.05, how, 3, least=1)
        parts.append(rank.auc(kept, "s", ["y"]).select(F.lit(how).alias("how"), "n", F.col("n_y").alias("n_pos"), r9(F.col("auc_y")).alias("auc")))
    return parts[0].union(parts[1]).union(parts[2])


@query()
def oof_two_targets(spark: SparkSession, d: str) -> DataFrame:
    """Surface features scored out of fold for two targets on shared folds, and the AUC of each."""
    p = pairs(spark, d).select("id", "y", "z_ext", *(F.col(c).cast("double").alias(c) for c in ("s", "len")))
    return learned.oof_targets(p, "id", ["s", "len"], ["y", "z_ext"])


@query()
def oof_text(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("doc_id").cast("string").alias("id"), F.col("toxic").alias("y"), "text")
    scored = kept(learned.oof_text(p, "id", "text", "y", k=3, vocabulary=2000), "scores")  # read several times
    return rank.auc(scored, "score", ["y"]).select("n", F.col("n_y").alias("n_pos"), F.round("auc_y", 3).alias("auc"))


@query()
def language_probe(spark: SparkSession, d: str) -> DataFrame:
    """Balanced accuracy of a linear probe for the language from counts of four letters."""
    t = table(spark, d, "documents")
    low = F.lower(tx.body("text"))
    share = lambda c: ((F.length(low) - F.length(F.translate(low, c, ""))) / F.greatest(F.length(low), F.lit(1))).alias(f"f_{c}")
    return learned.probe(t.select("doc_id", "lang", *(share(c) for c in "ehos")), "doc_id", ["f_e", "f_h", "f_o", "f_s"], "lang", k=3).withColumn("balanced_accuracy", F.round("balanced_accuracy", 2))


@query()
def projection(spark: SparkSession, d: str) -> DataFrame:
    """Two principal components of three features."""
    p = pairs(spark, d).select("id", *(F.col(c).cast("double").alias(c) for c in ("s", "len", "z_ext")))
    return learned.project(p, ["s", "len", "z_ext"]).select("id", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query()
def platt_calibration(spark: SparkSession, d: str) -> DataFrame:
    """A score through a one-feature logistic regression, and its calibration error."""
    p = calibrate.platt(pairs(spark, d).select("id", "y", F.col("s").cast("double").alias("s")), "s", "y")
    return calibrate.calibration_error(calibrate.reliability(p, "p", "y")).select("n", F.round("ece", 4).alias("ece"))

