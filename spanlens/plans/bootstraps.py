"""Queries of statistics bootstrapped on counts of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as tx
from ..operators import cells, noise, rank, spans
from ..sources import kept, table
from .contracts import pairs, pairs_sql, r9
from .draws_sql import auc_sql, binomial_sql, deal_sql, hash_sql, order_ends_sql
from .registry import query

DRAWS = 400


def _cells_sql(a: str, b: str, src: str = "pair", keys: str = "") -> str:
    return f"SELECT {keys}{a} AS a, {b} AS b, count(*) AS c FROM {src} GROUP BY ALL"


_COUNTS = {"n11": "CASE WHEN a = 1 AND b = 1 THEN w ELSE 0 END", "n10": "CASE WHEN a = 1 AND b = 0 THEN w ELSE 0 END", "n01": "CASE WHEN a = 0 AND b = 1 THEN w ELSE 0 END", "n00": "CASE WHEN a = 0 AND b = 0 THEN w ELSE 0 END"}
_SUMS = ", ".join(f"CAST(sum({v}) AS DOUBLE) AS {k}" for k, v in _COUNTS.items())
_PE = "((n11 + n10) * (n11 + n01) + (n00 + n01) * (n00 + n10)) / (n * n)"
_MEASURES = {
    "accuracy": "(n11 + n00) / n",
    "kappa": f"CASE WHEN {_PE} < 1 THEN ((n11 + n00) / n - {_PE}) / (1 - {_PE}) END",
    "mcc": "CASE WHEN (n11 + n10) * (n11 + n01) * (n00 + n10) * (n00 + n01) > 0 THEN (n11 * n00 - n10 * n01) / sqrt((n11 + n10) * (n11 + n01) * (n00 + n10) * (n00 + n01)) ELSE 0 END",
    "fpr": "CASE WHEN n10 + n00 > 0 THEN n10 / (n10 + n00) END",
    "fnr": "CASE WHEN n11 + n01 > 0 THEN n01 / (n11 + n01) END",
}


def agreement(a: str, b: str) -> dict:
    """Statistics of two binary labels as aggregates over cells weighted by a column: accuracy, kappa, MCC, and the first one's error rates against the second."""

    def counts(w: str) -> list:
        return [F.sum(F.when((F.col(a) == i) & (F.col(b) == j), F.col(w)).otherwise(0)).cast("double") for i, j in ((1, 1), (1, 0), (0, 1), (0, 0))]

    def of(f):
        return lambda w: f(*counts(w))

    return {
        "accuracy": of(lambda tp, fp, fn, tn: (tp + tn) / (tp + fp + fn + tn)),
        "kappa": of(stats.kappa),
        "mcc": of(stats.mcc),
        "fpr": of(lambda tp, fp, fn, tn: F.when(fp + tn > 0, fp / (fp + tn))),
        "fnr": of(lambda tp, fp, fn, tn: F.when(tp + fn > 0, fn / (tp + fn))),
    }




@query(
    f"WITH {pairs_sql()}, src AS ({_cells_sql('CAST(s > 28 AS INT)', 'q', keys='lang, ')}), {deal_sql('d', 'src', ['a', 'b'], DRAWS, 'b', ['lang'])}, "
    f"v AS (SELECT lang, draw, " + ", ".join(f"{e} AS {k}" for k, e in _MEASURES.items()) + f" FROM (SELECT *, n11 + n10 + n01 + n00 AS n FROM (SELECT lang, draw, {_SUMS} FROM d GROUP BY lang, draw))), "
    f"o AS (SELECT lang, " + ", ".join(order_ends_sql(k) for k in _MEASURES) + " FROM v GROUP BY lang) "
    "SELECT lang, " + ", ".join(f"draws_{k}, round(lo_{k}, 9) AS lo_{k}, round(hi_{k}, 9) AS hi_{k}" for k in _MEASURES) + " FROM o"
)
def agreement_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, kappa, MCC and error rates of a thresholded score against quality, with bootstrap intervals by language; order-statistic ends."""
    p = pairs(spark, d).select("lang", (F.col("s") > 28).cast("int").alias("a"), F.col("q").alias("b"))
    found = cells.statistic(cells.cells(p, ["a", "b"], ["lang"]), ["a", "b"], agreement("a", "b"), DRAWS, "b", ["lang"])
    ends = cells.order_ends(found, list(_MEASURES), ["lang"])
    return ends.select("lang", *(c for k in _MEASURES for c in (F.col(f"draws_{k}").cast("bigint").alias(f"draws_{k}"), r9(F.col(f"lo_{k}")).alias(f"lo_{k}"), r9(F.col(f"hi_{k}")).alias(f"hi_{k}"))))


_FLEISS = "((sum(w * (v * v + (3 - v) * (3 - v) - 3)) / CAST(6 * sum(w) AS DOUBLE)) - (pow(sum(w * v) / CAST(3 * sum(w) AS DOUBLE), 2) + pow(1 - sum(w * v) / CAST(3 * sum(w) AS DOUBLE), 2))) / (1 - (pow(sum(w * v) / CAST(3 * sum(w) AS DOUBLE), 2) + pow(1 - sum(w * v) / CAST(3 * sum(w) AS DOUBLE), 2)))"


def fleiss_of_votes(v: str, raters: int):
    """Fleiss' kappa of `raters` binary votes from counts of the number of ones; null where they all agree on one class."""

    def of(w: str):
        x, n = F.col(v), F.sum(F.col(w)).cast("double")
        agree = F.sum(F.col(w) * (x * x + (raters - x) * (raters - x) - raters)) / (n * raters * (raters - 1))
        p = F.sum(F.col(w) * x) / (n * raters)
        chance = p * p + (1 - p) * (1 - p)
        return F.when(chance < 1, (agree - chance) / (1 - chance))

    return of


@query(
    f"WITH {pairs_sql()}, src AS (SELECT z_ext + y + q AS v, count(*) AS c FROM pair GROUP BY ALL), {deal_sql('d', 'src', ['v'], DRAWS, 'f')}, "
    f"f AS (SELECT draw, CASE WHEN min(v) < 3 OR max(v) > 0 THEN CASE WHEN (sum(w * v) > 0 AND sum(w * v) < 3 * sum(w)) THEN {_FLEISS} END END AS fleiss, sum(CASE WHEN v IN (0, 3) THEN w ELSE 0 END) / CAST(sum(w) AS DOUBLE) AS unanimous FROM d GROUP BY draw), "
    f"o AS (SELECT {order_ends_sql('fleiss')}, {order_ends_sql('unanimous')} FROM f) SELECT draws_fleiss, round(lo_fleiss, 9) AS lo_fleiss, round(hi_fleiss, 9) AS hi_fleiss, round(lo_unanimous, 9) AS lo_unanimous, round(hi_unanimous, 9) AS hi_unanimous FROM o"
)
def fleiss_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Fleiss' kappa of three labels and their unanimity, bootstrapped."""
    p = pairs(spark, d).select((F.col("z_ext") + F.col("y") + F.col("q")).alias("v"))
    unanimous = lambda w: F.sum(F.when(F.col("v").isin(0, 3), F.col(w)).otherwise(0)) / F.sum(w)
    found = cells.statistic(cells.cells(p, ["v"]), ["v"], {"fleiss": fleiss_of_votes("v", 3), "unanimous": unanimous}, DRAWS, "f")
    ends = cells.order_ends(found, ["fleiss", "unanimous"])
    return ends.select(F.col("draws_fleiss").cast("bigint").alias("draws_fleiss"), *(r9(F.col(f"{e}_{k}")).alias(f"{e}_{k}") for k in ("fleiss", "unanimous") for e in ("lo", "hi")))


#: Spans of the walk, in characters, and the cues that are walked, with the letter that the score counts.
SPANS, CUES = (1, 10, 25, 50, 80, 120, 160, 200, 250, 300, 400, 500, 600, 800, 1000, 1400, 2000, 4000), (("ion", "o"), ("re", "r"), ("the", "h"), ("de", "d"))
_WALK_DRAWS = 200
_T = "coalesce(text, '')"
_VALUES = ", ".join(f"({i}, {k})" for i, k in enumerate(SPANS))
_WALK = (
    f"WITH sp AS (SELECT * FROM (VALUES {_VALUES}) AS v(i, span)), t AS (SELECT doc_id, {_T} AS t, cue, CAST(length(substring({_T}, 1, 50)) - length(replace(substring({_T}, 1, 50), letter, '')) AS BIGINT) AS s, CAST(coalesce(lang = 'en', false) AS INT) AS y FROM documents, (VALUES " + ", ".join(f"('{c}', '{x}')" for c, x in CUES) + ") AS c(cue, letter)), "
    "b AS (SELECT cue, doc_id, s, y, CAST(count(*) FILTER (NOT contains(substring(t, 1, span), cue)) AS INT) AS b_in, CAST(count(*) FILTER (contains(substring(t, span + 1), cue)) AS INT) AS b_out FROM t, sp GROUP BY ALL), "
    "src AS MATERIALIZED (SELECT cue, s, y, b_in, b_out, count(*) AS c FROM b GROUP BY ALL), "
    f"{deal_sql('d', 'src', ['s', 'y', 'b_in', 'b_out'], _WALK_DRAWS, 'walk', ['cue'])}, "
    "e AS (SELECT cue, draw, i, s, y, CAST(i >= b_in AS INT) AS z, w FROM d, sp), "
    f"g AS (SELECT a.cue AS cue, a.i AS i, quantile_cont(a.auc - b.auc, 0.025) AS lo, quantile_cont(a.auc - b.auc, 0.975) AS hi FROM {auc_sql('e', 's', 'z', ['cue', 'draw', 'i'])} a JOIN {auc_sql('d', 's', 'y', ['cue', 'draw'])} b ON a.cue = b.cue AND a.draw = b.draw GROUP BY ALL), "
    "o AS (SELECT cue, i, s, y, CAST(i >= b_in AS INT) AS z, CAST(i < b_out AS INT) AS zc, c AS w FROM src, sp), "
    "m AS (SELECT cue, i, CAST(sum(w) AS BIGINT) AS n, CAST(sum(w * z) AS BIGINT) AS n_z, count(DISTINCT CASE WHEN z = 1 THEN s END) AS at_z FROM o GROUP BY ALL), mm AS (SELECT cue, max(c) / CAST(sum(c) AS DOUBLE) AS modal FROM (SELECT cue, s, sum(c) AS c FROM src GROUP BY ALL) GROUP BY cue), "
    f"wk AS (SELECT m.cue AS cue, m.i AS i, sp.span AS span, m.n_z AS n_z, m.n_z / CAST(m.n AS DOUBLE) AS coverage, z.auc AS auc_z, zc.auc AS auc_z_comp, y.auc AS auc_y, z.auc - y.auc AS gap, g.lo AS lo, g.hi AS hi, "
    "CASE WHEN m.n_z = 0 OR m.n_z = m.n THEN 'no proxy variation' WHEN m.at_z <= 1 OR mm.modal > 0.5 THEN 'score degenerate' WHEN g.lo > 0 THEN 'coupled' ELSE 'clear' END AS status "
    f"FROM m JOIN mm ON m.cue = mm.cue JOIN sp ON sp.i = m.i JOIN {auc_sql('o', 's', 'z', ['cue', 'i'])} z ON z.cue = m.cue AND z.i = m.i JOIN {auc_sql('o', 's', 'zc', ['cue', 'i'])} zc ON zc.cue = m.cue AND zc.i = m.i JOIN {auc_sql('(SELECT * FROM o WHERE i = 0)', 's', 'y', ['cue'])} y ON y.cue = m.cue LEFT JOIN g ON g.cue = m.cue AND g.i = m.i)"
)
_WALKED = ("coverage", "auc_z", "auc_z_comp", "auc_y", "gap", "lo", "hi")


def _walk(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("t", tx.body("text"))
    head = tx.prefix(F.col("t"), 50)
    score = lambda x: (F.length(head) - F.length(F.replace(head, F.lit(x), F.lit("")))).cast("bigint").alias("s")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("cue"), score(x), *spans.offset_index(F.col("t"), [c])) for c, x in CUES)))
    rows = docs.select(F.coalesce(F.col("lang") == "en", F.lit(False)).cast("int").alias("y"), each.alias("x")).select("y", "x.*")
    return spans.walk(rows, "s", "y", SPANS, _WALK_DRAWS, "walk", ["cue"])


@query(f"{_WALK} SELECT cue, span, n_z, " + ", ".join(f"round({c}, 9) AS {c}" for c in _WALKED) + ", status FROM wk")
def span_walk(spark: SparkSession, d: str) -> DataFrame:
    """The gap between proxy and construct at eighteen spans, with bootstrap intervals, from one read of the texts: a score that counts a letter in fifty characters, the cue in the span as its proxy, English as the construct. Each text gives where its first cue ends and its last one begins."""
    return _walk(spark, d).select("cue", "span", "n_z", *(r9(F.col(c)).alias(c) for c in _WALKED), "status")


@query(
    f"{_WALK}, u AS (SELECT *, row_number() OVER (PARTITION BY cue ORDER BY i) AS k, lag(span) OVER w AS span0, lag(gap) OVER w AS gap0, lag(coverage) OVER w AS cov0 FROM wk WHERE status IN ('coupled', 'clear') WINDOW w AS (PARTITION BY cue ORDER BY i)), "
    "f AS (SELECT cue, min(k) AS k FROM u WHERE status = 'clear' GROUP BY cue), x AS (SELECT cue, arg_min(span0 + gap0 / (gap0 - gap) * (span - span0), k) AS crossing FROM u WHERE gap0 > 0 AND gap <= 0 GROUP BY cue) "
    "SELECT c.cue AS cue, u.span0 AS last_coupled, u.span AS first_clear, round((u.span0 + u.span) / CAST(2 AS DOUBLE), 9) AS closure, round((u.cov0 + u.coverage) / CAST(2 AS DOUBLE), 9) AS coverage, round(CASE WHEN u.k IS NOT NULL THEN x.crossing END, 9) AS zero_crossing FROM (SELECT DISTINCT cue FROM wk) c LEFT JOIN f ON f.cue = c.cue AND f.k > 1 LEFT JOIN u ON u.cue = f.cue AND u.k = f.k LEFT JOIN x ON x.cue = c.cue"
)
def span_closure_walk(spark: SparkSession, d: str) -> DataFrame:
    """Where the walked gap stops being clearly positive, halfway between the last coupled and the first clear span, and where it crosses zero."""
    return spans.closure(_walk(spark, d), ["cue"]).select("cue", "last_coupled", "first_clear", *(r9(F.col(c)).alias(c) for c in ("closure", "coverage", "zero_crossing")))


_N = "s2 AS (SELECT -s AS s, y, z_ext, id FROM pair)"
_SWAPS = (
    f"WITH {pairs_sql()}, {_N}, o AS (SELECT *, CASE WHEN y = 1 THEN row_number() OVER (PARTITION BY y ORDER BY s, id) ELSE row_number() OVER (PARTITION BY y ORDER BY s DESC, id) END AS r FROM s2), "
    "k AS (SELECT least(count(*) FILTER (y = 1), count(*) FILTER (y = 0)) AS most, count(*) AS n FROM s2), x AS (SELECT t, s, CASE WHEN r <= t THEN 1 - y ELSE y END AS y, 1 AS w FROM o, (SELECT unnest(range(0, most + 1)) AS t FROM k)), "
    f"a AS (SELECT t, auc FROM {auc_sql('x', 's', 'y', ['t'])}), z AS (SELECT auc FROM {auc_sql('(SELECT s, z_ext, 1 AS w FROM s2)', 's', 'z_ext', [])}), y0 AS (SELECT auc FROM a WHERE t = 0)"
)


@query(
    f"{_SWAPS}, g AS (SELECT auc AS surface, auc - m AS target FROM z, (VALUES (CAST(0.4 AS DOUBLE)), (0.3), (0.15), (-0.2)) AS v(m)), f AS (SELECT surface, target, min(t) AS t FROM g LEFT JOIN a ON a.auc >= target - 1e-9 GROUP BY ALL) "
    "SELECT n, round(y0.auc, 9) AS auc, round(target, 9) AS target, most AS max_swaps, f.t AS min_swaps, 2 * f.t AS min_flips, round(2 * f.t / CAST(n AS DOUBLE), 9) AS flip_rate, round(a.auc, 9) AS auc_at FROM f CROSS JOIN k CROSS JOIN y0 LEFT JOIN a ON a.t = f.t"
)
def swap_target(spark: SparkSession, d: str) -> DataFrame:
    """The least swaps of labels that lift the construct's AUC to within four margins of the proxy's; the SQL tries every number of swaps."""
    p = pairs(spark, d).withColumn("s", -F.col("s"))
    surface = rank.auc(p, "s", ["z_ext"]).select(F.col("auc_z_ext").alias("surface")).first()[0]  # one number
    return noise.swap_targets(p, "s", "y", [surface - m for m in (0.4, 0.3, 0.15, -0.2)]).select("n", r9(F.col("auc")).alias("auc"), r9(F.col("target")).alias("target"), "max_swaps", "min_swaps", "min_flips", r9(F.col("flip_rate")).alias("flip_rate"), r9(F.col("auc_at")).alias("auc_at"))


_BUDGETS = ((0, 0), (5, 0), (0, 5), (10, 20), (40, 100))


@query(
    f"WITH {pairs_sql()}, {_N}, r AS (SELECT *, CASE WHEN y = 1 THEN row_number() OVER (PARTITION BY y ORDER BY s DESC, id) ELSE row_number() OVER (PARTITION BY y ORDER BY s, id) END AS r FROM s2), "
    f"x AS (SELECT down, up, s, CASE WHEN r <= CASE WHEN y = 1 THEN down ELSE up END THEN 1 - y ELSE y END AS y, 1 AS w FROM r, (VALUES {', '.join(f'({a}, {b})' for a, b in _BUDGETS)}) AS v(down, up)) SELECT down, up, round(auc, 9) AS auc FROM {auc_sql('x', 's', 'y', ['down', 'up'])}"
)
def worst_flips(spark: SparkSession, d: str) -> DataFrame:
    """The AUC after the most harmful flips within budgets by class."""
    return noise.worst_flips(pairs(spark, d).withColumn("s", -F.col("s")), "s", "y", _BUDGETS).withColumn("auc", r9(F.col("auc")))


_MEASURED = 200
#: Rates at which the two sides' labels are wrong, by the label: side a (the mark), side b (toxic).
_RATES = {"a": {0: 0.02, 1: 0.15}, "b": {0: 0.04, 1: 0.1}}
_P, _Q = ("CASE {c} WHEN 0 THEN {z} ELSE {o} END".format(c=c, z=_RATES[s][0], o=_RATES[s][1]) for s, c in (("a", "a"), ("b", "b")))
_HOW = {"independent": f"(CAST({_P} AS DOUBLE) + {_Q} - 2 * CAST({_P} AS DOUBLE) * {_Q})", "opposed": f"(CAST({_P} AS DOUBLE) + {_Q} - 2 * greatest(CAST({_P} AS DOUBLE) + {_Q} - 1, 0.0))"}


@query(
    f"WITH {pairs_sql()}, q AS (SELECT -s AS s, z_ext AS a, y AS b, CAST(row_number() OVER (ORDER BY s, id) <= 55 AS INT) AS queued, CAST(z_ext <> y AS INT) AS y FROM pair), src AS (SELECT s, a, b, queued, y, count(*) AS c FROM q GROUP BY ALL), "
    + ", ".join(
        f"k_{h} AS MATERIALIZED (SELECT draw, s, a, b, queued, y, c, {binomial_sql('c', r, '((' + hash_sql(repr(h), 'draw', 's', 'a', 'b', 'queued', 'y') + ' + 0.5) / CAST(4294967296 AS DOUBLE))')} AS k FROM (SELECT *, {r} AS r FROM src), (SELECT unnest(range(0, {_MEASURED})) AS draw)), "
        f"x_{h} AS (SELECT '{h}' AS errors, draw, s, queued, y, c - k AS w FROM k_{h} UNION ALL SELECT '{h}', draw, s, queued, 1 - y, k FROM k_{h})"
        for h, r in _HOW.items()
    )
    + f", x AS (SELECT * FROM x_independent UNION ALL SELECT * FROM x_opposed), g AS (SELECT a.errors AS errors, a.draw AS draw, a.auc AS auc, sum(CASE WHEN x.queued = 1 AND x.y = 1 THEN x.w ELSE 0 END) AS routed FROM {auc_sql('x', 's', 'y', ['errors', 'draw'])} a JOIN x ON x.errors = a.errors AND x.draw = a.draw GROUP BY ALL) "
    "SELECT errors, count(auc) AS draws, round(avg(auc), 9) AS mean, round(quantile_cont(auc, 0.025), 9) AS lo, round(quantile_cont(auc, 0.975), 9) AS hi, round(avg(CASE WHEN auc > 0.7 THEN 1.0 ELSE 0.0 END), 9) AS above, round(avg(routed), 9) AS routed FROM g GROUP BY errors"
)
def measured_flips(spark: SparkSession, d: str) -> DataFrame:
    """The AUC and the queue of a disagreement of two labels that are wrong at given rates, independently, or on opposed sides."""
    p = pairs(spark, d)
    top = rank.ranked(p.withColumn("s", -F.col("s")), "s", "id", most=55).select("id", F.lit(1).alias("queued"))
    rows = p.join(F.broadcast(top), "id", "left").select((-F.col("s")).alias("s"), F.col("z_ext").alias("a"), F.col("y").alias("b"), F.coalesce("queued", F.lit(0)).alias("queued"), (F.col("z_ext") != F.col("y")).cast("int").alias("y"))  # 55 rows
    cols = ["s", "a", "b", "queued"]
    table = kept(cells.cells(rows, [*cols, "y"]), "flip-cells")
    rate = lambda side: F.when(F.col(side) == 0, F.lit(_RATES[side][0])).otherwise(F.lit(_RATES[side][1]))
    ranges = cells.ranged(table.select("s").distinct(), "s").select("s", "range")
    parts = []
    for errors in _HOW:
        drawn = noise.measured_flips(table, noise.change_rate(rate("a"), rate("b"), errors == "opposed"), _MEASURED, errors, cols, "y").join(ranges, "s")
        a = cells.aucs(drawn, "s", ["y"], ["draw"]).join(drawn.groupBy("draw").agg(F.sum(F.when((F.col("queued") == 1) & (F.col("y") == 1), F.col("w")).otherwise(0)).alias("routed")), "draw")
        v = F.col("auc_y")
        parts.append(a.agg(F.lit(errors).alias("errors"), F.count(v).alias("draws"), r9(F.avg(v)).alias("mean"), r9(F.percentile(v, F.lit(0.025))).alias("lo"), r9(F.percentile(v, F.lit(0.975))).alias("hi"), r9(F.avg((v > 0.7).cast("double"))).alias("above"), r9(F.avg("routed")).alias("routed")))
    return parts[0].union(parts[1])


_SHUFFLES = 400


@query(
    f"WITH {pairs_sql()}, t AS (SELECT s, CAST(count(*) AS BIGINT) AS c, CAST(sum(q) AS BIGINT) AS p FROM pair GROUP BY s), src AS (SELECT s, c, (SELECT CAST(sum(p) AS BIGINT) FROM t) AS take FROM t), {deal_sql('d', 'src', ['s'], _SHUFFLES, 'shuffle', [], 'take')}, "
    f"x AS (SELECT draw, s, 1 AS y, w FROM d UNION ALL SELECT draw, s, 0, -w FROM d UNION ALL SELECT draw, s, 0, c FROM t, (SELECT unnest(range(0, {_SHUFFLES})) AS draw)), n AS (SELECT auc AS v FROM {auc_sql('x', 's', 'y', ['draw'])}), o AS (SELECT auc FROM {auc_sql('(SELECT s, q AS y, 1 AS w FROM pair)', 's', 'y', [])}) "
    "SELECT round(max(auc), 9) AS auc, round(avg(v), 9) AS null_mean, round(stddev_pop(v), 9) AS null_sd, round(quantile_cont(v, 0.99), 9) AS null_p99, round(avg(CASE WHEN round(v, 9) >= round(auc, 9) THEN 1.0 ELSE 0.0 END), 9) AS p_one, round(avg(CASE WHEN round(abs(round(v, 9) - 0.5), 9) >= round(abs(round(auc, 9) - 0.5), 9) THEN 1.0 ELSE 0.0 END), 9) AS p_two FROM n, o"
)
def shuffle_p(spark: SparkSession, d: str) -> DataFrame:
    """One- and two-sided p-values of quality's AUC under shuffles of its labels."""
    return noise.shuffle_p(pairs(spark, d), "s", "q", _SHUFFLES, "shuffle").select(*(r9(F.col(c)).alias(c) for c in ("auc", "null_mean", "null_sd", "null_p99", "p_one", "p_two")))
