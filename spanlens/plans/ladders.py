"""Queries of verdicts on contracts that reach every branch: one table of cells, one set of draws, all rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import cells, contracts
from ..operators import verdict as vd
from ..sources import kept, table
from .contracts import r9
from .draws_sql import auc_sql, deal_sql
from .registry import query

DRAWS = 200
_T = "coalesce(text, '')"


def _per_mille(part: str) -> str:
    """How often a two-letter part stands in a thousand characters."""
    return f"CAST(floor(500.0 * (length({_T}) - length(replace({_T}, '{part}', ''))) / greatest(length({_T}), 1)) AS BIGINT)"


def _letters(part: str, n: int) -> str:
    return f"CAST(length(substring({_T}, 1, {n})) - length(replace(substring({_T}, 1, {n}), '{part}', '')) AS BIGINT)"


#: name: score, construct (null: the row takes no part), cue of the proxy, span. The expressions read alike in Spark and DuckDB.
CONTRACTS = {
    "gap": (_per_mille("th"), "quality", "the", 50),
    "gap_wide": (_per_mille("th"), f"CASE WHEN lang = 'en' THEN doc_id % 3 > 0 ELSE doc_id % 3 = 0 END", "the", 50),
    "small_gap": (_per_mille("th"), "CASE WHEN lang = 'en' THEN doc_id % 11 > 0 ELSE doc_id % 11 = 0 END", "the", 50),
    "merged": (_per_mille("th"), "lang = 'en'", "the", 50),
    "backwards": (f"1000 - {_per_mille('th')}", "lang = 'en'", "ing", 50),
    "chance_ranked": (f"CAST(length({_T}) // 200 AS BIGINT)", "lang = 'en'", "er", 300),
    "chance_unranked": ("CAST(doc_id % 89 AS BIGINT)", "lang = 'en'", "the", 50),
    "wide": (_letters(" ", 200), "toxic", "!", 50),
    "rare": (_per_mille("th"), "lang = 'fr' AND source LIKE '%1%' AND doc_id % 20 = 1", "the", 50),
    "short": (_per_mille("th"), "lang = 'en'", "the", 1500),
    "coarse": (f"CAST(length({_T}) - length(replace({_T}, '!', '')) AS BIGINT)", "lang = 'en'", "the", 50),
    "flat": (_per_mille("th"), "lang = 'en'", "#no#", 50),
    "contained": (_letters(" ", 200), "lang = 'en'", "sg", 50),
    "within_null": (_letters(" ", 200), "lang = 'en'", "1", 50),
    "local": (_letters("h", 50), "CASE WHEN lang = 'en' THEN doc_id % 4 > 0 ELSE doc_id % 4 = 0 END", "th", 50),
    "shared": (_per_mille("th"), "CASE WHEN lang = 'en' THEN doc_id % 4 > 0 ELSE doc_id % 4 = 0 END", "ou", 50),
}
COLS = ["s", "y", "z", "z_comp", "z_ext", "empty"]


def _cells_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS contract, {s} AS s, CAST({y} AS INT) AS y, CAST(contains(substring({_T}, 1, {k}), '{cue}') AS INT) AS z, CAST(contains(substring({_T}, {k + 1}), '{cue}') AS INT) AS z_comp, CAST(contains({_T}, '{cue}') AS INT) AS z_ext, CAST(length({_T}) <= {k} AS INT) AS empty FROM d WHERE ({y}) IS NOT NULL"
        for name, (s, y, cue, k) in CONTRACTS.items()
    )
    return f"d AS (SELECT documents.*, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)), src AS MATERIALIZED (SELECT *, count(*) AS c FROM ({rows}) GROUP BY ALL)"


def grid(spark: SparkSession, d: str) -> DataFrame:
    """contract, s, y, z, z_comp, z_ext, empty, c: cells of all contracts from one read of the texts."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("__t", tx.body("text"))

    def sql(e: str) -> Column:
        return F.expr(e.replace(_T, "__t").replace("//", "DIV"))

    def row(name: str, s: str, y: str, cue: str, k: int) -> Column:
        has = lambda c: F.contains(c, F.lit(cue)).cast("int")
        t = F.col("__t")
        return F.struct(F.lit(name).alias("contract"), sql(s).alias("s"), sql(y).cast("int").alias("y"), has(tx.prefix(t, k)).alias("z"), has(tx.complement(t, k)).alias("z_comp"), has(t).alias("z_ext"), (F.length(t) <= k).cast("int").alias("empty"))

    rows = docs.select(F.explode(F.array(*(row(n, *c) for n, c in CONTRACTS.items()))).alias("x")).select("x.*").filter("y IS NOT NULL")
    return cells.cells(rows, COLS, ["contract"])


def chain_sql(keys: tuple[str, ...] = ("contract",), draws: int = DRAWS, src: str = "src") -> str:
    """CTEs from cells in `src` to `chain`: arms, gates, interval ends and the null of each key."""
    ks, on = ", ".join(keys), lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    k = list(keys)
    w = f"(SELECT *, c AS w FROM {src})"

    def kappa(a: str, b: str) -> str:
        pe = f"(sum(c * {a}) * sum(c * {b}) + sum(c * (1 - {a})) * sum(c * (1 - {b}))) / pow(CAST(sum(c) AS DOUBLE), 2)"
        return f"CASE WHEN {pe} < 1 THEN (sum(CASE WHEN {a} = {b} THEN c ELSE 0 END) / CAST(sum(c) AS DOUBLE) - {pe}) / (1 - {pe}) END"

    aucs = " ".join(f"LEFT JOIN {auc_sql(w, 's', z, k)} a_{z} ON {on(f'a_{z}', 'm')}" for z in ("y", "z", "z_comp", "z_ext"))
    hm = "(auc_y * (1 - auc_y) + (n_y - 1) * (auc_y / (2 - auc_y) - auc_y * auc_y) + (n - n_y - 1) * (2 * auc_y * auc_y / (1 + auc_y) - auc_y * auc_y)) / (CAST(n_y AS DOUBLE) * (n - n_y))"
    return (
        f"m AS (SELECT {ks}, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c * y) AS BIGINT) AS n_y, CAST(sum(c * z) AS BIGINT) AS n_z, CAST(sum(c * z_comp) AS BIGINT) AS n_z_comp, sum(c * empty) / CAST(sum(c) AS DOUBLE) AS empty_share, {kappa('z_comp', 'y')} AS kappa_zc_y, {kappa('z', 'y')} AS kappa_z_y FROM {src} GROUP BY {ks}), "
        f"md AS (SELECT {ks}, max(c) / CAST(sum(c) AS DOUBLE) AS modal_share FROM (SELECT {ks}, s, sum(c) AS c FROM {src} GROUP BY {ks}, s) GROUP BY {ks}), "
        f"ar AS MATERIALIZED (SELECT m.*, md.modal_share, " + ", ".join(f"a_{z}.auc AS auc_{z}" for z in ("y", "z", "z_comp", "z_ext")) + f" FROM m JOIN md ON {on('md', 'm')} {aucs}), "
        f"bs AS (SELECT {ks}, s, y, z_comp, CAST(sum(c) AS BIGINT) AS c FROM {src} GROUP BY ALL), {deal_sql('bd', 'bs', ['s', 'y', 'z_comp'], draws, 'boot', k)}, "
        f"bg AS (SELECT {', '.join(f'a.{x} AS {x}' for x in keys)}, a.auc AS ay, abs(b.auc - 0.5) - abs(a.auc - 0.5) AS g FROM {auc_sql('bd', 's', 'y', [*k, 'draw'])} a JOIN {auc_sql('bd', 's', 'z_comp', [*k, 'draw'])} b ON {on('a', 'b')} AND a.draw = b.draw), "
        f"en AS (SELECT {ks}, quantile_cont(ay, 0.025) AS lo95, quantile_cont(ay, 0.975) AS hi95, quantile_cont(ay, 0.05) AS lo90, quantile_cont(ay, 0.95) AS hi90, quantile_cont(g, 0.025) AS d_lo, quantile_cont(g, 0.975) AS d_hi, count(g) AS valid, (count(*) FILTER (g <= 0) + 1) / CAST(count(g) + 1 AS DOUBLE) AS p_boot FROM bg GROUP BY {ks}), "
        f"ns AS (SELECT *, sum(ones) OVER (PARTITION BY {ks}, y) AS take FROM (SELECT {ks}, y, s, CAST(sum(c) AS BIGINT) AS c, CAST(sum(c * z_comp) AS BIGINT) AS ones FROM {src} GROUP BY ALL)), {deal_sql('nd', 'ns', ['s'], draws, 'null', [*k, 'y'], 'take')}, "
        f"nu AS (SELECT {ks}, draw, s, 1 AS zp, w FROM nd UNION ALL SELECT {ks}, draw, s, 0, -w FROM nd UNION ALL SELECT {ks}, draw, s, 0, c FROM ns, (SELECT unnest(range(0, {draws})) AS draw)), "
        f"nl AS (SELECT {ks}, abs(auc - 0.5) AS v FROM {auc_sql('nu', 's', 'zp', [*k, 'draw'])} WHERE auc IS NOT NULL), "
        f"n1 AS (SELECT {ks}, quantile_cont(v, 0.95) AS n95, list(v) AS vs FROM nl GROUP BY {ks}), "
        f"c0 AS (SELECT ar.*, en.* EXCLUDE ({ks}), auc_z - auc_y AS d_auc, abs(auc_z - 0.5) - abs(auc_y - 0.5) AS d_same, abs(auc_z_ext - 0.5) - abs(auc_y - 0.5) AS d_ext, abs(auc_z_comp - 0.5) - abs(auc_y - 0.5) AS d_dis, auc_y - 1.96 * sqrt(greatest({hm}, 0)) AS lo_y, auc_y + 1.96 * sqrt(greatest({hm}, 0)) AS hi_y, n95 - abs(auc_y - 0.5) AS null_p95, vs FROM ar LEFT JOIN en ON {on('en', 'ar')} LEFT JOIN n1 ON {on('n1', 'ar')}), "
        "chain AS MATERIALIZED (SELECT * EXCLUDE (vs), d_dis > null_p95 AS beats, (len(list_filter(vs, lambda v: v - abs(auc_y - 0.5) >= d_dis)) + 1) / CAST(len(vs) + 1 AS DOUBLE) AS p_perm FROM c0)"
    )


_POWER, _COMPLEMENT, _COARSE = "(n_y < 10 OR n - n_y < 10)", "(empty_share > 0.15)", "(modal_share > 0.5)"
_FLAT = "(n_z_comp = 0 OR n_z_comp = n OR n_y = 0 OR n_y = n)"
_BLOCKED = f"({_POWER} OR {_COMPLEMENT} OR {_FLAT})"
_ROW = ("auc_y", "auc_z", "auc_z_comp", "d_dis", "lo95", "hi95", "lo90", "hi90", "d_lo", "d_hi", "null_p95", "p_perm", "kappa_zc_y", "empty_share", "modal_share")


@query(f"WITH {_cells_sql()}, {chain_sql()} SELECT contract, n, n_y, n_z_comp, coalesce(valid, 0) AS valid, beats, " + ", ".join(f"round({c}, 9) AS {c}" for c in _ROW) + " FROM chain")
def contract_grid(spark: SparkSession, d: str) -> DataFrame:
    """Arms, gates, bootstrap ends and permutation null of sixteen contracts, all from one table of cells."""
    c = contracts.chain(grid(spark, d), ["contract"], DRAWS)
    return c.select("contract", "n", "n_y", "n_z_comp", F.coalesce("valid", F.lit(0)).alias("valid"), "beats", *(r9(F.col(x)).alias(x) for x in _ROW))


_NEAR, _TOST, _COVERS = "(lo_y >= 0.45 AND hi_y <= 0.55)", "(lo90 >= 0.45 AND hi90 <= 0.55)", "(lo95 <= 0.5 AND hi95 >= 0.5)"
_REASONS = (
    (_BLOCKED, "UNDECIDABLE", "precondition"), ("hi_y < 0.5", "SCORE NOT EVIDENCE", "ranks the construct backwards"), (f"{_NEAR} AND abs(auc_z_comp - 0.5) >= 0.1", "SCORE NOT EVIDENCE", "at chance, proxy ranked"), (_NEAR, "UNDECIDABLE", "at chance, nothing ranked"),
    ("NOT (lo_y > 0.5)", "UNDECIDABLE", "interval too wide to decide"), ("kappa_zc_y >= 0.4", "ALIGNED", "proxy has become the construct"), ("NOT beats", "ALIGNED", "within the null"), ("d_dis >= 0.15", "MISMATCH", "gap"), ("d_dis >= 0.1", "CAUTION", "gap"),
)


def _case(steps, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN coalesce({c}, false) THEN '{v}'" for c, v in steps) + f" ELSE '{otherwise}' END"


_V2 = _case([(c, v) for c, v, _ in _REASONS], "ALIGNED")
_WHY = _case([(c, r) for c, _, r in _REASONS], "no gap")


def _tail(aligned: str, mismatch: str) -> list[tuple[str, str]]:
    return [("NOT beats AND d_same >= 0.15", "CONTAINMENT"), ("NOT beats", aligned), ("d_dis >= 0.15", mismatch), ("d_dis >= 0.1", "CAUTION")]


_GATED = [(_POWER, "UNDECIDABLE (power)"), (_COMPLEMENT, "UNDECIDABLE (complement)"), (_COARSE, "UNDECIDABLE (resolution)")]
_RULES = {
    "v2": _V2,
    "final": _case([*_GATED, (_FLAT, "UNDECIDABLE (degenerate arm)"), (f"{_TOST} AND abs(auc_z_comp - 0.5) >= 0.1", "SCORE FAILURE"), (_TOST, "CONTAINMENT"), (_COVERS, "UNDECIDABLE (equivalence)"), ("kappa_zc_y >= 0.4", "ALIGNED"), *_tail("ALIGNED", "MISMATCH")], "ALIGNED"),
    "frozen": _case([("n_y < 10", "UNDECIDABLE (minimum-positive-count)"), *_GATED[1:], (f"{_TOST} AND abs(auc_z_comp - 0.5) >= 0.1", "SCORE FAILURE"), (f"{_TOST} AND d_same >= 0.15", "CONTAINMENT"), (_TOST, "UNDECIDABLE (no signal)"), (_COVERS, "UNDECIDABLE (equivalence)"), *_tail("NO RESIDUAL FLAG", "DIVERGENCE")], "NO RESIDUAL FLAG"),
    "synthetic": _case([(f"{_POWER} OR {_COARSE}", "UNDECIDABLE"), (f"{_TOST} AND abs(auc_z_comp - 0.5) >= 0.1", "SCORE FAILURE"), (_TOST, "CONTAINMENT"), (_COVERS, "UNDECIDABLE"), ("kappa_zc_y >= 0.4", "ALIGNED"), *_tail("ALIGNED", "DIVERGENCE")], "ALIGNED"),
    "baseline": _case([*_GATED, (_TOST, "FLAG: not evidence"), (_COVERS, "UNDECIDABLE (equivalence)"), ("kappa_z_y < 0.4", "FLAG: label")], "NO FLAG"),
    "cheap": _case([("kappa_z_y IS NULL", "n/a"), (f"NOT coalesce(lo95 > 0.5 OR hi95 < 0.5, false) AND kappa_z_y <= 0.2", "MISMATCH"), ("kappa_z_y <= 0.2", "CAUTION")], "ALIGNED"),
    "earlier": _case([("NOT coalesce(lo95 > 0.5 OR hi95 < 0.5, false) AND NOT coalesce(abs(auc_z - 0.5) >= 0.1, false)", "NULL"), ("d_auc IS NULL", "UNDECIDABLE"), ("d_auc >= 0.15 AND (kappa_z_y IS NULL OR kappa_z_y <= 0.2)", "MISMATCH"), ("d_auc >= 0.1", "CAUTION")], "ALIGNED"),
    "encoder": _case([*_GATED, (f"{_TOST} AND abs(auc_z_comp - 0.5) > 0.05", "SCORE FAILURE"), (_TOST, "CONTAINMENT"), (_COVERS, "UNDECIDABLE (equivalence)"), ("kappa_zc_y >= 0.4", "ALIGNED (proxy merged with construct)"), *_tail("ALIGNED", "MISMATCH")], "ALIGNED"),
    "external": _case([(f"{_BLOCKED} OR {_COARSE}", "UNDECIDABLE"), ("d_lo > 0 AND d_dis >= 0.15", "MISMATCH"), ("d_lo > 0 AND d_dis >= 0.1", "CAUTION")], "ALIGNED"),
}


def rules() -> dict[str, Column]:
    """Every rule as a column over a chain's rows."""
    c = F.col
    power, complement, coarse, flat = contracts.gates()
    blocked = power | complement | flat
    tost, ranked = vd.equivalent(c("lo90"), c("hi90")), F.coalesce((c("lo95") > 0.5) | (c("hi95") < 0.5), F.lit(False))
    v2, reason = vd.verdict_v2(blocked, c("lo_y"), c("hi_y"), F.abs(c("auc_z_comp") - 0.5) >= 0.1, c("kappa_zc_y"), c("beats"), c("d_dis"))
    ends = (c("lo95"), c("hi95"))
    encoder, _ = vd.encoder_rule(power, complement, coarse, tost, *ends, c("auc_z_comp"), c("kappa_zc_y"), c("beats"), c("d_dis"), c("d_same"))
    return {
        "v2": v2,
        "reason": reason,
        "final": vd.final_rule(power, complement, coarse, flat, tost, c("auc_z_comp"), *ends, c("kappa_zc_y"), c("beats"), c("d_dis"), c("d_same")),
        "frozen": vd.frozen_rule(c("n_y") < 10, complement, c("modal_share"), tost, c("auc_z_comp"), *ends, c("beats"), c("d_dis"), c("d_same")),
        "synthetic": vd.synthetic_rule(power, coarse, tost, c("auc_z_comp"), *ends, c("kappa_zc_y"), c("beats"), c("d_dis"), c("d_same"), kappa_exit=True),
        "baseline": vd.baseline(power, complement, coarse, tost, *ends, c("kappa_z_y")),
        "cheap": vd.cheap_rule(ranked, c("kappa_z_y")),
        "earlier": vd.earlier_verdict(c("d_auc"), c("kappa_z_y"), ranked, F.coalesce(F.abs(c("auc_z") - 0.5) >= 0.1, F.lit(False))),
        "encoder": encoder,
        "external": vd.external(blocked | coarse, vd.survives(~power, ~flat, ~complement, c("d_lo")), c("d_dis")),
    }


@query(f"WITH {_cells_sql()}, {chain_sql()} SELECT contract, " + ", ".join(f"{q} AS {n}" for n, q in _RULES.items()) + f", {_WHY} AS reason FROM chain")
def verdict_grid(spark: SparkSession, d: str) -> DataFrame:
    """Nine rules on sixteen contracts, which reach every exit of the second and most of the final rule."""
    return contracts.chain(grid(spark, d), ["contract"], DRAWS).select("contract", *(v.alias(n) for n, v in rules().items()))


_SWITCHES = {"all": (True, True, True), "no_power": (False, True, True), "no_complement": (True, False, True), "no_resolution": (True, True, False), "none": (False, False, False)}


def _switched(p: bool, c: bool, r: bool) -> str:
    gated = [g for g, on in zip(_GATED, (p, c, r), strict=True) if on]
    return _case([*gated, (_FLAT, "UNDECIDABLE (degenerate arm)"), (f"{_TOST} AND abs(auc_z_comp - 0.5) >= 0.1", "SCORE FAILURE"), (_TOST, "CONTAINMENT"), (_COVERS, "UNDECIDABLE (equivalence)"), ("kappa_zc_y >= 0.4", "ALIGNED"), *_tail("ALIGNED", "MISMATCH")], "ALIGNED")


_CUTS = ((0.05, 0.02), (0.10, 0.05), (0.15, 0.10), (0.20, 0.15), (0.40, 0.30))


@query(
    f"WITH {_cells_sql()}, {chain_sql()}, r AS (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, {_switched(*s)} AS verdict FROM chain" for n, s in _SWITCHES.items()) + " UNION ALL "
    + " UNION ALL ".join(f"SELECT 'cut {m:.2f}' AS rule, {_case([*((c, v) for c, v, _ in _REASONS[1:] if not c.startswith('d_dis')), (f'd_dis >= {m}', 'MISMATCH'), (f'd_dis >= {x}', 'CAUTION')], 'ALIGNED')} AS verdict FROM chain" for m, x in _CUTS)
    + ") SELECT rule, verdict, count(*) AS contracts FROM r GROUP BY ALL"
)
def verdict_tally(spark: SparkSession, d: str) -> DataFrame:
    """How many contracts come to which verdict as gates of the final rule are switched off, and as the cut-offs of the second rule move."""
    c, gates = F.col, contracts.gates()
    tost = vd.equivalent(c("lo90"), c("hi90"))
    out = []
    for name, on in _SWITCHES.items():
        out.append((name, vd.final_rule(*gates, tost, c("auc_z_comp"), c("lo95"), c("hi95"), c("kappa_zc_y"), c("beats"), c("d_dis"), c("d_same"), *on)))
    for mismatch, caution in _CUTS:
        out.append((f"cut {mismatch:.2f}", vd.verdict_v2(F.lit(False), c("lo_y"), c("hi_y"), F.abs(c("auc_z_comp") - 0.5) >= 0.1, c("kappa_zc_y"), c("beats"), c("d_dis"), mismatch, caution)[0]))
    chain = contracts.chain(grid(spark, d), ["contract"], DRAWS)
    each = chain.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), v.alias("verdict")) for n, v in out))).alias("x")).select("x.*")
    return each.groupBy("rule", "verdict").agg(F.count("*").alias("contracts"))


@query(
    f"WITH {_cells_sql()}, {chain_sql()}, g AS (SELECT contract, {_RULES['external']} AS verdict, round(p_perm, 9) AS p FROM chain), d2 AS (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r FROM g WHERE verdict <> 'UNDECIDABLE' AND p IS NOT NULL), "
    "c AS (SELECT max(p) AS crit FROM d2 WHERE p <= 0.05 * r / m), a AS (SELECT contract, verdict, p, coalesce(p <= crit, false) AS survives_bh FROM d2, c UNION ALL SELECT contract, verdict, p, NULL FROM g WHERE verdict = 'UNDECIDABLE' OR p IS NULL) "
    "SELECT *, CASE WHEN survives_bh = false AND verdict IN ('MISMATCH', 'CAUTION') THEN 'ALIGNED (fails BH)' ELSE verdict END AS verdict_bh FROM a"
)
def bh_contracts(spark: SparkSession, d: str) -> DataFrame:
    """The external rule's verdicts graded again: Benjamini-Hochberg at 0.05 over the permutation p-values of all decided contracts."""
    chain = contracts.chain(grid(spark, d), ["contract"], DRAWS)
    return vd.regrade(chain.select("contract", rules()["external"].alias("verdict"), r9(F.col("p_perm")).alias("p")), "verdict", "p", 0.05)


#: Positives that an outer draw keeps, outer and inner draws, and the contracts that are thinned.
KEEP, OUTER, INNER, THINNED = 40, 24, 60, ("shared", "gap")
_INSIDE = ["s", "z", "z_comp", "z_ext", "empty"]
_LABELS_OF = ", ".join(_INSIDE)
_THIN = _case([("n_y < 10", "UNDECIDABLE (power)"), (f"{_TOST} AND abs(auc_z_comp - 0.5) >= 0.1", "SCORE FAILURE"), (f"{_TOST} AND d_same >= 0.15", "CONTAINMENT"), (_TOST, "UNDECIDABLE (no signal)"), (_COVERS, "UNDECIDABLE (equivalence)"), *_tail("ALIGNED", "DIVERGENCE")], "ALIGNED")


@query(
    f"WITH {_cells_sql()}, few AS (SELECT * FROM src WHERE contract IN {THINNED}), tk AS (SELECT contract, {_LABELS_OF}, c, {KEEP} AS take FROM few WHERE y = 1), {deal_sql('td', 'tk', _INSIDE, OUTER, 'outer', ['contract'], 'take')}, "
    f"th AS MATERIALIZED (SELECT contract, outer_, {_LABELS_OF}, y, CAST(sum(c) AS BIGINT) AS c FROM (SELECT contract, draw AS outer_, {_LABELS_OF}, 1 AS y, w AS c FROM td UNION ALL SELECT contract, draw, {_LABELS_OF}, 0, -w FROM td UNION ALL SELECT contract, outer_, {_LABELS_OF}, 0, c FROM few, (SELECT unnest(range(0, {OUTER})) AS outer_)) GROUP BY ALL HAVING sum(c) > 0), "
    f"{chain_sql(('contract', 'outer_'), INNER, 'th')}, v AS (SELECT contract, {_THIN} AS verdict, d_dis FROM chain) "
    "SELECT contract, verdict, count(*) AS draws, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY contract) AS DOUBLE), 9) AS share, round(min(d_dis), 9) AS d_least, round(max(d_dis), 9) AS d_most FROM v GROUP BY contract, verdict"
)
def nested_stability(spark: SparkSession, d: str) -> DataFrame:
    """The whole rule again on constructs thinned to forty positives, each with its own bootstrap and null: two levels of draws on one table of cells."""
    few = kept(grid(spark, d).filter(F.col("contract").isin(*THINNED)), "thinned-cells")
    thin = contracts.thinned(few, ["contract"], KEEP, OUTER, "outer").withColumnRenamed("draw", "outer_")
    c = F.col
    chain = contracts.chain(thin, ["contract", "outer_"], INNER)
    rule = vd.thinned_rule(c("n_y") < 10, vd.equivalent(c("lo90"), c("hi90")), c("auc_z_comp"), c("lo95"), c("hi95"), c("beats"), c("d_dis"), c("d_same"))
    by = chain.select("contract", rule.alias("verdict"), "d_dis").groupBy("contract", "verdict").agg(F.count("*").alias("draws"), r9(F.min("d_dis")).alias("d_least"), r9(F.max("d_dis")).alias("d_most"))
    # A row a verdict.
    return by.select("contract", "verdict", "draws", r9(F.col("draws") / F.sum("draws").over(W.partitionBy("contract"))).alias("share"), "d_least", "d_most")
