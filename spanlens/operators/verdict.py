"""Gates and verdict ladders as ordered CASE expressions over one row per contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import CAUTION_BAND, KAPPA_MERGED, LEAST_CLASS, LOW_KAPPA, MISMATCH_BAND, MOST_EMPTY, MOST_MODAL, NEAR_CHANCE, RANKED


def ladder(*steps: tuple[Column, str], otherwise: str) -> Column:
    """The first step whose condition holds (null does not)."""
    out = F.when(F.coalesce(steps[0][0], F.lit(False)), steps[0][1])
    for when, name in steps[1:]:
        out = out.when(F.coalesce(when, F.lit(False)), name)
    return out.otherwise(otherwise)


def underpowered(pos: Column, n: Column, least: int = LEAST_CLASS) -> Column:
    return (pos < least) | (n - pos < least)


def degenerate_complement(share: Column) -> Column:
    return share > MOST_EMPTY


def coarse(modal_share: Column, distinct_at_positives: Column | None = None) -> Column:
    out = modal_share > MOST_MODAL
    return out if distinct_at_positives is None else out | (distinct_at_positives <= 1)


def screen(d_auc: Column, d_ap: Column, kappa: Column, fail: float = MISMATCH_BAND, warn_auc: float = CAUTION_BAND, warn_ap: float = CAUTION_BAND, low: float = LOW_KAPPA) -> Column:
    """FAIL, WARN or PASS of the command-line screen."""
    return ladder(((d_auc >= fail) & (kappa <= low), "FAIL"), ((d_auc >= warn_auc), "WARN"), ((d_ap >= warn_ap), "WARN"), otherwise="PASS")


def repair(d_auc: Column, d_ap: Column, kappa: Column) -> Column:
    """The screen applied to a repaired score."""
    s = screen(d_auc, d_ap, kappa)
    return F.when(s == "FAIL", "MISMATCH").when(s == "WARN", "CAUTION").otherwise("ALIGNED")


def survives(powered: Column, plain: Column, complement_ok: Column, lo: Column) -> Column:
    return F.coalesce(powered & plain & complement_ok & (lo > 0), F.lit(False))


def orientation(lo: Column, hi: Column) -> Column:
    return ladder((hi < 0.5, "reversed"), (lo > 0.5, "forward"), otherwise="unranked")


def equivalent(lo90: Column, hi90: Column, band: tuple[float, float] = NEAR_CHANCE) -> Column:
    """The 90 % interval lies in the band: two one-sided tests."""
    return (lo90 >= band[0]) & (hi90 <= band[1])


def bands(d: Column, mismatch: float = MISMATCH_BAND, caution: float = CAUTION_BAND) -> list[tuple[Column, str]]:
    return [(d >= mismatch, "MISMATCH"), (d >= caution, "CAUTION")]


def verdict_v2(blocked: Column, lo: Column, hi: Column, proxy_ranked: Column, kappa: Column, beats_null: Column, d: Column, mismatch: float = MISMATCH_BAND, caution: float = CAUTION_BAND, merged: float = KAPPA_MERGED) -> tuple[Column, Column]:
    """(verdict, reason) in the second rule's order."""
    near = (lo >= NEAR_CHANCE[0]) & (hi <= NEAR_CHANCE[1])
    # The reasons as the rule's reports name them.
    steps = [
        (blocked, "UNDECIDABLE", "precondition"),
        (hi < 0.5, "SCORE NOT EVIDENCE", "ranks the construct backwards"),
        (near & proxy_ranked, "SCORE NOT EVIDENCE", "at chance, proxy ranked"),
        (near, "UNDECIDABLE", "at chance, nothing ranked"),
        (~(lo > 0.5), "UNDECIDABLE", "interval too wide to decide"),
        (kappa >= merged, "ALIGNED", "proxy has become the construct"),
        (~beats_null, "ALIGNED", "within the null"),
        (d >= mismatch, "MISMATCH", "gap"),
        (d >= caution, "CAUTION", "gap"),
    ]
    return ladder(*((c, v) for c, v, _ in steps), otherwise="ALIGNED"), ladder(*((c, r) for c, _, r in steps), otherwise="no gap")


def final_rule(underpowered: Column, complement_bad: Column, coarse: Column, degenerate: Column, tost: Column, auc_zc: Column, lo: Column, hi: Column, kappa: Column, beats_null: Column, d_dis: Column, d_same: Column, use_power: bool = True, use_complement: bool = True, use_resolution: bool = True, use_kappa: bool = True) -> Column:
    """The final rule, gates switchable. `d_same`: the orientation-robust gap on the span itself."""
    off = F.lit(False)
    return ladder(
        (underpowered if use_power else off, "UNDECIDABLE (power)"),
        (complement_bad if use_complement else off, "UNDECIDABLE (complement)"),
        (coarse if use_resolution else off, "UNDECIDABLE (resolution)"),
        (degenerate, "UNDECIDABLE (degenerate arm)"),
        (tost & (F.abs(auc_zc - 0.5) >= RANKED), "SCORE FAILURE"),
        (tost, "CONTAINMENT"),
        ((lo <= 0.5) & (hi >= 0.5), "UNDECIDABLE (equivalence)"),
        ((kappa >= KAPPA_MERGED) if use_kappa else off, "ALIGNED"),
        (~beats_null & (d_same >= MISMATCH_BAND), "CONTAINMENT"),
        (~beats_null, "ALIGNED"),
        *bands(d_dis),
        otherwise="ALIGNED",
    )


def frozen_rule(few_positives: Column, complement_bad: Column, modal_share: Column, tost: Column, auc_zc: Column, lo: Column, hi: Column, beats_null: Column, d_dis: Column, d_same: Column) -> Column:
    """The frozen rule: positives alone make the power gate, the modal share is raw, there is no kappa exit, and one more without signal."""
    return ladder(
        (few_positives, "UNDECIDABLE (minimum-positive-count)"),
        (complement_bad, "UNDECIDABLE (complement)"),
        (modal_share > MOST_MODAL, "UNDECIDABLE (resolution)"),
        (tost & (F.abs(auc_zc - 0.5) >= RANKED), "SCORE FAILURE"),
        (tost & (d_same >= MISMATCH_BAND), "CONTAINMENT"),
        (tost, "UNDECIDABLE (no signal)"),
        ((lo <= 0.5) & (hi >= 0.5), "UNDECIDABLE (equivalence)"),
        (~beats_null & (d_same >= MISMATCH_BAND), "CONTAINMENT"),
        (~beats_null, "NO RESIDUAL FLAG"),
        (d_dis >= MISMATCH_BAND, "DIVERGENCE"),
        (d_dis >= CAUTION_BAND, "CAUTION"),
        otherwise="NO RESIDUAL FLAG",
    )


def thinned_rule(few_positives: Column, tost: Column, auc_zc: Column, lo: Column, hi: Column, beats_null: Column, d_dis: Column, d_same: Column) -> Column:
    """The whole rule as it runs on each thinned construct: positives make the power gate, and nothing else gates."""
    return ladder(
        (few_positives, "UNDECIDABLE (power)"),
        (tost & (F.abs(auc_zc - 0.5) >= RANKED), "SCORE FAILURE"),
        (tost & (d_same >= MISMATCH_BAND), "CONTAINMENT"),
        (tost, "UNDECIDABLE (no signal)"),
        ((lo <= 0.5) & (hi >= 0.5), "UNDECIDABLE (equivalence)"),
        (~beats_null & (d_same >= MISMATCH_BAND), "CONTAINMENT"),
        (~beats_null, "ALIGNED"),
        (d_dis >= MISMATCH_BAND, "DIVERGENCE"),
        (d_dis >= CAUTION_BAND, "CAUTION"),
        otherwise="ALIGNED",
    )


def synthetic_rule(underpowered: Column, coarse: Column, tost: Column, auc_zc: Column, lo: Column, hi: Column, kappa: Column, beats_null: Column, d_dis: Column, d_same: Column, kappa_exit: bool = False) -> Column:
    """The rule of the synthetic cases: no complement gate, the kappa exit by choice."""
    return ladder(
        (underpowered | coarse, "UNDECIDABLE"),
        (tost & (F.abs(auc_zc - 0.5) >= RANKED), "SCORE FAILURE"),
        (tost, "CONTAINMENT"),
        ((lo <= 0.5) & (hi >= 0.5), "UNDECIDABLE"),
        ((kappa >= KAPPA_MERGED) if kappa_exit else F.lit(False), "ALIGNED"),
        (~beats_null & (d_same >= MISMATCH_BAND), "CONTAINMENT"),
        (~beats_null, "ALIGNED"),
        (d_dis >= MISMATCH_BAND, "DIVERGENCE"),
        (d_dis >= CAUTION_BAND, "CAUTION"),
        otherwise="ALIGNED",
    )


def baseline(underpowered: Column, complement_bad: Column, coarse: Column, tost: Column, lo: Column, hi: Column, kappa: Column) -> Column:
    """The same preconditions, then only the score's interval and the agreement of proxy and construct on the span."""
    return ladder(
        (underpowered, "UNDECIDABLE (power)"),
        (complement_bad, "UNDECIDABLE (complement)"),
        (coarse, "UNDECIDABLE (resolution)"),
        (tost, "FLAG: not evidence"),
        ((lo <= 0.5) & (hi >= 0.5), "UNDECIDABLE (equivalence)"),
        (kappa < KAPPA_MERGED, "FLAG: label"),
        otherwise="NO FLAG",
    )


def baseline_power_only(underpowered: Column, tost: Column, lo: Column, hi: Column, kappa: Column) -> Column:
    """The baseline of the synthetic cases: the power gate alone."""
    return ladder((underpowered, "UNDECIDABLE"), (tost, "FLAG: not evidence"), ((lo <= 0.5) & (hi >= 0.5), "UNDECIDABLE"), (kappa < KAPPA_MERGED, "FLAG: label"), otherwise="NO FLAG")


def cheap_rule(construct_ranked: Column, kappa: Column) -> Column:
    """Whether the score ranks the construct, and whether the proxy agrees with it: no spans, no controls."""
    return ladder((kappa.isNull(), "n/a"), (~construct_ranked & (kappa <= LOW_KAPPA), "MISMATCH"), (kappa <= LOW_KAPPA, "CAUTION"), otherwise="ALIGNED")


def earlier_verdict(gap: Column, kappa: Column, construct_ranked: Column, proxy_ranked: Column) -> Column:
    """The first form, with an exit for a score that ranks nothing."""
    return ladder((~construct_ranked & ~proxy_ranked, "NULL"), (gap.isNull(), "UNDECIDABLE"), ((gap >= MISMATCH_BAND) & (kappa.isNull() | (kappa <= LOW_KAPPA)), "MISMATCH"), (gap >= CAUTION_BAND, "CAUTION"), otherwise="ALIGNED")


def external(blocked: Column, survives_: Column, d: Column) -> Column:
    return ladder((blocked, "UNDECIDABLE"), (survives_ & (d >= MISMATCH_BAND), "MISMATCH"), (survives_ & (d >= CAUTION_BAND), "CAUTION"), otherwise="ALIGNED")


def regrade(cells: DataFrame, verdict: str, p: str, q: float = 0.05) -> DataFrame:
    """Adds survives_bh and verdict_bh: Benjamini-Hochberg over the decided cells; a mismatch or caution that fails it is aligned after all. A small table of cells."""
    from .multiplicity import benjamini_hochberg

    decided = F.col(verdict).isin("MISMATCH", "CAUTION", "ALIGNED")
    tested = benjamini_hochberg(cells.filter(decided), p, q).withColumnRenamed("rejected", "survives_bh").drop("rank", "adjusted")
    out = tested.unionByName(cells.filter(~decided | F.col(p).isNull()).withColumn("survives_bh", F.lit(None).cast("boolean")))
    fails = F.coalesce(~F.col("survives_bh"), F.lit(False)) & F.col(verdict).isin("MISMATCH", "CAUTION")
    return out.withColumn("verdict_bh", F.when(fails, "ALIGNED (fails BH)").otherwise(F.col(verdict)))


def encoder_rule(underpowered: Column, complement_bad: Column, coarse: Column, tost: Column, lo: Column, hi: Column, auc_zc: Column, kappa: Column, beats_null: Column, d: Column, d_same: Column) -> tuple[Column, Column]:
    """(verdict, reoriented): the final order; a score at chance fails if the proxy is still ranked above .05, and a reversed score is turned round."""
    verdict = ladder(
        (underpowered, "UNDECIDABLE (power)"),
        (complement_bad, "UNDECIDABLE (complement)"),
        (coarse, "UNDECIDABLE (resolution)"),
        (tost & (F.abs(auc_zc - 0.5) > 0.05), "SCORE FAILURE"),
        (tost, "CONTAINMENT"),
        ((lo <= 0.5) & (hi >= 0.5), "UNDECIDABLE (equivalence)"),
        (kappa >= KAPPA_MERGED, "ALIGNED (proxy merged with construct)"),
        (~beats_null & (d_same >= MISMATCH_BAND), "CONTAINMENT"),
        (~beats_null, "ALIGNED"),
        *bands(d),
        otherwise="ALIGNED",
    )
    return verdict, F.coalesce(hi < 0.5, F.lit(False))


def judge_grade(acc: Column, kappa: Column, worst: Column, fpr: Column, fnr: Column) -> Column:
    """The grades' thresholds."""
    return ladder(
        ((acc >= 0.92) & (kappa >= 0.75) & (worst >= 0.80) & (fpr <= 0.05) & (fnr <= 0.07), "strong"),
        ((acc >= 0.85) & (kappa >= 0.65) & (worst >= 0.75) & (fpr <= 0.07) & (fnr <= 0.10), "defensive"),
        ((acc >= 0.85) & (kappa >= 0.60) & (worst >= 0.70) & (fpr <= 0.10) & (fnr <= 0.15), "required"),
        otherwise="below_required",
    )


def screening(proxy_pos: Column, n: Column, d_auc: Column, kappa: Column) -> Column:
    """Status of a proxy x score cell."""
    return ladder((underpowered(proxy_pos, n), "UNDERPOWERED"), ((d_auc >= MISMATCH_BAND) & (kappa <= LOW_KAPPA), "MISMATCH_CANDIDATE"), (d_auc >= CAUTION_BAND, "CAUTION"), otherwise="ALIGNED")


def locus(query: Column, output: Column, override: Column | None = None) -> Column:
    """Where a score looks: QUERY, OUTPUT, BOTH or UNCLEAR; an override, where there is one, stands before the evidence."""
    out = ladder((query & output, "BOTH"), (query, "QUERY"), (output, "OUTPUT"), otherwise="UNCLEAR")
    return out if override is None else F.coalesce(override, out)


def release(hit: Column, reachable: Column, override: Column | None = None) -> Column:
    """Whether generations are public: RELEASED, NOT RELEASED where a repository could be read, else UNDETERMINED."""
    out = ladder((hit, "RELEASED"), (reachable, "NOT RELEASED"), otherwise="UNDETERMINED")
    return out if override is None else F.coalesce(override, out)


def pair_decision(a: Column, b: Column) -> Column:
    """AGREEMENT or DISAGREEMENT of two sides' labels, UNCLEAR where one is missing or unclear."""
    known = ("REFUSAL", "COMPLIANCE")
    return F.when(a.isin(*known) & b.isin(*known), F.when(a == b, "AGREEMENT").otherwise("DISAGREEMENT")).otherwise("UNCLEAR")
