"""Everything a verdict reads, for many contracts at once, from one table of cells.

A contract's rows are counted once into cells (score, construct, proxy inside,
outside and anywhere, empty complement). Arms and gates are sums over cells; the
bootstrap of the construct's AUC and of the off-span gap is a multinomial draw
over them, and the null permutes the outside proxy within the construct's strata
by a hypergeometric draw over (stratum, score). Texts and rows are not read again, and
neither shuffle grows with draws times rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..sources import kept
from . import cells
from . import verdict as vd
from .resample import draws

LABELS = ("y", "z", "z_comp", "z_ext")


def _sum(*conditions: Column) -> Column:
    """Rows for which all conditions hold."""
    hit = conditions[0]
    for c in conditions[1:]:
        hit = hit & c
    return F.sum(F.when(hit, F.col("c")).otherwise(0)).cast("bigint")


def _kappa(a: str, b: str) -> Column:
    return stats.kappa(*(_sum(F.col(a) == i, F.col(b) == j) for i, j in ((1, 1), (1, 0), (0, 1), (0, 0))))


def arms(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, n_<label>, auc_<label>, kappas of proxies and construct, empty and modal share."""
    keys = list(keys)
    whole = cells.aucs(cells.ranged(grid, "s", keys).withColumn("w", F.col("c")), "s", LABELS, keys)
    sums = grid.groupBy(*keys).agg(
        F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("empty")) / F.sum("c")).alias("empty_share"), _kappa("z_comp", "y").alias("kappa_zc_y"), _kappa("z", "y").alias("kappa_z_y")
    )
    modal = grid.groupBy(*keys, "s").agg(F.sum("c").alias("c")).groupBy(*keys).agg((F.max("c") / F.sum("c")).alias("modal_share"))
    return whole.join(sums, keys).join(modal, keys)


def interval_ends(grid: DataFrame, keys: Sequence[str], n_draws: int, seed: int | str = "boot") -> DataFrame:
    """keys, lo95, hi95, lo90, hi90 of the construct's AUC, d_lo and d_hi (95 %) of the off-span gap, valid draws, and p_boot, the share of them at or below zero (one added to both counts)."""
    keys = list(keys)
    some = cells.ranged(grid.groupBy(*keys, "s", "y", "z_comp").agg(F.sum("c").alias("c")), "s", keys)
    drawn = cells.deal(some.drop("range"), ["s", "y", "z_comp"], n_draws, seed, keys).join(some.select(*keys, "s", "range").distinct(), [*keys, "s"])
    each = cells.aucs(drawn, "s", ["y", "z_comp"], [*keys, "draw"]).withColumn("g", stats.robust_gap(F.col("auc_z_comp"), F.col("auc_y")))
    y = F.col("auc_y")
    at = lambda c, p, name: F.percentile(c, F.lit(p)).alias(name)
    return each.groupBy(*keys).agg(at(y, 0.025, "lo95"), at(y, 0.975, "hi95"), at(y, 0.05, "lo90"), at(y, 0.95, "hi90"), at("g", 0.025, "d_lo"), at("g", 0.975, "d_hi"), F.count("g").alias("valid"), ((F.count_if(F.col("g") <= 0) + 1) / (F.count("g") + 1)).alias("p_boot"))


def null(grid: DataFrame, keys: Sequence[str], n_draws: int, seed: int | str = "null") -> DataFrame:
    """keys, draw, auc of the outside proxy permuted within the construct's strata; scores keep their rows."""
    keys = list(keys)
    some = grid.groupBy(*keys, "y", "s").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("z_comp")).alias("ones"))
    ones = some.groupBy(*keys, "y").agg(F.sum("ones").alias("take"))
    drawn = cells.deal(some.join(ones, [*keys, "y"]).select(*keys, "y", "s", "c", "take"), ["s"], n_draws, seed, [*keys, "y"], take="take")
    placed = drawn.select(*keys, "draw", "s", F.explode(F.array(F.struct(F.lit(1).alias("zp"), F.col("w")), F.struct(F.lit(0).alias("zp"), (-F.col("w")).alias("w")))).alias("x")).select(*keys, "draw", "s", "x.*")
    rest = some.crossJoin(F.broadcast(draws(grid.sparkSession, n_draws))).select(*keys, "draw", "s", F.lit(0).alias("zp"), F.col("c").alias("w"))
    ranges = cells.ranged(some.groupBy(*keys, "s").agg(F.sum("c").alias("c")), "s", keys).select(*keys, "s", "range")
    return cells.aucs(placed.union(rest).join(ranges, [*keys, "s"]), "s", ["zp"], [*keys, "draw"]).select(*keys, "draw", F.col("auc_zp").alias("auc"))


def chain(grid: DataFrame, keys: Sequence[str], n_draws: int, ends: bool = True) -> DataFrame:
    """A row for each key: arms, gaps, the Hanley-McNeil interval, bootstrap ends, the null's 95 % point, whether the gap beats it, and its p-value (one added to both counts; null where the null has no AUC). Without `ends`, for rules that read none of them, no bootstrap."""
    keys = list(keys)
    grid = kept(grid, "contract-cells")
    nulls = null(grid, keys, n_draws).select(*keys, F.abs(F.col("auc") - 0.5).alias("v")).groupBy(*keys).agg(F.percentile("v", F.lit(0.95)).alias("n95"), F.array_compact(F.collect_list("v")).alias("vs"))
    # One row for each key.
    a = arms(grid, keys).join(nulls, keys, "left")
    a = a.join(interval_ends(grid, keys, n_draws), keys, "left") if ends else a
    c = F.col
    own = F.abs(c("auc_y") - 0.5)
    _, lo, hi = stats.hanley_mcneil(c("auc_y"), c("n_y"), c("n") - c("n_y"))
    gaps = {"d_auc": c("auc_z") - c("auc_y"), "d_same": stats.robust_gap(c("auc_z"), c("auc_y")), "d_ext": stats.robust_gap(c("auc_z_ext"), c("auc_y")), "d_dis": stats.robust_gap(c("auc_z_comp"), c("auc_y")), "lo_y": lo, "hi_y": hi, "null_p95": c("n95") - own}
    a = a.withColumns(gaps)
    exceed = F.size(F.filter("vs", lambda v: v - own >= c("d_dis")))
    return a.withColumns({"beats": c("d_dis") > c("null_p95"), "p_perm": F.when(F.size("vs") > 0, (exceed + 1) / (F.size("vs") + 1))}).drop("n95", "vs")


def gates() -> tuple[Column, Column, Column, Column]:
    """underpowered, complement degenerate, score coarse, an arm without both classes: of a chain's row."""
    c = F.col
    flat = (c("n_z_comp") == 0) | (c("n_z_comp") == c("n")) | (c("n_y") == 0) | (c("n_y") == c("n"))
    return vd.underpowered(c("n_y"), c("n")), vd.degenerate_complement(c("empty_share")), vd.coarse(c("modal_share")), flat


def thinned(grid: DataFrame, keys: Sequence[str], keep: int, n_draws: int, seed: int | str) -> DataFrame:
    """keys, draw and the cells of contracts whose construct keeps `keep` positives drawn without replacement: the others count as negatives, as in the outer level of a nested resampling."""
    keys = list(keys)
    cols = [x for x in grid.columns if x not in (*keys, "y", "c")]
    ones = grid.filter("y = 1").select(*keys, *cols, "c", F.lit(keep).cast("bigint").alias("take"))
    drawn = cells.deal(ones, cols, n_draws, seed, keys, take="take")
    # What is kept turns from negative to positive.
    all_negative = grid.crossJoin(F.broadcast(draws(grid.sparkSession, n_draws))).select(*keys, "draw", *cols, F.lit(0).alias("y"), "c")
    up = drawn.select(*keys, "draw", *cols, F.lit(1).alias("y"), F.col("w").alias("c"))
    down = drawn.select(*keys, "draw", *cols, F.lit(0).alias("y"), (-F.col("w")).alias("c"))
    return all_negative.unionByName(up).unionByName(down).groupBy(*keys, "draw", *cols, "y").agg(F.sum("c").alias("c")).filter("c > 0")
