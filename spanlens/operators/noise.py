"""Label noise as arithmetic on the table of distinct scores: swaps to a target, worst flips, measured flips.

Exchanging the labels of a positive and a negative changes the pairs that a
score wins by the difference of their mid-ranks, whatever was exchanged before.
So the AUC after t swaps is a sum of mid-ranks, and the least t that reaches a
target is read off prefix sums over scores, without trying one t after another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import kept
from . import cells
from .rank import RANGES, auc, running, score_table, usable
from .resample import draw_hash, draws


def carried(table: DataFrame, order: str, cols: Sequence[str]) -> DataFrame:
    """Nulls of `cols` replaced by the last value before them in `order`: within ranges of it, then over the ranges, so that no task holds the table."""
    cuts = [k / RANGES for k in range(1, RANGES)]
    edges = table.agg(F.percentile_approx(F.col(order).cast("double"), cuts, 10_000).alias("__edges"))
    ranged = table.crossJoin(F.broadcast(edges)).withColumn("__range", F.size(F.filter("__edges", lambda e: e < F.col(order)))).drop("__edges")  # one row
    # At most RANGES rows.
    lasts = ranged.groupBy("__range").agg(*(F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__l_{c}") for c in cols))
    over = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    lasts = lasts.select("__range", *(F.last(f"__l_{c}", ignorenulls=True).over(over).alias(f"__l_{c}") for c in cols))
    own = W.partitionBy("__range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    joined = ranged.join(F.broadcast(lasts), "__range")
    return joined.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(own), F.col(f"__l_{c}")) for c in cols}).drop("__range", *(f"__l_{c}" for c in cols))


def swap_targets(df: DataFrame, s: str, y: str, targets: Sequence[float]) -> DataFrame:
    """For each target n, auc, target, max_swaps, min_swaps, min_flips, flip_rate, auc_at: the least number of swaps (the lowest positive and the highest negative, again and again) with an AUC of the target or more; null where none has, and without both classes."""
    rows = df.filter(F.col(y).isNotNull())
    t = running(score_table(rows, s, [y]).select(s, "n", F.col(f"p_{y}").alias("p"), F.col(f"q_{y}").alias("q")), s, ["n", "p", "q"])
    # Written, since prefix sums read their table more than once and here follow each other.
    t = kept(t.withColumn("mid", F.col("before_n") + (F.col("n") + 1) / F.lit(2.0)), "swap-scores")
    sums = t.agg(F.sum("n").alias("n"), F.sum("p").alias("pos"), F.sum("q").alias("neg"), F.sum(F.col("p") * (F.col("before_q") + F.col("q") / F.lit(2.0))).alias("won"))
    pairs = F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("pos").cast("double") * F.col("neg"))
    one = F.broadcast(sums.select("neg", F.least("pos", "neg").alias("most")))  # one row
    lows = t.filter("p > 0").select(F.col("before_p").alias("at"), F.col("mid").alias("lo"), F.lit(None).cast("double").alias("hi"))
    highs = t.filter("q > 0").crossJoin(one).select((F.col("neg") - F.col("before_q") - F.col("q")).alias("at"), F.lit(None).cast("double").alias("lo"), F.col("mid").alias("hi"))
    # Where either side comes to its next score: between two such places every swap gains alike.
    marks = kept(lows.union(highs).groupBy("at").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi")), "swap-marks")
    steps = carried(marks, "at", ["lo", "hi"]).crossJoin(one).filter(F.col("at") < F.col("most")).join(_following(marks, "at"), "at")
    steps = steps.withColumn("width", F.least(F.coalesce("after", F.col("most")), F.col("most")) - F.col("at")).withColumn("gain", F.col("hi") - F.col("lo"))
    summed = running(kept(steps.select("at", "gain", (F.col("gain") * F.col("width")).alias("rise")), "swap-steps"), "at", ["rise"])
    asked = F.array(*(F.lit(float(x)) for x in targets))
    base = sums.select("n", F.least("pos", "neg").alias("max_swaps"), pairs.alias("pairs"), (F.col("won") / pairs).alias("auc"), F.explode(asked).alias("target")).withColumn("need", (F.col("target") - F.col("auc")) * F.col("pairs"))
    # Half a won pair is the least difference; a row for each target on one side. Gains fall, so the first step that reaches is the only one.
    reached = summed.crossJoin(F.broadcast(base)).filter((F.col("need") > 1e-6) & (F.col("gain") > 0) & (F.col("before_rise") < F.col("need") - 1e-6) & (F.col("before_rise") + F.col("rise") >= F.col("need") - 1e-6))
    more = F.ceil((F.col("need") - 1e-6 - F.col("before_rise")) / F.col("gain"))
    found = reached.select("target", (F.col("at") + more).cast("bigint").alias("t"), (F.col("before_rise") + more * F.col("gain")).alias("up"))
    met = base.join(F.broadcast(found), "target", "left")  # a row for each target
    none = F.col("need") <= 1e-6
    out = met.withColumn("min_swaps", F.when(none, F.lit(0).cast("bigint")).otherwise(F.col("t")))
    at = F.col("auc") + F.when(none, F.lit(0.0)).otherwise(F.col("up")) / F.col("pairs")
    return out.select("n", "auc", "target", "max_swaps", "min_swaps", (2 * F.col("min_swaps")).alias("min_flips"), (2 * F.col("min_swaps") / F.col("n")).alias("flip_rate"), at.alias("auc_at"))


def _following(table: DataFrame, order: str) -> DataFrame:
    """order, after: the next value of a column of distinct numbers, by ranges."""
    back = table.select((-F.col(order)).alias("__m"))
    cuts = [k / RANGES for k in range(1, RANGES)]
    edges = back.agg(F.percentile_approx(F.col("__m").cast("double"), cuts, 10_000).alias("__edges"))
    ranged = back.crossJoin(F.broadcast(edges)).withColumn("__range", F.size(F.filter("__edges", lambda e: e < F.col("__m")))).drop("__edges")  # one row
    tops = ranged.groupBy("__range").agg(F.max("__m").alias("__t"))  # at most RANGES rows
    tops = tops.select("__range", F.max("__t").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)).alias("__t"))
    own = F.lag("__m").over(W.partitionBy("__range").orderBy("__m"))
    return ranged.join(F.broadcast(tops), "__range").select((-F.col("__m")).alias(order), (-F.coalesce(own, F.col("__t"))).alias("after"))


def worst_flips(df: DataFrame, s: str, y: str, budgets: Sequence[tuple[int, int]]) -> DataFrame:
    """down, up, auc: labels flipped where it harms the AUC most, within a budget by class: the `down` highest positives and the `up` lowest negatives. A pass over the distinct scores for all budgets."""
    t = running(score_table(df.filter(F.col(y).isNotNull()), s, [y]).select(F.col(s).alias("s"), F.col(f"p_{y}").alias("p"), F.col(f"q_{y}").alias("q")), "s", ["p", "q"])
    total = t.agg(F.sum("p").alias("all_p"))
    each = t.crossJoin(F.broadcast(total)).withColumn("b", F.explode(F.array(*(F.struct(F.lit(d).alias("down"), F.lit(u).alias("up")) for d, u in budgets)))).select("*", "b.*")  # one row
    fell = F.greatest(F.least(F.col("down") - (F.col("all_p") - F.col("before_p") - F.col("p")), F.col("p")), F.lit(0))
    rose = F.greatest(F.least(F.col("up") - F.col("before_q"), F.col("q")), F.lit(0))
    flipped = each.select("down", "up", "s", (F.col("p") - fell + rose).alias("p"), (F.col("q") + fell - rose).alias("q"))
    long = flipped.select("down", "up", "s", F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("p").alias("w")), F.struct(F.lit(0).alias("y"), F.col("q").alias("w")))).alias("x")).select("down", "up", "s", "x.*")
    ranges = cells.ranged(t.select("s"), "s").select("s", "range")
    return cells.aucs(long.join(ranges, "s"), "s", ["y"], ["down", "up"]).select("down", "up", F.col("auc_y").alias("auc"))


def change_rate(p: Column, q: Column, opposed: bool) -> Column:
    """How often exactly one of two sides flips: on its own, or as rarely together as their rates allow (errors opposed)."""
    return p + q - 2 * F.greatest(p + q - 1, F.lit(0.0)) if opposed else p + q - 2 * p * q


def measured_flips(table: DataFrame, rate: Column, n_draws: int, seed: int | str, cols: Sequence[str], y: str) -> DataFrame:
    """draw, cols, y, w: of each cell's c rows a binomial number has its label y flipped, at the cell's rate."""
    cell = F.concat_ws("-", *(F.col(c).cast("string") for c in (*cols, y)))
    u = (draw_hash(seed, F.col("draw"), cell) + F.lit(0.5)) / F.lit(4294967296.0)
    # As many tasks as draws allow: few bytes, much work.
    tasks = min(n_draws, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = table.withColumn("__rate", rate).crossJoin(F.broadcast(draws(table.sparkSession, n_draws))).repartition(tasks, "draw")
    dealt = spread.withColumn("__k", cells.binomial(F.col("c"), F.col("__rate"), u))
    return dealt.select("draw", *cols, F.explode(F.array(F.struct(F.col(y).alias("y"), (F.col("c") - F.col("__k")).alias("w")), F.struct((1 - F.col(y)).alias("y"), F.col("__k").alias("w")))).alias("x")).select("draw", *cols, "x.*").filter("w > 0")


def shuffle_p(df: DataFrame, s: str, y: str, n_draws: int, seed: int | str) -> DataFrame:
    """One row: auc, null_mean, null_sd, null_p99, p_one and p_two: shares of label shuffles with an AUC as large, and as far from a half. Ones are dealt to scores without replacement."""
    t = df.filter(usable(s) & F.col(y).isNotNull()).groupBy(F.col(s).alias("s")).agg(F.count("*").alias("c"), F.sum(F.col(y).cast("bigint")).alias("p"))
    seen = auc(df.filter(F.col(y).isNotNull()), s, [y]).select(F.col(f"auc_{y}").alias("auc"))
    total = t.agg(F.sum("p").alias("take"))
    drawn = cells.deal(t.crossJoin(F.broadcast(total)).select("s", "c", "take"), ["s"], n_draws, seed, take="take")  # one row
    long = drawn.select("draw", "s", F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("w")), F.struct(F.lit(0).alias("y"), (-F.col("w")).alias("w")))).alias("x")).select("draw", "s", "x.*")
    rest = t.crossJoin(F.broadcast(draws(df.sparkSession, n_draws))).select("draw", "s", F.lit(0).alias("y"), F.col("c").alias("w"))
    ranges = cells.ranged(t.select("s"), "s").select("s", "range")
    null = cells.aucs(long.union(rest).join(ranges, "s"), "s", ["y"], ["draw"]).select(F.col("auc_y").alias("v"))
    far = lambda c: F.abs(c - 0.5)
    met = null.crossJoin(F.broadcast(seen))  # one row
    # Nine decimals, so that sums in another order make no tie a difference.
    v, o = F.round(F.col("v"), 9), F.round(F.col("auc"), 9)
    return met.groupBy("auc").agg(F.avg("v").alias("null_mean"), F.stddev_pop("v").alias("null_sd"), F.percentile("v", F.lit(0.99)).alias("null_p99"), F.avg((v >= o).cast("double")).alias("p_one"), F.avg((F.round(far(v), 9) >= F.round(far(o), 9)).cast("double")).alias("p_two"))
