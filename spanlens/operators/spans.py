"""Spans walked in one read: two offsets of a text say what any span holds.

A cue lies in the first k characters of a text if its first occurrence ends by
k, and in the rest if its last one begins at k or after. With these two offsets
the proxy inside and outside of every span is a comparison of two numbers, so the
contracts of all spans come from one table of cells (score, construct, first and
last span with the cue), and their bootstrap intervals from the same draws.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vocabulary import MOST_MODAL
from ..sources import kept
from . import cells


def offset_index(text: Column, cues: Sequence[str]) -> list[Column]:
    """first_end (one past the end of the earliest cue to end) and last_start (of the latest to begin) in characters, null without a cue."""
    found = [(F.instr(text, c), F.instr(F.reverse(text), c[::-1]), len(c)) for c in cues]
    ends = [F.when(a > 0, a + (n - 1)) for a, _, n in found]
    starts = [F.when(b > 0, F.length(text) - b + 1 - n) for _, b, n in found]
    least, most = (ends[0], starts[0]) if len(cues) == 1 else (F.least(*ends), F.greatest(*starts))
    return [least.alias("first_end"), most.alias("last_start")]


def span_cells(df: DataFrame, s: str, y: str, spans: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """keys, s, y, b_in, b_out, c: the cue is inside spans number b_in and later, and outside those before b_out."""
    spans_ = F.array(*map(F.lit, spans))
    b_in = F.coalesce(F.size(F.filter(spans_, lambda k: k < F.col("first_end"))), F.lit(len(spans)))
    b_out = F.coalesce(F.size(F.filter(spans_, lambda k: k <= F.col("last_start"))), F.lit(0))
    none = lambda c, b, n: F.when(F.col(c).isNull(), F.lit(n)).otherwise(b)
    rows = df.filter(F.col(s).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(s).alias("s"), F.col(y).alias("y"), none("first_end", b_in, len(spans)).alias("b_in"), none("last_start", b_out, 0).alias("b_out"))
    return cells.cells(rows, ["s", "y", "b_in", "b_out"], keys)


def _each_span(table: DataFrame, k: int, outside: bool) -> DataFrame:
    """A row for each cell and span i with its proxy z; i = -1 has the construct, and with `outside` i from k on the proxy in the rest."""
    rows = [(-1, F.col("y").cast("int")), *((i, (F.col("b_in") <= i).cast("int")) for i in range(k))]
    if outside:
        rows += [(k + i, (F.col("b_out") > i).cast("int")) for i in range(k)]
    return table.withColumn("__x", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), z.alias("z")) for i, z in rows)))).select("*", "__x.*").drop("__x")


def walk(df: DataFrame, s: str, y: str, spans: Sequence[int], n_draws: int, seed: int | str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, i, span, n_z, coverage, auc_z, auc_z_comp, auc_y, gap, lo, hi, status.

    `df` has the offsets of `offset_index`; lo and hi are the 95 % interval of the
    gap over bootstrap draws that all spans share. Status: no proxy variation,
    score degenerate (one score at all positives, or a modal share above a half),
    coupled (lo above zero), clear.
    """
    keys, k = list(keys), len(spans)
    # The texts are read once: all that follows reads the counts.
    grid = cells.ranged(kept(span_cells(df, s, y, spans, keys), "span-cells"), "s", keys)
    cols = ["s", "y", "b_in", "b_out"]
    observed = cells.aucs(_each_span(grid.withColumn("w", F.col("c")), k, outside=True), "s", ["z"], [*keys, "i"])
    counts = grid.groupBy(*keys, "s").agg(F.sum("c").alias("c"), F.min("b_in").alias("b"))
    modal = counts.groupBy(*keys).agg(F.sum("c").alias("n"), (F.max("c") / F.sum("c")).alias("modal"), F.collect_list("b").alias("bs"))  # a number a score
    drawn = _with_range(cells.deal(grid.drop("range"), cols, n_draws, seed, keys), grid, keys)
    each = cells.aucs(_each_span(drawn, k, outside=False), "s", ["z"], [*keys, "draw", "i"])
    # A row a span in each window.
    at_y = F.max(F.when(F.col("i") < 0, F.col("auc_z"))).over(W.partitionBy(*keys, "draw"))
    gaps = each.withColumn("gap", F.col("auc_z") - at_y).filter("i >= 0")
    ends = gaps.groupBy(*keys, "i").agg(F.percentile("gap", F.lit(0.025)).alias("lo"), F.percentile("gap", F.lit(0.975)).alias("hi"))
    named = F.when(F.col("i") < 0, "auc_y").when(F.col("i") < k, "auc_z").otherwise("auc_z_comp")
    kind = observed.select(*keys, F.when(F.col("i") < k, F.col("i")).otherwise(F.col("i") - k).alias("i"), named.alias("kind"), "n_z", "auc_z")
    of = lambda c, name: F.max(F.when(F.col("kind") == name, F.col(c)))
    by_span = kind.groupBy(*keys, "i").agg(of("n_z", "auc_z").alias("n_z"), of("auc_z", "auc_z").alias("auc_z"), of("auc_z", "auc_z_comp").alias("auc_z_comp"), of("auc_z", "auc_y").alias("__y"))
    by_span = by_span.withColumn("auc_y", F.max("__y").over(W.partitionBy(*(keys or [F.lit(0)])))).filter("i >= 0").drop("__y")
    met = by_span.join(ends, [*keys, "i"], "left")
    met = met.join(modal, keys) if keys else met.crossJoin(F.broadcast(modal))  # one row
    n, n_z = F.col("n"), F.col("n_z")
    at_z = F.size(F.filter("bs", lambda b: b <= F.col("i")))
    status = F.when((n_z == 0) | (n_z == n), "no proxy variation").when((at_z <= 1) | (F.col("modal") > MOST_MODAL), "score degenerate").when(F.col("lo") > 0, "coupled").otherwise("clear")
    span = F.element_at(F.array(*map(F.lit, spans)), F.col("i") + 1)
    return met.select(*keys, "i", span.alias("span"), n_z.cast("bigint").alias("n_z"), (n_z / n).alias("coverage"), "auc_z", "auc_z_comp", "auc_y", (F.col("auc_z") - F.col("auc_y")).alias("gap"), "lo", "hi", status.alias("status"))


def _with_range(drawn: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drawn cells with their scores' ranges."""
    return drawn.join(grid.select(*keys, "s", "range").distinct(), [*keys, "s"])


def closure(walked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, last_coupled, first_clear, closure, coverage, zero_crossing of the usable spans in order; null where the first one is clear or none is. A row a span: small."""
    keys = list(keys)
    usable = walked.filter(F.col("status").isin("coupled", "clear"))
    by = W.partitionBy(*(keys or [F.lit(0)])).orderBy("i")
    u = usable.withColumns({"k": F.row_number().over(by), "span0": F.lag("span").over(by), "gap0": F.lag("gap").over(by), "cov0": F.lag("coverage").over(by)})
    at = F.struct("k", "span0", "span", "cov0", "coverage")
    cross = F.when((F.col("gap0") > 0) & (F.col("gap") <= 0), F.struct(F.col("k"), (F.col("span0") + F.col("gap0") / (F.col("gap0") - F.col("gap")) * (F.col("span") - F.col("span0"))).alias("at")))
    found = u.groupBy(*keys).agg(F.min(F.when(F.col("status") == "clear", at)).alias("f"), F.min(cross).alias("x"))
    found = found.withColumn("f", F.when(F.col("f.k") > 1, F.col("f")))
    out = [F.col("f.span0").alias("last_coupled"), F.col("f.span").alias("first_clear"), (0.5 * (F.col("f.span0") + F.col("f.span"))).alias("closure"), (0.5 * (F.col("f.cov0") + F.col("f.coverage"))).alias("coverage"), F.when(F.col("f").isNotNull(), F.col("x.at")).alias("zero_crossing")]
    if not keys:
        return found.select(*out)
    return walked.select(*keys).distinct().join(found, keys, "left").select(*keys, *out)
