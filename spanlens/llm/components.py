"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Contractions after which a graph that still changes is an error: a path of n nodes takes about log2(n).
ROUNDS = 60
#: A hub has more edges than this, and more than a HUBS-th of all: so there are at most HUBS.
HUB, HUBS = 1_000, 1_000


def _mark(edges: DataFrame, total: int | None = None) -> tuple[tuple, list]:
    """What tells two edge tables apart, and the hubs: the few nodes that a large share of the edges leads to."""
    by = edges.groupBy("b").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    if total is None:
        total = edges.count()
    hub = F.col("n") > max(HUB, total // HUBS)
    r = by.agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.collect_list(F.when(hub, F.col("b"))).alias("hubs")).first()
    return (r.n, r.h), r.hubs


def _large_star(edges: DataFrame, hubs: list) -> DataFrame:
    """A hub's edges meet its least neighbour by a broadcast of at most HUBS rows, so they stay where they are; the rest is joined by node."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def met(rows: DataFrame, few: bool) -> DataFrame:
        least = rows.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return rows.join(F.broadcast(least) if few else least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))

    if hubs:
        some = F.broadcast(edges.sparkSession.createDataFrame([(h,) for h in hubs], edges.select("a").schema))
        stars = met(both.join(some, "a", "left_anti"), False).union(met(both.join(some, "a", "left_semi"), True))
    else:
        stars = met(both, False)
    return stars.filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node that has an edge; the root is the component's least node. Self-edges and nulls are ignored."""
    e = materialise(edges.select("a", "b").filter("a <> b").distinct(), name)
    was, hubs = _mark(e)
    for _ in range(ROUNDS):
        e = materialise(_small_star(_large_star(e, hubs)), name)
        now, hubs = _mark(e, was[0])
        if now == was:
            roots = e.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        was = now
    raise RuntimeError(f"components still change after {ROUNDS} rounds")
