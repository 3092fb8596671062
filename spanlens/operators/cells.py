"""Resampling on counts of distinct cells.

A contract of any size is a table of distinct cells (a score, its labels) with
counts. A bootstrap of its rows is a multinomial draw over the cells, and
taking rows without replacement (a thinned class, ones permuted within a
stratum) is a multivariate hypergeometric one, so a draw costs as many steps as
there are cells, however many rows they stand for. Both are drawn by a tree of two
levels: first how many rows go to each of at most GROUPS groups of cells, then
within each group, one conditional count after another. A count is the inverse of
its distribution function at a number from MD5 of (seed, draw, cell): no
partitioning changes it, and another engine gives the same.

Draws, spans and labels share one table of cells; keys (contracts, outer draws) go
through together. AUCs of draws are sums within ranges of the score, then over the
ranges, so no task holds the scores of a draw.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship
from .rank import usable
from .resample import draw_hash

#: Groups of cells: a task draws the cells of a group for one draw, and the groups of a key for one draw.
GROUPS = 64
#: Draws that go through a group together.
BLOCK = 64
#: Ranges of the score by which a draw's AUC is summed.
RANGES = 64
#: The part of a distribution that is walked: so many deviations and counts to either side of the mean. Hashes have 32 bits, and what is left out has a chance below 1e-11.
DEVIATIONS, MARGIN = 6.8, 8


def cells(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, cols and c, how many rows are alike in them: one aggregate with partial counts on the map side."""
    return df.groupBy(*keys, *cols).agg(F.count("*").alias("c"))


def log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series at x + 8, to about 1e-13."""
    n = x + F.lit(9.0)
    series = (n - 0.5) * F.ln(n) - n + F.lit(0.9189385332046727) + 1 / (12 * n) - 1 / (360 * n * n * n) + 1 / (1260 * n * n * n * n * n)
    steps = F.lit(1.0)
    for i in range(1, 9):
        steps = steps * (x + F.lit(float(i)))
    return series - F.ln(steps)


def _inverse(lo: Column, hi: Column, log_first: Callable[[Column], Column], ratio: Callable[[Column], Column], u: Column) -> Column:
    """The least k from lo on with P(X <= k) >= u, hi at most: log_first is ln P(X = lo), ratio P(X = k + 1) / P(X = k)."""
    start = F.struct(F.exp(log_first(lo)).alias("t"), F.lit(0.0).alias("f"), lo.alias("k"))

    def step(a: Column, k: Column) -> Column:
        f = a["f"] + a["t"]
        return F.struct((a["t"] * ratio(k.cast("double"))).alias("t"), f.alias("f"), (a["k"] + (f < u).cast("bigint")).alias("k"))

    return F.least(F.aggregate(F.sequence(lo, hi), start, step, lambda a: a["k"]), hi)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once: lambdas don't share subexpressions."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _range(mean: Column, variance: Column, least: Column, most: Column) -> Column:
    off = F.sqrt(F.greatest(variance, F.lit(0.0))) * DEVIATIONS + MARGIN
    return F.struct(F.greatest(least, F.floor(mean - off).cast("bigint")).alias("lo"), F.least(most, F.ceil(mean + off).cast("bigint")).alias("hi"))


def binomial(n: Column, p: Column, u: Column) -> Column:
    """Inverse of the binomial distribution function at u in (0, 1); n a bigint, p a double."""

    def walk(v: Column) -> Column:
        x, p_ = v["x"], v["p"]

        def from_(b: Column) -> Column:
            lo = b["lo"].cast("double")
            first = log_factorial(x) - log_factorial(lo) - log_factorial(x - lo) + lo * F.ln(p_) + (x - lo) * F.ln(1 - p_)
            return _inverse(b["lo"], b["hi"], lambda _: first, lambda k: (x - k) / (k + 1) * v["odds"], v["u"])

        inner = _once(_range(x * p_, x * p_ * (1 - p_), F.lit(0).cast("bigint"), v["n"]), from_)
        return F.when((v["n"] <= 0) | (p_ <= 0), F.lit(0).cast("bigint")).when(p_ >= 1, v["n"]).otherwise(inner)

    # What a walk reads at each step is computed once, the hash above all.
    return _once(F.struct(n.alias("n"), n.cast("double").alias("x"), p.alias("p"), F.when(p < 1, p / (1 - p)).alias("odds"), u.alias("u")), walk)


def hypergeometric(size: Column, ones: Column, taken: Column, u: Column) -> Column:
    """Inverse distribution function of the ones among `taken` of `size` rows, `ones` of them ones; bigints."""

    def walk(v: Column) -> Column:
        n, c, t, f = v["n"], v["c"], v["t"], log_factorial

        def from_(b: Column) -> Column:
            lo = b["lo"].cast("double")
            first = f(c) - f(lo) - f(c - lo) + f(n - c) - f(t - lo) - f(n - c - t + lo) - f(n) + f(t) + f(n - t)
            return _inverse(b["lo"], b["hi"], lambda _: first, lambda k: (c - k) * (t - k) / ((k + 1) * (n - c - t + k + 1)), v["u"])

        variance = t * (c / n) * (1 - c / n) * (n - t) / F.greatest(n - 1, F.lit(1.0))
        inner = _once(_range(t * c / n, variance, v["least"], v["most"]), from_)
        return F.when(v["least"] == v["most"], v["least"]).otherwise(inner)

    least, most = F.greatest(F.lit(0).cast("bigint"), taken - (size - ones)), F.least(taken, ones)
    named = {"n": size.cast("double"), "c": ones.cast("double"), "t": taken.cast("double"), "u": u, "least": least, "most": most}
    return _once(F.struct(*(v.alias(k) for k, v in named.items())), walk)


def _log_factorials(x: np.ndarray) -> np.ndarray:
    """`log_factorial` in arrays, by the same series."""
    n = x + 9.0
    steps = np.ones_like(n)
    for i in range(1, 9):
        steps = steps * (x + float(i))
    return (n - 0.5) * np.log(n) - n + 0.9189385332046727 + 1 / (12 * n) - 1 / (360 * n**3) + 1 / (1260 * n**5) - np.log(steps)


def _inverses(mean, variance, least, most, log_first, ratio, u) -> np.ndarray:
    """`_inverse` for many draws at once, up to the last that still walks."""
    off = np.sqrt(np.maximum(variance, 0.0)) * DEVIATIONS + MARGIN
    lo = np.maximum(least, np.floor(mean - off).astype(np.int64))
    hi = np.minimum(most, np.ceil(mean + off).astype(np.int64))
    t, f, k, at = np.exp(log_first(lo.astype(np.float64))), np.zeros(len(u)), lo.copy(), lo.astype(np.float64)
    for _ in range(int((hi - lo).max(initial=-1)) + 1):
        f += t
        below = (f < u) & (at <= hi)
        if not below.any():
            break
        k += below
        t = t * ratio(at)
        at += 1
    return np.minimum(k, hi)


def _binomials(n: np.ndarray, c: int, size: int, u: np.ndarray) -> np.ndarray:
    p = c / float(size)
    if p >= 1:
        return n.copy()
    x, lf, odds = n.astype(np.float64), _log_factorials, p / (1 - p)
    found = _inverses(x * p, x * p * (1 - p), np.zeros(len(n), np.int64), n, lambda lo: lf(x) - lf(lo) - lf(x - lo) + lo * np.log(p) + (x - lo) * np.log(1 - p), lambda k: (x - k) / (k + 1) * odds, u)
    return np.where(n > 0, found, 0)


def _hypergeometrics(size: int, ones: int, taken: np.ndarray, u: np.ndarray) -> np.ndarray:
    n, c, t, lf = float(size), float(ones), taken.astype(np.float64), lambda v: _log_factorials(np.asarray(v, np.float64))
    least, most = np.maximum(0, taken - (size - ones)), np.minimum(taken, ones)
    first = lambda lo: lf(c) - lf(lo) - lf(c - lo) + lf(n - c) - lf(t - lo) - lf(n - c - t + lo) - lf(n) + lf(t) + lf(n - t)
    with np.errstate(divide="ignore", invalid="ignore"):  # beyond the support, where nothing is read
        found = _inverses(t * c / n, t * (c / n) * (1 - c / n) * (n - t) / max(n - 1, 1.0), least, most, first, lambda k: (c - k) * (t - k) / ((k + 1) * (n - c - t + k + 1)), u)
    return np.where(least == most, least, found)


def _uniforms(seed: int | str, name: str, first: int, many: int) -> np.ndarray:
    """`draw_hash` of (seed, draw, name) for draws from `first` on, within (0, 1)."""
    h = [int(hashlib.md5(f"{seed}-{first + i}-{name}".encode()).hexdigest()[:8], 16) for i in range(many)]
    return (np.array(h, np.float64) + 0.5) / 4294967296.0


def _share_out(names: list[str], counts: list[int], size: int, take: np.ndarray, first: int, seed: int | str, replace: bool) -> np.ndarray:
    """Items x draws: how many of `take` rows fall on each item, one conditional count after another."""
    out, left = np.zeros((len(names), len(take)), np.int64), take.copy()
    for j, (name, c) in enumerate(zip(names, counts, strict=True)):
        u = _uniforms(seed, name, first, len(take))
        out[j] = _binomials(left, c, size, u) if replace else _hypergeometrics(size, c, left, u)
        left -= out[j]
        size -= c
    return out


def _dealer(kept: list[str], fields: list[str], seed: int | str, replace: bool):
    """Rows (kept columns, items with name, c and fields, size, take by draw, first draw) to a row for each item that any draw falls on: kept columns, fields, first, ws by draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, sizes, takes, firsts = (batch.column(batch.schema.get_field_index(c)) for c in ("items", "size", "take", "first"))
            for r in range(batch.num_rows):
                own = items.slice(r, 1).flatten()
                ws = _share_out(own.field("name").to_pylist(), own.field("c").to_pylist(), sizes[r].as_py(), np.array(takes[r].as_py(), np.int64), firsts[r].as_py(), seed, replace)
                some = np.flatnonzero(ws.any(axis=1))
                row, at = pa.array(np.full(len(some), r)), pa.array(some)
                columns = [batch.column(batch.schema.get_field_index(c)).take(row) for c in kept] + [own.field(c).take(at) for c in fields] + [firsts.take(row), pa.array(ws[some].tolist(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *fields, "first", "ws"])

    return run


def deal(table: DataFrame, cols: Sequence[str], n_draws: int, seed: int | str, keys: Sequence[str] = (), take: str | None = None) -> DataFrame:
    """keys, draw, cols, w (above 0): for each draw, rows of each cell.

    Without `take` as many rows as a key has, with replacement (the bootstrap);
    with it, the number in that column (one for each key, cut to the key's rows),
    without replacement. Numpy walks the distributions of BLOCK draws at once, about
    fifty times as fast as `binomial` in a lambda for each; the same numbers come out.
    """
    keys, spark = list(keys), table.sparkSession
    ship(spark)
    cell = F.concat_ws("-", *(F.col(c).cast("string") for c in cols))
    t = table.withColumn("__id", cell).withColumn("__g", F.pmod(draw_hash("cell", F.col("__id")), F.lit(GROUPS)))
    types = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    listed = F.array_sort(F.collect_list(F.struct(F.col("__id").alias("name"), "c", *cols)))
    groups = t.groupBy(*keys, "__g").agg(F.sum("c").alias("__c"), listed.alias("__cells"), *([F.max(take).alias("__take")] if take else []))
    # At most GROUPS entries for each key.
    named = F.array_sort(F.collect_list(F.struct(F.col("__g").alias("g"), F.col("__c").alias("c"))))
    tops = groups.groupBy(*keys).agg(named.alias("__gs"), F.sum("__c").alias("size"), *([F.max("__take").alias("__take")] if take else []))
    n = F.least(F.col("__take").cast("bigint"), F.col("size")) if take else F.col("size")
    blocks = spark.range(0, n_draws, BLOCK).select(F.col("id").alias("first"), F.least(F.lit(BLOCK), n_draws - F.col("id")).cast("int").alias("__many"))
    items = F.transform("__gs", lambda x: F.struct(x["g"].cast("string").alias("name"), x["c"].alias("c"), x["g"].alias("__g")))
    # By number, since these few bytes are much work: they would be joined into one task by their size.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    high = tops.crossJoin(F.broadcast(blocks)).select(*keys, items.alias("items"), "size", F.array_repeat(n, F.col("__many")).alias("take"), "first").repartition(tasks, *keys, "first")
    key_types = "".join(f"`{k}` {types[k]}, " for k in keys)
    by_group = high.mapInArrow(_dealer(keys, ["__g"], seed, not take), f"{key_types}__g bigint, first bigint, ws array<bigint>")
    met = by_group.join(groups.select(*keys, "__g", F.col("__c").alias("size"), F.col("__cells").alias("items")), [*keys, "__g"])
    low = met.select(*keys, "items", "size", F.col("ws").alias("take"), "first").repartition(tasks)
    cell_types = "".join(f"`{c}` {types[c]}, " for c in cols)
    dealt = low.mapInArrow(_dealer(keys, list(cols), seed, not take), f"{key_types}{cell_types}first bigint, ws array<bigint>")
    each = dealt.select(*keys, "first", *cols, F.posexplode("ws").alias("__i", "w")).filter("w > 0")
    return each.select(*keys, (F.col("first") + F.col("__i")).alias("draw"), *cols, "w")


def ranged(table: DataFrame, s: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds range: the score's place among RANGES ranges of its key's distinct cells."""
    cuts = [k / RANGES for k in range(1, RANGES)]
    edges = table.groupBy(*keys).agg(F.percentile_approx(F.col(s).cast("double"), cuts, 10_000).alias("__edges"))
    met = table.join(edges, list(keys)) if keys else table.crossJoin(F.broadcast(edges))  # without keys one row
    return met.withColumn("range", F.size(F.filter("__edges", lambda e: e < F.col(s)))).drop("__edges")


def aucs(drawn: DataFrame, s: str, labels: Sequence[str], keys: Sequence[str], w: str = "w") -> DataFrame:
    """keys, and for each label n_<label> (positives) and auc_<label>, null without both classes; `drawn` has range (of `ranged`)."""
    keys = list(keys)
    sums = []
    for y in labels:
        one = F.col(y).cast("int")
        sums += [F.coalesce(F.sum(F.col(w) * one), F.lit(0)).alias(f"p_{y}"), F.coalesce(F.sum(F.col(w) * (1 - one)), F.lit(0)).alias(f"q_{y}")]
    t = drawn.filter(usable(s)).groupBy(*keys, "range", s).agg(*sums)
    below = W.partitionBy(*keys, "range").orderBy(s).rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumns({f"b_{y}": F.coalesce(F.sum(f"q_{y}").over(below), F.lit(0)) for y in labels})
    per = t.groupBy(*keys, "range").agg(*(a for y in labels for a in (F.sum(f"p_{y}").alias(f"p_{y}"), F.sum(f"q_{y}").alias(f"q_{y}"), F.sum(F.col(f"p_{y}") * (F.col(f"b_{y}") + F.col(f"q_{y}") / F.lit(2.0))).alias(f"won_{y}"))))
    # At most RANGES rows a key and draw.
    before = W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1) if keys else W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumns({f"b_{y}": F.coalesce(F.sum(f"q_{y}").over(before), F.lit(0)) for y in labels})
    out = []
    for y in labels:
        p, q = F.sum(f"p_{y}"), F.sum(f"q_{y}")
        out += [p.alias(f"n_{y}"), F.when((p > 0) & (q > 0), F.sum(F.col(f"won_{y}") + F.col(f"p_{y}") * F.col(f"b_{y}")) / (p.cast("double") * q)).alias(f"auc_{y}")]
    return per.groupBy(*keys).agg(*out)


def statistic(table: DataFrame, cols: Sequence[str], stats: dict[str, Callable[[str], Column]], n_draws: int, seed: int | str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, draw and each statistic: an aggregate over cells weighted by the column it is given, on bootstrap draws."""
    drawn = deal(table, cols, n_draws, seed, keys)
    return drawn.groupBy(*keys, "draw").agg(*(f("w").alias(name) for name, f in stats.items()))


def order_ends(df: DataFrame, values: Sequence[str], keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """keys, and of each value its valid draws m, lo and hi as order statistics: places int(alpha / 2 m) and int((1 - alpha / 2) m) - 1, from 0."""
    lists = df.groupBy(*keys).agg(*(F.array_sort(F.array_compact(F.collect_list(v))).alias(v) for v in values))  # a number a draw
    out = []
    for v in values:
        m = F.size(v)
        lo, hi = F.floor(m * (alpha / 2)).cast("int") + 1, F.greatest(F.floor(m * (1 - alpha / 2)).cast("int"), F.lit(1))
        out += [m.alias(f"draws_{v}"), F.when(m > 0, F.try_element_at(F.col(v), lo)).alias(f"lo_{v}"), F.when(m > 0, F.try_element_at(F.col(v), hi)).alias(f"hi_{v}")]
    return lists.select(*keys, *out)
