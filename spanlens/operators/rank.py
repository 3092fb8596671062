"""Rank statistics: AUC, average precision, precision at k, routed composition, ties, selection.

All of them work on the table of distinct scores, so the shuffle carries one row
for each score and map task. With keys the running sums are windows within a
key; without keys they are two-level prefix sums (score ranges first), so a lone
contract of any size is not sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import kept

#: Score ranges of the two-level prefix sums.
RANGES = 64


def usable(s: str) -> Column:
    """Scores that take part: neither null nor NaN."""
    return F.col(s).isNotNull() & ~F.isnan(F.col(s).cast("double"))


def score_table(df: DataFrame, s: str, labels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, s, n and p_<label>, q_<label> (positives and negatives of each label; null labels are neither)."""
    aggs = [F.count("*").alias("n")]
    for y in labels:
        one = F.col(y).cast("int")
        aggs += [F.coalesce(F.sum(one), F.lit(0)).alias(f"p_{y}"), F.coalesce(F.sum(1 - one), F.lit(0)).alias(f"q_{y}")]
    return df.filter(usable(s)).groupBy(*keys, s).agg(*aggs)


def running(table: DataFrame, s: str, cols: Sequence[str], keys: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Adds before_<col>: the sum of `col` over rows whose score comes earlier. One row for each key and score."""
    order = F.desc(s) if descending else F.asc(s)
    frame = (W.unboundedPreceding, -1)
    if keys:
        w = W.partitionBy(*keys).orderBy(order).rowsBetween(*frame)
        return table.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in cols})
    cuts = [k / RANGES for k in range(1, RANGES)]
    edges = table.agg(F.percentile_approx(F.col(s).cast("double"), cuts, 10_000).alias("__edges"))
    # One row; then at most RANGES rows.
    ranged = table.crossJoin(F.broadcast(edges)).withColumn("__range", F.size(F.filter("__edges", lambda e: e < F.col(s)))).drop("__edges")
    sums = ranged.groupBy("__range").agg(*(F.sum(c).alias(f"__s_{c}") for c in cols))
    by_range = W.orderBy(F.desc("__range") if descending else F.asc("__range")).rowsBetween(*frame)
    offsets = sums.select("__range", *(F.coalesce(F.sum(f"__s_{c}").over(by_range), F.lit(0)).alias(f"__o_{c}") for c in cols))
    w = W.partitionBy("__range").orderBy(order).rowsBetween(*frame)
    joined = ranged.join(F.broadcast(offsets), "__range")
    out = joined.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"__o_{c}") for c in cols})
    return out.drop("__range", *(f"__o_{c}" for c in cols))


def auc(df: DataFrame, s: str, labels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, and for each label n_<label> (positives) and auc_<label>: Mann-Whitney with half ties, null if a class is missing."""
    t = running(score_table(df, s, labels, keys), s, [f"q_{y}" for y in labels], keys)
    aggs = [F.coalesce(F.sum("n"), F.lit(0)).alias("n")]
    for y in labels:
        p, q = F.sum(f"p_{y}"), F.sum(f"q_{y}")
        won = F.sum(F.col(f"p_{y}") * (F.col(f"before_q_{y}") + F.col(f"q_{y}") / F.lit(2.0)))
        aggs += [F.coalesce(p, F.lit(0)).alias(f"n_{y}"), F.when((p > 0) & (q > 0), won / (p.cast("double") * q)).alias(f"auc_{y}")]
    return t.groupBy(*keys).agg(*aggs)


def average_precision(df: DataFrame, s: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, n_pos, ap: sum of recall steps times precision over distinct thresholds; null without positives."""
    t = running(score_table(df, s, [label], keys).withColumnRenamed(f"p_{label}", "p"), s, ["p", "n"], keys, descending=True)
    step = F.col("p") * (F.col("before_p") + F.col("p")) / (F.col("before_n") + F.col("n")).cast("double")
    total = F.sum("p")
    return t.groupBy(*keys).agg(F.sum("n").alias("n"), total.alias("n_pos"), F.when(total > 0, F.sum(step) / total).alias("ap"))


def ranked(df: DataFrame, s: str, tie: str, keys: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """Adds rk: 1 for the largest score, ties by `tie`. With `most`, the first rows only, which Spark then limits before it shuffles."""
    w = W.partitionBy(*keys).orderBy(F.desc(s), tie) if keys else W.partitionBy(F.lit(0)).orderBy(F.desc(s), tie)
    out = df.filter(usable(s)).withColumn("rk", F.row_number().over(w))
    return out if most is None else out.filter(F.col("rk") <= most)


def precision_at(df: DataFrame, s: str, label: str, tie: str, ks: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """keys, k, n_top, precision: mean label of the k rows of largest score, for each k."""
    top = ranked(df, s, tie, keys, max(ks))
    each = top.withColumn("k", F.explode(F.array(*(F.lit(k) for k in sorted(set(ks)))))).filter(F.col("rk") <= F.col("k"))
    return each.groupBy(*keys, "k").agg(F.count("*").alias("n_top"), F.avg(F.col(label).cast("double")).alias("precision"))


def budgets(spec: str, n: int, n_pos: int) -> list[int]:
    """Counts from a comma list: 0 < v <= 1 is a share of n, else a count; clamped to [1, n]; the positives' number joins them."""
    out = {n_pos} if n_pos else set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        v = float(part)
        if v <= 0:
            raise ValueError(f"budget {part!r} is not positive")
        out.add(round(v * n) if v <= 1 else int(v))
    return sorted({min(max(1, b), n) for b in out}) if n else []


def budget_of(share: Column, n: Column, how: str = "half_even") -> Column:
    """A share of n rows as a count: rounded half-even and one at least, or down."""
    if how == "floor":
        return F.floor(share * n).cast("int")
    return F.greatest(F.lit(1), F.bround(share * n, 0).cast("int"))


def summary(df: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    """name, settings, mean_<value> over rows in which no value is null."""
    return df.dropna(subset=list(values)).groupBy(name).agg(F.count("*").alias("settings"), *(F.avg(v).alias(f"mean_{v}") for v in values))


def numbered(df: DataFrame, orders: Sequence[Column], name: str = "rk") -> DataFrame:
    """Adds 1, 2, ... in an order of all rows, which must leave no ties: ranges of the whole order are written, counted and numbered apart, so no task holds the table, and half the rows on one score are as many ranges as any other half."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written with its range, so that counts and rows are of one and the same cut.
    cut = kept(df.repartitionByRange(tasks, *orders).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = cut.groupBy("__range").agg(F.count("*").alias("__n"))  # a row a range
    before = counts.select("__range", F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    place = F.row_number().over(W.partitionBy("__range").orderBy(*orders))
    return cut.join(F.broadcast(before), "__range").withColumn(name, (F.col("__o") + place).cast("long")).drop("__range", "__o")


def cases(df: DataFrame, s: str, tie: str, most: int | None = None) -> DataFrame:
    """Adds rk = 1, 2, ... by falling score, equal ones by `tie`; or only the first `most` rows are kept."""
    if most is not None:
        return ranked(df, s, tie, most=most)
    return numbered(df.filter(usable(s)), [F.desc(s), F.asc(tie)]).withColumn("rk", F.col("rk").cast("int")).select("rk", *df.columns)


def composition(df: DataFrame, s: str, tie: str, states: Sequence[str], sizes: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """keys, budget, routed, n_<state> of the first `budget` rows, and their mean score."""
    top = ranked(df, s, tie, keys, max(sizes))
    each = top.withColumn("budget", F.explode(F.array(*(F.lit(b) for b in sizes)))).filter(F.col("rk") <= F.col("budget"))
    counts = [F.sum(F.col(x).cast("long")).alias(f"n_{x}") for x in states]
    return each.groupBy(*keys, "budget").agg(F.count("*").alias("routed"), *counts, F.avg(s).alias("mean_score"))


def modal(df: DataFrame, s: str, keys: Sequence[str] = (), digits: int | None = 6) -> DataFrame:
    """keys, n, distinct_scores, modal_share: share of the most frequent score, rounded to `digits` (None: as it is)."""
    v = F.col(s) if digits is None else F.round(s, digits)
    t = df.filter(usable(s)).groupBy(*keys, v.alias("__v")).agg(F.count("*").alias("c"))
    return t.groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("distinct_scores"), (F.max("c") / F.sum("c")).alias("modal_share"))


def within_auc(df: DataFrame, s: str, y: str, group: str) -> DataFrame:
    """Groups with both classes: their number, mean AUC, AUC weighted by pairs; and the decomposition pooled = lam * within + (1 - lam) * cross."""
    per = auc(df, s, [y], [group]).withColumn("pairs", F.col(f"n_{y}").cast("double") * (F.col("n") - F.col(f"n_{y}")))
    pooled = auc(df, s, [y]).select(F.col(f"auc_{y}").alias("pooled"), (F.col(f"n_{y}").cast("double") * (F.col("n") - F.col(f"n_{y}"))).alias("all_pairs"))
    w = per.agg(
        F.count(f"auc_{y}").alias("groups"),
        F.avg(f"auc_{y}").alias("within"),
        (F.sum(F.col("pairs") * F.col(f"auc_{y}")) / F.sum("pairs")).alias("within_weighted"),
        F.sum("pairs").alias("own_pairs"),
        F.sum(F.col("n")).alias("n"),
    )
    lam = F.col("own_pairs") / F.col("all_pairs")
    both = w.crossJoin(F.broadcast(pooled))  # two single rows
    return both.select("groups", "n", "within", "within_weighted", "pooled", lam.alias("lam"), ((F.col("pooled") - lam * F.col("within_weighted")) / (1 - lam)).alias("cross"))


def exact_within_null(df: DataFrame, s: str, y: str, group: str) -> DataFrame:
    """Mean pooled AUC if labels are permuted within groups: each group's positives at its mean rank. Rows meet the ranks as counts by group and score, so a frequent score is a row a group."""
    t = score_table(df, s, [y])
    ranks = running(t, s, ["n"]).select(s, (F.col("before_n") + (F.col("n") + 1) / F.lit(2.0)).alias("mid"))
    cells = df.filter(usable(s)).groupBy(group, s).agg(F.count("*").alias("k"), F.sum(F.col(y).cast("long")).alias("p"))
    per = cells.join(ranks, s).groupBy(group).agg((F.sum(F.col("mid") * F.col("k")) / F.sum("k")).alias("m"), F.sum("p").alias("p"), F.sum("k").alias("c"))
    p, n = F.sum("p").cast("double"), F.sum("c")
    return per.agg(F.sum("c").alias("n"), ((F.sum(F.col("m") * F.col("p")) - p * (p + 1) / 2) / (p * (n - p))).alias("null_mean"))


def best_of_group(df: DataFrame, s: str, tie: str, group: str) -> DataFrame:
    """The row of largest score of each group, the first by `tie` of equals: an aggregate, so a hot group is one row a map task."""
    order = F.struct(F.negate(F.col(s)).alias("s"), F.col(tie).alias("tie"))
    return df.filter(usable(s)).groupBy(group).agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def budget_sweep(df: DataFrame, s: str, label: str, tie: str, sizes: Sequence[int]) -> DataFrame:
    """budget, routed, hits, precision, recall of the first rows."""
    total = df.filter(usable(s)).agg(F.sum(F.col(label).cast("long")).alias("__p"))
    c = composition(df, s, tie, [label], sizes).crossJoin(F.broadcast(total))  # one row
    return c.select("budget", "routed", F.col(f"n_{label}").alias("hits"), (F.col(f"n_{label}") / F.col("routed")).alias("precision"), F.when(F.col("__p") > 0, F.col(f"n_{label}") / F.col("__p")).alias("recall"))


def tie_exposure(df: DataFrame, s: str, label: str, size: int) -> DataFrame:
    """At the cut of the first `size` rows: cut score, rows surely in, rows tied at the cut, places left for them, positives in and tied, and the expected positives if ties fall at random (hypergeometric mean)."""
    t = running(score_table(df, s, [label]), s, ["n", f"p_{label}"], descending=True)
    at = t.filter((F.col("before_n") < size) & (F.col("before_n") + F.col("n") >= size))
    left = size - F.col("before_n")
    return at.select(F.col(s).alias("cut"), F.col("before_n").alias("surely"), F.col("n").alias("tied"), left.alias("places"), F.col(f"before_p_{label}").alias("pos_in"), F.col(f"p_{label}").alias("pos_tied"), (F.col(f"before_p_{label}") + left * F.col(f"p_{label}") / F.col("n")).alias("expected"))


def side_summary(df: DataFrame, side: str, text: str, status: str, error: str) -> DataFrame:
    """side, status, n, empty, errors."""
    blank = F.coalesce(F.trim(F.col(text)), F.lit("")) == ""
    return df.groupBy(side, status).agg(F.count("*").alias("n"), F.count_if(blank).alias("empty"), F.count_if(F.col(error).isNotNull() & (F.col(error) != "")).alias("errors"))


def error_model(df: DataFrame, truth: str, said: str, side: str) -> DataFrame:
    """side, n, p_false_pos, p_false_neg: how often the judge leaves the truth, by the truth."""
    t, j = F.col(truth).cast("int"), F.col(said).cast("int")
    wrong = (t != j).cast("double")
    return df.groupBy(side).agg(F.count("*").alias("n"), F.avg(F.when(t == 0, wrong)).alias("p_false_pos"), F.avg(F.when(t == 1, wrong)).alias("p_false_neg"))


def aggregator_check(df: DataFrame, values: str, released: str) -> DataFrame:
    """how, n, corr, max_gap of each way to sum up step values against a released score."""
    from ..functions.rules import prefix_score

    ways = ("product", "min", "mean", "last")
    v = F.col(values)
    wide = df.select(F.col(released).alias("r"), *(prefix_score(v, F.size(v), w).alias(w) for w in ways))
    sums = wide.agg(F.count("r").alias("n"), *(F.corr(w, "r").alias(f"c_{w}") for w in ways), *(F.max(F.abs(F.col(w) - F.col("r"))).alias(f"g_{w}") for w in ways))
    rows = F.array(*(F.struct(F.lit(w).alias("how"), F.col("n").alias("n"), F.col(f"c_{w}").alias("corr"), F.col(f"g_{w}").alias("max_gap")) for w in ways))
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def zero_crossing(df: DataFrame, at: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, crossing: where the value, linear between neighbours, first falls from above zero to zero or below; null if it never does. A table of spans: small."""
    w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(at)
    steps = df.withColumn("__a", F.lag(at).over(w)).withColumn("__v", F.lag(value).over(w))
    cross = F.when((F.col("__v") > 0) & (F.col(value) <= 0), F.col("__a") + (F.col(at) - F.col("__a")) * F.col("__v") / (F.col("__v") - F.col(value)))
    return steps.groupBy(*keys).agg(F.min(cross).alias("crossing"))


def first_clear(df: DataFrame, at: str, lo: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, first_clear: the first span from which on the interval's lower end isn't above zero."""
    return df.groupBy(*keys).agg(F.min(F.when(F.col(lo) <= 0, F.col(at))).alias("first_clear"))
