"""Simulated contracts with known structure, and power."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .resample import draw_hash


def uniform(seed: int | str, *parts: Column) -> Column:
    """In (0, 1), the same in any partitioning."""
    return (draw_hash(seed, *parts) + 0.5) / F.lit(4294967296.0)


def normal(seed: int | str, *parts: Column) -> Column:
    """Box-Muller from two hashes."""
    return F.sqrt(-2 * F.log(uniform(f"{seed}u", *parts))) * F.cos(F.lit(6.283185307179586) * uniform(f"{seed}v", *parts))


def latent_contracts(spark: SparkSession, n: int, alphas: Sequence[float], prevalence: float = 0.3, seed: int = 1) -> DataFrame:
    """alpha, id, s, z, z_comp, y: the score sees the span's latent; the construct is alpha times the span's latent and the rest another's, and so is the proxy off the span."""
    grid = spark.range(n).crossJoin(F.broadcast(spark.createDataFrame([(float(a),) for a in alphas], "alpha double")))
    u, v, e = (normal(f"{seed}-{k}", F.col("id"), F.col("alpha")) for k in "uve")
    mixed = grid.select("alpha", "id", u.alias("u"), v.alias("v"), e.alias("e"))
    beta = F.sqrt(1 - F.col("alpha") * F.col("alpha"))
    latent_y = F.col("alpha") * F.col("u") + beta * F.col("v")
    rows = mixed.select("alpha", "id", (F.col("u") + 0.3 * F.col("e")).alias("s"), F.col("u").alias("lz"), (0.5 * F.col("u") + 0.8660254 * F.col("e")).alias("lc"), latent_y.alias("ly"))
    cut = rows.groupBy("alpha").agg(*(F.percentile(c, F.lit(1 - prevalence)).alias(f"c_{c}") for c in ("lz", "lc", "ly")))
    at = rows.join(F.broadcast(cut), "alpha")  # one row an alpha
    return at.select("alpha", "id", "s", *((F.col(c) > F.col(f"c_{c}")).cast("int").alias(n) for c, n in (("lz", "z"), ("lc", "z_comp"), ("ly", "y"))))


#: The named cases: how score, proxy and its complement arise from the construct's latent q, others' a, v, m and fresh noise.
CASES = ("valid", "containment", "mismatch", "spillover", "score_failure", "high_kappa", "mixed")


def named_cases(spark: SparkSession, n: int, seed: int | str = 7) -> DataFrame:
    """case, id, s, z, z_comp, y of the seven named cases, n rows each; thresholds at each case's median."""
    grid = spark.range(n).crossJoin(F.broadcast(spark.createDataFrame([(c,) for c in CASES], "case string")))
    u = lambda k: normal(f"{seed}-{k}", F.col("case"), F.col("id"))
    base = grid.select("case", "id", *(u(k).alias(k) for k in "qavm"), *(u(f"e{i}").alias(f"e{i}") for i in range(8)), uniform(f"{seed}-flip", F.col("case"), F.col("id")).alias("flip"))
    q, a, v, m = (F.col(k) for k in "qavm")

    def mix(latent: Column, w: float, noise: str) -> Column:
        return w * latent + (max(1e-9, 1 - w * w) ** 0.5) * F.col(noise)

    # The cases' weights.
    t = base.select("case", "id", "q", "a", "v", "m", "flip", "e5", "e6", "e7", mix(q, 0.30, "e0").alias("qs"), mix(v, 0.80, "e1").alias("vs"), mix(v, 0.80, "e2").alias("vo"), mix(m, 0.80, "e3").alias("ms"), mix(m, 0.80, "e4").alias("mo"), mix(q, 0.7, "e6").alias("q1"), mix(q, 0.7, "e7").alias("q2"))
    qs, vs, ms = F.col("qs"), F.col("vs"), F.col("ms")
    y = (q > 0).cast("int")
    merged = F.when(F.col("flip") < 0.20, 1 - y).otherwise(y)
    pick = lambda d: reduce(lambda out, c: out.when(F.col("case") == c, d[c]), CASES[1:], F.when(F.col("case") == CASES[0], d[CASES[0]]))
    s = pick({"valid": 0.7 * qs + 0.3 * F.col("e5"), "containment": 0.55 * a + 0.25 * qs, "mismatch": 0.35 * qs + 0.55 * ms, "spillover": 0.25 * qs + 0.55 * vs, "score_failure": 0.55 * a + 0.55 * vs, "high_kappa": merged + 0.05 * F.col("e5"), "mixed": 0.55 * a + 0.35 * qs + 0.4 * ms})
    lz = pick({"valid": F.col("q1"), "containment": a, "mismatch": ms, "spillover": vs, "score_failure": a + vs, "high_kappa": merged.cast("double"), "mixed": 0.5 * a + 0.5 * ms})
    lc = pick({"valid": F.col("q2"), "containment": F.col("e6"), "mismatch": F.col("mo"), "spillover": F.col("vo"), "score_failure": F.col("vo"), "high_kappa": merged.cast("double"), "mixed": F.col("mo")})
    rows = t.select("case", "id", s.alias("s"), lz.alias("lz"), lc.alias("lc"), y.alias("y"))
    cut = rows.groupBy("case").agg(F.percentile("lz", F.lit(0.5)).alias("cz"), F.percentile("lc", F.lit(0.5)).alias("cc"))
    above = lambda latent, at: F.when(F.col("case") == "high_kappa", F.col(latent)).otherwise((F.col(latent) > F.col(at)).cast("double")).cast("int")
    return rows.join(F.broadcast(cut), "case").select("case", "id", "s", above("lz", "cz").alias("z"), above("lc", "cc").alias("z_comp"), "y")  # one row a case


def pair_kappa(spark: SparkSession, n: int, errors: Sequence[float], prevalence: float = 0.3, shared: float = 0.0, seed: int = 2) -> DataFrame:
    """error, side_kappa_rows: labels of two sides and their judges, flipped independently or with `shared` ambiguity; and the pair label from each."""
    grid = spark.range(n).crossJoin(F.broadcast(spark.createDataFrame([(float(e),) for e in errors], "error double")))
    u = lambda name: uniform(f"{seed}-{name}", F.col("id"), F.col("error"))
    truth = grid.select("error", "id", (u("a") < prevalence).cast("int").alias("a"), (u("b") < prevalence).cast("int").alias("b"), (u("h") < shared).alias("hard"), *(u(f"f{s}").alias(f"f{s}") for s in "ab"))
    flip = lambda s: F.when(F.col(f"f{s}") < F.when(F.col("hard"), 0.5).otherwise(F.col("error")), 1 - F.col(s)).otherwise(F.col(s))
    judged = truth.select("error", "id", "a", "b", flip("a").alias("ja"), flip("b").alias("jb"))
    return judged.withColumn("pair", (F.col("a") != F.col("b")).cast("int")).withColumn("judged_pair", (F.col("ja") != F.col("jb")).cast("int"))


def power(df: DataFrame, auc: str, pos: str, neg: str, target: float = 0.15) -> DataFrame:
    """Adds half_width of the Hanley-McNeil interval and the positives needed for `target` at the same ratio (by the square of the widths)."""
    from ..functions.stats import hanley_mcneil

    se, _, _ = hanley_mcneil(F.col(auc), F.col(pos), F.col(neg))
    half = 1.96 * se
    return df.withColumn("half_width", half).withColumn("pos_needed", F.ceil(F.col(pos) * (half / target) * (half / target)))
