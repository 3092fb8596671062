"""Aligning record tables by key: label parsing, key checks, joins, pair explosion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vocabulary import FALSE_WORDS, TRUE_WORDS

#: Rows of a frequent key that stand in a block of one side of a join; links of a task.
BLOCK, LINKS_A_TASK = 4096, 1 << 22


def parse_bool(c: Column | str, strict: bool = True) -> Column:
    """Word or number to boolean; unknown words and NaN raise, or are null if not strict. Null stays null."""
    t = F.lower(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")))
    number = F.try_to_number(t, F.lit("S9999999999D9999999999"))
    bad = F.raise_error(F.concat(F.lit("not a boolean label: "), t)).cast("boolean") if strict else F.lit(None).cast("boolean")
    return F.when(t.isNull(), F.lit(None).cast("boolean")).when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False).when(number.isNotNull(), number != 0).otherwise(bad)


def choose_field(df: DataFrame, names: Sequence[str]) -> str:
    """The first of the names that the table has."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {', '.join(names)} among {', '.join(df.columns)}")


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """Raises on a missing or repeated key when it is read."""
    n = F.count("*").over(W.partitionBy(key))
    missing = F.col(key).isNull() | (F.col(key).cast("string") == "")
    checked = F.when(missing, F.raise_error(F.lit(f"missing {key}"))).when(n > 1, F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string")))).otherwise(F.col(key))
    return df.withColumn("__n", n).withColumn(key, checked).drop("__n")


def keep_last(df: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key by position."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), position).alias("r")).select("r.*")


def inner(tables: Sequence[DataFrame], key: str, must: bool = True) -> DataFrame:
    """Inner join of all by the key as a string; no common key is an error if `must`."""
    out = reduce(lambda a, b: a.join(b, key), (t.withColumn(key, F.col(key).cast("string")) for t in tables))
    if must and out.isEmpty():
        raise ValueError(f"no common {key}")
    return out


def outer_coalesce(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer join; of columns that both have, a's value where it is there."""
    both = [c for c in a.columns if c in b.columns and c != key]
    renamed = b.withColumnsRenamed({c: f"__b_{c}" for c in both})
    j = a.join(renamed, key, "full_outer")
    return j.select(key, *(F.coalesce(c, f"__b_{c}").alias(c) if c in both else F.col(c) for c in a.columns if c != key), *(c for c in b.columns if c not in both and c != key))


def lookup(df: DataFrame, found: DataFrame, key: str, fallback: dict[str, object]) -> DataFrame:
    """Left join; what isn't found is the fallback's value."""
    return df.join(found, key, "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fallback.items()})


def join_on(a: DataFrame, b: DataFrame, left: Column, right: Column) -> DataFrame:
    """Inner join on an expression of either side, such as a text without its marks or white space; empty keys meet nothing.

    A frequent key is no hot one: its rows go by a hash to blocks of about BLOCK
    rows on either side, and each pair of blocks is a key of its own. There are as
    many tasks as the links need; their number is read ahead.
    """
    x, y = a.withColumn("__k", left).filter(F.col("__k") != ""), b.withColumn("__k", right).filter(F.col("__k") != "")
    n, m = (t.groupBy("__k").agg(F.count("*").alias(c)) for t, c in ((x, "__n"), (y, "__m")))
    met = n.join(m, "__k").select("__k", (F.col("__n") * F.col("__m")).alias("__links"), F.ceil(F.col("__n") / BLOCK).alias("__ni"), F.ceil(F.col("__m") / BLOCK).alias("__nj"))
    links = met.agg(F.sum("__links").alias("n")).first().n or 0
    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-links // LINKS_A_TASK))
    cut = met.filter((F.col("__ni") > 1) | (F.col("__nj") > 1)).select("__k", "__ni", "__nj")

    def dealt(t: DataFrame, own: str, other: str) -> DataFrame:
        """Rows in one block of their own side, once for each block of the other."""
        block = F.pmod(F.xxhash64(*(c for c, kind in t.dtypes if "map<" not in kind)), F.coalesce(f"__n{own}", F.lit(1)))
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(f"__n{other}", F.lit(1)) - 1))
        return t.join(cut, "__k", "left").withColumn(f"__{own}", block).withColumn(f"__{other}", others).drop("__ni", "__nj").repartition(tasks, "__k", "__i", "__j")

    return dealt(x, "i", "j").join(dealt(y, "j", "i"), ["__k", "__i", "__j"]).drop("__k", "__i", "__j")


def join_with_reasons(df: DataFrame, other: DataFrame, keys: Sequence[str], reasons: Sequence[tuple[Column, str]], kept: str = "kept") -> DataFrame:
    """Left join on a composite key with status: the first reason that holds, else `kept`; so skipped rows can be counted in the same pass."""
    status = F.lit(kept)
    for when, why in reversed(reasons):
        status = F.when(F.coalesce(when, F.lit(False)), why).otherwise(status)
    return df.join(other, list(keys), "left").withColumn("status", status)


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def union_prompts(tables: Sequence[tuple[str, DataFrame]], key: str = "id") -> DataFrame:
    """All rows; a key that occurs in an earlier file gets its own file's stem in front."""
    rows = reduce(DataFrame.unionByName, (t.withColumn("stem", F.lit(stem)).withColumn("file_no", F.lit(i)) for i, (stem, t) in enumerate(tables)))
    first = F.row_number().over(W.partitionBy(key).orderBy("file_no")) == 1
    return rows.withColumn("__first", first).withColumn(key, F.when(F.col("__first"), F.col(key).cast("string")).otherwise(F.concat_ws("_", "stem", key))).drop("__first", "file_no")


def first_wins(df: DataFrame, key: str, order: str, tie: str | None = None) -> DataFrame:
    """One row a key: that of least order."""
    by = F.struct(order, *([tie] if tie else []))
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), by).alias("r")).select("r.*")


def pair_explode(df: DataFrame, key: str, items: str, value: str) -> DataFrame:
    """key, i, j, left, right of each pair i < j of an array's items whose values differ."""
    a = df.select(key, items, F.posexplode(items).alias("i", "left"))
    b = a.select(key, "i", "left", F.posexplode(items).alias("j", "right"))
    return b.filter((F.col("i") < F.col("j")) & (F.col("left")[value] != F.col("right")[value]))


def keyed_pairs(df: DataFrame, key: str, results: str, candidates: str, name: str = "model") -> DataFrame:
    """key, a, b, verdict of a JSON map "A,B" -> verdict, with the two candidates looked up."""
    m = df.select(key, candidates, F.explode(F.from_json(results, "map<string,string>")).alias("pair", "verdict"))
    ab = F.split("pair", ",", 2)
    find = lambda who: F.try_element_at(F.filter(candidates, lambda c: c[name] == F.trim(who)), F.lit(1))
    return m.select(key, find(ab[0]).alias("a"), find(ab[1]).alias("b"), "verdict")


def unpivot_models(df: DataFrame, key: str, models: Sequence[str], suffix: str = "|model_response") -> DataFrame:
    """key, model, score, response of a wide table with columns <model> and <model>|model_response."""
    rows = F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"`{m}`").cast("double").alias("score"), F.col(f"`{m}{suffix}`").alias("response")) for m in models))
    return df.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def row_oracle(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """n, oracle: mean over rows of the best model's score."""
    best = F.greatest(*(F.col(f"`{m}`") for m in models)) if len(models) > 1 else F.col(f"`{models[0]}`")
    return df.agg(F.count("*").alias("n"), F.avg(best).alias("oracle"))
