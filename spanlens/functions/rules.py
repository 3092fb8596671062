"""Predicates that make labels: golds, numbers, medians, disagreement, reasons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import body, strip
from .vocabulary import REFUSAL_OPENINGS, THINKING_OPENINGS


def quoted(c: Column) -> Column:
    """The text as a pattern that matches itself."""
    return F.regexp_replace(c, r"([\\.\[\](){}*+?^$|])", r"\\$1")


def gold_offset(text: Column | str, gold: Column | str) -> Column:
    """Characters before the first place where the answer stands between word boundaries, case aside; null if nowhere or empty."""
    g = F.lower(strip(body(gold)))
    at = F.regexp_instr(F.lower(body(text)), F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quoted(g), F.lit(r"(?![\p{L}\p{N}_])")))
    return F.when((g != "") & (at > 0), at - 1)


def has_number(text: Column | str, number: Column | str) -> Column:
    """The number, separators and trailing zeros aside, stands in the text and not inside a longer one."""
    n = F.regexp_replace(F.replace(strip(body(number)), F.lit(","), F.lit("")), r"(\.\d*?)0+$", "$1")
    n = F.regexp_replace(n, r"\.$", "")
    t = F.replace(body(text), F.lit(","), F.lit(""))
    return (n != "") & F.regexp_like(t, F.concat(F.lit(r"(?<![\d.])"), quoted(n), F.lit(r"(?:\.0+)?(?![\d]|\.\d)")))


def above_median(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds above: 1 if the value exceeds the exact median of its group. The median is an aggregate joined back."""
    m = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("__m"))
    joined = df.join(m, list(keys)) if keys else df.crossJoin(F.broadcast(m))  # without keys one row
    return joined.withColumn("above", (F.col(value) > F.col("__m")).cast("int")).drop("__m")


def long_sides(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds long_a and long_b: longer than the median length of both sides pooled."""
    lengths = df.select(F.explode(F.array(F.length(body(a)), F.length(body(b)))).alias("n")).agg(F.percentile("n", F.lit(0.5)).alias("__m"))
    return df.crossJoin(F.broadcast(lengths)).withColumn("long_a", F.length(body(a)) > F.col("__m")).withColumn("long_b", F.length(body(b)) > F.col("__m")).drop("__m")


def disagree(a: Column, b: Column) -> Column:
    """1 where two labels differ; null with a null."""
    return (a != b).cast("int")


def threshold_disagree(a: Column, b: Column, cut: float = 0.7) -> Column:
    return ((a >= cut) != (b >= cut)).cast("int")


def any_disagree(raters: Sequence[Column]) -> Column:
    """1 where not all raters agree."""
    values = [r.cast("int") for r in raters]
    return (F.greatest(*values) != F.least(*values)).cast("int")


def joint_states(a: Column, b: Column) -> dict[str, Column]:
    a, b = a.cast("boolean"), b.cast("boolean")
    return {"both": a & b, "neither": ~a & ~b, "only_a": a & ~b, "only_b": ~a & b}


def opening_family(text: Column | str) -> Column:
    t = body(text)
    starts = lambda ps: reduce(lambda x, y: x | y, (F.regexp_like(t, F.lit(rf"(?i)^\s*(?:{p})")) for p in ps))
    return F.when(starts(THINKING_OPENINGS), "thinking").when(starts(REFUSAL_OPENINGS), "direct_refusal").otherwise("other")


# Fixed value: words of a change of mind, case ignored.
BACKTRACK = r"(?i)\b(wait|hmm|actually|oops|let me try|on second thought|that'?s not right|i made a mistake|scratch that)\b"


def backtracks(text: Column | str) -> Column:
    return F.regexp_like(body(text), F.lit(BACKTRACK))


def has_box(text: Column | str) -> Column:
    return F.regexp_like(body(text), F.lit(r"\\boxed\s*\{"))


def comparable(prompt_a: Column, prompt_b: Column, final_a: Column, final_b: Column) -> Column:
    """Equal prompts, and neither final answer blank."""
    return F.coalesce(prompt_a == prompt_b, F.lit(False)) & (strip(body(final_a)) != "") & (strip(body(final_b)) != "")


def arithmetic_density(text: Column | str) -> Column:
    """Share of digits and operators among the characters; 0 for an empty text."""
    t = body(text)
    return F.when(F.length(t) > 0, F.length(F.regexp_replace(t, r"[^0-9+\-*/=^]", "")) / F.length(t)).otherwise(F.lit(0.0))


def screen_reason(*steps: tuple[Column, str]) -> Column:
    """The reason of the first exclusion that holds, else `included`."""
    out = F.when(F.coalesce(steps[0][0], F.lit(False)), steps[0][1])
    for when, why in steps[1:]:
        out = out.when(F.coalesce(when, F.lit(False)), why)
    return out.otherwise("included")


def whole_numbers(models: Sequence[str]) -> Column:
    """No model's score has a fraction."""
    return ~F.exists(F.array(*(F.col(f"`{m}`").cast("double") for m in models)), lambda x: x % 1 != 0)


def prefix_score(values: Column, k: Column, how: str = "product") -> Column:
    """Product, mean, least or last of the first k step values."""
    head = F.slice(values, F.lit(1), k)
    if how == "product":
        return F.aggregate(head, F.lit(1.0), lambda acc, v: acc * v)
    if how == "mean":
        return F.aggregate(head, F.lit(0.0), lambda acc, v: acc + v) / F.size(head)
    if how == "min":
        return F.array_min(head)
    if how == "last":
        return F.try_element_at(head, F.lit(-1))
    raise ValueError(f"product, mean, min or last, not {how}")


def ensemble(scores: Sequence[Column]) -> dict[str, Column]:
    return {"mean": sum(scores[1:], scores[0]) / len(scores), "min": F.least(*scores), "max": F.greatest(*scores)}
