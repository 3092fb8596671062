"""The driver's tables as contracts, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import table


def r9(c: Column) -> Column:
    """Doubles to nine decimals, so that summation order does not show."""
    return F.round(c.cast("double"), 9)


def pairs(spark: SparkSession, sf_dir: str, span: int = 50, mark: str = "!") -> DataFrame:
    """One row for each labelled document: score s (spaces in 200 characters), the mark inside the span (z), after it (z_comp) and anywhere (z_ext), toxic (y), quality (q)."""
    t = tx.body("text")
    has = lambda c: F.contains(c, F.lit(mark)).cast("int")
    head = tx.prefix(t, 200)
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"), "lang", "source", F.col("toxic").alias("y"), F.col("quality").alias("q"),
        (F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))).alias("s"),
        has(tx.prefix(t, span)).alias("z"), has(tx.complement(t, span)).alias("z_comp"), has(t).alias("z_ext"), F.length(t).alias("len"),
    )


def pairs_sql(span: int = 50, mark: str = "!") -> str:
    t = "coalesce(d.text, '')"
    return f"""pair AS (SELECT CAST(doc_id AS VARCHAR) AS id, d.lang AS lang, d.source AS source, l.toxic AS y, l.quality AS q,
        length(substring({t}, 1, 200)) - length(replace(substring({t}, 1, 200), ' ', '')) AS s,
        CAST(contains(substring({t}, 1, {span}), '{mark}') AS INT) AS z, CAST(contains(substring({t}, {span + 1}), '{mark}') AS INT) AS z_comp,
        CAST(contains({t}, '{mark}') AS INT) AS z_ext, length({t}) AS len
        FROM documents d JOIN labels l USING (doc_id))"""


def auc_sql(src: str, s: str, y: str, g: str = "") -> str:
    """(g, n, n_pos, auc) of a source."""
    first = f"{g}, " if g else ""
    by = f"PARTITION BY {g} " if g else ""
    return f"""(SELECT {first}count(*) AS n, CAST(coalesce(sum(y_), 0) AS BIGINT) AS n_pos,
        CASE WHEN sum(y_) > 0 AND sum(1 - y_) > 0 THEN (sum(CASE WHEN y_ = 1 THEN rk END) - sum(y_) * (sum(y_) + 1) / CAST(2 AS DOUBLE)) / (CAST(sum(y_) AS DOUBLE) * sum(1 - y_)) END AS auc
        FROM (SELECT {first}CAST({y} AS INT) AS y_, rank() OVER ({by}ORDER BY {s}) + (count(*) OVER (PARTITION BY {first}{s}) - 1) / CAST(2 AS DOUBLE) AS rk
              FROM {src} WHERE {s} IS NOT NULL AND {y} IS NOT NULL) {f'GROUP BY {g}' if g else ''})"""


def kappa_sql(a: str, b: str) -> str:
    """Aggregate expression."""
    pa, pb = f"avg(CAST({a} AS DOUBLE))", f"avg(CAST({b} AS DOUBLE))"
    pe = f"({pa} * {pb} + (1 - {pa}) * (1 - {pb}))"
    return f"CASE WHEN {pe} < 1 THEN (avg(CASE WHEN {a} = {b} THEN 1.0 ELSE 0.0 END) - {pe}) / (1 - {pe}) END"


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair, a, b: each user turn and the assistant's turn after it."""
    c = table(spark, sf_dir, "conversations")
    a = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("a"))
    b = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return a.join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair"), tx.body("a").alias("a"), tx.body("b").alias("b"))


TURNS_SQL = """tp AS (SELECT x.conv_id * 1000 + x.turn AS pair, coalesce(x.text, '') AS a, coalesce(w.text, '') AS b
    FROM conversations x JOIN conversations w ON x.conv_id = w.conv_id AND w.turn = x.turn + 1 WHERE x.role = 'user' AND w.role = 'assistant')"""
