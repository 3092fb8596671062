"""Records of one large JSON file, read by many tasks.

A JSON array on a line, or in a wrapper object, has no line ends to split at, so
Spark's multi-line reader gives the file to one task. Here it is read as text that
ends at `}`, which Spark's readers split anywhere. Whether a piece begins inside a
string follows from the parity of the quotes before it, and its depth from the
brackets before it outside of strings; both are sums, taken within a split and over
the splits of a file. A brace that brings the depth back to that of the array's
elements ends a record, and the pieces of a record meet again by its number.

A backslash never stands before a piece's end (`\\}` is no JSON), so no escape is
cut in two. Elements are objects. A wrapper may have other fields before and
after its array, which is the first one of that name. Bytes are UTF-8; compressed
files are read whole by one task, as everywhere in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kept

#: A character of a string, plain or escaped.
_CHAR = r'(?:[^"\\]|\\.)'


def _strip_escapes(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\.", "")


def _quotes(text: Column) -> Column:
    """Quotes that no backslash escapes."""
    bare = _strip_escapes(text)
    return F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))


def _outside(text: Column, inside: Column) -> Column:
    """What stands outside of strings, for a piece that begins inside one or not."""
    bare = _strip_escapes(text)
    rest = F.when(inside, F.regexp_replace(bare, r'(?s)^[^"]*(?:"|$)', "")).otherwise(bare)
    return F.regexp_replace(rest, r'(?s)"[^"]*(?:"|$)', "")


def _count(text: Column, marks: str) -> Column:
    return F.length(text) - F.length(F.translate(text, marks, ""))


def _raw(spark: SparkSession, path: str, opening: str | None = None) -> DataFrame:
    """file, block, place, text and counts of a piece, written once: how a file is split may differ between two readings."""
    raw = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("text"))
    text = F.col("text")
    level = lambda out: _count(out, "{[") - _count(out, "}]")
    return kept(raw.select("file", "block", "place", "text", _quotes(text).alias("quotes"), level(_outside(text, F.lit(False))).alias("__free"), level(_outside(text, F.lit(True))).alias("__held"), (text.rlike(opening) if opening else F.lit(False)).alias("opens")), "pieces")


def _marks(raw: DataFrame) -> DataFrame:
    """file, block, place, inside, depth, closes, opens (the piece has the opening): windows over the pieces' numbers, without their texts."""
    counted = raw.drop("text")
    # A row a split.
    own, before = W.partitionBy("file", "block").orderBy("place"), W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    per = counted.groupBy("file", "block").agg(F.sum("quotes").alias("__q"))
    per = per.select("file", "block", F.coalesce(F.sum("__q").over(before), F.lit(0)).alias("__before"))
    odd = counted.join(per, ["file", "block"]).withColumn("__so_far", F.col("__before") + F.coalesce(F.sum("quotes").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    known = odd.withColumn("inside", F.col("__so_far") % 2 == 1).withColumn("closes", (F.col("__so_far") + F.col("quotes")) % 2 == 0)
    turned = known.withColumn("__d", F.when(F.col("inside"), F.col("__held")).otherwise(F.col("__free")) - F.col("closes").cast("int"))
    sums = turned.groupBy("file", "block").agg(F.sum("__d").alias("__t")).select("file", "block", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"))
    depth = F.col("__base") + F.sum("__d").over(own.rowsBetween(W.unboundedPreceding, 0))
    return turned.join(sums, ["file", "block"]).select("file", "block", "place", "inside", depth.alias("depth"), "closes", "opens")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, place, text, inside, depth, closes: pieces in the order of the file, whether each begins inside a string, the depth at its end, and whether a brace outside of strings ends it."""
    raw = _raw(spark, path)
    return raw.select("file", "block", "place", "text").join(_marks(raw).drop("opens"), ["file", "block", "place"])


def records(spark: SparkSession, path: str, schema: str, wrapper: str | None = None) -> DataFrame:
    """The elements of a file's array, or of the array in field `wrapper`, by `schema`; a record that doesn't parse is an error.

    Texts are shuffled twice: to the numbers of their records, and to each other.
    """
    at = 1 if wrapper is None else 2
    raw = _raw(spark, path, None if wrapper is None else rf'"{wrapper}"\s*:\s*\[')
    p = kept(_marks(raw).withColumn("at", F.struct("block", "place")), "marks")
    ends = F.col("closes") & (F.col("depth") == at)
    if wrapper is not None:
        # Between the piece that opens the array and the one that leaves it; a row a file.
        opens = p.groupBy("file").agg(F.min(F.when(F.col("opens"), F.col("at"))).alias("__start"))
        p = p.join(opens, "file")
        stops = p.groupBy("file").agg(F.min(F.when((F.col("at") >= F.col("__start")) & (F.col("depth") < at), F.col("at"))).alias("__stop"))
        p = p.join(stops, "file")
        ends = ends & (F.col("at") >= F.col("__start")) & (F.col("__stop").isNull() | (F.col("at") < F.col("__stop")))
    p = p.withColumn("ends", F.coalesce(ends, F.lit(False)))
    own, before = W.partitionBy("file", "block").orderBy("place").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    per = p.groupBy("file", "block").agg(F.count_if("ends").alias("__n")).select("file", "block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))  # a row a split
    numbered = p.join(per, ["file", "block"]).withColumn("record", F.col("__first") + F.coalesce(F.sum(F.col("ends").cast("long")).over(own), F.lit(0)))
    numbered = raw.select("file", "block", "place", "text").join(kept(numbered.select("file", "block", "place", "record", "ends"), "numbers"), ["file", "block", "place"])
    whole = numbered.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "place", "text"))).alias("ps"), F.max("ends").alias("done")).filter("done")
    text = F.concat(F.array_join(F.transform("ps", lambda x: x["text"]), "}"), F.lit("}"))
    # The first record's text begins with what opens the array, any other with a comma.
    opening = r"(?s)^[^\[]*\[" if wrapper is None else rf'(?s)^.*?"{wrapper}"\s*:\s*\['
    head = F.when(F.col("record") == 0, F.regexp_replace(text, opening, "")).otherwise(text)
    one = F.regexp_replace(head, r"(?s)^[\s,]+", "")
    return whole.select(F.from_json(one, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
