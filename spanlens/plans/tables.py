"""Queries of alignment: joins, explosions, set operations, samples, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..operators import agree, align, resample
from ..operators import verdict as vd
from ..sources import table
from .contracts import pairs, pairs_sql
from .registry import query

P = "WITH " + pairs_sql()


@query("WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_discount) AS r FROM lineitem) SELECT a.l_orderkey AS l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, CAST(a.l_extendedprice > b.l_extendedprice AS INT) AS first_dearer FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.r < b.r WHERE a.l_discount <> b.l_discount")
def pair_explode(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of an order's lines whose discounts differ: an order has at most a few lines."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_discount"))).alias("items"))
    p = align.pair_explode(items, "l_orderkey", "items", "l_discount")
    return p.select("l_orderkey", F.col("left.l_linenumber").alias("i"), F.col("right.l_linenumber").alias("j"), (F.col("left.l_extendedprice") > F.col("right.l_extendedprice")).cast("int").alias("first_dearer"))


@query(f"{P}, s AS (SELECT *, CASE WHEN y = 1 THEN 0 WHEN z_ext = 1 THEN 1 WHEN q = 0 THEN 2 ELSE 3 END AS stratum FROM pair), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY CAST(('0x' || substring(md5('k-' || id), 1, 8)) AS BIGINT), id) AS k FROM s) SELECT id, stratum FROM r WHERE k <= 15")
def stratified_sample_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """An item belongs to the first stratum it meets; of each the first 15 by hash, which is the feature."""
    from pyspark.sql import Window as W

    p = pairs(spark, d)
    strata = F.array(*(F.when(c, F.lit(i)) for i, c in enumerate([F.col("y") == 1, F.col("z_ext") == 1, F.col("q") == 0, F.lit(True)])))
    met = p.select("id", F.explode(F.array_compact(strata)).alias("stratum"))
    first = align.first_wins(met, "id", "stratum")
    w = W.partitionBy("stratum").orderBy(resample.draw_hash("k", F.col("id")), "id")
    return first.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= 15).select("id", "stratum")


@query(f"{P} SELECT id, CASE WHEN z_ext = y THEN z_ext ELSE 1 - q END AS resolved, CASE WHEN z_ext = y THEN 'agreed' ELSE 'adjudicated' END AS how FROM pair")
def two_rater_resolution(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return p.select("id", agree.resolve(F.col("z_ext"), F.col("y"), 1 - F.col("q")).alias("resolved"), F.when(F.col("z_ext") == F.col("y"), "agreed").otherwise("adjudicated").alias("how"))


@query("SELECT doc_id, coalesce(d.n_chars, -1) AS n_chars, l.toxic AS toxic FROM (SELECT doc_id, n_chars FROM documents WHERE lang <> 'en') d FULL OUTER JOIN (SELECT doc_id, toxic FROM labels) l USING (doc_id)")
def outer_join_coalesce(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").filter("lang <> 'en'").select("doc_id", "n_chars")
    b = table(spark, d, "labels").select("doc_id", "toxic")
    return align.outer_coalesce(a, b, "doc_id").select("doc_id", F.coalesce("n_chars", F.lit(-1)).alias("n_chars"), "toxic")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return align.resume(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def subset_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source, lang")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type FROM events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type")


@query("SELECT count(*) AS n, round(avg(greatest(l_quantity / 50, l_discount * 10, l_tax * 12)), 9) AS oracle FROM lineitem")
def row_oracle(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_tax") * 12).alias("c"))
    return align.row_oracle(t, ["a", "b", "c"]).withColumn("oracle", F.round("oracle", 9))


@query("SELECT l_orderkey, l_linenumber, unnest(['quantity', 'discount']) AS model, CAST(unnest([l_quantity, l_discount]) AS DOUBLE) AS score, unnest([l_returnflag, l_linestatus]) AS response FROM lineitem")
def unpivot_models(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("k"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("quantity|model_response"), F.col("l_discount").alias("discount"), F.col("l_linestatus").alias("discount|model_response"))
    return align.unpivot_models(t, "k", ["quantity", "discount"]).select("k.*", "model", "score", "response")


@query("WITH c AS (SELECT c_nationkey, c_custkey, CASE WHEN c_acctbal > 0 THEN 'REFUSAL' ELSE 'COMPLIANCE' END AS a FROM customer), o AS (SELECT o_custkey, CASE WHEN sum(o_totalprice) > 1000000 THEN 'REFUSAL' ELSE 'COMPLIANCE' END AS b FROM orders GROUP BY o_custkey) SELECT n_name, CASE WHEN b IS NULL THEN 'UNCLEAR' WHEN a = b THEN 'AGREEMENT' ELSE 'DISAGREEMENT' END AS decision, count(*) AS n FROM c JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON o_custkey = c_custkey GROUP BY ALL")
def pair_decision(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") > 0, "REFUSAL").otherwise("COMPLIANCE").alias("a"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.when(F.sum("o_totalprice") > 1_000_000, "REFUSAL").otherwise("COMPLIANCE").alias("b"))
    t = c.join(o, "c_custkey", "left").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return t.groupBy("n_name", vd.pair_decision(F.col("a"), F.col("b")).alias("decision")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) FILTER (value > 50 AND user_id % 2 = 1) AS n11, count(*) FILTER (value > 50 AND user_id % 2 = 0) AS n10, count(*) FILTER (NOT value > 50 AND user_id % 2 = 1) AS n01, count(*) FILTER (NOT value > 50 AND user_id % 2 = 0) AS n00 FROM events GROUP BY event_type")
def streaming_contingency(spark: SparkSession, d: str) -> DataFrame:
    """The running counts of a file stream, drained once into a table of the session."""
    import uuid

    events = table(spark, d, "events")
    # A stream reads folders; a table that is one file is picked out of its folder by name.
    one_file = all(f.endswith("/events.parquet") for f in events.inputFiles())
    reader = spark.readStream.schema(events.schema)
    stream = reader.option("pathGlobFilter", "events.parquet").parquet(d) if one_file else reader.parquet(f"{d}/events.parquet")
    rows = stream.select("event_type", (F.col("value") > 50).alias("z"), (F.col("user_id") % 2 == 1).alias("y"))
    name = f"contingency_{uuid.uuid4().hex[:8]}"
    q = streaming.contingency_counts(rows, ["event_type"], "z", "y").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def streaming_windows(spark: SparkSession, d: str) -> DataFrame:
    """Counts by hour and type of a file stream with a watermark, drained once into a table of the session."""
    from .. import sources

    events = table(spark, d, "events")
    at = sources.scratch(spark, "windows")
    events.select("ts", "event_type").write.parquet(f"{at}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{at}/in")
    counts = streaming.windowed_counts(stream, "ts", "1 hour", "1 hour", ["event_type"])
    q = counts.select(F.col("window.start").alias("hour"), "event_type", "n").writeStream.outputMode("complete").format("memory").queryName(f"w{at[-12:]}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(f"w{at[-12:]}")


@query("SELECT event_id, event_type, CASE WHEN event_id % 4 > 0 OR user_id % 2 = 0 THEN value > 50 END AS label FROM events")
def judged_batches(spark: SparkSession, d: str) -> DataFrame:
    """Events judged as three files come in, one of them twice; where a judgement failed a second run tries again."""
    from .. import sources

    events = table(spark, d, "events").select("event_id", "event_type", "user_id", "value")
    at = sources.scratch(spark, "judged")
    for k in (0, 1, 2, 1):
        events.filter(F.col("event_id") % 3 == k).write.mode("append").parquet(f"{at}/in")
    verdict = F.col("value") > 50
    for checkpoint, label in (("one", F.when(F.col("event_id") % 4 > 0, verdict)), ("two", F.when((F.col("event_id") % 4 > 0) | (F.col("user_id") % 2 == 0), verdict))):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 8).parquet(f"{at}/in")
        streaming.judge_once(stream, "event_id", f"{at}/out", f"{at}/{checkpoint}", lambda batch, label=label: batch.select("event_id", "event_type", label.alias("label"))).awaitTermination()
    return streaming.judged(spark, f"{at}/out", "event_id")
