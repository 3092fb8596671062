"""Queries of readers, writers and reports on record files, and of the joins between record tables.

Each source query writes small tables of the session's own to a scratch folder, reads them back and returns what was read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import audit, sources
from ..functions import text as tx
from ..operators import align, rank
from ..sources import table, wrapped
from .contracts import auc_sql, kappa_sql, pairs, pairs_sql, r9
from .registry import query

P = "WITH " + pairs_sql()


@query("SELECT kind, CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE n_name || ', \"quoted\"' || chr(10) || 'x' END AS text FROM nation, (VALUES ('jsonl'), ('json'), ('csv'), ('parquet'), ('orc')) AS v(kind)")
def record_files(spark: SparkSession, d: str) -> DataFrame:
    """The same records as JSON lines, a wrapped JSON file, CSV, Parquet and ORC, read back as traces: a null trace is empty."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.when(F.col("n_nationkey") % 4 != 0, F.concat("n_name", F.lit(', "quoted"\nx'))).alias("trace"))
    at = sources.scratch(spark, "record-files")
    sources.write_rows(rows, f"{at}/a.jsonl", "json")
    sources.write_rows(rows, f"{at}/a.csv", "csv", ["id", "trace"])
    sources.write_rows(rows, f"{at}/a.parquet", "parquet")
    rows.write.orc(f"{at}/a.orc")
    sources.write_wrapped(rows, f"{at}/a.json", "records")
    parts = [sources.traces(sources.read_rows(spark, f"{at}/a.{kind}", "id string, trace string" if kind == "jsonl" else None)).select(F.lit(kind).alias("kind"), "id", "text") for kind in ("jsonl", "json", "csv", "parquet", "orc")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


_SAID = "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal > 0 END AS label, CASE WHEN c_custkey % 11 = 0 THEN 'timeout' END AS error FROM customer"


@query(f"WITH j AS ({_SAID}) SELECT 'drop' AS policy, id, label FROM j WHERE label IS NOT NULL UNION ALL SELECT 'zero', id, coalesce(label, false) FROM j UNION ALL SELECT 'errors', id, label FROM j WHERE label IS NOT NULL AND error IS NULL")
def judge_null_policy(spark: SparkSession, d: str) -> DataFrame:
    """Judgements from JSON lines: null ones dropped, made false, or dropped with those that have an error."""
    c = F.col("c_custkey")
    rows = table(spark, d, "customer").select(c.cast("string").alias("id"), F.when(c % 7 != 0, F.col("c_acctbal") > 0).alias("refusal_judge"), F.when(c % 11 == 0, F.lit("timeout")).alias("error"))
    at = sources.scratch(spark, "judgements")
    sources.write_rows(rows, f"{at}/j.jsonl", "json")
    read = sources.read_rows(spark, f"{at}/j.jsonl", sources.JUDGEMENT)
    kept = {"drop": sources.judgements(read), "zero": sources.judgements(read, null_policy="zero"), "errors": sources.judgements(read, errors=True)}
    a, b, e = (t.select(F.lit(policy).alias("policy"), "id", "label") for policy, t in kept.items())
    return a.union(b).union(e)


@query("SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS prompt, 'region' AS stem FROM region UNION ALL SELECT CASE WHEN n_nationkey IN (SELECT r_regionkey FROM region) THEN 'nation_' ELSE '' END || CAST(n_nationkey AS VARCHAR), coalesce(CASE WHEN n_nationkey % 5 > 0 THEN n_name END, ''), 'nation' FROM nation")
def prompt_union(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of two wrapped files: an id of an earlier file gets its own file's stem in front."""
    at = sources.scratch(spark, "prompts")
    sources.write_wrapped(table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("prompt"), F.lit("x").alias("answer")), f"{at}/region.json", "prompts")
    sources.write_wrapped(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 5 > 0, F.col("n_name")).alias("prompt"), F.lit("y").alias("gold_answer")), f"{at}/nation.json", "prompts")
    files = [(stem, sources.prompts(sources.read_rows(spark, f"{at}/{stem}.json")).drop("answer")) for stem in ("region", "nation")]
    return align.union_prompts(files).select("id", "prompt", "stem")


@query("SELECT event_id, event_type FROM events WHERE event_id % 5 > 0")
def tolerant_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines of which every fifth is cut off and some are blank: bad ones are skipped."""
    k = F.col("event_id")
    line = F.to_json(F.struct("event_id", "event_type"))
    lines = table(spark, d, "events").select(F.when(k % 5 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value"), k).select(F.explode(F.when(k % 3 == 0, F.array("value", F.lit(""))).otherwise(F.array("value"))).alias("value"))
    at = sources.scratch(spark, "lines")
    lines.write.text(f"{at}/a.jsonl")
    return sources.read_rows(spark, f"{at}/a.jsonl", "event_id bigint, event_type string", tolerant=True)


@query("SELECT c_custkey, c_mktsegment AS split FROM customer WHERE c_mktsegment = 'BUILDING'")
def dataset_split(spark: SparkSession, d: str) -> DataFrame:
    """One split of a dataset folder: only its files are read."""
    at = sources.scratch(spark, "dataset")
    table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("split")).write.partitionBy("split").parquet(f"{at}/customers")
    return sources.dataset(spark, f"{at}/customers", "BUILDING").select("c_custkey", "split")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def parsed_group_cache(spark: SparkSession, d: str) -> DataFrame:
    """Groups parsed once and kept: the second call finds the inputs unchanged and reads what the first wrote."""
    at = sources.scratch(spark, "groups") + "/cache"
    groups = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    sources.cached(groups, at, [f"{d}/lineitem.parquet"])
    return sources.cached(groups.filter("false"), at, [f"{d}/lineitem.parquet"])


@query("SELECT version, l_returnflag AS flag, count(*) AS n FROM lineitem, (VALUES (1), (2)) AS v(version) WHERE version = 2 OR l_linenumber = 1 GROUP BY ALL")
def published_versions(spark: SparkSession, d: str) -> DataFrame:
    """A table published twice: a reader of the first version keeps it, and a new one sees the second, whatever a write that never reached its pointer left."""
    at = sources.scratch(spark, "published") + "/flags"
    lines = table(spark, d, "lineitem")
    counts = lambda t, v: t.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), "flag", "n")
    sources.publish(counts(lines.filter("l_linenumber = 1"), 1), at)
    early = sources.published(spark, at)
    sources.publish(counts(lines, 2), at)
    counts(lines.limit(1), 3).write.parquet(f"{at}/versions/unfinished")
    return early.union(sources.published(spark, at))


@query("SELECT doc_id, coalesce(text, '') AS text, n_chars AS chars FROM documents")
def wrapped_splits(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts in wrapped JSON files, one for each partition of the table, each read by as many tasks as it has splits."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(F.col("n_chars").alias("chars"), F.lit('a "}" in a string').alias("note")).alias("meta"))
    at = sources.scratch(spark, "wrapped") + "/a.json"
    sources.write_wrapped_parts(docs, at, "records", {"phase": "one {", "model": "m"})
    read = wrapped.records(spark, at, "doc_id bigint, text string, meta struct<chars bigint, note string>", "records")
    return read.select("doc_id", "text", F.col("meta.chars").alias("chars"))


@query("SELECT c_name AS name, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, '') AS segment FROM customer")
def public_fields(spark: SparkSession, d: str) -> DataFrame:
    """CSV of a fixed field list, nulls blank."""
    rows = table(spark, d, "customer").select(F.lit("secret").alias("hidden"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("segment"), F.col("c_name").alias("name"))
    at = sources.scratch(spark, "public")
    sources.write_rows(rows, f"{at}/a.csv", "csv", ["name", "segment"])
    read = spark.read.option("header", True).option("emptyValue", "").option("nullValue", "\u0000").csv(f"{at}/a.csv")
    return read.select("name", F.coalesce("segment", F.lit("")).alias("segment"))


@query("SELECT n_regionkey AS region, count(*) AS n, round(avg(s_acctbal), 3) AS mean FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey")
def report_files(spark: SparkSession, d: str) -> DataFrame:
    """A report of several rows written as one JSON document and read again."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = s.groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 3).alias("mean"))
    at = sources.scratch(spark, "report")
    sources.write_report(rows, f"{at}/report.json", {"title": "balances"})
    return sources.read_rows(spark, f"{at}/report.json").select(F.col("region").cast("int").alias("region"), "n", "mean")


_FMT = "CASE WHEN n_nationkey % 6 = 0 THEN '-' ELSE printf('%.3f', n_nationkey / 7.0::DOUBLE) END"


@query(f"SELECT n_nationkey, '| ' || n_name || ' | ' || {_FMT} || ' |' AS markdown, n_name || ' & ' || {_FMT} || ' \\\\' AS latex FROM nation")
def report_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of Markdown and LaTeX tables: three decimals, a dash for nulls."""
    t = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 6 != 0, F.col("n_nationkey") / F.lit(7.0)).alias("value"))
    return t.select("n_nationkey", sources.markdown_row("name", F.col("value")).alias("markdown"), sources.latex_row("name", F.col("value")).alias("latex"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey ORDER BY min(l_orderkey * 10 + l_linenumber) LIMIT 40)")
def first_groups(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the first 40 orders in file order, which is the feature."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("p"))
    return sources.first_groups(rows, "l_orderkey", "p", 40).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders ORDER BY CAST(('0x' || substring(md5('0-' || CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT), o_orderkey LIMIT 100")
def fixed_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred rows that a hash picks, which is the feature."""
    return sources.fixed_sample(table(spark, d, "orders"), "o_orderkey", 100).select("o_orderkey")


@query(f"{P} SELECT p.id AS id, p.lang AS lang, p.y AS y, p.z AS z FROM pair p WHERE p.len > 0 AND (p.q = 1 OR p.y = 0) AND (p.z = 1 OR p.z_ext = 1)")
def six_way_join(spark: SparkSession, d: str) -> DataFrame:
    """Records, two judges and prompts of two sides by id, filtered after the join."""
    p = pairs(spark, d)
    tables = [p.select("id", *c) for c in (["lang"], ["y"], ["q"], ["z"], ["z_ext"], ["len"])]
    return align.inner(tables, "id", must=False).filter("len > 0 AND (q = 1 OR y = 0) AND (z = 1 OR z_ext = 1)").select("id", "lang", "y", "z")


@query("SELECT o_orderkey, coalesce(c_name, '') AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def lookup_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    return align.lookup(table(spark, d, "orders"), c, "o_custkey", {"name": ""}).select("o_orderkey", "name")


_STYLE = "CASE WHEN turn % 2 = 0 THEN 'base' ELSE 'other' END"


@query(
    f"WITH j AS (SELECT conv_id AS q, {_STYLE} AS style, text AS response, CASE WHEN turn < 6 THEN turn % 3 = 0 END AS label FROM conversations), pr AS (SELECT conv_id AS q, {_STYLE} AS style, min(text) AS prompt FROM conversations WHERE role = 'user' AND conv_id % 4 > 0 GROUP BY ALL), "
    "t AS (SELECT CASE WHEN prompt IS NULL THEN 'no_prompt' WHEN coalesce(response, '') = '' THEN 'no_response' WHEN label IS NULL THEN 'bad_label' ELSE 'kept' END AS status FROM j LEFT JOIN pr USING (q, style)) SELECT status, count(*) AS n FROM t GROUP BY status"
)
def composite_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Judgements by question and style against prompts: how many are kept, and for what the others are skipped."""
    style = F.when(F.col("turn") % 2 == 0, "base").otherwise("other")
    c = table(spark, d, "conversations").withColumn("style", style)
    j = c.select(F.col("conv_id").alias("q"), "style", F.col("text").alias("response"), F.when(F.col("turn") < 6, F.col("turn") % 3 == 0).alias("label"))
    prompts = c.filter("role = 'user' AND conv_id % 4 > 0").groupBy(F.col("conv_id").alias("q"), "style").agg(F.min("text").alias("prompt"))
    reasons = [(F.col("prompt").isNull(), "no_prompt"), (F.coalesce("response", F.lit("")) == "", "no_response"), (F.col("label").isNull(), "bad_label")]
    return align.join_with_reasons(j, prompts, ["q", "style"], reasons).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, s.s_suppkey AS s_suppkey FROM part JOIN (SELECT s_suppkey, 'Brand' || CAST(10 + s_suppkey % 30 AS VARCHAR) AS b FROM supplier) s ON regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') = regexp_replace(lower(b), '[^a-z0-9]', '', 'g')")
def normalised_text_join(spark: SparkSession, d: str) -> DataFrame:
    """Brands written in two ways, joined on their letters and digits."""
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("BRAND "), (10 + F.col("s_suppkey") % 30).cast("string")).alias("b"))
    return align.join_on(table(spark, d, "part").select("p_partkey", "p_brand"), s, tx.plain("p_brand"), tx.plain("b")).select("p_partkey", "s_suppkey")


@query("SELECT c_custkey, n_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey")
def trimmed_text_join(spark: SparkSession, d: str) -> DataFrame:
    """Prompts with white space around them, joined to their category."""
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit(" \n"), "n_name", F.lit("\t")).alias("prompt")), "c_nationkey")
    return align.join_on(c.select("c_custkey", "prompt"), n.select("n_nationkey", "n_name"), tx.strip("prompt"), tx.strip("n_name")).select("c_custkey", "n_nationkey")


@query("WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS r FROM lineitem) SELECT a.l_orderkey AS l_orderkey, a.l_quantity AS qa, b.l_quantity AS qb, CASE WHEN a.l_quantity >= b.l_quantity THEN 'A is better' ELSE 'B is better' END AS verdict FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.r = 1 AND b.r = 2")
def keyed_pair_explode(spark: SparkSession, d: str) -> DataFrame:
    """A JSON map "A,B" -> verdict, with the two candidates looked up in an array."""
    item = F.struct("l_linenumber", "l_quantity")
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("x")).filter(F.size("x") > 1)
    named = F.transform("x", lambda v, i: F.struct(F.concat(F.lit("m"), i).alias("model"), v["l_quantity"].alias("q")))
    verdict = F.when(F.col("x")[0]["l_quantity"] >= F.col("x")[1]["l_quantity"], "A is better").otherwise("B is better")
    rows = t.select("l_orderkey", named.alias("candidates"), F.concat(F.lit('{"m0,m1": "'), verdict, F.lit('"}')).alias("results"))
    return align.keyed_pairs(rows, "l_orderkey", "results", "candidates").select("l_orderkey", F.col("a.q").alias("qa"), F.col("b.q").alias("qb"), "verdict")


@query("SELECT o_orderstatus AS side, o_orderpriority AS status, count(*) AS n, count(*) FILTER (o_orderkey % 9 = 0) AS empty, count(*) FILTER (o_orderkey % 10 = 0) AS errors FROM orders GROUP BY ALL")
def side_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = table(spark, d, "orders").select(F.col("o_orderstatus").alias("side"), F.col("o_orderpriority").alias("status"), F.when(k % 9 == 0, F.lit("  ")).otherwise("text").alias("text"), F.when(k % 10 == 0, F.lit("e")).when(k % 3 == 0, F.lit("")).alias("error"))
    return rank.side_summary(t, "side", "text", "status", "error")


_AP = "(SELECT CASE WHEN sum(p) > 0 THEN sum(p * cp / CAST(cn AS DOUBLE)) / sum(p) END AS ap FROM (SELECT n, p, sum(n) OVER w AS cn, sum(p) OVER w AS cp FROM (SELECT m, count(*) AS n, sum({y}) AS p FROM a GROUP BY m) WINDOW w AS (ORDER BY m DESC)))"


@query(
    f"{P}, a AS (SELECT id, -s AS m, CAST(z <> z_comp AS INT) AS sf, CAST(y <> q AS INT) AS sm, z, z_comp, y, q FROM pair), k AS (SELECT {kappa_sql('sf', 'sm')} AS kp, {kappa_sql('z', 'y')} AS ka, {kappa_sql('z_comp', 'q')} AS kb, count(*) AS n, sum(sm) AS p FROM a), "
    f"v AS (SELECT k.*, x.auc AS xs, y.auc AS ys, ps.ap AS ps, pm.ap AS pm FROM k, {auc_sql('a', 'm', 'sf')} x, {auc_sql('a', 'm', 'sm')} y, {_AP.format(y='sf')} ps, {_AP.format(y='sm')} pm), b AS (SELECT DISTINCT unnest([10, CAST(round_even(0.05 * n, 0) AS BIGINT), p]) AS b FROM k), r AS (SELECT *, row_number() OVER (ORDER BY m DESC, id) AS rk FROM a) "
    "SELECT b AS budget, count(*) AS routed, CAST(sum(sm) AS BIGINT) AS n_semantic, CAST(sum(sf) AS BIGINT) AS n_surface, count(*) FILTER (y = 1 AND q = 1) AS n_both, count(*) FILTER (y = 0 AND q = 0) AS n_neither, round(avg(m), 9) AS mean_metric, round(max(xs), 9) AS auc_surface, round(max(ys), 9) AS auc_semantic, round(max(ps - pm), 9) AS ap_gap, round(max(kp), 9) AS kappa_pair, round(max(CASE WHEN ka IS NULL THEN kb WHEN kb IS NULL THEN ka ELSE (ka + kb) / 2 END), 9) AS kappa_sides, "
    "max(CASE WHEN xs - ys >= 0.15 AND coalesce(CASE WHEN ka IS NULL THEN kb WHEN kb IS NULL THEN ka ELSE (ka + kb) / 2 END, kp) <= 0.2 THEN 'FAIL' WHEN xs - ys >= 0.1 OR ps - pm >= 0.1 THEN 'WARN' ELSE 'PASS' END) AS status FROM r, b, v WHERE rk <= b GROUP BY b"
)
def audit_files(spark: SparkSession, d: str) -> DataFrame:
    """The whole audit from four files of different kinds and field names to its report, read back."""
    p = pairs(spark, d)
    at = sources.scratch(spark, "audit-files")
    word = lambda c, yes, no: F.when(F.col(c) == 1, yes).otherwise(no)
    sources.write_rows(p.select("id", F.lit("x").alias("output")), f"{at}/outputs.jsonl", "json")
    sources.write_rows(p.select("id", word("z", "Yes", "no").alias("label_a"), word("z_comp", "refusal", "comply").alias("label_b")), f"{at}/surface.csv", "csv")
    sources.write_wrapped_parts(p.select("id", F.col("y").alias("semantic_a"), (F.col("q") == 1).alias("semantic_b")), f"{at}/semantic.json", "records")
    sources.write_rows(p.select("id", F.col("s").cast("double").alias("distance")), f"{at}/scores.parquet", "parquet")
    audit.audit(spark, f"{at}/outputs.jsonl", f"{at}/surface.csv", f"{at}/semantic.json", f"{at}/scores.parquet", f"{at}/report", lower=True)
    one, many = (sources.read_rows(spark, f"{at}/report/{part}.json") for part in ("summary", "routed"))
    shown = [r9(F.col(c)).alias(c) for c in ("auc_surface", "auc_semantic", "ap_gap", "kappa_pair", "kappa_sides")]
    both = many.drop("audit").crossJoin(F.broadcast(one.select(*shown, "status")))  # one row
    return both.select("budget", "routed", "n_semantic", "n_surface", "n_both", "n_neither", r9(F.col("mean_metric")).alias("mean_metric"), *(F.col(c) for c in ("auc_surface", "auc_semantic", "ap_gap", "kappa_pair", "kappa_sides")), "status")
