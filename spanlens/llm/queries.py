"""The registered query of each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontam, license_scan, lm_scoring, ngram_join, periodic, quality, secret_scan, token_counts, toxicity, vector_codes
from .common import read, text_or_empty

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["rank"] < len(secret_scan.BASE))

    def number(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("secrets")).alias("spans"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.withColumn("log_score", F.round("log_score", 6))  # sums of logarithms differ in their last places by order


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _lm_oracle() -> str:
    """Counts of words and pairs over all rows less a row's own; a sum of logarithms by row."""
    return (
        f"WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS ws FROM documents), t AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d), "
        "b AS (SELECT id, i, w, lag(w) OVER (PARTITION BY id ORDER BY i) AS v FROM t), u AS (SELECT w, count(*) AS c FROM t GROUP BY w), ou AS (SELECT id, w, count(*) AS c FROM t GROUP BY ALL), "
        "p AS (SELECT v, w, count(*) AS c FROM b WHERE v IS NOT NULL GROUP BY ALL), op AS (SELECT id, v, w, count(*) AS c FROM b WHERE v IS NOT NULL GROUP BY ALL), n AS (SELECT count(*) AS n FROM t), z AS (SELECT id, count(*) AS m FROM t GROUP BY id), "
        "x AS (SELECT b.id AS id, b.v IS NOT NULL AS second, coalesce(p.c - op.c, 0) AS two, uv.c - ov.c AS one_v, u.c - ou.c AS one_w, greatest(n.n - z.m, 1) AS rest FROM b JOIN z ON z.id = b.id CROSS JOIN n JOIN u ON u.w = b.w JOIN ou ON ou.id = b.id AND ou.w = b.w "
        "LEFT JOIN u uv ON uv.w = b.v LEFT JOIN ou ov ON ov.id = b.id AND ov.w = b.v LEFT JOIN p ON p.v = b.v AND p.w = b.w LEFT JOIN op ON op.id = b.id AND op.v = b.v AND op.w = b.w), "
        "s AS (SELECT id, sum(CASE WHEN two > 0 THEN ln(two / CAST(one_v AS DOUBLE)) ELSE CASE WHEN second THEN ln(0.4) ELSE 0 END + ln(CASE WHEN one_w > 0 THEN one_w ELSE 0.4 END / CAST(rest AS DOUBLE)) END) AS score, count(*) FILTER (second AND two <= 0) AS back FROM x GROUP BY id) "
        "SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(score, 6) AS log_score, coalesce(back, 0) AS n_backoff FROM d LEFT JOIN s ON s.id = d.id"
    )


def _contamination_oracle() -> str:
    """Windows of items as texts, met by equally long runs of each document's words."""
    return (
        f"WITH it AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS ws FROM benchmark), st AS (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, CASE WHEN len(ws) > 0 THEN 1 ELSE 0 END) + 1)) AS k FROM it), "
        "wi AS (SELECT DISTINCT item, least(len(ws), 13) AS n, array_to_string(ws[k:k + 12], ' ') AS win FROM st), "
        f"d AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS ws FROM documents), r AS (SELECT id, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM d, (SELECT DISTINCT n FROM wi)), "
        "h AS (SELECT r.id AS id, r.i AS i, r.n AS n, wi.item AS item FROM r JOIN wi ON wi.n = r.n AND wi.win = array_to_string(r.ws[r.i:r.i + r.n - 1], ' ')), "
        "c AS (SELECT id, count(DISTINCT at_) AS hit FROM (SELECT id, unnest(range(i, i + n)) AS at_ FROM h) GROUP BY id), m AS (SELECT id, count(*) AS items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT id, item FROM h) GROUP BY id) "
        "SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(hit, 0) AS n_hit, coalesce(items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(hit, 0) > 0 AND 20 * coalesce(hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN c ON c.id = d.id LEFT JOIN m ON m.id = d.id"
    )


def _secret_oracle() -> str:
    """Matches by regexp_extract_all, their places by the lengths of what lies between."""
    each = []
    for rank, r in enumerate(secret_scan.BASE + secret_scan.MORE):
        p = r.regex.replace("'", "''")
        value = f"length(regexp_extract(m[i], '{p}', {r.group})) >= {r.least}"
        each.append(
            f"SELECT id, doc_id, {rank} AS rank, '{r.kind}' AS kind, "
            f"unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: "
            f"{{'s': list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0), 'n': length(m[i]), 'ok': {value}}}), lambda q: q.ok)) AS q "
            f"FROM (SELECT id, doc_id, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS b FROM d)"
        )
    one = "string_agg(kind || ':' || CAST(q.s AS BIGINT) || ':' || CAST(q.s + q.n AS BIGINT), ',' ORDER BY q.s, rank)"
    base = f"rank < {len(secret_scan.BASE)}"
    return (
        "WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents), "
        "f AS (" + " UNION ALL ".join(each) + "), "
        "g AS (SELECT id, " + ", ".join(f"count(*) FILTER (kind = '{k.kind}') AS n_{k.kind}" for k in secret_scan.BASE) + f", {one} FILTER ({base}) AS base, {one} AS spans FROM f GROUP BY id) "
        "SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (id)"
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), BPE_RANKS, public_tokenizers.PATTERN, with_ids=False)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.turns(read(spark, sf_dir, "conversations"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.train(docs)).select("doc_id", "weak_label", "score", "good")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.hits(docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontam.contaminated().alias("contaminated"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), PIECE_MODEL)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("places", lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        license_scan.labels("places").alias("base_labels"),
        license_scan.labels("places", "spans").alias("labels"),
        "score",
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(read(spark, sf_dir, "embeddings")).drop("label")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = periodic.runs(docs.select("doc_id", periodic.repeated_tail(text_or_empty(), F.col("doc_id")).alias("text")))
    best = found.withColumn("best", periodic.strongest())
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _codes_oracle(rounds: int = 6) -> str:
    """Each round as two tables: nearest entries, and entries at floored means. DuckDB divides towards 0, so the remainder is made positive first."""
    far = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT p.id AS id, p.part AS part, min({far} * 16 + c.e) AS m FROM p JOIN c{r} c ON c.part = p.part GROUP BY ALL)")
        if r < rounds:
            steps.append(
                f"s{r} AS (SELECT p.part AS part, a.m % 16 AS e, j, CAST(sum(p.x[j]) AS BIGINT) AS s, count(*) AS n FROM p JOIN a{r} a ON a.id = p.id AND a.part = p.part CROSS JOIN (SELECT unnest(range(1, w + 1)) AS j FROM w) GROUP BY ALL), "
                f"m{r} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM s{r} GROUP BY part, e), "
                f"c{r + 1} AS MATERIALIZED (SELECT c.part AS part, c.e AS e, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.part = c.part AND m.e = c.e)"
            )
    return (
        "WITH k AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, label, embedding, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
        "w AS (SELECT max(len(v)) // 8 AS w FROM k), p AS MATERIALIZED (SELECT id, part, v[part * w + 1:part * w + w] AS x FROM k, w, (SELECT unnest(range(8)) AS part)), "
        "f AS (SELECT id, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS e FROM k ORDER BY vec_id, embedding LIMIT 16), c0 AS MATERIALIZED (SELECT part, e, x FROM p JOIN f ON f.id = p.id), "
        + ", ".join(steps)
        + f", o AS (SELECT id, string_agg(printf('%02x', m % 16), '' ORDER BY part) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a{rounds} GROUP BY id), "
        f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS books FROM c{rounds}) "
        "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, books AS codebooks_sha256 FROM o JOIN k ON k.id = o.id CROSS JOIN h"
    )


def _runs_oracle() -> str:
    """Equal words q apart as stretches of places; a stretch whose period a divisor's stretch covers has a smaller period. The checksum goes bit by bit: a byte, then seven zeros."""
    space = r"[^\x20\x09-\x0D]+"
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295, {bits}), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))))"
    return (
        f"WITH t AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '{space}') AS ws, {crc} AS h FROM documents), "
        "g AS (SELECT id, doc_id, ws, len(ws) AS n, coalesce(h % 10 = 0, false) AND len(ws) > 0 AS dealt, (h // 10) % greatest(len(ws), 1) AS a, (h // 10) % 8 AS e FROM t), "
        "d AS MATERIALIZED (SELECT id, doc_id, n, CASE WHEN dealt THEN list_concat(ws[1:a], list_transform(range(0, n - a), lambda i: ws[a + 1 + i % (1 + (n - a) // (3 + e))])) ELSE ws END AS ws FROM g), "
        "x AS MATERIALIZED (SELECT id, n, unnest(range(n)) AS i, unnest(ws) AS w FROM d), m AS (SELECT x.id AS id, x.i AS i, y.i - x.i AS q FROM x JOIN x y ON y.id = x.id AND y.w = x.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n), "
        "s AS MATERIALIZED (SELECT id, q, min(i) AS s, count(*) + q AS l FROM (SELECT id, q, i, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS o FROM m) GROUP BY id, q, o HAVING count(*) + q >= greatest(6, 4 * q)), "
        "r AS MATERIALIZED (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.id = s.id AND b.q < s.q AND s.q % b.q = 0 AND b.s <= s.s AND b.s + b.l >= s.s + s.l)), "
        "o AS (SELECT id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM r GROUP BY id), "
        "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CAST(l AS DECIMAL(18, 0)) / q DESC, s, q) AS k FROM r) WHERE k = 1), "
        "c AS (SELECT id, string_agg(w, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id = x.id AND x.i >= r.s + r.q AND x.i < r.s + r.l) GROUP BY id) "
        "SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period, 1000 * b.l // b.q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 "
        "FROM d LEFT JOIN o ON o.id = d.id LEFT JOIN b ON b.id = d.id LEFT JOIN c ON c.id = d.id"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_chat_turns": op5_chat_turns,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_nearest": op10_nearest,
    "op11_license_scan": op11_license_scan,
    "op12_vector_codes": op12_vector_codes,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op1_secret_scan": _secret_oracle(), "op2_lm_scoring": _lm_oracle(), "op7_decontamination": _contamination_oracle(), "op12_vector_codes": _codes_oracle(), "op13_periodic_runs": _runs_oracle()}
