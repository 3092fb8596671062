"""Queries of spans, rules, strips, parsers and text distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mathtext, rules
from ..functions import text as tx
from ..functions.vocabulary import CITED_OPENINGS, CUES, CUES_11, OPENINGS, RESTATED_OPENINGS, WIDE_CUES
from ..operators import distance
from ..shipping import ship
from ..sources import table
from .contracts import TURNS_SQL, r9, turn_pairs
from .registry import query

FOLDS = 5
_WORDS = ("sed", "the", "von", "que", "idiot")


@query("SELECT doc_id, CAST(coalesce(least(" + ", ".join(f"CASE WHEN strpos(lower(coalesce(text, '')), '{w}') > 0 THEN strpos(lower(coalesce(text, '')), '{w}') END" for w in _WORDS) + ") - 1, -1) AS INT) AS first_offset FROM documents")
def keyword_first_offset(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.first_offset("text", _WORDS).cast("int").alias("first_offset"))


@query("SELECT doc_id, " + " OR ".join(f"contains(lower(coalesce(text, '')), '{c.replace(chr(39), chr(39) * 2)}')" for c in CUES) + " AS cue FROM documents")
def keyword_rule(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.any_of("text").alias("cue"))


@query("SELECT doc_id, list_filter(['" + "', '".join(_WORDS) + "'], lambda k: contains(lower(coalesce(text, '')), k)) AS cues FROM documents")
def keyword_matches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.matched("text", _WORDS).alias("cues"))


@query("WITH s AS (SELECT lang, strpos(lower(coalesce(text, '')), lang) AS place FROM documents) SELECT lang, count(*) AS n, count(*) FILTER (place > 0) AS found, round(quantile_cont(place - 1, 0.5) FILTER (place > 0), 9) AS median_offset, count(*) FILTER (place BETWEEN 1 AND 50) AS within_50 FROM s GROUP BY lang")
def answer_arrival(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower(tx.body("text"))
    at = F.instr(t, F.col("lang"))
    rows = table(spark, d, "documents").select("lang", at.alias("at"))
    found = F.col("at") > 0
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(found).alias("found"), r9(F.percentile(F.when(found, F.col("at") - 1), F.lit(0.5))).alias("median_offset"), F.count_if(F.col("at").between(1, 50)).alias("within_50"))


def _strip_sql(text: str, passes: int, keep: str, source: str) -> str:
    """Each pass finds its own first pattern by a list search and takes that off, where the column expression has one regex."""
    quoted = ", ".join("'" + p.replace("'", "''") + "'" for p in OPENINGS)
    sql = f"SELECT {keep}, {text} AS t, 0 AS n FROM {source}"
    for _ in range(passes):
        found = f"SELECT *, list_filter([{quoted}], lambda p: regexp_matches(t, '(?i)^(?:' || p || ')'))[1] AS p FROM ({sql})"
        sql = f"SELECT {keep}, CASE WHEN p IS NULL THEN t ELSE regexp_replace(regexp_replace(t, '(?i)^(?:' || p || ')', ''), '^\\s+', '') END AS t, n + CAST(p IS NOT NULL AS INT) AS n FROM ({found})"
    return f"SELECT {keep}, t AS text, n AS stripped FROM ({sql})"


_SAID = ("Thinking Process: ", "Okay, let's see what this is\n\nThe user is asking for it.\n", "I cannot help with X. Sorry, but no. ", "I'm sorry, but I cannot do that. Thought\n\n1. **Analyze the Request:** ", "", "let me think\n" * 4 + "I cannot fulfill this request. I am sorry. ", "<think> <think>\n<think>I cannot answer. I cannot provide advice on it. Okay, let's go\nSorry, no. I'm sorry. ")
_SAID_SQL = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{x.replace(chr(39), chr(39) * 2)}'" for i, x in enumerate(_SAID)) + " END || coalesce(text, '')"


def _said() -> Column:
    out = F.lit("")
    for i, x in enumerate(_SAID):
        out = F.when(F.col("doc_id") % 7 == i, F.lit(x)).otherwise(out)
    return F.concat(out, tx.body("text"))


@query(_strip_sql(_SAID_SQL, 5, "doc_id", "documents"))
def opening_strip(spark: SparkSession, d: str) -> DataFrame:
    """All the reference's openings, five passes, on texts with none to many openings before them."""
    rest, n = tx.strip_openings(_said())
    return table(spark, d, "documents").select("doc_id", rest.alias("text"), n.alias("stripped"))


@query(_strip_sql(_SAID_SQL, 8, "doc_id", "documents"))
def opening_strip_eight(spark: SparkSession, d: str) -> DataFrame:
    """The router's variant: eight passes."""
    rest, n = tx.strip_openings(_said(), passes=8)
    return table(spark, d, "documents").select("doc_id", rest.alias("text"), n.alias("stripped"))


_OPENED = (
    "Based on the passages, the provided passages do not ",
    "Based on the provided passages, there is **no information** about ",
    "There is **no information** in the provided passages ",
    "Thinking Process:\n\n1.  **Analyze the Request:** the user wants to know ",
    "The user wants to figure out if ",
    "",
)
_ONCE = CITED_OPENINGS + RESTATED_OPENINGS
_OPENED_SQL = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_OPENED)) + " END || coalesce(text, '')"


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(t, '(?i)^(?:{p})') THEN regexp_replace(t, '(?i)^(?:{p})', '')" for p in _ONCE) + f" ELSE t END AS text FROM (SELECT doc_id, {_OPENED_SQL} AS t FROM documents)")
def opening_strip_once(spark: SparkSession, d: str) -> DataFrame:
    """A single pass: of two openings on end the first goes."""
    said = F.concat(F.element_at(F.array(*map(F.lit, _OPENED)), (F.col("doc_id") % 6 + 1).cast("int")), tx.body("text"))
    return table(spark, d, "documents").select("doc_id", tx.strip_once(said, _ONCE).alias("text"))


@query("SELECT doc_id, CASE WHEN strpos(coalesce(text, ''), chr(10)) > 0 THEN substring(text, strpos(text, chr(10)) + 1) ELSE '' END AS text FROM documents")
def drop_first_line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.drop_first_line("text").alias("text"))


@query("SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: NOT (contains(lower(x), 'idiot') OR contains(lower(x), 'trash'))), ' ') AS text FROM documents")
def marker_sentence_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.drop_sentences("text", ("idiot", "trash")).alias("text"))


@query("SELECT doc_id, substring(coalesce(text, ''), 1, 50) AS head, substring(coalesce(text, ''), 201, 500) AS middle, right(coalesce(text, ''), 40) AS tail, length(substring(coalesce(text, ''), 51)) AS rest FROM documents")
def span_slices(spark: SparkSession, d: str) -> DataFrame:
    t = tx.body("text")
    return table(spark, d, "documents").select("doc_id", tx.prefix(t, 50).alias("head"), tx.window(t, 200, 700).alias("middle"), tx.tail(t, 40).alias("tail"), F.length(tx.complement(t, 50)).alias("rest"))


_TOK = "regexp_extract_all(lower({c}), '[a-z0-9'']+')"


@query(
    f"WITH {TURNS_SQL}, t AS (SELECT pair, list_distinct({_TOK.format(c='a')}) AS x, list_distinct({_TOK.format(c='b')}) AS w FROM tp) "
    "SELECT pair, round(CASE WHEN len(list_distinct(list_concat(x, w))) = 0 THEN 0 ELSE 1 - len(list_intersect(x, w)) / CAST(len(list_distinct(list_concat(x, w))) AS DOUBLE) END, 9) AS distance FROM t"
)
def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    p = turn_pairs(spark, d)
    return p.select("pair", r9(tx.jaccard_distance(tx.tokens("a", "[a-z0-9']+"), tx.tokens("b", "[a-z0-9']+"))).alias("distance"))


_GRAMS = r"""tok AS (SELECT pair, 0 AS side, regexp_extract_all(lower(a), '[\p{L}\p{N}_]{2,}') AS t FROM tp UNION ALL SELECT pair, 1, regexp_extract_all(lower(b), '[\p{L}\p{N}_]{2,}') FROM tp),
    g AS (SELECT pair, side, unnest(list_concat(t, CASE WHEN len(t) > 1 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)) AS term FROM tok),
    tc AS (SELECT pair, term, count(*) FILTER (side = 0) AS ta, count(*) FILTER (side = 1) AS tb FROM g GROUP BY pair, term)"""
_COS = "s AS (SELECT pair, sum(wa * wb) AS dot, sum(wa * wa) AS aa, sum(wb * wb) AS bb FROM w GROUP BY pair) SELECT tp.pair AS pair, round(1 - coalesce(CASE WHEN aa > 0 AND bb > 0 THEN dot / sqrt(aa) / sqrt(bb) ELSE 0 END, 0), 9) AS distance FROM tp LEFT JOIN s USING (pair)"


@query(f"WITH {TURNS_SQL}, {_GRAMS}, w AS (SELECT pair, CAST(ta AS DOUBLE) AS wa, CAST(tb AS DOUBLE) AS wb FROM tc), {_COS}")
def count_cosine(spark: SparkSession, d: str) -> DataFrame:
    return distance.count_cosine(turn_pairs(spark, d)).withColumn("distance", r9(F.col("distance")))


_VOC = """n AS (SELECT 2 * count(*) AS docs FROM tp), v AS (SELECT term, sum(ta + tb) AS tf, sum(CASE WHEN ta > 0 THEN 1 ELSE 0 END + CASE WHEN tb > 0 THEN 1 ELSE 0 END) AS df FROM tc GROUP BY term {having} ORDER BY tf DESC, term LIMIT {most}),
    i AS (SELECT term, ln((1 + docs) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM v, n)"""


@query(f"WITH {TURNS_SQL}, {_GRAMS}, {_VOC.format(having='', most=10000)}, w AS (SELECT pair, CASE WHEN ta > 0 THEN (1 + ln(ta)) * idf ELSE 0 END AS wa, CASE WHEN tb > 0 THEN (1 + ln(tb)) * idf ELSE 0 END AS wb FROM tc JOIN i USING (term)), {_COS}")
def tfidf_distance(spark: SparkSession, d: str) -> DataFrame:
    return distance.tfidf(turn_pairs(spark, d)).withColumn("distance", r9(F.col("distance")))


_CHARS = """side AS (SELECT pair, 0 AS side, lower(a) AS t FROM tp UNION ALL SELECT pair, 1, lower(b) FROM tp), wd AS (SELECT pair, side, ' ' || unnest(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) || ' ' AS w FROM side),
    g AS (SELECT pair, side, unnest(list_concat(list_transform(range(1, greatest(length(w) - 1, 1)), lambda i: substring(w, i, 3)), list_transform(range(1, greatest(length(w) - 2, 1)), lambda i: substring(w, i, 4)))) AS term FROM wd),
    tc AS (SELECT pair, term, count(*) FILTER (side = 0) AS ta, count(*) FILTER (side = 1) AS tb FROM g GROUP BY pair, term)"""


@query(f"WITH {TURNS_SQL}, {_CHARS}, {_VOC.format(having='HAVING sum(CASE WHEN ta > 0 THEN 1 ELSE 0 END + CASE WHEN tb > 0 THEN 1 ELSE 0 END) >= 2', most=20000)}, w AS (SELECT pair, ta * idf AS wa, tb * idf AS wb FROM tc JOIN i USING (term)), {_COS}")
def char_tfidf_distance(spark: SparkSession, d: str) -> DataFrame:
    """N-grams of 3 and 4 characters only, as its SQL; the reference's forms are the next two queries."""
    out = distance.char_tfidf(turn_pairs(spark, d), 3, 4, most=20_000, min_df=2, sublinear=False)
    return out.withColumn("distance", r9(F.col("distance")))


_FIVE = "list_transform(range(1, greatest(length(w) - 3, 1)), lambda i: substring(w, i, 5))"
_CHARS_TO_FIVE = _CHARS.replace("substring(w, i, 4))))", f"substring(w, i, 4)), {_FIVE}))")


@query(f"WITH {TURNS_SQL}, {_CHARS_TO_FIVE}, {_VOC.format(having='HAVING sum(CASE WHEN ta > 0 THEN 1 ELSE 0 END + CASE WHEN tb > 0 THEN 1 ELSE 0 END) >= 2', most='ALL')}, w AS (SELECT pair, ta * idf AS wa, tb * idf AS wb FROM tc JOIN i USING (term)), {_COS}")
def char_tfidf_all_terms(spark: SparkSession, d: str) -> DataFrame:
    """The reference's span form: n-grams of 3 to 5 characters in two documents or more, plain counts, no cut of terms."""
    out = distance.char_tfidf(turn_pairs(spark, d), 3, 5, most=None, min_df=2, sublinear=False)
    return out.withColumn("distance", r9(F.col("distance")))


@query(f"WITH {TURNS_SQL}, {_CHARS_TO_FIVE}, {_VOC.format(having='', most=20000)}, w AS (SELECT pair, CASE WHEN ta > 0 THEN (1 + ln(ta)) * idf ELSE 0 END AS wa, CASE WHEN tb > 0 THEN (1 + ln(tb)) * idf ELSE 0 END AS wb FROM tc JOIN i USING (term)), {_COS}")
def char_tfidf_sublinear(spark: SparkSession, d: str) -> DataFrame:
    """The reference's metric-family form: n-grams of 3 to 5 characters, the 20,000 most frequent terms, 1 + ln(tf)."""
    out = distance.char_tfidf(turn_pairs(spark, d), 3, 5, most=20_000)
    return out.withColumn("distance", r9(F.col("distance")))


@query("WITH e AS (SELECT a.vec_id AS vec_id, a.embedding AS x, b.embedding AS w FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(1 - list_dot_product(CAST(x AS DOUBLE[]), CAST(w AS DOUBLE[])), 9) AS distance FROM e")
def embedding_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w"))
    return e.join(nxt, "vec_id").select("vec_id", r9(distance.embedding_distance(F.col("embedding"), F.col("w"))).alias("distance"))


@query(f"WITH {TURNS_SQL} SELECT pair, abs(length(a) - length(b)) AS gap, CAST((length(a) > 200) <> (length(b) > 200) AS INT) AS long_differs FROM tp")
def length_gap(spark: SparkSession, d: str) -> DataFrame:
    return turn_pairs(spark, d).select("pair", F.abs(F.length("a") - F.length("b")).alias("gap"), ((F.length("a") > 200) != (F.length("b") > 200)).cast("int").alias("long_differs"))


_SHARE = "CASE WHEN length(t) > 0 THEN (length(t) - length(regexp_replace(t, '{p}', '', 'g'))) / CAST(length(t) AS DOUBLE) ELSE 0 END"


@query(
    r"WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents) "
    "SELECT doc_id, length(t) AS chars, CAST(len(w) AS INT) AS words, round(CASE WHEN len(w) > 0 THEN length(array_to_string(w, '')) / CAST(len(w) AS DOUBLE) ELSE 0 END, 9) AS mean_word, "
    "round(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / CAST(len(w) AS DOUBLE) ELSE 0 END, 9) AS distinct_share, "
    "CAST(len(list_filter(string_split_regex(t, '[.!?]+'), lambda x: trim(x) <> '')) AS INT) AS sentences, "
    "round(len(w) / CAST(greatest(len(list_filter(string_split_regex(t, '[.!?]+'), lambda x: trim(x) <> '')), 1) AS DOUBLE), 9) AS mean_sentence, CAST(len(regexp_extract_all(t, '(?m)^\\s*([-*]|[0-9]+\\.)\\s')) AS INT) AS list_marks, "
    f"round({_SHARE.format(p='[0-9]')}, 9) AS digit_share, round({_SHARE.format(p=chr(92) + 'p{Lu}')}, 9) AS upper_share, CAST(regexp_matches(t, '[.!?]\\s*$') AS INT) AS ends_closed, "
    "round(CASE WHEN len(w) > 1 THEN 1 - len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) / CAST(len(w) - 1 AS DOUBLE) ELSE 0 END, 9) AS pair_repeats FROM d"
)
def surface_features(spark: SparkSession, d: str) -> DataFrame:
    out = tx.surface(table(spark, d, "documents"), "text", ["doc_id"])
    return out.withColumns({c: r9(F.col(c)) for c in ("mean_word", "distinct_share", "mean_sentence", "digit_share", "upper_share", "pair_repeats")})


_HTML = "regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_e}', '{_c}')"
_HTML = f"trim(regexp_replace({_HTML}, '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_HTML} AS text FROM pages")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.html_to_text("html").alias("text"))


@query(f"WITH p AS (SELECT page_id, {_HTML} AS t FROM pages), m AS (SELECT page_id, regexp_extract_all(t, '[A-Z][a-z]+ the [a-z]+') AS m FROM p) SELECT page_id, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i)[1:6], ' / ') AS passages FROM m")
def evidence_passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.array_join(tx.passages(tx.html_to_text("html"), "[A-Z][a-z]+ the [a-z]+"), " / ").alias("passages"))


@query("SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', '', 'g') AS plain, CAST(regexp_extract_all(replace(coalesce(text, ''), ',', ''), '-?[0-9]+(?:\\.[0-9]+)?')[-1] AS VARCHAR) AS last_number FROM documents")
def text_normalisation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.plain("text").alias("plain"), tx.last_number("text").alias("last_number"))


@query("SELECT doc_id, regexp_matches(t, '(?m)^\\s*([-*]|[0-9]+\\.)\\s') AS has_list, contains(t, '```') AS has_code, len(string_split_regex(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '\\s+')) > 40 AS long, t = '' OR contains(t, '__ERROR__') OR length(t) < 40 OR NOT regexp_matches(t, '[.!?)\\]}\"'']$') AS incomplete FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents)")
def surface_rules(spark: SparkSession, d: str) -> DataFrame:
    t = tx.strip(tx.body("text"))
    s = tx.signature(t)
    return table(spark, d, "documents").select("doc_id", s["has_list"].alias("has_list"), s["has_code"].alias("has_code"), s["long"].alias("long"), tx.incomplete("text").alias("incomplete"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 4 < 3 AS equal FROM lineitem")
def math_equal(spark: SparkSession, d: str) -> DataFrame:
    """Lines' quantities as boxed fractions against decimals, as roots of squares, as sums of a symbol in another order, and with one too many."""
    ship(spark)
    q, k = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber") % 4
    a = F.when(k == 0, F.concat(F.lit("so \\boxed{\\frac{"), q, F.lit("}{4}}"))).when(k == 1, F.concat(F.lit("\\sqrt{"), q, F.lit("\\cdot "), q, F.lit("}"))).otherwise(F.concat(q, F.lit("x + 1")))
    b = F.when(k == 0, (F.col("l_quantity") / 4).cast("string")).when(k == 1, q).when(k == 2, F.concat(F.lit("\\boxed 1+x*"), q)).otherwise(F.concat(q, F.lit("x + 2")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", mathtext.math_equal(a, b).alias("equal"))


@query("SELECT l_linenumber, count(*) AS n, count(*) FILTER (l_linenumber = 7) AS false_claims FROM lineitem GROUP BY l_linenumber")
def arithmetic_claims(spark: SparkSession, d: str) -> DataFrame:
    """Sums that are right but for the seventh lines'."""
    ship(spark)
    claim = F.format_string("%d + %d = %d", F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.col("l_linenumber") + F.col("l_quantity").cast("int") + F.when(F.col("l_linenumber") == 7, 1).otherwise(0))
    t = table(spark, d, "lineitem").select("l_linenumber", mathtext.arithmetic_claim_false(claim).alias("f"))
    return t.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count_if("f").alias("false_claims"))


@query()
def sequence_ratio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", r9(distance.sequence_distance(F.col("p_name"), F.col("p_type"))).alias("distance"))


_SLOTS = "CAST(('0x' || substring(md5(term), 1, 8)) AS BIGINT) % 65536"


@query(f"WITH {TURNS_SQL}, {_GRAMS}, w AS (SELECT pair, {_SLOTS} AS slot, CAST(sum(ta) AS DOUBLE) AS wa, CAST(sum(tb) AS DOUBLE) AS wb FROM tc GROUP BY ALL), {_COS}")
def hashed_cosine(spark: SparkSession, d: str) -> DataFrame:
    return distance.hashed_cosine(turn_pairs(spark, d)).withColumn("distance", r9(F.col("distance")))


_TAGGED = "CASE doc_id % 4 WHEN 0 THEN '<reasoning>r ' || lang || '</reasoning><final> ' || source || ' </final>' WHEN 1 THEN 'So. Final answer: ' || source WHEN 2 THEN '<final>' || lang ELSE lang END"


@query(
    f"WITH t AS (SELECT doc_id, {_TAGGED} AS t FROM documents) SELECT doc_id, trim(regexp_extract(t, '(?is)<reasoning>(.*?)</reasoning>', 1)) AS reasoning, "
    "CASE WHEN regexp_matches(t, '(?is)<final>(.*?)</final>') THEN trim(regexp_extract(t, '(?is)<final>(.*?)</final>', 1)) WHEN regexp_matches(t, '(?is)final answer\\s*:\\s*(.*)$') THEN trim(regexp_extract(t, '(?is)final answer\\s*:\\s*(.*)$', 1)) WHEN contains(t, '<final>') THEN trim(regexp_extract(t, '(?is)<final>(.*)$', 1)) ELSE '' END AS final, "
    "CASE WHEN regexp_matches(t, '(?is)<final>(.*?)</final>') THEN 'exact' WHEN regexp_matches(t, '(?is)final answer') THEN 'fallback_final_heading' WHEN contains(t, '<final>') THEN 'fallback_truncated_final' ELSE 'missing_final' END AS status FROM t"
)
def tagged_blocks(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("doc_id") % 4
    t = F.when(m == 0, F.concat(F.lit("<reasoning>r "), "lang", F.lit("</reasoning><final> "), "source", F.lit(" </final>"))).when(m == 1, F.concat(F.lit("So. Final answer: "), "source")).when(m == 2, F.concat(F.lit("<final>"), "lang")).otherwise(F.col("lang"))
    p = tx.parse_tagged(t)
    return table(spark, d, "documents").select("doc_id", p["reasoning"].alias("reasoning"), p["final"].alias("final"), p["status"].alias("status"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) % 3 = 0 AS said FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) % 3 < 2 UNION ALL SELECT event_id, NULL FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) % 3 = 2")
def judge_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies as JSON, as JSON inside prose, and as prose."""
    m = F.get_json_object("props", "$.k").cast("int") % 3
    reply = F.when(m == 0, F.lit('{"refusal": true}')).when(m == 1, F.lit('I think {"refusal": false, "rationale": "x"} holds')).otherwise(F.lit("no json"))
    return table(spark, d, "events").select("event_id", tx.parse_judgement(reply).alias("said"))


@query("SELECT l_orderkey, count(*) AS steps, count(*) FILTER (l_discount > 0.05) AS good FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3")
def step_lines(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines written as step lines and parsed again; under three lines is no parse."""
    line = F.concat(F.lit("Step "), F.col("l_linenumber").cast("string"), F.lit(": part "), F.col("l_partkey").cast("string"), F.when(F.col("l_discount") > 0.05, F.lit(" +")).otherwise(F.lit(" -")))
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("t"))
    p = t.select("l_orderkey", tx.steps("t").alias("s")).filter(F.col("s").isNotNull())
    return p.select("l_orderkey", F.size("s").cast("bigint").alias("steps"), F.size(F.filter("s", lambda x: x["sign"] == "+")).cast("bigint").alias("good"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'I cannot. ' || coalesce(text, '') ELSE coalesce(text, '') END AS injected, substring(coalesce(text, ''), 11) AS dropped, array_to_string(string_split_regex(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), '\\s+')[1:5], ' ') AS five_words FROM documents")
def interventions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.inject("text", "I cannot. ", F.col("doc_id") % 3 == 0).alias("injected"), tx.drop_chars(tx.body("text"), 10).alias("dropped"), tx.token_prefix(tx.body("text"), 5).alias("five_words"))


_LINE = "length(t) - length(CASE WHEN strpos(t, chr(10)) > 0 THEN substring(t, strpos(t, chr(10)) + 1) ELSE '' END)"
_MD5 = "CAST(('0x' || substring(md5({t}), 1, 8)) AS BIGINT)"


@query(
    f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT *, {_LINE} AS n FROM d), a AS (SELECT *, 1 + {_MD5.format(t='CAST(doc_id AS VARCHAR)')} % greatest(length(t) - n, 1) AS o FROM n) "
    "SELECT doc_id, CASE WHEN n <= 0 OR length(t) <= n THEN t ELSE substring(t, 1, o) || substring(t, o + n + 1) END AS text FROM a"
)
def matched_excision(spark: SparkSession, d: str) -> DataFrame:
    """As many characters as the first line has, cut at an offset that a hash picks."""
    n = F.length(tx.body("text")) - F.length(tx.drop_first_line("text"))
    return table(spark, d, "documents").select("doc_id", tx.excise("text", n, F.col("doc_id")).alias("text"))


_DEVIATE = "sqrt(-2 * ln((CAST(('0x' || substring(md5('5u-' || term || '-' || CAST(slot AS VARCHAR)), 1, 8)) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE))) * cos(CAST(6.283185307179586 AS DOUBLE) * ((CAST(('0x' || substring(md5('5v-' || term || '-' || CAST(slot AS VARCHAR)), 1, 8)) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))"


@query(
    f"WITH {TURNS_SQL}, {_GRAMS}, {_VOC.format(having='', most=10000)}, x AS (SELECT pair, term, CASE WHEN ta > 0 THEN (1 + ln(ta)) * idf ELSE 0 END AS xa, CASE WHEN tb > 0 THEN (1 + ln(tb)) * idf ELSE 0 END AS xb FROM tc JOIN i USING (term)), "
    f"r AS (SELECT term, slot, {_DEVIATE} AS r FROM i, (SELECT unnest(range(0, 384)) AS slot)), w AS (SELECT pair, slot, sum(r * xa) AS wa, sum(r * xb) AS wb FROM x JOIN r USING (term) GROUP BY pair, slot), {_COS}"
)
def projected_distance(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF weights at 384 coordinates."""
    return distance.projected_distance(turn_pairs(spark, d), 5).withColumn("distance", r9(F.col("distance")))


@query(f"WITH {TURNS_SQL}, {_GRAMS}, w AS (SELECT pair, CAST(ta AS DOUBLE) AS wa, CAST(tb AS DOUBLE) AS wb FROM tc WHERE length(term) <= 3), e AS (SELECT pair, round(sum(CASE WHEN length(term) <= 3 THEN ta * ta + tb * tb ELSE 0 END) / CAST(sum(ta * ta + tb * tb) AS DOUBLE), 9) AS energy FROM tc GROUP BY pair), {_COS.replace("s AS (", "s AS (", 1).replace(" SELECT tp.pair", ", q AS (SELECT tp.pair", 1)}) SELECT q.pair AS pair, distance, energy FROM q LEFT JOIN e ON e.pair = q.pair")
def template_energy(spark: SparkSession, d: str) -> DataFrame:
    out = distance.subspace(turn_pairs(spark, d), distance.word_grams, F.length("term") <= 3)
    return out.withColumns({c: r9(F.col(c)) for c in ("distance", "energy")})


_FOLD = "CAST(('0x' || substring(md5(CAST(pair // 1000 AS VARCHAR)), 1, 8)) AS BIGINT) % 5"


@query(
    f"WITH {TURNS_SQL}, {_GRAMS}, f AS (SELECT *, {_FOLD} AS fold FROM tc), k AS (SELECT unnest(range(0, 5)) AS k), n AS (SELECT k, 2 * count(*) FILTER ({_FOLD} <> k) AS docs FROM tp, k GROUP BY k), "
    "v AS (SELECT k, term, sum(CASE WHEN ta > 0 THEN 1 ELSE 0 END + CASE WHEN tb > 0 THEN 1 ELSE 0 END) AS df, row_number() OVER (PARTITION BY k ORDER BY sum(ta + tb) DESC, term) AS r FROM f, k WHERE fold <> k GROUP BY k, term), "
    "i AS (SELECT v.k AS fold, term, ln((1 + docs) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM v JOIN n USING (k) WHERE r <= 10000), "
    f"w AS (SELECT pair, CASE WHEN ta > 0 THEN (1 + ln(ta)) * idf ELSE 0 END AS wa, CASE WHEN tb > 0 THEN (1 + ln(tb)) * idf ELSE 0 END AS wb FROM f JOIN i USING (fold, term)), {_COS}"
)
def held_out_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Distances of all pairs by terms learned on the conversations of other folds: one of five by a hash of conv_id."""
    fold = F.pmod(tx.hashed(F.floor(F.col("pair") / 1000)), F.lit(FOLDS))
    return distance.held_out_tfidf(turn_pairs(spark, d), fold, FOLDS).withColumn("distance", r9(F.col("distance")))


@query("SELECT doc_id, round(CASE WHEN length(coalesce(text, '')) > 0 THEN length(regexp_replace(text, '[^0-9+\\-*/=^]', '', 'g')) / CAST(length(text) AS DOUBLE) ELSE 0 END, 9) AS density, CASE WHEN lang <> 'en' THEN 'not english' WHEN n_chars < 100 THEN 'short' WHEN contains(coalesce(text, ''), '|') THEN 'table' ELSE 'included' END AS reason FROM documents")
def screening_reasons(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    reason = rules.screen_reason((F.col("lang") != "en", "not english"), (F.col("n_chars") < 100, "short"), (F.contains(tx.body("text"), F.lit("|")), "table"))
    return t.select("doc_id", r9(rules.arithmetic_density("text")).alias("density"), reason.alias("reason"))
