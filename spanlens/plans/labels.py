"""Queries of the predicates that make labels, and of edits of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as tx
from ..functions.vocabulary import ANSWER_MARKER, CUES, CUES_11, PASSAGE, REFUSAL_OPENINGS, THINKING_OPENINGS, UNCERTAINTY, WIDE_CUES
from ..operators import agree
from ..sources import table
from .contracts import TURNS_SQL, pairs, pairs_sql, r9, turn_pairs
from .registry import query

P = "WITH " + pairs_sql()


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _any(t: str, cues) -> str:
    return f"len(list_filter([{', '.join(map(_q, cues))}], lambda k: contains({t}, k))) > 0"


_TRIM = "regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
#: Cues stand in few of the texts, so some get one in front.
_CUED = "CASE doc_id % 6 WHEN 0 THEN '  Sorry, I am ' WHEN 1 THEN 'we are unable to say ' WHEN 2 THEN 'I will not say ' WHEN 3 THEN repeat(' ', 220) || 'cannot ' ELSE '' END || coalesce(text, '')"


def _cued():
    m = F.col("doc_id") % 6
    head = F.when(m == 0, F.lit("  Sorry, I am ")).when(m == 1, F.lit("we are unable to say ")).when(m == 2, F.lit("I will not say ")).when(m == 3, F.concat(F.repeat(F.lit(" "), F.lit(220)), F.lit("cannot "))).otherwise(F.lit(""))
    return F.concat(head, tx.body("text"))


@query(
    f"WITH d AS (SELECT doc_id, {_CUED} AS t FROM documents), s AS (SELECT doc_id, lower(t) AS raw, lower({_TRIM.format(t='t')}) AS low FROM d) SELECT doc_id, {_any('raw', CUES)} AS not_stripped, "
    f"{_any('substring(low, 1, 200)', CUES)} AS stripped_then_cut, {_any('substring(raw, 1, 200)', CUES)} AS cut_only, {_any('low', CUES_11)} AS eleven, {_any('low', WIDE_CUES)} AS wide FROM s"
)
def keyword_variants(spark: SparkSession, d: str) -> DataFrame:
    """The keyword rule without stripping, on a span cut after stripping, with the shorter and with the wide list."""
    t = _cued()
    return table(spark, d, "documents").select(
        "doc_id",
        tx.any_of(t, stripped=False).alias("not_stripped"),
        tx.any_of(t, span=200).alias("stripped_then_cut"),
        tx.any_of(tx.prefix(t, 200), stripped=False).alias("cut_only"),
        tx.any_of(t, CUES_11).alias("eleven"),
        tx.any_of(t, WIDE_CUES).alias("wide"),
    )


_GOLD = r"'(?s)^(.*?(?:^|[^\p{L}\p{N}_]))' || lang || '(?:$|[^\p{L}\p{N}_])'"
_NUM = r"'(?:^|[^0-9.])' || CAST(n_chars AS VARCHAR) || '(?:\.0+)?(?:$|[^0-9.]|\.(?:$|[^0-9]))'"


def _starts(patterns) -> str:
    return "regexp_matches(t, " + _q(r"(?i)^\s*(?:" + "|".join(f"(?:{p})" for p in patterns) + ")") + ")"


_TALK = "CASE doc_id % 3 WHEN 0 THEN 'Let me think\n' WHEN 1 THEN 'I''m sorry, but ' ELSE '' END || coalesce(text, '') || ' It has ' || CAST(n_chars + doc_id % 2 AS VARCHAR) || '.'".replace("\\n", "' || chr(10) || '")


def _talk():
    m = F.col("doc_id") % 3
    head = F.when(m == 0, F.lit("Let me think\n")).when(m == 1, F.lit("I'm sorry, but ")).otherwise(F.lit(""))
    return F.concat(head, tx.body("text"), F.lit(" It has "), (F.col("n_chars") + F.col("doc_id") % 2).cast("string"), F.lit("."))


@query(
    f"WITH d AS (SELECT doc_id, lang, n_chars, {_TALK} AS t FROM documents) SELECT doc_id, contains(lower(t), lang) AS anywhere, CASE WHEN regexp_matches(lower(t), {_GOLD}) THEN CAST(length(regexp_extract(lower(t), {_GOLD}, 1)) AS INT) END AS word_offset, "
    f"regexp_matches(replace(t, ',', ''), {_NUM}) AS names_length, CASE WHEN {_starts(THINKING_OPENINGS)} THEN 'thinking' WHEN {_starts(REFUSAL_OPENINGS)} THEN 'direct_refusal' ELSE 'other' END AS family FROM d"
)
def gold_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document's language code stands in it, where it stands as a word, whether its length is named, and how it opens."""
    t = _talk()
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars", t.alias("t"))
    return rows.select("doc_id", tx.has_gold("t", "lang").alias("anywhere"), rules.gold_offset("t", F.col("lang")).cast("int").alias("word_offset"), rules.has_number("t", F.col("n_chars").cast("string")).alias("names_length"), rules.opening_family("t").alias("family"))


_MARKED = "CASE doc_id % 5 WHEN 0 THEN 'Therefore ' WHEN 1 THEN 'Not sure. Wait, ' WHEN 2 THEN 'The passage: \\boxed {4} ' ELSE '' END || coalesce(text, '')"


def _marked():
    m = F.col("doc_id") % 5
    return F.concat(F.when(m == 0, F.lit("Therefore ")).when(m == 1, F.lit("Not sure. Wait, ")).when(m == 2, F.lit("The passage: \\boxed {4} ")).otherwise(F.lit("")), tx.body("text"))


@query(f"WITH d AS (SELECT doc_id, {_MARKED} AS t FROM documents) SELECT doc_id, regexp_matches(t, {_q(ANSWER_MARKER)}) AS answer, regexp_matches(t, {_q(UNCERTAINTY)}) AS uncertain, regexp_matches(t, {_q(PASSAGE)}) AS passage, regexp_matches(t, {_q(rules.BACKTRACK)}) AS backtracks, regexp_matches(t, '\\\\boxed\\s*\\{{') AS boxed FROM d")
def marker_flags(spark: SparkSession, d: str) -> DataFrame:
    t = _marked()
    f = tx.markers(t)
    return table(spark, d, "documents").select("doc_id", *(f[n].alias(n) for n in ("answer", "uncertain", "passage")), rules.backtracks(t).alias("backtracks"), rules.has_box(t).alias("boxed"))


def _marker_list(c: str) -> str:
    t = _TRIM.format(t=c)
    incomplete = f"({t} = '' OR contains({t}, '__ERROR__') OR length({t}) < 40 OR NOT regexp_matches({t}, '[.!?)\\]}}\"'']$'))"
    flags = {"answer": f"regexp_matches({c}, {_q(ANSWER_MARKER)})", "uncertain": f"regexp_matches({c}, {_q(UNCERTAINTY)})", "passage": f"regexp_matches({c}, {_q(PASSAGE)})", "incomplete": incomplete}
    return "list_filter([" + ", ".join(f"CASE WHEN {f} THEN '{n}' END" for n, f in flags.items()) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {TURNS_SQL}, m AS (SELECT pair, {_marker_list('a')} AS x, {_marker_list('b')} AS w FROM tp) SELECT pair, round(CASE WHEN len(list_distinct(list_concat(x, w))) = 0 THEN 0 ELSE 1 - len(list_intersect(x, w)) / CAST(len(list_distinct(list_concat(x, w))) AS DOUBLE) END, 9) AS distance FROM m")
def marker_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return turn_pairs(spark, d).select("pair", r9(tx.jaccard_distance(tx.marker_set("a"), tx.marker_set("b"))).alias("distance"))


@query(f"WITH {TURNS_SQL}, m AS (SELECT quantile_cont(n, 0.5) AS m FROM (SELECT length(a) AS n FROM tp UNION ALL SELECT length(b) FROM tp)) SELECT pair, length(a) > m AS long_a, length(b) > m AS long_b, CAST((length(a) > m) <> (length(b) > m) AS INT) AS differs FROM tp, m")
def long_surface(spark: SparkSession, d: str) -> DataFrame:
    """Longer than the median of both sides pooled."""
    return rules.long_sides(turn_pairs(spark, d), "a", "b").select("pair", "long_a", "long_b", rules.disagree(F.col("long_a"), F.col("long_b")).alias("differs"))


@query("SELECT l_orderkey, l_linenumber, CAST((l_discount * 10 >= 0.7) <> (l_tax * 12 >= 0.7) AS INT) AS differs, CAST(l_quantity <= 3 AS INT) AS low, l_quantity % 1 = 0 AND l_extendedprice % 1 = 0 AS whole FROM lineitem")
def threshold_labels(spark: SparkSession, d: str) -> DataFrame:
    """Two scores on either side of a cut, a score below a cut, scores without fractions."""
    t = table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", rules.threshold_disagree(F.col("l_discount") * 10, F.col("l_tax") * 12).alias("differs"), (F.col("l_quantity") <= 3).cast("int").alias("low"), rules.whole_numbers(["l_quantity", "l_extendedprice"]).alias("whole"))


_PARSED = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'fallback_final_heading' WHEN 2 THEN 'fallback_truncated_final' ELSE 'missing_final' END AS status FROM documents"


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("doc_id") % 4
    t = F.when(m == 0, F.lit("<final>x</final>")).when(m == 1, F.lit("So. Final answer: y")).when(m == 2, F.lit("<final>cut")).otherwise(F.lit("none"))
    return table(spark, d, "documents").select("doc_id", "lang", "source", tx.parse_tagged(t).alias("p")).select("doc_id", "lang", "source", "p.*")


@query(f"SELECT doc_id, status FROM ({_PARSED}) WHERE status <> 'fallback_truncated_final'")
def parse_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Without the rows whose parse fell back to an answer that was cut off."""
    return _parsed(spark, d).filter(F.col("status") != "fallback_truncated_final").select("doc_id", "status")


@query("SELECT a.conv_id AS conv_id, a.turn AS turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn WHERE a.role = b.role AND length(regexp_replace(coalesce(a.text, ''), '^\\s+|\\s+$', '', 'g')) > 0 AND substring(a.text, 1, a.turn * 20) <> '' AND regexp_replace(substring(b.text, 1, b.turn * 20), '\\s', '', 'g') <> ''")
def comparable_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of two runs are kept where prompts are the same and no final answer is blank: here the second run cuts its text at 20 characters a turn."""
    c = table(spark, d, "conversations")
    a = c.select("conv_id", "turn", F.col("role").alias("pa"), F.col("text").alias("fa"))
    b = c.select("conv_id", "turn", F.col("role").alias("pb"), F.expr("substring(text, 1, cast(turn * 20 as int))").alias("fb"))
    return a.join(b, ["conv_id", "turn"]).filter(rules.comparable(F.col("pa"), F.col("pb"), F.col("fa"), F.col("fb"))).select("conv_id", "turn")


@query("WITH o AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS v FROM lineitem GROUP BY l_orderkey), k AS (SELECT *, len(v) AS n, greatest(1, CAST(CASE WHEN (len(v) * 0.5) % 1 = 0.5 THEN 2 * round(len(v) * 0.25) ELSE round(len(v) * 0.5) END AS INT)) AS even, greatest(1, CAST(ceil(len(v) * 0.5) AS INT)) AS up FROM o) SELECT l_orderkey, array_to_string(v[1:even], ',') AS half_even, array_to_string(v[1:up], ',') AS half_up FROM k WHERE even < n")
def step_spans(spark: SparkSession, d: str) -> DataFrame:
    """The first half of an order's lines, rounded half-even and up; orders whose first half is all are left out."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(steps.alias("v"))
    half = tx.step_prefix(F.col("v"), 0.5)
    return t.filter(F.size(half) < F.size("v")).select("l_orderkey", F.array_join(half, ",").alias("half_even"), F.array_join(tx.step_prefix(F.col("v"), 0.5, ceiling=True), ",").alias("half_up"))


@query("SELECT doc_id, array_to_string(string_split_regex(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), '\\s+')[4:], ' ') AS without_words, regexp_replace(coalesce(text, ''), '(?s)^.*?[.!?](\\s+|$)', '') AS without_sentence FROM documents")
def model_agnostic_drops(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.drop_tokens("text", 3).alias("without_words"), tx.drop_first_sentence("text").alias("without_sentence"))


_H = "CAST(('0x' || substring(md5({t}), 1, 8)) AS BIGINT)"


@query(
    "WITH p AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS s, generate_subscripts(list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''), 1) - 1 AS i FROM documents), "
    f"h AS (SELECT *, sum(length(s)) OVER (PARTITION BY doc_id) * 0.3 AS budget, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY {_H.format(t=chr(39) + '5-' + chr(39) + ' || CAST(doc_id AS VARCHAR) || ' + chr(39) + '-' + chr(39) + ' || CAST(i AS VARCHAR)')}, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM p) "
    "SELECT d.doc_id AS doc_id, coalesce(string_agg(h.s, ' ' ORDER BY h.i) FILTER (spent >= budget), '') AS text FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id GROUP BY d.doc_id"
)
def matched_sentence_removal(spark: SparkSession, d: str) -> DataFrame:
    """Sentences in a hash's order go until three tenths of the characters are gone: the control of the marker strip."""
    return table(spark, d, "documents").select("doc_id", tx.drop_random_sentences("text", 0.3, F.concat_ws("-", F.lit("5"), "doc_id")).alias("text"))


_BARE = "lower(regexp_replace({w}, '[^\\p{{L}}\\p{{N}}_]', '', 'g'))"
_CONTENT = "list_filter(list_transform(regexp_extract_all({t}, '\\S+'), lambda w: " + _BARE.replace("{w}", "w") + "), lambda w: length(w) > 2 AND regexp_matches(w, '^\\p{{L}}+$'))"


@query(
    f"WITH w AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (SELECT doc_id, source FROM documents), k AS (SELECT doc_id, t, list_filter({_CONTENT.format(t='substring(t, 1, 60)')}, lambda x: NOT list_contains({_CONTENT.format(t='substring(t, 101, 80)')}, x)) AS asked FROM w) "
    f"SELECT doc_id, coalesce(array_to_string(list_transform(regexp_extract_all(substring(t, 1, 400), '\\S+|\\s+'), lambda w: CASE WHEN list_contains(asked, {_BARE.format(w='w')}) THEN repeat('x', length(w)) ELSE w END), ''), '') || substring(t, 401) AS text FROM k"
)
def question_masking(spark: SparkSession, d: str) -> DataFrame:
    """Words of a question (a text's first 60 characters) become fillers in its first 400, but for those of the kept answer (80 further on)."""
    t = tx.body("text")
    return table(spark, d, "documents").select("doc_id", tx.mask_words("text", tx.prefix(t, 60), tx.window(t, 100, 180)).alias("text"))


@query(
    f"{P}, o AS (SELECT id, row_number() OVER (ORDER BY {_H.format(t=chr(39) + 'i-' + chr(39) + ' || id')}, id) AS r, count(*) OVER () AS n FROM pair WHERE z = z_comp), k AS (SELECT id FROM o, (SELECT count(*) AS all_n FROM pair) WHERE r <= least(round_even(0.2 * all_n, 0), n)) "
    "SELECT id, CASE WHEN id IN (SELECT id FROM k) THEN 'I cannot help with that. ' || substring(coalesce(d.text, ''), 51) || ' I must decline.' ELSE coalesce(d.text, '') END AS text FROM pair JOIN documents d ON CAST(d.doc_id AS VARCHAR) = id"
)
def rated_injection(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of all texts, drawn by a hash from those where both rules agree, get an opening in place of their span and a suffix off it."""
    from ..operators.resample import inject_at_rate

    p = pairs(spark, d).select("id", "z", "z_comp").join(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"), "id")
    marked = inject_at_rate(p, "id", F.col("z") == F.col("z_comp"), 0.2, "i")
    return marked.select("id", tx.inject("text", "I cannot help with that. ", F.col("injected"), 50, " I must decline.").alias("text"))


_THOUGHT = "CASE doc_id % 3 WHEN 0 THEN '<think>a</think> b </think>  seen ' || lang WHEN 1 THEN 'x answer: no. Final answer:  this is the visible part of it ' ELSE '  plain answer: ' || lang END"


@query(
    f"WITH t AS (SELECT doc_id, {_THOUGHT} AS t FROM documents) SELECT doc_id, " + _TRIM.format(t="CASE WHEN contains(lower(t), '</think>') THEN regexp_extract(t, '(?is)^.*</think>(.*)$', 1) WHEN regexp_extract(t, '(?is)^.*(?:final answer|final response|answer)\\s*:\\s*(.{20,})$', 1) <> '' THEN regexp_extract(t, '(?is)^.*(?:final answer|final response|answer)\\s*:\\s*(.{20,})$', 1) ELSE t END") + " AS visible FROM t"
)
def visible_response(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("doc_id") % 3
    t = F.when(m == 0, F.concat(F.lit("<think>a</think> b </think>  seen "), "lang")).when(m == 1, F.lit("x answer: no. Final answer:  this is the visible part of it ")).otherwise(F.concat(F.lit("  plain answer: "), "lang"))
    return table(spark, d, "documents").select("doc_id", tx.visible_response(t).alias("visible"))


@query(
    "SELECT p_partkey, nullif(regexp_extract(CASE p_partkey % 3 WHEN 0 THEN 'It is (B), not A' WHEN 1 THEN 'none AB' ELSE 'x C.' END, '\\b([A-J])\\b', 1), '') AS letter, p_retailprice AS number, "
    "CASE p_partkey % 4 WHEN 0 THEN p_brand || '|it''s|3' WHEN 1 THEN p_brand WHEN 2 THEN '[' || p_brand || ' x' ELSE '' END AS items, CAST(CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 3 THEN 0 ELSE 1 END AS INT) AS many FROM part"
)
def answer_parsing(spark: SparkSession, d: str) -> DataFrame:
    """Answer letters; numbers with separators and units; list literals, one-item lists, a list that is none and an empty one."""
    m, k = F.col("p_partkey") % 3, F.col("p_partkey") % 4
    letter = F.when(m == 0, F.lit("It is (B), not A")).when(m == 1, F.lit("none AB")).otherwise(F.lit("x C."))
    number = F.concat(F.lit(" $"), F.format_number("p_retailprice", 2), F.lit(" "))
    items = F.when(k == 0, F.concat(F.lit("['"), "p_brand", F.lit("', \"it's\", 3]"))).when(k == 1, F.concat(F.lit("[ '"), "p_brand", F.lit("' ]"))).when(k == 2, F.concat(F.lit("["), "p_brand", F.lit(" x"))).otherwise(F.lit("[]"))
    parsed = tx.list_items(items)
    return table(spark, d, "part").select("p_partkey", tx.answer_letter(letter).alias("letter"), tx.plain_number(number).alias("number"), F.array_join(parsed, "|").alias("items"), F.size(parsed).alias("many"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp, CAST(ts AS DATE) AS day, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, CAST(date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS INT) AS days FROM events")
def time_stamps(spark: SparkSession, d: str) -> DataFrame:
    """A report's time stamp and the parts of it."""
    t = table(spark, d, "events")
    return t.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"), F.to_date("ts").alias("day"), F.date_trunc("hour", "ts").alias("hour"), F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).alias("days"))


def _signature(c: str) -> str:
    return f"[regexp_matches({c}, '(?m)^\\s*([-*]|[0-9]+\\.)\\s'), contains({c}, '```'), len(string_split_regex({_TRIM.format(t=c)}, '\\s+')) > 40]"


@query(f"WITH {TURNS_SQL} SELECT pair, CAST({_signature('a')} <> {_signature('b')} AS INT) AS differs FROM tp")
def signature_differs(spark: SparkSession, d: str) -> DataFrame:
    """Whether the two sides' format signatures are different."""
    return turn_pairs(spark, d).select("pair", (tx.signature("a") != tx.signature("b")).cast("int").alias("differs"))


_SUBSETS = {"toxic": "y = 1", "marked": "z_ext = 1", "low": "q = 0"}


@query(f"{P} SELECT id FROM pair WHERE y = 1 UNION SELECT id FROM pair WHERE z_ext = 1 UNION SELECT id FROM pair WHERE q = 0")
def subset_union(spark: SparkSession, d: str) -> DataFrame:
    """Ids of any of three subsets, each once."""
    p = pairs(spark, d)
    return agree.union_ids([p.filter(c).select("id") for c in _SUBSETS.values()])


@query(f"{P}, a AS (SELECT DISTINCT id FROM pair WHERE y = 1), b AS (SELECT DISTINCT id FROM pair WHERE z_ext = 1) SELECT id, 'first' AS only_in FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'second' FROM b WHERE id NOT IN (SELECT id FROM a)")
def flag_difference(spark: SparkSession, d: str) -> DataFrame:
    """Ids that one rule flags and the other doesn't, either way."""
    p = pairs(spark, d)
    return agree.difference(p.filter("y = 1"), p.filter("z_ext = 1"), "id")
