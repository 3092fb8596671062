"""Spans, rules, strips and parsers as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocabulary import ANSWER_MARKER, CUES, OPENINGS, PASSAGE, UNCERTAINTY


def _s(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def body(c: Column | str) -> Column:
    """Null counts as empty."""
    return F.coalesce(_s(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(_s(c), r"^\s+|\s+$", "")


def prefix(c: Column | str, k: int) -> Column:
    return F.substring(_s(c), 1, k)


def complement(c: Column | str, k: int) -> Column:
    """What follows the first k characters."""
    return F.substring(_s(c), F.lit(k + 1), F.length(_s(c)))


def window(c: Column | str, lo: int, hi: int) -> Column:
    return F.substring(_s(c), lo + 1, hi - lo)


def tail(c: Column | str, k: int) -> Column:
    """The last k characters; k = 0 is the whole text, as a slice from minus zero is."""
    return F.right(_s(c), F.lit(k)) if k else _s(c)


def token_prefix(c: Column | str, n: int) -> Column:
    """The first n words, joined by a space."""
    return F.array_join(F.slice(F.split(strip(c), r"\s+"), 1, n), " ")


def step_prefix(steps: Column, share: float, ceiling: bool = False) -> Column:
    """The first k steps: k = max(1, half-even or ceiling of share * length)."""
    k = F.size(steps) * share
    k = F.ceil(k) if ceiling else F.bround(k, 0)
    return F.slice(steps, F.lit(1), F.greatest(F.lit(1), k.cast("int")))


def any_of(c: Column | str, cues: Sequence[str] = CUES, stripped: bool = True, span: int | None = None) -> Column:
    """The lower-cased text has one of the cues, in its first `span` characters after stripping if that is given."""
    t = F.lower(strip(body(c)) if stripped else body(c))
    t = t if span is None else prefix(t, span)
    return reduce(lambda a, b: a | b, (F.contains(t, F.lit(x)) for x in cues))


def matched(c: Column | str, cues: Sequence[str] = CUES) -> Column:
    """The cues that occur, in their order."""
    t = F.lower(body(c))
    return F.filter(F.array(*map(F.lit, cues)), lambda x: F.contains(t, x))


def first_offset(c: Column | str, cues: Sequence[str] = CUES) -> Column:
    """Characters before the first cue, -1 if there is none."""
    t = F.lower(body(c))
    at = F.least(*(F.when(F.instr(t, x) > 0, F.instr(t, x)) for x in cues)) if len(cues) > 1 else F.when(F.instr(t, cues[0]) > 0, F.instr(t, cues[0]))
    return F.coalesce(at - 1, F.lit(-1))


def has_gold(c: Column | str, gold: Column | str) -> Column:
    """The answer occurs in the text, case aside; an empty answer always does."""
    return F.contains(F.lower(body(c)), F.lower(body(gold)))


def incomplete(c: Column | str) -> Column:
    """Empty, an error mark, under 40 characters, or no closing punctuation."""
    t = strip(body(c))
    return (t == "") | F.contains(t, F.lit("__ERROR__")) | (F.length(t) < 40) | ~F.regexp_like(t, F.lit(r"[.!?)\]}\"']$"))


def signature(c: Column | str) -> Column:
    """(list, code, long): a list mark, a code fence, over 40 words."""
    t = body(c)
    return F.struct(F.regexp_like(t, F.lit(r"(?m)^\s*([-*]|[0-9]+\.)\s")).alias("has_list"), F.contains(t, F.lit("```")).alias("has_code"), (F.size(F.split(strip(t), r"\s+")) > 40).alias("long"))


def _either(patterns: Sequence[str]) -> str:
    """One pattern for all: alternatives are tried in their order, so the first that matches is taken."""
    return "|".join(f"(?:{p})" for p in patterns)


def strip_openings(c: Column | str, patterns: Sequence[str] = OPENINGS, passes: int = 5) -> tuple[Column, Column]:
    """Take off leading openings and the white space after them, the first that matches in each pass; the rest and how many went.

    A pass is one regex; the passes fold over a sequence, so the plan does not grow with either number.
    """
    opening = rf"(?i)^(?:{_either(patterns)})\s*"

    def step(acc: Column, _: Column) -> Column:
        rest = F.regexp_replace(acc["t"], opening, "")
        return F.struct(rest.alias("t"), (acc["n"] + (F.length(rest) < F.length(acc["t"])).cast("int")).alias("n"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(passes)), F.struct(body(c).alias("t"), F.lit(0).alias("n")), step)
    return out["t"], out["n"]


def strip_once(c: Column | str, patterns: Sequence[str]) -> Column:
    """Take off the first opening that matches, and nothing else."""
    return F.regexp_replace(body(c), rf"(?i)^(?:{_either(patterns)})", "")


def drop_chars(c: Column | str, k: int) -> Column:
    return complement(c, k)


def drop_tokens(c: Column | str, n: int) -> Column:
    words = F.split(strip(body(c)), r"\s+")
    return F.array_join(F.slice(words, F.lit(n + 1), F.greatest(F.size(words) - n, F.lit(0))), " ")


def drop_first_sentence(c: Column | str) -> Column:
    return F.regexp_replace(body(c), r"(?s)^.*?[.!?](\s+|$)", "")


def drop_first_line(c: Column | str) -> Column:
    """What follows the first line break; a single line leaves nothing."""
    t = body(c)
    return F.when(F.instr(t, "\n") > 0, F.substring(t, F.instr(t, "\n") + 1, F.length(t))).otherwise(F.lit(""))


def sentences(c: Column | str) -> Column:
    """Cut after closing punctuation and white space."""
    return F.split(F.regexp_replace(body(c), r"([.!?])\s+", "$1\x01"), "\x01")


def drop_sentences(c: Column | str, cues: Sequence[str] = CUES) -> Column:
    """Without the sentences that have a cue."""
    lower = lambda x: F.lower(x)
    return F.array_join(F.filter(sentences(c), lambda x: ~F.exists(F.array(*map(F.lit, cues)), lambda k: F.contains(lower(x), k))), " ")


def hashed(*parts: Column | str) -> Column:
    """32 bits of MD5 of the parts joined by a dash, as a bigint: any engine gives the same."""
    joined = F.concat_ws("-", *(_s(p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 8), 16, 10).cast("long")


def excise(c: Column | str, n: Column, key: Column) -> Column:
    """Without n characters from an offset of 1 or more that the key's hash picks; a text of n characters or fewer stays as it is."""
    t = body(c)
    at = 1 + F.pmod(hashed(key), F.greatest(F.length(t) - n, F.lit(1))).cast("int")
    return F.when((n <= 0) | (F.length(t) <= n), t).otherwise(F.concat(F.substring(t, F.lit(1), at), F.substring(t, at + n + 1, F.length(t))))


def drop_random_sentences(c: Column | str, share: Column | float, key: Column) -> Column:
    """Sentences in an order that the key's hash picks go until their characters reach the share of all; the rest stays in order."""
    parts = F.filter(sentences(c), lambda x: F.trim(x) != "")
    order = F.array_sort(F.transform(parts, lambda x, i: F.struct(hashed(key, i).alias("h"), i.alias("i"), F.length(x).alias("n"), x.alias("s"))))
    total = F.aggregate(order, F.lit(0), lambda acc, x: acc + x["n"])
    budget = ((share if isinstance(share, Column) else F.lit(share)) * total).cast("double")

    def spend(acc: Column, x: Column) -> Column:
        more = acc["spent"] < acc["budget"]
        return F.struct((acc["spent"] + F.when(more, x["n"]).otherwise(0)).alias("spent"), acc["budget"].alias("budget"), (acc["gone"] + more.cast("int")).alias("gone"))

    gone = F.aggregate(order, F.struct(F.lit(0).alias("spent"), budget.alias("budget"), F.lit(0).alias("gone")), spend)["gone"]
    left = F.array_sort(F.transform(F.slice(order, gone + 1, F.greatest(F.size(order), F.lit(1))), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
    return F.array_join(F.transform(left, lambda x: x["s"]), " ")


def inject(c: Column | str, opening: str, chosen: Column, span: int = 0, suffix: str = "") -> Column:
    """Where chosen: the opening in place of the first `span` characters, and a suffix after the text."""
    return F.when(chosen, F.concat(F.lit(opening), complement(c, span) if span else body(c), F.lit(suffix))).otherwise(body(c))


def content_word(w: Column) -> Column:
    """A token's letters in lower case; null unless it has three or more and nothing else but punctuation."""
    bare = F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
    return F.when((F.length(bare) > 2) & F.regexp_like(bare, F.lit(r"^\p{L}+$")), bare)


def content_words(c: Column | str, stop: Sequence[str] = ()) -> Column:
    found = F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(body(c), F.lit(r"\S+"), F.lit(0)), content_word)))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else found


def mask_words(c: Column | str, question: Column, keep: Column, span: int = 400, filler: str = "x", stop: Sequence[str] = ()) -> Column:
    """In the first `span` characters, tokens whose content word the question has and the kept answer lacks become fillers of their length."""
    t = body(c)
    asked = F.array_except(content_words(question, stop), content_words(keep))
    # At most `span` tokens, so the fold's text stays short.
    tokens_ = F.regexp_extract_all(prefix(t, span), F.lit(r"\S+|\s+"), F.lit(0))
    step = lambda acc, w: F.struct(acc["asked"].alias("asked"), F.concat(acc["out"], F.when(F.coalesce(F.array_contains(acc["asked"], content_word(w)), F.lit(False)), F.repeat(F.lit(filler), F.length(w))).otherwise(w)).alias("out"))
    return F.concat(F.aggregate(tokens_, F.struct(asked.alias("asked"), F.lit("").alias("out")), step)["out"], complement(t, span))


def parse_tagged(c: Column | str) -> Column:
    """(reasoning, final, status) of a tagged block: exact, a heading, a block without end, or missing."""
    t = body(c)
    grab = lambda p: F.regexp_extract(t, p, 1)
    has = lambda p: F.regexp_like(t, F.lit(p))
    exact, heading, cut = r"(?is)<final>(.*?)</final>", r"(?is)final answer\s*:\s*(.*)$", r"(?is)<final>(.*)$"
    status = F.when(has(exact), "exact").when(has(heading), "fallback_final_heading").when(has(cut), "fallback_truncated_final").otherwise("missing_final")
    final = F.when(has(exact), grab(exact)).when(has(heading), grab(heading)).when(has(cut), grab(cut)).otherwise("")
    return F.struct(strip(grab(r"(?is)<reasoning>(.*?)</reasoning>")).alias("reasoning"), strip(final).alias("final"), status.alias("status"))


def visible_response(c: Column | str) -> Column:
    """After the last closing thought tag, or after the last marker of a final answer if 20 characters follow, else the text."""
    t = body(c)
    after = F.regexp_extract(t, r"(?is)^.*</think>(.*)$", 1)
    final = F.regexp_extract(t, r"(?is)^.*(?:final answer|final response|answer)\s*:\s*(.{20,})$", 1)
    return strip(F.when(F.contains(F.lower(t), F.lit("</think>")), after).when(final != "", final).otherwise(t))


def parse_judgement(c: Column | str, field: str = "refusal") -> Column:
    """Boolean field of a reply: its JSON, JSON inside it, else null."""
    t = body(c)
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    value = F.lower(F.coalesce(F.get_json_object(t, f"$.{field}"), F.get_json_object(inner, f"$.{field}")))
    return F.when(value == "true", True).when(value == "false", False)


def html_to_text(c: Column | str) -> Column:
    """Without scripts, styles, tags and the common entities, white space made single."""
    t = F.regexp_replace(body(c), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def list_items(c: Column | str) -> Column:
    """Items of a list literal of quoted strings or bare words, `['a', "b", 3]`; any other text is its own only item."""
    t = strip(body(c))
    item = r"'(?:[^'\\\\]|\\\\.)*'|\"(?:[^\"\\\\]|\\\\.)*\"|[^,'\"\[\]\s][^,'\"\[\]]*"
    whole = rf"^\[\s*(?:(?:{item})\s*(?:,\s*(?:{item})\s*)*,?)?\s*\]$"
    items = F.transform(F.regexp_extract_all(F.regexp_extract(t, r"(?s)^\[(.*)\]$", 1), F.lit(f"({item})"), F.lit(1)), lambda x: F.regexp_replace(F.trim(x), r"^(['\"])(.*)\1$", "$2"))
    return F.when(F.regexp_like(t, F.lit(whole)), items).otherwise(F.array(body(c)))


def passages(c: Column | str, pattern: str, most: int = 6) -> Column:
    """Distinct matches in order, the first `most`."""
    return F.slice(F.array_distinct(F.regexp_extract_all(body(c), F.lit(pattern), F.lit(0))), 1, most)


def answer_letter(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(body(c), r"\b([A-J])\b", 1), F.lit(""))


def last_number(c: Column | str) -> Column:
    return F.try_element_at(F.regexp_extract_all(F.replace(body(c), F.lit(","), F.lit("")), F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0)), F.lit(-1))


def plain(c: Column | str) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(body(c)), "[^a-z0-9]", "")


def plain_number(c: Column | str) -> Column:
    """A number without separators, unit signs and trailing zeros; null if it is none."""
    return F.try_to_number(F.regexp_replace(strip(body(c)), "[,$%]", ""), F.lit("S9999999999999999D9999999999")).cast("double")


def steps(c: Column | str) -> Column:
    """Array of (text, sign) of `Step k: text +` lines; null if a line is none or there are under three."""
    lines = F.filter(F.split(body(c), "\n"), lambda x: F.trim(x) != "")
    p = r"^\s*Step\s+\d+\s*:\s*(.*?)\s*([+-])\s*$"
    parsed = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, p, 1).alias("text"), F.regexp_extract(x, p, 2).alias("sign")))
    return F.when(F.forall(lines, lambda x: F.regexp_like(x, F.lit(p))) & (F.size(lines) >= 3), parsed)


#: Surface features in the order in which `surface` gives them.
SURFACE = ("chars", "words", "mean_word", "distinct_share", "sentences", "mean_sentence", "list_marks", "digit_share", "upper_share", "ends_closed", "pair_repeats")


def surface(df: DataFrame, c: str, keep: Sequence[str]) -> DataFrame:
    """`keep` columns and the surface features of a text. Words are cut in a projection of their own, which the features share."""
    t = F.col("__t")
    cut = df.select(*keep, body(c).alias("__t")).select(*keep, "__t", F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("__w"))
    words, n, chars = F.col("__w"), F.size("__w"), F.length(t)
    follow = F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(1)))
    pairs = F.zip_with(words, follow, lambda a, b: F.concat(a, F.lit(" "), b))  # the last word has no follower and gives a null
    cut = cut.select(*keep, "__t", "__w", F.size(F.array_distinct(words)).alias("__d"), F.size(F.array_distinct(F.array_compact(pairs))).alias("__p"), F.size(F.filter(F.split(t, "[.!?]+"), lambda x: F.trim(x) != "")).alias("__s"))
    share = lambda p: F.when(chars > 0, (chars - F.length(F.regexp_replace(t, p, ""))) / chars).otherwise(F.lit(0.0))
    return cut.select(
        *keep,
        chars.alias("chars"),
        n.alias("words"),
        F.when(n > 0, F.length(F.array_join(words, "")) / n).otherwise(F.lit(0.0)).alias("mean_word"),
        F.when(n > 0, F.col("__d") / n).otherwise(F.lit(0.0)).alias("distinct_share"),
        F.col("__s").alias("sentences"),
        (n / F.greatest("__s", F.lit(1))).alias("mean_sentence"),
        F.size(F.regexp_extract_all(t, F.lit(r"(?m)^\s*([-*]|[0-9]+\.)\s"), F.lit(0))).alias("list_marks"),
        F.when(chars > 0, (chars - F.length(F.translate(t, "0123456789", ""))) / chars).otherwise(F.lit(0.0)).alias("digit_share"),
        share(r"\p{Lu}").alias("upper_share"),
        F.regexp_like(t, F.lit(r"[.!?]\s*$")).cast("int").alias("ends_closed"),
        F.when(n > 1, 1 - F.col("__p") / (n - 1)).otherwise(F.lit(0.0)).alias("pair_repeats"),
    )


def tokens(c: Column | str, pattern: str = r"[\p{L}\p{N}_]{2,}") -> Column:
    return F.regexp_extract_all(F.lower(body(c)), F.lit(pattern), F.lit(0))


def markers(c: Column | str) -> dict[str, Column]:
    """Whether the text has an answer marker, a word of doubt, a cited passage."""
    t = body(c)
    return {"answer": F.regexp_like(t, F.lit(ANSWER_MARKER)), "uncertain": F.regexp_like(t, F.lit(UNCERTAINTY)), "passage": F.regexp_like(t, F.lit(PASSAGE))}


def marker_set(c: Column | str) -> Column:
    """Names of the markers that hold, `incomplete` among them."""
    flags = markers(c) | {"incomplete": incomplete(c)}
    return F.array_compact(F.array(*(F.when(f, F.lit(n)) for n, f in flags.items())))


def jaccard_distance(a: Column, b: Column) -> Column:
    """Of token sets; 0 if both are empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / union)
