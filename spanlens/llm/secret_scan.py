"""Secret scans over a trigram inverted index (operator 1), in DataFrame functions only.

Each rule's regex is parsed into alternatives, each a sequence of literal runs;
the trigrams of a run are mandatory, so an alternative is a conjunction of
trigrams and a rule a disjunction of alternatives. The index holds a posting
(trigram, text key) for every trigram that some rule needs; keys are hashes of
whole texts, so copies share their postings, and two texts with one key could
only add candidates. Postings are intersected by counting them for each key and
alternative. Candidates are verified by the regex itself on their whole texts;
a rule with an alternative that has no trigram is run on every text.

The candidate table (text key, rules) is written before it is joined, so Spark
knows its size and broadcasts it only below its threshold; beyond that texts
are shuffled by key, where a hot key is one candidate row and many text rows
that adaptive execution can split.

Null and empty texts have no secrets; repeated rows come out as often as they
went in; an input column named `secrets` is replaced, and inner columns have
names of their own. Places of matches are prefix sums of lengths by blocks, so
a text with many matches costs about its length and not the square of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

#: Most alternatives that a regex is expanded to, and members of a class that are expanded.
ALTERNATIVES, MEMBERS = 256, 6
#: Matches whose places are added up together.
BLOCK = 128


@dataclass(frozen=True)
class Rule:
    """Matches of `regex` count if their group `group` has `least` characters or more."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: A match takes the whole run of its class, so for the last two a shorter run is no match from any start in it: the least length can stand in the regex.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def literal_runs(regex: str) -> list[tuple[str, ...]]:
    """The alternatives of a regex, each as its lower-case literal runs; anything unbounded ends a run."""
    gap = "\0"

    def times(left: list[str], right: list[str]) -> list[str]:
        return [a + b for a in left for b in right] if len(left) * len(right) <= ALTERNATIVES else [a + gap for a in left]

    def walk(nodes) -> list[str]:
        out = [""]
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                here = [chr(arg).lower()]
            elif name == "SUBPATTERN":
                here = walk(arg[-1])
            elif name == "BRANCH":
                here = [x for b in arg[1] for x in walk(b)]
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, inner = arg
                if (low, int(high)) == (0, 1):
                    here = ["", *walk(inner)]
                elif low == int(high) and low <= 4:
                    here = [""]
                    for _ in range(low):
                        here = times(here, walk(inner))
                else:
                    here = [gap]
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= MEMBERS:
                here = [chr(c).lower() for _, c in arg]
            else:
                here = [gap]
            out = times(out, here)
        return out

    return sorted({tuple(r for r in x.split(gap) if r) for x in walk(re._parser.parse(regex))})


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Conjunctions of mandatory trigrams, one of which holds for any match; None if some alternative has none."""
    query = [frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2)) for runs in literal_runs(regex)]
    return sorted(set(query), key=sorted) if all(query) else None


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index (trigram, key) of `texts` (key, text) for the trigrams asked for."""
    low = texts.select("key", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select("key", F.explode(found).alias("trigram")).distinct()


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): the kinds whose trigram query the text with that key meets."""
    clauses = [(r.kind, n, len(c), t) for r in rules for n, c in enumerate(trigram_query(r.regex) or []) for t in c]
    index = postings(texts, sorted({c[3] for c in clauses}))
    # As many rows as the rules have trigrams.
    needs = F.broadcast(texts.sparkSession.createDataFrame(clauses, "kind string, clause int, size int, trigram string"))
    met = index.join(needs, "trigram").groupBy("key", "kind", "clause", "size").count().filter(F.col("count") == F.col("size"))
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _blocks(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Folds of each BLOCK items. Arrays that a fold appends to stay short, so long lists cost no square."""
    starts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    folds = F.transform(starts, lambda k: F.aggregate(F.slice(items, k * BLOCK + 1, F.lit(BLOCK)), zero, step))
    return F.when(F.size(items) > 0, folds)


def lengths(text: Column, rule: Rule) -> Column:
    """For each match the characters before it since the last one, its own, and whether it is accepted; null without matches."""
    regex = F.lit(rule.regex)
    matches, between = F.regexp_extract_all(text, regex, F.lit(0)), F.split(text, rule.regex, -1)

    def one(m: Column, b: Column) -> Column:
        ok = F.length(F.regexp_extract(m, rule.regex, rule.group)) >= rule.least
        return F.struct(F.length(b).alias("gap"), F.length(m).alias("n"), ok.alias("ok"))

    pairs = F.filter(F.zip_with(matches, between, one), lambda x: x["n"].isNotNull())  # what follows the last match has none
    return F.when(F.regexp_like(text, regex), pairs)


def _placed(acc: Column, x: Column) -> Column:
    start = acc["at"] + x["gap"]
    here = F.struct(start.alias("start"), (start + x["n"]).alias("end"))
    return F.struct((start + x["n"]).alias("at"), F.when(x["ok"], F.array_append(acc["all"], here)).otherwise(acc["all"]).alias("all"))


_SPANS = "array<struct<start:int,end:int>>"


def spans(blocks: Column) -> Column:
    """(start, end) of the accepted matches in code points, from the blocks' own places and the blocks' lengths."""
    offsets = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")))["all"]
    moved = F.zip_with(blocks, offsets, lambda b, o: F.transform(b["all"], lambda s: F.struct((s["start"] + o).alias("start"), (s["end"] + o).alias("end"))))
    return F.coalesce(F.flatten(moved), F.array().cast(_SPANS))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text") -> DataFrame:
    """All columns of `docs`, and `secrets`: array of (start, rank, end, kind) by start, then by the order of the rules."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    body = text_or_empty(names[docs.columns.index(text)])
    keyed = rows.withColumn("key", F.xxhash64(body))
    indexed = tuple(r for r in rules if trigram_query(r.regex) is not None)
    kinds = materialise(candidates(keyed.select("key", body.alias("text")), indexed), "secret-candidates")
    found = keyed.join(kinds, "key", "left")

    # Each step is a projection of its own: an expression that a lambda mentions would be evaluated for every element.
    cut, folded = {}, {}
    for rank, rule in enumerate(rules):
        of = lengths(body, rule)
        cut[f"m{rank}"] = F.when(F.array_contains("kinds", rule.kind), of) if rule in indexed else of
        items = F.col(f"m{rank}")
        folded[f"b{rank}"] = _blocks(items, F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("all")), _placed)
    found = found.select(*names, *(c.alias(n) for n, c in cut.items())).select(*names, *(c.alias(n) for n, c in folded.items()))

    def tagged(rank: int, kind: str):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))

    each = [F.transform(spans(F.col(f"b{rank}")), tagged(rank, rule.kind)) for rank, rule in enumerate(rules)]
    own = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c != "secrets"]
    return found.select(*own, F.array_sort(F.concat(*each)).alias("secrets"))


def listed(secrets: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, mark: str = "[secret]") -> DataFrame:
    """The rows with each secret of their text replaced by `mark`; overlapping ones by one mark. Null texts stay null."""
    names = [f"d{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index("text")]
    found = scan(docs.toDF(*names), rules, text=at)

    def reached(acc: Column, s: Column) -> Column:
        here = F.struct(s["start"].alias("start"), acc["to"].alias("before"))
        return F.struct(F.greatest(acc["to"], s["end"]).alias("to"), F.array_append(acc["all"], here).alias("all"))

    folds = _blocks(F.col("secrets"), F.struct(F.lit(0).alias("to"), F.array().cast("array<struct<start:int,before:int>>").alias("all")), reached)
    found = found.select("*", folds.alias("__b"))
    reach = F.aggregate("__b", F.struct(F.lit(0).alias("to"), F.array().cast("array<int>").alias("all")), lambda acc, b: F.struct(F.greatest(acc["to"], b["to"]).alias("to"), F.array_append(acc["all"], acc["to"]).alias("all")))
    found = found.select("*", reach.alias("__r"))

    def pieces(b: Column, lo: Column) -> Column:
        """A block's part of the text, cut once, and what stays of it: the text between where former spans end and a span begins."""

        def of(part: Column) -> Column:
            def keep(x: Column) -> Column:
                before = F.greatest(x["before"], lo)
                return F.when(x["start"] >= before, F.concat(F.substring(part, before - lo + 1, x["start"] - before), F.lit(mark))).otherwise(F.lit(""))

            return F.array_join(F.transform(b["all"], keep), "")

        return F.transform(F.array(F.substring(F.col(at), lo + 1, F.greatest(b["to"] - lo, F.lit(0)))), of)[0]

    whole = F.concat(F.array_join(F.zip_with("__b", F.col("__r")["all"], pieces), ""), F.substring(F.col(at), F.col("__r")["to"] + 1, F.length(at)))
    text = F.when(F.size("secrets") > 0, whole).otherwise(F.col(at))
    return found.select(*((text if n == at else F.col(n)).alias(c) for n, c in zip(names, docs.columns, strict=True)))
