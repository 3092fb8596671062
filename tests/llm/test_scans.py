"""Licence scans, vector codes and periodic runs: against brute force on small inputs and SQL on the given tables, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlens.llm import license_scan, periodic, vector_codes
from spanlens.llm import queries as Q
from spanlens.llm.words import Words
from tests import oracle
from tests.llm.test_operators import ODD, D, odd_docs, small_docs, words

# -- licence scans


def naive_statistics(text, templates):
    """Longest run of template words that ends at each word."""
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    return [max((n for n in range(1, i + 2) if tuple(text[i - n + 1 : i + 1]) in runs), default=0) for i in range(len(text))]


@pytest.mark.parametrize("single", [True, False])
def test_matching_statistics(single):
    rng = random.Random(3)
    for _ in range(150):
        letters = "abcd"[: rng.randint(1, 4)]
        templates = [[rng.choice(letters) for _ in range(rng.randint(2, 9))] for _ in range(rng.randint(1, 4))]
        texts = [[rng.choice(letters + "xy") for _ in range(rng.randint(0, 30))] for _ in range(3)]
        a = license_scan.Automaton([" ".join(t) for t in templates])
        assert len(a.length) <= 2 * sum(map(len, templates)) + 1
        w = Words([" ".join(t).encode() for t in texts])
        places, states, sizes, extended = a.statistics(w, single)
        got = dict(zip(places.tolist(), sizes.tolist(), strict=True))
        state = dict(zip(places.tolist(), states.tolist(), strict=True))
        goes_on = dict(zip(places.tolist(), extended.tolist(), strict=True))
        for k, text in enumerate(texts):
            expected = naive_statistics(text, templates)
            for i, n in enumerate(expected):
                at = int(w.bounds[k]) + i
                assert got.get(at, 0) == n or (not single and n < 2 and at not in got)
                if n >= 2:
                    run = text[i - n + 1 : i + 1]
                    assert goes_on[at] == (i + 1 < len(text) and expected[i + 1] == n + 1)
                    assert sorted(a.occurrences(state[at])) == [(t, e) for t, x in enumerate(templates) for e in range(n, len(x) + 1) if x[e - n : e] == run]


def test_chains_by_enumeration():
    """The best chain covers as much as the best of all sequences of matches."""
    rng = random.Random(5)

    def covered(seq, gap):
        total = seq[0][2]
        for (a, b, m), (s, t, n) in zip(seq, seq[1:], strict=False):
            over = max(0, a + m - s, b + m - t)
            if b >= t or over >= n or s - a - m > gap or t - b - m > gap:
                return -1
            total += n - over
        return total

    for _ in range(200):
        matches = sorted({(rng.randint(0, 25), rng.randint(0, 25), rng.randint(2, 5)) for _ in range(rng.randint(1, 7))})
        gap = rng.randint(0, 6)
        best = max(covered([m for i, m in enumerate(matches) if mask >> i & 1], gap) for mask in range(1, 2 ** len(matches)))
        got = license_scan.chains(matches, gap)
        assert max(c for _, _, c in got) == best
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


def test_licences_by_hand(spark):
    mit = dict((name, text) for name, text in license_scan.TEMPLATES if name == "mit" and text.startswith("Permission"))["mit"]
    broken = mit.replace("without limitation the rights", "with no limit on rights")
    rows = [
        (0, "Some words. Licensed under CC BY-NC 4.0. More", "cc-by,cc-by-nc-4.0", 1),
        (1, "This work is licensed under the GNU General Public License, version 3", "gpl,gpl-3.0", 1),
        (2, "licensed under the GNU General Public License", "gpl", 1),
        (3, "All rights reserved. all RIGHTS reserved, all rights, reserved", "reserved", 3),
        (4, f"before {broken} after", "mit", 0),
        (5, "Released under the MIT License", "mit", 0),
        (6, "by cc and general public licenses; rights reserved all", "", 0),
        (7, "cc by cc by", "cc-by", 2),
    ]
    found = license_scan.scan(spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string"))
    got = {r.doc_id: r for r in found.select("*", license_scan.labels("places", "spans").alias("labels")).collect()}
    for i, text, named, places in rows:
        assert (got[i].labels, len(got[i].places), got[i].n_words) == (named, places, len(words(text))), i
    assert [(s.start, s.end) for s in got[4].spans] == [(1, 1 + len(words(broken)))]
    assert 0.9 < got[4].spans[0].share < 1 and got[4].score == got[4].spans[0].share
    assert got[6].score == 0.0 and got[2].score == 1.0 and [p.start for p in got[7].places] == [0, 2]


def test_license_query_against_plain_search(spark):
    """Base places of every text by a scan of its words."""
    docs = small_docs(spark)
    got = {r.doc_id: r for r in Q.op11_license_scan(spark, D).collect()}
    phrases = [(name, words(p)) for name, p in license_scan.PHRASES]
    for r in docs.collect():
        w = words(r.text)
        at = sorted((i, name) for name, p in phrases for i in range(len(w)) if w[i : i + len(p)] == p)
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert g.base_labels == ",".join(sorted({n for _, n in at})) and set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(","))
        assert 0 <= g.score <= 1 and (not at or g.score == 1)
    assert any("mit" in r.labels or "apache-2.0" in r.labels for r in Q.op11_license_scan(spark, "/root/testdata/sf0.01").select("labels").collect())


def test_licences_of_odd_rows(spark):
    odd = odd_docs(spark)
    assert license_scan.scan(odd).count() == len(ODD)
    clash = odd.withColumn("places", F.lit(1)).withColumn("__c0", F.lit("x"))
    out = license_scan.scan(clash)
    assert len(out.columns) == len(set(out.columns)) and {"score", "places", "__c0", "key"} <= set(out.columns)
    assert license_scan.scan(odd.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "of the license " * 60_000 + "all rights reserved")], "doc_id long, text string")
    assert license_scan.scan(long).first().places[0].start == 180_000
    none = license_scan.scan(odd, phrases=(), templates=(("a", "tab and space"),)).filter(F.size("spans") > 0).collect()
    assert [s.label for r in none for s in r.spans] == []  # three words are no long match
    with pytest.raises(ValueError):
        license_scan.scan(odd, templates=(("a", "..."),))


# -- vector codes


def naive_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted((r for r in rows if r[2] and all(x is not None and math.isfinite(x) for x in r[2])), key=lambda r: (r[0] is None, r[0], r[2]))
    kept = [(i, lab, [math.floor(4096 * x) for x in v]) for i, lab, v in kept]
    w = len(kept[0][2]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(col) // len(groups[k]) for col in zip(*groups[k], strict=True)] if groups[k] else e for k, e in enumerate(books[p])]
    out = []
    for (i, lab, _), c in zip(kept, cut, strict=True):
        best = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in best), min(sum(d for d, _ in best), vector_codes.LARGEST)))
    total = Counter()
    for r in out:
        total[r[1]] += r[3]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((*r, min(total[r[1]], vector_codes.LARGEST), digest) for r in out), key=str)


def coded(spark, rows, block=None, monkeypatch=None, **how):
    if block:
        monkeypatch.setattr(vector_codes, "BLOCK", block)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    out = vector_codes.codes(df, **how)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("scale", [1.0, 1e-3, 3e5, 1e30])
def test_codes_against_plain_rounds(spark, monkeypatch, scale):
    """Also where numbers need Python's integers, with repeated rows and ids, null labels and vectors that are dropped."""
    rng = random.Random(7)
    rows = [(i // 2, rng.choice([None, 1, 2]), [rng.choice([-1, 1]) * round(rng.random(), 2) * scale for _ in range(16)]) for i in range(90)]
    rows += [rows[5], rows[5], (None, 1, rows[3][2])]
    odd = [(500, 1, None), (501, 1, [None] * 16), (502, 1, [float("nan")] * 16), (503, None, [float("inf")] + [0.0] * 15), (504, 1, [])]
    assert coded(spark, rows + odd, 7, monkeypatch) == naive_codes(rows)


def test_few_and_no_vectors(spark):
    few = [(3, 1, [0.5] * 8), (1, 1, [-0.00001] * 8), (2, 2, [0.25] * 8)]
    got = coded(spark, few)
    assert got == naive_codes(few) and [r[2] for r in got] == ["00" * 8, "01" * 8, "02" * 8]
    assert coded(spark, [(1, 1, None)]) == []
    assert len(coded(spark, [*few, (4, 1, [0.1] * 7)])) == 3  # another length
    uneven = coded(spark, [(i, 0, [float(i)] * 10) for i in range(20)], entries=2, rounds=1)
    assert len(uneven) == 20 and all(len(r[2]) == 16 for r in uneven)


def test_no_round_depends_on_tasks(spark):
    df = spark.read.parquet(f"{D}/embeddings.parquet").withColumn("extra", F.lit(1)).withColumn("id", F.lit("x"))
    one, many = (sorted(map(tuple, vector_codes.codes(df.repartition(n)).collect())) for n in (1, 7))
    assert one == many


# -- periodic runs


def naive_runs(w, least, times):
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            x = w[i : j + q]
            if len(x) >= max(least, times * q) and not any(all(x[k] == x[k + p] for k in range(len(x) - p)) for p in range(1, q)):
                out.append((i, len(x), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def naive_collapse(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (4, 3), (1, 5)])
def test_runs_against_all_periods(least, times):
    rng = random.Random(11)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, kinds = rng.randint(0, 60), rng.randint(1, 4)
            w = [rng.choice("abcd"[:kinds]) for _ in range(n)]
            if n and rng.random() < 0.5:
                s, p = rng.randrange(n), rng.randint(1, 9)
                part = w[s : s + p]
                w = w[:s] + [part[i % len(part)] for i in range(n - s)]
            texts.append(w)
        runs, collapsed = periodic._runs_of([" ".join(w).encode() for w in texts], least, times)
        for w, r, c in zip(texts, runs, collapsed, strict=True):
            expected = naive_runs(w, least, times)
            assert [tuple(x) for x in r] == expected
            assert c.decode() == naive_collapse(w, expected)


def test_smaller_halves_do_the_work():
    """Places handled in all steps stay below n log n on texts with many equal factors."""
    a, b = "a", "ab"
    for _ in range(16):
        a, b = b, b + a  # a Fibonacci word
    handled = 0
    whole = periodic.Classes(np.array([ord(x) for x in b] + [-1]), 2, len(b) // 2)
    while whole.length < whole.deepest:
        handled += len(whole.small)
        whole.refine()
    assert handled < 3 * len(b) * math.log2(len(b))


def test_runs_query_equals_its_sql_and_python(spark):
    cols, rows = oracle.rows_of(Q.op13_periodic_runs(spark, D))
    assert (cols, rows) == oracle.rows_of_sql(Q.ORACLES["op13_periodic_runs"], D)
    got = {r.doc_id: r for r in Q.op13_periodic_runs(spark, D).collect()}
    some = 0
    for r in small_docs(spark).collect():
        w = re.findall("[^\x20\x09-\x0d]+", r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = naive_runs(w, 6, 4)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        x = got[r.doc_id]
        assert (x.n_runs, x.start, x.length, x.period, x.exponent_milli) == (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(naive_collapse(w, runs).encode()).hexdigest()
        some += bool(runs)
    assert some > 5


def test_runs_of_odd_rows(spark):
    odd = odd_docs(spark)
    clash = odd.withColumn("runs", F.lit(1)).withColumn("__c1", F.lit("x"))
    out = periodic.runs(clash)
    assert out.count() == len(ODD) and len(out.columns) == len(set(out.columns)) and "__c1" in out.columns
    by_text = {r.text: r for r in out.collect()}
    assert by_text[None].collapsed == "" and by_text[None].runs == [] and by_text[ODD[8]].collapsed == ODD[8].replace("\t", " ")
    assert periodic.runs(odd.limit(0)).count() == 0
    long = " ".join(f"w{i % 5_000}" for i in range(30_000)) + " x" * 50_000
    row = periodic.runs(spark.createDataFrame([(1, long)], "doc_id long, text string")).select("*", periodic.strongest().alias("best")).first()
    assert [tuple(r) for r in row.runs] == [(0, 30_000, 5_000), (30_000, 50_000, 1)] and tuple(row.best) == (30_000, 50_000, 1)
    with pytest.raises(ValueError):
        periodic.runs(odd, times=1)


def test_a_null_id_is_dealt_nothing(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, ""), (1, " ")], "doc_id long, text string")
    assert [r[0] for r in df.select(periodic.repeated_tail(F.col("text"), F.col("doc_id"))).collect()] == ["a b c", "", " "]


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_periodic_runs"])
def test_query_equals_its_sql(spark, name):
    cols, rows = oracle.rows_of(Q.QUERIES[name](spark, "/root/testdata/sf0.01"))
    assert (cols, rows) == oracle.rows_of_sql(Q.ORACLES[name], "/root/testdata/sf0.01")
