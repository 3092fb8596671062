"""Similarity self-join on word n-grams with Bayesian candidate pruning (operator 9).

Texts are sets of hashed 5-word shingles; a link joins two different texts of
Jaccard similarity 0.8 or more. Equal texts are one text with a membership, so
copies are never paired. The steps:

1. MinHash signatures of the distinct texts, and bands of them. Texts that share
   a band key are candidates; a list of n texts gives n - 1 edges to its least.
2. Components of those edges hold every candidate pair. Their texts are dealt
   to tasks: small components together, larger ones by pairs of blocks of about
   BLOCK texts or WEIGHT shingles, so a task holds two blocks at most and no pair
   is a row. A component of more than WIDE blocks (texts that a chain of chance
   meetings joins) is not compared as a whole: each band list in it is a group
   of its own, cut in blocks likewise, and a link counts in the first list that
   its pair shares. So in each of its band lists a text is copied once for each
   block of the list, and a pair is compared in every list that it shares.
3. In a task, MinHash values are compared ROW at a time over all pairs still
   open. With a uniform prior the posterior of similarity s after m of n matches
   is Beta(m + 1, n - m + 1); a pair is dropped as soon as P(s >= 0.8) falls
   below TOLERANCE. The rest is verified on the sets themselves.
4. A task returns link counts by text and a spanning forest of its links, so
   results stay linear in texts. Components of the forests are the classes.

Chance of missing a link of similarity exactly 0.8: about 2e-5 by the bands (both
arrangements regroup the same values, so their misses go together) and
about TOLERANCE for each of 7 comparisons by the pruning; it falls fast above 0.8.

Texts of fewer than 5 words have one shingle, all their words; null texts count
as empty; texts without words have no shingles and only equal ones form a class.
Repeated rows are copies. A null doc_id is a document like any other (it cannot
name a class unless all its members have none). Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship, text_or_empty, tidy, tidy_batches
from .components import components
from .words import Words, batch_parts, raw_texts

SHINGLE = 5
#: Similarity as a fraction.
SIMILAR = (4, 5)
#: MinHash values of a band, bands of one arrangement, arrangements.
ROW, BANDS, ARRANGEMENTS = 7, 28, 2
VALUES = ROW * BANDS
#: Posterior probability of similarity below which a pair is dropped; values compared at a time.
TOLERANCE, STEP = 1e-7, 28
#: Texts and shingles of a block, blocks from which a component is compared by band lists, and blocks' worth of small components in a task.
BLOCK, WEIGHT, WIDE, TASK = 1024, 600_000, 48, 0.5
#: Shingles of partners that are looked up together.
SHINGLES_AT_ONCE = 500_000

_rng = np.random.default_rng(99)
_FACTOR = _rng.integers(1, 2**63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = _rng.integers(0, 2**63, VALUES, np.uint64)
#: Byte offsets of the values of each band: adjacent ones, then strided ones.
ARRANGED = [[[b * ROW + r for r in range(ROW)] for b in range(BANDS)], [[r * BANDS + b for r in range(ROW)] for b in range(BANDS)]][:ARRANGEMENTS]


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, one after another and sorted in each, and the texts' bounds."""
    w = Words(texts)
    n = np.diff(w.bounds)
    few = (n > 0) & (n < SHINGLE)
    at = w.shingles(SHINGLE)
    position = np.arange(len(at))
    text = np.searchsorted(w.bounds, position, "right") - 1
    inside = position + SHINGLE <= w.bounds[text + 1] if len(at) else np.zeros(0, bool)
    values, owner = [at[inside]], [text[inside]]
    for k in range(1, SHINGLE):
        some = np.flatnonzero(few & (n == k))
        if len(some):
            values.append(w.shingles(k)[w.bounds[some]])
            owner.append(some)
    value, of = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[new], of[new]
    return value, np.searchsorted(of, np.arange(len(texts) + 1))


def all_shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same for any number of texts, cut a chunk at a time."""
    values, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for part in batch_parts(pa.RecordBatch.from_arrays([texts], ["text"]), 0):
        value, bounds = shingle_sets(raw_texts(part.column(0)))
        values.append(value)
        sizes.append(np.diff(bounds))
    return np.concatenate(values), np.cumsum(np.concatenate(sizes))


def signatures(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """texts x VALUES; of texts without shingles all ones."""
    out = np.full((len(bounds) - 1, VALUES), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        for k in range(VALUES):
            out[some, k] = np.minimum.reduceat((value ^ _MASK[k]) * _FACTOR[k], bounds[:-1][some]) >> np.uint64(32)
    return out


def least_matches(tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n compared values, the matches from which P(similarity >= 0.8) is `tolerance` or more: P(Bin(n + 1, 0.8) <= m)."""
    s = SIMILAR[0] / SIMILAR[1]
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
        out[n] = m
    return out


def similar_pairs(sig: np.ndarray, compact: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray, least: dict[int, int], mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs between rows `left` and rows `right`; if both are the same, each pair once. `compact`: the rows' shingles as small numbers; `mark`: a false for each of those."""
    same = left is right
    size = np.diff(bounds)
    i_all, j_all = [], []
    for lo in range(0, len(left), 256):
        rows = left[lo : lo + 256]
        if len(rows) * len(right) <= 4096:
            match = (sig[rows, None, :STEP] == sig[None, right, :STEP]).sum(2)
        else:
            match = np.zeros((len(rows), len(right)), np.int16)
            for k in range(STEP):
                match += sig[rows, k][:, None] == sig[right, k][None, :]
        i, j = np.nonzero(match >= least[STEP])
        m = match[i, j].astype(np.int64)
        i, j = i + lo, j
        if same:
            m, i, j = m[i < j], i[i < j], j[i < j]
        i, j = left[i], right[j]
        # Sizes bound the similarity from above.
        fits = (np.minimum(size[i], size[j]) * SIMILAR[1] >= np.maximum(size[i], size[j]) * SIMILAR[0]) & (size[i] > 0)
        i, j, m = i[fits], j[fits], m[fits]
        for n in range(STEP, VALUES, STEP):
            for part in range(0, len(i), 1 << 16):
                s = slice(part, part + (1 << 16))
                m[s] += (sig[i[s], n : n + STEP] == sig[j[s], n : n + STEP]).sum(1)
            open_ = m >= least[n + STEP]
            i, j, m = i[open_], j[open_], m[open_]
        i_all.append(i)
        j_all.append(j)
    i, j = np.concatenate(i_all), np.concatenate(j_all)
    if not len(i):
        return i, j
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    keep = np.zeros(len(i), bool)
    cuts = np.flatnonzero(np.diff(i)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(i)], strict=True):
        own = compact[bounds[i[a]] : bounds[i[a] + 1]]
        mark[own] = True
        at_once = np.cumsum(size[j[a:b]]) // SHINGLES_AT_ONCE
        for lo, hi in zip(a + np.flatnonzero(np.diff(at_once, prepend=-1)), a + np.append(np.flatnonzero(np.diff(at_once)) + 1, b - a), strict=True):
            js = j[lo:hi]
            lengths = size[js]
            at = np.repeat(bounds[js] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            common = np.add.reduceat(mark[compact[at]].astype(np.int64), np.cumsum(lengths) - lengths)
            keep[lo:hi] = common * SIMILAR[1] >= (len(own) + lengths - common) * SIMILAR[0]
        mark[own] = False
    return i[keep], j[keep]


def first_common_band(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of the first band that is the same in both rows of each pair; the number of bands if none is."""
    out = np.full(len(i), ARRANGEMENTS * BANDS)
    for lo in range(0, len(i), 1 << 14):
        same = sig[i[lo : lo + (1 << 14)]] == sig[j[lo : lo + (1 << 14)]]
        for n in reversed(range(ARRANGEMENTS * BANDS)):
            out[lo : lo + (1 << 14)][same[:, ARRANGED[n // BANDS][n % BANDS]].all(1)] = n
    return out


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[ra] = rb
            out.append((a, b))
    return out


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met: set[bytes] = set()
    for batch in batches:
        new = []
        for n, key in enumerate(batch.column(0).to_pylist()):
            if key not in met:
                met.add(key)
                new.append(n)
        if new:
            yield batch.take(pa.array(new, pa.int64()))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _first_of_task(batches):
        for part in batch_parts(batch, 1):
            value, bounds = shingle_sets(raw_texts(part.column(1)))
            sig = signatures(value, bounds)
            size = np.diff(bounds)
            some = np.flatnonzero(size)
            keys = part.column(0).take(pa.array(some))
            yield pa.RecordBatch.from_arrays([keys, pa.array([sig[s].tobytes() for s in some], pa.binary()), pa.array(size[some], pa.int64())], ["key", "sig", "size"])


def _link(table: pa.Table) -> pa.Table:
    """One task: its texts, by group (a component or a band list) and side (0: pairs within, 1 and 2: pairs across)."""
    table = table.select(["key", "group", "side", "band", "sig", "text"]).combine_chunks()
    group, side, band = (table.column(c).to_numpy() for c in ("group", "side", "band"))
    # A text may stand in several band lists of a task, and copies of it come from several map tasks.
    keys, places = [], np.zeros(table.num_rows, np.int64)
    first: dict[bytes, int] = {}
    for n, key in enumerate(table.column("key").to_pylist()):
        if key not in first:
            first[key] = len(keys)
            keys.append(n)
        places[n] = first[key]
    once = table.take(pa.array(keys, pa.int64()))
    del table
    keys = list(first)
    sig = np.frombuffer(b"".join(once.column("sig").to_pylist()), np.uint32).reshape(-1, VALUES)
    texts = once.column("text").cast(pa.binary()).combine_chunks()
    del once, first
    value, bounds = all_shingle_sets(texts)
    del texts
    names, compact = np.unique(value, return_inverse=True)
    del value
    shared = compact, bounds
    least, mark = least_matches(), np.zeros(len(names), bool)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    order = np.lexsort((side, group))
    cuts = np.flatnonzero(np.diff(group[order], prepend=group[order[0]] - 1, append=group[order[-1]] + 1)) if len(order) else []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[lo:hi]
        sides = [np.unique(places[rows[side[rows] == k]]) for k in (0, 1, 2)]
        left, right = (sides[0], sides[0]) if len(sides[0]) else sides[1:]
        if not len(left) or not len(right):
            continue
        pair = similar_pairs(sig, *shared, left, right, least, mark)
        if band[rows[0]] >= 0:
            own = first_common_band(sig, *pair) == band[rows[0]]
            pair = pair[0][own], pair[1][own]
        found.append(pair)
    i, j = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    n = np.bincount(i, minlength=len(keys)) + np.bincount(j, minlength=len(keys))
    some = np.flatnonzero(n)
    edges = _forest(len(keys), i, j)
    return pa.table(
        {
            "a": pa.array([keys[k] for k in some] + [keys[a] for a, _ in edges], pa.binary()),
            "b": pa.array([None] * len(some) + [keys[b] for _, b in edges], pa.binary()),
            "n": pa.array(n[some].tolist() + [None] * len(edges), pa.int64()),
        }
    )


def text_key(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(text))


def _bands(sig: str = "sig") -> Column:
    """Keys of the bands, from the signature's bytes."""
    out = []
    for arrangement, bands in enumerate(ARRANGED):
        for b, places in enumerate(bands):
            if arrangement == 0:
                value = F.substring(sig, places[0] * 4 + 1, 4 * ROW)
            else:
                value = F.concat(*(F.substring(sig, p * 4 + 1, 4) for p in places))
            out.append(F.xxhash64(value, F.lit(arrangement * BANDS + b)))
    return F.array(*out)


def _dealt(members: DataFrame, tasks: int) -> DataFrame:
    """Rows (name, group, load in blocks, band) with their task and side: small groups together in `tasks` tasks, larger ones by pairs of blocks."""
    blocks = F.when(F.col("load") <= 1, 1).otherwise(F.ceil(F.col("load") * 4 / 3)).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    # A text meets its own block (side 0) and each other block (sides 1 and 2) once.
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first, second = F.least("own", "other"), F.greatest("own", "other")
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(tasks))).otherwise(F.xxhash64("group", first, second))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return placed.select("name", "group", "band", (F.col("blocks") > 1).alias("large"), task.alias("task"), side.alias("side"))


def text_links(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, n_links) of the texts that have links, and (node, root) of their classes; both by the text's key."""
    ship(docs.sparkSession)
    keyed = docs.select(text_key(text_or_empty(text)).alias("key"), text_or_empty(text).alias("text"))
    signed = keyed.mapInArrow(tidy_batches(_sign), "key binary, sig binary, size bigint").groupBy("key").agg(F.max("sig").alias("sig"), F.max("size").alias("size"))
    signed = materialise(signed, "signatures")
    # Candidates are named by 64 bits of their key: two texts with one name would only be compared in vain.
    named = signed.select(F.xxhash64("key").alias("name"), "size", F.posexplode(_bands()).alias("place", "band"))
    postings = named.select("name", "band")
    lists = materialise(postings.groupBy("band").agg(F.min("name").alias("least"), F.count("*").alias("n")).filter("n > 1").select("band", "least"), "band-lists")
    edges = postings.join(lists, "band").select(F.col("name").alias("a"), F.col("least").alias("b"))
    grouped = components(edges, "candidates")
    sized = grouped.join(signed.select(F.xxhash64("key").alias("node"), "size"), "node")
    # A group's blocks, by texts or by shingles, whichever needs more.
    load = F.greatest(F.count("*") / BLOCK, F.sum("size") / WEIGHT)
    sizes = materialise(sized.groupBy("root").agg(load.alias("load")), "component-sizes")
    totals = sizes.agg(F.coalesce(F.sum(F.when(F.col("load") <= 1, F.col("load"))), F.lit(0.0)).alias("small"), F.coalesce(F.max("load"), F.lit(0.0)).alias("most")).first()
    tasks = int(totals.small / TASK) + 1
    placed = _dealt(grouped.join(sizes.filter(F.col("load") <= WIDE), "root").select(F.col("node").alias("name"), F.col("root").alias("group"), "load", F.lit(-1).alias("band")), tasks)
    if totals.most > WIDE:
        wide = grouped.join(sizes.filter(F.col("load") > WIDE).select("root"), "root").select(F.col("node").alias("name"))
        entries = named.join(wide, "name").join(lists.select("band"), "band").select("name", F.col("band").alias("group"), "size", F.col("place").alias("band"))
        entries = materialise(entries, "wide-lists")
        of_list = materialise(entries.groupBy("group", "band").agg(load.alias("load")), "wide-list-sizes")
        many = of_list.agg(F.sum(F.when(F.col("load") <= 1, F.col("load")))).first()[0] or 0.0
        placed = placed.union(_dealt(entries.join(of_list, ["group", "band"]).select("name", "group", "load", "band"), int(many / TASK) + 1))
    placed = materialise(placed, "tasks")
    wanted = signed.join(placed.select("name").distinct(), F.xxhash64("key") == F.col("name")).select("key", "name", "sig")
    # Merged whatever the size: the texts' side is large, and the candidates grow with it.
    texts = keyed.mapInArrow(tidy_batches(_first_of_task), keyed.schema).join(wanted.hint("merge"), "key")
    rows = texts.join(placed, "name")
    linked = materialise(rows.groupBy("large", "task").applyInArrow(tidy(_link), "a binary, b binary, n bigint"), "links")
    counts = linked.filter(F.col("b").isNull()).groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n_links"))
    return counts, components(linked.filter(F.col("b").isNotNull()), "classes")


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, class_id (least doc_id of the class), n_links (linked different texts), n_copies (other rows with the same text) for each row."""
    counts, nodes = text_links(docs, text)
    rows = docs.select("doc_id", text_key(text_or_empty(text)).alias("key"))
    nodes = nodes.select(F.col("node").alias("key"), "root")
    texts = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    texts = texts.join(nodes, "key", "left").join(counts, "key", "left")
    texts = materialise(texts.select("key", F.coalesce("root", "key").alias("root"), "first", "rows", F.coalesce("n_links", F.lit(0)).alias("n_links")), "text-classes")
    roots = materialise(texts.groupBy("root").agg(F.min("first").alias("class_id")), "roots")
    of = materialise(texts.join(roots, "root").select("key", "class_id", "n_links", (F.col("rows") - 1).alias("n_copies")), "class-of-text")
    return rows.join(of, "key").select("doc_id", "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class, with its own columns: that of the least doc_id (nulls last), of equals the one with the least text key; of repeated rows one."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    text, doc_id = names[docs.columns.index("text")], names[docs.columns.index("doc_id")]
    _, nodes = text_links(rows, text)
    keyed = rows.withColumn("key", text_key(text_or_empty(text)))
    nodes = nodes.select(F.col("node").alias("key"), "root")
    order = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col("key").alias("key"))
    # The least row of each text first: a hot text is one row from each map task.
    texts = keyed.select(doc_id, "key").groupBy("key").agg(F.min(order).alias("best"))
    best = texts.join(nodes, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("best").alias("best"))
    chosen = best.select("best.id", "best.key")
    same = F.col(doc_id).eqNullSafe(F.col("id"))
    many = keyed.groupBy(F.col(doc_id).alias("id"), "key").agg(F.count("*").alias("rows")).filter("rows > 1")
    chosen = materialise(chosen.join(many, (chosen["key"] == many["key"]) & chosen["id"].eqNullSafe(many["id"]), "left").select(chosen["id"], chosen["key"], (F.coalesce("rows", F.lit(1)) > 1).alias("repeated")), "chosen")
    kept = keyed.join(chosen.withColumnRenamed("key", "chosen_key"), (F.col("key") == F.col("chosen_key")) & same)
    once = kept.filter(~F.col("repeated")).select(*names)
    repeated = kept.filter("repeated").dropDuplicates([doc_id, "key"]).select(*names)
    return once.union(repeated).toDF(*docs.columns)
