"""Periodic runs of words by partition refinement (operator 13).

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends, of at least `least` words and `times` periods. The
method is Crochemore's: places of a text are classed by the factor (words in
sequence) of length k that begins there, and the classes of length k + 1 come
from those of length k by splitting each by the classes of the places one word
on. A class that was split in the step before splits others by all its parts
but the largest one, so each place takes part in a logarithmic number of steps.
Where neighbouring members of a class of length k are k places apart, a factor
is followed by itself: a square with a primitive root. Squares of one length at
consecutive places are one run, which is as long as they reach.

Every place of a run of `times` periods or more is in a class of times - 1 or
more members until k passes the period, so smaller classes are dropped as they
arise. What is left of ordinary prose after a few steps is nothing.

Texts of a task are refined together, in parts of CHUNK bytes, as one sequence
with a mark between texts; a class never holds places of two texts. A text is
never cut: one beyond CHUNK is a part of its own and takes some 80 bytes a word.
Documents are not shuffled, so neither copies nor hot sources gather anywhere.

Words are `[^\\x20\\x09-\\x0D]+`. Null, empty and blank texts have no words, no
runs and an empty collapsed text. Repeated rows come out as often as they went
in. Columns of the input stay; `runs` and `collapsed` replace columns of those
names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, text_or_empty, tidy_batches

#: Bytes of texts refined together.
CHUNK = 4_000_000

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _bounds(keys: np.ndarray) -> np.ndarray:
    """Where each stretch of equal keys begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from first[i] on, size[i] of them, for each i."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Classes:
    """Places by equal factors of a length that grows by one at each `refine`.

    `kind` is a place's class, or -1. Members of a class lie together in `member`, at `slot`; `after` and `before` link them in the order of the text.
    """

    def __init__(self, words: np.ndarray, fewest: int, deepest: int):
        """words: a number for each word, -1 for a mark. fewest: smaller classes are dropped. deepest: the last length asked for."""
        n = len(words)
        self.fewest, self.deepest, self.length = fewest, deepest, 1
        order = np.argsort(words, kind="stable")
        first = _bounds(words[order])
        size = np.diff(np.append(first, n))
        kept = (size >= fewest) & (words[order[first]] >= 0)
        self.member = order[np.repeat(kept, size)]
        self.size = size[kept]
        self.first = np.cumsum(self.size) - self.size
        self.classes = len(self.size)
        self.kind, self.slot, self.after, self.before = (np.full(n, -1, np.int64) for _ in range(4))
        self.kind[self.member] = np.repeat(np.arange(self.classes), self.size)
        self.slot[self.member] = np.arange(len(self.member))
        self.moving = np.zeros(n, bool)
        self.due: dict[int, list[np.ndarray]] = defaultdict(list)
        self._link(self.member, self.kind[self.member])
        self.small = np.arange(n)

    def _link(self, places: np.ndarray, of: np.ndarray) -> None:
        """Places, ascending within each class, become lists of their own."""
        same = of[1:] == of[:-1]
        a, b = places[:-1][same], places[1:][same]
        self.after[places] = self.before[places] = -1
        self.after[a], self.before[b] = b, a
        self._expect(a)

    def _expect(self, places: np.ndarray) -> None:
        """Places whose distance to the next member has changed are looked at again when the length gets there."""
        gap = self.after[places] - places
        ahead = (gap >= self.length) & (gap <= self.deepest)
        places, gap = places[ahead], gap[ahead]
        order = np.argsort(gap, kind="stable")
        places, gap = places[order], gap[order]
        for k, own in zip(gap[at := _bounds(gap)].tolist(), np.split(places, at[1:]), strict=False):
            self.due[k].append(own)

    def squares(self) -> np.ndarray:
        """Places, ascending, where a factor of the present length is followed by itself."""
        found = self.due.pop(self.length, None)
        if found is None:
            return np.zeros(0, np.int64)
        places = np.unique(np.concatenate(found))
        return places[(self.kind[places] >= 0) & (self.after[places] - places == self.length)]

    def refine(self) -> None:
        """From the classes of the present length to those of the next."""
        self.length += 1
        at = self.small[self.small > 0] - 1
        at = at[self.kind[at] >= 0]
        at = at[np.argsort(self.kind[at] * len(self.kind) + at)]
        while True:  # a second time without classes that move as one, since these stay as they are
            touched_at = _bounds(self.kind[at])
            moved = np.diff(np.append(touched_at, len(at)))
            touched = self.kind[at[touched_at]]
            rank = np.repeat(np.arange(len(touched)), moved)
            left = self.size[touched] - moved
            key = rank * (self.classes + 1) + self.kind[at + 1] + 1
            grouped = np.argsort(key, kind="stable")
            group_at = _bounds(key[grouped])
            group_size = np.diff(np.append(group_at, len(at)))
            group_rank = rank[grouped[group_at]]
            lives = (group_size >= self.fewest) & (self.kind[at[grouped[group_at]] + 1] >= 0)
            whole = np.zeros(len(touched), bool)
            whole[group_rank[lives]] = group_size[lives] == self.size[touched[group_rank[lives]]]
            if not whole.any():
                break
            at = at[~whole[rank]]
        if not len(at):
            self.small = at
            return
        self._unlink(at)
        places = at[grouped]
        slots = self._move_last(at, places, touched, moved, left, rank)
        ids = np.full(len(group_at), -1, np.int64)
        ids[lives] = self._new(slots[group_at[lives]], group_size[lives])
        self.kind[places] = np.repeat(ids, group_size)
        self.size[touched] = left
        gone = (left > 0) & (left < self.fewest)
        rest = self.member[_ranges(self.first[touched[gone]], left[gone])]
        self.kind[rest] = -1
        self.size[touched[gone]] = 0
        alive = np.repeat(lives, group_size)
        self._link(places[alive], self.kind[places[alive]])
        # All parts of a class but the largest are small.
        best = np.lexsort((-group_size, group_rank))
        best = best[lives[best]]
        best = best[_bounds(group_rank[best])]
        best = best[group_size[best] > left[group_rank[best]]]
        spared = np.zeros(len(group_at), bool)
        spared[best] = True
        behind = group_rank[best][left[group_rank[best]] >= self.fewest]
        self.small = np.concatenate([places[np.repeat(~spared, group_size)], rest, self.member[_ranges(self.first[touched[behind]], left[behind])]])

    def _unlink(self, at: np.ndarray) -> None:
        """Take places, ascending within each class, out of their lists."""
        chained = self.after[at[:-1]] == at[1:]
        head, tail = at[np.concatenate([[True], ~chained])], at[np.concatenate([~chained, [True]])]
        p, q = self.before[head], self.after[tail]
        self.after[p[p >= 0]] = q[p >= 0]
        self.before[q[q >= 0]] = p[q >= 0]
        self._expect(p[(p >= 0) & (q >= 0)])

    def _move_last(self, at, places, touched, moved, left, rank) -> np.ndarray:
        """Members that leave go behind those that stay, in the order of `places`; their slots."""
        begins = self.first[touched] + left
        slots = _ranges(begins, moved)
        self.moving[at] = True
        held = self.member[slots]
        held = held[~self.moving[held]]
        self.moving[at] = False
        free = self.slot[at]
        free = free[free < begins[rank]]
        # Of each class as many stay in the last slots as leave from before them.
        self.member[free], self.slot[held] = held, free
        self.member[slots], self.slot[places] = places, slots
        return slots

    def _new(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        ids = np.arange(self.classes, self.classes + len(first))
        self.classes += len(first)
        if self.classes > len(self.size):
            grow = np.zeros(max(self.classes, 2 * len(self.size)) - len(self.size), np.int64)
            self.size, self.first = np.concatenate([self.size, grow]), np.concatenate([self.first, grow])
        self.first[ids], self.size[ids] = first, size
        return ids


def find(words: np.ndarray, longest: int, least: int, times: int) -> np.ndarray:
    """Rows (place, length, period) of all runs, by place, then period. words: numbers, each text's its own, -1 between texts; longest: words of the longest text."""
    deepest = longest // times
    out = [np.zeros((0, 3), np.int64)]
    if deepest and len(words):
        classes = Classes(words, max(2, times - 1), deepest)
        while True:
            places = classes.squares()
            if len(places):
                begin = np.flatnonzero(np.concatenate([[True], np.diff(places) > 1]))
                first, last = places[begin], places[np.append(begin[1:], len(places)) - 1]
                length = last - first + 2 * classes.length
                runs = np.column_stack([first, length, np.full(len(first), classes.length)])
                out.append(runs[length >= max(least, times * classes.length)])
            if classes.length >= deepest or not (len(classes.small) or classes.due):
                break
            classes.refine()
    found = np.concatenate(out)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapse(words: list[bytes], runs: list[list[int]]) -> bytes:
    """The words outside runs and those of each run's first period that no other run drops, joined by spaces."""
    if runs:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            drop[start + period] += 1
            drop[start + length] -= 1
        kept = np.cumsum(drop)[:-1] == 0
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


def _runs_of(texts: list[bytes], least: int, times: int) -> tuple[list[list[list[int]]], list[bytes]]:
    """Runs and collapsed text of each text."""
    numbers, cut, ids, bounds = count(), [], [], [0]
    for text in texts:
        # Without an argument bytes are split at runs of exactly the bytes \x20 and \x09-\x0D.
        words = text.split()
        own: defaultdict[bytes, int] = defaultdict(numbers.__next__)
        cut.append(words)
        ids.append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)))
        ids.append(np.array([-1], np.int64))
        bounds.append(bounds[-1] + len(words) + 1)
    found = find(np.concatenate(ids), max(map(len, cut)), least, times)
    at = np.searchsorted(found[:, 0], bounds)
    runs = []
    for k, words in enumerate(cut):
        own_runs = found[at[k] : at[k + 1]]
        runs.append((own_runs - [bounds[k], 0, 0]).tolist() if len(own_runs) else [])
    return runs, [collapse(w, r) for w, r in zip(cut, runs, strict=True)]


def _task(names: list[str], text: int, least: int, times: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Texts of like length together: the steps of a part are as many as its longest text needs.
            sizes = np.asarray(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False))
            order = np.argsort(sizes, kind="stable")
            part = np.cumsum(sizes[order] + 1) // CHUNK
            for own in np.split(order, _bounds(part)[1:]) if len(order) else ():
                rows = batch.take(pa.array(own))
                runs, collapsed = _runs_of(rows.column(text).cast(pa.binary()).to_pylist(), least, times)
                listed = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], kind)
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(names))), listed, pa.array(collapsed, pa.binary()).cast(pa.string())], [*names, "__runs", "__collapsed"])

    return tidy_batches(run)


def runs(docs: DataFrame, text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """All columns of `docs`, with runs (start, length and period in words, by start, then period) and collapsed, the text with one period left of each run."""
    if times < 2 or least < 1:
        raise ValueError("a run has two periods or more, and a word")
    ship(docs.sparkSession)
    # Input columns are renamed by position, so that none can clash with the new ones.
    names = [f"__c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)
    df = docs.toDF(*names).withColumn("__text", text_or_empty(names[at]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "__text")
    found = df.mapInArrow(_task(names, len(names), least, times), f"{fields}, __runs {RUNS}, __collapsed string")
    own = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in ("runs", "collapsed")]
    return found.select(*own, F.col("__runs").alias("runs"), F.col("__collapsed").alias("collapsed"))


def strongest(runs: Column | str = "runs") -> Column:
    """The run with the greatest exact length / period, of equals the first by start, then period; null without runs."""
    col = F.col(runs) if isinstance(runs, str) else runs
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(col, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def repeated_tail(text: Column, doc_id: Column) -> Column:
    """`text` with its words from number a on replaced by repeats of the p words there, as the query of this operator deals: h = crc32 of the id's digits, g = h div 10; where h mod 10 is 0 and the text has n > 0 words, a = g mod n and p = 1 + (n - a) div (3 + g mod 8)."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    n = F.size(words).cast("long")
    a = F.pmod(g, n)
    p = F.lit(1) + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
    # Arrays are repeated and cut as wholes: inside a lambda the words would be cut again for each element.
    repeats = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), repeats)), F.lit(1), (n - a).cast("int"))
    dealt = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.rlike(r"[^\x20\x09-\x0D]"), dealt).otherwise(text)
