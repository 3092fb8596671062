"""Approximate nearest neighbours by inner product over robust-pruned directed graphs (operator 10).

Vectors are dealt to shards of about SHARD rows by a hash of their id. In each
shard equal vectors are one node. Taking the shard's mean off its vectors adds
the same to all scores of a query, so graphs are built on what is left. Inner
product is no distance: where norms differ, a few long vectors are near to all
queries and a graph over all of them is hard to walk. So a shard is cut into
strata of like norms (within a factor of RATIO, at least LEAST nodes), and each
stratum gets a directed graph: points are
inserted in batches; a greedy search from the entry points proposes neighbours,
relaxed distance pruning keeps at most DEGREE diverse edges, and edges back are
added and pruned the same way. Entries are spread points (each the farthest from
those before it), and a node that no walk reaches becomes one more, so tight
clusters far from each other are all found.

A beam search walks the strata of a shard from the longest vectors down and
leaves out a stratum whose largest norm, times the query's, is below the k-th
score found so far. Everything in the beams is scored in double precision on the
original vectors. Graphs are built on vectors divided by their stratum's largest
norm, so no finite norm overflows.

Queries go to every shard in blocks of at most QUERIES rows, each a task of its
own with a copy of the shard's graph (which is smaller than a full block), so no
task holds more than a shard and a block. The shards' lists are merged by a
window of (k x shards) rows a query.

Vectors that are null, zero, of no components or with a null or non-finite one
take no part, nor do rows with a null id; vectors of another length are never
neighbours. Repeated rows (id and vector) count once. Rows of one id with
different vectors are one neighbour and one query, whose score is the greatest
of their scores. Ties go to the smaller id. Queries with fewer than k candidates
get all of them; empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, ship, tidy

SHARD, QUERIES = 10_000, 32_768
#: Out-edges, beam of the building and of the querying search, relaxation of the pruning.
DEGREE, BUILD_BEAM, BEAM, RELAX = 32, 64, 256, 1.2
#: Nodes expanded at once in a step of a search, queries searched at once.
EXPAND, TOGETHER = 4, 256
#: Norms of a stratum within this factor, nodes of a stratum at least, spread entry points.
RATIO, LEAST, ENTRIES = 1.15, 64, 16


def _search(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int, by_product: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Node ids and distances (or inner products less than 0) of the `beam` nearest found for each row of q, nearest first; -1 where there are fewer."""
    n, m = len(x), len(q)
    beam = min(beam, n)
    norm = np.zeros(n, np.float32) if by_product else np.einsum("ij,ij->i", x, x)
    ids = np.full((m, beam), -1, np.int64)
    dist = np.full((m, beam), np.inf, np.float32)
    open_ = np.zeros((m, beam), bool)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    seen[:, entries] = True
    first = norm[entries] - 2 * (q @ x[entries].T)
    width = min(beam, len(entries))
    best = np.argsort(first, axis=1, kind="stable")[:, :width]
    ids[:, :width], dist[:, :width], open_[:, :width] = entries[best], np.take_along_axis(first, best, 1), True
    act = np.arange(m)
    while len(act):
        some = np.argsort(~open_[act], axis=1, kind="stable")[:, :EXPAND]  # the beam is sorted, so these are the nearest open ones
        took = np.take_along_axis(open_[act], some, 1)
        node = np.where(took, np.take_along_axis(ids[act], some, 1), n)
        open_[act[:, None], some] = False
        near = np.sort(edges[node].reshape(len(act), -1), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[act[:, None], near]] = n
        seen[act[:, None], near] = True
        new = near < n
        at = np.where(new, near, 0)
        d = norm[at] - 2 * np.matmul(x[at], q[act][:, :, None])[:, :, 0]
        d = np.where(new, d, np.inf).astype(np.float32)
        all_d = np.concatenate([dist[act], d], 1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[act] = np.take_along_axis(all_d, order, 1)
        ids[act] = np.take_along_axis(np.concatenate([ids[act], np.where(new, near, -1)], 1), order, 1)
        open_[act] = np.take_along_axis(np.concatenate([open_[act], new], 1), order, 1)
        act = act[open_[act].any(1)]
    return ids, dist


def _prune(x: np.ndarray, of: np.ndarray, cand: np.ndarray, degree: int) -> np.ndarray:
    """For each node of `of`, at most `degree` of its candidates (-1: none), such that none is much nearer to an earlier one."""
    n = len(x)
    cand = np.sort(np.where(cand == of[:, None], -1, cand), axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    v = x[np.maximum(cand, 0)]
    d = np.where(cand >= 0, ((v - x[of][:, None, :]) ** 2).sum(2), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    v = x[np.maximum(cand, 0)]
    sq = (v**2).sum(2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive = cand >= 0
    rows = np.arange(len(of))
    out = np.full((len(of), degree), n, np.int64)
    for k in range(degree):
        pick = alive.argmax(1)
        has = alive[rows, pick]
        if not has.any():
            break
        out[has, k] = cand[rows, pick][has]
        alive[rows, pick] = False
        alive &= ~(has[:, None] & (RELAX**2 * between[rows, pick] <= d))
    return out


def spread(x: np.ndarray, most: int) -> np.ndarray:
    """The point next to the mean, then the farthest from those before, as long as there are different ones."""
    out = [int(((x - x.mean(0)) ** 2).sum(1).argmin())]
    away = ((x - x[out[0]]) ** 2).sum(1)
    while len(out) < min(most, len(x)) and away.max() > 0:
        out.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[out[-1]]) ** 2).sum(1))
    return np.array(out)


def with_unreached(edges: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entries, and one more for each part of the graph that no walk from those before reaches."""
    n = len(edges) - 1
    seen, out, front, next_ = np.zeros(n + 1, bool), entries.tolist(), entries, 0
    seen[n] = True
    while True:
        seen[front] = True
        while len(front):
            front = np.unique(edges[front])
            front = front[~seen[front]]
            seen[front] = True
        rest = np.flatnonzero(~seen[next_:n])
        if not len(rest):
            return np.array(out)
        next_ += int(rest[0])
        out.append(next_)
        front = np.array([next_])


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Edges (n + 1 rows; n stands for none) and the entry points."""
    n = len(x)
    edges = np.full((n + 1, degree), n, np.int64)
    entries = spread(x, ENTRIES)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([entries, order[~np.isin(order, entries)]])
    done = 0
    while done < len(order):
        batch = order[done : done + max(1, min(512, done + 1))]
        found, _ = _search(x, edges, entries, x[batch], beam)
        edges[batch] = _prune(x, batch, found, degree)
        # Edges back, for each target the sources of this batch.
        source = np.repeat(batch, degree)
        target = edges[batch].ravel()
        source, target = source[target < n], target[target < n]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        to, first, count = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(to), 512):
            some, f, c = to[lo : lo + 512], first[lo : lo + 512], count[lo : lo + 512]
            width = int(c.max())
            at = f[:, None] + np.arange(width)
            more = np.where(np.arange(width) < c[:, None], source[np.minimum(at, len(source) - 1)], -1)
            have = np.where(edges[some] < n, edges[some], -1)
            pool = np.concatenate([have, more], 1)
            room = (pool >= 0).sum(1) <= degree
            if room.any():
                packed = -np.sort(-pool[room], axis=1)[:, :degree]
                if packed.shape[1] < degree:
                    packed = np.pad(packed, ((0, 0), (0, degree - packed.shape[1])), constant_values=-1)
                edges[some[room]] = np.where(packed >= 0, packed, n)
            if (~room).any():
                edges[some[~room]] = _prune(x, some[~room], pool[~room], degree)
        done += len(batch)
    return edges, with_unreached(edges, entries)


def mean(v: np.ndarray) -> np.ndarray:
    return (v / len(v)).sum(0)


def norms(v: np.ndarray) -> np.ndarray:
    """Without overflow for any finite vectors; at least the least positive number."""
    most = np.maximum(np.abs(v).max(1), np.finfo(float).tiny)
    return np.maximum(most * np.sqrt(((v / most[:, None]) ** 2).sum(1)), np.finfo(float).tiny)


def strata(norm: np.ndarray) -> np.ndarray:
    """Bounds of the strata in norms that fall."""
    bounds = [0]
    for i in range(1, len(norm)):
        if i - bounds[-1] >= LEAST and norm[i] * RATIO < norm[bounds[-1]]:
            bounds.append(i)
    if len(bounds) > 1 and len(norm) - bounds[-1] < LEAST:
        bounds.pop()
    return np.array([*bounds, len(norm)])


def _unpack(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


_INDEX = "dim int, shard int, node int, stratum int, entry boolean, vector array<double>, members array<bigint>, edges array<int>"


def _build_shard(table: pa.Table) -> pa.Table:
    dim = table.column("dim")[0].as_py()
    ids = table.column("vec_id").to_numpy()
    v = _unpack(table.column("vector"), dim)
    distinct, at = np.unique(v, axis=0, return_inverse=True)
    n = len(distinct)
    rest = distinct - mean(distinct)
    norm = norms(rest)
    falling = np.lexsort((np.arange(n), -norm))
    place = np.empty(n, np.int64)
    place[falling] = np.arange(n)
    distinct, rest, norm, at = distinct[falling], rest[falling], norm[falling], place[at.ravel()]
    bounds = strata(norm)
    edges, entry = [], np.zeros(n, bool)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        own, entries = build_graph((rest[lo:hi] / norm[lo]).astype(np.float32))
        edges += [e[e < hi - lo].astype(np.int32) for e in own[:-1]]
        entry[lo + entries] = True
    order = np.lexsort((ids, at))
    members = np.split(ids[order], np.cumsum(np.bincount(at, minlength=n))[:-1])
    return pa.table(
        {
            "dim": pa.array([dim] * n, pa.int32()),
            "shard": pa.array([table.column("shard")[0].as_py()] * n, pa.int32()),
            "node": pa.array(range(n), pa.int32()),
            "stratum": pa.array(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), pa.int32()),
            "entry": pa.array(entry),
            "vector": pa.array(list(distinct), pa.list_(pa.float64())),
            "members": pa.array([np.unique(m) for m in members], pa.list_(pa.int64())),
            "edges": pa.array(edges, pa.list_(pa.int32())),
        }
    )


class Shard:
    """A shard's graphs, from its index rows."""

    def __init__(self, index: pa.Table):
        index = index.sort_by("node")
        self.v = _unpack(index.column("vector"), index.column("dim")[0].as_py())
        self.mean = mean(self.v)
        rest = self.v - self.mean
        self.norm = norms(rest)
        self.members = index.column("members").to_pylist()
        of = index.column("stratum").to_numpy()
        self.bounds = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
        entry, edges = index.column("entry").to_numpy(zero_copy_only=False), index.column("edges").to_pylist()
        self.graphs = []
        for lo, hi in zip(self.bounds[:-1], self.bounds[1:], strict=True):
            own = np.full((hi - lo + 1, DEGREE), hi - lo, np.int64)
            for i, e in enumerate(edges[lo:hi]):
                own[i, : len(e)] = e
            self.graphs.append(((rest[lo:hi] / self.norm[lo]).astype(np.float32), own, np.flatnonzero(entry[lo:hi])))

    def search(self, ids: list[int], q: np.ndarray, k: int, beam: int) -> tuple[list[int], list[int], list[float]]:
        """Query id, neighbour and score of the k nearest found."""
        out: tuple[list, list, list] = ([], [], [])
        size, base = norms(q), q @ self.mean
        unit = (q / size[:, None]).astype(np.float32)
        best: list[list[tuple[float, int]]] = [[] for _ in ids]
        for (x, edges, entries), lo in zip(self.graphs, self.bounds, strict=False):
            # A stratum's vectors score at most the mean's score and norm x norm, with a grain of rounding on top.
            reach = base + size * self.norm[lo] * (1 + 1e-9) + 1e-9 * np.abs(base)
            act = np.array([a for a, b in enumerate(best) if len(b) < k or -b[k - 1][0] <= reach[a]], np.int64)
            if not len(act):
                break
            found, _ = _search(x, edges, entries, unit[act], beam, True)
            for a, row in zip(act.tolist(), found, strict=True):
                row = row[row >= 0] + lo
                pool = best[a]
                for s, node in zip((-(self.v[row] * q[a]).sum(1)).tolist(), row.tolist(), strict=True):
                    # A member list is sorted: its first k + 1 hold the first k but the query's own row.
                    pool += [(s, m) for m in self.members[node][: k + 1] if m != ids[a]]
                pool.sort()
                met: set[int] = set()
                best[a] = [(s, m) for s, m in pool if not (m in met or met.add(m))][:k]
        for a, pool in zip(ids, best, strict=True):
            for s, m in pool:
                out[0].append(a)
                out[1].append(m)
                out[2].append(-s)
        return out


def _search_block(k: int, beam: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if index.num_rows and queries.num_rows:
            shard = Shard(index)
            q, ids = _unpack(queries.column("vector"), shard.v.shape[1]), queries.column("vec_id").to_pylist()
            for lo in range(0, len(q), TOGETHER):
                for o, more in zip(out, shard.search(ids[lo : lo + TOGETHER], q[lo : lo + TOGETHER], k, beam), strict=True):
                    o.extend(more)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, vector): the rows that take part, each once."""
    v = F.col("vector")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda c: c != 0)).distinct()


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, shard: int = SHARD, beam: int = BEAM, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of `vectors` (vec_id, embedding) for which `is_query` holds."""
    ship(vectors.sparkSession)
    rows = materialise(valid(vectors), "vectors")
    queries = rows.filter(is_query)
    shards = max(1, -(-rows.count() // shard))
    blocks = max(1, -(-queries.count() // block))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    index = materialise(dealt.groupBy("dim", "shard").applyInArrow(tidy(_build_shard), _INDEX), "graphs")
    blocked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    # Each shard's graph once for each block of queries, each query once for each shard: bounded pieces of (shards x blocks) tasks.
    # A full block is larger than a shard's graph, so the graphs' copies are the lesser part of what is sent.
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = blocked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    keys = ("dim", "shard", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search_block(k, beam), "query_id bigint, vec_id bigint, score double")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
