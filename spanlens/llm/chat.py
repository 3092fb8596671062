"""Transcript parsing by a hidden Markov model, and canonical turn rendering (operator 5).

A transcript is the lines of a conversation's rows in order. States are the
three roles, each at the beginning of a turn or in its continuation. A line's
features are: whether it begins a row, the role that a speaker marker at its
start names ("User:", "### Assistant", "<|bot|>", ...), whether it asks, its
length, and for the first line of a row without markers the length of the row
and its number of lines. Emissions score the features, transitions score who
speaks after whom, and Viterbi finds the roles; a row may therefore hold several
turns, and a wrong or missing marker can be overruled.

The role that a row records is not looked at when roles are recovered
(`trust=True` makes it one more feature of the row's first line). Recorded roles
only give the shares of row sizes for each role, one count table of a few dozen
rows over the whole input; without any the sizes say nothing.

Rows are cut into blocks of BLOCK turn numbers; where a turn number has more than
CROWD rows, its block is cut by turn and by a hash. A block first becomes its
max-plus transfer matrix, the matrices of a conversation are combined to the
state before each block, and each block is then decoded between its two known
states. So no task needs a whole conversation's text, however long it is.

Results: one row for each parsed turn of each row (part 1, 2, ...), with its
text without marker and its canonical rendering; rows without text give one
empty turn. Null turns come before turn 0; rows of one turn number are ordered
by role and text (crowded ones by a hash first); repeated rows are read once and
come out as often as they went in; rows with a null conv_id are conversations of
their own. Of paths that score alike one is taken, the same in each run. Other
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship, text_or_empty

BLOCK, CROWD = 64, 1024
#: Row sizes: powers of two of the length (up to SIZES) by lines (1, 2, 3 and more).
SIZES, LINES = 14, 3
#: Rows of a task, about.
TASK = 10_000
ROLES = ("system", "user", "assistant")
# Names that transcripts use for the roles.
NAMES = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q"),
    "assistant": ("assistant", "ai", "bot", "agent", "model", "gpt", "answer", "a"),
}
_ROLE_OF = {name: k for k, role in enumerate(ROLES) for name in NAMES[role]}
_ANY = "|".join(sorted(_ROLE_OF, key=lambda n: (-len(n), n)))
MARKER = re.compile(rf"\s*(?:<\|(?:im_start\|>)?\s*(?P<tag>{_ANY})\s*(?:\|>)?|(?:#{{1,4}}|\*\*|\[)\s*(?P<head>{_ANY})\s*(?:\*\*|\])?\s*:?(?=\s|$)|(?P<name>{_ANY})\s*:)\s*", re.I)

# States: role k begins (k) or continues (k + 3).
_LOG = np.log
_START = _LOG(np.array([0.3, 0.6, 0.1, 1e-9, 1e-9, 1e-9]))
_AFTER = np.array([[0.02, 0.88, 0.10], [0.01, 0.09, 0.90], [0.01, 0.89, 0.10]])  # who begins after whom
_NEXT = np.zeros((6, 6))
for _k in range(3):
    for _s in (_k, _k + 3):
        _NEXT[_s, :3] = _LOG(0.4 * _AFTER[_k])
        _NEXT[_s, 3:] = -np.inf
        _NEXT[_s, 3 + _k] = _LOG(0.6)
NONE = -1
#: Stands for a null turn: before all others, in a block of its own.
NO_TURN = -(1 << 40)


def role_of(name: str | None) -> int:
    return _ROLE_OF.get((name or "").strip().lower(), NONE)


def size_of(text: str, lines: int) -> int:
    return min((len(text) + 1).bit_length() - 1, SIZES - 1) * LINES + min(lines, LINES) - 1


#: Log shares of row sizes for each role, where they say nothing.
FLAT = np.zeros((3, SIZES * LINES))


def emissions(text: str, named: int = NONE, sizes: np.ndarray = FLAT) -> tuple[list[str], np.ndarray]:
    """The lines of a row without their markers, and log-likelihood scores (lines x states)."""
    lines = re.split(r"\r\n|\r|\n", text)
    score = np.zeros((len(lines), 6))
    plain, marked = [], False
    for i, line in enumerate(lines):
        m = MARKER.match(line)
        marker = role_of(next(filter(None, m.groups()))) if m else NONE
        marked |= marker != NONE
        plain.append(line[m.end() :] if m else line)
        e = score[i]
        if marker != NONE:  # a marked line begins a turn of that role
            e[:3] += _LOG(0.02)
            e[marker] += _LOG(0.96) - _LOG(0.02)
            e[3:] += _LOG(1e-4)
        if i == 0:
            e[:3] += _LOG(0.98)
            e[3:] += _LOG(0.02)
            if named != NONE:
                wrong = _LOG(0.02)
                e += wrong
                e[[named, named + 3]] += _LOG(0.96) - wrong
        elif marker == NONE:
            e[:3] += _LOG(0.01)
            e[3:] += _LOG(0.99)
        if line.rstrip().endswith("?"):
            e[[1, 4]] += _LOG(1.5)
        if len(line) > 400:
            e[[2, 5]] += _LOG(1.3)
    if not marked:
        score[0, :3] += sizes[:, size_of(text, len(lines))]
    return plain, score


def transfer(score: np.ndarray) -> np.ndarray:
    """Best score from the state before the lines to the state of the last."""
    m = np.where(np.eye(6, dtype=bool), 0.0, -np.inf)
    for e in score:
        m = (m[:, :, None] + _NEXT[None]).max(1) + e
    return m


def viterbi(score: np.ndarray, before: int, last: int) -> list[int]:
    """States of the lines, between a known state before them (-1: the start) and a known last one (-1: any)."""
    best = (_START if before < 0 else _NEXT[before]) + score[0]
    back = np.zeros((len(score), 6), np.int64)
    for i in range(1, len(score)):
        step = best[:, None] + _NEXT
        back[i] = step.argmax(0)
        best = step.max(0) + score[i]
    state = int(best.argmax()) if last < 0 else last
    out = [state]
    for i in range(len(score) - 1, 0, -1):
        state = int(back[i, state])
        out.append(state)
    return out[::-1]


def _blocks(table: pa.Table):
    """((conv, block), rows in order) of a task."""
    rows = table.select(["conv", "block", "turn", "role", "text", "copies"]).to_pylist()
    rows.sort(key=lambda r: (r["conv"], r["block"], r["turn"], r["role"] or "", r["text"]))
    lo = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or (rows[i]["conv"], rows[i]["block"]) != (rows[lo]["conv"], rows[lo]["block"]):
            yield rows[lo]["conv"], rows[lo]["block"], rows[lo:i]
            lo = i


def _emitter(sizes: np.ndarray, trust: bool):
    return lambda r: emissions(r["text"], role_of(r["role"]) if trust else NONE, sizes)


def _matrices(emit):
    def run(table: pa.Table) -> pa.Table:
        conv, block, first, matrix = [], [], [], []
        for c, b, rows in _blocks(table):
            score = np.concatenate([emit(r)[1] for r in rows])
            conv.append(c)
            block.append(b)
            matrix.append(transfer(score).ravel().tolist())
            first.append((transfer(score[1:])[:, :] + (_START + score[0])[:, None]).max(0).tolist())
        return pa.table({"conv": pa.array(conv, pa.string()), "block": pa.array(block, pa.int64()), "matrix": pa.array(matrix, pa.list_(pa.float64())), "first": pa.array(first, pa.list_(pa.float64()))})

    return run


def _bounds(table: pa.Table) -> pa.Table:
    """For each block of the task's conversations the state before it and its last state."""
    rows = sorted(table.select(["conv", "block", "matrix", "first"]).to_pylist(), key=lambda r: (r["conv"], r["block"]))
    out: tuple[list, list, list, list] = ([], [], [], [])
    lo = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i]["conv"] != rows[lo]["conv"]:
            mine = rows[lo:i]
            best = np.array(mine[0]["first"])
            back = []
            for r in mine[1:]:
                step = best[:, None] + np.array(r["matrix"]).reshape(6, 6)
                back.append(step.argmax(0))
                best = step.max(0)
            last = [int(best.argmax())]
            for b in back[::-1]:
                last.append(int(b[last[-1]]))
            last.reverse()
            for k, r in enumerate(mine):
                for o, x in zip(out, (r["conv"], r["block"], last[k - 1] if k else -1, last[k]), strict=True):
                    o.append(x)
            lo = i
    return pa.table({"conv": pa.array(out[0], pa.string()), "block": pa.array(out[1], pa.int64()), "before": pa.array(out[2], pa.int32()), "last": pa.array(out[3], pa.int32())})


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text.strip()}\n<|end|>"


def _decode(emit):
    def run(table: pa.Table, bounds: pa.Table) -> pa.Table:
        known = {(c, b): (s, e) for c, b, s, e in zip(*(bounds.column(n).to_pylist() for n in ("conv", "block", "before", "last")), strict=True)}
        out: dict[str, list] = {n: [] for n in ("conv", "turn", "part", "given_role", "role", "begins", "text", "rendered", "copies")}
        for c, b, rows in _blocks(table):
            parsed = [emit(r) for r in rows]
            states = viterbi(np.concatenate([p[1] for p in parsed]), *known[c, b])
            at = 0
            for r, (plain, _) in zip(rows, parsed, strict=True):
                own = states[at : at + len(plain)]
                at += len(plain)
                starts = [0, *(k for k in range(1, len(own)) if own[k] < 3), len(own)]
                for part, (s, e) in enumerate(zip(starts[:-1], starts[1:], strict=True), 1):
                    role, text = ROLES[own[s] % 3], "\n".join(plain[s:e])
                    for o, x in zip(out.values(), (c, None if r["turn"] == NO_TURN else r["turn"], part, r["role"], role, own[s] < 3, text.strip(), render(role, text), r["copies"]), strict=True):
                        o.append(x)
        kinds = {"turn": pa.int64(), "part": pa.int32(), "begins": pa.bool_(), "copies": pa.int64()}
        return pa.table({n: pa.array(v, kinds.get(n, pa.string())) for n, v in out.items()})

    return run


def row_sizes(rows: DataFrame) -> np.ndarray:
    """Log shares of row sizes for each role by the recorded roles (each size once more than counted), as ratios to the shares of all rows."""
    role = F.create_map(*(F.lit(x) for name, k in _ROLE_OF.items() for x in (name, k)))[F.lower(F.trim("role"))]
    power = F.least(F.length(F.bin(F.length("text") + 1)) - 1, F.lit(SIZES - 1))
    lines = F.least(F.size(F.split("text", r"\r\n|\r|\n")), F.lit(LINES))
    counts = rows.select(role.alias("k"), (power * LINES + lines - 1).alias("size"), "copies").filter("k IS NOT NULL").groupBy("k", "size").agg(F.sum("copies").alias("n"))
    n = np.ones((3, SIZES * LINES))
    for r in counts.collect():  # at most 3 x SIZES x LINES
        n[r.k, r.size] += r.n
    return _LOG(n / n.sum(1, keepdims=True)) - _LOG(n.sum(0) / n.sum())


def turns(conversations: DataFrame, trust: bool = False) -> DataFrame:
    """conv_id, turn, part, given_role, role, begins, text, rendered: each parsed turn (`begins` is false where it goes on with the turn before)."""
    ship(conversations.sparkSession)
    body = text_or_empty()
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN))
    conv = F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.concat(F.lit("n"), F.xxhash64("turn", "role", body).cast("string")))
    rows = conversations.select(conv.alias("conv"), turn.alias("turn"), F.col("role").cast("string").alias("role"), body.alias("text"))
    # Copies meet after each map task has counted its own.
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = materialise(rows.withColumn("tb", F.floor(F.col("turn") / BLOCK).cast("long")), "transcripts")
    crowded = rows.groupBy("conv", "tb", "turn").agg(F.count("*").alias("n")).groupBy("conv", "tb").agg(F.max("n").alias("n")).filter(F.col("n") > CROWD)
    shifted = rows.join(crowded, ["conv", "tb"], "left")
    sub = F.pmod(F.xxhash64("role", "text"), F.ceil(F.col("n") / CROWD))
    block = F.when(F.col("n").isNull(), F.col("tb") * BLOCK * (1 << 20)).otherwise(F.col("turn") * (1 << 20) + sub)
    rows = materialise(shifted.select("conv", block.alias("block"), "turn", "role", "text", "copies"), "transcript-blocks")
    emit = _emitter(row_sizes(rows), trust)
    tasks = rows.count() // TASK + 1
    dealt = rows.withColumn("task", F.pmod(F.xxhash64("conv", "block"), F.lit(tasks)))
    matrices = dealt.groupBy("task").applyInArrow(_matrices(emit), "conv string, block bigint, matrix array<double>, first array<double>")
    bounds = matrices.groupBy(F.pmod(F.xxhash64("conv"), F.lit(tasks))).applyInArrow(_bounds, "conv string, block bigint, before int, last int")
    bounds = materialise(bounds, "transcript-bounds").withColumn("task", F.pmod(F.xxhash64("conv", "block"), F.lit(tasks)))
    out = dealt.groupBy("task").cogroup(bounds.groupBy("task")).applyInArrow(_decode(emit), "conv string, turn bigint, part int, given_role string, role string, begins boolean, text string, rendered string, copies bigint")
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    kind = conversations.schema["conv_id"].dataType
    return out.select(F.when(F.startswith("conv", F.lit("v")), F.substring("conv", F.lit(2), F.length("conv"))).cast(kind).alias("conv_id"), "turn", "part", "given_role", "role", "begins", "text", "rendered")
