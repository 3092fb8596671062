"""SQL of the draws on cells (operators/cells.py): the same hashes, bounds and distribution functions."""

from __future__ import annotations

from collections.abc import Sequence

from ..operators.cells import DEVIATIONS, GROUPS, MARGIN


def hash_sql(*parts: str) -> str:
    text = " || '-' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substring(md5({text}), 1, 8)) AS BIGINT)"


def _lf(x: str) -> str:
    steps = " * ".join(f"({x} + {i})" for i in range(1, 9))
    return f"(({x} + 8.5) * ln({x} + 9.0) - ({x} + 9.0) + 0.9189385332046727 + 1 / (12 * ({x} + 9.0)) - 1 / (360 * pow({x} + 9.0, 3)) + 1 / (1260 * pow({x} + 9.0, 5)) - ln({steps}))"


def _walk(mean: str, variance: str, least: str, most: str, log_first: str, ratio: str, u: str) -> str:
    """log_first uses at_.x (the lower bound as a double), ratio uses k_."""
    off = f"(sqrt(greatest({variance}, CAST(0 AS DOUBLE))) * {DEVIATIONS} + {MARGIN})"
    lo, hi = f"greatest({least}, CAST(floor({mean} - {off}) AS BIGINT))", f"least({most}, CAST(ceil({mean} + {off}) AS BIGINT))"
    start = f"{{'t': exp({log_first}), 'f': CAST(0 AS DOUBLE), 'k': at_.lo}}"
    step = f"{{'t': sum_.t * {ratio}, 'f': sum_.f + sum_.t, 'k': sum_.k + CAST(sum_.f + sum_.t < {u} AS BIGINT)}}"
    return f"list_transform([{{'lo': {lo}, 'hi': {hi}, 'x': CAST({lo} AS DOUBLE)}}], lambda at_: least(list_reduce(range(at_.lo, at_.hi + 1), lambda sum_, k_: {step}, {start}).k, at_.hi))[1]"


def binomial_sql(n: str, p: str, u: str) -> str:
    x, p, r = f"CAST({n} AS DOUBLE)", f"({p})", f"greatest(1 - ({p}), 1e-300)"
    first = f"{_lf(x)} - {_lf('at_.x')} - {_lf(f'({x} - at_.x)')} + at_.x * ln(greatest({p}, 1e-300)) + ({x} - at_.x) * ln({r})"
    inner = _walk(f"{x} * {p}", f"{x} * {p} * (1 - {p})", "CAST(0 AS BIGINT)", n, first, f"({x} - k_) / (k_ + 1) * ({p} / {r})", u)
    return f"CASE WHEN {n} <= 0 OR {p} <= 0 THEN CAST(0 AS BIGINT) WHEN {p} >= 1 THEN {n} ELSE {inner} END"


def hypergeometric_sql(size: str, ones: str, taken: str, u: str) -> str:
    n, c, t = (f"CAST({v} AS DOUBLE)" for v in (size, ones, taken))
    first = f"{_lf(c)} - {_lf('at_.x')} - {_lf(f'({c} - at_.x)')} + {_lf(f'({n} - {c})')} - {_lf(f'({t} - at_.x)')} - {_lf(f'({n} - {c} - {t} + at_.x)')} - {_lf(n)} + {_lf(t)} + {_lf(f'({n} - {t})')}"
    least, most = f"greatest(CAST(0 AS BIGINT), {taken} - ({size} - {ones}))", f"least({taken}, {ones})"
    inner = _walk(f"{t} * {c} / {n}", f"{t} * ({c} / {n}) * (1 - {c} / {n}) * ({n} - {t}) / greatest({n} - 1, 1.0)", least, most, first, f"({c} - k_) * ({t} - k_) / ((k_ + 1) * ({n} - {c} - {t} + k_ + 1))", u)
    return f"CASE WHEN {least} = {most} THEN {least} ELSE {inner} END"


def _deal(items: str, take: str, size: str, replace: bool, seed: str, name: str) -> str:
    """The list of how many rows fall on each item."""
    u = f"(({hash_sql(repr(seed), 'draw', name)} + 0.5) / CAST(4294967296 AS DOUBLE))"
    k = binomial_sql("a.lft", "x.c / CAST(a.size AS DOUBLE)", u) if replace else hypergeometric_sql("a.size", "x.c", "a.lft", u)
    step = f"list_transform([{k}], lambda w: {{'lft': a.lft - w, 'size': a.size - x.c, 'ws': list_append(a.ws, w)}})[1]"
    return f"list_reduce({items}, lambda a, x: {step}, {{'lft': CAST({take} AS BIGINT), 'size': CAST({size} AS BIGINT), 'ws': CAST([] AS BIGINT[])}}).ws"


def deal_sql(out: str, src: str, cols: Sequence[str], n_draws: int, seed: str, keys: Sequence[str] = (), take: str | None = None) -> str:
    """CTEs that end in `out` (keys, draw, cols, w) from `src` (keys, cols, c and, where rows are taken without replacement, `take`)."""
    ks = "".join(f"{k}, " for k in keys)
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    on = " AND ".join([f"t.{k} = g.{k}" for k in keys] + ["t.g = g.g"])
    cell = " || '-' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    item = ", ".join(f"'{c}': {c}" for c in cols)
    most = f", max({take}) AS take" if take else ""
    n = "least(take, size)" if take else "size"
    return (
        f"{out}_i AS (SELECT *, {cell} AS id FROM {src}), "
        f"{out}_g AS MATERIALIZED (SELECT {ks}g, CAST(sum(c) AS BIGINT) AS c{most}, list({{'id': id, 'c': c, {item}}} ORDER BY id) AS cells FROM (SELECT *, {hash_sql(repr('cell'), 'id')} % {GROUPS} AS g FROM {out}_i) GROUP BY {ks}g), "
        f"{out}_t AS MATERIALIZED (SELECT {ks}list({{'g': g, 'c': c}} ORDER BY g) AS gs, CAST(sum(c) AS BIGINT) AS size{', max(take) AS take' if take else ''} FROM {out}_g {by}), "
        f"{out}_d AS MATERIALIZED (SELECT {ks}draw, gs, {_deal('gs', n, 'size', not take, seed, 'x.g')} AS ws FROM {out}_t, (SELECT unnest(range(0, {n_draws})) AS draw)), "
        f"{out}_u AS (SELECT {ks}draw, unnest(gs).g AS g, unnest(ws) AS w FROM {out}_d), "
        f"{out}_l AS MATERIALIZED (SELECT {''.join(f't.{k} AS {k}, ' for k in keys)}draw, cells, {_deal('cells', 'w', 'g.c', not take, seed, 'x.id')} AS ws FROM {out}_u t JOIN {out}_g g ON {on} WHERE w > 0), "
        f"{out} AS MATERIALIZED (SELECT {ks}draw, {', '.join(f'x.{c} AS {c}' for c in cols)}, w FROM (SELECT {ks}draw, unnest(cells) AS x, unnest(ws) AS w FROM {out}_l) WHERE w > 0)"
    )


def auc_sql(src: str, s: str, y: str, keys: Sequence[str], w: str = "w") -> str:
    """(keys, n, auc) of weighted rows, null without both classes."""
    ks, by = "".join(f"{k}, " for k in keys), f"PARTITION BY {', '.join(keys)} " if keys else ""
    return (
        f"(SELECT {ks}sum(p) AS n_pos, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN sum(p * (below + q / CAST(2 AS DOUBLE))) / (CAST(sum(p) AS DOUBLE) * sum(q)) END AS auc FROM "
        f"(SELECT *, coalesce(sum(q) OVER ({by}ORDER BY {s} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT {ks}{s}, CAST(sum({w} * {y}) AS BIGINT) AS p, CAST(sum({w} * (1 - {y})) AS BIGINT) AS q FROM {src} GROUP BY {ks}{s})) "
        + (f"GROUP BY {', '.join(keys)})" if keys else ")")
    )


def order_ends_sql(v: str, alpha: float = 0.05) -> str:
    """Aggregates draws_v, lo_v and hi_v as order statistics."""
    m, sorted_ = f"count({v})", f"list({v} ORDER BY {v}) FILTER ({v} IS NOT NULL)"
    return f"{m} AS draws_{v}, ({sorted_})[CAST(floor({m} * {alpha / 2}) AS INT) + 1] AS lo_{v}, ({sorted_})[greatest(CAST(floor({m} * {1 - alpha / 2}) AS INT), 1)] AS hi_{v}"
