"""Null histograms and posteriors in DuckDB's SQL, from ratios alone.

The bins of equal null mass come from a recursive query that repeats the fixed-point iteration;
widening, densities, counting, filling, the monotone curve, smoothing and interpolation are window by window and list by list.
Nothing is computed by the engine under test but the number of bins, which follows from the number of targets, and fixed values.
"""

from __future__ import annotations

import math

from pairwright.operators.histogram import bin_count
from pairwright.operators.posterior import WIDEST, WING

_PARTS, _POINTS = 1000, 16


def _pdf(x: str, n1: int, n2: int) -> str:
    norm = math.log(2) + math.lgamma((n1 + n2) / 2) - math.lgamma(n1 / 2) - math.lgamma(n2 / 2)
    return f"exp({n1 / 2 - 1!r}::DOUBLE * ln(1 - exp(-2 * ({x}))) - {n2} * ({x}) + {norm!r}::DOUBLE)"


def null_ctes(name: str, dmax: str, targets: int, freedom: tuple[int, int]) -> dict[str, str]:
    """CTEs that end in `name` (ne, nd): edges and null densities of the bins for the largest ratio in table `dmax` (dmax)."""
    n, p = bin_count(targets), _PARTS
    wide = "(edges[g // {0} + 2] - edges[g // {0} + 1])".format(p)
    return {
        # Midpoints of a thousand parts of each bin, their running mass, and where it passes each multiple of the mean.
        f"{name}_i(k, edges, change)": f"SELECT 0, [dmax * (1 + 1e-6::DOUBLE) * i / {n} for i in range(0, {n + 1})], 1e9::DOUBLE FROM {dmax} UNION ALL "
        f"SELECT k + 1, list_concat([edges[1]], list(new ORDER BY t), [edges[{n + 1}]]), max(abs(new - edges[t + 1]) / (edges[t + 2] - edges[t + 1])) FROM ("
        f"SELECT k, edges, t, edges[g // {p} + 1] + step * (g % {p}) + (t - before) * step / (cum - before) AS new FROM ("
        f"SELECT k, edges, g, step, cum, coalesce(lag(cum) OVER (ORDER BY g), 0) AS before FROM ("
        f"SELECT k, edges, g, step, sum(m) OVER (ORDER BY g) * {n} / sum(m) OVER () AS cum FROM ("
        f"SELECT k, edges, g, step, step * {_pdf('x', *freedom)} AS m FROM (SELECT k, edges, g, {wide} / {p} AS step, edges[g // {p} + 1] + {wide} * ((g % {p}) + 0.5) / {p} AS x "
        f"FROM {name}_i, range(0, {n * p}) r(g) WHERE change > 1e-5)))) JOIN range(1, {n}) q(t) ON cum > t AND before <= t) GROUP BY k, edges",
        # From equal mass at the left to equal width at the right.
        f"{name}_w": f"SELECT edges[1] AS lo, edges[{n + 1}] - edges[1] AS total, [CASE WHEN i = {n} THEN (edges[{n + 1}] - edges[1]) / {n} WHEN i = 1 THEN edges[2] - edges[1] "
        f"ELSE exp((ln(edges[i + 1] - edges[i]) * ({n} - i) + ln((edges[{n + 1}] - edges[1]) / {n}) * (i - 1)) / {max(n - 1, 1)}) END for i in range(1, {n + 1})] AS w FROM {name}_i ORDER BY k DESC LIMIT 1",
        f"{name}_e": f"SELECT [CASE WHEN i = {n} THEN lo + total ELSE lo + coalesce(list_sum(w[1:i]), 0) * total / list_sum(w) END for i in range(0, {n + 1})] AS ne FROM {name}_w",
        name: f"SELECT ne, [list_sum([{_pdf(f'ne[i] + (ne[i + 1] - ne[i]) / {_POINTS} * (CASE WHEN j = {_POINTS - 1} THEN j ELSE j + 0.5 END)', *freedom)} for j in range(0, {_POINTS})]) / {_POINTS} for i in range(1, {n + 1})] AS nd FROM {name}_e",
    }


def largest_cte(source: str, column: str, nodiag: bool) -> str:
    """(dmax): the largest finite value, self-pairs not counted under `nodiag`."""
    return f"SELECT max({column}) FILTER (isfinite({column}){' AND a <> b' if nodiag else ''}) AS dmax FROM {source}"


def histogram_rows(source: str, targets: int) -> str:
    """A row per bin of `source` (ne, nd): bin, lo, hi, dens."""
    n = bin_count(targets)
    return f"SELECT (i - 1)::INT AS bin, ne[i] AS lo, ne[i + 1] AS hi, nd[i] AS dens FROM {source}, range(1, {n + 1}) t(i)"


def posterior_ctes(name: str, source: str, column: str, targets: int, freedom: tuple[int, int], nodiag: bool) -> dict[str, str]:
    """CTEs that end in `name` (a, b, p): the posterior of `column` in `source` (a, b, ...), self-pairs not counted under `nodiag`."""
    nbin, total = bin_count(targets), targets - nodiag
    off = "WHERE a <> b" if nodiag else ""
    k = "list_filter(range(1, {0} + 1), lambda k: {1})"
    x = f"least({column}, dmax)"
    middles = f"[(ne[k] + ne[k + 1]) / 2 for k in range(1, {nbin + 1})]"
    return {f"{name}_top": largest_cte(source, column, nodiag)} | null_ctes(f"{name}_null", f"{name}_top", targets, freedom) | {
        f"{name}_g": f"SELECT dmax, ne, nd, list_concat([ne[1]], {middles}, [ne[{nbin + 1}]]) AS pts FROM {name}_top, {name}_null",
        # Density per bin, as one list per a.
        f"{name}_c": f"SELECT a, len(list_filter(ne, lambda z: z <= {x})) AS k FROM {source}, {name}_g {off}",
        f"{name}_h": f"SELECT a, [coalesce(list_sum([CASE WHEN q = k THEN 1 ELSE 0 END for q in ks]), 0)::DOUBLE / ({total} * (ne[k + 1] - ne[k])) for k in range(1, {nbin + 1})] AS h FROM (SELECT a, list(k) AS ks FROM {name}_c GROUP BY a), {name}_g",
        f"{name}_n": f"SELECT a, h, coalesce(list_max({k.format(nbin, 'h[k] > 0')}), 1) AS nb FROM {name}_h",
        # Empty bins take the one before, except the first.
        f"{name}_f": f"SELECT a, nb, h[1] AS h1, [CASE WHEN k = 1 THEN h[1] ELSE coalesce(h[list_max({k.format('k', 'h[k] > 0').replace('lambda k: h[k] > 0', 'lambda j: h[j] > 0')})], h[1]) END for k in range(1, nb + 1)] AS r FROM {name}_n",
        f"{name}_r": f"SELECT a, nb, h1, [CASE WHEN r[k] > 0 THEN nd[k] / r[k] ELSE 'Infinity'::DOUBLE END for k in range(1, nb + 1)] AS ratio FROM {name}_f, {name}_g",
        f"{name}_p": f"SELECT *, list_position(ratio, list_max(ratio)) AS peak FROM {name}_r",
        f"{name}_q": f"SELECT a, nb, h1, [CASE WHEN k <= peak THEN 0 ELSE 1 - ratio[least(k, nb)] / ratio[peak] END for k in range(1, {nbin + 1})] AS q FROM {name}_p",
        f"{name}_m": f"SELECT a, nb, h1, [(list_max(q[1:k]) + list_min(q[k:{nbin}])) / 2 for k in range(1, {nbin + 1})] AS q, least(nb // 2, {WIDEST}) AS cut FROM {name}_q",
        # Differences, smoothed with equal wings, summed up and put back to the old range.
        f"{name}_d": f"SELECT *, [list_sum([(CASE WHEN j = 0 THEN 1 ELSE {WING!r} END) * (q[greatest(2, least({nbin}, k + j))] - q[greatest(2, least({nbin}, k + j)) - 1]) for j in range(-cut, cut + 1)]) / (1 + 2 * cut * {WING!r}) for k in range(2, {nbin + 1})] AS d FROM {name}_m",
        f"{name}_s": f"SELECT *, [coalesce(list_sum(d[1:k]), 0) for k in range(0, {nbin})] AS s, list_min(q) AS lo, list_max(q) - list_min(q) AS span FROM {name}_d",
        f"{name}_v": f"SELECT a, [CASE WHEN nb = 1 THEN 0.0 WHEN h1 = 0 THEN 1.0 WHEN span = 0 THEN q[k] ELSE lo + (s[k] - list_min(s)) * span / (list_max(s) - list_min(s)) END for k in range(1, {nbin + 1})] AS v FROM {name}_s",
        f"{name}_x": f"SELECT l.a, l.b, {x} AS x, list_concat([v[1]], v, [v[{nbin}]]) AS y, pts, len(list_filter(pts, lambda z: z <= {x})) AS i FROM {source} l JOIN {name}_v USING (a), {name}_g",
        name: f"SELECT a, b, CASE WHEN i < 1 THEN y[1] WHEN i >= {nbin + 2} THEN y[{nbin + 2}] ELSE y[i] + (x - pts[i]) * (y[i + 1] - y[i]) / (pts[i + 1] - pts[i]) END AS p FROM {name}_x",
    }


def five_ctes(targets: int, freedom: dict[int, tuple[int, int]]) -> dict[str, str]:
    """CTEs that end in `pijs` (a, b, p1 .. p5) from `l` (a, b, l1 .. l5), with nodiag."""
    out: dict[str, str] = {}
    for t in (2, 3, 4, 5):
        out |= posterior_ctes(f"t{t}", "l", f"l{t}", targets, freedom[t], True)
    zero = lambda p: f"CASE WHEN t2.a = t2.b THEN 0 ELSE {p} END"
    out["own"] = "SELECT a, p AS p1 FROM t2 WHERE a = b"
    out["pijs"] = (
        f"SELECT t2.a, t2.b, own.p1, {zero('t2.p')} AS p2, {zero('1 - t3.p')} AS p3, {zero('t4.p')} AS p4, {zero('t5.p')} AS p5 FROM t2 "
        "JOIN t3 ON t2.a = t3.a AND t2.b = t3.b JOIN t4 ON t2.a = t4.a AND t2.b = t4.b JOIN t5 ON t2.a = t5.a AND t2.b = t5.b JOIN own ON own.a = t2.a"
    )
    return out


