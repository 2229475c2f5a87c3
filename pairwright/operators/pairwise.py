"""All pairs of variables: correlations, log-likelihood ratios, p-values, posteriors.

Variables arrive as rows (gene, sample, value) and are packed to one array per gene by one
shuffle.  A batch of A rows meets the whole B matrix in one NumPy product, so a row of
ratios is complete where it is made: its posterior needs no shuffle of pairs, and nothing
of the size of the result is kept.  The only thing that posteriors need from elsewhere, the
largest ratio per test over everything, comes from a first pass that returns a few numbers.

Few long rows, beyond `LONG_BYTES`, are cut by samples: all that ratios need are sums over samples, so a task multiplies
one block of samples of all rows, and sums of blocks meet by A row.  Rows move once, however many samples there are.
Of other rows B is broadcast if its counted size is within `BROADCAST_BYTES`; beyond that,
both sides are cut into tiles that a task holds, and every tile of A meets every tile of B in one shuffle.
Histograms of a row add up over tiles, so posteriors then take one more pass: ratios are made three times, kept never.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.special import normal_scores, null_sf
from pairwright.operators.elementwise import uniform_draw
from pairwright.operators.histogram import ADVISED_BINS, LEAST_BINS, bin_count, null_histogram
from pairwright.operators.posterior import curve, curve_points, posteriors

#: The driver holds B twice while it is sent, and so does every Python worker that gets it.
BROADCAST_BYTES = 64 << 20
#: Beyond this, long rows are cut by samples instead.
LONG_BYTES = 16 << 20
#: Pairs that a task makes, about: tasks are more than cores if they must, so that a lost one costs little.
TASK_PAIRS = 1 << 25
#: Bytes of one side of a tile.
TILE_BYTES = 32 << 20
#: Bytes of one block of samples, all rows together.
BLOCK_BYTES = 8 << 20
#: Results of about so many bytes are made at a time.
WORK_BYTES = 64 << 20
#: Ties of fewer samples than this are shaken, as rank scores are coarse there.
SHAKE_BELOW = 30
#: The smallest positive normal single-precision number: floor of a residual variance (fixed value).
FLOOR = 1.17549435e-38
TESTS = {"rank": (2,), "discrete": (1, 2, 3, 4, 5), "continuous": (1, 2, 3, 4, 5)}
#: Kinds of problem whose rows are taken as they are, not ranked: sums of products, and means of genotype classes.
PLAIN = ("products", "classes")
#: Kinds whose A rows have an anchor alongside.
ANCHORED = ("discrete", "continuous", "classes")


@dataclass(frozen=True)
class Plan:
    """What a pass over the pairs does.  kind: rank, discrete or continuous, or one of `PLAIN`."""

    kind: str
    ns: int
    nt: int
    nodiag: bool = False
    seed: int = 0
    dmax: dict[int, float] = field(default_factory=dict)

    def freedom(self, test: int, kv: int) -> tuple[int, int]:
        """Degrees of freedom of a test's null law; kv: distinct genotypes of the anchor."""
        n = self.ns
        if self.kind == "discrete":
            return {1: (kv - 1, n - kv), 2: (kv - 1, n - kv), 3: (kv - 1, n - kv - 1), 4: (kv, n - kv - 1), 5: (1, n - kv - 1)}[test]
        return {1: (1, n - 2), 2: (1, n - 2), 3: (1, n - 3), 4: (2, n - 3), 5: (1, n - 3)}[test]


def rank_scores(values: np.ndarray, ids: np.ndarray, seed: int) -> np.ndarray:
    """Rows turned to normal scores of their ranks, variance 1; ties by position.

    With fewer than 30 samples, scores are shaken by up to 2 / ns^2 of themselves (from
    a hash of `seed`, the row's id and the sample's place) and scaled again, so that coarse ranks don't coincide.
    """
    ns = values.shape[1]
    z = np.empty(values.shape)
    np.put_along_axis(z, np.argsort(values, axis=1, kind="stable"), np.broadcast_to(normal_scores(ns), values.shape), 1)
    if ns < SHAKE_BELOW:
        u = np.array([[uniform_draw(seed, i, k) for k in range(ns)] for i in ids.tolist()]).reshape(z.shape)
        z = z * (1 + (2 * u - 1) * 2 / ns**2)
        z = z - z.mean(1, keepdims=True)
        z = z / np.sqrt((z * z).mean(1, keepdims=True))
    return z


def _rows_of(plan: Plan, values: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return values if plan.kind in PLAIN else rank_scores(values, ids, plan.seed)


def class_means(plan: Plan, a: np.ndarray, za: np.ndarray, anchor: np.ndarray, b: np.ndarray, zb: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(a, geno, b, f, mu_a, mu_b) of every genotype that a row's anchor has."""
    for g in np.unique(anchor):
        yield _means_of(plan, a, b, g, *class_sums(anchor, g, za, zb))


def class_sums(anchor: np.ndarray, g: float, za: np.ndarray, zb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(samples, sum of the row itself, sum of every B row) over the samples of genotype g, per A row."""
    member = (anchor == g).astype(float)
    return member.sum(1, keepdims=True), (member * za).sum(1, keepdims=True), member @ zb.T


def _means_of(plan: Plan, a: np.ndarray, b: np.ndarray, g: float, count: np.ndarray, own: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    has = np.flatnonzero(count)
    n, k = len(has), len(b)
    count = count[has]
    each = lambda x: pa.array(np.broadcast_to(x, (n, k)).ravel())
    return pa.RecordBatch.from_arrays([each(a[has, None]), pa.array(np.full(n * k, int(g), np.int16)), pa.array(np.tile(b, n)), each(count / plan.ns), each(own[has] / count), each(other[has] / count)], ["a", "geno", "b", "f", "mu_a", "mu_b"])


def _half_log(x: np.ndarray) -> np.ndarray:
    """-ln(x) / 2 with infinity at 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return -0.5 * np.log(x)


def five_ratios(s1, s2, s12, rho) -> dict[int, np.ndarray]:
    """Ratios of the five tests from class or anchor sums and the correlation; none below 0."""
    v = np.maximum((1 - s1) * (1 - s2) - (rho - s12) ** 2, FLOOR)
    lv, l1, l2 = _half_log(v), _half_log(np.maximum(1 - s1, 0)), _half_log(np.maximum(1 - s2, 0))
    with np.errstate(invalid="ignore"):
        out = {1: l1 + np.zeros_like(rho), 2: l2, 3: lv - l1 - _half_log(1 - rho**2), 4: lv - l1, 5: lv - l1 - l2}
    return {k: np.where(x < 0, 0.0, x) for k, x in out.items()}


def ratios(plan: Plan, za: np.ndarray, anchor: np.ndarray | None, zb: np.ndarray) -> dict[int, np.ndarray]:
    """Ratios of a block of A rows (their anchors alongside) against a block of B rows."""
    return ratios_of_sums(plan, za @ zb.T, _anchor_sums(plan, za, anchor, zb))


def _anchor_sums(plan: Plan, za: np.ndarray, anchor: np.ndarray | None, zb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What anchors add: (samples, sum with the row itself, sums with B rows), once or for every genotype."""
    if plan.kind == "continuous":
        yield np.full((len(za), 1), float(za.shape[1])), (anchor * za).sum(1, keepdims=True), anchor @ zb.T
    elif plan.kind == "discrete":
        for g in np.unique(anchor):
            yield class_sums(anchor, g, za, zb)


def ratios_of_sums(plan: Plan, products: np.ndarray, anchors: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
    """Ratios from sums over all samples; `anchors` as `_anchor_sums` has them."""
    if plan.kind == "products":
        return {0: products}
    rho = np.clip(products / plan.ns, -1.0, 1.0)
    if plan.kind == "rank":
        x = _half_log(1 - rho**2)
        return {2: np.where(x < 0, 0.0, x)}
    if plan.kind == "continuous":
        ((_, own, other),) = anchors
        ea, eb = np.clip(own / plan.ns, -1.0, 1.0), np.clip(other / plan.ns, -1.0, 1.0)
        return five_ratios(ea**2, eb**2, ea * eb, rho)
    s1, s2, s12 = np.zeros((len(rho), 1)), np.zeros(rho.shape), np.zeros(rho.shape)
    for count, own, other in anchors:
        mu_a, mu_b, f = own / np.maximum(count, 1), other / np.maximum(count, 1), count / plan.ns
        s1 += f * mu_a**2
        s2 += f * mu_b**2
        s12 += f * mu_a * mu_b
    return five_ratios(s1, s2, s12, rho)


def _finish(plan: Plan, mode: str, a: np.ndarray, kv: np.ndarray, b: np.ndarray, found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    own = a[:, None] == b[None, :]
    if mode == "max":
        counted = ~own if plan.nodiag else np.ones_like(own)
        rows = [(t, float(np.max(x, where=counted & np.isfinite(x), initial=-1.0)), int((np.isnan(x) & counted).sum())) for t, x in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.float64(), pa.int64()))], ["test", "dmax", "nans"])
        return
    if plan.kind == "rank" and plan.nodiag and mode != "pv":
        found = {2: np.where(own, 0.0, found[2])}
    if mode in ("llr", "sum"):
        out = found
    elif mode == "pv":
        out = {t: np.empty(x.shape) for t, x in found.items()}
        for k in np.unique(kv):
            rows = kv == k
            for t, x in found.items():
                out[t][rows] = null_sf(x[rows], *plan.freedom(t, int(k)))
    else:
        out = {t: np.empty(x.shape) for t, x in found.items() if t > 1}
        diagonal = [np.flatnonzero(r) for r in own]
        p1 = np.ones(len(a))
        for i in range(len(a)):
            self_at = int(diagonal[i][0]) if plan.nodiag and len(diagonal[i]) else None
            for t in out:
                x = np.where(np.isposinf(found[t][i]), plan.dmax[t], found[t][i])
                edges, null = null_histogram(plan.dmax[t], plan.nt, *plan.freedom(t, int(kv[i])), warn=False)
                out[t][i] = posteriors(x, self_at, edges, null)
            if self_at is not None and plan.kind != "rank":
                p1[i] = out[2][i, self_at]
        if plan.kind != "rank":
            out[3] = 1.0 - out[3]
            if plan.nodiag:
                out = {t: np.where(own, 0.0, x) for t, x in out.items()}
            out[1] = np.broadcast_to(p1[:, None], own.shape)
    yield from _emit(plan, mode, a, b, out)


def _emit(plan: Plan, mode: str, a: np.ndarray, b: np.ndarray, out: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    tests = TESTS.get(plan.kind, (0,))
    prefix = {"llr": "l", "sum": "c"}.get(mode, "p")
    names = ["c"] if mode == "sum" else [prefix if plan.kind == "rank" else f"{prefix}{t}" for t in tests]
    names = ["llr" if n == "l" else n for n in names]
    for s in range(0, len(a), max(1, 20_000 // max(1, len(b)))):
        cut = slice(s, s + max(1, 20_000 // max(1, len(b))))
        k = len(a[cut])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a[cut], len(b))), pa.array(np.tile(b, k)), *(pa.array(np.ascontiguousarray(out[t][cut]).ravel()) for t in tests)], ["a", "b", *names])


def _schema(plan: Plan, mode: str) -> str:
    if mode == "max":
        return "test int, dmax double, nans long"
    if mode == "stats":
        return "a int, geno short, b int, f double, mu_a double, mu_b double"
    if mode == "sum":
        return "a int, b int, c double"
    if mode == "hist":
        return "a int, test int, counts array<long>, n long, own double"
    prefix = "l" if mode == "llr" else "p"
    cols = ["llr" if mode == "llr" else "p"] if plan.kind == "rank" else [f"{prefix}{t}" for t in TESTS[plan.kind]]
    return "a int, b int, " + ", ".join(f"{c} double" for c in cols)


def _matrix(column: pa.Array, ns: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, ns)


def _prepared(plan: Plan, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """(ids, scores, anchors, distinct genotypes) of packed A rows."""
    a = batch.column("gene").to_numpy()
    za = _rows_of(plan, _matrix(batch.column("vals"), plan.ns), a)
    kv = np.zeros(len(a), int)
    anchor = None
    if plan.kind == "continuous":
        anchor = rank_scores(_matrix(batch.column("anchor"), plan.ns), a, plan.seed + 1)
    elif plan.kind in ("discrete", "classes"):
        anchor = _matrix(batch.column("anchor"), plan.ns)
        s = np.sort(anchor, 1)
        kv = 1 + (s[:, 1:] != s[:, :-1]).sum(1)
    return a, za, anchor, kv


def _against(plan: Plan, mode: str, b: np.ndarray, zb: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, WORK_BYTES // (8 * 12 * max(1, len(b))))
        for batch in batches:
            for s in range(0, len(batch), step):
                a, za, anchor, kv = _prepared(plan, pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(s, step)]) for c in batch.columns], batch.schema.names))
                if mode == "stats":
                    yield from class_means(plan, a, za, anchor, b, zb)
                else:
                    yield from _finish(plan, mode, a, kv, b, ratios(plan, za, anchor, zb))

    return run


def _bins(plan: Plan, a: np.ndarray, kv: np.ndarray, b: np.ndarray, found: dict[int, np.ndarray]) -> list[tuple]:
    """(a, test, counts per bin, values counted, ratio of the variable with itself or None) of each row against some targets."""
    own = a[:, None] == b[None, :]
    out = []
    for t, x in found.items():
        if t == 1:
            continue
        x = np.where(np.isposinf(x), plan.dmax[t], x)
        for i in range(len(a)):
            edges, _ = null_histogram(plan.dmax[t], plan.nt, *plan.freedom(t, int(kv[i])), warn=False)
            counted = x[i][~own[i]] if plan.nodiag else x[i]
            at = np.searchsorted(edges, counted, "right") - 1
            at = at[(at >= 0) & (at < len(edges) - 1)]
            self_at = np.flatnonzero(own[i]) if plan.nodiag else ()
            out.append((int(a[i]), t, np.bincount(at, minlength=len(edges) - 1).tolist(), len(counted), float(x[i][self_at[0]]) if len(self_at) else None))
    return out


def _looked_up(plan: Plan, a: np.ndarray, kv: np.ndarray, curves: list, b: np.ndarray, found: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Posteriors of ratios from the summed histograms of their rows."""
    own = a[:, None] == b[None, :]
    out = {t: np.empty(x.shape) for t, x in found.items() if t > 1}
    p1 = np.ones(len(a))
    for i in range(len(a)):
        for c in curves[i]:
            t = c["test"]
            edges, null = null_histogram(plan.dmax[t], plan.nt, *plan.freedom(t, int(kv[i])), warn=False)
            real = np.array(c["counts"], float) / (c["n"] * np.diff(edges))
            x, y = curve_points(edges, curve(real, null))
            out[t][i] = np.interp(np.where(np.isposinf(found[t][i]), plan.dmax[t], found[t][i]), x, y)
            if t == 2 and c["own"] is not None:
                p1[i] = np.interp(c["own"], x, y)
    if plan.kind != "rank":
        out[3] = 1.0 - out[3]
        if plan.nodiag:
            out = {t: np.where(own, 0.0, x) for t, x in out.items()}
        out[1] = np.broadcast_to(p1[:, None], own.shape)
    return out


def _tiled(plan: Plan, mode: str):
    """Rows sorted by (i, j, side, gene): the A rows of a tile, then its B rows, which pass in portions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, mine, ready, curves = None, [], None, []
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("i", "j", "side")], 1)
            edge = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key)]
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if s == e:
                    continue
                if tuple(key[s][:2]) != tile:
                    tile, mine, ready = tuple(key[s][:2]), [], None
                part = batch.slice(s, e - s)
                if key[s][2] == 0:
                    mine.append(part)
                    continue
                if ready is None:
                    if not mine:
                        continue
                    rows = pa.Table.from_batches(mine).combine_chunks().to_batches()[0]
                    ready, curves = _prepared(plan, rows), rows.column("curves").to_pylist() if mode == "pij" else []
                    mine = []
                ids, za, anchor, kv = ready
                step = max(1, WORK_BYTES // (8 * 12 * max(1, len(ids))))
                for k in range(0, len(part), step):
                    now = part.slice(k, step)
                    b = now.column("gene").to_numpy()
                    zb = _rows_of(plan, _matrix(pa.concat_arrays([now.column("vals")]), plan.ns), b)
                    if mode == "stats":
                        yield from class_means(plan, ids, za, anchor, b, zb)
                        continue
                    found = ratios(plan, za, anchor, zb)
                    if mode not in ("hist", "pij"):
                        yield from _finish(plan, mode, ids, kv, b, found)
                        continue
                    if plan.kind == "rank" and plan.nodiag:
                        found = {2: np.where(ids[:, None] == b[None, :], 0.0, found[2])}
                    if mode == "hist":
                        rows_ = _bins(plan, ids, kv, b, found)
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows_], t) for n, t in enumerate((pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.float64()))], ["a", "test", "counts", "n", "own"])
                    else:
                        yield from _emit(plan, mode, ids, b, _looked_up(plan, ids, kv, curves, b, found))

    return run


#: A sum over the samples of one block: the products of an A row (`part` 0), or those of its anchor or of one genotype (1).
_SUMS = "gene int, part int, geno double, block int, n double, own double, sums array<double>"


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], np.ascontiguousarray(m).ravel())


def _sliced(plan: Plan, side: int, width: int):
    """Packed rows to their scores, cut into blocks of `width` samples; a row at a time, as rows are long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(i, 1)]) for c in batch.columns], batch.schema.names)
                if side == 0:
                    ids, z, anchor, _ = _prepared(plan, row)
                else:
                    ids = row.column("gene").to_numpy()
                    z, anchor = _rows_of(plan, _matrix(row.column("vals"), plan.ns), ids), None
                cuts = np.append(np.arange(0, plan.ns, width), plan.ns).astype(np.int32)
                n = len(cuts) - 1
                cut = lambda x: pa.ListArray.from_arrays(cuts, x.ravel())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, side, np.int32)), pa.array(np.full(n, ids[0], np.int32)), cut(z), pa.nulls(n, pa.list_(pa.float64())) if anchor is None else cut(anchor)], ["block", "side", "gene", "vals", "anchor"])

    return run


def _block_sums(plan: Plan, alike: bool):
    """Rows sorted by (block, side, gene) to `_SUMS`; with `alike`, B rows are the A rows."""

    def sums(block: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        na = int((rows.column("side").to_numpy() == 0).sum())
        width = len(rows.column("vals")[0])
        z = _matrix(rows.column("vals"), width)
        genes, za, zb = rows.column("gene").slice(0, na), z[:na], z if alike else z[na:]
        anchor = _matrix(rows.column("anchor").slice(0, na), width) if plan.kind in ANCHORED else None
        step = max(1, WORK_BYTES // (8 * 2 * max(len(zb), width)))
        for s in range(0, na, step):
            a, held = za[s : s + step], None if anchor is None else anchor[s : s + step]
            found = [] if plan.kind == "classes" else [(0, 0.0, np.full((len(a), 1), float(width)), np.zeros((len(a), 1)), a @ zb.T)]
            if plan.kind == "continuous":
                found += [(1, 0.0, *x) for x in _anchor_sums(plan, a, held, zb)]
            elif held is not None:
                found += [(1, float(g), *class_sums(held, g, a, zb)) for g in np.unique(held)]
            for part, g, n, own, other in found:
                k = len(a)
                yield pa.RecordBatch.from_arrays([genes.slice(s, k), pa.array(np.full(k, part, np.int32)), pa.array(np.full(k, g)), pa.array(np.full(k, block, np.int32)), pa.array(n.ravel()), pa.array(own.ravel()), _lists(other)], ["gene", "part", "geno", "block", "n", "own", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            block = batch.column("block").to_numpy()
            edge = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if s == e:
                    continue
                if parts and block[s] != now:
                    yield from sums(now, parts)
                    parts = []
                now = int(block[s])
                parts.append(batch.slice(s, e - s))
        if parts:
            yield from sums(now, parts)

    return run


def _added(plan: Plan, mode: str, b: np.ndarray):
    """`_SUMS` sorted by (gene, part, geno, block): blocks are added up, and an A row is finished when all its sums are there."""

    def finished(gene: int, sums: dict[tuple[int, float], list]) -> Iterator[pa.RecordBatch]:
        a = np.array([gene], np.int32)
        anchors = {g: (np.array([[n]]), np.array([[own]]), other) for (part, g), (n, own, other) in sums.items() if part == 1}
        if mode == "stats":
            for g, x in anchors.items():
                yield _means_of(plan, a, b, g, *x)
            return
        kv = sum(bool(x[0].any()) for x in anchors.values()) if plan.kind == "discrete" else 0
        yield from _finish(plan, mode, a, np.array([kv]), b, ratios_of_sums(plan, sums[0, 0.0][2], list(anchors.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, {}
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("gene", "part", "geno", "n", "own")))
            rows = _matrix(batch.column("sums"), len(b))
            for i, (gene, part, g, n, own) in enumerate(keys):
                if gene != now:
                    if sums:
                        yield from finished(now, sums)
                    now, sums = gene, {}
                was = sums.get((part, g))
                if was is None:
                    sums[part, g] = [n, own, rows[i : i + 1].copy()]
                else:
                    was[0] += n
                    was[1] += own
                    was[2] += rows[i]
        if sums:
            yield from finished(now, sums)

    return run


def pack(rows: DataFrame, value: str = "value") -> DataFrame:
    """(gene, vals, samples, bad): one array per gene, ordered by sample; what `shape` checks is kept beside it."""
    packed = rows.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("sample", F.col(value).cast("double").alias("value")))).alias("r"))
    repeated = F.size("r") - F.size(F.array_distinct(F.col("r.sample")))
    invalid = F.size(F.filter("r", lambda c: c["sample"].isNull() | c["value"].isNull() | F.isnan(c["value"])))
    return packed.select(F.col("gene").cast("int").alias("gene"), F.col("r.value").alias("vals"), F.xxhash64("r.sample").alias("samples"), repeated.alias("repeated"), invalid.alias("invalid"))


def shape(packed: DataFrame, what: str) -> tuple[int, int, int]:
    """(genes, samples, hash of the samples) of packed rows; raises on nulls, NaN, repeated or missing cells."""
    size = F.size("vals")
    r = packed.agg(F.count(F.lit(1)).alias("genes"), F.min(size).alias("lo"), F.max(size).alias("hi"), F.min("samples").alias("first"), F.max("samples").alias("last"), F.max("repeated").alias("repeated"), F.sum("invalid").alias("invalid"), F.count_if(F.col("gene").isNull()).alias("unnamed")).first()
    if not r["genes"]:
        raise ValueError(f"{what} is empty")
    if r["invalid"] or r["unnamed"]:
        raise ValueError(f"{what} has {r['invalid']} null or NaN cells and {r['unnamed']} rows without gene")
    if r["repeated"] or r["first"] != r["last"]:
        raise ValueError(f"{what} isn't dense: every gene needs every sample once")
    return int(r["genes"]), int(r["lo"]), int(r["first"])


@dataclass
class Pairs:
    """A checked problem: packed A rows (with anchors) and packed B rows."""

    plan: Plan
    a: DataFrame
    b: DataFrame
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Give the memory of the packed matrices back; they are packed again if a result is used afterwards."""
        for df in self.held:
            df.unpersist()

    @classmethod
    def of(cls, t: DataFrame, t2: DataFrame, anchor: DataFrame | None = None, kind: str = "rank", nodiag: bool = False, seed: int = 0) -> Pairs:
        # Packed once; a lost executor costs a recomputation of its part.
        packed = pack(t).persist()
        packed2 = packed if t2 is t else pack(t2).persist()
        held = (packed, packed2)
        ng, ns, which = shape(packed, "t")
        nt, ns2, which2 = (ng, ns, which) if t2 is t else shape(packed2, "t2")
        if which != which2:
            raise ValueError(f"t and t2 have different samples: {ns} and {ns2}")
        if ns < (3 if kind == "rank" else 4):
            raise ValueError(f"{ns} samples are too few")
        packed = packed.select("gene", "vals")
        targets = packed if t2 is t else packed2.select("gene", "vals")
        if anchor is not None:
            anchors = pack(anchor, "geno" if kind == "discrete" else "value").persist()
            held += (anchors,)
            ne, nse, which3 = shape(anchors, "anchor")
            if ne != ng or which3 != which:
                raise ValueError(f"anchor has {ne} genes and {nse} samples, t has {ng} and {ns}, or they are others")
            if kind == "discrete":
                kv = F.size(F.array_distinct("vals"))
                worst = anchors.agg(F.min(kv), F.max(kv), F.min(F.array_min("vals"))).first()
                if worst[2] < 0:
                    raise ValueError("genotypes must not be negative")
                if worst[0] < 2:
                    raise ValueError("an anchor has one genotype only, so no test is defined for it")
                if ns < worst[1] + 2:
                    raise ValueError(f"{worst[1]} genotypes need {worst[1] + 2} samples, there are {ns}")
            packed = packed.join(anchors.select("gene", F.col("vals").alias("anchor")), "gene")
            if packed.count() != ng:
                raise ValueError("anchor and t have different genes")
        return cls(Plan(kind, ns, nt, nodiag, seed), packed, targets, held)

    @classmethod
    def plain(cls, x: DataFrame, y: DataFrame, anchor: DataFrame | None = None) -> Pairs:
        """Rows (gene, sample, z) as they are, and genotypes (gene, sample, geno) of the first."""
        a = pack(x, "z").persist()
        b = a if y is x else pack(y, "z").persist()
        ng, ns, which = shape(a, "x")
        nt, ns2, which2 = (ng, ns, which) if y is x else shape(b, "y")
        if which != which2:
            raise ValueError(f"x and y have different samples: {ns} and {ns2}")
        held, a, b = (a, b), a.select("gene", "vals"), b.select("gene", "vals")
        b = a if y is x else b
        if anchor is not None:
            anchors = pack(anchor, "geno").persist()
            ne, nse, which3 = shape(anchors, "anchor")
            if ne != ng or which3 != which:
                raise ValueError(f"anchor has {ne} genes and {nse} samples, x has {ng} and {ns}, or they are others")
            a, held = a.join(anchors.select("gene", F.col("vals").alias("anchor")), "gene"), (*held, anchors)
        return cls(Plan("products" if anchor is None else "classes", ns, nt), a, b, held)

    def warn_equal_rows(self) -> int:
        """Warn of equal A and B rows under different ids, or unequal ones under the same, as `nodiag` claims."""
        n = mismatched_rows(self.a, self.b, self.plan.nodiag).count()
        if n:
            warnings.warn(f"{n} pairs of rows contradict nodiag={self.plan.nodiag}", stacklevel=3)
        return n

    def run(self, mode: str, dmax: dict[int, float] | None = None) -> DataFrame:
        """mode: llr, pv, pij or max; of `PLAIN` kinds, sum or stats.

        The result is lazy; `release` frees the packed matrices once it has been used.
        """
        plan = Plan(self.plan.kind, self.plan.ns, self.plan.nt, self.plan.nodiag, self.plan.seed, dmax or {})
        size = plan.nt * plan.ns * 8
        if size > min(LONG_BYTES, BROADCAST_BYTES) and self._long_rows():
            return self._blocks(plan, mode)
        if size <= BROADCAST_BYTES:
            rows = self.b.orderBy("gene").toArrow()  # within the limit just counted
            b = rows.column("gene").combine_chunks().to_numpy()
            zb = _rows_of(plan, _matrix(pa.concat_arrays(rows.column("vals").chunks) if rows.num_rows else pa.array([], pa.list_(pa.float64())), plan.ns), b)
            n = max(int(self.a.sparkSession.sparkContext.defaultParallelism), math.ceil(self.a.count() * plan.nt / TASK_PAIRS), 1)
            return self.a.repartition(n).mapInArrow(_against(plan, mode, b, zb), _schema(plan, mode))
        a = self.a
        if mode == "pij":
            bins = [F.sum(F.col("counts")[k]).alias(f"c{k}") for k in range(bin_count(plan.nt))]
            summed = self._tiles(plan, "hist", a).groupBy("a", "test").agg(*bins, F.sum("n").alias("n"), F.max("own").alias("own"))
            each = F.struct("test", F.array(*[f"c{k}" for k in range(len(bins))]).alias("counts"), "n", "own")
            curves = summed.groupBy(F.col("a").alias("gene")).agg(F.collect_list(each).alias("curves"))
            a = a.join(curves, "gene")
        return self._tiles(plan, mode, a)

    def _long_rows(self) -> bool:
        """Whether the sums of blocks of samples are no more than the rows themselves, or else both less than what tiles move."""
        row, na, nt = 8 * self.plan.ns, self.a.count(), self.plan.nt
        kinds = {"rank": 1, "products": 1, "continuous": 2}.get(self.plan.kind) or 1 + self.a.agg(F.max(F.size(F.array_distinct("anchor")))).first()[0]
        sides = na * (1 + (self.plan.kind in ANCHORED)), nt
        rows, moved = self._tile_rows(), row * sum(sides)
        sums = math.ceil(moved / BLOCK_BYTES) * na * nt * 8 * kinds
        tiled = row * (sides[0] * math.ceil(nt / rows) + nt * math.ceil(na / rows))
        return sums <= moved or row * nt > BROADCAST_BYTES and moved + sums < tiled

    def _tile_rows(self) -> int:
        return max(1, min(TILE_BYTES // (8 * self.plan.ns), math.isqrt(TASK_PAIRS)))

    def _blocks(self, plan: Plan, mode: str) -> DataFrame:
        """Blocks of samples, each with a part of every row, and their sums added up by A row."""
        alike = self.b is self.a
        na = self.a.count()
        rows = na * (1 + (plan.kind in ANCHORED)) + (0 if alike else plan.nt)
        width = min(plan.ns, max(1, BLOCK_BYTES // (8 * rows)))
        blocks = math.ceil(plan.ns / width)
        least = max(int(self.a.sparkSession.sparkContext.defaultParallelism), 1)
        cut = lambda df, n, side: df.repartition(max(least, math.ceil(8 * plan.ns * n / BLOCK_BYTES))).mapInArrow(_sliced(plan, side, width), "block int, side int, gene int, vals array<double>, anchor array<double>")
        cells = cut(self.a, na, 0)
        if not alike:
            cells = cells.union(cut(self.b, plan.nt, 1))
        sums = cells.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "side", "gene").mapInArrow(_block_sums(plan, alike), _SUMS)
        b = self.b.select("gene").orderBy("gene").toArrow().column("gene").combine_chunks().to_numpy()  # of few rows
        return sums.repartition(min(least, na), "gene").sortWithinPartitions("gene", "part", "geno", "block").mapInArrow(_added(plan, mode, b), _schema(plan, mode))

    def _tiles(self, plan: Plan, mode: str, a: DataFrame) -> DataFrame:
        """Every tile of A with every tile of B; each side travels as often as the other has tiles."""
        rows = self._tile_rows()
        na, nb = max(1, math.ceil(a.count() / rows)), max(1, math.ceil(plan.nt / rows))
        tile = lambda n, salt: F.pmod(F.xxhash64("gene", F.lit(salt)), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        mine = a.withColumn("i", tile(na, 1)).withColumn("j", every(nb)).withColumn("side", F.lit(0))
        other = self.b.withColumn("j", tile(nb, 2)).withColumn("i", every(na)).withColumn("side", F.lit(1))
        for c in a.columns:
            if c not in ("gene", "vals"):
                other = other.withColumn(c, F.lit(None).cast(a.schema[c].dataType))
        order = [*a.columns, "i", "j", "side"]
        dealt = mine.select(order).union(other.select(order)).repartitionById(na * nb, F.col("i") * nb + F.col("j")).sortWithinPartitions("i", "j", "side", "gene")
        return dealt.mapInArrow(_tiled(plan, mode), _schema(plan, mode))

    def largest(self) -> dict[int, float]:
        """Largest finite ratio of each test, over all pairs that count."""
        rows = self.run("max").groupBy("test").agg(F.max("dmax").alias("dmax"), F.sum("nans").alias("nans")).collect()  # a row per test
        out = {r["test"]: r["dmax"] for r in rows if r["test"] > 1}
        for r in rows:
            if r["nans"]:
                raise ValueError(f"test {r['test']}: {r['nans']} ratios are NaN")
        for t, d in out.items():
            if d <= 0:
                raise ValueError(f"test {t}: all ratios are zero, so there is nothing to estimate from")
        return out

    def posteriors(self) -> DataFrame:
        if bin_count(self.plan.nt) < LEAST_BINS:
            raise ValueError(f"{self.plan.nt} targets are too few for posteriors; 56 are needed")
        if bin_count(self.plan.nt) < ADVISED_BINS:
            warnings.warn(f"{self.plan.nt} targets give {bin_count(self.plan.nt)} bins; {ADVISED_BINS} are advised", stacklevel=3)
        return self.run("pij", self.largest())


def mismatched_rows(a: DataFrame, b: DataFrame, nodiag: bool) -> DataFrame:
    """(a, b) of packed rows that are equal although their ids differ, or under nodiag differ although their ids are equal."""
    x = a.select(F.col("gene").alias("a"), F.col("vals").alias("va")).withColumn("h", F.xxhash64("va"))
    y = b.select(F.col("gene").alias("b"), F.col("vals").alias("vb")).withColumn("h", F.xxhash64("vb"))
    same = x.join(y, "h").filter(F.col("va") == F.col("vb"))
    if not nodiag:
        return same.select("a", "b")
    wrong = x.drop("h").join(y.drop("h"), F.col("a") == F.col("b")).filter(F.col("va") != F.col("vb"))
    return same.filter("a <> b").select("a", "b").unionByName(wrong.select("a", "b"))
