"""Bins and null densities, on the driver: at most a hundred bins each, whatever the data size."""

from __future__ import annotations

import math
import warnings
from functools import lru_cache

import numpy as np

from pairwright.functions.special import null_pdf, quantiles_of_cdf

MOST_BINS, LEAST_BINS, ADVISED_BINS = 100, 5, 10
_PARTS = 1000
_PRECISION = 1e-5
_SUBPOINTS = 16


def bin_count(n: int) -> int:
    """Bins for n values: n^0.4, at most 100.  Through exp and log, so that exact powers fall the same way everywhere."""
    return min(MOST_BINS, int(math.floor(math.exp(math.log(n) / 2.5)))) if n > 0 else 0


def uniform_bins(lo: float, hi: float, n: int, rng: np.random.Generator | None = None) -> np.ndarray:
    """n equal bins; with `rng`, edges are moved slightly."""
    edges = lo + (hi - lo) / n * np.arange(n + 1)
    return jitter_edges(edges, 1e-5, rng) if rng is not None else edges


def jitter_edges(edges: np.ndarray, by: float, rng: np.random.Generator) -> np.ndarray:
    """Inner edges move by up to half of `by` times the narrower neighbour, from the right; the outer ones are pushed out."""
    e = np.array(edges, float)
    for i in range(len(e) - 2, 0, -1):
        e[i] += min(e[i] - e[i - 1], e[i + 1] - e[i]) * (rng.random() - 0.5) * by
    e[0] -= (e[1] - e[0]) * by
    e[-1] += (e[-1] - e[-2]) * by
    return e


def finer_edges(edges: np.ndarray, parts: int) -> np.ndarray:
    """Every bin cut into `parts` equal ones."""
    lo, width = edges[:-1, None], np.diff(edges)[:, None] / parts
    return np.r_[(lo + width * np.arange(parts)).ravel(), edges[-1]]


def finer_centres(edges: np.ndarray, parts: int) -> np.ndarray:
    """`parts` points in every bin: centres of equal parts, but for the last, which stands at its part's left end."""
    at = np.arange(parts) + 0.5
    at[-1] = parts - 1
    return (edges[:-1, None] + np.diff(edges)[:, None] / parts * at).ravel()


def equal_mass_bins(lo: float, hi: float, n: int, pdf) -> np.ndarray:
    """Edges of n bins of equal mass under `pdf`, by fixed-point iteration on a thousand midpoints per bin."""
    edges = np.linspace(lo, hi, n + 1)
    offsets = (np.arange(_PARTS) + 0.5) / _PARTS
    targets = np.arange(1, n)
    while n > 1:
        width = np.diff(edges)
        mass = pdf((edges[:-1, None] + width[:, None] * offsets).ravel()) * np.repeat(width / _PARTS, _PARTS)
        total = np.cumsum(mass)
        total *= n / total[-1]
        i = np.searchsorted(total, targets, "right")
        before = np.where(i > 0, total[i - 1], 0.0)
        step = width[i // _PARTS] / _PARTS
        new = edges[i // _PARTS] + step * (i % _PARTS) + (targets - before) * step / (total[i] - before)
        change = np.max(np.abs(new - edges[1:-1]) / width[1:])
        edges[1:-1] = new
        if not change > _PRECISION:
            break
    return edges


def equal_mass_bins_cdf(lo: float, hi: float, n: int, cdf, eps: float | None = None) -> np.ndarray:
    """The same from a CDF, by bisection."""
    a, b = cdf(lo), cdf(hi)
    inner = quantiles_of_cdf(cdf, a + (b - a) / n, (b - a) / n, n - 1, lo, hi, (hi - lo) * 1e-6 if eps is None else eps)
    return np.r_[lo, inner, hi]


def widened(edges: np.ndarray) -> np.ndarray:
    """From equal mass at the left to equal width at the right: log widths are interpolated, and rescaled to the same total."""
    n, total = len(edges) - 1, edges[-1] - edges[0]
    w = np.diff(edges)
    if n > 1:
        k = np.arange(1, n - 1)
        w[1:-1] = np.exp((np.log(w[1:-1]) * (n - 1 - k) + math.log(total / n) * k) / (n - 1))
    w[-1] = total / n
    out = edges[0] + np.r_[0.0, np.cumsum(w * (total / np.abs(w).sum()))]
    out[-1] = edges[0] + total
    return out


def null_density(edges: np.ndarray, n1: int, n2: int) -> np.ndarray:
    """Mean null density at sixteen points of every bin."""
    return null_pdf(finer_centres(edges, _SUBPOINTS), n1, n2).reshape(-1, _SUBPOINTS).mean(1)


@lru_cache(maxsize=4096)
def _null_histogram(dmax: float, n: int, n1: int, n2: int) -> tuple[np.ndarray, np.ndarray]:
    nbin = bin_count(n)
    edges = widened(equal_mass_bins(0.0, dmax * (1 + 1e-6), nbin, lambda x: null_pdf(x, n1, n2)))
    return edges, null_density(edges, n1, n2)


def null_histogram(dmax: float, n: int, n1: int, n2: int, warn: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(edges, null density) for n targets whose largest ratio is dmax."""
    if n1 < 1 or n2 < 1:
        raise ValueError(f"degrees of freedom must be positive, got {n1} and {n2}")
    nbin = bin_count(n)
    if nbin < LEAST_BINS:
        raise ValueError(f"{n} targets give {nbin} bins; {LEAST_BINS} are needed, hence 56 targets")
    if warn and nbin < ADVISED_BINS:
        warnings.warn(f"{n} targets give {nbin} bins; {ADVISED_BINS} are advised", stacklevel=2)
    return _null_histogram(float(dmax), n, n1, n2)


def null_histograms(dmax: dict[int, float], n: int, freedom, classes: list[int]) -> list[tuple[int, int, int, float, float, float]]:
    """(test, kv, bin, lo, hi, density) of every test and class count; `freedom(test, kv)` gives its degrees of freedom.

    One set per class count, whatever the number of variables: at most a hundred rows for each test and class.
    """
    out = []
    for test in sorted(dmax):
        for kv in classes:
            edges, dens = null_histogram(dmax[test], n, *freedom(test, kv))
            out += [(test, kv, k, float(edges[k]), float(edges[k + 1]), float(v)) for k, v in enumerate(dens)]
    return out


def split_sizing(n: int, rate: float) -> tuple[float, int]:
    """(quantile up to which bins have equal counts, their number) for n values."""
    split, nbin = min(1 - rate * 5 / math.sqrt(n), 0.9995), min(int(math.sqrt(math.sqrt(n)) - rate * 5), MOST_BINS)
    if nbin < 4 or split < 0:
        raise ValueError(f"{n} values are too few for bins of equal count")
    return split, nbin


def _tail(edges: list[float], top: float, width: float) -> list[float]:
    return [edges[-1] + width * (k + 1) for k in range(max(0, math.ceil((top - edges[-1]) / width)))]


def quantile_bins(values: np.ndarray, rate: float = 0.0, rng: np.random.Generator | None = None) -> np.ndarray:
    """Bins of equal count up to a quantile, then of equal width to the maximum; exact, by sorting."""
    v = np.sort(np.asarray(values, float))
    split, n1 = split_sizing(len(v), rate)
    last = int(math.floor(len(v) * split))
    step = last / n1
    width = v[last] - v[int(math.floor(last - step))]
    head = np.unique(v[np.floor(step * np.arange(n1)).astype(int)])
    n2 = max(1, math.ceil((v[-1] - v[last]) / width)) if width > 0 else 1
    edges = np.r_[head, np.linspace(v[last], v[-1], n2 + 1)]
    return jitter_edges(edges, 1e-5, rng) if rng is not None else edges


def exponential_bins(values: np.ndarray, dof: int, rate: float = 0.0, rng: np.random.Generator | None = None) -> np.ndarray:
    """The same without sorting: counts on a grid of exponential quantiles, edges uniform within a cell."""
    v = np.asarray(values, float)
    split, n1 = split_sizing(len(v), rate)
    fine, beyond = 100 * n1 + 1, 50 * n1
    grid = -np.log(1 - np.arange(fine) * split / fine) / dof
    grid = np.r_[grid, grid[-1] + (grid[-1] - grid[-2]) * np.arange(1, beyond + 1), np.inf]
    counts = np.histogram(v, grid)[0].astype(float)
    total = np.cumsum(counts)
    unit = math.floor(len(v) * split / n1)
    goal = unit * np.arange(1, n1 + 1)
    cell = np.searchsorted(total, goal, "left")
    before = np.where(cell > 0, total[cell - 1], 0.0)
    edges = [0.0, *(grid[cell] + (goal - before) / counts[cell] * (grid[cell + 1] - grid[cell]))]
    width = edges[-1] - edges[-2]
    edges = np.array([*edges, *_tail(edges, float(v.max()), width)])
    return jitter_edges(edges, 1e-5, rng) if rng is not None else edges
