"""From log-likelihood ratios to posterior probabilities: one minus the local false discovery rate.

One row of ratios (one variable against all targets) has a histogram; its density ratio to
the null, made monotone and smoothed, is the posterior as a function of the ratio.
"""

from __future__ import annotations

import numpy as np

#: Relative weight of every neighbour in the smoothing mask (fixed value: exp(-9); the offset doesn't enter).
WING = float(np.exp(-9.0))
WIDEST = 50


def real_density(values: np.ndarray, edges: np.ndarray, n: int) -> np.ndarray:
    """Counts per bin over n and the bin's width; values outside the edges count in n only."""
    at = np.searchsorted(edges, values, "right") - 1
    at = at[(at >= 0) & (at < len(edges) - 1)]
    return np.bincount(at, minlength=len(edges) - 1) / (n * np.diff(edges))


def monotone(h: np.ndarray) -> np.ndarray:
    """Mean of the running maximum from the left and the running minimum from the right."""
    return (np.maximum.accumulate(h) + np.minimum.accumulate(h[::-1])[::-1]) / 2


def smooth(h: np.ndarray, cut: int) -> np.ndarray:
    """First differences averaged with `cut` neighbours on either side, summed up again and put back to the old range."""
    lo, span = h.min(), h.max() - h.min()
    if span == 0:
        return h
    d = np.diff(h)
    d = np.r_[np.full(cut, d[0]), d, np.full(cut, d[-1])]
    mask = np.full(2 * cut + 1, WING)
    mask[cut] = 1.0
    s = np.r_[0.0, np.cumsum(np.convolve(d, mask / mask.sum(), "valid"))]
    return lo + (s - s.min()) * span / (s.max() - s.min())


def curve(real: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Posterior per bin.

    All zero where only the first bin has values; all one where the first bin is empty.
    """
    filled = np.flatnonzero(real)
    nb = int(filled[-1]) + 1 if len(filled) else 1
    if nb == 1:
        return np.zeros(len(real))
    r = real[:nb].copy()
    # An empty bin takes the value of the one before, except the first.
    source = np.maximum.accumulate(np.where((r != 0) | (np.arange(nb) == 0), np.arange(nb), 0))
    r = r[source]
    with np.errstate(divide="ignore"):
        ratio = null[:nb] / r
    peak = int(np.argmax(ratio))
    share = 1.0 / ratio[peak]
    if share == 0:
        return np.ones(len(real))
    q = 1.0 - share * ratio
    q = np.r_[q, np.full(len(real) - nb, q[-1])]
    q[: peak + 1] = 0.0
    return smooth(monotone(q), min(nb // 2, WIDEST))


def curve_points(edges: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points to interpolate between: bin centres, and the outer edges with the values next to them."""
    return np.r_[edges[0], (edges[:-1] + edges[1:]) / 2, edges[-1]], np.r_[values[0], values, values[-1]]


def posteriors(ratios: np.ndarray, skip: int | None, edges: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Posterior of each ratio of one row; `skip` is the target that isn't counted (the variable itself)."""
    counted = ratios if skip is None else np.delete(ratios, skip)
    x, y = curve_points(edges, curve(real_density(counted, edges, len(counted)), null))
    return np.interp(ratios, x, y)
