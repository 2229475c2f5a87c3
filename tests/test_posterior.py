from __future__ import annotations

import math

import numpy as np
import pytest

from pairwright.functions.special import null_pdf, null_sf
from pairwright.operators import histogram as hg
from pairwright.operators import posterior as po


def plain_curve(real, null):
    """The same curve, one bin after another."""
    n = len(real)
    nb = max([i + 1 for i in range(n) if real[i]], default=1)
    if nb == 1:
        return [0.0] * n
    r = list(real)
    for i in range(1, nb):
        r[i] = r[i] or r[i - 1]
    ratio = [null[i] / r[i] if r[i] else math.inf for i in range(nb)]
    peak = ratio.index(max(ratio))
    if math.isinf(ratio[peak]):
        return [1.0] * n
    q = [0.0 if i <= peak else 1 - ratio[min(i, nb - 1)] / ratio[peak] for i in range(n)]
    q = [(max(q[: i + 1]) + min(q[i:])) / 2 for i in range(n)]
    cut, lo, hi = min(nb // 2, 50), min(q), max(q)
    if lo == hi:
        return q
    d = [q[i] - q[i - 1] for i in range(1, n)]
    at = lambda i: d[min(max(i, 0), len(d) - 1)]
    wing = math.exp(-9)
    s = [0.0]
    for i in range(n - 1):
        s.append(s[-1] + sum(at(i + k) * (1 if k == 0 else wing) for k in range(-cut, cut + 1)) / (1 + 2 * cut * wing))
    return [lo + (v - min(s)) * (hi - lo) / (max(s) - min(s)) for v in s]


@pytest.mark.parametrize("seed", range(8))
def test_curve_equals_the_plain_form(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(5, 60))
    null = np.sort(rng.random(n))[::-1] + 0.01
    real = null * np.linspace(0.8, 5, n) * rng.random(n) * (rng.random(n) > 0.2)
    real[0] = null[0]
    got = po.curve(real, null)
    assert np.allclose(got, plain_curve(real.tolist(), null.tolist()), atol=1e-12)
    assert (np.diff(got) >= -1e-12).all() and got.min() >= -1e-12 and got.max() <= 1 + 1e-12


def test_curve_edges():
    assert (po.curve(np.array([3.0, 0, 0, 0]), np.ones(4)) == 0).all()
    assert (po.curve(np.array([0.0, 1, 2, 1]), np.ones(4)) == 1).all()


def test_own_ratio_is_not_counted():
    edges, null = hg.null_histogram(0.5, 60, 1, 50)
    x = np.r_[np.random.default_rng(1).random(59) * 0.1, 40.0]
    assert np.allclose(po.posteriors(x, 59, edges, null)[:59], po.posteriors(x[:59], None, edges, null))


def test_bin_count():
    assert [hg.bin_count(n) for n in (55, 56, 316, 317, 100_000, 10**9)] == [4, 5, 9, 10, 100, 100]
    with pytest.raises(ValueError, match="56"):
        hg.null_histogram(1.0, 55, 1, 50)
    with pytest.warns(UserWarning, match="advised"):
        hg.null_histogram(1.0, 56, 1, 50)


@pytest.mark.parametrize("n1,n2", [(1, 100), (2, 80), (4, 300)])
def test_equal_mass(n1, n2):
    edges = hg.equal_mass_bins(0.0, 0.2, 20, lambda x: null_pdf(x, n1, n2))
    mass = -np.diff(null_sf(edges, n1, n2))
    assert np.allclose(mass[1:], mass[1:].mean(), rtol=0.01) and mass[0] == pytest.approx(mass[1], rel=0.05)
    by_cdf = hg.equal_mass_bins_cdf(0.0, 0.2, 20, lambda x: 1 - float(null_sf(np.array([x]), n1, n2)[0]))
    assert np.allclose(edges[3:], by_cdf[3:], rtol=0.02)


def test_widened_keeps_ends_and_first_ratio():
    e = np.r_[0, np.cumsum(np.linspace(1, 3, 10))]
    w = hg.widened(e)
    assert w[0] == 0 and w[-1] == e[-1] and (np.diff(w) > 0).all()
    assert np.diff(w)[-1] / np.diff(w)[0] == pytest.approx((e[-1] / 10) / 1.0)


def test_finer():
    assert hg.finer_edges(np.array([0.0, 1, 3]), 2).tolist() == [0, 0.5, 1, 2, 3]
    assert hg.finer_centres(np.array([0.0, 4]), 4).tolist() == [0.5, 1.5, 2.5, 3.0]


def test_data_bins():
    v = np.random.default_rng(2).exponential(size=5000)
    for edges in (hg.quantile_bins(v, 0.1), hg.exponential_bins(v, 1, 0.1)):
        assert (np.diff(edges) > 0).all() and edges[-1] >= v.max() * (1 - 1e-12)
        counts = np.histogram(v, edges)[0]
        assert counts[1:5].std() < 0.15 * counts[1:5].mean()
    with pytest.raises(ValueError, match="too few"):
        hg.quantile_bins(v[:50], 0.1)
    shaken = hg.uniform_bins(0, 1, 10, np.random.default_rng(0))
    assert shaken[0] < 0 and shaken[-1] > 1 and np.allclose(np.diff(shaken), 0.1, rtol=1e-3)
