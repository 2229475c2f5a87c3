from __future__ import annotations

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.functions import special as sp


def test_normal_quantile_matches_the_standard_library():
    p = np.r_[1e-300, 1e-12, np.linspace(0.001, 0.999, 501), 1 - 1e-12]
    want = [statistics.NormalDist().inv_cdf(x) for x in p]
    assert np.allclose(sp.normal_quantile(p), want, rtol=1e-14, atol=1e-15)


def test_normal_quantile_column(spark):
    df = spark.range(1, 1000).select((F.col("id") / 1000.0).alias("p")).select("p", sp.normal_quantile_column(F.col("p")).alias("z"))
    rows = df.collect()
    assert np.allclose([r.z for r in rows], sp.normal_quantile([r.p for r in rows]), atol=1e-14)


def _integral(x: float, n1: int, n2: int) -> float:
    g = np.exp(np.linspace(math.log(1e-10), math.log(80), 400_001))
    return float(np.trapezoid(sp.null_pdf(x + g, n1, n2) * g, np.log(g)))


@pytest.mark.parametrize("n1,n2", [(1, 6), (1, 7), (2, 9), (3, 8), (3, 9), (4, 11), (5, 20), (9, 400), (10, 81)])
def test_survival_is_the_integral_of_the_density(n1, n2):
    x = np.array([0.003, 0.05, 0.2, 0.7])
    assert np.allclose(sp.null_sf(x, n1, n2), [_integral(v, n1, n2) for v in x], atol=2e-7)


def test_survival_limits():
    x = np.array([-1.0, 0.0, np.inf, np.nan])
    got = sp.null_sf(x, 3, 50)
    assert got[0] == got[1] == 1 and got[2] == 0 and math.isnan(got[3])
    v = np.linspace(0.001, 3, 50)
    assert np.allclose(sp.null_sf(v, 2, 41), np.exp(-41 * v), rtol=1e-13)
    assert (np.diff(sp.null_sf(v, 5, 41)) < 0).all()


@pytest.mark.parametrize("n1,n2", [(1, 1), (1, 498), (1, 81), (2, 9), (3, 8), (6, 30), (9, 40)])
def test_survival_column(spark, n1, n2):
    df = spark.range(-1, 40).select((F.col("id") / 30.0).alias("x")).select("x", sp.null_sf_column(F.col("x"), n1, n2).alias("q"))
    rows = df.collect()
    assert np.allclose([r.q for r in rows], sp.null_sf(np.array([r.x for r in rows]), n1, n2), atol=1e-12)


def test_quantiles_of_cdf():
    got = sp.quantiles_of_cdf(lambda x: 1 - math.exp(-x), 0.1, 0.1, 9, 0.0, 50.0, 1e-9)
    assert np.allclose(got, -np.log1p(-np.arange(1, 10) / 10), atol=1e-8)


def test_scores_have_variance_one():
    z = sp.normal_scores(83)
    assert z.mean() == pytest.approx(0, abs=1e-15) and (z * z).mean() == pytest.approx(1)
