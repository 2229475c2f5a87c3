from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from pairwright.operators import aggregate as agg
from pairwright.operators import elementwise as el
from pairwright.operators import normal, rows
from pairwright.sources import matrix

NAN, INF = float("nan"), float("inf")


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def same(a, b):
    return all(x == y or (x is not None and y is not None and math.isnan(x) and math.isnan(y)) for x, y in zip(a, b))


def test_nan_passes_bounds(spark):
    v = [-2.0, 0.5, 2.0, NAN, INF, -INF]
    assert same(apply(spark, lambda c: el.bound_below(c, 0), v), [0, 0.5, 2, NAN, INF, 0])
    assert same(apply(spark, lambda c: el.bound_above(c, 1), v), [-2, 0.5, 1, NAN, 1, -INF])
    assert same(apply(spark, lambda c: el.bound_both(c, 0, 1), v), [0, 0.5, 1, NAN, 1, 0])
    assert same(apply(spark, lambda c: el.set_inf(c, 7), v), [-2, 0.5, 2, NAN, 7, 7])
    assert same(apply(spark, lambda c: el.set_nan(c, 7), v), [-2, 0.5, 2, 7, INF, -INF])
    assert apply(spark, lambda c: el.eq(c, 2.0).cast("double"), v) == [0, 0, 1, 0, 0, 0]


def test_first_nan_and_extremes(spark):
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, NAN), (1, 0, NAN)], "gene int, sample int, value double")
    assert [tuple(r) for r in rows.first_nan(m).collect()] == [(0, 1)]
    assert rows.first_nan(m.filter("gene > 5")).count() == 0
    p = spark.createDataFrame([(0, 0, 99.0), (0, 1, INF), (1, 0, 3.0), (1, 1, NAN), (1, 2, -1.0)], "a int, b int, x double")
    assert tuple(agg.finite_max(p, "x", nodiag=True).first()) == (3.0, 0, 1)
    assert tuple(agg.finite_max(p, "x").first()) == (99.0, 1, 1)
    assert [r.x for r in agg.repair_infinite(p, "x", F.lit(3.0)).filter("a = 0 and b = 1").collect()] == [3.0]


def test_diagonal_round_trip(spark):
    packed = spark.createDataFrame([(i, [float(10 * i + j) for j in range(4)]) for i in range(4)], "gene int, vals array<double>")
    back = {r.gene: r.vals for r in rows.wrap_nodiag(rows.flatten_nodiag(packed), -1.0).collect()}
    assert back == {i: [(-1.0 if i == j else 10.0 * i + j) for j in range(4)] for i in range(4)}
    idx = [tuple(r) for r in spark.range(12).select(*[c.cast("int") for c in rows.pair_of_flat(F.col("id"), 4)]).collect()]
    assert idx == [(i, j) for i in range(4) for j in range(4) if i != j]


def test_normalisation(spark):
    m = matrix.from_dense(spark, np.random.default_rng(0).random((3, 40)), 3, 40)
    for df, c in ((normal.normalize_row(m), "x"), (normal.supernormalize(m, 40), "z"), (normal.supernormalize_auto(m, 12, 3), "z"), (normal.supernormalize_random(m, 3), "z")):
        for r in df.groupBy("gene").agg(F.avg(c).alias("m"), F.var_pop(c).alias("v")).collect():
            assert abs(r.m) < 1e-9 and (abs(r.v - 1) < 1e-9 or c == "z" and df.count() != 120)
    flat = matrix.from_dense(spark, [[2.0] * 5], 1, 5)
    assert {r.x for r in normal.normalize_row(flat).collect()} == {0.0}


def test_sources(spark, tmp_path):
    m = np.random.default_rng(1).random((5, 7))
    m.astype(np.float32).tofile(tmp_path / "m32")
    m.tofile(tmp_path / "m64")
    for bits in (32, 64):
        got = matrix.from_dense_file(spark, f"file://{tmp_path}/m{bits}", 5, 7, bits).orderBy("gene", "sample").collect()
        assert np.allclose([r.value for r in got], m.ravel(), rtol=1e-6)
    import pytest

    with pytest.raises(ValueError, match="rows"):
        matrix.from_dense_file(spark, f"file://{tmp_path}/m64", 4, 7)
    pairs = spark.createDataFrame([(0, 1, 0.5)], "a int, b int, p double")
    matrix.write_pairs(pairs, f"{tmp_path}/pairs")
    matrix.write_network(pairs, f"{tmp_path}/net")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == spark.read.parquet(f"{tmp_path}/net").count() == 1


def test_shuffle_is_a_permutation(spark):
    m = matrix.from_dense(spark, np.arange(30.0), 10, 3)
    to = rows.shuffle_rows(m, 4)
    assert sorted(r.to for r in to.collect()) == list(range(10))
    assert rows.permute_rows(m, to).count() == 30
    parts = rows.chunks(m, 3).groupBy("chunk").agg(F.countDistinct("gene").alias("n")).collect()
    assert sorted(r.n for r in parts) == [3, 3, 4]
