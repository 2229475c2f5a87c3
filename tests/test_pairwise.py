from __future__ import annotations

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.functions.special import normal_quantile, null_sf
from pairwright.operators import pairwise as pw
from pairwright.plans import api

warnings.filterwarnings("ignore", message=".*advised")


def long(spark, m, value="value", first=0):
    rows = [(first + i, j, (int if value == "geno" else float)(x)) for i, r in enumerate(m) for j, x in enumerate(r)]
    return spark.createDataFrame(rows, f"gene int, sample int, {value} {'short' if value == 'geno' else 'double'}")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    ns, nt, ng = 60, 64, 4
    g = rng.integers(0, 3, (ng, ns))
    g[:, :3] = [0, 1, 2]
    b = rng.standard_normal((nt, ns))
    b[:ng] += g
    b[10] += 2 * b[0]
    c = rng.standard_normal((ng, ns)) + b[:ng]
    return {"g": g, "b": b, "c": c, "G": long(spark, g, "geno").persist(), "A": long(spark, b[:ng]).persist(), "B": long(spark, b).persist(), "C": long(spark, c).persist()}


def scores(x):
    z = np.empty(len(x))
    z[np.argsort(x, kind="stable")] = normal_quantile(np.arange(1, len(x) + 1) / (len(x) + 1))
    return (z - z.mean()) / z.std()


def table(df):
    return {(r[0], r[1]): r[2:] for r in df.collect()}


def formula(s1, s2, s12, rho):
    v = max((1 - s1) * (1 - s2) - (rho - s12) ** 2, pw.FLOOR)
    out = (-0.5 * math.log(1 - s1), -0.5 * math.log(1 - s2), -0.5 * (math.log(v) - math.log(1 - s1) - math.log(1 - rho**2)), -0.5 * (math.log(v) - math.log(1 - s1)), -0.5 * (math.log(v) - math.log(1 - s1) - math.log(1 - s2)))
    return [max(0.0, x) for x in out]


def test_rank(spark, data):
    got = table(api.rank_llr(data["A"], data["B"]))
    pv = table(api.rank_pv(data["A"], data["B"]))
    z = [scores(x) for x in data["b"]]
    for a in range(4):
        for b in range(64):
            if a != b:
                x = -0.5 * math.log(1 - np.mean(z[a] * z[b]) ** 2)
                assert got[a, b][0] == pytest.approx(x, abs=1e-12)
                assert pv[a, b][0] == pytest.approx(null_sf(np.array([x]), 1, 58)[0], abs=1e-12)
    assert got[0, 0][0] > 10 and pv[0, 0][0] < 1e-12
    assert got[1, 2][0] == pytest.approx(got[2, 1][0])


def test_discrete(data):
    got = table(api.gassist_llr(data["G"], data["A"], data["B"]))
    pv = table(api.gassist_pv(data["G"], data["A"], data["B"]))
    z = [scores(x) for x in data["b"]]
    freedom = [(2, 57), (2, 57), (2, 56), (3, 56), (1, 56)]
    for a in range(4):
        for b in range(64):
            if a == b:
                continue
            s = [0.0, 0.0, 0.0]
            for k in range(3):
                m = data["g"][a] == k
                f, x, y = m.mean(), z[a][m].mean(), z[b][m].mean()
                s = [s[0] + f * x * x, s[1] + f * y * y, s[2] + f * x * y]
            want = formula(*s, np.mean(z[a] * z[b]))
            assert got[a, b] == pytest.approx(want, abs=1e-10)
            assert pv[a, b] == pytest.approx([null_sf(np.array([w]), *d)[0] for w, d in zip(want, freedom)], abs=1e-9)


def test_continuous(data):
    got = table(api.cassist_llr(data["C"], data["A"], data["B"]))
    z, e = [scores(x) for x in data["b"]], [scores(x) for x in data["c"]]
    for a in range(4):
        for b in range(64):
            if a != b:
                ea, eb = np.mean(e[a] * z[a]), np.mean(e[a] * z[b])
                assert got[a, b] == pytest.approx(formula(ea**2, eb**2, ea * eb, np.mean(z[a] * z[b])), abs=1e-10)


def test_monotone_transform_changes_nothing(data):
    bent = data["B"].withColumn("value", F.exp(F.col("value")) + 3)
    assert table(api.rank_pv(data["A"], bent)) == table(api.rank_pv(data["A"], data["B"]))


@pytest.mark.parametrize("f,anchor", [(api.gassist_pijs, "G"), (api.cassist_pijs, "C")])
def test_posteriors(data, monkeypatch, f, anchor):
    got = table(f(data[anchor], data["A"], data["B"], nodiag=True))
    assert len(got) == 4 * 64
    for (a, b), p in got.items():
        assert all(-1e-12 <= x <= 1 + 1e-12 for x in p)
        assert p[0] == got[a, (a + 1) % 64][0]
        if a == b:
            assert p[1:] == (0, 0, 0, 0)
    # Neither partitions nor the way B gets there change a result.
    assert table(f(data[anchor].repartition(7), data["A"].repartition(5), data["B"].repartition(3), nodiag=True)) == got
    monkeypatch.setattr(pw, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(pw, "WORK_BYTES", 20_000)
    monkeypatch.setattr(pw, "TILE_BYTES", 20_000)
    streamed = table(f(data[anchor], data["A"], data["B"], nodiag=True))
    assert streamed.keys() == got.keys()
    assert all(streamed[k] == pytest.approx(got[k], abs=1e-9) for k in got)


def test_combinations(data):
    p = table(api.gassist_pijs(data["G"], data["A"], data["B"], True))
    assert table(api.gassist(data["G"], data["A"], data["B"], True)) == {k: (pytest.approx((v[1] * v[4] + v[3]) / 2),) for k, v in p.items()}
    assert table(api.gassist_trad(data["G"], data["A"], data["B"], True)) == {k: (pytest.approx(v[1] * v[2]),) for k, v in p.items()}


def test_rank_posterior_finds_the_planted_pair(data):
    got = table(api.rank(data["A"], data["B"], nodiag=True))
    row = [got[0, b][0] for b in range(64) if b]
    assert got[0, 10][0] == max(row) > 0.5


def test_p1_is_one_without_nodiag(spark, data):
    other = data["B"].withColumn("gene", F.col("gene") + 100).withColumn("value", F.col("value") + F.rand(1))
    assert all(p[0] == 1 for p in table(api.gassist_pijs(data["G"], data["A"], other)).values())


def test_few_samples_are_shaken_by_seed(spark):
    rng = np.random.default_rng(0)
    t = long(spark, rng.integers(0, 3, (3, 12)))
    one, two, three = (table(api.rank_llr(t, t, seed=s)) for s in (1, 1, 2))
    assert one == two != three


def test_errors(spark, data):
    rng = np.random.default_rng(0)
    two = long(spark, rng.random((3, 2)))
    with pytest.raises(ValueError, match="too few"):
        api.rank_pv(two, two)
    three = long(spark, rng.random((3, 3)))
    assert api.rank_pv(three, three).count() == 9
    with pytest.raises(ValueError, match="too few"):
        api.cassist_pv(three, three, three)
    with pytest.raises(ValueError, match="56"):
        api.rank(data["A"], data["B"].filter("gene < 55"))
    with pytest.raises(ValueError, match="null"):
        api.rank_pv(data["A"].withColumn("value", F.when(F.col("gene") > 0, F.col("value"))), data["B"])
    with pytest.raises(ValueError, match="dense"):
        api.rank_pv(data["A"].filter("gene > 0 or sample > 0"), data["B"])
    with pytest.raises(ValueError, match="one genotype"):
        api.gassist_pv(data["G"].withColumn("geno", F.when(F.col("gene") == 0, 1).otherwise(F.col("geno")).cast("short")), data["A"], data["B"])
    with pytest.raises(ValueError, match="empty"):
        api.rank_pv(data["A"].limit(0), data["B"])
    with pytest.raises(ValueError, match="genes"):
        api.gassist_pv(data["G"].filter("gene < 3"), data["A"], data["B"])


def test_equal_rows_warn(data):
    with pytest.warns(UserWarning, match="contradict"):
        api.rank(data["A"], data["B"].withColumn("gene", F.col("gene") + 100))


def test_products_and_class_means_by_another_way(spark, monkeypatch):
    """Arrays against joins by sample, broadcast and in tiles."""
    from pairwright.operators import aggregate as agg

    rng = np.random.default_rng(8)
    x = spark.createDataFrame([(g, s, float(v)) for g in range(5) for s, v in enumerate(rng.standard_normal(40))], "gene int, sample int, z double")
    y = spark.createDataFrame([(g, s, float(v)) for g in range(9) for s, v in enumerate(rng.standard_normal(40))], "gene int, sample int, z double")
    geno = spark.createDataFrame([(g, s, int(rng.integers(0, 3 + g))) for g in range(5) for s in range(40)], "gene int, sample int, geno short")
    values = lambda df, keys: {tuple(r[:keys]): pytest.approx(tuple(r[keys:])) for r in df.collect()}
    for limit in (1 << 20, 100):
        monkeypatch.setattr(pw, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(pw, "TILE_BYTES", 700)
        assert {tuple(r[:2]): tuple(r[2:]) for r in agg.cov2(x, y, 40).collect()} == values(agg.cov2_sparse(x, y, 40), 2)
        assert {tuple(r[:2]): tuple(r[2:]) for r in agg.cov1(x, 40, True).collect()} == values(agg.cov2_sparse(x, x, 40, True), 2)
        assert {tuple(r[:3]): tuple(r[3:]) for r in agg.class_stats(geno, x, y, 40).select("a", "geno", "b", "f", "mu_a", "mu_b").collect()} == values(agg.class_stats_sparse(geno, x, y, 40).select("a", "geno", "b", "f", "mu_a", "mu_b"), 3)
    with pytest.raises(ValueError, match="dense"):
        agg.cov2(x, y.filter("gene > 0 or sample < 39"), 40)
    with pytest.raises(ValueError, match="samples"):
        agg.cov2(x, y.filter("sample < 39"), 40)
