"""Few rows of many samples: cut by samples, in tiles and broadcast, with the same results."""

from __future__ import annotations

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.operators import aggregate as agg
from pairwright.operators import pairwise as pw
from pairwright.plans import api

warnings.filterwarnings("ignore", message=".*advised")
WAYS = ("broadcast", "samples", "tiles")


@pytest.fixture
def way(monkeypatch):
    def take(which):
        monkeypatch.setattr(pw, "BROADCAST_BYTES", 1 << 20 if which == "broadcast" else 100)
        monkeypatch.setattr(pw.Pairs, "_long_rows", lambda self: which == "samples")
        monkeypatch.setattr(pw, "BLOCK_BYTES", 7_000)
        monkeypatch.setattr(pw, "TILE_BYTES", 9_000)
        monkeypatch.setattr(pw, "WORK_BYTES", 5_000)

    return take


def long(spark, m, value="value", kind="double"):
    return spark.createDataFrame([(g, s, (int if kind == "short" else float)(x)) for g, r in enumerate(m) for s, x in enumerate(r)], f"gene int, sample int, {value} {kind}")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    ns, nt, ng = 61, 60, 3
    g = rng.integers(0, 4, (ng, ns))
    g[2] = np.arange(ns) // 31  # two genotypes only, and none of them in every block
    b = rng.standard_normal((nt, ns))
    b[:ng] += g
    return {"G": long(spark, g, "geno", "short").persist(), "A": long(spark, b[:ng]).persist(), "B": long(spark, b).persist(), "C": long(spark, b[:ng] + rng.standard_normal((ng, ns))).persist()}


def table(df, keys=2):
    return {tuple(r[:keys]): tuple(r[keys:]) for r in df.collect()}


CALLS = {
    "rank_llr": lambda d: api.rank_llr(d["A"], d["B"]),
    "rank_llr_self": lambda d: api.rank_llr(d["B"], d["B"]),
    "rank_pv": lambda d: api.rank_pv(d["B"], d["B"]),
    "rank": lambda d: api.rank(d["A"], d["B"], nodiag=True),
    "gassist_pv": lambda d: api.gassist_pv(d["G"], d["A"], d["B"]),
    "gassist_pijs": lambda d: api.gassist_pijs(d["G"], d["A"], d["B"], nodiag=True),
    "cassist_llr": lambda d: api.cassist_llr(d["C"], d["A"], d["B"]),
    "cassist_pijs": lambda d: api.cassist_pijs(d["C"], d["A"], d["B"], nodiag=True),
    "few_samples": lambda d: api.rank_llr(d["B"].filter("sample < 20"), d["B"].filter("sample < 20")),
    "cov2": lambda d: agg.cov2(d["A"].withColumnRenamed("value", "z"), d["B"].withColumnRenamed("value", "z"), 61),
    "class_stats": lambda d: agg.class_stats(d["G"], d["A"].withColumnRenamed("value", "z"), d["B"].withColumnRenamed("value", "z"), 61).select("a", "b", "geno", "f", "mu_a", "mu_b"),
}


@pytest.mark.parametrize("name", CALLS)
def test_every_way_gives_the_same(data, way, name):
    keys, got = 3 if name == "class_stats" else 2, {}
    for w in WAYS:
        way(w)
        got[w] = table(CALLS[name](data), keys)
    skip = "llr" in name or "_pv" in name or name == "few_samples"  # of a row with itself rounding decides
    for w in WAYS[1:]:
        assert got[w].keys() == got["broadcast"].keys()
        for k, x in got["broadcast"].items():
            if not (skip and k[0] == k[1]):
                assert got[w][k] == pytest.approx(x, abs=1e-9, nan_ok=True), (w, k)


def written(spark):
    """Bytes that shuffles have written so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_long_rows_travel_once(spark, monkeypatch):
    """Tiles of two rows would send each of 16 rows 16 times."""
    monkeypatch.setattr(pw, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(pw, "TILE_BYTES", 320_000)
    monkeypatch.setattr(pw, "BLOCK_BYTES", 320_000, raising=False)
    genes, ns = 16, 20_000
    t = spark.range(genes * ns).select((F.col("id") % genes).cast("int").alias("gene"), F.floor(F.col("id") / genes).cast("int").alias("sample"), F.rand(1).alias("value")).persist()
    t.count()
    before = written(spark)
    got = api.rank_llr(t, t)
    assert got.filter("a <> b").agg(F.max("llr")).first()[0] < 0.001
    assert written(spark) - before < 5 * genes * ns * 8
