from __future__ import annotations

import warnings

import pytest

import __spark_entry__ as entry
from pairwright.operators.histogram import null_histograms
from pairwright.operators.pairwise import Plan
from pairwright.plans import queries
from pairwright.plans.queries import MORE_SUPPLIERS, ORACLES, QUERIES
from tests.oracle import compare, oracle_rows

SF, COMPARED = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
warnings.filterwarnings("ignore", message=".*advised")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        sf_dir = COMPARED if name in MORE_SUPPLIERS else SF
        n, differences = compare(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)
        assert not differences, differences[:3]
        assert n
    else:
        assert QUERIES[name](spark, SF).count()


def test_null_histograms_follow_the_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 3 > 0").write.parquet(f"{tmp_path}/embeddings.parquet")
    top = "SELECT max(l2), max(l3), max(l4), max(l5), (SELECT count(DISTINCT sample) FROM ea) FROM l WHERE a <> b"
    _, [(*largest, ns)] = oracle_rows(queries.fx.with_ctes(top, "ea", "eb", "ed", **queries._discrete("ed", "ea", "eb")), str(tmp_path))
    want = null_histograms(dict(zip((2, 3, 4, 5), largest)), 56, Plan("discrete", int(ns), 56).freedom, [2, 3, 10])
    got = sorted(map(tuple, QUERIES["null_hist_classes"](spark, str(tmp_path)).collect()))
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)]
    for x, y in zip(got, sorted(want)):
        assert x[3:] == pytest.approx(y[3:], rel=1e-6, abs=2e-6)


def test_ten_suppliers_are_too_few_for_posteriors(spark):
    with pytest.raises(ValueError, match="56"):
        QUERIES["sup_gassist_pijs"](spark, SF)


def test_entry(spark):
    assert entry.entry(spark).columns == ["a", "b", "p"]
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
