"""Many short rows: all pairs are dealt to as many tasks as their number needs, with the same results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairwright.operators import pairwise as pw
from pairwright.plans import api


@pytest.mark.parametrize("broadcast", [1 << 20, 100])
def test_tasks_are_bounded_by_pairs(spark, monkeypatch, broadcast):
    t = spark.range(60 * 40).select((F.col("id") % 60).cast("int").alias("gene"), F.floor(F.col("id") / 60).cast("int").alias("sample"), F.rand(2).alias("value")).persist()
    want = {(r["a"], r["b"]): r["p"] for r in api.rank_pv(t, t).collect()}
    monkeypatch.setattr(pw, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(pw.Pairs, "_long_rows", lambda self: False, raising=False)
    monkeypatch.setattr(pw, "TASK_PAIRS", 400, raising=False)
    got = api.rank_pv(t, t)
    most = got.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    assert most <= 4 * 400  # whole rows of A, and tiles by hash, are not all alike
    assert {(r["a"], r["b"]): pytest.approx(r["p"], abs=1e-12) for r in got.collect()} == want
