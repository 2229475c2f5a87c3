from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairwright.llm import mixing


def brute_targets(sizes: dict, weights, share, most) -> dict:
    """Reshare the excess by weight until no target is above its ceiling."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in held]
        rest, weight = total - sum(held.values()), sum(w[s] for s in open_)
        target = {s: rest * w[s] / weight for s in open_}
        above = [s for s in open_ if target[s] > most * sizes[s]]
        if not above:
            return held | target
        held |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 1000, "c": 40, "d": 7, "é": 300, "Z": 60}, {"a": 10, None: 1000, "b": 0}, {"x": 50}])
def test_targets_equal_resharing(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df, (3, 1, 2), 1.5, 2.0).collect()}
    want = brute_targets(sizes, (3, 1, 2), 1.5, 2.0)
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def rows(n=4000):
    return [(i, "w " * (1 + i % 17), f"s{i % 5}" if i % 3 else "hot") for i in range(n)]


def test_mix_meets_targets(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r in out:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s in target:
        assert taken[s] == pytest.approx(target[s], rel=0.12)
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in out}


def test_documents_follow_the_plan(spark):
    docs = spark.createDataFrame(rows(300), "doc_id long, text string, source string")
    plan = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns
    assert Counter(r.doc_id for r in made.collect()) == Counter({k: v for k, v in plan.items() if v})


def test_odd_rows(spark):
    odd = [(1, None, None), (None, "a b", "x"), (2, "", "x"), (2, "", "x"), (3, "a\x0bb c", "y"), (4, "é\xa0z", "y")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("target", F.lit(None).cast("string"))
    got = {(r.doc_id, r.source): r.size for r in mixing.mix(docs).collect()}
    assert got == {(1, None): 0, (None, "x"): 2, (2, "x"): 0, (3, "y"): 3, (4, "y"): 1}
    assert mixing.mix(docs).count() == 6
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_many_sources_are_joined_by_a_shuffle(spark):
    docs = spark.createDataFrame(rows(600), "doc_id long, text string, source string")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(mixing.mix(docs, few_sources=2)) == key(mixing.mix(docs))
    assert "Broadcast" not in mixing.mix(docs.hint("merge"), few_sources=2)._jdf.queryExecution().optimizedPlan().toString()
    assert key(mixing.mixed_documents(docs, few_sources=2)) == key(mixing.mixed_documents(docs))


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 400_000, "a"), (2, "x", "a"), (2, "x", "a")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.source_size) for r in mixing.mix(docs).collect()) == [(1, 400_000, 400_002), (2, 1, 400_002), (2, 1, 400_002)]
