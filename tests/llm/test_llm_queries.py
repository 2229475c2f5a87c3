from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairwright.llm import mixing
from pairwright.llm.queries import ORACLES, QUERIES
from pairwright.llm.scratch import Scratch
from tests.llm.helpers import clashing, documents, frame
from tests.llm.test_near import brute as brute_near
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op8_token_rollup"}))  # that one has a brute-force test of its own
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        n, differences = compare(df, ORACLES[name], SF)
        assert n and not differences, differences[:3]
    else:
        table = "embeddings" if name.startswith("op10") else "documents"
        found = df.select(df.columns[0]).distinct().count()
        assert found == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_ten_operators():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES} == set(range(1, 11))


def test_pipeline_stages(spark):
    """Each stage against brute force on what its predecessor kept."""
    scratch = Scratch(spark, "t")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(scratch.table(stage(spark, seen[-1], SF), name))
    for df in seen[1:-1]:
        assert df.columns == names
    rows = [[(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()] for df in seen[:-1]]
    toxic = {r.doc_id for r in QUERIES["op2_toxicity"](spark, SF).filter("predicted = 1").collect()}
    assert sorted(r[0] for r in rows[1]) == sorted(r[0] for r in rows[0] if r[0] not in toxic)
    first = {}
    for r in sorted(rows[1]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    assert sorted(rows[2]) == sorted(first.values())
    near = brute_near(rows[2])
    assert sorted(r[0] for r in rows[3]) == [d for d, _, c in near if d == c]
    plan = {r.doc_id: r.copies for r in mixing.mix(seen[3]).collect()}
    assert Counter(r[0] for r in rows[4]) == Counter({d: n for d, n in plan.items() if n})
    pieces = seen[-1]
    assert pieces.agg(F.sum(F.when(F.col("start") == 0, 1))).first()[0] == len(rows[4])
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in rows[4]}


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mixing", "packing"]
    a = corpus_pipeline.run(spark, SF).agg(F.sum("length"), F.count(F.lit(1))).first()
    assert a[0] > 0 and hashlib.sha256(str(a).encode())


def odd_documents(spark):
    return clashing(frame(spark, documents(seed=3)))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, name, tmp_path):
    """Nulls, empty and very long texts, repeated ids and rows, clashing columns, an empty table."""
    labels = [(r[0], 1, int(bool(r[1]) and len(r[1]) % 2)) for r in documents(seed=3) if r[0] is not None] + [(None, None, 1), (3, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage, df = dict(corpus_pipeline.STAGES)[name], odd_documents(spark)
    out, none = stage(spark, df, str(tmp_path)), stage(spark, df.limit(0), str(tmp_path))
    assert none.count() == 0
    if name != "packing":
        assert out.columns == none.columns == df.columns
        before = Counter((str(r.doc_id), r.text) for r in df.collect())
        after = Counter((str(r.doc_id), r.text) for r in out.collect())
        assert set(after) <= set(before) and after
        if name != "mixing":
            assert not after - before
    else:
        assert out.select("doc_id").distinct().count() == df.select("doc_id").distinct().count()


def test_run_on_odd_rows(spark, tmp_path):
    frame(spark, documents(seed=3)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # Without labels no document is rejected.
    packed = {str(r.doc_id) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert len(packed) > 100 and "None" in packed


def test_unlinked_rows_of_a_repeated_id_stay(spark):
    rng = random.Random(5)
    a, b = (" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(40)) for _ in range(2))
    docs = frame(spark, [(1, a, "en", "s", 1), (5, a + " tail", "en", "s", 2), (5, b, "en", "s", 3)])
    assert sorted(r.n_chars for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3]
