from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from pairwright.llm import exact_dedup, line_dedup
from tests.llm.helpers import clashing, documents, frame


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_groups(spark):
    rows = documents()
    got = exact_dedup.exact_groups(clashing(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    want = sorted((str(r[0]), str(min((x for x in groups[norm(r[1])] if x is not None), default=None)), len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_hot_group_meets_in_few_rows(spark):
    rows = [(i, "the same text" if i % 3 else f"own {i}", "en", "s", 1) for i in range(3000)]
    got = exact_dedup.exact_groups(frame(spark, rows).repartition(9), salts=4)
    assert got.filter("kept").count() == 1001
    assert {r.group_size for r in got.filter("keep_id = 1").collect()} == {2000}


def test_drop_exact_keeps_one_row_each(spark):
    rows = documents()
    df = clashing(frame(spark, rows))
    out = exact_dedup.drop_exact(df)
    assert out.columns == df.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    first = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(norm(r[1]), r[0])
    assert sorted(str(d) for d, _ in kept) == sorted(str(d) for d in first.values())
    assert exact_dedup.drop_exact(df.limit(0)).count() == 0


def brute_lines(rows, k=3):
    first, covered = {}, defaultdict(set)
    for d, t in sorted((r[0], r[1] or "") for r in rows if r[0] is not None):
        ls = t.split("\n")
        for i in range(len(ls) - k + 1):
            key = tuple(ls[i : i + k])
            if key in first and first[key] != (d, i):
                covered[d].update(range(i, i + k))
            first.setdefault(key, (d, i))
    return {d: [x for i, x in enumerate(t.split("\n")) if i not in covered[d]] for d, t in ((r[0], r[1] or "") for r in rows)}


def test_lines(spark):
    block = "l1\nl2\nl3\nl4"
    texts = [f"a\n{block}\nb", f"{block}\nc", "l2\nl3\nl4\nl1\nl2\nl3", "x\nx\nx\nx\nx", "\n\n\n\n", "", None, "l1\nl2", f"q\nl3\n{block}", "\r\nl1\r\nl2"] + ["same\npage\nfooter"] * 40
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, block, "en", "s", 1)]
    got = line_dedup.dedup_lines(clashing(frame(spark, rows))).collect()
    want = brute_lines(rows)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0 and r.kept_text == block
            continue
        assert r.kept_text == "\n".join(want[r.doc_id]), r.doc_id
        assert r.n_lines - r.n_removed == len(want[r.doc_id])
    assert len(got) == len(rows)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_long_and_repeated_rows(spark):
    rng = random.Random(2)
    page = "\n".join(f"line {rng.random()}" for _ in range(30_000))
    rows = [(1, page, "en", "s", 1), (2, "new\n" + page, "en", "s", 1), (3, "a\nb\nc", "en", "s", 1), (3, "a\nb\nc", "en", "s", 1), (4, None, "en", "s", 1)]
    got = sorted((r.doc_id, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(clashing(frame(spark, rows))).collect())
    assert got == [(1, 30_000, 0), (2, 30_001, 30_000), (3, 3, 0), (3, 3, 0), (4, 1, 0)]


def test_drop_exact_of_odd_rows(spark):
    """Own names beside the caller's, one id with several texts, null ids, ties."""
    rows = [(5, "A  b", "x", None, 1), (5, "c", "x", None, 2), (2, "A\tb", "x", None, 3), (2, "A\tb", "y", None, 4), (None, "c", "x", None, 5), (None, "only here", "x", None, 6), (None, "only here", "x", None, 7), (None, None, None, None, None), (7, "", None, None, 8)]
    df = clashing(frame(spark, rows)).withColumn("__n", F.lit("own")).withColumn("__sha", F.lit("own")).withColumn("__id", F.lit(0))
    out = exact_dedup.drop_exact(df)
    assert out.columns == df.columns
    got = sorted((str(r.doc_id), norm(r.text), r["__n"]) for r in out.collect())
    assert got == [("2", "A b", "own"), ("5", "c", "own"), ("7", "", "own"), ("None", "only here", "own")]
