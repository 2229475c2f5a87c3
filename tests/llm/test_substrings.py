from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from pairwright.llm import substring_dedup as sd
from tests.llm.helpers import clashing, documents, frame


def brute(rows, length=400):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((str(d), len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out)


def result(df, **how):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in sd.remove_repeats(df, **how).collect())


def overlapping():
    rng = random.Random(3)
    page = "".join(rng.choice("abcdef \n") for _ in range(3000))
    rows = []
    for i in range(60):
        a = rng.randrange(0, 2500)
        cut = page[a : a + rng.randrange(300, 500)]
        rows.append((i, "".join(rng.choice("xyz é") for _ in range(rng.randrange(0, 300))) + cut + "".join(rng.choice("xyzé\0") for _ in range(rng.randrange(0, 300))), "en", "s", 1))
    odd = ["a" * 3000, "ab" * 900, None, "", "a" * 399, "\0" * 700, "b" * 400, "Q" * 10 + "b" * 400, page, page[:1000] + "\0" * 5 + page[1000:]]
    return rows + [(100 + i, t, "en", "s", 1) for i, t in enumerate(odd)]


@pytest.mark.parametrize("how", [{}, {"hot": 1}])
def test_overlapping_passages(spark, how):
    rows = overlapping()
    assert result(clashing(frame(spark, rows)).repartition(5), **how) == brute(rows)


def test_documents(spark):
    rows = [r for r in documents() if r[0] not in (903, 904)]
    assert result(frame(spark, rows)) == brute(rows)


def test_texts_longer_than_a_segment(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    rows = [(1, long, "", "", 0), (2, "z" * 50 + long[1_040_000:1_060_000] + "y" * 60, "", "", 0)]
    got = {r.doc_id: (r.n_removed, [(s["start"], s["end"]) for s in r.spans]) for r in sd.remove_repeats(frame(spark, rows)).collect()}
    assert got == {1: (20_000, [(1_040_000, 1_060_000)]), 2: (20_000, [(50, 20_050)])}


@pytest.mark.parametrize("how", [{}, {"hot": 1}])
def test_long_texts_keep_what_occurs_once(spark, how):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2_200_000))
    twice = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000)) + "!"
    rows = [(1, long, "", "", 0), (2, twice + "?" + twice[300_000:301_000] + "#", "", "", 0)]
    got = {r.doc_id: (r.n_removed, [(s["start"], s["end"]) for s in r.spans]) for r in sd.remove_repeats(frame(spark, rows), **how).collect()}
    n = len(twice) + 1
    assert got == {1: (0, []), 2: (2_000, [(300_000, 301_000), (n, n + 1_000)])}


@pytest.mark.parametrize("beyond", [-1, 0, 1, 399, 400, 401])
def test_each_start_is_in_one_segment(beyond):
    most, length = 1 << 20, 400
    for k in (1, 2, 3):
        n = k * (most - length + 1) + length - 1 + beyond  # k segments hold the starts of all but `beyond` strings
        off = np.array([0, 500, 500 + n, 1_000 + n], np.int64)
        starts = [(max(a, off[t]), min(b, off[t + 1]) - length) for i, j, a, b in sd._segments(off, length) for t in range(i, j)]
        assert sum(b - a + 1 for a, b in starts if b >= a) == 101 + (n - length + 1) + 101
        assert all(x[1] < y[0] for x, y in zip(starts, starts[1:]))


def test_other_lengths_and_empty(spark):
    rows = overlapping()[:30]
    assert result(frame(spark, rows), length=300) == brute(rows, 300)
    assert sd.remove_repeats(frame(spark, [])).count() == 0
    with pytest.raises(ValueError, match="length"):
        sd.remove_repeats(frame(spark, rows), length=100)


def twin_texts():
    """Strings that a polynomial modulo a power of two takes for equal, none of which repeats."""
    from tests.llm.test_near import twins

    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("cdefgh") for _ in range(n))
    rows = []
    for i, word in enumerate(twins(9)):
        rows.append((i, noise(300) + word[:390] + noise(300), "", "", 0))
        rows.append((10 + i, noise(300) + word + noise(300), "", "", 0))
    return rows


@pytest.mark.parametrize("how", [{}, {"hot": 1}])
def test_strings_that_a_polynomial_confuses(spark, how):
    rows = twin_texts()
    assert result(frame(spark, rows), **how) == brute(rows)


def test_ids_that_repeat(spark):
    a, b = overlapping()[3][1], overlapping()[60][1]
    rows = [(1, a * 3, "", "", 0), (1, a * 3, "", "", 0), (1, b, "", "", 0), (None, b + "x", "", "", 0), (None, "y" * 20 + a, "", "", 0)]
    assert result(frame(spark, rows)) == brute(rows)


def test_one_very_common_passage(spark):
    """Over many partitions, as a hot key meets them."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefghij klm") for _ in range(700))
    rows = [(i, "".join(rng.choice("nopqrs tuvw") for _ in range(rng.randrange(0, 250))) + (passage[rng.randrange(0, 150) : 700 - rng.randrange(0, 150)] if i % 3 else "") + "".join(rng.choice("nopqrs") for _ in range(rng.randrange(0, 250))), "", "", 0) for i in range(900)]
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        got = result(frame(spark, rows).repartition(61))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute(rows)
