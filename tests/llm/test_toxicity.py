from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pairwright.llm import textscan as ts
from pairwright.llm import toxicity as tx
from tests.llm.helpers import clashing, documents, frame, prose

BAD = ["grolm", "vexarn", "sknutter"]


def labelled(seed=0, n=1200):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = prose(rng, rng.randint(5, 120)).split()
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rng.randint(2, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", "s", "ing", "ed"]))
        if rng.random() < (0.6 if toxic else 0.1):  # mentions go with toxicity in the labels
            w.insert(rng.randrange(len(w)), rng.choice(["muslims", "jews", "christians"]))
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = labelled()
    docs = frame(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, marks, tx.fit(docs, marks.filter(~tx.held_out()))


def test_held_out_accuracy(spark, fitted):
    docs, marks, model = fitted
    got = {r.doc_id: r for r in tx.score(clashing(docs), model).collect()}
    rest = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {r.doc_id for r in docs.filter(tx.held_out()).select("doc_id").collect()} == set(rest)
    right = [got[i].predicted == (i % 8 == 0) for i in rest]
    assert np.mean(right) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def score_of(model, *texts):
    return model.scores(pa.array(texts))


def test_mentions_stay_neutral(spark, fitted):
    docs, marks, model = fitted
    plain = tx.fit(docs, marks.filter(~tx.held_out()), fairness=0.0)
    logit = lambda m, t: float(np.log(score_of(m, t)[0] / (1 - score_of(m, t)[0])))
    assert model.swaps > 100
    for said in ("the muslims met here", "the jews met here", "the christians met here"):
        # Neither which group is named nor that one is named moves the score.
        without = said.replace("muslims ", "").replace("jews ", "").replace("christians ", "")
        assert abs(logit(model, said) - logit(model, without)) < 0.1
        assert logit(plain, said) >= logit(plain, without)
        assert score_of(model, said)[0] < 0.3
    assert score_of(model, "the grolms are vexarning, you sknutter")[0] > 0.8


def neutral_mentions(spark, terms):
    """Shares of clean held-out texts judged toxic: (with a mention, without, without in a model that is held to nothing)."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(1200):
        w = prose(rng, rng.randint(8, 50)).split()
        toxic = i % 4 == 0
        if toxic and rng.random() < 0.85:  # the rest is known by the mention only, which a plain model learns
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", "s"]))
        for _ in range(rng.randint(1, 2) if rng.random() < (0.7 if toxic else 0.08) else 0):
            w.insert(rng.randrange(len(w)), rng.choice(terms))
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, plain = tx.fit(docs, marks), tx.fit(docs, marks, fairness=0.0)
    clean = [prose(rng, rng.randint(8, 50)) for _ in range(300)]
    named = [f"{t} {rng.choice(tx.IDENTITY_TERMS[0])}" for t in clean]
    share = lambda m, t: float((score_of(m, *t) >= 0.3).mean())
    return share(model, named), share(model, clean), share(plain, named)


@pytest.mark.parametrize("count", [3, 6])
def test_neutral_mentions_are_not_judged(spark, count):
    named, clean, plain = neutral_mentions(spark, tx.IDENTITY_TERMS[0][:count])
    assert named <= clean + 0.03 and clean <= 0.1 and plain > named + 0.03, (named, clean, plain)


def test_scores_are_sums_of_weights(fitted):
    _, _, model = fitted
    rng = random.Random(6)
    texts = [prose(rng, n) for n in (0, 1, 5, 50, 400)] + ["grolm Grolms GROLMING", "grolm", "muslims. Muslims! é", ""]
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist()))
    for text, score in zip(texts, score_of(model, *texts)):
        words = re.findall(rb"[A-Za-z\x80-\xff]+", text.encode())
        parts = [p for w in words for p in [(w.lower(), 0), *((w.lower()[:k], 1) for k in tx.STEMS if len(w) > k)]]
        total = model.bias
        for (part, seed), n in Counter(parts).items():
            raw = np.frombuffer(part, np.uint8)
            h = int(ts.span_hashes(raw, np.array([0]), np.array([len(raw)]), seed)[0]) & ~1
            total += weight.get(h, 0) + (weight.get(h | 1, 0) if n > 1 else 0)
        assert score == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-9)


def changed(text, term, other):
    """(features that go, features that come) when every mention of `term` is replaced in the text itself."""
    swapped = re.sub(rf"\b{term}\b", other, text, flags=re.I)
    a, b = (set(tx.feature_set(t).tolist()) for t in (text, swapped))
    return tuple(sorted(a - b)), tuple(sorted(b - a))


def test_swaps_are_those_of_the_texts():
    groups = (("muslims", "jews", "christians"), ("women", "men"))
    sentences = ["the Muslims met muslims and a christian", "jews met women", " nothing here", "MEN christianity christians "]
    text = sentences[0] + ". " + sentences[1] + "!" + sentences[2] + "\n" + sentences[3]
    want = Counter()
    for part in [*(sentences[0], " " + sentences[1], sentences[3]), text]:
        for group in groups:
            for term in group:
                if re.search(rf"\b{term}\b", part, re.I):
                    for other in (*group, *tx.NEUTRAL):
                        if other != term:
                            want[changed(part, term, other)] += 1
    got = Counter()
    for (go, come), n in tx.counterfactuals(text.encode(), groups).items():
        got[tuple(sorted(go)), tuple(sorted(come))] += n
    assert got == want
    assert not tx.counterfactuals(b"", groups) and not tx.counterfactuals(b"muslims", ()) and not tx.counterfactuals(b"nobody is named", groups)


def test_counterfactual_pairs_pull_terms_together():
    pair = [(np.array([0]), np.array([1]))]
    w, _ = tx._train(np.array([0, 1]), np.array([0, 1]), np.array([1.0, 0.0]), 2, pair, 0.0, 0.0, 400)
    v, _ = tx._train(np.array([0, 1]), np.array([0, 1]), np.array([1.0, 0.0]), 2, pair, 50.0, 0.0, 400)
    assert abs(v[0] - v[1]) < 0.1 * abs(w[0] - w[1])


def test_repeated_mentions_stay_neutral(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        w = prose(rng, rng.randint(5, 60)).split()
        toxic = i % 4 == 0
        # Every term is named, muslims again in most toxic texts only and jews in the others.
        w += ["muslims", "jews"]
        if rng.random() < 0.8:
            w += ["muslims" if toxic else "jews"] * 2
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = tx.fit(docs, marks, fairness=20.0)
    logit = lambda x: np.log(x / (1 - x))
    a, b = logit(score_of(model, "the muslims met muslims", "the jews met jews"))
    assert abs(a - b) < 1.0


def test_odd_rows(spark, fitted):
    _, _, model = fitted
    rows = documents()
    df = clashing(frame(spark, rows)).drop("score")
    got = tx.score(df, model).collect()
    assert len(got) == len(rows)
    empty = score_of(model, "")[0]
    assert all(r.score == pytest.approx(empty) for r in got if r.doc_id in (900, 901, 902))
    kept = tx.drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.score < 0.3 for r in got)
    assert tx.score(df.limit(0), model).count() == 0


def test_too_few_labels(spark):
    docs = frame(spark, documents())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert score_of(tx.fit(docs, none), "a", "") == pytest.approx([0.5, 0.5])
    one = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    assert (score_of(tx.fit(docs, one), "a") < 0.3).all()


def test_slices_and_long_texts(fitted):
    _, _, model = fitted
    long = "word " * 400_000
    both = score_of(model, long, "grolm vexarn", long + "grolm vexarn sknutter grolms")
    assert both[1] == score_of(model, "grolm vexarn")[0] and both[2] > both[0]


def test_memory_does_not_follow_the_longest_text(fitted):
    import tracemalloc

    model = fitted[2]
    rng = random.Random(7)
    unit = " ".join([*prose(rng, 5000).split(), *BAD, "jews"]) + "\n"
    text = unit * (8_000_000 // len(unit.encode()))
    size = len(text.encode())
    column, raw = pa.array([text]), text.encode()
    for work in (lambda: model.scores(column), lambda: tx.feature_set(raw), lambda: tx.counterfactuals(raw, tx.IDENTITY_TERMS)):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 6 * size


@pytest.mark.parametrize("most", [1, 7, 64])
def test_pieces_of_a_text_cut_no_word(fitted, monkeypatch, most):
    model = fitted[2]
    texts = ["", " ", "grolm", "jews " * 9 + "vexarns. Jews? \0grolm" + "x" * 300, "é" * 99 + " über jews!sknutter" * 3, *(r[1] for r in documents()[:20])]
    whole = [(tx.feature_set(t), tx.counterfactuals(t.encode(), tx.IDENTITY_TERMS), score_of(model, t)[0]) for t in texts]
    monkeypatch.setattr(ts, "SLICE_BYTES", most)
    for t, (found, swaps, score) in zip(texts, whole):
        assert np.array_equal(tx.feature_set(t), found)
        assert tx.counterfactuals(t.encode(), tx.IDENTITY_TERMS) == swaps
        assert score_of(model, t)[0] == score
    assert np.array_equal(score_of(model, *texts), [x[2] for x in whole])


def test_the_sample_is_written_to_few_files(spark, fitted, monkeypatch, tmp_path):
    docs, marks, model = fitted
    monkeypatch.setattr(tx, "Scratch", lambda s, name: type("Here", (), {"table": lambda self, df, n: (df.write.parquet(str(tmp_path / n)), s.read.parquet(str(tmp_path / n)))[1]})())
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        again = tx.fit(docs, marks.filter(~tx.held_out()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "features").glob("part-*"))) <= 16
    assert np.array_equal(again.hashes, model.hashes) and np.array_equal(again.weights, model.weights)
