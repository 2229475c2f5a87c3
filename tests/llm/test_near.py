from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from pairwright.llm import embedding_join as ej
from pairwright.llm import ngram_join as nj
from pairwright.llm.graph import components, merged, stars
from pairwright.llm.scratch import Scratch
from tests.llm.helpers import clashing, documents, frame


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    rows = [r for r in rows if r[0] is not None]
    sets = [(r[0], shingles(r[1])) for r in rows]
    u, lists = Union({r[0] for r in rows}), defaultdict(list)
    for k, (d, s) in enumerate(sets):
        met = Counter(j for g in s for j in lists[g])
        for j, c in met.items():
            if 100 * c >= 75 * (len(s) + len(sets[j][1]) - c):
                u.join(d, sets[j][0])
        for g in s:
            lists[g].append(k)
    return sorted((d, len(s), u.find(d)) for d, s in sets)


@pytest.mark.parametrize("how", [{}, {"short": 2}, {"short": 2, "rounds": 0}, {"bits": 14}, {"short": 2, "tile": 5}, {"short": 2, "tile": 3, "rounds": 0}, {"hot": 5}, {"hot": 1, "short": 4}, {"id_bits": 5}, {"id_bits": 3, "short": 4}])
def test_near_duplicates(spark, how):
    rows = documents(seed=len(str(how)))
    got = nj.near_duplicates(clashing(frame(spark, rows)), **how).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def twins(n=10, a="a", b="b"):
    """Two words of 2**n bytes that any polynomial modulo a power of two takes for one."""
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_a_polynomial_confuses(spark):
    from pairwright.llm import textscan as ts

    x, y = twins()
    text = f"{x} {y} {x[:64]} {y[:64]} {x[:63]} {y[:63]}".encode()
    assert len(set(ts.word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tolist())) == 6
    rows = [(1, x, "", "", 0), (2, y, "", "", 0), (3, x.upper(), "", "", 0)]
    assert sorted(map(tuple, nj.near_duplicates(frame(spark, rows)).collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_span_hashes_depend_on_the_bytes_alone():
    from pairwright.llm import textscan as ts

    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 3000)
    ends = starts + rng.integers(0, 140, 3000)
    h = ts.span_hashes(data, starts, ends)
    spans = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert len(set(h.tolist())) == len(set(spans)) == len(set(zip(spans, h.tolist())))


def test_large_group_of_near_copies(spark):
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(80)] = f"x{rng.random()}"
        rows.append((i, " ".join(w), "en", "s", 1))
    got = nj.near_duplicates(frame(spark, rows), short=8).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_small_tables_are_few_files(spark, monkeypatch):
    """Files of links and labels follow their rows, not the shuffle partitions: each costs an executor two processes."""
    files = {}

    def table(self, df, name, plain=Scratch.table):
        out = plain(self, df, name)
        files[name] = len(out.inputFiles())
        return out

    rows = documents(2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    monkeypatch.setattr(Scratch, "table", table)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = nj.near_duplicates(frame(spark, rows), short=8).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    small = {k: n for k, n in files.items() if k.startswith(("links", "comp", "hubs"))}
    assert len(small) > 3 and max(small.values()) <= nj.FEW


def test_lists_longer_than_a_task_holds(monkeypatch):
    """The same pairs and members come out of one long sorted stream, however little of it is held."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    sig = np.sort(rng.choice([4, 4, 4, 4, 8, 12, 16], 900)).astype(np.int64)
    o = np.concatenate([np.sort(rng.choice(10_000, n, replace=False)) for n in np.unique(sig, return_counts=True)[1]]).astype(np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(sig[i : i + 70]), pa.array(o[i : i + 70]), pa.array(np.full(len(sig[i : i + 70]), 50, np.int32)), pa.array(np.full(len(sig[i : i + 70]), 48, np.int32))], ["sig", "o", "n", "rest"]) for i in range(0, 900, 70)]

    def result():
        rows = [tuple(r.values()) for b in nj._lists(32, 3, 4)(iter(batches)) for r in b.to_pylist()]
        return {r[:3] for r in rows}

    whole = result()
    monkeypatch.setattr(nj, "HELD", 60)
    assert result() == whole and len(whole) > 1700


def test_nothing_to_join(spark):
    assert nj.near_duplicates(frame(spark, [])).count() == 0
    got = nj.near_duplicates(frame(spark, [(1, None, "", "", 0), (2, "", "", "", 0), (3, "a", "", "", 0), (4, "A\n", "", "", 0)])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 999), (999, 999), (5, 4)], "x long, y long")
    got = {r.node: r.component for r in components(edges, Scratch(spark, "t"), "c").collect()}
    assert got == {**dict.fromkeys(range(301), 0), 999: 999, 1000: 999}


def test_components_in_portions(spark):
    """Edges that come in portions, among them ones that join settled components from above and from below."""
    rng = random.Random(5)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(230)]
    comp, scratch = None, Scratch(spark, "t")
    for k in range(3):
        portion = spark.createDataFrame(edges[k * 80 : k * 80 + 80], "x long, y long")
        comp = merged(comp, portion, scratch, f"c-{k}", 2)
    union = Union(range(-200, 200))
    for a, b in edges:
        union.join(a, b)
    assert sorted(map(tuple, comp.collect())) == sorted((n, union.find(n)) for n in {n for a, b in edges if a != b for n in (a, b)})
    x, y = (np.array(e) for e in zip(*edges))
    assert {(a, b) for a, b in zip(*(z.tolist() for z in stars(x, y)))} == {(n, union.find(n)) for e in edges for n in e if union.find(n) != n}


def brute_vectors(rows, cosine):
    u, links = Union({r[0] for r in rows}), Counter()
    good = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for k, (i, v) in enumerate(good):
        for j, w in good[:k]:
            if len(v) == len(w) and float(ej.unit(np.array([v]))[0] @ ej.unit(np.array([w]))[0]) >= cosine:
                links[i] += 1
                links[j] += 1
                u.join(i, j)
    return sorted((i, links[i], u.find(i)) for i, _ in rows)


@pytest.mark.parametrize("d,how", [(16, {}), (16, {"depth": 2}), (16, {"tile": 30}), (3, {}), (64, {"cosine": 0.8})])
def test_near_vectors(spark, d, how):
    rng = np.random.default_rng(d)
    base = rng.standard_normal((12, d))
    rows = [(i, [float(np.float32(x)) for x in base[i % 12] + rng.standard_normal(d) * rng.choice([0.05, 0.2, 0.45])]) for i in range(180)]
    rows += [(500, None), (501, []), (502, [0.0] * d), (503, [float("nan")] * d), (504, [None] + [1.0] * (d - 1)), (505, rows[0][1]), (506, rows[0][1]), (507, [4 * x for x in rows[1][1]]), (508, [float("inf")] + [1.0] * (d - 1)), (509, [1.0] * (d + 5)), (510, [2.0] * (d + 5)), (511, [-0.0] * (d - 1) + [1.0]), (512, [0.0] * (d - 1) + [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ej.near_vectors(clashing(df), **how).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute_vectors(rows, how.get("cosine", 0.9))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_planted_links_among_many_vectors(spark):
    """10,000 vectors of 64 dimensions: copies at every distance around the threshold, a few blobs, the rest random."""
    rng = np.random.default_rng(5)
    m = rng.standard_normal((10_000, 64))
    for i in range(2_000):  # cosine from 0.6 to 1
        m[8_000 + i] = m[i] + rng.standard_normal(64) * rng.uniform(0, 0.9)
    m[6_000:6_300] = m[0] + rng.standard_normal((300, 64)) * rng.uniform(0.1, 0.35, (300, 1))
    m = m.astype(np.float32)
    u = ej.unit(m)
    x, y = np.nonzero(np.triu(u @ u.T >= 0.9, 1))
    up = Union(range(len(m)))
    for a, b in zip(x.tolist(), y.tolist()):
        up.join(a, b)
    links = np.bincount(np.r_[x, y], minlength=len(m))
    assert len(x) > 10_000
    df = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<float>").repartition(4)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in ej.near_vectors(df).collect())
    assert got == [(i, int(links[i]), up.find(i)) for i in range(len(m))]


def test_vectors_odd_rows(spark):
    assert ej.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (None, [1.0, 0.0])]
    got = sorted((str(r.vec_id), r.n_links) for r in ej.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [("1", 1), ("1", 1), ("1", 1), ("2", 1), ("None", 0)]


def two_texts_an_id():
    """Ids 100 to 119 have two texts each: the first is near a text of id 0 to 19, the second near one of 200 to 219."""
    rng = random.Random(9)
    rows = []
    for k in range(20):
        first, second = (" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60)) for _ in range(2))
        rows += [(100 + k, first, "en", "s", 1), (100 + k, second, "en", "s", 2), (k, first + " one", "en", "s", 3), (200 + k, second + " two", "en", "s", 4)]
    return rows


def test_an_id_with_two_texts(spark):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.near_duplicates(frame(spark, two_texts_an_id()).repartition(7)).collect())
    assert got == sorted(x for k in range(20) for x in ((100 + k, 56, k), (100 + k, 56, 100 + k), (k, 57, k), (200 + k, 57, 100 + k)))


def test_rows_of_an_id_go_by_their_own_text(spark):
    docs = frame(spark, two_texts_an_id()).repartition(7)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.n_chars) for r in kept.collect()) == sorted(x for k in range(20) for x in ((k, 3), (100 + k, 2)))


def test_components_of_odd_edges(spark):
    none = spark.createDataFrame([], "x long, y long")
    assert components(none, Scratch(spark, "t"), "c").count() == 0
    edges = spark.createDataFrame([(None, 1), (2, None), (None, None), (3, 3), (4, 5), (5, 4), (4, 5), (-9, 5)], "x long, y long")
    assert sorted(map(tuple, components(edges, Scratch(spark, "t"), "c").collect())) == [(-9, -9), (4, -9), (5, -9)]


def test_a_shared_folder_is_needed_beyond_one_process():
    from pairwright.llm.scratch import shared_dir

    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "local-cluster[2,1,1024]"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
