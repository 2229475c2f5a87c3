"""Toxicity scores from a counterfactually regularised linear classifier."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm import textscan as ts
from pairwright.llm.scratch import Scratch

U64 = np.uint64
#: Groups that a neutral text may mention; terms of one group stand in for each other.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("frauen", "männer", "muslime", "juden", "christen"),
    ("femmes", "hommes", "musulmans", "juifs", "chrétiens"),
    ("mujeres", "hombres", "musulmanes", "judíos", "cristianos"),
)
#: What may stand for any term besides: nothing, or a word that names no group.
NEUTRAL = ("", "people")
#: Bytes of the word beginnings that count as features beside the words: inflected forms share them.
STEMS = (4, 5, 6, 7, 8, 9)
#: Files of the sample's features at most: it is bounded, so more would only be more small files, each of them a task and some processes.
FILES = 16

_WORDS, _SENTENCE_ENDS = re.compile(rb"[A-Za-z\x80-\xff]+"), re.compile(rb"[.!?\n]+")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature hash) of every letter run and of its beginnings."""
    inside = _LETTER[data]
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, U64)
    edges = offsets[offsets < len(data)]
    before = np.concatenate(([False], inside[:-1]))
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:], [False]))
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    low = ts.LOWER[data]
    view = ts.eights(low)
    of = np.searchsorted(offsets, starts, "right") - 1
    texts, hashes = [of], [ts.span_hashes(low, starts, ends, view=view)]
    for k in STEMS:
        long = np.flatnonzero(ends - starts > k)
        texts.append(of[long])
        hashes.append(ts.span_hashes(low, starts[long], starts[long] + k, 1, view))
    return np.concatenate(texts), np.concatenate(hashes) & ~U64(1)


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about `SLICE_BYTES` that end between letter runs, so that memory doesn't follow the longest text; only a longer run stays whole."""
    a, n = 0, len(data)
    while a < n:
        b = a + ts.SLICE_BYTES
        while b < n:
            ends = np.flatnonzero(~_LETTER[data[b : b + ts.SLICE_BYTES]])
            if len(ends):
                b += int(ends[0])
                break
            b += ts.SLICE_BYTES
        yield a, min(b, n)
        a = b


def _summed(found: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of several arrays, and how often each occurs in all of them."""
    values, n = None, None
    for x in found:
        x, k = np.unique(x, return_counts=True)
        if values is not None:
            x, of = np.unique(np.concatenate((values, x)), return_inverse=True)
            k = np.bincount(of, np.concatenate((n, k)), len(x)).astype(np.int64)
        values, n = x, k
    return (np.zeros(0, U64), np.zeros(0, np.int64)) if values is None else (values, n)


def _counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct even features of one text, and how often each occurs."""
    data = np.frombuffer(text, np.uint8)
    return _summed(features(data[a:b], np.array([0, b - a]))[1] for a, b in _pieces(data))


def feature_set(text: str | bytes) -> np.ndarray:
    """Sorted features of one text: an even hash for what occurs, the odd one after it for what occurs twice or more."""
    base, n = _counted(text.encode() if isinstance(text, str) else text)
    return np.sort(np.concatenate((base, base[n > 1] | U64(1))))


@functools.lru_cache(maxsize=4096)
def _forms(term: str) -> frozenset[int]:
    """Even features of a term that is named once."""
    return frozenset(int(h) for h in feature_set(term) & ~U64(1))


def _sentences(text: bytes) -> Iterator[bytes]:
    start = 0
    for end in _SENTENCE_ENDS.finditer(text):
        yield text[start : end.start()]
        start = end.end()
    yield text[start:]


def _named(text: bytes, known: set[bytes]) -> Iterator[bytes]:
    """Every mention of a known term."""
    return (w for m in _WORDS.finditer(text) if (w := m.group().lower()) in known)


def counterfactuals(text: bytes, groups: tuple[tuple[str, ...], ...]) -> Counter:
    """(features that go, features that come) and how often, for every swap of an identity term in a text.

    In each sentence that names a term, all its mentions there become another term of the
    group, a neutral word, or nothing; the same is done in the whole text at once, so that
    terms that are named in several sentences count as repeated.
    """
    named = {t for g in groups for t in g}
    if not named:
        return Counter()
    known = {t.encode() for t in named}
    parts = [p for p in _sentences(text) if any(_named(p, known))]
    if not parts:
        return Counter()
    if len(parts) > 1:
        parts.append(text)
    forms = {t: _forms(t) for t in (*named, *NEUTRAL)}
    watched = frozenset().union(*forms.values())
    out: Counter = Counter()
    for p in parts:
        mentions = Counter(w.decode() for w in _named(p, known))
        base, n = _counted(p)
        count = {h: k for h, k in zip(base.tolist(), n.tolist()) if h in watched}
        for group in groups:
            for term in group:
                if not mentions[term]:
                    continue
                for other in (*group, *NEUTRAL):
                    if other == term:
                        continue
                    go, come = [], []
                    for h in sorted(forms[term] ^ forms[other]):
                        before = count.get(h, 0)
                        after = before + (mentions[term] if h in forms[other] else -mentions[term])
                        for least, f in ((1, h), (2, h | 1)):
                            if (before >= least) != (after >= least):
                                (come if after >= least else go).append(f)
                    out[tuple(go), tuple(come)] += 1
    return out


@dataclass(frozen=True)
class Model:
    """Selected feature hashes (sorted), their weights, the intercept, and how many swaps the fit was held to."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    swaps: int = 0

    def scores(self, column) -> np.ndarray:
        data, off = ts.text_bytes(column)
        out = np.full(len(off) - 1, self.bias)
        bases, of = np.unique(self.hashes & ~U64(1), return_inverse=True)
        again = (self.hashes & U64(1)).astype(bool)
        once, twice = (np.bincount(of[x], self.weights[x], len(bases)) for x in (~again, again))
        likely = np.zeros(1 << 16, bool)
        likely[(bases >> U64(48)).astype(np.int64)] = True

        def pairs(part: np.ndarray, edges: np.ndarray) -> np.ndarray:
            """Text and feature as one number, for every feature that has a weight."""
            text, h = features(part, edges)
            maybe = likely[(h >> U64(48)).astype(np.int64)]
            text, h = text[maybe], h[maybe]
            at = np.minimum(np.searchsorted(bases, h), len(bases) - 1)
            hit = bases[at] == h
            return text[hit] * len(bases) + at[hit]

        for i, j in ts.slices(off) if len(bases) else ():
            part, edges = data[off[i] : off[j]], off[i : j + 1] - off[i]
            pair, n = _summed(pairs(part[a:b], np.clip(edges, a, b) - a) for a, b in _pieces(part))
            pair = pair.astype(np.int64)
            out[i:j] += np.bincount(pair // len(bases), once[pair % len(bases)] + np.where(n > 1, twice[pair % len(bases)], 0), j - i)
        return 1.0 / (1.0 + np.exp(-np.clip(out, -500, 500)))


_SWAPS = pa.list_(pa.struct([("go", pa.list_(pa.int64())), ("come", pa.list_(pa.int64())), ("n", pa.int64())]))


def _featurised(groups):
    def signed(hashes) -> list[int]:
        return np.array(hashes, U64).view(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = ts.text_bytes(batch.column("text"))
            for i, j in ts.slices(off):
                rows, swaps = [], []
                for k in range(i, j):
                    text = data[off[k] : off[k + 1]].tobytes()
                    rows.append(feature_set(text).view(np.int64))
                    swaps.append([{"go": signed(go), "come": signed(come), "n": n} for (go, come), n in counterfactuals(text, groups).items()])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "toxic")), pa.array(rows, pa.list_(pa.int64())), pa.array(swaps, _SWAPS)], ["doc_id", "toxic", "features", "swaps"])

    return run


def _among(hashes: np.ndarray):
    """Each row's features as positions in `hashes` (sorted); others go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for f in batch.column("features"):
                x = f.values.to_numpy(zero_copy_only=False).view(U64)
                at = np.minimum(np.searchsorted(hashes, x), max(len(hashes) - 1, 0))
                rows.append(np.sort(at[hashes[at] == x]).astype(np.int32) if len(hashes) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "toxic", "at"])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, toxic, text) of at most `per_class` labelled documents of each class, those with the smallest id hash.

    Repeated labels of a document count once, toxic if any says so.  The id list that is
    broadcast has at most 2 * `per_class` rows.
    """
    one = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = None
    for c in (0, 1):
        part = one.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, top: int = 4096, fairness: float = 1.0, sparsity: float = 5e-4, rounds: int = 300, groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> Model:
    """Fit on a bounded sample: at most `per_class` labelled documents of either class.

    Documents are sets of hashed words and word beginnings, each in two forms: it occurs, it occurs again.  The `top` features whose
    frequency differs most between the classes enter an L1-regularised logistic
    regression.  In each labelled sentence that names an identity term, the term is swapped for the others of its group,
    a neutral word and nothing, and `fairness` times the mean squared change of the score
    is added to the loss: neither which group is named nor that one is named moves the
    score much, however mentions were distributed over the labels.  Texts without such a
    term give no swap, and without any the model is a plain L1 regression.  Scores depend on
    the text only.  Without rows of both classes the model is the constant 0.5, or the only class seen: 0 or 1 smoothed.

    Null texts count as empty, labels without document and documents without label aren't
    used, rows that repeat a document count once.  Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = labelled_sample(docs, labels, per_class).mapInArrow(ts.tidied(_featurised(groups)), "doc_id long, toxic int, features array<long>, swaps array<struct<go: array<long>, come: array<long>, n: long>>")
    sample = scratch.table(sample.distinct().coalesce(FILES), "features")  # rows that repeat a document count once
    n0, n1 = sample.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    if not n0 or not n1:
        return Model(np.zeros(0, U64), np.zeros(0), float(np.log1p(n1) - np.log1p(n0)))
    counts = sample.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n"))
    rate = F.col("n") / F.lit(float(n0 + n1))
    z = F.abs(F.col("pos") / F.lit(float(n1)) - (F.col("n") - F.col("pos")) / F.lit(float(n0))) / F.sqrt(rate * (1 - rate) + 1e-12)
    best = counts.filter("n >= 3").withColumn("z", z).orderBy(F.col("z").desc(), "f").limit(top).select("f")
    terms = np.array(sorted({f for g in groups for t in g for h in _forms(t) for f in (h, h | 1)}), U64).view(np.int64).tolist()
    named = counts.filter(F.col("f").isin(terms)).select("f")
    hashes = np.unique(np.array([r["f"] for r in best.union(named).collect()], np.int64).view(U64))  # at most `top` and the terms'
    # As Arrow, at most 2 * `per_class` rows: Python objects for each number would take many times the memory.
    rows = sample.select("doc_id", "toxic", "features").mapInArrow(ts.tidied(_among(hashes)), "doc_id long, toxic int, at array<int>").orderBy("doc_id", "toxic", "at").toArrow()
    y, at = rows.column("toxic").to_numpy().astype(float), rows.column("at")
    x_row, x_col = np.repeat(np.arange(len(y)), pc.list_value_length(at).to_numpy()), pc.list_flatten(at).to_numpy().astype(np.int64)
    # Swaps that move the same features are one row; they differ by terms and by which beginnings a sentence has elsewhere.
    swaps = sample.select(F.explode("swaps").alias("s")).groupBy("s.go", "s.come").agg(F.sum("s.n").alias("n")).orderBy("go", "come").collect()
    pairs, often = [], []
    for r in swaps:
        go, come = (_positions(np.array(x, np.int64).view(U64), hashes) for x in (r["go"], r["come"]))
        pairs.append((go, come))
        often.append(r["n"])
    w, bias = _train(x_row, x_col, y, len(hashes), pairs, fairness, sparsity, rounds, np.array(often, float))
    used = np.flatnonzero(w)
    del rows, at, x_row, x_col
    ts.tidy()
    return Model(hashes[used], w[used], bias, int(sum(often)))


def _positions(f: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places in `hashes` (sorted); what isn't there has no weight to move."""
    at = np.minimum(np.searchsorted(hashes, f), max(len(hashes) - 1, 0))
    return at[hashes[at] == f] if len(hashes) else at[:0]


def _curvature(apply, size: int, rounds: int = 40) -> float:
    """The largest eigenvalue of a symmetric positive operator, by power iteration from a fixed start."""
    v, most = 1.0 + np.arange(size) % 7, 0.0
    for _ in range(rounds):
        v = v / np.sqrt(v @ v)
        u = apply(v)
        most = max(most, float(v @ u))
        if not u.any():
            break
        v = u
    return most


def _train(row, col, y, size, pairs, fairness, sparsity, rounds, often=None) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on mean logistic loss + L1 + fairness * mean squared score change of the pairs.

    `often`: how many swaps each pair (features that go, that come) stands for.
    """
    n = len(y)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    go = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs]) if pairs else np.zeros(0, int)
    which = np.concatenate([np.concatenate(p) for p in pairs]).astype(int) if pairs else np.zeros(0, int)
    sign = np.concatenate([np.r_[-np.ones(len(a)), np.ones(len(b))] for a, b in pairs]) if pairs else np.zeros(0)
    share = np.ones(len(pairs)) if often is None else often
    share = share / max(share.sum(), 1)

    def unfair(v):
        change = np.bincount(go, sign * v[which], len(pairs)) if len(pairs) else np.zeros(0)
        return 2 * fairness * np.bincount(which, sign * (share * change)[go], size)

    def second(vb):
        margin = weight * (np.bincount(row, vb[col], n) + vb[size])
        return np.r_[0.25 * np.bincount(col, margin[row], size) + unfair(vb[:size]), 0.25 * margin.sum()]

    step = 1.0 / (1.1 * _curvature(second, size + 1) + 1e-9)
    w, b = np.zeros(size), 0.0
    v, c, t = w, b, 1.0
    for _ in range(rounds):
        margin = np.bincount(row, v[col], n) + c
        g = weight * (1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500))) - y)
        new = v - step * (np.bincount(col, g[row], size) + unfair(v))
        new = np.sign(new) * np.maximum(np.abs(new) - step * sparsity, 0)
        new_b, new_t = c - step * g.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        if (new - w) @ (v - new) > 0:  # restart
            new_t = 1.0
        v, c = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    return w, float(b)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted), one row per row of `docs`; one narrow pass, no shuffle.

    Null and empty texts get the model's score of an empty set.  Only `text` is an input
    of a score.  Other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(ts.tidied(run), "doc_id long, score double, predicted int")


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt from: crc32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """`docs` without the rows whose score reaches `threshold`; all columns and row copies stay.

    A model without features, as after a fit without labels of both classes, tells no document from another and drops none.
    """
    if not len(model.hashes):
        return docs
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = model.scores(batch.column(names.index("text"))) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(ts.tidied(run), schema)
