from __future__ import annotations

import itertools
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pairwright.llm import packing, tokens
from tests.llm.helpers import clashing, documents, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("by_rank", [True, False])
def test_tokens_equal_the_tokenizers(by_rank):
    odd = ["İstanbul ſtraße ﬁ", "a<|endoftext|>b", "it's  We'LL 12½²", "x\x1cy\x85z w", "​q", "ÀÉ ÿ Ÿ ŉ", "", "日本語 text", "a­b", "😀 ok", "ΑΣ ΑΣ. ΟΔΟΣ", "a\xa0b　c", "é ̈x", "\x0b\x0ca", "<| endoftext|>", "�", "aaaa aaaaaaa \x00\x01 b"]
    texts = [r[1] or "" for r in documents()] + odd
    want = [np.array(e.ids, "<u2").tobytes() for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    tok = tokens.WordTokenizer(PATH, by_rank)
    assert tok.encode([t.encode() for t in texts]) == want
    tok.forget()
    assert tok.encode([t.encode() for t in texts[::-1]]) == want[::-1]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER", 20)
    texts = [(r[1] or "").encode() for r in documents()][:80]
    tok, fresh = tokens.WordTokenizer(PATH, True), tokens.WordTokenizer(PATH, False)
    for t in texts:
        assert tok.encode([t]) == fresh.encode([t])


def test_columns_are_encoded_like_texts():
    texts = [None, "", " \t\n", " lead", "trail \x0b", None, "a  b\x1cc", "x" * 5000 + " y", "b a"]
    tok, want = tokens.WordTokenizer(PATH, True), [tokens.WordTokenizer(PATH, False).encode([(t or "").encode()])[0] for t in texts]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["cut off", *texts], kind).slice(1)
        raw, off = tok.encode_column(column)
        assert [raw[a:b] for a, b in itertools.pairwise(off.tolist())] == want
        raw, off = tok.encode_column(column.slice(0, 0))
        assert (raw, off.tolist()) == (b"", [0])
    raw, off = tok.encode_column(pa.array([None, None], pa.string()))
    assert (raw, off.tolist()) == (b"", [0, 0, 0])


def test_rank_merges_hold_for_the_file():
    assert tokens.rank_merges(PATH)
    assert not tokens.rank_merges(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, pieces, window):
    tk = Tokenizer.from_file(PATH)
    want = Counter((r[0], tuple([*tk.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in rows)
    sequences, found = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length * 4 == len(p.ids) > 0
        sequences[p.sequence_id].append((p.offset, p.length))
        found[p.doc_id].append(p)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window and at & (at - 1) == 0  # full, or a power of two
    for (d, ids), n in want.items():
        if sum(v for (x, _), v in want.items() if x == d) == 1:
            mine = sorted(found[d], key=lambda p: p.start)
            assert b"".join(bytes(p.ids) for p in mine) == np.array(ids, "<u4").tobytes()
            assert [p.start for p in mine] == np.cumsum([0, *[p.length for p in mine[:-1]]]).tolist()
            assert {p.doc_tokens for p in mine} == {len(ids)}
    assert sum(p.length for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())


@pytest.mark.parametrize("how", [{}, {"window": 64, "shard_tokens": 500}, {"window": 256, "shard_tokens": 100_000}])
def test_pieces(spark, how):
    rows = documents()
    check(rows, packing.pack(clashing(frame(spark, rows)), PATH, **how).collect(), how.get("window", 4096))


def test_empty(spark):
    assert packing.pack(frame(spark, []), PATH).count() == 0
    check([(1, None, "", "", 0)], packing.pack(frame(spark, [(1, None, "", "", 0)]), PATH).collect(), 4096)


def test_neighbours_share_a_window():
    rng = np.random.default_rng(0)
    topics = [rng.choice(5000, 40, replace=False) for _ in range(10)]
    docs = [rng.choice(topics[i % 10], 60) for i in range(200)]
    out = packing.fill_shard(docs, np.ones(5000, np.float32), 60.0, 240)
    assert Counter(d for s in out for d, _, _ in s) >= Counter(range(200))
    pure = [len({d % 10 for d, _, _ in s}) for s in out]
    assert np.mean(pure) < 1.6  # by chance it would be about 3.4


def test_any_term_of_the_seed_finds_neighbours():
    idf = np.linspace(5, 0.5, 200).astype(np.float32)
    seed, strangers = np.arange(60), [np.arange(100 + 10 * i, 110 + 10 * i) for i in range(5)]
    near = np.r_[59, np.arange(180, 189)]  # shares the seed's least telling term only
    out = packing.fill_shard([seed, *strangers, near], idf, 20.0, 70)
    assert out[0] == [(0, 0, 60), (6, 0, 10)]


def test_neighbours_follow_by_score_over_all_terms():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 400, rng.integers(30, 90)) for _ in range(150)]
    idf, window = rng.uniform(0.1, 6, 400).astype(np.float32), 256
    average = float(np.mean([len(d) for d in docs]))

    def score(seed, d):
        return sum(float(idf[t]) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / average)) for t in set(docs[seed].tolist()) if (tf := int((docs[d] == t).sum())))

    unused = set(range(150))
    for seq in [s for s in packing.fill_shard(docs, idf, average, window) if sum(n for _, _, n in s) == window]:
        seed = seq[0][0]
        unused.discard(seed)
        for d, _, _ in seq[1:]:
            assert score(seed, d) >= max(score(seed, x) for x in unused) - 1e-6
            unused.discard(d)


def test_powers_of_two():
    out = packing.powers_of_two([(0, 5, 100), (1, 0, 3)])
    assert [sum(n for _, _, n in s) for s in out] == [64, 32, 4, 2, 1]
    assert out[-1] == [(1, 2, 1)] and packing.powers_of_two([]) == []
