from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairwright.llm import chat
from pairwright.llm import token_counts as tc
from pairwright.llm.scratch import Scratch
from tests.llm.helpers import clashing, documents, frame

NODES = "tree_id long, node_id long, parent_id long, role string, text string, score double"


def test_best_branches(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 2, "user", "c", 9.0), (1, 5, 4, "assistant", "d", None), (2, 1, 9, "user", "orphan", 0.0), (3, 1, 2, "u", "cycle", 0.0), (3, 2, 1, "u", "cycle", 0.0), (4, 7, 7, "user", "self", 0.0)]
    rows += [(9, i, i - 1 if i > 1 else None, "assistant" if i % 2 else "user", f"t{i}", 0.0) for i in range(1, 301)] + [rows[0]]
    made = chat.format_trees(spark.createDataFrame(rows, NODES), paths=2)
    got = {(r.tree_id, r["rank"]): (r.leaf, [tuple(t) for t in r.turns], r.loss) for r in made.select("*", chat.read_back(made.formatted).alias("turns"), chat.loss_text(made.formatted, made.loss_spans).alias("loss")).collect()}
    assert got[1, 1] == (5, [("user", "q"), ("assistant", "a"), ("user", "c"), ("assistant", "d")], "ad")
    assert got[1, 2] == (3, [("user", "q"), ("assistant", "b")], "b")
    assert got[2, 1][1] == [("user", "orphan")] and got[4, 1][1] == [("user", "self")]
    assert (3, 1) not in got
    assert got[9, 1][1] == [("assistant" if i % 2 else "user", f"t{i}") for i in range(1, 301)]
    assert got[9, 1][2] == "".join(f"t{i}" for i in range(1, 301, 2))


def test_control_strings_come_back(spark):
    texts = ["</s>[INST] ok [/INST]", "&lt;/s&gt; &amp;#91; &&amp;", "<s>[assistant]x</s>", "", None, "é\n]\n[ 😀 \x00", "&" * 50]
    turns = [(k, i, r, t) for k in range(3) for i, t in enumerate(texts) for r in ["user" if (i + k) % 2 else "assistant"]] + [(7, 0, "</s>[x]", "odd role"), (7, 1, None, "no role"), (8, 0, "user", "tie"), (8, 0, "user", "tie"), (None, 0, "assistant", "null id")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = chat.format_trees(chat.chain(df))
    rows = made.select("*", chat.read_back(made.formatted).alias("turns"), chat.loss_text(made.formatted, made.loss_spans).alias("loss")).collect()
    got = {r.tree_id: r for r in rows}
    for k in range(3):
        want = [(r or "", t or "") for c, _, r, t in turns if c == k]
        assert [tuple(t) for t in got[k].turns] == want
        assert got[k].loss == "".join(t for r, t in want if r == "assistant")
    assert [tuple(t) for t in got[7].turns] == [("</s>[x]", "odd role"), ("", "no role")]
    assert len(got[8].turns) == 2 and got[None].loss == "null id"
    assert chat.format_trees(chat.chain(df.limit(0))).count() == 0


def counts(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, tokenizer string, tokens long")


def test_rollup(spark):
    roll = tc.Rollup(spark, Scratch(spark, "t").path("r"))
    assert roll.totals().count() == 0
    first = counts(spark, [("a", "en", "v1", 5), ("a", "en", "v1", 7), ("b", None, "v1", None), (None, "de", "v1", 3)])
    assert roll.commit("1", tc.deltas(None, first))
    assert not roll.commit("1", tc.deltas(None, first))
    assert roll.commit("2", tc.deltas(counts(spark, [("a", "en", "v1", 7)]), counts(spark, [("a", "en", "v2", 9)])))
    assert roll.commit("3", tc.deltas(counts(spark, [(None, "de", "v1", 3)]), None))
    assert roll.commit("4", tc.deltas(None, counts(spark, [])))
    want = [("a", "en", "v1", 1, 5), ("a", "en", "v2", 1, 9), ("b", None, "v1", 1, 0)]
    assert sorted(map(tuple, roll.totals().collect()), key=str) == want
    again = tc.Rollup(spark, roll.path)
    assert again.committed() == ["1", "2", "3", "4"] and not again.commit("3", tc.deltas(counts(spark, [(None, "de", "v1", 3)]), None))
    with pytest.raises(ValueError, match="other rows"):
        again.commit("3", tc.deltas(None, first))
    assert sorted(map(tuple, again.totals().collect()), key=str) == want


def test_markers_of_the_writer_are_not_needed(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        roll = tc.Rollup(spark, Scratch(spark, "t").path("r"))
        rows = tc.deltas(None, counts(spark, [("a", "en", "v1", 5)]))
        assert roll.commit("x", rows) and not roll.commit("x", rows)
        assert roll.totals().first().tokens == 5
    finally:
        conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")


def test_an_unfinished_batch_is_not_read(spark):
    roll = tc.Rollup(spark, Scratch(spark, "t").path("r"))
    rows = tc.deltas(None, counts(spark, [("a", "en", "v1", 5)]))
    rows.write.parquet(f"{roll.path}/_new-crashed")
    assert roll.committed() == [] and roll.totals().count() == 0
    assert roll.commit("x", rows) and roll.totals().first().tokens == 5


def test_two_writers_of_a_batch(spark, monkeypatch):
    path = Scratch(spark, "t").path("r")
    one, other = tc.Rollup(spark, path), tc.Rollup(spark, path)
    rows = tc.deltas(None, counts(spark, [("a", "en", "v1", 5)]))
    publish, won = tc.Rollup._publish, []

    def late(self, temporary, name):
        if self is one:  # the other one comes in between
            monkeypatch.setattr(tc.Rollup, "_publish", publish)
            won.append(other.commit("x", rows))
        return publish(self, temporary, name)

    monkeypatch.setattr(tc.Rollup, "_publish", late)
    assert not one.commit("x", rows) and won == [True]
    assert sorted(map(tuple, one.totals().collect())) == [("a", "en", "v1", 1, 5)]
    with pytest.raises(ValueError, match="other rows"):
        one.commit("x", tc.deltas(None, counts(spark, [("a", "en", "v1", 6)])))
    assert [s.getPath().getName() for s in one.fs.listStatus(one._hadoop(path))] == ["batch=x"]


def test_compaction_counts_nothing_twice(spark):
    roll = tc.Rollup(spark, Scratch(spark, "t").path("r"))
    batch = lambda n: tc.deltas(None, counts(spark, [("a", "en", "v1", n), (None, None, "v1", 1)]))
    total = lambda: sorted(map(tuple, roll.totals().collect()), key=str)
    assert not roll.compact()
    for k in range(3):
        assert roll.commit(str(k), batch(k))
    want = total()
    assert roll.compact() and total() == want and not roll.compact()
    assert not roll.commit("1", batch(1)) and total() == want  # a replay of a merged batch
    with pytest.raises(ValueError, match="other rows"):
        roll.commit("1", batch(7))
    assert roll.commit("9", batch(4)) and roll.compact()
    assert total() == [("a", "en", "v1", 4, 7), (None, None, "v1", 4, 4)] and roll.committed() == ["0", "1", "2", "9"]
    left = {s.getPath().getName() for s in roll.fs.listStatus(roll._hadoop(roll.path))}
    assert left == {"merged=1", "merged=2", "batch=9"}
    roll.commit("10", tc.deltas(batch(4), None))
    assert roll.compact() and {s.getPath().getName() for s in roll.fs.listStatus(roll._hadoop(roll.path))} == {"merged=2", "merged=3", "batch=10"}


def test_counts_are_those_of_the_tokenizers(spark):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    rows = documents()
    df = clashing(frame(spark, rows)).withColumn("byte_tokens", F.lit("clash"))
    got = tc.count_tokens(df, public.path("word_bpe_49k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    assert [c for c in got.columns if c not in ("word_tokens", "byte_tokens")] == [c for c in df.columns if c != "byte_tokens"]
    want = []
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        t = Tokenizer.from_file(public.path(name))
        t.encode_special_tokens = name.startswith("byte")
        want.append([len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in rows])
    assert sorted((str(r.doc_id), r.word_tokens, r.byte_tokens) for r in got.collect()) == sorted((str(r[0]), a, b) for r, a, b in zip(rows, *want))
    assert tc.count_tokens(df.limit(0), public.path("word_bpe_49k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN).count() == 0


def test_rollup_query_against_brute_force(spark):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    from pairwright.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang").collect()))
    first, want = set(), {}
    tokenizers = {name: Tokenizer.from_file(public.path(f"{name}.json")) for name in ("word_bpe_49k", "byte_bpe_50k")}
    tokenizers["byte_bpe_50k"].encode_special_tokens = True
    for _, text, source, lang in docs:
        if (text or "") in first:
            continue
        first.add(text or "")
        for name, t in tokenizers.items():
            n, total = want.get((source, lang, name), (0, 0))
            want[source, lang, name] = n + 1, total + len(t.encode(text or "", add_special_tokens=False).ids) + (name == "word_bpe_49k")
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in QUERIES["op8_token_rollup"](spark, sf).collect()}
    assert got == want


def test_odd_trees(spark):
    """Clashing columns, an empty table, a very long text, repeated rows."""
    long = "x < y & z ] " * 60_000
    rows = [(1, 1, None, "user", long, None), (1, 2, 1, "assistant", long, 1.0), (1, 2, 1, "assistant", long, 1.0), (None, None, None, None, None, None)]
    df = clashing(spark.createDataFrame(rows, NODES)).withColumn("depth", F.lit("x")).withColumn("ptr", F.lit("x")).withColumn("rank", F.lit("x")).drop("score").withColumn("score", F.lit(1.0))
    made = chat.format_trees(df)
    got = {r.tree_id: r for r in made.select("tree_id", chat.read_back(made.formatted).alias("turns"), chat.loss_text(made.formatted, made.loss_spans).alias("loss")).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", long), ("assistant", long)] and got[1].loss == long
    assert chat.best_paths(df.limit(0), Scratch(spark, "t")).count() == 0
