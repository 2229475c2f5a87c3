"""Packing documents into training windows, by lexical retrieval.

Every text becomes token ids and an end mark.  Full windows of a long document are sequences as they
are; its rest, and every shorter document, is packed with what resembles it.  Documents
are dealt into shards by their most telling term (frequency times rarity of the id in the
vocabulary), so that neighbours meet; a term of too many tokens is spread over several shards.  A shard builds a BM25
inverted index of its documents and then fills windows: all terms of the seed query the
index, unused documents follow in order of score, and the last is cut where the window
ends; its rest is the next seed.  What remains of a shard at the end is cut into sequences
whose lengths are powers of two, so nothing is padded at all.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm import textscan as ts
from pairwright.llm.ngram_join import _merge_slices
from pairwright.llm.scratch import Scratch
from pairwright.llm.tokens import rank_merges, word_tokenizer

K1, B = 1.2, 0.75
#: Bytes of texts that are tokenised together.
TOGETHER = 16 << 20
_SLICE = 1 << 13
PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _arrays(columns: list, names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _tokenise(path: str, by_rank: bool, end: int, window: int):
    """kind 0: a full window as a sequence; 1: the rest of a document, to be packed; 2: document frequencies, by slice."""
    names = ["kind", "doc_id", "start", "doc_tokens", "ids", "term", "slice", "counts"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(path, by_rank)
        code = np.dtype(f"<u{tok.width}")
        mark = np.array([end], code).tobytes()
        size = -(-max(tok.size, end + 1) // _SLICE) * _SLICE
        counts = np.zeros(size, np.int64)
        full = window * tok.width
        # Ids follow the order of merges, frequent ones first: log id is a fixed stand-in for idf, known before any count.
        rarity = np.log1p(np.arange(size)).astype(np.float32)
        rarity[end] = 0
        for batch in batches:
            text, doc = batch.column("text"), batch.column("doc_id")
            for i, j in ts.slices(ts.text_bytes(text)[1], TOGETHER):
                rows: list[list] = [[] for _ in names]
                raw, at = tok.encode_column(text.slice(i, j - i))
                for k, (a, b) in enumerate(itertools.pairwise(at.tolist())):
                    ids = raw[a:b] + mark
                    n = len(ids) // tok.width
                    terms, tf = np.unique(np.frombuffer(ids, code), return_counts=True)
                    counts[terms] += 1
                    telling = int(terms[np.argmax(tf * rarity[terms])])
                    d = doc[i + k].as_py()
                    for s in range(0, n, window):
                        part = ids[s * tok.width : s * tok.width + full]
                        for c, v in zip(rows, (0 if len(part) == full else 1, d, s, n, part, telling, None, None)):
                            c.append(v)
                yield _arrays(rows, names, types)
        if counts.any():
            parts = np.split(counts, size // _SLICE)
            yield _arrays([[2] * len(parts), *[[None] * len(parts)] * 5, list(range(len(parts))), [x.astype(np.uint32).tobytes() for x in parts]], names, types)

    return run


def fill_shard(docs: list[np.ndarray], idf: np.ndarray, average: float, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, from, length) that use every token of the shard once."""
    n = len(docs)
    unique = [np.unique(x, return_counts=True) for x in docs]
    of = np.repeat(np.arange(n), [len(t) for t, _ in unique])
    term = np.concatenate([t for t, _ in unique]).astype(np.int64)
    tf = np.concatenate([c for _, c in unique]).astype(np.float64)
    size = np.array([len(x) for x in docs])
    score = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[of] / average))
    order = np.argsort(term, kind="stable")
    post_doc, post_score = of[order], score[order]
    begin = np.searchsorted(term[order], np.arange(len(idf) + 1))
    first = np.r_[0, np.cumsum([len(t) for t, _ in unique])]
    unused = np.ones(n, bool)
    indexed = n
    next_seed, out = 0, []
    now: list[tuple[int, int, int]] = []
    room, seed, left = window, None, (-1, 0)
    while True:
        if left[0] >= 0:
            seed, at = left
            left = (-1, 0)
        else:
            while next_seed < n and not unused[next_seed]:
                next_seed += 1
            if next_seed == n:
                break
            seed, at = next_seed, 0
            unused[seed] = False
        now, room = [(seed, at, int(size[seed]) - at)], window - (int(size[seed]) - at)
        if room <= 0:  # only a rest as long as a window gets here
            out.append([(seed, at, window)])
            left = (seed, at + window) if room < 0 else left
            now = []
            continue
        live = int(np.count_nonzero(unused))
        if 2 * live < indexed:  # used documents leave the index, as they are never hits
            keep = unused[post_doc]
            post_doc, post_score, begin, indexed = post_doc[keep], post_score[keep], np.r_[0, np.cumsum(keep)][begin], live
        query = term[first[seed] : first[seed + 1]]
        lists = [slice(i, j) for i, j in zip(begin[query].tolist(), begin[query + 1].tolist())]
        total = np.bincount(np.concatenate([post_doc[x] for x in lists]), np.concatenate([post_score[x] for x in lists]), n)
        total[~unused] = 0
        ranked = np.flatnonzero(total)
        ranked = iter(ranked[np.argsort(-total[ranked], kind="stable")].tolist())
        while room:
            d = next(ranked, None)
            if d is None:  # nothing unused shares a term with the seed
                while next_seed < n and not unused[next_seed]:
                    next_seed += 1
                if next_seed == n:
                    break
                d = next_seed
            if not unused[d]:
                continue
            unused[d] = False
            take = min(room, int(size[d]))
            now.append((d, 0, take))
            room -= take
            if take < size[d]:
                left = (d, take)
        if room:
            break  # the shard is used up
        out.append(now)
        now = []
    out += powers_of_two(now)
    return out


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cut what doesn't fill a window into sequences whose lengths are powers of two, longest first."""
    out, rest = [], list(pieces)
    while total := sum(p[2] for p in rest):
        room, now = 1 << (total.bit_length() - 1), []
        while room:
            d, at, n = rest.pop(0)
            take = min(n, room)
            now.append((d, at, take))
            room -= take
            if take < n:
                rest.insert(0, (d, at + take, n - take))
        out.append(now)
    return out


def _pack(width: int, idf: np.ndarray, average: float, window: int):
    """Rows sorted by (shard, doc_id, start)."""
    code = np.dtype(f"<u{width}")
    names = [c.split()[0] for c in PIECE.split(", ")]
    types = [*[pa.int64()] * 6, pa.binary()]

    def work(shard: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        docs = [np.frombuffer(r[3], code) for r in rows]
        cols: list[list] = [[] for _ in names]
        for k, seq in enumerate(fill_shard(docs, idf, average, window)):
            offset = 0
            for d, at, n in seq:
                for c, v in zip(cols, (rows[d][0], rows[d][1] + at, n, rows[d][2], (shard << 24) + k, offset, docs[d][at : at + n].astype("<u4").tobytes())):
                    c.append(v)
                offset += n
            if len(cols[0]) > 500:
                yield _arrays(cols, names, types)
                cols = [[] for _ in names]
        yield _arrays(cols, names, types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            for s, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "start", "doc_tokens", "ids"))):
                if s != shard and held:
                    yield from work(shard, held)
                    held = []
                shard = s
                held.append(tuple(row))
        if held:
            yield from work(shard, held)

    return run


def _whole_windows(width: int):
    """Full windows as sequences of their own; ids are negative, by task and position."""
    from pyspark import TaskContext

    code = np.dtype(f"<u{width}")
    names = [c.split()[0] for c in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = len(batch)
            ids = [np.frombuffer(x.as_buffer(), code).astype("<u4").tobytes() for x in batch.column("ids")]
            length = pa.array(np.array([len(x) // 4 for x in ids], np.int64))
            seq = -1 - ((task << 32) + np.arange(k, k + n, dtype=np.int64))
            k += n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), length, batch.column("doc_tokens"), pa.array(seq), pa.array(np.zeros(n, np.int64)), pa.array(ids, pa.binary())], names)

    return run


def pack(docs: DataFrame, tokenizer: str, end: int = 2, window: int = 4096, shard_tokens: int = 1_000_000) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): the pieces of every row of `docs`.

    `ids` are little-endian unsigned 32-bit; a sequence's pieces follow each other by
    `offset` without gaps, and every id of a row is in one piece.  `tokenizer` is the path
    of a tokenizers file, there on every machine.  `shard_tokens` bounds what a shard holds
    in memory (up to half more, where a term is spread).  Corpus statistics (document frequencies, mean length) cover
    all documents; they and the routing table have one entry per vocabulary id.

    Null and empty texts are a single end mark.  Null ids are allowed; rows that repeat an
    id are documents of their own, with pieces of their own.  Other columns are ignored;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    by_rank = rank_merges(tokenizer)
    tok = word_tokenizer(tokenizer, by_rank)
    scan = "kind int, doc_id long, start long, doc_tokens long, ids binary, term int, slice int, counts binary"
    t = scratch.table(docs.select("doc_id", "text").mapInArrow(ts.tidied(_tokenise(tokenizer, by_rank, end, window)), scan), "tokens")
    size = -(-max(tok.size, end + 1) // _SLICE) * _SLICE
    df = np.zeros(size)  # one counter per vocabulary id
    for r in t.filter("kind = 2").select("slice", "counts").repartition(size // _SLICE, "slice").mapInArrow(ts.tidied(_merge_slices), "slice int, counts binary").collect():
        df[r["slice"] * _SLICE : (r["slice"] + 1) * _SLICE] = np.frombuffer(r["counts"], np.int64)
    rest = t.filter("kind = 1").select("term", "doc_id", "start", "doc_tokens", "ids")
    about = t.filter("kind < 2").agg(F.count_if(F.col("start") == 0), F.sum(F.octet_length("ids")), F.count_if(F.col("kind") == 1), F.sum(F.when(F.col("kind") == 1, F.octet_length("ids")))).first()
    n, average = about[0], (about[3] or 0) / tok.width / max(about[2], 1)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).clip(0).astype(np.float32)
    tokens = np.zeros(size)
    for r in rest.groupBy("term").agg(F.sum(F.octet_length("ids")).alias("b")).collect():  # at most one row per vocabulary id
        tokens[r["term"]] = r["b"] / tok.width
    parts = np.maximum(1, np.round(tokens / shard_tokens)).astype(np.int64)
    # Small terms share a shard in order of id; a large one has shards of its own.
    small = np.where(parts > 1, 0, tokens)
    base = np.floor(np.cumsum(small) / shard_tokens).astype(np.int64)
    own = int(base[-1]) + 1 if size else 0
    base = np.where(parts > 1, own + np.cumsum(np.where(parts > 1, parts, 0)) - parts, base)
    shards = int(max(own + parts[parts > 1].sum(), 1))
    # One entry per term that occurs: at most the vocabulary.
    table = spark.createDataFrame([(int(k), int(base[k]), int(parts[k])) for k in np.flatnonzero(tokens)] or [(-1, 0, 1)], "term int, base long, parts long")
    dealt = rest.join(F.broadcast(table), "term").withColumn("shard", F.col("base") + F.pmod(F.xxhash64("doc_id", "start", "doc_tokens", F.crc32("ids")), F.col("parts")))
    # Shards are of like size and numbered without gaps: dealt in turn, every task gets as many, where a hash gives some three times as many.
    tasks = max(1, min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards // 8)))
    dealt = dealt.select("shard", "doc_id", "start", "doc_tokens", "ids").repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "doc_id", "start")
    packed = dealt.mapInArrow(ts.tidied(_pack(tok.width, idf, max(average, 1.0), window)), PIECE)
    full = t.filter("kind = 0").select("doc_id", "start", "doc_tokens", "ids").mapInArrow(ts.tidied(_whole_windows(tok.width)), PIECE)
    return packed.unionByName(full)
