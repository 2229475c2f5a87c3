"""Removal of long repeated substrings, by prefix-free parsing.

Every text is parsed at triggers of a rolling hash: the start of the least hash among any
`SPAN` consecutive ones.  Whether a position is a trigger depends on nearby bytes only,
so equal strings are parsed alike wherever they stand, and a string of `length` bytes
belongs to the one trigger that is least in its first `SPAN` positions.  What it consists of
is a suffix of the phrase before that trigger and a prefix of the text after it.

1. Dictionary.  Triggers are dealt by a digest of the bytes that all their strings share.  A
   trigger that is alone has no repeated string; most text ends here.  Triggers whose
   whole ranges are equal, by a digest of 128 bits, are repeated entirely, and one of them stands for all.
2. Order.  What is left, a trigger for each distinct range, is sorted twice per dealt
   group: by the text after the trigger (the suffix order of the parse) and by the
   reversed phrase before it (the order of dictionary suffixes).  Common-prefix lengths
   of neighbours cut each order into classes for every depth, and two strings are equal
   if and only if both their classes are: the combination that gives corpus order.
3. Spans.  Repeated strings are merged to maximal runs per document.

A text shared by very many documents, or repeated within one, sends one row per batch to its
task in step 1; the other rows are known to be repeated and are dealt evenly.  Where more than `hot` distinct ranges share a trigger's bytes, step 2 instead
hashes each of their strings and deals by that, so no task gets such a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm import textscan as ts
from pairwright.llm.scratch import Scratch

U64 = np.uint64
#: Bytes hashed for a trigger, positions of which one is a trigger, bytes of a digest.
ROLL, SPAN, MIDDLE = 16, 200, 16
_POS = 21
_MASK = U64((1 << _POS) - 1)


def _rolled(data: np.ndarray) -> np.ndarray:
    """A hash of the `ROLL` = 16 bytes from each position on; it only has to pick triggers."""
    view = ts.eights(data)[: len(data) - 7].copy()
    x = view[:-8] * U64(0x9E3779B97F4A7C15) + view[8:] * U64(0xC2B2AE3D27D4EB4F)
    x ^= x >> U64(32)
    return x * U64(0xD6E8FEB86659FD93)


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(n, 2): 128 bits of BLAKE2b of each range, which stand for its bytes from here on."""
    raw, blake = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    return np.frombuffer(b"".join([blake(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())]), "<u8").reshape(-1, 2)


def _least(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every `span` consecutive values."""
    width, m = 1, x
    while width * 2 <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = span - width
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def _segments(off: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last text, from byte, to byte): texts together, or parts of a long one, where each string starts in exactly one."""
    most = 1 << (_POS - 1)
    for i, j in ts.slices(off, most):
        if off[j] - off[i] <= most:
            yield i, j, int(off[i]), int(off[j])
        else:
            for a in range(int(off[i]), int(off[j]) - length + 1, most - length + 1):
                yield i, j, a, min(a + most, int(off[j]))


def triggers(data: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, key, two halves of whole, first start, last start, trigger), offsets within the text, for every trigger that owns strings."""
    for i, j, a, b in _segments(off, length):
        part = data[a:b]
        if len(part) < length:
            continue
        roll = _rolled(part)
        tagged = (roll & ~_MASK) | np.arange(len(roll), dtype=U64)
        at = (_least(tagged, SPAN) & _MASK).astype(np.int64)
        ends = np.minimum(off[i + 1 : j + 1], b) - a
        starts = np.maximum(off[i:j], a) - a
        count = np.maximum(ends - starts - length + 1, 0)
        use = np.flatnonzero(count)
        if not len(use):
            continue
        count = count[use]
        text = np.repeat(use, count)
        s = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[use], count)
        p = at[s]
        new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (text[1:] != text[:-1])])
        first, last, p, text = s[new], s[np.r_[new[1:] - 1, len(s) - 1]], p[new], text[new]
        key = _digests(part, p, p + (length - SPAN + 1))[:, 0]
        whole = _digests(part, first, last + length)
        place = ts.mix((p - first).astype(U64))
        back = off[i + text] - a
        yield i + text, key, whole[:, 0] ^ place, whole[:, 1], first - back, last - back, p - back


ROW = ["key", "whole", "half", "rid", "first", "last", "at", "state"]


def _parse(length: int):
    """One row per trigger.  Ranges met twice within a batch are known to be repeated: one row of
    them goes to the others of its key as `state` 1, the rest are dealt at random as 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = ts.text_bytes(batch.column("text"))
            rid = batch.column("rid").to_numpy()
            found = list(triggers(data, off, length))
            if not found:
                continue
            text, key, whole, half, first, last, at = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((half, whole, key))
            same = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (key, whole, half)])
            state = np.zeros(len(key), np.int32)
            state[order] = np.where(np.r_[False, same], 2, np.where(np.r_[same, False], 1, 0))
            own = rid[text]
            key = np.where(state == 2, ts.mix(own.view(U64) + at.astype(U64) * U64(0x9E3779B97F4A7C15)), key)
            for s in range(0, len(key), 100_000):
                cut = slice(s, s + 100_000)
                yield pa.RecordBatch.from_arrays([*(ts.long_array(x[cut]) for x in (key, whole, half)), pa.array(own[cut]), *(pa.array(x[cut].astype(np.int32)) for x in (first, last, at, state))], ROW)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, whole, half).  kind 0: a range that is repeated as a whole; where a key
    has several ranges, 1: one of those, 2: a range that is alone."""
    names = ["kind", "key", "rid", "first", "last", "at"]
    waiting = None  # the representative of a key's first range, while it has only one
    last_key, last_many = None, False

    def out(kind, rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.asarray(kind, np.int32), len(rows[0]))), *(pa.array(rows[k]) for k in (0, 3, 4, 5, 6))], names)

    def changes(rows) -> np.ndarray:
        return np.logical_or.reduce([x[1:] != x[:-1] for x in rows[:3]])

    def work(rows) -> Iterator[pa.RecordBatch]:
        """Whole runs of equal (key, whole, half)."""
        nonlocal waiting, last_key
        start = np.flatnonzero(np.r_[True, changes(rows)])
        size = np.diff(np.r_[start, len(rows[0])])
        several_rows = np.add.reduceat(1 + (rows[7] == 1), start) > 1
        full = np.repeat(several_rows, size)
        if full.any():
            yield out(0, [x[full] for x in rows])
        head = [x[start] for x in rows]
        kind = np.where(several_rows, 1, 2).astype(np.int32)
        same = np.r_[False, head[0][1:] == head[0][:-1]]
        several = same | np.r_[same[1:], False]
        if last_key is not None and head[0][0] == last_key:
            several[0] = True
            if waiting is not None:
                yield out(waiting[1], waiting[0])
        waiting = None if several[-1] else ([x[-1:] for x in head], kind[-1:])
        last_key = head[0][-1]
        if several.any():
            yield out(kind[several], [x[several] for x in head])

    held = None
    for batch in batches:
        if not len(batch):
            continue
        now = [batch.column(k).to_numpy() for k in range(8)]
        known = now[7] == 2
        if known.any():
            yield out(0, [x[known] for x in now])
            now = [x[~known] for x in now]
            if not len(now[0]):
                continue
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        if len(held[0]) < 100_000:
            continue
        run = np.flatnonzero(changes(held))
        if len(run):
            cut = int(run[-1]) + 1
            yield from work([x[:cut] for x in held])
            held = [x[cut:] for x in held]
        elif len(held[0]) > 400_000:  # one range everywhere: surely repeated, only two rows of it must wait
            yield out(0, [x[2:] for x in held])
            held = [x[:2] for x in held]
    if held is not None and len(held[0]):
        yield from work(held)


def _contexts(length: int):
    names = ["key", "kind", "rid", "at", "low", "high", "before", "after"]
    shared = length - SPAN + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = ts.text_bytes(batch.column("text"))
            cols: list[list] = [[] for _ in names]
            for i, (rid, marks) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("marks").to_pylist())):
                text = data[off[i] : off[i + 1]].tobytes()
                for m in marks:
                    p = m["at"]
                    middle = hashlib.blake2b(text[p : p + shared], digest_size=MIDDLE).digest()
                    for c, v in zip(cols, (m["key"], m["kind"], rid, p, p - m["last"], p - m["first"], text[m["first"] : p], middle + text[p + shared : m["last"] + length])):
                        c.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 3, pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return run


def _strings(length: int):
    """Every string of the marked ranges by its own digest, in the columns of `_parse`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = ts.text_bytes(batch.column("text"))
            for i, (rid, marks) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("marks").to_pylist())):
                text = data[off[i] : off[i + 1]]
                for m in marks:
                    s = np.arange(m["first"], m["last"] + 1)
                    h = _digests(text, s, s + length)
                    key, half = ts.long_array(h[:, 0]), ts.long_array(h[:, 1])
                    yield pa.RecordBatch.from_arrays([key, key, half, pa.array(np.full(len(s), rid)), *[pa.array(s.astype(np.int32))] * 3, pa.array(np.zeros(len(s), np.int32))], ROW)

    return run


def _order(rows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort by (key, bytes); (order, bytes in common with the one before, -1 at a new key)."""
    words = np.ascontiguousarray(rows).view(">u8")
    order = np.lexsort([*(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), key])
    s, k = rows[order], key[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, np.r_[-1, np.where(k[1:] == k[:-1], common, -1)]


def combine(key: np.ndarray, low: np.ndarray, high: np.ndarray, before: list[bytes], after: list[bytes]) -> np.ndarray:
    """For each trigger and offset r (string start = trigger - r), whether another trigger of the key has an equal string.

    `after` begins with `MIDDLE` bytes of digest of what all strings of a trigger share; the key alone only deals.
    """
    n, width = len(key), -(-SPAN // 8) * 8
    left, right = np.zeros((n, width), np.uint8), np.zeros((n, width + MIDDLE), np.uint8)
    for k in range(n):
        x = before[k][::-1]
        left[k, : len(x)] = np.frombuffer(x, np.uint8)
        right[k, : len(after[k])] = np.frombuffer(after[k], np.uint8)
    lo, lcommon = _order(left, key)
    ro, rcommon = _order(right, key)
    out = np.zeros((n, SPAN), bool)
    lclass, rclass = np.empty(n, np.int64), np.empty(n, np.int64)
    for r in range(int(low.min()), int(high.max()) + 1):
        use = np.flatnonzero((low <= r) & (r <= high))
        if len(use) < 2:
            continue
        lclass[lo] = np.cumsum(lcommon < r)
        rclass[ro] = np.cumsum(rcommon < MIDDLE + SPAN - 1 - r)
        pair = lclass[use] * (n + 1) + rclass[use]
        order = np.argsort(pair, kind="stable")
        p = pair[order]
        same = p[1:] == p[:-1]
        out[use[order], r] = np.r_[same, False] | np.r_[False, same]
    return out


def _combined(length: int):
    """Rows sorted by key: the repeated strings of the ranges that are alone, as (rid, first, last)."""

    def work(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        key, kind, rid, at, low, high = (t.column(k).to_numpy() for k in range(6))
        hit = combine(key, low, high, t.column(6).to_pylist(), t.column(7).to_pylist())
        hit[kind != 2] = False
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (row, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        return pa.RecordBatch.from_arrays([pa.array(rid[row]), pa.array((at[row] - b + 1).astype(np.int32)), pa.array((at[row] - a).astype(np.int32))], ["rid", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            rows += len(batch)
            if rows < 20_000:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column(0).to_numpy()
            cut = int(np.flatnonzero(key == key[-1])[0])
            if cut:
                yield work(t.slice(0, cut).to_batches())
                held, rows = t.slice(cut).to_batches(), len(key) - cut
        if held:
            yield work(held)

    return run


def _cut(length: int):
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = ts.text_bytes(batch.column("text"))
            removed, spans, kept = [], [], []
            for i, r in enumerate(batch.column("ranges")):
                text = data[off[i] : off[i + 1]].tobytes()
                if not r.is_valid:
                    removed.append(0)
                    spans.append([])
                    kept.append(text)
                    continue
                first = r.values.field("first").to_numpy()
                last = r.values.field("last").to_numpy() + length
                order = np.argsort(first, kind="stable")
                a, b = first[order].astype(np.int64), np.maximum.accumulate(last[order]).astype(np.int64)
                new = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
                a, b = a[new], b[np.r_[new[1:] - 1, len(b) - 1]]
                removed.append(int((b - a).sum()))
                spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())])
                edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names)

    return run


def remove_repeats(docs: DataFrame, length: int = 400, hot: int = 50_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept), one row per row of `docs`.

    Every byte goes that is covered by a string of `length` bytes which also starts
    anywhere else, in the same text or another; strings are judged on the input.  `spans`
    are the maximal removed ranges, `kept` the remaining bytes (possibly cut inside a
    character, hence binary).  `length` must exceed `SPAN` + `ROLL`.

    Null texts count as empty; texts shorter than `length` stay whole.  Rows that repeat
    an id are texts of their own, equal or not.  Null ids are allowed.  Other
    columns are ignored; an empty table gives an empty result.
    """
    if length <= SPAN + ROLL:
        raise ValueError(f"length must exceed {SPAN + ROLL}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("rid"))
    if not base.groupBy("rid").count().filter("rid is null or count > 1").isEmpty():  # ids that don't tell rows apart: numbers that do, in a durable table
        base = scratch.table(base.withColumn("rid", F.monotonically_increasing_id()), "numbered")
    row = "key long, whole long, half long, rid long, first int, last int, at int, state int"
    ranged = "kind int, key long, rid long, first int, last int, at int"
    long = base.filter(F.octet_length("text") >= length).select("rid", "text")
    parsed = long.mapInArrow(ts.tidied(_parse(length)), row)
    found = scratch.table(parsed.repartition(n, "key").sortWithinPartitions("key", "whole", "half").mapInArrow(ts.tidied(_repeated), ranged), "found")
    whole = found.filter("kind = 0").select("rid", "first", "last")
    marked = found.filter("kind > 0")
    groups = scratch.table(marked.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max("kind").alias("k")).filter("k = 2").select("key", (F.col("m") > hot).alias("hot")), "groups")
    marked = marked.join(groups, "key")
    marks = marked.groupBy("rid").agg(F.collect_list(F.struct("key", "kind", "first", "last", "at", "hot")).alias("marks"))
    here = scratch.table(long.join(marks, "rid"), "marked")
    some = here.withColumn("marks", F.filter("marks", lambda m: ~m["hot"])).filter(F.size("marks") > 0)
    context = some.mapInArrow(ts.tidied(_contexts(length)), "key long, kind int, rid long, at int, low int, high int, before binary, after binary")
    ranges = whole.unionByName(context.repartition(n, "key").sortWithinPartitions("key").mapInArrow(ts.tidied(_combined(length)), "rid long, first int, last int"))
    if not groups.filter("hot").isEmpty():
        strings = here.withColumn("marks", F.filter("marks", lambda m: m["hot"])).filter(F.size("marks") > 0).mapInArrow(ts.tidied(_strings(length)), row)
        more = strings.repartition(n, "key").sortWithinPartitions("key", "whole", "half").mapInArrow(ts.tidied(_repeated), ranged)
        ranges = ranges.unionByName(more.filter("kind = 0").select("rid", "first", "last"))
    per = ranges.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    rows = base.join(per, "rid", "left").select("doc_id", "text", "ranges")
    return rows.mapInArrow(ts.tidied(_cut(length)), "doc_id long, n_bytes long, n_removed long, spans array<struct<start long, end long>>, kept binary")
