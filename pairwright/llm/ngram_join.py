"""N-gram Jaccard join: exact near-duplicate classes by T-occurrence search.

Two texts link when their sets of word shingles have Jaccard similarity of at least
`num / den`.  The search follows DivideSkip, dealt over a cluster.  All shingles have one global order, rare
before common.  A text's rarest shingles, just enough that no linked pair can miss each
other in them, are its *short lists*: they are merged by a distributed sort, and a pair
is a candidate where the merge meets it early enough, and often enough, that the rest of
both sets could still bring it to the required overlap.  The rest, the *long lists*, are never merged;
they are probed by binary search in the sorted set of a candidate.

Skew.  Equal sets are one node from the start.  Where a short list holds very many nodes
(a large group of near copies), its pairs aren't made: neighbours in four random
orders are verified first, and only members of different components of what that links
are paired afterwards, with its hubs and then with each other.  Pairs within a component can't change the result, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pairwright.llm import textscan as ts
from pairwright.llm.graph import merged
from pairwright.llm.scratch import Scratch

U64 = np.uint64
_SLICE = 1 << 14
#: Rows of sorted lists that a task holds at a time.
HELD = 200_000
#: Tasks that write a table known to be small, and rows of it from which it takes more: each file costs executors two processes.
FEW, ROWS, TEXTS = 16, 100_000, 2_000
#: More sets that share half a fingerprint with another one are taken for an error.
SHARED = 100_000


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted shingle set) of each text of a batch."""
    data, off = ts.text_bytes(batch.column("text"))
    for i, j in ts.slices(off):
        h, first = ts.word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
        for k, s in enumerate(ts.shingle_sets(h, first, words)):
            yield i + k, s


def fingerprint(shingles: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """128 bits of a whole set, in two halves: sums of its members, mixed in two ways, and its size.

    `bits` of the first half are kept; fewer only make its collisions frequent, for tests.
    """
    first = int(ts.mix(shingles ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64))
    second = int(ts.mix(shingles * U64(0xDA942042E4DD58B5) + U64(0x2545F4914F6CDD1D)).sum(dtype=U64))
    x = ts.mix(np.array([(first + len(shingles) * 0x9E3779B97F4A7C15) % (1 << 64), (second + len(shingles)) % (1 << 64)], U64))
    return int(x[0]) >> (64 - bits), int(x[1])


class _Node:
    """The 64 bits that a set goes by: the first half of its fingerprint, or the second where different sets share the first."""

    def __init__(self, bits: int, shared: frozenset[int]) -> None:
        self.bits, self.shared = bits, shared

    def __call__(self, shingles: np.ndarray) -> int:
        first, second = fingerprint(shingles, self.bits)
        return second if first in self.shared else first


def _scanner(words: int, bits: int, id_bits: int):
    shift = U64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        names = ["doc_id", "n", "first", "second", "slice", "counts"]
        for batch in batches:
            n, fp, held = np.zeros(len(batch), np.int32), np.zeros((2, len(batch)), U64), []
            for row, s in _sets(batch, words):
                n[row] = len(s)
                if len(s):
                    fp[:, row] = fingerprint(s, id_bits)
                    held.append(s)
                if len(held) >= 500:
                    counts += np.bincount((np.concatenate(held) >> shift).astype(np.int64), minlength=1 << bits)
                    held = []
            if held:
                counts += np.bincount((np.concatenate(held) >> shift).astype(np.int64), minlength=1 << bits)
            rows = len(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), ts.long_array(fp[0]), ts.long_array(fp[1]), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        parts = max(1, (1 << bits) // _SLICE)
        if counts.any():
            rows = [x.astype(np.uint32).tobytes() for x in np.split(counts, parts)]
            yield pa.RecordBatch.from_arrays([pa.nulls(parts, pa.int64()), pa.nulls(parts, pa.int32()), pa.nulls(parts, pa.int64()), pa.nulls(parts, pa.int64()), pa.array(np.arange(parts, dtype=np.int32)), pa.array(rows, pa.binary())], names)

    return run


def _merge_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counters of each slice while reading; memory doesn't follow the number of tasks before."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.frombuffer(c.as_buffer(), np.uint32)
            sums[k] = sums[k] + x if k in sums else x.astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["slice", "counts"])


def _rotated(x: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """x rotated left by 16 bits, `turns` times: one of four orders of the same nodes."""
    r = (turns * U64(16)) & U64(63)
    return (x << r) | (x >> ((U64(64) - r) & U64(63)))


def _prefixes(words: int, node_of: _Node, sketch: np.ndarray, bits: int, num: int, den: int, hot: int):
    """(shingle, node, size, shingles from this one on); the size is negative if the shingle may be in over `hot` texts."""
    shift = U64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sig, node, size = [], [], []  # a shingle's place in its text follows from its position here
            for _, s in _sets(batch, words):
                if not len(s):
                    continue
                fp = node_of(s)
                if fp in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(fp)
                # Rare first; equal counters by hash (s is sorted).
                order = np.argsort(sketch[(s >> shift).astype(np.int64)], kind="stable")
                p = len(s) - -(-num * len(s) // den) + 1
                sig.append(s[order[:p]])
                node.append(fp)
                size.append(len(s))
            lengths = [len(x) for x in sig]
            if lengths:
                flat = np.concatenate(sig)
                fps = np.repeat(np.array(node, U64), lengths)
                n = np.repeat(np.array(size, np.int32), lengths)
                n = np.where(sketch[(flat >> shift).astype(np.int64)] > hot, -n, n)
                rest = np.concatenate([np.arange(k, k - m, -1, dtype=np.int32) for k, m in zip(size, lengths)])
                yield pa.RecordBatch.from_arrays([ts.long_array(flat), ts.long_array(_rotated(fps, flat & U64(3))), pa.array(n), pa.array(rest)], ["sig", "o", "n", "rest"])

    return run


def _may_link(na, ra, nb, rb, num: int, den: int):
    """Whether two sets of na and nb shingles can link if this shingle is the first they share.

    ra and rb are how many shingles each has from this one on, in the global order: the overlap is at
    most the smaller.  A linked pair passes at its first common shingle, which is in the short lists of both.
    """
    return -(-num * (na + nb) // (num + den)) <= np.minimum(ra, rb)


def _lists(short: int, num: int, den: int):
    """Merge sorted lists.  kind 0: a pair and how often short lists met it; 1: the same, and one of them may be
    its first common shingle; 2: neighbours in a long list; 3: a member of one."""
    names = ["kind", "a", "b", "na", "nb", "c"]

    def emit(a, b, na, nb, near) -> pa.RecordBatch:
        swap = a > b
        a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
        order = np.lexsort((b, a))
        a, b, na, nb, near = a[order], b[order], na[order], nb[order], near[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        count, kind = np.diff(np.r_[first, len(a)]), np.maximum.reduceat(near, first)
        return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), ts.long_array(a[first]), ts.long_array(b[first]), *(pa.array(x.astype(np.int32)) for x in (na[first], nb[first], count))], names)

    def work(sig, o, n, rest, goes_on: bool = False) -> Iterator[pa.RecordBatch]:
        """Whole lists; `goes_on`: the first is the end of one that was too long to hold, from its last member so far."""
        new = np.empty(len(sig), bool)
        new[0] = True
        new[1:] = (sig[1:] != sig[:-1]) | (o[1:] != o[:-1])
        sig, o, n, rest = sig[new], o[new], n[new], rest[new]
        fp = _rotated(o, (U64(4) - (sig & U64(3))) & U64(3))
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        length = np.diff(np.r_[start, len(sig)])
        known = length + short * (n[start] < 0)  # part of a list that is dealt to many tasks
        known[0] += short * goes_on
        n = np.abs(n)
        mine = np.repeat(known, length)
        small = np.flatnonzero((mine > 1) & (mine <= short))
        if len(small):
            s, f, m, r = sig[small], fp[small], n[small], rest[small]
            held: list[tuple] = []
            for lag in range(1, short):
                at = np.flatnonzero(s[lag:] == s[:-lag])
                if not len(at):
                    break
                x, y = at, at + lag
                ok = den * np.minimum(m[x], m[y]) >= num * np.maximum(m[x], m[y])
                held.append((x[ok], y[ok]))
            x, y = (np.concatenate(k) for k in zip(*held)) if held else (small[:0], small[:0])
            if len(x):
                yield emit(f[x], f[y], m[x], m[y], _may_link(m[x], r[x], m[y], r[y], num, den).astype(np.int32))
        big = np.flatnonzero(mine > short)
        if len(big):
            s, f, m = sig[big], fp[big], n[big]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), 3, np.int32)), ts.long_array(s), ts.long_array(f), pa.array(m.astype(np.int32)), pa.array(rest[big].astype(np.int32)), pa.array(np.zeros(len(s), np.int32))], names)
            x = np.flatnonzero((s[1:] == s[:-1]) & (den * np.minimum(m[1:], m[:-1]) >= num * np.maximum(m[1:], m[:-1])))
            if len(x):
                yield emit(f[x], f[x + 1], m[x], m[x + 1], np.full(len(x), 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows, goes_on = 0, False
        for batch in batches:
            held.append((batch.column(0).to_numpy().view(U64), batch.column(1).to_numpy().view(U64), batch.column(2).to_numpy(), batch.column(3).to_numpy()))
            rows += len(batch)
            if rows < HELD or not len(batch):
                continue
            cols = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.flatnonzero(cols[0] == cols[0][-1])[0])  # the last list may go on
            if cut:
                yield from work(*(x[:cut] for x in cols), goes_on)
                goes_on = False
            elif len(cols[0]) > 2 * HELD:  # one list only: its last member stays, as a neighbour of the next
                yield from work(*cols, goes_on)
                cut, goes_on = len(cols[0]) - 1, True
            held, rows = [tuple(x[cut:] for x in cols)], len(cols[0]) - cut
        if rows:
            yield from work(*(np.concatenate(x) for x in zip(*held)), goes_on)

    return run


def _across(num: int, den: int):
    """Candidate pairs of members of different components within each list."""

    def work(sig, comp, fp, n, rest) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1], True])
        out: list[tuple] = []
        made = 0
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            # No partner is smaller than the smallest of the list, nor than a text can link with.
            least = np.maximum(n[a:b].min(), -(-num * n[a:b] // den))
            at = a + np.flatnonzero(_may_link(n[a:b], rest[a:b], least, rest[a:b], num, den))
            for i in range(0, len(at), 256):
                x, y = at[i : i + 256, None], at[None, i + 1 :]
                ok = _may_link(n[x], rest[x], n[y], rest[y], num, den) & (comp[x] != comp[y])
                u, v = np.nonzero(ok)
                u, v = at[i + u], at[i + 1 + v]
                u, v = u[u < v], v[u < v]
                if len(u):
                    out.append((np.minimum(fp[u], fp[v]), np.maximum(fp[u], fp[v])))
                    made += len(u)
                if made > 500_000:
                    yield _distinct(out)
                    out, made = [], 0
        if out:
            yield _distinct(out)

    return _by_list(work)


def _distinct(pairs: list[tuple]) -> pa.RecordBatch:
    p = np.unique(np.stack([np.concatenate(x) for x in zip(*pairs)], 1), axis=0)
    return pa.RecordBatch.from_arrays([ts.long_array(p[:, 0]), ts.long_array(p[:, 1])], ["a", "b"])


def _to_hubs(num: int, den: int, hubs: int = 3):
    """Pairs of each list's members with its hubs, where components differ.

    A hub is the member met in most long lists, hence nearest to the middle of its group;
    of each component of the list only the best counts.  Rows are sorted by (sig, rank).
    """

    def work(sig, comp, fp, n, rest) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1], True])
        out: list[tuple] = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            best = np.sort(np.unique(comp[a : min(b, a + 64)], return_index=True)[1])[:hubs]
            for h in (best + a).tolist():
                j = np.arange(a, b)
                j = j[(comp[j] != comp[h]) & (den * np.minimum(n[j], n[h]) >= num * np.maximum(n[j], n[h]))]
                if len(j):
                    out.append((np.minimum(fp[j], fp[h]), np.maximum(fp[j], fp[h])))
        if out:
            yield _distinct(out)

    return _by_list(work)


def _by_list(work):
    """Feed whole lists to `work`: columns sig, comp, fp, n, rest, sorted by sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            now = [batch.column(0).to_numpy().view(U64), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(U64), batch.column(3).to_numpy(), batch.column(4).to_numpy()]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if len(held[0]) < 50_000:
                continue
            cut = int(np.flatnonzero(held[0] == held[0][-1])[0])
            if cut:
                yield from work(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None:
            yield from work(*held)

    return run


def _verify(words: int, num: int, den: int):
    """Rows sorted by (x, part, kind): a text of kind 0, then its candidates; yields the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            x, y, kind = (batch.column(k).to_numpy() for k in range(3))
            out = []
            for row, s in _sets(batch, words):
                if kind[row] == 0:
                    key, own = x[row], s
                elif key == x[row]:
                    t = -(-num * (len(own) + len(s)) // (num + den))
                    small, large = (own, s) if len(own) <= len(s) else (s, own)
                    if len(small) >= t:
                        at = np.searchsorted(large, small)  # binary probes of the longer list
                        at[at == len(large)] = 0
                        if int((large[at] == small).sum()) >= t:
                            out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(x[out]), pa.array(y[out])], ["x", "y"])

    return run


def _tasks(df: DataFrame, rows: int, each: int) -> DataFrame:
    """`df` in a task per `each` of so many rows, at least `FEW` and no more than it has."""
    return df.coalesce(max(FEW, -(-rows // each)))


def _marked(words: int, node_of: _Node, name: str):
    """Each row with the node of its text, 0 for no shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.zeros(len(batch), U64)
            for row, s in _sets(batch, words):
                if len(s):
                    fp[row] = node_of(s)
            yield batch.append_column(name, ts.long_array(fp))

    return run


class _Join:
    def __init__(self, docs: DataFrame, words: int, num: int, den: int, short: int, bits: int, rounds: int, tile: int, hot: int, id_bits: int) -> None:
        self.docs = docs.select("doc_id", "text").filter("doc_id is not null")
        self.words, self.num, self.den, self.short, self.bits, self.rounds, self.tile, self.hot, self.id_bits = words, num, den, short, bits, rounds, tile, hot, id_bits
        self.scratch = Scratch(docs.sparkSession, "ngram-join")
        self.linked = 0  # links so far

    def scan(self) -> None:
        t = self.scratch.table(self.docs.mapInArrow(ts.tidied(_scanner(self.words, self.bits, self.id_bits)), "doc_id long, n int, first long, second long, slice int, counts binary"), "scan")
        scanned = t.filter("slice is null").select("doc_id", "n", "first", "second")
        parts = max(1, (1 << self.bits) // _SLICE)
        merged = t.filter("slice is not null").select("slice", "counts").repartition(parts, "slice").mapInArrow(ts.tidied(_merge_slices), "slice int, counts binary").collect()
        sketch = np.zeros(1 << self.bits, np.int64)  # 2**bits counters, whatever the input
        for r in merged:
            part = np.frombuffer(r["counts"], np.int64)
            sketch[r["slice"] * len(part) : (r["slice"] + 1) * len(part)] = part
        self.sketch = np.minimum(sketch, 2**32 - 1).astype(np.uint32)
        classes = self.scratch.table(scanned.filter("n > 0").groupBy("first", "second").agg(F.min("doc_id").alias("id"), F.max("n").alias("n")), "classes")
        # First halves that different sets share: with N sets about N * N / 2**65, three in 10**10 sets.
        shared = [r[0] for r in classes.groupBy("first").count().filter("count > 1").select("first").limit(SHARED + 1).collect()]
        if len(shared) > SHARED:
            raise RuntimeError(f"more than {SHARED} collisions of 64 bits")
        self.node_of = _Node(self.id_bits, frozenset(x % (1 << 64) for x in shared))
        node = F.when(F.col("first").isin(shared), F.col("second")).otherwise(F.col("first")) if shared else F.col("first")
        self.rows = scanned.select("doc_id", "n", node.alias("fp"))
        self.classes = classes.select(node.alias("fp"), "id", "n")
        self.total = self.classes.agg(F.sum("n")).first()[0] or 0

    def merge(self) -> None:
        spark = self.docs.sparkSession
        pre = self.docs.mapInArrow(ts.tidied(_prefixes(self.words, self.node_of, self.sketch, self.bits, self.num, self.den, self.hot)), "sig long, o long, n int, rest int")
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), self.total * (self.den - self.num) // self.den // 1_000_000)
        part = F.when(F.col("n") < 0, F.pmod(F.col("o"), F.lit(64))).otherwise(-1)  # very long lists go to many tasks
        lists = pre.repartition(tasks, "sig", part).sortWithinPartitions("sig", "o").mapInArrow(ts.tidied(_lists(self.short, self.num, self.den)), "kind int, a long, b long, na int, nb int, c int")
        lists = self.scratch.table(lists, "lists")
        self.long = lists.filter("kind = 3").select(F.col("a").alias("sig"), F.col("b").alias("fp"), F.col("na").alias("n"), F.col("nb").alias("rest"))
        met = lists.filter("kind < 3").groupBy("a", "b", "na", "nb").agg(F.sum(F.when(F.col("kind") < 2, F.col("c")).otherwise(0)).alias("c"), F.max((F.col("kind") == 1).cast("int")).alias("near"), F.max((F.col("kind") == 2).cast("int")).alias("next"))
        # Of the overlap that a pair must have, what can lie beyond the short lists of either doesn't count; long lists may hold the rest.
        up = lambda x, d: F.ceil(x * self.num / F.lit(float(d)))  # noqa: E731  sizes stay far below 2**53
        need = F.greatest(F.lit(1).cast("long"), up(F.col("na") + F.col("nb"), self.num + self.den) - (up(F.greatest("na", "nb"), self.den) - 1))
        more = self.long.groupBy("fp").agg(F.count(F.lit(1)).alias("m"))
        met = met.filter("near = 1 or next = 1").withColumn("need", need)
        met = met.join(more.select(F.col("fp").alias("a"), F.col("m").alias("ma")), "a", "left").join(more.select(F.col("fp").alias("b"), F.col("m").alias("mb")), "b", "left")
        met = met.filter((F.col("next") == 1) | (F.col("c") + F.least(F.coalesce("ma", F.lit(0)), F.coalesce("mb", F.lit(0))) >= F.col("need")))
        self.met = self.scratch.table(met.select("a", "b"), "met")

    def texts(self) -> None:
        """The texts that any verification may read, one per node."""
        nodes = self.met.select(F.explode(F.array("a", "b")).alias("fp")).union(self.long.select("fp")).distinct()
        ids = self.classes.join(nodes, "fp", "left_semi").select("id", "fp")
        one = self.docs.join(ids, self.docs["doc_id"] == ids["id"]).select("fp", "text")
        if self.repeats:  # an id may have other texts besides
            one = one.mapInArrow(ts.tidied(_marked(self.words, self.node_of, "own")), "fp long, text string, own long").filter("fp = own").dropDuplicates(["fp"]).drop("own")
        self.cand = self.scratch.table(one, "texts")

    def verify(self, pairs: DataFrame, number: int, name: str) -> DataFrame:
        """Those of so many pairs (a, b) that link, as (x, y)."""
        part = F.pmod(F.xxhash64("b"), F.lit(16))  # a node of very many candidates is in so many tasks
        pairs = pairs.select("a", "b", part.alias("part"))
        other = pairs.join(self.cand, pairs["b"] == self.cand["fp"]).select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(1).alias("kind"), "part", "text")
        mine = pairs.select("a", "part").distinct().join(self.cand, F.col("a") == self.cand["fp"]).select(F.col("a").alias("x"), F.col("a").alias("y"), F.lit(0).alias("kind"), "part", "text")
        n = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = _tasks(mine.union(other).repartition(n, "x", "part").sortWithinPartitions("x", "part", "kind"), number, TEXTS)
        return self.scratch.table(rows.select("x", "y", "kind", "text").mapInArrow(ts.tidied(_verify(self.words, self.num, self.den)), "x long, y long"), name)

    def joined(self, comp: DataFrame | None, pairs: DataFrame, number: int, name: str) -> DataFrame:
        """The components after so many pairs more; `comp` stays if none of them links."""
        links = self.verify(pairs, number, f"links-{name}")
        number = links.count()
        if comp is not None and not number:
            return comp
        self.linked += number
        return merged(comp, links, self.scratch, f"comp-{name}", max(FEW, -(-self.linked // ROWS)))

    def mixed(self, comp: DataFrame) -> DataFrame:
        """Members (sig, comp, fp, n, rest, lists, least) of the long lists that hold more than one component; least: smallest n there."""
        own = self.long.join(comp, self.long["fp"] == comp["node"], "left").withColumn("comp", F.coalesce("component", "fp")).drop("node", "component")
        several = own.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least")).filter("lo < hi").select("sig", "least")
        return own.join(several, "sig")

    def dealt(self, members: DataFrame, pairs: bool, salt: int, *order) -> DataFrame:
        """The lists, each for one task; one of more than `tile` members in random chunks.

        For `pairs`, every two chunks of a list meet in a task of their own; else chunks stay
        apart, and another `salt` mixes them anew.  The first column tells lists, or their tiles, apart.
        """
        g = members.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(self.tile))).cast("int").alias("g")).filter("g > 1")
        g = F.coalesce("g", F.lit(1)), members.join(g, "sig", "left")
        rows = g[1].withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit(salt)), g[0]).cast("int"))
        if pairs:
            rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), g[0] - 1)))
            tile = F.struct(F.least("chunk", "with"), F.greatest("chunk", "with"))
        else:
            tile = F.struct("chunk")
        rows = rows.withColumn("sig", F.when(F.col("g").isNull(), F.col("sig")).otherwise(F.xxhash64("sig", tile)))
        n = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(n, "sig").sortWithinPartitions("sig", *order).select("sig", "comp", "fp", "n", "rest")

    def run(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, fp)."""
        s = self.scratch
        self.scan()
        self.repeats = bool(self.rows.groupBy("doc_id").count().filter("count > 1").limit(1).count())
        self.merge()
        self.texts()
        done, number = self.met, self.met.count()
        comp = self.joined(None, self.met, number, "0")
        rank = self.long.groupBy("fp").agg(F.count(F.lit(1)).alias("lists"))
        self.long = s.table(self.long.join(rank, "fp"), "long")
        members = self.long.count()
        for k in range(1, self.rounds + 1):
            pairs = self.dealt(self.mixed(comp), False, k, F.col("lists").desc(), "fp").mapInArrow(ts.tidied(_to_hubs(self.num, self.den)), "a long, b long").distinct()
            pairs = s.table(_tasks(pairs.join(done, ["a", "b"], "left_anti"), members, ROWS), f"hubs-{k}")
            number = pairs.count()
            if not number:
                break
            done = done.unionByName(pairs)
            comp = self.joined(comp, pairs, number, f"{k}")
        # Members that may meet a partner first here: none is smaller than the list's smallest, nor than a text can link with.
        members = self.mixed(comp)
        least = F.greatest("least", F.ceil(F.col("n") * self.num / F.lit(float(self.den))))
        members = members.filter(F.ceil((F.col("n") + least) * self.num / F.lit(float(self.num + self.den))) <= F.col("rest"))
        cross = self.dealt(members, True, 0, "comp").mapInArrow(ts.tidied(_across(self.num, self.den)), "a long, b long").distinct()
        cross = s.table(cross.join(done, ["a", "b"], "left_anti"), "cross")
        number = cross.count()
        if number:
            comp = self.joined(comp, cross, number, "cross")
        # From fingerprints to the least doc_id of each component.
        named = self.classes.join(comp, self.classes["fp"] == comp["node"], "left").select("fp", "id", F.coalesce("component", "fp").alias("c"))
        least = named.groupBy("c").agg(F.min("id").alias("component_id"))
        self.named = s.table(named.join(least, "c").select(F.col("fp").alias("nfp"), "component_id"), "named")
        s.keep("scan", "named")
        rows = self.rows.join(self.named, (F.col("fp") == F.col("nfp")) & (F.col("n") > 0), "left")
        return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "fp")


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 3, den: int = 4, short: int = 32, bits: int = 18, rounds: int = 3, tile: int = 16_384, hot: int = 500_000, id_bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of `docs` with a doc_id.

    `num / den` is the similarity, `short` the length from which a short list is treated
    by components first, `rounds` how often its members are tried against hubs, `tile` how
    many of them a task takes, `hot` the length from which a list is merged in many tasks, `bits` the size of
    the table of counters that orders the shingles, `id_bits` the width of the first half of a set's
    fingerprint; these six don't change the result.  Sets are the same where 128 bits of fingerprint agree.  Null and empty texts have no shingle and
    stay alone; texts of fewer than `words` words are one shingle, their whole sequence.
    Rows without doc_id have no place in the result; rows that repeat an id are one row
    each.  Other columns are ignored; an empty table gives an empty result.
    """
    return _Join(docs, words, num, den, short, bits, rounds, tile, hot, id_bits).run().drop("fp")


def drop_near(docs: DataFrame, words: int = 5, num: int = 3, den: int = 4, short: int = 32, bits: int = 18, rounds: int = 3, tile: int = 16_384, hot: int = 500_000, id_bits: int = 64) -> DataFrame:
    """`docs` without the rows that `near_duplicates` links to a smaller doc_id; rows of one id go or stay by their own text."""
    join = _Join(docs, words, num, den, short, bits, rounds, tile, hot, id_bits)
    gone = join.run().filter("component_id <> doc_id").select(F.col("doc_id").alias("__gone"), F.col("fp").alias("__gone_fp"))
    if not join.repeats:
        return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
    schema = StructType([*docs.schema.fields, StructField("__fp", LongType())])
    marked = docs.mapInArrow(ts.tidied(_marked(words, join.node_of, "__fp")), schema)
    return marked.join(gone, (marked["doc_id"] == F.col("__gone")) & (F.col("__fp") == F.col("__gone_fp")), "left_anti").drop("__fp")
