"""Vectorised scans of Arrow text columns: words, word hashes, shingles.

Everything works on the UTF-8 bytes of many texts at once, in NumPy, so a Python worker
spends no time per word.  Words are maximal runs of bytes outside `[\\x20\\x09-\\x0D]`, compared after A-Z
is lower-cased; other bytes stay as they are.  Hashes are 64 bits wide: eight bytes after eight are mixed into
the hash so far, beginning with the length; of words beyond `LONG` bytes, BLAKE2b is taken.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_LIBC = ctypes.CDLL(ctypes.util.find_library("c")) if ctypes.util.find_library("c") else None
if not hasattr(_LIBC, "malloc_trim"):  # not glibc
    _LIBC = None
#: Longer spans are hashed one by one.
LONG = 64
#: Texts are scanned in slices of about so many bytes, so that memory doesn't follow the Arrow batch.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers (the finaliser of SplitMix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number, zeros behind the end; a view."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", buffer=padded.data, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, view: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each `data[starts[i]:ends[i]]`; `view`: the `eights` of data, if they are at hand."""
    view = eights(data) if view is None else view
    size = ends - starts
    h = mix(size.astype(U64) * U64(0xA0761D6478BD642F) + U64(seed))
    todo, k = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(todo):
        left = size[todo] - k
        h[todo] = mix(h[todo] ^ (view[starts[todo] + k] & _FIRST[np.minimum(left, 8)]))
        k += 8
        todo = todo[left > 8]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] ^= U64(int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little"))
    return h


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets): null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def tidy() -> None:
    """Give freed memory back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def tidied(run):
    """A batch function that tidies up after its task."""

    def go(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return go


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end): texts are `data[offsets[i]:offsets[i+1]]`."""
    if len(data) == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    starts, ends = word_spans(data, offsets)
    return span_hashes(LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[offsets < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


_STEP = mix(np.arange(11, 139, dtype=U64)) | U64(1)


def shingle_sets(words: np.ndarray, first: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct shingles of `size` words; with fewer words, the whole sequence as one."""
    total = len(words)
    rolled = np.zeros(max(total - size + 1, 0), U64)
    for k in range(size if total >= size else 0):
        rolled += words[k : total - size + 1 + k] * _STEP[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        if n >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif n:
            short = np.array([n], U64) * U64(0xE7037ED1A0B428DB)
            for k in range(n):
                short += words[a + k : a + k + 1] * _STEP[size + k]
            out.append(mix(short))
        else:
            out.append(words[:0])
    return out


def long_array(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark's signed longs, bit by bit."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
