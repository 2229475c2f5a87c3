"""Token ids of whole texts by a public tokenizer file, word by word.

The tokenizer drops white space before it splits, so nothing reaches across a space: the
ids of a text are those of its maximal runs of other bytes, one after another.  Arrow splits
the texts, numbers distinct runs and puts their ids in a row again, so Python spends no time
per run; a worker remembers the runs it has met and encodes new ones only.

A run is split into words here only where that is certain: one with characters beyond
U+017F, control characters, special spaces or the opening of a special token goes to the
tokenizer as it is.  Words are merged by rank of the merged token instead of by rank of the
pair, which a faster library does; `rank_merges` says when that is the same.
"""

from __future__ import annotations

import array
import base64
import bisect
import functools
import importlib.util
import itertools
import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct runs that a worker remembers; beyond it, those of the present texts only.
REMEMBER = 600_000
#: Whether the library that merges by rank is there; without it, the tokenizer itself gives the same ids, more slowly.
MERGER = importlib.util.find_spec("tiktoken") is not None
#: What ends a word, and a word that ends a run, in the text for the merging library.
END, STOP = "\0", "\n\0"

_EXCEPT = {0x85, 0xA0, 0xAD, 0x130, 0x149}
_PLAIN = [chr(c) for c in [*range(33, 127), *range(0xA1, 0x180)] if c not in _EXCEPT]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == kind)


#: What a run must not hold to be split here, runs standing on lines of their own.
_ODD = re.compile(f"[^{''.join(map(re.escape, _PLAIN))}\\n]|<\\|")
#: The split pattern above for lines of plain characters, and the end of a line.
_WORDS = re.compile(f"[{_class('L')}]+|\\n|[{_class('N')}]|'(?:s|t|re|ve|m|ll|d)|[^{_class('L')}{_class('N')}\\n]+")


def _byte_of() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def _alone(symbols: list, rank: dict) -> list:
    """Merge pairs by rank until none is left."""
    while len(symbols) > 1:
        best = min(range(len(symbols) - 1), key=lambda i: rank.get((symbols[i], symbols[i + 1]), 1 << 60))
        if (symbols[best], symbols[best + 1]) not in rank:
            return symbols
        symbols = [*symbols[:best], symbols[best] + symbols[best + 1], *symbols[best + 2 :]]
    return symbols


@functools.lru_cache(maxsize=4)
def rank_merges(path: str) -> bool:
    """Whether merging by the rank of the merged token gives the ids of merging by the rank of the pair.

    It does if every token is made by one pair only and is what its own symbols merge to.
    For where two neighbours make up a token, nothing has crossed the ends of its span, so
    the span has gone the way it goes alone, and the neighbours are that pair.
    """
    spec = json.load(open(path, encoding="utf-8"))
    model = spec["model"]
    splits = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x.get("type") == "Split"]
    steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("ignore_merges") or len(splits) != 1 or splits[0]["pattern"] != {"Regex": _SPLIT} or steps != ["NFC", "Replace", "Lowercase"]:
        return False
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if len({a + b for a, b in pairs}) != len(pairs):
        return False
    rank = {p: k for k, p in enumerate(pairs)}
    for a, b in pairs:
        t = a + b
        symbols = [*t[:-5], t[-5:]] if t.endswith("</w>") else list(t)
        if _alone(symbols, rank) != [t]:
            return False
    return True


class WordTokenizer:
    """Encodes with the file at `path`; ids are little-endian integers of `width` bytes."""

    def __init__(self, path: str, by_rank: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.code, self.width = ("H", 2) if self.size <= 1 << 16 else ("I", 4)
        self.forget()
        self.merger = None
        if by_rank and MERGER:
            self._load(json.load(open(path, encoding="utf-8"))["model"])

    def _load(self, model: dict) -> None:
        import tiktoken

        byte, end = _byte_of(), END.encode()

        def raw(t: str) -> bytes:
            body, tail = (t[:-4], end) if t.endswith("</w>") else (t, b"")
            return bytes(byte[c] for c in body) + tail

        ranks = {bytes([b]): b for b in range(256)}
        for b in range(1, 256):  # a word's last byte takes the end mark before anything else
            ranks[bytes([b]) + end] = len(ranks)
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            ranks.setdefault(raw(a + b), len(ranks))
        self.merger = tiktoken.Encoding("words", pat_str=f"[^{END}]*{END}", mergeable_ranks=ranks, special_tokens={})
        self.stop = ranks[STOP.encode()]
        self.ids = np.zeros(len(ranks), np.dtype(f"<u{self.width}"))
        for t, i in model["vocab"].items():
            if set(t.removesuffix("</w>")) <= byte.keys() and (k := ranks.get(raw(t))) is not None:
                self.ids[k] = i

    def forget(self) -> None:
        self.runs, self.run_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array.array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, runs: list[bytes]) -> list[bytes]:
        """The ids of each run, all at once: one string with a run per line."""
        out = [b""] * len(runs)
        lines = b"\n".join(runs).decode("utf-8", "replace")
        if self.merger is None:
            odd = range(len(runs))
        else:
            ends = list(itertools.accumulate((len(x) + 1 for x in lines.split("\n")))) if _ODD.search(lines) else []
            odd = sorted({bisect.bisect_right(ends, m.start()) for m in _ODD.finditer(lines)}) if ends else []
        left: list[int] | range = range(len(runs))
        if odd:
            text = lines.split("\n")
            for k, ids in zip(odd, self._encode([text[k] for k in odd])):
                out[k] = ids
            left = sorted(set(left) - set(odd))
            lines = "\n".join([text[k] for k in left])
        if left:
            merged = np.array(self.merger.encode_ordinary(END.join([*_WORDS.findall(lines.lower()), STOP])), np.int64)
            ends = np.flatnonzero(merged == self.stop)
            raw, starts = self.ids[merged].tobytes(), np.r_[0, ends[:-1] + 1]
            w = self.width
            for k, a, b in zip(left, (starts * w).tolist(), (ends * w).tolist()):
                out[k] = raw[a:b]
        return out

    def encode_column(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        """(ids of all texts, offsets in bytes); null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.ascii_split_whitespace(texts)  # at [\x20\x09-\x0D]+; runs at the ends of a text may be empty
        met = split.flatten().dictionary_encode()
        runs, at = met.dictionary, pc.index_in(met.dictionary, value_set=self.runs)
        fresh = runs.filter(at.is_null())
        learned = pa.array(self._learn(fresh.cast(pa.large_binary()).to_pylist()) if len(fresh) else [], pa.large_binary())
        place = np.array(pc.fill_null(at, -1))
        place[place < 0] = len(self.runs) + np.arange(len(fresh))
        run_ids = pa.concat_arrays([self.run_ids, learned])
        mine = run_ids.take(pa.array(place))
        if len(self.runs) + len(fresh) <= REMEMBER:
            self.runs, self.run_ids = pa.concat_arrays([self.runs, fresh]), run_ids
        else:
            self.runs, self.run_ids = runs, mine
        ids = mine.take(met.indices)
        _, off, data = ids.buffers()
        off = np.frombuffer(off, np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        return (data.to_pybytes() if data is not None else b"")[: off[-1]], off[split.offsets.to_numpy()]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text."""
        raw, off = self.encode_column(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        return [raw[a:b] for a, b in itertools.pairwise(off.tolist())]


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str, by_rank: bool) -> WordTokenizer:
    return WordTokenizer(path, by_rank)


class ByteTokenizer:
    """Counts ids of the byte-level vocabulary in the rank file at `path` (base64 token and rank per line), split by `pattern`."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def count(self, texts: list[str]) -> list[int]:
        return [len(self.encoding.encode_ordinary(t)) for t in texts]


@functools.lru_cache(maxsize=2)
def byte_tokenizer(path: str, pattern: str) -> ByteTokenizer:
    return ByteTokenizer(path, pattern)
