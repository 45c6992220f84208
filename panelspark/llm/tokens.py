"""Token ids of whole texts by the tokenizers library, each distinct word encoded once.

Where a tokenizer drops white space before it splits (its pattern keeps only runs without white space), a text's ids are
its words' ids in a row. Texts are then cut at spaces and line ends, the distinct words of a block go to the library in
one batch, and numpy puts the ids back in order. Other tokenizers get the texts whole.
"""

from __future__ import annotations

import json
import os
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa

from .blocks import LOWER, span_hashes, spans

TOKEN_BLOCK = 8 << 20
_MOST_WORDS = 4_000_000
_APART, _LETTER, _MARK = (np.zeros(256, bool) for _ in range(3))
_APART[[0x20, 0x0A]] = True
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True


def cuts_at_space(path: str) -> bool:
    """Whether the tokenizer file splits by a pattern of runs without white space and removes the rest."""
    spec = json.loads(Path(path).read_text())
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    pattern = first.get("pattern", {}).get("Regex", " ")
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and " " not in pattern and not spec.get("post_processor")


class Store:
    """Id lists of the words seen so far, as flat arrays, found by the words' 64-bit hashes and compared byte by byte.

    A word whose hash an other one has is encoded each time it is met. The store is emptied when it holds too many words.
    """

    def __init__(self, encode, most: int = _MOST_WORDS):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.places, self.words = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0
        self.ids, self.starts = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64)
        self.raw, self.edges = np.zeros(1 << 16, np.uint8), np.zeros(1 << 12, np.int64)

    @staticmethod
    def _appended(values: np.ndarray, at: int, more: np.ndarray) -> np.ndarray:
        while len(values) < at + len(more):
            values = np.concatenate([values, np.zeros_like(values)])
        values[at : at + len(more)] = more
        return values

    def _add(self, keys: np.ndarray, words: list[bytes], decode, index: np.ndarray) -> np.ndarray:
        """Encode `words` and keep them; those of `index` are found by their keys from now on."""
        lists = self.encode([decode(w) for w in words])
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        n, to = self.words, self.words + len(words)
        self.ids = self._appended(self.ids, int(self.starts[n]), np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())))
        self.starts = self._appended(self.starts, n + 1, self.starts[n] + np.cumsum(sizes))
        self.raw = self._appended(self.raw, int(self.edges[n]), np.frombuffer(b"".join(words), np.uint8))
        self.edges = self._appended(self.edges, n + 1, self.edges[n] + np.cumsum(np.fromiter(map(len, words), np.int64, len(words))))
        self.words, places = to, np.arange(n, to, dtype=np.int32)
        order = index[np.argsort(keys[index])]
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.places = np.insert(self.keys, at, keys[order]), np.insert(self.places, at, places[order])
        return places

    def _same(self, places: np.ndarray, data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the words at `places` are these spans of `data`."""
        same = self.edges[places + 1] - self.edges[places] == sizes
        sizes = np.where(same, sizes, 0)
        first = np.cumsum(sizes) - sizes
        step = np.arange(int(sizes.sum()))
        other = data[np.repeat(begin - first, sizes) + step] != self.raw[np.repeat(self.edges[places] - first, sizes) + step]
        wrong = np.concatenate([[0], np.cumsum(other)])
        return same & (wrong[first + sizes] == wrong[first])

    def of(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, decode=bytes.decode) -> np.ndarray:
        """The place of each span of bytes (in order, apart), after the new ones have been encoded."""
        if not len(begin):
            return np.zeros(0, np.int64)
        if self.words > self.most:
            self.clear()
        sizes = end - begin
        if int(sizes.sum()) < len(data):
            inside = np.zeros(len(data) + 1, np.int8)
            inside[begin] += 1
            inside[end] -= 1
            data = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        spans_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
        both = spans_.dictionary_encode()
        codes, words = both.indices.to_numpy(), both.dictionary
        edges = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        own = np.frombuffer(words.buffers()[2], np.uint8)
        keys = span_hashes(own, edges[:-1], edges[1:])
        places = np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        met = np.flatnonzero(hit)
        found = self.places[at[met]].astype(np.int64) if len(met) else np.zeros(0, np.int64)
        good = self._same(found, own, edges[:-1][met], np.diff(edges)[met])
        places[met[good]] = found[good]
        new = np.flatnonzero(places < 0)
        if len(new):
            _, first = np.unique(keys[new], return_index=True)
            places[new] = self._add(keys[new], words.take(pa.array(new)).to_pylist(), decode, first[~hit[new][first]])
        return places[codes]

    def lists(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words in a row, and where each word's begin."""
        sizes = self.starts[places + 1] - self.starts[places]
        begin = np.zeros(len(places) + 1, np.int64)
        np.cumsum(sizes, out=begin[1:])
        at = np.repeat(self.starts[places] - begin[:-1], sizes) + np.arange(begin[-1])
        return self.ids[at], begin


@cache
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@cache
def _word_store(path: str) -> Store:
    encode = library(path).encode_batch_fast
    return Store(lambda words: [x.ids for x in encode(words, add_special_tokens=False)])


@cache
def _specials(path: str) -> list[bytes]:
    return [x.content.encode() for x in library(path).get_added_tokens_decoder().values()]


def _cut(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut further where an ASCII letter stands beside an ASCII mark: a boundary of the pattern, except after an apostrophe."""
    begin, end, first = spans(data, starts, _APART)
    if len(data) < 2:
        return begin, end, first
    letter, mark = _LETTER[data], _MARK[data]
    cut = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:] & (data[:-1] != 39))
    cut[starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < len(data))] - 1] = False
    at = np.flatnonzero(cut) + 1
    begin, end = np.sort(np.concatenate([begin, at]), kind="stable"), np.sort(np.concatenate([end, at]), kind="stable")
    return begin, end, np.searchsorted(begin, starts)


def encoded(data: np.ndarray, starts: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents of a block in a row, and where each document's begin."""
    if not cuts_once(path):
        texts = [bytes(data[a:b]).decode() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        lists = [x.ids for x in library(path).encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(lists), np.int32), np.cumsum([0, *map(len, lists)])
    low = LOWER[data]
    raw = low.tobytes()
    if any(x.lower() in raw for x in _specials(path)):  # these are found in the text as it is, and whole
        low, (begin, end, first) = data, spans(data, starts, _APART)
    else:
        begin, end, first = _cut(low, starts)
    store = _word_store(path)
    ids, at = store.lists(store.of(low, begin, end))
    return ids, at[first]


cuts_once = cache(cuts_at_space)


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The same with `end_id` after each document."""
    if end_id is None:
        return ids, at
    return np.insert(ids, at[1:], end_id), at + np.arange(len(at))
