"""Operator 2: token counts by finite-state transducers compiled from a byte-level BPE tokenizer file.

Two deterministic transducers read a text once. The first reads character classes and marks where the tokenizer's
pattern cuts; a text is read in chunks, each chunk is turned into a map from state to state, the maps are composed by a
parallel prefix scan, and each chunk then runs from its known state. The second reads the bytes of a cut and emits, on
each transition, by how much the count of tokens changes; its states are compiled as they are met (from the merges, the
set of tokens and which token may follow which) and kept. A text's count is the sum over its cuts, each distinct one
counted once per worker.

How the second works: in BPE the tokens of a string's prefix are the tokens of a shorter prefix and one last token, and
a token may follow another exactly if merging the two strings together gives those two tokens again. A state holds, for
each place where a longer token may still have begun, the vocabulary node read since, the token before it and the count
there relative to now.

Defined results: null text is empty and has 0 tokens; very long texts are read whole, chunk by chunk in one row; a count equal to
the limit is not over it; added-token strings inside texts count as the library counts
them (one token); repeated rows are counted alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks
from .tokens import Store

CHUNK = 64
BLOCK = 1 << 20
#: The classes of the byte-level pattern 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
LETTER, STMD, RV, E, L, NUMBER, BLANK, WHITE, APOSTROPHE, OTHER = range(10)
#: States: at a text's start; in letters; in numbers; in others; after one blank; after blanks or white, last a blank;
#: after one white; after several, last a white; after an apostrophe that opens a cut; after a whole contraction;
#: after 'r or 'v; after 'l.
S0, SL, SN, SO, SB, SBB, SW, SWW, SA, SC, SRV, SLL = range(12)
#: What a transition emits: bit 0, a cut before this character; bit 1, a cut before the one before it.
HERE, BACK = 1, 2


def _compiled_cuts() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission by (state, class); classes from 10 on are the same at the first character of a text."""
    to, emit = np.zeros((12, 20), np.uint8), np.zeros((12, 20), np.uint8)
    opens = {NUMBER: SN, BLANK: SB, WHITE: SW, APOSTROPHE: SA, OTHER: SO} | dict.fromkeys((LETTER, STMD, RV, E, L), SL)
    inside = {SL: SL, SN: SN, SO: SO}
    for state in range(12):
        for c in range(10):
            new, out = opens[c], HERE
            white = c in (BLANK, WHITE)
            if state in (SB, SBB, SW, SWW):
                if white:
                    new, out = (SBB if c == BLANK else SWW), 0
                elif state in (SB, SBB):  # the last blank goes with what follows
                    new, out = (SO if c == APOSTROPHE else new), (BACK if state == SBB else 0)
                elif state == SWW:
                    out = HERE | BACK
            elif state in inside and (new == inside[state] or state == SO and c == APOSTROPHE):
                new, out = state, 0
            elif state == SA and c == STMD or state == SRV and c == E or state == SLL and c == L:
                new, out = SC, 0
            elif state == SA and c in (RV, L):
                new, out = (SRV if c == RV else SLL), 0
            elif state == SA and c in (OTHER, APOSTROPHE):
                new, out = SO, 0
            elif state in (SRV, SLL):  # no contraction: the letter was a cut of its own
                new, out = (SL, BACK) if new == SL else (new, BACK | HERE)
            to[state, c], emit[state, c] = new, out
            to[state, c + 10], emit[state, c + 10] = opens[c], HERE | (BACK if state in (SRV, SLL) else 0)
    return to, emit


@cache
def _classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LNZ":
            out[c] = {"L": LETTER, "N": NUMBER, "Z": WHITE}[kind]
    out[[9, 10, 11, 12, 13, 0x85]] = WHITE
    out[0x20], out[0x27] = BLANK, APOSTROPHE
    for chars, kind in (("stmd", STMD), ("rv", RV), ("e", E), ("l", L)):
        out[[ord(c) for c in chars]] = kind
    return out


_TO, _EMIT = _compiled_cuts()


def states_before(classes: np.ndarray) -> np.ndarray:
    """The cutting transducer's state before each chunk of CHUNK classes (rows), by composing the chunks' state maps."""
    n, states = len(classes), _TO.shape[0]
    flat = _TO.ravel()
    maps = np.tile(np.arange(states, dtype=np.intp), (n, 1))
    for k in range(classes.shape[1]):
        maps = flat[maps * 20 + classes[:, k, None]].astype(np.intp)
    step = 1
    while step < n:  # inclusive scan: each map after this also holds the `step` maps before
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
        step *= 2
    return np.concatenate([[S0], maps[:-1, S0]]) if n else np.zeros(0, np.intp)


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The byte where each cut of the block begins."""
    text = data.tobytes().decode()
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    classes = _classes()[code].astype(np.intp)
    n = len(classes)
    begins = np.searchsorted(at, starts[:-1][np.diff(starts) > 0])
    classes[begins] += 10
    padded = np.full(-(-(n + 1) // CHUNK) * CHUNK, LETTER + 10, np.intp)  # a text's start after the end, for what the end leaves open
    padded[:n] = classes
    rows = padded.reshape(-1, CHUNK)
    state = states_before(rows)
    emitted = np.empty(rows.shape, np.uint8)
    to, emit = _TO.ravel(), _EMIT.ravel()
    for k in range(CHUNK):
        key = state * 20 + rows[:, k]
        emitted[:, k] = emit[key]
        state = to[key].astype(np.intp)
    emitted = emitted.ravel()[: n + 1]
    mark = (emitted[:n] & HERE) > 0
    mark |= (emitted[1:] & BACK) > 0
    return at[mark]


class CountTransducer:
    """Bytes in, changes of the token count out; states are compiled as they are met."""

    def __init__(self, spec: dict, most: int = 120_000):
        model = spec["model"]
        byte = _byte_of_character()
        raw = lambda token: bytes(byte[c] for c in token)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.rank}
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for t in sorted(self.tokens):
            node = 0
            for b in t:
                if b not in self.trie[node]:
                    self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token.append(None)
                node = self.trie[node][b]
            if self.merged(t) == [t]:
                self.token[node] = t
        self.most, self.follow = most, {}
        self._clear()

    def _clear(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self._state(((0, None, 0),))

    def _state(self, key: tuple) -> int:
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return self.number[key]

    def merged(self, text: bytes) -> list[bytes]:
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def may_follow(self, a: bytes | None, b: bytes) -> bool:
        if a is None:
            return True
        if (a, b) not in self.follow:
            if len(self.follow) > 200_000:
                self.follow.clear()
            self.follow[a, b] = self.merged(a + b) == [a, b]
        return self.follow[a, b]

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        going, last, count = [], None, 0
        for node, before, relative in self.states[state]:
            node = self.trie[node].get(byte, -1)
            if node < 0:
                continue
            token = self.token[node]
            if last is None and token is not None and self.may_follow(before, token):
                last, count = token, relative + 1
            if self.trie[node]:
                going.append((node, before, relative))
        key = tuple((node, before, relative - count) for node, before, relative in going) + ((0, last, 0),)
        return self._state(key), count

    def count(self, text: bytes) -> int:
        state, total = 0, 0
        for b in text:
            move = self.moves[state].get(b)
            if move is None:
                if len(self.states) > self.most:  # within a long cut as well
                    key = self.states[state]
                    self._clear()
                    state = self._state(key)
                move = self.moves[state][b] = self._move(state, b)
            state = move[0]
            total += move[1]
        return total


def _byte_of_character() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def _counter(path: str) -> tuple[Store, list[bytes]]:
    spec = json.loads(Path(path).read_text())
    split = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space") or spec.get("normalizer") or spec["model"].get("ignore_merges"):
        raise ValueError(f"{path}: a byte-level BPE file with the byte-level pattern and no normaliser is asked for")
    machine = CountTransducer(spec)
    return Store(lambda words: [[machine.count(w)] for w in words]), [t["content"].encode() for t in spec["added_tokens"]]


def counts(data: np.ndarray, starts: np.ndarray, path: str) -> np.ndarray:
    """The token count of each document of a block."""
    store, added = _counter(path)
    n, extra = len(starts) - 1, np.zeros(len(starts) - 1, np.int64)
    if not len(data):
        return extra
    raw = data.tobytes()
    found = [(m.start(), m.end()) for m in re.finditer(b"|".join(re.escape(t) for t in added), raw)] if added else []
    found = [(a, b) for a, b in found if starts[np.searchsorted(starts, a, "right")] >= b]  # else it only arises where two documents meet
    if found:  # an added token counts 1, and the texts on its two sides are read apart
        edges = np.unique(np.concatenate([starts, np.array(found).ravel()]))
        keep = np.ones(len(edges) - 1, bool)
        keep[np.searchsorted(edges, [a for a, _ in found])] = False
        np.add.at(extra, np.searchsorted(starts, [a for a, _ in found], "right") - 1, 1)
        begin = cuts(data, edges)
        part = keep[np.searchsorted(edges, begin, "right") - 1]
        end = np.append(begin[1:], len(data))[part]
        begin = begin[part]
    else:
        begin = cuts(data, starts)
        end = np.append(begin[1:], len(data))
    sums = np.zeros(len(begin) + 1, np.int64)
    places = store.of(data, begin, end, decode=bytes)
    np.cumsum(store.ids[store.starts[places]], out=sums[1:])
    at = np.searchsorted(begin, starts)
    return extra + sums[at[1:]] - sums[at[:-1]] if n else extra


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of `docs` (columns doc_id and text)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in blocks(batches, most=BLOCK):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(starts)), pa.array(counts(data, starts, tokenizer))], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
