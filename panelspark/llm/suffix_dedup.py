"""Operator 11: removal of every byte that a repeated 200-byte string covers, by prefix-free parsing.

Parsing. A 12-byte string whose rolling hash is a multiple of 64 is a trigger; the text from one trigger to the next is a
phrase, and what follows from the next trigger on is the suffix of the parse after it. A suffix of the corpus is so a
suffix of a phrase and a suffix of the parse. Where the next trigger is over 150 bytes away, triggers of a multiple of 16
end phrases too; where there is none of these either, each byte starts a phrase of its own. Which trigger a 200-byte
string meets first is told by its own bytes, so equal strings are cut alike, wherever they stand. Triggers never reach
over a document's ends.

Dictionary. The strings that start in one phrase share the 51 bytes at its end (from the byte before the trigger on), or
none of them repeats. So phrases whose 64-bit hash of these bytes is met once in the corpus leave at once (`_ends`): that
is most of the text. The others, with the bytes that their strings reach, form the dictionary of distinct extended
phrases, told apart by 128-bit hashes. All strings of an extended phrase met twice or more are repeated.

Corpus order. What is left are different extended phrases with the same end: of each, once, a suffix array of the phrases
(from their ends) and one of the parse after them (its next 199 bytes), both with their common prefixes, are made by comparing
bytes. For each length of a phrase's suffix, (class in the one, class in the other) is the corpus order cut at 200
bytes: neighbours of equal rank are repeated. Rows meet sorted by phrase end, many ends in a block. An end that more
than LARGE extended phrases share is never brought together: stretches of its strings are counted by 128-bit hashes, and
one by one only those strings whose stretch has company by the bytes in common, but is not met again (`_of_large_ends`).

So the highly repetitive part of a corpus costs its distinct phrases, and the rest one small row a phrase. Copies of whole
texts are known by a 128-bit hash of the text: all of them are decided, and one stands for them in the comparison.
Keys that hold many rows are dealt out by `shared.meet`. Lists of candidate texts are broadcast up to LISTED rows only
(16 bytes each); beyond that the texts are dealt to them.

Defined results: null and empty texts have no bytes and no spans; texts under 200 bytes never change; the same text in two
rows (doc_ids alike or not) repeats all its strings; strings that overlap in one text count; very long texts are taken
whole, as one row; bytes are cut where the strings end, if need be within a character; rows keep all other columns, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import blocks, mixed
from .shared import meet, stored, whole_text

WIDTH, TRIGGER, SPARSE, DENSE, REACH = 200, 12, 64, 16, 150
#: Extended phrases of one end that one task compares, rows of a block, and texts of a list that is broadcast.
LARGE, BLOCK, LISTED = 2_000, 20_000, 2_000_000
#: Lengths of a phrase's suffix in a stretch: about the root of how many a phrase has.
STEP = 10
_FAR = 1 << 60
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_tables: dict[int, list[np.ndarray]] = {}


class _Hash:
    """Hashes of any span of `data` by polynomial prefix sums; the two bases give independent ones."""

    def __init__(self, data: np.ndarray, base: int):
        known = _tables.get(base)
        if known is None or len(known[0]) <= len(data):
            n = max(len(data), 2 << 20) + 1
            known = _tables[base] = [np.full(n, x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
            for k, x in enumerate(known):
                x[0] = 1
                known[k] = np.cumprod(x, dtype=np.uint64)
        self.inverse = known[1]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        letters = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
        np.cumsum(letters[data] * known[0][: len(data)], out=self.sums[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))

    def rolling(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


class Phrases:
    """The phrases of the documents of a block with a 200-byte string that starts in them, in order.

    doc, k (number within the document), first and last (of the starts of their strings), at (the trigger that ends
    them; for a phrase without one, the byte after it), end (hash that all their strings share).
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.hash = h = _Hash(data, _BASES[0])
        self.data = data
        rolled = h.rolling(TRIGGER) if len(data) >= TRIGGER else np.zeros(0, np.uint64)
        at = np.flatnonzero(rolled & np.uint64(DENSE - 1) == 0)
        doc = np.searchsorted(starts, at, "right") - 1
        inside = at + TRIGGER <= starts[doc + 1]
        at, doc = at[inside], doc[inside]
        sparse = rolled[at] & np.uint64(SPARSE - 1) == 0
        # every document ends with a gap before a trigger that is far away
        docs = np.arange(len(starts) - 1)
        doc, at, sparse = np.concatenate([doc, docs]), np.concatenate([at, np.full(len(docs), _FAR)]), np.concatenate([sparse, np.ones(len(docs), bool)])
        order = np.lexsort((at, doc))
        doc, at, sparse = doc[order], at[order], sparse[order]
        final = starts[doc + 1] - WIDTH
        before = self._before(doc, at, starts)
        upcoming = self._upcoming(at, sparse)
        ends = sparse & (at < _FAR)
        one = (doc[ends], np.maximum(self._before(doc[sparse], at[sparse], starts)[at[sparse] < _FAR], at[ends] - REACH), np.minimum(at[ends] - 1, final[ends]), at[ends])
        two = (doc, np.maximum(before, at - REACH), np.minimum(np.minimum(at - 1, upcoming - REACH - 1), final), at)
        n = np.maximum(0, np.minimum(at - REACH - 1, final) - before + 1)
        alone = np.repeat(before - np.cumsum(n) + n, n) + np.arange(n.sum())
        none = (np.repeat(doc, n), alone, alone, alone + 1)
        kind = np.repeat([1, 2, 0], [len(one[0]), len(two[0]), len(none[0])])
        doc, first, last, at = (np.concatenate(x) for x in zip(one, two, none))
        order = np.argsort(first + (last < first) * _FAR, kind="stable")[: int((last >= first).sum())]
        self.doc, self.first, self.last, self.at, self.kind = (x[order] for x in (doc, first, last, at, kind))
        self.k = np.arange(len(self.doc)) - np.searchsorted(self.doc, self.doc)
        own = self.kind == 0
        self.end = mixed(h(np.where(own, self.first, self.at - 1), np.where(own, self.first, self.at - REACH) + WIDTH) + self.kind.astype(np.uint64))

    @staticmethod
    def _before(doc: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The trigger before each, or the start of its document."""
        out = starts[doc].copy()
        same = np.flatnonzero(doc[1:] == doc[:-1]) + 1
        out[same] = at[same - 1]
        return out

    @staticmethod
    def _upcoming(at: np.ndarray, sparse: np.ndarray) -> np.ndarray:
        """The next sparse trigger at or after each; a document's last is far away."""
        where = np.flatnonzero(sparse)
        return at[where[np.searchsorted(where, np.arange(len(at)))]]

    def extended(self) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hashes of the extended phrases: all bytes of their strings."""
        to = self.last + WIDTH
        return self.hash(self.first, to), _Hash(self.data, _BASES[1])(self.first, to)

    def distinct(self, *hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of equal phrases of a document, the first: which, how many, and for each phrase the place among them."""
        keys = [*hashes, self.doc]
        order = np.lexsort(keys)
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in keys])
        heads = np.flatnonzero(new)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        return order[heads], np.diff(np.append(heads, len(order))), group


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _taken(batch: pa.RecordBatch, names: tuple[str, ...], at: np.ndarray) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)).take(pa.array(at)) for n in names]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, starts in blocks(batches):
        p = Phrases(data, starts)
        which, n, _ = p.distinct(p.hash(p.first, p.last + WIDTH))
        yield pa.RecordBatch.from_arrays([_signed(p.end[which]), *_taken(batch, ("d",), p.doc[which]), pa.array(p.k[which], pa.int32()), pa.array(np.minimum(n, 2), pa.int64())], ["end", "d", "k", "n"])


def _listed(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The lists of a column end to end, and for each element its row."""
    lists = batch.column(batch.schema.get_field_index(name))
    flat = lists.flatten()
    return flat, np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()) if not lists.null_count else lists.value_lengths().fill_null(0).to_numpy())


def _numbered(p: Phrases, doc: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in p of phrases given by document and number; and which of those given are there."""
    heads = np.searchsorted(p.doc, doc)
    there = k < np.searchsorted(p.doc, doc, "right") - heads
    return (heads + k)[there], there


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, starts in blocks(batches):
        p = Phrases(data, starts)
        e1, e2 = p.extended()
        which, n, _ = p.distinct(e1, e2)
        flat, row = _listed(batch, "ks")
        asked, _ = _numbered(p, row, flat.to_numpy(zero_copy_only=False))
        kept = np.zeros(len(p.doc), bool)
        kept[asked] = True
        sure = kept[which]
        which, n = which[sure], n[sure]
        yield pa.RecordBatch.from_arrays([_signed(p.end[which]), _signed(e1[which]), _signed(e2[which]), *_taken(batch, ("d", "e"), p.doc[which]), pa.array(p.k[which], pa.int32()), pa.array(n, pa.int64())], ["end", "e1", "e2", "d", "e", "k", "n"])


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the phrases asked for, before the trigger and after it."""
    for batch, data, starts in blocks(batches):
        p = Phrases(data, starts)
        flat, row = _listed(batch, "asked")
        asked, there = _numbered(p, row, flat.field("k").to_numpy(zero_copy_only=False))
        flat, row = flat.filter(pa.array(there)), row[there]
        left = [data[a:b].tobytes() for a, b in zip(p.first[asked], p.at[asked])]
        right = [data[a:b].tobytes() for a, b in zip(p.at[asked], p.last[asked] + WIDTH)]
        yield pa.RecordBatch.from_arrays([*_taken(batch, ("d", "e"), row), *[flat.field(n) for n in ("k", "end", "single", "large")], pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["d", "e", "k", "end", "single", "large", "left", "right"])


def _matrix(texts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)


def _sorted(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of `texts`, and how many bytes each shares with the one before it in that order."""
    width = -(-width // 8) * 8
    rows = _matrix(texts, width)
    order = np.lexsort(np.ascontiguousarray(rows).view(">u8").T[::-1])
    differ = rows[order][1:] != rows[order][:-1]
    common = np.zeros(len(texts), np.int64)
    common[1:] = np.where(differ.any(1), differ.argmax(1), width)
    return order, common


def repeated_suffixes(left: list[bytes], right: list[bytes], single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, length of the phrase's suffix) of each string of a single phrase that starts elsewhere too.

    A row's strings start at most len(left) bytes before its trigger, and end within `right`.
    """
    most, least = np.array([len(x) for x in left]), WIDTH - np.array([len(x) for x in right])
    phrase, shared_left = _sorted([x[::-1] for x in left], REACH)
    parse, shared_right = _sorted(right, WIDTH)
    n, rows, lengths = len(left), [], []
    dictionary_rank, parse_rank = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(max(1, int(least.min())), int(most.max()) + 1):
        these = np.flatnonzero((least <= a) & (a <= most))
        dictionary_rank[phrase] = np.cumsum(shared_left < a)
        parse_rank[parse] = np.cumsum(shared_right < WIDTH - a)
        rank = dictionary_rank[these] * (n + 1) + parse_rank[these]
        order = np.argsort(rank)
        same = rank[order][1:] == rank[order][:-1]
        both = np.zeros(len(these), bool)
        both[order[1:]] = same
        both[order[:-1]] |= same
        found = these[both & single[these]]
        rows.append(found)
        lengths.append(np.full(len(found), a))
    return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *lengths])


def _in_corpus_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by `end`; those of one end are compared in one block."""
    held: pa.Table | None = None

    def compared(rows: pa.Table) -> pa.RecordBatch:
        row, a = repeated_suffixes(rows["left"].to_pylist(), rows["right"].to_pylist(), rows["single"].to_numpy())
        order = np.argsort(row, kind="stable")
        row, a = row[order], a[order]
        heads = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
        found = rows.take(pa.array(row[heads])).combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(row)), pa.int32()), pa.array(a, pa.int32()))
        columns = [found[n].chunk(0) if found.num_rows else pa.array([], rows.schema.field(n).type) for n in ("d", "e", "k")]
        return pa.RecordBatch.from_arrays([*columns, lists], ["d", "e", "k", "a"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        if held.num_rows >= BLOCK:
            ends = held["end"].to_numpy()
            cut = int(np.searchsorted(ends, ends[-1]))  # the last end may go on
            if cut:
                yield compared(held.slice(0, cut))
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield compared(held)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a stretch of STEP lengths of a phrase's suffix: those that the phrase has, the bytes that any strings of the
    stretch have in common, all bytes of its strings, and its weight."""
    for batch in batches:
        left, right, single = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("left", "right", "single"))
        row, lo, hi, core, text = [], [], [], [], []
        for i, (a, b) in enumerate(zip(left, right)):
            at, least, whole = len(a), WIDTH - len(b), a + b
            for begin in range((least - 1) // STEP * STEP + 1, at + 1, STEP):
                row.append(i)
                lo.append(max(begin, least))
                hi.append(min(begin + STEP - 1, at))
                core.append(whole[at - begin : at - begin + WIDTH - STEP + 1])
                text.append(whole[at - hi[-1] : at - lo[-1] + WIDTH])
        weight = np.where(np.array(single, bool), 1, 2)[np.array(row, np.int64)]
        yield pa.RecordBatch.from_arrays([*_taken(batch, ("d", "e", "k"), np.array(row, np.int64)), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(core, pa.binary()), pa.array(text, pa.binary()), pa.array(weight, pa.int64())], ["d", "e", "k", "lo", "hi", "core", "text", "n"])


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a string of a stretch: its phrase, the length of the phrase's suffix, 128 bits of hash, and its weight."""
    for batch in batches:
        if not batch.num_rows:
            continue
        hi, text = (batch.column(batch.schema.get_field_index(n)) for n in ("hi", "text"))
        whole = text.to_pylist()
        sizes = np.array([len(x) for x in whole])
        data = np.frombuffer(b"".join(whole), np.uint8)
        n = sizes - WIDTH + 1
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin = place + np.repeat(np.cumsum(sizes) - sizes, n)
        hashes = [_Hash(data, b)(begin, begin + WIDTH) for b in _BASES]
        yield pa.RecordBatch.from_arrays([*_taken(batch, ("d", "e", "k"), row), pa.array(hi.to_numpy()[row] - place, pa.int32()), *map(_signed, hashes), *_taken(batch, ("n",), row)], ["d", "e", "k", "a", "h1", "h2", "n"])


def _of_large_ends(spelled: DataFrame) -> DataFrame:
    """d, e, k, a: the suffixes of single phrases whose strings start elsewhere too, without bringing an end together.

    Equal strings lie in the same stretch of their phrases, and have its core. A core met once so has no repeated string,
    and a stretch met twice nothing else; only the different stretches of one core are counted string by string, of each one.
    Strings met once are told by the sums themselves, and what is not met once repeats: no string meets its count.
    """
    stretches = spelled.mapInArrow(_stretches, "d bigint, e bigint, k int, lo int, hi int, core binary, text binary, n bigint")
    hashed = [F.xxhash64(*seed, x).alias(f"{x}{i}") for x in ("core", "text") for i, seed in ((1, ()), (2, (F.lit(7),)))]
    kinds = stretches.select("*", *hashed).groupBy("core1", "core2", "text1", "text2")
    kinds = stored(kinds.agg(F.sum("n").alias("met"), F.min(F.struct("d", "e", "k", "lo", "hi", "text")).alias("where")), "stretches")
    cores = stored(kinds.groupBy("core1", "core2").agg(F.count("*").alias("n")), "cores")
    known = stored(meet(kinds, cores, ["core1", "core2"], ["text1"]).select("where.*", "met", "n"), "known-stretches")

    strings = known.where("n > 1").select("d", "e", "k", "hi", "text", F.least("met", F.lit(2)).alias("n")).mapInArrow(_one_by_one, "d bigint, e bigint, k int, a int, h1 bigint, h2 bigint, n bigint")
    strings = strings.groupBy("h1", "h2").agg(F.sum("n").alias("n"), *[F.min(c).alias(c) for c in ("d", "e", "k", "a")]).where("n = 1")
    once = strings.select("d", "e", "k", F.col("a").alias("lo"), F.col("a").alias("hi")).union(known.where("n = 1 and met = 1").select("d", "e", "k", "lo", "hi"))
    every = F.sequence((WIDTH - F.octet_length("right")), F.octet_length("left"))
    rows = spelled.where("single").select("d", "e", "k", every.alias("every"), F.lit(None).cast("array<int>").alias("once"))
    rows = rows.union(once.select("d", "e", "k", F.lit(None).cast("array<int>"), F.sequence("lo", "hi"))).groupBy("d", "e", "k")
    repeated = rows.agg(F.array_except(F.max("every"), F.flatten(F.collect_list("once"))).alias("a"))
    return repeated.where(F.size("a") > 0)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, starts in blocks(batches):
        p = Phrases(data, starts)
        edge = np.zeros(len(data) + 1, np.int32)
        flat, row = _listed(batch, "deep")
        _, _, group = p.distinct(*p.extended())
        asked, _ = _numbered(p, row, flat.to_numpy(zero_copy_only=False))
        whole = np.isin(group, group[asked])
        np.add.at(edge, p.first[whole], 1)
        np.add.at(edge, p.last[whole] + WIDTH, -1)
        flat, row = _listed(batch, "parts")
        a = flat.field("a")
        asked, there = _numbered(p, row, flat.field("k").to_numpy(zero_copy_only=False))
        begin = np.repeat(p.at[asked], a.value_lengths().to_numpy()[there]) - a.filter(pa.array(there)).flatten().to_numpy(zero_copy_only=False)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + WIDTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        kept, froms, tos = [], [], []
        for a, b in zip(starts[:-1], starts[1:]):
            own = gone[a:b]
            turn = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            kept.append(data[a:b][~own].tobytes())
            froms.append(turn[::2])
            tos.append(turn[1::2])
        spans = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, froms)]), pa.int32()), pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (froms, tos)], ["start", "stop"]))
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("row")), pa.array(kept, pa.binary()), spans], ["row", "kept", "spans"])


def _texts(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns but the text), text without nulls, and its 128-bit hash d, e."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    return docs.select(row, whole_text().alias("text")).select("*", F.xxhash64("text").alias("d"), F.xxhash64(F.lit(7), "text").alias("e"))


def _told(texts: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """`texts` with the columns of `listed`: a list of bounded size is broadcast, a longer one met by dealing out the texts."""
    if listed.count() <= LISTED:
        return texts.join(F.broadcast(listed), keys, "left")
    return meet(texts, listed, keys, ["row"])


def repeated_parts(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts with their state, those to compare, and the phrases found repeated in each of them.

    States: `copied` (all strings repeat), `open` (some may); the rest is left as it is. Of each text to compare: deep, the
    numbers of phrases that repeat as a whole, and parts, numbers of phrases with the suffixes that do.
    """
    texts = _texts(docs)
    ends = texts.select("d", "text").mapInArrow(_ends, "end bigint, d bigint, k int, n bigint")
    shared = stored(ends.groupBy("end").agg(F.sum("n").alias("n")).where("n > 1"), "phrase-ends")
    met = meet(ends.drop("n"), shared, ["end"], ["d", "k"]).where("n is not null")
    survivors = stored(met.groupBy("d").agg(F.collect_set("k").alias("ks"), F.lit(1).cast("bigint").alias("n")), "survivors")

    copies = stored(texts.groupBy("d", "e").agg(F.count("*").alias("n"), F.min("row.doc_id").alias("least")).where("n > 1"), "copies")
    told = _told(_told(texts, copies, ["d", "e"]).withColumnRenamed("n", "copies"), survivors.select("d", "n"), ["d"])
    state = told.select("row", "text", "d", "e", F.col("copies").isNotNull().alias("copied"), F.col("n").isNotNull().alias("open"), F.col("row.doc_id").eqNullSafe(F.col("least")).alias("stands"))
    compared = state.where("open and (not copied or stands)").join(survivors.select("d", "ks"), "d")
    compared = stored(compared.select("row", "text", "d", "e", "copied", "ks"), "candidates")

    phrases = compared.select("d", "e", "text", "ks").mapInArrow(_extended, "end bigint, e1 bigint, e2 bigint, d bigint, e bigint, k int, n bigint")
    dictionary = stored(phrases.groupBy("end", "e1", "e2").agg(F.sum("n").alias("met"), F.min(F.struct("d", "e", "k")).alias("where")), "dictionary")
    deep = meet(phrases.drop("n"), dictionary.where("met > 1").select("e1", "e2", F.col("met").alias("n")), ["e1", "e2"], ["d", "k"]).where("n is not null")
    deep = deep.groupBy("d", "e").agg(F.collect_set("k").alias("deep"))

    several = stored(dictionary.groupBy("end").agg(F.count("*").alias("n")).where("n > 1"), "shared-ends")
    undecided = meet(dictionary, several, ["end"], ["e1"]).where("n is not null")
    asked = undecided.groupBy("where.d", "where.e").agg(F.collect_list(F.struct("where.k", "end", (F.col("met") == 1).alias("single"), (F.col("n") > LARGE).alias("large"))).alias("asked"))
    spelled = compared.select("d", "e", "text").join(asked, ["d", "e"]).mapInArrow(_spelled, "d bigint, e bigint, k int, end bigint, single boolean, large boolean, left binary, right binary")
    spelled = stored(spelled, "extended-phrases")
    parts = spelled.where("not large").repartition("end").sortWithinPartitions("end").mapInArrow(_in_corpus_order, "d bigint, e bigint, k int, a array<int>")
    large = _of_large_ends(spelled.where("large"))
    parts = parts.union(large.select("d", "e", "k", "a")).groupBy("d", "e").agg(F.collect_list(F.struct("k", "a")).alias("parts"))
    return state, compared, deep.join(parts, ["d", "e"], "full")


def without_repeats(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns but the text), n_bytes, kept (the bytes that stay), spans (start and stop of each removed run)."""
    state, compared, found = repeated_parts(docs)
    raw = F.col("text").cast("binary")
    size = F.octet_length("text").cast("bigint")
    spans = "array<struct<start:bigint,stop:bigint>>"
    all_of_it = F.col("copied") & (size >= WIDTH)
    decided = state.where("copied or not open").select("row", size.alias("n_bytes"), F.when(all_of_it, F.lit(b"")).otherwise(raw).alias("kept"), F.when(all_of_it, F.array(F.struct(F.lit(0).cast("bigint").alias("start"), size.alias("stop")))).otherwise(F.array()).cast(spans).alias("spans"))
    none = F.array().cast("array<int>")
    rest = compared.where("not copied").select("row", "text", "d", "e").join(found, ["d", "e"], "left")
    rest = rest.select("row", "text", F.coalesce("deep", none).alias("deep"), F.coalesce("parts", F.array().cast("array<struct<k:int,a:array<int>>>")).alias("parts"))
    schema = T.StructType([compared.schema["row"], T.StructField("kept", T.BinaryType()), T.StructField("spans", T._parse_datatype_string(spans))])
    cut = rest.mapInArrow(_cut, schema)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["stop"] - x["start"])
    return decided.union(cut.select("row", (F.octet_length("kept") + removed).cast("bigint").alias("n_bytes"), "kept", "spans"))


def digests(parts: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of what `without_repeats` gives."""

    def size(x: str | Column) -> Column:
        return F.octet_length(x).cast("bigint")

    return parts.select("row.doc_id", "n_bytes", (F.col("n_bytes") - size("kept")).alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def oracle() -> str:
    """The digests over `documents` as DuckDB SQL: every string by its hash, bytes as hexadecimal digits."""
    return f"""WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5_number(substr(h, 2 * i + 1, {2 * WIDTH})) AS k FROM (SELECT r, h, unnest(range(0, length(h) // 2 - {WIDTH - 1})) AS i FROM t)),
s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
g AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + {WIDTH} THEN 1 ELSE 0 END AS fresh FROM s)),
spans AS (SELECT r, min(i) AS a, max(i) + {WIDTH} AS b FROM g GROUP BY r, g),
cuts AS (SELECT r, b AS a, lead(a) OVER (PARTITION BY r ORDER BY a) AS b FROM spans UNION ALL SELECT r, 0, min(a) FROM spans GROUP BY r),
kept AS (SELECT c.r, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a) AS h FROM cuts c JOIN t ON t.r = c.r GROUP BY c.r),
n AS (SELECT r, count(*) AS n, sum(b - a) AS bytes FROM spans GROUP BY r)
SELECT doc_id, CAST(length(t.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(bytes, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN n IS NULL THEN t.h ELSE coalesce(kept.h, '') END)) AS kept_sha256
FROM t LEFT JOIN kept ON t.r = kept.r LEFT JOIN n ON t.r = n.r"""
