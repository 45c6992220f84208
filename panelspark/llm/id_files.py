"""Operator 6: token ids as binary shards with a minimal perfect hash index.

Documents are dealt into ranges of their key and sorted; each task encodes its range and writes a shard of raw
little-endian ids (16 bits where the vocabulary fits, else 32) beside an index file. The index holds a minimal perfect
hash from key to slot, in blocks of 512 bits with the number of bits set before each; a slot stores a fingerprint of its
key, the document's offset and its length; keys and lengths in file order follow. A key finds its shard by the shards'
greatest keys, and its ids by one block a level of the hash (two levels for most keys), one slot and one read of the ids:
the time does not grow with the shard. A key that is not there finds another's ids with a probability of 2 ** -32.

Whole-number keys are hashed as they are, others as text by a 64-bit digest; keys that share one are listed beside the
hash. Files carry unique names and a task's row names the file it finished, so a task that runs again after a lost
executor leaves at most an unnamed file. Shards take SHARD bytes of text at most, but for one longer document or for many
rows of one key; a task holds one block of text and the keys and lengths of its shard.

Defined results: null text is empty (the end id alone); rows that repeat a key are all written, in order, and keyed
access gives the first; null keys come first and are not indexed; an empty table gives no shards; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import blocks, mixed
from .shared import new_path, stored
from .tokens import TOKEN_BLOCK, encoded, library, with_end

SHARD, SPAN = 256 << 20, 512
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WHOLE = ("tinyint", "smallint", "int", "bigint")


class MinimalHash:
    """A minimal perfect hash of distinct 64-bit keys: levels of bit arrays, each key at the first level where it is alone."""

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        self.rank = np.cumsum([0, *(int(b.sum()) for b in bits)])
        self.sums = [np.cumsum(b) for b in bits]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + np.array([level + 1], np.uint64) * _STEP) % np.uint64(size)).astype(np.int64)

    @classmethod
    def built(cls, keys: np.ndarray) -> MinimalHash:
        bits, left = [], keys.view(np.uint64)
        while len(left):
            size = 2 * len(left) + 1
            at = cls._place(left, len(bits), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            left = left[~alone[at]]
        return cls(bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A number from 0 to n - 1 for each key of the set; for any other key some number, or -1."""
        keys, out = keys.view(np.uint64), np.full(len(keys), -1, np.int64)
        for level, bits in enumerate(self.bits):
            open_ = np.flatnonzero(out < 0)
            at = self._place(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.rank[level] + self.sums[level][at[hit]] - 1
        return out


def coded(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64 bits and a fingerprint of 32 bits of each key."""
    if pa.types.is_integer(keys.type):
        code = keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        return code, (mixed(code ^ np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32)
    raw = b"".join(hashlib.blake2b(k.encode(), digest_size=12).digest() for k in keys.to_pylist())
    both = np.frombuffer(raw, np.dtype([("code", "<u8"), ("print", "<u4")]))
    return both["code"].copy(), both["print"].copy()


def _index_bytes(keys: pa.Array, lengths: np.ndarray, width: int) -> bytes:
    """The index file of documents in order; null keys come first."""
    offsets = np.cumsum(np.concatenate([[0], lengths]))[:-1].astype(np.int64)
    code, prints = coded(keys.slice(keys.null_count))
    first = {}  # the first row of each key whose 64 bits another key has
    unique, where = np.unique(code, return_index=True)
    if not pa.types.is_integer(keys.type) and len(unique) < len(code):
        names = keys.slice(keys.null_count).to_pylist()
        one = dict(zip(unique.tolist(), where.tolist(), strict=True))
        for row, (name, c) in enumerate(zip(names, code.tolist(), strict=True)):
            if names[one[c]] != name and name not in first:
                first[name] = row
    at = where + keys.null_count
    h = MinimalHash.built(unique.view(np.int64))
    slot = h.slots(unique.view(np.int64))
    table = np.zeros((len(unique), 3), "<i8")
    table[slot] = np.stack([prints[where].astype(np.int64), offsets[at], lengths[at]], axis=1)
    parts, levels, place = [table.tobytes()], [], table.nbytes
    for bits, before in zip(h.bits, h.rank, strict=False):
        rows = np.zeros((-(-len(bits) // SPAN), SPAN), bool)
        rows.ravel()[: len(bits)] = bits
        sums = before + np.cumsum(np.concatenate([[0], rows.sum(1)]))[:-1]
        block = np.concatenate([sums.astype("<i8").view(np.uint8).reshape(-1, 8), np.packbits(rows, axis=1, bitorder="little")], axis=1)
        parts.append(block.tobytes())
        levels.append([len(bits), place])
        place += block.nbytes
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([keys, pa.array(lengths, pa.int64())], names=["key", "length"])
    with pa.ipc.new_file(sink, batch.schema) as out:
        out.write_batch(batch)
    twins = {name: [int(offsets[row + keys.null_count]), int(lengths[row + keys.null_count])] for name, row in first.items()}
    head = json.dumps({"width": width, "keys": len(unique), "levels": levels, "rows": place, "twins": twins}).encode()
    return len(head).to_bytes(8, "little") + head + b"".join(parts) + sink.getvalue().to_pybytes()


class Lookup:
    """Keyed access to an index through reads of a few bytes."""

    def __init__(self, read: Callable[[int, int], bytes]):
        n = int.from_bytes(read(0, 8), "little")
        self.read, self.head, self.base = read, json.loads(read(8, n)), 8 + n
        self.width = self.head["width"]

    def slot(self, code: np.ndarray) -> int:
        """A number under the number of keys, or -1, for an array of one code."""
        for level, (size, place) in enumerate(self.head["levels"]):
            at = int(MinimalHash._place(code, level, size)[0])
            raw = self.read(self.base + place + at // SPAN * (8 + SPAN // 8), 8 + SPAN // 8)
            bits = int.from_bytes(raw[8:], "little")
            if bits >> at % SPAN & 1:
                return int.from_bytes(raw[:8], "little") + (bits & (1 << at % SPAN) - 1).bit_count()
        return -1

    def find(self, key: int | str) -> tuple[int, int]:
        """Offset and length in ids of the key's first document; -1 where its fingerprint is not stored."""
        if key in self.head["twins"]:
            return tuple(self.head["twins"][key])
        code, prints = coded(pa.array([key]))
        slot = self.slot(code)
        if slot >= 0:
            stored_print, offset, length = np.frombuffer(self.read(self.base + 24 * slot, 24), "<i8").tolist()
            if stored_print == int(prints[0]):
                return offset, length
        return -1, -1

    def rows(self, size: int) -> tuple[pa.Array, np.ndarray]:
        """Keys and lengths of all documents in order; `size` is the file's."""
        at = self.base + self.head["rows"]
        table = pa.ipc.open_file(pa.py_buffer(self.read(at, size - at))).read_all().combine_chunks()
        keys = table["key"].combine_chunks() if isinstance(table["key"], pa.ChunkedArray) else table["key"]
        return keys, table["length"].to_numpy().astype(np.int64)


def write_ids(docs: DataFrame, tokenizer: str, end_id: int | None = 1, shard_bytes: int = SHARD) -> DataFrame:
    """Write `docs` (doc_id, text) as shards; one row a shard: shard, path, n_documents, n_ids, high (the greatest key), start."""
    spark = docs.sparkSession
    folder = new_path(spark, "ids")
    width = 2 if library(tokenizer).get_vocab_size() <= 1 << 16 else 4
    kind = "bigint" if dict(docs.dtypes)["doc_id"] in _WHOLE else "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name, keys, lengths = f"ids-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", [], []
        out = None
        for batch, data, starts in blocks(batches, most=TOKEN_BLOCK):
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}.bin")
            ids, at = with_end(*encoded(data, starts, tokenizer), end_id)
            out.write(ids.astype(f"<u{width}").tobytes())
            keys.append(batch.column(0))
            lengths.append(np.diff(at))
        if out is not None:
            out.close()
            k, n = pa.concat_arrays(keys), np.concatenate(lengths)
            with fs.open_output_stream(f"{root}/{name}.idx") as index:
                index.write(_index_bytes(k, n, width))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([len(k)], pa.int64()), pa.array([int(n.sum())], pa.int64()), k.slice(len(k) - 1)], names=["shard", "path", "n_documents", "n_ids", "high"])

    rows = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    whole = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(-(-whole // shard_bytes), min(4 * spark.sparkContext.defaultParallelism, -(-whole // (1 << 20))), 1)
    ranged = rows.repartitionByRange(int(shards), "doc_id", "row").sortWithinPartitions("doc_id", "row")
    made = stored(ranged.mapInArrow(run, f"shard bigint, path string, n_documents bigint, n_ids bigint, high {kind}"), "shards")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row a shard
    return made.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every document of the shards, each key looked up in its shard's hash index."""
    kind = dict(shards.dtypes)["high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, root = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(f"{root}.idx") as f:
                    raw = f.read()
                index = Lookup(lambda at, n, raw=raw: raw[at : at + n])
                keys, lengths = index.rows(len(raw))
                offset = np.cumsum(np.concatenate([[0], lengths]))
                seen = None
                for row in range(keys.null_count, len(keys)):
                    key = keys[row].as_py()
                    if key != seen and index.find(key) != (int(offset[row]), int(lengths[row])):
                        raise ValueError(f"the hash index of {path} does not lead to its documents")
                    seen = key
                with fs.open_input_file(f"{root}.bin") as f:
                    at = 0
                    while at < len(keys):
                        to = max(at + 1, int(np.searchsorted(offset, offset[at] + (2 << 20), "right")) - 1)
                        f.seek(int(offset[at]) * index.width)
                        ids = np.frombuffer(f.read(int(offset[to] - offset[at]) * index.width), f"<u{index.width}").astype("<u4")
                        edge = offset[at : to + 1] - offset[at]
                        crc = [zlib.crc32(ids[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays([keys.slice(at, to - at), pa.array(start + offset[at:to]), pa.array(np.diff(edge)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        at = to

    # as many tasks as shards: by their number, since the rows are too small for Spark to see the work behind them
    return shards.select("path", "start").repartition(max(shards.count(), 1), "path").mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def ids_of(spark: SparkSession, shards: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, ids (or null) for a table of keys (column doc_id): its shard by the greatest keys, one slot by hash, one read."""
    kind = dict(shards.dtypes)["high"]
    known = shards.where("high is not null").orderBy("shard").select("path", "high").collect()  # a row a shard, of up to SHARD bytes of text
    paths, highs = [r["path"] for r in known], pd.Series([r["high"] for r in known], dtype=object)
    asked = keys.select(F.col("doc_id").cast(kind).alias("doc_id")).where("doc_id is not null").distinct()

    def routed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(shard=highs.searchsorted(frame["doc_id"].astype(object), "left"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, part in frame.groupby("shard"):
                if shard == len(paths):
                    yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [None] * len(part)})
                    continue
                fs, root = pafs.FileSystem.from_uri(paths[shard])
                with fs.open_input_file(f"{root}.idx") as f, fs.open_input_file(f"{root}.bin") as data:
                    index, ids = Lookup(lambda at, n, f=f: f.read_at(n, at)), []
                    for key in part["doc_id"].tolist():
                        offset, n = index.find(key)
                        ids.append(np.frombuffer(data.read_at(n * index.width, offset * index.width), f"<u{index.width}").astype(np.int32).tolist() if n >= 0 else None)
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": ids})

    return asked.mapInPandas(routed, f"doc_id {kind}, shard bigint").repartition(len(paths) + 1, "shard").mapInPandas(run, f"doc_id {kind}, ids array<int>")


def written_and_read(docs: DataFrame, tokenizer: str, end_id: int | None = 1) -> DataFrame:
    return read_ids(write_ids(docs, tokenizer, end_id)).withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]))
