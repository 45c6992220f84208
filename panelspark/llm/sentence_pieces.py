"""Operator 5: SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here, and normaliser, metaspace marker, scores (or merges, for a BPE model) and byte
fallback are rebuilt for the tokenizers library. Texts are cut where no piece can cross, before a run of blanks and
around line ends; the distinct parts of a block are encoded in one batch of the tokenizers library, by as many threads as
a task has cores and two at least, and decoded again. Its ids are the result; the sentencepiece library encodes each part too, and where it gives others,
the part counts as differing.

Defined results: null text is empty and has no tokens; very long texts are encoded whole, part by part; equal scores are the
library's to decide, and checked; repeated rows are encoded alike; control strings in texts are
plain text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import blocks
from .tokens import Store

MARK = "▁"
#: Piece types and model types of the format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
BLOCK = 4 << 20


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message; fixed-size and length-delimited values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = varint() if size is None else size
        yield key >> 3, raw[at : at + size]
        at += size


def parsed(raw: bytes) -> dict:
    """Pieces (text, score, type), model type, byte fallback and normaliser of a SentencePiece model file."""
    model = {"pieces": [], "type": UNIGRAM, "byte_fallback": False, "charsmap": b"", "dummy_prefix": True, "extra_blanks": True, "escape": True, "suffix": False}
    for field, value in _fields(raw):
        if field == 1:
            piece = {1: b"", 2: struct.pack("<f", 0), 3: NORMAL} | dict(_fields(value))
            model["pieces"].append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif field == 2:
            spec = dict(_fields(value))
            model |= {"type": spec.get(3, UNIGRAM), "byte_fallback": bool(spec.get(35, 0)), "suffix": bool(spec.get(24, 0))}
        elif field == 3:
            spec = dict(_fields(value))
            model |= {"charsmap": spec.get(2, b""), "dummy_prefix": bool(spec.get(3, 1)), "extra_blanks": bool(spec.get(4, 1)), "escape": bool(spec.get(5, 1))}
    return model


def backend(model: dict, prefix: bool = True):
    """The model as a Tokenizer of the tokenizers library; without `prefix`, no blank is put before a text."""
    from tokenizers import AddedToken, Tokenizer, decoders, models, normalizers

    pieces = model["pieces"]
    unknown = next((k for k, p in enumerate(pieces) if p[2] == UNKNOWN), None)
    if model["type"] == UNIGRAM:
        low = min((s for _, s, t in pieces if t == NORMAL), default=0.0) - 10
        core = models.Unigram([(p, s if t == NORMAL else low if t == UNKNOWN else -1e9) for p, s, t in pieces], unknown, model["byte_fallback"])
    else:
        vocab = {p: k for k, (p, _, _) in enumerate(pieces)}
        plain = {p: s for p, s, t in pieces if t in (NORMAL, USER)}
        merges = []
        for p, s in plain.items():
            for k in range(1, len(p)):
                if p[:k] in plain and p[k:] in plain:
                    merges.append((-s, vocab[p], vocab[p[:k]], vocab[p[k:]], p[:k], p[k:]))
        core = models.BPE(vocab, [m[4:] for m in sorted(merges)], unk_token=pieces[unknown][0] if unknown is not None else None, fuse_unk=True, byte_fallback=model["byte_fallback"])
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["extra_blanks"]:
        from tokenizers import Regex

        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if prefix and model["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK))
    if model["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if prefix and model["dummy_prefix"] else [])])
    if own := [AddedToken(p, normalized=True) for p, _, t in pieces if t == USER]:
        out.add_tokens(own)
    return out


def cuts_apart(model: dict) -> bool:
    """Whether a text's pieces are those of its parts: the normaliser keeps each character, and no piece runs across a cut."""
    plain = [p for p, _, t in model["pieces"] if t in (NORMAL, USER)]
    return not model["charsmap"] and not model["extra_blanks"] and model["escape"] and model["dummy_prefix"] and not model["suffix"] and not any(MARK in p.lstrip(MARK) or "\n" in p for p in plain)


@cache
def _coder(path: str, threads: int) -> tuple[bool, Store]:
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    import sentencepiece

    model = parsed(Path(path).read_bytes())
    parts = cuts_apart(model)
    own, theirs = backend(model, prefix=not parts), sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(texts: list[str]) -> list[list[int]]:
        """A word of flags (1: the libraries differ, 2: the text does not come back), then the ids."""
        lists = [x.ids for x in own.encode_batch_fast(texts, add_special_tokens=False)]
        lead = [parts and (t == " " or not t.startswith(" ")) for t in texts]  # the library's own prefix is not theirs
        asked = [t[1:] if parts and t.startswith(" ") else t for t in texts]
        right = theirs.encode(asked, num_threads=threads)
        out = []
        back = own.decode_batch(lists, skip_special_tokens=False)
        for text, a, b, inner, again in zip(texts, lists, right, lead, back, strict=True):
            if inner:  # parts after a line end, and lone blanks: the library is asked with a line end before them
                b = theirs.encode("\n" + text)
                b = b[len(theirs.encode("\n")) :]
            out.append([(a != b) | (again != text) << 1, *a])
        return out

    return parts, Store(encode, 2_000_000)


def pieces_of(data: np.ndarray, starts: np.ndarray, path: str, threads: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all documents of a block in a row, where each document's begin, and by document how many parts differ and do not come back."""
    parts, store = _coder(path, threads)
    n = len(starts) - 1
    filled = np.diff(starts) > 0
    if parts:
        first = np.flatnonzero(filled)
        data = np.insert(data, starts[:-1][first], 0x20)
        starts = starts + np.concatenate([[0], np.cumsum(filled)])
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True
    if parts and len(data) > 1:
        mark = np.zeros(len(data), bool)
        mark[3:] = (data[:-3] == 0xE2) & (data[1:-2] == 0x96) & (data[2:-1] == 0x81)
        cut[1:-1] |= (data[1:] == 0x20) & (data[:-1] != 0x20) & ~mark[1:]
        cut[1:-1] |= (data[1:] == 0x0A) != (data[:-1] == 0x0A)
    begin = np.flatnonzero(cut[:-1])
    end = np.append(begin[1:], len(data)) if len(begin) else begin
    ids, at = store.lists(store.of(data, begin, end))
    doc = np.searchsorted(starts, begin, "right") - 1
    flags = ids[at[:-1]]
    keep = np.ones(len(ids), bool)
    keep[at[:-1]] = False
    edge = (at - np.arange(len(at)))[np.searchsorted(begin, starts)]
    return ids[keep], edge, np.bincount(doc[(flags & 1) > 0], minlength=n), np.bincount(doc[(flags & 2) > 0], minlength=n)


def encoded_pieces(docs: DataFrame, model: str, threads: int | None = None) -> DataFrame:
    """doc_id, ids, n_differing and round_trip for every row of `docs` (columns doc_id and text)."""
    return _encoded(docs, model, threads, False)


def piece_digests(docs: DataFrame, model: str, threads: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids_crc32 (ids as little-endian unsigned 32-bit integers), n_differing, round_trip."""
    return _encoded(docs, model, threads, True)


def _encoded(docs: DataFrame, model: str, threads: int | None, digest: bool) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    threads = threads or max(2, int(docs.sparkSession.conf.get("spark.task.cpus", "1")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in blocks(batches, most=BLOCK):
            ids, at, differ, lost = pieces_of(data, starts, model, threads)
            if digest:
                raw = ids.astype("<u4")
                own = [pa.array(np.diff(starts)), pa.array(np.diff(at)), pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())]
            else:
                own = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *own, pa.array(differ, pa.int64()), pa.array(lost == 0)], names=["doc_id", *(["n_bytes", "n_tokens", "ids_crc32"] if digest else ["ids"]), "n_differing", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {'n_bytes bigint, n_tokens bigint, ids_crc32 bigint' if digest else 'ids array<int>'}, n_differing bigint, round_trip boolean")


@cache
def _decoder(path: str):
    return backend(parsed(Path(path).read_bytes()))


def decoded(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """The rows with column `ids` decoded into a column text; null lists give an empty text."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def text(lists):
        import pandas as pd

        return pd.Series(_decoder(model).decode_batch([[] if x is None else list(map(int, x)) for x in lists], skip_special_tokens=False))

    return rows.withColumn("text", text(F.col(ids)))
