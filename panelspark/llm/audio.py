"""Operator 1: telephony audio as a media column.

Bytes are kept losslessly as 8-bit G.711 samples in a WAV file per row. Stored files are read back and expanded to
16-bit PCM: mu-law and A-law by tables of 256 values, IMA ADPCM by decoding all blocks at once, one nibble position a
step. PCM is resampled by linear interpolation in integers and written to the shared folder in a lossless predicted form
(`packed`): even samples, then what odd ones differ from the mean of their neighbours. It is read back, unpacked and hashed.

Defined results: null text is empty, and empty text is one block of 64 zero bytes; very long texts are one file, taken whole;
repeated rows give equal values; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks
from .shared import stored

UNIT, RATE, OUT_RATE = 64, 8000, 16000
#: Of the stored files: zstd level, and bytes that a writer holds before it writes a row group.
LEVEL, ROW_GROUP = 9, 32 << 20
MU_LAW, A_LAW, IMA = 7, 6, 17
#: IMA ADPCM step sizes and index changes.
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mu_law() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _a_law() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    high, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(high == 0, low + 8, low + 264 << np.maximum(high - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


EXPANDED = {MU_LAW: _mu_law(), A_LAW: _a_law()}


def wav(payload: bytes, law: int = MU_LAW, rate: int = RATE) -> bytes:
    """A mono WAV file whose 8-bit samples, or blocks of IMA ADPCM, are `payload`."""
    if law == IMA:
        per = 1 + 2 * (UNIT - 4)
        head = struct.pack("<4sIHHIIHHHH", b"fmt ", 20, law, 1, rate, rate * UNIT // per, UNIT, 4, 2, per) + struct.pack("<4sII", b"fact", 4, len(payload) // UNIT * per) + struct.pack("<4sI", b"data", len(payload))
    else:
        head = struct.pack("<4sIHHIIHHH", b"fmt ", 18, law, 1, rate, rate, 1, 8, 0) + struct.pack("<4sII", b"fact", 4, len(payload)) + struct.pack("<4sI", b"data", len(payload))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + len(payload) + len(payload) % 2, b"WAVE") + head + payload + b"\0" * (len(payload) % 2)


def samples(file: bytes) -> tuple[int, int, bytes]:
    """Format tag, rate and samples of a WAV file."""
    at, law, rate = 12, 0, 0
    while at + 8 <= len(file):
        name, size = struct.unpack_from("<4sI", file, at)
        if name == b"fmt ":
            law, _, rate = struct.unpack_from("<HHI", file, at + 8)
        elif name == b"data":
            return law, rate, file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples in the file")


def adpcm(data: np.ndarray, block: int = UNIT) -> np.ndarray:
    """PCM of IMA ADPCM blocks, one row a block: first sample, then two for each byte after the 4 of the header."""
    rows = data.reshape(-1, block)
    now = rows[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(rows[:, 2], 88).astype(np.int32)
    out = np.empty((len(rows), 1 + 2 * (block - 4)), np.int16)
    out[:, 0] = now
    for k in range(2 * (block - 4)):
        nibble = (rows[:, 4 + k // 2] >> (4 * (k % 2)) & 15).astype(np.int32)
        step = IMA_STEPS[index]
        change = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
        now = np.clip(now + np.where(nibble & 8, -change, change), -32768, 32767)
        index = np.clip(index + IMA_INDEX[nibble & 7], 0, 88)
        out[:, k + 1] = now
    return out


def resampled(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """`pcm` at another rate, by linear interpolation in integers; the last sample holds."""
    if rate == to or not len(pcm):
        return pcm
    at = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    i, part = at // to, at % to
    x = pcm.astype(np.int64)
    return ((x[i] * (to - part) + x[np.minimum(i + 1, len(x) - 1)] * part) // to).astype(np.int16)


def packed(pcm: np.ndarray) -> bytes:
    """16-bit samples as two planes: the even ones, and the odd ones less the mean of the even ones beside them."""
    x = pcm.astype("<i2")
    even, odd = x[::2], x[1::2]
    return even.tobytes() + (odd - _between(even, len(odd))).astype("<i2").tobytes()


def unpacked(planes: bytes) -> bytes:
    """The little-endian samples that `packed` was given."""
    x = np.frombuffer(planes, "<i2")
    out = np.empty(len(x), "<i2")
    even = x[: (len(x) + 1) // 2]
    out[::2] = even
    out[1::2] = x[len(even) :] + _between(even, len(x) // 2)
    return out.tobytes()


def _between(even: np.ndarray, n: int) -> np.ndarray:
    """The mean of each of n neighbours, rounded down; the last even sample stands for one after it. Differences wrap at 16 bits."""
    wide = even.astype(np.int32)
    return ((wide[:n] + np.append(wide[1:], wide[-1:])[:n]) >> 1).astype("<i2")


def stored_media(docs: DataFrame, law: int = MU_LAW, rate: int = RATE) -> DataFrame:
    """doc_id, n_bytes and media (a WAV file) for every row of `docs`, written to the shared folder."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in blocks(batches):
            raw, files = data.tobytes(), []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                files.append(wav(raw[a:b] + bytes(max(UNIT, -(-(b - a) // UNIT) * UNIT) - (b - a)), law, rate))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(starts)), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return stored(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary"), "media", LEVEL, ROW_GROUP)


def _expanded(law: int, data: np.ndarray) -> np.ndarray:
    return adpcm(data[: len(data) // UNIT * UNIT]).ravel() if law == IMA else EXPANDED[law][data]


def pcm(media: DataFrame, rate: int = OUT_RATE) -> DataFrame:
    """doc_id and 16-bit little-endian PCM at `rate` of G.711 and IMA ADPCM files in a media column, written to the shared folder."""
    kind = dict(media.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in blocks(batches, "media"):
            out = []
            for file in batch.column(1):
                law, own, data = samples(file.as_py())
                out.append(packed(resampled(_expanded(law, np.frombuffer(data, np.uint8)), own, rate)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "planes"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in blocks(batches, "planes"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([unpacked(x.as_py()) for x in batch.column(1)], pa.binary())], names=["doc_id", "pcm"])

    return stored(media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, planes binary"), "pcm", LEVEL, ROW_GROUP).mapInArrow(back, f"doc_id {kind}, pcm binary")


def _root_mean_square(x: np.ndarray) -> int:
    x = x.astype(np.int64).ravel()
    return int(np.sqrt((x * x).sum() // max(len(x), 1)))


def digests(media: DataFrame, rate: int = OUT_RATE) -> DataFrame:
    """Digests and features of a stored media column, and of its PCM at `rate`, which is written beside them; from the bytes read back."""
    kind = dict(media.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in blocks(batches, "media"):
            files = [x.as_py() for x in batch.column(2)]
            read = [samples(f) for f in files]
            whole = np.frombuffer(b"".join(p for _, _, p in read), np.uint8)
            edges = np.cumsum([0, *(len(p) for _, _, p in read)])
            waves = adpcm(whole)
            out = []
            for (law, own, p), file, n, a, b in zip(read, files, batch.column(1).to_pylist(), edges[:-1], edges[1:], strict=True):
                x = _expanded(law, whole[a:b])
                y = packed(resampled(x, own, rate))
                other = EXPANDED[A_LAW if law == MU_LAW else MU_LAW][whole[a:b]]
                wide = x.astype(np.int32)
                feature = f"samples={len(x)} peak={int(np.abs(wide).max())} rms={_root_mean_square(wide)} crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())} other_rms={_root_mean_square(other)} adpcm_rms={_root_mean_square(waves[a // UNIT : b // UNIT])}"
                out.append((n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), feature, y))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", *names, "planes"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in blocks(batches, "planes"):
            read = [unpacked(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(x) for x in read], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in read])], names=["doc_id", *names, "pcm_bytes", "pcm_sha256"])

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    columns = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    out = stored(media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"{columns}, planes binary"), "pcm", LEVEL, ROW_GROUP)
    return out.mapInArrow(hashed, f"{columns}, pcm_bytes bigint, pcm_sha256 string")
