"""Operator 8: quality classifier, a naive-Bayes support vector machine.

A document's features are indicators of its n-grams: lower-cased tokens, token pairs, and pairs and triples of token
shapes (kind, case, length, same as the token before), each hashed to one of 2 ** BITS places. Indicators are scaled by
the log-count ratio of the two classes; a linear hinge-loss model over the scaled, length-normed vectors is fitted by
dual coordinate descent; a logistic curve fitted on a fold kept aside turns margins into probabilities.

The fit reads a bounded sample: the `sample` labelled documents with the least hash of doc_id (a parameter). Only rows
whose crc32(doc_id as text) mod 5 is not 0 are ever learnt from. Scoring covers every whole text without a shuffle.

Defined results: very long texts are scored whole; a score equal to the threshold is predicted good; of equal hashes the sample
takes the lower doc_id; null and empty texts have no n-grams and get the score of an empty document; labels of null quality
are not learnt from; with no labels, or one class, every score is that class's share (0.5 without labels); repeated
rows are scored alike; other columns pass through `kept_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, blocks, document_of, mixed, span_hashes, spans

BITS = 18
SIZE = 1 << BITS
SAMPLE = 12_000
THRESHOLD = 0.3
#: Kinds of bytes: 0 apart, 1 letter (and any byte of a non-ASCII character), 2 digit, 3 other.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_K = mixed(np.arange(201, 212, dtype=np.uint64)) | np.uint64(1)


def _tokens(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of one kind of byte, and each document's first run."""
    if not len(data):
        return spans(data, starts)
    kind = _KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts[:-1][starts[:-1] < len(data)]] = True
    at = np.flatnonzero(new)
    to = np.append(at[1:], len(data))
    word = kind[at] > 0
    at, to = at[word], to[word]
    return at, to, np.searchsorted(at, starts)


def features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature places of all documents of a block, and each document's first in them."""
    n = len(starts) - 1
    at, to, first = _tokens(data, starts)
    doc = document_of(first)
    low = LOWER[data]
    word = span_hashes(low, at, to)
    kind = _KIND[data[at]].astype(np.uint64) if len(at) else np.zeros(0, np.uint64)
    big = np.zeros(len(data) + 1, np.int64)
    np.cumsum(low != data, out=big[1:])
    capitals = big[to] - big[at]
    case = np.where(capitals == 0, 0, np.where(capitals == to - at, 3, np.where((capitals == 1) & (low[at] != data[at]), 1, 2)) if len(at) else 0)
    size = np.minimum(np.floor(np.log2(np.maximum(to - at, 1))), 5).astype(np.uint64)
    shape = mixed(np.where(kind == 3, word, (kind * np.uint64(64) + case.astype(np.uint64) * np.uint64(8) + size) * _K[0]))
    same = np.zeros(len(at), np.uint64)
    for back in (1, 2):  # the token before, or the one before a mark in between
        if len(at) > back:
            same[back:] |= ((word[back:] == word[:-back]) & (doc[back:] == doc[:-back])).astype(np.uint64)
    shape = shape + same * _K[1]
    grams, docs = [mixed(word * _K[2])], [doc]
    for k, (what, odd) in enumerate(((word, _K[3:]), (shape, _K[5:]))):
        if len(at) > 1:
            grams.append(mixed(what[:-1] * odd[0] + what[1:] * odd[1])[doc[1:] == doc[:-1]])
            docs.append(doc[1:][doc[1:] == doc[:-1]])
    if len(at) > 2:
        inside = doc[2:] == doc[:-2]
        grams.append(mixed(shape[:-2] * _K[7] + shape[1:-1] * _K[8] + shape[2:] * _K[9])[inside])
        docs.append(doc[2:][inside])
    sizes = np.minimum(np.log2(np.diff(first) + 1.0) * 2, 40).astype(np.uint64)
    grams.append(mixed((sizes + np.uint64(1000)) * _K[10]))
    docs.append(np.arange(n))
    keys = np.concatenate(docs).astype(np.int64) << BITS | (np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64)
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys & (SIZE - 1), np.searchsorted(keys, np.arange(n + 1, dtype=np.int64) << BITS)


def descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of the L2-regularised hinge-loss model, by dual coordinate descent over the documents."""
    w, alpha, random = np.zeros(SIZE + 1), np.zeros(len(y)), np.random.default_rng(seed)
    norm = np.array([v @ v for v in values]) + 1.0
    for _ in range(epochs):
        most = 0.0
        for i in random.permutation(len(y)):
            at, x = rows[i], values[i]
            slope = y[i] * (w[at] @ x + w[SIZE]) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            if step := new - alpha[i]:
                alpha[i] = new
                w[at] += step * y[i] * x
                w[SIZE] += step * y[i]
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w


def _scaled(at: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    x = ratio[at]
    return x / max(float(np.sqrt(x @ x)), 1e-9)


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(1 | margin), by Newton steps with a slight pull to 0."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - y) * margin).sum() + 0.01 * a, (p - y).sum() + 0.01 * b])
        d = p * (1 - p) + 1e-9
        h = np.array([[(d * margin * margin).sum() + 0.01, (d * margin).sum()], [(d * margin).sum(), d.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, aside: np.ndarray) -> dict:
    """The model from feature places, labels 0/1, and a mask of the fold that only the curve is fitted on."""
    share = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        return {"scale": np.zeros(SIZE), "weight": np.zeros(SIZE + 1), "slope": 1.0, "shift": float(np.log((share + 1e-6) / (1 - share + 1e-6)))}
    counts = np.ones((2, SIZE))
    for at, label, out in zip(rows, y, aside, strict=True):
        if not out:
            counts[int(label), at] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = [_scaled(at, ratio) for at in rows]
    use = np.flatnonzero(~aside)
    part = y[use].mean()
    cost = np.where(y[use] == 1, 0.5 / part, 0.5 / (1 - part)) * 4.0
    w = descent([rows[i] for i in use], [values[i] for i in use], 2.0 * y[use] - 1, cost)
    probe = np.flatnonzero(aside) if len(set(y[aside].tolist())) == 2 else use
    slope, shift = _logistic(np.array([w[rows[i]] @ values[i] + w[SIZE] for i in probe]), y[probe])
    return {"scale": ratio, "weight": w, "slope": slope, "shift": shift}


def _margins(places: np.ndarray, first: np.ndarray, model: dict) -> np.ndarray:
    sums = np.zeros((2, len(places) + 1))
    r = model["scale"][places]
    np.cumsum(r * model["weight"][places], out=sums[0, 1:])
    np.cumsum(r * r, out=sums[1, 1:])
    dot, norm = sums[:, first[1:]] - sums[:, first[:-1]]
    return dot / np.maximum(np.sqrt(np.maximum(norm, 0)), 1e-9) + model["weight"][SIZE]


def _probability(data: np.ndarray, starts: np.ndarray, model: dict) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model["slope"] * _margins(*features(data, starts), model) + model["shift"], -30, 30)))


def fold(doc_id: str | Column = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model fitted on at most `sample` labelled documents outside fold 0."""
    usable = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y")).where("id is not null and y in (0, 1)").where(fold("id") != 0)
    chosen = usable.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", "y", (fold("id") == 4).alias("aside"), "text")  # at most `sample` small rows

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in blocks(batches):
            places, first = features(data, starts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([places[a:b].astype(np.int32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["id", "y", "aside", "places"])

    kind = dict(labels.dtypes)["doc_id"]
    # of rows that repeat an id, the least counts
    seen = rows.mapInArrow(described, f"id {kind}, y int, aside boolean, places binary").groupBy("id", "y", "aside").agg(F.min("places").alias("places"))

    def learnt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat([pd.DataFrame({"id": [], "y": [], "aside": [], "places": []}), *frames]).sort_values("id")
        m = fit([np.frombuffer(x, np.int32).astype(np.int64) for x in frame["places"]], frame["y"].to_numpy(float), frame["aside"].to_numpy(bool))
        yield pd.DataFrame({"scale": [m["scale"].astype(np.float32).tobytes()], "weight": [m["weight"].astype(np.float32).tobytes()], "slope": [m["slope"]], "shift": [m["shift"]]})

    row = seen.coalesce(1).mapInPandas(learnt, "scale binary, weight binary, slope double, shift double").first()  # bounded by `sample`
    return {"scale": np.frombuffer(row["scale"], np.float32).astype(float), "weight": np.frombuffer(row["weight"], np.float32).astype(float), "slope": row["slope"], "shift": row["shift"]}


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, sample))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_probability(data, starts, model.value))], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, whose score reaches the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in blocks(batches):
            yield batch.filter(pa.array(_probability(data, starts, model.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
