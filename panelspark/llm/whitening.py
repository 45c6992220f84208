"""Operator 13: whitening of embeddings by the leading components of their covariance, found by contour integration.

Spark makes the sums of each dimension, then the covariance of whole numbers centred by the rounded mean (products below
2^53 are exact, whatever the order of tasks), and last the projections. Between them stands a matrix of dimensions x dimensions only.

Its components come by contours (`components`): counts of the signs of pivots (Sylvester's inertia) place bounds in gaps of the
spectrum, about eight eigenvalues apart. For each interval, solves of the complex shifted covariance at 16 points of a circle through its
bounds, added up, project a block of vectors onto the interval's space; Rayleigh-Ritz in that block gives the components, and the
step is repeated until they stand still to rounding. The count within the bounds must be the inertia's, so that none is missed.

Bounds: dimensions x dimensions doubles in the driver and in each task, so some thousands of dimensions at most.

Defined results: vectors that are null or hold a null or non-finite entry are dropped, as are those with an entry of 2^50 or
more, which has no exact x, and those of another length than most vectors have (of equals, the longer); repeated rows and ids count each; fewer
components than 32 come where there are fewer with an eigenvalue above 1e-12 of the greatest (none for one vector, or for equal vectors: no
rows); deviation is null where it exceeds a long; the sign of a component makes its largest entry positive; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHIFT, SCALE, MOST, NODES, APART = 1_000_000, 64, 32, 16, 8
#: Eigenvalues under this share of the greatest count as rounding.
FLOOR = 1e-12


def _usable(rows: DataFrame, vector: str) -> DataFrame:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(1 << 50)))
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)


def _whole(batch: pa.RecordBatch, vector: str, dims: int) -> np.ndarray:
    """floor(64 c), a row a vector: x without its shift."""
    flat = batch.column(batch.schema.get_field_index(vector)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, dims)


def _sums(rows: DataFrame, vector: str) -> tuple[int, list[int]]:
    """How many vectors of the commonest length, and each dimension's exact sum of x without shift."""
    lengths = rows.groupBy(F.size(vector).alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if lengths is None:
        return 0, []

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _whole(batch, vector, lengths.dims)
                # halves of 32 bits, so that no sum of a batch overflows
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lengths.dims), pa.int32()), pa.array((x >> 32).sum(0)), pa.array((x & 0xFFFFFFFF).sum(0))], ["i", "high", "low"])

    sums = rows.where(F.size(vector) == lengths.dims).select(vector).mapInArrow(partial, "i int, high bigint, low bigint").groupBy("i").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    found = {r.i: (int(r.high) << 32) + int(r.low) for r in sums.collect()}
    return lengths.n, [found[i] for i in range(lengths.dims)]


def _gram(rows: DataFrame, vector: str, projected) -> np.ndarray:
    """Sum over the rows of the products of all pairs of the columns that `projected` makes of a batch."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = projected(batch)
                total = y.T @ y + (0 if total is None else total)
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])

    found = rows.select(vector).mapInArrow(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    size = int(found["i"].max()) + 1
    out = np.zeros((size, size))
    out[found["i"], found["j"]] = found["s"]
    return out


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of v, by reflections."""
    t = v.copy()
    for k in range(len(t) - 2):
        x = t[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += np.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        t[k + 1 :] -= 2 * np.outer(x, x @ t[k + 1 :])
        t[:, k + 1 :] -= 2 * np.outer(t[:, k + 1 :] @ x, x)
    return np.diag(t).copy(), np.diag(t, -1).copy()


def inertia(diagonal: np.ndarray, beside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie above each of `at`: the positive pivots of the shifted matrix."""
    scale = np.abs(diagonal).max() + np.abs(beside).max(initial=0) + np.finfo(float).tiny
    above, pivot = np.zeros(len(at), np.int64), np.ones(len(at))
    for i, d in enumerate(diagonal):
        pivot = d - at - (beside[i - 1] ** 2 / pivot if i else 0)
        pivot = np.where(np.abs(pivot) < 1e-300 + scale * 1e-20, -scale * 1e-20, pivot)
        above += pivot > 0
    return above


def _eigenvalues(diagonal: np.ndarray, beside: np.ndarray, most: int, top: float) -> np.ndarray:
    """The `most` greatest eigenvalues, roughly: bisection by inertia, all at a time."""
    low, high = np.full(most, -1e-6 * top - 1e-300), np.full(most, 1.001 * top)
    for _ in range(40):
        middle = (low + high) / 2
        reached = inertia(diagonal, beside, middle) > np.arange(most)
        low, high = np.where(reached, middle, low), np.where(reached, high, middle)
    return (low + high) / 2


def _projected(v: np.ndarray, low: float, high: float, block: np.ndarray) -> np.ndarray:
    """The block's part in the eigenvectors between low and high: the contour integral of the resolvent by NODES points."""
    middle, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(block)
    for theta in np.pi * (np.arange(NODES) + 0.5) / NODES:  # the lower half of the circle gives the conjugates
        turn = radius * np.exp(1j * theta)
        out += (turn * np.linalg.solve((middle + turn) * np.eye(len(v)) - v, block)).real / NODES
    return out


def _within(v: np.ndarray, low: float, high: float, count: int, top: float) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenpairs between low and high."""
    block = np.random.default_rng(13).standard_normal((len(v), min(len(v), count + count // 2 + 6)))
    last, found = np.inf, None
    for _ in range(40):
        basis, _ = np.linalg.qr(_projected(v, low, high, block))
        values, turn = np.linalg.eigh(basis.T @ v @ basis)
        block = basis @ turn
        inside = (values > low) & (values < high)
        residual = np.linalg.norm(v @ block - block * values, axis=0)
        good = inside & (residual <= 1e-9 * top)  # a stray value of the block is no eigenvalue
        if good.sum() == count:
            found, worst = (values[good], block[:, good]), residual[good].max()
            if worst <= 1e-14 * top * len(v) ** 0.5 or worst >= last / 2:
                return found
            last = worst
    if found is None:
        raise ArithmeticError(f"the contour from {low} to {high} does not give the {count} eigenvalues that inertia counts")
    return found


def components(v: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of a covariance above rounding, falling, and unit eigenvectors as columns."""
    top = float(np.abs(v).sum(1).max()) if len(v) else 0.0
    if top == 0:
        return np.zeros(0), np.zeros((len(v), 0))
    tri = tridiagonal(v)
    rough = _eigenvalues(*tri, min(len(v), most + APART), top)
    floor = FLOOR * rough[0]
    wanted = min(most, int(inertia(*tri, np.array([floor]))[0]))
    rough = rough[: max(wanted, min(len(rough), int((rough > floor).sum())))]
    all_of_them = wanted == len(rough) and wanted < most or len(rough) == len(v)
    # bounds in the widest gap of each stretch; the last one lies below all that are wanted
    gaps = np.append(rough[:-1] - rough[1:], rough[-1] if all_of_them else 0)
    ends, at = [], 0
    while at < wanted:
        stretch = np.arange(at + APART // 2, min(at + APART, len(rough))) if at + APART // 2 < len(rough) else np.arange(len(rough) - 1, len(rough))
        stretch = stretch[stretch >= at]
        best = int(stretch[np.argmax(gaps[stretch])])
        while best + 1 < len(rough) and gaps[best] <= 1e-7 * rough[0]:
            best += 1  # a cluster stays together
        ends.append(best)
        at = best + 1
    high = rough[0] + 0.01 * rough[0]
    above, values, vectors = 0, [], []
    for end in ends:
        low = (rough[end] + rough[end + 1]) / 2 if end + 1 < len(rough) else (max(rough[end] / 2, floor) if all_of_them else rough[end] - 0.01 * rough[0])
        count = int(inertia(*tri, np.array([low]))[0])
        if count > above:
            found = _within(v, low, high, count - above, top)
            values.append(found[0])
            vectors.append(found[1])
        above, high = count, low
    # one Rayleigh-Ritz step over all intervals makes the components orthogonal to rounding
    basis, _ = np.linalg.qr(np.concatenate(vectors, axis=1))
    values, turn = np.linalg.eigh(basis.T @ v @ basis)
    order = np.argsort(-values, kind="stable")[:wanted]
    vectors = (basis @ turn)[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
    return values[order], vectors * sign


def whitened(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = MOST) -> DataFrame:
    """A row for each usable vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    schema = T.StructType([rows.schema[key], *T._parse_datatype_string("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double").fields])
    usable = _usable(rows.select(key, vector), vector)
    n, sums = _sums(usable, vector)
    dims = len(sums)
    usable = usable.where(F.size(vector) == dims)
    whole, rest = [s // n for s in sums] if n else [], [s % n for s in sums] if n else []
    centre, over = np.array(whole, np.int64), np.array(rest, np.int64)

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        return (_whole(batch, vector, dims) - centre).astype(float)

    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    share = over / n
    v = _gram(usable, vector, centred) / n - np.outer(share, share)  # what the rounded mean leaves: below one each
    values, vectors = components(v, most)
    scaled = vectors / np.sqrt(values)
    k = len(values)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    trace = float(np.trace(v))

    def projections(batch: pa.RecordBatch) -> np.ndarray:
        return (centred(batch) - share) @ scaled  # their mean is 0

    error = float(np.abs(_gram(usable, vector, projections) / n - np.eye(k)).max())

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 4096):
                batch = whole_batch.slice(at, 4096)
                m = batch.num_rows
                y = _whole(batch, vector, dims) - centre
                about = ((y.astype(float) * n - over) ** 2).sum(1)
                deviation = pa.array([None] * m, pa.int64())
                if (about < 2.0**62).all():
                    deviation = pa.array(((y * n - over) ** 2).sum(1))
                else:  # whole numbers of any size
                    exact = [sum((int(a) * n - b) ** 2 for a, b in zip(r, rest)) if s < 2.0**64 else 1 << 64 for r, s in zip(y, about)]
                    deviation = pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())
                row = pa.array(np.repeat(np.arange(m), k))
                columns = [batch.column(batch.schema.get_field_index(key)).take(row), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n)), deviation.take(row), pa.array(projections(batch).ravel()), pa.array(np.tile(values / trace, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return usable.mapInArrow(out, schema)
