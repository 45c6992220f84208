"""Boosted regression trees by histograms: all fits of a table in one plan (ML3-ML5).

A fit is a training window of one anchor and horizon. Candidate thresholds are approximate quantiles of the window; a null
feature is a bin of its own, tried on both sides of each split. A tree is grown level by level to its depth, each level from
sums of gradients and weights by (node, feature, bin); of the splits so found those that leaf-wise growth would make, best
gain first, stay until the tree has its leaves. Leaves shrink by L2. Rows of the late fold are not trained on; their loss after each
round is kept in the model table, and `best_rounds` takes the least, with patience.

A fit is held by one task where its rows fit there: they become codes of a byte a feature where they are read (two from 255 bins
on), an eighth of a row of doubles, so that a task holds 8 times `at_most` rows, and the fits grow beside each other, one a partition, the
largest first. A tree's histograms are summed over the smaller of two children only, two features at once where rows are many; the
other child is the rest of its parent. A row's leaf comes from tables of its codes (`_tables`). A larger fit stays spread over its
partitions: each level is a Spark aggregation of partial histograms, the best split of a node is found in a group of bounded size
(features x bins), and only splits reach the driver. Both give the same trees up to the order of sums; margins of spread fits are
written anew every REWRITE rounds, so that neither lineage nor the trees to apply grow.

The model table has a row for each fit and round: its tree as nodes with thresholds of the features' own scale, so that a later anchor
can start from it (`before`): its trees are taken over as they stand, and their sum is the new fit's base.

Defined results: rows without label or weight count nothing; a fit without rows has no model; without early or without late rows
all rows train and the last round is the best; equal gains go to the lower feature, then nulls right, then the lower threshold; a row's share in
a round is drawn from its key and the round, so that repeated rows are drawn alike; constant or all-null features never split.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NODE = "struct<feature:int,threshold:double,nulls_left:boolean,left:int,right:int,value:double>"
MODEL = f"dt date, horizon string, round int, late_loss double, rows bigint, tree array<{NODE}>"
FIT = ["dt", "horizon"]
REWRITE = 20
BLOCK = 1 << 16


@dataclass(frozen=True)
class Settings:
    rounds: int = 300
    leaves: int = 31
    depth: int = 6
    rate: float = 0.05
    least_leaf: int = 200
    row_share: float = 0.7
    feature_share: float = 0.7
    l2: float = 1.0
    patience: int = 100
    bins: int = 64
    seed: int = 42
    at_most: int = 2_000_000


def thresholds(rows: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """dt, horizon and for each feature its candidate thresholds: distinct values at quantiles of the fit's rows."""
    at = [k / bins for k in range(bins)]
    of = lambda c: F.coalesce(F.array_sort(F.array_distinct(F.percentile_approx(c, at, 20 * bins))), F.array().cast("array<double>"))
    return rows.groupBy(*FIT).agg(F.count("*").alias("rows"), F.array(*[F.struct(of(c).alias("at")) for c in columns]).alias("edges"))


def binned(x: np.ndarray, edges: Sequence[np.ndarray], bins: int, kind: type = np.int16) -> np.ndarray:
    """Bin b of a value: it exceeds b thresholds; nulls are in the last bin."""
    out = np.empty(x.shape, kind)
    for f, e in enumerate(edges):
        out[:, f] = np.searchsorted(e, x[:, f], "left")
    out[np.isnan(x)] = bins + 1
    return out


def _drawn(key: np.ndarray, at: int, s: Settings) -> np.ndarray:
    """The rows of a round, by a hash of key and round (public splitmix64 constants)."""
    if s.row_share >= 1:
        return np.ones(len(key), bool)
    x = key.view(np.uint64) + np.uint64((at + s.seed) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return (x ^ (x >> np.uint64(31))) < np.uint64(int(s.row_share * 2.0**64))


def _features(n: int, at: int, s: Settings) -> np.ndarray:
    return np.sort(np.random.default_rng([s.seed, at]).permutation(n)[: max(1, round(s.feature_share * n))])


def best_splits(g: np.ndarray, h: np.ndarray, n: np.ndarray, features: np.ndarray, s: Settings) -> np.ndarray:
    """For each node of histograms (node, feature, bin): gain, feature, bin, nulls left, and sums of node and left side.

    Columns: gain (0: none), feature, bin, nulls_left, g, h, n, left g, left h, left n.
    """
    total = [x[:, features[0]].sum(-1) for x in (g, h, n)]
    score = lambda a, b: a * a / (b + s.l2)
    out = np.zeros((len(g), 10))
    out[:, 4], out[:, 5], out[:, 6] = total
    sides = [x[:, features, :-1].cumsum(-1) for x in (g, h, n)]
    both = np.stack([np.stack([a, a + x[:, features, -1:]], 2) for a, x in zip(sides, (g, h, n))])  # sums, node, feature, nulls left, bin
    left = both
    right = np.stack(total)[:, :, None, None, None] - left
    gain = score(left[0], left[1]) + score(right[0], right[1]) - score(total[0], total[1])[:, None, None, None]
    gain[(left[2] < s.least_leaf - 0.5) | (right[2] < s.least_leaf - 0.5) | (left[1] <= 1e-12) | (right[1] <= 1e-12)] = 0
    gain = np.where(gain > 1e-12 * (1 + np.abs(score(total[0], total[1]))[:, None, None, None]), gain, 0).reshape(len(g), -1)
    # gains that differ by rounding only are equal: the first of them counts
    at = (gain >= gain.max(1, keepdims=True) * (1 - 1e-10)).argmax(1)
    f, nulls, b = np.unravel_index(at, (len(features), 2, left.shape[-1]))
    rows = np.arange(len(g))
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = gain[rows, at], features[f], b, nulls
    for i in range(3):
        out[:, 7 + i] = left[i, rows, f, nulls, b]
    return out


class Tree:
    """A tree in growth: nodes in order of their making; `open` are those whose histograms come next."""

    def __init__(self, s: Settings):
        self.s, self.open, self.depth = s, [0], 0
        self.splits: dict[int, np.ndarray] = {}
        self.left: dict[int, int] = {}
        self.sums: dict[int, tuple[float, float]] = {}
        self.size = 1

    def add(self, found: np.ndarray) -> None:
        """`found`: the best splits of the open nodes; their children are open next."""
        after = []
        for node, split in zip(self.open, found):
            if node == 0:
                self.sums[0] = (split[4], split[5])
            if split[0] > 0:
                self.splits[node], self.left[node] = split, self.size
                self.sums[self.size] = (split[7], split[8])
                self.sums[self.size + 1] = (split[4] - split[7], split[5] - split[8])
                after += [self.size, self.size + 1]
                self.size += 2
        self.depth += 1
        self.open = after if self.depth < self.s.depth else []

    def routed(self, bins: np.ndarray, node: np.ndarray, levels: int = 1) -> np.ndarray:
        """The rows' nodes after further `levels`."""
        table = np.full((self.size, 4), -1, np.int64)
        for k, x in self.splits.items():
            table[k] = int(x[1]), int(x[2]), int(x[3]), self.left[k]
        for _ in range(levels):
            feature, bin_, nulls, left = table[node].T
            inner = feature >= 0
            value = bins[np.arange(len(bins)), np.where(inner, feature, 0)]
            right = np.where(value == self.s.bins + 1, nulls == 0, value > bin_)
            node = np.where(inner, left + right, node)
        return node

    def nodes(self, edges: Sequence[np.ndarray]) -> list[tuple]:
        """(feature, threshold, nulls left, left, right, value) of the tree of at most `leaves` leaves, best gains first."""
        import heapq

        ready, inner = [(-self.splits[0][0], 0)] if 0 in self.splits else [], set()
        while ready and len(inner) < self.s.leaves - 1:
            _, k = heapq.heappop(ready)
            inner.add(k)
            for child in (self.left[k], self.left[k] + 1):
                if child in self.splits:
                    heapq.heappush(ready, (-self.splits[child][0], child))
        out, at = [], [0]
        place = {0: 0}
        while len(out) < len(at):
            k = at[len(out)]
            g, h = self.sums[k]
            value = float(-g / (h + self.s.l2) * self.s.rate) if h + self.s.l2 > 0 else 0.0
            if k in inner:
                f, b, nulls = (int(v) for v in self.splits[k][1:4])
                for child in (self.left[k], self.left[k] + 1):
                    place[child] = len(at)
                    at.append(child)
                # past the last threshold only nulls go right
                out.append((f, float(edges[f][b]) if b < len(edges[f]) else float("inf"), bool(nulls), place[self.left[k]], place[self.left[k] + 1], value))
            else:
                out.append((-1, None, None, None, None, value))
        return out


def _tables(nodes: Sequence[tuple], grids: Sequence[np.ndarray], null: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """For each feature of a tree a table from code to the leaves that its splits leave open, as bits; and the leaves' values from left to right.

    A split to the right closes the leaves on its left, whatever the way to it: of the leaves that stay open in all tables the
    first is the row's.
    """
    values, closes = [], []

    def under(k: int) -> int:
        feature, threshold, nulls, left, right, value = nodes[k]
        if feature < 0:
            values.append(value)
            return 1 << len(values) - 1
        leaves = under(left)
        closes.append((feature, int(np.searchsorted(grids[feature], threshold)), nulls, leaves))
        return leaves | under(right)

    every = under(0)
    kind = np.uint32 if len(values) <= 32 else np.uint64 if len(values) <= 64 else object
    tables: dict[int, np.ndarray] = {}
    for feature, at, nulls, leaves in closes:
        table = tables.setdefault(feature, np.full(null + 1, every, kind))
        rest = every & ~leaves if kind is object else kind(every & ~leaves)
        table[at + 1 : null] &= rest
        if not nulls:
            table[null] &= rest
    return tables, np.array(values, float)


def _first_leaf(leaves: np.ndarray) -> np.ndarray:
    """Number of the lowest bit that is set."""
    if leaves.dtype == object:
        return np.array([(n & -n).bit_length() - 1 for n in leaves], np.intp)
    low = leaves & (~leaves + leaves.dtype.type(1))
    return (low.astype(np.float32).view(np.int32) >> 23) - 127 if leaves.dtype == np.uint32 else (low.astype(np.float64).view(np.int64) >> 52) - 1023


def _valued(tables: dict[int, np.ndarray], values: np.ndarray, codes: Sequence[np.ndarray], joint: dict[tuple[int, int], np.ndarray] | None = None) -> np.ndarray:
    """A tree's value for each row of `codes` (an array a feature); `joint` has the codes of two features as one number."""
    n = len(codes[0])
    if not tables:
        return np.full(n, values[0])
    looked, left = [], dict(tables)
    for (a, b), code in (joint or {}).items():
        if a in left and b in left:
            looked.append(((left.pop(a)[:, None] & left.pop(b)[None, :]).ravel(), code))
    looked += [(table, codes[f]) for f, table in left.items()]
    out = np.empty(n)
    for at in range(0, n, BLOCK):
        leaves = None
        for table, code in looked:
            found = table.take(code[at : at + BLOCK], mode="clip")
            leaves = found if leaves is None else np.bitwise_and(leaves, found, out=leaves)
        out[at : at + BLOCK] = values.take(_first_leaf(leaves), mode="clip")
    return out


class Forest:
    """Trees made ready for many rows: thresholds of all trees are one grid a feature, and rows become codes by it."""

    def __init__(self, trees: Sequence[Sequence], columns: int):
        found: list[set] = [set() for _ in range(columns)]
        for tree in trees:
            for feature, threshold, *_ in tree:
                if feature >= 0 and threshold < np.inf:
                    found[feature].add(threshold)
        self.grids = [np.array(sorted(f), float) for f in found]
        self.null = max((len(g) for g in self.grids), default=0) + 1
        self.trees = [_tables(tree, self.grids, self.null) for tree in trees]

    def applied(self, x: np.ndarray) -> np.ndarray:
        codes = np.ascontiguousarray(binned(x, self.grids, self.null - 1, np.min_scalar_type(self.null)).T)
        total = np.zeros(len(x))
        for tables, values in self.trees:
            total += _valued(tables, values, codes)
        return total


def applied(trees: Sequence[Sequence], x: np.ndarray) -> np.ndarray:
    """Sum of the trees' values for rows of features (nulls are NaN)."""
    return Forest(trees, x.shape[1]).applied(x)


def _histograms(bins: np.ndarray, group: np.ndarray, groups: int, g: np.ndarray, w: np.ndarray, s: Settings) -> np.ndarray:
    """Sums of g and w and numbers of rows by (group, feature, bin)."""
    n, columns, width = len(bins), bins.shape[1], s.bins + 2
    at = ((group[:, None] * columns + np.arange(columns)) * width + bins).ravel()
    size = groups * columns * width
    many = lambda v: np.bincount(at, None if v is None else np.repeat(v, columns), size).reshape(groups, columns, width)
    return np.stack([many(g), many(w), many(None)]) if n else np.zeros((3, groups, columns, width))


def _joint(codes: Sequence[np.ndarray], features: np.ndarray, width: int) -> dict[tuple[int, int], np.ndarray]:
    """The codes of two features each as one number."""
    kind = np.min_scalar_type(width * width - 1)
    return {(int(a), int(b)): codes[a].astype(kind) * kind.type(width) + codes[b] for a, b in zip(features[::2], features[1::2])}


def _sums(codes: Sequence[np.ndarray], features: np.ndarray, joint: dict[tuple[int, int], np.ndarray], rows: np.ndarray, g: np.ndarray, w: np.ndarray, s: Settings) -> np.ndarray:
    """Sums of g and w and numbers of some rows by (feature, bin); two features at once where their cells are fewer than the rows."""
    width = s.bins + 2
    out, weights, left = np.zeros((3, len(codes), width)), (g.take(rows), w.take(rows), None), [int(f) for f in features]
    if len(rows) > width * width:
        for (a, b), code in joint.items():
            at = code.take(rows).astype(np.intp)
            for k, v in enumerate(weights):
                cells = np.bincount(at, v, width * width).reshape(width, width)
                out[k, a], out[k, b] = cells.sum(1), cells.sum(0)
            left.remove(a), left.remove(b)
    for f in left:
        at = codes[f].take(rows).astype(np.intp)
        for k, v in enumerate(weights):
            out[k, f] = np.bincount(at, v, width)
    return out


def _tree(codes: Sequence[np.ndarray], features: np.ndarray, joint: dict[tuple[int, int], np.ndarray], use: np.ndarray, g: np.ndarray, w: np.ndarray, s: Settings) -> Tree:
    """A tree of the rows `use`. Of two children the smaller is summed, the other is the rest of their parent."""
    tree, rows, sums = Tree(s), {0: use}, {0: _sums(codes, features, joint, use, g, w, s)}
    while tree.open:
        parents = tree.open
        tree.add(best_splits(*np.stack([sums[k] for k in parents], 1), features, s))
        for k in parents:
            own, whole = rows.pop(k), sums.pop(k)
            if k not in tree.splits or not tree.open:
                continue
            feature, bin_, nulls = (int(v) for v in tree.splits[k][1:4])
            value = codes[feature].take(own)
            goes = value <= bin_
            if nulls:
                goes |= value == s.bins + 1
            sides = own.compress(goes), own.compress(~goes)
            small = int(len(sides[1]) < len(sides[0]))
            part = _sums(codes, features, joint, sides[small], g, w, s)
            rest = whole - part
            rest[:, rest[2] == 0] = 0
            at = tree.left[k]
            rows[at], rows[at + 1] = sides
            sums[at + small], sums[at + 1 - small] = part, rest
    return tree


def _code_type(s: Settings) -> type:
    return np.min_scalar_type(s.bins + 1).type


def grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, late: np.ndarray, key: np.ndarray, edges: Sequence[np.ndarray], s: Settings, before: Sequence = ()) -> Iterator[tuple[int, float | None, list]]:
    """round, loss of the late fold after it, tree: the trees of one fit whose rows are at hand; `before`'s trees come first."""
    yield from ((k, None, t) for k, t in enumerate(before))
    codes = np.ascontiguousarray(binned(x, edges, s.bins, _code_type(s)).T)
    yield from _rounds(codes, y, w, late, key, edges, s, applied(before, x) if before else None, len(before))


def _rounds(codes: np.ndarray, y: np.ndarray, w: np.ndarray, late: np.ndarray, key: np.ndarray, edges: Sequence[np.ndarray], s: Settings, margin: np.ndarray | None, start: int) -> Iterator[tuple[int, float | None, list]]:
    """The rounds of one fit from `start` on, of rows as codes (an array a feature); without a `margin` the mean comes first."""
    late = late if late.any() and not late.all() else np.zeros(len(y), bool)
    train, width = ~late, s.bins + 2
    if margin is None:
        mean = float((w[train] * y[train]).sum() / w[train].sum())
        yield 0, None, [(-1, None, None, None, None, mean)]
        margin, start = np.full(len(y), mean), 1
    best = (np.inf, start)
    for at in range(start, start + s.rounds):
        use = np.flatnonzero(train & _drawn(key, at, s))
        features = _features(len(codes), at, s)
        joint = _joint(codes, features, width) if len(use) > width * width else {}
        nodes = _tree(codes, features, joint, use, w * (margin - y), w, s).nodes(edges)
        margin = margin + _valued(*_tables(nodes, edges, s.bins + 1), codes, joint)
        loss = _loss(y, margin, w, late)
        yield at, loss, nodes
        if loss is not None:
            best = min(best, (loss, at))
            if at - best[1] >= s.patience:
                return


def _loss(y: np.ndarray, margin: np.ndarray, w: np.ndarray, late: np.ndarray) -> float | None:
    return float((w[late] * (y[late] - margin[late]) ** 2).sum() / w[late].sum()) if late.any() else None


def _edges(found) -> list[np.ndarray]:
    return [np.asarray(e["at"], float) for e in found]


def _as_nodes(kept) -> list[tuple]:
    """Nodes as `Tree.nodes` gives them: leaves come back with nulls or NaN, and their numbers as doubles."""
    rows = [tuple(n.values()) if isinstance(n, dict) else tuple(n) for n in kept["tree"]]
    return [(int(f), t, bool(nulls), int(left), int(right), v) if f >= 0 else (-1, None, None, None, None, v) for f, t, nulls, left, right, v in rows]


def fitted(rows: DataFrame, columns: Sequence[str], path: str, s: Settings | None = None, before: DataFrame | None = None) -> DataFrame:
    """The model table of all fits of `rows` (dt, horizon, key, the features, y, w, late), written under `path` and read back.

    `before`: horizon and trees that every fit of the horizon starts from.
    """
    s = s or Settings()
    rows = rows.where("y is not null and w > 0")
    setup = thresholds(rows, columns, s.bins)
    if before is not None:
        setup = setup.join(before.select("horizon", F.col("trees").alias("before")), "horizon", "left")
    else:
        setup = setup.withColumn("before", F.lit(None).cast(f"array<struct<round:int,tree:array<{NODE}>>>"))
    setup.write.parquet(f"{path}/setup")
    setup = rows.sparkSession.read.parquet(f"{path}/setup")
    room = s.at_most * 8 // np.dtype(_code_type(s)).itemsize
    small, large = setup.where(F.col("rows") <= room), setup.where(F.col("rows") > room)
    old = small.select(*FIT, F.posexplode("before").alias("round", "_t"), "rows").select(*FIT, "round", F.lit(None).cast("double").alias("late_loss"), "rows", "_t.tree")
    old.unionByName(_held(rows, columns, small, before, s)).write.parquet(f"{path}/model")
    if large.limit(1).count():
        _spread(rows.join(F.broadcast(large.select(*FIT)), FIT, "left_semi"), columns, large, path, s).write.mode("append").parquet(f"{path}/model")
    return rows.sparkSession.read.schema(MODEL).parquet(f"{path}/model")


def _slots(rows: DataFrame, n: int) -> list[int]:
    """For each of n partitions a number that `repartition` deals to it."""
    found: dict[int, int] = {}
    wide = 16 * n + 64
    while len(found) < n:
        numbers = rows.sparkSession.range(wide).select(F.col("id").cast("int").alias("v"))
        found = {r.p: r.v for r in numbers.select("v", F.pmod(F.hash("v"), F.lit(n)).alias("p")).collect()}
        wide *= 2
    return [found[k] for k in range(n)]


def _held(rows: DataFrame, columns: Sequence[str], setup: DataFrame, before: DataFrame | None, s: Settings) -> DataFrame:
    """The new rounds of fits that a task each can hold: rows become codes where they are read, some 50 bytes a row, and then meet.

    Margins of older trees are worked out there too, by all tasks. The driver holds the fits' thresholds and older trees, no rows.
    The largest fits begin first.
    """
    spark, names, kind = rows.sparkSession, list(columns), _code_type(s)
    fits = setup.select(*FIT, "rows", "edges").orderBy(F.desc("rows"), *FIT).collect()
    if not fits:
        return spark.createDataFrame([], MODEL)
    edges, slots = [_edges(f.edges) for f in fits], _slots(rows, len(fits))
    olds = {} if before is None else {r["horizon"]: [_as_nodes(t) for t in r["trees"]] for r in before.select("horizon", "trees").toArrow().to_pylist()}
    starts = [olds.get(f.horizon, []) for f in fits]
    counts = [len(o) for o in starts]
    numbered = spark.createDataFrame([(f.dt, f.horizon, i, slots[i]) for i, f in enumerate(fits)], "dt date, horizon string, fit int, slot int")
    whole = {"slot": pa.int32(), "fit": pa.int32(), "key": pa.int64(), "y": pa.float64(), "w": pa.float64(), "late": pa.bool_(), "margin": pa.float64(), "codes": pa.binary()}

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests: dict[int, Forest] = {}
        for batch in batches:
            fit = batch.column("fit").to_numpy()
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], 1) if batch.num_rows else np.zeros((0, len(names)))
            codes, margin = np.empty(x.shape, kind), np.zeros(len(x))
            for i in np.unique(fit):
                own = fit == i
                codes[own] = binned(x[own], edges[i], s.bins, kind)
                if starts[i]:
                    if i not in forests:
                        forests[i] = Forest(starts[i], len(names))
                    margin[own] = forests[i].applied(x[own])
            step = codes.shape[1] * codes.itemsize
            at = pa.py_buffer(np.arange(0, (len(x) + 1) * step, step, dtype=np.int32)[: len(x) + 1])
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, at, pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("slot", "fit", "key", "y", "w", "late")], pa.array(margin), packed], list(whole))

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, list[dict[str, np.ndarray]]] = {}
        for batch in batches:
            fit = batch.column("fit").to_numpy()
            own = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "y", "w", "late", "margin")}
            packed = batch.column("codes")
            first = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset] if batch.num_rows else 0
            own["codes"] = np.frombuffer(packed.buffers()[2] or b"", kind, batch.num_rows * len(names), int(first)).reshape(-1, len(names))
            for i in np.unique(fit):
                met.setdefault(int(i), []).append({c: v[fit == i] for c, v in own.items()})
        for i in sorted(met):
            parts = met.pop(i)
            key, y = (np.concatenate([p[c] for p in parts]) for c in ("key", "y"))
            order = np.lexsort((y, key))  # sums in one order, whatever the shuffle's
            w, late, margin = (np.concatenate([p[c] for p in parts])[order] for c in ("w", "late", "margin"))
            codes = np.empty((len(names), len(y)), kind)
            for f in range(len(names)):
                codes[f] = np.concatenate([p["codes"][:, f] for p in parts])[order]
            del parts
            for at, loss, tree in _rounds(codes, y[order], w, late, key[order], edges[i], s, margin if counts[i] else None, counts[i]):
                yield pa.RecordBatch.from_pylist([{"fit": i, "round": at, "late_loss": loss, "tree": [dict(zip(("feature", "threshold", "nulls_left", "left", "right", "value"), n)) for n in tree]}], arrow)

    arrow = pa.schema([("fit", pa.int32()), ("round", pa.int32()), ("late_loss", pa.float64()), ("tree", pa.list_(pa.struct([("feature", pa.int32()), ("threshold", pa.float64()), ("nulls_left", pa.bool_()), ("left", pa.int32()), ("right", pa.int32()), ("value", pa.float64())])))])
    own = rows.join(F.broadcast(numbered), FIT).select("slot", "fit", "key", *names, "y", "w", "late")
    packed = own.mapInArrow(coded, "slot int, fit int, key bigint, y double, w double, late boolean, margin double, codes binary")
    found = packed.repartition(len(fits), "slot").mapInArrow(trained, f"fit int, round int, late_loss double, tree array<{NODE}>")
    told = spark.createDataFrame([(i, f.dt, f.horizon, f.rows) for i, f in enumerate(fits)], "fit int, dt date, horizon string, rows bigint")
    return found.join(F.broadcast(told), "fit").select(*FIT, "round", "late_loss", "rows", "tree")


def _spread(rows: DataFrame, columns: Sequence[str], setup: DataFrame, path: str, s: Settings) -> DataFrame:
    """The same for fits whose rows stay in their partitions; the driver holds the fits' thresholds and trees, no rows."""
    spark = rows.sparkSession
    given = {(r.dt, r.horizon): (_edges(r.edges), [] if r.before is None else [_as_nodes(t) for t in r.before], r.rows) for r in setup.collect()}
    fits = sorted(given)
    index = {f: i for i, f in enumerate(fits)}
    edges = [given[f][0] for f in fits]
    number = F.create_map(*[F.lit(v) for (dt, horizon), i in index.items() for v in (f"{dt} {horizon}", i)])[F.concat_ws(" ", F.col("dt").cast("string"), "horizon")]
    names = list(columns)

    def written(table: DataFrame) -> DataFrame:
        to = f"{path}/margins-{uuid.uuid4().hex}"
        table.write.parquet(to)
        return spark.read.schema(table.schema).parquet(to)

    def numbers(batch: pa.RecordBatch, which: Sequence[str]) -> list[np.ndarray]:
        return [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in which]

    def features_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([c.astype(float) for c in numbers(batch, names)], 1) if batch.num_rows else np.zeros((0, len(names)))

    def margins(batch: pa.RecordBatch, trees: list[list]) -> np.ndarray:
        fit, margin = numbers(batch, ["fit", "margin"])
        x, out = features_of(batch), margin.copy()
        for i in np.unique(fit):
            own = fit == i
            out[own] += applied(trees[i], x[own])
        return out

    sides = rows.groupBy(*FIT).agg(F.count_if("late").alias("late"), F.count_if(~F.col("late")).alias("early"))
    split = F.col("sides.late").isNotNull() & (F.col("sides.late") > 0) & (F.col("sides.early") > 0)
    told = rows.join(F.broadcast(sides.select(*FIT, F.struct("late", "early").alias("sides"))), FIT)
    table = written(told.select(number.alias("fit"), "key", *columns, "y", "w", (F.col("late") & split).alias("late"), F.lit(0.0).alias("margin")))
    means = {r.fit: r.mean for r in table.where("not late").groupBy("fit").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("mean")).collect()}
    trees = [list(given[f][1]) or [[(-1, None, None, None, None, means[i])]] for i, f in enumerate(fits)]
    out = [(*f, k, None, given[f][2], t) for i, f in enumerate(fits) for k, t in enumerate(trees[i])]
    starts, pending, live, best = [len(t) for t in trees], [list(t) for t in trees], set(range(len(fits))), {}

    def losses(parts: list[list], of: DataFrame) -> dict[int, float]:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fit, y, w = numbers(batch, ["fit", "y", "w"])
                yield pa.RecordBatch.from_arrays([pa.array(fit, pa.int32()), pa.array(w * (y - margins(batch, parts)) ** 2), pa.array(w)], ["fit", "s", "w"])

        found = of.where("late").mapInArrow(partial, "fit int, s double, w double").groupBy("fit").agg((F.sum("s") / F.sum("w")).alias("loss"))
        return {r.fit: r.loss for r in found.collect()}

    for step in range(s.rounds):
        growing = {i: Tree(s) for i in live}
        while any(t.open for t in growing.values()):
            state, parts = {i: t for i, t in growing.items() if t.open}, [list(p) for p in pending]
            features_now = {i: _features(len(names), starts[i] + step, s) for i in state}

            def partial(batches: Iterator[pa.RecordBatch], state=state, parts=parts, step=step) -> Iterator[pa.RecordBatch]:
                sums: dict[int, np.ndarray] = {}
                for batch in batches:
                    fit, key, y, w, late = numbers(batch, ["fit", "key", "y", "w", "late"])
                    x, margin = features_of(batch), margins(batch, parts)
                    for i in np.unique(fit):
                        if i not in state:
                            continue
                        tree, own = state[i], np.flatnonzero((fit == i) & ~late.astype(bool) & _drawn(key.astype(np.int64), starts[i] + step, s))
                        bins = binned(x[own], edges[i], s.bins)
                        node = tree.routed(bins, np.zeros(len(own), np.int64), tree.depth)
                        place = np.full(tree.size, -1)
                        place[tree.open] = np.arange(len(tree.open))
                        here = place[node] >= 0
                        own, bins, node = own[here], bins[here], place[node[here]]
                        sums[i] = _histograms(bins, node, len(tree.open), w[own] * (margin[own] - y[own]), w[own], s) + sums.get(i, 0)
                for i, found in sums.items():
                    node, feature, bin_ = np.nonzero(found[2])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), i), pa.int32()), *[pa.array(v, pa.int32()) for v in (node, feature, bin_)], *[pa.array(v[node, feature, bin_]) for v in found]], ["fit", "node", "feature", "bin", "g", "h", "n"])

            def split(cells):
                i = int(cells["fit"].iloc[0])
                found = np.zeros((3, 1, len(names), s.bins + 2))
                for k, c in enumerate("ghn"):
                    found[k, 0, cells["feature"], cells["bin"]] = cells[c]
                best = best_splits(*found, features_now[i], s)
                return pd.DataFrame({"fit": [i], "node": [int(cells["node"].iloc[0])], "split": [best[0].tolist()]})

            cells = table.mapInArrow(partial, "fit int, node int, feature int, bin int, g double, h double, n double").groupBy("fit", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])
            found = {(r.fit, r.node): np.array(r.split) for r in cells.groupBy("fit", "node").applyInPandas(split, "fit int, node int, split array<double>").collect()}
            for i, tree in state.items():
                tree.add(np.array([found.get((i, k), np.zeros(10)) for k in range(len(tree.open))]))
        for i in live:
            nodes = growing[i].nodes(edges[i])
            trees[i].append(nodes)
            pending[i].append(nodes)
        after = losses(pending, table)
        for i in sorted(live):
            at = starts[i] + step
            out.append((*fits[i], at, after.get(i), given[fits[i]][2], trees[i][-1]))
            if i in after:
                best[i] = min(best.get(i, (np.inf, 0)), (after[i], at))
                if at - best[i][1] >= s.patience:
                    live = live - {i}
        if not live:
            break
        if step % REWRITE == REWRITE - 1:
            done = [list(p) for p in pending]

            def moved(batches: Iterator[pa.RecordBatch], done=done) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margins(batch, done)))

            table, pending = written(table.mapInArrow(moved, table.schema)), [[] for _ in fits]
    return spark.createDataFrame(out, MODEL)


def best_rounds(model: DataFrame, patience: int = 100) -> DataFrame:
    """dt, horizon, rounds (that were made), best_round, best_loss: the round of least loss before patience ran out (ML4).

    Patience runs out at the first round that many after the best so far; without a late fold the last round is the best. The
    base (the mean, or an older model) has no loss of its own: one tree at least is used.
    """
    so_far = W.partitionBy(*FIT).orderBy("round").rowsBetween(W.unboundedPreceding, 0)
    rank = F.when(F.col("late_loss").isNotNull(), F.struct("late_loss", "round"))
    seen = model.select("*", F.min(rank).over(so_far)["round"].alias("_best"))
    stopped = seen.withColumn("_over", F.max(F.coalesce(F.col("round") - F.col("_best") >= patience, F.lit(False)).cast("int")).over(W.partitionBy(*FIT).orderBy("round").rowsBetween(W.unboundedPreceding, -1)))
    used = stopped.where(F.coalesce("_over", F.lit(0)) == 0)
    least = F.min(F.when(F.col("late_loss").isNotNull(), F.struct("late_loss", "round")))
    return used.groupBy(*FIT).agg(F.max("rows").alias("rows"), F.max("round").alias("rounds"), F.coalesce(least["round"], F.max("round")).alias("best_round"), least["late_loss"].alias("best_loss"))


def best_trees(model: DataFrame, patience: int = 100) -> DataFrame:
    """dt, horizon and the trees up to the best round, in order, each with its round."""
    best = best_rounds(model, patience).select(*FIT, "best_round")
    used = model.join(best, FIT).where(F.col("round") <= F.col("best_round"))
    return used.groupBy(*FIT).agg(F.array_sort(F.collect_list(F.struct("round", "tree"))).alias("trees"))


def predicted(now: DataFrame, columns: Sequence[str], trees: DataFrame, rows_a_group: int = 50_000) -> DataFrame:
    """dt, permno, horizon, pred for the rows of `now` by the trees of their dt; a date's rows are dealt to groups of bounded size."""
    sizes = now.groupBy("dt").agg(F.ceil(F.count("*") / rows_a_group).cast("int").alias("parts"))
    dealt = now.join(sizes, "dt").withColumn("part", F.pmod(F.xxhash64("permno"), F.col("parts")).cast("int")).drop("parts")
    copies = trees.join(sizes, "dt").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def one(rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or models.empty:
            return pd.DataFrame([], columns=["dt", "permno", "horizon", "pred"])
        x = rows[list(columns)].to_numpy(float)
        return pd.concat([pd.DataFrame({"dt": rows["dt"], "permno": rows["permno"], "horizon": m.horizon, "pred": applied([_as_nodes(t) for t in m.trees], x)}) for m in models.itertuples()])

    return dealt.groupBy("dt", "part").cogroup(copies.groupBy("dt", "part")).applyInPandas(one, "dt date, permno bigint, horizon string, pred double")
