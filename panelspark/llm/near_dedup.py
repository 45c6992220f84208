"""Operator 10: MinHash near-duplicates by one-permutation hashing.

Each document's set of 5-word shingles is hashed once; the hash's top bits choose a bin and each bin keeps its least
hash. Empty bins borrow from a full bin chosen by a hash of (bin, attempt), the same attempt order for every document
(optimal densification). Rows of bins form bands; a band's value is a bucket. In each bucket the member that meets most
others in all its buckets is the hub, and edges go from it to each member only, so that a bucket of n documents gives
n - 1 candidates. Every candidate is confirmed on full shingle sets. Buckets whose members are still in several
components are looked at again, first from a second hub, then by an exact search for the partners of every member
outside the hub's component, so that no link is lost because its hub was a bad match.

Defined results: null or word-free text has an empty set, links to nothing and is its own component; documents of
fewer than five words have one shingle, the whole sequence; equal sets (by a 128-bit digest) are one node; rows are
linked by their sets, one by one, whatever ids they share; doc_ids keep their type and its order, and a null one is the least of
a component only where all are null; ties in size or centrality go by node; very long texts are taken whole, in one row; an empty bin
whose 4,096 attempts all meet empty bins (odds under 1e-13) takes the first full one; an empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import LOWER, blocks, document_of, mixed, span_hashes, spans
from .shared import HOT, counted, forget, measured, meet, stored

WIDTH, BINS, ROWS, SKETCH = 5, 128, 4, 512
_ODD = mixed(np.arange(11, 11 + WIDTH, dtype=np.uint64)) | np.uint64(1)
_TRIES = 4096
_PROBE = (mixed((np.arange(BINS, dtype=np.uint64)[:, None] << np.uint64(20)) + np.arange(1, _TRIES + 1, dtype=np.uint64)) % np.uint64(BINS)).astype(np.int64)


def shingle_sets(data: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each document of a block, the sorted distinct hashes of its shingles."""
    data = LOWER[data]
    begin, end, first = spans(data, starts)
    words = span_hashes(data, begin, end)
    counts = np.diff(first)
    if len(words) >= width:
        keys = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            keys += words[k : len(words) - width + 1 + k] * _ODD[k]
        keys = mixed(keys)
    else:
        keys = np.zeros(0, np.uint64)
    out = []
    for a, n in zip(first[:-1].tolist(), counts.tolist(), strict=True):
        if n >= width:
            s = np.sort(keys[a : a + n - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            whole = (words[a : a + n] * _ODD[:n]).sum(dtype=np.uint64, keepdims=True)
            out.append(mixed(whole + np.array([n], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS least hashes for each non-empty set, with empty bins filled by optimal densification."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
    sig, full = np.zeros((len(sets), BINS), np.uint64), np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        to = np.append(at[1:], len(s))
        full[i] = to > at
        sig[i] = s[np.minimum(at, len(s) - 1)]
    doc, hole = np.nonzero(~full)
    for t in range(_TRIES):
        if not len(doc):
            break
        donor = _PROBE[hole, t]
        found = full[doc, donor]
        sig[doc[found], hole[found]] = sig[doc[found], donor[found]]
        doc, hole = doc[~found], hole[~found]
    if len(doc):  # as good as never: the next full bin
        for d, h in zip(doc, hole, strict=True):
            sig[d, h] = sig[d, np.flatnonzero(full[d])[0]]
    return sig


def _band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = sig.shape[1] // rows
    keys = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        keys = mixed(keys + sig[:, r :: rows][:, :bands] + np.uint64(r + 1))
    return mixed(keys + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, whether each of SKETCH bins (by top bits) holds an odd number of its hashes.

    The bins in which two sets' bits differ hold an element each that only one of them has, so that no more bits differ
    than there are such elements.
    """
    odd = [np.bincount((s >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64), minlength=SKETCH) & 1 for s in sets]
    return np.packbits(np.array(odd, np.uint8).reshape(len(sets), SKETCH), axis=1).view(np.int64)


def _digest(s: np.ndarray) -> tuple[int | None, int | None]:
    """128 bits of a set's hashes, as two whole numbers; nulls for the empty set."""
    if not len(s):
        return None, None
    both = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


def _described(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in blocks(batches):
            sets = shingle_sets(data, starts)
            filled = [i for i, s in enumerate(sets) if len(s)]
            some = [sets[i] for i in filled]
            sig = signatures(some)
            bands: list = [None] * len(sets)
            sketch: list = [None] * len(sets)
            for i, k, b in zip(filled, _band_keys(sig, rows), _sketches(some), strict=True):
                bands[i], sketch[i] = k, b
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*map(_digest, sets))), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64())), *batch.columns[2:]],
                names=["doc_id", "n_shingles", "high", "low", "bands", "sketch", *batch.schema.names[2:]],
            )

    return run


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, starts in blocks(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(data, starts)], pa.binary())], names=["node", "shingles"])


def _linked(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
                    ok.append(False)
                    continue
                s = np.sort(np.concatenate([a, b]), kind="stable")
                both = int((s[1:] == s[:-1]).sum())
                ok.append(100 * both >= threshold * (len(s) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    return run


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Node and its component's least node, for every node of `links`, by alternating large-star and small-star steps."""
    sums = {"n": F.count(F.lit(1)), "hashes": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    edges, now = measured(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges", **sums)
    previous = None
    while previous != now and now["n"]:
        previous = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, now = measured(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", **sums)
        forget(edges)
        edges = after
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, threshold: int = 75, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (columns doc_id and text); see the module's text."""
    described, of_node = _joined_up(_marked(docs), threshold, rows)
    least = of_node.groupBy("component").agg(F.min("rep").alias("component_id"))
    out = described.select("doc_id", "n_shingles", "node").join(of_node.join(least, "component").select("node", "component_id"), "node", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, text without nulls, and a 128-bit hash of it: these three tell rows apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("left"), F.xxhash64(F.lit(7), text).alias("right"))


def one_of_each(docs: DataFrame, threshold: int = 75, rows: int = ROWS) -> DataFrame:
    """The rows of `docs`, with all their columns, that stay: of each component the one of least (doc_id, text hash).

    Rows are judged one by one: of rows that share a doc_id only the copies go, and of rows that share doc_id and text
    one stays. Rows without words link with nothing and all stay.
    """
    text = F.coalesce("text", F.lit(""))
    marks = [F.xxhash64(text).alias("left"), F.xxhash64(F.lit(7), text).alias("right")]
    described, of_node = _joined_up(_marked(docs), threshold, rows)
    key = ["doc_id", "left", "right"]
    worded = described.where("node is not null").join(of_node.select("node", "component"), "node")
    counted = stored(worded.groupBy("component", *key).agg(F.count("*").alias("n")), "counted")
    least = counted.groupBy("component").agg(F.min(F.struct(*key)).alias("least"))
    stays = F.struct(*key).eqNullSafe(F.col("least"))
    acted = stored(counted.join(least, "component").where(~stays | (F.col("n") > 1)).select(*key, stays.alias("stays")), "acted").alias("a")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", *marks).alias("o")
    met = own.join(acted, F.col("o.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("o.left") == F.col("a.left")) & (F.col("o.right") == F.col("a.right")), "left")
    alone = met.where("a.stays is null").select("o.row")
    repeated = met.where("a.stays").select("o.*").dropDuplicates(key).select("row")
    return alone.union(repeated).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def _joined_up(docs: DataFrame, threshold: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, left, right, n_shingles, node of each row of `_marked` documents, and node, rep, component of each distinct set.

    rep is the least doc_id of the rows with the set.
    """
    more = T._parse_datatype_string("n_shingles bigint, high bigint, low bigint, bands array<bigint>, sketch array<bigint>, left bigint, right bigint").fields
    described = stored(docs.mapInArrow(_described(rows), T.StructType([docs.schema["doc_id"], *more])), "described")
    text = F.struct("doc_id", "left", "right")  # nulls come last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), text.alias("of")))
    nodes = described.where("high is not null").groupBy("high", "low").agg(F.count("*").alias("n"), first["of"].alias("text"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes, counts = counted(nodes.select(F.monotonically_increasing_id().alias("node"), "*", F.col("text.doc_id").alias("rep")), "nodes")
    own = described.drop("bands", "sketch")
    worded = meet(own.where("high is not null"), nodes.select("high", "low", "n", "node"), ["high", "low"], ["doc_id", "left"], counts)
    described = worded.drop("n", "high", "low").unionByName(own.where("high is null").drop("high", "low").withColumn("node", F.lit(None).cast("bigint")))  # read once
    members = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    sizes, counts = counted(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = meet(members, sizes, ["bucket"], ["node"], counts).where("n is not null")
    central = shared.groupBy("node").agg(F.sum("n").alias("central"))
    crowd = stored(shared.join(central, "node"), "buckets")
    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * threshold
    first = F.struct("central", "node")
    hubs, counts = counted(crowd.groupBy("bucket").agg(F.max_by(F.struct("node", "size"), first).alias("h"), F.count("*").alias("n")).select("bucket", F.col("h.node").alias("hub"), F.col("h.size").alias("hub_size"), "n"), "hubs")
    sets = _sets(docs, nodes.join(central.select("node"), "node", "left_semi"))
    star = meet(crowd.drop("n"), hubs, ["bucket"], ["node"], counts).where((F.col("node") != F.col("hub")) & fits("size", "hub_size"))
    checked, _ = _checked(sets, _pairs(star, "node", "hub").distinct(), threshold)
    found = _found(checked)
    # Buckets of three and more that still hold several components: a second hub from those that the first did not link.
    known, out = _open(crowd, hubs, found)
    one, counts = counted(out.groupBy("bucket").agg(F.max_by(F.struct("node", "size", "component"), first).alias("h"), F.max("n").alias("n")).select("bucket", F.col("h.node").alias("one"), F.col("h.size").alias("one_size"), F.col("h.component").alias("one_component"), "n"), "second")
    if counts["rows"]:  # else every member is in its hub's component
        cross = meet(known.drop("n"), one, ["bucket"], ["node"], counts).where((F.col("one").isNotNull()) & (F.col("component") != F.col("one_component")) & fits("size", "one_size"))
        more, links = _checked(sets, _fresh(cross, checked), threshold)
        checked = checked.union(more)
        if links:
            found = _found(checked)
            known, out = _open(crowd, hubs, found)
        # Then, exactly: what is still outside the hub's component against all others of the hub's buckets.
        more, links = _checked(sets, _fresh(_beside(sets, nodes, known, out, hubs, threshold), checked), threshold)
        if links:
            found = _found(checked.union(more))
    return described, nodes.select("node", "rep").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _found(checked: DataFrame) -> DataFrame:
    return stored(components(checked.where("linked").select("a", "b")), "components")


def _fresh(cross: DataFrame, checked: DataFrame) -> DataFrame:
    return _pairs(cross, "node", "one").distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")


def _open(crowd: DataFrame, hubs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of buckets of three and more with their components, and those outside their hub's component."""
    known = crowd.where("n > 2").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_hub = hubs.where("n > 2").join(found.select(F.col("node").alias("hub"), F.col("component").alias("hub_component")), "hub", "left")
    of_hub, counts = counted(of_hub.select("bucket", F.coalesce("hub_component", "hub").alias("hub_component"), F.col("n").alias("n")), "hubs")
    return known, meet(known.drop("n"), of_hub, ["bucket"], ["node"], counts).where("component <> hub_component").select(*known.columns)


def _beside(sets: DataFrame, nodes: DataFrame, known: DataFrame, out: DataFrame, hubs: DataFrame, threshold: int) -> DataFrame:
    """node, one: every pair that may be a link, of a member outside its hub's component and another member of a bucket.

    Let o be a set's overlap with the hub. A link of x and y, |x| <= |y|, needs |x & y| >= t * (|x| + |y|) with
    t = s / (1 + s) for the similarity s; at most min(o(x), o(y)) of it lies in the hub, at most
    min(|x - hub|, |y - hub|) outside. If min(o(x), o(y)) does not reach the bound alone, x and y share shingles outside
    the hub: 2 t |x| - o(x) at least as seen from x, s |y| - o(y) from y. By the prefix principle they then share one
    among the first |x - hub| - that + 1 of x - hub, and likewise for y, rarest first; those that no other set of the
    hub has come first and need no look. If min(o(x), o(y)) reaches the bound, o(x) / t - |x| bounds |y|. Both are
    equi-joins. A link also needs |x ^ y| <= (1 - s) / (1 + s) * (|x| + |y|), and sketches never differ in more bits than
    |x ^ y|: pairs whose sketches differ in more are left out, and no link is among them.
    """
    outer = out.select("bucket", "node").withColumn("outer", F.lit(True))
    rows = known.join(outer.select("bucket").distinct(), "bucket").join(outer, ["bucket", "node"], "left").join(hubs.select("bucket", "hub"), "bucket").where("node <> hub")
    rows = stored(rows.groupBy("hub", "node").agg(F.first("size").alias("size"), F.first("component").alias("component"), F.max(F.coalesce("outer", F.lit(False))).alias("outer")), "beside")
    own = sets.select("node", F.col("shingles").alias("own"))
    of_hub = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("theirs"))
    apart = rows.join(own, "node").join(of_hub, "hub").select("hub", "node", "size", "component", "outer", "own", "theirs").mapInArrow(_apart, "hub bigint, node bigint, size bigint, component bigint, outer boolean, overlap bigint, apart array<bigint>")
    words = [f"s{i}" for i in range(SKETCH // 64)]
    drawn = nodes.select("node", *[F.col("sketch")[i].alias(w) for i, w in enumerate(words)])
    apart = stored(apart.join(drawn, "node"), "apart")
    bits = sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in words), F.lit(0))
    near = bits * (100 + threshold) <= (F.col("x.size") + F.col("y.size")) * (100 - threshold)
    fits = (F.col("x.component") != F.col("y.component")) & (F.least("x.size", "y.size") * 100 >= F.greatest("x.size", "y.size") * threshold) & near
    pair = [F.col("x.node").alias("node"), F.col("y.node").alias("one")]
    keys = apart.select("hub", "node", F.explode("apart").alias("key"))
    common = keys.join(keys.groupBy("hub", "key").agg(F.count("*").alias("n")).where("n > 1"), ["hub", "key"])
    listed = common.groupBy("hub", "node").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("listed"))  # of one set
    spread = apart.drop("apart").join(listed, ["hub", "node"])
    # of the first n_apart - needed + 1 by rarity, the n_apart - size(listed) that no other set has are the first
    prefix = lambda needed: F.explode(F.slice("listed", F.lit(1), F.greatest(F.size("listed") - F.greatest(F.ceil(needed) - F.col("overlap"), F.lit(1)) + 1, F.lit(0)).cast("int"))["key"]).alias("key")
    columns = ["hub", "node", "size", "component", "outer", "overlap", *words]
    x = spread.select(*columns, prefix(F.col("size") * (2 * threshold) / (100 + threshold))).alias("x")
    y = spread.select(*columns, prefix(F.col("size") * threshold / 100)).alias("y")
    most_shared = F.least("x.overlap", "y.overlap") + F.least(F.col("x.size") - F.col("x.overlap"), F.col("y.size") - F.col("y.overlap"))
    can = most_shared * (100 + threshold) >= (F.col("x.size") + F.col("y.size")) * threshold
    upward = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.node") < F.col("y.node")))
    by_shingle = x.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.key") == F.col("y.key")) & upward & (F.col("x.outer") | F.col("y.outer")) & fits & can).select(*pair)
    # sizes in steps of about an eighth; x looks into the steps from s * |x| to o(x) / t - |x|
    step = lambda c: F.floor(F.log2(c) * 6)
    sized = apart.where(F.col("overlap") * 100 >= F.col("size") * threshold).drop("apart")
    most = F.least(F.col("overlap") * (100 + threshold) / threshold - F.col("size"), F.col("size") * 100 / threshold)
    x = sized.where("outer").withColumn("most", most).withColumn("least", F.col("size") * threshold / 100).where("most >= least and most >= 1")
    x = x.withColumn("key", F.explode(F.sequence(step(F.greatest("least", F.lit(1))), step(F.col("most")))))
    y = sized.withColumn("key", step(F.col("size")))
    bound = F.least("x.overlap", "y.overlap") * (100 + threshold) >= (F.col("x.size") + F.col("y.size")) * threshold
    by_size = x.alias("x").join(y.alias("y"), (F.col("x.hub") == F.col("y.hub")) & (F.col("x.key") == F.col("y.key")) & fits & bound).select(*pair)
    return by_shingle.union(by_size)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set's overlap with its hub, and its other shingles."""
    for batch in batches:
        overlap, apart = [], []
        for own, theirs in zip(batch.column(5), batch.column(6), strict=True):
            own, theirs = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(theirs.as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(theirs, own), len(theirs) - 1)
            rest = own[theirs[at] != own]
            overlap.append(len(own) - len(rest))
            apart.append(rest.view(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(overlap, pa.int64()), pa.array(apart, pa.list_(pa.int64()))], names=["hub", "node", "size", "component", "outer", "overlap", "apart"])


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its full sorted shingle set, from the node's one text; rows that repeat its id and text give it once."""
    chosen = nodes.select("node", "text.*")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.left") == F.col("c.left")) & (F.col("d.right") == F.col("c.right"))
    texts = docs.alias("d").join(chosen.alias("c"), same).select("node", "text")
    return stored(texts.mapInArrow(_sets_of, "node bigint, shingles binary").dropDuplicates(["node"]), "sets")


def _checked(sets: DataFrame, pairs: DataFrame, threshold: int) -> tuple[DataFrame, int]:
    """a, b, linked: each pair of nodes confirmed on their full sets; how many are linked."""
    pairs, seen = measured(pairs, "pairs", n=F.count(F.lit(1)))
    if not seen["n"]:
        return pairs.select("a", "b", F.lit(False).alias("linked")), 0
    both = _with_sets(_with_sets(pairs, pairs, seen["n"], sets, "a"), pairs, seen["n"], sets, "b").select("a", "b", "sa", "sb")
    checked, seen = measured(both.mapInArrow(_linked(threshold), "a bigint, b bigint, linked boolean"), "checked", links=F.count_if("linked"))
    return checked, seen["links"]


def _with_sets(rows: DataFrame, pairs: DataFrame, n_pairs: int, sets: DataFrame, side: str) -> DataFrame:
    """`rows` with the sets of their `side`. A node in more than one HOT-th of the pairs has its rows dealt to parts of that size, each with a copy of the set."""
    most = max(n_pairs // HOT, 1000)
    plain = sets.select(F.col("node").alias(side), F.col("shingles").alias(f"s{side}"))
    if n_pairs <= most:  # no node can be in more
        return rows.join(plain, side)
    hot, seen = measured(pairs.groupBy(side).agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col(side).alias("node"), F.ceil(F.col("n") / most).cast("int").alias("parts")).coalesce(1), "hot", rows=F.count(F.lit(1)))  # fewer than HOT rows
    if not seen["rows"]:
        return rows.join(plain, side)
    dealt = rows.join(F.broadcast(hot.withColumnRenamed("node", side)), side, "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = sets.join(F.broadcast(hot), "node", "left").select(F.col("node").alias(side), F.col("shingles").alias(f"s{side}"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    return dealt.join(copies, [side, "part"]).drop("part")
