"""All five stages of the pipeline over edge rows, against brute force: nulls, very long texts, repeated rows and ids, clashing names."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import line_dedup, near_dedup, packing, quality_classifier, shared, tokens
from panelspark.llm.shared import table

from . import brute
from .test_training_data import EDGE_ROWS, SMALL, WORDS, _stage_rows

#: Columns named like the operators' own.
NAMES = "doc_id bigint, text string, node string, d int, e int, row int, n_chars bigint, piece int, length int"


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*r, 1, 2, 3, len(r[1] or ""), 4, 5) for r in EDGE_ROWS], NAMES)


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


def bag(rows):
    return Counter(map(repr, map(tuple, rows)))


def test_rules_stage(spark, frame, stages):
    _, kept = _stage_rows(spark, frame)
    got = stages["quality_rules"](spark, frame, SMALL)
    assert got.schema == frame.schema and bag(got.collect()) == bag(kept)


def test_classifier_stage(spark, frame, stages):
    """Texts' scores by the fitted weights, one text at a time; given documents lend the labels."""
    lent = table(spark, SMALL, "documents").select("doc_id", "text", F.lit("x").alias("node"), *[F.lit(0).cast(t).alias(c) for c, t in frame.dtypes[3:]])
    docs = frame.union(lent)
    m = quality_classifier.trained(docs, table(spark, SMALL, "labels"))
    known = {}

    def score(text):
        if text not in known:
            raw = (text or "").encode()
            places = sorted(set(quality_classifier.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist()))
            x = [float(m["scale"][p]) for p in places]
            norm = max(sum(v * v for v in x) ** 0.5, 1e-9)
            margin = sum(v / norm * float(m["weight"][p]) for v, p in zip(x, places)) + float(m["weight"][-1])
            known[text] = 1 / (1 + np.exp(-(m["slope"] * margin + m["shift"])))
        return known[text]

    rows = docs.collect()
    got = stages["quality_classifier"](spark, docs, SMALL)
    assert got.schema == docs.schema and bag(got.collect()) == bag(r for r in rows if score(r.text) >= quality_classifier.THRESHOLD)
    assert 0 < got.count() < len(rows)


def test_line_stage(spark, frame, stages):
    """Rows that repeat id and text are one document and share its result; documents that lose everything go."""
    rows = frame.collect()
    distinct = sorted({(r.doc_id is not None, r.doc_id or 0, r.text) for r in rows if r.text is not None})
    texts = brute.without_copies([(k, t) for k, (_, _, t) in enumerate(distinct)])
    of = {key: texts[k][:2] for k, key in enumerate(distinct)}
    want = []
    for r in rows:
        text, gone = (None, 0) if r.text is None else of[r.doc_id is not None, r.doc_id or 0, r.text]
        if not gone or text.strip(" \t\r\f\v\n"):
            want.append((r.doc_id, text, *r[2:6], len(text) if gone else r.n_chars, *r[7:]))
    got = stages["line_dedup"](spark, frame, SMALL)
    assert got.schema == frame.schema and bag(got.collect()) == bag(want)
    assert any(a != tuple(r) for a, r in zip(want, rows))


def test_near_duplicate_stage(spark, frame, stages):
    rows = frame.collect()
    texts = sorted({r.text for r in rows if r.text and r.text.split()})
    group = brute.components(list(enumerate(texts)))
    least = {}
    for r in rows:
        if r.text and r.text.split():
            k = group[texts.index(r.text)][1]
            least[k] = min(least.get(k, (True, 1 << 60, "")), (r.doc_id is not None, r.doc_id or 0, ""))
    got = stages["minhash_near_dedup"](spark, frame, SMALL)
    assert got.schema == frame.schema
    stay = Counter(r.doc_id for r in got.collect() if r.text and r.text.split())
    assert stay == Counter(d if some else None for some, d, _ in least.values())
    wordless = [r for r in rows if not (r.text and r.text.split())]
    assert bag(r for r in got.collect() if not (r.text and r.text.split())) == bag(wordless)


def test_dedup_stages_take_few_jobs(spark):
    """The driver holds threads, plans and metrics of each job: 130 and 155 of them took it beyond its memory when stages ran again and again."""
    docs = table(spark, SMALL, "documents")
    for stage, most in ((line_dedup.without_repeated_lines, 100), (near_dedup.one_of_each, 80)):
        spark.sparkContext.setJobGroup(stage.__name__, "jobs of a stage")
        try:
            assert stage(docs).count()
        finally:
            spark.sparkContext.setJobGroup(None, None)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(stage.__name__)) < most


@pytest.mark.parametrize("largest", [shared.LIGHT, shared.LIGHT + 1])
def test_rows_meet_their_groups_by_counts(spark, largest):
    """One join where no key has many rows, two where one has; the same rows as without the counts."""
    rows = spark.range(largest).select(F.lit(7).cast("bigint").alias("key"), F.col("id").alias("row")).union(spark.range(40).selectExpr("id div 2 + 10", "id + 1000")).union(spark.range(5).selectExpr("id + 100", "id + 2000"))
    groups, counts = shared.counted(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("least")).where("n > 1"), "groups")
    assert counts == {"rows": 21, "total": largest + 40, "most": largest}
    got = shared.meet(rows, groups, ["key"], ["row"], counts)
    assert got.columns == ["row", "key", "n", "least"] and bag(got.collect()) == bag(shared.meet(rows, groups, ["key"], ["row"]).collect())
    assert bag(got.collect()) == bag(rows.join(groups, "key", "left").select(*got.columns).collect())


def test_measures_of_no_rows(spark):
    none, counts = shared.counted(spark.range(9).selectExpr("id AS key", "id AS n").where("n < 0"), "none")
    assert none.count() == 0 and counts == {"rows": 0, "total": 0, "most": 0}


@pytest.mark.parametrize("whole", [True, False])
def test_packing_stage(spark, frame, stages, whole):
    """Every piece of every row by the library: piece, start, length and crc32; sequences without gaps, as many as planned."""
    rows = frame.collect()
    limit = 4096 if whole else 50
    lib = tokens.library(WORDS)
    want, counts = Counter(), Counter()
    for r in rows:
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), limit)):
            own = np.array(ids[at : at + limit], "<u4")
            want[r.doc_id, k, at, len(own), zlib.crc32(own.tobytes())] += 1
            counts[len(own)] += 1
    got = (stages["best_fit_packing"](spark, frame, SMALL) if whole else packing.packed(frame, WORDS, 1, limit)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert all(a + n == b for (a, n), b in zip(parts, [p[0] for p in parts[1:]] + [sum(n for _, n in parts)])) and parts[0][0] == 0 and sum(n for _, n in parts) <= limit
    assert len(sequences) == sum(n for _, n in packing.planned(dict(counts), limit))


def test_stages_of_an_empty_table(spark, frame, stages):
    for name, stage in stages.items():
        out = stage(spark, frame.limit(0), SMALL)
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == frame.columns)
