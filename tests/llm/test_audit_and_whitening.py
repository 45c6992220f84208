"""Operators 11 to 13 against brute force, SQL and a dense eigensolver."""

import hashlib
import random
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest

from panelspark.llm import filter_audit, suffix_dedup, whitening
from panelspark.llm.shared import table

from .brute import WORD

SMALL = "/root/testdata/sf0.001"


def repeats(texts, width=suffix_dedup.WIDTH):
    """n_bytes, n_removed, n_spans, kept_sha256 of each text, by a count of all its strings."""
    raw = [(t or "").encode() for t in texts]
    n = Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - width + 1):
            if n[r[i : i + width]] > 1:
                gone[i : i + width] = True
        turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        out.append((len(r), int(gone.sum()), len(turns) // 2, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefgé ", k=rnd.randint(2, 9)))
    passages = [" ".join(word() for _ in range(rnd.randint(20, 120))) for _ in range(12)]
    docs = [None, "", "x" * 199, "a" * 700, "ab" * 400, "ab" * 130 + "x" + "ab" * 150, "z" * 200, "\0" * 230, "\0" * 201 + "q", " ".join(word() for _ in range(4000))]
    for _ in range(60):
        docs.append("".join(rnd.choice(passages)[rnd.randint(0, 40) : rnd.randint(150, 900)] if rnd.random() < 0.6 else word() * rnd.randint(1, 3) + " " for _ in range(rnd.randint(1, 8))))
    return docs + rnd.choices(docs, k=6)


@pytest.mark.parametrize(("seed", "large"), [(1, suffix_dedup.LARGE), (2, 3)])
def test_repeats_against_brute_force(spark, monkeypatch, seed, large):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)  # 3: most ends are counted string by string
    docs = corpus(seed)
    frame = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in enumerate(docs)], "doc_id bigint, text string, k int, `end` string, d int")
    out = suffix_dedup.without_repeats(frame)
    assert out.schema["row"].dataType.fieldNames() == ["doc_id", "k", "end", "d"]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(out).collect()}
    assert got == dict(enumerate(repeats(docs)))


def test_repeats_of_a_hot_passage_list_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LISTED", 0)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 10)
    rnd = random.Random(5)
    hot = "".join(rnd.choices("abcdefgh ", k=400))
    docs = ["".join(rnd.choices("abcdefgh ", k=rnd.randint(0, 90))) + hot[rnd.randint(0, 60) :] + "".join(rnd.choices("abcdefgh ", k=50)) for _ in range(80)] + [hot] * 5
    frame = spark.createDataFrame([(i // 2 if i > 82 else i, t) for i, t in enumerate(docs)], "doc_id bigint, text string")
    got = Counter(tuple(r)[1:] for r in suffix_dedup.digests(suffix_dedup.without_repeats(frame)).collect())
    assert got == Counter(repeats(docs))
    assert suffix_dedup.without_repeats(frame.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["passage", "near copies"])
def test_a_large_end_makes_few_rows_a_phrase(spark, monkeypatch, kind):
    monkeypatch.setattr(suffix_dedup, "LARGE", 40)
    rnd = random.Random(7)
    some = lambda n: "".join(rnd.choices("abcdefghijklmnop ", k=n))
    hot = some(400)
    docs = [some(300) + hot + some(300) if kind == "passage" else "".join(some(1) if rnd.random() < 0.004 else c for c in hot + hot[::-1]) for _ in range(150)]
    docs += [docs[0][250:], hot[:230], hot[30:] + some(40), docs[1]]
    made = Counter()  # strings of large ends, and rows that a join or a count gives back
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    mapped, met, stored = type(frame).mapInArrow, suffix_dedup.meet, suffix_dedup.stored

    def counted(self, f, *args, **more):
        out = mapped(self, f, *args, **more)
        if f is suffix_dedup._one_by_one:
            made["strings"] += out.count()
        return out

    def meeting(rows, groups, keys, apart):
        if keys not in (["end"], ["d"], ["e1", "e2"]):
            made["met"] += rows.count()
        return met(rows, groups, keys, apart)

    def storing(out, name, *args):
        out = stored(out, name, *args)
        if name == "extended-phrases":
            made["phrases"] = out.where("large").count()
            made["all"] = out.where("large").selectExpr("octet_length(left) + octet_length(right) - 199 AS n").groupBy().sum("n").first()[0]
        return out

    monkeypatch.setattr(type(frame), "mapInArrow", counted)
    monkeypatch.setattr(suffix_dedup, "meet", meeting)
    monkeypatch.setattr(suffix_dedup, "stored", storing)
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.digests(suffix_dedup.without_repeats(frame)).collect()}
    assert got == dict(enumerate(repeats(docs)))
    assert made["all"] > 50 * made["phrases"] > 50 * 150, made
    assert made["strings"] + made["met"] < 0.5 * made["all"], made  # string by string: once to count, and once to meet the count


def test_repeats_with_null_and_repeated_ids(spark):
    rnd = random.Random(6)
    text = "".join(rnd.choices("abcdefgh ", k=300))
    docs = [(None, text), (None, text), (7, text[:250] + "é"), (7, text[:250] + "é"), (8, text[5:210]), (9, "short"), (9, "short"), (None, None)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted(suffix_dedup.digests(suffix_dedup.without_repeats(frame)).collect(), key=repr)
    want = sorted(((d, *r) for (d, _), r in zip(docs, repeats([t for _, t in docs]))), key=repr)
    assert sorted(map(tuple, got), key=repr) == want


def test_phrases_are_cut_by_their_bytes_alone():
    rnd = random.Random(3)
    text = "".join(rnd.choices("abcd efgh", k=3000)).encode()
    other = b"something before " + text + b" and after"
    where = lambda raw: {raw[p.first[i] : p.last[i] + 200]: int(p.at[i] - p.first[i]) for p in [suffix_dedup.Phrases(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))] for i in range(len(p.k))}
    one, two = where(text), where(other)
    assert len(set(one) - set(two)) <= 2 and all(two[x] == one[x] for x in one if x in two)
    p = suffix_dedup.Phrases(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert (p.first[1:] == p.last[:-1] + 1).all() and p.first[0] == 0 and p.last[-1] == len(text) - 200  # each start stands in one phrase


def audit(docs, labels):
    text = [t or "" for _, t, _ in docs]
    masks = []
    for (d, _, _), t in zip(docs, text):
        w = WORD.findall(t)
        copy = d is not None and any(u == t and e is not None and e < d for (e, _, _), u in zip(docs, text))
        masks.append({x for x, f in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), copy)) if f})
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    rows = []
    for part in {s or "" for _, _, s in docs}:
        own = [(d, m) for (d, _, s), m in zip(docs, masks) if (s or "") == part]
        removed_in = Counter()
        these = []
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                before = set(order[:k])
                removed = [d for d, m in own if not m & before and x in m]
                removed_in[x] += len(removed)
                these.append((part, "".join(order), k + 1, sum(not m & (before | {x}) for _, m in own), len(removed), sum(bool(m & before) and x in m for _, m in own), sum(m == {x} for _, m in own), sum(d in good for d in removed), sum(d in toxic for d in removed), x))
        rows += [(*r[:-1], removed_in[r[-1]]) for r in these]
    return sorted(rows)


def test_filter_audit_against_brute_force(spark):
    plain = " ".join(f"word{i}" for i in range(60))
    docs = [(1, None, None), (2, "", ""), (3, plain, "a"), (4, plain, "b"), (4, plain, "b"), (None, plain, "a"), (None, "x", None), (5, plain.upper(), "a"), (6, "dup " * 80, "a"), (7, "dup # " * 40, "b"), (8, plain + " $", "a"), (9, "é" * 90, "c"), (10, plain + " \x1c\x85 end", "c"), (11, "w" * 100_000 + " " + plain, "c"), (3, plain, "b")]
    labels = [(1, 1, 0), (3, 0, 1), (4, 1, 1), (4, 0, 0), (6, 1, None), (7, None, 1), (None, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(d, t, s, 1, 2) for d, t, s in docs], "doc_id bigint, text string, source string, mask int, n int")
    told = spark.createDataFrame([(*x, "k") for x in labels], "doc_id bigint, quality int, toxic int, good string")
    got = sorted(tuple(r) for r in filter_audit.audited(frame, told).collect())
    assert got == audit(docs, labels)
    assert filter_audit.audited(frame.limit(0), told).count() == 0
    assert sorted(tuple(r)[:7] for r in filter_audit.audited(frame, told.limit(0)).collect()) == [r[:7] for r in audit(docs, [])]


def test_filter_audit_sql(spark):
    got = filter_audit.audited(table(spark, SMALL, "documents"), table(spark, SMALL, "labels")).toPandas()
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    want = con.execute(filter_audit.oracle()).df()
    assert sorted(map(tuple, got[list(want.columns)].values.tolist())) == sorted(map(tuple, want.values.tolist()))


@pytest.mark.parametrize("kind", ["flat", "low rank", "decay", "cluster", "equal", "one"])
def test_components_against_a_dense_solver(kind):
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    values = {"flat": np.linspace(9, 5, 40), "low rank": np.r_[np.arange(20, 0, -1), np.zeros(20)], "decay": np.exp(-np.arange(40) / 4), "cluster": np.r_[[5] * 12, [3] * 25, [1] * 3], "equal": np.full(40, 3), "one": np.r_[2, np.zeros(39)]}[kind].astype(float)
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    got, p = whitening.components(v)
    k = min(32, int((values > 0).sum()))
    assert len(got) == k and np.allclose(got, values[:k], rtol=0, atol=1e-13 * values[0] * 40)
    assert np.abs(p.T @ p - np.eye(k)).max() < 1e-13 and np.abs(v @ p - p * got).max() < 1e-13 * values[0]
    assert whitening.components(np.zeros((3, 3)))[1].shape == (3, 0)


def test_inertia_counts_eigenvalues():
    a = np.random.default_rng(1).standard_normal((30, 30))
    a = a + a.T
    values = np.linalg.eigvalsh(a)
    at = np.r_[values - 1e-6, values + 1e-6, -99, 99]
    assert whitening.inertia(*whitening.tridiagonal(a), at).tolist() == [(values > x).sum() for x in at]


def test_whitening(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.standard_normal((50, 5)) @ rng.standard_normal((5, 5))).round(3).tolist()
    bad = [None, [], [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [1.0, float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0], [1e300] * 5]
    rows = [(i, v, 1, 2.0) for i, v in enumerate(vectors + bad)] + [(0, vectors[0], 1, 2.0), (None, vectors[1], 1, 2.0)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n int, component double")
    got = whitening.whitened(frame).toPandas()
    used = [(r[0], r[1]) for r in rows if r[1] in vectors]
    x = np.floor(64 * np.array([v for _, v in used])).astype(int) + whitening.SHIFT
    n, s = len(x), x.sum(0)
    values, p = np.linalg.eigh(np.cov((x - s / n).T, bias=True))
    values, p = values[::-1], p[:, ::-1]
    assert len(got) == 5 * n and set(got.n) == {n} and got.identity_error.max() < 1e-10
    for c in range(5):
        w = (x - s / n) @ p[:, c] / np.sqrt(values[c])
        own = got[got.component == c + 1]
        assert np.allclose(sorted(np.abs(own.whitened)), sorted(np.abs(w)), atol=1e-9) and np.allclose(own.explained, values[c] / values.sum(), rtol=1e-9)
        assert sorted(own.deviation) == sorted(((n * x - s) ** 2).sum(1).tolist())
    for few in (frame.limit(0), frame.where("vec_id = 50"), frame.where("vec_id = 3")):
        assert whitening.whitened(few).count() == 0
    large = spark.createDataFrame([(1, [1e12, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 9.0])], "vec_id int, embedding array<double>")
    assert {r.vec_id: r.deviation for r in whitening.whitened(large).collect()} == {1: None, 2: None, 3: None}
