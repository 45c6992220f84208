"""Boosted trees against boosting by hand: nulls, L2, leaf-wise growth, the late fold, warm starts, and fits that stay spread."""

from datetime import date, timedelta

import numpy as np
import pytest

from panelspark.operators import boosting, learning
from panelspark.operators.boosting import Settings

PLAIN = Settings(rounds=6, leaves=5, depth=3, rate=0.3, least_leaf=4, row_share=1.0, feature_share=1.0, l2=2.0, patience=100)


def by_hand(x, y, w, late, s, rounds, base=None):
    """Trees as nested tuples, leaf-wise, every split tried; and the late loss after each."""
    train = ~late
    margin = np.full(len(y), (w[train] * y[train]).sum() / w[train].sum()) if base is None else base.copy()
    margins, losses = [], []
    for _ in range(rounds):
        g = w * (margin - y)
        score = lambda m: g[m].sum() ** 2 / (w[m].sum() + s.l2)  # noqa: E731, B023

        def best(rows):
            found = None
            for f in range(x.shape[1]):
                null = np.isnan(x[:, f])
                for nulls_left in (False, True):
                    for t in sorted(set(x[train & ~null, f])):
                        left = rows & np.where(null, nulls_left, x[:, f] <= t)
                        right = rows & ~left
                        if left.sum() >= s.least_leaf and right.sum() >= s.least_leaf:
                            gain = score(left) + score(right) - score(rows)  # noqa: B023
                            if gain > 1e-9 and (found is None or gain > found[0] * (1 + 1e-10)):
                                found = (gain, f, t, nulls_left)
            return found

        leaves = [(train, np.ones(len(y), bool), 0)]
        for _ in range(s.leaves - 1):
            able = [(b[0], i, b) for i, (rows, _, depth) in enumerate(leaves) if depth < s.depth and (b := best(rows))]
            if not able:
                break
            _, i, (_, f, t, nulls_left) = max(able, key=lambda a: a[0])
            rows, everyone, depth = leaves.pop(i)
            goes = np.where(np.isnan(x[:, f]), nulls_left, x[:, f] <= t)
            leaves += [(rows & goes, everyone & goes, depth + 1), (rows & ~goes, everyone & ~goes, depth + 1)]
        for rows, everyone, _ in leaves:
            margin[everyone] += -s.rate * g[rows].sum() / (w[rows].sum() + s.l2)
        margins.append(margin.copy())
        losses.append((w[late] * (y[late] - margin[late]) ** 2).sum() / w[late].sum() if late.any() else None)
    return margins, losses


def data(seed, n=90):
    g = np.random.default_rng(seed)
    x = np.round(g.normal(size=(n, 3)), 1)
    y = x[:, 0] + 0.5 * np.sign(x[:, 1]) * x[:, 2] + g.normal(size=n) * 0.2
    x[g.random((n, 3)) < 0.15] = np.nan
    return x, y, g.random(n) + 0.1, np.arange(n) >= 70, g.integers(-(2**62), 2**62, n)


def frame(spark, fits):
    rows = [(dt, h, int(k), *[None if np.isnan(v) else float(v) for v in r], float(a), float(b), bool(c)) for (dt, h), (x, y, w, late, key) in fits.items() for r, a, b, c, k in zip(x, y, w, late, key)]
    return spark.createDataFrame(rows, "dt date, horizon string, key bigint, a double, b double, c double, y double, w double, late boolean")


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_by_hand(seed):
    x, y, w, late, key = data(seed)
    edges = [np.unique(c[~np.isnan(c)]) for c in x.T]
    margins, losses = by_hand(x, y, w, late, PLAIN, 6)
    got = list(boosting.grown(x, y, w, late, key, edges, PLAIN))
    assert [t[0] for t in got] == list(range(7)) and got[0][1] is None
    for k in range(6):
        assert np.allclose(boosting.applied([t[2] for t in got[: k + 2]], x), margins[k]) and got[k + 1][1] == pytest.approx(losses[k])
        assert sum(n[0] < 0 for n in got[k + 1][2]) <= PLAIN.leaves


def test_fits_of_one_plan_and_spread_fits(spark, tmp_path):
    days = [date(2000, 1, 1), date(2000, 4, 1)]
    fits = {(d, h): data(i) for i, (d, h) in enumerate((d, h) for d in days for h in ("3mo", "1y"))}
    fits[days[1], "1y"] = (*fits[days[1], "1y"][:3], np.zeros(90, bool), fits[days[1], "1y"][4])  # no late fold
    rows = frame(spark, fits)
    s = Settings(rounds=4, leaves=6, depth=3, rate=0.3, least_leaf=4, l2=1.0, bins=128)
    one = {(r.dt, r.horizon, r["round"]): r for r in boosting.fitted(rows, ["a", "b", "c"], str(tmp_path / "one"), s).collect()}
    spread = {(r.dt, r.horizon, r["round"]): r for r in boosting.fitted(rows, ["a", "b", "c"], str(tmp_path / "spread"), Settings(**{**s.__dict__, "at_most": 0})).collect()}
    assert one.keys() == spread.keys() and len(one) == 4 * 5
    for k, r in one.items():
        t = spread[k]
        assert (r.late_loss is None) == (t.late_loss is None) == (k[2] == 0 or k[:2] == (days[1], "1y")) and r.rows == t.rows == 90
        assert r.late_loss is None or r.late_loss == pytest.approx(t.late_loss)
        assert len(r.tree) == len(t.tree) and all(a.feature == b.feature and a.threshold == b.threshold and a.left == b.left and a.value == pytest.approx(b.value) for a, b in zip(r.tree, t.tree))
    # and by hand, where every row and feature takes part
    plain = Settings(**{**PLAIN.__dict__, "rounds": 2, "bins": 128})
    model = boosting.fitted(rows, ["a", "b", "c"], str(tmp_path / "plain"), plain)
    for (d, h), (x, y, w, late, _) in fits.items():
        trees = [boosting._as_nodes({"tree": r.tree}) for r in model.where(f"dt = '{d}' and horizon = '{h}'").orderBy("round").collect()]
        assert np.allclose(boosting.applied(trees, x), by_hand(x, y, w, late, plain, 2)[0][-1])


def test_patience_keeps_the_later_trees(spark):
    leaf = [(-1, None, None, None, None, 0.0)]
    losses = {"long": [None, 5.0, 6.0, 7.0, 4.0, 4.5, 3.0], "short": [None, 5.0, 6.0, 7.0, 8.0, 4.0, 3.0], "none": [None] * 4, "tie": [None, 2.0, 2.0, 3.0]}
    rows = [(date(2000, 1, 1), h, k, v, 9, leaf) for h, of in losses.items() for k, v in enumerate(of)]
    model = spark.createDataFrame(rows, boosting.MODEL)
    got = {r.horizon: (r.best_round, r.best_loss, r.rounds) for r in boosting.best_rounds(model, 3).collect()}
    assert got == {"long": (6, 3.0, 6), "short": (1, 5.0, 4), "none": (3, None, 3), "tie": (1, 2.0, 3)}
    kept = {r.horizon: [t["round"] for t in r.trees] for r in boosting.best_trees(model, 3).collect()}
    assert kept == {"long": [0, 1, 2, 3, 4, 5, 6], "short": [0, 1], "none": [0, 1, 2, 3], "tie": [0, 1]}


def test_the_late_fold_stops_the_rounds():
    x, y, w, late, key = data(3)
    y = np.where(late, -y, y)  # what is learnt is wrong later on
    s = Settings(**{**PLAIN.__dict__, "rounds": 50, "patience": 5})
    got = list(boosting.grown(x, y, w, late, key, [np.unique(c[~np.isnan(c)]) for c in x.T], s))
    losses = [t[1] for t in got[1:]]
    assert len(losses) - 1 - int(np.argmin(losses)) == 5


def panel(spark, dates, names=40):
    g = np.random.default_rng(2)
    rows = [(d, p, float(p), None if p % 7 == 0 else float(g.normal())) for d in dates for p in range(names)]
    return spark.createDataFrame(rows, "date date, permno bigint, a double, b double"), rows


def test_warm_start_goes_on_from_the_anchor_before(spark, tmp_path):
    dates = [date(2010, 1, 1) + timedelta(days=91 * k) for k in range(13)]
    features, rows = panel(spark, dates)
    y = {(d, p): 0.01 * a + (b or 0.0) * 0.02 + 0.001 * k for k, (d, p, a, b) in enumerate(rows)}
    passed = spark.createDataFrame([(d, p, "3mo", v) for (d, p), v in y.items()], "date date, permno bigint, horizon string, y double")
    s = Settings(**{**PLAIN.__dict__, "rounds": 3, "bins": 1024})
    model = learning.tree_models(features, passed, ["a", "b"], str(tmp_path), 1.0, 1.5, s, warm=True)
    trees = {(r.dt, r["round"]): boosting._as_nodes({"tree": r.tree}) for r in model.collect()}
    best = {r.dt: r.best_round for r in boosting.best_rounds(model).collect()}
    anchors = sorted(best)
    assert len(anchors) > 1
    base_trees = None
    for dt in anchors:
        train = [(d, p, a, b) for d, p, a, b in rows if dt - timedelta(days=365) <= d < dt and add_months(d, 3) <= dt]
        x = np.array([[a, np.nan if b is None else b] for *_, a, b in train])
        t = np.array([y[d, p] for d, p, *_ in train])
        age = np.array([(dt - d).days for d, *_ in train])
        w = np.maximum(np.exp(-np.log(2) * age / 365.2425 / 1.5), 1e-8)
        late = age <= 180
        late = late if late.any() and not late.all() else np.zeros(len(t), bool)
        margins, losses = by_hand(x, t, w, late, s, 3, None if base_trees is None else boosting.applied(base_trees, x))
        own = [trees[dt, k] for k in sorted(k for d, k in trees if d == dt)]
        assert len(own) == 3 + (1 if base_trees is None else len(base_trees)) and np.allclose(boosting.applied(own, x), margins[-1])
        base_trees = own[: best[dt] + 1]
    got = learning.tree_predictions(features, ["a", "b"], model, s)
    assert {r.date for r in got.collect()} == set(anchors)


def add_months(d, m):
    y, k = divmod(d.month - 1 + m, 12)
    last = [31, 29 if (d.year + y) % 4 == 0 else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][k]
    return date(d.year + y, k + 1, min(d.day, last))


def test_tree_ranking_has_every_anchor(spark, tmp_path):
    dates = [date(2010, 1, 1) + timedelta(days=91 * k) for k in range(13)]
    features, rows = panel(spark, dates)
    passed = spark.createDataFrame([(d, p, h, 0.01 * a) for d, p, a, _ in rows for h in ("3mo", "1y")], "date date, permno bigint, horizon string, y double")
    got = learning.tree_ranking(features, passed, ["a", "b"], str(tmp_path / "x"), 1.0, settings=Settings(rounds=5, depth=2, least_leaf=5)).collect()
    legal = {r.dt for r in learning.anchor_windows(features, 1.0).collect()}
    assert {r.date for r in got} == legal and len(got) == 40 * len(legal) > 0
    assert np.mean([r.permno for r in got if r.rank <= 5]) > 25
    for warm in (False, True):
        assert learning.tree_ranking(features.limit(0), passed, ["a", "b"], str(tmp_path / f"none{warm}"), 1.0, warm=warm).count() == 0


def walked(trees, x):
    """Sum of the trees' values, a row and a node at a time."""
    out = np.zeros(len(x))
    for tree in trees:
        for i, row in enumerate(x):
            k = 0
            while tree[k][0] >= 0:
                feature, threshold, nulls, left, right, _ = tree[k]
                k = left if (nulls if np.isnan(row[feature]) else row[feature] <= threshold) else right
            out[i] += tree[k][5]
    return out


@pytest.mark.parametrize("leaves,depth,more_than", [(31, 6, 20), (60, 8, 32), (90, 12, 64)])
def test_trees_by_bits_are_trees_by_nodes(leaves, depth, more_than):
    x, y, w, late, key = data(4, 2000)
    s = Settings(**{**PLAIN.__dict__, "rounds": 3, "leaves": leaves, "depth": depth, "least_leaf": 1, "l2": 0.01})
    y = np.random.default_rng(6).normal(size=2000)
    trees = [t[2] for t in boosting.grown(x, y, w, np.zeros(2000, bool), key, [np.unique(c[~np.isnan(c)]) for c in x.T], s)]
    assert max(sum(n[0] < 0 for n in t) for t in trees) > more_than
    assert np.allclose(boosting.applied(trees, x), walked(trees, x), rtol=0, atol=1e-14)
    edge = [[(0, float("inf"), False, 1, 2, 0.0), (-1, None, None, None, None, 1.0), (-1, None, None, None, None, 5.0)]]
    assert boosting.applied(edge, np.array([[3.0], [np.nan]])).tolist() == [1.0, 5.0]  # past the last threshold only nulls go right


def test_a_tree_sums_the_smaller_child_only(monkeypatch):
    x, y, w, late, key = data(5, 6000)
    summed, sums = [], boosting._sums
    monkeypatch.setattr(boosting, "_sums", lambda codes, features, joint, rows, *a: summed.append(len(rows)) or sums(codes, features, joint, rows, *a))
    s = Settings(rounds=1, leaves=31, depth=6, least_leaf=20, row_share=1.0, feature_share=1.0)
    edges = [np.quantile(c[~np.isnan(c)], np.arange(64) / 64) for c in x.T]
    got = list(boosting.grown(x, y, w, np.zeros(6000, bool), key, [np.unique(e) for e in edges], s))
    assert len(got[1][2]) > 40 and len(summed) > 20 and sum(summed) <= 6000 * (1 + 5 / 2)  # a level by level pass has 6 times the rows
    joint = boosting._joint(boosting.binned(x, edges, s.bins).T, np.arange(3), s.bins + 2)
    codes, rows = np.ascontiguousarray(boosting.binned(x, edges, s.bins, np.uint8).T), np.arange(6000)
    assert np.allclose(sums(codes, np.arange(3), joint, rows, y, w, s), sums(codes, np.arange(3), {}, rows, y, w, s), atol=1e-9)  # two features at once


def test_fits_that_fit_a_task_as_bytes_are_not_spread(spark, tmp_path, monkeypatch):
    rows = frame(spark, {(date(2000, 1, 1), h): data(i) for i, h in enumerate(("3mo", "6mo", "1y"))})
    s = Settings(rounds=4, leaves=6, depth=3, rate=0.3, least_leaf=4, bins=128)
    whole = lambda m: sorted((r.horizon, r["round"], r.late_loss or 0.0, str(r.tree)) for r in m.collect())
    want = whole(boosting.fitted(rows, ["a", "b", "c"], str(tmp_path / "one"), s))

    def fail(*_):
        raise AssertionError("spread")

    monkeypatch.setattr(boosting, "_spread", fail)
    got = boosting.fitted(rows, ["a", "b", "c"], str(tmp_path / "bytes"), Settings(**{**s.__dict__, "at_most": 20}))
    assert whole(got) == want and len(want) == 3 * 5
    assert len(set(boosting._slots(rows, 50))) == 50


def test_predictions_by_many_trees_of_several_models(spark):
    """Thresholds of all trees share one grid a feature: more of them than a byte holds, and others in each model."""
    x, y, w, _, key = data(7, 3000)
    x[:, 0] = np.where(np.isnan(x[:, 0]), np.nan, np.random.default_rng(9).normal(size=3000))
    edges = [np.unique(c[~np.isnan(c)]) for c in x.T]
    s = Settings(**{**PLAIN.__dict__, "rounds": 40, "leaves": 31, "depth": 6, "bins": 4000})
    models = [[t[2] for t in boosting.grown(x, of, w, np.zeros(3000, bool), key, edges, s)] for of in (y, -y * y)]
    forest = boosting.Forest(models[0], 3)
    assert len(forest.grids[0]) > 256
    now = spark.createDataFrame([(date(2000, 1, 1), p, *[None if np.isnan(v) else float(v) for v in x[p]]) for p in range(200)], "dt date, permno bigint, a double, b double, c double")
    trees = spark.createDataFrame([(date(2000, 1, 1), h, [(k, t) for k, t in enumerate(m)]) for h, m in zip(("3mo", "1y"), models)], f"dt date, horizon string, trees array<struct<round:int,tree:array<{boosting.NODE}>>>")
    got = {(r.horizon, r.permno): r.pred for r in boosting.predicted(now, ["a", "b", "c"], trees, 70).collect()}
    for h, m in zip(("3mo", "1y"), models):
        assert np.allclose([got[h, p] for p in range(200)], walked(m, x[:200]), rtol=0, atol=1e-12)
