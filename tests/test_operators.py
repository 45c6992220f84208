"""Operators on small frames: the edge cases of FIXTURES.md section 4."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import exprs as X
from panelspark.functions.windows import along, full_sum, sliding_members
from panelspark.operators import attribution, labels, learning, performance, portfolio, scores
from panelspark.operators.asof import asof_by_key, asof_calendar
from panelspark.operators.ratios import anchor_calendar, available, latest
from panelspark.operators.robust import robust_z
from panelspark.sources import tables as S

D = date


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_guarded_division(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, -2.0), (1.0, float("nan")), (1.0, float("inf")), (1.0, None), (None, 2.0)], "a double, b double")
    got = df.select(X.safe_div("a", "b"), X.pos_div("a", "b")).collect()
    assert [tuple(r) for r in got] == [(0.5, 0.5), (None, None), (-0.5, None), (None, None), (None, None), (None, None), (None, None)]


def test_dates(spark):
    df = spark.createDataFrame([("1999-12-31",), ("19991231",), ("14609",), ("x",), (None,), ("19991331",)], "t string")
    assert [r[0] for r in df.select(X.parse_any_date("t")).collect()] == [D(1999, 12, 31), D(1999, 12, 31), D(1999, 12, 31), None, None, None]
    assert spark.createDataFrame([(D(2000, 2, 29),)], "d date").select(X.anniversary("d")).first()[0] == D(2001, 2, 28)


def test_first_valid_and_means(spark):
    df = spark.createDataFrame([(None, 2.0, 3.0), (1.0, None, None), (None, None, None)], "a double, b double, c double")
    value, tag = X.first_valid([(X.is_finite("a"), F.col("a"), "A"), (X.is_finite("b"), F.col("b"), "B")])
    got = df.select(value, tag, X.weighted_mean(["a", "b", "c"], [0.5, 0.25, 0.25]), X.weighted_mean(["a", "b", "c"], [1, 1, 1], 2), X.count_present(["a", "b", "c"])).collect()
    assert [tuple(r) for r in got] == [(2.0, "B", 2.5, 2.5, 2), (1.0, "A", 1.0, None, 1), (None, "NA", None, None, 0)]


def test_total_return_and_growth(spark):
    df = spark.createDataFrame([(0.1, "-0.5"), (None, "S"), (None, None)], "r double, d string")
    assert [round(x[0], 9) for x in df.select(X.total_return("r", "d")).collect()] == [-0.45, 0.0, 0.0]
    z = spark.createDataFrame([(0.0, 1.0)], "a double, b double")
    assert z.select(X.log_growth([F.col("a"), F.col("b")], [F.col("b"), F.col("b")])).first()[0] is None


def test_full_window(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0])], "k int, t int, x double")
    assert [r[0] for r in df.select(full_sum(F.col("x"), along(["k"], ["t"]), 4), "t").orderBy("t").collect()] == [None, None, None, None, None, None, 22.0]


def test_sliding_members(spark):
    df = spark.createDataFrame([(0,), (2,)], "i int")
    assert rows(sliding_members(df, "i", F.lit(3), 3), "i", "window_end") == [(0, 2), (2, 2), (2, 3)]


def test_asof(spark):
    left = spark.createDataFrame([(1, D(2020, 1, 5)), (1, D(2020, 1, 1)), (2, D(2020, 1, 9)), (1, None)], "k int, d date")
    right = spark.createDataFrame([(1, D(2020, 1, 5), 5.0), (1, D(2020, 1, 2), 2.0), (1, None, 0.0)], "k int, t date, v double")
    got = {(r.k, r.d): (r.v, r.t_asof) for r in asof_by_key(left, right, ["k"], "d", "t", ["v"]).collect()}
    assert got == {(1, D(2020, 1, 5)): (5.0, D(2020, 1, 5)), (1, D(2020, 1, 1)): (None, None), (2, D(2020, 1, 9)): (None, None), (1, None): (None, None)}
    got = {r.d: r.out for r in asof_calendar(left.select("d").distinct(), "d", right, "t", "out", forward=True).collect()}
    assert got == {D(2020, 1, 5): D(2020, 1, 5), D(2020, 1, 1): D(2020, 1, 2), D(2020, 1, 9): None, None: None}


@pytest.mark.parametrize("values", [[1.0, 2.0, 3.0, 100.0], [5.0, 5.0, 5.0], [1.0, 1.0, 1.0, 9.0], [7.0], [None, None], [1.0, None, 3.0, float("inf")]])
def test_robust_z(spark, values):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, x double")
    got = [r.z for r in robust_z(df, ["k"], "x").orderBy("i").collect()]
    x = np.array([v for v in values if v is not None and math.isfinite(v)])
    if not len(x):
        assert got == [None] * len(values)
        return
    med = np.median(x)
    scale = 1.4826 * np.median(abs(x - med)) or (x.std(ddof=1) if len(x) > 1 else 0) or 1.0
    s = np.sort(x)
    lo, hi = (s[int((len(x) - 1) * q + 0.5)] for q in (0.01, 0.99))
    want = [None if v is None or not math.isfinite(v) else (min(max(v, lo), hi) - med) / scale for v in values]
    assert got == pytest.approx(want)


def test_point_in_time(spark):
    f = spark.createDataFrame(
        [("a", 1, D(2020, 3, 31), D(2020, 5, 1), None, None), ("a", 1, D(2020, 6, 30), None, None, None), ("b", 2, D(2020, 3, 31), D(2020, 4, 1), None, D(2020, 9, 27)), ("c", None, D(2020, 3, 31), D(2020, 4, 1), None, None)],
        "GVKEY string, LPERMNO bigint, DATADATE date, RDQ date, LINKDT date, LINKENDDT date",
    )
    asof = spark.createDataFrame([(D(2020, 9, 28),), (D(2020, 9, 27),)], "asof_date date")
    got = available(f, asof)
    assert rows(got.select("asof_date", "GVKEY", "DATADATE"), "asof_date", "GVKEY", "DATADATE") == [
        (D(2020, 9, 27), "a", D(2020, 3, 31)), (D(2020, 9, 27), "b", D(2020, 3, 31)), (D(2020, 9, 27), "c", D(2020, 3, 31)),
        (D(2020, 9, 28), "a", D(2020, 3, 31)), (D(2020, 9, 28), "a", D(2020, 6, 30)), (D(2020, 9, 28), "c", D(2020, 3, 31)),
    ]
    assert rows(latest(got).select("asof_date", "GVKEY", "DATADATE"), "asof_date", "GVKEY")[-1] == (D(2020, 9, 28), "a", D(2020, 6, 30))
    assert anchor_calendar(spark, 2020, 2021).count() == 8


@pytest.mark.parametrize("n", [0, 1, 2, 9, 10, 11, 25])
def test_deciles(spark, n):
    df = spark.createDataFrame([("m", D(2020, 1, 1), i, float(i // 2)) for i in range(n)] + [("m", D(2020, 1, 1), 0, -1.0)] * (n > 0), "model string, asof_date date, permno bigint, score double")
    got = portfolio.decile_selection(df).collect()
    up, down = {r.permno for r in got if r.signal == 1}, {r.permno for r in got if r.signal == -1}
    k = max(1, n // 10)
    assert not up & down
    assert (len(up), len(down)) == ((0, 0) if n == 0 else (1, 0) if n == 1 else (k, k))


def test_cohorts(spark):
    s = spark.createDataFrame([("m", D(2020, 4, 15), 1, 1), ("m", D(2021, 4, 20), 1, -1), ("m", D(2020, 2, 29), 2, 1)], "model string, asof_date date, permno bigint, signal int")
    assert rows(portfolio.cohorts(s), "asof_date") == [("m", D(2020, 2, 29), D(2021, 2, 28), 1, 0), ("m", D(2020, 4, 15), D(2021, 4, 20), 1, 0), ("m", D(2021, 4, 20), D(2022, 4, 20), 0, 1)]
    r = spark.createDataFrame([(1, D(2020, 4, 15), 0.5, None), (1, D(2020, 4, 16), 0.1, None), (1, D(2020, 4, 17), -1.0, None), (1, D(2021, 4, 20), 0.3, None)], "PERMNO bigint, DATE date, RET double, DLRET double")
    held = portfolio.held_returns(s, r).where("asof_date = date '2020-04-15'")
    assert [(x[0], round(x[1], 9)) for x in rows(held.select("DATE", "gross"), "DATE")] == [(D(2020, 4, 16), 1.1), (D(2020, 4, 17), 0.0)]
    assert portfolio.sleeves(portfolio.cohort_nav(s, r)).count() == 0  # no cohort has both legs


def test_weights_sum_to_one(spark):
    s = spark.createDataFrame([("m", D(2020, m, 1), p, 1 if p else -1) for m in (1, 4, 7) for p in range(m)], "model string, asof_date date, permno bigint, signal int")
    got = portfolio.live_weights(s).groupBy("rebal").agg(F.sum("w_long"), F.sum("w_short")).collect()
    assert all(r[2] == pytest.approx(1.0) for r in got) and {r[0] for r in got} == {D(2020, 4, 1), D(2020, 7, 1)}


def test_labels(spark):
    r = spark.createDataFrame([(1, D(2020, 1, d), 0.1) for d in (1, 2, 3)] + [(1, D(2020, 4, 1), -1.0), (1, D(2020, 7, 2), None)], "PERMNO bigint, DATE date, RET double")
    f = spark.createDataFrame([(D(2020, 1, 2), 1), (D(2020, 1, 3), 1), (D(2020, 1, 2), 9)], "date date, permno bigint")
    got = {(x.date, x.horizon): x.y for x in labels.forward_labels(f, r).collect()}
    assert got == {(D(2020, 1, 2), "3mo"): -1.0, (D(2020, 1, 3), "3mo"): -1.0, (D(2020, 1, 2), "6mo"): -1.0} and len(got) == 3 or (D(2020, 1, 2), "6mo") in got
    assert {h for _, h in {(x.date, x.horizon) for x in labels.forward_labels(f, r, truncated=True).collect()}} == {"3mo", "6mo", "1y"}


def test_drawdown_and_stats(spark):
    r = [0.1, -0.2, 0.05, 0.4, -0.1, -0.1]
    df = spark.createDataFrame([("m", "LS", D(2020, 1, 1 + i), x) for i, x in enumerate(r)] + [("up", "LS", D(2020, 1, 1 + i), 0.01) for i in range(3)], "model string, series string, DATE date, r double")
    got = {x.model: x for x in performance.max_drawdown(df).collect()}
    assert (round(got["m"].max_drawdown, 9), got["m"].dd_start, got["m"].dd_end) == (-0.2, D(2020, 1, 1), D(2020, 1, 2))
    assert (got["up"].max_drawdown, got["up"].dd_start, got["up"].dd_end) == (0.0, D(2020, 1, 1), D(2020, 1, 1))
    stats = {x.model: x for x in performance.performance_stats(df).collect()}
    a = np.array(r)
    assert stats["m"].ann_sharpe == pytest.approx(a.mean() / a.std(ddof=1) * math.sqrt(252)) and stats["m"].sortino == pytest.approx(a.mean() / np.minimum(a, 0).std(ddof=1) * math.sqrt(252))
    assert stats["up"].sortino is None


def test_hit_rates_leave_out_zero(spark):
    s = spark.createDataFrame([("m", D(2020, 1, 1), p, g) for p, g in ((1, 1), (2, 1), (3, -1), (4, -1))], "model string, asof_date date, permno bigint, signal int")
    r = spark.createDataFrame([(p, D(2020, 1, 2), x, None) for p, x in ((1, 0.1), (2, 0.0), (3, -0.1), (4, 0.2))], "PERMNO bigint, DATE date, RET double, DLRET double")
    assert rows(performance.hit_rates(s, r), "model") == [("m", 0.5, 0.5, 0.5)]


def test_regression(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(60, 6))
    y = 0.01 + x @ np.arange(6) * 0.1 + g.normal(size=60) * 0.1
    data = [("m", "LS", D(2020, 1, 1).fromordinal(737425 + i), *map(float, [y[i], *x[i]])) for i in range(60)]
    df = spark.createDataFrame(data, "model string, series string, DATE date, r double, " + ", ".join(f"{f} double" for f in attribution.FACTORS))
    few = df.limit(29).withColumn("model", F.lit("few"))
    flat = df.withColumn("model", F.lit("flat")).withColumn("Mom", F.lit(0.0))
    got = {r.model: r for r in attribution.ols_report(df.union(few).union(flat)).collect()}
    a = np.column_stack([np.ones(60), x])
    beta, rss = np.linalg.lstsq(a, y, rcond=None)[:2]
    se = np.sqrt(rss[0] / 53 * np.diag(np.linalg.inv(a.T @ a)))
    assert got["m"].alpha == pytest.approx(beta[0]) and got["m"].t_smb == pytest.approx(beta[2] / se[2]) and got["m"].R2 == pytest.approx(1 - rss[0] / ((y - y.mean()) ** 2).sum())
    assert got["few"].status == "too few days" and got["flat"].status == "collinear factors" and got["few"].alpha is None
    roll = attribution.rolling_alpha(df, 50).orderBy("DATE").collect()
    assert len(roll) == 11 and roll[-1].alpha == pytest.approx(252 * np.linalg.lstsq(a[-50:], y[-50:], rcond=None)[0][0])


def test_ridge_equals_direct_solution(spark):
    g = np.random.default_rng(5)
    x, y, age = g.normal(size=(80, 3)), g.normal(size=80), g.integers(1, 900, 80)
    dt = D(2020, 1, 1)
    df = spark.createDataFrame([(dt, dt.fromordinal(dt.toordinal() - int(a)), "1y", *map(float, v), float(t)) for a, v, t in zip(age, x, y)], "dt date, date date, horizon string, a double, b double, c double, y double")
    got = learning.ridge_coefficients(learning.ridge_moments(df, ["a", "b", "c"], 1.5), ["a", "b", "c"], 10.0).first()
    w = np.maximum(np.exp(-math.log(2) * age / 365.2425 / 1.5), 1e-8)
    wn = w / w.sum()
    mu, ybar = wn @ x, wn @ y
    std = np.sqrt(np.maximum(wn @ (x - mu) ** 2, 1e-12))
    z = (x - mu) / std
    beta = np.linalg.solve(z.T @ (z * w[:, None]) + 10 * np.eye(3), z.T @ (w * (y - ybar))) / std
    assert got.beta == pytest.approx(beta) and got.intercept == pytest.approx(ybar - mu @ beta)


def test_score_dynamics_needs_observations(spark):
    data = [(D(2020 + k // 4, 1 + 3 * (k % 4), 1), str(p), p, float(p + k * (p == 1))) for k in range(12) for p in range(4) if p != 3 or k < 7]
    got = {r.permno: r for r in scores.score_dynamics(spark.createDataFrame(data, "asof_date date, gvkey string, permno bigint, score double")).collect()}
    assert got[3].n_obs == 7 and got[3].slope_score is None and got[1].slope_score is not None


def test_sources(spark, tmp_path):
    lines = spark.createDataFrame([("banner, 2020",), (" 20200102, 1.50,-0.25",), ("20200103,x,1",), ("2020,1,2",), (None,)], "value string")
    assert rows(S.factor_file(lines, ["DATE", "a", "b"]), "DATE") == [(D(2020, 1, 2), 0.015, -0.0025), (D(2020, 1, 3), None, 0.01)]
    raw = spark.createDataFrame([("2020-01-02", 1), ("bad", 2), ("20210102", 3)], "DATE string, v int")
    S.ingest(raw, "DATE", str(tmp_path / "r"))
    assert S.scan_years(spark, str(tmp_path / "r"), 2021, 2021, ["v"]).collect()[0].v == 3
    assert "PartitionFilters: [isnotnull(year" in S.scan_years(spark, str(tmp_path / "r"), 2021, 2021)._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="lacks q"):
        S.require_columns(raw, ["v", "q"])
    panel = spark.createDataFrame([(D(2020, 1, 1), 1)], "asof_date date, v int")
    S.write_new(panel, str(tmp_path / "p"))
    S.write_new(panel.union(spark.createDataFrame([(D(2021, 1, 1), 2)], panel.schema)), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    level = spark.createDataFrame([("2020-01-01", 1.0), ("2020-01-02", 2.0)], "DATE string, level double")
    assert rows(S.return_series(level), "DATE") == [(D(2020, 1, 2), 1.0)]


def test_asof_ties_and_empty_tables(spark):
    left = spark.createDataFrame([(1, D(2020, 1, 5)), (1, D(2020, 1, 5))], "k int, d date")
    right = spark.createDataFrame([(1, D(2020, 1, 5), 2.0), (1, D(2020, 1, 5), 9.0), (1, D(2020, 1, 5), 5.0), (1, D(2020, 1, 9), 1.0), (1, D(2020, 1, 9), 3.0)], "k int, t date, v double").repartition(5)
    assert [r.v for r in asof_by_key(left, right, ["k"], "d", "t", ["v"]).collect()] == [9.0, 9.0]
    assert [r.v for r in asof_by_key(left, right, ["k"], "d", "t", ["v"], exact=False, forward=True).collect()] == [3.0, 3.0]
    assert [r.v for r in asof_by_key(left, right.limit(0), ["k"], "d", "t", ["v"]).collect()] == [None, None]
    assert asof_by_key(left.limit(0), right, ["k"], "d", "t", ["v"]).count() == 0
    timeless = spark.createDataFrame([(1, None), (None, D(2020, 1, 7))], left.schema)
    assert [r.v for r in asof_by_key(timeless, right, ["k"], "d", "t", ["v"], forward=True).collect()] == [None, None]
    assert [r.out for r in asof_calendar(left, "d", right.limit(0), "t", "out").collect()] == [None, None]


def test_operators_of_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    panel = none("model string, asof_date date, permno bigint, score double")
    picks, returns = portfolio.decile_selection(panel), none("PERMNO bigint, DATE date, RET double, DLRET double")
    daily = portfolio.daily_long_short(picks, returns)
    market = none("DATE date, mkt double")
    for df in (picks, portfolio.cohorts(picks), portfolio.cohort_nav(picks, returns), portfolio.live_weights(picks), daily, performance.performance_report(daily, market), performance.hit_rates(picks, returns), performance.max_drawdown(performance.legs(daily))):
        assert df.count() == 0
    features = none("date date, permno bigint, a double")
    found = labels.forward_labels(features, returns)
    assert found.count() == learning.ridge_ranking(features, found, ["a"]).count() == 0
    rated = none("asof_date date, gvkey string, permno bigint, score double")
    assert scores.investment_ranking(rated).count() == scores.score_features(rated).count() == 0


def test_repeated_rows_of_a_ranking_are_one_name(spark):
    """A name that a ranking repeats counts once, with its best score; repeated daily rows of a name compound as they stand."""
    data = [("m", D(2020, 1, 1), p, float(p)) for p in range(10)] + [("m", D(2020, 1, 1), 0, 99.0)]
    got = {(r.permno, r.signal) for r in portfolio.decile_selection(spark.createDataFrame(data, "model string, asof_date date, permno bigint, score double")).collect()}
    assert got == {(0, 1), (1, -1)}


def test_performance_report_has_the_market_on_the_same_days(spark):
    daily = spark.createDataFrame([("m", D(2020, 1, d), x, 0.0, x) for d, x in ((1, 0.1), (2, -0.2), (3, 0.3), (4, 0.1))], "model string, DATE date, long_ret double, short_ret double, ls_ret double")
    market = spark.createDataFrame([(D(2020, 1, d), x) for d, x in ((1, 0.01), (2, 0.02), (3, None), (4, -0.05), (9, 0.5))], "DATE date, mkt double")
    got = {r.series: r for r in performance.performance_report(daily, market).collect()}
    assert set(got) == {"LS", "LONG", "SHORT", "Mkt"} and {r.n_days for r in got.values()} == {3} and {r.end_date for r in got.values()} == {D(2020, 1, 4)}
    assert got["Mkt"].info_ratio is None and got["LS"].info_ratio is not None
    assert (got["Mkt"].dd_start, got["Mkt"].dd_end, round(got["Mkt"].max_drawdown, 9)) == (D(2020, 1, 2), D(2020, 1, 4), -0.05)


def test_short_leg_is_its_profit(spark):
    daily = spark.createDataFrame([("m", D(2020, 1, 1), 0.3, 0.1, 0.2)], "model string, DATE date, long_ret double, short_ret double, ls_ret double")
    assert {r.series: r.r for r in performance.legs(daily).collect()} == {"LS": 0.2, "LONG": 0.3, "SHORT": -0.1}


@pytest.mark.parametrize("n", [11, 12])
def test_a_fit_needs_twelve_anchors(spark, n):
    dates = [D(2010, 1, 1).fromordinal(D(2010, 1, 1).toordinal() + 150 * k) for k in range(n)]
    features = spark.createDataFrame([(d, 1) for d in dates] + [(None, 1)], "date date, permno bigint")
    got = {r.dt for r in learning.anchor_windows(features, 1.0).collect()}
    assert got == (set() if n < 12 else {d for d in dates if (d - dates[0]).days >= 365 + 365})


def test_rolling_window_of_any_length(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(1300, 6))
    y = g.normal(size=1300)
    day = D(2015, 1, 1).toordinal()
    df = spark.createDataFrame([("m", "LS", D.fromordinal(day + i), *map(float, [y[i], *x[i]])) for i in range(1300)], "model string, series string, DATE date, r double, " + ", ".join(f"{f} double" for f in attribution.FACTORS))
    a = np.column_stack([np.ones(1300), x])
    got = attribution.rolling_alpha(df).orderBy("DATE").collect()
    assert len(got) == 41 and got[7].alpha == pytest.approx(252 * np.linalg.lstsq(a[7:1267], y[7:1267], rcond=None)[0][0])
    assert attribution.rolling_alpha(df.limit(1259)).count() == 0


def test_fundamentals_ingest_and_file_sizes(spark, tmp_path):
    import pyarrow.parquet as pq

    raw = spark.createDataFrame([(str(k % 9), f"20{k % 2:02d}-03-31" if k % 3 else f"20{k % 2:02d}0331", float(k)) for k in range(9000)], "GVKEY string, DATADATE string, SALEQ double")
    S.ingest(raw, "DATADATE", str(tmp_path / "f"), rows_per_file=160, rows_per_group=50)
    files = list((tmp_path / "f").glob("year=*/*.parquet"))
    sizes = [pq.ParquetFile(f).metadata for f in files]
    assert sum(m.num_rows for m in sizes) == 9000 and max(m.num_rows for m in sizes) <= 160
    assert max(m.row_group(i).num_rows for m in sizes for i in range(m.num_row_groups)) <= 50
    S.ingest(raw.limit(0), "DATADATE", str(tmp_path / "none"))


def test_snapshots_by_year_and_by_tag(spark, tmp_path):
    panel = spark.createDataFrame([(D(y, 3, 1), y) for y in range(2018, 2023)], "asof_date date, v int")
    S.write_panel(panel, str(tmp_path / "p"))
    both = lambda *years: sorted(r.v for r in S.snapshots(spark, str(tmp_path / "p"), *years).collect())
    assert both() == [2018, 2019, 2020, 2021, 2022] and both(2020) == [2020, 2021, 2022] and both(2019, 2020) == [2019, 2020] and both(None, 2018) == [2018]
    (tmp_path / "q").mkdir()
    for tag in ("20200102", "20190331", "none"):
        panel.limit(1).toPandas()[["v"]].to_parquet(tmp_path / "q" / f"ratios_{tag}.parquet")
    assert sorted(str(r.asof_date) for r in S.tagged(spark.read.parquet(str(tmp_path / "q"))).collect()) == ["2019-03-31", "2020-01-02", "None"]


def test_series_and_report_sinks(spark, tmp_path):
    series = spark.createDataFrame([(m, s, D(2020, 1, d), 0.1) for m in "ab" for s in ("LS", "LONG", "SHORT") for d in (2, 1)], "model string, series string, DATE date, r double")
    S.write_series(series, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.where("model = 'a' and leg = 'LONG'").count() == 2 and back.count() == 12
    S.write_report(series.groupBy("model").count(), str(tmp_path / "r"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "r")).orderBy("model").collect()] == [("a", "6"), ("b", "6")]
    assert len(list((tmp_path / "r").glob("*.csv"))) == 1
    named = spark.createDataFrame([("2020-01-02", "0.5"), ("20200103", "x"), ("bad", "1"), (None, "2")], "DATE string, ret string")
    assert rows(S.return_series(named, "ret"), "DATE") == [(D(2020, 1, 2), 0.5)]


def test_stages_follow_their_tables(spark, tmp_path):
    from panelspark.plans.stages import stage

    path = str(tmp_path / "t")
    read = lambda: stage(spark, path, "copy", lambda: spark.read.parquet(path)).count()
    spark.range(3).write.parquet(path)
    assert read() == read() == 3
    spark.range(2).write.mode("append").parquet(path)
    assert read() == 5


def test_equal_names_tie_whatever_the_order_of_their_rows(spark, monkeypatch):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ in their last bit: not in rank."""
    day, names = D(2000, 1, 1), {1: -1, 2: 1}  # the second name's rows come in the order of the sums
    of = lambda features: [(day, str(p), p, f, z) for p, step in names.items() for f, z in list(zip(features, (0.1, 0.2, 0.3)))[::step]]
    shape = "asof_date date, gvkey string, permno bigint, feature string, z double"
    both = [*of(scores.PILLARS["P"]), *of(scores.PILLARS["V"])]
    monkeypatch.setattr(scores, "standardised", lambda _: spark.createDataFrame(both, shape).coalesce(1).withColumn("pillar", F.when(F.col("feature").isin(*scores.PILLARS["P"]), "P").otherwise("V")))
    got = rows(scores.anchor_ranking(None), "rank")
    assert [r[3] for r in got] == [1, 2] and got[0][4] == got[1][4] == pytest.approx(0.2)
    measures = ("slope_score", "avg_score", "vol_dscore")
    monkeypatch.setattr(scores, "score_dynamics", lambda *_: spark.createDataFrame([(day, "1", 1, 0.0, 0.0, 0.0)], "asof_date date, gvkey string, permno bigint, slope_score double, avg_score double, vol_dscore double"))
    monkeypatch.setattr(scores, "robust_z", lambda *_: spark.createDataFrame(of(measures), shape).coalesce(1))
    got = rows(scores.investment_ranking(None), "rank")
    assert [r[3] for r in got] == [1, 2] and got[0][4] == got[1][4] == pytest.approx(0.2)
