"""Plans and mechanisms of panels: one pass, runtime pruning, buckets, densification, incremental writes, files by name, exact medians."""

import re
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import labels, learning, portfolio, ratios
from panelspark.plans import queries as plans
from panelspark.sources import tables as S

from .conftest import DATA

D = date


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines_of(tree):
    """(depth, node) of each line of a plan."""
    found = (re.match(r"([\s:+*()\d-]*)(.+)", line) for line in tree.split("\n"))
    return [(len(m[1]), m[2]) for m in found if m]


def exchanges_above(tree, marker):
    """How many shuffles stand above the scans that read `marker`."""
    out, stack = [], []
    for depth, node in lines_of(tree):
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, node))
        if "FileScan" in node and marker in node:
            out.append(sum("Exchange hashpartitioning" in n for _, n in stack))
    return out


@pytest.fixture(scope="module")
def panels(spark):
    p = plans.Panels(spark, DATA)
    p.selection, p.labels, p.fundamentals  # noqa: B018 written now
    return p


def test_labels_shuffle_the_daily_panel_once(spark, panels):
    plain = spark.read.parquet(panels.returns_d.inputFiles()[0].rsplit("/", 1)[0])  # without its buckets
    tree = plan(labels.forward_labels(panels.features, plain))
    assert len([x for x in exchanges_above(tree, "RET")]) == 1 and exchanges_above(tree, "RET") == [1]
    assert exchanges_above(plan(labels.forward_labels(panels.features, panels.returns_d)), "RET") in ([1], [0])


def test_labels_of_many_probes(spark):
    returns = spark.createDataFrame([(1, D(2020, 1, 1) + timedelta(days=k), 0.01 if k else None) for k in range(200)] + [(2, D(2020, 3, 1), -1.0), (2, D(2020, 1, 5), 0.5), (2, D(2020, 1, 5), 0.5), (None, D(2020, 1, 1), 0.1), (3, None, 0.1)], "PERMNO bigint, DATE date, RET double")
    features = spark.createDataFrame([(D(2020, 1, 1), 1), (D(2020, 1, 1), 1), (D(2019, 12, 31), 1), (D(2020, 1, 5), 2), (D(2020, 1, 5), 9), (None, 1), (D(2020, 1, 5), None)], "date date, permno bigint")
    got = {(r.date, r.permno, r.horizon): r.y for r in labels.forward_labels(features, returns).collect()}
    assert got.keys() == {(D(2020, 1, 1), 1, "3mo"), (D(2020, 1, 1), 1, "6mo"), (D(2020, 1, 5), 2, "3mo"), (D(2020, 1, 5), 2, "6mo")}
    assert got[D(2020, 1, 1), 1, "3mo"] == pytest.approx(1.01**91 - 1) and got[D(2020, 1, 5), 2, "3mo"] == -1.0
    young = {(r.date, r.horizon): r.y for r in labels.forward_labels(features.where("permno = 1"), returns, truncated=True).collect()}
    assert young[D(2020, 1, 1), "1y"] == pytest.approx(1.01**199 - 1)


def test_years_reach_the_scan_of_fundamentals(panels):
    tree = plan(ratios.available(panels.fundamentals, panels.asof.where("asof_date < '1997-01-01'")))
    assert "dynamicpruning" in tree and "partition" in tree.lower()


def test_bucketed_panel_is_not_shuffled(panels, spark):
    assert exchanges_above(plan(plans.QUERIES["cum_log_return"](spark, DATA)), "RET") == [0]
    held = plan(portfolio.held_returns(panels.selection, panels.returns_d))
    assert exchanges_above(held, "RET") == [0]
    assert exchanges_above(plan(portfolio.cohort_nav(panels.selection, panels.returns_d)), "RET") == [1]  # the sums by day


def test_carry_forward(spark):
    selection = spark.createDataFrame([("m", D(2020, 1, 1), 1, 1), ("m", D(2020, 1, 1), 2, 1), ("m", D(2020, 1, 1), 3, -1)], "model string, asof_date date, permno bigint, signal int")
    rows = [(1, D(2020, 1, k), 0.1, None) for k in (2, 3, 6)] + [(2, D(2020, 1, 2), 0.5, None)] + [(3, D(2020, 1, k), 0.0, None) for k in (3, 6)]
    returns = spark.createDataFrame(rows, "PERMNO bigint, DATE date, RET double, DLRET double")
    nav = lambda carry: {r.DATE.day: (r.nav_long, r.nav_short) for r in portfolio.cohort_nav(selection, returns, carry=carry).collect()}
    stops, carried = nav(False), nav(True)
    assert stops[6][0] == pytest.approx(1.1**3) and carried[6][0] == pytest.approx((1.1**3 + 1.5) / 2)
    assert carried[2] == stops[2] == (pytest.approx(1.3), None) and carried[3][0] == pytest.approx((1.1**2 + 1.5) / 2) and carried[3][1] == 1.0
    assert portfolio.cohort_nav(selection, returns.limit(0), carry=True).count() == 0


def test_carried_positions_are_not_laid_out_over_days(panels):
    """The daily panel is read once, and only sums by day are shuffled."""
    tree = plan(portfolio.cohort_nav(panels.selection, panels.returns_d, carry=True))
    assert exchanges_above(tree, "RET") == [2]  # the sums by day, and their order within a cohort


def test_carried_sums_against_days(spark):
    g = np.random.default_rng(8)
    picks = [("m", D(2020, 1, 1), p, 1 if p < 6 else -1) for p in range(10)]
    moves = {p: {int(k): float(g.normal() * 0.1) for k in g.choice(np.arange(2, 29), g.integers(1, 9), replace=False)} for p in range(9)}  # the tenth has no rows
    rows = [(p, D(2020, 1, k), r, None) for p, own in moves.items() for k, r in own.items()]
    nav = portfolio.cohort_nav(spark.createDataFrame(picks, "model string, asof_date date, permno bigint, signal int"), spark.createDataFrame(rows, "PERMNO bigint, DATE date, RET double, DLRET double").repartition(5), carry=True)
    want = {}
    for day in sorted({k for own in moves.values() for k in own}):
        value = {p: np.prod([1 + r for k, r in own.items() if k <= day]) for p, own in moves.items() if min(own) <= day}
        mean = lambda side: pytest.approx(np.mean(side), abs=1e-12) if side else None
        want[day] = (mean([v for p, v in value.items() if p < 6]), mean([v for p, v in value.items() if p >= 6]))
    assert {r.DATE.day: (r.nav_long, r.nav_short) for r in nav.collect()} == want


def test_incremental_write_mends_a_half_written_date(spark, tmp_path):
    path = str(tmp_path / "panel")
    rows = spark.createDataFrame([(D(2020, 1, d), k, 1.0) for d in (1, 2, 3) for k in range(4)] + [(None, 9, 1.0)], "asof_date date, permno bigint, v double")
    S.write_new(rows.where("asof_date = '2020-01-01'"), path)
    half = rows.where("asof_date = '2020-01-02' and permno < 2").withColumn("_on", F.lit("2020-01-02"))
    half.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_on").parquet(path)
    assert S.read_new(spark, path).count() == 4  # the half does not show
    S.write_new(rows.withColumn("v", F.col("v") * 2), path)
    got = sorted((r.asof_date.day, r.permno, r.v) for r in S.read_new(spark, path).collect())
    assert got == [(d, k, 1.0 if d == 1 else 2.0) for d in (1, 2, 3) for k in range(4)]  # the finished date is as it was
    before = S.finished(spark, path).collect()
    S.write_new(rows, path)
    assert sorted(S.finished(spark, path).collect()) == sorted(before) and S.read_new(spark, path).count() == 12
    S.write_new(rows.limit(0), str(tmp_path / "none"))
    assert S.finished(spark, str(tmp_path / "none")).count() == 0


def test_files_by_name(spark, tmp_path):
    path = str(tmp_path / "files")
    rows = spark.createDataFrame([(D(y, 4, 15), k) for y in (1998, 1999, 2000) for k in range(3)], "asof_date date, k int")
    S.write_tagged(rows, path, "ratios")
    rows.drop("asof_date").coalesce(1).write.parquet(str(tmp_path / "other"))
    got = S.tagged_snapshots(spark, path, 1999, 2000)
    assert sorted((r.asof_date.year, r.k) for r in got.collect()) == [(y, k) for y in (1999, 2000) for k in range(3)]
    scans = got._jdf.queryExecution().executedPlan().collectLeaves()
    read = sum(scans.apply(i).metrics().apply("numFiles").value() for i in range(scans.size()) if scans.apply(i).metrics().contains("numFiles"))
    assert read == 2  # of three files; the third is not listed to be read
    assert S.tagged_snapshots(spark, str(tmp_path / "other")).count() == 0


def test_factor_lines(spark, tmp_path):
    lines = ["Banner, 1999", ",Mom", " 20200101, 1.5", "20200102,x", "202001, 2.0", "  2020, 3.0", "20201340,1", "20200103", ""]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / "f"))
    got = S.factor_lines(spark, str(tmp_path / "f"), S.MOM).collect()
    assert [(r.DATE.day, r.Mom) for r in got if r.DATE] == [(1, pytest.approx(0.015)), (2, None)]
    assert sorted(r.rejected for r in got if r.rejected is not None) == sorted(x for x in lines if x not in (" 20200101, 1.5", "20200102,x"))


@pytest.mark.parametrize("parts", [1, 8])
def test_long_series_in_parts(spark, parts):
    g = np.random.default_rng(1)
    level = [float(x) if i % 13 else None for i, x in enumerate(g.random(400) + 1)]
    days = [D(2000, 1, 1) + timedelta(days=int(k)) for k in np.sort(g.choice(3000, 400, replace=False))]
    rows = spark.createDataFrame(list(zip(days, level)), "DATE date, level double").repartition(7)
    got = {r.DATE: r.r for r in S.long_series_return(rows, parts).collect()}
    want = {d: b / a - 1 for d, a, b in zip(days[1:], level, level[1:]) if a is not None and b is not None}
    assert got == pytest.approx(want)
    assert S.long_series_return(rows.limit(0), parts).count() == 0


def test_exact_medians(spark):
    g = np.random.default_rng(3)
    rows = [(k % 3, float(a), None if k % 3 == 2 else float(b)) for k, (a, b) in enumerate(zip(g.normal(size=4001), g.integers(0, 3, 4001)))] + [(7, None, 1.0), (8, 5.0, 5.0), (8, 6.0, None)]
    frame = spark.createDataFrame(rows, "g int, a double, b double")
    want = {r.g: (r.a, r.b) for r in frame.groupBy("g").agg(F.median("a").alias("a"), F.median("b").alias("b")).collect()}
    for accuracy in (10_000, 20):  # a coarse sketch too
        got = {r.g: (r.med_a, r.med_b) for r in learning.selected_medians(frame, ["g"], ["a", "b"], accuracy).collect()}
        assert got == want


def test_released_stages_are_made_anew(spark, tmp_path):
    from panelspark.plans import stages

    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    known = dict(stages._WRITTEN)
    try:
        stages._WRITTEN.clear()
        made = stages.stage(spark, path, "copy", lambda: spark.read.parquet(path))
        bucketed = stages.bucketed_stage(spark, path, "by_id", lambda: spark.read.parquet(path).withColumn("k", F.col("id") % 2), "k", "id")
        files = made.inputFiles() + bucketed.inputFiles()
        assert made.count() == bucketed.count() == 5 and len(stages._WRITTEN) == 2
        stages.release(spark)
        where = spark._jvm.org.apache.hadoop.fs.Path
        assert not stages._WRITTEN and not any(where(f).getFileSystem(spark._jsc.hadoopConfiguration()).exists(where(f)) for f in files)
        assert stages.stage(spark, path, "copy", lambda: spark.read.parquet(path)).count() == 5
    finally:
        stages._WRITTEN.update(known)
