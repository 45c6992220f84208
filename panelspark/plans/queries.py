"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.windows import along, change, full_mean, full_sum, period_return, running_log_return, running_product
from ..operators import asof, attribution, boosting, labels, learning, performance, portfolio, ratios, robust, scores
from ..sources import adapters as A
from ..sources import tables as S
from .sql import YEARS, labels as labels_sql, query, robust as robust_sql
from .stages import bucketed_stage, shared_dir, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: Years of history: the first score window ends in late 1998, and three more years would leave no anchor.
RATIO_YEARS, SCORE_YEARS = 3.0, 1.0
ROLLING = 1260


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = query(sql)
        return f

    return add


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(*names: str, digits: int = 9) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


class Panels:
    """The panels of one session and folder, and what the operators make of them; each is a stage that is written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.source, self.lines = spark, f"{sf_dir.rstrip('/')}/lineitem.parquet", A.table(spark, sf_dir, "lineitem")

    def _stage(self, name: str, build: Callable[[], DataFrame], write: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
        return stage(self.spark, self.source, name, build, write)

    anchors = property(lambda self: ratios.anchor_calendar(self.spark, *YEARS))
    asof = property(lambda self: ratios.asof_days(self.anchors, self.returns_m))
    returns_d = property(lambda self: bucketed_stage(self.spark, self.source, "returns_d", lambda: A.returns_d(self.lines), "PERMNO", "DATE"))
    returns_m = property(lambda self: self._stage("returns_m", lambda: A.returns_m(self.lines)))
    fundamentals = property(lambda self: self._stage("fundamentals", lambda: A.fundamentals_q(self.lines).withColumn("year", F.year("DATADATE")), lambda df, to: df.write.partitionBy("year").parquet(to)))
    factors = property(lambda self: self._stage("factors", lambda: A.factors_d(self.lines)))
    ratios = property(lambda self: self._stage("ratios", lambda: ratios.fundamental_ratios(self.fundamentals, self.returns_m, self.anchors)))
    composite = property(lambda self: self._stage("composite", lambda: scores.composite(self.ratios)))
    ranking = property(lambda self: scores.ranked(self.composite))
    invest = property(lambda self: self._stage("invest", lambda: scores.investment_ranking(self.ranking)))
    features = property(lambda self: self.ratios.withColumnRenamed("asof_date", "date"))
    labels = property(lambda self: self._stage("labels", lambda: labels.forward_labels(self.features, self.returns_d)))
    score_features = property(lambda self: self._stage("score_features", lambda: scores.score_features(self.ranking)))
    score_labels = property(lambda self: self._stage("score_labels", lambda: labels.forward_labels(self.score_features, self.returns_d)))
    ridge_ratios = property(lambda self: self._stage("ridge_ratios", lambda: learning.ridge_ranking(self.features, self.labels, learning.RATIO_FEATURES, RATIO_YEARS)))
    ridge_scores = property(lambda self: self._stage("ridge_scores", lambda: learning.ridge_ranking(self.score_features, self.score_labels, learning.SCORE_FEATURES, SCORE_YEARS)))
    model_ratios = property(lambda self: self._models("model_ratios", self.features, self.labels, learning.RATIO_FEATURES, RATIO_YEARS))
    model_scores = property(lambda self: self._models("model_scores", self.score_features, self.score_labels, learning.SCORE_FEATURES, SCORE_YEARS))
    model_warm = property(lambda self: self._models("model_warm", self.features, self.labels, learning.RATIO_FEATURES, RATIO_YEARS, True))
    trees_ratios = property(lambda self: self._stage("trees_ratios", lambda: learning.tree_predictions(self.features, learning.RATIO_FEATURES, self.model_ratios)))
    trees_scores = property(lambda self: self._stage("trees_scores", lambda: learning.tree_predictions(self.score_features, learning.SCORE_FEATURES, self.model_scores)))
    selection = property(lambda self: self._stage("selection", self._select))
    tree_selection = property(lambda self: self._stage("tree_selection", lambda: portfolio.decile_selection(self._learnt("trees", self.trees_ratios).union(self._learnt("trees_scores", self.trees_scores)))))
    daily = property(lambda self: self._stage("daily", lambda: portfolio.daily_long_short(self.selection, self.returns_d)))
    series = property(lambda self: performance.legs(self.daily))
    market = property(lambda self: self.factors.select("DATE", F.col("Mkt_RF").alias("mkt")))

    def _folder(self, name: str) -> str:
        return f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"

    def _models(self, name: str, features: DataFrame, labels: DataFrame, columns: tuple[str, ...], years: float, warm: bool = False) -> DataFrame:
        """The model table of all fits."""
        return self._stage(name, lambda: learning.tree_models(features, labels, columns, self._folder(name), years, warm=warm))

    @staticmethod
    def _learnt(model: str, ranking: DataFrame) -> DataFrame:
        return ranking.select(F.lit(model).alias("model"), F.col("date").alias("asof_date"), "permno", F.col("pred_12m").alias("score"))

    def _select(self) -> DataFrame:
        """Deciles of the rankings that SQL can check; those of the trees are in `tree_selection`."""
        rule = [d.select(F.lit(m).alias("model"), "asof_date", "permno", "score") for m, d in (("composite", self.ranking), ("investment", self.invest))]
        learnt = [self._learnt("ridge", self.ridge_ratios), self._learnt("ridge_scores", self.ridge_scores)]
        return portfolio.decile_selection(rule[0].union(rule[1]).union(learnt[0]).union(learnt[1]))


@registered("SELECT PERMNO, DATE, year(DATE)::INT AS year, CAST(count(*) OVER (PARTITION BY year(DATE)) AS BIGINT) AS year_rows FROM returns_d")
def ingest_year_derivation(spark, d):
    """Dates arrive as ISO text, yyyymmdd numbers and days since 1960, by security."""
    p = Panels(spark, d).returns_d
    k = F.col("PERMNO") % 3
    raw = p.withColumn("DATE", F.when(k == 0, F.col("DATE").cast("string")).when(k == 1, F.date_format("DATE", "yyyyMMdd")).otherwise(F.datediff("DATE", F.lit("1960-01-01")).cast("string")))
    return S.with_year(raw, "DATE").select("PERMNO", "DATE", "year", F.count("*").over(W.partitionBy("year")).alias("year_rows"))


@registered(f"SELECT PERMNO, DATE, {r('RET')} FROM returns_d WHERE year(DATE) BETWEEN 1996 AND 1997 AND DATE <= DATE '1997-06-30'")
def partition_pruned_scan(spark, d):
    """The daily panel written by year and read again: years reach the scan as partitions, columns and dates too."""
    p = Panels(spark, d)
    path = p._stage("returns_by_year", lambda: p.returns_d, lambda df, to: S.ingest(df, "DATE", to)).inputFiles()[0].split("/year=")[0]
    return rounded(S.scan_years(spark, path, 1996, 1997, ["PERMNO", "DATE", "RET"]).where(F.col("DATE") <= F.lit("1997-06-30").cast("date")))


@registered(f"SELECT GVKEY, DATADATE, year(DATADATE)::INT AS year, {r('SALEQ', digits=2)} FROM fundamentals_q WHERE year(DATADATE) BETWEEN 1997 AND 1999")
def fundamentals_ingest(spark, d):
    """Fundamentals whose dates arrive as text in two forms, written by year, and the snapshots of some years."""
    f = Panels(spark, d).fundamentals.drop("year")
    text = F.when(F.col("LPERMNO") % 2 == 0, F.col("DATADATE").cast("string")).otherwise(F.date_format("DATADATE", "yyyyMMdd"))
    p = Panels(spark, d)
    path = p._stage("fundamentals_by_year", lambda: f.withColumn("DATADATE", text), lambda df, to: S.ingest(df, "DATADATE", to, rows_per_file=800_000, rows_per_group=200_000)).inputFiles()[0].split("/year=")[0]
    return rounded(S.snapshots(spark, path, 1997, 1999).select("GVKEY", "DATADATE", "year", "SALEQ"), 2)


@registered(f"SELECT DATE, {r('Mkt_RF', 'SMB', 'HML', 'RMW', 'CMA', 'RF', 'Mom', digits=8)} FROM factors_d")
def factor_table(spark, d):
    """Factors written as lines of text in percent, read again line by line (S8, RG1)."""
    f = Panels(spark, d).factors
    text = lambda cols: f.select(F.concat_ws(",", F.date_format("DATE", " yyyyMMdd"), *[F.format_string("%.8f", F.col(c) * 100) for c in cols]).alias("value"))
    banner = f.limit(1).select(F.lit("Copyright, percent; 1999,not a day").alias("value"))
    five = S.factor_file(text(S.FF5[1:]).union(banner), S.FF5)
    return rounded(S.factor_table(five, S.factor_file(text(S.MOM[1:]).union(banner), S.MOM)), 8)


def _factor_files(p: Panels) -> str:
    """The two factor files as a provider writes them: banner, header, days in percent, a table of years, footer."""
    folder, f = p._folder("factor_files"), p.factors
    single = lambda *texts: p.spark.createDataFrame([(t,) for t in texts], "value string")
    years = f.groupBy(F.year("DATE").alias("year")).agg(F.avg("RF").alias("RF"))
    years = years.select(F.concat_ws(",", F.format_string("  %d", "year"), F.format_string("%.4f", "RF")).alias("value"))
    for name, columns in (("five", S.FF5), ("mom", S.MOM)):
        percent = [F.format_string("%.8f", F.col(c) * 100) for c in columns[1:]]
        days = f.select(F.concat_ws(",", F.date_format("DATE", " yyyyMMdd"), *percent).alias("value"))
        head, foot = single("Made from daily returns", f",{','.join(columns[1:])}"), single(" Annual averages", "20011399,1,1,1,1,1,1", "Copyright")
        head.union(days).union(years).union(foot).write.text(f"{folder}/{name}")
    return folder


@registered(f"SELECT DATE, {r('Mkt_RF', 'SMB', 'HML', 'RMW', 'CMA', 'RF', 'Mom', digits=8)} FROM factors_d")
def factor_files(spark, d):
    """Both factor files written as text with banners and annual tables, read from disk and joined (S8, RG1)."""
    folder = _factor_files(Panels(spark, d))
    five, momentum = (S.factor_lines(spark, f"{folder}/{name}", columns).where("rejected is null") for name, columns in (("five", S.FF5), ("mom", S.MOM)))
    return rounded(S.factor_table(five.drop("rejected"), momentum), 8)


@registered("""SELECT file, (SELECT count(*) FROM factors_d) AS days, 5 + (SELECT count(DISTINCT year(DATE)) FROM factors_d) AS rejected
FROM (VALUES ('five'), ('mom')) AS f(file)""")
def factor_file_rejects(spark, d):
    """How many lines of each factor file are days, and how many are not."""
    folder = _factor_files(Panels(spark, d))
    counted = [S.factor_lines(spark, f"{folder}/{name}", columns).agg(F.count("DATE").alias("days"), F.count("rejected").alias("rejected")).select(F.lit(name).alias("file"), "days", "rejected") for name, columns in (("five", S.FF5), ("mom", S.MOM))]
    return counted[0].union(counted[1])


@registered(f"SELECT asof_date, permno, {r('MB')} FROM ratios WHERE year(asof_date) BETWEEN 1998 AND 1999")
def snapshot_files(spark, d):
    """A file a snapshot, named by its date; those of some years, pruned by their names."""
    p = Panels(spark, d)
    folder = p._folder("snapshot_files")
    S.write_tagged(p.ratios.select("asof_date", "permno", "MB"), folder, "ratios")
    return rounded(S.tagged_snapshots(spark, folder, 1998, 1999).select("asof_date", "permno", "MB"))


@registered(f"SELECT asof_date, permno, {r('MB')} FROM ratios")
def incremental_snapshots(spark, d):
    """Snapshots to 1998, then a run that dies within 1999, then one over all years: each snapshot is there once and whole."""
    p = Panels(spark, d)
    rows, folder = p.ratios.select("asof_date", "permno", "MB"), p._folder("incremental")
    S.write_new(rows.where(F.year("asof_date") <= 1998), folder)
    half = rows.where((F.year("asof_date") == 1999) & (F.col("permno") % 2 == 0)).withColumn("_on", F.date_format("asof_date", "yyyy-MM-dd"))
    half.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_on").parquet(folder)
    S.write_new(rows, folder)
    return rounded(S.read_new(spark, folder).select("asof_date", "permno", "MB"))


@registered(f"""SELECT DATE, {r('r')} FROM (SELECT DATE, avg(RET) AS r FROM returns_d GROUP BY DATE) WHERE r IS NOT NULL AND month(DATE) <> 2""")
def return_series_reader(spark, d):
    """A series whose dates and numbers arrive as text, some of them no numbers, read with a check of its columns."""
    p = Panels(spark, d)
    folder = p._folder("series_text")
    daily = p.returns_d.groupBy("DATE").agg(F.avg("RET").alias("r"))
    number = F.when(F.month("DATE") == 2, "n.a.").otherwise(F.col("r").cast("string"))
    daily.select(F.col("DATE").cast("string").alias("DATE"), number.alias("ret")).write.option("header", True).csv(folder)
    return rounded(S.return_series(spark.read.option("header", True).csv(folder), "ret"))


@registered(f"""SELECT PERMNO, DATE, {r('total')} FROM (SELECT PERMNO, DATE, (1 + coalesce(RET, 0)) * (1 + CASE WHEN PERMNO % 14 = 0 THEN 0 ELSE coalesce(DLRET, 0) END) - 1 AS total FROM returns_d)""")
def text_delisting_returns(spark, d):
    """Delisting returns that arrive as text, with letters in place of some: those count as null."""
    p = Panels(spark, d).returns_d
    text = F.when(F.col("PERMNO") % 14 == 0, "A").otherwise(F.col("DLRET").cast("string"))
    return rounded(p.withColumn("DLRET", text).select("PERMNO", "DATE", X.total_return("RET", "DLRET").alias("total")))


@registered(f"""SELECT DATE, {r('r')} FROM (SELECT DATE, level / lag(level) OVER (ORDER BY DATE) - 1 AS r
FROM (SELECT DATE, sum(1 + coalesce(RET, 0)) AS level FROM returns_d GROUP BY DATE)) WHERE r IS NOT NULL""")
def long_series_return(spark, d):
    """Changes of one series cut into parts by date."""
    levels = Panels(spark, d).returns_d.groupBy("DATE").agg(F.sum(1 + F.coalesce("RET", F.lit(0.0))).alias("level"))
    return rounded(S.long_series_return(levels))


@registered(f"SELECT * FROM (SELECT PERMNO, DATE, {r('x')} FROM (SELECT PERMNO, DATE, PRC / lag(PRC) OVER (PARTITION BY PERMNO ORDER BY DATE) - 1 AS x FROM returns_m)) WHERE x IS NOT NULL")
def level_to_return(spark, d):
    p = Panels(spark, d).returns_m
    return rounded(p.select("PERMNO", "DATE", period_return(F.col("PRC"), along(["PERMNO"], ["DATE"])).alias("x")).where("x is not null"))


@registered(f"""SELECT GVKEY, DATADATE, {r('margin', 'leverage', 'sales')} FROM (SELECT GVKEY, DATADATE, CASE WHEN SALEQ > 0 THEN coalesce(SALEQ - COGSQ, OIBDPQ + XSGAQ) / SALEQ END AS margin,
CASE WHEN SEQQ <> 0 THEN coalesce(DLCQ, 0) / SEQQ END AS leverage, CASE WHEN coalesce(ATQ, 0) > 0 THEN SALEQ / coalesce(ATQ, 0) END AS sales FROM fundamentals_q)""")
def safe_ratio_projection(spark, d):
    f = Panels(spark, d).fundamentals
    gross = F.coalesce(F.col("SALEQ") - F.col("COGSQ"), F.col("OIBDPQ") + F.col("XSGAQ"))
    return rounded(f.select("GVKEY", "DATADATE", X.pos_div(gross, "SALEQ").alias("margin"), X.safe_div(X.or_zero("DLCQ"), "SEQQ").alias("leverage"), X.pos_div("SALEQ", X.or_zero("ATQ")).alias("sales")))


@registered(f"SELECT asof_date, GVKEY, EV_src, {r('EV_FLEX', 'EV_A', digits=4)} FROM ev WHERE LPERMNO IS NOT NULL")
def flex_cascade_provenance(spark, d):
    p = Panels(spark, d)
    base = ratios.latest(ratios.quarterly_measures(ratios.available(p.fundamentals, p.asof)))
    price = ratios.snapshots(p.returns_m, p.asof).withColumnRenamed("PERMNO", "LPERMNO")
    df = base.join(price, ["asof_date", "LPERMNO"], "left").withColumn("MC_mn", X.market_cap("PRC", "SHROUT"))
    return rounded(ratios.enterprise_value(df).select("asof_date", "GVKEY", "EV_src", "EV_FLEX", "EV_A"), 4)


@registered("SELECT asof_date, core_non_null, count(*) AS n FROM ratios GROUP BY 1, 2")
def core_non_null(spark, d):
    return Panels(spark, d).ratios.groupBy("asof_date", "core_non_null").agg(F.count("*").alias("n"))


@registered(f"""SELECT asof_date, permno, {r('m', 'm2')} FROM (SELECT asof_date, permno, CASE WHEN n > 0 THEN t / nullif(w, 0) END AS m, CASE WHEN n >= 2 THEN t / nullif(w, 0) END AS m2 FROM (
SELECT asof_date, permno, (GP_AT IS NOT NULL)::INT + (OP_BE IS NOT NULL)::INT + (MB IS NOT NULL)::INT AS n, coalesce(GP_AT * 0.5::DOUBLE, 0) + coalesce(OP_BE * 0.3::DOUBLE, 0) + coalesce(MB * 0.2::DOUBLE, 0) AS t,
CASE WHEN GP_AT IS NULL THEN 0 ELSE 0.5::DOUBLE END + CASE WHEN OP_BE IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN MB IS NULL THEN 0 ELSE 0.2::DOUBLE END AS w FROM ratios))""")
def weighted_row_mean(spark, d):
    cols, w = ["GP_AT", "OP_BE", "MB"], [0.5, 0.3, 0.2]
    return rounded(Panels(spark, d).ratios.select("asof_date", "permno", X.weighted_mean(cols, w).alias("m"), X.weighted_mean(cols, w, 2).alias("m2")))


@registered(f"SELECT DISTINCT PERMNO, DATE, {r('w', digits=9)} FROM (SELECT PERMNO, DATE, greatest(1e-8::DOUBLE, exp(-ln(2.0::DOUBLE) * (DATE '2002-01-01' - DATE) / 365.2425::DOUBLE / 1.5::DOUBLE)) AS w FROM returns_m)")
def decay_weights(spark, d):
    p = Panels(spark, d).returns_m
    return rounded(p.select("PERMNO", "DATE", X.decay_weight("DATE", F.lit("2002-01-01").cast("date"), 1.5).alias("w")), 9)


@registered("SELECT asof_date, GVKEY, DATADATE, coalesce(RDQ, DATADATE + 90) AS available_date FROM available")
def point_in_time_filter(spark, d):
    p = Panels(spark, d)
    return ratios.available(p.fundamentals, p.asof).select("asof_date", "GVKEY", "DATADATE", F.coalesce("RDQ", F.date_add("DATADATE", 90)).alias("available_date"))


@registered(f"SELECT asof_date, GVKEY, LPERMNO, DATADATE, {r('SALEQ', digits=2)} FROM measured1 WHERE rn = 1 AND LPERMNO IS NOT NULL")
def latest_row_per_entity(spark, d):
    p = Panels(spark, d)
    return rounded(ratios.latest(ratios.available(p.fundamentals, p.asof)).select("asof_date", "GVKEY", "LPERMNO", "DATADATE", "SALEQ"), 2)


@registered("SELECT anchor, asof_date, prior_date FROM asof_days")
def next_prev_trading_day(spark, d):
    return Panels(spark, d).asof.select("anchor", "asof_date", "prior_date")


@registered("SELECT DISTINCT DATADATE, (SELECT max(DATE) FROM returns_d r WHERE r.DATE <= DATADATE) AS day FROM fundamentals_q")
def asof_calendar(spark, d):
    p = Panels(spark, d)
    return asof.asof_calendar(p.fundamentals.select("DATADATE").distinct(), "DATADATE", p.returns_d, "DATE", "day")


@registered(f"SELECT f.GVKEY, f.DATADATE, x.DATE AS return_date, {r('RET')} FROM fundamentals_q f ASOF LEFT JOIN returns_d x ON x.PERMNO = f.LPERMNO AND x.DATE <= f.DATADATE")
def asof_by_key(spark, d):
    p = Panels(spark, d)
    out = asof.asof_by_key(p.fundamentals.select("GVKEY", "DATADATE", F.col("LPERMNO").alias("PERMNO")), p.returns_d, ["PERMNO"], "DATADATE", "DATE", ["RET"])
    return rounded(out.select("GVKEY", "DATADATE", F.col("DATE_asof").alias("return_date"), "RET"))


@registered(f"SELECT model, rebal, asof_date, {r('w_long', 'w_short')} FROM live")
def live_cohort_range_join(spark, d):
    return rounded(portfolio.live_weights(Panels(spark, d).selection))


@registered("""SELECT 'in' AS side, DATE, count(*) AS n FROM returns_m WHERE PERMNO IN (SELECT permno FROM ratios) GROUP BY DATE UNION ALL SELECT 'out', DATE, count(*) FROM returns_m WHERE PERMNO NOT IN (SELECT permno FROM ratios WHERE permno IS NOT NULL) GROUP BY DATE""")
def semi_anti_universe(spark, d):
    p = Panels(spark, d)
    universe = p.ratios.select(F.col("permno").alias("PERMNO")).distinct()
    part = lambda how, side: p.returns_m.join(universe, "PERMNO", how).groupBy("DATE").agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "DATE", "n")
    return part("left_semi", "in").union(part("left_anti", "out"))


@registered(f"""SELECT GVKEY, DATADATE, {r('ttm', 'avg4', digits=6)} FROM (SELECT GVKEY, DATADATE, CASE WHEN count(NIQ) OVER f = 4 THEN sum(NIQ) OVER f END AS ttm, CASE WHEN count(ATQ) OVER f = 4 THEN avg(ATQ) OVER f END AS avg4 FROM fundamentals_q
WINDOW f AS (PARTITION BY GVKEY ORDER BY DATADATE ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))""")
def ttm_rolling_sums(spark, d):
    w = along(["GVKEY"], ["DATADATE"])
    return rounded(Panels(spark, d).fundamentals.select("GVKEY", "DATADATE", full_sum(F.col("NIQ"), w, 4).alias("ttm"), full_mean(F.col("ATQ"), w, 4).alias("avg4")), 6)


@registered(f"SELECT GVKEY, DATADATE, {r('d1', 'd4', digits=4)} FROM (SELECT GVKEY, DATADATE, ACTQ - lag(ACTQ) OVER w AS d1, LTQ - lag(LTQ, 4) OVER w AS d4 FROM fundamentals_q WINDOW w AS (PARTITION BY GVKEY ORDER BY DATADATE))")
def lag_differences(spark, d):
    w = along(["GVKEY"], ["DATADATE"])
    return rounded(Panels(spark, d).fundamentals.select("GVKEY", "DATADATE", change(F.col("ACTQ"), w).alias("d1"), change(F.col("LTQ"), w, 4).alias("d4")), 4)


@registered(f"SELECT PERMNO, DATE, {r('cumlog')} FROM cum")
def cum_log_return(spark, d):
    p = Panels(spark, d).returns_d
    return rounded(p.select("PERMNO", "DATE", running_log_return(F.col("RET"), along(["PERMNO"], ["DATE"])).alias("cumlog")))


@registered(f"SELECT PERMNO, DATE, {r('gross')} FROM (SELECT PERMNO, DATE, product((1 + coalesce(RET, 0)) * (1 + coalesce(DLRET, 0))) OVER (PARTITION BY PERMNO ORDER BY DATE) AS gross FROM returns_d)")
def cum_product_gross(spark, d):
    p = Panels(spark, d).returns_d
    return rounded(p.select("PERMNO", "DATE", running_product(1 + X.total_return("RET", "DLRET"), along(["PERMNO"], ["DATE"])).alias("gross")))


@registered(f"SELECT asof_date, permno, gvkey, {r(*ratios.BASE, 'MC_mn')}, {r('EV_FLEX', digits=4)}, EV_src, CFO_src, NOA_src, core_non_null FROM ratios")
def fundamental_ratios(spark, d):
    p = Panels(spark, d)
    df = ratios.fundamental_ratios(p.fundamentals, p.returns_m, p.anchors)
    return rounded(df.withColumn("EV_FLEX", F.round("EV_FLEX", 4)))


@registered(f"SELECT asof_date, gvkey, permno, pillar, feature, {r('z')} FROM standard")
def robust_zscore(spark, d):
    return rounded(scores.standardised(Panels(spark, d).ratios))


@registered("SELECT PERMNO, DATE, round(z, 9) + 0.0 AS z FROM (%s)" % robust_sql("(SELECT PERMNO, DATE, PRC FROM returns_m)", "DATE", "PRC"))
def robust_zscore_prices(spark, d):
    return rounded(robust.robust_z(Panels(spark, d).returns_m.select("PERMNO", "DATE", "PRC"), ["DATE"], "PRC").select("PERMNO", "DATE", "z"))


@registered(f"SELECT asof_date, gvkey, permno, {r('score_P', 'score_V', 'score_Q', 'score')} FROM composite")
def composite_score(spark, d):
    return rounded(scores.composite(Panels(spark, d).ratios))


@registered(f"SELECT asof_date, rank, gvkey, permno, {r('score')} FROM ranking")
def anchor_ranking(spark, d):
    return rounded(scores.anchor_ranking(Panels(spark, d).ratios))


@registered(f"SELECT asof_date, permno, gvkey, n_obs, {r('slope_score', 'avg_score', 'vol_dscore')} FROM dynamics")
def score_dynamics(spark, d):
    return rounded(scores.score_dynamics(Panels(spark, d).ranking))


@registered(f"SELECT asof_date, rank, gvkey, permno, {r('score')} FROM invest")
def investment_ranking(spark, d):
    return rounded(scores.investment_ranking(Panels(spark, d).ranking))


@registered(f"SELECT asof_date AS date, permno, {r('avg_score', 'slope_score', 'vol_dscore')} FROM dynamics WHERE avg_score IS NOT NULL OR slope_score IS NOT NULL OR vol_dscore IS NOT NULL")
def score_features(spark, d):
    return rounded(scores.score_features(Panels(spark, d).ranking))


@registered(f"SELECT date, permno, horizon, {r('y')} FROM labels")
def forward_labels(spark, d):
    p = Panels(spark, d)
    return rounded(labels.forward_labels(p.features, p.returns_d))


@registered(f"SELECT date, permno, horizon, {r('y')} FROM ({labels_sql(True)})")
def forward_labels_truncated(spark, d):
    p = Panels(spark, d)
    return rounded(labels.forward_labels(p.features, p.returns_d, truncated=True))


@registered(f"""SELECT q.asof_date AS date, q.permno, CAST(count(r.DATE) AS BIGINT) AS days, round(coalesce(sum(CASE WHEN r.RET > -1 THEN ln(1 + r.RET) END), 0), 9) + 0.0 AS growth
FROM ratios q LEFT JOIN returns_d r ON r.PERMNO = q.permno AND r.DATE > q.asof_date - 365 AND r.DATE <= q.asof_date GROUP BY 1, 2""")
def half_open_growth(spark, d):
    """Returns after the day a year before a snapshot, up to and including its own: differences of running sums at both ends."""
    p = Panels(spark, d)
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.date_sub("date", 365).alias("at")), F.struct(F.lit(1).alias("end"), F.col("date").alias("at"))))
    probes = p.features.select("date", "permno", ends.alias("x")).select("date", "permno", "x.end", "x.at")
    at = lambda c, end: F.max(F.when(F.col("end") == end, F.coalesce(c, F.lit(0))))
    met = labels.probed_growth(probes, p.returns_d).groupBy("permno", "date")
    return rounded(met.agg((at("days", 1) - at("days", 0)).cast("bigint").alias("days"), (at("cumlog", 1) - at("cumlog", 0)).alias("growth")).select("date", "permno", "days", "growth"))


_IMPUTE = ("GP_AT", "PE", "MB")


@registered(f"""SELECT date, dt, permno, {', '.join(f'round(coalesce({c}, m_{c}), 9) + 0.0 AS {c}' for c in _IMPUTE)}, {', '.join(f'CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS miss_{c}' for c in _IMPUTE)} FROM (
SELECT w.dt, w.date, permno, {', '.join(f'{c}, coalesce(median({c}) OVER (PARTITION BY w.dt), 0) AS m_{c}' for c in _IMPUTE)} FROM ratios JOIN windows w ON w.date = ratios.asof_date)""")
def impute_with_flags(spark, d):
    p = Panels(spark, d)
    rows = learning.window_rows(p.features, _IMPUTE, RATIO_YEARS)
    return rounded(learning.imputed(rows, learning.impute_values(rows, _IMPUTE), _IMPUTE))


@registered(f"""SELECT dt, horizon, {r('w_sum', 'mean_x', 'mean_y', 'sxx', 'sxy')} FROM (SELECT dt, horizon, any_value(Wt) AS w_sum, any_value(mx) AS mean_x, any_value(my) AS mean_y, sum(w * (x - mx) * (x - mx)) AS sxx, sum(w * (x - mx) * (y - my)) AS sxy FROM (
SELECT *, sum(w) OVER g AS Wt, sum(w * x) OVER g / sum(w) OVER g AS mx, sum(w * y) OVER g / sum(w) OVER g AS my FROM (
SELECT v.dt, l.horizon, q.GP_AT AS x, l.y, greatest(1e-8::DOUBLE, exp(-ln(2.0::DOUBLE) * (v.dt - v.date) / 365.2425::DOUBLE / 1.5::DOUBLE)) AS w FROM ratios q JOIN windows v ON v.date = q.asof_date JOIN labels l ON l.date = q.asof_date AND l.permno = q.permno
WHERE q.GP_AT IS NOT NULL AND CAST(v.date + to_months(CASE l.horizon WHEN '3mo' THEN 3 WHEN '6mo' THEN 6 ELSE 12 END) AS DATE) <= v.dt) WINDOW g AS (PARTITION BY dt, horizon)) GROUP BY dt, horizon)""")
def ridge_moments(spark, d):
    p = Panels(spark, d)
    rows = p.features.select("date", "permno", "GP_AT").where("GP_AT is not null").join(learning.anchor_windows(p.features, RATIO_YEARS), "date")
    sums = learning.ridge_moments(learning._matured(rows, p.labels), ["GP_AT"])
    return rounded(sums.select("dt", "horizon", "w_sum", F.col("mean_GP_AT").alias("mean_x"), "mean_y", F.col("s_0_0").alias("sxx"), F.col("t_0").alias("sxy")))


@registered(f"SELECT date, permno, rank, {r('pred_12m', digits=7)} FROM ridge_ratios")
def ridge_ranking_ratios(spark, d):
    p = Panels(spark, d)
    return rounded(learning.ridge_ranking(p.features, p.labels, learning.RATIO_FEATURES, RATIO_YEARS), 7)


@registered(f"SELECT date, permno, rank, {r('pred_12m', digits=7)} FROM ridge_scores")
def ridge_ranking_scores(spark, d):
    p = Panels(spark, d)
    return rounded(learning.ridge_ranking(p.score_features, p.score_labels, learning.SCORE_FEATURES, SCORE_YEARS), 7)


@registered()
def gbt_ranking_ratios(spark, d):
    return Panels(spark, d).trees_ratios


@registered()
def gbt_ranking_scores(spark, d):
    return Panels(spark, d).trees_scores


@registered()
def gbt_fits(spark, d):
    """Rows, rounds made, best round and its late loss, trees and leaves of every fit of the two tree rankings (ML3, ML4)."""
    p = Panels(spark, d)
    leaves = lambda m: F.size(F.filter("tree", lambda n: n["feature"] < 0))
    out = []
    for name, model in (("ratios", p.model_ratios), ("scores", p.model_scores)):
        grown = model.groupBy("dt", "horizon").agg(F.count("*").alias("trees"), F.sum(leaves(model)).cast("bigint").alias("leaves"))
        out.append(boosting.best_rounds(model).join(grown, ["dt", "horizon"]).select(F.lit(name).alias("features"), "*"))
    return rounded(out[0].union(out[1]))


@registered()
def gbt_warm_start(spark, d):
    """The ranking of ratios by trees that go on from those of the anchor before (ML5)."""
    p = Panels(spark, d)
    return learning.tree_predictions(p.features, learning.RATIO_FEATURES, p.model_warm)


@registered()
def tree_performance(spark, d):
    """The trees' deciles, cohorts, daily series and report, as for the models that SQL can check (PF2, PF12)."""
    p = Panels(spark, d)
    return performance.performance_report(portfolio.daily_long_short(p.tree_selection, p.returns_d), p.market)


@registered()
def tree_hit_rates(spark, d):
    p = Panels(spark, d)
    return performance.hit_rates(p.tree_selection, p.returns_d)


@registered(f"SELECT date, permno, {r('pred_12m')} FROM (SELECT date, permno, sum(y * w) / sum(w) AS pred_12m FROM (SELECT *, CASE horizon WHEN '3mo' THEN 0.2::DOUBLE WHEN '6mo' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS w FROM labels) GROUP BY 1, 2)")
def horizon_blend(spark, d):
    p = Panels(spark, d)
    return rounded(labels.blended(p.labels.withColumnRenamed("y", "pred")))


@registered("SELECT model, asof_date, permno, signal FROM selection")
def decile_selection(spark, d):
    return Panels(spark, d)._select()


@registered("SELECT model, asof_date, end_date, n_long, n_short FROM cohorts")
def cohort_end_dates(spark, d):
    return portfolio.cohorts(Panels(spark, d).selection)


@registered(f"SELECT model, asof_date, end_date, DATE, {r('nav_long', 'nav_short')} FROM nav")
def cohort_nav(spark, d):
    p = Panels(spark, d)
    return rounded(portfolio.cohort_nav(p.selection, p.returns_d))


@registered(f"""SELECT model, asof_date, end_date, DATE, {r('nav_long', 'nav_short')} FROM (SELECT model, asof_date, end_date, DATE, avg(CASE WHEN signal = 1 THEN g END) AS nav_long, avg(CASE WHEN signal = -1 THEN g END) AS nav_short FROM (
SELECT p.*, d.DATE, last_value(h.gross IGNORE NULLS) OVER (PARTITION BY p.model, p.asof_date, p.signal, p.permno ORDER BY d.DATE) AS g
FROM (SELECT model, asof_date, end_date, signal, permno, min(DATE) AS first FROM held GROUP BY ALL) p JOIN (SELECT DISTINCT model, asof_date, DATE FROM held) d ON d.model = p.model AND d.asof_date = p.asof_date AND d.DATE >= p.first
LEFT JOIN held h ON h.model = p.model AND h.asof_date = p.asof_date AND h.signal = p.signal AND h.permno = p.permno AND h.DATE = d.DATE) GROUP BY 1, 2, 3, 4)""")
def cohort_nav_carried(spark, d):
    """Cohorts whose names count with their last value after they stop (PF4, Q18)."""
    p = Panels(spark, d)
    return rounded(portfolio.cohort_nav(p.selection, p.returns_d, carry=True))


@registered(f"SELECT model, DATE, {r('long_ret', 'short_ret', 'ls_ret')} FROM daily")
def daily_long_short(spark, d):
    p = Panels(spark, d)
    return rounded(portfolio.daily_long_short(p.selection, p.returns_d))


@registered(f"SELECT model, series AS leg, DATE, {r('r')} FROM series WHERE r IS NOT NULL")
def series_sink(spark, d):
    """The daily series written by model and leg, and read again."""
    p = Panels(spark, d)
    return rounded(p._stage("series_by_leg", lambda: p.series, S.write_series).select("model", "leg", "DATE", "r"))


_RATIO = lambda x, below: f"CASE WHEN stddev_samp({below}) > 0 THEN avg({x}) / stddev_samp({below}) * sqrt(252.0::DOUBLE) END"


@registered(f"""SELECT model, series, {r('ann_sharpe', 'sortino', 'info_ratio', 'avg_daily', 'daily_vol')}, start_date, end_date, n_days FROM (SELECT model, series, {_RATIO('r', 'r')} AS ann_sharpe, {_RATIO('r', 'least(r, 0)')} AS sortino, {_RATIO('(r - Mkt_RF)', '(r - Mkt_RF)')} AS info_ratio,
avg(r) AS avg_daily, stddev_samp(r) AS daily_vol, min(DATE) AS start_date, max(DATE) AS end_date, count(*) AS n_days FROM aligned GROUP BY 1, 2)""")
def performance_stats(spark, d):
    p = Panels(spark, d)
    return rounded(performance.performance_stats(p.series, p.market))


@registered(f"""SELECT s.model, s.series, {', '.join(f'round(s.{c}, 9) + 0.0 AS {c}' for c in ('ann_sharpe', 'sortino', 'info_ratio', 'avg_daily', 'daily_vol'))}, start_date, end_date, n_days, round(max_drawdown, 9) + 0.0 AS max_drawdown,
CASE WHEN max_drawdown < 0 THEN (SELECT min(q.DATE) FROM report_wealth q WHERE q.model = y.model AND q.series = y.series AND q.DATE <= y.trough AND q.v = y.peak) ELSE first END AS dd_start, CASE WHEN max_drawdown < 0 THEN trough ELSE first END AS dd_end
FROM (SELECT model, series, {_RATIO('r', 'r')} AS ann_sharpe, {_RATIO('r', 'least(r, 0)')} AS sortino, {_RATIO('(r - m)', '(r - m)')} AS info_ratio, avg(r) AS avg_daily, stddev_samp(r) AS daily_vol, min(DATE) AS start_date, max(DATE) AS end_date, count(*) AS n_days FROM report_rows GROUP BY 1, 2) s
JOIN report_fall y ON y.model = s.model AND y.series = s.series""")
def performance_report(spark, d):
    p = Panels(spark, d)
    return rounded(performance.performance_report(p.daily, p.market))


@registered(f"""SELECT model, series, n_days, start_date, {r('avg_daily', 'daily_vol', digits=7)} FROM (SELECT model, series, avg(r) AS avg_daily, stddev_samp(r) AS daily_vol, min(DATE) AS start_date, count(*) AS n_days FROM report_rows GROUP BY 1, 2)""")
def report_sink(spark, d):
    """The performance report written as a CSV file with a header, and read again."""
    p = Panels(spark, d)
    folder = p._folder("report")
    S.write_report(performance.performance_report(p.daily, p.market), folder)
    names = spark.read.option("header", True).csv(folder).columns
    kinds = {"n_days": "bigint", "start_date": "date", "avg_daily": "double", "daily_vol": "double"}
    typed = spark.read.option("header", True).schema(", ".join(f"{c} {kinds.get(c, 'string')}" for c in names)).csv(folder)
    return rounded(typed.select("model", "series", "n_days", "start_date", "avg_daily", "daily_vol"), 7)


@registered(f"""SELECT model, series, {r('max_drawdown')}, CASE WHEN max_drawdown < 0 THEN (SELECT min(q.DATE) FROM wealth q WHERE q.model = y.model AND q.series = y.series AND q.DATE <= y.trough AND q.v = y.peak) ELSE first END AS dd_start, CASE WHEN max_drawdown < 0 THEN trough ELSE first END AS dd_end FROM (
SELECT model, series, min(dd) AS max_drawdown, min(DATE) AS first, arg_min(DATE, (dd, DATE)) AS trough, arg_min(peak, (dd, DATE)) AS peak FROM (SELECT *, v / peak - 1 AS dd FROM (SELECT *, max(v) OVER (PARTITION BY model, series ORDER BY DATE) AS peak FROM wealth)) GROUP BY 1, 2) y""")
def max_drawdown(spark, d):
    return rounded(performance.max_drawdown(Panels(spark, d).series))


@registered(f"SELECT model, series, DATE, {r('vami', digits=7)} FROM (SELECT model, series, DATE, 100 * product(1 + r) OVER (PARTITION BY model, series ORDER BY DATE) AS vami FROM series WHERE DATE IN (SELECT DATE FROM series GROUP BY DATE HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM series)))")
def vami_all_models(spark, d):
    return rounded(performance.wealth(performance.common_dates(Panels(spark, d).series)).select("model", "series", "DATE", "vami"), 7)


@registered(f"""SELECT model, {r('GlobalHitRate', 'LongHitRate', 'ShortHitRate')} FROM (SELECT model, count(*) FILTER ((signal = 1 AND g > 1) OR (signal = -1 AND g < 1)) / count(*) AS GlobalHitRate, count(*) FILTER (signal = 1 AND g > 1) / nullif(count(*) FILTER (signal = 1), 0) AS LongHitRate,
count(*) FILTER (signal = -1 AND g < 1) / nullif(count(*) FILTER (signal = -1), 0) AS ShortHitRate FROM (SELECT model, asof_date, signal, permno, arg_max(gross, DATE) AS g FROM held GROUP BY 1, 2, 3, 4) GROUP BY model)""")
def hit_rates(spark, d):
    p = Panels(spark, d)
    return rounded(performance.hit_rates(p.selection, p.returns_d))


def _factor_rows(p: Panels) -> DataFrame:
    return attribution.joined(p.series, p.factors)


_MOMENTS = ["g_0_0", "g_0_1", "g_1_1", "g_1_2", "g_6_6", "y_0", "y_1", "yy"]


@registered(f"SELECT model, series, N, sample_start, sample_end, {r(*_MOMENTS)} FROM (SELECT model, series, count(*) AS N, min(DATE) AS sample_start, max(DATE) AS sample_end, sum(1.0::DOUBLE) AS g_0_0, sum(Mkt_RF) AS g_0_1, sum(Mkt_RF * Mkt_RF) AS g_1_1, sum(Mkt_RF * SMB) AS g_1_2, sum(Mom * Mom) AS g_6_6, sum(r) AS y_0, sum(Mkt_RF * r) AS y_1, sum(r * r) AS yy FROM aligned GROUP BY 1, 2)")
def ols_moments(spark, d):
    return rounded(attribution.moments(_factor_rows(Panels(spark, d))).select("model", "series", "N", "sample_start", "sample_end", *_MOMENTS))


@registered(f"SELECT model, series, n, {r('beta', 'alpha', 'r2')} FROM (SELECT model, series, count(*) AS n, regr_slope(r, Mkt_RF) AS beta, regr_intercept(r, Mkt_RF) AS alpha, regr_r2(r, Mkt_RF) AS r2 FROM aligned GROUP BY 1, 2)")
def ols_single_factor(spark, d):
    return rounded(attribution.single_factor(_factor_rows(Panels(spark, d))))


_OLS = ["alpha", "t_alpha", *[f"{p}_{n}" for n in attribution.NAMES for p in ("beta", "t")]]
_COEFFICIENTS = ", ".join(f"(SELECT {c} FROM ols_t t WHERE t.model = s.model AND t.series = s.series AND t.i = {i}) AS {n}" for i, (b, t) in enumerate(zip(_OLS[::2], _OLS[1::2], strict=True)) for n, c in ((b, "beta"), (t, "t")))


_ENOUGH = lambda e, name: f"CASE WHEN N >= 30 THEN round({e}, 6) + 0.0 END AS {name}"


@registered(f"""SELECT model, series, sample_start, sample_end, N, {', '.join(_ENOUGH(c, c) for c in _OLS)},
{_ENOUGH('1 - rss / tss', 'R2')}, {_ENOUGH('1 - (rss / tss) * (N - 1) / (N - 7)', 'Adj_R2')}, CASE WHEN N >= 30 THEN 'ok' ELSE 'too few days' END AS status
FROM (SELECT s.model, s.series, s.sample_start, s.sample_end, s.N, f.rss, f.tss, {_COEFFICIENTS} FROM ols_sample s JOIN ols_fit f ON f.model = s.model AND f.series = s.series)""")
def ols_factor_report(spark, d):
    return rounded(attribution.ols_report(_factor_rows(Panels(spark, d))), 6)


@registered(f"SELECT model, series, DATE, N, {r('g_0_1', 'g_1_1', 'y_1')} FROM (SELECT model, series, DATE, count(*) OVER w AS N, sum(Mkt_RF) OVER w AS g_0_1, sum(Mkt_RF * Mkt_RF) OVER w AS g_1_1, sum(Mkt_RF * r) OVER w AS y_1 FROM aligned WINDOW w AS (PARTITION BY model, series ORDER BY DATE ROWS BETWEEN 1259 PRECEDING AND CURRENT ROW)) WHERE N = 1260")
def rolling_moments(spark, d):
    return rounded(attribution.rolling_moments(_factor_rows(Panels(spark, d)), ROLLING).select("model", "series", "DATE", "N", "g_0_1", "g_1_1", "y_1"))


@registered("SELECT model, series, DATE, round(252 * v, 7) + 0.0 AS alpha FROM rolling_solved WHERE k = 7 AND i = 0 AND j = 7")
def rolling_alpha(spark, d):
    return rounded(attribution.rolling_alpha(_factor_rows(Panels(spark, d)), ROLLING), 7)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of ratios, robust z-scores, composite, rank and deciles."""
    return Panels(spark, sf_dir).selection
