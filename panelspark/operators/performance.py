"""Performance statistics, drawdowns, wealth and hit rates (PF8-PF14). Each series is one key; all run in one job.

Null returns are left out; rows that repeat a date each count; statistics of fewer than two days, or of no spread, are
null; an empty table gives no rows. A series is some 250 rows a year, and so one task's window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.windows import along, running_product
from .portfolio import held_returns

YEAR = math.sqrt(252)


def legs(daily: DataFrame) -> DataFrame:
    """model, series (LS, LONG, SHORT), DATE, r in long form; the short leg's r is its profit, the negative of its return."""
    rows = F.array(*[F.struct(F.lit(n).alias("series"), F.expr(c).alias("r")) for n, c in (("LS", "ls_ret"), ("LONG", "long_ret"), ("SHORT", "-short_ret"))])
    return daily.select("model", "DATE", F.explode(rows).alias("_x")).select("model", "_x.series", "DATE", "_x.r").where("r is not null")


def _ratio(x: Column, below: Column) -> Column:
    spread = F.stddev_samp(below)
    return F.when(spread > 0, F.avg(x) / spread * YEAR)


def performance_stats(series: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """Sharpe, Sortino, information ratio, mean, volatility, dates and days of each (model, series) (PF8, PF10-PF12).

    `market` (DATE, mkt): days without it go, and the information ratio is against it.
    """
    if market is not None:
        series = series.join(market.select("DATE", "mkt"), "DATE").where("mkt is not null")
    else:
        series = series.withColumn("mkt", F.lit(None).cast("double"))
    r = F.col("r")
    return series.groupBy("model", "series").agg(
        _ratio(r, r).alias("ann_sharpe"), _ratio(r, F.least(r, F.lit(0.0))).alias("sortino"), _ratio(r - F.col("mkt"), r - F.col("mkt")).alias("info_ratio"),
        F.avg(r).alias("avg_daily"), F.stddev_samp(r).alias("daily_vol"), F.min("DATE").alias("start_date"), F.max("DATE").alias("end_date"), F.count("*").alias("n_days"),
    )


def performance_report(daily: DataFrame, market: DataFrame) -> DataFrame:
    """One row a model and series (LS, LONG, SHORT and Mkt, all on the model's days with a market return): statistics and drawdown (PF12).

    The market's information ratio is null: it is its own benchmark. A model without such days has no rows.
    """
    own = legs(daily)
    days = daily.select("model", "DATE").distinct().join(market.select("DATE", F.col("mkt").alias("r")), "DATE").where("r is not null")
    series = own.join(market.where("mkt is not null").select("DATE"), "DATE", "left_semi").select("model", "series", "DATE", "r")
    series = series.union(days.select("model", F.lit("Mkt").alias("series"), "DATE", "r"))
    return performance_stats(series, market).join(max_drawdown(series), ["model", "series"])


def wealth(series: DataFrame, base: float = 100.0) -> DataFrame:
    """Wealth of each series from `base` on (PF13, W7)."""
    return series.withColumn("vami", base * running_product(1 + F.col("r"), along(["model", "series"], ["DATE"])))


def common_dates(series: DataFrame) -> DataFrame:
    """The rows on dates that all models have."""
    models = series.select("model").distinct()
    full = series.groupBy("DATE").agg(F.count_distinct("model").alias("n")).crossJoin(models.agg(F.count("*").alias("all"))).where("n = all").select("DATE")  # one row
    return series.join(full, "DATE", "left_semi")


def max_drawdown(series: DataFrame) -> DataFrame:
    """Deepest fall from a peak of each series, with the peak's and the trough's first dates (PF9, W8)."""
    w = along(["model", "series"], ["DATE"])
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    rows = wealth(series, 1.0).withColumn("peak", F.max("vami").over(so_far))
    fell = rows.withColumn("dd", F.col("vami") / F.col("peak") - 1)
    rise = fell.withColumn("peak_date", F.max(F.when(F.col("vami") > F.coalesce(F.max("vami").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)), F.col("DATE"))).over(so_far))
    first = F.min_by(F.struct("peak_date", "DATE"), F.struct("dd", "DATE"))
    out = rise.groupBy("model", "series").agg(F.min("dd").alias("max_drawdown"), first.alias("x"), F.min("DATE").alias("first"))
    down = F.col("max_drawdown") < 0
    return out.select("model", "series", "max_drawdown", F.when(down, F.col("x.peak_date")).otherwise(F.col("first")).alias("dd_start"), F.when(down, F.col("x.DATE")).otherwise(F.col("first")).alias("dd_end"))


def hit_rates(selection: DataFrame, returns: DataFrame) -> DataFrame:
    """Shares of long positions that end above, and short ones that end below, their start (PF14)."""
    final = held_returns(selection, returns).groupBy("model", "asof_date", "signal", "permno").agg(F.max_by("gross", "DATE").alias("g"))
    long, short = F.col("signal") == 1, F.col("signal") == -1
    won_long, won_short = long & (F.col("g") > 1), short & (F.col("g") < 1)
    rate = lambda a, b: F.try_divide(F.count_if(a).cast("double"), F.count_if(b))
    return final.where("g is not null").groupBy("model").agg(rate(won_long | won_short, long | short).alias("GlobalHitRate"), rate(won_long, long).alias("LongHitRate"), rate(won_short, short).alias("ShortHitRate"))
