"""Decile selection, cohorts and the overlapping-cohort daily series (PF1-PF7).

A name that a ranking repeats on a date counts once, with its best score; names or scores that are null are left out;
tied scores go by the lower number. Daily rows that repeat a name and date each compound. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import anniversary, total_return
from ..functions.windows import along, period_return, running_product
from .asof import asof_calendar

KEYS = ["model", "asof_date"]


def decile_selection(ranking: DataFrame, score: str = "score", share: float = 0.1) -> DataFrame:
    """model, asof_date, permno, signal: the best and worst tenth, one name at least, never both (PF1, PF2, T3-T5)."""
    best = ranking.where(F.col("permno").isNotNull() & F.col(score).isNotNull()).groupBy(*KEYS, F.col("permno").cast("bigint").alias("permno")).agg(F.max(F.col(score).cast("double")).alias("s"))
    w = W.partitionBy(*KEYS)
    n = F.greatest(F.lit(1), F.floor(share * F.count("*").over(w)))
    rows = best.withColumns({"top": F.row_number().over(w.orderBy(F.desc("s"), "permno")), "n": n})
    rows = rows.withColumn("rest", F.col("top") > F.col("n"))
    low = F.row_number().over(W.partitionBy(*KEYS, "rest").orderBy("s", "permno"))
    rows = rows.withColumn("signal", F.when(~F.col("rest"), 1).when(low <= F.col("n"), -1))
    return rows.where("signal is not null").select(*KEYS, "permno", "signal")


def cohorts(selection: DataFrame) -> DataFrame:
    """model, asof_date, end_date, n_long, n_short: a cohort ends at next year's snapshot of the month, or its anniversary (PF3, PF5)."""
    mine = selection.groupBy(*KEYS).agg(F.count_if(F.col("signal") == 1).alias("n_long"), F.count_if(F.col("signal") == -1).alias("n_short"))
    mine = mine.withColumns({"_y": F.year("asof_date") + 1, "_m": F.month("asof_date")})
    later = selection.groupBy("model", F.year("asof_date").alias("_y"), F.month("asof_date").alias("_m")).agg(F.max("asof_date").alias("_next"))
    return mine.join(later, ["model", "_y", "_m"], "left").select(*KEYS, F.coalesce("_next", anniversary("asof_date")).alias("end_date"), "n_long", "n_short")


def held_returns(selection: DataFrame, returns: DataFrame) -> DataFrame:
    """Every day of every position strictly inside its cohort, with its running gross return (PF4, F7, J5, W6).

    An equi-join on the security and the years that the cohort touches, with the dates as a further condition: a position does
    not meet the rest of its name's history. A panel bucketed by security is not shuffled where the positions can be broadcast.
    """
    held = selection.join(cohorts(selection).select(*KEYS, "end_date"), KEYS)
    held = held.withColumn("_year", F.explode(F.when(F.col("end_date") >= F.col("asof_date"), F.sequence(F.year("asof_date"), F.year("end_date")))))
    daily = returns.select(F.col("PERMNO").alias("permno"), "DATE", total_return("RET", "DLRET").alias("r"), F.year("DATE").alias("_year"))
    rows = daily.join(held, ["permno", "_year"]).where((F.col("DATE") > F.col("asof_date")) & (F.col("DATE") < F.col("end_date"))).drop("_year")
    return rows.withColumn("gross", running_product(1 + F.col("r"), along([*KEYS, "signal", "permno"], ["DATE"])))


def carried_nav(held: DataFrame) -> DataFrame:
    """The navs of `held` where a name that has stopped goes on with its last gross return from its first day on (Q18).

    The days of a cohort are those on which one of its names has a row. A position adds its first gross return on its first day and what it
    has changed on each further day of its own: the running sums over a cohort's days are those of all names that have begun, so
    that positions need not be laid out over all days. Of a name's rows of one day the greatest gross return counts.
    """
    cohort = [*KEYS, "end_date"]
    position = [*cohort, "signal", "permno"]
    own = held.groupBy(*position, "DATE").agg(F.max("gross").alias("gross"))
    before = F.lag("gross").over(along(position, ["DATE"]))
    moved = own.withColumns({"first": before.isNull(), "change": F.col("gross") - F.coalesce(before, F.lit(0.0))})
    sides = {"nav_long": F.col("signal") == 1, "nav_short": F.col("signal") == -1}
    of = lambda c, side: F.sum(F.when(side, c).otherwise(0))
    days = moved.groupBy(*cohort, "DATE").agg(*[of(F.col("change"), s).alias(n) for n, s in sides.items()], *[of(F.col("first").cast("bigint"), s).alias(f"_{n}") for n, s in sides.items()])
    so_far = along(cohort, ["DATE"]).rowsBetween(W.unboundedPreceding, 0)
    return days.select(*cohort, "DATE", *[F.try_divide(F.sum(n).over(so_far), F.sum(f"_{n}").over(so_far)).alias(n) for n in sides])


def cohort_nav(selection: DataFrame, returns: DataFrame, carry: bool = False) -> DataFrame:
    """model, asof_date, end_date, DATE, nav_long, nav_short: mean gross of the names with a row that day.

    With `carry`, names that have stopped count with their last gross return (PF4, Q18).
    """
    held = held_returns(selection, returns)
    if carry:
        return carried_nav(held)
    by = held.groupBy(*KEYS, "end_date", "DATE")
    return by.agg(F.avg(F.when(F.col("signal") == 1, F.col("gross"))).alias("nav_long"), F.avg(F.when(F.col("signal") == -1, F.col("gross"))).alias("nav_short"))


def sleeves(nav: DataFrame) -> DataFrame:
    """Daily return of both legs of each cohort, where both are there."""
    w = along(KEYS, ["DATE"])
    out = nav.select(*KEYS, "end_date", "DATE", period_return(F.col("nav_long"), w).alias("long_ret"), period_return(F.col("nav_short"), w).alias("short_ret"))
    return out.where("long_ret is not null and short_ret is not null")


def live_weights(selection: DataFrame, include_on_formation: bool = False) -> DataFrame:
    """model, rebal, asof_date, w_long, w_short: shares of the cohorts that live at each rebalance (J11, A16, PF6)."""
    c = cohorts(selection)
    dates = selection.select("model", F.col("asof_date").alias("rebal")).distinct()
    begun = F.col("asof_date") <= F.col("rebal") if include_on_formation else F.col("asof_date") < F.col("rebal")
    live = dates.join(c, "model").where(begun & (F.col("rebal") < F.col("end_date")))  # a row a snapshot on both sides
    w = W.partitionBy("model", "rebal")
    share = lambda n: F.coalesce(F.try_divide(F.col(n).cast("double"), F.sum(n).over(w)), F.lit(0.0))
    return live.select("model", "rebal", "asof_date", share("n_long").alias("w_long"), share("n_short").alias("w_short"))


def daily_long_short(selection: DataFrame, returns: DataFrame, include_on_formation: bool = False) -> DataFrame:
    """model, DATE, long_ret, short_ret, ls_ret of the overlapping cohorts (PF7, J10)."""
    s = sleeves(cohort_nav(selection, returns))
    days = asof_calendar(s.select("DATE").distinct(), "DATE", selection, "asof_date", "rebal").where("rebal is not null")
    rows = s.join(days, "DATE").join(live_weights(selection, include_on_formation), ["model", "rebal", "asof_date"], "left")
    both = rows.groupBy("model", "DATE").agg(F.sum(F.col("long_ret") * F.coalesce("w_long", F.lit(0.0))).alias("long_ret"), F.sum(F.col("short_ret") * F.coalesce("w_short", F.lit(0.0))).alias("short_ret"))
    return both.withColumn("ls_ret", F.col("long_ret") - F.col("short_ret"))
