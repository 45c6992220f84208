"""Point-in-time fundamentals and the ratios built on them.

Of rows of one firm, as-of date and period the order within the period is open, as nothing in the data tells them apart;
the latest period counts. Nulls spread through sums and ratios but where a cascade names a substitute. Empty tables give
no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import count_present, first_valid, is_finite, log_growth, market_cap, or_zero, pos_div, safe_div
from ..functions.windows import along, change, full_mean, full_sum
from .asof import asof_calendar

#: Months and days of the anchors, and the ratios' names in order.
ANCHOR_DAYS = ((4, 15), (5, 20), (8, 19), (11, 19))
BASE = ["GP_AT", "OP_BE", "ROA_TTM", "CFO_AT", "SloanAcc_AT", "AssetGrowth", "NOA_AT", "NetShareIss", "MB", "PE", "PC", "EV_EBITDA_STRICT", "CFO_AT_FLEX", "PC_FLEX", "SloanAcc_AT_FLEX", "NOA_AT_FLEX", "EV_EBITDA_FLEX", "EV_EBITDA"]
CORE = ["GP_AT", "MB", "PE", "ROA_TTM", "AssetGrowth", "NetShareIss", "OP_BE"]


def anchor_calendar(spark: SparkSession, first: int, last: int, days: Sequence[tuple[int, int]] = ANCHOR_DAYS) -> DataFrame:
    """anchor: one row for each (month, day) of each year."""
    return spark.createDataFrame([(date(y, m, d),) for y in range(first, last + 1) for m, d in days], "anchor date")


def trading_days(returns: DataFrame) -> DataFrame:
    """The dates on which the market return is present."""
    return returns.where(F.col("VWRETD").isNotNull()).select("DATE").distinct()


def asof_days(anchors: DataFrame, returns: DataFrame) -> DataFrame:
    """anchor, asof_date (first trading day at or after it), prior_date (last one at or before 365 days earlier)."""
    days = trading_days(returns)
    out = asof_calendar(anchors.select("anchor"), "anchor", days, "DATE", "asof_date", forward=True)
    return asof_calendar(out, "asof_date", days, "DATE", "prior_date", shift=-365)


def available(fundamentals: DataFrame, asof: DataFrame, lookback_years: int = 3) -> DataFrame:
    """Every quarter that each asof_date can see: reported by then, linked then, of its last calendar years.

    `asof` holds a few hundred dates; each quarter meets the dates of its own and the next years by an equi-join on the
    year, and the dates themselves decide. Where the fundamentals are partitioned by `year`, the dates' years reach their
    scan as a runtime filter, so that files of other years are not opened.
    """
    dates = asof.select("asof_date").where("asof_date is not null").distinct()
    name = "year" if "year" in fundamentals.columns else "_year"
    seen = dates.withColumn(name, F.explode(F.sequence(F.year("asof_date") - (lookback_years - 1), F.year("asof_date"))))
    seen = F.broadcast(seen.where(F.col(name) > F.year("asof_date") - lookback_years))  # a row a date and year
    quarters = fundamentals if name == "year" else fundamentals.withColumn(name, F.year("DATADATE"))
    keep = F.coalesce("RDQ", F.date_add("DATADATE", 90)) <= F.col("asof_date")
    if {"LINKDT", "LINKENDDT"} <= set(fundamentals.columns):
        keep = keep & (F.col("LINKDT").isNull() | (F.col("LINKDT") <= F.col("asof_date"))) & (F.col("LINKENDDT").isNull() | (F.col("LINKENDDT") >= F.col("asof_date")))
    return quarters.join(seen, name).where(keep).drop(name)


def quarterly_measures(panel: DataFrame, keys: Sequence[str] = ("asof_date", "GVKEY"), parity: bool = False) -> DataFrame:
    """Trailing sums, means, lags and numerators of each quarter (R1-R10, W1-W4). `parity` orders by report date first."""
    order = ["RDQ", "DATADATE"] if parity else ["DATADATE", "RDQ"]
    w = along(keys, order)
    c = F.col
    stock = [x for x in ("PSTKRQ", "PSTKRV", "PSTKQ") if x in panel.columns]
    panel = panel.withColumns(
        {
            "WC": (c("ACTQ") - c("CHEQ")) - (c("LCTQ") - c("DLCQ") - c("TXPQ")),
            "WC_B": (c("ACTQ") - c("CHEQ")) - (c("LCTQ") - c("DLCQ")),
            "WC_C": (c("ACTQ") - c("CHEQ")) - c("LCTQ"),
            "PSTK": F.coalesce(*stock) if stock else F.lit(0.0),
        }
    )
    none = F.lit(None).cast("double")
    panel = panel.withColumns(
        {
            "TTM_NIQ": full_sum(c("NIQ"), w, 4), "TTM_DPQ": full_sum(c("DPQ"), w, 4), "TTM_OIBDP": full_sum(c("OIBDPQ"), w, 4),
            "AVG4_ATQ": full_mean(c("ATQ"), w, 4), "WC_D4": change(c("WC"), w, 4), "ATQ_lag4": F.lag("ATQ", 4).over(w),
            "WC_B_D4": none if parity else change(c("WC_B"), w, 4), "WC_C_D4": none if parity else change(c("WC_C"), w, 4),
            "ACC_num": change(c("ACTQ"), w) - change(c("CHEQ"), w) - change(c("LCTQ"), w) + change(c("DLCQ"), w) + change(c("TXPQ"), w) - c("DPQ"),
        }
    )
    return panel.withColumns(
        {
            "CFO_TTM": c("TTM_NIQ") + c("TTM_DPQ") - c("WC_D4"),
            "BE": c("SEQQ") + c("TXDITCQ") - c("PSTK"),
            "GP_num": F.coalesce(c("SALEQ") - c("COGSQ"), c("OIBDPQ") + c("XSGAQ")),
            "OP_num": F.coalesce(c("SALEQ") - c("COGSQ") - c("XSGAQ") - c("XINTQ"), c("OIBDPQ") - c("XINTQ")),
            "NOA_full": (c("ATQ") - c("CHEQ") - c("IVSTQ")) - (c("LTQ") - c("DLCQ") - c("DLTTQ")),
        }
    )


def latest(panel: DataFrame, keys: Sequence[str] = ("asof_date", "GVKEY"), parity: bool = False) -> DataFrame:
    """The last quarter of each key; then rows without a linked security go."""
    order = [F.col(x).desc() for x in (("RDQ", "DATADATE") if parity else ("DATADATE", "RDQ"))]
    last = panel.withColumn("_rn", F.row_number().over(along(keys, order))).where("_rn = 1").drop("_rn")
    return last.where("LPERMNO is not null")


def snapshots(returns: DataFrame, asof: DataFrame) -> DataFrame:
    """asof_date, PERMNO, PRC, SHROUT and ns_12m: prices at each asof_date and log share growth over a year."""
    prices = returns.select("PERMNO", "DATE", "PRC", "SHROUT", "CFACSHR")
    now = asof.where("asof_date is not null").select("asof_date", "prior_date").distinct()
    at = prices.join(now, prices["DATE"] == now["asof_date"]).drop("DATE")
    before = prices.select("PERMNO", F.col("DATE").alias("prior_date"), F.col("SHROUT").alias("S0"), F.col("CFACSHR").alias("C0"))
    joined = at.join(before, ["PERMNO", "prior_date"], "left")
    return joined.select("asof_date", "PERMNO", "PRC", "SHROUT", log_growth([F.col("SHROUT"), F.col("CFACSHR")], [F.col("S0"), F.col("C0")]).alias("ns_12m"))


def enterprise_value(df: DataFrame) -> DataFrame:
    """EV_A and the flexible value with the letter of the variant that gave it."""
    c = F.col
    variants = {
        "A": c("MC_mn") + c("DLTTQ") + c("DLCQ") + c("PSTK") + c("MIBQ") - c("CHEQ") - c("IVSTQ"),
        "B": c("MC_mn") + or_zero("DLTTQ") + or_zero("DLCQ") - or_zero("CHEQ"),
        "C": c("MC_mn") + or_zero("LTQ") - (or_zero("LCTQ") - or_zero("DLCQ")) - or_zero("CHEQ"),
        "D": c("MC_mn"),
    }
    value, letter = first_valid([(is_finite(v) & (v > 0), v, k) for k, v in variants.items()])
    return df.withColumns({"EV_FLEX": value, "EV_src": letter, "EV_A": F.when(is_finite(variants["A"]) & (variants["A"] > 0), variants["A"])})


def fundamental_ratios(fundamentals: DataFrame, returns: DataFrame, anchors: DataFrame, parity: bool = False) -> DataFrame:
    """The ratio panel: one row for each asof_date and firm."""
    c = F.col
    asof = asof_days(anchors, returns)
    base = latest(quarterly_measures(available(fundamentals, asof), parity=parity), parity=parity)
    price = snapshots(returns, asof).withColumnRenamed("PERMNO", "LPERMNO")
    df = base.join(price, ["asof_date", "LPERMNO"], "left").withColumn("MC_mn", market_cap("PRC", "SHROUT"))
    df = enterprise_value(df)
    income = c("TTM_NIQ") + c("TTM_DPQ")
    flows = [("A", c("CFO_TTM")), ("B", income - c("WC_B_D4")), ("C", income - c("WC_C_D4")), ("D", income)]
    flow, flow_letter = first_valid([(is_finite(v), v, k) for k, v in flows])
    assets = [
        ("A", c("NOA_full")),
        ("B", c("ATQ") - c("CHEQ") - (or_zero("DLTTQ") + or_zero("DLCQ"))),
        ("C", c("ATQ") - c("CHEQ") - or_zero("LTQ")),
        ("D", (c("ACTQ") - c("CHEQ")) - (c("LCTQ") - c("DLCQ"))),
    ]
    noa, noa_letter = first_valid([(is_finite(v), v, k) for k, v in assets])
    df = df.withColumns({"CFO_TTM_FLEX": flow, "CFO_src": flow_letter, "NOA_FLEX": noa, "NOA_src": noa_letter})
    df = df.withColumns(
        {
            "GP_AT": pos_div("GP_num", "ATQ"), "OP_BE": pos_div("OP_num", "BE"), "ROA_TTM": pos_div("TTM_NIQ", "AVG4_ATQ"),
            "CFO_AT": pos_div("CFO_TTM", "ATQ"), "SloanAcc_AT": safe_div("ACC_num", "AVG4_ATQ"), "AssetGrowth": safe_div(c("ATQ") - c("ATQ_lag4"), "ATQ_lag4"),
            "NOA_AT": pos_div("NOA_full", "ATQ"), "NetShareIss": c("ns_12m"), "MB": pos_div("MC_mn", "BE"), "PE": pos_div("MC_mn", "TTM_NIQ"), "PC": pos_div("MC_mn", "CFO_TTM"),
            "EV_EBITDA_STRICT": pos_div("EV_A", "TTM_OIBDP"), "CFO_AT_FLEX": pos_div("CFO_TTM_FLEX", "ATQ"), "PC_FLEX": pos_div("MC_mn", "CFO_TTM_FLEX"),
            "SloanAcc_AT_FLEX": safe_div(c("TTM_NIQ") - c("CFO_TTM_FLEX"), "AVG4_ATQ"), "NOA_AT_FLEX": pos_div("NOA_FLEX", "ATQ"), "EV_EBITDA_FLEX": pos_div("EV_FLEX", "TTM_OIBDP"),
        }
    ).withColumn("EV_EBITDA", c("EV_EBITDA_FLEX"))
    df = df.withColumn("core_non_null", count_present(CORE))
    return df.select("asof_date", c("LPERMNO").alias("permno"), c("GVKEY").alias("gvkey"), *BASE, "EV_src", "CFO_src", "NOA_src", "MC_mn", "EV_FLEX", "core_non_null")
