"""Equity panels derived from the star-schema tables, so that every operator runs on given data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ret() -> Column:
    return F.when(F.min("l_linenumber") == 7, None).otherwise(F.round(F.avg(F.col("l_discount") - F.col("l_tax")) - 0.01, 8))


def _delisting(df: DataFrame) -> DataFrame:
    last = F.max("DATE").over(W.partitionBy("PERMNO"))
    return df.withColumn("DLRET", F.when((F.col("PERMNO") % 7 == 0) & (F.col("DATE") == last), -0.05))


def returns_d(lineitem: DataFrame) -> DataFrame:
    """PERMNO, DATE, RET, DLRET: a supplier as a security, a day as a date."""
    by = lineitem.groupBy(F.col("l_suppkey").cast("bigint").alias("PERMNO"), F.col("l_shipdate").cast("date").alias("DATE")).agg(_ret().alias("RET"))
    return _delisting(by)


def returns_m(lineitem: DataFrame) -> DataFrame:
    """The same by month, with PRC, SHROUT, CFACSHR and VWRETD."""
    by = lineitem.groupBy(F.col("l_suppkey").cast("bigint").alias("PERMNO"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("DATE")).agg(
        _ret().alias("RET"), F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 8).alias("PRC"), F.sum(F.col("l_quantity").cast("double")).alias("SHROUT")
    )
    k = F.col("PERMNO")
    market = by.groupBy("DATE").agg(F.round(F.avg("RET"), 8).alias("VWRETD"))
    full = by.join(market, "DATE").withColumns({"PRC": F.when(k % 11 == 0, -F.col("PRC")).otherwise(F.col("PRC")), "CFACSHR": 1 + (k % 3) / 10})
    return _delisting(full)


#: The stocks as a share of ATQ plus so much for each unit of quantity; where a column is null, by PERMNO.
STOCKS = {"ACTQ": (0.4, 10), "CHEQ": (0.1, 5), "LCTQ": (0.25, 3), "DLCQ": (0.05, 1), "TXPQ": (0.02, 0.5), "IVSTQ": (0.03, 0), "DLTTQ": (0.2, 2), "MIBQ": (0.01, 0), "LTQ": (0.55, 4), "SEQQ": (0.4, -2), "TXDITCQ": (0.02, 0), "PSTKRQ": (0.01, 0), "PSTKRV": (0.015, 0), "PSTKQ": (0.02, 0)}
HOLES = {"IVSTQ": (4, 1), "TXPQ": (10, 3), "DLCQ": (14, 5), "COGSQ": (13, 0), "PSTKRQ": (3, 0), "PSTKRV": (17, 0), "PSTKQ": (17, 0), "NIQ": (19, 0), "ATQ": (23, 0)}


def fundamentals_q(lineitem: DataFrame) -> DataFrame:
    """A quarterly fundamentals panel: a supplier's sales stand for its accounts."""
    c, k = F.col, F.col("LPERMNO")
    end = F.date_sub(F.add_months(F.trunc(F.col("l_shipdate").cast("date"), "quarter"), 3), 1)
    df = lineitem.groupBy(F.col("l_suppkey").cast("bigint").alias("LPERMNO"), end.alias("DATADATE")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("SALEQ"), F.round(F.sum(c("l_extendedprice") * (0.5 + c("l_discount"))), 4).alias("COGSQ"),
        F.round(F.sum(c("l_extendedprice") * c("l_tax")) * 0.2, 5).alias("XINTQ"), F.sum(c("l_quantity").cast("double")).alias("q"),
    )
    df = df.withColumns({"XSGAQ": F.round(0.1 * c("SALEQ"), 4), "DPQ": F.round(0.05 * c("SALEQ"), 4), "ATQ": F.round(4 * c("SALEQ") + 1e5 * (k % 9), 4)})
    df = df.withColumn("OIBDPQ", F.round(c("SALEQ") - c("COGSQ") - c("XSGAQ"), 4))
    df = df.withColumn("NIQ", F.round(c("OIBDPQ") - c("XINTQ") - 0.15 * c("SALEQ"), 5))
    df = df.withColumns({n: F.round(a * c("ATQ") + b * c("q"), 4) for n, (a, b) in STOCKS.items()})
    df = df.withColumns({n: F.when(k % m == r, None).otherwise(c(n)) for n, (m, r) in HOLES.items()})
    df = df.withColumns(
        {
            "GVKEY": k.cast("string"), "RDQ": F.when(k % 5 == 0, None).otherwise(F.date_add("DATADATE", (30 + k % 45).cast("int"))),
            "LINKDT": F.when(k % 8 == 0, F.lit("1996-01-01").cast("date")), "LINKENDDT": F.when(k % 8 == 1, F.lit("1999-12-31").cast("date")),
        }
    )
    return df.drop("q")


def factors_d(lineitem: DataFrame) -> DataFrame:
    """DATE and seven factors: differences of mean l_discount - l_tax between groups of lines, and a constant rate."""
    x = F.col("l_discount") - F.col("l_tax")

    def gap(a: Column, b: Column) -> Column:
        return F.coalesce(F.round(F.avg(F.when(a, x)) - F.avg(F.when(b, x)), 8), F.lit(0.0))

    c = F.col
    return lineitem.groupBy(F.col("l_shipdate").cast("date").alias("DATE")).agg(
        F.round(F.avg(x) - 0.01, 8).alias("Mkt_RF"), gap(c("l_returnflag") == "A", c("l_returnflag") == "R").alias("SMB"), gap(c("l_linestatus") == "F", c("l_linestatus") == "O").alias("HML"),
        gap(c("l_partkey") % 2 == 0, c("l_partkey") % 2 == 1).alias("RMW"), gap(c("l_partkey") % 3 == 0, c("l_partkey") % 3 == 1).alias("CMA"), gap(c("l_orderkey") % 2 == 0, c("l_orderkey") % 2 == 1).alias("Mom"), F.first(F.lit(0.0001)).alias("RF"),
    )
