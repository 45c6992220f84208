"""Cross-sectional statistics: nearest-rank quantiles, medians, robust z-scores.

A cross-section is the names of one date and feature: some tens of thousands of rows, whatever the history's length, and
so one task's window. Repeated rows count as often as they stand; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import clip, finite


def _middle(x: Column, rank: Column, n: Column) -> Column:
    """Median of x by its rank from 1 to n."""
    return F.when((rank == F.floor((n + 1) / 2)) | (rank == F.floor(n / 2) + 1), x)


def robust_z(df: DataFrame, keys: Sequence[str], value: str, out: str = "z", invert: bool | Column = False, winsor: float | None = 0.01) -> DataFrame:
    """z-score of `value` within `keys`: centred on the median, scaled by 1.4826 times the median absolute deviation.

    Values are first clipped at the nearest-rank quantiles `winsor` and 1 - `winsor`; median and deviation use unclipped
    values. A scale of 0 falls back on the sample standard deviation, and then on 1. Nulls stay null and do not count.
    All steps are windows over one partitioning by `keys`: one shuffle; a partition is one cross-section.
    """
    x = F.col("_x")
    df = df.withColumn("_x", finite(F.col(value).cast("double"))).withColumn("_has", F.col("_x").isNotNull())
    w = W.partitionBy(*keys, "_has")
    df = df.withColumn("_rank", F.row_number().over(w.orderBy("_x"))).withColumn("_n", F.count("*").over(w))
    at = lambda q: F.max(F.when(F.col("_rank") == F.floor((F.col("_n") - 1) * q + 0.5) + 1, x)).over(w)
    stats = {"_med": F.avg(_middle(x, F.col("_rank"), F.col("_n"))).over(w), "_std": F.stddev_samp(x).over(w)}
    if winsor is not None:
        stats |= {"_lo": at(winsor), "_hi": at(1 - winsor)}
    df = df.withColumns(stats).withColumn("_dev", F.abs(x - F.col("_med")))
    df = df.withColumn("_dev_rank", F.row_number().over(w.orderBy("_dev")))
    df = df.withColumn("_scale", F.lit(1.4826) * F.avg(_middle(F.col("_dev"), F.col("_dev_rank"), F.col("_n"))).over(w))
    scale = F.when(F.col("_scale") > 0, F.col("_scale")).when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)
    clipped = clip(x, F.col("_lo"), F.col("_hi")) if winsor is not None else x
    z = (clipped - F.col("_med")) / scale
    sign = F.when(invert, -z).otherwise(z) if isinstance(invert, Column) else (-z if invert else z)
    return df.withColumn(out, F.when(F.col("_has"), sign)).drop("_x", "_has", "_rank", "_n", "_med", "_std", "_lo", "_hi", "_dev", "_dev_rank", "_scale")


def long_form(df: DataFrame, ids: Sequence[str], features: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row for each feature (name, expression): columns ids, feature, x."""
    pairs = F.array(*[F.struct(F.lit(name).alias("feature"), expression.cast("double").alias("x")) for name, expression in features])
    return df.select(*ids, F.explode(pairs).alias("_f")).select(*ids, "_f.feature", "_f.x")
