"""Window expressions that demand full frames or run along one entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def along(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*order)


def full_sum(c: Column, w: WindowSpec, rows: int) -> Column:
    """Rolling sum that is null unless the frame holds `rows` numbers."""
    frame = w.rowsBetween(1 - rows, 0)
    return F.when(F.count(c).over(frame) == rows, F.sum(c).over(frame))


def full_mean(c: Column, w: WindowSpec, rows: int) -> Column:
    """Rolling mean with the same demand."""
    frame = w.rowsBetween(1 - rows, 0)
    return F.when(F.count(c).over(frame) == rows, F.avg(c).over(frame))


def change(c: Column, w: WindowSpec, rows: int = 1) -> Column:
    """Difference to `rows` before."""
    return c - F.lag(c, rows).over(w)


def period_return(c: Column, w: WindowSpec) -> Column:
    """Level over the level before, less 1."""
    return F.try_divide(c, F.lag(c).over(w)) - 1


def running_log_return(ret: Column, w: WindowSpec) -> Column:
    """Running sum of log returns; null counts as 0, a return of -1 or less as 0 too (count these apart, W5)."""
    return F.sum(F.when(ret > -1, F.log1p(ret)).otherwise(0.0)).over(w.rowsBetween(W.unboundedPreceding, 0))


def running_losses(ret: Column, w: WindowSpec) -> Column:
    """How many returns of -1 or less there have been so far."""
    return F.sum(F.when(ret <= -1, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))


def running_product(c: Column, w: WindowSpec) -> Column:
    """Running product."""
    return F.product(c).over(w.rowsBetween(W.unboundedPreceding, 0))


def sliding_members(df: DataFrame, index: str, last: Column, size: int, out: str = "window_end") -> DataFrame:
    """Each row once for every window of `size` consecutive indexes that holds it (W12); a member need not be at the end."""
    ends = F.sequence(F.greatest(F.col(index), F.lit(size - 1)), F.least(F.col(index) + size - 1, last))
    ok = F.greatest(F.col(index), F.lit(size - 1)) <= F.least(F.col(index) + size - 1, last)
    return df.withColumn(out, F.explode(F.when(ok, ends)))
