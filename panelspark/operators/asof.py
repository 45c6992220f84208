"""As-of joins and calendar look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_by_key(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, values: Sequence[str], exact: bool = True, forward: bool = False) -> DataFrame:
    """`left` with the `values` of the last row of `right` at or before `left_on` for the same keys (`forward`: the first at or after).

    One shuffle by key: both sides in one stream, the right rows first at equal times, and the last value seen so far. Of
    right rows at one time the one with the greatest values (in their order) counts. Left rows with null times get nulls,
    and null keys meet null keys; repeated left rows stay; an empty right side gives nulls.
    """
    packed = F.struct(F.col(right_on).alias("_at"), *[F.col(v) for v in values])
    whole = F.struct(*left.columns)
    kind_left, kind_right = left.select(whole.alias("x")).schema["x"].dataType, right.select(packed.alias("x")).schema["x"].dataType
    order_right = 0 if exact else 1
    keys = [f"_k{i}" for i in range(len(by))]
    own_keys = [F.col(k).alias(n) for k, n in zip(by, keys, strict=True)]
    rows = left.select(*own_keys, F.col(left_on).alias("_t"), F.lit(1 - order_right).alias("_side"), whole.alias("_left"), F.lit(None).cast(kind_right).alias("_right"))
    other = right.where(F.col(right_on).isNotNull())
    other = other.select(*own_keys, F.col(right_on).alias("_t"), F.lit(order_right).alias("_side"), F.lit(None).cast(kind_left).alias("_left"), packed.alias("_right"))
    time = F.col("_t").desc() if forward else F.col("_t").asc()
    w = W.partitionBy(*keys).orderBy(time, "_side", "_right").rowsBetween(W.unboundedPreceding, 0)
    last = F.when(F.col("_t").isNotNull(), F.last("_right", ignorenulls=True).over(w))
    seen = rows.unionByName(other).withColumn("_seen", last).where("_left is not null")
    found = [F.col(f"_seen.{v}").alias(v if v not in left.columns else f"{v}_right") for v in values]
    return seen.select("_left.*", *found, F.col("_seen._at").alias(f"{right_on}_asof"))


def asof_calendar(dates: DataFrame, on: str, calendar: DataFrame, day: str, out: str, forward: bool = False, shift: int = 0) -> DataFrame:
    """`dates` with the last calendar day at or before `on` + `shift` days (`forward`: the first at or after).

    One task sorts the distinct dates and calendar days: some 365 a year, whatever the size of the tables. Null dates get
    null; repeated rows stay; an empty calendar gives nulls.
    """
    target = F.date_add(F.col(on), shift)
    asked = dates.select(F.col(on)).where(F.col(on).isNotNull()).distinct().withColumn("_target", target)
    days = calendar.select(F.col(day).alias("_day")).where("_day is not null").distinct()
    both = asked.select("_target").distinct().withColumn("_one", F.lit(1))
    found = asof_by_key(both, days.withColumn("_one", F.lit(1)), ["_one"], "_target", "_day", ["_day"], forward=forward).select("_target", F.col("_day").alias(out))
    return dates.join(asked.join(found, "_target").select(on, out), on, "left")
