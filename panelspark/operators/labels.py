"""Forward-return labels through as-of joins (L1-L3).

Repeated feature rows give one label; repeated return rows each compound; a name without a return before its date, or
before the horizon's end, has no label; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.windows import along, running_log_return, running_losses

#: Horizons in months, and the blend's weights.
HORIZONS = {"3mo": 3, "6mo": 6, "1y": 12}
BLEND = {"3mo": 0.2, "6mo": 0.3, "1y": 0.5}


def probed_growth(probes: DataFrame, returns: DataFrame) -> DataFrame:
    """`probes` (permno, at and others) with cumlog, losses and days of their name's returns up to and including `at`.

    Returns and probes go through one stream by name: one shuffle of the daily panel, however many probes a row has. A probe
    without a return before it has days 0.
    """
    own = [c for c in probes.columns if c != "permno"]
    whole = F.struct(*own)
    kind = probes.select(whole.alias("x")).schema["x"].dataType
    moves = returns.where("DATE is not null").select(F.col("PERMNO").cast(dict(probes.dtypes)["permno"]).alias("permno"), F.col("DATE").alias("_t"), F.lit(0).alias("_side"), F.col("RET").alias("_ret"), F.lit(None).cast(kind).alias("_probe"))
    asked = probes.select("permno", F.col("at").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_ret"), whole.alias("_probe"))
    w = along(["permno"], ["_t", "_side"])
    days = F.sum(1 - F.col("_side")).over(w.rowsBetween(W.unboundedPreceding, 0))
    seen = moves.unionByName(asked).select("permno", "_probe", running_log_return(F.col("_ret"), w).alias("cumlog"), running_losses(F.col("_ret"), w).alias("losses"), days.alias("days"))
    return seen.where("_probe is not null").select("permno", *[f"_probe.{c}" for c in own], "cumlog", "losses", "days")


def forward_labels(features: DataFrame, returns: DataFrame, horizons: dict[str, int] | None = None, truncated: bool = False) -> DataFrame:
    """date, permno, horizon, y: return from each feature date to the last trading day at or before the horizon's end.

    The start and all ends of a row are probes of one pass over the daily panel, and meet again without another shuffle of it.
    Only horizons that have fully passed count; with `truncated`, younger dates get the return so far.
    """
    horizons = horizons or HORIZONS
    last = returns.agg(F.max("DATE").alias("_last"))
    ends = [F.struct(F.lit(h).alias("horizon"), F.add_months("date", m).alias("at")) for h, m in horizons.items()]
    start = F.struct(F.lit(None).cast("string").alias("horizon"), F.col("date").alias("at"))
    rows = features.where("date is not null and permno is not null").select("date", "permno").distinct()
    probes = rows.withColumn("_h", F.explode(F.array(start, *ends))).select("date", "permno", "_h.horizon", "_h.at")
    if not truncated:
        probes = probes.crossJoin(F.broadcast(last)).where("horizon is null or at <= _last").drop("_last")  # one row
    met = probed_growth(probes, returns)
    of = W.partitionBy("permno", "date")
    begun = F.max(F.when(F.col("horizon").isNull(), F.struct("days", "cumlog", "losses"))).over(of)
    both = met.withColumn("_0", begun).where("horizon is not null and _0.days > 0")
    y = F.when(F.col("losses") > F.col("_0.losses"), F.lit(-1.0)).otherwise(F.exp(F.col("cumlog") - F.col("_0.cumlog")) - 1)
    return both.select("date", "permno", "horizon", y.alias("y"))


def blended(predictions: DataFrame, keys: Sequence[str] = ("date", "permno"), weights: dict[str, float] | None = None) -> DataFrame:
    """Mean prediction over the horizons at hand, by the blend's weights (ML6)."""
    w = F.create_map(*[F.lit(x) for h, v in (weights or BLEND).items() for x in (h, v)])[F.col("horizon")]
    return predictions.where("pred is not null").groupBy(*keys).agg(F.try_divide(F.sum(F.col("pred") * w), F.sum(w)).alias("pred_12m"))
