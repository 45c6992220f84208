"""Composite scores, rankings and score dynamics.

Null scores are not ranked, and ties go by the lower security number; repeated rows of a name each take a rank; empty
tables give no rows. The anchors of a history, a few hundred, are numbered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import weighted_mean
from ..functions.windows import along, sliding_members
from .robust import long_form, robust_z

#: The features of the three pillars; a feature that coalesces; those for which high is bad.
USE = {"CFO_AT_use": ("CFO_AT", "CFO_AT_FLEX"), "PC_use": ("PC", "PC_FLEX"), "SloanAcc_use": ("SloanAcc_AT", "SloanAcc_AT_FLEX"), "NOA_AT_use": ("NOA_AT", "NOA_AT_FLEX"), "EV_EBITDA_use": ("EV_EBITDA_STRICT", "EV_EBITDA", "EV_EBITDA_FLEX")}
PILLARS = {"P": ("GP_AT", "OP_BE", "ROA_TTM", "CFO_AT_use"), "V": ("MB", "PE", "PC_use", "EV_EBITDA_use"), "Q": ("SloanAcc_use", "AssetGrowth", "NOA_AT_use", "NetShareIss")}
HIGH_IS_BAD = PILLARS["V"] + PILLARS["Q"]
IDS = ["asof_date", "gvkey", "permno"]
WINDOW, LEAST_SHARE = 12, 0.6


def least_observations(window: int = WINDOW, share: float = LEAST_SHARE) -> int:
    return max(3, math.ceil(share * window))


def standardised(ratios: DataFrame) -> DataFrame:
    """asof_date, gvkey, permno, pillar, feature, z: robust z-scores of the 12 features, high always good."""
    features = [(f, F.coalesce(*[F.col(c) for c in USE.get(f, (f,))])) for fs in PILLARS.values() for f in fs]
    long = long_form(ratios, IDS, features).withColumn("bad", F.col("feature").isin(*HIGH_IS_BAD))
    pillar = F.create_map(*[F.lit(x) for p, fs in PILLARS.items() for f in fs for x in (f, p)])
    return robust_z(long, ["asof_date", "feature"], "x", "z", F.col("bad")).select(*IDS, pillar[F.col("feature")].alias("pillar"), "feature", "z")


def mean_in_order(features: Sequence[str], value: str = "z") -> Column:
    """Mean of the `value`s of a group's features, summed in their order: names with equal values get equal means, whatever the shuffle's order.

    Else names that tie would be ranked by the last bits of their sums, and otherwise in each run.
    """
    own = [F.when(F.col("feature") == f, F.col(value)) for f in features]
    total = sum((F.coalesce(F.sum(x), F.lit(0.0)) for x in own), F.lit(0.0))
    return F.try_divide(total, sum((F.count(x) for x in own), F.lit(0)))


def composite(ratios: DataFrame, weights: dict[str, float] | None = None, least: int = 2) -> DataFrame:
    """Pillar scores and their mean, null with fewer than `least` pillars."""
    w = weights or {p: 1 / 3 for p in PILLARS}
    by = standardised(ratios).groupBy(*IDS).agg(*[mean_in_order(fs).alias(f"score_{p}") for p, fs in PILLARS.items()])
    return by.withColumn("score", weighted_mean([f"score_{p}" for p in PILLARS], [w[p] for p in PILLARS], least))


def ranked(df: DataFrame, keys: Sequence[str] = ("asof_date",), score: str = "score", tie: str = "permno") -> DataFrame:
    """Rank from 1, high score first, without null scores."""
    return df.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(along(keys, [F.col(score).desc(), F.col(tie)])))


def anchor_ranking(ratios: DataFrame) -> DataFrame:
    return ranked(composite(ratios)).select("asof_date", "rank", "gvkey", "permno", "score")


def score_dynamics(scores: DataFrame, window: int = WINDOW, keys: Sequence[str] = ("permno", "gvkey"), share: float = LEAST_SHARE) -> DataFrame:
    """For each window of `window` anchors and entity: slope of the re-standardised score on time, level, volatility of its changes.

    An entity needs the least number of observations, not one at the last anchor; changes are over available rows. Each
    score is repeated for the windows that hold it, and one partitioning by window and entity serves lag and sums.
    """
    least = least_observations(window, share)
    z = robust_z(scores.where("score is not null"), ["asof_date"], "score", "score_z", winsor=None)
    dates = scores.select("asof_date").distinct()
    order = dates.withColumn("index", F.row_number().over(W.orderBy("asof_date")) - 1)  # a row an anchor
    last = order.agg(F.max("index").alias("last"))
    rows = sliding_members(z.join(order, "asof_date").crossJoin(F.broadcast(last)), "index", F.col("last"), window)
    rows = rows.withColumn("t", (F.col("index") - F.col("window_end") + (window - 1)).cast("double"))
    group = ["window_end", *keys]
    rows = rows.withColumn("change", F.col("score_z") - F.lag("score_z").over(along(group, ["t"])))
    s, t = F.col("score_z"), F.col("t")
    sums = rows.groupBy(*group).agg(F.count("*").alias("k"), F.sum(t).alias("st"), F.sum(t * t).alias("stt"), F.sum(s).alias("ss"), F.sum(s * t).alias("sst"), F.avg(s).alias("mean"), F.stddev_samp("change").alias("vol"), F.count("change").alias("nd"))
    spread = F.col("k") * F.col("stt") - F.col("st") * F.col("st")
    slope = F.when((spread > 0) & (F.col("k") >= least), (F.col("k") * F.col("sst") - F.col("st") * F.col("ss")) / spread)
    out = sums.join(order.withColumnRenamed("index", "window_end"), "window_end")
    return out.select("asof_date", *keys, F.col("k").alias("n_obs"), slope.alias("slope_score"), F.when(F.col("k") >= least, F.col("mean")).alias("avg_score"), F.when(F.col("nd") >= least - 1, F.col("vol")).alias("vol_dscore"))


def investment_ranking(scores: DataFrame, window: int = WINDOW) -> DataFrame:
    """Mean of the robust z-scores of slope, level and (inverted) volatility, ranked."""
    ids, measures = ["asof_date", "gvkey", "permno"], ("slope_score", "avg_score", "vol_dscore")
    long = long_form(score_dynamics(scores, window), ids, [(c, F.col(c)) for c in measures])
    z = robust_z(long, ["asof_date", "feature"], "x", "z", F.col("feature") == "vol_dscore")
    return ranked(z.groupBy(*ids).agg(mean_in_order(measures).alias("score"))).select("asof_date", "rank", "gvkey", "permno", "score")


def score_features(scores: DataFrame, window: int = WINDOW) -> DataFrame:
    """date, permno, avg_score, slope_score, vol_dscore of all windows, by security."""
    out = score_dynamics(scores.groupBy("asof_date", "permno").agg(F.max("score").alias("score")), window, ["permno"])
    return out.select(F.col("asof_date").alias("date"), "permno", "avg_score", "slope_score", "vol_dscore").where("avg_score is not null or slope_score is not null or vol_dscore is not null")
