"""Walk-forward rankings: weighted ridge on moment sums, and boosted trees (ML1-ML8).

Walk-forward training windows are key columns: a row of the feature panel joins every anchor whose window holds it, so
one job fits all anchors and horizons. Rows shrink to moment sums before any Python sees them; a Python task solves a
k x k system for each (anchor, horizon). Boosted trees shrink to histograms: see `boosting`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import decay_weight, finite
from .boosting import MODEL, Settings, best_trees, fitted, predicted
from .labels import blended

#: The two feature sets.
RATIO_FEATURES = ("GP_AT", "OP_BE", "ROA_TTM", "CFO_AT_FLEX", "MB", "PE", "PC_FLEX", "EV_EBITDA_FLEX", "SloanAcc_AT_FLEX", "AssetGrowth", "NOA_AT_FLEX", "NetShareIss")
SCORE_FEATURES = ("avg_score", "slope_score", "vol_dscore")


def window_days(years: float) -> int:
    return round(365.2425 * years)


def anchor_windows(features: DataFrame, train_years: float = 3.0, least_anchors: int = 12) -> DataFrame:
    """dt, date: every anchor with enough history behind it, and the dates of its training window (F13, W14, ML7).

    A panel of fewer than `least_anchors` dates has none. A few hundred anchors: the range join is over distinct dates only.
    """
    days = window_days(train_years)
    dates = features.select("date").where("date is not null").distinct()
    first = dates.agg(F.min("date").alias("first"), F.count("*").alias("anchors")).where(F.col("anchors") >= least_anchors)  # one row at most
    legal = dates.crossJoin(F.broadcast(first)).where(F.datediff("date", "first") >= days + 365).select(F.col("date").alias("dt"))
    span = legal.withColumn("_m", F.explode(F.expr(f"sequence(trunc(date_sub(dt, {days}), 'month'), trunc(dt, 'month'), interval 1 month)")))
    keyed = dates.withColumn("_m", F.trunc("date", "month"))
    return span.join(keyed, "_m").where((F.col("date") >= F.date_sub("dt", days)) & (F.col("date") < F.col("dt"))).select("dt", "date")


def window_rows(features: DataFrame, columns: Sequence[str], train_years: float = 3.0) -> DataFrame:
    """dt, date, permno and the features of every training row of every anchor (L3)."""
    clean = features.select("date", "permno", *[finite(F.col(c).cast("double")).alias(c) for c in columns])
    return clean.join(anchor_windows(features, train_years), "date")


def selected_medians(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """keys and the exact median `med_c` of each column (null where it has no value), in memory that does not grow with a group.

    A mergeable quantile sketch brackets the middle within 4 / accuracy of the ranks; values below the bracket are counted, those
    inside it are counted by value, and the two middle ranks are read from running counts of these few. Where a sketch misses
    its bound the bracket does not hold the rank, and the whole column of that group is counted by value instead.
    """
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("x")).select(*keys, "x.i", "x.v").where("v is not null")
    slack = 4 / accuracy
    sketch = F.percentile_approx("v", [max(0.0, 0.5 - slack), min(1.0, 0.5 + slack)], accuracy)
    bracket = long.groupBy(*keys, "i").agg(sketch.alias("b"), F.count("*").alias("n")).select(*keys, "i", "n", F.col("b")[0].alias("low"), F.col("b")[1].alias("high"))
    side = long.join(bracket, [*keys, "i"])
    counted = side.groupBy(*keys, "i").agg(F.first("n").alias("n"), F.count_if(F.col("v") < F.col("low")).alias("below"), F.count_if(F.col("v") <= F.col("high")).alias("upto"))
    first, second = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1  # ranks from 1
    holds = (F.col("below") < first) & (second <= F.col("upto"))
    checked = counted.select(*keys, "i", "below", holds.alias("holds"))
    inner = side.join(checked, [*keys, "i"]).where("not holds or (v >= low and v <= high)")
    values = inner.groupBy(*keys, "i", "v").agg(F.count("*").alias("m"), F.first("n").alias("n"), F.first(F.when(F.col("holds"), F.col("below")).otherwise(0)).alias("below"))
    run = F.col("below") + F.sum("m").over(W.partitionBy(*keys, "i").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    ranked = values.withColumn("to", run)
    at = lambda rank: F.min(F.when(F.col("to") >= rank, F.col("v")))
    middle = ranked.groupBy(*keys, "i").agg(at(first).alias("a"), at(second).alias("z"))
    wide = middle.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, (F.col("a") + F.col("z")) / 2)).alias(f"med_{c}") for i, c in enumerate(columns)])
    return rows.select(*keys).distinct().join(wide, list(keys), "left")


def impute_values(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """dt and each feature's median over the anchor's whole window, 0 where it has none (ML1, A20)."""
    found = selected_medians(rows, ["dt"], columns)
    return found.select("dt", *[F.coalesce(f"med_{c}", F.lit(0.0)).alias(f"med_{c}") for c in columns])


def imputed(rows: DataFrame, medians: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Features with medians in place of nulls, and a flag for each (ML1)."""
    out = rows.join(medians, "dt")
    keep = [c for c in rows.columns if c not in columns]
    return out.select(*keep, *[F.coalesce(c, f"med_{c}").alias(c) for c in columns], *[F.col(c).isNull().cast("double").alias(f"miss_{c}") for c in columns])


def ridge_moments(train: DataFrame, columns: Sequence[str], half_life: float = 1.5) -> DataFrame:
    """Per (dt, horizon): weight, weighted means, then centred weighted products of all pairs, in long form (ML2, A19).

    Two passes, so that variances do not come from differences of large sums. Names: i, j index the features; y is -1.
    """
    w = decay_weight("date", "dt", half_life)
    rows = train.withColumn("w", w)
    keys = ["dt", "horizon"]
    means = rows.groupBy(*keys).agg(F.sum("w").alias("w_sum"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("mean_y"), *[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(f"mean_{c}") for c in columns])
    centred = rows.join(means, keys).select(*keys, "w", *[(F.col(c) - F.col(f"mean_{c}")).alias(f"c{i}") for i, c in enumerate(columns)], (F.col("y") - F.col("mean_y")).alias("cy"))
    n = len(columns)
    sums = [F.sum(F.col("w") * F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s_{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(F.col("w") * F.col(f"c{i}") * F.col("cy")).alias(f"t_{i}") for i in range(n)]
    return centred.groupBy(*keys).agg(*sums).join(means, keys)


def ridge_coefficients(sums: DataFrame, columns: Sequence[str], alpha: float = 10.0) -> DataFrame:
    """dt, horizon, intercept, beta: solves (Z'WZ + alpha I) b = Z'Wy on the k x k sums of each (dt, horizon) (ML2)."""
    n = len(columns)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = np.zeros((len(f), n, n))
            for i in range(n):
                for j in range(i, n):
                    s[:, i, j] = s[:, j, i] = f[f"s_{i}_{j}"]
            t = np.stack([f[f"t_{i}"].to_numpy(float) for i in range(n)], axis=1)
            variance = np.einsum("kii->ki", s) / f["w_sum"].to_numpy(float)[:, None]
            use = variance > 0  # a constant column has no say
            scale = np.sqrt(np.maximum(variance, 1e-12))
            a = s / scale[:, :, None] / scale[:, None, :] + alpha * np.eye(n)
            beta = np.linalg.solve(a, (t / scale)[:, :, None])[:, :, 0] / scale * use
            mean = np.stack([f[f"mean_{c}"].to_numpy(float) for c in columns], axis=1)
            yield pd.DataFrame({"dt": f["dt"], "horizon": f["horizon"], "intercept": f["mean_y"].to_numpy(float) - (mean * beta).sum(1), "beta": list(beta)})

    return sums.mapInPandas(solve, "dt date, horizon string, intercept double, beta array<double>")


def _matured(windows: DataFrame, labels: DataFrame, horizons: dict[str, int] | None = None) -> DataFrame:
    """Training rows with the labels that had fully passed at the anchor."""
    from .labels import HORIZONS

    months = F.create_map(*[F.lit(x) for h, m in (horizons or HORIZONS).items() for x in (h, m)])[F.col("horizon")]
    return windows.join(labels, ["date", "permno"]).where(F.add_months("date", months) <= F.col("dt"))


def ridge_ranking(features: DataFrame, labels: DataFrame, columns: Sequence[str], train_years: float = 3.0, half_life: float = 1.5, alpha: float = 10.0) -> DataFrame:
    """date, permno, pred_12m, rank for every anchor with enough history, in one job (ML2, ML6-ML8)."""
    rows = window_rows(features, columns, train_years)
    medians = impute_values(rows, columns)
    every = [*columns, *[f"miss_{c}" for c in columns]]
    train = imputed(_matured(rows, labels), medians, columns)
    fitted = ridge_coefficients(ridge_moments(train, every, half_life), every, alpha)
    now = imputed(features.select(F.col("date").alias("dt"), "permno", *[finite(F.col(c).cast("double")).alias(c) for c in columns]), medians, columns)
    scored = now.join(fitted, "dt").select(F.col("dt").alias("date"), "permno", "horizon", (F.col("intercept") + sum((F.col(c) * F.col("beta")[i] for i, c in enumerate(every)), F.lit(0.0))).alias("pred"))
    return _ranked(blended(scored))


def _ranked(predictions: DataFrame) -> DataFrame:
    from .scores import ranked

    return ranked(predictions, ["date"], "pred_12m").select("date", "permno", "pred_12m", "rank")


def tree_rows(features: DataFrame, labels: DataFrame, columns: Sequence[str], train_years: float = 3.0, half_life: float = 1.5) -> DataFrame:
    """dt, horizon, key, features (nulls stay), y, w, late: the training rows of all fits; the last 180 days are the late fold (ML4)."""
    train = _matured(window_rows(features, columns, train_years), labels)
    return train.select("dt", "horizon", F.xxhash64("date", "permno").alias("key"), *columns, "y", decay_weight("date", "dt", half_life).alias("w"), (F.datediff("dt", "date") <= 180).alias("late"))


def tree_models(features: DataFrame, labels: DataFrame, columns: Sequence[str], path: str, train_years: float = 3.0, half_life: float = 1.5, settings: Settings | None = None, warm: bool = False) -> DataFrame:
    """The model table of boosted trees for every anchor and horizon (ML3-ML5, ML7), under `path`.

    All anchors are fitted in one plan. With `warm`, each starts from the trees of the anchor before up to their best round, so
    that anchors follow each other (a step a date, the horizons together) and models grow.
    """
    settings = settings or Settings()
    spark = features.sparkSession
    train = tree_rows(features, labels, columns, train_years, half_life)
    if not warm:
        train.write.parquet(f"{path}/train")
        return fitted(spark.read.parquet(f"{path}/train"), columns, path, settings)
    train.write.partitionBy("dt").parquet(f"{path}/train")  # a step reads its own anchor's rows only
    train, before = spark.read.schema(train.schema).parquet(f"{path}/train"), None
    for k, (dt,) in enumerate(train.select("dt").distinct().orderBy("dt").collect()):  # some hundreds of dates
        model = fitted(train.where(F.col("dt") == F.lit(dt)), columns, f"{path}/{k}", settings, before)
        newest = best_trees(model, settings.patience)
        kept = newest if before is None else newest.select("horizon", "trees").unionByName(before.join(newest, "horizon", "left_anti").select("horizon", "trees"))
        kept.select("horizon", "trees").write.parquet(f"{path}/{k}/before")  # a horizon without rows keeps its older model
        before = spark.read.parquet(f"{path}/{k}/before")
    return spark.read.schema(MODEL).parquet(f"{path}/*/model") if before is not None else spark.createDataFrame([], MODEL)


def tree_ranking(features: DataFrame, labels: DataFrame, columns: Sequence[str], path: str, train_years: float = 3.0, half_life: float = 1.5, settings: Settings | None = None, warm: bool = False) -> DataFrame:
    """date, permno, pred_12m, rank by boosted trees up to the best round of each fit (ML3-ML8).

    Features go in as they are, nulls included; see `boosting`. A panel without a legal anchor gives no rows.
    """
    settings = settings or Settings()
    return tree_predictions(features, columns, tree_models(features, labels, columns, path, train_years, half_life, settings, warm), settings)


def tree_predictions(features: DataFrame, columns: Sequence[str], model: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The ranking that a model table gives: trees up to the best rounds, horizons blended."""
    now = features.select(F.col("date").alias("dt"), "permno", *[finite(F.col(c).cast("double")).alias(c) for c in columns])
    scored = predicted(now, columns, best_trees(model, (settings or Settings()).patience))
    return _ranked(blended(scored.withColumnRenamed("dt", "date")))
