"""Factor regressions from moment sums, whole-sample and rolling (RG1-RG5, W13).

Days that lack a return or a factor are left out; rows that repeat a date each count; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FACTORS = ("Mkt_RF", "SMB", "HML", "RMW", "CMA", "Mom")
NAMES = ("mkt", "smb", "hml", "rmw", "cma", "mom")


def _terms(factors: Sequence[str]) -> list[tuple[str, object]]:
    """Names and expressions of the products whose sums make up the normal equations; the constant comes first."""
    x = [F.lit(1.0), *[F.col(c) for c in factors]]
    out = [(f"g_{i}_{j}", x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]
    return out + [(f"y_{i}", x[i] * F.col("r")) for i in range(len(x))] + [("yy", F.col("r") * F.col("r"))]


def joined(series: DataFrame, factors: DataFrame) -> DataFrame:
    """Series with the factors of its days; days that lack a return or a factor go (J6, RG1)."""
    return series.join(factors.select("DATE", *FACTORS), "DATE").dropna(subset=["r", *FACTORS])


def moments(rows: DataFrame, keys: Sequence[str] = ("model", "series"), factors: Sequence[str] = FACTORS) -> DataFrame:
    """Sums of products by key: one pass with map-side partial sums (RG2)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("N"), F.min("DATE").alias("sample_start"), F.max("DATE").alias("sample_end"), *[F.sum(e).alias(n) for n, e in _terms(factors)])


def _matrices(frame: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.zeros((len(frame), k, k))
    for i in range(k):
        for j in range(i, k):
            g[:, i, j] = g[:, j, i] = frame[f"g_{i}_{j}"]
    return g, np.stack([frame[f"y_{i}"].to_numpy(float) for i in range(k)], axis=1)


def ols_report(rows: DataFrame, least: int = 30) -> DataFrame:
    """alpha, betas, t-values, R2 and adjusted R2 of each series; status tells why one is missing (RG2, RG3, RG5)."""
    k = len(FACTORS) + 1
    names = ["alpha", "t_alpha", *[f"{p}_{n}" for n in NAMES for p in ("beta", "t")], "R2", "Adj_R2"]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            g, y = _matrices(frame, k)
            out = []
            for n, a, b, yy in zip(frame["N"], g, y, frame["yy"], strict=True):
                try:
                    if n < least:
                        raise ValueError("too few days")
                    if np.linalg.matrix_rank(a) < k:
                        raise ValueError("collinear factors")
                    inverse = np.linalg.inv(a)
                    beta = inverse @ b
                    rss = yy - beta @ b
                    t = beta / np.sqrt(rss / (n - k) * np.diag(inverse))
                    r2 = 1 - rss / (yy - b[0] ** 2 / n)
                    values = [beta[0], t[0], *[v for i in range(1, k) for v in (beta[i], t[i])], r2, 1 - (1 - r2) * (n - 1) / (n - k)]
                    out.append([*map(float, values), "ok"])
                except (ValueError, np.linalg.LinAlgError) as why:
                    out.append([None] * len(names) + [str(why)])
            head = frame[["model", "series", "sample_start", "sample_end", "N"]].reset_index(drop=True)
            yield pd.concat([head, pd.DataFrame(out, columns=[*names, "status"])], axis=1)

    schema = "model string, series string, sample_start date, sample_end date, N bigint, " + ", ".join(f"{n} double" for n in names) + ", status string"
    return moments(rows).mapInPandas(solve, schema)


def rolling_moments(rows: DataFrame, window: int, keys: Sequence[str] = ("model", "series"), factors: Sequence[str] = FACTORS) -> DataFrame:
    """The same sums over the last `window` rows of each series, where there are as many.

    Each sum is the difference of two running sums, so that a row costs the same for any window. A series is one task: its
    days, some 250 a year.
    """
    w = W.partitionBy(*keys).orderBy("DATE")
    terms = _terms(factors)
    running = rows.select(*keys, "DATE", F.row_number().over(w).alias("_row"), *[F.sum(e).over(w.rowsBetween(W.unboundedPreceding, 0)).alias(n) for n, e in terms])
    sums = running.select(*keys, "DATE", "_row", *[(F.col(n) - F.coalesce(F.lag(n, window).over(w), F.lit(0.0))).alias(n) for n, _ in terms])
    return sums.where(F.col("_row") >= window).select(*keys, "DATE", F.lit(window).cast("bigint").alias("N"), *[n for n, _ in terms])


def rolling_alpha(rows: DataFrame, window: int = 1260) -> DataFrame:
    """Yearly alpha of every day's trailing regression (RG4)."""
    k = len(FACTORS) + 1

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            g, y = _matrices(frame, k)
            alpha = (np.linalg.pinv(g) @ y[:, :, None])[:, 0, 0] * 252
            yield pd.DataFrame({"model": frame["model"], "series": frame["series"], "DATE": frame["DATE"], "alpha": alpha})

    return rolling_moments(rows, window).mapInPandas(solve, "model string, series string, DATE date, alpha double")


def single_factor(rows: DataFrame) -> DataFrame:
    """Slope, intercept and R2 on the market alone, by built-in aggregates (RG2)."""
    return rows.groupBy("model", "series").agg(F.count("*").alias("n"), F.regr_slope("r", "Mkt_RF").alias("beta"), F.regr_intercept("r", "Mkt_RF").alias("alpha"), F.regr_r2("r", "Mkt_RF").alias("r2"))
