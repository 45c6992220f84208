"""Column expressions: guarded arithmetic, tolerant parsing, cascades and null-aware means."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: str | Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != INF)


def finite(c: str | Column) -> Column:
    """The number, or null where it is not finite."""
    return F.when(is_finite(c), col(c))


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / den where den is finite and not 0."""
    return F.when(is_finite(den) & (col(den) != 0), F.try_divide(col(num), col(den)))


def pos_div(num: str | Column, den: str | Column) -> Column:
    """num / den where den is finite and above 0 (E5)."""
    return F.when(is_finite(den) & (col(den) > 0), F.try_divide(col(num), col(den)))


def or_zero(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0.0))


def parse_date(c: str | Column) -> Column:
    """A date from a date, an ISO text or a yyyymmdd text or number; null for anything else."""
    text = F.trim(col(c).cast("string"))
    return F.coalesce(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), F.when(text.rlike(r"^\d{8}(\.0)?$"), F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd")))


def parse_any_date(c: str | Column) -> Column:
    """As parse_date, and smaller whole numbers as days since 1960-01-01."""
    text = F.trim(col(c).cast("string"))
    return F.coalesce(parse_date(c), F.when(text.rlike(r"^-?\d{1,6}(\.0+)?$"), F.date_add(F.lit("1960-01-01").cast("date"), text.cast("double").cast("int"))))


def first_valid(choices: Sequence[tuple[Column, Column, str]], none: str = "NA") -> tuple[Column, Column]:
    """Value and letter of the first choice (condition, value, letter) whose condition holds."""
    value, letter = F.lit(None).cast("double"), F.lit(none)
    for ok, expression, tag in reversed(choices):
        value, letter = F.when(ok, expression).otherwise(value), F.when(ok, F.lit(tag)).otherwise(letter)
    return value, letter


def count_present(columns: Sequence[str | Column]) -> Column:
    """How many of the columns are not null."""
    return sum((col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def weighted_mean(columns: Sequence[str | Column], weights: Sequence[float], least: int = 1) -> Column:
    """Mean of the columns that are present, by weight; null with fewer than `least` of them."""
    top = sum((F.coalesce(col(c) * w, F.lit(0.0)) for c, w in zip(columns, weights, strict=True)), F.lit(0.0))
    below = sum((F.when(col(c).isNotNull(), w).otherwise(0.0) for c, w in zip(columns, weights, strict=True)), F.lit(0.0))
    return F.when((count_present(columns) >= least) & (below > 0), F.try_divide(top, below))


def clip(c: str | Column, low: Column, high: Column) -> Column:
    """Winsorise; null stays null."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, high), low))


def log_growth(now: Sequence[Column], before: Sequence[Column]) -> Column:
    """Log difference of two products; null if a part is missing or a product is not above 0."""
    a, b = now[0] * now[1], before[0] * before[1]
    return F.when((a > 0) & (b > 0), F.ln(a) - F.ln(b))


def market_cap(price: str | Column, shares: str | Column) -> Column:
    """Millions, from a price that may carry a sign and shares in thousands."""
    return F.abs(col(price)) * col(shares) / 1000.0


def total_return(ret: str | Column, delisting: str | Column) -> Column:
    """Return with the delisting return; nulls and bad text count as 0."""
    return (1 + or_zero(ret)) * (1 + F.coalesce(col(delisting).cast("string").try_cast("double"), F.lit(0.0))) - 1


def anniversary(d: str | Column) -> Column:
    """The same month next year, the day at most 28."""
    d = col(d)
    return F.make_date(F.year(d) + 1, F.month(d), F.least(F.dayofmonth(d), F.lit(28)))


def decay_weight(date: str | Column, now: str | Column, half_life_years: float) -> Column:
    """Weight that halves every `half_life_years`, at least 1e-8."""
    age = F.datediff(col(now), col(date)) / 365.2425
    return F.greatest(F.lit(1e-8), F.exp(-math.log(2.0) * age / max(half_life_years, 1e-9)))
