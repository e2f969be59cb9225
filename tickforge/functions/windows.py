"""Window expressions shared by the feature operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

try:
    from pyspark.sql.internal import InternalFunction

    _ewm_window = InternalFunction.ewm
except ImportError:  # the JVM window expression is not exposed by this build
    _ewm_window = None

# weight below which an old observation cannot change a double result
NEGLIGIBLE = 2.0 ** -60


def span_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def ewm_memory(alpha: float) -> int:
    """Rows after which an exponential mean has forgotten its start."""
    return math.ceil(math.log(NEGLIGIBLE) / math.log1p(-alpha))


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def full(w: WindowSpec, n: int, agg, value: Column) -> Column:
    """agg(value) over the last n rows, null until n non-null values exist."""
    frame = last_rows(w, n)
    return F.when(F.count(value).over(frame) == n, agg(value).over(frame))


def warm(index: Column, first_valid: int, value: Column) -> Column:
    """value, null before row first_valid of the period."""
    return F.when(index >= first_valid, value)


def ewm_mean(value: Column, alpha: float, w: WindowSpec) -> Column:
    """Recursive mean y = (1 - a) y' + a x, seeded with the first non-null value.

    The window expression weighs all rows (adjusted form); the recursive form
    differs only in the weight of the first value.
    """
    if _ewm_window is None:
        return ewm_mean_bounded(value, alpha, w)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    decay = F.pow(F.lit(1.0 - alpha), F.count(value).over(upto))
    seed = F.first(value, ignorenulls=True).over(upto)
    return _ewm_window(value, alpha, False).over(w) * (1.0 - decay) + seed * decay


def ewm_mean_bounded(value: Column, alpha: float, w: WindowSpec) -> Column:
    """The same mean with public functions only: fold the rows it remembers."""
    rows = F.collect_list(value).over(last_rows(w, ewm_memory(alpha) + 1))
    return F.aggregate(
        F.slice(rows, 2, ewm_memory(alpha) + 1),
        F.get(rows, 0),
        lambda y, x: y * (1.0 - alpha) + x * alpha,
    )


def ewm_std(value: Column, alpha: float, w: WindowSpec) -> Column:
    """Bias-corrected exponential standard deviation, null for the first value."""
    m1 = ewm_mean(value, alpha, w)
    m2 = ewm_mean(value * value, alpha, w)
    n = F.count(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    q = F.pow(F.lit(1.0 - alpha), 2 * (n - 1))
    sum_w2 = q + alpha ** 2 * (1.0 - q) / (1.0 - (1.0 - alpha) ** 2)
    return F.when(n >= 2, F.sqrt(F.greatest(m2 - m1 * m1, F.lit(0.0)) / (1.0 - sum_w2)))


def clip(value: Column, lo: float, hi: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(float(hi))), F.lit(float(lo))))


def flag(condition: Column) -> Column:
    """1.0 where true, 0.0 where false or unknown."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def seconds(time: Column) -> Column:
    return F.unix_seconds(time)


def nearest(value: Column, grid: list[float]) -> Column:
    """Grid member closest to value; the first one wins a tie."""
    ranked = F.array(*[F.struct(F.abs(value - F.lit(g)), F.lit(i), F.lit(float(g)).alias("g")) for i, g in enumerate(grid)])
    return F.array_min(ranked)["g"]
