"""Indicators with a finite or cumulative frame, as columns: code-generated, one sort per symbol.

Undefined is NULL, never NaN; a rolling value needs its whole frame.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def by(*keys: str):
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("ts")


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rolling(agg, x, n: int, w=None, least: int | None = None) -> Column:
    frame = (w if w is not None else by()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(x)).over(frame) >= (n if least is None else least), agg(col(x)).over(frame))


def sma(x="close", n: int = 20, w=None) -> Column:
    return rolling(F.avg, x, n, w)


def lag(x="close", n: int = 1, w=None) -> Column:
    return F.lag(col(x), n).over(w if w is not None else by())


def pct_change(x="close", n: int = 1, w=None) -> Column:
    return F.try_divide(col(x), lag(x, n, w)) - 1


def true_range(w=None) -> Column:
    before = lag("close", 1, w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def bollinger(x="close", n: int = 20, mult: float = 2.0, w=None) -> dict[str, Column]:
    mid, dev = sma(x, n, w), rolling(F.stddev_pop, x, n, w)
    return {"mid": mid, "upper": mid + mult * dev, "lower": mid - mult * dev}


def donchian(n: int = 20, w=None) -> dict[str, Column]:
    upper, lower = rolling(F.max, "high", n, w), rolling(F.min, "low", n, w)
    return {"upper": upper, "lower": lower, "mid": (upper + lower) / 2}


def zscore(x="close", n: int = 20, w=None) -> Column:
    return F.try_divide(col(x) - sma(x, n, w), rolling(F.stddev_pop, x, n, w))


def pct_rank(x, n: int, least: int, w=None) -> Column:
    """Share of the defined values in the frame that are at most the current one. The frame is bounded by n."""
    frame = (w if w is not None else by()).rowsBetween(-(n - 1), 0)
    values = F.collect_list(col(x)).over(frame)
    return F.when((F.size(values) >= least) & col(x).isNotNull(), F.size(F.filter(values, lambda v: v <= col(x))) / F.size(values))


def long_short(up: Column, down: Column, allow_short: bool = True) -> Column:
    """+1, -1 or 0; short wins where both hold; an undefined comparison is false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(down) & F.lit(allow_short), -1.0).when(yes(up), 1.0).otherwise(0.0)


def scale_forecast(raw: str, least: int, w=None) -> Column:
    """Forecast scaled so that its mean size so far is half of the cap, in [-1, 1]; undefined is 0."""
    frame = (w if w is not None else by()).rowsBetween(Window.unboundedPreceding, 0)
    size = F.when(F.count(raw).over(frame) >= least, F.avg(F.abs(F.col(raw))).over(frame))
    forecast = F.try_divide(F.col(raw) * 10, size)
    return F.coalesce(F.when(forecast > 20, 20.0).when(forecast < -20, -20.0).otherwise(forecast) / 20, F.lit(0.0))
