"""Checks of bar frames: one conditional aggregation, and two anti-joins against the expected grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators import calendars

#: fixed values: greatest move from close to close of one bar by calendar, and the greatest share of bars without a trade
MOVES = {"24/7": 0.25, "us_equity": 0.15, "fx": 0.05}
FILLED = 0.02


def check_bars(bars: DataFrame, calendar: str | None = None) -> DataFrame:
    """Counts per symbol: rows, repeated times, inconsistent or non-positive prices, moves beyond the calendar's limit, the
    share of flat bars without a trade, and, where rows carry a `position`, those out of order."""
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = bars.withColumn("before", F.lag("close").over(w)).withColumn("same", F.count("*").over(Window.partitionBy("symbol", "ts")))
    by = calendars.describe(bars).select("symbol", "calendar") if calendar is None else bars.select("symbol").distinct().withColumn("calendar", F.lit(calendar))
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in MOVES.items() for x in pair)), F.col("calendar"))
    unordered = F.lit(False)
    if "position" in bars.columns:
        rows = rows.withColumn("earlier", F.lag("ts").over(Window.partitionBy("symbol").orderBy("position")))
        unordered = F.col("ts") < F.col("earlier")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")).cast("long")
    flat = (F.col("volume") <= 0) & (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))
    return rows.join(by, "symbol").groupBy("symbol", "calendar").agg(
        F.count("*").alias("bars"), n(F.col("same") > 1).alias("duplicates"), n(unordered).alias("unordered"),
        n((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("low") <= 0)).alias("inconsistent"),
        n(F.abs(F.try_divide("close", "before") - 1) > limit).alias("jumps"), F.avg(F.coalesce(flat, F.lit(False)).cast("int")).alias("flat_share"))


def issues(bars: DataFrame, symbols: list[str], calendar: str | None = None) -> DataFrame:
    """One row per symbol and problem, with what was found; a symbol without bars is empty. No rows: no problems."""
    spark, seen = bars.sparkSession, check_bars(bars, calendar)
    found = {"duplicates": F.col("duplicates") > 0, "order": F.col("unordered") > 0, "ohlc": F.col("inconsistent") > 0, "jump": F.col("jumps") > 0, "filled": (F.col("calendar") != "24/7") & (F.col("flat_share") > FILLED)}
    amount = {"duplicates": "duplicates", "order": "unordered", "ohlc": "inconsistent", "jump": "jumps", "filled": "flat_share"}
    rows = F.explode(F.filter(F.array(*(F.when(c, F.struct(F.lit(k).alias("issue"), F.col(amount[k]).cast("double").alias("amount"))) for k, c in found.items())), lambda x: x.isNotNull()))
    empty = spark.createDataFrame([(x,) for x in symbols], "symbol string").join(seen, "symbol", "left_anti").select("symbol", F.lit("empty").alias("issue"), F.lit(0.0).alias("amount"))
    return seen.select("symbol", rows.alias("i")).select("symbol", "i.*").unionByName(empty)


def session_issues(bars: DataFrame, expected: DataFrame) -> DataFrame:
    keys = ["symbol", "ts"]
    missing = expected.join(bars, keys, "left_anti").select(*keys, F.lit("missing").alias("issue"))
    return missing.unionByName(bars.join(expected, keys, "left_anti").select(*keys, F.lit("outside").alias("issue")))
