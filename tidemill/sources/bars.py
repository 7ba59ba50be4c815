"""Bars made from the event and order tables.

A bar frame has symbol, ts (bar open, TIMESTAMP_NTZ in UTC), open, high, low, close, volume and
funding_rate. Everything is a group-by or a window per symbol, so symbols spread over executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICE_STEP = 0.0004


def by_symbol(*more: str):
    return Window.partitionBy(*more, "symbol").orderBy("ts")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, event_id, value, price: a geometric walk driven by the events' values.

    The walk is a running sum within each day on top of the days before, so a symbol's ticks are
    spread over tasks by day. Prices are in steps of a ten-thousandth: ties are the same in any engine, and an
    average of 20 of them is a whole number of millionths.
    """
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", "value", F.to_date("ts").alias("day"), (F.col("value") - 50).alias("step"))
    days = e.groupBy("symbol", "day").agg(F.sum("step").alias("of_day"))
    before = days.select("symbol", "day", F.coalesce(F.sum("of_day").over(Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    inside = F.sum("step").over(Window.partitionBy("symbol", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    walk = F.col("before") + F.col("inside")
    return e.withColumn("inside", inside).join(before, ["symbol", "day"]).select("symbol", "ts", "event_id", "value", F.round(100 * F.exp(PRICE_STEP * walk), 4).alias("price"))


def floor_ts(ts: Column, step: str) -> Column:
    return F.window(ts, step).start


def ohlcv(rows: DataFrame, label: Column, order: list[str], price: str = "price") -> DataFrame:
    """First, greatest, least and last price and the row count per symbol and label, in one pass."""
    key = F.struct(*order)
    return rows.groupBy("symbol", label.alias("ts")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"),
        F.count("*").cast("double").alias("volume"))


def resample(bars: DataFrame, label: Column) -> DataFrame:
    """Coarser bars from finer ones."""
    return bars.groupBy("symbol", label.alias("label")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")).withColumnRenamed("label", "ts")


def fill_flat(bars: DataFrame, step: str) -> DataFrame:
    """Every step from a symbol's first bar to its last; a missing bar is flat at the close before, volume 0."""
    span = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select("symbol", F.explode(F.expr(f"sequence(a, b, interval {step})")).alias("ts"))
    close = F.last("close", ignorenulls=True).over(by_symbol())
    full = grid.join(bars, ["symbol", "ts"], "left").withColumn("last_close", close)
    return full.select("symbol", "ts", *(F.coalesce(c, "last_close").alias(c) for c in ("open", "high", "low", "close")), F.coalesce("volume", F.lit(0.0)).alias("volume"))


def funding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular settlements: every symbol is charged the rates of the error events."""
    return table(spark, sf_dir, "events").filter("event_type = 'error'").select("ts", ((F.col("value") - 50) * 1e-6).alias("rate"))


def align_funding(bars: DataFrame, events: DataFrame, step: str, nearest_second: bool = False) -> DataFrame:
    """funding_rate per bar: the sum of settlements in (open, open + step]; 0 where there is none."""
    t = F.col("ts")
    if nearest_second:
        t = F.window(t + F.expr("interval 500 milliseconds"), "1 second").start
    owner = floor_ts(t - F.expr("interval 1 millisecond"), step)
    keys = ["symbol", "ts"] if "symbol" in events.columns else ["ts"]
    rates = events.select(*keys[:-1], owner.alias("ts"), "rate").groupBy(*keys).agg(F.sum("rate").alias("funding_rate"))
    return bars.join(rates, keys, "left").withColumn("funding_rate", F.coalesce("funding_rate", F.lit(0.0)))


def align_forward(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Each charge goes to the first bar at or after it, summed; charges before the first or after the last bar are dropped.

    Union and an ordered window instead of a range join; equal times and duplicates are safe. The window runs backwards
    over the bars and charges of one day, and a charge after its day's last bar takes the first bar of the days after, so a
    symbol's charges spread over tasks by day and each row is read once.
    """
    both = bars.select("symbol", "ts", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("rate")).unionByName(events.select("symbol", "ts", F.lit(0).alias("kind"), "rate")).withColumn("day", F.to_date("ts"))
    bar = F.when(F.col("kind") == 1, F.col("ts"))
    later = Window.partitionBy("symbol").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    days = both.groupBy("symbol", "day").agg(F.min(bar).alias("of_day")).select("symbol", "day", F.min("of_day").over(later).alias("after"), F.min("of_day").over(Window.partitionBy("symbol")).alias("first"))
    inside = F.min(bar).over(Window.partitionBy("symbol", "day").orderBy(F.desc("ts"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("inside", inside).filter("kind = 0").join(days, ["symbol", "day"]).withColumn("bar", F.coalesce("inside", "after")).filter("bar is not null and ts >= first")
    rates = placed.groupBy("symbol", F.col("bar").alias("ts")).agg(F.sum("rate").alias("funding_rate"))
    return bars.join(rates, ["symbol", "ts"], "left").withColumn("funding_rate", F.coalesce("funding_rate", F.lit(0.0)))


def event_bars(spark: SparkSession, sf_dir: str, step: str = "4 hours") -> DataFrame:
    """Gap-filled bars of every event type, with funding."""
    bars = fill_flat(ohlcv(ticks(spark, sf_dir), floor_ts(F.col("ts"), step), ["ts", "event_id"]), step)
    return align_funding(bars, funding_events(spark, sf_dir), step)


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order totals per priority; days without an order are missing."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"), "o_orderkey")
    return ohlcv(rows, floor_ts(F.col("ts"), "1 day"), ["ts", "o_orderkey"]).withColumn("funding_rate", F.lit(0.0))
