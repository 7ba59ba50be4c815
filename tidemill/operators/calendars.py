"""Sessions, New York clock labels, calendar inference and financing charges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.operators.ledger import spacing

NEW_YORK = "America/New_York"


def easter(year: int) -> dt.date:
    a, b, c = year % 19, year // 100, year % 100
    d = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    e = (32 + 2 * (b % 4) + 2 * (c // 4) - d - c % 4) % 7
    f = d + e - 7 * ((a + 11 * d + 22 * e) // 451) + 114
    return dt.date(year, f // 31, f % 31 + 1)


def nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The nth such weekday of a month; n = -1 is the last."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7)


def us_holidays(year: int) -> set[dt.date]:
    """Full-day closings of the New York stock exchange by its present rules."""
    fixed = [(1, 1), (7, 4), (12, 25), *([(6, 19)] if year >= 2022 else [])]
    out = {nth(year, 1, 0, 3), nth(year, 2, 0, 3), easter(year) - dt.timedelta(2), nth(year, 5, 0, -1), nth(year, 9, 0, 1), nth(year, 11, 3, 4)}
    for m, d in fixed:
        day = dt.date(year, m, d)
        if day.weekday() == 5:
            if (m, d) == (1, 1):
                continue  # a Saturday new year's day isn't made up for
            day -= dt.timedelta(1)
        elif day.weekday() == 6:
            day += dt.timedelta(1)
        out.add(day)
    return out


def us_early_closes(year: int) -> set[dt.date]:
    days = {nth(year, 11, 3, 4) + dt.timedelta(1), dt.date(year, 12, 24), dt.date(year, 7, 3)}
    return {d for d in days if d.weekday() < 5 and d not in us_holidays(year)}


def us_equity_sessions(spark: SparkSession, start: str, end: str) -> DataFrame:
    """session_open and session_close in UTC; early closes at 13:00 New York. A few hundred rows a year."""
    a, b = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    closed = {d for y in range(a.year, b.year + 1) for d in us_holidays(y)}
    early = {d for y in range(a.year, b.year + 1) for d in us_early_closes(y)}
    rows = [(d, "13:00:00" if d in early else "16:00:00") for k in range((b - a).days + 1) if (d := a + dt.timedelta(k)).weekday() < 5 and d not in closed]
    days = spark.createDataFrame([(d.isoformat(), c) for d, c in rows], "day string, close string")
    utc = lambda text: F.convert_timezone(F.lit(NEW_YORK), F.lit("UTC"), F.to_timestamp_ntz(text))
    return days.select(utc(F.concat_ws(" ", "day", F.lit("09:30:00"))).alias("session_open"), utc(F.concat_ws(" ", "day", "close")).alias("session_close"))


def regular_hours(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows inside a session. The sessions, a few hundred a year whatever the data, are broadcast."""
    return rows.join(F.broadcast(sessions), (rows["ts"] >= sessions["session_open"]) & (rows["ts"] < sessions["session_close"]))


def session_buckets(sessions: DataFrame, step: str) -> DataFrame:
    """Half-open buckets from each open, the last one clipped at the close."""
    starts = sessions.withColumn("bucket", F.explode(F.expr(f"sequence(session_open, session_close - interval 1 microsecond, interval {step})")))
    return starts.select("bucket", F.least(F.col("bucket") + F.expr(f"interval {step}"), F.col("session_close")).alias("bucket_end"))


def session_label(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(buckets), (rows["ts"] >= buckets["bucket"]) & (rows["ts"] < buckets["bucket_end"]))


def new_york(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(NEW_YORK), ts)


def fx_trading_hours(rows: DataFrame) -> DataFrame:
    """Sunday from 17:00 to Friday 17:00, New York time."""
    t = new_york(F.col("ts"))
    day, hour = F.weekday(t), F.hour(t)
    return rows.filter((day < 4) | ((day == 4) & (hour < 17)) | ((day == 6) & (hour >= 17)))


def fx_label(ts: Column, step: str) -> Column:
    """Buckets anchored at 17:00 New York wall time, whatever the clock change."""
    shift = F.expr("interval 17 hours")
    return F.convert_timezone(F.lit(NEW_YORK), F.lit("UTC"), F.window(new_york(ts) - shift, step).start + shift)


def mid_bars(bid: DataFrame, ask: DataFrame) -> DataFrame:
    """Mid prices where both sides have a bar; high and low cover open and close."""
    both = bid.alias("b").join(ask.alias("a"), ["symbol", "ts"])
    mid = both.select("symbol", "ts", *(((F.col(f"b.{c}") + F.col(f"a.{c}")) / 2).alias(c) for c in ("open", "high", "low", "close")))
    return mid.select("symbol", "ts", "open", F.greatest("high", "open", "close").alias("high"), F.least("low", "open", "close").alias("low"), "close")


def describe(bars: DataFrame) -> DataFrame:
    """Inferred calendar and its annualisations per symbol."""
    seen = bars.groupBy("symbol").agg(F.bool_or(F.weekday("ts") == 5).alias("saturdays"), F.bool_or(F.weekday("ts") == 6).alias("sundays"))
    out = seen.join(spacing(bars), "symbol")
    calendar = F.when(F.col("saturdays"), "24/7").when(F.col("sundays"), "fx").otherwise("us_equity")
    per_session = F.when(calendar == "us_equity", F.greatest(F.lit(1.0), F.ceil(6.5 * 3600 / F.col("median_step")))).otherwise(F.greatest(F.lit(1.0), F.bround(86400 / F.col("median_step"))))
    sessions = F.when(calendar == "us_equity", 252.0).otherwise(260.0)
    return out.select("symbol", calendar.alias("calendar"), per_session.alias("bars_per_session"),
        F.when(F.col("saturdays"), 365.25 * 86400 / F.col("median_step")).otherwise(sessions * per_session).alias("periods_per_year"),
        F.when(F.col("saturdays"), 86400 / F.col("first_step")).otherwise(per_session).alias("bars_per_day"))


def daily(rates: DataFrame) -> DataFrame:
    """A rate for every calendar day: the last one known. One short series, so one window."""
    grid = rates.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("ts"))
    return grid.join(rates, "ts", "left").select("ts", F.last("rate", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("ts")).alias("rate"))


def us_financing(bars: DataFrame, rates: DataFrame) -> DataFrame:
    """Charge of each session after the first: rate times the days since the one before, over 360."""
    days = F.datediff("ts", F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts")))
    return bars.withColumn("days", days).filter("days is not null").join(rates, "ts").select("symbol", "ts", (F.col("rate") * F.col("days") / 360).alias("charge"))


def fx_rollovers(spark: SparkSession, start: str, end: str, difference: float) -> DataFrame:
    """Weekday charges at 17:00 New York; three days' worth on Wednesdays."""
    days = spark.sql(f"SELECT explode(sequence(TIMESTAMP_NTZ'{start}', TIMESTAMP_NTZ'{end}', interval 1 day)) AS d").filter(F.weekday("d") < 5)
    ts = F.convert_timezone(F.lit(NEW_YORK), F.lit("UTC"), F.col("d") + F.expr("interval 17 hours"))
    return days.select(ts.alias("ts"), (F.lit(difference) * F.when(F.weekday("d") == 2, 3).otherwise(1) / 360).alias("charge"))
