"""Bars: bucketing, filling, alignment, calendars, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import calendars, quality
from tidemill.queries import DAILY, TICKS, bars_sql, query
from tidemill.sources import bars as B

OHLC = ("open", "high", "low", "close")


def show(df, *names, digits=6):
    """Times as text and doubles rounded, so that engines can be compared."""
    kinds = dict(df.dtypes)
    out = []
    for n in names or df.columns:
        c = F.col(n)
        out.append((c.cast("string") if kinds[n].startswith("timestamp") else F.round(c, digits) if kinds[n] == "double" else c).alias(n))
    return df.select(*out)


OHLC_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in OHLC)


def raw_bars_sql(step):
    return f"WITH {TICKS} SELECT symbol, time_bucket(INTERVAL '{step}', ts)::VARCHAR AS ts, round(first(price ORDER BY ts, event_id), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(last(price ORDER BY ts, event_id), 6) AS close, count(*)::DOUBLE AS volume FROM ticks GROUP BY ALL"


for _name, _step in (("bars_1h", "1 hour"), ("bars_4h", "4 hours")):
    query(_name, raw_bars_sql(_step).replace("GROUP BY ALL", f"GROUP BY symbol, time_bucket(INTERVAL '{_step}', ts)"))(
        lambda spark, sf, step=_step: show(B.ohlcv(B.ticks(spark, sf), B.floor_ts(F.col("ts"), step), ["ts", "event_id"])))


@query("bars_daily", DAILY + f" SELECT symbol, ts::VARCHAR AS ts, {OHLC_SQL}, volume FROM bars")
def bars_daily(spark, sf):
    return show(B.order_bars(spark, sf), "symbol", "ts", *OHLC, "volume")


@query("fill_flat", bars_sql("1 hour") + f" SELECT symbol, ts::VARCHAR AS ts, {OHLC_SQL}, volume FROM bars")
def fill_flat(spark, sf):
    raw = B.ohlcv(B.ticks(spark, sf), B.floor_ts(F.col("ts"), "1 hour"), ["ts", "event_id"])
    return show(B.fill_flat(raw, "1 hour"))


@query("resample_1h_to_1d", bars_sql("1 hour") + " SELECT symbol, date_trunc('day', ts)::TIMESTAMP::VARCHAR AS ts, round(first(open ORDER BY ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(last(close ORDER BY ts), 6) AS close, sum(volume) AS volume FROM bars GROUP BY symbol, date_trunc('day', ts)")
def resample_days(spark, sf):
    return show(B.resample(B.event_bars(spark, sf, "1 hour"), B.floor_ts(F.col("ts"), "1 day")))


@query("funding_align_raw", bars_sql() + " SELECT symbol, ts::VARCHAR AS ts, round(funding_rate, 9) AS funding_rate FROM bars")
def funding_raw(spark, sf):
    return show(B.event_bars(spark, sf), "symbol", "ts", "funding_rate", digits=9)


@query("funding_align_nearest", bars_sql().replace("ts - INTERVAL '1 millisecond'", "time_bucket(INTERVAL '1 second', ts + INTERVAL '500 milliseconds') - INTERVAL '1 millisecond'") + " SELECT symbol, ts::VARCHAR AS ts, round(funding_rate, 9) AS funding_rate FROM bars")
def funding_nearest(spark, sf):
    bars = B.event_bars(spark, sf).drop("funding_rate")
    return show(B.align_funding(bars, B.funding_events(spark, sf), "4 hours", nearest_second=True), "symbol", "ts", "funding_rate", digits=9)


@query("asof_forward", bars_sql() + """, charges AS (SELECT event_type AS symbol, ts, value FROM events WHERE event_id % 3 = 0),
placed AS (SELECT c.symbol, (SELECT min(b.ts) FROM bars b WHERE b.symbol = c.symbol AND b.ts >= c.ts) AS ts, c.value FROM charges c JOIN (SELECT symbol, min(ts) AS a FROM bars GROUP BY symbol) f ON f.symbol = c.symbol AND c.ts >= f.a)
SELECT b.symbol, b.ts::VARCHAR AS ts, round(coalesce(sum(p.value), 0), 6) AS funding_rate FROM bars b LEFT JOIN placed p ON b.symbol = p.symbol AND b.ts = p.ts GROUP BY ALL""")
def asof_forward(spark, sf):
    charges = B.table(spark, sf, "events").filter("event_id % 3 = 0").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("rate"))
    return show(B.align_forward(B.event_bars(spark, sf).drop("funding_rate"), charges), "symbol", "ts", "funding_rate")


SESSIONS = """sessions AS (SELECT d + INTERVAL '14 hours 30 minutes' AS open, d + INTERVAL '21 hours' AS close FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL '1 day')) AS d) WHERE isodow(d) <= 5 AND d <> TIMESTAMP '2024-01-01' AND d <> TIMESTAMP '2024-01-15')"""


@query("range_join_sessions", f"WITH {TICKS}, {SESSIONS} SELECT t.symbol, t.event_id, s.open::VARCHAR AS session, round(t.price, 6) AS price FROM ticks t JOIN sessions s ON t.ts >= s.open AND t.ts < s.close")
def range_join_sessions(spark, sf):
    found = calendars.regular_hours(B.ticks(spark, sf), calendars.us_equity_sessions(spark, "2024-01-01", "2024-01-31"))
    return show(found.select("symbol", "event_id", F.col("session_open").alias("session"), "price"))


@query("us_equity_resample", f"""WITH {TICKS}, {SESSIONS}, k AS (SELECT t.*, s.open + INTERVAL '1 hour' * (date_diff('second', s.open, t.ts) // 3600) AS label FROM ticks t JOIN sessions s ON t.ts >= s.open AND t.ts < s.close)
SELECT symbol, label::VARCHAR AS ts, round(first(price ORDER BY ts, event_id), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(last(price ORDER BY ts, event_id), 6) AS close, count(*)::DOUBLE AS volume FROM k GROUP BY symbol, label""")
def us_equity_resample(spark, sf):
    sessions = calendars.us_equity_sessions(spark, "2024-01-01", "2024-01-31")
    rows = calendars.session_label(B.ticks(spark, sf), calendars.session_buckets(sessions, "1 hour"))
    return show(B.ohlcv(rows, F.col("bucket"), ["ts", "event_id"]))


@query("fx_resample", f"""WITH {TICKS}, l AS (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny FROM ticks),
k AS (SELECT *, ((time_bucket(INTERVAL '1 day', ny - INTERVAL '17 hours') + INTERVAL '17 hours') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS label FROM l WHERE isodow(ny) < 5 OR (isodow(ny) = 5 AND hour(ny) < 17) OR (isodow(ny) = 7 AND hour(ny) >= 17))
SELECT symbol, label::VARCHAR AS ts, round(first(price ORDER BY ts, event_id), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(last(price ORDER BY ts, event_id), 6) AS close, count(*)::DOUBLE AS volume FROM k GROUP BY symbol, label""")
def fx_resample(spark, sf):
    rows = calendars.fx_trading_hours(B.ticks(spark, sf))
    return show(B.ohlcv(rows, calendars.fx_label(F.col("ts"), "1 day"), ["ts", "event_id"]))


@query("calendar_stats", bars_sql() + """, s AS (SELECT symbol, ts, lead(epoch(ts)) OVER (PARTITION BY symbol ORDER BY ts) - epoch(ts) AS step FROM bars)
SELECT symbol, CASE WHEN bool_or(isodow(ts) = 6) THEN '24/7' ELSE 'us_equity' END AS calendar, round(365.25 * 86400 / median(step), 6) AS periods_per_year, round(86400 / first(step ORDER BY ts), 6) AS bars_per_day FROM s GROUP BY symbol""")
def calendar_stats(spark, sf):
    return show(calendars.describe(B.event_bars(spark, sf)).select("symbol", "calendar", "periods_per_year", "bars_per_day"))


CHECKED = DAILY + """, w AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS before, count(*) OVER (PARTITION BY symbol, ts) AS same FROM bars),
 cal AS (SELECT symbol, CASE WHEN bool_or(isodow(ts) = 6) THEN '24/7' WHEN bool_or(isodow(ts) = 7) THEN 'fx' ELSE 'us_equity' END AS calendar FROM bars GROUP BY symbol),
 ck AS (SELECT symbol, calendar, count(*)::BIGINT AS bars, sum((same > 1)::INT)::BIGINT AS duplicates, 0::BIGINT AS unordered, sum((high < greatest(open, close) OR low > least(open, close) OR low <= 0)::INT)::BIGINT AS inconsistent, coalesce(sum((abs(close / before - 1) > CASE calendar WHEN '24/7' THEN 0.25 WHEN 'fx' THEN 0.05 ELSE 0.15 END)::INT), 0)::BIGINT AS jumps, avg((volume <= 0 AND open = high AND high = low AND low = close)::INT) AS flat_share FROM w JOIN cal USING (symbol) GROUP BY symbol, calendar)"""


@query("quality_checks", CHECKED + " SELECT symbol, calendar, bars, duplicates, unordered, inconsistent, jumps, round(flat_share, 6) AS flat_share FROM ck")
def quality_checks(spark, sf):
    return show(quality.check_bars(B.order_bars(spark, sf)))


@query("quality_issues", CHECKED + " SELECT symbol, 'jump' AS issue, jumps::DOUBLE AS amount FROM ck WHERE jumps > 0 UNION ALL SELECT symbol, 'duplicates', duplicates FROM ck WHERE duplicates > 0 UNION ALL SELECT symbol, 'ohlc', inconsistent FROM ck WHERE inconsistent > 0 UNION ALL SELECT symbol, 'filled', round(flat_share, 6) FROM ck WHERE flat_share > 0.02 AND calendar <> '24/7' UNION ALL SELECT 'none', 'empty', 0.0")
def quality_issues(spark, sf):
    return show(quality.issues(B.order_bars(spark, sf), ["1-URGENT", "none"]))


@query("quality_missing", DAILY + """, g AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL '1 day')) AS ts FROM bars GROUP BY symbol)
SELECT symbol, ts::VARCHAR AS ts, 'missing' AS issue FROM g WHERE isodow(ts) <= 5 AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = g.symbol AND b.ts = g.ts) UNION ALL SELECT symbol, ts::VARCHAR, 'outside' FROM bars WHERE isodow(ts) > 5""")
def quality_missing(spark, sf):
    bars = B.order_bars(spark, sf)
    days = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("symbol", F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("ts")).filter(F.weekday("ts") < 5)
    return show(quality.session_issues(bars, days))


@query("mid_bars", """WITH b AS (SELECT event_type AS symbol, time_bucket(INTERVAL '4 hours', ts) AS t, event_id % 2 AS side, value, ts, event_id FROM events),
s AS (SELECT symbol, t, side, first(value ORDER BY ts, event_id) AS o, max(value) AS h, min(value) AS l, last(value ORDER BY ts, event_id) AS c FROM b GROUP BY symbol, t, side),
m AS (SELECT x.symbol, x.t, (x.o + y.o) / 2 AS o, (x.h + y.h) / 2 AS h, (x.l + y.l) / 2 AS l, (x.c + y.c) / 2 AS c FROM s x JOIN s y ON x.symbol = y.symbol AND x.t = y.t AND x.side = 0 AND y.side = 1)
SELECT symbol, t::VARCHAR AS ts, round(o, 6) AS open, round(greatest(h, o, c), 6) AS high, round(least(l, o, c), 6) AS low, round(c, 6) AS close FROM m""")
def mid_bars(spark, sf):
    rows = B.table(spark, sf, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"))
    side = lambda k: B.ohlcv(rows.filter(F.col("event_id") % 2 == k), B.floor_ts(F.col("ts"), "4 hours"), ["ts", "event_id"])
    return show(calendars.mid_bars(side(0), side(1)))


@query("us_financing", """SELECT ts::VARCHAR AS ts, round(0.01 * (1 + month(ts)) * days / 360, 9) AS charge FROM (SELECT ts, date_diff('day', lag(ts) OVER (ORDER BY ts), ts) AS days FROM (SELECT DISTINCT date_trunc('day', o_orderdate)::TIMESTAMP AS ts FROM orders WHERE isodow(o_orderdate) <= 5)) WHERE days IS NOT NULL""")
def us_financing(spark, sf):
    days = B.table(spark, sf, "orders").select(F.window("o_orderdate", "1 day").start.alias("ts")).distinct().filter(F.weekday("ts") < 5)
    rates = days.select("ts", (F.lit(0.01) * (1 + F.month("ts"))).alias("rate"))
    return show(calendars.us_financing(days.withColumn("symbol", F.lit("x")), rates).select("ts", "charge"), digits=9)


@query("fx_rollovers", """WITH d AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-31', INTERVAL '1 day')) AS d)
SELECT ((d + INTERVAL '17 hours') AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC')::VARCHAR AS ts, round(0.02 * CASE WHEN isodow(d) = 3 THEN 3 ELSE 1 END / 360, 9) AS charge FROM d WHERE isodow(d) <= 5""")
def fx_rollovers(spark, sf):
    return show(calendars.fx_rollovers(spark, "2024-01-01", "2024-03-31", 0.02), digits=9)


@query("daily_rates_ffill", """WITH r AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, avg(o_totalprice) / 1e6 AS rate FROM orders GROUP BY 1), g AS (SELECT unnest(generate_series((SELECT min(ts) FROM r), (SELECT max(ts) FROM r), INTERVAL '1 day')) AS ts)
SELECT g.ts::VARCHAR AS ts, round(last_value(r.rate IGNORE NULLS) OVER (ORDER BY g.ts), 6) AS rate FROM g LEFT JOIN r ON g.ts = r.ts""")
def daily_rates(spark, sf):
    r = B.table(spark, sf, "orders").groupBy(F.window("o_orderdate", "1 day").start.alias("ts")).agg((F.avg("o_totalprice") / 1e6).alias("rate"))
    return show(calendars.daily(r))
