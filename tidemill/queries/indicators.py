"""Indicators: native frames, and folds against list reductions or recursive queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import folds as K
from tidemill.functions import indicators as I
from tidemill.queries import W, bars_sql, query, rows, sma_sql
from tidemill.queries.bars import show
from tidemill.sources import bars as B

B4 = bars_sql()
TR = f"CASE WHEN lag(close) {W} IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})) END"


def bars(spark, sf):
    return B.event_bars(spark, sf)


def native(name: str, sql: str, **columns):
    query(name, B4 + f" SELECT symbol, ts::VARCHAR AS ts, {sql} FROM bars")(
        lambda spark, sf: show(bars(spark, sf).select("symbol", "ts", *(make().alias(c) for c, make in columns.items()))))


def ema_sql(values: str, alpha: float, least: int) -> str:
    """Exponential average of a non-null list so far: NULL before `least` values."""
    return f"CASE WHEN len({values}) >= {least} THEN list_reduce({values}, lambda a, x: a * (1 - {alpha!r}) + x * {alpha!r}) END"


def listed(x: str) -> str:
    return f"list({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


native("sma", f"round({sma_sql('close', 20)}, 6) AS sma", sma=lambda: I.sma("close", 20))
native("bollinger", f"round({sma_sql('close', 20)}, 6) AS mid, round(CASE WHEN count(*) {rows(20)} >= 20 THEN avg(close) {rows(20)} + 2 * stddev_pop(close) {rows(20)} END, 6) AS upper, round(CASE WHEN count(*) {rows(20)} >= 20 THEN avg(close) {rows(20)} - 2 * stddev_pop(close) {rows(20)} END, 6) AS lower",
       **{k: (lambda k=k: I.bollinger("close", 20, 2.0)[k]) for k in ("mid", "upper", "lower")})
native("donchian", f"round(CASE WHEN count(*) {rows(20)} >= 20 THEN max(high) {rows(20)} END, 6) AS upper, round(CASE WHEN count(*) {rows(20)} >= 20 THEN min(low) {rows(20)} END, 6) AS lower, round(CASE WHEN count(*) {rows(20)} >= 20 THEN (max(high) {rows(20)} + min(low) {rows(20)}) / 2 END, 6) AS mid",
       **{k: (lambda k=k: I.donchian(20)[k]) for k in ("mid", "upper", "lower")})
native("zscore", f"round(CASE WHEN count(*) {rows(20)} >= 20 THEN (close - avg(close) {rows(20)}) / nullif(stddev_pop(close) {rows(20)}, 0) END, 6) AS z", z=lambda: I.zscore("close", 20))
native("true_range", f"round({TR}, 6) AS tr", tr=lambda: I.true_range())
native("pct_change", f"round(close / lag(close, 20) {W} - 1, 6) AS change", change=lambda: I.pct_change("close", 20))
native("rolling_pct_rank", f"round(CASE WHEN count(*) {rows(60)} >= 15 THEN len(list_filter(list(close) {rows(60)}, lambda v: v <= close))::DOUBLE / count(*) {rows(60)} END, 6) AS rank", rank=lambda: I.pct_rank("close", 60, 15))


def folded(name: str, sql: str, shown: list[str], **columns):
    query(name, B4 + sql)(lambda spark, sf: show(K.with_folds(bars(spark, sf), columns), "symbol", "ts", *shown))


folded("ema", f", l AS (SELECT symbol, ts, {listed('close')} AS v FROM bars) SELECT symbol, ts::VARCHAR AS ts, round({ema_sql('v', 2 / 21, 20)}, 6) AS ema FROM l", ["ema"], ema=lambda b: K.ema(b.close, 20))
folded("wilder", f", l AS (SELECT symbol, ts, {listed('close')} AS v FROM bars) SELECT symbol, ts::VARCHAR AS ts, round({ema_sql('v', 1 / 14, 14)}, 6) AS wilder FROM l", ["wilder"], wilder=lambda b: K.wilder(b.close, 14))
ATR = f", t AS (SELECT *, {TR} AS tr FROM bars), l AS (SELECT *, {listed('tr')} AS v FROM t), a AS (SELECT *, {ema_sql('v', 1 / 14, 14)} AS atr FROM l)"
folded("atr", ATR + " SELECT symbol, ts::VARCHAR AS ts, round(atr, 6) AS atr FROM a", ["atr"], atr=lambda b: K.atr(b, 14))
folded("keltner", ATR + f", m AS (SELECT *, {listed('close')} AS c FROM a), e AS (SELECT *, {ema_sql('c', 2 / 21, 20)} AS mid FROM m) SELECT symbol, ts::VARCHAR AS ts, round(mid, 6) AS mid, round(mid + 2 * atr, 6) AS upper, round(mid - 2 * atr, 6) AS lower FROM e",
       ["mid", "upper", "lower"], mid=lambda b: K.ema(b.close, 20), upper=lambda b: b.mid + 2 * K.atr(b, 14), lower=lambda b: b.mid - 2 * K.atr(b, 14))
folded("rsi", f""", d AS (SELECT symbol, ts, close - lag(close) {W} AS d FROM bars), l AS (SELECT symbol, ts, list(greatest(d, 0)) FILTER (d IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g, list(greatest(-d, 0)) FILTER (d IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM d),
 r AS (SELECT symbol, ts, {ema_sql('g', 1 / 14, 14)} AS gain, {ema_sql('s', 1 / 14, 14)} AS loss FROM l) SELECT symbol, ts::VARCHAR AS ts, round(CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END, 6) AS rsi FROM r""", ["rsi"], rsi=lambda b: K.rsi(b.close, 14))
MACD = f", l AS (SELECT symbol, ts, {listed('close')} AS v FROM bars), m AS (SELECT symbol, ts, {ema_sql('v', 2 / 13, 12)} - {ema_sql('v', 2 / 27, 26)} AS line FROM l), n AS (SELECT *, list(line) FILTER (line IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS q FROM m), s AS (SELECT *, {ema_sql('q', 0.2, 9)} AS signal FROM n)"
folded("macd", MACD + " SELECT symbol, ts::VARCHAR AS ts, round(line, 6) AS line, round(signal, 6) AS signal, round(line - signal, 6) AS hist FROM s",
       ["line", "signal", "hist"], line=lambda b: K.macd(b.close, 12, 26, 9)[0], signal=lambda b: K.macd(b.close, 12, 26, 9)[1], hist=lambda b: b.line - b.signal)
ADX = ATR + f""", u AS (SELECT *, high - lag(high) {W} AS up, lag(low) {W} - low AS dn FROM a), p AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pd, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS md FROM u),
 q AS (SELECT *, {listed('pd')} AS pl, {listed('md')} AS ml FROM p), x AS (SELECT *, 100 * {ema_sql('pl', 1 / 14, 14)} / atr AS plus, 100 * {ema_sql('ml', 1 / 14, 14)} / atr AS minus FROM q),
 y AS (SELECT *, 100 * abs(plus - minus) / (plus + minus) AS dx FROM x), z AS (SELECT *, list(dx) FILTER (dx IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS dl FROM y), ad AS (SELECT *, {ema_sql('dl', 1 / 14, 14)} AS adx FROM z)"""
folded("adx", ADX + " SELECT symbol, ts::VARCHAR AS ts, round(plus, 6) AS plus_di, round(minus, 6) AS minus_di, round(adx, 6) AS adx FROM ad",
       ["plus_di", "minus_di", "adx"], plus_di=lambda b: K.adx(b, 14)[0], minus_di=lambda b: K.adx(b, 14)[1], adx=lambda b: K.adx(b, 14)[2])



@query("ewm_vol", B4.replace("WITH ", "WITH RECURSIVE ", 1) + """, r AS MATERIALIZED (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars),
 f AS (SELECT symbol, rn, x AS m, 0.0::DOUBLE AS cov, 1.0::DOUBLE AS sw2 FROM r WHERE rn = 2
 UNION ALL SELECT r.symbol, r.rn, f.m * (1 - 2 / 21.0) + r.x * 2 / 21.0, (1 - 2 / 21.0) * (f.cov + (f.m - (f.m * (1 - 2 / 21.0) + r.x * 2 / 21.0)) ^ 2) + 2 / 21.0 * (r.x - (f.m * (1 - 2 / 21.0) + r.x * 2 / 21.0)) ^ 2, f.sw2 * (1 - 2 / 21.0) ^ 2 + (2 / 21.0) ^ 2
 FROM f JOIN r ON r.symbol = f.symbol AND r.rn = f.rn + 1)
 SELECT r.symbol, r.ts::VARCHAR AS ts, round(CASE WHEN r.rn >= 11 THEN sqrt(f.cov / (1 - f.sw2)) END, 8) AS vol FROM r LEFT JOIN f ON r.symbol = f.symbol AND r.rn = f.rn""")
def ewm_vol(spark, sf):
    return show(K.with_folds(bars(spark, sf), {"vol": lambda b: K.ewm_vol(b.close.pct_change(), 20)}), "symbol", "ts", "vol", digits=8)


NUMBERED = ", b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, lag(low) OVER (PARTITION BY symbol ORDER BY ts) AS l1, lag(low, 2) OVER (PARTITION BY symbol ORDER BY ts) AS l2, lag(high) OVER (PARTITION BY symbol ORDER BY ts) AS h1, lag(high, 2) OVER (PARTITION BY symbol ORDER BY ts) AS h2, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS c1 FROM bars)"


PSAR = B4.replace("WITH ", "WITH RECURSIVE ", 1) + NUMBERED + """,
 s AS (SELECT symbol, rn, true AS bull, 0.02::DOUBLE AS af, high AS ep, low AS sar FROM b WHERE rn = 1
 UNION ALL SELECT symbol, rn, bull2, CASE WHEN bull2 <> bull THEN CASE WHEN (bull2 AND high > ep2) OR (NOT bull2 AND low < ep2) THEN least(0.04, 0.2) ELSE 0.02 END WHEN (bull2 AND high > ep2) OR (NOT bull2 AND low < ep2) THEN least(af + 0.02, 0.2) ELSE af END,
  CASE WHEN bull2 THEN greatest(ep2, high) ELSE least(ep2, low) END, sar2 FROM (
  SELECT *, CASE WHEN bull AND low < v THEN false WHEN NOT bull AND high > v THEN true ELSE bull END AS bull2, CASE WHEN bull AND low < v THEN low WHEN NOT bull AND high > v THEN high ELSE ep END AS ep2, CASE WHEN (bull AND low < v) OR (NOT bull AND high > v) THEN ep ELSE v END AS sar2 FROM (
   SELECT b.symbol, b.rn, b.high, b.low, s.bull, s.af, s.ep, CASE WHEN s.bull THEN least(s.sar + s.af * (s.ep - s.sar), b.l1, coalesce(b.l2, b.l1)) ELSE greatest(s.sar + s.af * (s.ep - s.sar), b.h1, coalesce(b.h2, b.h1)) END AS v FROM s JOIN b ON b.symbol = s.symbol AND b.rn = s.rn + 1)))"""


@query("psar", PSAR + " SELECT b.symbol, b.ts::VARCHAR AS ts, round(s.sar, 6) AS sar FROM b JOIN s USING (symbol, rn)")
def psar(spark, sf):
    return show(K.with_folds(bars(spark, sf), {"sar": K.parabolic_sar}), "symbol", "ts", "sar")


SUPERTREND = B4.replace("WITH ", "WITH RECURSIVE ", 1) + ATR.replace("1 / 14", "1 / 14").replace(repr(1 / 14), repr(1 / 10)).replace(">= 14", ">= 10") + """,
 b AS MATERIALIZED (SELECT *, (high + low) / 2 + 3 * atr AS bu, (high + low) / 2 - 3 * atr AS bl, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS c1 FROM a),
 s AS (SELECT symbol, rn, bu AS up, bl AS lo, 1.0::DOUBLE AS trend FROM b WHERE rn = 10
 UNION ALL SELECT symbol, rn, u, l, CASE WHEN trend > 0 AND close < l THEN -1.0 WHEN trend < 0 AND close > u THEN 1.0 ELSE trend END FROM (
  SELECT b.symbol, b.rn, b.close, s.trend, CASE WHEN b.c1 <= s.up THEN least(b.bu, s.up) ELSE b.bu END AS u, CASE WHEN b.c1 >= s.lo THEN greatest(b.bl, s.lo) ELSE b.bl END AS l FROM s JOIN b ON b.symbol = s.symbol AND b.rn = s.rn + 1))"""


@query("supertrend", SUPERTREND + " SELECT b.symbol, b.ts::VARCHAR AS ts, coalesce(s.trend, 0.0)::DOUBLE AS direction, round(CASE WHEN s.trend > 0 THEN s.lo ELSE s.up END, 6) AS line FROM b LEFT JOIN s USING (symbol, rn)")
def supertrend(spark, sf):
    return show(K.with_folds(bars(spark, sf), {"line": lambda b: K.supertrend(b)[0], "direction": lambda b: K.supertrend(b)[1]}), "symbol", "ts", "direction", "line")


@query("scale_forecast", B4 + f""", r AS (SELECT symbol, ts, close / lag(close, 5) {W} - 1 AS raw FROM bars), a AS (SELECT *, CASE WHEN count(raw) {W} >= 10 THEN avg(abs(raw)) {W} END AS size FROM r)
 SELECT symbol, ts::VARCHAR AS ts, round(CASE WHEN raw * 10 / nullif(size, 0) IS NULL THEN 0 ELSE greatest(-20, least(20, raw * 10 / size)) / 20 END, 6) AS forecast FROM a""")
def scale_forecast(spark, sf):
    rows_ = bars(spark, sf).withColumn("raw", I.pct_change("close", 5))
    return show(rows_.select("symbol", "ts", I.scale_forecast("raw", 10).alias("forecast")))
