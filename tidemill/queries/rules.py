"""Rules: the target of each, against SQL where it can say it."""

from __future__ import annotations

from tidemill.functions import rules as R
from tidemill.queries import W, bars_sql, query, rows, sma_sql
from tidemill.queries.bars import show
from tidemill.queries.indicators import ADX, ATR, B4, MACD, PSAR, SUPERTREND, ema_sql, listed
from tidemill.sources import bars as B

B1 = bars_sql("1 hour")


def target(name: str, spec: dict, sql: str | None = None, step: str = "4 hours"):
    query(name, sql)(lambda spark, sf: show(R.with_target(B.event_bars(spark, sf, step), spec).select("symbol", "ts", "target")))


def plain(expr: str, extra: str = "", frm: str = "bars") -> str:
    return B4 + extra + f" SELECT symbol, ts::VARCHAR AS ts, round(({expr})::DOUBLE, 6) AS target FROM {frm}"


def sided(up: str, down: str) -> str:
    return f"CASE WHEN {down} THEN -1 WHEN {up} THEN 1 ELSE 0 END"


def automaton(flags: str) -> str:
    """flags: a SELECT of symbol, ts, el, xl, es, xs."""
    return B4.replace("WITH ", "WITH RECURSIVE ", 1) + f""", g AS MATERIALIZED (SELECT symbol, ts, coalesce(el, false) AS el, coalesce(xl, false) AS xl, coalesce(es, false) AS es, coalesce(xs, false) AS xs, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM ({flags})),
 s AS (SELECT DISTINCT symbol, 0::BIGINT AS rn, 0 AS pos FROM g
 UNION ALL SELECT symbol, rn, CASE WHEN kept <> 0 THEN kept WHEN el AND NOT xl AND NOT es THEN 1 WHEN es AND NOT xs AND NOT el THEN -1 ELSE 0 END FROM (
  SELECT g.*, CASE WHEN s.pos = 1 AND (g.xl OR g.es) THEN 0 WHEN s.pos = -1 AND (g.xs OR g.el) THEN 0 ELSE s.pos END AS kept FROM s JOIN g ON g.symbol = s.symbol AND g.rn = s.rn + 1))
 SELECT g.symbol, g.ts::VARCHAR AS ts, s.pos::DOUBLE AS target FROM g JOIN s USING (symbol, rn)"""


def prior(f: str, x: str, n: int) -> str:
    f_n = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(*) {f_n} >= {n} THEN {f}({x}) {f_n} END"


BB = f"SELECT *, {sma_sql('close', 20)} AS mid, CASE WHEN count(*) {rows(20)} >= 20 THEN stddev_pop(close) {rows(20)} END AS dev FROM bars"
RSI = f""", d AS (SELECT symbol, ts, close - lag(close) {W} AS d FROM bars), l AS (SELECT symbol, ts, list(greatest(d, 0)) FILTER (d IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g, list(greatest(-d, 0)) FILTER (d IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM d), r AS (SELECT symbol, ts, {ema_sql('g', 1 / 14, 14)} AS gain, {ema_sql('s', 1 / 14, 14)} AS loss FROM l), v AS (SELECT symbol, ts, CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END AS v FROM r)"""

target("momentum", {"type": "momentum", "lookback": 10}, plain(sided(f"close > lag(close, 10) {W}", f"close < lag(close, 10) {W}")))
target("buy_and_hold", {"type": "buy_and_hold"}, plain("1"))
target("ma_crossover", {"type": "ma_crossover", "fast": 5, "slow": 20}, plain(sided("a > b", "a < b"), f", m AS (SELECT symbol, ts, {sma_sql('close', 5)} AS a, {sma_sql('close', 20)} AS b FROM bars)", "m"))
target("ma_crossover_ema", {"type": "ma_crossover", "fast": 5, "slow": 20, "kind": "ema"}, plain(sided("a > b", "a < b"), f", l AS (SELECT symbol, ts, {listed('close')} AS v FROM bars), m AS (SELECT symbol, ts, {ema_sql('v', 2 / 6, 5)} AS a, {ema_sql('v', 2 / 21, 20)} AS b FROM l)", "m"))
target("parabolic_sar", {"type": "parabolic_sar"}, PSAR + " SELECT b.symbol, b.ts::VARCHAR AS ts, CASE WHEN b.close < s.sar THEN -1 ELSE 1 END::DOUBLE AS target FROM b JOIN s USING (symbol, rn)")
target("macd_rule", {"type": "macd"}, plain(sided("line > signal", "line < signal"), MACD, "s"))
target("supertrend_rule", {"type": "supertrend"}, SUPERTREND + " SELECT b.symbol, b.ts::VARCHAR AS ts, coalesce(s.trend, 0)::DOUBLE AS target FROM b LEFT JOIN s USING (symbol, rn)")
target("adx_trend", {"type": "adx_trend", "ma_length": 20}, plain(sided("adx > 25 AND plus > minus AND close > m", "adx > 25 AND minus > plus AND close < m"), ADX + f", am AS (SELECT *, {sma_sql('close', 20)} AS m FROM ad)", "am"))
target("trend_gate", {"type": "rsi_reversion", "trend_filter": 30, "length": 7}, automaton("SELECT symbol, ts, v < 30 AND close > m AS el, v > 50 AS xl, v > 70 AND close < m AS es, v < 50 AS xs FROM gv").replace(", g AS", RSI.replace(repr(1 / 14), repr(1 / 7)).replace(">= 14", ">= 7") + f", gv AS (SELECT v.symbol, v.ts, v.v, b.close, b.m FROM v JOIN (SELECT *, {sma_sql('close', 30)} AS m FROM bars) b USING (symbol, ts)), g AS", 1))
target("donchian_breakout", {"type": "donchian_breakout"}, automaton(f"SELECT symbol, ts, close > {prior('max', 'high', 20)} AS el, close < {prior('min', 'low', 10)} AS xl, close < {prior('min', 'low', 20)} AS es, close > {prior('max', 'high', 10)} AS xs FROM bars"))
target("bollinger_breakout", {"type": "bollinger_breakout"}, automaton(f"SELECT symbol, ts, close > mid + 2 * dev AS el, close < mid AS xl, close < mid - 2 * dev AS es, close > mid AS xs FROM ({BB})"))
target("bollinger_reversion", {"type": "bollinger_reversion"}, automaton(f"SELECT symbol, ts, close < mid - 2 * dev AS el, close > mid AS xl, close > mid + 2 * dev AS es, close < mid AS xs FROM ({BB})"))
target("keltner_breakout", {"type": "keltner_breakout", "length": 14}, automaton("SELECT symbol, ts, close > mid + 2 * atr AS el, close < mid AS xl, close < mid - 2 * atr AS es, close > mid AS xs FROM kl").replace(", g AS", ATR + f", km AS (SELECT *, {listed('close')} AS c FROM a), kl AS (SELECT *, {ema_sql('c', 2 / 15, 14)} AS mid FROM km), g AS", 1))
target("rsi_reversion", {"type": "rsi_reversion"}, automaton("SELECT symbol, ts, v < 30 AS el, v > 50 AS xl, v > 70 AS es, v < 50 AS xs FROM v").replace(", g AS", RSI + ", g AS", 1))
target("rsi_reversion_long_only", {"type": "rsi_reversion", "allow_short": False}, automaton("SELECT symbol, ts, v < 30 AS el, v > 50 OR v > 70 AS xl, false AS es, v < 50 AS xs FROM v").replace(", g AS", RSI + ", g AS", 1))


def deviation(x: str, span: int, least: int) -> str:
    """vol: the exponentially weighted deviation of x, over a recursion; NULL before `least` values of x."""
    w, k = f"2 / {span + 1}.0", f"(1 - 2 / {span + 1}.0)"
    m = f"(f.m * {k} + r.x * {w})"
    return f""", r AS MATERIALIZED (SELECT symbol, ts, close, {x} AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars),
 f AS (SELECT symbol, rn, x AS m, 0.0::DOUBLE AS cov, 1.0::DOUBLE AS sw2 FROM r WHERE rn = 2
 UNION ALL SELECT r.symbol, r.rn, {m}, {k} * (f.cov + (f.m - {m}) ^ 2) + {w} * (r.x - {m}) ^ 2, f.sw2 * {k} ^ 2 + ({w}) ^ 2 FROM f JOIN r ON r.symbol = f.symbol AND r.rn = f.rn + 1),
 vol AS (SELECT r.symbol, r.ts, r.rn, r.x, CASE WHEN r.rn >= {least + 1} THEN sqrt(f.cov / (1 - f.sw2)) END AS vol FROM r LEFT JOIN f ON r.symbol = f.symbol AND r.rn = f.rn)"""


VOL = deviation("close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1", 30, 15)


def forecast(raw: str, least: int) -> str:
    """A SELECT of symbol, ts, raw, scaled so that its mean size so far is half of the cap."""
    return f"SELECT symbol, ts::VARCHAR AS ts, round(CASE WHEN raw * 10 / nullif(size, 0) IS NULL THEN 0 ELSE greatest(-20, least(20, raw * 10 / size)) / 20 END::DOUBLE, 6) AS target FROM (SELECT *, CASE WHEN count(raw) OVER w >= {least} THEN avg(abs(raw)) OVER w END AS size FROM ({raw}) WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING))"


REC = "WITH RECURSIVE "
target("ewmac", {"type": "ewmac", "fast": 8, "slow": 32, "vol_days": 5}, B4.replace("WITH ", REC, 1) + deviation("close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)", 30, 30)
       + f", l AS (SELECT symbol, ts, {listed('close')} AS v FROM bars), e AS (SELECT symbol, ts, {ema_sql('v', 2 / 9, 8)} - {ema_sql('v', 2 / 33, 32)} AS gap FROM l) " + forecast("SELECT e.symbol, e.ts, gap / vol AS raw FROM e JOIN vol USING (symbol, ts)", 32))
target("carver_breakout", {"type": "carver_breakout", "lookback": 20}, B4 + f", h AS (SELECT *, CASE WHEN count(*) {rows(20)} >= 20 THEN 40 * (close - (max(close) {rows(20)} + min(close) {rows(20)}) / 2) / (max(close) {rows(20)} - min(close) {rows(20)}) END AS p FROM bars), l AS (SELECT symbol, ts, list(p) FILTER (p IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS v FROM h) "
       + forecast(f"SELECT symbol, ts, {ema_sql('v', 2 / 6, 1)} AS raw FROM l", 20))
target("funding_carry", {"type": "funding_carry", "span_days": 5, "vol_days": 5}, B4.replace("WITH ", REC, 1) + deviation("close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1", 30, 30)
       + f", l AS (SELECT symbol, ts, {listed('funding_rate')} AS v FROM bars), p AS (SELECT symbol, ts, {ema_sql('v', 2 / 31, 30)} * 365.25 * 6 AS paid FROM l) " + forecast("SELECT p.symbol, p.ts, -paid / (vol * sqrt(365.25 * 6)) AS raw FROM p JOIN vol USING (symbol, ts)", 30))
target("vol_target", {"type": "vol_target", "strategy": {"type": "momentum", "lookback": 10}, "vol_days": 5, "annual_vol": 0.5, "max_leverage": 2},
       plain("greatest(-2.0, least(2.0, t * coalesce(0.5 / (vol * sqrt(365.25 * 6)), 0)))", VOL + f", m AS (SELECT symbol, ts, {sided(f'close > lag(close, 10) {W}', f'close < lag(close, 10) {W}')} AS t FROM bars), j AS (SELECT m.symbol, m.ts, m.t, vol.vol FROM m JOIN vol USING (symbol, ts))", "j").replace("WITH ", REC, 1))
target("trend_filter", {"type": "trend_filter", "length": 20, "strategy": {"type": "momentum", "lookback": 5}}, plain("CASE WHEN (t > 0 AND close > s) OR (t < 0 AND close < s) THEN t ELSE 0 END", f", m AS (SELECT symbol, ts, close, {sma_sql('close', 20)} AS s, {sided(f'close > lag(close, 5) {W}', f'close < lag(close, 5) {W}')} AS t FROM bars)", "m"))
target("combine", {"type": "combine", "weights": [1, 3], "multiplier": 1.2, "strategies": [{"type": "momentum", "lookback": 5}, {"type": "momentum", "lookback": 20, "allow_short": False}]},
       plain(f"greatest(-1, least(1, 1.2 * (0.25 * {sided(f'close > lag(close, 5) {W}', f'close < lag(close, 5) {W}')} + 0.75 * CASE WHEN close > lag(close, 20) {W} THEN 1 ELSE 0 END)))"))
SHOCK = VOL + ", h AS (SELECT symbol, ts, rn, CASE WHEN lag(vol) OVER (PARTITION BY symbol ORDER BY ts) > 0 AND abs(x / lag(vol) OVER (PARTITION BY symbol ORDER BY ts)) >= 2 THEN rn END AS hit, -sign(x) AS side FROM vol), k AS (SELECT *, last_value(hit IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS at FROM h)"
target("shock_fade", {"type": "i002_shock_fade", "z_entry": 2.0, "hold_bars": 4, "vol_days": 5}, B4.replace("WITH ", REC, 1) + SHOCK + " SELECT k.symbol, k.ts::VARCHAR AS ts, CASE WHEN k.rn - k.at < 4 THEN h.side ELSE 0 END::DOUBLE AS target FROM k LEFT JOIN h ON h.symbol = k.symbol AND h.rn = k.at")
CROWD = B4.replace("WITH ", REC, 1) + ATR + f""", g AS (SELECT *, CASE WHEN count(*) {rows(6)} >= 6 THEN sum(funding_rate) {rows(6)} END AS paid FROM a),
 k AS (SELECT *, CASE WHEN count(paid) {rows(120)} >= 30 THEN len(list_filter(list(paid) FILTER (paid IS NOT NULL) {rows(120)}, lambda v: v <= paid))::DOUBLE / count(paid) {rows(120)} END AS rank FROM g),
 c AS (SELECT *, coalesce(rank >= 0.8 AND paid > 1e-9, false) AS crowded, coalesce(rank < 0.5, false) AS calm, row_number() {W} AS rn FROM k),
 n AS MATERIALIZED (SELECT *, crowded AND NOT coalesce(lag(crowded) {W}, false) AS onset FROM c),
 s AS (SELECT DISTINCT symbol, 0::BIGINT AS rn, NULL::BIGINT AS since, 0.0::DOUBLE AS stop FROM n
 UNION ALL SELECT n.symbol, n.rn, CASE WHEN s.since IS NOT NULL THEN CASE WHEN n.rn - s.since >= 7 OR n.calm OR n.close >= s.stop THEN NULL ELSE s.since END WHEN n.onset AND n.atr IS NOT NULL THEN n.rn END, CASE WHEN s.since IS NULL THEN n.close + 3 * n.atr ELSE s.stop END FROM s JOIN n ON n.symbol = s.symbol AND n.rn = s.rn + 1)
 SELECT n.symbol, n.ts::VARCHAR AS ts, CASE WHEN s.since IS NULL THEN 0 ELSE -1 END::DOUBLE AS target FROM n JOIN s USING (symbol, rn)"""
target("funding_crowding", {"type": "i004_funding_crowding_short", "funding_days": 1, "history_days": 20, "neutral_daily_funding": 0.0}, CROWD)
target("settlement_rebound", {"type": "i005_settlement_rebound", "threshold": 0.00002}, B1 + """, d AS (SELECT b.symbol, b.ts, CASE WHEN e.funding_rate + l.funding_rate >= 0.00002 THEN 1 WHEN e.funding_rate + l.funding_rate <= -0.00002 THEN -1 ELSE 0 END AS side FROM bars b JOIN bars e ON e.symbol = b.symbol AND e.ts = b.ts - INTERVAL '8 hours' JOIN bars l ON l.symbol = b.symbol AND l.ts = b.ts - INTERVAL '7 hours' WHERE hour(b.ts) % 8 = 7)
 SELECT b.symbol, b.ts::VARCHAR AS ts, coalesce(max(d.side), 0)::DOUBLE AS target FROM bars b LEFT JOIN d ON d.symbol = b.symbol AND d.ts <= b.ts AND b.ts < d.ts + INTERVAL '2 hours' GROUP BY b.symbol, b.ts""", "1 hour")
NY = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"
RET = f", r AS (SELECT *, close / lag(close) {W} - 1 AS x FROM bars), v AS (SELECT *, CASE WHEN count(x) {rows(48)} >= 48 THEN stddev_samp(x) {rows(48)} END AS sd FROM r)"
target("us_open_momentum", {"type": "i008_us_open_momentum", "k": 0.5, "vol_bars": 48}, B1 + RET + f""", d AS (SELECT b.symbol, b.ts, CASE WHEN b.close / p.close - 1 >= 0.5 * b.sd * sqrt(2) THEN 1 WHEN b.close / p.close - 1 <= -0.5 * b.sd * sqrt(2) THEN -1 ELSE 0 END AS side FROM v b JOIN bars p ON p.symbol = b.symbol AND p.ts = b.ts - INTERVAL '2 hours' JOIN bars q ON q.symbol = b.symbol AND q.ts = b.ts - INTERVAL '1 hour' WHERE hour({NY.replace('ts', 'b.ts', 1)}) = 9 AND isodow({NY.replace('ts', 'b.ts', 1)}) <= 5)
 SELECT b.symbol, b.ts::VARCHAR AS ts, coalesce(max(d.side), 0)::DOUBLE AS target FROM bars b LEFT JOIN d ON d.symbol = b.symbol AND d.ts <= b.ts AND b.ts < d.ts + INTERVAL '6 hours' GROUP BY b.symbol, b.ts""", "1 hour")
target("weekend_reversal", {"type": "i009_weekend_reversal", "min_move": 0.3, "vol_bars": 48}, B1 + RET + """, d AS (SELECT b.symbol, b.ts, CASE WHEN b.close / p.close - 1 >= 0.3 * b.sd * sqrt(48) THEN -1 WHEN b.close / p.close - 1 <= -0.3 * b.sd * sqrt(48) THEN 1 ELSE 0 END AS side FROM v b JOIN bars p ON p.symbol = b.symbol AND p.ts = b.ts - INTERVAL '48 hours' WHERE isodow(b.ts) = 7 AND hour(b.ts) = 21)
 SELECT b.symbol, b.ts::VARCHAR AS ts, coalesce(max(d.side), 0)::DOUBLE AS target FROM bars b LEFT JOIN d ON d.symbol = b.symbol AND d.ts <= b.ts AND b.ts < d.ts + INTERVAL '24 hours' GROUP BY b.symbol, b.ts""", "1 hour")
target("dual_thrust", {"type": "i007_dual_thrust", "k": 0.3}, B1.replace("WITH ", REC, 1) + """, dd AS (SELECT symbol, date_trunc('day', ts) AS d, count(*) AS n, max(high) AS hh, min(low) AS ll, max(close) FILTER (hour(ts) = 23) AS lc, max(open) FILTER (hour(ts) = 0) AS o FROM bars GROUP BY ALL),
 lv AS (SELECT t.symbol, t.d, t.o, CASE WHEN y.n = 24 AND y.lc IS NOT NULL THEN greatest(y.hh - y.lc, y.lc - y.ll) END AS r FROM dd t LEFT JOIN dd y ON y.symbol = t.symbol AND y.d = t.d - INTERVAL '1 day'),
 g AS MATERIALIZED (SELECT b.symbol, b.ts, b.close, lv.o, CASE WHEN r > 0 AND lv.o IS NOT NULL AND hour(b.ts) <> 23 THEN lv.o + 0.3 * r END AS up, CASE WHEN r > 0 AND lv.o IS NOT NULL AND hour(b.ts) <> 23 THEN lv.o - 0.3 * r END AS dn, lv.d, row_number() OVER (PARTITION BY b.symbol ORDER BY b.ts) AS rn FROM bars b JOIN lv ON lv.symbol = b.symbol AND lv.d = date_trunc('day', b.ts)),
 s AS (SELECT DISTINCT symbol, 0::BIGINT AS rn, NULL::TIMESTAMP AS d, 0 AS pos, false AS lu, false AS su FROM g
 UNION ALL SELECT symbol, rn, d, np, lu OR np = 1, su OR np = -1 FROM (SELECT *, CASE WHEN up IS NULL THEN 0 WHEN pos = 0 THEN CASE WHEN close > up AND NOT lu THEN 1 WHEN close < dn AND NOT su THEN -1 ELSE 0 END
   WHEN pos = 1 THEN CASE WHEN close < dn AND NOT su THEN -1 WHEN close < o THEN 0 ELSE 1 END ELSE CASE WHEN close > up AND NOT lu THEN 1 WHEN close > o THEN 0 ELSE -1 END END AS np FROM (
   SELECT g.symbol, g.rn, g.d::TIMESTAMP AS d, g.close, g.o, g.up, g.dn, CASE WHEN s.d IS DISTINCT FROM g.d THEN 0 ELSE s.pos END AS pos, CASE WHEN s.d IS DISTINCT FROM g.d THEN false ELSE s.lu END AS lu, CASE WHEN s.d IS DISTINCT FROM g.d THEN false ELSE s.su END AS su FROM s JOIN g ON g.symbol = s.symbol AND g.rn = s.rn + 1)))
 SELECT g.symbol, g.ts::VARCHAR AS ts, s.pos::DOUBLE AS target FROM g JOIN s USING (symbol, rn)""", "1 hour")


@query("breakout_bracket_signals", B4 + ATR + f", hl AS (SELECT *, CASE WHEN count(*) {rows(12)} >= 12 THEN max(close) {rows(12)} END AS hi, CASE WHEN count(*) {rows(12)} >= 12 THEN min(close) {rows(12)} END AS lo FROM a)" + RSI.replace(", l AS", ", ll AS").replace("FROM l)", "FROM ll)") + " SELECT hl.symbol, hl.ts::VARCHAR AS ts, coalesce(close >= hi AND strength > 50, false) AS long, coalesce(close <= lo AND strength < 50, false) AS short, round(2.0 * atr, 6) AS stop_dist, round(4.0 * atr, 6) AS target_dist FROM hl JOIN (SELECT symbol, ts, v AS strength FROM v) USING (symbol, ts)")
def breakout_bracket(spark, sf):
    return show(R.with_signals(B.event_bars(spark, sf), {"type": "breakout_bracket", "lookback": 12, "rsi_length": 14}).select("symbol", "ts", "long", "short", "stop_dist", "target_dist"))


@query("squeeze_breakout_signals", B4 + ATR + f", bb AS (SELECT *, {sma_sql('close', 20)} AS mid, CASE WHEN count(*) {rows(20)} >= 20 THEN stddev_pop(close) {rows(20)} END AS dev FROM a), bw AS (SELECT *, 4 * dev / mid AS width FROM bb), sq AS (SELECT *, CASE WHEN count(width) {rows(30)} >= 30 AND width <= min(width) {rows(30)} THEN 1 ELSE 0 END AS narrow FROM bw), ar AS (SELECT *, max(narrow) {rows(10)} > 0 AND atr IS NOT NULL AS ready FROM sq)"
       + " SELECT symbol, ts::VARCHAR AS ts, coalesce(ready AND close > mid + 2 * dev, false) AS long, coalesce(ready AND close < mid - 2 * dev, false) AS short, round(2.0 * atr, 6) AS stop_dist FROM ar")
def squeeze_breakout(spark, sf):
    return show(R.with_signals(B.event_bars(spark, sf), {"type": "i006_squeeze_breakout", "squeeze_bars": 30, "armed_bars": 10}).select("symbol", "ts", "long", "short", "stop_dist"))
