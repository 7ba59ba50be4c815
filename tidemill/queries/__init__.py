"""Named queries over the driver tables, each with a DuckDB oracle where SQL can express it."""

from __future__ import annotations

import importlib

SPARK: dict = {}
ORACLE: dict[str, str] = {}
MODULES = ("bars", "indicators", "rules", "simulation", "lab", "sources")


def query(name: str, sql: str | None = None):
    def add(function):
        SPARK[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"tidemill.queries.{module}")


# --- SQL pieces shared by the oracles ---------------------------------------------------------

TICKS = "ticks AS (SELECT event_type AS symbol, ts, event_id, value, round(100 * exp(0.0004 * sum(value - 50) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), 4) AS price FROM events)"


def bars_sql(step: str = "4 hours") -> str:
    """WITH ... bars(symbol, ts, open, high, low, close, volume, funding_rate), gap-filled."""
    return f"""WITH {TICKS},
raw AS (SELECT symbol, time_bucket(INTERVAL '{step}', ts) AS ts, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume FROM ticks GROUP BY ALL),
grid AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL '{step}')) AS ts FROM raw GROUP BY symbol),
filled AS (SELECT g.symbol, g.ts, r.open, r.high, r.low, r.close, r.volume, last_value(r.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.ts) AS lc FROM grid g LEFT JOIN raw r ON g.symbol = r.symbol AND g.ts = r.ts),
rates AS (SELECT time_bucket(INTERVAL '{step}', ts - INTERVAL '1 millisecond') AS ts, sum((value - 50) * 1e-6) AS rate FROM events WHERE event_type = 'error' GROUP BY ALL),
bars AS (SELECT f.symbol, f.ts, coalesce(open, lc) AS open, coalesce(high, lc) AS high, coalesce(low, lc) AS low, coalesce(close, lc) AS close, coalesce(volume, 0) AS volume, coalesce(rate, 0) AS funding_rate FROM filled f LEFT JOIN rates USING (ts))"""


DAILY = """WITH bars AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
 last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close, count(*)::DOUBLE AS volume, 0.0::DOUBLE AS funding_rate FROM orders GROUP BY ALL)"""

W = "OVER (PARTITION BY symbol ORDER BY ts)"


def rows(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def sma_sql(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {rows(n)} >= {n} THEN avg({x}) {rows(n)} END"
