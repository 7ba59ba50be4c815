"""Queries agree with DuckDB where prices fall to 0, rise without measure and accounts are ruined."""

import duckdb
import numpy as np
import pytest

from tidemill import queries as own

own.load()
NAMES = ["momentum", "combine", "block_bootstrap", "path_bands", "fingerprint", "fingerprint_nearest", "monkey_shift", "capture", "ledger", "ewm_vol", "carver_breakout", "funding_carry", "account_summary"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The smallest events three times over with shifted keys, moves sixty times as large."""
    path = tmp_path_factory.mktemp("extreme")
    duckdb.sql(f"COPY (SELECT e.* REPLACE (event_id + 1000 * k AS event_id, 50 + 60 * (value - 50) AS value) FROM '/root/testdata/sf0.001/events.parquet' e, range(3) r(k)) TO '{path}/events.parquet' (FORMAT parquet)")
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    return str(path), c


@pytest.mark.parametrize("name", NAMES)
def test_agrees(spark, tables, name):
    path, duck = tables
    keys = [k for k in ("symbol", "ts", "key", "day", "run", "step", "entry", "exit") if k in own.ORACLE[name].rsplit("SELECT", 1)[1]]
    got, want = own.SPARK[name](spark, path).toPandas(), duck.sql(own.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    keys = [k for k in keys if k in got.columns]
    if keys:
        got, want = (x.sort_values(keys, ignore_index=True) for x in (got, want))
    for c in got.columns:
        a, b = got[c], want[c]
        equal = (a == b) | (a.isna() & b.isna())
        if a.dtype == float:
            with np.errstate(invalid="ignore"):
                equal |= (a - b).abs() <= 1e-9 * b.abs()
        assert equal.all(), (c, a[~equal].head(3).tolist(), b[~equal].head(3).tolist())
