"""Every query with an oracle agrees with DuckDB on the smallest data."""

import duckdb
import pytest

from tidemill import queries as own

SF = "/root/testdata/sf0.001"
own.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    a, b = (x[cols].sort_values(cols, ignore_index=True) for x in (a, b))
    assert len(a) == len(b)
    for c in cols:
        equal = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert equal.all(), (c, a[c][~equal].head(3).tolist(), b[c][~equal].head(3).tolist())


@pytest.mark.parametrize("name", sorted(own.ORACLE))
def test_oracle(spark, duck, name):
    same(own.SPARK[name](spark, SF).toPandas(), duck.sql(own.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(own.SPARK) - set(own.ORACLE)))
def test_runs(spark, name):
    assert own.SPARK[name](spark, SF).count() > 0
