"""Every core query with SQL against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from paperloom import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame, names):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
            return bool(v)
        if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.shape == ():
            return round(float(v), 6)
        return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)

    return sorted([tuple(cell(v) for v in r) for r in frame[names].itertuples(index=False, name=None)], key=str)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_duckdb(spark, small, duck, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    want = duck.execute(queries.ORACLE_SQL[name]).fetchdf()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert rows(got, names) == rows(want, names)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, small, name):
    """Queries without SQL give rows; tests/test_more.py compares them with plain Python."""
    assert queries.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
