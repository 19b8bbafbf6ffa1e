"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""
import hashlib
import math

import duckdb
import pytest

from contingo.plans import all_oracles, all_queries
from contingo.sources.io import TABLES

SF = "/root/testdata/sf0.001"
SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
                 "boolean": "BOOLEAN", "date": "DATE", "array<double>": "DOUBLE[]"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha256("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_matches_oracle(spark, con, name):
    df = all_queries()[name](spark, SF)
    s_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(all_oracles()[name])
    d_cols = [c[0] for c in cur.description]
    d_rows = [tuple(r) for r in cur.fetchall()]
    assert sorted(df.columns) == sorted(d_cols)
    d_types = dict(zip(d_cols, [str(t) for t in con.sql(all_oracles()[name]).types]))
    for col, t in df.dtypes:
        assert SPARK_TO_DUCK.get(t, t) == d_types[col], (col, t, d_types[col])
    assert len(s_rows) == len(d_rows)
    assert _digest(df.columns, s_rows) == _digest(d_cols, d_rows)


def test_rows_only_queries_run(spark):
    for name in sorted(set(all_queries()) - set(all_oracles())):
        assert all_queries()[name](spark, SF).count() >= 0


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
