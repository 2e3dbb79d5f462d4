"""Every query of the library against its DuckDB form on the smallest tables."""

import math
import os

import duckdb
import pytest

from bidloom.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plain(v):
    import decimal

    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def duck(sql):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = con.sql(sql)
    order = sorted(got.columns)
    at = [got.columns.index(c) for c in order]
    return order, sorted(repr(tuple(plain(r[i]) for i in at)) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name in SQL:
        assert (columns, got) == duck(SQL[name])
    else:
        assert got


def test_llm_is_not_imported_by_the_rest():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys, bidloom.plans, bidloom.streaming.ingest, bidloom.sources.documents; assert not any(m.startswith('bidloom.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
