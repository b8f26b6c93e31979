"""Every query against its SQL in DuckDB, and the others for their columns."""

import math
import os

import duckdb
import pytest
from weftline.plans import listing_queries, view_queries  # noqa: F401  they register their queries
from weftline.plans.queries import ORACLES, QUERIES

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    return float(v) if hasattr(v, "as_integer_ratio") else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert df.columns and rows
        return
    want = duck.execute(ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    left = sorted(([plain(r[c]) for c in order] for r in rows), key=str)
    right = sorted(([plain(r[cols.index(c)]) for c in order] for r in want.fetchall()), key=str)
    assert len(left) == len(right)
    for a, b in zip(left, right, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, float) and isinstance(y, (float, int)) and abs(x - y) <= 2e-6 * max(1, abs(x)), (a, b)
    assert rows, "no rows tell nothing"
