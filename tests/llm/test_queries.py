"""The queries with SQL against DuckDB on whole tables."""

import duckdb
import pytest
from weftline.llm import queries, url_filter


def rows(d):
    return sorted(map(str, d))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "pages", "clicks"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    want = c.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(tuple(r) for r in df.select(*cols).collect()) == rows(want.fetchall())


def test_alias_sql(spark):
    link = '<link rel="canonical" href="{}">'
    data = [(1, "http://a.net/x#f", link.format("https://example.org/es/1")), (2, "http://a.net/x", ""), (3, "http://b.net/", '<meta http-equiv="refresh" content="0; url=q">'), (4, "http://b.net/q", link.format("//shop.com/de/1")),
            (5, "http://c.net/q", link.format("http://A.com/de/2?a=1&amp;b=2")), (6, "http://a.com/de/2?a=1&b=2", link.format("http://a.com/fr/2")), (7, None, None), (8, "x", "canonical")]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    pages = df.toPandas()  # noqa: F841  DuckDB reads it by name
    got = url_filter.filter_urls(df).select("page_id", "host", "path", "rule", "verdict").collect()
    want = duckdb.sql(queries.OP1_SQL).select("page_id", "host", "path", "rule", "verdict").fetchall()
    assert rows(tuple(r) for r in got) == rows(want)
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block", 7: "allow", 8: "allow"}
