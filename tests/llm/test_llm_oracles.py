"""Registered queries against their DuckDB oracles, whole tables."""
import duckdb
import pytest

from ecotally.llm import catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    rel = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in rel.description]
    want = sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in rel.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(r) for r in df.select(sorted(cols)).collect()), key=repr) == want
