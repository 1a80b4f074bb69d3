"""Every registered query of the graph library against its DuckDB SQL."""

import math

import duckdb
import pytest

from loomgraph import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", plans.QUERIES)
def test_query_equals_oracle(spark, duck, name):
    frame = plans.QUERIES[name](spark, SF)
    cursor = duck.execute(plans.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    got = sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in frame.collect())
    want = sorted(repr([plain(dict(zip(columns, r))[c]) for c in sorted(columns)]) for r in cursor.fetchall())
    assert got == want


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
