"""Spark queries against their DuckDB oracles on the smallest scale."""
import duckdb
import pytest

import __spark_entry__ as E
from stoich.sources.tables import TABLES
from tools.check_oracle import digest

SF = "/root/testdata/sf0.001"


def _names():
    """Every oracle of the library proper; those of the training-data
    operators are checked where these are present."""
    return sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", _names())
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_every_query_has_a_callable_and_entry_runs(spark):
    qs = E.queries()
    assert set(E.oracle_sql()) <= set(qs)
    df = E.entry(spark)
    assert df.columns == ["sample_id", "feature_id", "value"]
    assert df.limit(5).count() == 5
