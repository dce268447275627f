"""Every catalog query that SQL can express equals DuckDB's answer on the same tables."""

import duckdb
import pytest
from factloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def told(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(map(repr, plain.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    try:
        want = con.execute(catalog.ORACLE_SQL[name]).df()
    except duckdb.InternalException as broken:  # a fault of this DuckDB build on dictionary columns
        pytest.skip(str(broken)[:80])
    assert told(catalog.QUERIES[name](spark, SF).toPandas()) == told(want)
