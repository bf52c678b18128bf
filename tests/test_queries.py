"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from paperloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def plain(rows):
    return sorted(str(tuple(round(float(x), 6) if isinstance(x, float) else int(x) if type(x).__name__ == "Decimal" else x for x in row)) for row in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, oracle, name):
    frame = catalogue.QUERIES[name](spark, DATA)
    expected = oracle.sql(catalogue.SQL[name])
    assert sorted(frame.columns) == sorted(expected.columns)
    columns = ", ".join(f'"{c}"' for c in frame.columns)
    assert plain(map(tuple, frame.collect())) == plain(oracle.sql(f"SELECT {columns} FROM ({catalogue.SQL[name]})").fetchall())


def test_entry_and_registration(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
