"""Every registered array query against its SQL on the smallest tables, and the driver's contract."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from cubeflow.plans import queries as array

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return "nan" if isinstance(x, float) and math.isnan(x) else repr(float(x))
    return str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", list(array.QUERIES))
def test_against_sql(spark, db, name):
    df = array.QUERIES[name](spark, SF)
    want = db.sql(array.ORACLES[name])
    assert table(df.columns, df.collect()) == table(want.columns, want.fetchall())


@pytest.fixture(scope="module")
def apart(spark, db, tmp_path_factory):
    """Copies of the line items whose keys lie 1,000,000,000 apart."""
    folder = tmp_path_factory.mktemp("apart")
    keys = ", ".join(f"{k} + i * 1000000000 AS {k}" for k in ("l_orderkey", "l_partkey", "l_suppkey"))
    c = duckdb.connect()
    c.sql(f"COPY (SELECT * REPLACE ({keys}) FROM '{SF}/lineitem.parquet', range(4) r(i)) TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    return str(folder), c


def against_sql_apart(spark, apart, name):
    df, want = array.QUERIES[name](spark, apart[0]), apart[1].sql(array.ORACLES[name])
    rows = df.collect()
    assert rows and table(df.columns, rows) == table(want.columns, want.fetchall())


def test_big_subset_of_keys_beyond_32_bits(spark, apart):
    against_sql_apart(spark, apart, "big_subset")


def test_big_traces_of_keys_beyond_32_bits(spark, apart):
    against_sql_apart(spark, apart, "big_traces")


def test_big_lod_of_keys_beyond_32_bits(spark, apart):
    against_sql_apart(spark, apart, "big_lod")


@pytest.mark.parametrize("name", ["big_traces", "big_subset", "big_lod"])
@pytest.mark.parametrize("step", [10**12, 10**17])
def test_big_queries_of_more_chunks_than_64_bit_numbers(spark, db, tmp_path, name, step):
    keys = ", ".join(f"{k} + i * {step} AS {k}" for k in ("l_orderkey", "l_partkey", "l_suppkey"))
    c = duckdb.connect()
    c.sql(f"COPY (SELECT * REPLACE ({keys}) FROM '{SF}/lineitem.parquet', range(60) r(i) USING SAMPLE 20000 ROWS (reservoir, 7)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    against_sql_apart(spark, (str(tmp_path), c), name)


def test_entry_and_contract(spark, db):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(array.QUERIES) <= set(entry.queries())
