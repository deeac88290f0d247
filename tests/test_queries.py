"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from millrace.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    got = QUERIES[name](spark, D)
    want = duck.sql(ORACLES[name]).to_arrow_table()
    names = sorted(got.columns)
    assert names == sorted(want.column_names)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    left = sorted((tuple(r[c] for c in names) for r in got.collect()), key=key)
    right = sorted(zip(*(want.column(c).to_pylist() for c in names), strict=True), key=key)
    assert left == right


@pytest.mark.parametrize("name", ["run_status", "gate_latency", "circuit_state", "admission"])
def test_same_rows_with_one_shuffle_partition(spark, name):
    many = sorted(map(str, QUERIES[name](spark, D).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(map(str, QUERIES[name](spark, D).collect())) == many
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
