"""Queries beside their SQL on tables with firms of a single row."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("customer", "supplier", "part", "orders", "lineitem")


@pytest.fixture(scope="module")
def lone_dir(sf_dir, tmp_path_factory):
    """sf0.001, of every fifth customer one line only."""
    out = tmp_path_factory.mktemp("lone")
    for name in TABLES:
        sql = f"SELECT * FROM '{sf_dir}/{name}.parquet'"
        if name == "lineitem":
            sql = (
                f"SELECT l.* FROM ({sql}) l JOIN '{sf_dir}/orders.parquet' ON l_orderkey = o_orderkey "
                "QUALIFY o_custkey % 5 > 0 OR row_number() OVER (PARTITION BY o_custkey "
                "ORDER BY l_partkey % 11 = 0, l_orderkey, l_linenumber) = 1"
            )
        duckdb.sql(f"COPY ({sql}) TO '{out}/{name}.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", ["subgroup_curves", "effect_levels"])
def test_samples_without_singletons(spark, lone_dir, name):
    link = duckdb.connect()
    for table in TABLES:
        link.execute(f"CREATE VIEW {table} AS SELECT * FROM '{lone_dir}/{table}.parquet'")
    want = sorted(link.execute(entry.oracle_sql()[name]).fetchall())
    got = sorted(tuple(r) for r in entry.queries()[name](spark, lone_dir).collect())
    assert got == want
    lines = link.execute("SELECT count(*) FROM lineitem").fetchall()[0][0]
    assert name != "effect_levels" or {r[2] for r in got} == {lines, lines - 30}
