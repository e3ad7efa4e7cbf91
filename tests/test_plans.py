"""The plans that the queries are meant to have."""

import re

import duckdb

from quern import registry
from quern.operators.ordered import as_of


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(registry.QUERIES["scan_parquet"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,45.0)]" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in text


def test_partition_filter_prunes(spark, sf_dir):
    assert "PartitionFilters: [isnotnull(l_returnflag" in plan(registry.QUERIES["partitioned_write"](spark, sf_dir))


def test_topn_limits_groups_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(registry.QUERIES["win_topn"](spark, sf_dir))


def test_subqueries_are_decorrelated(spark, sf_dir):
    for name in ("subq_exists", "subq_correlated", "lateral"):
        assert "CartesianProduct" not in plan(registry.QUERIES[name](spark, sf_dir))


def test_lateral_numbers_rows_in_order(spark, sf_dir):
    """The window itself orders, not a sort below a shuffle, which need not keep its order."""
    text = plan(registry.QUERIES["lateral"](spark, sf_dir)).split("== Physical Plan ==")[1]
    assert re.search(r"row_number\(\) windowspecdefinition\(o_custkey#\d+L, o_totalprice#\d+ DESC NULLS LAST, o_orderkey#\d+L ASC NULLS LAST", text) and "rangepartitioning" not in text


def test_lateral_orders_nulls_as_its_sql(spark, tmp_path):
    """Equal prices with and without a key, no price at all, and customers and orders that occur twice."""
    customer = [(i,) for i in (0, 1, 2, 3, 3, 4, None)]
    orders = [(1, 0, 5.0), (2, 0, 5.0), (None, 0, 5.0), (3, 1, None), (4, 1, 1.0), (None, 2, None), (6, 2, None), (7, 3, 1.0), (7, 3, 1.0), (None, 4, 2.0), (8, 4, 1.0), (9, None, 1.0)]
    spark.createDataFrame(customer, "c_custkey bigint").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, registry.QUERIES["lateral"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(con.execute(registry.ORACLES["lateral"]).fetchall(), key=repr) and (0, 1) in got


def test_as_of_keeps_left_rows_without_a_match(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c"), (None, 9, "d")], "k int, t int, x string")
    right = spark.createDataFrame([(1, 3, "p"), (1, 5, "q"), (1, 7, "r"), (None, 1, "n")], "k int, t int, v string")
    got = {r.x: r.found for r in as_of(left, right, "k", "t", "v", "found").collect()}
    assert got == {"a": "q", "b": None, "c": None, "d": "n"}
