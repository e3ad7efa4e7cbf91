"""Window functions and frames, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.registry import query
from quern.sources.tables import load


@query("win_rank", """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr,
    round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 9) AS pr, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 9) AS cd, ntile(4) OVER w AS quarter
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def win_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    big = lambda c, name: c.cast("bigint").alias(name)
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", big(F.row_number().over(w), "rn"), big(F.rank().over(p), "rk"), big(F.dense_rank().over(p), "dr"),
        F.round(F.percent_rank().over(p), 9).alias("pr"), F.round(F.cume_dist().over(p), 9).alias("cd"), big(F.ntile(4).over(w), "quarter"),
    )


@query("win_offset", """SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after2, first_value(event_id) OVER w AS first_id,
    last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id,
    nth_value(event_id, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third_id
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def win_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return load(spark, sf_dir, "events").select(
        "event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id", 2).over(w).alias("after2"), F.first("event_id").over(w).alias("first_id"),
        F.last("event_id").over(whole).alias("last_id"), F.nth_value("event_id", 3).over(whole).alias("third_id"),
    )


_CENTS = "CAST(round(value * 100) AS BIGINT)"


def _sum_over(w, spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.sum(F.round(F.col("value") * 100).cast("bigint")).over(w).alias("total"))


@query("win_moving", f"SELECT event_id, (sum({_CENTS}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING))::BIGINT AS total FROM events")
def win_moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sum_over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0), spark, sf_dir)


@query("win_range", f"SELECT event_id, (sum({_CENTS}) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW))::BIGINT AS total FROM events")
def win_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sum_over(Window.partitionBy("user_id").orderBy("event_id").rangeBetween(-500, 0), spark, sf_dir)


@query("win_topn", """SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def win_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter on row_number becomes a WindowGroupLimit before the shuffle, so each task sends three rows a customer at most."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("o_custkey", "o_orderkey", F.col("rn").cast("bigint").alias("rn"))


@query("sort_multi", "SELECT c_custkey, c_mktsegment, c_nationkey FROM customer ORDER BY c_mktsegment DESC NULLS LAST, nullif(c_nationkey, 3) ASC NULLS LAST, c_custkey")
def sort_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").orderBy(F.desc_nulls_last("c_mktsegment"), F.expr("nullif(c_nationkey, 3)").asc_nulls_last(), "c_custkey").select("c_custkey", "c_mktsegment", "c_nationkey")


@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("limit_offset", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40")
def limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").orderBy("c_custkey").offset(40).limit(20).select("c_custkey", "c_name")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = load(spark, sf_dir, "lineitem")
    return lines.filter("l_returnflag = 'A'").select("l_suppkey", "l_linenumber"), lines.filter("l_returnflag = 'R' AND l_quantity < 3").select("l_suppkey", "l_linenumber")


_A = "SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A'"
_R = "SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 3"


def _set_op(name: str, sql: str, op):
    @query(name, f"{_A} {sql} {_R}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(*_sides(spark, sf_dir))

    return run


union_all = _set_op("union_all", "UNION ALL", lambda a, b: a.unionByName(b))
union_distinct = _set_op("union_distinct", "UNION", lambda a, b: a.unionByName(b).distinct())
intersect = _set_op("intersect", "INTERSECT", lambda a, b: a.intersect(b))
intersect_all = _set_op("intersect_all", "INTERSECT ALL", lambda a, b: a.intersectAll(b))
except_distinct = _set_op("except", "EXCEPT", lambda a, b: a.subtract(b))
except_all = _set_op("except_all", "EXCEPT ALL", lambda a, b: a.exceptAll(b))
