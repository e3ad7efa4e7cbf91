"""Projection, filters, distinct and every join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.ordered import sums_above
from quern.registry import query
from quern.sources.tables import load, small

@query("project_expr", """SELECT l_orderkey, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents, CAST(l_quantity AS BIGINT) AS quantity,
    CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size_class, CAST(l_shipdate AS DATE) AS ship_day FROM lineitem""")
def project_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price_cents"), q.cast("bigint").alias("quantity"),
        F.when(q < 10, "small").when(q < 30, "medium").otherwise("large").alias("size_class"), F.col("l_shipdate").cast("date").alias("ship_day"),
    )


@query("filter_preds", """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000
    AND o_orderstatus IN ('F', 'P') AND o_orderpriority LIKE '%-H%' AND o_orderdate IS NOT NULL AND NOT (o_totalprice BETWEEN 50000 AND 60000)""")
def filter_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    keep = c("o_totalprice").between(1000, 200000) & c("o_orderstatus").isin("F", "P") & c("o_orderpriority").like("%-H%") & c("o_orderdate").isNotNull() & ~c("o_totalprice").between(50000, 60000)
    return load(spark, sf_dir, "orders").filter(keep).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("first_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least struct of a group is a partial aggregate: one row a user is shuffled from each task, not all."""
    least = F.min(F.struct("ts", "event_id", "event_type")).alias("x")
    return load(spark, sf_dir, "events").groupBy("user_id").agg(least).select("user_id", "x.event_id", "x.event_type")


@query("sample_hash", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 = 3")
def sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders", "o_orderkey", "o_custkey").filter(F.pmod("o_orderkey", F.lit(10)) == 3)


_ORDER_CUSTOMER = "SELECT o_orderkey, c_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey"


def _order_customer(spark: SparkSession, sf_dir: str, hint: str | None = None) -> DataFrame:
    customer = load(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    orders = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    right = customer.hint(hint) if hint else customer
    return orders.join(right, orders.o_custkey == right.c_custkey).select("o_orderkey", "c_custkey", "c_name", "c_mktsegment")


@query("join_inner", _ORDER_CUSTOMER)
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_customer(spark, sf_dir)


@query("join_sortmerge", _ORDER_CUSTOMER)
def join_sortmerge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_customer(spark, sf_dir, "merge")


@query("join_shuffle_hash", _ORDER_CUSTOMER)
def join_shuffle_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_customer(spark, sf_dir, "shuffle_hash")


@query("join_left", """SELECT o_orderkey, o_custkey, l_orderkey, n_lines FROM orders
    LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_lines FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with the number of its lines; some orders have none."""
    lines = load(spark, sf_dir, "lineitem", "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    orders = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select("o_orderkey", "o_custkey", "l_orderkey", "n_lines")


@query("join_right", """SELECT o_orderkey, c_custkey, c_name FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') RIGHT JOIN customer ON o_custkey = c_custkey""")
def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with their urgent orders; some customers have none."""
    urgent = load(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    customer = load(spark, sf_dir, "customer", "c_custkey", "c_name")
    return urgent.join(customer, urgent.o_custkey == customer.c_custkey, "right").select("o_orderkey", "c_custkey", "c_name")


@query("join_full", """SELECT o_custkey, n_orders, user_id, n_events FROM (SELECT o_custkey, count(*)::BIGINT AS n_orders FROM orders GROUP BY o_custkey HAVING count(*) > 12)
    FULL OUTER JOIN (SELECT user_id, count(*)::BIGINT AS n_events FROM events GROUP BY user_id) ON o_custkey = user_id""")
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of many orders beside the users seen in events; some are only the one or the other."""
    buyers = load(spark, sf_dir, "orders", "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n_orders")).filter("n_orders > 12")
    users = load(spark, sf_dir, "events", "user_id").groupBy("user_id").agg(F.count("*").alias("n_events"))
    return buyers.join(users, buyers.o_custkey == users.user_id, "full")


@query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer", "c_custkey", "c_name")
    orders = load(spark, sf_dir, "orders").filter("o_totalprice > 400000").select("o_custkey")
    return customer.join(orders, customer.c_custkey == orders.o_custkey, "left_semi")


@query("join_anti", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    lines = load(spark, sf_dir, "lineitem", "l_orderkey")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_anti")


@query("join_broadcast", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = small(load(spark, sf_dir, "nation")), small(load(spark, sf_dir, "region"))
    customer = load(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("join_theta", """SELECT s_suppkey, count(c_custkey)::BIGINT AS richer FROM supplier JOIN customer ON s_nationkey = c_nationkey AND c_acctbal > s_acctbal GROUP BY s_suppkey""")
def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A non-equi predicate beside an equi key of few values, so pairs of rows are never made: each nation's customers are summed up by ranges of balance."""
    supplier = load(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    customer = load(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal", F.col("c_custkey").isNotNull().cast("bigint").alias("known"))
    met = sums_above(supplier, "s_acctbal", customer, "c_acctbal", {"known": "richer"}, by=("s_nationkey", "c_nationkey")).filter("matches > 0")
    return met.groupBy("s_suppkey").agg(F.sum("richer").alias("richer"))


@query("join_cross", "SELECT a.r_name AS left_region, b.r_name AS right_region FROM region a CROSS JOIN region b")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = load(spark, sf_dir, "region")
    return region.select(F.col("r_name").alias("left_region")).crossJoin(region.select(F.col("r_name").alias("right_region")))


@query("join_range", """SELECT a.event_id AS error_id, b.event_id AS purchase_id, a.user_id FROM events a JOIN events b
    ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2 DAY WHERE a.event_type = 'error' AND b.event_type = 'purchase'""")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join by day bins: an error meets the bins that its two days touch, so equal keys carry the join and users are split by day."""
    events = load(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    day = F.unix_date(F.col("ts").cast("date"))
    a = events.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("ts").alias("at"), F.explode(F.sequence(day, day + 2)).alias("bin"))
    b = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", "ts", day.alias("bin"))
    within = (F.col("ts") > F.col("at")) & (F.col("ts") <= F.col("at") + F.expr("INTERVAL 2 DAYS"))
    return a.join(b, ["user_id", "bin"]).filter(within).select("error_id", "purchase_id", "user_id")


@query("join_null_safe", """SELECT a.o_orderkey, b.n_name FROM (SELECT o_orderkey, nullif(o_orderkey % 30, 25) AS k FROM orders) a
    JOIN (SELECT n_name, nullif(n_nationkey, 0) AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k""")
def join_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "orders").select("o_orderkey", F.expr("nullif(o_orderkey % 30, 25)").alias("k"))
    b = load(spark, sf_dir, "nation").select("n_name", F.expr("nullif(n_nationkey, 0)").alias("k"))
    return a.join(b, a.k.eqNullSafe(b.k)).select("o_orderkey", "n_name")
