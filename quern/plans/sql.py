"""Queries written as SQL: subqueries, common table expressions, lateral joins and the pricing and supply reports.

Tables are bound as named arguments of spark.sql, so no view is left behind. {name} stands for a table.
"""

from __future__ import annotations

from quern.registry import sql_query

sql_query("subq_scalar", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > (SELECT max(o_totalprice) * 0.98 FROM {orders})", tables=("orders",))
sql_query("subq_exists", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", tables=("customer", "orders"))
sql_query("subq_in", "SELECT p_partkey, p_name FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity = 50) AND p_size NOT IN (SELECT n_nationkey FROM {nation})", tables=("part", "lineitem", "nation"))
sql_query("subq_correlated", "SELECT o.o_orderkey, o.o_custkey FROM {orders} o WHERE o.o_totalprice = (SELECT max(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)", tables=("orders",))
sql_query(
    "cte",
    "WITH spent AS (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM {orders} GROUP BY o_custkey), big AS (SELECT * FROM spent WHERE cents > 200000000) SELECT c_custkey, c_name, cents FROM {customer} JOIN big ON c_custkey = o_custkey",
    tables=("orders", "customer"),
)
sql_query(
    "cte_recursive",
    "WITH RECURSIVE steps(n, total) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, total + n + 1 FROM steps WHERE n < 50) SELECT n, total, r_name FROM steps JOIN {region} ON n % 5 = r_regionkey",
    tables=("region",),
)
sql_query(
    "lateral",
    "SELECT c_custkey, x.o_orderkey FROM {customer} c, LATERAL (SELECT o_orderkey FROM {orders} o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) x",
    # Spark turns ORDER BY and LIMIT of a lateral subquery into a row number without an order, over sorted rows that a shuffle then mixes. So the order is the window's own, with nulls where DuckDB has them.
    text="""SELECT c_custkey, x.o_orderkey FROM {customer} c, LATERAL (SELECT o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS LAST) AS place FROM {orders}) o
    WHERE o.o_custkey = c.c_custkey AND place = 1) x""",
    tables=("customer", "orders"),
)

_PRICE = "CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))"
_REVENUE = f"CAST(sum({_PRICE}) AS BIGINT) AS revenue_e4"
_DAY = "CAST({} AS DATE)"

sql_query(
    "tpch_q01",
    f"""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS sum_base_cents, {_REVENUE},
    CAST(sum({_PRICE} * (100 + CAST(round(l_tax * 100) AS BIGINT))) AS BIGINT) AS charge_e6, CAST(count(*) AS BIGINT) AS count_order, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS avg_qty
    FROM {{lineitem}} WHERE {_DAY.format('l_shipdate')} <= DATE '2001-08-01' GROUP BY l_returnflag, l_linestatus""",
    tables=("lineitem",),
)
sql_query(
    "tpch_q03",
    f"""SELECT l_orderkey, {_REVENUE}, CAST(o_orderdate AS DATE) AS o_day FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND CAST(o_orderdate AS DATE) < DATE '1998-03-15' AND CAST(l_shipdate AS DATE) > DATE '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue_e4 DESC, l_orderkey LIMIT 10""",
    tables=("customer", "orders", "lineitem"),
)
sql_query(
    "tpch_q05",
    f"""SELECT n_name, {_REVENUE} FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey JOIN {{supplier}} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
    JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AND CAST(o_orderdate AS DATE) < DATE '1999-01-01' GROUP BY n_name""",
    tables=("customer", "orders", "lineitem", "supplier", "nation", "region"),
)
sql_query(
    "tpch_q06",
    """SELECT CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS revenue_e4 FROM {lineitem}
    WHERE CAST(l_shipdate AS DATE) >= DATE '1996-01-01' AND CAST(l_shipdate AS DATE) < DATE '1997-01-01' AND CAST(round(l_discount * 100) AS BIGINT) BETWEEN 5 AND 7 AND l_quantity < 24""",
    tables=("lineitem",),
)
sql_query(
    "tpch_q07",
    f"""SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, {_REVENUE} FROM {{supplier}} JOIN {{lineitem}} ON s_suppkey = l_suppkey JOIN {{orders}} ON o_orderkey = l_orderkey
    JOIN {{customer}} ON c_custkey = o_custkey JOIN {{nation}} n1 ON s_nationkey = n1.n_nationkey JOIN {{nation}} n2 ON c_nationkey = n2.n_nationkey
    WHERE (n1.n_name IN ('NATION_1', 'NATION_2', 'NATION_3') AND n2.n_name IN ('NATION_4', 'NATION_5', 'NATION_6')) GROUP BY n1.n_name, n2.n_name, CAST(year(l_shipdate) AS BIGINT)""",
    tables=("supplier", "lineitem", "orders", "customer", "nation"),
)
sql_query(
    "tpch_q08",
    f"""SELECT o_year, CAST(sum(CASE WHEN s_nation = 'NATION_7' THEN volume ELSE 0 END) AS BIGINT) AS nation_e4, CAST(sum(volume) AS BIGINT) AS all_e4 FROM (
    SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, {_PRICE} AS volume, n2.n_name AS s_nation FROM {{part}} JOIN {{lineitem}} ON p_partkey = l_partkey JOIN {{supplier}} ON s_suppkey = l_suppkey JOIN {{orders}} ON o_orderkey = l_orderkey
    JOIN {{customer}} ON c_custkey = o_custkey JOIN {{nation}} n1 ON c_nationkey = n1.n_nationkey JOIN {{region}} ON n1.n_regionkey = r_regionkey JOIN {{nation}} n2 ON s_nationkey = n2.n_nationkey
    WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY') AS sold GROUP BY o_year""",
    tables=("part", "lineitem", "supplier", "orders", "customer", "nation", "region"),
)
sql_query(
    "tpch_q10",
    f"""SELECT c_custkey, c_name, {_REVENUE}, n_name FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey JOIN {{nation}} ON c_nationkey = n_nationkey
    WHERE CAST(o_orderdate AS DATE) >= DATE '1997-01-01' AND CAST(o_orderdate AS DATE) < DATE '1997-07-01' AND l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY revenue_e4 DESC, c_custkey LIMIT 20""",
    tables=("customer", "orders", "lineitem", "nation"),
)
sql_query(
    "tpch_q13",
    """SELECT c_count, CAST(count(*) AS BIGINT) AS custdist FROM (SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS c_count FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority <> '5-LOW' GROUP BY c_custkey) AS counted GROUP BY c_count""",
    tables=("customer", "orders"),
)
sql_query(
    "tpch_q14",
    f"""SELECT CAST(sum(CASE WHEN p_type = 'PROMO' THEN {_PRICE} ELSE 0 END) AS BIGINT) AS promo_e4, {_REVENUE} FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
    WHERE CAST(l_shipdate AS DATE) >= DATE '1997-09-01' AND CAST(l_shipdate AS DATE) < DATE '1997-12-01'""",
    tables=("lineitem", "part"),
)
sql_query(
    "tpch_q15",
    f"""WITH revenue AS (SELECT l_suppkey AS supplier_no, {_REVENUE} FROM {{lineitem}} WHERE CAST(l_shipdate AS DATE) >= DATE '1996-01-01' AND CAST(l_shipdate AS DATE) < DATE '1996-07-01' GROUP BY l_suppkey)
    SELECT s_suppkey, s_name, revenue_e4 FROM {{supplier}} JOIN revenue ON s_suppkey = supplier_no WHERE revenue_e4 = (SELECT max(revenue_e4) FROM revenue)""",
    tables=("lineitem", "supplier"),
)
sql_query(
    "tpch_q17",
    """SELECT CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM {lineitem} l JOIN {part} ON p_partkey = l.l_partkey WHERE p_brand = 'Brand#3'
    AND 5 * l.l_quantity < (SELECT CAST(sum(CAST(i.l_quantity AS BIGINT)) AS DOUBLE) / count(*) * 2 FROM {lineitem} i WHERE i.l_partkey = l.l_partkey)""",
    tables=("lineitem", "part"),
)
sql_query(
    "tpch_q18",
    """SELECT c_name, c_custkey, o_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON o_orderkey = l_orderkey
    WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 200) GROUP BY c_name, c_custkey, o_orderkey""",
    tables=("customer", "orders", "lineitem"),
)
sql_query(
    "tpch_q19",
    f"""SELECT {_REVENUE} FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey WHERE (p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5)
    OR (p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10) OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)""",
    tables=("lineitem", "part"),
)
