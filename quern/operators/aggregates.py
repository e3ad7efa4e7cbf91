"""Aggregations: plain, distinct, approximate, grouping sets, statistics, collections, pivot and unpivot.

Sums of money go over whole cents, so that the order of adding does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.registry import query
from quern.sources.tables import load
from quern.storage import stored


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


_CENTS = "CAST(round({} * 100) AS BIGINT)"


@query("agg_basic", f"""SELECT l_returnflag, count(*)::BIGINT AS n, sum({_CENTS.format('l_extendedprice')})::BIGINT AS price_cents,
    sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity, min(l_extendedprice) AS low, max(l_extendedprice) AS high, sum(CAST(l_quantity AS BIGINT))::DOUBLE / count(*) AS mean_quantity
    FROM lineitem GROUP BY l_returnflag""")
def agg_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.sum(F.col("l_quantity").cast("bigint"))
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.sum(cents("l_extendedprice")).alias("price_cents"), q.alias("quantity"),
        F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), (q.cast("double") / F.count("*")).alias("mean_quantity"),
    )


@query("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey)::BIGINT AS parts, count(DISTINCT l_suppkey)::BIGINT AS suppliers FROM lineitem GROUP BY l_returnflag")
def agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("agg_approx_distinct")
def agg_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HyperLogLog; tested against the exact count, as engines' sketches differ."""
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


#: How far an estimate may be off, relative to the exact number, and bits of the number of a sketch's registers. Their relative standard error, 1.04 / sqrt(2 ** SKETCH_BITS), is a sixth of NEAR: of hundreds of
#: groups some are three errors off, none six.
NEAR = 3 * 1.04 / 2**6
SKETCH_BITS = 14


def distinct_rollup(lines: DataFrame) -> DataFrame:
    """level, month, flag and estimate: how many parts there are in each month and flag, month, flag, and in all, from sketches of each month and flag that are stored once and then merged; no row is read again."""
    month = F.date_format("l_shipdate", "yyyy-MM")
    sketches = stored(lines.groupBy(month.alias("month"), F.col("l_returnflag").alias("flag")).agg(F.hll_sketch_agg("l_partkey", SKETCH_BITS).alias("sketch")), "sketches")
    count = F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate")
    levels = [("month, flag", ["month", "flag"]), ("month", ["month"]), ("flag", ["flag"]), ("all", [])]
    name = lambda keys, k: F.col(k) if k in keys else F.lit(None).cast("string").alias(k)
    parts = [sketches.groupBy(*keys).agg(count).select(F.lit(level).alias("level"), name(keys, "month"), name(keys, "flag"), "estimate") for level, keys in levels]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("agg_hll_rollup", """SELECT CASE grouping(month) * 2 + grouping(flag) WHEN 0 THEN 'month, flag' WHEN 1 THEN 'month' WHEN 2 THEN 'flag' ELSE 'all' END AS level, month, flag, count(DISTINCT l_partkey)::BIGINT AS parts, true AS near
    FROM (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag AS flag, l_partkey FROM lineitem) GROUP BY CUBE (month, flag)""")
def agg_hll_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact numbers, and whether the merged sketches are within NEAR of them at every level."""
    lines = load(spark, sf_dir, "lineitem", "l_shipdate", "l_returnflag", "l_partkey")
    cube = lines.cube(F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_returnflag").alias("flag")).agg(F.grouping_id().alias("g"), F.count_distinct("l_partkey").alias("parts"))
    exact = cube.select(F.element_at(F.array(*map(F.lit, ("month, flag", "month", "flag", "all"))), (F.col("g") + 1).cast("int")).alias("level"), "month", "flag", "parts")
    met = exact.alias("x").join(distinct_rollup(lines).alias("y"), (F.col("x.level") == F.col("y.level")) & F.col("x.month").eqNullSafe(F.col("y.month")) & F.col("x.flag").eqNullSafe(F.col("y.flag")))
    return met.select("x.level", "x.month", "x.flag", "parts", (F.abs(F.col("estimate") - F.col("parts")) <= F.greatest(F.lit(1.0), NEAR * F.col("parts"))).alias("near"))


@query("agg_filter", """SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase')::BIGINT AS purchases, count(*) FILTER (WHERE event_type = 'view')::BIGINT AS views,
    coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_type = 'purchase'), 0)::BIGINT AS spent_cents FROM events GROUP BY user_id""")
def agg_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = F.col("event_type") == "purchase"
    return load(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(bought).alias("purchases"), F.count_if(F.col("event_type") == "view").alias("views"), F.coalesce(F.sum(F.when(bought, cents("value"))), F.lit(0)).alias("spent_cents")
    )


def _grouped_sql(sets: str) -> str:
    return f"SELECT l_returnflag, l_linestatus, (2 * grouping(l_returnflag) + grouping(l_linestatus))::BIGINT AS level, count(*)::BIGINT AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity FROM lineitem GROUP BY {sets}"



def _measures() -> list[Column]:
    return [F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity")]


@query("agg_rollup", _grouped_sql("ROLLUP (l_returnflag, l_linestatus)"))
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(*_measures())


@query("agg_cube", _grouped_sql("CUBE (l_returnflag, l_linestatus)"))
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(*_measures())


@query("agg_grouping_sets", _grouped_sql("GROUPING SETS ((l_returnflag), (l_linestatus), ())"))
def agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return load(spark, sf_dir, "lineitem").groupingSets([[flag], [status], []], flag, status).agg(*_measures())


@query("agg_stats", """SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS variance, round(corr(l_quantity, l_extendedprice), 6) AS correlation,
    round(covar_samp(l_quantity, l_tax), 6) AS covariance FROM lineitem GROUP BY l_returnflag""")
def agg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c, name: F.round(c, 6).alias(name)
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        r(F.stddev_samp("l_quantity"), "sd"), r(F.var_pop("l_quantity"), "variance"), r(F.corr("l_quantity", "l_extendedprice"), "correlation"), r(F.covar_samp("l_quantity", "l_tax"), "covariance")
    )


def exact_quantiles(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """One row for each key with the linearly interpolated quantiles of its non-null values, however many rows a key has.

    Equal values are counted first. The counts are dealt by ranges of key and value; the sums of each range (a row for each range and key) tell
    which ranges hold the wanted ranks, and only those are summed up row by row, so that no task holds more than one range.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    dealt = stored(counted.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()), "dealt")
    parts = dealt.groupBy("k", "part").agg(F.sum("n").alias("here"))
    by_key = Window.partitionBy("k")
    ranges = parts.select("k", "part", "here", F.sum("here").over(by_key).alias("all"), (F.sum("here").over(by_key.orderBy("part")) - F.col("here")).alias("before"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("all") - 1) * F.lit(share)).alias("at")) for name, share in shares.items()])
    asked = ranges.select("k", "part", "here", "before", F.explode(wanted).alias("w")).filter((F.floor("w.at") < F.col("before") + F.col("here")) & (F.floor("w.at") + 1 >= F.col("before")))
    near = asked.groupBy("k", "part").agg(F.first("before").alias("before"), F.collect_list("w").alias("w"))  # of each range, a quantile once
    near = near.select(F.col("k").alias("k1"), F.col("part").alias("p1"), "before", "w")
    met = dealt.join(near, F.col("k").eqNullSafe(F.col("k1")) & (F.col("part") == F.col("p1")))
    upto = F.sum("n").over(Window.partitionBy("part", "k").orderBy("v")) + F.col("before")
    # A value holds the ranks from last - n to last - 1; each wanted rank lies between the floor and the one above it.
    spots = met.withColumn("last", upto).select("k", "v", "n", "last", F.explode("w").alias("w"))
    low, share = F.floor("w.at"), F.col("w.at") - F.floor("w.at")
    holds = lambda rank: (rank >= F.col("last") - F.col("n")) & (rank < F.col("last"))
    weight = F.when(holds(low), 1 - share).otherwise(0.0) + F.when(holds(low + 1), share).otherwise(0.0)
    found = spots.withColumn("weight", weight).filter((F.col("weight") > 0) | holds(low)).groupBy("k").agg(*[F.sum(F.when(F.col("w.name") == name, F.col("v") * F.col("weight"))).alias(name) for name in shares])
    return found.withColumnRenamed("k", key)


@query("agg_percentile", "SELECT event_type, round(median(value), 6) AS middle, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def agg_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_quantiles(load(spark, sf_dir, "events", "event_type", "value"), "event_type", "value", {"middle": 0.5, "p90": 0.9})
    return found.select("event_type", F.round("middle", 6).alias("middle"), F.round("p90", 6).alias("p90"))


@query("agg_minmax_by", "SELECT event_type, min_by(user_id, event_id) AS first_user, max_by(user_id, event_id) AS last_user FROM events GROUP BY event_type")
def agg_minmax_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.min_by("user_id", "event_id").alias("first_user"), F.max_by("user_id", "event_id").alias("last_user"))


@query("agg_collect", "SELECT n_regionkey, array_to_string(list(n_name ORDER BY n_name), ',') AS nations FROM nation GROUP BY n_regionkey")
def agg_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("nations"))


@query("having", "SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 12")


@query("pivot", """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS F, count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS O,
    count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS P FROM orders GROUP BY o_orderpriority""")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values are given, so no pass is needed to find them."""
    return load(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query("unpivot", """SELECT p_partkey, 'p_brand' AS attribute, p_brand AS content FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part""")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").unpivot("p_partkey", ["p_brand", "p_type"], "attribute", "content")


@query("label_rates", """SELECT source, count(*)::BIGINT AS n, sum(quality)::BIGINT AS good, sum(toxic)::BIGINT AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents", "doc_id", "source"), load(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))


@query("conv_assemble", """SELECT conv_id, count(*)::BIGINT AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS script FROM conversations GROUP BY conv_id""")
def conv_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a conversation, its turns in order."""
    turns = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(turns, lambda x: x["line"]), "\n").alias("script"))
