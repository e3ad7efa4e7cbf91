"""Scans in an order of which one key may hold most rows: running sums, as-of joins, sessions, and inequality joins.

A window over a key puts all of its rows into one task. Here rows are dealt by ranges of key and order instead, so that a large key's rows lie in
many ranges, each a slice of it. What a scan has to know from the slices before is small: a sum, the last value, the last time. It is
made once a slice, carried along the slices of the key (a table of one row for each key and range), and joined back; the rest of the scan is a
window over a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quern.registry import query
from quern.sources.tables import load
from quern.storage import stored

_SLICE, _CARRY = "_slice", "_carry"


def sliced(df: DataFrame, *order: str | Column) -> DataFrame:
    """df dealt by ranges of ``order`` and written; column _slice has the number of each row's range, ascending."""
    return stored(df.repartitionByRange(*order).withColumn(_SLICE, F.spark_partition_id()), "sliced")


def _before(key: str) -> WindowSpec:
    """The earlier slices of a key."""
    return Window.partitionBy(key).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)


def _within(key: str, order: list) -> WindowSpec:
    return Window.partitionBy(key, _SLICE).orderBy(*order)


def _carried(rows: DataFrame, carries: DataFrame, key: str) -> DataFrame:
    """rows with what is carried into their slice; null keys are a key."""
    other = carries.withColumnsRenamed({key: "_key", _SLICE: "_of"})
    return rows.join(other, F.col(key).eqNullSafe(F.col("_key")) & (F.col(_SLICE) == F.col("_of"))).drop("_key", "_of")


def running_sum(df: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """df with out: the sum of value over its key's rows up to this one, by ``order`` (which has no ties). Null values add nothing; before any value the sum is null."""
    at = sliced(df, key, *order)
    sums = at.groupBy(key, _SLICE).agg(F.sum(value).alias("s"))
    carries = sums.select(key, _SLICE, F.sum("s").over(_before(key)).alias(_CARRY))
    own = F.sum(value).over(_within(key, order).rowsBetween(Window.unboundedPreceding, 0))
    return _carried(at, carries, key).withColumn(out, F.coalesce(own + F.col(_CARRY), own, F.col(_CARRY))).drop(_SLICE, _CARRY)


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, out: str) -> DataFrame:
    """Each left row with the value of the last right row of its key at or before its time (of equal times the greatest value); null without one. Right rows of null value don't count."""
    rows = left.withColumns({"_right": F.lit(0), out: F.lit(None).cast(right.schema[value].dataType)}).unionByName(
        right.select(key, time, F.col(value).alias(out), F.lit(1).alias("_right")), allowMissingColumns=True
    )
    order = [F.col(time), F.desc("_right"), F.col(out)]
    at = sliced(rows, F.col(key), *order)
    latest = at.groupBy(key, _SLICE).agg(F.max_by(out, F.when(F.col(out).isNotNull(), F.struct(time, out))).alias("v"))
    carries = latest.select(key, _SLICE, F.last("v", ignorenulls=True).over(_before(key)).alias(_CARRY))
    seen = F.last(out, ignorenulls=True).over(_within(key, order).rowsBetween(Window.unboundedPreceding, 0))
    return _carried(at, carries, key).withColumn(out, F.coalesce(seen, F.col(_CARRY))).filter("_right = 0").drop("_right", _SLICE, _CARRY)


def sessions(df: DataFrame, key: str, time: str, tie: str, gap: str, out: str) -> DataFrame:
    """df with out: the number, from 1, of the run of its key's rows that this one is in; a run ends before a row that comes more than ``gap`` after the row before it."""
    at = sliced(df, key, time, tie)
    ends = at.groupBy(key, _SLICE).agg(F.max(time).alias("t"))
    carries = ends.select(key, _SLICE, F.last("t").over(_before(key)).alias(_CARRY))
    w = _within(key, [time, tie])
    met = _carried(at, carries, key)
    fresh = F.when(F.col(time) <= F.coalesce(F.lag(time).over(w), F.col(_CARRY)) + F.expr(f"INTERVAL {gap}"), 0).otherwise(1)
    numbered = met.withColumn("_fresh", fresh).withColumn(out, F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = stored(numbered.drop("_fresh", _CARRY), "numbered")
    upto = numbered.groupBy(key, _SLICE).agg(F.max(out).alias("n"))
    carries = upto.select(key, _SLICE, F.coalesce(F.sum("n").over(_before(key)), F.lit(0)).alias(_CARRY))
    return _carried(numbered, carries, key).withColumn(out, F.col(out) + F.col(_CARRY)).drop(_SLICE, _CARRY)


def sums_above(left: DataFrame, value: str, right: DataFrame, other: str, sums: dict[str, str], by: tuple[str, str] | None = None) -> DataFrame:
    """The inequality join right.other > left.value, aggregated: left with the number of right rows above each row's value (``matches``), and the sum of each column of ``sums`` over them.

    With ``by``, a left and a right column, only right rows whose column equals the left row's count; a null equals nothing. Both sides become one row for each distinct key and value, dealt by ranges, so a key may lie in many.
    Ranges of the key that lie above a row's own count by their totals, and only the own range is scanned, so the work is that of sorting both sides once, not that of comparing all pairs. A null value is below and above nothing.
    """
    names = ["matches", *sums.values()]
    of_left, of_right = (F.col(x) for x in by) if by else (F.lit(0), F.lit(0))
    totals = right.select(of_right.alias("_k"), F.col(other).alias("_v"), *sums).filter("_k IS NOT NULL AND _v IS NOT NULL").groupBy("_k", "_v").agg(F.count("*").alias("matches"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in sums.items()])
    asked = left.select(of_left.alias("_k"), F.col(value).alias("_v")).filter("_k IS NOT NULL AND _v IS NOT NULL").distinct().withColumn("_asks", F.lit(1)).withColumns({n: F.lit(0).cast(totals.schema[n].dataType) for n in names})
    at = sliced(totals.withColumn("_asks", F.lit(0)).unionByName(asked), "_k", "_v")
    parts = at.groupBy("_k", _SLICE).agg(*[F.sum(n).alias(n) for n in names])
    higher = Window.partitionBy("_k").orderBy(F.desc(_SLICE)).rowsBetween(Window.unboundedPreceding, -1)  # one row a key and range
    beyond = parts.select(F.col("_k").alias("_key"), F.col(_SLICE).alias("_of"), *[F.coalesce(F.sum(n).over(higher), F.lit(0)).alias(f"_{n}") for n in names])
    upto = Window.partitionBy("_k", _SLICE).orderBy(F.desc("_v"), F.desc("_asks")).rowsBetween(Window.unboundedPreceding, 0)  # a row that asks comes before its equals
    local = at.select("_k", "_v", "_asks", _SLICE, *[F.sum(n).over(upto).alias(n) for n in names]).filter("_asks = 1")
    found = local.join(beyond, (F.col("_k") == F.col("_key")) & (F.col(_SLICE) == F.col("_of"))).select("_k", "_v", *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in names])
    return left.join(found, (of_left == F.col("_k")) & (F.col(value) == F.col("_v")), "left").drop("_k", "_v").na.fill(0, names)


_CENTS = "CAST(round(value * 100) AS BIGINT)"


@query("win_running", f"SELECT event_id, (sum({_CENTS}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM events")
def win_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return running_sum(events, "user_id", ["ts", "event_id"], "cents", "total").select("event_id", "total")


@query("join_asof", """SELECT e.event_id, e.user_id, (SELECT max(v.event_id) FROM events v WHERE v.event_type = 'view' AND v.user_id = e.user_id AND v.ts = m.t) AS view_id
    FROM events e LEFT JOIN LATERAL (SELECT max(ts) AS t FROM events v WHERE v.event_type = 'view' AND v.user_id = e.user_id AND v.ts <= e.ts) m ON true WHERE e.event_type = 'purchase'""")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    purchases = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("id"))
    return as_of(purchases, views, "user_id", "ts", "id", "view_id").select("event_id", "user_id", "view_id")


@query("gaps_islands", """SELECT user_id, session, count(*)::BIGINT AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (
        SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session""")
def gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = sessions(load(spark, sf_dir, "events", "user_id", "ts", "event_id"), "user_id", "ts", "event_id", "6 HOURS", "session")
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("join_theta_ranges", """SELECT s_suppkey, count(c_custkey)::BIGINT AS matches, coalesce(sum(CAST(round(c_acctbal * 100) AS BIGINT)), 0)::BIGINT AS cents
    FROM supplier LEFT JOIN customer ON c_acctbal > s_acctbal GROUP BY s_suppkey""")
def join_theta_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier with the number of all customers of a higher balance, and what those have together."""
    customer = load(spark, sf_dir, "customer").select("c_acctbal", F.round(F.col("c_acctbal") * 100).cast("bigint").alias("own"))
    return sums_above(load(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal"), "s_acctbal", customer, "c_acctbal", {"own": "cents"}).select("s_suppkey", "matches", "cents")
