"""Structured Streaming over events. Each query runs its stream to the end of the input and returns what the sink holds.

Windows close by watermark in append mode, so state ends with its window; a row far after the last event closes the last ones.
Streams end in foreachBatch writers that put each batch in a folder of its own, so a batch that is run again replaces itself.
State is kept by RocksDB, off the heap. Event time needs a zoned type, so ts is cast (the session zone is UTC).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.registry import query
from quern.sources.tables import load, table_path
from quern.storage import fresh_path

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """events as a stream, with ts in UTC."""
    schema = load(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(path or table_path(sf_dir, "events") + "*").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there and returns the sink as a table: the last result in complete mode, all rows otherwise."""
    spark = stream.sparkSession
    at, state = fresh_path(spark, "sink"), fresh_path(spark, "progress")
    schema = stream.schema
    spark.createDataFrame([], schema).write.parquet(f"{at}/batch=-1")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/batch={0 if mode == 'complete' else number}")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(put).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(schema).option("basePath", at).parquet(f"{at}/batch=*").select(schema.names)


def _times(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.col(k).cast("timestamp_ntz") for k, t in df.dtypes if t == "timestamp"})


def closed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of events, and one more a hundred days after the last: it moves the watermark past every window of theirs, and its own stays open."""
    events = load(spark, sf_dir, "events")
    at = fresh_path(spark, "closing")
    last = events.agg(F.max("ts").alias("ts"))
    last.select(*[(F.col("ts") + F.expr("INTERVAL 100 DAYS") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]).write.parquet(at)
    return read_events(spark, sf_dir).unionByName(read_events(spark, sf_dir, at))


@query("stream_tumbling", "SELECT date_trunc('day', ts)::TIMESTAMP AS day_start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = closed_events(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return _times(drained(counted.select(F.col("window.start").alias("day_start"), "event_type", "n"), "append"))


@query("stream_sliding", """SELECT start_at, count(*)::BIGINT AS n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') - k * INTERVAL 6 HOUR AS start_at FROM events, (SELECT unnest(generate_series(0, 3)) AS k)) GROUP BY start_at""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = closed_events(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day", "6 hours")).agg(F.count("*").alias("n"))
    return _times(drained(counted.select(F.col("window.start").alias("start_at"), "n"), "append"))


@query("stream_session", """SELECT user_id, min(ts) AS start_at, count(*)::BIGINT AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = closed_events(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    return _times(drained(counted.select("user_id", F.col("session_window.start").alias("start_at"), "n"), "append"))


@query("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is read twice; one of each is left."""
    once = read_events(spark, sf_dir)
    return drained(once.union(once).withWatermark("ts", "2 days").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type"), "append")


@query("stream_static_join", "SELECT event_id, user_id, c_name, c_mktsegment FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    met = read_events(spark, sf_dir).filter("event_type = 'purchase'").join(customer, F.col("user_id") == F.col("c_custkey"))
    return drained(met.select("event_id", "user_id", "c_name", "c_mktsegment"), "append")


@query("stream_stream_join", """SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND p.ts > v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR
    WHERE v.event_type = 'view' AND p.event_type = 'purchase'""")
def stream_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A purchase within an hour of a view; watermarks on both sides bound the state."""
    views = read_events(spark, sf_dir).filter("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("u"), F.col("ts").alias("seen")).withWatermark("seen", "2 hours")
    buys = read_events(spark, sf_dir).filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", "ts").withWatermark("ts", "2 hours")
    met = views.join(buys, F.expr("u = user_id AND ts > seen AND ts <= seen + INTERVAL 1 HOUR"))
    return drained(met.select("view_id", "purchase_id"), "append")


@query("stream_late", "SELECT date_trunc('day', ts)::TIMESTAMP AS day_start, count(*)::BIGINT AS n FROM events GROUP BY 1")
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four files: the events but the last; the last; a tenth of them again, five days before it; one far later.

    A batch drops what is late by the watermark with which the batch before it ran, so the repeated events, in the third
    batch, are dropped by what the first has seen. The last event closes the windows.
    """
    events = load(spark, sf_dir, "events")
    at = fresh_path(spark, "feed")
    last = events.agg(F.max("ts").alias("ts")).first().ts
    late = events.filter("event_id % 10 = 0").withColumn("ts", F.lit(last).cast("timestamp_ntz") - F.expr("INTERVAL 5 DAYS"))
    end = events.limit(1).withColumn("ts", F.lit(last).cast("timestamp_ntz") + F.expr("INTERVAL 30 DAYS"))
    when = F.lit(last).cast("timestamp_ntz")
    for k, part in enumerate((events.filter(F.col("ts") < when), events.filter(F.col("ts") == when), late, end)):
        part.coalesce(1).write.parquet(f"{at}/part={k}")
    feed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/part=*").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = feed.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return _times(drained(counted.select(F.col("window.start").alias("day_start"), "n"), "append"))


def _running(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, cents = state.get if state.exists else (0, 0)
    for x in frames:
        n, cents = n + len(x), cents + int(x.cents.sum())
    state.update((n, cents))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "cents": [cents]})


@query("stream_state", "SELECT user_id, count(*)::BIGINT AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY user_id")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arbitrary state: each user's count and sum; the state is two numbers a user, and the last row a user counts."""
    source = read_events(spark, sf_dir).select("user_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    running = source.groupBy("user_id").applyInPandasWithState(_running, "user_id bigint, n bigint, cents bigint", "n bigint, cents bigint", "update", GroupStateTimeout.NoTimeout)
    return drained(running, "update").groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("cents", "n").alias("cents"))
