"""Recursion over tables: what a set of nodes reaches along edges, to the fixpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.registry import query
from quern.sources.tables import load
from quern.storage import drop_stored, stored

#: Rounds after which what has been reached is written as one table, so that plans don't grow with the recursion.
COMPACT = 8


def closure(start: DataFrame, follow: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node and steps: every node that start (node) leads to, and the fewest steps to it; follow gives the nodes (node, repeated or not) that are one step from those of a frontier (node).

    Semi-naive: a round follows the frontier alone, the nodes that the last round added, and what is already visited is taken out, so cycles end. Each round is a table, and the recursion stops when one adds no
    row. Null nodes are on no path.
    """
    visited = [stored(start.select("node").filter("node IS NOT NULL").distinct().withColumn("steps", F.lit(0).cast("bigint")), "reached")]

    def all_of(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    steps = 0
    while True:
        steps += 1
        next_ = follow(visited[-1].filter(F.col("steps") == steps - 1).select("node")).distinct()
        fresh = stored(next_.join(all_of(visited).select("node"), "node", "left_anti").withColumn("steps", F.lit(steps).cast("bigint")), "reached")
        if fresh.isEmpty():
            break
        visited.append(fresh)
        if len(visited) > COMPACT:
            whole = stored(all_of(visited), "reached")
            drop_stored(*visited)
            visited = [whole]
    return all_of(visited)


def reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node and steps: every node on a path of edges (a, b) from the nodes of start (node), and the fewest edges to it."""
    edges = stored(edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "edges")
    return closure(start, lambda frontier: frontier.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")))


def spread(events: DataFrame, start: DataFrame) -> DataFrame:
    """node and steps as of ``reached``, where an edge goes from user a to user b if an event (user_id, ts) of b comes within ten minutes after one of a. No edge becomes a row: their number grows with the square of the events in ten minutes.

    Bins are ten minutes long, so an event follows one of the frontier if it comes after the earliest in its own bin, or within ten minutes after the latest in the bin before. Hence a round needs two times of each bin, and of
    each user and bin the first and last event.
    """
    day, hour, minute = F.unix_date(F.col("ts").cast("date")), F.hour("ts"), F.minute("ts")  # not of the epoch: no zone's clock change lies within a bin
    bin_ = (day.cast("bigint") * 144 + hour * 6 + F.floor(minute / 10)).alias("bin")
    spans = stored(events.filter("user_id IS NOT NULL AND ts IS NOT NULL").groupBy("user_id", bin_).agg(F.min("ts").alias("low"), F.max("ts").alias("high")), "spans")

    def follow(frontier: DataFrame) -> DataFrame:
        at = frontier.join(spans, F.col("node") == F.col("user_id")).groupBy("bin").agg(F.min("low").alias("first"), F.max("high").alias("last"))
        own = F.struct("bin", F.col("first").alias("after"), F.lit(None).alias("until"))
        later = F.struct((F.col("bin") + 1).alias("bin"), F.lit(None).alias("after"), (F.col("last") + F.expr("INTERVAL 10 MINUTES")).alias("until"))
        reach = at.select(F.inline(F.array(own, later))).groupBy("bin").agg(F.min("after").alias("after"), F.max("until").alias("until"))
        return spans.join(reach, "bin").filter("high > after OR low <= until").select(F.col("user_id").alias("node"))

    return closure(start, follow)


@query("cte_reach", """WITH RECURSIVE errors AS (SELECT user_id, ts FROM events WHERE event_type = 'error'),
    edges AS (SELECT DISTINCT x.user_id AS a, y.user_id AS b FROM errors x JOIN errors y ON y.ts > x.ts AND y.ts <= x.ts + INTERVAL 10 MINUTE WHERE x.user_id <> y.user_id),
    walk(node, steps) AS (SELECT user_id, 0::BIGINT FROM (SELECT user_id FROM errors ORDER BY ts LIMIT 1) UNION SELECT b, steps + 1 FROM walk JOIN edges ON a = node WHERE steps < 60)
    SELECT node, min(steps)::BIGINT AS steps FROM walk GROUP BY node""")
def cte_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users that an error may have spread to from the user of the first error, along errors that follow each other, and in how many steps."""
    errors = load(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type").filter("event_type = 'error' AND ts IS NOT NULL")
    return spread(errors, errors.agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("node")))
