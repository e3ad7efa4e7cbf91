"""Reachability against a plain breadth-first search: cycles, several starts, nodes without edges, and long paths."""

import random

from quern.plans import recursion
from quern.plans.recursion import reached, spread


def plain(edges, start):
    steps = {x: 0 for x in start if x is not None}
    frontier = list(steps)
    while frontier:
        fresh = []
        for a, b in edges:
            if a in frontier and b is not None and b not in steps and b not in fresh:
                fresh.append(b)
        steps |= {b: steps[frontier[0]] + 1 for b in fresh}
        frontier = fresh
    return steps


def test_reached(spark):
    r = random.Random(3)
    edges = [(r.randrange(30), r.randrange(30)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(11)] + [(111, 100), (None, 1), (1, None)]
    for start in ([0, 100], [77, None], []):
        got = reached(spark.createDataFrame(edges, "a int, b int"), spark.createDataFrame([(x,) for x in start], "node int")).collect()
        assert {x.node: x.steps for x in got} == plain(edges, start) and len(got) == len({x.node for x in got})


def test_spread_without_edges(spark, monkeypatch):
    """Crowded and sparse bins, ties, exactly ten minutes, midnight and nulls, against all pairs; what is written has a row for each user and bin, never one for an edge."""
    sizes, stored = [], recursion.stored

    def put(df, name):
        out = stored(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(recursion, "stored", put)
    r = random.Random(4)
    crowd = [(i, 60_000 + r.randrange(300)) for i in range(300)]
    for seed in range(3):
        r = random.Random(seed)
        sparse = [(r.randrange(40), r.choice([86_400, 0]) + 300 * r.randrange(-200, 200)) for _ in range(90)]
        rows = crowd * (seed == 0) + sparse + [(None, 5), (3, None)]
        edges = {(a, b) for a, t in rows for b, u in rows if None not in (a, b, t, u) and a != b and t < u <= t + 600}
        for start in ([sparse[0][0]], [None, 999], [7, 8]):
            sizes.clear()
            events = spark.createDataFrame(rows, "user_id int, s int").selectExpr("user_id", "TIMESTAMP_NTZ '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, s) AS ts")
            got = spread(events, spark.createDataFrame([(x,) for x in start], "node int")).collect()
            assert {x.node: x.steps for x in got} == plain(edges, start) and len(got) == len({x.node for x in got})
            assert max(n for _, n in sizes) <= len(rows)
