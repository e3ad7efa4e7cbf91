"""Scans with carries against plain Python: one key with nearly all rows, ties, nulls, and ranges that cut keys anywhere."""

import random
import re

import pytest

from quern import registry
from quern.operators import ordered
from quern.operators.ordered import as_of, running_sum, sessions, sliced, sums_above

from .test_plans import plan


@pytest.fixture(params=[1, 7, 40])
def ranges(spark, request):
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    for k, v in was.items():
        spark.conf.set(k, v)


def rows(seed: int) -> list[tuple]:
    r = random.Random(seed)
    return [(r.choice([1, 1, 1, 1, 1, 1, 2, None]), r.randrange(400), i, r.choice([None, *range(-3, 9)])) for i in range(300)]


def by_key(table):
    out = {}
    for x in sorted(table, key=lambda x: (x[1], x[2])):
        out.setdefault(x[0], []).append(x)
    return out


def test_running_sums(spark, ranges):
    table = rows(1)
    want = {}
    for own in by_key(table).values():
        total = None
        for _, _, i, v in own:
            total = total if v is None else (total or 0) + v
            want[i] = total
    df = spark.createDataFrame(table, "k int, t int, i int, v bigint")
    assert {r.i: r.out for r in running_sum(df, "k", ["t", "i"], "v", "out").collect()} == want


def test_sessions(spark, ranges):
    table = rows(2)
    want = {}
    for own in by_key(table).values():
        n, last = 0, None
        for _, t, i, _ in own:
            n += last is None or t > last + 3
            want[i], last = n, t
    df = spark.createDataFrame(table, "k int, t int, i int, v bigint").selectExpr("k", "i", "timestamp_seconds(t) AS t")
    assert {r.i: r.out for r in sessions(df, "k", "t", "i", "3 SECONDS", "out").collect()} == want


def test_as_of(spark, ranges):
    left, right = rows(3), rows(4)
    want = {}
    for k, t, i, _ in left:
        seen = [(u, v) for q, u, _, v in right if q == k and u <= t and v is not None]
        want[i] = max(seen)[1] if seen else None
    a = spark.createDataFrame([x[:3] for x in left], "k int, t int, i int")
    b = spark.createDataFrame([(k, t, v) for k, t, _, v in right], "k int, t int, v bigint")
    assert {r.i: r.out for r in as_of(a, b, "k", "t", "v", "out").collect()} == want


def test_one_key_spreads_over_tasks(spark):
    df = spark.range(4000).selectExpr("1 AS k", "id AS t", "1L AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in sliced(df, "k", "t").groupBy("_slice").count().collect()]
        assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2000
        assert running_sum(df, "k", ["t"], "v", "n").filter("n <> t + 1").isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_sums_above(spark, ranges):
    r = random.Random(5)
    left = [(i, r.choice([None, *map(float, range(-5, 25))])) for i in range(80)]
    right = [(r.choice([None, 3.0, 3.0, 3.0, *map(float, range(20))]), r.choice([None, 1, 10])) for _ in range(300)]
    want = {i: (sum(o is not None and v is not None and o > v for o, _ in right), sum(a or 0 for o, a in right if o is not None and v is not None and o > v)) for i, v in left}
    a, b = spark.createDataFrame(left, "i int, v double"), spark.createDataFrame(right, "o double, a bigint")
    assert {x.i: (x.matches, x.total) for x in sums_above(a, "v", b, "o", {"a": "total"}).collect()} == want


def test_sums_above_within_a_key(spark, ranges):
    """Few keys, one with nearly all rows; null keys meet nothing, and a key of one side alone has no matches."""
    r = random.Random(6)
    draw = lambda: (r.choice([1, 1, 1, 1, 2, None]), r.choice([None, float("nan"), *map(float, range(25))]))
    left = [(i, *draw()) for i in range(80)] + [(80, 3, 1.0)]
    right = [(*draw(), r.choice([None, 1, 10])) for _ in range(300)] + [(4, 9.0, 1)]
    above = lambda o, v: (o > v or o != o) and v == v  # noqa: E731  NaN is above all numbers
    met = {i: [a for q, o, a in right if None not in (k, v, o) and q == k and above(o, v)] for i, k, v in left}
    a, b = spark.createDataFrame(left, "i int, k int, v double"), spark.createDataFrame(right, "q int, o double, a bigint")
    got = sums_above(a, "v", b, "o", {"a": "total"}, by=("k", "q"))
    assert {x.i: (x.matches, x.total) for x in got.collect()} == {i: (len(m), sum(x or 0 for x in m)) for i, m in met.items()} and got.columns == ["i", "k", "v", "matches", "total"]


def test_theta_makes_no_pairs(spark, sf_dir):
    """Suppliers and customers meet only as sums, so the plan has no join with an inequality."""
    text = plan(registry.QUERIES["join_theta"](spark, sf_dir))
    assert "acctbal" in text and not re.search(r"Join.*acctbal#\d+ [<>]", text)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k int, t timestamp, i int, v bigint")
    assert running_sum(none, "k", ["t", "i"], "v", "out").collect() == []
    assert sessions(none, "k", "t", "i", "1 DAY", "out").collect() == []
    assert as_of(none.drop("v"), none, "k", "t", "v", "out").collect() == []
    assert sums_above(none, "v", none, "v", {}).collect() == []


def test_no_nested_loop(spark, sf_dir):
    for name in ("join_theta_ranges", "join_asof", "win_running", "gaps_islands"):
        text = plan(registry.QUERIES[name](spark, sf_dir))
        assert "NestedLoop" not in text and "Cartesian" not in text
    assert ordered.join_asof is registry.QUERIES["join_asof"]
