"""Exact neighbours against numpy, with ties, repeated rows and odd vectors."""

import numpy as np
import pytest

from quern.operators import vectors
from quern.operators.vectors import k_best

from .test_plans import plan


def plain(queries, items, k, skip):
    out = []
    for q, a in queries:
        near = sorted((-round(float(np.dot(np.array(a), np.array(b))), 9), i) for i, b in items if not (skip and i == q))[:k]
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 7])
def test_k_best_equals_brute_force(spark, k, monkeypatch):
    for name, value in (("QUERIES", 40), ("ITEMS", 150), ("FEWEST", 20)):
        monkeypatch.setattr(vectors, name, value)
    r = np.random.default_rng(k)
    rows = [(i, [float(x) for x in np.round(r.normal(size=4), 1)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(120)]  # a large group of copies: ties that the id decides
    rows += [(5, rows[5][1])]
    table = spark.createDataFrame([*rows, (2000, None), (2001, [1.0, None, 0.0, 0.0])], "id bigint, vec array<double>")
    queries = [x for x in rows if x[0] % 3 == 0]
    got = k_best(spark.createDataFrame(queries, "id bigint, vec array<double>"), table, k, skip_own=True).collect()
    assert sorted((x.query, x.item, round(x["product"], 9), x["rank"]) for x in got) == plain(queries, rows, k, True)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "id bigint, vec array<double>")
    one = spark.createDataFrame([(1, [1.0])], "id bigint, vec array<double>")
    assert k_best(none, one, 3).collect() == [] and k_best(one, none, 3).collect() == []
    assert k_best(one, one, 3, skip_own=True).collect() == []


def test_no_nested_loop_and_a_limit_before_the_shuffle(spark, sf_dir):
    text = plan(vectors.vec_topk(spark, sf_dir))
    assert "NestedLoop" not in text and "Cartesian" not in text and "WindowGroupLimit" in text
