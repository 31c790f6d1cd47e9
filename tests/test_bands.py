"""Neighbours of neighbours in bands against the graph of their edges."""

import random

from harborlight.operators.graph import Graph, band_neighbourhood
from test_meetings import written


def test_against_the_graph(spark):
    rng = random.Random(8)
    value = lambda: rng.choice([round(rng.uniform(-300, 300), 2), 0.1 * rng.randrange(-20, 20) * 6, None, 1e9, float("nan")])
    rows = spark.createDataFrame([(i, rng.choice([1, 2, None]), rng.choice(["a", "b"]), value()) for i in range(150)], "id long, k int, s string, x double").localCheckpoint()
    edges = rows.alias("a").join(rows.alias("b"), "k").where("a.s = b.s and a.id < b.id and b.x between a.x - 6 and a.x + 6").selectExpr("a.id as src", "b.id as dst")
    want = Graph(rows.select("id"), edges).neighbourhood(rows.select("id"), 2)
    got = band_neighbourhood(rows, "id", ["k", "s"], "x", 6.0)
    assert dict(got.dtypes) == dict(want.dtypes)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_pairs_of_edges_do_not_travel(spark):
    """400 rows of one balance: 160,000 edges, 64 million pairs of them."""
    rows = spark.range(400).selectExpr("id", "1 as k", "cast(5 as double) as x")
    before = written(spark)
    assert band_neighbourhood(rows, "id", ["k"], "x", 60.0).where("hops = 1").count() == 400 * 399
    assert written(spark) - before < 1_000_000
