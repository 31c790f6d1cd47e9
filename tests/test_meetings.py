"""Pairs and triangles counted in blocks: results against brute force, and what travels."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from harborlight.operators import meetings
from harborlight.operators.graph import Graph, shared_pairs


def written(spark) -> int:
    """Bytes of shuffle files written so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.mark.parametrize("entries", [1, 1 << 20])
def test_against_brute_force(spark, monkeypatch, entries):
    monkeypatch.setattr(meetings, "ENTRIES", entries)
    rng = random.Random(5)
    edges = {tuple(sorted(rng.sample(range(-9, 30), 2))) for _ in range(160)} | {(0, i) for i in range(1, 29)}
    g = Graph(spark.range(30), spark.createDataFrame(sorted(edges), "src long, dst long"))
    want = dict.fromkeys({x for e in edges for x in e}, 0)
    for t in combinations(sorted(want), 3):
        if all(p in edges for p in combinations(t, 2)):
            for x in t:
                want[x] += 1
    assert {r.id: r.triangles for r in g.triangles().collect()} == want
    links = [(rng.randrange(20), rng.randrange(12)) for _ in range(150)]
    owned = {o: {i for p, i in links if p == o} for o, _ in links}
    pairs = {(a, b): n for a, b in combinations(sorted(owned), 2) if (n := len(owned[a] & owned[b])) >= 2}
    got = shared_pairs(spark.createDataFrame(links, "o int, i int"), "o", "i", 2)
    assert dict(got.dtypes) == {"a": "int", "b": "int", "shared": "bigint"}
    assert {(r.a, r.b): r.shared for r in got.collect()} == pairs


def test_names_as_vertices_and_empty_tables(spark):
    g = Graph(spark.range(1), spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x"), ("z", "w"), (None, "x")], "src string, dst string"))
    assert {r.id: r.triangles for r in g.triangles().collect()} == {"x": 1, "y": 1, "z": 1, "w": 0}
    none = spark.createDataFrame([], "src long, dst long")
    assert Graph(spark.range(1), none).triangles().collect() == [] and shared_pairs(none, "src", "dst").collect() == []


def test_only_lists_travel(spark):
    """A clique of 300 has 4.5 million pairs of edges that meet."""
    v = spark.range(300)
    g = Graph(v, v.select(F.col("id").alias("src")).join(v.select(F.col("id").alias("dst")), F.expr("src < dst")))
    before = written(spark)
    assert {(r.triangles, r.clustering) for r in g.triangles().collect()} == {(299 * 298 // 2, 1.0)}
    assert written(spark) - before < 12_000_000
