"""What the n-gram join moves and how many jobs it makes."""

from __future__ import annotations

import random

import numpy as np

from harborlight.llm import common, ngram_join


def shuffled(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_texts_of_no_list_do_not_travel(spark):
    rng = random.Random(3)
    texts = [" ".join(f"{rng.getrandbits(256):064x}" for _ in range(90)) for _ in range(300)]
    texts.append(texts[0] + " more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    before, limit = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(common.stored(docs, "texts")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {k: 0 if k == 300 else k for k in range(301)}
    moved = (shuffled(spark) - before) / sum(map(len, texts))
    print("moved", moved)
    assert moved < 1.3


def test_only_wanted_texts(spark):
    ids = np.random.default_rng(5).integers(-(1 << 63), (1 << 63) - 1, 2000).tolist()
    texts = spark.createDataFrame([(k, str(k)) for k in ids], "at long, text string")
    for some in (ids[:50], ids[:1], []):
        wanted = spark.createDataFrame([(k,) for k in some], "at long")
        got = [r["at"] for r in ngram_join.only(texts.union(texts).coalesce(1), wanted).collect()]
        assert len(got) == len(set(got)) and set(some) <= set(got) and len(got) <= len(some) + 2


def test_components_of_few_links_in_few_jobs(spark):
    rng = random.Random(9)
    chain = [(k, k + 1) for k in range(-200, 200)]
    rng.shuffle(chain)
    rows = [*chain, *[(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(180)], (5000, 5000)]
    sc = spark.sparkContext
    for links in (rows, []):
        table = common.stored(spark.createDataFrame(links, "a long, b long"), "links")
        want = sorted(map(tuple, common.components(table).collect()))
        sc.setJobGroup("together", "")
        try:
            got = sorted(map(tuple, ngram_join.components_of(table, "links").collect()))
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        assert got == want
    assert len(sc.statusTracker().getJobIdsForGroup("together")) <= 12
