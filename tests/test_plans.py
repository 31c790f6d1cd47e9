"""Every plan with a SQL equivalent gives the rows that DuckDB gives; the others hold their invariants."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

from harborlight.catalog import TABLES
from harborlight.plans.registry import ORACLES, PLANS

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.7g}"
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, datetime.datetime)):
        return f"{v:.7g}" if isinstance(v, int) else str(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, duck, name):
    df = PLANS[name](spark, BASE)
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted((tuple(cell(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(cell(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    assert got == want


def test_sketches_are_near_the_exact_values(spark):
    exact, near = PLANS["quantiles_exact"](spark, BASE).first(), PLANS["quantiles_sketch"](spark, BASE).first()
    for q in ("p25", "median", "p75", "p95"):
        assert abs(exact[q] - near[q]) <= 0.05 * exact[q]
    users = spark.read.parquet(f"{BASE}/events.parquet").select("user_id").distinct().count()
    assert abs(PLANS["distinct_sketch"](spark, BASE).first()[0] - users) <= 0.05 * users


def test_linkage_finds_pairs_and_entities(spark):
    pairs = PLANS["linkage_pairs"](spark, BASE).collect()
    assert all(p.l < p.r and 0.9 <= p.match_probability <= 1 for p in pairs)
    master = PLANS["entity_master"](spark, BASE)
    rows = master.collect()
    assert sum(r.record_count for r in rows) == 150
    assert len({r.entity_id for r in rows}) == len(rows)
    assert all(r.confidence == 1.0 for r in rows if r.match_pair_count == 0)


def test_linkage_is_over_every_customer(spark, tmp_path):
    """Against all pairs of a small table, tested one by one for what blocks ask."""
    from harborlight.operators import linkage
    from harborlight.plans.entities import people

    spark.range(1, 151).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    rows = linkage.with_sounds(people(spark, str(tmp_path)))
    had = sorted(rows.collect(), key=lambda r: r.unique_id)
    assert [r.unique_id for r in had] == list(range(1, 151))
    meet = [(a.unique_id, b.unique_id) for i, a in enumerate(had) for b in had[i + 1 :] if any(all(a[c] is not None and a[c] == b[c] for c in rule) for rule in linkage.NAMES.blocks)]
    want = linkage.scored(rows, spark.createDataFrame(meet, "l long, r long"), linkage.NAMES).where("match_probability >= 0.9").select("l", "r").collect()
    got = PLANS["linkage_pairs"](spark, str(tmp_path)).select("l", "r").collect()
    assert want and sorted(got) == sorted(want)
    assert sorted(i for r in PLANS["entity_master"](spark, str(tmp_path)).collect() for i in r.member_ids) == list(range(1, 151))


def test_every_plan_has_a_stable_schema(spark):
    for name in sorted(set(PLANS) - set(ORACLES)):
        assert PLANS[name](spark, BASE).columns, name
