"""Reports, materialised tables, polling, catalog."""

from __future__ import annotations

import os
from datetime import datetime, timedelta
from graphlib import CycleError

import pytest
from pyspark.sql import functions as F

from harborlight import catalog
from harborlight.functions import report
from harborlight.operators.materialize import Materialized
from harborlight.streaming import polling

ROWS = [("a|b", 1.5, None), ("c\nd", 1234567.0, "x" * 50)]


def test_tables_as_text():
    md = report.markdown(["n", "v", "t"], ROWS, total=9)
    assert md.split("\n")[0] == "| n | v | t |" and "a\\|b" in md and "1,234,567" in md and md.endswith("(2 of 9 rows)")
    assert all(len(x) <= 42 for x in report.markdown(["t"], [("y" * 99,)]).split("|"))
    assert report.compact(["n", "t"], [("a,b", None)]) == "rows[1]{n,t}:\n  a b,"
    assert report.cards(["n", "t"], [("a", None)]) == "**n**: a"
    assert report.markdown([], []) == report.compact(["a"], []) == report.cards(["a"], []) == "(no rows)"
    assert report.best(list("abcde"), [tuple("vwxyz")]).startswith("**a**") and report.best(["a"], [(1,)] * 30).startswith("rows[30]")


def test_budget_keeps_first_rows():
    rows = [("x" * 10,)] * 20
    kept, left = report.within_budget(rows, 20)
    assert len(kept) + left == 20 and 0 < len(kept) < 20 and report.within_budget(rows, 10_000) == (rows, 0) and report.within_budget(rows, 0)[0] == []


def test_csv():
    assert report.csv_text(["a", "b"], [(1, None), ("x,y", 2)], {"Query": "a\nb"}) == '# Query: a b\nrow_id,a,b\n1,1,\n2,"x,y",2\n'


def test_refresh_in_order(spark, tmp_path):
    m = Materialized(spark, f"file://{tmp_path}")
    m.add("top", ("mid",), lambda s, t: t["mid"].agg(F.sum("n").alias("n")))
    m.add("mid", ("base",), lambda s, t: t["base"].groupBy("k").agg(F.count("*").alias("n")))
    m.add("other", ("side",), lambda s, t: t["side"])
    base = spark.range(10).select((F.col("id") % 3).alias("k"))
    sources = {"base": base, "side": spark.range(2)}
    assert set(m.refresh(sources)) == {"mid", "top", "other"} and m.order().index("mid") < m.order().index("top")
    assert m.table("top").read().first().n == 10
    sources["base"] = base.union(base)
    assert m.behind({"base"}) == ["mid", "top"] and m.refresh(sources, {"base"}) == ["mid", "top"]
    assert {r.name: r.row_count for r in m.counts().collect()} == {"mid": 3, "top": 1, "other": 2} and m.table("top").read().first().n == 20
    m.add("mid", ("top",), lambda s, t: t["top"])
    with pytest.raises(CycleError):
        m.order()


def test_polling():
    names = [str(i) for i in range(7)]
    a, at = polling.next_chunk(names, 0, 3)
    b, at = polling.next_chunk(names, at, 3)
    c, at = polling.next_chunk(names, at, 3)
    assert a + b + c == names and at == 0 and polling.next_chunk([], 5) == ([], 0)
    now = datetime(2024, 1, 2)
    last = {"a": now - timedelta(hours=1), "b": now - timedelta(hours=7)}
    assert polling.due([("a", "stale"), ("b", "stale"), ("c", "synced"), ("d", "stale")], last, now) == ["d", "b"]
    assert len(polling.due([(str(i), "stale") for i in range(30)], {}, now)) == 10


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_catalog(spark, tmp_path):
    base = "/root/testdata/sf0.001"
    d = catalog.describe(spark, base, ("nation", "region"))
    assert {r.table_name for r in d.collect()} == {"nation", "region"}
    assert catalog.find(spark, base, "custmer")[0][0] == "customer"
    df = catalog.commented(spark.range(1), {"id": "key"})
    df.write.parquet(f"{tmp_path}/x")
    assert spark.read.parquet(f"{tmp_path}/x").schema["id"].metadata["comment"] == "key"
