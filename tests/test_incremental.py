"""Tables that change in parts, incremental datasets, look-ahead, repair, workbooks, building blocks of views."""

from __future__ import annotations

import io
import re
import threading
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from harborlight.functions import report
from harborlight.operators import guard, views
from harborlight.sources import files, incremental, paged, sinks


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


class TestTable:
    def test_a_merge_writes_touched_buckets_only(self, spark, tmp_path):
        t = sinks.Table(spark, f"file://{tmp_path}/t", buckets=8)
        t.merge(spark.range(1000).selectExpr("id as _id", "id * 2 as v"))
        before = dict(t._manifest()["parts"])
        assert set(before) == set(range(8))
        t.merge(spark.createDataFrame([(5, 0), (5, -1), (2000, 7)], "_id long, v long").coalesce(1))
        after = dict(t._manifest()["parts"])
        assert 6 <= sum(after[b] == before[b] for b in before) < 8
        got = dict(rows(t.read(), "_id", "v"))
        assert len(got) == 1001 and got[5] == -1 and got[2000] == 7 and got[6] == 12

    def test_an_append_writes_its_rows_only(self, spark, tmp_path):
        t = sinks.Table(spark, f"file://{tmp_path}/t", buckets=4)
        t.merge(spark.createDataFrame([(1, "a"), (2, "b")], "_id int, v string"))
        old = {p for _, p in t._manifest()["parts"]}
        t.append(spark.createDataFrame([(3, "c", 9)], "_id int, v string, w int"))
        new = {p for _, p in t._manifest()["parts"]}
        assert old < new and rows(t.read(), "_id", "w") == [(1, None), (2, None), (3, "9")]
        t.merge(spark.createDataFrame([(3, "C"), (1, "A")], "_id int, v string"))
        assert rows(t.read(), "_id", "v", "w") == [(1, "A", None), (2, "b", None), (3, "C", None)]

    def test_a_type_that_changes_becomes_text(self, spark, tmp_path):
        t = sinks.Table(spark, f"file://{tmp_path}/t", buckets=4)
        t.merge(spark.createDataFrame([(1, 5), (2, 6)], "_id int, v int"))
        t.merge(spark.createDataFrame([(2, "x")], "_id int, v string"))
        assert rows(t.read(), "_id", "v") == [(1, "5"), (2, "x")]

    def test_rows_without_a_key_are_rewritten_once_one_is_asked_for(self, spark, tmp_path):
        t = sinks.Table(spark, f"file://{tmp_path}/t", buckets=4)
        t.replace(spark.createDataFrame([(1, "a"), (2, "b")], "_id int, v string"))
        assert {b for b, _ in t._manifest()["parts"]} == {-1}
        t.merge(spark.createDataFrame([(2, "B"), (3, "c")], "_id int, v string"))
        assert rows(t.read(), "_id", "v") == [(1, "a"), (2, "B"), (3, "c")] and all(b >= 0 for b, _ in t._manifest()["parts"])
        t.merge(t.read().limit(0))
        assert t.read().count() == 3

    def test_old_versions_go(self, spark, tmp_path):
        t = sinks.Table(spark, f"file://{tmp_path}/t", buckets=2, keep=2)
        for i in range(5):
            t.replace(spark.createDataFrame([(i,)], "q int"))
        assert t.read().first().q == 4 and len(t._versions()) == 2 and len(t._list(f"{t.folder}/data")) == 2

    def test_a_faster_writer_is_noticed(self, spark, tmp_path):
        t = sinks.Table(spark, f"file://{tmp_path}/t")
        base, _ = t._base()
        t.replace(spark.range(1))
        with pytest.raises(sinks.Contended):
            t._commit(spark.range(1).schema, None, [], base)
        waits, left = [], [1, 1]

        def work():
            if left:
                left.pop()
                raise sinks.Contended
            return "done"

        assert sinks.retried(work, waits.append) == "done" and len(waits) == 2 and waits[0] < waits[1]


class TestIncremental:
    def test_replace_then_merge_then_skip(self, spark, tmp_path):
        t, s = (sinks.Table(spark, f"file://{tmp_path}/{n}", buckets=4) for n in "ts")
        asked = []

        def fetch(cursor):
            asked.append(cursor)
            data = [(1, "2024-01-01", "a"), (2, "2024-01-05", "b")] if cursor is None else [(2, "2024-02-01", "B"), (3, "2024-02-02", "c")] if cursor < "2024-02" else []
            return spark.createDataFrame(data, "`:id` int, `:updated_at` string, v string")

        steps = [incremental.refreshed(t, s, "d", fetch, f"run{i}") for i in range(3)]
        assert steps == ["replaced", "merged", "skipped"] and asked == [None, "2024-01-05", "2024-02-02"]
        assert rows(t.read(), "_id", "v") == [(1, "a"), (2, "B"), (3, "c")]
        assert rows(s.read(), "dataset_name", "last_updated_at", "row_count", "last_run_at") == [("d", "2024-02-02", 3, "run2")]

    def test_ahead_keeps_order_and_bound(self):
        running, most, lock = [0], [0], threading.Lock()

        def fetch(i):
            with lock:
                running[0] += 1
                most[0] = max(most[0], running[0])
            time.sleep(0.01 * (i % 3))
            with lock:
                running[0] -= 1
            return i * i

        assert list(incremental.ahead(fetch, list(range(12)), 3)) == [i * i for i in range(12)]
        assert 1 <= most[0] <= 3 and list(incremental.ahead(fetch, [])) == []

    def test_row_count(self):
        assert paged.row_count(lambda r: [{"count": "42"}] if r == {"$select": "count(*)", "$where": "x"} else [], "x") == 42

        def gone(_):
            raise paged.Gone

        assert paged.row_count(gone) == 0


class TestEdges:
    def test_a_wrong_name_is_mended_once(self, spark):
        spark.range(3).selectExpr("id", "id as violations").createOrReplaceTempView("hpd_violations")
        known = {"hpd_violations": ["id", "violations"]}
        df, said = guard.run_repaired(spark, "SELECT sum(id) AS s FROM hpd_violatons", known)
        assert df.first().s == 3 and said == {"hpd_violatons": "hpd_violations"}
        df, said = guard.run_repaired(spark, "SELECT sum(violatons) AS s FROM hpd_violations", known)
        assert df.first().s == 3 and said == {"violatons": "violations"}
        assert guard.run_repaired(spark, "SELECT 1 AS x", known)[1] == {}
        with pytest.raises(Exception, match="zzz"):
            guard.run_repaired(spark, "SELECT * FROM zzz", known)

    def test_workbook(self):
        data = report.xlsx_bytes(["a", "b & c"], [(1, "x<y"), (None, 2.5), (True, "é\x01")] + [(i, None) for i in range(30)])
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            sheet = z.read("xl/worksheets/sheet1.xml").decode()
            assert len(z.namelist()) == 5
        assert "<v>2.5</v>" in sheet and "x&lt;y" in sheet and "b &amp; c" in sheet and "é</t>" in sheet
        assert len(re.findall("<row ", sheet)) == 34 and '<c r="A2"><v>1</v></c>' in sheet

    def test_house_numbers(self, spark):
        df = spark.createDataFrame([(" 12-3a", None, " main   st "), ("x", "9", "Elm"), ("5", "7", ""), ("1", "9", "Oak Ave")], "low string, high string, street string")
        assert rows(files.house_numbers(df), "low", "high", "street") == [("1", "9", "OAK AVE"), ("12-3", "12-3", "MAIN ST")]

    def test_compressed_files(self, spark, tmp_path):
        files.write_compressed(spark.range(100).withColumn("d", F.col("id") % 7), f"{tmp_path}/x", "d")
        assert spark.read.parquet(f"{tmp_path}/x").count() == 100 and all(".zstd." in p.name for p in tmp_path.joinpath("x").glob("*.parquet"))


class TestViews:
    def test_numbers_are_dense(self, spark):
        df = spark.createDataFrame([(i * 7 % 50, f"k{i}") for i in range(50)], "n int, k string").repartition(5)
        got = views.numbered(df, ["n"], "at").orderBy("n").collect()
        assert [r["at"] for r in got] == list(range(1, 51))

    def test_update_from_keeps_what_the_source_lacks(self, spark):
        a, b = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], "k int, v string, w int"), spark.createDataFrame([(1, "A"), (2, None), (9, "z")], "k int, v string")
        assert rows(views.updated_from(a, b, "k", ["v"]), "k", "v", "w") == [(1, "A", 1), (2, "b", 2), (3, None, 3)]

    def test_unpivot(self, spark):
        df = spark.createDataFrame([("d1", "1,234", "x"), ("d2", None, "7.0")], "district string, ann string, bob string")
        assert rows(views.unpivoted(df, ["district"], "who", "n"), "district", "who", "n") == [("d1", "ann", 1234), ("d2", "bob", 7)]

    def test_doubled(self, spark):
        df = spark.createDataFrame([(1,), (1,), (2,), (2,)], "k int")
        got = views.doubled({"twice": (df, ["k"]), "once": (df.distinct(), ["k"]), "none": (df.limit(0), ["k"])})
        assert rows(got, "table_name", "ratio", "doubled") == [("none", None, False), ("once", 1.0, False), ("twice", 2.0, True)]
