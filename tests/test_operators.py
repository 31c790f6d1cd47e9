"""Operators on small frames made here."""

from __future__ import annotations

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborlight.functions import exprs, matching
from harborlight.operators import aggregates, anomaly, filters, guard, linkage, ranking, spatial
from harborlight.operators.graph import Graph, connected, shared_pairs
from harborlight.sources import files, paged, sinks


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


class TestFilters:
    def frame(self, spark):
        return spark.createDataFrame([(1, "Anna B", 5.0, "open"), (2, "Bob", None, "OPEN"), (3, None, 7.0, "shut")], "id int, name string, amount double, status string")

    def test_terms_are_joined_by_and(self, spark):
        page, total = filters.filtered_page(self.frame(spark), {"min:amount": "5", "q:name": "ANNA"}, "id")
        assert rows(page, "id") == [(1,)] and total.first().total == 1

    def test_nulls_sort_last_and_pages_move_on(self, spark):
        df = self.frame(spark)
        ids = [filters.filtered_page(df, {}, "amount", "desc", p, 1)[0].first().id for p in (1, 2, 3)]
        assert ids == [3, 1, 2]

    @pytest.mark.parametrize("bad", [{"id; drop": 1}, {"near:id": 1}, {"nothing": 1}])
    def test_bad_filters_are_refused(self, spark, bad):
        with pytest.raises(ValueError):
            filters.filtered_page(self.frame(spark), bad)

    @pytest.mark.parametrize(
        ("name", "kind", "want"),
        [("zip", T.StringType(), "geography"), ("owner_zip", T.LongType(), "geography"), ("seen", T.DateType(), "date_range"), ("issue_date", T.StringType(), "date_range"),
         ("status", T.StringType(), "category"), ("permit_type", T.StringType(), "category"), ("owner_name", T.StringType(), "text_search"), ("amount", T.DoubleType(), "numeric_range"),
         ("amount", T.StringType(), None), ("x", T.LongType(), None), ("Community_Board", T.StringType(), "category"), ("borocode", T.LongType(), "geography"), ("disposition", T.StringType(), "category"),
         ("streetname", T.StringType(), None), ("street_name", T.StringType(), "text_search"), ("offense_description", T.StringType(), "category"), ("other_description_text", T.StringType(), "text_search"),
         ("latitude", T.DoubleType(), None), ("fee_fine", T.DecimalType(9, 2), "numeric_range"), ("class", T.LongType(), None), ("updated", T.TimestampType(), "date_range")],
    )
    def test_column_kinds(self, name, kind, want):
        assert filters.column_kind(name, kind) == want


class TestGuard:
    @pytest.mark.parametrize("sql", ["SELECT 1", "SELECT * FROM housing.a -- note; more", "WITH x AS (SELECT * FROM lake.housing.a) SELECT * FROM x UNION SELECT * FROM housing.b", "SELECT ';' AS s", "SELECT * FROM housing.a WHERE x IN (SELECT y FROM housing.b);"])
    def test_reads_pass(self, spark, sql):
        assert guard.check(spark, sql, {"housing"})

    @pytest.mark.parametrize(
        "sql",
        ["", "SELECT 1; SELECT 2", "DROP TABLE housing.a", "INSERT INTO housing.a VALUES (1)", "CREATE VIEW v AS SELECT 1", "SELECT * FROM other.a", "SELECT * FROM a", "SELECT * FROM housing._state", "SET x = 1", "/* x */ DELETE FROM housing.a",
         "SELECT * FROM parquet.`/etc`", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM housing.a WHERE x IN (SELECT y FROM secret.b)", "selec 1", "SELECT 1" + " " * 10_000 + "+ 1", "TRUNCATE TABLE housing.a", "USE housing", "SHOW TABLES"],
    )
    def test_others_dont(self, spark, sql):
        with pytest.raises(guard.Rejected):
            guard.check(spark, sql, {"housing"})

    def test_repair(self):
        assert guard.repair_name("hpd_violatons", ["hpd_violations", "dob_permits"]) == "hpd_violations"
        assert guard.repair_name("zzz", ["abc"]) is None


class TestMatching:
    @pytest.mark.parametrize(("a", "b", "want"), [("MARTHA", "MARHTA", 0.961111), ("DIXON", "DICKSONX", 0.813333), ("", "", 1.0), ("A", "", 0.0), ("ABC", "XYZ", 0.0)])
    def test_jaro_winkler(self, a, b, want):
        assert abs(matching.jaro_winkler(a, b) - want) < 1e-5

    @given(st.text("ABC ", max_size=12), st.text("ABC ", max_size=12))
    @settings(max_examples=200, deadline=None)
    def test_common_subsequence(self, a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert matching._common(a, b) == table[-1][-1]

    def test_token_ratios(self):
        assert matching.token_sort_ratio("new york mets", "mets york new") == 100
        assert matching.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
        assert matching.partial_ratio("yankees", "new york yankees") == 100
        assert matching.token_sort_ratio(None, "a") is None

    def test_sounds(self):
        assert matching.phonetic_key("SMITH") == matching.phonetic_key("SMYTH")
        assert matching.phonetic_key("KNIGHT") == matching.phonetic_key("NITE")
        assert matching.phonetic_key("") == "" and matching.phonetic_key(None) is None


class TestRanking:
    @given(st.lists(st.integers(0, 9), min_size=1, max_size=40))
    @settings(max_examples=5, deadline=None)
    def test_percent_rank(self, spark, values):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id int, v double")
        below = lambda v: sum(w < v for w in values)
        want = [(i, below(v) / (len(values) - 1) if len(values) > 1 else 0.0) for i, v in enumerate(values)]
        few = ranking.FEW
        try:
            for ranking.FEW in (few, 2):  # broadcast, and ranges of a partition each
                got = rows(ranking.global_percent_ranks(df, {"v": "r", "id": "s"}), "id", "r", "s")
                assert [round(r, 9) for _, r, _ in got] == [round(r, 9) for _, r in want]
                assert [s for *_, s in got] == [i / max(1, len(values) - 1) for i in range(len(values))]
        finally:
            ranking.FEW = few

    def test_null_values_have_no_rank(self, spark):
        df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "id int, v double")
        assert [r.r for r in ranking.global_percent_rank(df, "v", "r").orderBy("id").collect()] == [0.0, None, 1.0]

    def test_flips(self, spark):
        d = datetime.date
        df = spark.createDataFrame([("a", d(2020, 1, 31), 100.0, 1), ("a", d(2020, 2, 1), 130.0, 2), ("a", d(2023, 1, 1), 500.0, 3), ("b", d(2020, 1, 1), 0.0, 4), ("b", d(2020, 2, 1), 9.0, 5)], "k string, t date, p double, id int")
        assert rows(ranking.flips(df, "k", "t", "p", "id"), "id", "months", "profit_pct") == [(2, 1, 30.0)]

    def test_modal_breaks_ties_by_value(self, spark):
        df = spark.createDataFrame([("z", "b"), ("z", "a"), ("y", None)], "k string, v string")
        assert rows(ranking.modal(df, "k", "v", "m"), "k", "m", "weight") == [("z", "a", 1)]


class TestGraph:
    @given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=20))
    @settings(max_examples=5, deadline=None)
    def test_components(self, spark, edges):
        root = {i: i for i in range(16)}
        for _ in range(16):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        g = Graph(spark.range(16), spark.createDataFrame(edges, "src long, dst long"))
        assert dict(rows(g.components(), "id", "component")) == root

    def test_long_chain(self, spark):
        chain = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
        assert {r.root for r in connected(chain).collect()} == {0}

    def test_hops_and_two_hops(self, spark):
        g = Graph(spark.range(6), spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0), (3, 4)], "src long, dst long"))
        assert rows(g.hops(spark.range(1), 6), "id", "hops") == [(0, 0), (1, 1), (2, 2), (3, 1), (4, 2)]
        assert rows(g.two_hops(spark.range(1)), "via", "id") == [(1, 2), (3, 2), (3, 4)]
        assert {r.id: r.clustering for r in g.triangles().collect()}[1] == 0.0

    def test_triangles_of_a_hub(self, spark):
        edges = [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(1, 29)] + [(5, 0), (3, 3)]
        g = Graph(spark.range(30), spark.createDataFrame(edges, "src long, dst long"))
        got = {r.id: (r.degree, r.triangles) for r in g.triangles().collect()}
        assert got[0] == (29, 28) and got[1] == (2, 1) and got[10] == (3, 2)

    def test_neighbourhood_and_edges_with_properties(self, spark):
        g = Graph(spark.range(5), spark.createDataFrame([(0, 1, "a"), (2, 0, "b"), (2, 3, "c"), (1, 2, "d"), (None, 0, "e")], "src long, dst long, kind string"))
        assert rows(g.neighbourhood(spark.range(1)), "start", "id", "hops") == [(0, 1, 1), (0, 2, 1), (0, 3, 2)]
        assert rows(g.incident(spark.range(1), "kind"), "id", "kind") == [(1, "a"), (2, "b")]

    def test_shared_pairs(self, spark):
        links = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("b", 2), ("c", 2), (None, 1)], "o string, i int")
        assert rows(shared_pairs(links, "o", "i"), "a", "b", "shared") == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]
        assert rows(shared_pairs(links, "o", "i", most=2), "a", "b") == [("a", "b")]


class TestSpatial:
    def test_rings(self, spark):
        df = spark.range(1).select(spatial.ring(spatial.cell(F.lit(40.7128), F.lit(-74.006), 0.01), 1).alias("r"))
        assert len(set(df.first().r)) == 9

    def test_centre_lies_in_its_cell(self, spark):
        df = spark.createDataFrame([(40.7128, -74.006), (-33.9, 151.2), (0.0, 0.0)], "lat double, lng double")
        c = spatial.cell(F.col("lat"), F.col("lng"), 0.01)
        la, lo = spatial.centre(c, 0.01)
        assert df.where(spatial.cell(la, lo, 0.01) != c).count() == 0

    def test_within_equals_all_pairs(self, spark):
        pts = [(i, 40.0 + (i * 37 % 100) / 1000, -74.0 + (i * 61 % 100) / 1000) for i in range(100)]
        df = spark.createDataFrame(pts, "id int, lat double, lng double")
        p = df.where("id < 5").withColumnsRenamed({"id": "p", "lat": "p_lat", "lng": "p_lng"})
        got = rows(spatial.within(df, p, 1500.0), "p", "id")
        near = lambda a, b: ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 <= 1500 / 111139.0
        assert got == sorted((b[0], a[0]) for a in pts for b in pts[:5] if near(a, b))

    def test_haversine(self, spark):
        miles = spark.range(1).select(exprs.haversine_miles(F.lit(40.7128), F.lit(-74.0060), F.lit(34.0522), F.lit(-118.2437)).alias("m")).first().m
        assert 2440 < miles < 2455


class TestAnomaly:
    def test_sync_status(self, spark):
        t = datetime.datetime
        data = [(100, 100, None, None, "synced"), (0, 5, None, None, "stale"), (100, 106, None, None, "stale"), (100, 104, None, None, "synced"), (100, None, None, None, "unknown"), (100, 90, t(2024, 1, 1), t(2024, 1, 2), "stale"), (100000, 101500, None, None, "stale"), (0, 0, None, None, "synced")]
        df = spark.createDataFrame(data, "a long, b long, c timestamp, d timestamp, want string")
        assert df.where(anomaly.sync_status(F.col("a"), F.col("b"), F.col("c"), F.col("d")) != F.col("want")).count() == 0

    def test_confidence(self, spark):
        df = spark.createDataFrame([(None, None, None, None, None, 1.0), (10, None, None, None, None, 1.0), (500, 5.0, 10.0, None, None, 0.562), (2000, None, None, 0.9, 0.5, 0.447)], "h int, r double, e double, m double, s double, want double")
        got = df.select("want", anomaly.confidence(*map(F.col, ("h", "r", "e", "m", "s"))).alias("c")).collect()
        assert all(abs(r.c - r.want) < 1e-9 for r in got), got


class TestLinkage:
    def test_entity_id_depends_on_members_only(self, spark):
        a, b, c = (spark.range(1).select(linkage.entity_id(F.array(*map(F.lit, x))).alias("i")).first().i for x in (["1", "2"], ["2", "1"], ["1", "3"]))
        assert a == b != c and len(a) == 36

    def test_large_blocks_keep_every_pair(self, spark):
        """First names that begin differently, nulls, and a block of many parts."""
        data = [(i, f"{chr(65 + i % 26)}{i}", "X", None if i % 9 == 0 else f"z{i % 2}") for i in range(60)]
        df = spark.createDataFrame(data, "unique_id long, first_name string, last_name string, zip string")
        got = rows(linkage.candidates(df, [("last_name", "zip"), ("first_name",)], most=4), "l", "r")
        assert got == sorted((a[0], b[0]) for a in data for b in data if a[0] < b[0] and a[3] is not None and a[3] == b[3])

    @pytest.mark.parametrize(("name", "want"), [("ACME LLC", "ORGANIZATION"), ("jo smith", "PERSON"), ("", "UNKNOWN"), (None, "UNKNOWN"), ("City of Oz", "ORGANIZATION"), ("VINCENT", "ORGANIZATION")])
    def test_kinds(self, spark, name, want):
        assert spark.createDataFrame([(name,)], "n string").select(linkage.entity_kind(F.col("n"))).first()[0] == want

    def test_name_patterns(self, spark):
        df = spark.createDataFrame([("Doe, Jane", "Jane Q Doe", "Doe Jane Q")], "a string, b string, c string")
        for pattern, col in (("comma", "a"), ("space", "b"), ("last_first", "c")):
            r = linkage.names(df, "t", pattern, [col]).first()
            assert r.last_name == "DOE" and r.first_name.startswith("JANE")
        assert linkage.names(df, "t", "multi", ["a", "b"]).count() == 2

    def test_em_separates_two_groups(self, spark):
        data = [(1, 1)] * 90 + [(0, 0)] * 880 + [(1, 0)] * 15 + [(0, 1)] * 15
        prior, m, u = linkage.expectation_maximisation(spark.createDataFrame(data, "a int, b int"), ["a", "b"], 0.05)
        assert 0.03 < prior < 0.3 and m["a"][1] > 0.7 and u["a"][1] < 0.1

    def test_batches(self):
        assert linkage.batches([("a", 6), ("b", 3), ("c", 2)], 9) == [(["a", "b"], 9), (["c"], 2)]
        assert linkage.batches([("a", 60)], 9) == [(["a"], 60)]

    def test_token_lookup(self, spark):
        df = spark.createDataFrame([(1, "Acme Realty LLC"), (2, "Acme Bakery"), (3, None)], "id int, name string")
        index = linkage.token_index(df, "name", "t", "id")
        assert rows(linkage.token_lookup(index, "acme realty llc"), "source_id") == [(1,)]


class TestSources:
    def test_pages(self):
        got = paged.page_requests(120, 50, "a,b", "x > 1")
        assert [(g["$limit"], g["$offset"]) for g in got] == [("50", "0"), ("50", "50"), ("20", "100")]
        assert all(g["$order"] == ":id" and g["$where"] == "x > 1" for g in got) and paged.page_requests(0) == []

    def test_retries(self):
        waits, calls = [], []

        def fetch(_):
            calls.append(1)
            if len(calls) < 3:
                raise paged.Busy(2.0 if len(calls) == 1 else None)
            return [{"a": 1}]

        assert paged.with_retries(fetch, {}, sleep=waits.append) == [{"a": 1}] and waits[0] == 2.0 and len(waits) == 2

        def gone(_):
            raise paged.Gone

        assert paged.with_retries(gone, {}) == []

    def test_delimited(self, spark, tmp_path):
        (tmp_path / "x.csv").write_text('﻿id,note\n1,"two\nlines"\n2,\n')
        assert rows(files.delimited(spark, str(tmp_path)).na.fill("-"), "id", "note") == [("1", "two\nlines"), ("2", "-")]
        (tmp_path / "y.txt").write_text("10001|a\n20001|b\n")
        df = files.delimited(spark, str(tmp_path / "y.txt"), ["zip", "v"], "|", header=False, with_file=True)
        assert rows(files.by_prefix(df, "zip", ["100"], "2024"), "zip", "cycle", "source_file") == [("10001", "2024", "y.txt")]

    def test_xml(self, spark, tmp_path):
        (tmp_path / "c.xml").write_text("<r><Case><id>1</id><p><n>A</n></p><p><n>B</n></p></Case><Case><id>2</id><p><n>C</n></p></Case></r>")
        got = files.xml_rows(spark, str(tmp_path / "c.xml"), "Case")
        assert {"id", "p_n"} <= set(got.columns) and rows(got, "id") == [("1",), ("2",)]

    def test_xml_keeps_every_repeat(self, spark, tmp_path):
        values = "".join(f"<p><n>{i}</n><q>{i}a</q><q>{i}b</q></p>" for i in range(1, 9))
        (tmp_path / "c.xml").write_text(f"<r><Case><id>1</id>{values}</Case><Case><id>2</id><p><n>C</n></p></Case></r>")
        got = files.xml_rows(spark, str(tmp_path / "c.xml"), "Case")
        one = got.where("id = '1'").first()
        assert [one["p_n" if i == 1 else f"p_{i}_n"] for i in range(1, 9)] == [str(i) for i in range(1, 9)]
        assert one["p_8_q"] == "8a" and one["p_8_q_2"] == "8b"

    def test_geojson(self, spark, tmp_path):
        (tmp_path / "z.json").write_text('{"features": [{"properties": {"zip": "1"}, "geometry": {"type": "Polygon", "coordinates": [[[0,0],[2,0],[2,2],[0,2],[0,0]]]}}]}')
        r = files.geojson_features(spark, str(tmp_path / "z.json")).first()
        assert (r.lon, r.lat, r.properties["zip"]) == (1.0, 1.0, "1")

    def test_union_widens(self, spark):
        a, b = spark.createDataFrame([(1, "x")], "id int, a string"), spark.createDataFrame([("y", 2.0)], "id string, b double")
        assert files.union_by_name([a, b]).dtypes == [("id", "string"), ("a", "string"), ("b", "double")]

    def test_merge_and_evolution(self, spark, tmp_path):
        t = sinks.Table(spark, f"file://{tmp_path}/t")
        t.merge(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "`:id` int, name string"))
        t.merge(spark.createDataFrame([(2, "B", 7)], "`:id` int, name string, extra int"))
        assert rows(t.read().na.fill("-"), "_id", "name", "extra") == [(1, "a", "-"), (2, "B", "7"), (3, "c", "-")]
        t.append(spark.createDataFrame([("z",)], "name string"))
        assert t.read().count() == 4
        t.replace(spark.createDataFrame([(9,)], "q int"))
        assert t.read().columns == ["q"]

    def test_last_of_equal_keys_wins(self, spark):
        df = spark.createDataFrame([(1, "2024-01-01", "a"), (1, "2024-02-01", "b")], "_id int, _updated_at string, v string")
        assert rows(sinks.last_per_key(df, "_id"), "v") == [("b",)]

    def test_state_keeps_the_cursor(self, spark):
        s = sinks.with_state(None, spark, "d", 5, "2024-01-01", "now")
        s = sinks.with_state(s, spark, "d", 6, None, "later")
        assert rows(s, "dataset_name", "last_updated_at", "row_count", "last_run_at") == [("d", "2024-01-01", 6, "later")]


def test_profile_and_quantiles(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "a int, b string")
    assert rows(aggregates.null_profile(df), "column_name", "null_pct", "mostly_null") == [("a", 0.0, False), ("b", 66.67, True)]
    assert aggregates.iqr_outliers(spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 100]], "v double"), "v").first().outlier_flag == "high_outlier"


def test_keys(spark):
    df = spark.createDataFrame([("1", "16", "7", "1000160007.0"), ("1", "16", "7", "nope")], "a string, b string, c string, k string")
    assert rows(df.select(exprs.lot_key("a", "b", "c").alias("x"), F.coalesce(exprs.lot_key_of("k"), F.lit("-")).alias("y")), "x", "y") == [("1000160007", "-"), ("1000160007", "1000160007")]
