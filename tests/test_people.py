"""Names in tables, their sounds, searches, and random pairs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from harborlight.functions.matching import jaro_winkler, token_sort_ratio
from harborlight.functions.metaphone import double_metaphone
from harborlight.operators import people


@pytest.mark.parametrize(
    ("name", "want"),
    [("Smith", ("SM0", "XMT")), ("Schmidt", ("XMT", "SMT")), ("Thomas", ("TMS", "TMS")), ("Knight", ("NT", "NT")), ("Michael", ("MKL", "MXL")), ("Czerny", ("SRN", "XRN")), ("Laugh", ("LF", "LF")), ("Jose", ("HS", "HS")), ("Cabrillo", ("KPRL", "KPR")),
     ("Sugar", ("XKR", "SKR")), ("Arnow", ("ARN", "ARNF")), ("Filipowicz", ("FLPT", "FLPF")), ("Breaux", ("PR", "PR")), ("García", ("KRS", "KRX")), ("Wasserman", ("ASRM", "FSRM")), ("Accident", ("AKST", "AKST")), ("Edgar", ("ATKR", "ATKR")), ("", ("", "")), (None, None)],
)
def test_published_codes(name, want):
    assert double_metaphone(name) == want


def test_registry():
    found = people.parse_sources()
    assert len(found) == 46 and len({(s.table, s.pattern) for s in found}) == 46
    assert [s.pattern for s in found].count("structured") == 18 and sum(s.last_first for s in found) == 3 and sum(s.no_companies for s in found) == 8
    with pytest.raises(ValueError):
        people.parse_sources("a.b | structured | last")


def take(df, source):
    return sorted((r.last_name, r.first_name, r.address, r.city, r.zip) for r in people.extracted(df, source).collect())


def test_patterns(spark):
    df = spark.createDataFrame([(" doe ", "Jane", "Doe, Jane Q", "Jane Q Doe", "Doe Jane", "ny", 10001), ("x", "y", "ACME LLC", "Acme INC", "REALTY CO", None, None), (None, None, None, None, None, "ny", 1)], "last string, first string, c string, s string, r string, town string, zip int")
    S, places = people.NameSource, {"city": "town", "zip": "zip"}
    assert take(df, S("a.t", "structured", (("last", "first"),), places)) == [("DOE", "JANE", None, "NY", "10001")]
    assert take(df, S("a.t", "comma", (("c", None),))) == [("DOE", "JANE", None, None, None)]
    assert take(df, S("a.t", "space", (("s", None),))) == [("DOE", "JANE", None, None, None), ("INC", "ACME", None, None, None)]
    assert take(df, S("a.t", "space", (("r", None),), {}, True, True)) == [("DOE", "JANE", None, None, None)]
    assert take(df, S("a.t", "owner", (("c", None), ("r", None)), {}, False, True)) == [("DOE", "JANE Q", None, None, None), ("DOE JANE", "", None, None, None)]
    assert take(df, S("a.t", "multi", (("last", "first"), ("s", None)))) == [("DOE", "JANE", None, None, None), ("DOE", "JANE", None, None, None), ("INC", "Acme".upper(), None, None, None)]
    both = people.all_names(lambda t: df if t == "a.t" else None, [S("a.t", "comma", (("c", None),)), S("a.u", "comma", (("c", None),))])
    assert both.count() == 1 and both.first().source_table == "t"


def test_searches(spark):
    data = [(i, n, f) for i, (n, f) in enumerate([("Smith", "Anna"), ("Smyth", "Ann"), ("Schmitt", "Anna"), ("Jones", "Anna"), ("SMITHE", "Bob"), (None, "Anna")])]
    df = spark.createDataFrame(data, "unique_id long, last_name string, first_name string")
    got = people.phonetic_search(people.phonetic_index(df), "smith", "anna").collect()
    want = []
    for i, n, f in data:
        if n and double_metaphone(n)[0] == double_metaphone("smith")[0]:
            score = 0.6 * jaro_winkler(n.upper(), "SMITH") + 0.4 * jaro_winkler(f.upper(), "ANNA")
            if score >= 0.75:
                want.append((-round(score, 9), i))
    assert [(-round(r.score, 9), r.unique_id) for r in got] == sorted(want) and len(want) >= 2
    assert [r.unique_id for r in people.phonetic_search(people.phonetic_index(df), "Jones").collect()] == [3]
    vital = people.vital_search(df, "last_name", "first_name", "Smith", "Ann").collect()
    assert vital[0].last_name == "Smith" and {r.last_name for r in vital} == {"Smith", "Smyth", "Schmitt", "SMITHE"}
    firms = spark.createDataFrame([("Blue Water Trading", 1), ("TRADING BLUE WATER", 2), ("Red Sand", 3), (None, 4)], "name string, n int")
    fuzzy = people.fuzzy_search(firms, "name", "water trading blue", extra=["n"]).collect()
    assert sorted(r.n for r in fuzzy) == [1, 2] and all(abs(r.match_score - token_sort_ratio(r.name.upper(), "WATER TRADING BLUE")) < 1e-9 for r in fuzzy)


def test_random_pairs_estimate_chance_agreement(spark):
    df = spark.range(4000).select(F.col("id").alias("unique_id"), (F.col("id") % 4).cast("string").alias("city"), F.col("id").cast("string").alias("name"))
    same = lambda a, b: F.when(F.col(a) == F.col(b), 1).otherwise(0)
    for pairs in (200_000, 10**9):  # a sample, and all pairs
        got = {(r["column"], r.level): r.u for r in people.random_levels(df, {"city": same, "name": same}, pairs).collect()}
        assert abs(got["city", 1] - 0.25) < 0.02 and ("name", 1) not in got and abs(got["city", 0] + got["city", 1] - 1) < 1e-9
