"""Where names of people stand in tables, taking them out, and searching them by sound or likeness."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.functions.matching import jaro_winkler_udf, token_sort_udf
from harborlight.functions.metaphone import double_metaphone, double_metaphone_udf

# Terms that mark a company in an owner's or respondent's name.
COMPANY_TERMS = ("LLC", "CORP", "INC", "TRUST", "BANK", "CITY OF", "NYC ", "L.L.C", "L.P.", "ASSOCIATES", "HOLDINGS", "REALTY", "HOUSING DEV", "MANAGEMENT", "PROPERTIES")

# The tables with names, how names stand in them, and where their addresses are.
# schema.table | pattern | name columns (last/first, several sets by ;) | place columns | marks
KNOWN_SOURCES = """
business.sbs_certified | structured | last_name/first_name | city=city zip=zip
city_government.citywide_payroll | structured | last_name/first_name | city=work_location_borough
city_government.civil_service_active | structured | last_name/first_name
city_government.oath_hearings | structured | respondent_last_name/respondent_first_name | address=respondent_address_house city=respondent_address_city zip=respondent_address_zip_code
city_government.coib_policymakers | space | name_of_employee
city_government.coib_legal_defense_trust | structured | last_name/first_name | city=city zip=zip_code
city_government.birth_certificates_1855_1909 | structured | last_name/first_name
city_government.death_certificates_1862_1948 | structured | last_name/first_name
city_government.marriage_certificates_1866_1937 | structured | last_name/first_name
federal.nypd_ccrb_officers_current | structured | Last Name/First Name
federal.nypd_ccrb_complaints | structured | LastName/FirstName
federal.nys_death_index | structured | last_name/first_name
financial.nys_attorney_registrations | structured | last_name/first_name | address=street_1 city=city zip=zip
financial.nys_elevator_licenses | structured | last_name/first_name
housing.hpd_registration_contacts | structured | lastname/firstname | address=businesshousenumber city=businesscity zip=businesszip
housing.evictions | structured | marshal_last_name/marshal_first_name | city=borough
housing.dob_safety_boiler | structured | owner_last_name/owner_first_name;applicant_last_name/applicantfirst_name
public_safety.ccrb_officers | structured | officer_last_name/officer_first_name
city_government.campaign_contributions | comma | name | city=city zip=zip
city_government.campaign_expenditures | comma | name | city=city zip=zip
city_government.cfb_intermediaries | comma | name | city=city zip=zip
city_government.cfb_offyear_contributions | comma | name | city=city zip=zip
federal.fec_contributions | comma | name | city=city zip=zip_code
public_safety.nypd_officer_profile | comma | name
city_government.civil_list | space | name
city_government.cfb_enforcement_audits | space | name
city_government.coib_enforcement | space | case_name
financial.nys_child_support_warrants | space | debtor_name | city=city zip=zip_code
financial.nys_cosmetology_licenses | space | license_holder_name | | last_first
financial.nys_re_appraisers | space | applicant_name | city=business_city zip=zip_code | last_first
financial.nys_re_brokers | space | license_holder_name | city=business_city | last_first no_companies
financial.nys_notaries | space | commission_holder_name
housing.dob_permit_issuance | space | superintendent_first___last_name
business.nys_daily_corp_filings | space | filer_name
city_government.city_record | space | contact_name
social_services.nys_child_care | space | provider_name | city=city zip=zip_code | no_companies
city_government.pluto | owner | ownername
housing.acris_parties | owner | name | address=address_1 city=city zip=zip
business.acris_pp_parties | owner | name
housing.dob_safety_facades | owner | owner_name;qewi_name | city=borough
housing.dob_ecb_violations | respondent | respondent_name | address=respondent_house_number city=respondent_city zip=respondent_zip
housing.hpd_litigations | respondent | respondent | zip=zip
housing.dob_permit_issuance | multi | owner_s_last_name/owner_s_first_name;permittee_s_last_name/permittee_s_first_name;site_safety_mgr_s_last_name/site_safety_mgr_s_first_name | city=borough zip=zip_code
housing.dob_now_build_filings | multi | applicant_last_name/applicant_first_name;filing_representative_last_name/filing_representative_first_name | city=city zip=zip
housing.dob_application_owners | structured | owner_s_last_name/owner_s_first_name
city_government.lobbyist_fundraising | multi | candidate_last_name/candidate_first_name;principal_last_name/principal_first_name | city=city zip=zip
"""


@dataclass(frozen=True)
class NameSource:
    """A table with names: pattern, sets of (last, first or None) columns, place columns."""

    table: str
    pattern: str
    names: tuple[tuple[str, str | None], ...]
    places: dict[str, str] = field(default_factory=dict)
    last_first: bool = False
    no_companies: bool = False


def parse_sources(text: str = KNOWN_SOURCES) -> list[NameSource]:
    found = []
    for line in text.strip().splitlines():
        table, pattern, names, places, marks = [*map(str.strip, line.split("|")), "", ""][:5]
        sets = tuple((last, first or None) for last, _, first in (n.partition("/") for n in names.split(";")))
        if pattern == "structured" and any(first is None for _, first in sets):
            raise ValueError(f"{table}: separate names need both columns")
        found.append(NameSource(table, pattern, sets, dict(p.split("=", 1) for p in places.split()), "last_first" in marks, "no_companies" in marks or pattern in ("owner", "respondent")))
    return found


def is_company(name: Column) -> Column:
    return reduce(Column.__or__, [name.contains(t) for t in COMPANY_TERMS])


def _split(source: NameSource, last: str, first: str | None) -> tuple[Column, Column, Column]:
    """(last name, first name, whether the row counts) of one set of columns."""
    whole = F.col(f"`{last}`").cast("string")
    up = lambda c: F.upper(F.trim(c))
    part = lambda c, sep, i: F.split_part(c, F.lit(sep), F.lit(i))
    if first is not None:
        return up(whole), up(F.col(f"`{first}`").cast("string")), F.length(F.trim(whole)) >= 2
    long = F.length(F.trim(whole)) > 2
    if source.pattern == "comma":
        return up(part(whole, ", ", 1)), up(part(part(whole, ", ", 2), " ", 1)), long & whole.contains(",")
    if source.pattern in ("owner", "respondent"):
        return up(part(whole, ", ", 1)), up(part(whole, ", ", 2)), long
    ends = (1, 2) if source.last_first else (-1, 1)
    return up(part(whole, " ", ends[0])), up(part(whole, " ", ends[1])), long


def extracted(df: DataFrame, source: NameSource) -> DataFrame:
    """(source_table, last_name, first_name, address, city, zip) of one table; several sets of columns come from one scan."""
    sets = []
    for last, first in source.names:
        a, b, ok = _split(source, last, first)
        if source.no_companies:
            ok = ok & ~is_company(F.col(f"`{last}`").cast("string"))
        sets.append(F.struct(a.alias("last_name"), b.alias("first_name"), F.coalesce(ok, F.lit(False)).alias("ok")))
    place = {k: F.col(f"`{source.places[k]}`").cast("string") if k in source.places else F.lit(None).cast("string") for k in ("address", "city", "zip")}
    rows = df.select(F.explode(F.array(*sets)).alias("n"), F.upper(place["address"]).alias("address"), F.upper(place["city"]).alias("city"), place["zip"].alias("zip"))
    return rows.where("n.ok").select(F.lit(source.table.split(".")[-1]).alias("source_table"), "n.last_name", "n.first_name", "address", "city", "zip")


def all_names(open_table: Callable[[str], DataFrame | None], sources: list[NameSource] | None = None) -> DataFrame:
    """The names of every known source that ``open_table`` has (None: it hasn't)."""
    parts = [extracted(df, s) for s in sources or parse_sources() if (df := open_table(s.table)) is not None]
    if not parts:
        raise ValueError("none of the sources is there")
    return reduce(DataFrame.unionByName, parts)


def phonetic_index(rows: DataFrame) -> DataFrame:
    """rows with the sounds of both names: usual codes (dm_*), codes of another origin (dm2_*), soundex."""
    out = rows
    for c in ("last", "first"):
        out = out.withColumn("__dm", double_metaphone_udf(F.upper(f"{c}_name")))
        out = out.withColumns({f"dm_{c}": F.get("__dm", F.lit(0)), f"dm2_{c}": F.get("__dm", F.lit(1)), f"soundex_{c}": F.soundex(F.upper(f"{c}_name"))})
    return out.drop("__dm")


def _likeness(column: str, asked: str) -> Column:
    return jaro_winkler_udf(F.upper(column), F.lit(asked.upper()))


def phonetic_search(index: DataFrame, last: str, first: str | None = None, least: float = 0.75, top: int = 50) -> DataFrame:
    """People whose last name sounds like the one asked for, by 0.6 of its likeness and 0.4 of the first name's (the last's alone without one)."""
    hit = index.where(F.col("dm_last") == double_metaphone(last)[0])
    scored = hit.withColumn("last_score", _likeness("last_name", last)).withColumn("first_score", F.lit(1.0) if first is None else _likeness("first_name", first))
    whole = F.col("last_score") if first is None else 0.6 * F.col("last_score") + 0.4 * F.col("first_score")
    return scored.withColumn("score", whole).where(F.col("score") >= least).orderBy(F.col("score").desc(), "unique_id").limit(top)


def vital_search(records: DataFrame, last_column: str, first_column: str, last: str, first: str | None = None, top: int = 30) -> DataFrame:
    """Historical records whose last name has the soundex of the one asked for, the most alike first (last name, then first name)."""
    hit = records.where(F.soundex(F.upper(last_column)) == F.soundex(F.lit(last.upper()))).withColumn("last_score", _likeness(last_column, last))
    if first is not None:
        hit = hit.withColumn("first_score", _likeness(first_column, first))
    return hit.orderBy(F.col("last_score").desc_nulls_last(), *([F.col("first_score").desc_nulls_last()] if first is not None else []), last_column, first_column).limit(top)


def fuzzy_search(df: DataFrame, column: str, asked: str, least: float = 70.0, top: int = 30, extra: list[str] | None = None) -> DataFrame:
    """Rows whose column has nearly the asked words in any order (companies, donors); with ``extra``, only the column and those."""
    rows = df if extra is None else df.select(column, *extra)
    return rows.withColumn("match_score", token_sort_udf(F.upper(column), F.lit(asked.upper()))).where(F.col("match_score") >= least).orderBy(F.col("match_score").desc(), column).limit(top)


def random_levels(rows: DataFrame, levels: dict[str, Callable[[str, str], Column]], pairs: int = 5_000_000, seed: int = 1, id_col: str = "unique_id") -> DataFrame:
    """(column, level, u): how often two random records agree, from about ``pairs`` random pairs.

    Records are dealt to buckets at random so that pairs inside buckets are about
    as many as asked for: a sample of pairs of the whole table, without a cross join.
    levels: column -> expression of its level from the names of both sides' columns.
    """
    n = rows.agg(F.count("*").alias("n"))
    cols = list(levels)
    # n / b records share a bucket, n * n / (2 * b) pairs in all.
    dealt = rows.select(id_col, *cols).crossJoin(F.broadcast(n)).withColumn("__b", F.floor(F.rand(seed) * F.greatest(F.lit(1.0), F.col("n").cast("double") * F.col("n") / (2.0 * pairs))))
    a, b = (dealt.select("__b", F.col(id_col).alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in cols]) for s in "lr")
    met = a.join(b, "__b").where("id_l < id_r")
    names = ", ".join(f"'{c}', g_{c}" for c in cols)
    long = met.select(*[levels[c](f"{c}_l", f"{c}_r").cast("int").alias(f"g_{c}") for c in cols]).select(F.expr(f"stack({len(cols)}, {names}) as (column, level)"))
    counts = long.where("level >= 0").groupBy("column", "level").agg(F.count("*").alias("k"))
    totals = counts.groupBy("column").agg(F.sum("k").alias("t"))
    return counts.join(F.broadcast(totals), "column").select("column", "level", (F.col("k") / F.col("t")).alias("u"))
