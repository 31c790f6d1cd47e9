"""A read-only gate for SQL from outside."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

MAX_LENGTH = 10_000
MAX_ROWS = 1000
READS = {"Project", "Aggregate", "Filter", "Sort", "GlobalLimit", "LocalLimit", "Distinct", "Union", "Intersect", "Except"}
#: Nodes of Spark's parsed plans that change something or reach outside.
WRITES = re.compile(r"^\W*'?(Insert|Create|Drop|Alter|Truncate|Delete|Update|Merge|Set|Use|Cache|Uncache|Refresh|Add|Load|Analyze|Repair|Explain|Describe|Show|Append|Overwrite|Replace|Comment|Call|RunnableCommand|Command)\w*", re.M)
OUTSIDE = re.compile(r"\b(read_files|reflect|java_method|try_reflect|input_file_\w+|from_avro|python_\w+)\s*\(|\b(parquet|csv|json|text|orc|avro|binaryFile|xml|delta)\s*\.\s*`", re.I)


class Rejected(ValueError):
    """The statement may not run."""


def plain(sql: str) -> str:
    """The statement without comments and closing semicolons; quoted text stays as it is."""
    out = re.sub(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`)|/\*.*?\*/|--[^\n]*", lambda m: m[1] or " ", sql, flags=re.S)
    return out.strip().rstrip(";").strip()


def relations(plan) -> list[list[str]]:
    """The parts of every table name in a parsed plan, subqueries and WITH parts included, but not the WITH names."""
    found, local = [], set()

    def walk(node) -> None:
        name = node.getClass().getSimpleName()
        if name == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            found.append([parts.apply(i) for i in range(parts.size())])
        if name == "UnresolvedWith":
            pairs = node.cteRelations()
            for i in range(pairs.size()):
                pair = pairs.apply(i)
                local.add(pair._1().lower())
                walk(pair._2())
        for group in (node.children(), node.subqueries()):
            for i in range(group.size()):
                walk(group.apply(i))

    walk(plan)
    return [x for x in found if not (len(x) == 1 and x[0].lower() in local)]


def check(spark: SparkSession, sql: str, schemas: set[str] | None = None) -> str:
    """The statement, if it only reads tables that it may; Rejected otherwise.

    schemas: allowed schema names; every table must then be named schema.table
    (a catalog before it is allowed), and not begin with an underscore.
    """
    text = plain(sql)
    if not text:
        raise Rejected("empty statement")
    if len(text) > MAX_LENGTH:
        raise Rejected("statement too long")
    if ";" in re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", "", text):
        raise Rejected("more than one statement")
    if OUTSIDE.search(text):
        raise Rejected("reads files or runs code")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise Rejected(f"not parsed: {str(e).splitlines()[0]}") from None
    if m := WRITES.search(plan.toString()):
        raise Rejected(f"not a query: {m[1]}")
    for parts in relations(plan):
        if schemas is not None and (len(parts) < 2 or parts[-2].lower() not in schemas):
            raise Rejected(f"table not allowed: {'.'.join(parts)}")
        if parts[-1].startswith("_"):
            raise Rejected(f"internal table: {parts[-1]}")
    return text


def run(spark: SparkSession, sql: str, schemas: set[str] | None = None, rows: int = MAX_ROWS) -> DataFrame:
    return spark.sql(check(spark, sql, schemas)).limit(rows)


def repair_name(wrong: str, known: list[str], least: float = 60.0) -> str | None:
    """The known name most like a wrong one, if it is like enough."""
    from harborlight.functions.matching import indel_ratio

    best = max(known, key=lambda k: (indel_ratio(wrong.lower(), k.lower()), k), default=None)
    return best if best is not None and indel_ratio(wrong.lower(), best.lower()) >= least else None


def run_repaired(spark: SparkSession, sql: str, tables: dict[str, list[str]], schemas: set[str] | None = None, rows: int = MAX_ROWS) -> tuple[DataFrame, dict[str, str]]:
    """run(), and once more with a mended name if a table or column isn't known; the second value says what was mended.

    tables: known tables (as they are written in statements) and their columns.
    """
    from pyspark.errors import AnalysisException

    text = check(spark, sql, schemas)
    try:
        return spark.sql(text).limit(rows), {}
    except AnalysisException as e:
        kind, wrong = e.getCondition() or "", (e.getMessageParameters() or {})
        if kind.startswith("TABLE_OR_VIEW_NOT_FOUND"):
            name, known = wrong.get("relationName", ""), list(tables)
        elif kind.startswith("UNRESOLVED_COLUMN"):
            name, known = wrong.get("objectName", ""), sorted({c for cs in tables.values() for c in cs})
        else:
            raise
        name = name.replace("`", "")
        if kind.startswith("UNRESOLVED_COLUMN"):
            name = name.rsplit(".", 1)[-1]
        better = repair_name(name, known)
        if better is None:
            raise
        mended = re.sub(rf"(?<![\w.])`?{re.escape(name)}`?(?!\w)", better, text)
        if mended == text and "." in name:
            mended = text.replace(name, better)
        return spark.sql(check(spark, mended, schemas)).limit(rows), {name: better}
