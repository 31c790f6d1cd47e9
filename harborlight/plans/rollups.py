"""Precomputed summaries: hubs, chains, per-area statistics, unions, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.catalog import table
from harborlight.functions.exprs import ratio
from harborlight.operators import aggregates as agg
from harborlight.plans.registry import plan


@plan("""
WITH own AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
portfolio AS (SELECT l_suppkey, count(*) AS parts, sum(p_size) AS total_size FROM own JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING count(*) >= 2),
flags AS (SELECT l_suppkey, count(*) AS violations, count(*) FILTER (WHERE l_linestatus = 'O') AS open_violations,
  count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1)
SELECT p.l_suppkey AS s_suppkey, s_name, parts, CAST(total_size AS BIGINT) AS total_size, coalesce(violations, 0) AS violations,
  coalesce(open_violations, 0) AS open_violations, coalesce(returned, 0) AS returned,
  coalesce(returned, 0) * 3 + coalesce(open_violations, 0) AS score
FROM portfolio p LEFT JOIN supplier ON s_suppkey = p.l_suppkey LEFT JOIN flags f ON f.l_suppkey = p.l_suppkey
ORDER BY score DESC, s_suppkey LIMIT 25
""")
def worst_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Owners ranked by a weighted count of their items' violations. The fact table is read once, its counters combined map-side."""
    line = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_linestatus", "l_returnflag")
    # One aggregation by (owner, item) serves both the portfolio and the counters.
    per = agg.counters(line, ["l_suppkey", "l_partkey"], {"open": F.col("l_linestatus") == "O", "returned": F.col("l_returnflag") == "R"})
    sized = per.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey", "left")
    own = sized.groupBy("l_suppkey").agg(
        F.count("p_size").alias("parts"), F.sum("p_size").cast("long").alias("total_size"), F.sum("total").cast("long").alias("violations"),
        F.sum("open").cast("long").alias("open_violations"), F.sum("returned").cast("long").alias("returned"),
    ).where("parts >= 2")
    score = F.col("returned") * 3 + F.col("open_violations")
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    top = own.withColumn("score", score).orderBy(F.col("score").desc(), "l_suppkey").limit(25)
    return top.join(names, "l_suppkey", "left").select(F.col("l_suppkey").alias("s_suppkey"), "s_name", "parts", "total_size", "violations", "open_violations", "returned", "score").orderBy(F.col("score").desc(), "s_suppkey")


@plan("""
WITH a AS (SELECT l_partkey, count(*) AS n_lines, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned, count(DISTINCT l_suppkey) AS n_suppliers,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, max(CAST(l_shipdate AS DATE)) AS last_ship
  FROM lineitem WHERE l_quantity > 10 GROUP BY 1)
SELECT coalesce(p_partkey, l_partkey) AS partkey, p_brand, p_size, coalesce(n_lines, 0) AS n_lines, coalesce(n_returned, 0) AS n_returned,
  coalesce(n_suppliers, 0) AS n_suppliers, revenue, CAST(last_ship AS VARCHAR) AS last_ship
FROM part FULL OUTER JOIN a ON p_partkey = l_partkey
""")
def part_hub(spark: SparkSession, d: str) -> DataFrame:
    """Full outer hub: every item with the counters of its facts."""
    a = table(spark, d, "lineitem").where("l_quantity > 10").groupBy("l_partkey").agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.count_distinct("l_suppkey").alias("n_suppliers"),
        agg.money("l_extendedprice").alias("revenue"), F.max(F.col("l_shipdate").cast("date")).cast("string").alias("last_ship"),
    )
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return p.join(a, F.col("p_partkey") == F.col("l_partkey"), "full").select(F.coalesce("p_partkey", "l_partkey").alias("partkey"), "p_brand", "p_size", *map(zero, ("n_lines", "n_returned", "n_suppliers")), "revenue", "last_ship")


@plan("""
SELECT o_orderkey, l_linenumber, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date, c_name, c_mktsegment, l_partkey, l_extendedprice
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus IN ('F', 'P') AND l_extendedprice > 40000
""")
def order_chain(spark: SparkSession, d: str) -> DataFrame:
    """Three-way fact join on document keys; both filters reach the scans."""
    o = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "P"))
    x = table(spark, d, "lineitem").where("l_extendedprice > 40000")
    c = table(spark, d, "customer")
    return o.join(x, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey")).select(
        "o_orderkey", "l_linenumber", F.col("o_orderdate").cast("date").cast("string").alias("order_date"), "c_name", "c_mktsegment", "l_partkey", "l_extendedprice"
    )


@plan("""
WITH c AS (SELECT c_nationkey AS k, count(*) AS customers, count(*) FILTER (WHERE c_acctbal < 0) AS in_debt, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building FROM customer GROUP BY 1),
s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1),
o AS (SELECT c_nationkey AS k, count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_orders FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT coalesce(c.k, s.k, o.k) AS nationkey, n_name, coalesce(customers, 0) AS customers, coalesce(in_debt, 0) AS in_debt, coalesce(building, 0) AS building,
  coalesce(suppliers, 0) AS suppliers, coalesce(orders, 0) AS orders, coalesce(open_orders, 0) AS open_orders,
  round(100.0 * in_debt / nullif(customers, 0), 2) AS debt_pct
FROM c FULL OUTER JOIN s ON s.k = c.k FULL OUTER JOIN o ON o.k = coalesce(c.k, s.k) LEFT JOIN nation ON n_nationkey = coalesce(c.k, s.k, o.k)
""")
def segment_stats(spark: SparkSession, d: str) -> DataFrame:
    """Three-way full outer join of per-area counters on a coalesced key."""
    cust = table(spark, d, "customer")
    c = agg.counters(cust, ["c_nationkey"], {"in_debt": F.col("c_acctbal") < 0, "building": F.col("c_mktsegment") == "BUILDING"}).withColumnsRenamed({"c_nationkey": "k", "total": "customers"})
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    per = agg.counters(table(spark, d, "orders"), ["o_custkey"], {"open": F.col("o_orderstatus") == "O"})  # before the join: fewer rows to match
    o = per.join(cust, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("total").alias("orders"), F.sum("open").alias("open_orders"))
    j = c.join(s, "k", "full").join(o, "k", "full").join(F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")), "k", "left")
    names = ("customers", "in_debt", "building", "suppliers", "orders", "open_orders")
    return j.select(F.col("k").alias("nationkey"), "n_name", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names], F.round(100 * ratio(F.col("in_debt"), F.col("customers")), 2).alias("debt_pct"))


@plan("""
WITH u AS (SELECT o_orderpriority, o_orderstatus, o_totalprice, 'history' AS part FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'
  UNION ALL SELECT o_orderpriority, o_orderstatus, o_totalprice, 'current' FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
SELECT o_orderpriority, CAST(regexp_extract(o_orderpriority, '[0-9]+') AS INTEGER) AS level, count(*) AS total, count(*) FILTER (WHERE part = 'current') AS current_orders,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM u GROUP BY 1, 2
""")
def union_stats(spark: SparkSession, d: str) -> DataFrame:
    """UNION ALL of a historic and a current slice, then pivot-style counters."""
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate")
    u = o.where("o_orderdate < timestamp_ntz '1998-01-01'").withColumn("part", F.lit("history")).unionByName(o.where("o_orderdate >= timestamp_ntz '1998-01-01'").withColumn("part", F.lit("current")))
    flags = {"current_orders": F.col("part") == "current", "finished": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 200000}
    return agg.counters(u, ["o_orderpriority"], flags).withColumn("level", F.regexp_extract("o_orderpriority", "[0-9]+", 0).try_cast("int"))


@plan("""
SELECT 'orders' AS section, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_amount, CAST(NULL AS DOUBLE) AS avg_size FROM orders
UNION ALL SELECT 'parts', CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), CAST(sum(p_size) AS DOUBLE) / count(*) FROM part
UNION ALL SELECT 'customers', CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(*), NULL FROM customer
""")
def city_averages(spark: SparkSession, d: str) -> DataFrame:
    """Tagged sections of averages, padded with nulls."""
    def part(name: str, section: str, amount: str, size: str | None = None) -> DataFrame:
        avg_size = F.sum(size).cast("double") / F.count("*") if size else F.lit(None).cast("double")
        return table(spark, d, name).agg((agg.money(amount) / F.count("*")).alias("avg_amount"), avg_size.alias("avg_size")).select(F.lit(section).alias("section"), "avg_amount", "avg_size")

    return part("orders", "orders", "o_totalprice").union(part("part", "parts", "p_retailprice", "p_size")).union(part("customer", "customers", "c_acctbal"))


@plan("""
SELECT event_type, user_id % 10 AS cohort, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN value > 50 THEN user_id END) AS big_users,
  bool_or(value > 99) AS any_top, max(CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 THEN value END) AS max_even
FROM events GROUP BY 1, 2 HAVING count(*) > 5
""")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    """Filtered distinct counts, bool_or, a conditional maximum, HAVING."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    return e.groupBy("event_type", (F.col("user_id") % 10).alias("cohort")).agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("big_users"),
        F.bool_or(F.col("value") > 99).alias("any_top"), F.max(F.when(k % 2 == 0, F.col("value"))).alias("max_even"),
    ).where("n > 5")


@plan("""
SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS status_o, count(*) FILTER (WHERE l_linestatus = 'F') AS status_f FROM lineitem GROUP BY 1
""")
def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).count().select(
        "l_returnflag", F.coalesce("O", F.lit(0)).alias("status_o"), F.coalesce("F", F.lit(0)).alias("status_f")
    )


@plan("""
SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, array_to_string(list_sort(list(DISTINCT substr(n_name, 1, 1))), '|') AS initials, count(*) AS n FROM nation GROUP BY 1
""")
def string_agg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").groupBy("n_regionkey").agg(
        F.expr("listagg(n_name, ', ') within group (order by n_name)").alias("names"), F.array_join(F.sort_array(F.collect_set(F.substring("n_name", 1, 1))), "|").alias("initials"), F.count("*").alias("n")
    )


@plan("""
SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS decade, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2
""")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").where(k.isNotNull()).groupBy("event_type", F.floor(k / 10).cast("long").alias("decade")).agg(F.count("*").alias("n"))


@plan("""
WITH c AS (UNPIVOT (SELECT count(event_id) AS event_id, count(ts) AS ts, count(user_id) AS user_id, count(event_type) AS event_type, count(value) AS value, count(props) AS props FROM events)
  ON event_id, ts, user_id, event_type, value, props INTO NAME column_name VALUE filled), n AS (SELECT count(*) AS n FROM events)
SELECT column_name, n AS row_count, round(100.0 * (n - filled) / nullif(n, 0), 2) AS null_pct, coalesce(100.0 * (n - filled) / nullif(n, 0) > 50, false) AS mostly_null FROM c, n
""")
def profile_nulls(spark: SparkSession, d: str) -> DataFrame:
    return agg.null_profile(table(spark, d, "events"))


@plan("SELECT event_type, count(*) AS freq FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY freq DESC, event_type LIMIT 20")
def freq_items(spark: SparkSession, d: str) -> DataFrame:
    return agg.frequent_items(table(spark, d, "events"), "event_type")


@plan("""
SELECT quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS p75,
  quantile_cont(l_extendedprice, 0.95) AS p95, quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem
""")
def quantiles_exact(spark: SparkSession, d: str) -> DataFrame:
    return agg.exact_quantiles(table(spark, d, "lineitem"), "l_extendedprice")


@plan()
def quantiles_sketch(spark: SparkSession, d: str) -> DataFrame:
    return agg.approx_quantiles(table(spark, d, "lineitem"), "l_extendedprice")


@plan()
def distinct_sketch(spark: SparkSession, d: str) -> DataFrame:
    return agg.approx_distinct(table(spark, d, "events"), "user_id")


@plan("""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders),
b AS (SELECT q1 - 1.0 * (q3 - q1) AS lower_bound, q3 + 1.0 * (q3 - q1) AS upper_bound FROM q)
SELECT o_orderkey, o_totalprice, lower_bound, upper_bound, CASE WHEN o_totalprice < lower_bound THEN 'low_outlier' ELSE 'high_outlier' END AS outlier_flag
FROM orders, b WHERE o_totalprice < lower_bound OR o_totalprice > upper_bound
""")
def iqr_outliers(spark: SparkSession, d: str) -> DataFrame:
    return agg.iqr_outliers(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 1.0)


@plan("""
SELECT l_shipmonth, n, users FROM (SELECT date_trunc('month', CAST(l_shipdate AS DATE)) AS m, strftime(l_shipdate, '%Y-%m') AS l_shipmonth, count(*) AS n, count(DISTINCT l_suppkey) AS users FROM lineitem GROUP BY ALL)
""")
def group_by_all(spark: SparkSession, d: str) -> DataFrame:
    """GROUP BY ALL through SQL text."""
    return spark.sql("SELECT date_format(l_shipdate, 'yyyy-MM') AS l_shipmonth, count(*) AS n, count(DISTINCT l_suppkey) AS users FROM {x} GROUP BY ALL", x=table(spark, d, "lineitem"))


@plan("""
SELECT k, md5(k) AS fingerprint, source FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k, 'orders' AS source FROM orders UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'customer' FROM customer UNION ALL SELECT s_name, 'supplier' FROM supplier)
""")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Row fingerprints of several tables' keys."""
    from functools import reduce

    parts = [table(spark, d, t).select(F.col(c).cast("string").alias("k"), F.md5(F.col(c).cast("string")).alias("fingerprint"), F.lit(t).alias("source")) for t, c in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("supplier", "s_name"))]
    return reduce(DataFrame.unionByName, parts)


@plan("""
WITH w AS (SELECT l_suppkey, 'sales' AS kind, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1
  UNION ALL SELECT l_suppkey, 'returns', CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), count(*) FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT s_name, kind, amount, n FROM w JOIN supplier ON s_suppkey = l_suppkey WHERE amount > 1000000
""")
def money_trail(spark: SparkSession, d: str) -> DataFrame:
    """Union of per-source sums per party. One pass: the source is a grouping key, not a second scan."""
    x = table(spark, d, "lineitem").groupBy("l_suppkey", F.when(F.col("l_returnflag") == "R", "returns").otherwise("sales").alias("kind")).agg(agg.money("l_extendedprice").alias("amount"), F.count("*").alias("n"))
    return x.where("amount > 1000000").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select("s_name", "kind", "amount", "n")
