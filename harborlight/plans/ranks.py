"""Percentiles, latest rows, flips, grids, deviations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.catalog import table
from harborlight.functions.exprs import month_number, ordinal, ratio
from harborlight.operators import anomaly, ranking
from harborlight.plans.registry import plan
from harborlight.storage import stored


@plan("""
WITH c AS (SELECT l_suppkey, count(*) AS lines, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_linestatus = 'O') AS open, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1)
SELECT l_suppkey, lines, returned, percent_rank() OVER (ORDER BY lines) AS lines_pctile, percent_rank() OVER (ORDER BY returned) AS returned_pctile,
  percent_rank() OVER (ORDER BY open) AS open_pctile, percent_rank() OVER (ORDER BY parts) AS parts_pctile FROM c
""")
def pctile_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Four metrics of each owner, ranked over all owners in one pass. The counts per owner are stored: every rank reads them."""
    x = table(spark, d, "lineitem")
    per = x.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_linestatus") == "O").alias("o"))
    c = stored(per.groupBy("l_suppkey").agg(F.sum("n").alias("lines"), F.sum("r").alias("returned"), F.sum("o").alias("open"), F.count("*").alias("parts")), "owner-metrics")
    metrics = ("lines", "returned", "open", "parts")
    return ranking.global_percent_ranks(c, {m: f"{m}_pctile" for m in metrics}).select("l_suppkey", "lines", "returned", *[f"{m}_pctile" for m in metrics])


@plan("SELECT p_partkey, p_retailprice, percent_rank() OVER (ORDER BY p_retailprice) AS pctile FROM part")
def pctile_parts(spark: SparkSession, d: str) -> DataFrame:
    return ranking.global_percent_rank(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "pctile")


@plan("""
WITH p AS (SELECT o_orderkey, o_totalprice, percent_rank() OVER (ORDER BY o_totalprice) AS r FROM orders), q AS (SELECT *, CAST(floor(r * 100) AS BIGINT) AS pctile FROM p)
SELECT o_orderkey, pctile, CAST(pctile AS VARCHAR) || CASE WHEN pctile % 100 BETWEEN 11 AND 13 THEN 'th' WHEN pctile % 10 = 1 THEN 'st' WHEN pctile % 10 = 2 THEN 'nd' WHEN pctile % 10 = 3 THEN 'rd' ELSE 'th' END AS label FROM q
""")
def pctile_orders(spark: SparkSession, d: str) -> DataFrame:
    p = ranking.global_percent_rank(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "r")
    return p.withColumn("pctile", F.floor(F.col("r") * 100).cast("long")).select("o_orderkey", "pctile", ordinal(F.col("pctile")).alias("label"))


@plan("""
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1
""")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The latest row per key as one aggregation (max_by over a total order), not a sort per key."""
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("m")).select("o_custkey", "m.o_orderkey", "m.o_totalprice")


@plan("SELECT DISTINCT ON (p_brand) p_brand, p_partkey, p_retailprice FROM part ORDER BY p_brand, p_retailprice DESC, p_partkey")
def distinct_on(spark: SparkSession, d: str) -> DataFrame:
    return ranking.latest(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], F.col("p_retailprice").desc(), F.col("p_partkey"))


@plan("""
WITH s AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS sold, o_totalprice, lag(o_totalprice) OVER w AS prev_price, lag(CAST(o_orderdate AS DATE)) OVER w AS prev_date FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey)),
m AS (SELECT *, (year(sold) * 12 + month(sold)) - (year(prev_date) * 12 + month(prev_date)) AS months, round(100 * (o_totalprice - prev_price) / prev_price, 2) AS profit_pct FROM s)
SELECT o_custkey, o_orderkey, CAST(sold AS VARCHAR) AS sold, o_totalprice, prev_price, CAST(prev_date AS VARCHAR) AS prev_date, months, profit_pct FROM m WHERE prev_price > 0 AND months <= 24 AND o_totalprice >= 1.2 * prev_price
""")
def price_flips(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("sold"), "o_totalprice")
    return ranking.flips(o, "o_custkey", "sold", "o_totalprice", "o_orderkey").withColumns({c: F.col(c).cast("string") for c in ("sold", "prev_date")})


@plan("""
WITH q AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-10-01', INTERVAL 3 MONTH)) AS DATE) AS quarter),
g AS (SELECT n_nationkey, quarter FROM nation, q),
f AS (SELECT c_nationkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, count(*) AS orders, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
first AS (SELECT c_nationkey, quarter, count(*) AS new_customers FROM (SELECT c_nationkey, o_custkey, min(CAST(date_trunc('quarter', o_orderdate) AS DATE)) AS quarter FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) GROUP BY 1, 2)
SELECT g.n_nationkey, CAST(g.quarter AS VARCHAR) AS quarter, coalesce(orders, 0) AS orders, coalesce(urgent, 0) AS urgent, coalesce(new_customers, 0) AS new_customers, CAST(urgent AS DOUBLE) / nullif(orders, 0) AS urgent_share
FROM g LEFT JOIN f ON f.c_nationkey = g.n_nationkey AND f.quarter = g.quarter LEFT JOIN first ON first.c_nationkey = g.n_nationkey AND first.quarter = g.quarter
""")
def quarter_grid(spark: SparkSession, d: str) -> DataFrame:
    """Dense grid of areas and quarters, facts and first-event cohorts joined onto it."""
    grid = ranking.quarter_grid(table(spark, d, "nation"), "n_nationkey", "1995-01-01", "2001-10-01")
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", F.date_trunc("quarter", "o_orderdate").cast("date").alias("quarter"))
    # Per customer first, so that the join with customers has one row per customer and quarter, and the cohort needs no second join.
    per = o.groupBy("o_custkey", "quarter").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    at = per.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey")
    facts = at.groupBy("n_nationkey", "quarter").agg(F.sum("n").alias("orders"), F.sum("u").alias("urgent"))
    first = at.groupBy("n_nationkey", "o_custkey").agg(F.min("quarter").alias("quarter")).groupBy("n_nationkey", "quarter").agg(F.count("*").alias("new_customers"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return grid.join(facts, ["n_nationkey", "quarter"], "left").join(first, ["n_nationkey", "quarter"], "left").select("n_nationkey", F.col("quarter").cast("string").alias("quarter"), zero("orders"), zero("urgent"), zero("new_customers"), ratio(F.col("urgent"), F.col("orders")).alias("urgent_share"))


@plan("""
WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT c_nationkey, c_mktsegment AS main_segment, n AS weight FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS rn FROM c) WHERE rn = 1
""")
def crosswalk_mode(spark: SparkSession, d: str) -> DataFrame:
    return ranking.modal(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", "main_segment")


@plan("""
SELECT c_custkey, (SELECT o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS last_price,
  (SELECT o_orderstatus FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS last_status FROM customer
""")
def correlated_top1(spark: SparkSession, d: str) -> DataFrame:
    """Correlated top-1 lookups as one aggregation and a left join."""
    m = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus")).alias("m"))
    return table(spark, d, "customer").select("c_custkey").join(m, "c_custkey", "left").select("c_custkey", F.col("m.o_totalprice").alias("last_price"), F.col("m.o_orderstatus").alias("last_status"))


@plan("""
SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS has_return,
  EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY) AS shipped_soon FROM orders
""")
def exists_flags(spark: SparkSession, d: str) -> DataFrame:
    """EXISTS as columns: one join, then one aggregation of both conditions."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_shipdate")
    soon = F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 30 days"))
    return o.join(x, "o_orderkey", "left").groupBy("o_orderkey").agg(F.coalesce(F.bool_or(F.col("l_returnflag") == "R"), F.lit(False)).alias("has_return"), F.coalesce(F.bool_or(soon), F.lit(False)).alias("shipped_soon"))


@plan("""
SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
WHERE abs(a.p_size - b.p_size) <= 2 AND b.p_retailprice BETWEEN a.p_retailprice - 50 AND a.p_retailprice + 50
""")
def range_twins(spark: SparkSession, d: str) -> DataFrame:
    """Pairs alike in kind and close in two measures: an equi-join on kind and price band (and its neighbours), then the exact test."""
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_brand", "p_size", "p_retailprice", F.floor(F.col("p_retailprice") / 50).alias("band"))
    near = p.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    on = "a.p_type = b.p_type and a.p_brand = b.p_brand and a.band = b.band and a.p_partkey < b.p_partkey and abs(a.p_size - b.p_size) <= 2 and b.p_retailprice between a.p_retailprice - 50 and a.p_retailprice + 50"
    return near.alias("a").join(p.alias("b"), F.expr(on)).select(F.expr("a.p_partkey").alias("a"), F.expr("b.p_partkey").alias("b"))


@plan("""
WITH n AS (SELECT event_type || '-' || CAST(user_id % 5 AS VARCHAR) AS grp, ts FROM events),
cur AS (SELECT grp, count(*) AS current_count FROM n WHERE CAST(ts AS DATE) > DATE '2024-01-23' AND CAST(ts AS DATE) <= DATE '2024-01-30' GROUP BY 1),
b AS (SELECT grp, date_trunc('day', ts) AS b, count(*) AS n FROM n WHERE CAST(ts AS DATE) > DATE '2024-01-02' AND CAST(ts AS DATE) <= DATE '2024-01-23' GROUP BY 1, 2),
s AS (SELECT grp, avg(n) AS mean, stddev_samp(n) AS sd FROM b GROUP BY 1 HAVING stddev_samp(n) <> 0)
SELECT grp, current_count, round(mean, 1) AS baseline_avg, round((current_count - mean) / sd, 2) AS z_score, round(100 * (current_count - mean) / mean, 1) AS pct_change, CASE WHEN current_count > mean THEN 'up' ELSE 'down' END AS direction
FROM cur JOIN s USING (grp) WHERE abs((current_count - mean) / sd) >= 2 ORDER BY abs(round((current_count - mean) / sd, 2)) DESC, grp LIMIT 20
""")
def anomalies_weekly(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.concat_ws("-", "event_type", (F.col("user_id") % 5).cast("string")).alias("grp"), "ts")
    return anomaly.deviations(e, "grp", "ts", F.lit("2024-01-30").cast("date"), 7, 21, "day")


@plan("""
WITH m AS (SELECT o_orderkey, (year(o_orderdate) * 12 + month(o_orderdate)) - (1995 * 12 + 1) AS months_since, hour(o_orderdate) AS hr, isodow(o_orderdate) AS dow, CAST(date_trunc('week', o_orderdate) AS DATE) AS week FROM orders)
SELECT CAST(week AS VARCHAR) AS week, dow, count(*) AS n, CAST(min(months_since) AS BIGINT) AS first_month, CAST(max(hr) AS BIGINT) AS last_hour FROM m GROUP BY 1, 2
""")
def calendar_parts(spark: SparkSession, d: str) -> DataFrame:
    """Date truncation, parts and month differences by calendar boundary."""
    t = F.col("o_orderdate")
    o = table(spark, d, "orders").select((month_number(t) - (1995 * 12 + 1)).alias("months_since"), F.hour(t).cast("long").alias("hr"), (F.weekday(t) + 1).cast("long").alias("dow"), F.date_trunc("week", t).cast("date").alias("week"))
    return o.withColumn("week", F.col("week").cast("string")).groupBy("week", "dow").agg(F.count("*").alias("n"), F.min("months_since").alias("first_month"), F.max("hr").alias("last_hour"))


@plan("""
SELECT k, CASE WHEN (src IS NOT NULL AND src > lake AND (lake = 0 OR src - lake > 0.05 * greatest(lake, 1) OR src - lake > 1000)) OR coalesce(upd > cur, false) THEN 'stale' WHEN src IS NULL AND upd IS NULL THEN 'unknown' ELSE 'synced' END AS status
FROM (SELECT o_orderkey AS k, o_orderkey % 3000 AS lake, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey * 37) % 3500 END AS src, o_orderdate AS cur, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + INTERVAL 1 DAY * (o_orderkey % 3 - 1) END AS upd FROM orders)
""")
def freshness_status(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    shifted = F.expr("o_orderdate + (o_orderkey % 3 - 1) * interval '1' day")
    return table(spark, d, "orders").select(k.alias("k"), anomaly.sync_status(k % 3000, F.when(k % 7 != 0, k * 37 % 3500), t, F.when(k % 5 != 0, shifted)).alias("status"))


@plan("""
SELECT k, CASE WHEN w = 0 THEN 1e0 ELSE round(v / w, 3) END AS confidence FROM (SELECT k,
  0e0 + CASE WHEN h IS NOT NULL THEN 40e-2 ELSE 0e0 END + CASE WHEN e > 0 THEN 25e-2 ELSE 0e0 END + CASE WHEN p IS NOT NULL THEN 20e-2 ELSE 0e0 END + CASE WHEN q IS NOT NULL THEN 15e-2 ELSE 0e0 END AS w,
  0e0 + CASE WHEN h IS NULL THEN 0e0 WHEN h <= 24 THEN 1e0 * 40e-2 WHEN h <= 168 THEN 85e-2 * 40e-2 WHEN h <= 720 THEN 6e-1 * 40e-2 ELSE 2e-1 * 40e-2 END + CASE WHEN e > 0 THEN least(r / e, 1e0) * 25e-2 ELSE 0e0 END + coalesce(p * 20e-2, 0e0) + coalesce(q * 15e-2, 0e0) AS v
  FROM (SELECT event_id AS k, CASE WHEN event_id % 4 <> 0 THEN event_id % 1000 END AS h, CAST(event_id % 50 AS DOUBLE) AS r, CAST(event_id % 40 AS DOUBLE) AS e, CASE WHEN event_id % 3 = 0 THEN (event_id % 64) / 67e0 END AS p, CASE WHEN event_id % 6 = 1 THEN 513e-3 END AS q FROM events))
""")
def confidence_scores(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    score = anomaly.confidence(F.when(k % 4 != 0, k % 1000), (k % 50).cast("double"), (k % 40).cast("double"), F.when(k % 3 == 0, (k % 64) / 67.0), F.when(k % 6 == 1, F.lit(0.513)))
    return table(spark, d, "events").select(k.alias("k"), score.alias("confidence"))
