"""Queries on the driver tables: scans, joins, aggregates, windows, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.constants import AGE_BANDS
from panelspark.functions.scalars import (
    band_label, band_midpoint, band_start, band_stop, civil_micros, clamp, complement_product, grid_key, grid_key_parts,
    leading_number, product, ratio, recode,
)
from panelspark.operators.audit import audit, key_coverage, null_counts, unmatched_keys
from panelspark.operators.interp import gap_fill
from panelspark.operators.joins import (
    anti_filter, band_join, bounded, complete_grid, interval_join, pivot_unique, semi_filter, stack, unpivot, with_values,
)
from panelspark.operators.report import baseline_join
from panelspark.operators.windows import best_row, previous, running_total, with_group_aggs
from panelspark.plans.registry import CELLS, FACTS, query, r, round_cols, rounded
from panelspark.sources.tables import CAUSES, SEXES, YEARS, cells, line_facts, table, year_of


@query("q01_scan_filter_project", f"""
SELECT l_orderkey AS order_key, l_linenumber AS line_no, CAST(year(l_shipdate) AS INTEGER) AS ship_year,
       {r("l_extendedprice * (1e0 - l_discount)")} AS net,
       {r("l_extendedprice * (1e0 - l_discount) * (1e0 + l_tax)")} AS gross
FROM lineitem
WHERE l_returnflag = 'R' AND l_quantity BETWEEN 10 AND 20
  AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'""")
def q01(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    kept = li.filter(
        (F.col("l_returnflag") == "R")
        & F.col("l_quantity").between(10, 20)
        & (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp"))
        & (F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp"))
    )
    out = kept.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    out = out.withColumn("gross", F.col("net") * (1 + F.col("l_tax")))
    return out.select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"),
        year_of("l_shipdate").alias("ship_year"), rounded("net").alias("net"), rounded("gross").alias("gross"),
    )


@query("q02_conditional_update_clamp", f"""
WITH {FACTS}, s AS (
  SELECT location, cause, sum(value) FILTER (WHERE year = 1996) AS v0, sum(value) FILTER (WHERE year = 1997) AS v1
  FROM facts GROUP BY location, cause),
g AS (SELECT location, cause, (v1 - v0) / nullif(v0, 0) AS change FROM s)
SELECT location, cause, {r("change")} AS change,
       {r("CASE WHEN change IS NULL THEN 0e0 WHEN change < 0 THEN 0e0 WHEN change > 1 THEN 0.99e0 ELSE change END")} AS clamped,
       CASE WHEN change < 0 THEN 'down' WHEN change > 1 THEN 'capped' WHEN change IS NULL THEN 'none' ELSE 'up' END AS kind
FROM g""")
def q02(spark: SparkSession, d: str) -> DataFrame:
    def in_year(y):
        return F.sum(F.when(F.col("year") == y, F.col("value")))
    s = line_facts(spark, d).groupBy("location", "cause").agg(in_year(1996).alias("v0"), in_year(1997).alias("v1"))
    s = s.withColumn("change", ratio(F.col("v1") - F.col("v0"), "v0"))
    kind = (
        F.when(F.col("change") < 0, "down").when(F.col("change") > 1, "capped")
        .when(F.col("change").isNull(), "none").otherwise("up")
    )
    out = s.withColumn("clamped", clamp("change", 0, 1, 0, 0.99, 0.0)).withColumn("kind", kind)
    return round_cols(out.select("location", "cause", "change", "clamped", "kind"))


@query("q03_band_labels", f"""
WITH b AS (
  SELECT CASE WHEN p_size < 5 THEN '<5 years' WHEN p_size < 10 THEN '5-9 years'
              ELSE CAST(p_size // 5 * 5 AS VARCHAR) || '-' || CAST(p_size // 5 * 5 + 4 AS VARCHAR) || ' years' END AS band,
         CASE WHEN p_type = 'ECONOMY' THEN 'Economy' ELSE p_type END AS kind, p_size, p_retailprice
  FROM part)
SELECT band, kind, count(*) AS n_parts, {r("sum(p_retailprice)", 2)} AS price,
       CAST(min(p_size // 5 * 5) AS INTEGER) AS band_start, CAST(min(p_size // 5 * 5 + 4) AS INTEGER) AS band_stop,
       CAST(min(p_size // 5 * 5 + 2) AS DOUBLE) AS midpoint,
       TRY_CAST(substring(band, 1, 2) AS INTEGER) AS leading_digits
FROM b GROUP BY band, kind""")
def q03(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(
        band_label("p_size").alias("band"), recode("p_type", {"ECONOMY": "Economy"}).alias("kind"), "p_retailprice"
    )
    g = p.groupBy("band", "kind").agg(F.count(F.lit(1)).alias("n_parts"), rounded(F.sum("p_retailprice"), 2).alias("price"))
    return g.withColumns({
        "band_start": band_start("band"), "band_stop": band_stop("band"), "midpoint": band_midpoint("band"),
        "leading_digits": leading_number("band"),
    })


@query("q04_null_fill_dropna", f"""
WITH y AS (SELECT o_custkey, sum(o_totalprice) AS spent, count(*) AS n FROM orders
           WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY o_custkey),
j AS (SELECT c_mktsegment AS segment, spent, n FROM customer LEFT JOIN y ON c_custkey = o_custkey)
SELECT segment, count(*) AS customers, {r("sum(coalesce(spent, 0))", 2)} AS filled_spend,
       count(*) FILTER (WHERE spent IS NOT NULL AND n IS NOT NULL) AS complete_rows
FROM j GROUP BY segment""")
def q04(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter(
        (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp"))
        & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))
    )
    y = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"), F.count(F.lit(1)).alias("n"))
    j = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")).join(y, "c_custkey", "left")
    filled = j.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"), rounded(F.sum(F.coalesce("spent", F.lit(0.0))), 2).alias("filled_spend")
    )
    whole = j.dropna("any").groupBy("segment").agg(F.count(F.lit(1)).alias("complete_rows"))
    return filled.join(whole, "segment", "left").withColumn("complete_rows", F.coalesce("complete_rows", F.lit(0).cast("long")))


@query("q05_distinct_keys", """
SELECT DISTINCT p_brand AS brand, l_returnflag AS flag, CAST(year(l_shipdate) AS INTEGER) AS ship_year
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def q05(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("flag"), year_of("l_shipdate").alias("ship_year")
    ).distinct()  # repeated keys go before the join, not after
    return li.join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand")), "p_partkey").select(
        "brand", "flag", "ship_year").distinct()


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("q06_inner_measures_pivoted", f"""
WITH s AS (SELECT user_id, event_type, round(sum(value), 2) AS v FROM events GROUP BY user_id, event_type),
w AS (SELECT user_id, {", ".join(f"max(CASE WHEN event_type = '{t}' THEN v END) AS {t}" for t in EVENT_TYPES)}
      FROM s GROUP BY user_id)
SELECT user_id, {", ".join(r(t, 2) + f" AS {t}" for t in EVENT_TYPES)} FROM w
WHERE {" AND ".join(f"{t} IS NOT NULL" for t in EVENT_TYPES)}""")
def q06(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy("user_id", "event_type").agg(rounded(F.sum("value"), 2).alias("v"))
    return round_cols(pivot_unique(s, ["user_id"], "event_type", "v", EVENT_TYPES).dropna("any"), 2)


@query("q07_inner_left_right_full", f"""
WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS v95 FROM orders WHERE year(o_orderdate) = 1995 GROUP BY o_custkey),
b AS (SELECT o_custkey AS k, sum(o_totalprice) AS v96 FROM orders WHERE year(o_orderdate) = 1996 GROUP BY o_custkey),
f AS (SELECT coalesce(a.k, b.k) AS k, v95, v96 FROM a FULL JOIN b ON a.k = b.k),
c AS (SELECT f.*, c_nationkey AS nk FROM f LEFT JOIN customer ON f.k = c_custkey),
n AS (SELECT n_name AS nation, n_nationkey, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n.nation, n.region, count(c.k) AS customers, count(v95) AS with_1995, count(v96) AS with_1996,
       {r("sum(v95)", 2)} AS v95, {r("sum(v96)", 2)} AS v96
FROM c RIGHT JOIN n ON c.nk = n.n_nationkey GROUP BY n.nation, n.region""")
def q07(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), year_of("o_orderdate").alias("y"), "o_totalprice")
    def total(y, name):
        return o.filter(F.col("y") == y).groupBy("k").agg(F.sum("o_totalprice").alias(name))
    f = total(1995, "v95").join(total(1996, "v96"), "k", "full")
    c = f.join(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n_nationkey")), "k", "left")
    n = table(spark, d, "nation").join(
        table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey"
    ).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return c.join(n, "n_nationkey", "right").groupBy("nation", "region").agg(
        F.count("k").alias("customers"), F.count("v95").alias("with_1995"), F.count("v96").alias("with_1996"),
        rounded(F.sum("v95"), 2).alias("v95"), rounded(F.sum("v96"), 2).alias("v96"),
    )


BANDS = [("young", 1, 25, 0.5), ("old", 26, 50, 0.25), ("all", 1, 50, 0.125)]


@query("q08_cross_band_join", f"""
WITH bands(band, start, stop, w) AS (VALUES {", ".join(f"('{b}', {x}, {y}, {w}e0)" for b, x, y, w in BANDS)}),
s AS (SELECT band, w, p_brand AS brand, count(*) AS n, sum(p_retailprice) AS price
      FROM part JOIN bands ON p_size BETWEEN start AND stop GROUP BY band, w, p_brand)
SELECT band, brand, CAST(y AS INTEGER) AS year, n AS n_parts, {r("price * w * (y - 2023)")} AS phased
FROM s, range(2024, 2028) t(y)""")
def q08(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame(BANDS, "band string, start int, stop int, w double")
    j = band_join(table(spark, d, "part").withColumnRenamed("p_size", "age"), "age", bands)
    s = j.groupBy("band", "w", F.col("p_brand").alias("brand")).agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("p_retailprice").alias("price")
    )
    out = with_values(s, "year", range(2024, 2028))
    return out.select("band", "brand", "year", "n_parts", rounded(F.col("price") * F.col("w") * (F.col("year") - 2023)).alias("phased"))


@query("q08b_interval_join", f"""
WITH e AS (SELECT user_id, epoch(ts) AS t, value FROM events),
i AS (SELECT o_orderkey, o_custkey AS user_id, 1704067200e0 + dayofyear(o_orderdate) * 7200e0 AS start,
             1704067200e0 + dayofyear(o_orderdate) * 7200e0 + o_totalprice AS stop FROM orders)
SELECT o_orderkey, count(*) AS n_events, {r("sum(value)", 2)} AS value, {r("min(t - start)", 3)} AS first_after
FROM e JOIN i ON e.user_id = i.user_id AND e.t BETWEEN i.start AND i.stop GROUP BY o_orderkey""")
def q08b(spark: SparkSession, d: str) -> DataFrame:
    """Events of a customer inside the stretch of time of each order, on real-valued seconds."""
    e = table(spark, d, "events").select("user_id", (civil_micros("ts") / F.lit(1e6)).alias("t"), "value")
    start = F.lit(1704067200.0) + F.dayofyear("o_orderdate") * F.lit(7200.0)
    i = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), start.alias("start"), (start + F.col("o_totalprice")).alias("stop"))
    j = interval_join(e, "t", i, "start", "stop", on=["user_id"], resolution=1e-2)
    return j.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_events"), rounded(F.sum("value"), 2).alias("value"),
                                       rounded(F.min(F.col("t") - F.col("start")), 3).alias("first_after"))


@query("q10_semi_anti", """
WITH late AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'),
x AS (SELECT 'kept' AS tag, c_nationkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM late WHERE o_custkey = c_custkey)
      UNION ALL
      SELECT 'lost', c_nationkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM late WHERE o_custkey = c_custkey))
SELECT tag, c_nationkey AS nation, count(*) AS customers FROM x
WHERE c_mktsegment NOT IN ('BUILDING') GROUP BY tag, c_nationkey""")
def q10(spark: SparkSession, d: str) -> DataFrame:
    late = table(spark, d, "orders").filter(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp")).select(
        F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").filter(~F.col("c_mktsegment").isin("BUILDING"))
    both = stack(
        semi_filter(c, late, ["c_custkey"]).withColumn("tag", F.lit("kept")),
        anti_filter(c, late, ["c_custkey"]).withColumn("tag", F.lit("lost")),
    )
    return both.groupBy("tag", F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))


@query("q11_baseline_join", f"""
WITH s AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS scenario, sum(o_totalprice) AS total
           FROM orders GROUP BY 1, 2)
SELECT s.year, s.scenario, {r("s.total", 2)} AS total, {r("b.total", 2)} AS base_total,
       {r("b.total - s.total", 2)} AS difference, 'priority' AS dimension
FROM s JOIN s b ON s.year = b.year AND b.scenario = '5-LOW'""")
def q11(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").groupBy(year_of("o_orderdate").alias("year"), F.col("o_orderpriority").alias("scenario")).agg(
        F.sum("o_totalprice").alias("total"))
    out = baseline_join(s, ["year"], "scenario", "5-LOW", ["total"]).withColumn("dimension", F.lit("priority"))
    return round_cols(out.withColumn("difference", F.col("base_total") - F.col("total")), 2)


@query("q12_grid_completion", f"""
WITH s AS (SELECT o_custkey AS cust, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS spent, count(*) AS n
           FROM orders GROUP BY 1, 2)
SELECT g.c_custkey AS cust, CAST(g.year AS INTEGER) AS year, {r("coalesce(spent, 0)", 2)} AS spent, coalesce(n, 0) AS n_orders
FROM (SELECT c_custkey, year FROM customer, range(1995, 2002) t(year)) g
LEFT JOIN s ON s.cust = g.c_custkey AND s.year = g.year""")
def q12(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cust"), year_of("o_orderdate").alias("year")).agg(
        F.sum("o_totalprice").alias("spent"), F.count(F.lit(1)).alias("n_orders"))
    everyone = table(spark, d, "customer").select(F.col("c_custkey").alias("cust"))
    return round_cols(complete_grid(s, ["cust"], {"year": YEARS}, ["spent", "n_orders"], everyone), 2)


RISK_SQL = """risk AS (SELECT l_linestatus AS sex, l_returnflag AS category, l_linenumber AS outcome, 1e0 + 10e0 * avg(l_tax) AS rr
           FROM lineitem GROUP BY 1, 2, 3)"""


def risk_table(spark: SparkSession, d: str) -> DataFrame:
    """Relative risks per status, flag and line number."""
    risk = table(spark, d, "lineitem").groupBy(
        F.col("l_linestatus").alias("sex"), F.col("l_returnflag").alias("category"), F.col("l_linenumber").alias("outcome")
    ).agg((F.lit(1.0) + F.lit(10.0) * F.avg("l_tax")).alias("rr"))
    return bounded(risk, {"sex": SEXES, "category": CAUSES, "outcome": range(1, 8)})


@query("q13_many_to_many_risk", f"""
WITH {FACTS}, {RISK_SQL},
n AS (SELECT location, sex, cause AS category, count(*) AS n FROM facts GROUP BY 1, 2, 3),
s AS (SELECT *, n * 1e0 / sum(n) OVER (PARTITION BY location, sex) AS share FROM n)
SELECT location, s.sex, outcome, count(*) AS n_terms, {r("sum(share * rr)")} AS burden
FROM s JOIN risk ON s.sex = risk.sex AND s.category = risk.category GROUP BY location, s.sex, outcome""")
def q13(spark: SparkSession, d: str) -> DataFrame:
    n = line_facts(spark, d).groupBy("location", "sex", F.col("cause").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    s = with_group_aggs(n, ["location", "sex"], tot=F.sum("n")).withColumn("share", F.col("n") / F.col("tot"))
    return s.join(risk_table(spark, d), ["sex", "category"]).groupBy("location", "sex", "outcome").agg(
        F.count(F.lit(1)).alias("n_terms"), rounded(F.sum(F.col("share") * F.col("rr"))).alias("burden"))


@query("q14_group_sum_mean", f"""
SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n_lines, {r("sum(l_quantity)", 2)} AS qty,
       {r("sum(l_extendedprice)", 2)} AS price, {r("avg(l_quantity)")} AS avg_qty,
       {r("sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem)")} AS price_share
FROM lineitem GROUP BY 1, 2""")
def q14(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    whole = li.agg(F.sum("l_extendedprice"))
    g = li.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"),
        F.avg("l_quantity").alias("avg_qty"))
    return round_cols(g.withColumn("price_share", ratio("price", whole.scalar())), 6, qty=2, price=2)


@query("q15_product_complement", f"""
SELECT l_orderkey AS order_key, {r("product(1e0 - abs(l_discount) / 3e0)")} AS kept,
       {r("1e0 - product(1e0 - l_tax / 3e0)")} AS joint_tax
FROM lineitem GROUP BY l_orderkey""")
def q15(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), (F.lit(1.0) - F.abs("l_discount") / 3.0).alias("keep"), (F.col("l_tax") / 3.0).alias("x"))
    return round_cols(li.groupBy("order_key").agg(product("keep").alias("kept"), complement_product("x").alias("joint_tax")))


@query("q16_window_broadcast_sum", f"""
WITH {FACTS}, s AS (SELECT location, year, cause, sum(value) AS v, count(*) AS n FROM facts GROUP BY 1, 2, 3)
SELECT location, year, cause, n AS n_lines, CAST(sum(n) OVER w AS BIGINT) AS group_lines,
       {r("v / sum(v) OVER w")} AS value_share
FROM s WINDOW w AS (PARTITION BY location, year)""")
def q16(spark: SparkSession, d: str) -> DataFrame:
    s = line_facts(spark, d).groupBy("location", "year", "cause").agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n_lines"))
    out = with_group_aggs(s, ["location", "year"], group_lines=F.sum("n_lines"), gv=F.sum("v"))
    return out.select("location", "year", "cause", "n_lines", "group_lines", rounded(ratio("v", "gv")).alias("value_share"))


@query("q17_rmse", f"""
WITH {CELLS}
SELECT location, {r("sqrt(avg((f.n_r - o.n_r) * (f.n_r - o.n_r) * 1e0))")} AS rmse_r,
       {r("sqrt(avg((f.n_a - o.n_a) * (f.n_a - o.n_a) * 1e0))")} AS rmse_a
FROM cells f JOIN cells o USING (location, age, year) WHERE f.sex = 'F' AND o.sex = 'O' GROUP BY location""")
def q17(spark: SparkSession, d: str) -> DataFrame:
    def of(sex, c):
        return F.sum(F.when(F.col("sex") == sex, F.col(c)))
    w = cells(spark, d).groupBy("location", "age", "year").agg(
        (of("F", "n_r") - of("O", "n_r")).alias("dr"), (of("F", "n_a") - of("O", "n_a")).alias("da"))
    def rmse(c):
        return F.sqrt(F.avg(F.pow(F.col(c).cast("double"), F.lit(2.0))))
    return round_cols(w.groupBy("location").agg(rmse("dr").alias("rmse_r"), rmse("da").alias("rmse_a")))


@query("q18_argmin_per_group", f"""
WITH x AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit,
           row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice / l_quantity, l_orderkey, l_linenumber, l_suppkey) AS k
           FROM lineitem)
SELECT l_partkey AS part_key, l_suppkey AS best_supplier, l_orderkey AS order_key, {r("unit")} AS unit_price FROM x WHERE k = 1""")
def q18(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("best_supplier"), F.col("l_orderkey").alias("order_key"),
        "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))
    best = best_row(li, ["part_key"], ["unit_price", "order_key", "l_linenumber", "best_supplier"])
    return round_cols(best.drop("l_linenumber"))


@query("q19_unpivot", f"""
WITH w AS (SELECT o_custkey AS cust, {", ".join(f"sum(o_totalprice) FILTER (WHERE year(o_orderdate) = {y}) AS y{y}" for y in range(1995, 2002))}
           FROM orders GROUP BY 1)
SELECT cust, metric, {r("val", 2)} AS val FROM (UNPIVOT w ON {", ".join(f"y{y}" for y in range(1995, 2002))} INTO NAME metric VALUE val)""")
def q19(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("cust"), F.concat(F.lit("y"), F.year("o_orderdate")).alias("y"), "o_totalprice")
    names = [f"y{y}" for y in YEARS]
    wide = o.groupBy("cust").pivot("y", names).agg(F.sum("o_totalprice"))
    return round_cols(unpivot(wide, ["cust"], names, "metric", "val").filter(F.col("val").isNotNull()), 2)


@query("q20_band_sums", f"""
WITH {FACTS}
SELECT location, sex, year, cause, CAST(age // 5 AS INTEGER) AS band, count(*) AS n_lines, {r("sum(value)", 2)} AS value
FROM facts GROUP BY location, sex, year, cause, age // 5""")
def q20(spark: SparkSession, d: str) -> DataFrame:
    from panelspark.functions.scalars import band_index
    return line_facts(spark, d).groupBy("location", "sex", "year", "cause", band_index("age", 5, len(AGE_BANDS) - 1).alias("band")).agg(
        F.count(F.lit(1)).alias("n_lines"), rounded(F.sum("value"), 2).alias("value"))


@query("q21_ratio_of_sums", f"""
WITH {FACTS}
SELECT location, {r("sum(value * discount) / nullif(sum(value), 0)")} AS discount_rate,
       {r("sum(CASE WHEN cause = 'A' THEN value END) / nullif(sum(CASE WHEN cause = 'R' THEN value END), 0)")} AS a_to_r
FROM facts GROUP BY location""")
def q21(spark: SparkSession, d: str) -> DataFrame:
    def of(c):
        return F.sum(F.when(F.col("cause") == c, F.col("value")))
    return line_facts(spark, d).groupBy("location").agg(
        rounded(ratio(F.sum(F.col("value") * F.col("discount")), F.sum("value"))).alias("discount_rate"),
        rounded(ratio(of("A"), of("R"))).alias("a_to_r"))


@query("q22_lag_cumsum", f"""
SELECT event_id, event_type, lag(value) OVER w AS prev_value, {r("sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", 2)} AS cum_value
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def q22(spark: SparkSession, d: str) -> DataFrame:
    """Five long series, cut into days that are linked by one row each."""
    order = ["ts", "event_id"]
    e = table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    out = previous(e, ["event_type"], order, ["value"], block=F.to_date("ts"))
    out = running_total(out, ["event_type"], order, ["value"], block=F.to_date("ts"))
    return out.select("event_id", "event_type", "prev_value", rounded("cum_value", 2).alias("cum_value"))


@query("q22b_monthly_cumulative", f"""
WITH m AS (SELECT o_orderpriority AS priority, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS total
           FROM orders GROUP BY 1, 2)
SELECT priority, month, {r("total", 2)} AS total, {r("lag(total) OVER w", 2)} AS prev_total,
       {r("sum(total) OVER (PARTITION BY priority ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", 2)} AS cum_total
FROM m WINDOW w AS (PARTITION BY priority ORDER BY month)""")
def q22b(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").groupBy(
        F.col("o_orderpriority").alias("priority"), F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("total"))
    out = running_total(previous(m, ["priority"], ["month"], ["total"]), ["priority"], ["month"], ["total"])
    return round_cols(out, 2)


GAP_SQL = """
WITH s AS (SELECT user_id, CAST(day(ts) AS INTEGER) AS day, round(sum(value), 2) AS v FROM events GROUP BY 1, 2),
g AS (SELECT u.user_id, CAST(d.day AS INTEGER) AS day, s.v
      FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN range(1, 32) d(day)
      LEFT JOIN s ON s.user_id = u.user_id AND s.day = d.day),
w AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN day END) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pd,
             min(CASE WHEN v IS NOT NULL THEN day END) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nd FROM g),
j AS (SELECT w.user_id, w.day, w.v, pd, nd, p.v AS pv, n.v AS nv FROM w
      LEFT JOIN s p ON p.user_id = w.user_id AND p.day = w.pd LEFT JOIN s n ON n.user_id = w.user_id AND n.day = w.nd),
f AS (SELECT user_id, day, v, pv, nv, CASE WHEN v IS NOT NULL THEN v WHEN pd IS NOT NULL AND nd IS NOT NULL
             THEN pv + (nv - pv) * (day - pd) / (nd - pd) END AS line FROM j)
"""


def _daily(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(rounded(F.sum("value"), 2).alias("v"))
    return complete_grid(s, ["user_id"], {"day": range(1, 32)}, ["v"], fill=None)


@query("q23_gap_fill_linear", GAP_SQL + f"SELECT user_id, day, {r('line')} AS line, {r('coalesce(line, pv, nv)')} AS held FROM f")
def q23(spark: SparkSession, d: str) -> DataFrame:
    g = _daily(spark, d).withColumnRenamed("v", "line").withColumn("held", F.col("line"))
    out = gap_fill(g, ["user_id"], "day", ["line"])
    return round_cols(gap_fill(out, ["user_id"], "day", ["held"], hold_ends=True).select("user_id", "day", "line", "held"))


@query("q23b_gap_fill_blocked", GAP_SQL + f"SELECT user_id, day, {r('line')} AS line FROM f")
def q23b(spark: SparkSession, d: str) -> DataFrame:
    """The same line, with every series cut into stretches of ten days."""
    g = _daily(spark, d).withColumnRenamed("v", "line")
    return round_cols(gap_fill(g, ["user_id"], "day", ["line"], by_value=False, block=10).select("user_id", "day", "line"))


@query("q48_audit", """
WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) FILTER (WHERE l_shipdate IS NULL OR l_quantity IS NULL) AS m FROM lineitem GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (WHERE n > 1) AS repeated_keys,
       CAST(sum(m) AS BIGINT) AS rows_with_missing FROM k""")
def q48(spark: SparkSession, d: str) -> DataFrame:
    return audit(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_quantity"])


@query("q48b_null_counts", """
SELECT count(*) AS n_rows, count(*) - count(o_orderkey) AS missing_o_orderkey, count(*) - count(o_custkey) AS missing_o_custkey,
       count(*) - count(o_orderstatus) AS missing_o_orderstatus, count(*) - count(o_totalprice) AS missing_o_totalprice,
       count(*) - count(o_orderdate) AS missing_o_orderdate, count(*) - count(o_orderpriority) AS missing_o_orderpriority FROM orders""")
def q48b(spark: SparkSession, d: str) -> DataFrame:
    return null_counts(table(spark, d, "orders"))


@query("q48c_unmatched_keys", """
SELECT DISTINCT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def q48c(spark: SparkSession, d: str) -> DataFrame:
    return unmatched_keys(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("q48d_key_coverage", """
WITH c AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(quarter(l_shipdate) AS INTEGER) AS quarter, l_linestatus, l_returnflag FROM lineitem),
have AS (SELECT DISTINCT l_suppkey, year, quarter FROM c WHERE l_returnflag = 'R' AND l_linestatus = 'F'),
want AS (SELECT DISTINCT l_suppkey, year, quarter FROM c WHERE l_returnflag = 'A' AND l_linestatus = 'F')
SELECT l_suppkey, year, quarter, 'missing' AS finding FROM (SELECT * FROM want EXCEPT SELECT * FROM have) m
UNION ALL SELECT l_suppkey, year, quarter, 'surplus' FROM (SELECT * FROM have EXCEPT SELECT * FROM want) s""")
def q48d(spark: SparkSession, d: str) -> DataFrame:
    """Quarters in which a supplier has lines of one kind but none of the other."""
    c = table(spark, d, "lineitem").filter("l_linestatus = 'F'").select(
        "l_suppkey", year_of("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("quarter"), "l_returnflag")
    have, want = c.filter("l_returnflag = 'R'"), c.filter("l_returnflag = 'A'")
    return key_coverage(have, ["l_suppkey"], {"year": range(1990, 2010), "quarter": [1, 2, 3, 4]}, want)


@query("q50_regex_cast_text", f"""
WITH k AS (SELECT o_orderpriority AS priority, TRY_CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS num,
                  TRY_CAST(substring(o_orderpriority, 3, 2) AS INTEGER) AS no_num, o_totalprice, CAST(month(o_orderdate) AS INTEGER) AS mon FROM orders),
t AS (SELECT *, 'IR' || CAST(num AS VARCHAR) || 'CF' || CAST(mon AS VARCHAR) AS grid_key FROM k)
SELECT grid_key, CAST(regexp_extract(grid_key, 'IR(.+)CF', 1) AS DOUBLE) AS ir_part,
       CAST(regexp_extract(grid_key, 'CF(.+)$', 1) AS DOUBLE) AS cf_part,
       min(regexp_extract(priority, '^\\d-(.+)$', 1)) AS label, count(no_num) AS numeric_labels, count(*) AS n_orders,
       {r("sum(o_totalprice)", 2)} AS total
FROM t GROUP BY grid_key""")
def q50(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("priority"), leading_number("o_orderpriority", 1, 1).alias("num"),
        leading_number("o_orderpriority", 3, 2).alias("no_num"), F.month("o_orderdate").alias("mon"), "o_totalprice")
    g = o.groupBy(grid_key("num", "mon").alias("grid_key")).agg(
        F.min(F.regexp_extract("priority", r"^\d-(.+)$", 1)).alias("label"), F.count("no_num").alias("numeric_labels"),
        F.count(F.lit(1)).alias("n_orders"), rounded(F.sum("o_totalprice"), 2).alias("total"))
    ir, cf = grid_key_parts("grid_key")
    return g.withColumns({"ir_part": ir, "cf_part": cf})
