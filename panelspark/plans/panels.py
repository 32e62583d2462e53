"""Panel queries: cohort joins, interpolation, growth, rates, births."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.constants import AGE_BANDS
from panelspark.functions.scalars import band_index, band_label, clamp, growth_rate
from panelspark.operators.growth import (
    denominator, disease_transition_rates, expand_growth, extend_edges, measures_wide, project_forward, remainder,
    split_series, status_transition_rates, to_rates,
)
from panelspark.operators.interp import bands_to_single, prevalence_panel
from panelspark.operators.joins import cohort_join
from panelspark.plans.registry import CAUSE_ROWS, CELLS, FACTS, STATUS, query, r, round_cols
from panelspark.sources.tables import CAUSES, cause_rows, cells, line_facts, status_panel, table


@query("q09_cohort_shift_join", f"""
WITH {CELLS},
now AS MATERIALIZED (SELECT location, sex, age, year, n_a + n_n + n_r AS n FROM cells),
later AS MATERIALIZED (SELECT location, sex, CAST(age - 2 AS INTEGER) AS age, CAST(year - 2 AS INTEGER) AS year, n AS n_later FROM now)
SELECT location, sex, age, year, n, n_later FROM now JOIN later USING (location, sex, age, year)""")
def q09(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).withColumn("n", F.col("n_a") + F.col("n_n") + F.col("n_r"))
    return cohort_join(c.select("location", "sex", "age", "year", "n"), ["location", "sex"], "age", "year", 2, ["n"])


BAND_SQL = CELLS + """, band_cells AS (
  SELECT location, sex, CAST((age - 1) // 5 AS INTEGER) AS band, year,
         CAST(sum(n_a) AS BIGINT) AS n_a, CAST(sum(n_n) AS BIGINT) AS n_n, CAST(sum(n_r) AS BIGINT) AS n_r
  FROM cells GROUP BY 1, 2, 3, 4)"""


def band_cells(spark: SparkSession, d: str, counted: DataFrame | None = None) -> DataFrame:
    return (cells(spark, d) if counted is None else counted).groupBy("location", "sex", band_index("age", 5, first_age=1).alias("band"), "year").agg(
        *[F.sum(c).alias(c) for c in ("n_a", "n_n", "n_r")])


@query("q09b_band_cohort_join", f"""
WITH {BAND_SQL}
SELECT a.location, a.sex, a.band, a.year, a.n_a, b.n_a AS n_a_later, a.n_r, b.n_r AS n_r_later
FROM band_cells a JOIN band_cells b ON a.location = b.location AND a.sex = b.sex AND b.band = a.band + 1 AND b.year = a.year + 5""")
def q09b(spark: SparkSession, d: str) -> DataFrame:
    b = band_cells(spark, d).drop("n_n")
    return cohort_join(b, ["location", "sex"], "band", "year", 5, ["n_a", "n_r"], axis_gap=1)


@query("q24_midpoint_to_single", f"""
WITH {CELLS}, b AS (
  SELECT location, sex, age // 5 * 5 + 2 AS x, (sum(n_r) + 1e0) / (sum(n_a + n_n + n_r) + 3e0) AS y FROM cells GROUP BY 1, 2, 3),
s AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM b WINDOW w AS (PARTITION BY location, sex ORDER BY x))
SELECT location, sex, CAST(a.age AS INTEGER) AS age,
       {r("CASE WHEN x1 IS NULL OR a.age = x THEN y ELSE y + (y1 - y) * (a.age - x) / (x1 - x) END")} AS rate
FROM s JOIN range(0, 100) a(age) ON a.age >= x AND (a.age < x1 OR (x1 IS NULL AND a.age = x))""")
def q24(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).groupBy("location", "sex", band_label("age", AGE_BANDS).alias("band")).agg(
        F.sum("n_r").alias("n"), F.sum(F.col("n_a") + F.col("n_n") + F.col("n_r")).alias("tot"))
    c = c.withColumn("rate", (F.col("n") + 1.0) / (F.col("tot") + 3.0))
    return round_cols(bands_to_single(c, ["location", "sex"], "band", "age", ["rate"]))


@query("q25_growth_expansion", f"""
WITH {FACTS}, v AS (
  SELECT location, sex, cause, count(*) FILTER (WHERE year = 1995) + 1e0 AS v0, count(*) FILTER (WHERE year = 2000) + 1e0 AS v1
  FROM facts GROUP BY 1, 2, 3),
g AS (SELECT *, ln(v1 / v0) / 5e0 AS g FROM v),
c AS (SELECT *, CASE WHEN g < 0 THEN 0e0 WHEN g > 1 THEN 0.99e0 ELSE g END AS rate FROM g)
SELECT location, sex, cause, CAST(k AS INTEGER) AS step, {r("rate")} AS rate, {r("v0 * pow(1e0 + rate, k - 1)")} AS value
FROM c, range(1, 6) t(k)""")
def q25(spark: SparkSession, d: str) -> DataFrame:
    def n(y):
        return F.count(F.when(F.col("year") == y, 1)) + F.lit(1.0)
    v = line_facts(spark, d).groupBy("location", "sex", "cause").agg(n(1995).alias("value"), n(2000).alias("v1"))
    v = v.withColumn("rate", clamp(growth_rate("value", "v1", 5), 0, 1, 0, 0.99))
    return round_cols(expand_growth(v, {"value": "rate"}, 5).select("location", "sex", "cause", "step", "rate", "value"))


@query("q26_union_project_forward", f"""
WITH {CELLS}, t AS (SELECT location, age, year, CAST(sum(n_a + n_n + n_r) AS BIGINT) AS n FROM cells GROUP BY 1, 2, 3),
f AS (SELECT * FROM t UNION ALL SELECT location, age, CAST(y AS INTEGER), n FROM t, range(2002, 2006) x(y) WHERE year = 2001)
SELECT location, age, year, n, 1e0 AS weight FROM f
UNION ALL SELECT location, CAST(0 AS INTEGER), year, n, 1e0 FROM f WHERE age = 1
UNION ALL SELECT location, CAST(a AS INTEGER), year, n, 0.5e0 FROM f, range(51, 56) x(a) WHERE age = 50""")
def q26(spark: SparkSession, d: str) -> DataFrame:
    t = cells(spark, d).groupBy("location", "age", "year").agg(F.sum(F.col("n_a") + F.col("n_n") + F.col("n_r")).alias("n"))
    f = project_forward(t, "year", 2001, 2005).withColumn("weight", F.lit(1.0))
    f = extend_edges(f, "age", 1, [0])
    return extend_edges(f, "age", 50, range(51, 56), {"weight": 0.5}).select("location", "age", "year", "n", "weight")


# Counts and rates per 100,000 of made-up populations: pop = 200 + 20 lines.
BURDEN_SQL = BAND_SQL + """, m AS (
  SELECT location, sex, band, year, n_a, n_n, n_r, 200e0 + 20e0 * (n_a + n_n + n_r) AS pop FROM band_cells),
burden AS (
  SELECT location, sex, band, year, cause, 10e0 * (n + 1) AS prev, 10e0 * (n + 1) / pop * 100000e0 AS prev_rate,
         0.5e0 * (n + 1) AS death, 0.5e0 * (n + 1) / pop * 100000e0 AS death_rate
  FROM (SELECT *, 'A' AS cause, n_a AS n FROM m UNION ALL SELECT *, 'N', n_n FROM m UNION ALL SELECT *, 'R', n_r FROM m) x),
total AS (SELECT location, sex, band, year, 0.5e0 * (n_a + n_n + n_r + 3) AS death,
                 0.5e0 * (n_a + n_n + n_r + 3) / pop * 100000e0 AS death_rate FROM m)"""


def burden_long(spark: SparkSession, d: str, counted: DataFrame | None = None) -> DataFrame:
    """Long table (measure, metric, val) of prevalence and deaths per cause and in total."""
    b = band_cells(spark, d, counted)
    tot = F.col("n_a") + F.col("n_n") + F.col("n_r")
    rows = [F.struct(F.lit(c).alias("cause"), (F.col(f"n_{c.lower()}") + 1).alias("n")) for c in CAUSES]
    rows.append(F.struct(F.lit("All causes").alias("cause"), (tot + 3).alias("n")))
    b = b.select("location", "sex", "band", "year", (F.lit(200.0) + F.lit(20.0) * tot).alias("pop"), F.inline(F.array(*rows)))
    def item(measure, metric, val):
        return F.struct(F.lit(measure).alias("measure"), F.lit(metric).alias("metric"), val.alias("val"))
    prev, death = F.lit(10.0) * F.col("n"), F.lit(0.5) * F.col("n")
    return b.select("location", "sex", "band", "year", "cause", F.inline(F.array(
        item("Prevalence", "Number", prev), item("Prevalence", "Rate", prev / F.col("pop") * 100000.0),
        item("Deaths", "Number", death), item("Deaths", "Rate", death / F.col("pop") * 100000.0))))


WANTED = {
    "prev": ("Prevalence", "Number"), "prev_rate": ("Prevalence", "Rate"),
    "death": ("Deaths", "Number"), "death_rate": ("Deaths", "Rate"),
}


def _step(v: str, g: str, k: int) -> str:
    return f"{v} * pow(1e0 + {g}, {k - 1})"


IR_TERMS = " + ".join(
    f"({_step('prev', 'gs', k)} - ({_step('prev', 'gs', k - 1)} - {_step('death', 'gd', k)})) / ({_step('w1', 'gw', k - 1)})" for k in range(2, 6))
CF_TERMS = " + ".join(f"({_step('death', 'gd', k)}) / ({_step('prev', 'gs', k - 1)})" for k in range(2, 6))


def _clip(x: str, high: str, low: bool = True) -> str:
    return f"CASE {f'WHEN {x} < 0 THEN 0e0 ' if low else ''}WHEN {x} > 1 THEN {high} ELSE {x} END"


@query("q27_transition_rates", f"""
WITH {BURDEN_SQL}, p AS (
  SELECT a.location, a.sex, a.cause, a.band, a.year + 5 AS year, a.prev, a.death,
         a.death / a.death_rate * 100000e0 AS pop1, b.death / b.death_rate * 100000e0 AS pop2,
         t1.death AS all1, t2.death AS all2, b.prev AS prev2,
         ln(b.prev_rate / a.prev_rate) / 5e0 AS gs0, ln(b.death_rate / a.death_rate) / 5e0 AS gd0
  FROM burden a JOIN burden b ON a.location = b.location AND a.sex = b.sex AND a.cause = b.cause AND b.band = a.band + 1 AND b.year = a.year + 5
  JOIN total t1 ON t1.location = a.location AND t1.sex = a.sex AND t1.band = a.band AND t1.year = a.year
  JOIN total t2 ON t2.location = b.location AND t2.sex = b.sex AND t2.band = b.band AND t2.year = b.year),
g AS (SELECT *, pop1 - prev - all1 AS w1, ln(((pop2 - prev2 - all2) / pop2) / ((pop1 - prev - all1) / pop1)) / 5e0 AS gw,
             {_clip('gs0', '0.99e0')} AS gs, {_clip('gd0', '0.99e0')} AS gd FROM p),
x AS (SELECT *, ({IR_TERMS}) / 4e0 AS ir0, ({CF_TERMS}) / 4e0 AS cf0 FROM g)
SELECT location, sex, cause, band, CAST(year AS INTEGER) AS year, {r(_clip('ir0', '0.9e0'))} AS ir, {r(_clip('cf0', '0.9e0', False))} AS cf FROM x""")
def q27(spark: SparkSession, d: str) -> DataFrame:
    wide = measures_wide(burden_long(spark, d), ["location", "sex", "band", "year", "cause"], "measure", "metric", "val", WANTED)
    return round_cols(disease_transition_rates(wide, ["location", "sex"], "cause", "band", "year", 5, 1))


def _mean_status(terms: str) -> str:
    return f"coalesce(({terms}) / 2e0, 0)"


INIT = " + ".join(
    f"({_step('current', 'gc', k)} - ({_step('current', 'gc', k - 1)} - {_step('ex', 'ge', k)})) / ({_step('never', 'gn', k - 1)})" for k in (2, 3))
CESS = " + ".join(f"({_step('ex', 'ge', k)}) / ({_step('current', 'gc', k - 1)})" for k in (2, 3))


@query("q27b_status_transition_rates", f"""
WITH {STATUS},
later AS MATERIALIZED (SELECT location, sex, CAST(age - 3 AS INTEGER) AS age, CAST(year - 3 AS INTEGER) AS year, never, current, ex FROM status),
p AS (
  SELECT location, sex, age, year + 3 AS year, a.never, a.current, a.ex,
         {", ".join(f"CASE WHEN ln(b.{c} / a.{c}) / 3e0 > 1 THEN 0.99e0 ELSE ln(b.{c} / a.{c}) / 3e0 END AS g{c[0]}" for c in ("never", "current", "ex"))}
  FROM status a LEFT JOIN later b USING (location, sex, age, year) WHERE year <= 1998),
x AS (SELECT *, {_mean_status(INIT)} AS i0, {_mean_status(CESS)} AS c0 FROM p)
SELECT location, sex, age, CAST(year AS INTEGER) AS year, {r(_clip('i0', '0.9e0'))} AS init, {r(_clip('c0', '0.9e0'))} AS cess FROM x""")
def q27b(spark: SparkSession, d: str) -> DataFrame:
    s = status_panel(spark, d)
    return round_cols(status_transition_rates(s, ["location", "sex"], "age", "year", 3, 2001))


@query("q23c_prevalence_panel", f"""
WITH {CELLS}, s AS (
  SELECT location, sex, (age - 1) // 10 * 10 + 5 AS age, year, 100e0 * (sum(n_n) + 1) / (sum(n_a + n_n + n_r) + 3) AS current,
         100e0 * (sum(n_r) + 1) / (sum(n_a + n_n + n_r) + 3) AS ex
  FROM cells WHERE year IN (1995, 2001) GROUP BY 1, 2, 3, 4),
k AS (SELECT a.location, a.sex, a.age, y.year, a.current + (b.current - a.current) * (y.year - 1995) / 6e0 AS current, a.ex + (b.ex - a.ex) * (y.year - 1995) / 6e0 AS ex
      FROM s a JOIN s b ON a.location = b.location AND a.sex = b.sex AND a.age = b.age, range(1995, 2002) y(year) WHERE a.year = 1995 AND b.year = 2001),
p AS (SELECT location, sex, age, year, current, ex, 100e0 - current - ex AS never FROM k
      UNION ALL SELECT DISTINCT location, sex, 0, year, 0e0, 0e0, 100e0 FROM k),
l AS (SELECT *, lead(age) OVER w AS a1, lead(current) OVER w AS c1, lead(ex) OVER w AS e1, lead(never) OVER w AS n1 FROM p
      WINDOW w AS (PARTITION BY location, sex, year ORDER BY age))
SELECT location, sex, CAST(g.age AS INTEGER) AS age, CAST(l.year AS INTEGER) AS year,
       {", ".join(r(f"CASE WHEN a1 IS NULL OR g.age = l.age THEN {c} ELSE {c} + ({c[0]}1 - {c}) * (g.age - l.age) / (a1 - l.age) END") + f" AS {c}" for c in ("current", "ex", "never"))}
FROM l JOIN range(0, 46) g(age) ON g.age >= l.age AND (g.age < a1 OR (a1 IS NULL AND g.age = l.age))""")
def q23c(spark: SparkSession, d: str) -> DataFrame:
    """Two survey years in age bands of ten to a full composition panel."""
    s = cells(spark, d).filter(F.col("year").isin(1995, 2001)).groupBy(
        "location", "sex", (band_index("age", 10, first_age=1) * 10 + 5).alias("age"), "year"
    ).agg(F.sum("n_n").alias("c"), F.sum("n_r").alias("e"), F.sum(F.col("n_a") + F.col("n_n") + F.col("n_r")).alias("tot"))
    tot = (F.col("tot") + 3).cast("double")
    s = s.select("location", "sex", "age", "year", (F.lit(100.0) * (F.col("c") + 1) / tot).alias("current"),
                 (F.lit(100.0) * (F.col("e") + 1) / tot).alias("ex"))
    out = prevalence_panel(s, ["location", "sex"], "year", "age", ["current", "ex"], "never", range(1995, 2002), range(0, 46),
                           start_shares={"never": 100.0})
    return round_cols(out)


@query("q46_births_split", f"""
WITH {FACTS}, n AS (SELECT location, sex, year, count(*) AS n FROM facts GROUP BY 1, 2, 3),
h AS (SELECT location, sex, year, n * 1e0 AS births FROM n WHERE year <= 1997),
sh AS (SELECT location, sum(CASE WHEN sex = 'F' THEN births END) / sum(births) AS share FROM h GROUP BY 1),
w AS (SELECT location, year, sum(n) * 1000e0 * 0.7e0 AS v FROM n WHERE year >= 1999 GROUP BY 1, 2),
a AS (SELECT location, sex, year, births FROM h
      UNION ALL SELECT w.location, x.sex, w.year, v * CASE WHEN x.sex = 'F' THEN share ELSE 1e0 - share END FROM w JOIN sh USING (location), (VALUES ('F'), ('O')) x(sex)),
k AS (SELECT DISTINCT location, sex FROM a),
e AS (SELECT k.location, k.sex, 1998 AS year, b.births + (c.births - b.births) * 0.5e0 AS births FROM k
      JOIN a b ON b.location = k.location AND b.sex = k.sex AND b.year = 1997 JOIN a c ON c.location = k.location AND c.sex = k.sex AND c.year = 1999
      UNION ALL SELECT k.location, k.sex, 2002, b.births FROM k JOIN a b ON b.location = k.location AND b.sex = k.sex AND b.year = 2001)
SELECT location, sex, CAST(year AS INTEGER) AS year, {r("births")} AS births FROM (SELECT * FROM a UNION ALL SELECT * FROM e) z""")
def q46(spark: SparkSession, d: str) -> DataFrame:
    n = line_facts(spark, d)
    history = n.filter(F.col("year") <= 1997).groupBy("location", "sex", "year").agg(F.count(F.lit(1)).cast("double").alias("births"))
    years = [1999, 2000, 2001]
    wide = n.filter(F.col("year") >= 1999).groupBy("location").agg(
        *[F.count(F.when(F.col("year") == y, 1)).alias(f"y{y}") for y in years])
    out = split_series(wide, history, ["location"], "sex", "year", "births", [f"y{y}" for y in years], ("F", "O"),
                       unit=1000.0, scale=0.7, horizon=2050, fill_years=[1998, 2002])
    return round_cols(out.select("location", "sex", "year", "births"))


@query("q47_denominators_rates", f"""
WITH s AS (SELECT user_id, event_type, round(sum(value), 2) AS v FROM events GROUP BY 1, 2),
t AS (SELECT user_id, round(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY 1),
p AS (SELECT t.user_id, c.event_type, coalesce(v, 0e0) AS part_value, total, n FROM t CROSS JOIN (SELECT DISTINCT event_type FROM events) c
      LEFT JOIN s ON s.user_id = t.user_id AND s.event_type = c.event_type),
b AS (SELECT user_id, sum(part_value) AS known FROM p GROUP BY 1)
SELECT p.user_id, event_type, {r("part_value")} AS part_value, {r("total - part_value")} AS other, {r("total - known")} AS background,
       {r("total / (total / n * 100e0 / 100000e0)")} AS population,
       {r("part_value / (total / (total / n * 100e0 / 100000e0))", 9)} AS part_rate,
       {r("(total - part_value) / (total / (total / n * 100e0 / 100000e0))", 9)} AS other_rate
FROM p JOIN b USING (user_id)""")
def q47(spark: SparkSession, d: str) -> DataFrame:
    """Counts, rates and totals of a long table to population, remainders and rates."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(
        rounded_sum("value").alias("v"), F.count(F.lit(1)).alias("n"))
    whole = table(spark, d, "events").groupBy("user_id").agg(rounded_sum("value").alias("v"), F.count(F.lit(1)).alias("n"))
    long = e.unionByName(whole.withColumn("event_type", F.lit("All causes")))
    parts = remainder(long, ["user_id"], "event_type", "v", ["click", "error", "purchase", "signup", "view"])
    two = whole.select("user_id", F.inline(F.array(
        F.struct(F.lit("Number").alias("metric"), F.col("v").alias("val")),
        F.struct(F.lit("Rate").alias("metric"), (F.col("v") / F.col("n") * 100.0).alias("val")))))
    pop = denominator(two, ["user_id"], "metric", "val")
    out = to_rates(parts.join(pop, "user_id"), {"part_rate": "part_value", "other_rate": "other"}, "population")
    return round_cols(out.drop("total"), 6, part_rate=9, other_rate=9)


def rounded_sum(c: str):
    return F.round(F.sum(c), 2)
