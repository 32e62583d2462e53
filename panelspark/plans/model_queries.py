"""The model jobs on the driver tables: base rates, transition rates, projection, recompute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.constants import AGE_BANDS
from panelspark.operators.report import averted
from panelspark.plans import model as M
from panelspark.plans.panels import BURDEN_SQL, CF_TERMS, IR_TERMS, _clip, burden_long
from panelspark.plans.registry import FACTS, query, r, round_cols
from panelspark.plans.rolls import coupled_sql
from panelspark.sources.tables import CAUSES, cells, gathered_cells, line_facts, table, year_of


def burden(spark: SparkSession, d: str, counted: DataFrame | None = None) -> DataFrame:
    """Long burden table with age-band labels."""
    labels = F.array(*[F.lit(b) for b in AGE_BANDS])
    return burden_long(spark, d, counted).withColumn("age", F.get(labels, F.col("band"))).drop("band")


def population(spark: SparkSession, d: str, counted: DataFrame | None = None) -> DataFrame:
    return (cells(spark, d) if counted is None else counted).select(
        "location", "sex", "age", "year", (F.lit(10.0) * (F.col("n_a") + F.col("n_n") + F.col("n_r") + 1)).alias("nx"))


BASE_SQL = BURDEN_SQL + """, band_rates AS (
  SELECT b.location, b.sex, b.cause, b.year, b.band * 5 + 2 AS x, t.death / (t.death / (t.death_rate / 100000e0)) AS all_mx, b.death / (t.death / (t.death_rate / 100000e0)) AS dis_mx,
         (t.death - b.death) / (t.death / (t.death_rate / 100000e0)) AS bg_mx, b.prev / (t.death / (t.death_rate / 100000e0)) AS prev_rate
  FROM burden b JOIN total t USING (location, sex, band, year)),
knots AS (SELECT *, lead(x) OVER w AS x1, lead(all_mx) OVER w AS a1, lead(dis_mx) OVER w AS d1, lead(bg_mx) OVER w AS b1, lead(prev_rate) OVER w AS p1
          FROM band_rates WINDOW w AS (PARTITION BY location, sex, cause, year ORDER BY x)),
base AS (
  SELECT location, sex, cause, year, CAST(g.age AS INTEGER) AS age,
         CASE WHEN g.age <= x THEN all_mx ELSE all_mx + (a1 - all_mx) * (g.age - x) / (x1 - x) END AS all_mx,
         CASE WHEN g.age <= x THEN dis_mx ELSE dis_mx + (d1 - dis_mx) * (g.age - x) / (x1 - x) END AS dis_mx,
         CASE WHEN g.age <= x THEN bg_mx ELSE bg_mx + (b1 - bg_mx) * (g.age - x) / (x1 - x) END AS bg_mx,
         CASE WHEN g.age <= x THEN prev_rate ELSE prev_rate + (p1 - prev_rate) * (g.age - x) / (x1 - x) END AS prev_rate
  FROM knots JOIN range(0, 48) g(age) ON (g.age >= x OR x = 2) AND (g.age < x1 OR (x1 IS NULL AND g.age = x))),
base_rates AS (
  SELECT base.*, 10e0 * (n_a + n_n + n_r + 1) AS nx FROM base LEFT JOIN cells USING (location, sex, age, year))"""


@query("q51_base_rates_job", f"""
WITH {BASE_SQL}
SELECT location, sex, cause, year, age, {r("all_mx", 9)} AS all_mx, {r("dis_mx", 9)} AS dis_mx, {r("bg_mx", 9)} AS bg_mx,
       {r("prev_rate", 9)} AS prev_rate, nx FROM base_rates""")
def q51(spark: SparkSession, d: str) -> DataFrame:
    out = M.base_rates(burden(spark, d), population(spark, d), CAUSES)
    return round_cols(out.select("location", "sex", "cause", "year", "age", "all_mx", "dis_mx", "bg_mx", "prev_rate", "nx"), 9)


@query("q52_transition_rates_job", f"""
WITH {BASE_SQL}, p AS (
  SELECT a.location, a.sex, a.cause, a.band, a.year + 5 AS year, a.prev, a.death,
         a.death / a.death_rate * 100000e0 AS pop1, b.death / b.death_rate * 100000e0 AS pop2,
         t1.death AS all1, t2.death AS all2, b.prev AS prev2, ln(b.prev_rate / a.prev_rate) / 5e0 AS gs0, ln(b.death_rate / a.death_rate) / 5e0 AS gd0
  FROM burden a JOIN burden b ON a.location = b.location AND a.sex = b.sex AND a.cause = b.cause AND b.band = a.band + 1 AND b.year = a.year + 5
  JOIN total t1 ON t1.location = a.location AND t1.sex = a.sex AND t1.band = a.band AND t1.year = a.year
  JOIN total t2 ON t2.location = b.location AND t2.sex = b.sex AND t2.band = b.band AND t2.year = b.year),
g AS (SELECT *, pop1 - prev - all1 AS w1, ln(((pop2 - prev2 - all2) / pop2) / ((pop1 - prev - all1) / pop1)) / 5e0 AS gw,
             {_clip('gs0', '0.99e0')} AS gs, {_clip('gd0', '0.99e0')} AS gd FROM p),
x AS (SELECT location, sex, cause, year, band * 5 + 2 AS x, ({IR_TERMS}) / 4e0 AS ir0, ({CF_TERMS}) / 4e0 AS cf0 FROM g),
kn AS (SELECT k.*, CAST(y.year AS INTEGER) AS year, b.b * 5 + 2 AS x, coalesce({_clip('ir0', '0.9e0')}, 0e0) AS ir, coalesce({_clip('cf0', '0.9e0', False)}, 0e0) AS cf
       FROM (SELECT DISTINCT location, sex, cause FROM x) k CROSS JOIN range(2000, 2002) y(year) CROSS JOIN range(0, 20) b(b)
       LEFT JOIN x ON x.location = k.location AND x.sex = k.sex AND x.cause = k.cause AND x.year = y.year AND x.x = b.b * 5 + 2),
ln AS (SELECT *, lead(x) OVER w AS x1, lead(ir) OVER w AS i1, lead(cf) OVER w AS c1 FROM kn WINDOW w AS (PARTITION BY location, sex, cause, year ORDER BY x)),
s AS (SELECT location, sex, cause, year, CAST(g.age AS INTEGER) AS age, CASE WHEN g.age <= x THEN ir ELSE ir + (i1 - ir) * (g.age - x) / (x1 - x) END AS ir,
             CASE WHEN g.age <= x THEN cf ELSE cf + (c1 - cf) * (g.age - x) / (x1 - x) END AS cf
      FROM ln JOIN range(0, 96) g(age) ON (g.age >= x OR x = 2) AND g.age < x1)
SELECT s.location, s.sex, s.cause, s.year, s.age, {r("s.ir", 9)} AS ir, {r("s.cf", 9)} AS cf, {r("b.prev_rate", 9)} AS prev_rate, b.nx
FROM s LEFT JOIN base_rates b ON b.location = s.location AND b.sex = s.sex AND b.cause = s.cause AND b.year = s.year AND b.age = s.age""")
def q52(spark: SparkSession, d: str) -> DataFrame:
    counted = gathered_cells(spark, d, len(CAUSES))
    b = burden(spark, d, counted)
    base = M.base_rates(b, population(spark, d, counted), CAUSES, placed=True)
    out = M.transition_rates(b, base, range(2000, 2002), placed=True)
    return round_cols(out.select("location", "sex", "cause", "year", "age", "ir", "cf", "prev_rate", "nx"), 9)


# Projection: ages 0..49 (quantity minus one), scenarios by flag, one place.
SETTINGS = M.Settings(
    base_year=1995, survey_last=1998, horizon=2001, status_first=1996, effect_start=1998, status_ages=(0, 49), ages=(0, 49))

PROJECT_SQL = "WITH RECURSIVE " + FACTS + """, nat AS (
  SELECT sex, age - 1 AS age, year, count(*) FILTER (WHERE cause = 'A') AS n_a, count(*) FILTER (WHERE cause = 'N') AS n_n, count(*) FILTER (WHERE cause = 'R') AS n_r
  FROM facts GROUP BY 1, 2, 3),
st AS (SELECT sex, age, year, (n_a + 1) * 100e0 / (n_a + n_n + n_r + 3) AS never, (n_n + 1) * 100e0 / (n_a + n_n + n_r + 3) AS current,
              (n_r + 1) * 100e0 / (n_a + n_n + n_r + 3) AS ex, (n_n + 1) * 0.2e0 / (n_a + n_n + n_r + 3) AS init, (n_r + 1) * 0.3e0 / (n_a + n_n + n_r + 3) AS cess FROM nat),
stp AS (SELECT * FROM st WHERE year <= 1998
        UNION ALL SELECT sex, age, CAST(y AS INTEGER), never, current, ex, init, cess FROM st, range(1999, 2002) t(y) WHERE year = 1998),
eff AS (SELECT cause AS scenario, CASE WHEN sex = 'F' THEN 0 ELSE 26 END AS age_start, CASE WHEN sex = 'F' THEN 25 ELSE 49 END AS age_stop,
               avg(discount) * 4e0 AS cessation, avg(tax) * 4e0 AS initiation FROM facts GROUP BY 1, 2, 3),
sr AS MATERIALIZED (
  SELECT x.scenario, s.sex, s.age, s.year, never, current, ex,
         CASE WHEN s.year >= 1998 THEN init * (1e0 - coalesce(initiation, 0e0)) ELSE init END AS init,
         CASE WHEN s.year >= 1998 THEN least(cess * (1e0 + coalesce(cessation, 0e0)), 1e0) ELSE cess END AS cess
  FROM stp s CROSS JOIN (VALUES ('0'), ('A'), ('N'), ('R')) x(scenario) LEFT JOIN eff ON eff.scenario = x.scenario AND s.age BETWEEN age_start AND age_stop),
sroll AS (
  SELECT scenario, sex, age, year, never, current, ex FROM sr WHERE year = 1996 OR (age = 0 AND year > 1996)
  UNION ALL
  SELECT p.scenario, p.sex, p.age + 1, p.year + 1, p.never * (1e0 - q.init), p.current * (1e0 - q.cess) + p.never * q.init, p.current * q.cess + p.ex
  FROM sroll p JOIN sr q ON q.scenario = p.scenario AND q.sex = p.sex AND q.age = p.age AND q.year = p.year + 1 WHERE p.age < 49),
sall AS (SELECT * FROM sroll UNION ALL SELECT scenario, sex, age, year, never, current, ex FROM sr WHERE year < 1996),
risk AS (SELECT sex, cause, avg(tax) AS t FROM facts GROUP BY 1, 2),
imp AS (SELECT n.scenario, n.sex, n.age, n.year, k.cause,
               (n.never + n.current * (2e0 + t) + n.ex * (1e0 + t)) / (b.never + b.current * (2e0 + t) + b.ex * (1e0 + t)) AS impact
        FROM sall n JOIN sall b ON b.scenario = '0' AND b.sex = n.sex AND b.age = n.age AND b.year = n.year JOIN risk k ON k.sex = n.sex WHERE n.scenario <> '0'),
rt AS (SELECT sex, age, 'A' AS cause, n_a AS n, n_a + n_n + n_r AS tot FROM nat WHERE year = 1995
       UNION ALL SELECT sex, age, 'N', n_n, n_a + n_n + n_r FROM nat WHERE year = 1995 UNION ALL SELECT sex, age, 'R', n_r, n_a + n_n + n_r FROM nat WHERE year = 1995),
prates AS MATERIALIZED (
  SELECT x.scenario, rt.sex, rt.age + 1 AS age, CAST(y.y AS INTEGER) AS year, rt.cause,
         CASE WHEN rt.age = 0 AND y.y > 1995 THEN b.births ELSE (100e0 + 10e0 * tot) / 7.3e0 END AS nx,
         (n + 1e0) / (tot + 3e0) * 0.1e0 AS prev_rate, (n + 1e0) / (tot + 3e0) * 0.01e0 AS dis_mx, 0.02e0 AS all_mx,
         0.02e0 - (n + 1e0) / (tot + 3e0) * 0.01e0 AS bg_mx, 0.02e0 - (n + 1e0) / (tot + 3e0) * 0.01e0 AS bg_mx_all,
         (n + 1e0) / (tot + 3e0) * 0.05e0 * coalesce(i.impact, 1e0) AS ir, (n + 2e0) / (tot + 4e0) * 0.1e0 * coalesce(i.impact, 1e0) AS cf
  FROM rt CROSS JOIN range(1995, 2002) y(y) CROSS JOIN (VALUES ('0'), ('A'), ('N'), ('R')) x(scenario)
  LEFT JOIN imp i ON i.scenario = x.scenario AND i.sex = rt.sex AND i.age = rt.age AND i.year = y.y AND i.cause = rt.cause
  LEFT JOIN (SELECT sex, year, count(*) / 7.3e0 AS births FROM facts GROUP BY 1, 2) b ON b.sex = rt.sex AND b.year = y.y),
""" + coupled_sql("scenario, sex", "prates") + """,
tot AS (SELECT scenario, year, sum(dead) AS dead, sum(newcases) AS newcases FROM roll GROUP BY 1, 2)"""


def projection_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Status panel, effects, risks, rates and births of one place made of all suppliers."""
    li = table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("sex"), F.col("l_returnflag").alias("cause"), year_of("l_shipdate").alias("year"),
        F.abs("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    nat = line_facts(spark, d).groupBy("sex", (F.col("age") - 1).alias("age"), "year").agg(
        *[F.count(F.when(F.col("cause") == c, 1)).alias(f"n_{c.lower()}") for c in CAUSES])
    tot = F.col("n_a") + F.col("n_n") + F.col("n_r")
    tot3 = (tot + 3).cast("double")
    status = nat.select(
        "sex", "age", "year", *[((F.col(c) + 1) * 100.0 / tot3).alias(s) for c, s in (("n_a", "never"), ("n_n", "current"), ("n_r", "ex"))],
        ((F.col("n_n") + 1) * 0.2 / tot3).alias("init"), ((F.col("n_r") + 1) * 0.3 / tot3).alias("cess"))
    young = F.col("sex") == "F"
    effects = li.groupBy(
        F.col("cause").alias("scenario"), F.when(young, F.lit(0)).otherwise(F.lit(26)).alias("age_start"),
        F.when(young, F.lit(25)).otherwise(F.lit(49)).alias("age_stop"),
    ).agg((F.avg("discount") * 4.0).alias("cessation"), (F.avg("tax") * 4.0).alias("initiation"))
    risks = li.groupBy("sex", "cause").agg(F.avg("tax").alias("t")).select("sex", "cause", F.inline(F.array(
        F.struct(F.lit("Nonsmoker").alias("category"), F.lit(1.0).alias("rr")), F.struct(F.lit("Smoker").alias("category"), (F.col("t") + 2.0).alias("rr")),
        F.struct(F.lit("Exsmoker").alias("category"), (F.col("t") + 1.0).alias("rr")))))
    n, share = F.col("n").cast("double"), (F.col("n") + 1.0) / (F.col("tot") + 3.0)
    rates = nat.select("sex", "age", "year", tot.alias("tot"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("cause"), F.col(f"n_{c.lower()}").alias("n")) for c in CAUSES]))).select(
        F.lit("all").alias("location"), "sex", "age", "year", "cause", ((F.lit(100.0) + F.lit(10.0) * F.col("tot")) / 7.3).alias("nx"),
        (share * 0.1).alias("prev_rate"), (share * 0.01).alias("dis_mx"), F.lit(0.02).alias("all_mx"), (F.lit(0.02) - share * 0.01).alias("bg_mx"),
        (F.lit(0.02) - share * 0.01).alias("bg_mx_all"), (share * 0.05).alias("ir"), ((n + 2.0) / (F.col("tot") + 4.0) * 0.1).alias("cf"))
    births = li.groupBy(F.lit("all").alias("location"), "sex", "year").agg((F.count(F.lit(1)) / 7.3).alias("births"))
    return status, effects, risks, rates, births


def projection_totals(spark: SparkSession, d: str, codes: list[str]) -> DataFrame:
    status, effects, risks, rates, births = projection_inputs(spark, d)
    s = SETTINGS
    impact = M.status_impact(M.status_scenarios(status, effects, codes, s), risks, s)
    wide = M.effect_table([impact], s)
    # The model's own sexes are texts of its tables; here they are line states.
    return M.totals_by_scenario(M.trajectories(rates, births, wide, codes, s, CAUSES, sexes=["F", "O"]))


@query("q53_projection_job", PROJECT_SQL + f"""
SELECT n.scenario, CAST(n.year AS INTEGER) AS year, {r("n.dead", 4)} AS dead, {r("n.newcases", 4)} AS newcases, {r("greatest(0e0, b.dead - n.dead)", 4)} AS deaths_averted
FROM tot n JOIN tot b ON b.scenario = '0' AND b.year = n.year WHERE n.scenario <> '0'""")
def q53(spark: SparkSession, d: str) -> DataFrame:
    """Status effects to risks to rates to trajectories to averted deaths, in one plan."""
    totals = projection_totals(spark, d, CAUSES)
    out = averted(totals, [], "year", "scenario", "0", {"dead": "deaths_averted"}, digits=None, keep=["dead", "newcases"])
    return round_cols(out, 4)


def projection(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Trajectories of all scenarios, and the composition behind their effects."""
    status, effects, risks, rates, births = projection_inputs(spark, d)
    s = SETTINGS
    scenarios = M.status_scenarios(status, effects, CAUSES, s)
    wide = M.effect_table([M.status_impact(scenarios, risks, s)], s)
    return M.trajectories(rates, births, wide, CAUSES, s, CAUSES, sexes=["F", "O"]), scenarios


@query("q57_status_scenarios_job", PROJECT_SQL + f"""
SELECT scenario, sex, CAST(age AS INTEGER) AS age, CAST(year AS INTEGER) AS year, {r("never")} AS never, {r("current")} AS current, {r("ex")} AS ex FROM sall""")
def q57(spark: SparkSession, d: str) -> DataFrame:
    """Effects on initiation and cessation, rolled forward for every scenario."""
    status, effects, _, _, _ = projection_inputs(spark, d)
    out = M.status_scenarios(status, effects, CAUSES, SETTINGS)
    return round_cols(out.select("scenario", "sex", "age", "year", "never", "current", "ex"))


@query("q58_survival_report", PROJECT_SQL + f""",
c AS (SELECT scenario, year, sex, age, avg(pop) AS pop, sum(dead) AS dead FROM roll WHERE age BETWEEN 31 AND 50 GROUP BY 1, 2, 3, 4),
b AS (SELECT scenario, year, (age - 31) // 5 AS band, sum(dead) / sum(pop) AS m FROM c GROUP BY 1, 2, 3)
SELECT scenario, CAST(year AS INTEGER) AS year, {r("1e0 - product(1e0 - 5e0 * m / (1e0 + 2.5e0 * m))")} AS dying_prob FROM b GROUP BY scenario, year""")
def q58(spark: SparkSession, d: str) -> DataFrame:
    """Probability of dying between two ages, from the trajectories; population is the mean over causes."""
    run, _ = projection(spark, d)
    return round_cols(M.survival_report(run, ["0", *CAUSES], (30, 49)))


@query("q58b_prevalence_report", PROJECT_SQL + f""",
p AS (SELECT scenario, sex, age - 1 AS age, year, avg(pop) AS pop FROM roll GROUP BY 1, 2, 3, 4)
SELECT p.scenario, p.sex, CAST(p.year AS INTEGER) AS year, {r("sum(pop * current / 100e0)", 4)} AS cases, {r("sum(pop)", 4)} AS population,
       {r("sum(pop * current / 100e0) / nullif(sum(pop), 0)")} AS rate
FROM p JOIN sall s ON s.scenario = p.scenario AND s.sex = p.sex AND s.age = p.age AND s.year = p.year
WHERE pop IS NOT NULL AND current IS NOT NULL GROUP BY p.scenario, p.sex, p.year""")
def q58b(spark: SparkSession, d: str) -> DataFrame:
    """People in the current state by scenario, from the trajectories and their composition."""
    run, scenarios = projection(spark, d)
    return round_cols(M.prevalence_report(run, scenarios, ["0", *CAUSES]), 6, cases=4, population=4)
