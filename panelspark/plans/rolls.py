"""Roll-forward queries: compositions, coupled states, scenario sweep, calibration."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.functions.scalars import band_index, piecewise_scale
from panelspark.operators.calibrate import apply_multipliers, calibration_errors, fit
from panelspark.operators.cohort import roll_composition, roll_coupled
from panelspark.operators.effects import apply_effects, effects_wide, scale_rates
from panelspark.operators.joins import bounded, with_values
from panelspark.operators.report import averted, model_vs_observed, prevalence_total
from panelspark.plans.registry import CAUSE_ROWS, FACTS, RATES, STATUS, query, r, round_cols
from panelspark.sources.tables import CAUSES, YEARS, cause_rows, gathered_cells, line_facts, rate_panel, status_panel

FIRST, AXIS = 1995, (1, 50)

# Composition: effects per flag for two age bands, scenario '0' without effects.
STATUS_ROLL = "WITH RECURSIVE " + STATUS + """, eff AS (
  SELECT cause AS scenario, CASE WHEN sex = 'F' THEN 1 ELSE 26 END AS age_start, CASE WHEN sex = 'F' THEN 25 ELSE 50 END AS age_stop,
         avg(discount) * 4e0 AS cessation, avg(tax) * 4e0 AS initiation FROM facts GROUP BY 1, 2, 3),
srates AS MATERIALIZED (
  SELECT x.scenario, s.location, s.sex, s.age, s.year, never, current, ex,
         CASE WHEN s.year >= 1997 THEN tuned_init * (1e0 - coalesce(initiation, 0e0)) ELSE tuned_init END AS init,
         CASE WHEN s.year >= 1997 THEN least(tuned_cess * (1e0 + coalesce(cessation, 0e0)), 1e0) ELSE tuned_cess END AS cess
  FROM (SELECT *, init * CASE WHEN age > 25 THEN 0.8e0 ELSE 0.9e0 END AS tuned_init,
               cess * CASE WHEN age > 25 THEN 0.7e0 ELSE 1.1e0 END AS tuned_cess FROM status) s
  CROSS JOIN (VALUES ('0'), ('A'), ('N'), ('R')) x(scenario)
  LEFT JOIN eff ON eff.scenario = x.scenario AND s.age BETWEEN age_start AND age_stop),
roll AS (
  SELECT scenario, location, sex, age, year, never, current, ex FROM srates WHERE year = 1995 OR age = 1
  UNION ALL
  SELECT p.scenario, p.location, p.sex, p.age + 1, p.year + 1,
         greatest(0e0, p.never * (1e0 - q.init)), greatest(0e0, p.current * (1e0 - q.cess) + p.never * q.init),
         greatest(0e0, p.current * q.cess + p.ex)
  FROM roll p JOIN srates q ON q.scenario = p.scenario AND q.location = p.location AND q.sex = p.sex AND q.age = p.age AND q.year = p.year + 1
  WHERE p.age < 50)"""


FLAG_SCENARIOS = ["0", *CAUSES]


def status_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """Composition of all scenarios, rolled forward."""
    young = F.col("sex") == "F"
    tax = _taxes(spark, d)
    eff = tax.groupBy(
        F.col("cause").alias("scenario"),
        F.when(young, F.lit(1)).otherwise(F.lit(26)).alias("age_start"),
        F.when(young, F.lit(25)).otherwise(F.lit(50)).alias("age_stop"),
    ).agg((F.avg("discount") * 4.0).alias("cessation"), (F.avg("tax") * 4.0).alias("initiation"))
    s = status_panel(spark, d, gathered_cells(spark, d, len(FLAG_SCENARIOS))).withColumns({
        "init": piecewise_scale("init", "age", 25, 0.9, 0.8), "cess": piecewise_scale("cess", "age", 25, 1.1, 0.7)})
    eff = bounded(eff, {"scenario": CAUSES, "age_start": [1, 26]})
    rates = scale_rates(with_values(s, "scenario", FLAG_SCENARIOS), eff, "age", "year", 1997, on=["scenario"])
    return roll_composition(rates, ["scenario", "location", "sex"], "age", "year", FIRST, AXIS, placed=True)


def _taxes(spark: SparkSession, d: str) -> DataFrame:
    from panelspark.sources.tables import table, year_of
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("cause"), F.col("l_linestatus").alias("sex"), year_of("l_shipdate").alias("year"),
        F.abs("l_discount").alias("discount"), F.col("l_tax").alias("tax"))


@query("q28_composition_roll", STATUS_ROLL + f"""
SELECT scenario, location, year, {r("avg(never) / 0.73e0")} AS never, {r("avg(current) / 0.73e0")} AS current, {r("avg(ex) / 0.73e0")} AS ex,
       {r("max(abs(never + current + ex - 100e0))", 6)} AS worst_sum, count(*) AS n_cells
FROM roll GROUP BY scenario, location, year""")
def q28(spark: SparkSession, d: str) -> DataFrame:
    """Mean shares as an index (73 percent is 100), which has no short decimals to round apart."""
    rolled = status_scenarios(spark, d)
    off = F.abs(F.col("never") + F.col("current") + F.col("ex") - 100.0)
    return round_cols(rolled.groupBy("scenario", "location", "year").agg(
        *[(F.avg(c) / 0.73).alias(c) for c in ("never", "current", "ex")],
        F.max(off).alias("worst_sum"), F.count(F.lit(1)).alias("n_cells")))


@query("q28b_composition_cells", STATUS_ROLL + f"""
SELECT scenario, location, sex, age, CAST(year AS INTEGER) AS year, {r("never / 0.73e0")} AS never, {r("current / 0.73e0")} AS current,
       {r("ex / 0.73e0")} AS ex
FROM roll""")
def q28b(spark: SparkSession, d: str) -> DataFrame:
    """All scenarios; shares as the index of q28."""
    rolled = status_scenarios(spark, d)
    return round_cols(rolled.select("scenario", "location", "sex", "age", "year", *[(F.col(c) / 0.73).alias(c) for c in ("never", "current", "ex")]))


def coupled_sql(keys: str, source: str, fi: str = "1e0", fc: str = "1e0") -> str:
    """Recursive CTE of the coupled roll-forward, advancing all cohorts by one year per round."""
    k = [c.strip() for c in keys.split(",")]
    own = ", ".join(f"p.{c}" for c in k)
    on = " AND ".join(f"q.{c} = p.{c}" for c in k)
    return f"""roll AS (
  SELECT {keys}, cause, age, year, nx * (1e0 - (prev_rate + all_mx)) AS well, nx * (1e0 - (prev_rate + all_mx)) * (ir * {fi}) AS newcases,
         nx * prev_rate AS sick, nx * dis_mx AS dead, nx AS pop, nx * all_mx AS all_dead
  FROM {source} WHERE year = 1995 OR age = 1
  UNION ALL
  SELECT {keys}, cause, age, year, greatest(0e0, pop - all_dead - sick) AS well, newcases, sick, dead, pop, all_dead FROM (
    SELECT *, greatest(0e0, sum(dead) OVER (PARTITION BY {keys}, year, age) + pop * bg) AS all_dead FROM (
      SELECT {own}, p.cause, p.age + 1 AS age, p.year + 1 AS year,
             greatest(0e0, p.well * least(q.ir * {fi}, 0.9e0)) AS newcases,
             greatest(0e0, p.sick * (1e0 - (least(q.cf * {fc}, 0.9e0) + q.bg_mx)) + p.well * least(q.ir * {fi}, 0.9e0)) AS sick,
             p.sick * least(q.cf * {fc}, 0.9e0) AS dead, greatest(0e0, p.pop - p.all_dead) AS pop, q.bg_mx_all AS bg
      FROM roll p JOIN {source} q ON {on} AND q.cause = p.cause AND q.age = p.age AND q.year = p.year + 1
      WHERE p.age < 50) a) b)"""


@query("q29_coupled_roll", "WITH RECURSIVE " + RATES + ", " + coupled_sql("location, sex", "rates") + f"""
SELECT location, sex, cause, CAST(age AS INTEGER) AS age, CAST(year AS INTEGER) AS year,
       {", ".join(r(c) + f" AS {c}" for c in ("well", "newcases", "sick", "dead", "pop", "all_dead"))}
FROM roll""")
def q29(spark: SparkSession, d: str) -> DataFrame:
    return round_cols(roll_coupled(rate_panel(spark, d), ["location", "sex"], "cause", CAUSES, "age", "year", FIRST, AXIS))


SCENARIOS = {"0": 0.0, "1": 1.0, "2": 2.0, "3": 4.0}
SWEEP_SQL = "WITH RECURSIVE " + RATES + """, lev AS (
  SELECT cause, year, avg(discount) AS disc, avg(tax) AS tax FROM facts GROUP BY 1, 2),
eff AS (SELECT scenario, cause, year, 1e0 - k * disc AS ir_eff, 1e0 - k * tax AS cf_eff
        FROM lev, (VALUES ('1', 1e0), ('2', 2e0), ('3', 4e0)) x(scenario, k) WHERE year >= 1997),
srates AS MATERIALIZED (
  SELECT x.scenario, q.location, q.sex, q.age, q.year, q.cause, nx, prev_rate, dis_mx, all_mx, bg_mx, bg_mx_all,
         ir * coalesce(ir_eff, 1e0) AS ir, cf * coalesce(cf_eff, 1e0) AS cf
  FROM rates q CROSS JOIN (VALUES ('0'), ('1'), ('2'), ('3')) x(scenario)
  LEFT JOIN eff ON eff.scenario = x.scenario AND eff.cause = q.cause AND eff.year = q.year),
""" + coupled_sql("scenario, location, sex", "srates")


def scenario_effects(spark: SparkSession, d: str) -> DataFrame:
    """Effects on both rates per scenario, cause and year, from 1997 on."""
    lev = _taxes(spark, d).filter(F.col("year") >= 1997).groupBy("cause", "year").agg(
        F.avg("discount").alias("IR"), F.avg("tax").alias("CF"))
    rows = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(k).alias("k")) for s, k in SCENARIOS.items() if k])
    long = lev.unpivot(["cause", "year"], ["IR", "CF"], "target", "x").select("*", F.inline(rows))
    long = long.withColumn("impact", F.lit(1.0) - F.col("k") * F.col("x"))
    wide = effects_wide(long, ["scenario", "cause", "year"], "target", "impact", {"IR": "ir_eff", "CF": "cf_eff"})
    return bounded(wide, {"scenario": list(SCENARIOS), "cause": CAUSES, "year": YEARS})


def sweep(spark: SparkSession, d: str) -> DataFrame:
    """All scenarios in one plan: scenario is a key of the panel."""
    rates = with_values(rate_panel(spark, d, gathered_cells(spark, d, len(SCENARIOS) * len(CAUSES))), "scenario", list(SCENARIOS))
    rates = apply_effects(rates, scenario_effects(spark, d), ["scenario", "cause", "year"], {"ir": "ir_eff", "cf": "cf_eff"})
    return roll_coupled(rates, ["scenario", "location", "sex"], "cause", CAUSES, "age", "year", FIRST, AXIS, placed=True)


@query("q29_scenario_sweep", SWEEP_SQL + f"""
SELECT scenario, location, cause, CAST(year AS INTEGER) AS year, {r("sum(dead)")} AS dead, {r("sum(newcases)")} AS newcases, {r("sum(pop)")} AS pop
FROM roll GROUP BY 1, 2, 3, 4""")
def q29s(spark: SparkSession, d: str) -> DataFrame:
    return round_cols(sweep(spark, d).groupBy("scenario", "location", "cause", "year").agg(
        F.sum("dead").alias("dead"), F.sum("newcases").alias("newcases"), F.sum("pop").alias("pop")))


@query("q29_scenario_averted", SWEEP_SQL + f""", t AS (
  SELECT scenario, location, year, sum(dead) AS dead, sum(newcases) AS newcases FROM roll GROUP BY 1, 2, 3)
SELECT t.scenario, t.location, CAST(t.year AS INTEGER) AS year, {r("greatest(b.dead - t.dead, 0e0)")} AS deaths_averted,
       {r("greatest(b.newcases - t.newcases, 0e0)")} AS cases_averted,
       {r("sum(greatest(b.dead - t.dead, 0e0)) OVER w")} AS cum_deaths_averted, {r("sum(greatest(b.newcases - t.newcases, 0e0)) OVER w")} AS cum_cases_averted
FROM t JOIN t b ON b.location = t.location AND b.year = t.year AND b.scenario = '0' WHERE t.scenario <> '0'
WINDOW w AS (PARTITION BY t.scenario, t.location ORDER BY t.year)""")
def q29a(spark: SparkSession, d: str) -> DataFrame:
    totals = sweep(spark, d).groupBy("scenario", "location", "year").agg(
        F.sum("dead").alias("dead"), F.sum("newcases").alias("newcases"))
    return round_cols(averted(totals, ["location"], "year", "scenario", "0",
                              {"dead": "deaths_averted", "newcases": "cases_averted"}, digits=None, cumulative=True))


# Calibration: observed deaths and cases per band of five ages.
def observed_sql(keys: str, counts: str) -> str:
    return f"""obs AS (
  SELECT {keys}, cause, CAST((age - 1) // 5 AS INTEGER) AS band, year, sum(0.03e0 * (n + 1)) AS obs_dead, sum(9e0 * (n + 1)) AS obs_sick
  FROM {counts} GROUP BY {keys}, cause, band, year)"""


def calibration_sql(keys: str, source: str, counts: str, i: int, j: int, step: str, weights: str, out: str) -> str:
    return f"""{observed_sql(keys, counts)}, grates AS MATERIALIZED (
  SELECT x.*, CAST(gi.i AS INTEGER) AS i, CAST(gj.j AS INTEGER) AS j FROM {source} x, range(-{i}, {i + 1}) gi(i), range(-{j}, {j + 1}) gj(j)),
{coupled_sql(keys + ", i, j", "grates", f"(1e0 + {'{p}'}i * {step})", f"(1e0 + {'{p}'}j * {step})")},
sums AS (
  SELECT {", ".join("m." + c.strip() for c in keys.split(","))}, m.cause, CAST((m.age - 1) // 5 AS INTEGER) AS band, m.year, m.i, m.j, sum(m.dead) AS d, sum(m.sick) AS s
  FROM roll m JOIN grates g ON {" AND ".join(f"g.{c.strip()} = m.{c.strip()}" for c in (keys + ", i, j, cause, age, year").split(","))}
  WHERE least(g.ir * (1e0 + g.i * {step}), 0.9e0) > 0 AND least(g.cf * (1e0 + g.j * {step}), 0.9e0) > 0
  GROUP BY ALL),
errs AS (
  SELECT {keys}, cause, band, i, j, sqrt(avg((obs_dead - d) * (obs_dead - d))) AS rd, sqrt(avg((obs_sick - s) * (obs_sick - s))) AS rs
  FROM sums JOIN obs USING ({keys}, cause, band, year) GROUP BY {keys}, cause, band, i, j),
best AS (
  SELECT *, {weights} AS error, row_number() OVER (PARTITION BY {keys}, cause, band ORDER BY {weights}, i, j) AS k FROM errs)
{out}"""


def _grid_sql(text: str) -> str:
    """Seeds read the grid columns without a table name, steps take those of the rates."""
    seed, step = text.split("UNION ALL\n  SELECT ", 1)
    return seed.replace("{p}", "") + "UNION ALL\n  SELECT " + step.replace("{p}", "q.")


def _observed(panel: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col("n").cast("double") + 1.0
    return panel.groupBy(*keys, "cause", "band", "year").agg(F.sum(n * 0.03).alias("obs_dead"), F.sum(n * 9.0).alias("obs_sick"))


@query("q33_calibration", _grid_sql("WITH RECURSIVE " + RATES + ", " + calibration_sql(
    "location, sex", "rates", "cause_rows", 1, 1, "0.05e0", "2e0 * rd + rs",
    f"SELECT location, sex, cause, band, i, j, {r('rd')} AS rmse_dead, {r('rs')} AS rmse_sick, {r('error')} AS error FROM best WHERE k = 1")))
def q33(spark: SparkSession, d: str) -> DataFrame:
    """Best multipliers per supplier, status, flag and band; cohorts of a supplier stay together."""
    band = band_index("age", 5, first_age=1).alias("band")
    counted = gathered_cells(spark, d, 3 * 3)
    counts = cause_rows(counted).select("*", band)
    panel = rate_panel(spark, d, counted).select("*", band)
    keys = ["location", "sex"]
    errors = calibration_errors(panel, _observed(counts, keys), keys, "cause", CAUSES, "age", "year", FIRST, AXIS, "band",
                                range(-1, 2), range(-1, 2), 0.05, placed=True)
    return round_cols(fit(errors, [*keys, "cause", "band"]))


NATIONAL = CAUSE_ROWS + """, nat AS (
  SELECT sex, cause, age, year, CAST(sum(n) AS BIGINT) AS n, CAST(sum(tot) AS BIGINT) AS tot FROM cause_rows GROUP BY 1, 2, 3, 4),
nrates AS MATERIALIZED (
  SELECT sex, age, year, cause, (100e0 + 10e0 * CAST(tot AS DOUBLE)) / 7.3e0 AS nx, (n + 1e0) / (tot + 3e0) * 0.1e0 AS prev_rate,
         (n + 1e0) / (tot + 3e0) * 0.01e0 AS dis_mx, 0.02e0 AS all_mx, 0.02e0 - (n + 1e0) / (tot + 3e0) * 0.01e0 AS bg_mx,
         0.02e0 - (n + 1e0) / (tot + 3e0) * 0.01e0 AS bg_mx_all, (n + 1e0) / (tot + 3e0) * 0.05e0 AS ir, (n + 2e0) / (tot + 4e0) * 0.1e0 AS cf
  FROM nat)"""


def national_counts(spark: SparkSession, d: str) -> DataFrame:
    total = line_facts(spark, d).groupBy("sex", "age", "year").agg(
        *[F.count(F.when(F.col("cause") == c, 1)).alias(f"n_{c.lower()}") for c in CAUSES])
    return cause_rows(total.withColumn("location", F.lit(0))).drop("location").withColumn("band", band_index("age", 5, first_age=1))


def national_rates(counts: DataFrame) -> DataFrame:
    n, tot = F.col("n").cast("double"), F.col("tot").cast("double")
    share = (n + 1.0) / (tot + 3.0)
    return counts.select(
        "sex", "age", "year", "cause", "band", ((F.lit(100.0) + F.lit(10.0) * tot) / 7.3).alias("nx"), (share * 0.1).alias("prev_rate"),
        (share * 0.01).alias("dis_mx"), F.lit(0.02).alias("all_mx"), (F.lit(0.02) - share * 0.01).alias("bg_mx"),
        (F.lit(0.02) - share * 0.01).alias("bg_mx_all"), (share * 0.05).alias("ir"), ((n + 2.0) / (tot + 4.0) * 0.1).alias("cf"))


@query("q33b_calibration_full_grid", _grid_sql("WITH RECURSIVE " + NATIONAL + ", " + calibration_sql(
    "sex", "nrates", "nat", 10, 10, "0.01e0", "2e0 * rd + rs",
    f"SELECT sex, cause, band, i, j, {r('rd', 4)} AS rmse_dead, {r('rs', 4)} AS rmse_sick, {r('error', 4)} AS error FROM best WHERE k = 1")))
def q33b(spark: SparkSession, d: str) -> DataFrame:
    """The whole 21 x 21 grid on the table of all suppliers together."""
    counts = national_counts(spark, d)
    errors = calibration_errors(national_rates(counts), _observed(counts, ["sex"]), ["sex"], "cause", CAUSES, "age", "year", FIRST, AXIS,
                                "band", range(-10, 11), range(-10, 11), 0.01)
    return round_cols(fit(errors, ["sex", "cause", "band"]), 4)


@query("q33c_apply_multipliers", _grid_sql("WITH RECURSIVE " + NATIONAL + ", " + calibration_sql(
    "sex", "nrates", "nat", 2, 2, "0.05e0", "rd",
    f"""SELECT q.sex, q.cause, q.age, q.year, CAST((q.age - 1) // 5 AS INTEGER) AS band, {r('q.ir * coalesce(1e0 + b.i * 0.05e0, 1e0)', 9)} AS ir, {r('q.cf * coalesce(1e0 + b.j * 0.05e0, 1e0)', 9)} AS cf
FROM nrates q LEFT JOIN best b ON b.k = 1 AND b.sex = q.sex AND b.cause = q.cause AND b.band = (q.age - 1) // 5""")))
def q33c(spark: SparkSession, d: str) -> DataFrame:
    """Second pass by deaths only, applied back to single ages."""
    counts = national_counts(spark, d)
    panel = national_rates(counts)
    errors = calibration_errors(panel, _observed(counts, ["sex"]), ["sex"], "cause", CAUSES, "age", "year", FIRST, AXIS,
                                "band", range(-2, 3), range(-2, 3), 0.05)
    best = fit(errors, ["sex", "cause", "band"], w_dead=1.0, w_sick=0.0)
    return round_cols(apply_multipliers(panel, best, ["sex", "cause", "band"], 0.05).select("sex", "cause", "age", "year", "band", "ir", "cf"), 9)


PASS_2 = re.sub(r"\b(obs|grates|roll|sums|errs|best)\b", r"\g<1>2", _grid_sql(calibration_sql(
    "sex", "rates2", "nat", 2, 3, "0.02e0", "rd",
    f"SELECT sex, cause, band, i, j, {r('rd', 4)} AS rmse_dead, {r('rs', 4)} AS rmse_sick, {r('error', 4)} AS error FROM best WHERE k = 1")))


@query("q54_calibrate_two_pass", _grid_sql("WITH RECURSIVE " + NATIONAL + ", " + calibration_sql(
    "sex", "nrates", "nat", 3, 3, "0.05e0", "2e0 * rd + rs", f""", rates2 AS MATERIALIZED (
  SELECT q.* REPLACE (q.ir * coalesce(1e0 + b.i * 0.05e0, 1e0) AS ir, q.cf * coalesce(1e0 + b.j * 0.05e0, 1e0) AS cf)
  FROM nrates q LEFT JOIN best b ON b.k = 1 AND b.sex = q.sex AND b.cause = q.cause AND b.band = (q.age - 1) // 5),
{PASS_2}""")))
def q54(spark: SparkSession, d: str) -> DataFrame:
    """Two passes on the table of all suppliers together: deaths and cases first, then deaths alone on the rates of pass 1."""
    counts = national_counts(spark, d)
    panel, observed, best = national_rates(counts), _observed(counts, ["sex"]), None
    for i_range, j_range, step, w_dead, w_sick in ((range(-3, 4), range(-3, 4), 0.05, 2.0, 1.0), (range(-2, 3), range(-3, 4), 0.02, 1.0, 0.0)):
        if best is not None:
            panel = apply_multipliers(panel, best, ["sex", "cause", "band"], 0.05)
        errors = calibration_errors(panel, observed, ["sex"], "cause", CAUSES, "age", "year", FIRST, AXIS, "band", i_range, j_range, step,
                                    cohort_blocks=4)
        best = fit(errors, ["sex", "cause", "band"], w_dead, w_sick)
    return round_cols(best, 4)


@query("q42_scenario_prevalence", STATUS_ROLL + f"""
SELECT p.scenario, p.location, CAST(p.year AS INTEGER) AS year, {r("sum(pop * current / 100e0)")} AS cases, {r("sum(pop)")} AS population,
       {r("sum(pop * current / 100e0) / sum(pop)")} AS rate
FROM roll p JOIN (SELECT location, sex, age, year, 10e0 * (n_a + n_n + n_r + 1) AS pop FROM cells) c
  ON c.location = p.location AND c.sex = p.sex AND c.age = p.age AND c.year = p.year GROUP BY 1, 2, 3""")
def q42(spark: SparkSession, d: str) -> DataFrame:
    pop = gathered_cells(spark, d, len(FLAG_SCENARIOS)).select(
        "location", "sex", "age", "year", (F.lit(10.0) * (F.col("n_a") + F.col("n_n") + F.col("n_r") + 1)).alias("pop"))
    return round_cols(prevalence_total(
        pop, status_scenarios(spark, d).select("scenario", "location", "sex", "age", "year", "current"),
        ["location", "sex", "age", "year"], ["scenario", "location", "year"], placed=True))


@query("q42b_model_vs_observed", STATUS_ROLL + f""", m AS (
  SELECT location, CAST(year AS INTEGER) AS year, avg(current) AS c, avg(ex) AS e FROM roll WHERE scenario = '0' GROUP BY 1, 2),
o AS (SELECT location, year, avg(current) AS c, avg(ex) AS e FROM status GROUP BY 1, 2),
x AS (SELECT m.location, m.year, m.c AS model_current, o.c AS obs_current, m.e AS model_ex, o.e AS obs_ex
      FROM m JOIN o ON o.location = m.location AND o.year = m.year)
SELECT location, year, metric, {r("val")} AS val FROM (UNPIVOT x ON model_current, obs_current, model_ex, obs_ex INTO NAME metric VALUE val)""")
def q42b(spark: SparkSession, d: str) -> DataFrame:
    keys = ["location", "year"]
    def mean(df):
        return df.groupBy(*keys).agg(F.avg("current").alias("current"), F.avg("ex").alias("ex"))
    rolled = status_scenarios(spark, d).filter(F.col("scenario") == "0")
    return round_cols(model_vs_observed(mean(rolled), mean(status_panel(spark, d)), keys, ["current", "ex"]))
