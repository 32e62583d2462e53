"""Effect queries: effect tables, impacts, phase-in, care cascade, transition matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.operators.effects import (
    add_package, apply_effects, cascade, cascade_impact, duplicate_target, effect_bands, effects_by_target, effects_wide,
    package_effects, phase_in, potential_impact, relative_risk_reduction,
)
from panelspark.operators.joins import stack
from panelspark.plans.registry import CELLS, FACTS, RATES, query, r, round_cols
from panelspark.plans.relational import RISK_SQL, risk_table
from panelspark.sources.tables import cells, rate_panel, table, year_of


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("location"), F.col("l_linestatus").alias("sex"), F.col("l_returnflag").alias("cause"),
        F.col("l_linenumber").alias("code"), year_of("l_shipdate").alias("year"), F.abs("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").cast("int").alias("age"))


# Effects per supplier: line number is the intervention, flag the target, status the age text.
EFFECT_SQL = FACTS + """, raw AS (
  SELECT location, code, CASE sex WHEN 'F' THEN '10 to 25' ELSE 'all' END AS age_text,
         CASE cause WHEN 'A' THEN 'initiation' WHEN 'N' THEN 'cessation' ELSE 'both' END AS target, avg(discount) * 5e0 AS rrr
  FROM facts GROUP BY 1, 2, 3, 4),
eff AS (
  SELECT location, code, 10 AS age_start, CASE age_text WHEN '10 to 25' THEN 25 ELSE 65 END AS age_stop,
         1e0 - (1e0 - coalesce(max(CASE target WHEN 'cessation' THEN rrr END), 0e0)) * (1e0 - coalesce(max(CASE target WHEN 'both' THEN rrr END), 0e0)) AS cessation,
         1e0 - (1e0 - coalesce(max(CASE target WHEN 'initiation' THEN rrr END), 0e0)) * (1e0 - coalesce(max(CASE target WHEN 'both' THEN rrr END), 0e0)) AS initiation
  FROM raw GROUP BY 1, 2, 3, 4)"""


def effect_rows(spark: SparkSession, d: str) -> DataFrame:
    from panelspark.functions.scalars import recode
    raw = lines(spark, d).groupBy(
        "location", "code", F.when(F.col("sex") == "F", "10 to 25").otherwise("all").alias("age_text"),
        recode("cause", {"A": "initiation", "N": "cessation", "R": "both"}).alias("target"),
    ).agg((F.avg("discount") * 5.0).alias("rrr"))
    return effects_by_target(
        effect_bands(raw, "age_text", "age_start", "age_stop"), ["location", "code", "age_start", "age_stop"], "target", "rrr",
        ["cessation", "initiation"])


@query("q34_effect_assembly", f"""
WITH {EFFECT_SQL}, pack AS (
  SELECT location, 10 AS age_start, 25 AS age_stop, 1e0 - product(1e0 - cessation) AS cessation, 1e0 - product(1e0 - initiation) AS initiation
  FROM eff WHERE age_stop = 25 GROUP BY 1
  UNION ALL SELECT location, 26, 65, 1e0 - product(1e0 - cessation), 1e0 - product(1e0 - initiation) FROM eff GROUP BY 1)
SELECT location, CAST(code AS INTEGER) AS code, CAST(age_start AS INTEGER) AS age_start, CAST(age_stop AS INTEGER) AS age_stop, {r("cessation")} AS cessation, {r("initiation")} AS initiation
FROM (SELECT * FROM eff UNION ALL SELECT location, 0, age_start, age_stop, cessation, initiation FROM pack) x""")
def q34(spark: SparkSession, d: str) -> DataFrame:
    eff = effect_rows(spark, d)
    pack = package_effects(eff, ["location"], ["cessation", "initiation"], "age_stop").withColumn("code", F.lit(0))
    return round_cols(stack(eff, pack).select("location", "code", "age_start", "age_stop", "cessation", "initiation"))


@query("q34b_effects_wide_packages", f"""
WITH {FACTS}, one AS (
  SELECT location, code, cause, 1e0 - avg(discount) / 0.73e0 AS impact FROM facts GROUP BY 1, 2, 3),
ir AS (SELECT location, code, cause, impact, 'IR' AS target FROM one),
cf AS (SELECT location, code, cause, 1e0 - (1e0 - impact) / 2e0 AS impact, 'CF' AS target FROM one WHERE code <> 3),
w AS (SELECT location, code, cause, coalesce(max(CASE target WHEN 'IR' THEN impact END), 1e0) AS ir_eff,
             coalesce(max(CASE target WHEN 'CF' THEN impact END), 1e0) AS cf_eff FROM (SELECT * FROM ir UNION ALL SELECT * FROM cf) GROUP BY 1, 2, 3)
SELECT location, CAST(code AS INTEGER) AS code, cause, {r("ir_eff")} AS ir_eff, {r("cf_eff")} AS cf_eff FROM (
  SELECT * FROM w UNION ALL SELECT location, 8, cause, product(ir_eff), product(cf_eff) FROM w WHERE code IN (1, 2, 4) GROUP BY location, cause) x""")
def q34b(spark: SparkSession, d: str) -> DataFrame:
    one = lines(spark, d).groupBy("location", "code", "cause").agg((F.lit(1.0) - F.avg("discount") / 0.73).alias("impact"))
    both = duplicate_target(one, "target", ["IR", "CF"]).filter((F.col("target") == "IR") | (F.col("code") != 3))
    both = both.withColumn("impact", F.when(F.col("target") == "CF", F.lit(1.0) - (F.lit(1.0) - F.col("impact")) / 2.0).otherwise(F.col("impact")))
    w = effects_wide(both, ["location", "code", "cause"], "target", "impact", {"IR": "ir_eff", "CF": "cf_eff"})
    return round_cols(add_package(w, "code", [1, 2, 4], 8, ["location", "cause"], ["ir_eff", "cf_eff"]).select(
        "location", "code", "cause", "ir_eff", "cf_eff"))


@query("q34c_apply_effects", f"""
WITH {RATES}, e AS (SELECT location, cause, 1e0 - avg(discount) AS ir_eff, 1e0 - avg(tax) AS cf_eff FROM facts WHERE sex = 'F' GROUP BY 1, 2)
SELECT q.location, q.sex, q.age, q.year, q.cause,
       {r("ir * CASE WHEN q.sex = 'F' THEN coalesce(ir_eff, 1e0) ELSE 1e0 END", 9)} AS ir,
       {r("cf * CASE WHEN q.sex = 'F' THEN coalesce(cf_eff, 1e0) ELSE 1e0 END", 9)} AS cf
FROM rates q LEFT JOIN e ON e.location = q.location AND e.cause = q.cause""")
def q34c(spark: SparkSession, d: str) -> DataFrame:
    """Effects for one status only; the other keeps its rates."""
    e = lines(spark, d).filter(F.col("sex") == "F").groupBy("location", "sex", "cause").agg(
        (F.lit(1.0) - F.avg("discount")).alias("ir_eff"), (F.lit(1.0) - F.avg("tax")).alias("cf_eff"))
    out = apply_effects(rate_panel(spark, d), e, ["location", "sex", "cause"], {"ir": "ir_eff", "cf": "cf_eff"})
    return round_cols(out.select("location", "sex", "age", "year", "cause", "ir", "cf"), 9)


@query("q35_potential_impact", f"""
WITH {CELLS}, {RISK_SQL},
t AS (SELECT location, sex, year, sum(n_a) + 1e0 AS a, sum(n_n) + 1e0 AS n, sum(n_r) + 1e0 AS r,
             sum(CASE WHEN age <= 25 THEN n_a ELSE 0 END) + 1e0 AS a2, sum(CASE WHEN age <= 25 THEN n_n ELSE 0 END) + 1e0 AS n2,
             sum(CASE WHEN age <= 25 THEN n_r ELSE 0 END) + 1e0 AS r2 FROM cells GROUP BY 1, 2, 3),
s AS (SELECT location, sex, year, 'A' AS category, a / (a + n + r) AS base_share, a2 / (a2 + n2 + r2) AS new_share FROM t
      UNION ALL SELECT location, sex, year, 'N', n / (a + n + r), n2 / (a2 + n2 + r2) FROM t
      UNION ALL SELECT location, sex, year, 'R', r / (a + n + r), r2 / (a2 + n2 + r2) FROM t)
SELECT location, s.sex, year, outcome, {r("sum(rr * base_share)")} AS alpha, {r("sum(rr * new_share) / sum(rr * base_share)")} AS impact
FROM s JOIN risk ON risk.sex = s.sex AND risk.category = s.category GROUP BY location, s.sex, year, outcome""")
def q35(spark: SparkSession, d: str) -> DataFrame:
    out = potential_impact(shares(spark, d), risk_table(spark, d), ["location", "sex", "year", "outcome"], ["sex"], "category")
    return round_cols(out)


def shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the flags per supplier, status and year: over all ages and over ages up to 25."""
    cols = ["n_a", "n_n", "n_r"]
    t = cells(spark, d).groupBy("location", "sex", "year").agg(
        *[(F.sum(c) + F.lit(1.0)).alias(c) for c in cols],
        *[(F.sum(F.when(F.col("age") <= 25, F.col(c)).otherwise(F.lit(0))) + F.lit(1.0)).alias(c + "2") for c in cols])
    base = F.col("n_a") + F.col("n_n") + F.col("n_r")
    new = F.col("n_a2") + F.col("n_n2") + F.col("n_r2")
    return t.select("location", "sex", "year", F.inline(F.array(*[
        F.struct(F.lit(c[-1].upper()).alias("category"), (F.col(c) / base).alias("base_share"), (F.col(c + "2") / new).alias("new_share"))
        for c in cols])))


@query("q36_phase_in", f"""
WITH {FACTS}, e AS (SELECT location, cause, 1e0 - avg(discount) * 5e0 AS rr FROM facts GROUP BY 1, 2)
SELECT location, cause, CAST(y AS INTEGER) AS year, CAST(a AS INTEGER) AS age, {r("rr")} AS rr,
       {r("CASE WHEN a > 20 THEN 1e0 ELSE 1e0 - CASE WHEN y < 2023 THEN 0e0 ELSE (1e0 - rr) * (y - 2023) / 7e0 END END")} AS impact
FROM e, range(2019, 2031) t(y), range(18, 23) u(a)""")
def q36(spark: SparkSession, d: str) -> DataFrame:
    e = lines(spark, d).groupBy("location", "cause").agg((F.lit(1.0) - F.avg("discount") * 5.0).alias("rr"))
    return round_cols(phase_in(e, "rr", "year", "age", range(2019, 2031), range(18, 23), 2023, 7, 20))


VARIANTS = {
    "screen1": {"aware": 0.75},
    "screen2": {"aware": 0.95},
    "treat1": {"connection": 0.95, "quality": 0.75},
    "treat2": {"aware": 0.95, "connection": 0.95, "quality": 0.75},
}


def _num(v) -> str:
    return "CAST(NULL AS DOUBLE)" if v is None else f"{v}e0"


CASCADE_SQL = CELLS + f""", lv AS (
  SELECT location, year + 22 AS year, 0.1e0 + 0.4e0 * sum(n_a + 1) / sum(n_a + n_n + n_r + 3) AS aware, 0.2e0 + 0.5e0 * sum(n_n + 1) / sum(n_a + n_n + n_r + 3) AS connection,
         0.3e0 + 0.3e0 * sum(n_r + 1) / sum(n_a + n_n + n_r + 3) AS quality, 0.2e0 + 0.1e0 * sum(n_r + 1) / sum(n_a + n_n + n_r + 3) AS htn
  FROM cells GROUP BY 1, 2),
lev AS (SELECT *, aware * connection AS treated, aware * connection * quality AS control FROM lv),
variants(scenario, ta, tc, tq) AS (VALUES {", ".join(f"('{n}', {_num(v.get('aware'))}, {_num(v.get('connection'))}, {_num(v.get('quality'))})" for n, v in VARIANTS.items())}),
ramp AS (
  SELECT scenario, location, CAST(t.y AS INTEGER) AS year, htn, aware + coalesce(ta - aware, 0e0) * (t.y - 2023) / 7e0 AS aware,
         connection + coalesce(tc - connection, 0e0) * (t.y - 2023) / 7e0 AS connection, quality + coalesce(tq - quality, 0e0) * (t.y - 2023) / 7e0 AS quality
  FROM lev, variants, range(2023, 2031) t(y) WHERE year = 2023),
casc AS (
  SELECT scenario, location, year, htn, aware, connection, quality, aware * connection AS treated, aware * connection * quality AS control FROM ramp
  UNION ALL SELECT scenario, location, CAST(year AS INTEGER), htn, aware, connection, quality, treated, control FROM lev, variants WHERE year < 2023)"""


def levels(spark: SparkSession, d: str) -> DataFrame:
    tot = F.sum(F.col("n_a") + F.col("n_n") + F.col("n_r") + 3)
    def share(c):
        return F.sum(F.col(c) + 1) / tot
    lv = cells(spark, d).groupBy("location", (F.col("year") + 22).alias("year")).agg(
        (F.lit(0.1) + F.lit(0.4) * share("n_a")).alias("aware"), (F.lit(0.2) + F.lit(0.5) * share("n_n")).alias("connection"),
        (F.lit(0.3) + F.lit(0.3) * share("n_r")).alias("quality"), (F.lit(0.2) + F.lit(0.1) * share("n_r")).alias("htn"))
    lv = lv.withColumn("treated", F.col("aware") * F.col("connection"))
    return lv.withColumn("control", F.col("treated") * F.col("quality"))


@query("q37_cascade", f"""
WITH {CASCADE_SQL}
SELECT scenario, location, year, {", ".join(r(c) + f" AS {c}" for c in ("aware", "connection", "quality", "htn", "treated", "control"))} FROM casc""")
def q37(spark: SparkSession, d: str) -> DataFrame:
    out = cascade(levels(spark, d), VARIANTS, "year", 2023, 2030)
    return round_cols(out.select("scenario", "location", "year", "aware", "connection", "quality", "htn", "treated", "control"))


@query("q37b_cascade_impact", f"""
WITH {CASCADE_SQL}, risk AS (
  SELECT location, cause, CASE sex WHEN 'F' THEN 'IR' ELSE 'CF' END AS target, 1e0 - avg(discount) * 4e0 AS rt, 1e0 - avg(discount) * 6e0 AS rc FROM facts GROUP BY 1, 2, 3),
i AS (SELECT c.scenario, c.location, c.year, c.htn, CASE WHEN c.treated - b.treated < 0.00001e0 THEN 0e0 ELSE c.treated - b.treated END AS dt,
             CASE WHEN c.control - b.control < 0.00001e0 THEN 0e0 ELSE c.control - b.control END AS dc
      FROM casc c JOIN lev b ON b.location = c.location AND b.year = 2023),
m AS (SELECT scenario, i.location, i.year, cause, target, htn, (1e0 - (dt - dc) * (1e0 - rt)) * (1e0 - dc * (1e0 - rc)) AS plain FROM i JOIN risk ON risk.location = i.location)
SELECT scenario, location, year, cause, target, {r("CASE WHEN target = 'CF' THEN 1e0 - (1e0 - plain) * htn ELSE plain END")} AS impact FROM m""")
def q37b(spark: SparkSession, d: str) -> DataFrame:
    lv = levels(spark, d)
    risk = lines(spark, d).groupBy("location", "cause", F.when(F.col("sex") == "F", "IR").otherwise("CF").alias("target")).agg(
        (F.lit(1.0) - F.avg("discount") * 4.0).alias("rr_treat"), (F.lit(1.0) - F.avg("discount") * 6.0).alias("rr_control"))
    out = cascade_impact(cascade(lv, VARIANTS, "year", 2023, 2030), lv.filter(F.col("year") == 2023), risk, ["location"], "year",
                         "cause", "target", "htn", risk_keys=["location"])
    return round_cols(out)


MATRIX = [("A", "A", 0.8), ("A", "N", 0.15), ("A", "R", 0.05), ("N", "A", 0.1), ("N", "N", 0.7), ("N", "R", 0.2), ("R", "A", 0.3), ("R", "N", 0.1), ("R", "R", 0.6)]


@query("q38_transition_matrix", f"""
WITH {FACTS}, {RISK_SQL}, mat(f, t, w) AS (VALUES {", ".join(f"('{a}', '{b}', {w}e0)" for a, b, w in MATRIX)}),
n AS (SELECT location, sex, cause AS category, count(*) AS n FROM facts GROUP BY 1, 2, 3),
s AS (SELECT *, n * 1e0 / sum(n) OVER (PARTITION BY location, sex) AS share FROM n),
new AS (SELECT location, sex, t AS category, sum(share * w) AS share FROM s JOIN mat ON f = category GROUP BY 1, 2, 3),
al AS (SELECT location, s.sex, outcome, sum(share * rr) AS alpha FROM s JOIN risk ON risk.sex = s.sex AND risk.category = s.category GROUP BY 1, 2, 3)
SELECT new.location, new.sex, al.outcome, {r("any_value(alpha)")} AS alpha, {r("sum(share * rr / alpha)")} AS rrr
FROM new JOIN risk ON risk.sex = new.sex AND risk.category = new.category JOIN al ON al.location = new.location AND al.sex = new.sex AND al.outcome = risk.outcome
GROUP BY new.location, new.sex, al.outcome""")
def q38(spark: SparkSession, d: str) -> DataFrame:
    from panelspark.operators.windows import with_group_aggs
    n = lines(spark, d).groupBy("location", "sex", F.col("cause").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    s = with_group_aggs(n, ["location", "sex"], tot=F.sum("n")).withColumn("share", F.col("n") / F.col("tot"))
    matrix = spark.createDataFrame(MATRIX, "from_category string, to_category string, weight double")
    out = relative_risk_reduction(s.select("location", "sex", "category", "share"), matrix, risk_table(spark, d),
                                  ["location", "sex", "outcome"], "category", risk_keys=["sex", "outcome"])
    return round_cols(out)
