"""Report queries: averted outcomes, totals, decomposition, survival, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.constants import SMOKE_SHARE
from panelspark.functions.scalars import band_index
from panelspark.operators.effects import tax_effect
from panelspark.operators.joins import select_scenarios, upsert_scenarios
from panelspark.operators.report import (
    averted, averted_totals, cost_per_unit, group_shares, marginal, nonadditivity, scaled_parts, scenario_difference, share_check, survival_prob,
)
from panelspark.plans.effect_queries import lines
from panelspark.plans.registry import CELLS, FACTS, query, r, round_cols
from panelspark.sources.tables import cells, table, year_of

RESULTS_SQL = """res AS (
  SELECT o_orderstatus AS grp, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS scenario, sum(o_totalprice) AS dead, count(*) * 1e0 AS newcases
  FROM orders GROUP BY 1, 2, 3)"""


def signif_sql(x: str) -> str:
    e = f"(floor(log10(abs({x}))) - 2)"
    return (f"CASE WHEN {x} = 0 THEN {x} WHEN {e} >= 0 THEN round({x} / pow(10e0, {e})) * pow(10e0, {e}) "
            f"ELSE round({x} * pow(10e0, -{e})) / pow(10e0, -{e}) END")


AVERTED_SQL = RESULTS_SQL + f""", gain AS (
  SELECT s.grp, s.year, s.scenario, round(b.dead - s.dead, 2) AS d, b.newcases - s.newcases AS c FROM res s JOIN res b ON b.grp = s.grp AND b.year = s.year AND b.scenario = '5-LOW'
  WHERE s.scenario <> '5-LOW'),
av AS (SELECT grp, year, scenario, CASE WHEN d < 0 THEN 0e0 ELSE {signif_sql("d")} END AS deaths_averted, CASE WHEN c < 0 THEN 0e0 ELSE {signif_sql("c")} END AS cases_averted FROM gain)"""


def results(spark: SparkSession, d: str) -> DataFrame:
    """Order totals per status, year and priority as scenario results."""
    return table(spark, d, "orders").groupBy(
        F.col("o_orderstatus").alias("grp"), year_of("o_orderdate").alias("year"), F.col("o_orderpriority").alias("scenario")
    ).agg(F.sum("o_totalprice").alias("dead"), F.count(F.lit(1)).cast("double").alias("newcases"))


MEASURES = {"dead": "deaths_averted", "newcases": "cases_averted"}


@query("q30_averted", f"WITH {AVERTED_SQL} SELECT grp, year, scenario, {r('deaths_averted')} AS deaths_averted, {r('cases_averted')} AS cases_averted FROM av")
def q30(spark: SparkSession, d: str) -> DataFrame:
    return round_cols(averted(results(spark, d), ["grp"], "year", "scenario", "5-LOW", MEASURES))


@query("q31_cumulative_averted", f"""
WITH {AVERTED_SQL}, k AS (
  SELECT *, sum(deaths_averted) OVER w AS cd, sum(cases_averted) OVER w AS cc FROM av WINDOW w AS (PARTITION BY grp, scenario ORDER BY year))
SELECT grp, year, scenario, {r('deaths_averted')} AS deaths_averted, {r('cases_averted')} AS cases_averted,
       {r(signif_sql('cd'))} AS cum_deaths_averted, {r(signif_sql('cc'))} AS cum_cases_averted FROM k ORDER BY grp, scenario, year""")
def q31(spark: SparkSession, d: str) -> DataFrame:
    out = averted(results(spark, d), ["grp"], "year", "scenario", "5-LOW", MEASURES, cumulative=True)
    return round_cols(out).orderBy("grp", "scenario", "year")


@query("q32_totals_by_scenario", f"""
WITH {AVERTED_SQL} SELECT grp, scenario, {r('sum(deaths_averted)')} AS deaths_averted, {r('sum(cases_averted)')} AS cases_averted
FROM av WHERE year >= 1997 GROUP BY grp, scenario""")
def q32(spark: SparkSession, d: str) -> DataFrame:
    out = averted(results(spark, d), ["grp"], "year", "scenario", "5-LOW", MEASURES)
    return round_cols(averted_totals(out, ["grp", "scenario"], "year", 1997, list(MEASURES.values())))


@query("q32b_scenario_difference", f"""
WITH {RESULTS_SQL} SELECT grp, year, {r("sum(CASE scenario WHEN '5-LOW' THEN dead END)", 2)} AS base_value, {r("sum(CASE scenario WHEN '1-URGENT' THEN dead END)", 2)} AS scenario_value,
       {r("sum(CASE scenario WHEN '5-LOW' THEN dead END) - sum(CASE scenario WHEN '1-URGENT' THEN dead END)", 2)} AS difference
FROM res WHERE scenario IN ('5-LOW', '1-URGENT') GROUP BY grp, year""")
def q32b(spark: SparkSession, d: str) -> DataFrame:
    return round_cols(scenario_difference(results(spark, d), ["grp", "year"], "scenario", "5-LOW", "1-URGENT", "dead"), 2)


@query("q39_nonadditivity", f"""
WITH {FACTS}, t AS (SELECT location, code, sum(value * discount) AS v FROM facts GROUP BY 1, 2)
SELECT location, {r("sum(CASE WHEN code = 1 THEN v END)")} AS package_total, {r("sum(CASE WHEN code <> 1 THEN v END)")} AS parts_total,
       {r("sum(CASE WHEN code = 1 THEN v END) / nullif(sum(CASE WHEN code <> 1 THEN v END), 0)")} AS ratio FROM t GROUP BY location""")
def q39(spark: SparkSession, d: str) -> DataFrame:
    t = lines(spark, d).groupBy("location", "code").agg(F.sum(F.col("value") * F.col("discount")).alias("v"))
    return round_cols(nonadditivity(t, ["location"], "code", 1, "v"))


@query("q39b_scaled_parts", f"""
WITH {FACTS}, t AS (SELECT location, code, sum(value * discount) AS v, sum(value * tax) AS total_cost FROM facts GROUP BY 1, 2),
q AS (SELECT location, sum(CASE WHEN code = 1 THEN v END) / nullif(sum(CASE WHEN code <> 1 THEN v END), 0) AS ratio FROM t GROUP BY location)
SELECT t.location, t.code, {r("round(CASE WHEN code = 1 THEN v ELSE v * ratio END)")} AS v, {r("total_cost", 4)} AS total_cost,
       {r("total_cost / nullif(round(CASE WHEN code = 1 THEN v ELSE v * ratio END), 0)")} AS cost_per_unit
FROM t JOIN q ON t.location = q.location""")
def q39b(spark: SparkSession, d: str) -> DataFrame:
    """Parts scaled to add up to the package, and their cost per unit."""
    t = lines(spark, d).groupBy("location", "code").agg(
        F.sum(F.col("value") * F.col("discount")).alias("v"), F.sum(F.col("value") * F.col("tax")).alias("total_cost"))
    scaled = scaled_parts(t.select("location", "code", "v"), ["location"], "code", 1, "v")
    return round_cols(cost_per_unit(scaled, t, ["location", "code"], "v", "total_cost"), 6, total_cost=4)


CHAINS, NAMES = [["1", "2", "3"], ["5", "6", "7"]], {"3": "3 most", "7": "7 most"}


@query("q40_marginal_decomposition", f"""
WITH {FACTS}, t AS (SELECT location, year, CAST(code AS VARCHAR) AS scenario, sum(value) AS v FROM facts GROUP BY 1, 2, 3),
w AS (SELECT location, year, {", ".join(f"sum(CASE scenario WHEN '{c}' THEN v END) AS c{c}" for c in "123567")} FROM t WHERE scenario IN ('1', '2', '3', '5', '6', '7') GROUP BY 1, 2)
SELECT location, year, x.scenario, {r("CASE x.scenario WHEN '1' THEN c1 WHEN '2' THEN c2 - c1 WHEN '3 most' THEN c3 - c2 WHEN '5' THEN c5 WHEN '6' THEN c6 - c5 ELSE c7 - c6 END", 2)} AS v
FROM w, (VALUES ('1'), ('2'), ('3 most'), ('5'), ('6'), ('7 most')) x(scenario)""")
def q40(spark: SparkSession, d: str) -> DataFrame:
    t = lines(spark, d).groupBy("location", "year", F.col("code").cast("string").alias("scenario")).agg(F.sum("value").alias("v"))
    return round_cols(marginal(t, ["location", "year"], "scenario", "v", CHAINS, NAMES), 2)


@query("q41_survival_prob", f"""
WITH {CELLS}, b AS (SELECT location, year, (age - 1) // 5 AS band, sum(n_r + 0.5e0) AS dead, sum(20e0 * (n_a + n_n + n_r + 1)) AS pop FROM cells WHERE age <= 40 GROUP BY 1, 2, 3)
SELECT location, year, {r("1e0 - product(1e0 - 5e0 * (dead / pop) / (1e0 + 2.5e0 * (dead / pop)))")} AS dying_prob FROM b GROUP BY location, year""")
def q41(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).filter(F.col("age") <= 40).select(
        "location", "year", band_index("age", 5, first_age=1).alias("band"), (F.col("n_r") + 0.5).alias("dead"),
        (F.lit(20.0) * (F.col("n_a") + F.col("n_n") + F.col("n_r") + 1)).alias("pop"))
    return round_cols(survival_prob(c, ["location", "year"], "band", "dead", "pop"))


@query("q43_group_shares", f"""
WITH {FACTS}, t AS (SELECT location, CASE WHEN cause IN ('A', 'R') THEN 'returned' ELSE 'kept' END AS group_name, sum(value) AS deaths, sum(value * discount) AS averted FROM facts GROUP BY 1, 2)
SELECT location, group_name, {r("deaths", 2)} AS deaths, {r("averted", 4)} AS averted, {r("100e0 * averted / nullif(deaths, 0)")} AS percent FROM t""")
def q43(spark: SparkSession, d: str) -> DataFrame:
    t = lines(spark, d).withColumn("averted_value", F.col("value") * F.col("discount"))
    return round_cols(group_shares(t, "cause", {"returned": ["A", "R"]}, "kept", "value", "averted_value", ["location"]), 6, deaths=2, averted=4)


@query("q44_cost_per_unit", f"""
WITH {FACTS}, a AS (SELECT location, code, sum(value * discount) AS averted FROM facts GROUP BY 1, 2),
c AS (SELECT location, code, sum(value * tax) AS total_cost, avg(tax) * 1000e0 AS tax_level FROM facts WHERE code <> 7 GROUP BY 1, 2)
SELECT a.location, a.code, {r("round(averted * 0.7e0)")} AS averted, {r("total_cost", 4)} AS total_cost, {r("total_cost / nullif(round(averted * 0.7e0), 0)")} AS cost_per_unit,
       {r("least(0.95e0, 0.48e0 * tax_level / 28e0)")} AS effect, {r("tax_level + 28e0")} AS price, {r("100e0 * round(tax_level / (tax_level + 28e0), 2)")} AS tax_share
FROM a LEFT JOIN c ON c.location = a.location AND c.code = a.code""")
def q44(spark: SparkSession, d: str) -> DataFrame:
    """Costs are missing for one code; its cost per unit stays empty."""
    li = lines(spark, d)
    a = li.groupBy("location", "code").agg(F.sum(F.col("value") * F.col("discount")).alias("averted"))
    c = li.filter(F.col("code") != 7).groupBy("location", "code").agg(
        F.sum(F.col("value") * F.col("tax")).alias("total_cost"), (F.avg("tax") * 1000.0).alias("tax_level"))
    out = cost_per_unit(a, c, ["location", "code"], "averted", "total_cost", 0.7)
    out = out.join(c.select("location", "code", "tax_level"), ["location", "code"], "left").withColumns(tax_effect("tax_level"))
    return round_cols(out.drop("tax_level"), 6, total_cost=4)


@query("q45_scenario_upsert", f"""
WITH res AS (SELECT c_mktsegment AS scenario, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS dead FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
upd AS (SELECT scenario, year, dead * 0.9e0 AS dead FROM res WHERE scenario IN ('AUTOMOBILE', 'BUILDING') AND year >= 1997),
al AS (SELECT * FROM res WHERE scenario NOT IN (SELECT scenario FROM upd) UNION ALL SELECT * FROM upd)
SELECT scenario, year, {r("dead", 3)} AS dead FROM al WHERE scenario IN (SELECT c_mktsegment FROM customer WHERE c_nationkey = 3 GROUP BY 1 HAVING count(*) > 5)""")
def q45(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), year_of("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    c = table(spark, d, "customer")
    res = o.join(c.select("c_custkey", F.col("c_mktsegment").alias("scenario")), "c_custkey").groupBy("scenario", "year").agg(F.sum("v").alias("dead"))
    upd = res.filter(F.col("scenario").isin("AUTOMOBILE", "BUILDING") & (F.col("year") >= 1997)).withColumn("dead", F.col("dead") * 0.9)
    chosen = c.filter(F.col("c_nationkey") == 3).groupBy(F.col("c_mktsegment").alias("scenario")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 5)
    return round_cols(select_scenarios(upsert_scenarios(res, upd), chosen), 3)


@query("q49_share_check", f"""
WITH {FACTS}, t AS (SELECT location, year, round(sum(value), 2) AS base FROM facts WHERE age < 20 GROUP BY 1, 2),
a AS (SELECT *, {signif_sql(f"(base * {SMOKE_SHARE}e0)")} AS averted FROM t),
k AS (SELECT *, sum(averted) OVER (PARTITION BY location ORDER BY year) AS c FROM a)
SELECT location, year, {r("base", 2)} AS base, {r("averted")} AS averted, {r(signif_sql("c"))} AS cum_averted FROM k""")
def q49(spark: SparkSession, d: str) -> DataFrame:
    return round_cols(share_check(lines(spark, d), ["location"], "year", "age", "value"), 6, base=2)
