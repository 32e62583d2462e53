"""The model jobs end to end on generated tables."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from panelspark.constants import AGE_BANDS, SEXES
from panelspark.operators.cohort import roll_coupled
from panelspark.operators.joins import stack
from panelspark.plans import jobs, model as M
from panelspark.session import materialize

CAUSES = ["Ischemic stroke", "Stomach cancer"]
PLACE = "Land"
YEARS = range(2009, 2020)
S = M.Settings()


def burden_rows():
    rnd = random.Random(1)
    out = []
    for sex in SEXES:
        for k, band in enumerate(AGE_BANDS):
            for y in YEARS:
                pop = 100_000 * math.exp(-0.03 * 5 * k) * (1 + 0.01 * (y - 2009))
                deaths = {c: pop * 1e-5 * (1 + k) ** 1.5 * (1 + 0.1 * i) * rnd.uniform(0.95, 1.05) for i, c in enumerate(CAUSES)}
                prev = {c: pop * 1e-3 * (1 + k) * (1 + 0.2 * i) for i, c in enumerate(CAUSES)}
                total = sum(deaths.values()) + pop * 2e-4 * (1 + k)
                for c, d, p in [*[(c, deaths[c], prev[c]) for c in CAUSES], ("All causes", total, pop * 0.9)]:
                    for m, v in (("Deaths", d), ("Prevalence", p)):
                        out.append((m, PLACE, sex, band, c, "Number", y, v))
                        out.append((m, PLACE, sex, band, c, "Rate", y, v / pop * 1e5))
    return out


@pytest.fixture(scope="module")
def burden(spark):
    df = spark.createDataFrame(burden_rows(), "measure string, location string, sex string, age string, cause string, metric string, year int, val double")
    return df.cache()


@pytest.fixture(scope="module")
def base(spark, burden):
    pop = spark.createDataFrame(
        [(PLACE, s, a, y, 20_000 * math.exp(-0.03 * a) * (1 + 0.01 * (y - 2009))) for s in SEXES for a in range(96) for y in YEARS],
        "location string, sex string, age int, year int, nx double")
    return M.base_rates(burden, pop, CAUSES, first_year=2009).cache()


@pytest.fixture(scope="module")
def rates(burden, base):
    return M.transition_rates(burden, base, range(2014, 2020)).cache()


@pytest.fixture(scope="module")
def newborn(spark, base):
    wide = spark.createDataFrame([(PLACE, *["60.0"] * 29)], "location string, " + ", ".join(f"y{y} string" for y in range(2022, 2051)))
    return M.births(base, wide, [f"y{y}" for y in range(2022, 2051)], 2019, fill_years=[2019, 2020, 2021]).cache()


def test_base_rates(burden, base):
    got = {(r.sex, r.cause, r.year, r.age): r for r in base.filter("year = 2010").collect()}
    assert {a for *_, a in got} == set(range(0, 98))
    raw = {(r.sex, r.age, r.cause, r.measure): r.val for r in burden.filter("year = 2010 and metric = 'Number'").collect()}
    rate = {(r.sex, r.age): r.val for r in burden.filter("year = 2010 and metric = 'Rate' and measure = 'Deaths' and cause = 'All causes'").collect()}
    for k in (0, 7, 19):
        band, age = AGE_BANDS[k], 5 * k + 2
        r = got["Male", CAUSES[0], 2010, age]
        nx = raw["Male", band, "All causes", "Deaths"] / (rate["Male", band] / 1e5)
        assert r.dis_mx == pytest.approx(raw["Male", band, CAUSES[0], "Deaths"] / nx)
        assert r.bg_mx == pytest.approx(r.all_mx - r.dis_mx) and r.bg_mx_all == r.bg_mx
        assert r.prev_rate == pytest.approx(raw["Male", band, CAUSES[0], "Prevalence"] / nx)
    a, b, mid = (got["Male", CAUSES[0], 2010, x] for x in (2, 7, 4))
    assert mid.all_mx == pytest.approx(a.all_mx + (b.all_mx - a.all_mx) * 0.4)
    assert got["Male", CAUSES[0], 2010, 0].prev_rate == a.prev_rate and a.nx is not None


def test_transition_rates(burden, base, rates):
    assert rates.count() == 6 * 96 * 2 * 2
    assert rates.filter("ir is null or cf is null or ir < 0 or ir > 0.9 or cf < 0 or cf > 0.9 or nx is null").count() == 0
    assert rates.filter("age = 95 and cf > 0").count() > 0
    closed = M.transition_rates(burden, base, range(2014, 2020), open_band_from_previous=False)
    assert closed.filter("age = 95").agg(F.max("cf")).first()[0] < rates.filter("age = 95").agg(F.max("cf")).first()[0]


def test_births(newborn):
    got = {(r.sex, r.year): r.births for r in newborn.collect()}
    assert sorted({y for _, y in got}) == list(range(2009, 2051))
    assert got["Female", 2025] + got["Male", 2025] == pytest.approx(60_000 * 0.7)
    a, b = got["Female", 2018], got["Female", 2022]
    assert [got["Female", y] for y in (2019, 2020, 2021)] == pytest.approx([a + (b - a) * k / 4 for k in (1, 2, 3)])


def test_calibration_finds_planted_factors(spark, rates, newborn):
    """Observed values made with known factors are found again, band by band."""
    panel = M.with_births(rates.filter("year between 2014 and 2019"), newborn.filter("year <= 2019"), 2014)
    true = panel.withColumns({"ir": F.col("ir") * 1.02, "cf": F.col("cf") * 0.97})
    sim = roll_coupled(true, M.PLACE, "cause", CAUSES, "age", "year", 2014, (0, 95)).withColumn("band", F.floor(F.col("age") / 5).cast("int"))
    band = sim.groupBy("location", "sex", "cause", "band", "year").agg(F.sum("dead").alias("Deaths"), F.sum("sick").alias("Prevalence"))
    labels = F.array(*[F.lit(b) for b in AGE_BANDS])
    seen = band.withColumn("age", F.get(labels, F.col("band"))).unpivot(["location", "sex", "cause", "age", "year"], ["Deaths", "Prevalence"], "measure", "val")
    seen = materialize(seen.withColumn("metric", F.lit("Number")))
    out = M.calibrate(rates, newborn, seen, 2014, 2019, CAUSES, passes=((range(-1, 4), range(-4, 2), 2.0, 1.0),), save=materialize)
    j = out.join(rates.select(*M.CELL, "cause", F.col("ir").alias("ir0"), F.col("cf").alias("cf0")), [*M.CELL, "cause"]).filter("ir0 > 0 and cf0 > 0")
    worst = j.select(F.max(F.abs(F.col("ir") / F.col("ir0") - 1.02)), F.max(F.abs(F.col("cf") / F.col("cf0") - 0.97)), F.count("*")).first()
    assert worst[2] > 1000 and worst[0] < 1e-9 and worst[1] < 1e-9


def test_status_rates(spark):
    survey = [(b, s, c + 0.5 * (y - 2013) / 10, e, y) for y in (2013, 2023) for s, f in (("Male", 1.0), ("Female", 0.2))
              for b, c, e in (("15-24", 16 * f, 5 * f), ("25-34", 30 * f, 9 * f), ("35-44", 31 * f, 9 * f), ("45-54", 27 * f, 8 * f), ("55-64", 25 * f, 7 * f), ("65+", 10 * f, 3 * f), ("Total", 20 * f, 6 * f))]
    df = spark.createDataFrame(survey, "age string, sex string, current double, ex double, year int")
    out = M.status_rates(df, range(2013, 2024)).cache()
    assert out.count() == 2 * 56 * 6
    assert out.filter("abs(never + current + ex - 100) > 1e-9 or init < 0 or init > 0.9 or cess < 0 or cess > 1").count() == 0
    assert {r.age for r in out.select("age").distinct().collect()} == set(range(10, 66))


@pytest.fixture(scope="module")
def inputs(spark):
    status = spark.createDataFrame(
        [(a, y, s, 70.0 - 0.2 * a, 20.0 + 0.1 * a, 10.0 + 0.1 * a, 0.01 if a < 30 else 0.002, 0.03) for a in range(10, 66) for y in range(2018, 2024) for s in SEXES],
        "age int, year int, sex string, never double, current double, ex double, init double, cess double")
    effects = spark.createDataFrame([("1.1", "10 to 25", "initiation", 0.28), ("1.3", "all", "both", 0.14), ("1.7", "all", "both", 0.6)],
                                    "code string, age_text string, target string, rrr double").withColumn("code", F.col("code").cast("decimal(3,1)"))
    risks = spark.createDataFrame([(c, rr, k, s) for c in CAUSES for k, rr in (("Nonsmoker", 1.0), ("Smoker", 3.0), ("Exsmoker", 1.5)) for s in SEXES],
                                  "cause string, rr double, category string, sex string")
    clinical = spark.createDataFrame([
        ("Hypertension treatment", CAUSES[0], "IR", 0.8), ("Hypertension control", CAUSES[0], "IR", 0.6), ("Hypertension control", CAUSES[0], "CF", 0.7),
        ("Diabetes treatment", CAUSES[0], "CF", 0.9), ("Diabetes control", CAUSES[0], "CF", 0.8), ("Second-hand smoke reduction", CAUSES[0], "IR", 0.97)],
        "name string, cause string, target string, rr double")
    levels = spark.createDataFrame([(y, s, 0.25, 0.5, 0.2, 0.1, 0.15, 0.4, 0.5) for y in range(2018, 2024) for s in SEXES],
                                   "year int, sex string, htn double, aware double, treated double, control double, dm double, connection double, quality double")
    return status, effects, risks, clinical, levels


CODES = ["1.0", "1.1", "1.3", "1.7"]


@pytest.fixture(scope="module")
def run(rates, newborn, inputs):
    status, effects, risks, clinical, levels = inputs
    eff = M.status_effect_table(effects, S)
    scen = materialize(M.status_scenarios(status, eff, CODES, S))
    table = M.effect_table([M.status_impact(scen, risks, S), M.second_hand_impact(clinical, S), M.care_impact(levels, clinical, S)], S)
    care = ["5.0", "5.1", "5.2", "5.3", "7.0", "7.1", "7.2", "7.3"]
    traj = materialize(M.trajectories(rates, newborn, table, [*CODES, "1.6", *care, "8.0"], S, CAUSES))
    return scen, table, traj


def test_effect_table(run):
    _, table, _ = run
    t = {(r.scenario, r.year, r.age, r.cause): (r.ir_eff, r.cf_eff) for r in table.filter("sex = 'Male'").collect()}
    assert t["1.0", 2030, 5, CAUSES[0]] == (1.0, 1.0) and t["1.0", 2023, 40, CAUSES[0]] == pytest.approx((1.0, 1.0))
    assert 0 < t["1.0", 2030, 40, CAUSES[0]][0] < t["1.3", 2030, 40, CAUSES[0]][0] < 1
    assert t["1.0", 2030, 80, CAUSES[0]] == pytest.approx(t["1.0", 2030, 65, CAUSES[0]])
    assert t["1.6", 2030, 10, CAUSES[0]] == (pytest.approx(0.97), 1.0) and t["1.6", 2030, 30, CAUSES[0]] == (1.0, 1.0)
    aware = {"5.1": 0.75, "5.2": 0.95}
    for code, a in aware.items():
        dt, dc = a * 0.4 - 0.2, a * 0.4 * 0.5 - 0.1
        assert t[code, 2030, 50, CAUSES[0]][0] == pytest.approx((1 - (dt - dc) * 0.2) * (1 - dc * 0.4))
    assert t["7.2", 2030, 50, CAUSES[0]][1] == pytest.approx(
        1 - (1 - (1 - (0.38 - 0.2 - 0.09) * 0.1) * (1 - 0.09 * 0.2)) * 0.15)
    combined = [math.prod(t[c, 2030, 50, CAUSES[0]][i] for c in ("1.0", "5.0", "7.0")) for i in (0, 1)]
    assert t["8.0", 2030, 50, CAUSES[0]] == pytest.approx(tuple(combined))


def test_projection_reports(spark, run):
    scen, _, traj = run
    assert traj.filter("scenario = '0'").count() == 96 * 12 * 2 * 2
    assert traj.filter("least(well, sick, dead, pop, all_dead, newcases) < 0").count() == 0
    totals = M.totals_by_scenario(traj)
    names = spark.createDataFrame([("1.1", "one"), ("1.0", "package")], "scenario string, name string")
    report = M.averted_report(totals, names, S, digits=None).cache()
    got = {(r.scenario, r.year): r for r in report.collect()}
    assert all(got[c, 2023].deaths_averted == pytest.approx(0, abs=1e-6) for c in ("1.0", "5.0", "7.3"))
    assert got["8.0", 2030].cum_deaths_averted > got["5.0", 2030].cum_deaths_averted > got["5.2", 2030].cum_deaths_averted > got["5.1", 2030].cum_deaths_averted > 0
    assert got["1.0", 2030].cum_deaths_averted > got["1.3", 2030].cum_deaths_averted > 0
    t = {r.scenario: r.deaths_averted for r in M.totals_report(report, 2023).collect()}
    assert t["8.0"] == pytest.approx(got["8.0", 2030].cum_deaths_averted, abs=1e-6)
    surv = {(r.scenario, r.year): r.dying_prob for r in M.survival_report(traj, ["0", "8.0"]).collect()}
    assert 0 < surv["8.0", 2030] < surv["0", 2030] < 1 and surv["8.0", 2023] == pytest.approx(surv["0", 2023])
    prev = {(r.scenario, r.sex, r.year): r.rate for r in M.prevalence_report(traj, scen, ["0", "1.0"]).collect()}
    assert prev["1.0", "Male", 2030] < prev["0", "Male", 2030]
    groups = {r.group_name: r for r in M.cause_report(traj, S, "8.0").collect()}
    assert set(groups) == {"CVD", "Cancer"} and groups["CVD"].percent > 0
    chain = {(r.scenario, r.year): r.cum_deaths_averted for r in M.chain_report(report, S).collect()}
    assert chain["5.1", 2030] + chain["5.2", 2030] + chain["5.4", 2030] == pytest.approx(got["5.0", 2030].cum_deaths_averted)
    ratio = M.additivity_report(report, S, ["1.1", "1.3", "1.7"]).first().ratio
    assert 0 < ratio
    costs = spark.createDataFrame([("1.1", 1000.0)], "code string, total_cost double").withColumn("code", F.col("code").cast("decimal(3,1)"))
    c = {r.scenario: r for r in M.cost_report(report, costs, ratio).collect()}
    assert c["1.1"].total_cost == 1000.0 and c["8.0"].cost_per_unit is None


def test_recompute_replaces_only_changed_scenarios(rates, newborn, inputs, run):
    status, effects, risks, clinical, levels = inputs
    _, _, traj = run
    results = materialize(M.totals_by_scenario(traj))
    old = {(r.scenario, r.year): r.dead for r in results.collect()}
    low = replace(S, arm_variants={"Hypertension": {"1": {"aware": 0.5}}, "Diabetes": {"1": {"aware": 0.5}}})
    new = M.recompute(results, rates, newborn, status, effects, risks, clinical, levels, low, chosen=["1.1", "1.7"], tax=5.0, causes=CAUSES)
    got = {(r.scenario, r.year): r.dead for r in new.collect()}
    assert set(got) == set(old)
    same = {s for s, _ in old} - {"1.0", "1.7", "5.1", "7.1"}
    assert all(got[k] == old[k] for k in old if k[0] in same)
    assert got["1.7", 2030] > old["1.7", 2030] and got["1.0", 2030] > old["1.0", 2030] and got["5.1", 2030] > old["5.1", 2030]
    # The totals the user did not touch are those of an independent run with the same targets.
    assert got["1.7", 2023] == pytest.approx(old["1.7", 2023])


def csv_of(df, path, names):
    df.select(*[F.col(c).cast("string").alias(h) for c, h in names.items()]).toPandas().to_csv(path, index=False)
    return str(path)


def test_jobs_read_and_write_tables(spark, burden, base, inputs, tmp_path):
    """Both jobs on files: calibrated rates with a tiny grid, then all reports."""
    status, effects, risks, clinical, levels = inputs
    def plain(df):
        return {c: c for c in df.columns}
    b = csv_of(burden, tmp_path / "burden.csv", plain(burden))
    pop = base.filter("age <= 95").select("location", "sex", "age", "year", "nx").distinct()
    p = csv_of(pop, tmp_path / "pop.csv", {"location": "location_name", "sex": "sex_name", "age": "age_group_name", "year": "year_id", "nx": "val"})
    w = tmp_path / "births.csv"
    years = list(range(2022, 2032))
    w.write_text("A title\n\nIndex,Variant,\"Region, subregion, country or area *\"," + ",".join(map(str, years)) + "\n1,Median," + PLACE + "," + ",".join(["60"] * len(years)) + "\n")
    out = str(tmp_path / "out")
    jobs.rates_job(spark, b, [p], str(w), out, CAUSES, passes=((range(0, 2), range(0, 1), 2.0, 1.0),))
    rates = spark.read.parquet(out + "/rates")
    assert rates.count() == 6 * 96 * 2 * 2 and rates.filter("ir is null or cf is null or nx is null").count() == 0
    files = dict(
        status=csv_of(status, tmp_path / "s.csv", {**plain(status), "sex": "Sex", "never": "Never", "current": "Current", "ex": "Ex"}),
        effects=csv_of(effects, tmp_path / "e.csv", {"code": "Code", "target": "Target", "age_text": "Age", "rrr": "RRR"}),
        risks=csv_of(risks, tmp_path / "r.csv", {"cause": "Cause", "rr": "RR", "category": "Category", "sex": "Sex"}),
        clinical=csv_of(clinical, tmp_path / "c.csv", {"name": "Intervention", "cause": "cause", "target": "target", "rr": "RR"}),
        levels=csv_of(levels, tmp_path / "l.csv", {"year": "year", "sex": "sex", "htn": "HTN", "aware": "Aware", "treated": "Treated", "control": "Control",
                                                   "dm": "DM", "connection": "connection.to.care", "quality": "quality.of.care"}),
        rates=out + "/rates", births=out + "/births")
    (tmp_path / "n.csv").write_text('Code,Intervention\n1.1,"first\nline"\n1,All\n')
    (tmp_path / "cost.csv").write_text("Code,Intervention,Total\n1.1,x,1000\n")
    import pandas as pd
    pd.read_csv(files["effects"]).assign(Intervention="x").to_csv(files["effects"], index=False)
    jobs.project_job(spark, **files, names=str(tmp_path / "n.csv"), costs=str(tmp_path / "cost.csv"), out=out, status_codes=["1.1", "1.3", "1.7"], causes=CAUSES)
    averted = spark.read.csv(out + "/averted", header=True, inferSchema=True, multiLine=True)
    assert averted.filter("year = 2030").count() == 14  # every scenario but the baseline
    assert averted.filter("cum_deaths_averted < 0 or deaths_averted < 0").count() == 0
    for name in ("totals", "averted_totals", "survival", "prevalence", "causes", "care_steps", "additivity", "costs"):
        assert spark.read.csv(f"{out}/{name}", header=True, multiLine=True).count() > 0, name


def test_stack_fills_missing_columns(spark):
    got = stack(spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3,)], "a int"))
    assert {tuple(r) for r in got.collect()} == {(1, 2), (3, None)}
