"""Growth, effects and reports."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelspark.operators import effects as E, growth as G, report as R
from tests.conftest import rows


def test_growth_expansion_and_projection(spark):
    df = spark.createDataFrame([("a", 100.0, 0.1)], "k string, v double, g double")
    got = rows(G.expand_growth(df, {"v": "g"}, 3), "step")
    assert [r["v"] for r in got] == pytest.approx([100.0, 110.0, 121.0])
    p = spark.createDataFrame([(2018, 1.0), (2019, 2.0), (2025, 9.0)], "year int, v double")
    assert {(r.year, r.v) for r in G.project_forward(p, "year", 2019, 2021).collect()} == {(2018, 1.0), (2019, 2.0), (2020, 2.0), (2021, 2.0)}
    e = spark.createDataFrame([(2, 5.0), (3, 6.0)], "age int, v double")
    assert {(r.age, r.v) for r in G.extend_edges(e, "age", 2, [1, 0], {"v": -1.0}).collect()} == {(0, -1.0), (1, -1.0), (2, 5.0), (3, 6.0)}


def py_rates(prev, prev2, rate, rate2, death, death2, drate, drate2, all1, all2, n=5):
    def div(a, b):
        return a / b if b else (None if a == 0 else math.copysign(math.inf, a))
    def growth(a, b, clip=True):
        q = None if a is None or b is None else div(b, a)
        g = None if q is None or q < 0 else (-math.inf if q == 0 else (math.inf if q == math.inf else math.log(q) / n))
        if clip and g is not None:
            g = 0 if g < 0 else (0.99 if g > 1 else g)
        return g
    pop1, pop2 = div(death, drate) , div(death2, drate2)
    pop1, pop2 = (None if x is None else x * 1e5 for x in (pop1, pop2))
    w1 = None if pop1 is None else pop1 - prev - all1
    w2 = None if pop2 is None else pop2 - prev2 - all2
    gw = growth(None if w1 is None else div(w1, pop1), None if w2 is None else div(w2, pop2), False)
    gs, gd = growth(rate, rate2), growth(drate, drate2)
    def at(v, g, k):
        return v if k == 1 else (math.nan if v is None or g is None else v * (1 + g) ** (k - 1))
    def over(a, b):
        if a is None or b is None or math.isnan(a) or math.isnan(b):
            return None
        return div(a, b)
    ir, cf = [], []
    for k in range(2, n + 1):
        s, s0, d, w0 = at(prev, gs, k), at(prev, gs, k - 1), at(death, gd, k), at(w1, gw, k - 1)
        cf.append(over(d, s0))
        ir.append(over(s - (s0 - d), w0))
    def mean(x):
        x = [v for v in x if v is not None and not math.isnan(v)]
        m = sum(x) / len(x) if x else math.nan
        return m
    i, c = mean(ir), mean(cf)
    return (0.0 if math.isnan(i) or i < 0 else (0.9 if i > 1 else i)), (0.0 if math.isnan(c) else (0.9 if c > 1 else c))


@pytest.mark.parametrize("case", [
    dict(prev=100, prev2=150, rate=1000, rate2=1400, death=5, death2=6, drate=50, drate2=56, all1=50, all2=70),
    dict(prev=0, prev2=10, rate=0, rate2=100, death=0, death2=1, drate=0, drate2=10, all1=50, all2=70),     # growth from zero
    dict(prev=100, prev2=50, rate=1000, rate2=400, death=5, death2=3, drate=50, drate2=30, all1=50, all2=70),  # falling
    dict(prev=1, prev2=400, rate=10, rate2=4000, death=5, death2=300, drate=50, drate2=9000, all1=50, all2=700),  # very fast
    dict(prev=0, prev2=0, rate=0, rate2=0, death=5, death2=5, drate=50, drate2=50, all1=50, all2=50),  # deaths without cases
])
def test_disease_rates_edges(spark, case):
    data = []
    for t, s in ((2000, ""), (2005, "2")):
        c = {k: case[k + s] for k in ("prev", "rate", "death", "drate")}
        data.append(("L", "x", 3 if t == 2000 else 4, t, float(c["prev"]), float(c["rate"]), float(c["death"]), float(c["drate"])))
        data.append(("L", "All causes", 3 if t == 2000 else 4, t, 1.0, 1.0, float(case["all1"] if t == 2000 else case["all2"]), 1.0))
    df = spark.createDataFrame(data, "loc string, cause string, band int, year int, prev double, prev_rate double, death double, death_rate double")
    r = G.disease_transition_rates(df, ["loc"], "cause", "band", "year", 5, 1).collect()
    assert len(r) == 1 and (r[0].band, r[0].year) == (3, 2005)
    want = py_rates(case["prev"], case["prev2"], case["rate"], case["rate2"], case["death"], case["death2"], case["drate"], case["drate2"], case["all1"], case["all2"])
    assert (r[0].ir, r[0].cf) == pytest.approx(want)


def test_status_rates_of_a_cohort(spark):
    data = [("M", 20, 2000, 60.0, 30.0, 10.0), ("M", 25, 2005, 50.0, 35.0, 15.0), ("M", 65, 2000, 50.0, 40.0, 10.0)]
    df = spark.createDataFrame(data, "sex string, age int, year int, never double, current double, ex double")
    got = {r.age: (r.init, r.cess, r.year) for r in G.status_transition_rates(df, ["sex"], "age", "year", 5, 2005).collect()}
    gn, gc, ge = (math.log(b / a) / 5 for a, b in ((60, 50), (30, 35), (10, 15)))
    def rates(ge):
        i, q = [], []
        for k in range(2, 6):
            c, c0, n0, e = 30 * (1 + gc) ** (k - 1), 30 * (1 + gc) ** (k - 2), 60 * (1 + gn) ** (k - 2), 10 * (1 + ge) ** (k - 1)
            i.append((c - (c0 - e)) / n0); q.append(e / c0)
        return sum(i) / 4, sum(q) / 4
    assert got[20][:2] == pytest.approx(rates(ge)) and got[20][2] == 2005
    assert got[65] == (0.0, 0.0, 2005)
    never = G.status_transition_rates(df, ["sex"], "age", "year", 5, 2005, ex_rate_from="never").filter("age = 20").first()
    assert (never.init, never.cess) == pytest.approx(rates(gn))


def test_split_series(spark):
    hist = spark.createDataFrame([("L", "Female", 2014, 40.0), ("L", "Male", 2014, 60.0)], "location string, sex string, year int, births double")
    wide = spark.createDataFrame([("L", "0.2", "0.4")], "location string, y2016 string, y2017 string")
    out = G.split_series(wide, hist, ["location"], "sex", "year", "births", ["y2016", "y2017"], ("Female", "Male"), 1000.0, 0.7, 2050, [2015, 2018])
    got = {(r.sex, r.year): r.births for r in out.collect()}
    assert got["Female", 2016] == pytest.approx(56.0) and got["Male", 2017] == pytest.approx(168.0)
    assert got["Female", 2015] == pytest.approx(48.0) and got["Male", 2018] == pytest.approx(168.0)


def test_effect_table_and_package(spark):
    df = spark.createDataFrame([
        ("1.1", "10 to 25", "initiation", 0.28), ("1.3", "all", "both", 0.14), ("1.5", "all", "cessation", 0.5)],
        "code string, age_text string, target string, rrr double")
    eff = E.effects_by_target(E.effect_bands(df, "age_text", "age_start", "age_stop"), ["code", "age_start", "age_stop"], "target", "rrr", ["cessation", "initiation"])
    got = {r.code: (r.age_stop, r.cessation, r.initiation) for r in eff.collect()}
    assert got == {"1.1": (25, 0.0, pytest.approx(0.28)), "1.3": (65, pytest.approx(0.14), pytest.approx(0.14)), "1.5": (65, 0.5, 0.0)}
    pack = {(r.age_start, r.age_stop): (r.cessation, r.initiation) for r in E.package_effects(eff, [], ["cessation", "initiation"], "age_stop").collect()}
    assert pack[10, 25] == pytest.approx((0.0, 0.28)) and pack[26, 65] == pytest.approx((1 - 0.86 * 0.5, 1 - 0.72 * 0.86))
    with pytest.raises(PySparkException, match="duplicate key"):
        E.effects_by_target(df.union(df), ["code"], "target", "rrr", ["cessation", "initiation"]).collect()


def test_effects_wide_and_apply(spark):
    long = spark.createDataFrame([("1", "x", "IR", 0.8), ("1", "y", "CF", 0.5)], "scenario string, cause string, target string, impact double")
    wide = E.effects_wide(long, ["scenario", "cause"], "target", "impact", {"IR": "ir_eff", "CF": "cf_eff"})
    rates = spark.createDataFrame([("1", "x", 0.1, 0.2), ("1", "y", 0.1, 0.2), ("0", "x", 0.1, 0.2)], "scenario string, cause string, ir double, cf double")
    got = {(r.scenario, r.cause): (r.ir, r.cf) for r in E.apply_effects(rates, wide, ["scenario", "cause"], {"ir": "ir_eff", "cf": "cf_eff"}).collect()}
    assert got["1", "x"] == pytest.approx((0.08, 0.2)) and got["1", "y"] == pytest.approx((0.1, 0.1)) and got["0", "x"] == (0.1, 0.2)
    with pytest.raises(PySparkException, match="duplicate key"):
        E.effects_wide(long.union(long), ["scenario", "cause"], "target", "impact", {"IR": "ir_eff", "CF": "cf_eff"}).collect()


def test_scale_rates_starts_late_and_caps(spark):
    rates = spark.createDataFrame([("1", a, t, 0.1, 0.6) for a in (20, 30) for t in (2023, 2024)], "scenario string, age int, year int, init double, cess double")
    eff = spark.createDataFrame([("1", 10, 25, 0.9, 0.5)], "scenario string, age_start int, age_stop int, cessation double, initiation double")
    got = {(r.age, r.year): (r.init, r.cess) for r in E.scale_rates(rates, eff, "age", "year", 2024, on=["scenario"]).collect()}
    assert got[20, 2024] == pytest.approx((0.05, 1.0)) and got[20, 2023] == (0.1, 0.6) and got[30, 2024] == (0.1, 0.6)


def test_phase_in(spark):
    df = spark.createDataFrame([("x", 0.9)], "cause string, rr double")
    got = {(r.year, r.age): r.impact for r in E.phase_in(df, "rr", "year", "age", range(2019, 2031), range(19, 23), 2023, 7, 20).collect()}
    assert got[2022, 19] == 1.0 and got[2030, 20] == pytest.approx(0.9) and got[2030, 21] == 1.0 and got[2025, 19] == pytest.approx(1 - 0.1 * 2 / 7)


def test_cascade_and_its_impact(spark):
    lv = spark.createDataFrame([(2022, "F", 0.3, 0.4, 0.5, 0.1, 0.05, 0.2), (2023, "F", 0.4, 0.5, 0.5, 0.2, 0.1, 0.25)],
                               "year int, sex string, aware double, connection double, quality double, treated double, control double, htn double")
    out = E.cascade(lv, {"s": {"aware": 0.8}}, "year", 2023, 2030)
    got = {r.year: r for r in out.collect()}
    assert sorted(got) == list(range(2022, 2031)) and got[2022].treated == 0.1
    assert got[2030].aware == pytest.approx(0.8) and got[2030].treated == pytest.approx(0.4) and got[2030].control == pytest.approx(0.2)
    imp = E.cascade_impact(out, lv.filter("year = 2023").select("sex", "treated", "control"), [("x", "IR", 0.8, 0.5), ("x", "CF", 0.8, 0.5)],
                           ["sex"], "year", "cause", "target", "htn")
    v = {(r.year, r.target): r.impact for r in imp.collect()}
    plain = (1 - (0.2 - 0.1) * 0.2) * (1 - 0.1 * 0.5)
    assert v[2030, "IR"] == pytest.approx(plain) and v[2030, "CF"] == pytest.approx(1 - (1 - plain) * 0.25)
    assert v[2023, "IR"] == 1.0 and v[2022, "IR"] == 1.0  # increments below the floor do not count


def test_relative_risk_reduction(spark):
    shares = spark.createDataFrame([("k", "a", 0.6), ("k", "b", 0.4)], "key string, category string, share double")
    risk = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "category string, rr double")
    m = spark.createDataFrame([("a", "a", 0.9), ("a", "b", 0.1), ("b", "a", 0.5), ("b", "b", 0.5)], "from_category string, to_category string, weight double")
    r = E.relative_risk_reduction(shares, m, risk, ["key"], "category").first()
    new_a, new_b = 0.6 * 0.9 + 0.4 * 0.5, 0.6 * 0.1 + 0.4 * 0.5
    assert r.alpha == pytest.approx(1.4) and r.rrr == pytest.approx((new_a + 2 * new_b) / 1.4)


def test_tax_effect(spark):
    df = spark.createDataFrame([(28.0,), (100.0,)], "tax double").select("tax", *[c.alias(n) for n, c in E.tax_effect("tax").items()])
    got = {r.tax: (r.effect, r.price, r.tax_share) for r in df.collect()}
    assert got[28.0] == pytest.approx((0.48, 56.0, 50.0)) and got[100.0] == pytest.approx((0.95, 128.0, 78.0))


def test_averted_clips_rounds_and_cumulates(spark):
    df = spark.createDataFrame([(t, s, v) for t, vals in ((1, (1000.0, 876.6, 1001.0)), (2, (1000.0, 0.0, 1000.0))) for s, v in zip("0ab", vals)],
                               "year int, scenario string, dead double")
    got = {(r.scenario, r.year): (r.da, r.cum_da) for r in R.averted(df, [], "year", "scenario", "0", {"dead": "da"}, cumulative=True).collect()}
    assert got == {("a", 1): (123.0, 123.0), ("a", 2): (1000.0, 1120.0), ("b", 1): (0.0, 0.0), ("b", 2): (0.0, 0.0)}
    exact = {(r.scenario, r.year): r.da for r in R.averted(df, [], "year", "scenario", "0", {"dead": "da"}, digits=None).collect()}
    assert exact["a", 1] == pytest.approx(123.4)


def test_marginal_and_additivity(spark):
    df = spark.createDataFrame([("5.1", 10.0), ("5.2", 15.0), ("5.0", 30.0)], "scenario string, v double").withColumn("year", F.lit(1))
    got = {r.scenario: r.v for r in R.marginal(df, ["year"], "scenario", "v", [["5.1", "5.2", "5.0"]], {"5.0": "5.4"}).collect()}
    assert got == {"5.1": 10.0, "5.2": 5.0, "5.4": 15.0}
    assert R.nonadditivity(df, [], "scenario", "5.0", "v").first().ratio == pytest.approx(1.2)


def test_survival_probability(spark):
    df = spark.createDataFrame([(b, 1.0 + b, 1000.0) for b in range(8)], "band int, dead double, pop double").withColumn("k", F.lit(1))
    want = 1.0
    for b in range(8):
        m = (1.0 + b) / 1000
        want *= 1 - 5 * m / (1 + 2.5 * m)
    assert R.survival_prob(df, ["k"], "band", "dead", "pop").first().dying_prob == pytest.approx(1 - want)


def test_costs_with_missing_and_zero(spark):
    df = spark.createDataFrame([("a", 10.4), ("b", 0.2), ("c", 5.0)], "scenario string, da double")
    costs = spark.createDataFrame([("a", 100.0), ("b", 50.0)], "scenario string, total_cost double")
    got = {r.scenario: (r.da, r.cost_per_unit) for r in R.cost_per_unit(df, costs, ["scenario"], "da").collect()}
    assert got == {"a": (10.0, 10.0), "b": (0.0, None), "c": (5.0, None)}
