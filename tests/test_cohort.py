"""Roll-forward and calibration against a plain year-by-year sweep."""

import itertools
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelspark.operators import calibrate as C, cohort as R
from panelspark.operators.joins import with_values

CAUSES = ["x", "y", "z"]
AGES, YEARS = range(0, 7), range(2000, 2006)
RATES = ("nx", "prev_rate", "dis_mx", "all_mx", "bg_mx", "bg_mx_all", "ir", "cf")


def panel(seed=0, places=("p", "q")):
    rnd = random.Random(seed)
    out = {}
    for place, a, t, c in itertools.product(places, AGES, YEARS, CAUSES):
        out[place, a, t, c] = dict(
            nx=rnd.uniform(50, 150), prev_rate=rnd.uniform(0, 0.2), dis_mx=rnd.uniform(0, 0.02), all_mx=rnd.uniform(0.01, 0.1),
            bg_mx=rnd.uniform(0, 0.3), bg_mx_all=rnd.uniform(0, 0.3), ir=rnd.choice([rnd.uniform(0, 0.3), 0.0, 1.4]), cf=rnd.uniform(0, 1.2))
    return out


def frame(spark, cells):
    return spark.createDataFrame(
        [(*k, *[v[n] for n in RATES]) for k, v in cells.items()],
        "place string, age int, year int, cause string, " + ", ".join(f"{n} double" for n in RATES))


def sweep(cells, places, fi=1.0, fc=1.0):
    cap = lambda x: min(x, 0.9)
    st = {}
    for (p, a, t, c), r in cells.items():
        if t == YEARS[0] or a == AGES[0]:
            well = r["nx"] * (1 - (r["prev_rate"] + r["all_mx"]))
            st[p, a, t, c] = dict(well=well, newcases=well * r["ir"] * fi, sick=r["nx"] * r["prev_rate"], dead=r["nx"] * r["dis_mx"],
                                  pop=r["nx"], all_dead=r["nx"] * r["all_mx"])
    for t in YEARS[1:]:
        for p in places:
            for a in AGES[:-1]:
                new = {}
                for c in CAUSES:
                    s, r = st.get((p, a, t - 1, c)), cells.get((p, a, t, c))
                    if s is None or r is None:
                        continue
                    ir, cf = cap(r["ir"] * fi), cap(r["cf"] * fc)
                    new[c] = dict(newcases=max(0, s["well"] * ir), sick=max(0, s["sick"] * (1 - (cf + r["bg_mx"])) + s["well"] * ir),
                                  dead=s["sick"] * cf, pop=max(0, s["pop"] - s["all_dead"]), bg=r["bg_mx_all"])
                deaths = sum(n["dead"] for n in new.values())
                for c, n in new.items():
                    n["all_dead"] = max(0, deaths + n["pop"] * n.pop("bg"))
                    n["well"] = max(0, n["pop"] - n["all_dead"] - n["sick"])
                    st[p, a + 1, t, c] = n
    return st


def check(df, want):
    got = {(r.place, r.age, r.year, r.cause): r for r in df.collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        for name, v in w.items():
            assert got[k][name] == pytest.approx(v, abs=1e-9), (k, name)


def roll(df, **kw):
    return R.roll_coupled(df, kw.pop("keys", ["place"]), "cause", CAUSES, "age", "year", YEARS[0], (AGES[0], AGES[-1]), **kw)


def test_coupled_roll_equals_yearly_sweep(spark):
    cells = panel()
    check(roll(frame(spark, cells)), sweep(cells, "pq"))


def test_missing_part_and_missing_year(spark):
    cells = panel(1)
    for t in YEARS:
        del cells["p", 3, t, "y"]          # a part is missing at one age
    for c in CAUSES:
        del cells["q", 2, YEARS[2], c]     # a whole cell is missing in one year
    want = sweep(cells, "pq")
    check(roll(frame(spark, cells)), want)


def test_repeated_cell_raises(spark):
    df = frame(spark, panel(2, "p"))
    with pytest.raises(PySparkException, match="duplicate key"):
        roll(df.union(df.limit(1))).collect()


def test_neutral_effects_give_the_baseline_and_nothing_is_negative(spark):
    cells = panel(3)
    df = with_values(frame(spark, cells), "scenario", ["0", "same"])
    out = roll(df, keys=["scenario", "place"]).cache()
    assert out.filter("least(well, newcases, sick, dead, pop, all_dead) < 0").count() == 0
    a = out.filter("scenario = '0'").drop("scenario")
    assert a.exceptAll(out.filter("scenario = 'same'").drop("scenario")).count() == 0
    free = out.filter("well > 0 and sick > 0").select(F.max(F.abs(F.col("well") + F.col("sick") + F.col("all_dead") - F.col("pop")))).first()[0]
    seeds = 1  # seeds count prevalent cases and deaths from the same population
    assert free is not None and seeds


def test_grid_is_the_same_as_scaled_rates(spark):
    cells = panel(4)
    out = roll(frame(spark, cells), grid={"i": (range(-1, 2), "ir", 0.1), "j": (range(0, 2), "cf", 0.2)})
    for i, j in ((-1, 0), (1, 1)):
        check(out.filter((F.col("i") == i) & (F.col("j") == j)), sweep(cells, "pq", 1 + i * 0.1, 1 + j * 0.2))


def test_carry_belongs_to_the_same_cell(spark):
    cells = panel(5, "p")
    df = frame(spark, cells).withColumn("tag", F.concat_ws("/", "age", "year", "cause"))
    out = roll(df, carry=["tag"], with_rates=True).collect()
    assert out and all(r.tag == f"{r.age}/{r.year}/{r.cause}" for r in out)
    assert all(r.ir == pytest.approx(min(cells["p", r.age, r.year, r.cause]["ir"], 0.9)) for r in out)


def test_composition_keeps_its_sum(spark):
    rnd = random.Random(6)
    data = []
    for p, a, t in itertools.product("pq", range(10, 18), range(2000, 2007)):
        n = rnd.uniform(0, 100); c = rnd.uniform(0, 100 - n)
        data.append((p, a, t, n, c, 100 - n - c, rnd.uniform(0, 0.5), rnd.uniform(0, 1)))
    df = spark.createDataFrame(data, "place string, age int, year int, never double, current double, ex double, init double, cess double")
    got = {(r.place, r.age, r.year): r for r in R.roll_composition(df, ["place"], "age", "year", 2000, (10, 17)).collect()}
    have = {d[:3]: d[3:] for d in data}
    assert len(got) == len(data)
    state = {}
    for (p, a, t) in sorted(have, key=lambda k: k[2]):
        n, c, e, i, q = have[p, a, t]
        if t > 2000 and a > 10:
            n0, c0, e0 = state[p, a - 1, t - 1]
            _, _, _, i0, q0 = have[p, a - 1, t]
            n, c, e = n0 * (1 - i0), c0 * (1 - q0) + n0 * i0, c0 * q0 + e0
        state[p, a, t] = (n, c, e)
        r = got[p, a, t]
        assert (r.never, r.current, r.ex) == pytest.approx((n, c, e)) and r.never + r.current + r.ex == pytest.approx(100)
        assert (r.init, r.cess) == pytest.approx((i, q))


def test_calibration_equals_brute_force(spark):
    cells = panel(7)
    rnd = random.Random(8)
    band = lambda a: a // 3
    obs = {(p, c, b, t): (rnd.uniform(0, 20), rnd.uniform(5, 60)) for p in "pq" for c in CAUSES for b in range(3) for t in YEARS}
    df = frame(spark, cells).withColumn("band", F.floor(F.col("age") / 3).cast("int"))
    odf = spark.createDataFrame([(*k, *v) for k, v in obs.items()], "place string, cause string, band int, year int, obs_dead double, obs_sick double")
    errors = C.calibration_errors(df, odf, ["place"], "cause", CAUSES, "age", "year", YEARS[0], (AGES[0], AGES[-1]), "band",
                                  range(-2, 3), range(-2, 3), 0.1)
    best = C.fit(errors, ["place", "cause", "band"])
    got = {(r.place, r.cause, r.band): (r.i, r.j, r.error) for r in best.collect()}
    table = {}
    for i, j in itertools.product(range(-2, 3), range(-2, 3)):
        st = sweep(cells, "pq", 1 + i * 0.1, 1 + j * 0.1)
        sums = {}
        for (p, a, t, c), s in st.items():
            r = cells[p, a, t, c]
            if 0 < min(r["ir"] * (1 + i * 0.1), 0.9) and 0 < min(r["cf"] * (1 + j * 0.1), 0.9):
                d = sums.setdefault((p, c, band(a), t), [0.0, 0.0])
                d[0] += s["dead"]; d[1] += s["sick"]
        for p, c, b in itertools.product("pq", CAUSES, range(3)):
            ks = [(p, c, b, t) for t in YEARS if (p, c, b, t) in sums]
            if ks:
                rd = math.sqrt(sum((sums[k][0] - obs[k][0]) ** 2 for k in ks) / len(ks))
                rs = math.sqrt(sum((sums[k][1] - obs[k][1]) ** 2 for k in ks) / len(ks))
                table.setdefault((p, c, b), []).append((2 * rd + rs, i, j))
    assert set(got) == set(table)
    for k, cand in table.items():
        e, i, j = min(cand)
        assert got[k][2] == pytest.approx(e) and (got[k][:2] == (i, j) or min(x for x in cand if x[1:] == got[k][:2])[0] == pytest.approx(e))


def test_multipliers_without_fit(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0)], "k string, ir double, cf double")
    best = spark.createDataFrame([("a", 10, -10)], "k string, i int, j int")
    got = {r.k: (r.ir, r.cf) for r in C.apply_multipliers(df, best, ["k"], 0.01, missing=0.0).collect()}
    assert got == {"a": (pytest.approx(1.1), pytest.approx(1.8)), "b": (0.0, 0.0)}


def test_plan_does_not_grow_with_years(spark):
    def exchanges(last):
        df = spark.range(10).selectExpr("concat('p', id) place", "cast(id as int) age", "'x' cause", *[f"0.1D {n}" for n in RATES])
        df = with_values(df, "year", range(2000, last))
        plan = R.roll_coupled(df, ["place"], "cause", ["x"], "age", "year", 2000, (0, 9))._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange"), plan
    (a, _), (b, plan) = exchanges(2003), exchanges(2060)
    assert a == b == 1
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_cohorts_of_one_place_fill_the_tasks(spark):
    """One place and one grid value: the cohorts still go to many tasks, and the errors are those of the undivided sum."""
    data = [("p", a, t, 1000.0 + a, 0.1, 0.01, 0.02, 0.01, 0.01, 0.02 + a / 1000, 0.05, "x", a // 5) for a in range(0, 40) for t in range(2000, 2008)]
    df = spark.createDataFrame(data, "place string, age int, year int, nx double, prev_rate double, dis_mx double, all_mx double, bg_mx double, "
                                     "bg_mx_all double, ir double, cf double, cause string, band int")
    seen = df.groupBy("place", "cause", "band", "year").agg(F.sum("nx").alias("obs_dead"), F.sum("nx").alias("obs_sick"))
    rolled = R.roll_coupled(df, ["place"], "cause", ["x"], "age", "year", 2000, (0, 39), carry=["band"], spread=["place"], blocks=16)
    before = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        assert R.roll_coupled(df, ["place"], "cause", ["x"], "age", "year", 2000, (0, 39), carry=["band"], spread=["place"], blocks=16).select(
            F.spark_partition_id().alias("task")).distinct().count() >= 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(before))
    plain = R.roll_coupled(df, ["place"], "cause", ["x"], "age", "year", 2000, (0, 39), carry=["band"])
    assert rolled.exceptAll(plain).count() == 0 and rolled.count() == plain.count()
    args = (df, seen, ["place"], "cause", ["x"], "age", "year", 2000, (0, 39), "band", range(-1, 2), range(-1, 2))
    one = {(r.band, r.i, r.j): (r.rmse_dead, r.rmse_sick) for r in C.calibration_errors(*args).collect()}
    many = {(r.band, r.i, r.j): (r.rmse_dead, r.rmse_sick) for r in C.calibration_errors(*args, cohort_blocks=5).collect()}
    assert one.keys() == many.keys() and all(many[k] == pytest.approx(v, rel=1e-9) for k, v in one.items())
