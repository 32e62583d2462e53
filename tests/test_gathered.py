"""Panels put in place once, as counted cells: whatever is made of them later meets, folds and adds up without another shuffle."""

import os
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelspark.operators import calibrate as C, cohort as R, joins as J, report as P
from panelspark.plans import catalog, model as M
from test_cohort import AGES, CAUSES, YEARS, frame, panel
from test_model import CAUSES as DISEASES, burden_rows

SF = "/root/testdata/sf0.001"
IN_PLACE = ["q33_calibration", "q29_scenario_sweep", "q29_scenario_averted", "q28_composition_roll", "q42_scenario_prevalence", "q52_transition_rates_job"]


@pytest.fixture
def no_broadcast(spark):
    """Small tables are joined as large ones are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffles(df):
    """The columns of every shuffle in the plan."""
    found = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())
    return [tuple(re.sub(r"#\w+", "", c).strip() for c in f.split(",")[:-1]) for f in found]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", IN_PLACE)
def test_only_lines_and_cells_are_shuffled(spark, no_broadcast, name):
    """No shuffle of rows of a supplier but those that count the lines and gather the counts, and of the winners of a fit."""
    found = [s for s in shuffles(catalog.QUERIES[name](spark, SF)) if "location" in s]
    winners = {("location", "sex", "cause", "band")} if name == "q33_calibration" else set()
    assert set(found) == {("location", "sex", "year"), ("location",)} | winners, found


def test_look_up_is_a_left_join(spark, no_broadcast):
    x = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 3), ("b", 1, None), (None, 1, 5)], "k string, t int, v int")
    y = spark.createDataFrame([("a", 1, 0.5, "p"), ("b", 1, None, "q"), ("c", 1, 2.0, "r"), (None, 1, 3.0, "s"), (None, 1, 4.0, "t")],
                              "k string, t long, w double, n string")
    got = J.look_up(x, y, ["k", "t"], ["w", "n"])
    assert [kind for _, kind in got.dtypes] == ["string", "int", "int", "double", "string"]
    def sorted_rows(df):
        return sorted(map(str, df.select("k", "t", "v", "w", "n").collect()))
    assert sorted_rows(got) == sorted_rows(x.join(y, ["k", "t"], "left").withColumn("t", F.col("t").cast("int")))
    with pytest.raises(PySparkException, match="duplicate key"):
        J.look_up(x, y.union(y.filter("w = 0.5")), ["k", "t"], ["w"]).collect()


def test_rows_of_one_gather_meet_in_place(spark, no_broadcast):
    held = J.gather(spark.range(40).select((F.col("id") % 5).alias("k"), F.col("id").alias("t")), ["k"], 2)
    wide = J.with_values(held, "s", ["0", "1"])
    got = J.look_up(wide, held.withColumn("v", F.col("t") * 2), ["k", "t"], ["v"])
    assert shuffles(got) == [("k",)] * 2 and got.count() == 80 and got.filter("v <> 2 * t or v is null").count() == 0


def test_calibration_in_place_is_the_same(spark, no_broadcast):
    """Missing observed values, parts and years included; both axes of the grid, with every cell of it."""
    cells = panel(11)
    for t in YEARS:
        del cells["p", 3, t, "y"]
    df = frame(spark, cells).withColumn("band", F.floor(F.col("age") / 3).cast("int"))
    seen = df.filter("not (place = 'q' and band = 1)").groupBy("place", "cause", "band", "year").agg(
        F.sum(F.col("nx") * 0.02).alias("obs_dead"), F.sum(F.col("nx") * 0.1).alias("obs_sick"))
    held = J.gather(df, ["place"], 3)
    observed = held.filter("not (place = 'q' and band = 1)").groupBy("place", "cause", "band", "year").agg(
        F.sum(F.col("nx") * 0.02).alias("obs_dead"), F.sum(F.col("nx") * 0.1).alias("obs_sick"))
    args = (["place"], "cause", CAUSES, "age", "year", YEARS[0], (AGES[0], AGES[-1]), "band", range(-2, 2), range(-1, 3), 0.1)
    inside = C.calibration_errors(held, observed, *args, placed=True)
    assert set(shuffles(inside)) == {("place",)}
    assert [s for s in shuffles(C.fit(inside, ["place", "cause", "band"])) if s != ("place",)] == [("place", "cause", "band")]
    def table(errors):
        return {(r.place, r.cause, r.band, r.i, r.j): (r.rmse_dead, r.rmse_sick) for r in errors.collect()}
    got, want = table(inside), table(C.calibration_errors(df, seen, *args))
    assert got.keys() == want.keys() and len({k[3:] for k in got}) == 16
    for k, v in want.items():
        assert got[k] == (pytest.approx(v) if v[0] is not None else v), k


def test_coupled_roll_in_place_is_the_same(spark, no_broadcast):
    """Missing parts and years, and a repeated cell, which raises here too."""
    cells = panel(12)
    for t in YEARS:
        del cells["p", 3, t, "y"]
    for c in CAUSES:
        del cells["q", 2, YEARS[2], c]
    held = J.with_values(J.gather(frame(spark, cells), ["place"], 2), "scenario", ["0", "1"])
    args = (["scenario", "place"], "cause", CAUSES, "age", "year", YEARS[0], (AGES[0], AGES[-1]))
    inside, plain = R.roll_coupled(held, *args, placed=True), R.roll_coupled(held, *args)
    assert shuffles(inside) == [("place",)] and shuffles(inside.groupBy("scenario", "place", "year").sum("dead")) == [("place",)]
    assert inside.count() == plain.count() > 0 and inside.exceptAll(plain).count() == 0
    with pytest.raises(PySparkException, match="duplicate key"):
        R.roll_coupled(held.union(held.limit(1)), *args, placed=True).collect()


def test_composition_in_place_is_the_same(spark, no_broadcast):
    """With a missing year, and a repeated cell, which raises here too."""
    data = [(p, a, t, 60.0 - a, 30.0 + t % 7, 10.0 + a - t % 7, 0.01 * a, 0.02 * (t % 5)) for p in "pq" for a in range(1, 9) for t in range(2000, 2006)
            if (p, t) != ("q", 2003)]
    df = spark.createDataFrame(data, "place string, age int, year int, never double, current double, ex double, init double, cess double")
    held = J.with_values(J.gather(df, ["place"], 2), "scenario", ["0", "1"])
    args = (["scenario", "place"], "age", "year", 2000, (1, 8))
    inside, plain = R.roll_composition(held, *args, placed=True), R.roll_composition(held, *args)
    assert shuffles(inside) == [("place",)] and inside.count() == plain.count() > 0 and inside.exceptAll(plain).count() == 0
    with pytest.raises(PySparkException, match="duplicate key"):
        R.roll_composition(held.union(held.limit(1)), *args, placed=True).collect()


def test_prevalence_in_place_is_the_same(spark, no_broadcast):
    """People or shares that are missing, or have no partner, count on neither side; NULL keys meet nothing."""
    pop = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, None), ("b", 1, 30.0), (None, 1, 40.0), ("c", 1, 5.0)], "k string, t int, pop double")
    shares = spark.createDataFrame([(s, k, t, v) for s in "01" for k, t, v in (("a", 1, 50.0), ("a", 2, None), ("a", 3, 7.0), ("b", 1, 25.0), (None, 1, 9.0), ("d", 1, 1.0))],
                                   "scenario string, k string, t int, current double")
    args = (["k", "t"], ["scenario", "k"])
    inside = P.prevalence_total(J.gather(pop, ["k"], 2), J.gather(shares, ["k"], 2), *args, placed=True)
    assert shuffles(inside) == [("k",)] * 2
    assert sorted(map(tuple, inside.collect())) == sorted(map(tuple, P.prevalence_total(pop, shares, *args).collect())) == [
        ("0", "a", 5.0, 10.0, 0.5), ("0", "b", 7.5, 30.0, 0.25), ("1", "a", 5.0, 10.0, 0.5), ("1", "b", 7.5, 30.0, 0.25)]


def test_rates_in_place_are_the_same(spark, no_broadcast):
    """Two places; bands without a total, an outcome or a population keep their rows."""
    kinds = "measure string, location string, sex string, age string, cause string, metric string, year int, val double"
    burden = J.with_values(spark.createDataFrame(burden_rows(), kinds).drop("location"), "location", ["p", "q"])
    burden = burden.filter("not (location = 'q' and year = 2011 and cause = 'All causes' and age = '20-24 years')")
    burden = burden.filter("not (location = 'p' and year = 2012 and measure = 'Deaths' and cause = 'Stomach cancer')")
    pop = J.with_axes(spark.createDataFrame([("p",), ("q",)], "location string"), {"sex": ["Female", "Male"], "age": range(0, 90), "year": range(2009, 2020)})
    pop = pop.withColumn("nx", F.col("age") + F.col("year") * 2.0).filter("not (location = 'p' and age = 40)")
    def both(b, p, **kw):
        base = M.base_rates(b, p, DISEASES, **kw)
        return base, M.transition_rates(b, base, range(2014, 2018), **kw)
    inside, plain = both(J.gather(burden, ["location"], 2), J.gather(pop, ["location"], 2), placed=True), both(burden, pop)
    for got, want in zip(inside, plain):
        assert set(shuffles(got)) == {("location",)}
        assert got.count() == want.count() > 0 and got.exceptAll(want.select(*got.columns)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name,times", [("q29_scenario_sweep", 12), ("q33_calibration", 9)])
def test_tasks_grow_with_the_repetition(spark, no_broadcast, name, times):
    """A supplier's cells go to as many times the usual partitions as their rows are repeated."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Exchange hashpartitioning\(location#\w+, (\d+)\)", plan)) == {str(times * int(spark.conf.get("spark.sql.shuffle.partitions")))}
