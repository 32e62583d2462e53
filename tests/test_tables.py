"""Joins, windows, interpolation and audits against plain Python."""

import itertools
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelspark.operators import audit as A, interp as I, joins as J, windows as W
from tests.conftest import rows


def test_cohort_join_pairs_rows_on_the_diagonal(spark):
    data = [("k", a, t, 100 * a + t) for a in range(0, 8) for t in range(0, 8) if (a * 7 + t) % 5]
    df = spark.createDataFrame(data, "k string, age int, t int, v int")
    have = {(a, t): v for _, a, t, v in data}
    for gap, axis_gap in ((2, 2), (3, 1), (1, 2)):
        got = {(r.age, r.t): (r.v, r.v_later) for r in J.cohort_join(df, ["k"], "age", "t", gap, ["v"], axis_gap).collect()}
        want = {(a, t): (v, have[a + axis_gap, t + gap]) for (a, t), v in have.items() if (a + axis_gap, t + gap) in have}
        assert got == want


def test_cohort_join_left_keeps_rows_without_partner(spark):
    df = spark.createDataFrame([("k", 1, 1, 5.0), ("k", 2, 2, None)], "k string, age int, t int, v double")
    got = rows(J.cohort_join(df, ["k"], "age", "t", 1, ["v"], how="left"), "age")
    assert [r["v_later"] for r in got] == [None, None] and len(got) == 2
    # A partner with a missing value is a partner: the inner form keeps it.
    assert J.cohort_join(df, ["k"], "age", "t", 1, ["v"]).count() == 1


def test_band_join_with_overlapping_bands(spark):
    df = spark.createDataFrame([(a,) for a in range(0, 10)], "age int")
    bands = spark.createDataFrame([("x", 0, 4), ("y", 3, 6)], "b string, start int, stop int")
    got = {(r.age, r.b) for r in J.band_join(df, "age", bands).collect()}
    assert got == {(a, b) for a in range(10) for b, lo, hi in (("x", 0, 4), ("y", 3, 6)) if lo <= a <= hi}


def test_complete_grid_fills_and_rejects_duplicates(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 3, 4.0)], "k string, t int, v double")
    got = {(r.k, r.t): r.v for r in J.complete_grid(df, ["k"], {"t": range(1, 4)}, ["v"]).collect()}
    assert got == {**{(k, t): 0.0 for k in "ab" for t in (1, 2, 3)}, ("a", 1): 2.0, ("b", 3): 4.0}
    with pytest.raises(PySparkException, match="duplicate key"):
        J.complete_grid(df.union(df), ["k"], {"t": range(1, 4)}, ["v"]).collect()


def test_complete_grid_is_one_shuffle_of_one_scan(spark):
    df = spark.range(100).selectExpr("concat('k', id % 9) k", "cast(id % 4 as int) t", "id v").groupBy("k", "t").agg(F.max("v").alias("v"))
    out = J.complete_grid(df, ["k"], {"t": range(0, 6)}, ["v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("Range (") == 1  # one of them is the aggregation of the input
    assert out.count() == 9 * 6
    pairs = spark.createDataFrame([("a", 1, 2, 3.0)], "k string, t int, u int, v double")
    got = {(r.t, r.u): r.v for r in J.complete_grid(pairs, ["k"], {"t": range(0, 3), "u": [1, 2]}, ["v"], fill=None).collect()}
    assert got == {(t, u): (3.0 if (t, u) == (1, 2) else None) for t in range(3) for u in (1, 2)}


def test_unique_and_pivot_raise_on_duplicates(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0)], "k string, n string, v double")
    with pytest.raises(PySparkException, match="duplicate key"):
        J.require_unique(df, ["k", "n"]).collect()
    with pytest.raises(PySparkException, match="duplicate key"):
        J.pivot_unique(df, ["k"], "n", "v", ["x", "y"]).collect()


def test_upsert_and_selection(spark):
    res = spark.createDataFrame([("0", 1, 1.0), ("1", 1, 2.0), ("1", 2, 3.0)], "scenario string, t int, v double")
    upd = spark.createDataFrame([("1", 9, 7.0), ("2", 1, 8.0)], "scenario string, t int, v double")
    got = {(r.scenario, r.t, r.v) for r in J.upsert_scenarios(res, upd).collect()}
    assert got == {("0", 1, 1.0), ("1", 9, 7.0), ("2", 1, 8.0)}
    assert J.select_scenarios(res, upd).count() == 2


def series(n, seed):
    rnd = random.Random(seed)
    data = []
    for k in ("hot", "cold"):
        for t in rnd.sample(range(200), n if k == "hot" else 5):
            data.append((k, t, None if rnd.random() < 0.4 else round(rnd.uniform(-5, 5), 3)))
    return data


@pytest.mark.parametrize("block", [None, 7, 50, W.BALANCED])
def test_previous_and_running_total(spark, block):
    data = series(120, 1)
    df = spark.createDataFrame(data, "k string, t int, v double")
    b = block if block in (None, W.BALANCED) else F.floor(F.col("t") / block)
    out = W.running_total(W.previous(df, ["k"], ["t"], ["v"], block=b), ["k"], ["t"], ["v"], block=b)
    got = {(r.k, r.t): (r.prev_v, r.cum_v) for r in out.collect()}
    assert len(got) == len(data)
    for k, group in itertools.groupby(sorted(data, key=lambda r: (r[0], r[1])), key=lambda r: r[0]):
        last, total = None, None
        for _, t, v in group:
            total = total if v is None else (total or 0.0) + v
            assert got[k, t][0] == last
            assert got[k, t][1] == (None if total is None else pytest.approx(total))
            last = v


def line_fill(points, hold, by_value):
    known = [((t if by_value else i), v) for i, (t, v) in enumerate(points) if v is not None]
    out = []
    for i, (t, v) in enumerate(points):
        x = t if by_value else i
        before, after = [p for p in known if p[0] <= x], [p for p in known if p[0] >= x]
        if v is not None:
            out.append(v)
        elif before and after:
            (x0, y0), (x1, y1) = before[-1], after[0]
            out.append(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
        else:
            out.append(None if not hold or not known else (before[-1] if before else after[0])[1])
    return out


@pytest.mark.parametrize("block", [None, 9])
@pytest.mark.parametrize("hold", [False, True])
@pytest.mark.parametrize("by_value", [False, True])
def test_gap_fill(spark, block, hold, by_value):
    data = series(90, 3) + [("none", t, None) for t in range(4)] + [("one", t, 2.5 if t == 2 else None) for t in range(5)]
    df = spark.createDataFrame(data, "k string, t int, v double")
    got = {(r.k, r.t): r.v for r in I.gap_fill(df, ["k"], "t", ["v"], hold, by_value, block).collect()}
    for k in ("hot", "cold", "none", "one"):
        pts = sorted((t, v) for kk, t, v in data if kk == k)
        pts = [(t, v) for t, v in sorted([(t, v) for kk, t, v in data if kk == k], key=lambda p: p[0])]
        for (t, _), want in zip(pts, line_fill(pts, hold, by_value)):
            assert got[k, t] == (None if want is None else pytest.approx(want))


def test_unit_steps_keep_knots(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0), ("a", 7.0, 2.0), ("a", 97.0, 0.0), ("b", 3.5, 1.0), ("b", 5.5, 5.0)], "k string, x double, y double")
    got = {(r.k, r.x): r.y for r in I.to_unit_steps(df, ["k"], "x", ["y"]).collect()}
    assert [x for k, x in sorted(got) if k == "a"] == list(range(2, 98))
    assert got["a", 2] == 1.0 and got["a", 7] == 2.0 and got["a", 97] == 0.0
    assert got["a", 4] == pytest.approx(1.4) and got["b", 4] == pytest.approx(2.0) and got["b", 5] == pytest.approx(4.0)


def test_best_row_ties_and_missing(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2, 1), ("a", 1.0, 1, 3), ("a", None, 0, 0), ("a", float("nan"), -1, 0), ("b", 3.0, 5, 5)], "k string, e double, i int, j int")
    got = {r.k: (r.e, r.i, r.j) for r in W.best_row(df, ["k"], ["e", "i", "j"]).collect()}
    assert got == {"a": (1.0, 1, 3), "b": (3.0, 5, 5)}


def test_group_aggs_keep_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 3.0)], "k string, v double")
    got = sorted((str(r.k), r.v, r.s) for r in W.with_group_aggs(df, ["k"], s=F.sum("v")).collect())
    assert got == [("None", 2.0, 5.0), ("None", 3.0, 5.0), ("a", 1.0, 1.0)]


def test_audit(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, None), ("b", 2, 3.0)], "k string, t int, v double")
    r = A.audit(df, ["k", "t"], ["v"], expected=4).first()
    assert (r.n_rows, r.n_keys, r.repeated_keys, r.rows_with_missing, r.missing_keys) == (3, 2, 1, 1, 2)
    other = spark.createDataFrame([("a",), ("z",)], "k string")
    assert [x.k for x in A.unmatched_keys(df, other, ["k"]).collect()] == ["b"]
    with pytest.raises(PySparkException, match="missing value"):
        A.require_complete(df, ["v"]).collect()
    assert A.null_counts(df).first().missing_v == 1


def test_prevalence_panel(spark):
    survey = [("M", 20, 2000, 10.0, 5.0), ("M", 20, 2004, 30.0, 9.0), ("M", 30, 2000, 20.0, 10.0), ("M", 30, 2004, 40.0, 20.0)]
    df = spark.createDataFrame(survey, "sex string, age int, year int, current double, ex double")
    out = I.prevalence_panel(df, ["sex"], "year", "age", ["current", "ex"], "never", range(2000, 2005), range(10, 36, 5), start_shares={"never": 100.0})
    got = {(r.year, r.age): (r.never, r.current, r.ex) for r in out.collect()}
    assert got[2002, 20] == pytest.approx((73.0, 20.0, 7.0)) and got[2002, 10] == (100.0, 0.0, 0.0)
    assert got[2002, 15] == pytest.approx((86.5, 10.0, 3.5)) and got[2002, 35] == (None, None, None)
    assert len(got) == 5 * 6


def test_key_coverage_names_cells(spark):
    axes = {"t": range(1, 40), "u": ["a", "b"]}  # 78 cells: two words
    have = [("x", t, u) for t in range(1, 40) for u in "ab" if (t, u) not in {(1, "a"), (33, "b"), (39, "b")}] + [("x", 2, "a")] * 3
    df = spark.createDataFrame([*have, ("y", 50, "a"), ("y", 3, "c"), (None, 1, "a")], "k string, t int, u string")
    want = spark.createDataFrame([("x", t, u) for t in range(1, 40) for u in "ab" if t != 5] + [(None, 2, "b")], "k string, t int, u string")
    got = sorted(map(tuple, A.key_coverage(df, ["k"], axes, want).collect()), key=str)
    assert got == sorted([("x", 1, "a", "missing"), ("x", 33, "b", "missing"), ("x", 39, "b", "missing"), ("x", 5, "a", "surplus"), ("x", 5, "b", "surplus"),
                          ("y", None, None, "surplus"), (None, 1, "a", "surplus"), (None, 2, "b", "missing")], key=str)
    whole = A.key_coverage(df.filter("k = 'x'"), ["k"], axes)
    assert sorted(map(tuple, whole.collect())) == [("x", 1, "a", "missing"), ("x", 33, "b", "missing"), ("x", 39, "b", "missing")]
    with pytest.raises(ValueError, match="k=x, t=1, u=a, finding=missing"):
        A.require_coverage(df.filter("k = 'x'"), ["k"], axes)
    A.require_coverage(df.filter("k = 'x' AND t BETWEEN 2 AND 32"), ["k"], {"t": range(2, 33)})
    assert A.key_coverage(df.limit(0), ["k"], axes, want.limit(0)).count() == 0


def test_grid_of_two_words_and_null_keys(spark):
    axes = {"t": range(-3, 40), "u": [5, 7]}
    df = spark.createDataFrame([("x", -3, 5, 1.0), ("x", 39, 7, 2.0), (None, 0, 7, 3.0), ("x", 77, 5, 4.0)], "k string, t int, u int, v double")
    got = {(r.k, r.t, r.u): r.v for r in J.complete_grid(df, ["k"], axes, ["v"]).collect()}
    assert len(got) == 2 * 86 + 1 and sum(got.values()) == 10.0 and got["x", 77, 5] == 4.0 and got[None, 39, 7] == 0.0
    wide = {"t": range(-3, 4000), "u": [5, 7]}  # beyond the bitmaps
    big = {(r.k, r.t, r.u): r.v for r in J.complete_grid(df, ["k"], wide, ["v"]).collect()}
    assert len(big) == 2 * 4003 * 2 and sum(big.values()) == 10.0
    with pytest.raises(PySparkException, match="duplicate"):
        J.complete_grid(df.union(df), ["k"], wide, ["v"]).collect()


def test_hot_entity_sends_one_row_per_task(spark):
    df = spark.range(20_000, numPartitions=4).select(F.lit("hot").alias("k"), (F.col("id") % 7).cast("int").alias("t"), F.col("id").alias("v"))
    bits = A.key_coverage(df, ["k"], {"t": range(0, 9)})
    plan = bits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_bit_or" in plan
    assert sorted(r.t for r in bits.collect()) == [7, 8]


@pytest.mark.parametrize("bits", [1, 3, 5])
def test_intervals_of_any_width(spark, bits):
    import random
    rng = random.Random(bits)
    edge = (1 << 63) - 1
    points = [(i, rng.choice([rng.randint(-50, 50), rng.randint(-10**12, 10**12), rng.choice([0, -1, edge, -edge - 1])])) for i in range(150)] + [(900, None)]
    bands = []
    for i in range(40):
        a = rng.choice([rng.randint(-60, 50), rng.randint(-10**12, 10**12)])
        bands.append((i, a, a + rng.choice([-1, 0, 1, 7, 100, 10**9, 10**12])))
    bands += [(90, -edge - 1, edge), (91, None, 5), (92, 0, edge), (93, -edge - 1, -1)]
    p = spark.createDataFrame(points, "id int, x long")
    b = spark.createDataFrame(bands, "band int, a long, z long")
    got = sorted((r.id, r.band) for r in J.interval_join(p, "x", b, "a", "z", bits=bits).collect())
    assert got == sorted((i, k) for i, x in points if x is not None for k, a, z in bands if a is not None and a <= x <= z)
    nodes = b.filter("a <= z").select((F.size(J.interval_nodes(F.col("a"), F.least("z", F.lit(edge - 1)), bits))).alias("n")).agg(F.max("n")).first()[0]
    assert nodes <= 2 * ((1 << bits) - 1) * -(-64 // bits)  # a width of 2^64 stays a few hundred rows


def test_intervals_of_real_numbers_dates_and_keys(spark):
    p = spark.createDataFrame([("a", 0.5), ("a", 1e300), ("b", -0.25), ("a", float("nan")), ("b", None), ("a", float("inf"))], "k string, x double")
    b = spark.createDataFrame([("a", 0.5, 0.5, 1), ("a", 0.500001, 9.0, 2), ("b", -1e308, 0.0, 3), ("a", 1.0, float("inf"), 4), ("b", 5.0, 4.0, 5)], "k string, lo double, hi double, n int")
    for resolution in (1e-3, 1.0, 1e6):
        got = sorted((r.x, r.n) for r in J.interval_join(p, "x", b, "lo", "hi", on=["k"], resolution=resolution).collect())
        assert got == [(-0.25, 3), (0.5, 1), (1e300, 4), (float("inf"), 4)]
    days = spark.sql("SELECT date'2020-02-29' AS d, timestamp'2020-02-29 12:00:00.000001' AS t")
    spans = spark.sql("SELECT date'2019-12-31' AS s, date'2020-02-29' AS e, timestamp'2020-02-29 12:00:00.000001' AS ts, timestamp'2021-01-01' AS te")
    assert J.interval_join(days, "d", spans, "s", "e").count() == 1
    assert J.interval_join(days, "t", spans, "ts", "te").count() == 1
    civil = days.selectExpr("CAST('2020-02-29 12:00:00.000001' AS timestamp_ntz) AS t")
    open_ = spans.selectExpr("CAST('2020-02-29 12:00:00.000001' AS timestamp_ntz) AS s", "CAST('2020-02-29 12:00:00.000001' AS timestamp_ntz) AS e")
    assert J.interval_join(civil, "t", open_, "s", "e").count() == 1
    assert J.interval_join(civil, "t", open_.selectExpr("s - INTERVAL 1 HOUR AS s", "e - INTERVAL 1 MICROSECOND AS e"), "s", "e").count() == 0
    assert J.interval_join(days.limit(0), "d", spans.limit(0), "s", "e").count() == 0
