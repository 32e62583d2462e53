"""Rows are never lost silently: NULL keys survive; unlisted keys, missing partners and duplicates raise."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelspark.operators import cohort as C, effects as E, interp as I, joins as J, windows as W


@pytest.mark.parametrize("by_value", [True, False])
def test_blocked_gap_fill_keeps_null_keys_and_places(spark, by_value):
    rows = [("a", 1, 1.0), ("a", 3, None), ("a", 6, 4.0), (None, 1, 5.0), (None, 2, None), (None, 9, 9.0), ("b", None, None), ("b", 4, 2.0)]
    df = spark.createDataFrame(rows, "k string, x int, v double")
    plain = I.gap_fill(df, ["k"], "x", ["v"], by_value=by_value)
    cut = I.gap_fill(df, ["k"], "x", ["v"], by_value=by_value, block=2)
    assert cut.count() == len(rows) and cut.exceptAll(plain).count() == 0


def test_unlisted_part_raises(spark):
    cols = ["nx", "prev_rate", "dis_mx", "all_mx", "bg_mx", "bg_mx_all", "ir", "cf"]
    df = spark.createDataFrame([("p", c, 0, 2000, *[0.1] * 8) for c in "xy"], "place string, cause string, age int, year int, " + ", ".join(f"{c} double" for c in cols))
    with pytest.raises(PySparkException, match="cause is not listed: y"):
        C.roll_coupled(df, ["place"], "cause", ["x"], "age", "year", 2000, (0, 3)).collect()
    assert C.roll_coupled(df.where("cause = 'x'"), ["place"], "cause", ["x"], "age", "year", 2000, (0, 3)).count() == 1


def test_category_without_risk_raises(spark):
    shares = spark.createDataFrame([("s", c, 0.5, 0.5) for c in "ab"], "sex string, category string, base_share double, new_share double")
    risk = spark.createDataFrame([("s", "a", "o", 2.0)], "sex string, category string, outcome string, rr double")
    with pytest.raises(PySparkException, match="no rr for"):
        E.potential_impact(shares, risk, ["sex", "outcome"], ["sex"], "category").collect()
    matrix = spark.createDataFrame([(x, y, 0.5) for x in "ab" for y in "ab"], "from_category string, to_category string, weight double")
    with pytest.raises(PySparkException, match="no rr for"):
        E.relative_risk_reduction(shares.withColumnRenamed("base_share", "share"), matrix, risk.select("category", "rr"), ["sex"], "category").collect()


def test_second_row_on_a_diagonal_raises(spark):
    df = spark.createDataFrame([("k", 1, 2000, 1.0), ("k", 2, 2001, 2.0), ("k", 2, 2001, 3.0)], "k string, age int, year int, v double")
    with pytest.raises(PySparkException, match="duplicate key"):
        J.cohort_join(df, ["k"], "age", "year", 1, ["v"]).collect()


def test_second_point_at_one_place_raises(spark):
    df = spark.createDataFrame([("k", 1.5, 1.0), ("k", 1.5, 2.0), ("k", 4.0, 2.0)], "k string, x double, v double")
    with pytest.raises(PySparkException, match="duplicate key"):
        I.to_unit_steps(df, ["k"], "x", ["v"]).collect()


def test_balanced_blocks_write_nothing(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 50 > 0, F.col("id")).alias("t"))
    sizes = {r["block"]: r["count"] for r in W.balanced_blocks(df, ["k"], ["t"], blocks=8).groupBy("block").count().collect()}
    assert len(sizes) == 8 and sum(sizes.values()) == 1000 and max(sizes.values()) < 250


def test_the_national_grid_is_spread(spark):
    from panelspark.operators.calibrate import calibration_errors
    cols = ["nx", "prev_rate", "dis_mx", "all_mx", "bg_mx", "bg_mx_all", "ir", "cf"]
    df = spark.createDataFrame([("n", "x", a, y, 0, *[0.1] * 8) for a in range(5) for y in (2000, 2001)],
                               "place string, cause string, age int, year int, band int, " + ", ".join(f"{c} double" for c in cols))
    seen = spark.createDataFrame([("n", "x", 0, 2001, 1.0, 2.0)], "place string, cause string, band int, year int, obs_dead double, obs_sick double")
    errors = calibration_errors(df, seen, ["place"], "cause", ["x"], "age", "year", 2000, (0, 4), "band", range(-10, 11), range(-1, 2))
    used = errors.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_parts_are_scaled_to_the_package(spark):
    from panelspark.operators.report import scaled_parts
    df = spark.createDataFrame([("a", 1, 8.0), ("a", 2, 4.0), ("a", 3, 6.0), (None, 1, 5.0), (None, 2, 2.0), ("z", 2, 1.0)], "k string, code int, v double")
    got = {(r.k, r.code): r.v for r in scaled_parts(df, ["k"], "code", 1, "v").collect()}
    assert got == {("a", 1): 8.0, ("a", 2): pytest.approx(3.2), ("a", 3): pytest.approx(4.8), (None, 1): 5.0, (None, 2): 5.0, ("z", 2): None}


def test_partitioned_tables_have_few_files(spark, tmp_path):
    from panelspark.sources.files import write_table
    df = spark.range(20_000).repartition(16).select((F.col("id") % 3).alias("year"), "id")
    write_table(df, str(tmp_path / "t"), partition_by=["year"])
    for folder in (tmp_path / "t").glob("year=*"):
        assert 1 <= len(list(folder.glob("part-*"))) <= 8
    assert spark.read.parquet(str(tmp_path / "t")).count() == 20_000
