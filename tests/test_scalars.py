import math

import pytest
from pyspark.sql import functions as F

from panelspark.constants import AGE_BANDS
from panelspark.functions import scalars as S


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize("x,want", [
    (56784.850523449, 56800.0), (0.0, 0.0), (-1234.0, -1230.0), (0.0012345, 0.00123), (999.6, 1000.0), (1000.0, 1000.0), (None, None), (7.0, 7.0),
])
def test_signif(spark, x, want):
    got = one(spark, S.signif(F.lit(x).cast("double"), 3))
    assert got == want if want is None else got == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("x,want", [(1.5, 0.99), (1.0, 1.0), (-0.1, 0.0), (None, -1.0), (float("nan"), -1.0), (float("inf"), 0.99), (float("-inf"), 0.0)])
def test_clamp_is_asymmetric_and_catches_nan(spark, x, want):
    assert one(spark, S.clamp(F.lit(x).cast("double"), 0, 1, 0, 0.99, -1.0)) == want


def test_growth_rate_edges(spark):
    def g(a, b):
        return one(spark, S.growth_rate(F.lit(float(a)), F.lit(float(b)), 5))
    assert g(1, math.e ** 5) == pytest.approx(1.0)
    assert g(0, 3) == float("inf") and g(3, 0) == float("-inf")
    assert g(0, 0) is None and g(1, -1) is None


def test_ratios(spark):
    assert one(spark, S.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, S.open_ratio(F.lit(1.0), F.lit(0.0))) == float("inf")
    assert one(spark, S.open_ratio(F.lit(0.0), F.lit(0.0))) is None


def test_band_labels_round_trip(spark):
    df = spark.createDataFrame([(a,) for a in range(0, 100)], "age int")
    got = df.withColumn("b", S.band_label("age")).withColumns(
        {"lo": S.band_start("b"), "hi": S.band_stop("b"), "mid": S.band_midpoint("b")}).collect()
    for r in got:
        k = min(r.age // 5, 19)
        assert r.b == AGE_BANDS[k]
        assert (r.lo, r.hi, r.mid) == (5 * k, 5 * k + 4, 5 * k + 2.0)


def test_text_helpers(spark):
    assert one(spark, S.leading_number(F.lit("15-24"))) == 15
    assert one(spark, S.leading_number(F.lit("Total"))) is None
    i, j = S.grid_key_parts(F.lit("IR0.93CF1.02"))
    assert (one(spark, i), one(spark, j)) == (0.93, 1.02)
    assert one(spark, S.case_map(F.lit("b"), {"g": ["a", "b"]}, "rest")) == "g"
    assert one(spark, S.case_map(F.lit("z"), {"g": ["a", "b"]}, "rest")) == "rest"
    assert one(spark, S.recode(F.lit("male"), {"male": "Male"})) == "Male"


def test_products_of_empty_groups(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.2), ("b", None)], "k string, x double")
    got = {r.k: (r.p, r.c) for r in df.groupBy("k").agg(S.product("x").alias("p"), S.complement_product("x").alias("c")).collect()}
    assert got["a"] == pytest.approx((0.1, 1 - 0.5 * 0.8)) and got["b"] == (1.0, 0.0)
