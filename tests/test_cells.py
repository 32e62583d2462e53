"""Counted cells: the grid of the suppliers is made after the shuffle, with the same counts. What the fold is fed with."""

import datetime as dt
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelspark.operators.cohort import roll_coupled
from panelspark.plans import catalog
from panelspark.sources import tables as T
from conftest import rows

KINDS = "l_suppkey long, l_linestatus string, l_returnflag string, l_quantity double, l_shipdate timestamp, l_linenumber int, " \
    "l_extendedprice double, l_discount double"


PANEL = "k string, part string, age int, year int, nx double, prev_rate double, dis_mx double, all_mx double, bg_mx double, " \
    "bg_mx_all double, ir double, cf double"


def line(supplier, sex, cause, age, year):
    return (supplier, sex, cause, age, dt.datetime(year, 6, 1) if year else None, 1, 1.0, 0.1)


def write(spark, tmp_path, lines, suppliers):
    spark.createDataFrame(lines, KINDS).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(s,) for s in suppliers], "s_suppkey long").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    return str(tmp_path)


def test_grid_is_repeated_after_the_shuffle(spark, tmp_path):
    d = write(spark, tmp_path, [line(1, "F", "A", 3.0, 1996)], range(1, 9))
    plan = T.cells(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    before_shuffle = plan.split("Exchange")[1]
    assert "partial_count" not in before_shuffle and "HashAggregate" not in before_shuffle
    assert "sequence(_from" not in before_shuffle


def test_counts_with_odd_lines(spark, tmp_path):
    """Lines outside the grid and with NULLs keep cells of their own; a supplier without lines gets its grid."""
    lines = [line(1, "F", "A", 3.0, 1996)] * 2 + [line(1, "F", "R", 3.0, 1996), line(1, "O", "X", 3.0, 1996), line(1, "X", "N", 3.0, 1996),
             line(1, "F", "A", 77.0, 1996), line(1, "F", "A", None, 1996), line(1, "F", "A", 3.0, None), line(None, None, "N", 3.0, 1996),
             line(9, "F", "N", 50.0, 2001)]
    d = write(spark, tmp_path, lines, [1, 2, 2])
    got = {(r["location"], r["sex"], r["age"], r["year"]): (r["n_a"], r["n_n"], r["n_r"]) for r in rows(T.cells(spark, d), "location")}
    want = {(s, x, a, y): (0, 0, 0) for s in (1, 2) for x in T.SEXES for a in T.AGES for y in T.YEARS}
    want |= {(1, "F", 3, 1996): (2, 0, 1), (1, "X", 3, 1996): (0, 1, 0), (1, "F", 77, 1996): (1, 0, 0), (1, "F", None, 1996): (1, 0, 0),
             (1, "F", 3, None): (1, 0, 0), (None, None, 3, 1996): (0, 1, 0), (9, "F", 50, 2001): (0, 1, 0)}
    assert got == want and T.cells(spark, d).count() == len(want)
    assert [t for _, t in T.cells(spark, d).dtypes] == ["bigint", "string", "int", "int", "bigint", "bigint", "bigint"]


def test_seeds_and_rates_meet_without_an_aggregation(spark):
    """Without carried columns a cell is a seed or has rates: the fold collects the shuffled rows as they are."""
    panel = spark.createDataFrame([("x", "p", 0, 2000, *[0.1] * 8)], PANEL)
    out = roll_coupled(panel, ["k"], "part", ["p"], "age", "year", 2000, (0, 5))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" not in plan and plan.count("Exchange") == 1 and "lambdafunction" not in plan.split("Exchange")[1]


@pytest.mark.parametrize("parts", [("a", "a", "b"), ("a", "a"), ("a", "a", "b", "c")])
def test_repeated_part_raises_whatever_the_number_of_rows(spark, parts):
    """Three rows for three parts are not yet one of each."""
    rates = [100.0, 0.1, 0.01, 0.02, 0.01, 0.01, 0.1, 0.1]
    panel = spark.createDataFrame([("x", p, 0, 2000, *rates) for p in parts], PANEL)
    with pytest.raises(PySparkException, match="duplicate key"):
        roll_coupled(panel, ["k"], "part", ["a", "b", "c"], "age", "year", 2000, (0, 5)).collect()


ON_CELLS = [
    "q17_rmse", "q09b_band_cohort_join", "q37_cascade", "q28_composition_roll", "q51_base_rates_job", "q42b_model_vs_observed",
    "q52_transition_rates_job", "q37b_cascade_impact", "q09_cohort_shift_join", "q29_coupled_roll", "q27_transition_rates",
    "q26_union_project_forward", "q34c_apply_effects",
]
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ON_CELLS)
def test_no_query_aggregates_suppliers_before_the_shuffle(spark, name):
    """Between the scan of the suppliers and its shuffle there is neither an aggregation nor the range of ages, in any branch of the query."""
    lines = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("\n")
    def depth(line):
        return len(line) - len(line.lstrip(" :+-"))
    scans = [i for i, line in enumerate(lines) if "Scan parquet [s_suppkey" in line]
    assert scans
    for i in scans:
        above, at = [], depth(lines[i])
        for line in reversed(lines[:i]):
            if depth(line) < at:
                at = depth(line)
                above.append(line)
            if above and "Exchange" in above[-1]:
                break
        assert "Exchange" in above[-1]
        assert not [line for line in above[:-1] if "Aggregate" in line or "sequence(1, 50" in line or "[1,2,3,4,5,6,7,8,9," in line], name
