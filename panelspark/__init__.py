"""Panel analytics on Spark: cohorts, rates, scenarios, calibration and reports.

Every operator takes a DataFrame and the names of its key columns and returns a
lazy DataFrame built from Spark SQL expressions.
"""
