"""Runnable jobs: read declared tables, write result tables.

    python -m panelspark.plans.jobs rates   --burden b.csv --population p1.csv p2.csv --births w.csv --out DIR
    python -m panelspark.plans.jobs project --status s.csv --effects e.csv --risks r.csv --clinical c.csv --levels l.csv \
        --rates DIR/rates --births DIR/births --names n.csv --costs c.csv --out DIR

``rates`` writes base rates, births and calibrated rates; ``project`` writes the
trajectories by scenario and all reports. Results are parquet, reports also CSV.
"""

from __future__ import annotations

import argparse
import itertools

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.constants import CAUSES
from panelspark.operators.audit import require_complete, require_coverage
from panelspark.plans import model as M
from panelspark.sources import files as S, schemas as H


def table(spark: SparkSession, path: str | list[str], spec: H.Spec, out: str, name: str, multi_line: bool = False) -> DataFrame:
    """CSV files in the declared layout, or a parquet table of our own.

    CSV is parsed once and kept below ``out``; a value that is not of its column's type stops the job there.
    """
    if isinstance(path, str) and not path.endswith(".csv"):
        return spark.read.parquet(path)
    rejects = S.Rejects()
    return S.stored(S.read_csv(spark, path, spec, multi_line, rejects=rejects), f"{out}/input/{name}", rejects)


def report(df: DataFrame, out: str, name: str) -> None:
    S.write_table(df, f"{out}/{name}", "csv")


def rates_job(
    spark: SparkSession, burden: str, population: list[str], births: str, out: str, causes: list[str] = CAUSES,
    first: int = 2014, last: int = 2019, passes: tuple | None = None,
) -> None:
    b = table(spark, [burden], H.BURDEN, out, "burden")
    pop = S.clean_population(table(spark, population, H.POPULATION, out, "population"))
    S.write_table(M.base_rates(b, pop, causes), f"{out}/base", partition_by=["year"])
    base = spark.read.parquet(f"{out}/base")
    S.write_table(M.transition_rates(b, base, range(first, last + 1)), f"{out}/transition", partition_by=["year"])
    rates = spark.read.parquet(f"{out}/transition")
    require_coverage(rates, [*M.PLACE, "cause"], {"year": range(first, last + 1), "age": range(M.LAST_AGE + 1)})
    wide = S.read_sheet_csv(spark, births, "Index", {"Region, subregion, country or area *": "location"})
    cols = [c for c in wide.columns if c != "location"]
    S.write_table(M.births(base, wide, cols, last, fill_years=[last, last + 1, last + 2]), f"{out}/births")
    newborn = spark.read.parquet(f"{out}/births")
    extra = {} if passes is None else {"passes": passes}
    number = itertools.count(1)
    calibrated = M.calibrate(rates, newborn, b, first, last, causes, save=lambda df: S.stored(df, f"{out}/pass{next(number)}"), **extra)
    S.write_table(calibrated, f"{out}/rates", partition_by=["year"])


def project_job(
    spark: SparkSession, status: str, effects: str, risks: str, clinical: str, levels: str, rates: str, births: str, names: str,
    costs: str, out: str, status_codes: list[str], s: M.Settings | None = None, causes: list[str] = CAUSES, user_costs: str | None = None,
) -> None:
    s = s or M.Settings()
    codes = [s.status_package, *status_codes]
    care = [f"{c}.{k}" for c in s.arm_codes.values() for k in s.variants]
    clinical_table = table(spark, clinical, H.CLINICAL_EFFECTS, out, "clinical")
    eff = M.status_effect_table(table(spark, effects, H.STATUS_EFFECTS, out, "effects"), s)
    scenarios = S.stored(M.status_scenarios(table(spark, status, H.STATUS_PANEL, out, "status"), eff, codes, s), f"{out}/status_scenarios")
    parts = [
        M.status_impact(scenarios, table(spark, risks, H.RISKS, out, "risks"), s), M.second_hand_impact(clinical_table, s),
        M.care_impact(require_complete(table(spark, levels, H.CASCADE, out, "levels"), ["htn", "aware", "treated", "control"]), clinical_table, s),
    ]
    newborn = table(spark, births, H.BIRTHS, out, "births")
    run = M.trajectories(table(spark, rates, H.RATES, out, "rates"), newborn, M.effect_table(parts, s), [*codes, s.second_hand_code, *care, s.combined], s, causes)
    S.replace_scenarios(run, f"{out}/trajectories")
    run = spark.read.schema(run.schema).parquet(f"{out}/trajectories")
    totals = S.stored(M.totals_by_scenario(run), f"{out}/totals_table")
    titles = table(spark, names, H.NAMES, out, "names", multi_line=True).select(M.code_text("code").alias("scenario"), "name")
    averted = S.stored(M.averted_report(totals, titles, s), f"{out}/averted_table")
    report(totals, out, "totals")
    report(averted, out, "averted")
    report(M.totals_report(averted, s.survey_last), out, "averted_totals")
    report(M.survival_report(run, [s.baseline, s.combined]), out, "survival")
    report(M.prevalence_report(run, scenarios, [s.baseline, s.status_package]), out, "prevalence")
    report(M.cause_report(run, s, s.combined), out, "causes")
    report(M.chain_report(averted, s), out, "care_steps")
    recent = F.col("year") >= s.survey_last
    exact = M.averted_report(totals, titles, s, digits=None)
    additivity = M.additivity_report(averted.filter(recent), s, status_codes, parts_from=exact.filter(recent))
    report(additivity, out, "additivity")
    factor = F.lit(additivity.first()["ratio"]).cast("double")  # one row: parts are scaled to add up to the package
    scale = F.when(F.col("scenario").isin(status_codes), factor).otherwise(F.lit(1.0))
    report(M.cost_report(averted, table(spark, user_costs or costs, H.COSTS, out, "costs", multi_line=True), scale), out, "costs")


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="job", required=True)
    a = sub.add_parser("rates")
    for name in ("burden", "births", "out"):
        a.add_argument(f"--{name}", required=True)
    a.add_argument("--population", nargs="+", required=True)
    b = sub.add_parser("project")
    for name in ("status", "effects", "risks", "clinical", "levels", "rates", "births", "names", "costs", "out"):
        b.add_argument(f"--{name}", required=True)
    b.add_argument("--user-costs")
    b.add_argument("--status-codes", nargs="+", default=["1.1", "1.2", "1.3", "1.4", "1.5", "1.7", "1.8", "1.9"])
    args = vars(top.parse_args(argv))
    spark = SparkSession.builder.appName("panelspark").getOrCreate()
    {"rates": rates_job, "project": project_job}[args.pop("job")](spark, **args)


if __name__ == "__main__":
    main()
