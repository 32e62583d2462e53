"""The model as Spark jobs: base rates, transition rates, births, calibration, projection.

Each function takes tables in the declared schemas and returns lazy DataFrames. Tables
that several reports read (trajectories, calibrated rates) are written and read back
by the caller.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.constants import (
    AGE_BANDS, ALL_CAUSES, BIRTH_SCALE, CAUSE_GROUPS, CAUSES, INPUT_RATE_CAP, PER, SEXES, TAX_EFFECT_CAP, TAX_ELASTICITY, BASE_PRICE,
)
from panelspark.functions.scalars import band_index, band_start, clamp, leading_number, piecewise_scale, ratio
from panelspark.operators.calibrate import apply_multipliers, calibration_errors, fit
from panelspark.operators.cohort import roll_composition, roll_coupled
from panelspark.operators.effects import (
    add_package, apply_effects, cascade, cascade_impact, duplicate_target, effect_bands, effects_by_target, effects_wide,
    package_effects, phase_in, potential_impact, scale_rates,
)
from panelspark.operators.growth import (
    disease_transition_rates, extend_edges, measures_wide, project_forward, split_series, status_transition_rates, to_rates,
)
from panelspark.operators.interp import bands_to_single, gap_fill, prevalence_panel, to_unit_steps
from panelspark.operators.joins import bounded, complete_grid, look_up, stack, upsert_scenarios, with_values
from panelspark.operators.report import (
    averted, averted_totals, baseline_join, cost_per_unit, group_shares, marginal, nonadditivity, prevalence_total, survival_prob,
)

PLACE = ["location", "sex"]
CELL = ["location", "sex", "age", "year"]
LAST_BAND = len(AGE_BANDS) - 1
LAST_AGE = 5 * LAST_BAND


# 1. Base rates -------------------------------------------------------------

def base_rates(
    burden: DataFrame, population: DataFrame, causes: list[str] = CAUSES, first_year: int | None = None,
    locations: list[str] | None = None, total: str = ALL_CAUSES, placed: bool = False,
) -> DataFrame:
    """Single-age rates per cause from five-year bands, with the population of each age.

    With ``placed`` both tables were distributed by location, or location and sex (``gather``), and nothing is shuffled.
    """
    df = burden.filter(F.col("age").isin(AGE_BANDS) & F.col("cause").isin(*causes, total))
    if locations:
        df = df.filter(F.col("location").isin(locations))
    wanted = {"deaths": ("Deaths", "Number"), "rate": ("Deaths", "Rate"), "sick": ("Prevalence", "Number")}
    def pick(name):
        m, k = wanted[name]
        return F.max(F.when((F.col("measure") == m) & (F.col("metric") == k), F.col("val"))).alias(name)
    per_cause = df.filter((F.col("metric") == "Number") & (F.col("cause") != total)).groupBy(*CELL, "cause").agg(pick("deaths"), pick("sick"))
    totals = df.filter((F.col("cause") == total) & (F.col("measure") == "Deaths")).groupBy(*CELL).agg(
        pick("deaths").alias("all_deaths"), pick("rate")).select(
        *CELL, "all_deaths", ratio("all_deaths", F.col("rate") / F.lit(float(PER))).alias("nx"))
    d = _beside(per_cause.filter(F.col("sick").isNotNull()), totals, CELL, placed)
    d = d.withColumn("deaths", F.coalesce("deaths", F.lit(0.0))).withColumn("other", F.col("all_deaths") - F.col("deaths"))
    names = {"all_mx": "all_deaths", "dis_mx": "deaths", "bg_mx": "other", "bg_mx_all": "other", "prev_rate": "sick"}
    d = to_rates(d, names, "nx")
    keys = ["year", *PLACE, "cause"]
    single = bands_to_single(d.select(*keys, F.col("age").alias("band"), *names), keys, "band", "age", list(names))
    single = extend_edges(single, "age", 2, [1, 0])
    if first_year is not None:
        single = single.filter(F.col("year") >= first_year)
    return _beside(single, population.select(*CELL, "nx"), CELL, placed)


def _beside(x: DataFrame, y: DataFrame, keys: list[str], placed: bool) -> DataFrame:
    """Left join on keys that are unique in ``y``; in place where both were distributed by some of them."""
    cols = [c for c in y.columns if c not in keys]
    return look_up(x.select(*keys, *[c for c in x.columns if c not in keys]), y, keys, cols) if placed else x.join(y, keys, "left")


# 2. Transition rates ---------------------------------------------------------

def transition_rates(
    burden: DataFrame, base: DataFrame, years: range, gap: int = 5, total: str = ALL_CAUSES, open_band_from_previous: bool = True,
    placed: bool = False,
) -> DataFrame:
    """Incidence and case fatality by single age, next to the base rates.

    The open band takes the rates of the band before it; with the flag off its rates
    are zero, and the ages before it run towards zero. With ``placed`` both tables were
    distributed by location, or location and sex (``gather``), and nothing is shuffled.
    """
    wide = measures_wide(
        burden.filter(F.col("age").isin(AGE_BANDS)), [*CELL, "cause"], "measure", "metric", "val",
        {"prev": ("Prevalence", "Number"), "prev_rate": ("Prevalence", "Rate"), "death": ("Deaths", "Number"), "death_rate": ("Deaths", "Rate")})
    both = wide.withColumn("band", (band_start("age") / 5).cast("int")).drop("age")
    rates = disease_transition_rates(both, PLACE, "cause", "band", "year", gap, 1, total)
    if open_band_from_previous:
        rates = extend_edges(rates, "band", LAST_BAND - 1, [LAST_BAND])
    full = complete_grid(rates, [*PLACE, "cause"], {"year": years, "band": range(LAST_BAND + 1)}, ["ir", "cf"])
    full = full.withColumn("age", F.col("band") * 5 + 2)
    keys = ["year", *PLACE, "cause"]
    single = extend_edges(to_unit_steps(full, keys, "age", ["ir", "cf"]), "age", 2, [1, 0])
    cell = [*CELL, "cause"]
    return (_beside(single, base, cell, True) if placed else base.join(single, cell, "right")).filter(F.col("age") <= LAST_AGE)


# 3. Status chain ---------------------------------------------------------------

def status_rates(
    survey: DataFrame, years: range, gap: int = 5, ages: tuple[int, int] = (10, 65), cut: int = 25,
    init_scale: tuple[float, float] = (0.35, 0.1), cess_scale: tuple[float, float] = (0.1, 0.025), init_cap: float = 0.9,
    ex_rate_from: str | None = None,
) -> DataFrame:
    """Composition and yearly rates by single age from banded surveys in a few years.

    The first year with rates is given, later ones are rolled forward with the tuned
    rates (one factor up to ``cut``, another beyond).
    """
    lo, hi = ages
    s = survey.withColumn("age", leading_number("age")).filter(F.col("age").isNotNull())
    panel = prevalence_panel(s, ["sex"], "year", "age", ["current", "ex"], "never", years, range(lo, hi + 1, 5), start_shares={"never": 100.0})
    last = years.stop - 1
    rates = status_transition_rates(panel, ["sex"], "age", "year", gap, last, ex_rate_from=ex_rate_from)
    rate_years = range(years.start + gap, years.stop)
    sexes = survey.select("sex").distinct()
    full = complete_grid(rates, ["sex"], {"year": rate_years, "age": range(lo, hi + 1)}, ["init", "cess"], sexes, fill=None)
    full = gap_fill(full, ["sex", "year"], "age", ["init", "cess"])
    full = full.withColumns({
        "init": piecewise_scale("init", "age", cut, *init_scale), "cess": piecewise_scale("cess", "age", cut, *cess_scale)})
    full = full.withColumn("init", F.least("init", F.lit(init_cap)))
    first = rate_years.start
    given = complete_grid(panel.filter(F.col("year") == first).drop("year"), ["sex"], {"age": range(lo, hi + 1)},
                          ["never", "current", "ex"], sexes, fill=None)
    given = gap_fill(given, ["sex"], "age", ["never", "current", "ex"])
    seeds = given.withColumn("year", F.explode(F.when(F.col("age") == lo, F.sequence(F.lit(first), F.lit(last))).otherwise(F.array(F.lit(first)))))
    rows = full.join(seeds, ["sex", "year", "age"], "left")
    return roll_composition(rows, ["sex"], "age", "year", first, ages)


# 4. Births and calibration -------------------------------------------------------

def births(
    base: DataFrame, wide: DataFrame, year_cols: list[str], until: int, scale: float = BIRTH_SCALE, fill_years: list[int] | None = None,
    horizon: int = 2050,
) -> DataFrame:
    """Newborns per location, sex and year: history from the base rates, future from a wide yearly table."""
    history = base.filter((F.col("age") == 0) & (F.col("year") < until)).select("location", "sex", "year", F.col("nx").alias("births"))
    history = history.groupBy("location", "sex", "year").agg(F.max("births").alias("births"))
    return split_series(wide, history, ["location"], "sex", "year", "births", year_cols, tuple(SEXES), 1000.0, scale, horizon, fill_years)


def with_births(panel: DataFrame, newborn: DataFrame, after: int) -> DataFrame:
    """Replace the population at age 0 by the births in years after ``after``."""
    b = newborn.select(*PLACE, "year", F.col("births").cast("double").alias("_b")).withColumn("age", F.lit(0))
    joined = panel.join(b, CELL, "left")
    return joined.withColumn("nx", F.when((F.col("age") == 0) & (F.col("year") > after), F.col("_b")).otherwise(F.col("nx"))).drop("_b")


def calibrate(
    rates: DataFrame, newborn: DataFrame, burden: DataFrame, first: int, last: int, causes: list[str] = CAUSES,
    passes: tuple = ((range(-10, 11), range(-10, 11), 2.0, 1.0), (range(-10, 11), range(-20, 11), 1.0, 0.0)),
    step: float = 0.01, missing: float = 1.0, ages: tuple[int, int] = (0, LAST_AGE), save=None, cohort_blocks: int = 1,
) -> DataFrame:
    """Fit incidence and fatality multipliers per cause and age band, pass after pass.

    ``save`` is applied to the rates after each pass (a checkpoint), so that the next
    pass does not compute the one before it again.
    """
    panel = rates.filter(F.col("year").between(first, last)).withColumns(
        {c: clamp(c, 0, INPUT_RATE_CAP) for c in ("ir", "cf")}).withColumn("band", band_index("age", 5, LAST_BAND))
    panel = with_births(panel, newborn.filter(F.col("year") <= last), first)
    seen = burden.filter((F.col("metric") == "Number") & F.col("cause").isin(causes) & F.col("year").between(first, last))
    seen = seen.filter(F.col("age").isin(AGE_BANDS)).withColumn("band", (band_start("age") / 5).cast("int"))
    def amount(m):
        return F.sum(F.when(F.col("measure") == m, F.col("val")))
    observed = seen.groupBy(*PLACE, "cause", "band", "year").agg(
        F.coalesce(amount("Deaths"), F.lit(0.0)).alias("obs_dead"), amount("Prevalence").alias("obs_sick"))
    keys = [*PLACE, "cause", "band"]
    for i_range, j_range, w_dead, w_sick in passes:
        errors = calibration_errors(panel, observed, PLACE, "cause", causes, "age", "year", first, ages, "band", i_range, j_range, step,
                                    cohort_blocks=cohort_blocks)
        panel = apply_multipliers(panel, fit(errors, keys, w_dead, w_sick), keys, step, missing)
        if save is not None:
            panel = save(panel)
    return panel.drop("band")


# 5. Projection ---------------------------------------------------------------------

@dataclass
class Settings:
    """Parameters of a projection run; the defaults are those of the published model."""

    base_year: int = 2019
    survey_last: int = 2023
    horizon: int = 2030
    status_first: int = 2020
    effect_start: int = 2024
    phase_start: int = 2023
    phase_length: int = 7
    phase_age_max: int = 20
    status_ages: tuple[int, int] = (10, 65)
    ages: tuple[int, int] = (0, LAST_AGE)
    baseline: str = "0"
    status_package: str = "1.0"
    second_hand_code: str = "1.6"
    tax_code: str = "1.7"
    combined: str = "8.0"
    combined_members: tuple[str, ...] = ("1.0", "5.0", "7.0")
    arms: dict[str, str] = field(default_factory=lambda: {"Hypertension": "htn", "Diabetes": "dm"})
    variants: dict[str, dict[str, float]] = field(default_factory=lambda: {
        "1": {"aware": 0.75},
        "2": {"aware": 0.95},
        "3": {"connection": 0.95, "quality": 0.75},
        "0": {"aware": 0.95, "connection": 0.95, "quality": 0.75},
    })
    arm_codes: dict[str, str] = field(default_factory=lambda: {"Hypertension": "5", "Diabetes": "7"})
    arm_variants: dict[str, dict[str, dict[str, float]]] | None = None

    def years(self) -> range:
        return range(self.base_year, self.horizon + 1)


def code_text(c: Column | str) -> Column:
    """Scenario codes as text: exact to compare, '0' for the baseline."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(3,1)").cast("string")


def status_effect_table(effects: DataFrame, s: Settings, chosen: list[str] | None = None, tax: float | None = None,
                        package_from_chosen: bool = True) -> DataFrame:
    """Effects per code and age band, with the package of all chosen ones.

    ``tax`` replaces the effect of the tax code. With ``package_from_chosen`` off, the
    older band of the package combines all unmodified effects.
    """
    keys = ["code", "age_start", "age_stop"]
    cols = ["cessation", "initiation"]
    plain = effects_by_target(
        effect_bands(effects.withColumn("code", code_text("code")), "age_text", "age_start", "age_stop"), keys, "target", "rrr", cols)
    used = plain
    if tax is not None:
        new = min(TAX_EFFECT_CAP, TAX_ELASTICITY * tax / BASE_PRICE)
        used = used.withColumns({c: F.when(F.col("code") == s.tax_code, F.lit(new)).otherwise(F.col(c)) for c in cols})
    members = used.filter(F.col("code").isin(chosen)) if chosen else used
    pack = package_effects(members, [], cols, "age_stop") if package_from_chosen else stack(
        package_effects(members, [], cols, "age_stop").filter(F.col("age_start") == s.status_ages[0]),
        package_effects(plain, [], cols, "age_stop").filter(F.col("age_start") > s.status_ages[0]))
    return stack(used, pack.withColumn("code", F.lit(s.status_package))).select(
        F.col("code").alias("scenario"), "age_start", "age_stop", *cols)


def status_scenarios(panel: DataFrame, effects: DataFrame, codes: list[str], s: Settings) -> DataFrame:
    """The composition under every code (and the baseline), to the horizon."""
    p = project_forward(panel.filter(F.col("year") >= s.base_year), "year", s.survey_last, s.horizon)
    p = with_values(p, "scenario", [s.baseline, *codes])
    rates = scale_rates(p, effects, "age", "year", s.effect_start, on=["scenario"])
    cols = ["scenario", "sex", "age", "year", "never", "current", "ex"]
    rolled = roll_composition(rates, ["scenario", "sex"], "age", "year", s.status_first, s.status_ages)
    return stack(rates.filter(F.col("year") < s.status_first).select(*cols), rolled.select(*cols))


def status_impact(scenarios: DataFrame, risks: DataFrame, s: Settings) -> DataFrame:
    """Effect of a changed composition on incidence and fatality, for all ages."""
    cats = {"Nonsmoker": "never", "Smoker": "current", "Exsmoker": "ex"}
    both = baseline_join(scenarios, ["sex", "age", "year"], "scenario", s.baseline, list(cats.values()))
    both = both.filter(F.col("scenario") != s.baseline)
    long = both.select("scenario", "sex", "age", "year", F.inline(F.array(*[
        F.struct(F.lit(k).alias("category"), F.col(f"base_{c}").alias("base_share"), F.col(c).alias("new_share")) for k, c in cats.items()])))
    out = potential_impact(long, risks, ["scenario", "cause", "sex", "age", "year"], ["sex"], "category").drop("alpha")
    lo, hi = s.status_ages
    out = extend_edges(out, "age", hi, range(s.ages[0], lo), {"impact": 1.0})
    # The copies below the first age are made from the last age, so they are told apart by age.
    out = extend_edges(out, "age", hi, range(hi + 1, s.ages[1] + 1))
    return duplicate_target(out, "target", ["IR", "CF"])


def second_hand_impact(clinical: DataFrame, s: Settings, name: str = "Second-hand smoke reduction") -> DataFrame:
    d = clinical.filter(F.col("name") == name).select("cause", "target", "rr", F.lit(s.second_hand_code).alias("scenario"))
    d = phase_in(d, "rr", "year", "age", s.years(), range(s.ages[0], s.ages[1] + 1), s.phase_start, s.phase_length, s.phase_age_max)
    return with_values(d.drop("rr"), "sex", SEXES)


def care_impact(levels: DataFrame, clinical: DataFrame, s: Settings) -> DataFrame:
    """Effects of all cascade variants of all arms, for all ages."""
    risks = clinical.withColumn("arm", F.regexp_extract("name", r"^(\S+) (treatment|control)$", 1)).filter(F.col("arm").isin(list(s.arms)))
    risks = risks.groupBy("arm", "cause", "target").agg(
        F.max(F.when(F.col("name").endswith("treatment"), F.col("rr"))).alias("rr_treat"),
        F.max(F.when(F.col("name").endswith("control"), F.col("rr"))).alias("rr_control"))
    parts = []
    for arm, prevalence in s.arms.items():
        lv = levels.withColumn("arm", F.lit(arm)).withColumn("prevalence", F.col(prevalence))
        variants = (s.arm_variants or {}).get(arm, s.variants)
        named = {f"{s.arm_codes[arm]}.{k}": v for k, v in variants.items()}
        parts.append(cascade(lv, named, "year", s.survey_last, s.horizon))
    cascades = stack(*parts)
    base = levels.filter(F.col("year") == s.survey_last).select("sex", "treated", "control")
    out = cascade_impact(cascades.select("scenario", "sex", "year", "arm", "treated", "control", "prevalence"), base, risks, ["sex"], "year",
                         "cause", "target", "prevalence", risk_keys=["arm"])
    return with_values(out.filter(F.col("year") >= s.base_year), "age", range(s.ages[0], s.ages[1] + 1))


def effect_table(parts: list[DataFrame], s: Settings) -> DataFrame:
    """All effects as multipliers of both rates, with the combined package."""
    keys = ["scenario", "year", "sex", "age", "cause"]
    rows = stack(*[p.select(*keys, "target", "impact") for p in parts])
    wide = effects_wide(rows, keys, "target", "impact", {"IR": "ir_eff", "CF": "cf_eff"})
    return add_package(wide, "scenario", list(s.combined_members), s.combined, ["year", "sex", "age", "cause"], ["ir_eff", "cf_eff"])


def trajectories(rates: DataFrame, newborn: DataFrame, effects: DataFrame, codes: list[str], s: Settings, causes: list[str] = CAUSES,
                 sexes: list[str] = SEXES) -> DataFrame:
    """Well, sick and dead of every scenario, location, sex, age, year and cause."""
    p = project_forward(rates.filter(F.col("year") == s.base_year), "year", s.base_year, s.horizon)
    p = with_births(p, newborn.filter(F.col("year") <= s.horizon), s.base_year)
    p = with_values(p, "scenario", [s.baseline, *codes])
    domains = {"scenario": codes, "year": s.years(), "sex": sexes, "age": range(s.ages[0], s.ages[1] + 1), "cause": causes}
    used = effects.filter(F.col("scenario").isin(codes) & F.col("year").isin(list(s.years())) & F.col("cause").isin(causes))
    p = apply_effects(p, bounded(used, domains), ["scenario", "year", "sex", "age", "cause"], {"ir": "ir_eff", "cf": "cf_eff"})
    return roll_coupled(p, ["scenario", *PLACE], "cause", causes, "age", "year", s.base_year, s.ages)


def totals_by_scenario(trajectory: DataFrame) -> DataFrame:
    return trajectory.groupBy("year", "scenario").agg(F.sum("dead").alias("dead"), F.sum("newcases").alias("newcases"))


# 6. Reports -----------------------------------------------------------------------

def averted_report(totals: DataFrame, names: DataFrame, s: Settings, digits: int | None = 3) -> DataFrame:
    """Deaths and cases averted per year, cumulated from the base year, with names."""
    out = averted(totals, [], "year", "scenario", s.baseline, {"dead": "deaths_averted", "newcases": "cases_averted"}, digits, cumulative=True)
    return out.join(names, "scenario", "left")


def totals_report(report: DataFrame, from_year: int) -> DataFrame:
    return averted_totals(report, ["scenario", "name"], "year", from_year, ["deaths_averted", "cases_averted"])


def survival_report(trajectory: DataFrame, scenarios: list[str], ages: tuple[int, int] = (30, 69)) -> DataFrame:
    """Probability of dying between two ages; population is the mean over causes."""
    lo, hi = ages
    rows = trajectory.filter(F.col("scenario").isin(scenarios) & F.col("age").between(lo, hi))
    cells = rows.groupBy("scenario", "year", "location", "sex", "age").agg(F.avg("pop").alias("pop"), F.sum("dead").alias("dead"))
    cells = cells.withColumn("band", band_index("age", 5, first_age=lo))
    return survival_prob(cells, ["scenario", "year"], "band", "dead", "pop")


def prevalence_report(trajectory: DataFrame, status: DataFrame, scenarios: list[str]) -> DataFrame:
    pop = trajectory.filter(F.col("scenario").isin(scenarios)).groupBy("scenario", *CELL).agg(F.avg("pop").alias("pop"))
    return prevalence_total(pop, status, ["scenario", "sex", "age", "year"], ["scenario", "sex", "year"])


def cause_report(trajectory: DataFrame, s: Settings, scenario: str, groups: dict = CAUSE_GROUPS, default: str = "Cancer") -> DataFrame:
    def at(x):
        return F.sum(F.when(F.col("scenario") == x, F.col("dead")))
    d = trajectory.filter(F.col("scenario").isin(s.baseline, scenario)).groupBy("cause").agg(
        at(scenario).alias("dead"), (at(s.baseline) - at(scenario)).alias("averted_deaths"))
    return group_shares(d, "cause", groups, default, "dead", "averted_deaths")


def chain_report(report: DataFrame, s: Settings) -> DataFrame:
    """Cumulative deaths averted by the steps of the nested care packages."""
    chains = [[f"{c}.1", f"{c}.2", f"{c}.0"] for c in s.arm_codes.values()]
    names = {f"{c}.0": f"{c}.4" for c in s.arm_codes.values()}
    return marginal(report, ["year"], "scenario", "cum_deaths_averted", chains, names)


def additivity_report(report: DataFrame, s: Settings, parts: list[str], parts_from: DataFrame | None = None) -> DataFrame:
    """Deaths averted by the package over the sum of its parts.

    ``parts_from`` may be another report (such as the unrounded one) for the parts.
    """
    source = report if parts_from is None else parts_from
    rows = stack(report.filter(F.col("scenario") == s.status_package), source.filter(F.col("scenario").isin(parts)))
    return nonadditivity(rows, [], "scenario", s.status_package, "deaths_averted", parts)


def cost_report(report: DataFrame, costs: DataFrame, scale: Column | float = 1.0) -> DataFrame:
    """Cost per death averted, by scenario, from the sum of the yearly amounts."""
    d = report.groupBy("scenario", "name").agg(F.sum("deaths_averted").alias("deaths_averted"))
    return cost_per_unit(d, costs.select(code_text("code").alias("scenario"), "total_cost"), ["scenario"], "deaths_averted", "total_cost", scale)


# 7. Recompute ---------------------------------------------------------------------

def recompute(
    results: DataFrame, rates: DataFrame, newborn: DataFrame, status: DataFrame, status_effects: DataFrame, risks: DataFrame,
    clinical: DataFrame, levels: DataFrame, s: Settings, chosen: list[str], tax: float | None = None,
    causes: list[str] = CAUSES, package_from_chosen: bool = True,
) -> DataFrame:
    """New totals for the scenarios a user's parameters change; the others stay.

    A tax gives new tax and package scenarios, a selection a new package, and changed
    targets in ``s.arm_variants`` new care scenarios.
    """
    codes = [s.status_package, *([s.tax_code] if tax is not None and s.tax_code in chosen else [])]
    eff = status_effect_table(status_effects, s, chosen, tax, package_from_chosen)
    parts = [status_impact(status_scenarios(status, eff, codes, s), risks, s)]
    if s.arm_variants is not None:
        parts.append(care_impact(levels, clinical, s))
        codes = [*codes, *[f"{s.arm_codes[a]}.{k}" for a in s.arms for k in s.arm_variants.get(a, s.variants)]]
    keys = ["scenario", "year", "sex", "age", "cause"]
    wide = effects_wide(stack(*[p.select(*keys, "target", "impact") for p in parts]), keys, "target", "impact", {"IR": "ir_eff", "CF": "cf_eff"})
    update = totals_by_scenario(trajectories(rates, newborn, wide, codes, s, causes)).filter(F.col("scenario") != s.baseline)
    return upsert_scenarios(results, update.select(*results.columns))
