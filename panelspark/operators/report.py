"""Reports on scenario results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.constants import SMOKE_SHARE
from panelspark.functions.scalars import case_map, ratio, signif
from panelspark.operators.joins import look_up, null_safe_join
from panelspark.operators.windows import running_total


def _signif(x: Column, digits: int | None) -> Column:
    return x if digits is None else signif(x, digits)


def baseline_join(df: DataFrame, keys: list[str], scenario: str, baseline, cols: list[str], prefix: str = "base_") -> DataFrame:
    """The baseline value of the same key next to every row.

    One window over the scenarios of a key, instead of a join of the table with
    itself; a key has as many rows as there are scenarios.
    """
    w = W.partitionBy(*keys)
    return df.withColumns({prefix + c: F.max(F.when(F.col(scenario) == F.lit(baseline), F.col(c))).over(w) for c in cols})


def averted(
    df: DataFrame,
    keys: list[str],
    t: str,
    scenario: str,
    baseline,
    measures: dict[str, str],
    digits: int | None = 3,
    cumulative: bool = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """Baseline minus scenario, at least 0, to significant digits.

    ``measures`` maps a column to the name of its averted amount. ``cumulative``
    adds the running sum of the rounded amounts, rounded again; ``digits=None`` is
    exact. ``keep`` names further columns of the input to return.
    """
    out = baseline_join(df, [*keys, t], scenario, baseline, list(measures), "_b_")
    out = out.filter(F.col(scenario) != F.lit(baseline))
    gain = {n: F.col(f"_b_{c}") - F.col(c) for c, n in measures.items()}
    out = out.withColumns({n: F.when(g < 0, F.lit(0.0)).otherwise(_signif(g, digits)) for n, g in gain.items()})
    names = list(measures.values())
    out = out.select(*keys, t, scenario, *(keep or []), *names)
    if cumulative:
        out = running_total(out, [*keys, scenario], [t], names)
        out = out.withColumns({f"cum_{n}": _signif(F.col(f"cum_{n}"), digits) for n in names})
    return out


def averted_totals(df: DataFrame, keys: list[str], t: str, from_t: int, measures: list[str]) -> DataFrame:
    """Sums from a year on."""
    return df.filter(F.col(t) >= from_t).groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def scenario_difference(
    df: DataFrame, keys: list[str], scenario: str, baseline, other, value: str
) -> DataFrame:
    """Baseline and one scenario side by side, and their difference."""
    def at(x):
        return F.sum(F.when(F.col(scenario) == F.lit(x), F.col(value)))
    out = df.filter(F.col(scenario).isin(baseline, other)).groupBy(*keys).agg(
        at(baseline).alias("base_value"), at(other).alias("scenario_value")
    )
    return out.withColumn("difference", F.col("base_value") - F.col("scenario_value"))


def nonadditivity(df: DataFrame, keys: list[str], scenario: str, package, value: str, parts: list | None = None) -> DataFrame:
    """Total of a package over the sum of its parts."""
    is_part = F.col(scenario).isin(parts) if parts else F.col(scenario) != F.lit(package)
    return df.groupBy(*keys).agg(
        F.sum(F.when(F.col(scenario) == F.lit(package), F.col(value))).alias("package_total"),
        F.sum(F.when(is_part, F.col(value))).alias("parts_total"),
    ).withColumn("ratio", ratio("package_total", "parts_total"))


def scaled_parts(df: DataFrame, keys: list[str], scenario: str, package, value: str, parts: list | None = None, cols: list[str] | None = None) -> DataFrame:
    """The rows with the parts of a package scaled so that they add up to it: amounts times the ratio of ``nonadditivity``.

    A part without a ratio (no package, or parts that add up to zero) becomes NULL.
    """
    is_part = F.col(scenario).isin(parts) if parts else F.col(scenario) != F.lit(package)
    ratios = nonadditivity(df, keys, scenario, package, value, parts).select(*keys, F.col("ratio").alias("_ratio"))
    out = null_safe_join(df, ratios, keys)
    return out.withColumns({c: F.when(is_part, F.col(c) * F.col("_ratio")).otherwise(F.col(c)) for c in cols or [value]}).drop("_ratio")


def marginal(
    df: DataFrame, keys: list[str], scenario: str, value: str, chains: list[list], names: dict | None = None
) -> DataFrame:
    """Increments along chains of nested packages, one row per member.

    A chain runs from the smallest package to the largest; the first keeps its
    value, each other one gives its value minus that of its neighbour.
    """
    members = list(dict.fromkeys(m for chain in chains for m in chain))
    wide = df.filter(F.col(scenario).isin(members)).groupBy(*keys).agg(
        *[F.sum(F.when(F.col(scenario) == F.lit(m), F.col(value))).alias(f"_m{i}") for i, m in enumerate(members)]
    )
    at = {m: F.col(f"_m{i}") for i, m in enumerate(members)}
    rows = []
    for chain in chains:
        for k, m in enumerate(chain):
            step = at[m] if k == 0 else at[m] - at[chain[k - 1]]
            label = m if names is None else names.get(m, m)
            rows.append(F.struct(F.lit(label).alias(scenario), step.alias(value)))
    return wide.select(*keys, F.inline(F.array(*rows)))


def survival_prob(
    df: DataFrame, keys: list[str], band: str, dead: str, pop: str, width: float = 5.0
) -> DataFrame:
    """Probability of dying between the first and the last band: 1 - prod(1 - w m / (1 + w m / 2)).

    ``df`` may have several rows per band; m is deaths over population of the band.
    """
    m = F.col("_m")
    banded = df.groupBy(*keys, band).agg(ratio(F.sum(dead), F.sum(pop)).alias("_m"))
    q = F.lit(float(width)) * m / (F.lit(1.0) + F.lit(width / 2.0) * m)
    return banded.groupBy(*keys).agg((F.lit(1.0) - F.product(F.lit(1.0) - q)).alias("dying_prob"))


def prevalence_total(
    pop: DataFrame, shares: DataFrame, on: list[str], keys: list[str], share: str = "current", people: str = "pop", per: float = 100.0,
    placed: bool = False,
) -> DataFrame:
    """People in a category and their part of the population.

    With ``placed`` both tables were distributed by some of ``on`` (``gather``) and meet without a shuffle; a second row of people
    for one key raises.
    """
    own = [k for k in keys if k in shares.columns and k not in on]
    parts = shares.select(*on, *own, share)
    d = look_up(parts, pop, on, [c for c in pop.columns if c not in on]) if placed else pop.join(parts, on)
    d = d.filter(F.col(people).isNotNull() & F.col(share).isNotNull())
    return d.groupBy(*keys).agg(
        F.sum(F.col(people) * F.col(share) / F.lit(per)).alias("cases"), F.sum(people).alias("population")
    ).withColumn("rate", ratio("cases", "population"))


def share_check(
    df: DataFrame, keys: list[str], t: str, axis: str, value: str, axis_below: int = 20, share: float = SMOKE_SHARE, digits: int | None = 3
) -> DataFrame:
    """A fixed share of the amount below an age, per year and cumulated."""
    out = df.filter(F.col(axis) < axis_below).groupBy(*keys, t).agg(F.sum(value).alias("base"))
    gain = F.col("base") * F.lit(float(share))
    out = out.withColumn("averted", F.when(gain < 0, F.lit(0.0)).otherwise(_signif(gain, digits)))
    out = running_total(out, keys, [t], ["averted"])
    return out.withColumn("cum_averted", _signif(F.col("cum_averted"), digits))


def group_shares(
    df: DataFrame, part: str, groups: dict[str, list], default: str, deaths: str, averted_col: str, keys: list[str] | None = None
) -> DataFrame:
    """Deaths and averted deaths per group of causes, with percent averted."""
    keys = keys or []
    out = df.groupBy(*keys, case_map(part, groups, default).alias("group_name")).agg(
        F.sum(deaths).alias("deaths"), F.sum(averted_col).alias("averted")
    )
    return out.withColumn("percent", F.lit(100.0) * ratio("averted", "deaths"))


def model_vs_observed(model: DataFrame, observed: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Modelled and observed values in one long table (metric, val)."""
    m = model.select(*keys, *[F.col(c).alias(f"model_{c}") for c in measures])
    o = observed.select(*keys, *[F.col(c).alias(f"obs_{c}") for c in measures])
    cols = [f"{s}_{c}" for c in measures for s in ("model", "obs")]
    return m.join(o, keys).unpivot(keys, cols, "metric", "val")


def cost_per_unit(
    df: DataFrame, costs: DataFrame, on: list[str], amount: str, total: str = "total_cost", scale: Column | float = 1.0
) -> DataFrame:
    """Cost per averted unit; the amount may be scaled and is rounded to whole units."""
    factor = scale if isinstance(scale, Column) else F.lit(float(scale))
    out = df.withColumn(amount, F.round(F.col(amount) * factor)).join(costs.select(*on, total), on, "left")
    return out.withColumn("cost_per_unit", ratio(total, amount))
