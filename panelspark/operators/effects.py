"""Scenario effects: from effect tables to multipliers on rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.constants import BASE_PRICE, INCREMENT_FLOOR, TAX_EFFECT_CAP, TAX_ELASTICITY
from panelspark.functions.scalars import complement_product, product, ratio
from panelspark.operators.joins import band_join, duplicate_error, left_join, with_values


def effects_by_target(
    df: DataFrame, keys: list[str], target: str, value: str, targets: list[str], both: str = "both"
) -> DataFrame:
    """Effects side by side per target; an effect on both is merged into each.

    1 - (1 - x)(1 - both), with 0 for a missing effect.
    """
    def at(label):
        return F.coalesce(F.max(F.when(F.col(target) == F.lit(label), F.col(value))), F.lit(0.0))
    n = F.greatest(*[F.count(F.when(F.col(target) == F.lit(x), 1)) for x in [*targets, both]]).alias("_n")
    out = df.groupBy(*keys).agg(*[at(x).alias(f"_{x}") for x in [*targets, both]], n)
    out = out.filter(F.when(F.col("_n") > 1, duplicate_error(keys)).otherwise(F.lit(True)))
    return out.select(
        *keys, *[(F.lit(1.0) - (F.lit(1.0) - F.col(f"_{x}")) * (F.lit(1.0) - F.col(f"_{both}"))).alias(x) for x in targets]
    )


def effect_bands(df: DataFrame, label: str, start: str, stop: str, first: int = 10, youth_last: int = 25, last: int = 65,
                 youth_label: str = "10 to 25") -> DataFrame:
    """Age limits from the text of an effect table."""
    return df.withColumns({
        start: F.lit(first),
        stop: F.when(F.col(label) == youth_label, F.lit(youth_last)).otherwise(F.lit(last)),
    })


def package_effects(
    df: DataFrame, keys: list[str], values: list[str], stop: str, start: str = "age_start", youth_last: int = 25,
    first: int = 10, last: int = 65,
) -> DataFrame:
    """All effects taken together, in two age bands.

    The young band combines the rows that are limited to it, the older band
    combines all rows. One aggregation makes both.
    """
    young = F.col(stop) == youth_last
    aggs = []
    for v in values:
        aggs.append(complement_product(F.when(young, F.col(v))).alias(f"_y_{v}"))
        aggs.append(complement_product(v).alias(f"_a_{v}"))
    out = df.groupBy(*keys).agg(*aggs, F.count(F.when(young, 1)).alias("_n"))
    older = F.struct(F.lit(youth_last + 1).alias("a"), F.lit(last).alias("z"), *[F.col(f"_a_{v}").alias(v) for v in values])
    younger = F.struct(F.lit(first).alias("a"), F.lit(youth_last).alias("z"), *[F.col(f"_y_{v}").alias(v) for v in values])
    rows = F.array_compact(F.array(F.when(F.col("_n") > 0, younger), older))
    out = out.withColumn("_r", F.explode(rows))
    return out.select(*keys, F.col("_r.a").alias(start), F.col("_r.z").alias(stop), *[F.col(f"_r.{v}").alias(v) for v in values])


def combine_effects(df: DataFrame, keys: list[str], values: list[str], how: str = "product") -> DataFrame:
    """Effects of several rows per key as one: product, or 1 - prod(1 - x)."""
    f = product if how == "product" else complement_product
    return df.groupBy(*keys).agg(*[f(v).alias(v) for v in values])


def add_package(
    effects: DataFrame, scenario: str, members: list, code, keys: list[str], values: list[str]
) -> DataFrame:
    """Append a scenario that multiplies the effects of its members."""
    made = combine_effects(effects.filter(F.col(scenario).isin(members)), keys, values).withColumn(
        scenario, F.lit(code).cast(effects.schema[scenario].dataType)
    )
    return effects.unionByName(made.select(*effects.columns))


def duplicate_target(df: DataFrame, target: str, targets: list[str]) -> DataFrame:
    """The same effect for each of several targets."""
    return with_values(df, target, targets)


def effects_wide(
    df: DataFrame, keys: list[str], target: str, value: str, targets: dict[str, str], default: float = 1.0
) -> DataFrame:
    """One row per key with a column per target; a missing effect is ``default``, a repeated one raises."""
    aggs, counts = [], []
    for label, name in targets.items():
        hit = F.col(target) == F.lit(label)
        aggs.append(F.coalesce(F.max(F.when(hit, F.col(value))), F.lit(default)).alias(name))
        counts.append(F.count(F.when(hit, 1)))
    n = (F.greatest(*counts) if len(counts) > 1 else counts[0]).alias("_n")
    out = df.groupBy(*keys).agg(*aggs, n)
    return out.filter(F.when(F.col("_n") > 1, duplicate_error(keys)).otherwise(F.lit(True))).drop("_n")


def apply_effects(
    rates: DataFrame, effects: DataFrame, keys: list[str], targets: dict[str, str], default: float = 1.0
) -> DataFrame:
    """Multiply rates by effects; ``targets`` maps a rate column to its effect column.

    A rate without an effect is multiplied by ``default``. The effects must have
    one row per key, see ``effects_wide``.
    """
    joined = left_join(rates, effects.select(*keys, *targets.values()), keys)
    return joined.withColumns(
        {r: F.col(r) * F.coalesce(F.col(e), F.lit(default)) for r, e in targets.items()}
    ).select(*rates.columns)


def scale_rates(
    rates: DataFrame,
    effects: DataFrame,
    axis: str,
    t: str,
    start_t: int,
    on: list[str] | None = None,
    init: str = "init",
    cess: str = "cess",
    start: str = "age_start",
    stop: str = "age_stop",
    cap: float = 1.0,
) -> DataFrame:
    """From ``start_t`` on, raise cessation and lower initiation by the effect of the age band.

    ``effects`` has ``cessation`` and ``initiation`` per band; a scenario is a column
    of both tables named in ``on``. Cessation is limited to ``cap``.
    """
    on = on or []
    bands = effects.select(*on, start, stop, "cessation", "initiation")
    joined = band_join(rates, axis, bands, start, stop, on, how="left")
    active = F.col(t) >= start_t
    e, i = F.coalesce("cessation", F.lit(0.0)), F.coalesce("initiation", F.lit(0.0))
    q = F.when(active, F.col(cess) * (F.lit(1.0) + e)).otherwise(F.col(cess))
    return joined.withColumns({
        cess: F.when(q > cap, F.lit(float(cap))).otherwise(q),
        init: F.when(active, F.col(init) * (F.lit(1.0) - i)).otherwise(F.col(init)),
    }).select(*rates.columns)


def required(c: str, keys: list[str]) -> Column:
    """The value, or an error that names the key without one: sums must not lose a category."""
    text = [F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys]
    missing = F.raise_error(F.concat(F.lit(f"no {c} for: "), F.concat_ws(", ", *text)))
    return F.coalesce(F.col(c), missing.cast("double"))


def potential_impact(
    shares: DataFrame,
    risk: DataFrame,
    keys: list[str],
    risk_keys: list[str],
    category: str,
    base: str = "base_share",
    new: str = "new_share",
    rr: str = "rr",
) -> DataFrame:
    """sum(RR new) / sum(RR base) per key and outcome, in one pass.

    The join expands every share by the outcomes of its (risk_keys, category);
    ``keys`` includes the outcome column of the risk table.
    """
    missing = required(rr, [*risk_keys, category])
    joined = shares.join(risk, [*risk_keys, category], "left").withColumn(rr, missing)
    return joined.groupBy(*keys).agg(
        F.sum(F.col(rr) * F.col(base)).alias("alpha"),
        ratio(F.sum(F.col(rr) * F.col(new)), F.sum(F.col(rr) * F.col(base))).alias("impact"),
    )


def phase_in(
    effects: DataFrame,
    rr: str,
    t: str,
    axis: str,
    years: range,
    ages: range,
    start: int,
    length: int,
    axis_max: int,
) -> DataFrame:
    """Linear phase-in of a relative risk: 1 - (1 - RR)(t - start) / length.

    1 before ``start`` and above ``axis_max``.
    """
    out = with_values(with_values(effects, t, years), axis, ages)
    part = F.when(F.col(t) < start, F.lit(0.0)).otherwise(
        (F.lit(1.0) - F.col(rr)) * (F.col(t) - start) / F.lit(float(length))
    )
    return out.withColumn("impact", F.when(F.col(axis) > axis_max, F.lit(1.0)).otherwise(F.lit(1.0) - part))


def cascade(
    levels: DataFrame,
    variants: dict[str, dict[str, float]],
    t: str,
    base_t: int,
    end_t: int,
    aware: str = "aware",
    connection: str = "connection",
    quality: str = "quality",
    treated: str = "treated",
    control: str = "control",
    scenario: str = "scenario",
) -> DataFrame:
    """Care cascades of all variants in one pass.

    From ``base_t`` to ``end_t`` a level named in a variant moves on a straight line
    to its target, other levels keep their base value; treated = aware connection
    and control = treated quality. Earlier years are kept as they are.
    """
    target = F.array(*[
        F.struct(
            F.lit(name).alias("s"),
            *[F.lit(v.get(c)).cast("double").alias(c) for c in (aware, connection, quality)],
        )
        for name, v in variants.items()
    ])
    years = F.when(F.col(t) == base_t, F.sequence(F.lit(base_t), F.lit(end_t))).otherwise(F.array(F.col(t).cast("int")))
    out = levels.filter(F.col(t) <= base_t).withColumn("_v", F.explode(target)).withColumn("_from", F.col(t))
    out = out.withColumn(t, F.explode(years))
    ramp = (F.col(t) - base_t) / F.lit(float(end_t - base_t))
    for c in (aware, connection, quality):
        goal = F.col(f"_v.{c}")
        moved = F.when(goal.isNull() | (F.col("_from") < base_t), F.col(c)).otherwise(F.col(c) + (goal - F.col(c)) * ramp)
        out = out.withColumn(c, moved)
    recent = F.col("_from") == base_t
    out = out.withColumn(treated, F.when(recent, F.col(aware) * F.col(connection)).otherwise(F.col(treated)))
    out = out.withColumn(control, F.when(recent, F.col(treated) * F.col(quality)).otherwise(F.col(control)))
    return out.withColumn(scenario, F.col("_v.s")).drop("_v", "_from")


def cascade_impact(
    cascades: DataFrame,
    base: DataFrame,
    risk: DataFrame | list[tuple],
    keys: list[str],
    t: str,
    cause: str,
    target: str,
    prevalence: str,
    floor: float = INCREMENT_FLOOR,
    treated: str = "treated",
    control: str = "control",
    rr_treat: str = "rr_treat",
    rr_control: str = "rr_control",
    weighted_target: str = "CF",
    scenario: str = "scenario",
    risk_keys: list[str] | None = None,
) -> DataFrame:
    """Effect of more treatment and control than in the base year.

    impact = (1 - (dT - dC)(1 - RR treat)) (1 - dC (1 - RR control)); for the
    weighted target 1 - (1 - impact) prevalence. Increments below ``floor`` count as
    0. ``base`` has the base-year levels per key. ``risk`` is a list of (cause, target,
    RR treat, RR control) or a table of them per ``risk_keys``. Rows without a value
    are dropped.
    """
    b = base.select(*keys, F.col(treated).alias("_bt"), F.col(control).alias("_bc"))
    d = cascades.join(b, keys)
    def inc(now, was):
        x = F.col(now) - F.col(was)
        return F.when(x < floor, F.lit(0.0)).otherwise(x)
    d = d.withColumns({"_dt": inc(treated, "_bt"), "_dc": inc(control, "_bc")})
    if isinstance(risk, list):
        rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip((cause, target, rr_treat, rr_control), r)]) for r in risk]
        d = d.withColumn("_r", F.explode(F.array(*rows)))
    else:
        if not risk_keys:
            raise ValueError("a risk table is joined on risk_keys; give a short table as a list of rows")
        d = d.join(risk.select(*risk_keys, F.struct(cause, target, rr_treat, rr_control).alias("_r")), risk_keys)
    gain_t = (F.col("_dt") - F.col("_dc")) * (F.lit(1.0) - F.col(f"_r.{rr_treat}"))
    gain_c = F.col("_dc") * (F.lit(1.0) - F.col(f"_r.{rr_control}"))
    plain = (F.lit(1.0) - gain_t) * (F.lit(1.0) - gain_c)
    weighted = F.when(
        F.col(f"_r.{target}") == weighted_target, F.lit(1.0) - (F.lit(1.0) - plain) * F.col(prevalence)
    ).otherwise(plain)
    return d.select(
        scenario, *keys, t, F.col(f"_r.{cause}").alias(cause), F.col(f"_r.{target}").alias(target), weighted.alias("impact")
    ).dropna("any")


def relative_risk_reduction(
    shares: DataFrame,
    matrix: DataFrame,
    risk: DataFrame,
    keys: list[str],
    category: str,
    share: str = "share",
    rr: str = "rr",
    risk_keys: list[str] | None = None,
    origin: str = "from_category",
    dest: str = "to_category",
    weight: str = "weight",
    matrix_keys: list[str] | None = None,
) -> DataFrame:
    """Relative risk after people move between categories by a transition matrix.

    alpha = sum(share RR); new share = share x matrix; result = sum(new share RR) / alpha.
    The matrix is a long table, so its product is a join and a sum. The change of
    risk of one origin, sum over destinations of weight RR, belongs to the small
    tables and is formed there first; the shares are then joined only once.
    """
    risk_keys, matrix_keys = risk_keys or [], matrix_keys or []
    after = (
        matrix.join(risk.withColumnRenamed(category, dest), [*[k for k in matrix_keys if k in risk_keys], dest], "left")
        .withColumn(rr, required(rr, [dest]))
        .groupBy(*dict.fromkeys([*matrix_keys, *risk_keys]), F.col(origin).alias(category))
        .agg(F.sum(F.col(weight) * F.col(rr)).alias("_after"))
    )
    both = [k for k in dict.fromkeys([*matrix_keys, *risk_keys]) if k in shares.columns]
    table = after.join(risk.select(*risk_keys, category, rr), [*risk_keys, category])
    joined = shares.join(table, [*both, category], "left").withColumn(rr, required(rr, [*both, category]))
    return joined.groupBy(*keys).agg(
        F.sum(F.col(share) * F.col(rr)).alias("alpha"),
        ratio(F.sum(F.col(share) * F.col("_after")), F.sum(F.col(share) * F.col(rr))).alias("rrr"),
    )


def tax_effect(
    tax: Column | str, elasticity: float = TAX_ELASTICITY, base_price: float = BASE_PRICE, cap: float = TAX_EFFECT_CAP
) -> dict[str, Column]:
    """Effect, pack price and tax share of a tax."""
    x = F.col(tax) if isinstance(tax, str) else tax
    return {
        "effect": F.least(F.lit(float(cap)), F.lit(float(elasticity)) * x / F.lit(float(base_price))),
        "price": x + F.lit(float(base_price)),
        "tax_share": F.lit(100.0) * F.round(x / (x + F.lit(float(base_price))), 2),
    }
