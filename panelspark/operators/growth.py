"""Rates from counts, growth expansion and transition rates of cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.constants import ALL_CAUSES, GROWTH_CAP, PER, TRANSITION_CAP
from panelspark.functions.scalars import clamp, growth_rate, mean_of, no_nan, open_ratio, ratio
from panelspark.operators.joins import cohort_join, duplicate_error, with_values


def denominator(
    df: DataFrame, keys: list[str], metric: str, value: str, number: str = "Number", rate: str = "Rate", per: float = PER
) -> DataFrame:
    """Population behind a count and a rate: count / (rate / per)."""
    wide = df.groupBy(*keys).agg(
        F.max(F.when(F.col(metric) == number, F.col(value))).alias("_number"),
        F.max(F.when(F.col(metric) == rate, F.col(value))).alias("_rate"),
    )
    return wide.select(*keys, ratio("_number", F.col("_rate") / F.lit(float(per))).alias("population"))


def remainder(
    df: DataFrame, keys: list[str], part: str, value: str, parts: list | None = None, total_label: str = ALL_CAUSES,
    others_to_background: bool = False,
) -> DataFrame:
    """Per part: its value, the total, total minus part and total minus all parts.

    The parts of a key travel in one array through a single aggregation, which
    completes missing parts with zero and needs no join back to the totals.
    ``parts`` is the short list of parts to report. A part that is not listed raises,
    or with ``others_to_background`` stays in the background.
    """
    if not parts:
        raise ValueError("name the parts")
    if not others_to_background:
        listed = F.col(part).isin([*parts, total_label])
        text = F.concat(F.lit(f"{part} is not listed: "), F.coalesce(F.col(part).cast("string"), F.lit("NULL")))
        df = df.filter(F.when(listed, F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))
    def at(label):
        return F.when(F.col(part) == F.lit(label), F.col(value))
    wide = df.groupBy(*keys).agg(
        F.sum(at(total_label)).alias("total"), *[F.sum(at(p)).alias(f"_v{i}") for i, p in enumerate(parts)]
    )
    cells = [F.coalesce(F.col(f"_v{i}").cast("double"), F.lit(0.0)) for i in range(len(parts))]
    known = cells[0]
    for c in cells[1:]:
        known = known + c
    wide = wide.withColumn("background", F.col("total") - known)
    rows = F.array(*[F.struct(F.lit(p).alias("p"), c.alias("v")) for p, c in zip(parts, cells)])
    out = wide.withColumn("_r", F.explode(rows))
    return out.select(
        *keys,
        F.col("_r.p").alias(part),
        F.col("_r.v").alias("part_value"),
        "total",
        (F.col("total") - F.col("_r.v")).alias("other"),
        "background",
    )


def to_rates(df: DataFrame, counts: dict[str, str], denom: str) -> DataFrame:
    """Counts to rates per unit of ``denom``; ``counts`` maps new names to columns."""
    return df.withColumns({name: ratio(c, denom) for name, c in counts.items()})


def expand_growth(df: DataFrame, values: dict[str, str], steps: int, step: str = "step") -> DataFrame:
    """Repeat rows for steps 1..n with value * (1 + rate)^(step - 1); closed form."""
    out = df.withColumn(step, F.explode(F.sequence(F.lit(1), F.lit(steps))))
    power = (F.col(step) - 1).cast("double")
    return out.withColumns({v: F.col(v) * F.pow(F.lit(1.0) + F.col(r), power) for v, r in values.items()})


def project_forward(df: DataFrame, t: str, last: int, horizon: int) -> DataFrame:
    """Keep the rows up to ``last`` and repeat the last year for every later one."""
    years = F.when(F.col(t) == last, F.sequence(F.lit(last), F.lit(horizon))).otherwise(F.array(F.col(t).cast("int")))
    return df.filter(F.col(t) <= last).withColumn(t, F.explode(years))


def extend_edges(
    df: DataFrame, axis: str, source: int, targets: list[int] | range, overrides: dict[str, Column | float] | None = None
) -> DataFrame:
    """Copy the rows at ``source`` to the target ages, with some columns replaced.

    Done by exploding, so the input is read once.
    """
    here = F.col(axis) == source
    ages = F.when(here, F.array(F.lit(source), *[F.lit(int(x)) for x in targets])).otherwise(
        F.array(F.col(axis).cast("int"))
    )
    out = df.withColumn("_origin", F.col(axis)).withColumn(axis, F.explode(ages))
    for name, value in (overrides or {}).items():
        new = value if isinstance(value, Column) else F.lit(value)
        out = out.withColumn(name, F.when(F.col(axis) != F.col("_origin"), new).otherwise(F.col(name)))
    return out.drop("_origin")


def measures_wide(
    df: DataFrame,
    keys: list[str],
    measure: str,
    metric: str,
    value: str,
    wanted: dict[str, tuple[str, str]],
) -> DataFrame:
    """Rows that have all wanted (measure, metric) values, side by side.

    An N-way inner join on the same keys is one conditional aggregation. A measure
    given twice for a key raises.
    """
    def hit(pair):
        return F.when((F.col(measure) == pair[0]) & (F.col(metric) == pair[1]), F.col(value))
    aggs = [F.max(hit(p)).alias(n) for n, p in wanted.items()]
    counts = F.greatest(*[F.count(hit(p)) for p in wanted.values()], F.lit(0)).alias("_n")
    out = df.groupBy(*keys).agg(*aggs, counts).dropna("any", subset=list(wanted))
    return out.filter(F.when(F.col("_n") > 1, duplicate_error(keys)).otherwise(F.lit(True))).drop("_n")


def _step(value: str, rate: str, k: int) -> Column:
    """Value at step k under constant growth; step 1 is the start, whatever the rate."""
    if k == 1:
        return F.col(value)
    return F.col(value) * F.pow(F.lit(1.0) + F.col(rate), F.lit(float(k - 1)))


def disease_transition_rates(
    df: DataFrame,
    keys: list[str],
    part: str,
    axis: str,
    t: str,
    gap: int,
    axis_gap: int = 1,
    total_label: str = ALL_CAUSES,
    per: float = PER,
    growth_cap: float = GROWTH_CAP,
    rate_cap: float = TRANSITION_CAP,
) -> DataFrame:
    """Incidence and case fatality of each cohort between two cross-sections.

    ``df`` has one row per (keys, part, axis, t) with ``prev``, ``prev_rate``,
    ``death`` and ``death_rate`` (rates per ``per``), including the rows of the
    total. All pairs (t, t + gap) are taken at once; the result carries the later
    year and the earlier age, and pairs without an end year do not appear.
    """
    values = ["prev", "prev_rate", "death", "death_rate"]
    both = cohort_join(df.select(*keys, part, axis, t, *values), [*keys, part], axis, t, gap, values, axis_gap, "_2")
    cell = W.partitionBy(*keys, axis, t)  # as many rows as there are parts
    d = both.withColumn("_all", F.max(F.when(F.col(part) == total_label, F.struct("death", "death_2"))).over(cell))
    d = d.filter((F.col(part) != total_label) & F.col("_all").isNotNull())
    d = d.withColumns({
        "_pop1": open_ratio("death", "death_rate") * F.lit(float(per)),
        "_pop2": open_ratio("death_2", "death_rate_2") * F.lit(float(per)),
    })
    d = d.withColumns({
        "_well1": F.col("_pop1") - F.col("prev") - F.col("_all.death"),
        "_well2": F.col("_pop2") - F.col("prev_2") - F.col("_all.death_2"),
    })
    d = d.withColumns({"_ws1": open_ratio("_well1", "_pop1"), "_ws2": open_ratio("_well2", "_pop2")})
    d = d.withColumns({
        "_gw": growth_rate("_ws1", "_ws2", gap),
        "_gs": growth_rate("prev_rate", "prev_rate_2", gap),
        "_gd": growth_rate("death_rate", "death_rate_2", gap),
    }).withColumns({g: clamp(g, 0, 1, 0, growth_cap) for g in ("_gs", "_gd")})
    steps = range(1, gap + 1)
    d = d.withColumns({
        f"{name}{k}": _step(v, g, k) for name, v, g in (("_s", "prev", "_gs"), ("_d", "death", "_gd"), ("_w", "_well1", "_gw")) for k in steps
    })
    return _mean_rates(
        d, {
            "ir": [open_ratio(F.col(f"_s{k}") - (F.col(f"_s{k - 1}") - F.col(f"_d{k}")), f"_w{k - 1}") for k in steps[1:]],
            "cf": [open_ratio(f"_d{k}", f"_s{k - 1}") for k in steps[1:]],
        },
    ).select(
        *keys,
        part,
        axis,
        (F.col(t) + gap).cast("int").alias(t),
        clamp("ir", 0, 1, 0, rate_cap, 0.0).alias("ir"),
        clamp("cf", None, 1, None, rate_cap, 0.0).alias("cf"),
    )


def _mean_rates(d: DataFrame, terms: dict[str, list[Column]]) -> DataFrame:
    """Means of yearly terms, in stages so that no expression is repeated inside another."""
    d = d.withColumns({f"_{n}{i}": no_nan(x) for n, xs in terms.items() for i, x in enumerate(xs)})
    return d.withColumns({n: mean_of([F.col(f"_{n}{i}") for i in range(len(xs))]) for n, xs in terms.items()})


def status_transition_rates(
    df: DataFrame,
    keys: list[str],
    axis: str,
    t: str,
    gap: int,
    last_t: int,
    axis_gap: int | None = None,
    never: str = "never",
    current: str = "current",
    ex: str = "ex",
    ex_rate_from: str | None = None,
    growth_cap: float = GROWTH_CAP,
    rate_cap: float = TRANSITION_CAP,
) -> DataFrame:
    """Yearly initiation and cessation of each cohort between two cross-sections.

    Every state grows at its own rate; ``ex_rate_from='never'`` lets the ex state
    grow at the rate of the never state, as the published estimates do. A cell
    without a later partner gets rates of zero; pairs end at ``last_t``.
    """
    cols = [never, current, ex]
    d = cohort_join(df.select(*keys, axis, t, *cols), keys, axis, t, gap, cols, axis_gap, "_2", how="left")
    d = d.filter(F.col(t) <= last_t - gap)
    grown = {never: "_gn", current: "_gc", ex: "_ge"}
    d = d.withColumns({g: growth_rate(c, c + "_2", gap) for c, g in grown.items()})
    d = d.withColumns({g: clamp(g, None, 1, None, growth_cap) for g in grown.values()})
    ex_rate = "_gn" if ex_rate_from == never else "_ge"
    steps = range(1, gap + 1)
    d = d.withColumns({
        f"{name}{k}": _step(v, g, k) for name, v, g in (("_n", never, "_gn"), ("_c", current, "_gc"), ("_e", ex, ex_rate)) for k in steps
    })
    return _mean_rates(
        d, {
            "init": [open_ratio(F.col(f"_c{k}") - (F.col(f"_c{k - 1}") - F.col(f"_e{k}")), f"_n{k - 1}") for k in steps[1:]],
            "cess": [open_ratio(f"_e{k}", f"_c{k - 1}") for k in steps[1:]],
        },
    ).select(
        *keys,
        axis,
        (F.col(t) + gap).cast("int").alias(t),
        clamp("init", 0, 1, 0, rate_cap, 0.0).alias("init"),
        clamp("cess", 0, 1, 0, rate_cap, 0.0).alias("cess"),
    )


def split_series(
    wide: DataFrame,
    history: DataFrame,
    keys: list[str],
    group: str,
    t: str,
    value: str,
    year_cols: list[str],
    groups: tuple[str, str],
    unit: float = 1000.0,
    scale: float = 1.0,
    horizon: int | None = None,
    fill_years: list[int] | None = None,
) -> DataFrame:
    """A wide yearly total split over two groups by their share in the history.

    The wide table is unpivoted, multiplied by ``unit`` and ``scale`` and split; the
    history is appended; ``fill_years`` without data are interpolated, constant at
    the ends. A place without history keeps its rows, without values.
    """
    from panelspark.operators.interp import gap_fill

    share = history.groupBy(*keys).agg(
        ratio(F.sum(F.when(F.col(group) == groups[0], F.col(value))), F.sum(value)).alias("_share")
    )
    long = wide.unpivot(keys, year_cols, t, "_v").withColumn(t, F.regexp_extract(t, r"(\d+)$", 1).try_cast("int"))
    long = long.withColumn("_v", F.col("_v").try_cast("double") * F.lit(float(unit)) * F.lit(float(scale)))
    long = with_values(long.join(share, keys, "left"), group, list(groups))
    part = F.when(F.col(group) == groups[0], F.col("_share")).otherwise(F.lit(1.0) - F.col("_share"))
    made = long.select(*keys, group, t, (F.col("_v") * part).alias(value))
    out = made.unionByName(history.select(*keys, group, F.col(t).cast("int").alias(t), value))
    if horizon is not None:
        out = out.filter(F.col(t) <= horizon)
    if fill_years:
        gaps = with_values(out.select(*keys, group).distinct(), t, fill_years).withColumn(value, F.lit(None).cast("double"))
        out = gap_fill(out.unionByName(gaps), [*keys, group], t, [value], hold_ends=True)
    return out
