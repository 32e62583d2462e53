"""Cohort roll-forward.

State only moves along birth diagonals: the row at (t, a) belongs to the cohort
``t - a``. A cohort is therefore independent of all others, and the whole history
of one cohort is a fold over its yearly steps. The rows are shuffled once by
(keys, cohort), folded with the built-in ``aggregate`` and exploded again; years
do not add stages to the plan. A cohort holds at most (years x parts) cells, and
a repeated cell raises before anything is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.constants import TRANSITION_CAP
from panelspark.functions.scalars import bind, floor0
from panelspark.operators.joins import duplicate_error, tasks


def _roles(df: DataFrame, keys: list[str], axis: str, t: str, first_t: int, axis_range: tuple[int, int], self_always: bool):
    """Each row twice: as a cell of its own cohort and as the rates of the cohort one year younger.

    The row (t, a) gives the rates of the step that ends at (t, a + 1).
    """
    lo, hi = axis_range
    inside = df.filter((F.col(t) >= first_t) & F.col(axis).between(lo, hi))
    own = F.struct(F.lit(0).alias("role"), F.col(t) - F.col(axis))
    rate = F.struct(F.lit(1).alias("role"), F.col(t) - F.col(axis) - 1)
    is_seed = (F.col(t) == first_t) | (F.col(axis) == lo)
    is_rate = (F.col(t) > first_t) & (F.col(axis) < hi)
    own_wanted = F.lit(True) if self_always else is_seed
    # Cases instead of a filter over an array: these compile.
    pick = F.when(own_wanted & is_rate, F.array(own, rate)).when(own_wanted, F.array(own)).when(is_rate, F.array(rate))
    out = inside.withColumn("_role", F.explode(pick))
    return out.withColumn("_b", F.col("_role").getField("col2").cast("int")).withColumn("_role", F.col("_role.role"))


def roll_composition(
    panel: DataFrame,
    keys: list[str],
    axis: str,
    t: str,
    first_t: int,
    axis_range: tuple[int, int],
    never: str = "never",
    current: str = "current",
    ex: str = "ex",
    init: str = "init",
    cess: str = "cess",
    placed: bool = False,
) -> DataFrame:
    """Roll a never / current / ex composition forward along its cohorts.

    The first year is given for all ages and the first age for all years; every
    other cell follows from the cell one year and one age before:

        current' = current (1 - cess) + never init
        ex'      = ex + current cess
        never'   = never (1 - init)

    with the rates of the row (t, a) for the step to (t, a + 1). The rates of each
    cell are returned with it. A missing year ends the cohort.

    ``placed`` says that the panel was distributed by some of the keys (``gather``) before it was widened; it is not shuffled again.
    """
    lo, hi = axis_range
    r = _roles(panel, keys, axis, t, first_t, axis_range, self_always=True)
    own, rate = F.col("_role") == 0, F.col("_role") == 1
    def one(flag, c):
        return F.max(F.when(flag, F.col(c).cast("double")))
    cells = (
        (r if placed else r.repartition(tasks(r), *keys, "_b"))
        .groupBy(*keys, "_b", F.col(t).cast("int").alias("_t"))
        .agg(
            one(own, never).alias("n"), one(own, current).alias("c"), one(own, ex).alias("e"),
            one(own, init).alias("own_init"), one(own, cess).alias("own_cess"),
            one(rate, init).alias("i"), one(rate, cess).alias("q"),
            F.count(F.when(own, 1)).alias("_n0"), F.count(F.when(rate, 1)).alias("_n1"),
        )
        .filter(F.when(F.greatest("_n0", "_n1") > 1, duplicate_error([*keys, "_b", "_t"])).otherwise(F.lit(True)))
    )
    cohorts = cells.groupBy(*keys, "_b").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_t").alias("t"), "n", "c", "e", "i", "q", "own_init", "own_cess"))).alias("s")
    )
    def state(t, n, c, e, i, q):
        return F.struct(t.alias("t"), n.alias("n"), c.alias("c"), e.alias("e"), i.alias("init"), q.alias("cess"))
    # The cast makes the type of the history nullable: a gap adds a NULL.
    start = bind(
        F.get(F.col("s"), F.lit(0)),
        lambda s: F.array(state(s["t"], s["n"], s["c"], s["e"], s["own_init"], s["own_cess"])),
    ).cast("array<struct<t:int,n:double,c:double,e:double,init:double,cess:double>>")
    def step(out: Column, s: Column) -> Column:
        def move(p: Column) -> Column:
            ok = (s["t"] == p["t"] + 1) & s["i"].isNotNull() & s["q"].isNotNull()
            return F.when(ok, state(
                s["t"],
                floor0(p["n"] * (F.lit(1.0) - s["i"])),
                floor0(p["c"] * (F.lit(1.0) - s["q"]) + p["n"] * s["i"]),
                floor0(p["c"] * s["q"] + p["e"]),
                s["own_init"], s["own_cess"],
            ))
        return F.array_append(out, bind(F.element_at(out, -1), move))
    # A cohort whose first cell is no seed (it starts after a gap) has no state.
    first = F.get(F.col("s"), F.lit(0))["t"]
    seeded = (first == first_t) | (first == F.col("_b") + lo)
    rest = F.slice(F.col("s"), F.lit(2), F.greatest(F.size("s") - 1, F.lit(0)))
    rolled = cohorts.filter(seeded).withColumn("o", F.explode(F.aggregate(rest, start, step)))
    return rolled.filter(F.col("o").isNotNull()).select(
        *keys,
        (F.col("o.t") - F.col("_b")).cast("int").alias(axis),
        F.col("o.t").alias(t),
        F.col("o.n").alias(never), F.col("o.c").alias(current), F.col("o.e").alias(ex),
        F.col("o.init").alias(init), F.col("o.cess").alias(cess),
    )


STATES = ("well", "newcases", "sick", "dead", "pop", "all_dead")


def roll_coupled(
    panel: DataFrame,
    keys: list[str],
    part: str,
    parts: list,
    axis: str,
    t: str,
    first_t: int,
    axis_range: tuple[int, int],
    cap: float = TRANSITION_CAP,
    grid: dict[str, tuple[range, str, float]] | None = None,
    carry: list[str] | None = None,
    spread: list[str] | None = None,
    with_rates: bool = False,
    blocks: int = 1,
    placed: bool = False,
) -> DataFrame:
    """Roll well / sick / dead states forward; all parts of a cohort share its deaths.

    ``panel`` has one row per (keys, axis, t, part) with ``nx``, ``prev_rate``,
    ``dis_mx``, ``all_mx``, ``bg_mx``, ``bg_mx_all``, ``ir`` and ``cf``. First year
    and first age are seeds. For a step to (t, a + 1), with the rates of row (t, a):

        newcases' = well ir
        sick'     = sick (1 - (cf + bg_mx)) + well ir
        dead'     = sick cf
        pop'      = pop - all_dead
        all_dead' = sum over parts of dead' + pop' bg_mx_all
        well'     = pop' - all_dead' - sick'

    each at least 0. ``ir`` and ``cf`` are capped after the first new cases. A part
    without rates in a year ends there; a missing year ends the cohort.

    ``grid`` maps a column name to (whole numbers, 'ir' or 'cf', step) and runs the
    cohort once per combination with the rate times 1 + number * step. The grid is
    made after the shuffle, so it multiplies work but not shuffled rows.

    ``carry`` columns of the panel row at the same (axis, t) come along, and with
    ``with_rates`` its own capped ``ir`` and ``cf`` (not those that led to it).

    ``spread`` names the columns to distribute the cohorts by (default: keys and
    cohort). Naming only ``keys`` keeps later sums over ages local to a task. With ``blocks`` the cohorts of one value of ``spread``
    are dealt to so many places. With ``placed`` nothing is shuffled here: the panel was distributed by some of the keys (``gather``)
    before it was widened.
    """
    carry = carry or []
    grid = grid or {}
    lo, hi = axis_range
    r = _roles(panel, keys, axis, t, first_t, axis_range, self_always=bool(carry) or with_rates)
    numbered = F.array_position(F.array(*[F.lit(p) for p in parts]), F.col(part)).cast("int")
    unlisted = F.raise_error(F.concat(F.lit(f"{part} is not listed: "), F.coalesce(F.col(part).cast("string"), F.lit("NULL"))))
    r = r.withColumn("_p", F.when(numbered > 0, numbered).otherwise(unlisted.cast("int")))
    held = [*keys, "_b"]
    if blocks > 1:
        r, held = r.withColumn("_blk", F.pmod(F.col("_b"), F.lit(blocks))), [*keys, "_blk", "_b"]
        spread = [*spread, "_blk"] if spread else None
    own, rate = F.col("_role") == 0, F.col("_role") == 1
    def one(flag, c, kind="double"):
        return F.max(F.when(flag, F.col(c).cast(kind)))
    seeds = ["nx", "prev_rate", "dis_mx", "all_mx"]
    rates = ["bg_mx", "bg_mx_all", "ir", "cf"]
    r = r if placed else r.repartition(tasks(r), *(spread or [*keys, "_b"]))
    year = F.col(t).cast("int").alias("_t")
    if carry or with_rates:
        cells = (
            r.groupBy(*held, year, "_p")
            .agg(
                *[one(own, c).alias(c) for c in seeds],
                one(own, "ir").alias("ir0"), one(own, "cf").alias("cf0"),
                *[one(rate, c).alias(c) for c in rates],
                *[one(own, c, panel.schema[c].dataType).alias(f"_c_{c}") for c in carry],
                F.count(F.when(own, 1)).alias("_n0"), F.count(F.when(rate, 1)).alias("_n1"),
            )
            .filter(F.when(F.greatest("_n0", "_n1") > 1, duplicate_error([*keys, "_b", "_t", "_p"])).otherwise(F.lit(True)))
        )
    else:
        # Seeds only: a cell is either a seed or has rates, never both, so there is nothing to merge.
        def only(flag, c, name):
            return F.when(flag, F.col(c).cast("double")).alias(name)
        cells = r.select(*held, year, "_p", *[only(own, c, c) for c in seeds], only(own, "ir", "ir0"), *[only(rate, c, c) for c in rates])
    # Rates are capped here when no grid scales them, in compiled code; a part without
    # all its rates has no fatality and ends in the fold.
    scaled = {which for _, which, _ in grid.values()}
    def ready(c):
        return F.col(c) if c in scaled else F.least(F.col(c), F.lit(float(cap)))
    complete = F.col("ir").isNotNull() & F.col("cf").isNotNull() & F.col("bg_mx").isNotNull() & F.col("bg_mx_all").isNotNull()
    own_cols = [*(("ir0", "cf0") if with_rates else ()), *[f"_c_{c}" for c in carry]]
    cell = F.struct(
        F.col("_p").alias("p"),
        F.when(complete, ready("cf")).alias("cf"), ready("ir").alias("ir"), F.col("bg_mx").alias("bg"), F.col("bg_mx_all").alias("bga"),
        F.struct(*seeds, "ir0").alias("seed"),
        *([F.struct(*own_cols).alias("own")] if own_cols else []),
    )
    by_year = cells.groupBy(*held, "_t").agg(F.collect_list(cell).alias("rows"))
    # One slot per part in a fixed order; a missing part is a NULL slot.
    n = len(parts)
    by_year = by_year.withColumn("rows", F.sort_array("rows"))
    full = reduce(lambda x, y: x & y, [F.size("rows") == n, *[F.get(F.col("rows"), F.lit(i))["p"] == i + 1 for i in range(n)]])
    repeated = F.size(F.array_distinct(F.col("rows.p"))) < F.size("rows")
    by_year = by_year.filter(F.when(full, F.lit(True)).when(repeated, duplicate_error([*keys, "_b", "_t"])).otherwise(F.lit(True)))
    slots = F.when(full, F.col("rows")).otherwise(
        F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.get(F.filter("rows", lambda x: x["p"] == i), F.lit(0)))
    )
    by_year = by_year.withColumn("rows", slots)
    cohorts = by_year.groupBy(*held).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_t").alias("t"), "rows"))).alias("s")
    )
    first = F.get(F.col("s"), F.lit(0))["t"]
    cohorts = cohorts.filter((first == first_t) | (first == F.col("_b") + lo))

    factor = {}
    for name, (numbers, which, step_size) in grid.items():
        cohorts = cohorts.withColumn(name, F.explode(F.sequence(F.lit(numbers.start), F.lit(numbers.stop - 1), F.lit(numbers.step))))
        cohorts = cohorts.withColumn(f"_f_{which}", F.lit(1.0) + F.col(name) * F.lit(float(step_size)))
        factor[which] = F.col(f"_f_{which}")

    def scale(x: Column, which: str) -> Column:
        return x * factor[which] if which in factor else x

    def rate_of(x: Column, which: str) -> Column:
        return F.least(x[which] * factor[which], F.lit(float(cap))) if which in factor else x[which]

    def seed(row: Column) -> Column:
        x = row["seed"]
        well = x["nx"] * (F.lit(1.0) - (x["prev_rate"] + x["all_mx"]))
        new = well * scale(x["ir0"], "ir")
        return F.when(x["nx"].isNotNull() & x["prev_rate"].isNotNull() & x["all_mx"].isNotNull() & x["ir0"].isNotNull(), F.struct(
            well.alias("well"), new.alias("newcases"), (x["nx"] * x["prev_rate"]).alias("sick"), (x["nx"] * x["dis_mx"]).alias("dead"),
            x["nx"].alias("pop"), (x["nx"] * x["all_mx"]).alias("all_dead"),
        ))

    def one_step(prev: Column, rows: Column) -> Column:
        def deaths_of(s: Column, x: Column) -> Column:
            return s["sick"] * rate_of(x, "cf")
        def close(deaths: Column) -> Column:
            def part_step(s: Column, x: Column) -> Column:
                ir, cf = rate_of(x, "ir"), rate_of(x, "cf")
                def finish(pop: Column, sick: Column, all_dead: Column) -> Column:
                    return F.struct(
                        floor0(pop - all_dead - sick).alias("well"), floor0(s["well"] * ir).alias("newcases"), sick.alias("sick"),
                        (s["sick"] * cf).alias("dead"), pop.alias("pop"), all_dead.alias("all_dead"))
                moved = bind(floor0(s["pop"] - s["all_dead"]), lambda pop: bind(
                    floor0(s["sick"] * (F.lit(1.0) - (cf + x["bg"])) + s["well"] * ir), lambda sick: bind(
                        floor0(deaths + pop * x["bga"]), lambda all_dead: finish(pop, sick, all_dead))))
                return F.when(s.isNotNull() & x["cf"].isNotNull(), moved)
            return F.zip_with(prev, rows, part_step)
        return F.aggregate(
            F.zip_with(prev, rows, deaths_of), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)), close)

    # The cast makes the type of the history nullable: a gap adds a NULL.
    state_type = "struct<" + ",".join(f"{c}:double" for c in STATES) + ">"
    start = bind(
        F.get(F.col("s"), F.lit(0)), lambda s: F.array(F.struct(s["t"].alias("t"), F.transform(s["rows"], seed).alias("v")))
    ).cast(f"array<struct<t:int,v:array<{state_type}>>>")

    def fold(out: Column, s: Column) -> Column:
        def grow(p: Column) -> Column:
            return F.when(s["t"] == p["t"] + 1, F.struct(s["t"].alias("t"), one_step(p["v"], s["rows"]).alias("v")))
        return F.array_append(out, bind(F.element_at(out, -1), grow))

    rest = F.slice(F.col("s"), F.lit(2), F.greatest(F.size("s") - 1, F.lit(0)))
    history = F.aggregate(rest, start, fold)
    used = [*keys, *grid, *[f"_f_{w}" for w in factor], "_b"]
    if own_cols:
        # The steps hold the columns of the cell itself at the same position as the history.
        rolled = cohorts.select(*used, F.explode(F.arrays_zip(history.alias("h"), F.col("s").alias("s"))).alias("_o")).filter(F.col("_o.h").isNotNull())
        cellwise = F.arrays_zip(F.col("_o.h.v").alias("v"), F.col("_o.s.rows").alias("r"))
        rolled = rolled.select(*used, F.col("_o.h.t").alias("_t"), F.posexplode(cellwise).alias("_i", "_z"))
        state = "_z.v"
        extra = [F.least(scale(F.col(f"_z.r.own.{c}0"), c), F.lit(float(cap))).alias(c) for c in ("ir", "cf") if with_rates]
        extra += [F.col(f"_z.r.own._c_{c}").alias(c) for c in carry]
    else:
        rolled = cohorts.select(*used, F.explode(history).alias("_h")).filter(F.col("_h").isNotNull())
        rolled = rolled.select(*used, F.col("_h.t").alias("_t"), F.posexplode("_h.v").alias("_i", "_z"))
        state, extra = "_z", []
    names = F.array(*[F.lit(p) for p in parts])
    return rolled.filter(F.col(state).isNotNull()).select(
        *keys, *grid, F.get(names, F.col("_i")).alias(part),
        (F.col("_t") - F.col("_b")).cast("int").alias(axis), F.col("_t").alias(t),
        *[F.col(f"{state}.{c}").alias(c) for c in STATES],
        *extra,
    )
