"""Cohort and band joins, grid completion, scenario replacement.

There is no cross join here: short literal lists and integer ranges are exploded
on the rows that need them. A side is broadcast by hint only where its keys are
limited to listed values (``bounded``); elsewhere Spark decides by measured size.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.functions.scalars import civil_micros


def tasks(df: DataFrame) -> int:
    """A number of partitions given outright, which Spark does not merge although the rows are few."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def gather(df: DataFrame, cols: list[str], times: int = 1) -> DataFrame:
    """The rows of each value of ``cols`` in one task, before they are repeated for parts, scenarios or roles.

    Whatever groups, folds or orders by these and more columns afterwards finds its rows in place and shuffles nothing. ``times`` is
    how often the rows will be repeated: there are so many more partitions, and a task holds no more than it would after a later shuffle.
    """
    return df.repartition(tasks(df) * times, *cols)


def look_up(x: DataFrame, y: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """``x`` with the columns of ``y`` for the same keys: a left join made of a union and a window over the keys.

    If both come from one ``gather`` by some of the keys, nothing is shuffled; a join would shuffle both sides by all of its keys.
    ``y`` has one row per key; a second one raises. NULL keys meet nothing.
    """
    kinds = {c: x.schema[c].dataType for c in x.columns}
    rest = [c for c in x.columns if c not in keys]
    held = y.select(F.struct(*cols).alias("_y")).schema["_y"].dataType
    both = x.select(*keys, *rest, F.lit(None).cast(held).alias("_y")).union(
        y.select(*keys, *[F.lit(None).cast(kinds[c]).alias(c) for c in rest], F.struct(*cols).alias("_y")))
    w = W.partitionBy(*keys)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    both = both.withColumns({"_in": F.first("_y", ignorenulls=True).over(w), "_n": F.count("_y").over(w)}).filter(F.col("_y").isNull())
    both = both.filter(F.when(known & (F.col("_n") > 1), duplicate_error(keys)).otherwise(F.lit(True)))
    return both.select(
        *[F.col(c).cast(kinds[c]).alias(c) for c in x.columns], *[F.when(known, F.col(f"_in.{c}")).alias(c) for c in cols])


def scattered(df: DataFrame) -> DataFrame:
    """The same rows, about whose place Spark knows nothing any more (columns of a generator have no history).

    After ``gather`` a result lies in many small partitions. The next aggregation then sends one partial row per key and task
    through a shuffle, whose partitions Spark merges to a few.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def with_values(df: DataFrame, name: str, values: list | range) -> DataFrame:
    """Repeat every row for each literal value (Cartesian product with a short list)."""
    if isinstance(values, range) and values.step == 1:
        items = F.sequence(F.lit(values.start), F.lit(values.stop - 1))
    else:
        items = F.array(*[F.lit(v) for v in values])
    return df.withColumn(name, F.explode(items))


def with_axes(df: DataFrame, axes: dict[str, list | range]) -> DataFrame:
    return reduce(lambda d, item: with_values(d, item[0], item[1]), axes.items(), df)


BROADCAST_BYTES = 100 << 20


def bounded(
    df: DataFrame, domains: dict[str, list | range], limit: int = BROADCAST_BYTES
) -> DataFrame:
    """A table with one row per key whose key columns take listed values only.

    Its size has a proven bound, the product of the lists times the width of a row; up
    to ``limit`` bytes it is marked for broadcast, beyond that it is left to the usual
    joins. A row with a key that is not listed raises: select rows before, visibly.
    """
    rows = 1
    for name, values in domains.items():
        listed = F.col(name).between(values.start, values.stop - 1) if isinstance(values, range) else F.col(name).isin(list(values))
        text = F.concat(F.lit(f"{name} is not listed: "), F.coalesce(F.col(name).cast("string"), F.lit("NULL")))
        df = df.filter(F.when(listed, F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))
        rows *= len(values)
    width = sum(40 if kind == "string" else 8 for _, kind in df.dtypes) + 16
    return F.broadcast(df) if rows * width <= limit else df


def null_safe_join(x: DataFrame, y: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join in which NULL keys meet; the keys of ``x`` stay."""
    other = y.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return x.join(other, on, how).drop(*[f"_k_{k}" for k in keys])


def left_join(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on written-out keys."""
    return x.join(y, keys, "left")


def cohort_join(
    df: DataFrame,
    keys: list[str],
    axis: str,
    t: str,
    gap: int,
    cols: list[str],
    axis_gap: int | None = None,
    suffix: str = "_later",
    how: str = "inner",
) -> DataFrame:
    """Pair the row at (axis, t) with the row at (axis + axis_gap, t + gap).

    Both rows lie on one birth diagonal, so a window over the diagonal finds the
    partner: one shuffle, no self-join. A diagonal holds at most one row per time;
    a second one raises.
    """
    step = gap if axis_gap is None else axis_gap
    diagonal = F.col(t) * F.lit(step) - F.col(axis) * F.lit(gap)
    w = W.partitionBy(*keys, "_diag").orderBy(F.col(t).cast("int")).rangeBetween(gap, gap)
    one = F.when(F.count(F.lit(1)).over(w) <= 1, F.lit(True)).otherwise(duplicate_error([*keys, axis, t]))
    later = F.when(one, F.first(F.struct(F.lit(True).alias("hit"), *cols)).over(w))
    out = df.withColumn("_diag", diagonal).withColumn("_later", later)
    if how == "inner":
        out = out.filter(F.col("_later").isNotNull())
    for c in cols:
        out = out.withColumn(c + suffix, F.col(f"_later.{c}"))
    return out.drop("_diag", "_later")


def band_join(
    df: DataFrame,
    axis: str,
    bands: DataFrame,
    start: str = "start",
    stop: str = "stop",
    on: list[str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join rows to every band with start <= axis <= stop, as an equi-join.

    The bands are a dimension of whole-number ranges: each is spread over its
    ages once, so the fact rows are looked up by key instead of compared.
    """
    spread = bands.withColumn(axis, F.explode(F.sequence(F.col(start).cast("int"), F.col(stop).cast("int"))))
    return df.join(spread, [*(on or []), axis], how)


def _whole(c: Column, kind: str, resolution: float) -> Column:
    """An axis value as a whole number that never decreases with it; NULL for NaN."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.least(c.cast("long"), F.lit((1 << 63) - 2))
    if kind == "date":
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    if kind.startswith("timestamp"):
        return civil_micros(c) if kind == "timestamp_ntz" else F.unix_micros(c)
    c = c.cast("double") * F.lit(float(resolution))
    edge = F.lit(float(1 << 62))
    return F.when(~F.isnan(c), F.floor(F.greatest(F.least(c, edge), -edge)).cast("long"))


def interval_nodes(start: Column, stop: Column, bits: int) -> Column:
    """The whole numbers start..stop as an array of nodes (level, number): node n of a level covers the numbers whose leading bits,
    after ``bits`` times level are cut off, are n.

    On each level these are the nodes inside the range whose parent is not; a range of length n has O(log n) of them.
    """
    levels = -(-64 // bits)
    none = F.array().cast("array<struct<level:int,node:bigint>>")

    def cut(c: Column, level: Column) -> Column:
        return F.call_function("shiftright", c, level * bits)

    def first(level: Column) -> Column:  # the first node that begins inside
        whole = F.call_function("shiftleft", cut(start, level), level * bits)
        return cut(start, level) + F.when(whole != start, F.lit(1)).otherwise(F.lit(0))

    def run(level: Column, a: Column, b: Column) -> Column:
        nodes = F.transform(F.sequence(a, b - 1), lambda n: F.struct(level.alias("level"), n.alias("node")))
        return F.when(a < b, nodes).otherwise(none)

    def at(level: Column) -> Column:
        a, b = first(level), cut(stop + 1, level)  # from a to before b lie inside
        below_top = level < levels - 1
        pa, pb = first(level + 1), cut(stop + 1, level + 1)
        sides = F.concat(run(level, a, F.call_function("shiftleft", pa, F.lit(bits))), run(level, F.call_function("shiftleft", pb, F.lit(bits)), b))
        return F.when(below_top & (pa < pb), sides).otherwise(run(level, a, b))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), at))


def interval_join(
    df: DataFrame, axis: str, intervals: DataFrame, start: str, stop: str, on: list[str] | None = None, bits: int = 3,
    resolution: float = 1.0,
) -> DataFrame:
    """Rows with every interval that holds them, start <= axis <= stop, as an equi-join; for wide or real-valued ranges.

    An interval is spread over O(log of its length) nodes of a tree of the number line, a row over its ancestors on those levels that
    some interval uses (a list of at most 64 / ``bits`` numbers, found first). Axis, start and stop are of one kind:
    whole numbers, dates, timestamps, or real numbers, which meet in units of 1 / ``resolution`` and are then compared exactly.
    NULL and NaN meet nothing; an interval with stop < start holds nothing.
    """
    on = on or []
    kind = df.schema[axis].dataType.simpleString()
    nodes = F.inline(interval_nodes(F.col("_start"), F.col("_stop"), bits)).alias("_level", "_node")
    spread = intervals.withColumns({"_start": _whole(F.col(start), kind, resolution), "_stop": _whole(F.col(stop), kind, resolution)})
    spread = spread.filter("_start <= _stop").select(*intervals.columns, nodes)
    levels = sorted(r[0] for r in spread.select("_level").distinct().collect())  # at most 64 / bits numbers
    place = _whole(F.col(axis), kind, resolution)
    own = F.array(*[F.struct(F.lit(v).alias("_level"), F.shiftright(F.col("_place"), bits * v).alias("_node")) for v in levels])
    if not levels:
        own = F.array().cast("array<struct<_level:int,_node:bigint>>")
    rows = df.withColumn("_place", place).filter(F.col("_place").isNotNull()).select(*df.columns, F.inline(own))
    out = rows.join(spread, [*on, "_level", "_node"]).drop("_level", "_node")
    return out.filter((F.col(start) <= F.col(axis)) & (F.col(axis) <= F.col(stop)))


def grid_of(entities: DataFrame, keys: list[str], axes: dict[str, list | range]) -> DataFrame:
    """Every combination of the distinct entities with the axis values."""
    return with_axes(entities.select(*keys).distinct(), axes)


WORD, GRID_CELLS, COMPLETED_CELLS = 64, 4096, 1024  # bits of a bitmap word; cells held as words in audits and in completion


def cell_number(axes: dict[str, list | range]) -> Column:
    """The place of a row in the grid of the axes, counted from 0; NULL outside."""
    place = F.lit(0)
    for name, values in axes.items():
        c = F.col(name)
        if isinstance(values, range) and values.step == 1:
            at = F.when(c.between(values.start, values.stop - 1), (c - values.start).cast("int"))
        else:
            at = F.array_position(F.array(*[F.lit(v) for v in values]), c).cast("int") - 1
            at = F.when(at >= 0, at)
        place = place * len(values) + at
    return place


def cell_values(place: Column, axes: dict[str, list | range]) -> dict[str, Column]:
    """The axis values at a place of the grid."""
    out, below = {}, 1
    for name, values in reversed(list(axes.items())):
        at = F.pmod(F.floor(place / below).cast("int"), F.lit(len(values)))
        listed = isinstance(values, range) and values.step == 1
        out[name] = at + values.start if listed else F.get(F.array(*[F.lit(v) for v in values]), at)
        below *= len(values)
    return {name: out[name] for name in axes}


def grid_size(axes: dict[str, list | range]) -> int:
    return reduce(lambda n, values: n * len(values), axes.values(), 1)


def cell_bits(place: Column, size: int, name: str = "_bits") -> list[Column]:
    """Aggregates: the cells present, as words of 64 bits. They combine before the shuffle: one row per key and task."""
    def word(w: int) -> Column:
        hit = F.when((place >= w * WORD) & (place < (w + 1) * WORD), F.call_function("shiftleft", F.lit(1).cast("long"), place - w * WORD))
        return F.coalesce(F.bit_or(hit), F.lit(0).cast("long")).alias(f"{name}{w}")
    return [word(w) for w in range(-(-size // WORD))]


def cells_where(size: int, bit: Callable[[Column], Column], names: list[str]) -> Column:
    """The places 0..size-1 whose combined bit is 1. ``bit`` combines words (one per name) to a word."""
    words = -(-size // WORD)
    whole = F.array(*[bit(*[F.col(f"{n}{w}") for n in names]) for w in range(words)])
    def one(p: Column) -> Column:
        word = F.get(whole, F.floor(p / WORD).cast("int"))
        return F.call_function("shiftright", word, (p % WORD).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return F.filter(F.sequence(F.lit(0), F.lit(size - 1)), one)


def complete_grid(
    df: DataFrame,
    keys: list[str],
    axes: dict[str, list | range],
    cols: list[str],
    entities: DataFrame | None = None,
    fill: float | None = 0.0,
) -> DataFrame:
    """One row per (entity, axis values); cells without data get ``fill``.

    Each row goes in twice, as itself and as a bit of its entity's bitmap of present cells, and both are aggregated in the same
    pass: one scan and one shuffle, in which an entity's bits are combined to one row per task. The complement of the bitmap
    gives the missing cells. With an entity table its entities get the whole grid and others keep their rows. A repeated cell raises;
    rows outside the axes stay as they are. Grids of more than 1,024 cells are completed by an anti join of all cells.
    """
    cell, size = [*keys, *axes], grid_size(axes)
    kinds = {c: df.schema[c].dataType for c in [*axes, *cols]}
    if size > COMPLETED_CELLS:
        own = require_unique(df.select(*cell, *cols), cell)
        grid = grid_of(entities if entities is not None else df, keys, axes)
        blank = grid.select(*keys, *[F.col(a).cast(kinds[a]).alias(a) for a in axes])
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in cell])
        blank = blank.join(df.select(*[F.col(k).alias(f"_k_{k}") for k in cell]), same, "left_anti")
        out = own.unionByName(blank.select(*cell, *[F.lit(None).cast(kinds[c]).alias(c) for c in cols]))
    else:
        empty = [F.lit(None).cast(kinds[c]).alias(c) for c in [*axes, *cols]]
        itself = F.struct(*axes, *cols, F.lit(0).alias("_bit"), F.lit(None).cast("int").alias("_place"), F.lit(False).alias("_whole"))
        bit = F.struct(*empty, F.lit(1).alias("_bit"), cell_number(axes).alias("_place"), F.lit(entities is None).alias("_whole"))
        rows = df.select(*keys, F.inline(F.array(itself, bit)))
        if entities is not None:
            rows = rows.union(entities.select(*keys, *empty, F.lit(1), F.lit(None).cast("int"), F.lit(True)))
        sums = rows.groupBy(*cell, "_bit").agg(
            *[F.max(c).alias(c) for c in cols], *cell_bits(F.col("_place"), size), F.count(F.lit(1)).alias("_n"), F.max("_whole").alias("_whole"))
        sums = sums.filter(F.when((F.col("_bit") == 0) & (F.col("_n") > 1), duplicate_error(cell)).otherwise(F.lit(True)))
        def blank_at(p: Column) -> Column:
            places = [v.cast(kinds[a]).alias(a) for a, v in cell_values(p, axes).items()]
            return F.struct(*places, *[F.lit(None).cast(kinds[c]).alias(c) for c in cols])
        missing = F.transform(cells_where(size, F.bitwise_not, ["_bits"]), blank_at)
        kept = F.filter(F.array(F.struct(*axes, *cols)), lambda _: F.col("_bit") == 0)
        out = sums.select(*keys, F.inline(F.when(F.col("_whole"), missing).otherwise(kept)))
    if fill is None:
        return out
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(fill).cast(df.schema[c].dataType)) for c in cols})


def duplicate_error(keys: list[str]) -> Column:
    """An expression that stops the job when it is evaluated."""
    text = [F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys]
    return F.raise_error(F.concat(F.lit("duplicate key: "), F.concat_ws(", ", *text))).cast("boolean")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows; a key that occurs twice raises when the result is used."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest], F.count(F.lit(1)).alias("_n"))
    return out.filter(F.when(F.col("_n") > 1, duplicate_error(keys)).otherwise(F.lit(True))).select(*df.columns)


def pivot_unique(df: DataFrame, keys: list[str], name: str, value: str, values: list) -> DataFrame:
    """Long to wide with named columns; two values for one cell raise.

    ``values`` maps nothing implicitly: a column appears for each listed value.
    """
    aggs, checks = [], []
    for v in values:
        hit = F.when(F.col(name) == F.lit(v), F.col(value))
        aggs.append(F.max(hit).alias(str(v)))
        checks.append(F.count(F.when(F.col(name) == F.lit(v), F.lit(1))))
    worst = F.greatest(*checks, F.lit(0)) if checks else F.lit(0)
    out = df.groupBy(*keys).agg(*aggs, worst.alias("_n"))
    return out.filter(F.when(F.col("_n") > 1, duplicate_error(keys)).otherwise(F.lit(True))).drop("_n")


def unpivot(df: DataFrame, keys: list[str], cols: list[str], name: str, value: str) -> DataFrame:
    """Wide to long."""
    return df.unpivot(keys, cols, name, value)


def semi_filter(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_semi")


def anti_filter(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_anti")


def stack(*frames: DataFrame) -> DataFrame:
    """Union by column name; a column missing on one side is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def upsert_scenarios(results: DataFrame, update: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Replace all rows of the scenarios present in ``update``."""
    kept = results.join(update.select(scenario).distinct(), scenario, "left_anti")
    return stack(kept, update).select(*results.columns)


def select_scenarios(df: DataFrame, selection: DataFrame, on: str = "scenario") -> DataFrame:
    """Rows of the scenarios a selection table names."""
    return df.join(selection.select(on), on, "left_semi")
