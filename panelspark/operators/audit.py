"""Data audits in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from panelspark.operators.joins import GRID_CELLS, cell_bits, cell_number, cell_values, cells_where, grid_size


def null_counts(df: DataFrame) -> DataFrame:
    """One row: rows and missing values (NULL or NaN) per column."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for name, kind in df.dtypes:
        gone = F.col(name).isNull()
        if kind in ("double", "float"):
            gone = gone | F.isnan(name)
        aggs.append(F.count(F.when(gone, 1)).alias(f"missing_{name}"))
    return df.agg(*aggs)


def audit(df: DataFrame, keys: list[str], cols: list[str], expected: int | None = None) -> DataFrame:
    """One row: rows, distinct keys, repeated keys, rows with a missing key or value, missing combinations.

    Rows are first counted per key (with partial sums before the shuffle), so a
    hot key costs one row.
    """
    gone = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in [*keys, *cols]])
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(gone, 1)).alias("_m"))
    out = per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count(F.when(F.col("_n") > 1, 1)).alias("repeated_keys"),
        F.coalesce(F.sum("_m"), F.lit(0)).alias("rows_with_missing"),
    )
    if expected is not None:
        out = out.withColumn("missing_keys", F.lit(expected).cast("long") - F.col("n_keys"))
    return out


def unmatched_keys(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``df`` that do not occur in ``other``."""
    return df.select(*keys).distinct().join(other.select(*keys), keys, "left_anti")


def key_coverage(df: DataFrame, keys: list[str], axes: dict[str, list | range], expected: DataFrame | None = None) -> DataFrame:
    """(keys, axes, finding): the cells that are 'missing' from ``df`` and those that are 'surplus' there.

    Expected are the cells that ``expected`` lists, or without it the whole grid of the axes for each entity of ``df``. Both sides
    become bitmaps per entity, combined before the shuffle: one row per entity and task, however many rows an entity has.
    Cells outside the axes are surplus with NULL axes, one row per entity. Repeated rows count once.
    """
    size = grid_size(axes)
    if size > GRID_CELLS:
        raise ValueError(f"the axes span {size} cells; up to {GRID_CELLS} are held as bitmaps")
    both = df.select(*keys, *axes, F.lit(True).alias("_given"))
    if expected is not None:
        both = both.unionByName(expected.select(*keys, *axes, F.lit(False).alias("_given")))
    place, given = cell_number(axes), F.col("_given")
    bits = both.groupBy(*keys).agg(
        *cell_bits(F.when(given, place), size, "_have"), *cell_bits(F.when(~given, place), size, "_want"),
        F.count(F.when(given & place.isNull(), 1)).alias("_outside"))
    if expected is None:
        bits = bits.withColumns({c: F.lit(-1).cast("long") for c in bits.columns if c.startswith("_want")})

    def found(name: str, places):
        return F.transform(places, lambda p: F.struct(F.lit(name).alias("finding"), p.alias("place")))
    outside = F.when(F.col("_outside") > 0, F.array(F.lit(None).cast("int"))).otherwise(F.array().cast("array<int>"))
    every = F.concat(
        found("missing", cells_where(size, lambda have, want: want.bitwiseAND(F.bitwise_not(have)), ["_have", "_want"])),
        found("surplus", cells_where(size, lambda have, want: have.bitwiseAND(F.bitwise_not(want)), ["_have", "_want"])),
        found("surplus", outside))
    out = bits.select(*keys, F.inline(every))
    kinds = {a: df.schema[a].dataType for a in axes}
    return out.select(*keys, *[v.cast(kinds[a]).alias(a) for a, v in cell_values(F.col("place"), axes).items()], "finding")


def require_coverage(df: DataFrame, keys: list[str], axes: dict[str, list | range], expected: DataFrame | None = None) -> None:
    """Raises if a cell is missing or surplus, and names some."""
    found = key_coverage(df, keys, axes, expected).limit(5).collect()
    if found:
        raise ValueError("cells: " + "; ".join(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in found))


def require_complete(df: DataFrame, cols: list[str]) -> DataFrame:
    """The same rows; a missing value in one of the columns raises when used."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    return df.filter(F.when(bad, F.raise_error(F.lit("missing value in " + ", ".join(cols))).cast("boolean")).otherwise(F.lit(True)))
