"""Linear interpolation on panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.operators.joins import duplicate_error, null_safe_join


def _point(c: str) -> Column:
    """(place, value) of a known point, NULL where the value is missing."""
    return F.when(F.col(c).isNotNull(), F.struct(F.col("_x").alias("x"), F.col(c).cast("double").alias("y")))


def _fill(c: str, before: Column, after: Column, hold_ends: bool) -> Column:
    x = F.col("_x")
    inner = before["y"] + (after["y"] - before["y"]) * (x - before["x"]) / (after["x"] - before["x"])
    filled = F.when(F.col(c).isNotNull(), F.col(c).cast("double")).when(
        before.isNotNull() & after.isNotNull(), inner
    )
    return filled.otherwise(F.coalesce(before["y"], after["y"])) if hold_ends else filled


def gap_fill(
    df: DataFrame,
    keys: list[str],
    x: str,
    cols: list[str],
    hold_ends: bool = False,
    by_value: bool = True,
    block: int | None = None,
) -> DataFrame:
    """Fill missing values between known points on a straight line.

    The place of a point is the value of ``x`` or, with ``by_value=False``, its row
    number in the series. Gaps at the ends stay NULL or, with ``hold_ends``, take
    the nearest known value. A series without two known points is left as it is
    (with ``hold_ends`` one point fills the series).

    ``block`` cuts long series into stretches of that many units of ``x``.
    """
    if block is not None:
        return _gap_fill_blocked(df, keys, x, cols, hold_ends, by_value, block)
    order = W.partitionBy(*keys).orderBy(x)
    past = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    future = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    out = df.withColumn("_x", F.col(x).cast("double") if by_value else F.row_number().over(order).cast("double"))
    out = out.withColumns({f"_p_{c}": F.last(_point(c), ignorenulls=True).over(past) for c in cols})
    out = out.withColumns({f"_n_{c}": F.first(_point(c), ignorenulls=True).over(future) for c in cols})
    out = out.withColumns({c: _fill(c, F.col(f"_p_{c}"), F.col(f"_n_{c}"), hold_ends) for c in cols})
    return out.drop("_x", *[f"_p_{c}" for c in cols], *[f"_n_{c}" for c in cols])


def _gap_fill_blocked(
    df: DataFrame, keys: list[str], x: str, cols: list[str], hold_ends: bool, by_value: bool, block: int
) -> DataFrame:
    tagged = df.withColumn("_block", F.floor(F.col(x).cast("double") / F.lit(float(block))).cast("long"))
    local = W.partitionBy(*keys, "_block").orderBy(x)
    across = W.partitionBy(*keys).orderBy("_block")
    if by_value:
        tagged = tagged.withColumn("_x", F.col(x).cast("double"))
    else:
        sizes = tagged.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_size"))
        before = F.coalesce(F.sum("_size").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        sizes = sizes.withColumn("_before", before).drop("_size")
        tagged = null_safe_join(tagged, sizes, [*keys, "_block"]).withColumn(
            "_x", (F.row_number().over(local) + F.col("_before")).cast("double")
        ).drop("_before")
    ends = tagged.groupBy(*keys, "_block").agg(
        *[F.max(_point(c)).alias(f"_hi_{c}") for c in cols], *[F.min(_point(c)).alias(f"_lo_{c}") for c in cols]
    )
    back = across.rowsBetween(W.unboundedPreceding, -1)
    ahead = across.rowsBetween(1, W.unboundedFollowing)
    ends = ends.select(
        *keys,
        "_block",
        *[F.last(f"_hi_{c}", ignorenulls=True).over(back).alias(f"_in_{c}") for c in cols],
        *[F.first(f"_lo_{c}", ignorenulls=True).over(ahead).alias(f"_out_{c}") for c in cols],
    )
    past = local.rowsBetween(W.unboundedPreceding, W.currentRow)
    future = local.rowsBetween(W.currentRow, W.unboundedFollowing)
    out = null_safe_join(tagged, ends, [*keys, "_block"])
    out = out.withColumns(
        {f"_p_{c}": F.coalesce(F.last(_point(c), ignorenulls=True).over(past), F.col(f"_in_{c}")) for c in cols}
    )
    out = out.withColumns(
        {f"_n_{c}": F.coalesce(F.first(_point(c), ignorenulls=True).over(future), F.col(f"_out_{c}")) for c in cols}
    )
    out = out.withColumns({c: _fill(c, F.col(f"_p_{c}"), F.col(f"_n_{c}"), hold_ends) for c in cols})
    return out.select(*df.columns)


def to_unit_steps(df: DataFrame, keys: list[str], x: str, cols: list[str]) -> DataFrame:
    """Values at irregular points to every whole number between the first and last.

    Each point owns the whole numbers up to the next point, so the rows are made
    where the segment is, without a search. A second point at one place raises; a point
    without a place owns no number.
    """
    seg = df.select(*keys, F.col(x).cast("double").alias("_x0"), *cols)
    w = W.partitionBy(*keys).orderBy("_x0")
    seg = seg.withColumn("_x1", F.lead("_x0").over(w)).withColumns({f"_y1_{c}": F.lead(c).over(w) for c in cols})
    seg = seg.filter(F.when(F.col("_x0") == F.col("_x1"), duplicate_error([*keys, "_x0"])).otherwise(F.lit(True)))
    first = F.ceil("_x0").cast("int")
    last = F.when(F.col("_x1").isNull(), F.floor("_x0")).otherwise(F.ceil("_x1") - 1).cast("int")
    seg = seg.withColumn("_lo", first).withColumn("_hi", last).filter(F.col("_hi") >= F.col("_lo"))
    seg = seg.withColumn(x, F.explode(F.sequence("_lo", "_hi")))
    share = F.when(F.col("_x1").isNull(), F.lit(0.0)).otherwise(
        (F.col(x) - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))
    )
    value = {
        c: F.when(share == 0, F.col(c).cast("double")).otherwise(
            F.col(c) + (F.col(f"_y1_{c}") - F.col(c)) * share
        )
        for c in cols
    }
    return seg.withColumns(value).select(*keys, x, *cols)


def bands_to_single(df: DataFrame, keys: list[str], label: str, axis: str, cols: list[str]) -> DataFrame:
    """Band labels to midpoints, then to single ages."""
    from panelspark.functions.scalars import band_midpoint

    return to_unit_steps(df.withColumn(axis, band_midpoint(label)).select(*keys, axis, *cols), keys, axis, cols)


def prevalence_panel(
    df: DataFrame,
    keys: list[str],
    t: str,
    axis: str,
    shares: list[str],
    rest: str,
    years: range,
    axis_values: range,
    total: float = 100.0,
    start_shares: dict[str, float] | None = None,
) -> DataFrame:
    """Composition for every (key, year, age) from a few survey years and ages.

    Missing years are filled per (key, age), the category ``rest`` is what is left
    of ``total``, the first age may be given, and missing ages are filled per year.
    """
    from panelspark.operators.joins import complete_grid, with_axes

    yearly = complete_grid(df, [*keys, axis], {t: years}, shares, fill=None)
    yearly = gap_fill(yearly, [*keys, axis], t, shares)
    left_over = F.lit(total)
    for s in shares:
        left_over = left_over - F.col(s)
    yearly = yearly.withColumn(rest, left_over)
    cols = [*shares, rest]
    if start_shares is not None:
        first = with_axes(df.select(*keys).distinct(), {t: years}).withColumn(axis, F.lit(axis_values.start))
        first = first.withColumns({c: F.lit(float(start_shares.get(c, 0.0))) for c in cols})
        yearly = yearly.unionByName(first.select(*yearly.columns))
    full = complete_grid(yearly, [*keys, t], {axis: axis_values}, cols, entities=df.select(*keys).distinct().withColumn(
        t, F.explode(F.sequence(F.lit(years.start), F.lit(years.stop - 1)))), fill=None)
    return gap_fill(full, [*keys, t], axis, cols)
