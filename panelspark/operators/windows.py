"""Ordered operators: previous row, running total, group totals, argmin.

A series is usually short (one row per year), and then a plain window is right.
With ``block`` the order axis is cut into blocks: every block is a window of its
own, and the blocks of a series are linked through one summary row each. A series
that holds a third of all rows is then spread over as many tasks as it has blocks.

``block`` is a column that grows with the order (such as the day), or BALANCED:
then quantiles of the first order column limit the blocks, so blocks have about the
same size whatever the data look like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BALANCED = "balanced"


def balanced_blocks(df: DataFrame, keys: list[str], order: list[str], name: str = "block", blocks: int | None = None) -> DataFrame:
    """The rows with the number of their range of the first order column, all ranges about equal.

    The limits are quantiles: one small aggregate runs now and gives as many values as
    blocks, which stand in the plan as literals. Give the column to ``block`` to share it.
    """
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(order[0], [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0] or []
    if not cuts:
        return df.withColumn(name, F.lit(0))
    limits = F.array(*[F.lit(c) for c in sorted(set(cuts))])
    return df.withColumn(name, F.size(F.filter(limits, lambda c: c <= F.col(order[0]))))


def _blocked(
    df: DataFrame, keys: list[str], order: list[str], block: Column | str, aggs: list[Column]
) -> tuple[DataFrame, DataFrame]:
    if isinstance(block, str) and block == BALANCED:
        tagged = balanced_blocks(df, keys, order, "_block")
    else:
        tagged = df.withColumn("_block", block)
    return tagged, tagged.groupBy(*keys, "_block").agg(*aggs)


def _link(tagged: DataFrame, summary: DataFrame, keys: list[str], carry: list[Column]) -> DataFrame:
    linked = summary.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_k_block"), *carry
    )
    on = F.col("_block").eqNullSafe(F.col("_k_block"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return tagged.join(linked, on, "left").drop("_k_block", *[f"_k_{k}" for k in keys])


def previous(
    df: DataFrame, keys: list[str], order: list[str], cols: list[str], block: Column | str | None = None, prefix: str = "prev_"
) -> DataFrame:
    """Value of the row before, per key, in the named order."""
    if block is None:
        w = W.partitionBy(*keys).orderBy(*order)
        return df.withColumns({prefix + c: F.lag(c).over(w) for c in cols})
    place = F.struct(*order)
    tagged, summary = _blocked(df, keys, order, block, [F.max_by(F.struct(*cols), place).alias("_last")])
    across = W.partitionBy(*keys).orderBy("_block")
    linked = _link(tagged, summary.withColumn("_in", F.lag("_last").over(across)), keys, [F.col("_in")])
    w = W.partitionBy(*keys, "_block").orderBy(*order)
    linked = linked.withColumn("_first", F.row_number().over(w) == 1)
    return linked.withColumns(
        {prefix + c: F.when(F.col("_first"), F.col(f"_in.{c}")).otherwise(F.lag(c).over(w)) for c in cols}
    ).drop("_block", "_in", "_first")


def running_total(
    df: DataFrame, keys: list[str], order: list[str], cols: list[str], block: Column | str | None = None, prefix: str = "cum_"
) -> DataFrame:
    """Sum of all rows up to this one, per key, in the named order (which must be total)."""
    if block is None:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumns({prefix + c: F.sum(c).over(w) for c in cols})
    tagged, summary = _blocked(df, keys, order, block, [F.sum(c).alias(f"_s_{c}") for c in cols])
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    summary = summary.withColumns({f"_b_{c}": F.sum(f"_s_{c}").over(before) for c in cols})
    linked = _link(tagged, summary, keys, [F.col(f"_b_{c}") for c in cols])
    w = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = {
        prefix + c: F.when(
            F.sum(c).over(w).isNotNull() | F.col(f"_b_{c}").isNotNull(),
            F.coalesce(F.col(f"_b_{c}"), F.lit(0)) + F.coalesce(F.sum(c).over(w), F.lit(0)),
        )
        for c in cols
    }
    return linked.withColumns(sums).drop("_block", *[f"_b_{c}" for c in cols])


def with_group_aggs(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Group aggregates attached to every row of the group.

    Aggregated with map-side partial sums and joined back, so a hot group never
    sits in one task: the join side with the rows can be split, the other has one
    row per group.
    """
    totals = df.groupBy(*[F.col(k).alias(f"_g_{k}") for k in keys]).agg(*[e.alias(n) for n, e in aggs.items()])
    on = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"_g_{k}"))
        on = e if on is None else on & e
    return df.join(totals, on, "left").drop(*[f"_g_{k}" for k in keys])


def best_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key by ``order``; NULL in the first order column never wins.

    ``min_by`` keeps one row per key before the shuffle; no window, no sort. End
    ``order`` with columns that make it total, so that ties have one answer.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = (
        df.filter(F.col(order[0]).isNotNull() & ~F.isnan(F.col(order[0]).cast("double")))
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    )
    return picked.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])
