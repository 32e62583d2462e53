"""Reading the driver tables and turning them into panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.operators.joins import gather, tasks, with_axes

AGES = range(1, 51)
YEARS = range(1995, 2002)
SEXES = ["F", "O"]
CAUSES = ["A", "N", "R"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def year_of(c: str):
    return F.year(c).cast("int")


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as panel facts: supplier, status, flag, quantity as age, ship year."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("location"),
        F.col("l_linestatus").alias("sex"),
        F.col("l_returnflag").alias("cause"),
        F.col("l_quantity").cast("int").alias("age"),
        year_of("l_shipdate").alias("year"),
        F.col("l_linenumber").alias("code"),
        F.col("l_extendedprice").alias("value"),
        (F.abs("l_discount")).alias("discount"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per cause for every (location, sex, age, year), zero where empty.

    The suppliers are a small table, often one file, and their grid is not: a supplier goes into the shuffle with the
    range of its ages, and the range is repeated to cells in the tasks that count. One shuffle both counts and completes.
    """
    age = F.col("age")
    facts = line_facts(spark, sf_dir).select("location", "sex", "year", "cause", age.alias("_from"), age.alias("_to"))
    grid = with_axes(
        table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("location")), {"sex": SEXES, "year": YEARS},
    ).select("*", F.lit(None).cast("string").alias("cause"), F.lit(AGES.start).alias("_from"), F.lit(AGES.stop - 1).alias("_to"))
    held = ["location", "sex", "year"]
    rows = facts.unionByName(grid).repartition(tasks(facts), *held)
    rows = rows.select(*held, "cause", F.explode_outer(F.sequence("_from", "_to")).alias("age"))
    return rows.groupBy("location", "sex", "age", "year").agg(
        *[F.count(F.when(F.col("cause") == c, 1)).alias(f"n_{c.lower()}") for c in CAUSES]
    )


def gathered_cells(spark: SparkSession, sf_dir: str, times: int = 1) -> DataFrame:
    """The cells of a supplier in one task, while they are still one row with three counts each."""
    return gather(cells(spark, sf_dir), ["location"], times)


def cause_rows(wide: DataFrame) -> DataFrame:
    """Cells to one row per cause, with the total over causes alongside."""
    total = F.col("n_a") + F.col("n_n") + F.col("n_r")
    rows = F.array(*[F.struct(F.lit(c).alias("cause"), F.col(f"n_{c.lower()}").alias("n")) for c in CAUSES])
    return wide.select("location", "sex", "age", "year", total.alias("tot"), F.explode(rows).alias("_r")).select(
        "location", "sex", "age", "year", F.col("_r.cause").alias("cause"), F.col("_r.n").alias("n"), "tot"
    )


def rate_panel(spark: SparkSession, sf_dir: str, counted: DataFrame | None = None) -> DataFrame:
    """Rates of the coupled roll-forward, from the shares of the counts."""
    n, tot = F.col("n").cast("double"), F.col("tot").cast("double")
    share = (n + 1.0) / (tot + 3.0)
    return cause_rows(cells(spark, sf_dir) if counted is None else counted).select(
        "location", "sex", "age", "year", "cause",
        ((F.lit(100.0) + F.lit(10.0) * tot) / 7.3).alias("nx"),
        (share * 0.1).alias("prev_rate"),
        (share * 0.01).alias("dis_mx"),
        F.lit(0.02).alias("all_mx"),
        (F.lit(0.02) - share * 0.01).alias("bg_mx"),
        (F.lit(0.02) - share * 0.01).alias("bg_mx_all"),
        (share * 0.05).alias("ir"),
        ((n + 2.0) / (tot + 4.0) * 0.1).alias("cf"),
    )


def status_panel(spark: SparkSession, sf_dir: str, counted: DataFrame | None = None) -> DataFrame:
    """Never / current / ex shares (sum 100) with yearly rates."""
    tot = (F.col("n_a") + F.col("n_n") + F.col("n_r") + 3).cast("double")
    return (cells(spark, sf_dir) if counted is None else counted).select(
        "location", "sex", "age", "year",
        *[((F.col(c) + 1) * 100.0 / tot).alias(s) for c, s in (("n_a", "never"), ("n_n", "current"), ("n_r", "ex"))],
        ((F.col("n_n") + 1) * 0.2 / tot).alias("init"),
        ((F.col("n_r") + 1) * 0.3 / tot).alias("cess"),
    )
