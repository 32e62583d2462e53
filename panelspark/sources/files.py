"""CSV and parquet tables in and out."""

from __future__ import annotations

import csv
from collections.abc import Collection
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from panelspark.functions.scalars import no_nan, recode
from panelspark.sources.schemas import COSTS, Spec


class Rejects:
    """Counts of texts that are not of their column's declared type, taken while the tables are read for a write.

    Give it to the reads and to ``stored`` or ``write_table``; the write raises when one of the reads rejected a text. The table is
    written by then and holds NULL in place of each rejected text.
    """

    def __init__(self) -> None:
        self._watched: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, source: str, wrong: dict[str, Column]) -> DataFrame:
        """The same rows; what ``wrong`` holds for is counted by column."""
        if not wrong:
            return df
        seen = Observation()
        self._watched.append((source, seen))
        counts = [F.count(F.when(c, F.lit(1))).alias(name) for name, c in wrong.items()]
        return df.observe(seen, *counts)

    def found(self) -> dict[tuple[str, str], int]:
        """Rejected texts by (source, column) of the reads so far; they are taken off the list."""
        watched, self._watched = self._watched, []
        return {(source, name): n for source, seen in watched for name, n in seen.get.items() if n}

    def check(self) -> None:
        found = self.found()
        if found:
            raise ValueError("rejected values: " + "; ".join(f"{source}, column {name}: {n}" for (source, name), n in found.items()))


def typed(df: DataFrame, spec: Spec, optional: Collection[str] = (), rejects: Rejects | None = None, source: str = "table") -> DataFrame:
    """Pick, rename and cast declared columns; other columns (such as row numbers) are dropped.

    A column named in ``optional`` is NULL where the input lacks it; any other missing one raises. NaN becomes NULL. A text
    that is no number becomes NULL; with ``rejects`` it is counted.
    """
    missing = [h for name, (h, _) in spec.items() if h not in df.columns and name not in optional]
    if missing:
        raise ValueError(f"columns missing in the input: {missing} ({source})")
    cols, wrong = [], {}
    for name, (header, kind) in spec.items():
        if header not in df.columns:
            cols.append(F.lit(None).cast(kind).alias(name))
            continue
        raw = F.col(f"`{header}`")
        c = raw.try_cast(kind)
        cols.append((no_nan(c) if kind == "double" else c).alias(name))
        if kind != "string":
            wrong[name] = raw.isNotNull() & c.isNull()
    return (df if rejects is None else rejects.watch(df, source, wrong)).select(*cols)


def headers(spark: SparkSession, paths: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of the paths by their header row.

    Only the first lines are read, through the file system that Spark itself uses; what reaches the driver is one header
    per file. Empty files have no rows and are left out.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def head(uri: str) -> tuple[tuple[str, ...] | None, str]:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
        stream = path.getFileSystem(conf).open(path)
        codec = codecs.getCodec(path)
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        text = lines.readLine()
        while text is not None and text.count('"') % 2:  # a line break inside quotes
            more = lines.readLine()
            if more is None:
                break
            text += "\n" + more
        lines.close()
        return (None if text is None else tuple(next(csv.reader([text.lstrip("\ufeff")], strict=True), ()))), path.toString()
    out: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(16) as pool:
        for found, path in pool.map(head, sorted(spark.read.text(paths).inputFiles())):
            if found is not None:
                out.setdefault(found, []).append(path)
    return out


def read_csv(
    spark: SparkSession, paths: str | list[str], spec: Spec, multi_line: bool = False, optional: Collection[str] = (), rejects: Rejects | None = None,
) -> DataFrame:
    """One CSV table from one or many files, stacked by column name.

    Files may order their columns differently: there is one read per distinct header, and the reads are united by name.
    ``multi_line`` allows line breaks inside quotes, at the price of reading each
    file in one task; leave it off for large files.
    """
    parts = []
    for header, files in headers(spark, paths).items():
        names = [h if h and header.count(h) == 1 else f"{h}_c{i}" for i, h in enumerate(header)]
        layout = T.StructType([T.StructField(n, T.StringType()) for n in names])
        raw = spark.read.schema(layout).csv(files, header=True, multiLine=multi_line, escape='"', nullValue="NA", mode="FAILFAST", enforceSchema=True)
        source = files[0] if len(files) == 1 else f"{files[0]} and {len(files) - 1} more"
        parts.append(typed(raw, spec, optional, rejects, source))
    if not parts:
        raise ValueError(f"no header row in {paths}")
    return reduce(lambda x, y: x.unionByName(y), parts)


def read_sheet_csv(spark: SparkSession, path: str, first_header: str, keep: dict[str, str]) -> DataFrame:
    """A wide sheet exported as CSV, with lines of text before the header row.

    The header is the row whose first cell is ``first_header``; data rows have a
    number there. ``keep`` maps headers to names; year columns become 'y<year>'.
    """
    line = spark.read.text(path).filter(F.col("value").startswith(first_header + ",") | F.col("value").startswith(f'"{first_header}",')).first()
    if line is None:
        raise ValueError(f"no header row starting with {first_header}")
    head = next(csv.reader([line.value]))
    # The lines of text may have fewer cells, so the width comes from the header.
    layout = ", ".join(f"_c{i} string" for i in range(len(head)))
    raw = spark.read.schema(layout).csv(path, header=False, escape='"', nullValue="NA")
    cols = []
    for place, title in zip(raw.columns, head):
        if title in keep:
            cols.append(F.col(place).alias(keep[title]))
        elif title.replace(".0", "").isdigit():
            cols.append(F.col(place).alias("y" + title.replace(".0", "")))
    return raw.filter(F.col("_c0").try_cast("double").isNotNull()).select(*cols)


def read_costs(spark: SparkSession, default_path: str, user_path: str | None = None, rejects: Rejects | None = None) -> DataFrame:
    """The user's cost table if there is one, else the default."""
    return read_csv(spark, user_path or default_path, COSTS, multi_line=True, rejects=rejects)


def clean_population(df: DataFrame) -> DataFrame:
    """Single-age population: text ages to numbers, sex labels, no totals."""
    age = recode("age", {"<1 year": "0", "95 plus": "95"}).try_cast("int")
    return df.filter(~F.col("sex").isin("both", "Both")).withColumns(
        {"age": age, "sex": recode("sex", {"male": "Male", "female": "Female"})}).filter(F.col("age").isNotNull())


def with_location_code(df: DataFrame, dimension: DataFrame, on: str = "location") -> DataFrame:
    """Attach the code of a location from a dimension table; NULL where unknown."""
    return df.join(dimension, on, "left")


def inline_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def number_range(spark: SparkSession, first: int, last: int, name: str) -> DataFrame:
    """Whole numbers first..last as a table."""
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias(name))


def dealt(df: DataFrame, by: list[str], files: int = 8) -> DataFrame:
    """Rows distributed by the columns of a partitioned table and a salt: at most ``files`` files per value, and a value
    with most of the rows is still written by that many tasks."""
    return df.repartition(*by, F.pmod(F.xxhash64(*df.columns), F.lit(files)))


def stored(df: DataFrame, path: str, rejects: Rejects | None = None) -> DataFrame:
    """Write a table and read it back: computed once, and the plans that follow start from the files."""
    write_table(df, path, rejects=rejects)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, rejects: Rejects | None = None) -> None:
    """Write a result, replacing an earlier one; no row numbers. Raises if the reads of ``rejects`` met a malformed value."""
    w = (dealt(df, partition_by) if partition_by else df).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path, header=True) if fmt == "csv" else w.parquet(path)
    if rejects is not None:
        rejects.check()


def replace_scenarios(df: DataFrame, path: str, scenario: str = "scenario") -> None:
    """Replace only the scenarios present in ``df`` in a table partitioned by scenario."""
    dealt(df, [scenario]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scenario).parquet(path)
