"""Shared by the operators of this package: shared folder, tables, text keys."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BLANKS = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors reach.

    Only where that setting is absent and the session is local (tests), a temporary folder is named there first.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write a table into the shared folder and read it: computed once, lineage cut, kept if executors are lost."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. Text of ASCII only takes the faster function."""
    slow = F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(slow)


def key_pair(c: Column) -> list[Column]:
    """128 bits of a string as two longs, h1 and h2."""
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2")]


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; null where the id is."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(remainder(doc_id) == 2, F.lit(False))


def learns(doc_id: str = "doc_id") -> Column:
    return F.coalesce(remainder(doc_id) != 2, F.lit(False))


BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Mark a table for broadcast if its counted rows stay below the limit; otherwise it is joined by a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def folded(docs: DataFrame, *used: str) -> DataFrame:
    """The named columns that an operator works on, and all others in one struct ``row``, so that no name can clash."""
    rest = [c for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(None).cast("int").alias("none")]).alias("row"))


def unfolded(docs: DataFrame, *used: str, results: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``docs`` out of a folded table; one with the name of a result is left out: the result replaces it."""
    return [F.col(c) if c in used else F.col("row").getField(c).alias(c) for c in docs.columns if c not in results]
