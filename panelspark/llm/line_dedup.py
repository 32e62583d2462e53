"""Line deduplication by levelled sorted runs of line hashes.

A run is a table of distinct line keys (128-bit hash, number of documents, keeper), bucketed by the hash and sorted in
each bucket, so a new batch meets all runs in merge joins that move no row of a run. Batches come in descending order
of doc_id: the batch that brings a key first holds the document that keeps the line. Each new batch is anti-joined with
the runs; keys that none of them has enter its own run with their keeper, the others with their count only. When a
level has ``fanout`` runs, they are compacted to one run of the next level.

Cases: null or empty text is one empty line; a null doc_id is smaller than all ids and all such rows count as one
document; rows with the same doc_id are one document. Further columns pass through.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.llm.common import BLANKS, ascii_lower, folded, key_pair, partitions, saved, scratch, unfolded

RESULTS, LISTED = ("kept", "n_lines", "n_dropped"), 256
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, h1, h2) of every line whose key has at least ``min_chars`` code points."""
    lines = docs.select("doc_id", F.explode(lines_of(F.col("text"))).alias("line")).where(F.char_length("line") >= min_chars)
    keys = lines.select("doc_id", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("doc_id", *key_pair(F.col("key")))


class LineRuns:
    """The levelled index. Runs are bucketed tables in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout, self.buckets = spark, fanout, partitions(spark)
        self.folder, self.levels = scratch(spark, "line-runs"), []

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (df.repartition(self.buckets, *KEY).sortWithinPartitions(*KEY).write.format("parquet")
         .bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.folder}/{name}").saveAsTable(name))
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        # one scan of all files instead of a union of bucketed tables
        rows = self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*[f"{self.folder}/{name}" for name in names])
        return rows.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The keys that no run has."""
        return reduce(lambda df, name: df.join(self.spark.table(name).select(*KEY), KEY, "left_anti"), self.runs(), keys)

    def add(self, hashes: DataFrame) -> None:
        """Add a batch of (doc_id, h1, h2), whose ids are below those of all batches before."""
        once = hashes.groupBy(*KEY, "doc_id").agg(F.lit(1).alias("one"))
        keys = once.groupBy(*KEY).agg(F.count("one").alias("n"), F.max("doc_id").alias("keeper"))
        if self.runs():
            first = self.fresh(keys).select(*KEY, F.lit(True).alias("first"))
            keys = keys.join(first, KEY, "left").select(*KEY, "n", F.when(F.col("first"), F.col("keeper")).alias("keeper"))
        self._put(0, self._write(keys))

    def _put(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._write(self._merged(merged)))
            self._forget(merged)

    def _forget(self, names: list[str]) -> None:
        for name in names:  # the files stay until the shared folder is cleared
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def frequent(self, min_docs: int) -> DataFrame:
        """(h1, h2, keeper) of the keys in at least ``min_docs`` documents; ends the index."""
        if not self.runs():
            return self.spark.createDataFrame([], "h1 long, h2 long, keeper long")
        found = saved(self._merged(self.runs()).where(F.col("n") >= min_docs).select(*KEY, "keeper"), "frequent-lines")
        self._forget(self.runs())
        self.levels = []
        return found


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the columns kept (text), n_lines and n_dropped added.

    Further columns pass through whatever their names; one with the name of a result is replaced. Documents that lose at most LISTED different
    lines carry them as a list; the lines of the others are joined.
    """
    spark = docs.sparkSession
    hashes = saved(line_hashes(docs, min_chars), "line-hashes")
    cuts = hashes.agg(F.percentile_approx("doc_id", [i / batches for i in range(batches - 1, 0, -1)], 1000)).first()[0] or []
    index, high = LineRuns(spark, fanout), None
    for cut in [*sorted(set(cuts), reverse=True), None]:
        part = hashes if high is None else hashes.where((F.col("doc_id") < high) | F.col("doc_id").isNull())
        index.add(part if cut is None else part.where(F.col("doc_id") >= cut))
        high = cut
    lost = hashes.join(index.frequent(min_docs), KEY).where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper")))
    lost = lost.select(F.col("doc_id").alias("_doc"), *KEY)
    listed = lost.groupBy("_doc").agg(F.collect_set(F.struct(*KEY)).alias("lost"))
    rows = folded(docs, "doc_id", "text")
    both = rows.join(listed, rows["doc_id"].eqNullSafe(listed["_doc"]), "left").drop("_doc")

    def stays(line: Column) -> Column:
        key = line_key(line)
        return ~((F.char_length(key) >= min_chars) & F.array_contains(F.col("lost"), F.struct(*key_pair(key))))

    lines = lines_of(F.col("text"))
    few = both.where(F.coalesce(F.size("lost"), F.lit(0)) <= LISTED)
    few = few.withColumn("left", F.when(F.col("lost").isNotNull(), F.filter(lines, stays)))
    many = both.where(F.size("lost") > LISTED).drop("lost")
    out = few.drop("lost").unionByName(without_lines(many, lost, min_chars))
    n = F.size(lines).cast("long")
    return out.select(
        *unfolded(docs, "doc_id", "text", results=RESULTS), F.coalesce(F.array_join("left", "\n"), "text", F.lit("")).alias("kept"), n.alias("n_lines"),
        F.coalesce(n - F.when(F.col("left").isNotNull(), F.size("left")), F.lit(0)).cast("long").alias("n_dropped"),
    )


def without_lines(rows: DataFrame, lost: DataFrame, min_chars: int) -> DataFrame:
    """``rows`` (doc_id, text, row) with ``left``, the lines that stay: by an anti join of the lines, linear in a document's lines."""
    rows = rows.withColumn("t", F.struct(*key_pair(F.col("text"))))
    each = rows.dropDuplicates(["doc_id", "t"]).select("doc_id", "t", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    key = line_key(F.col("line"))
    each = each.select("*", *[F.when(F.char_length(key) >= min_chars, k).alias(k_name) for k, k_name in zip(key_pair(key), KEY)])
    gone = lost.withColumnsRenamed({k: f"_{k}" for k in KEY})
    same = F.col("doc_id").eqNullSafe(F.col("_doc"))
    for k in KEY:
        same = same & (F.col(k) == F.col(f"_{k}"))
    left = each.join(gone, same, "left_anti").groupBy("doc_id", "t").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("l"))
    left = left.select(F.col("doc_id").alias("_doc"), F.col("t").alias("_t"), F.col("l.line").alias("left"))
    out = rows.join(left, rows["doc_id"].eqNullSafe(left["_doc"]) & (rows["t"] == left["_t"]), "left")
    return out.select("doc_id", "text", "row", F.coalesce("left", F.array().cast("array<string>")).alias("left"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL5 = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT doc_id, i, line,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.i, k.line, r.keeper IS NOT NULL AND k.doc_id < r.keeper AS lost FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id"""
