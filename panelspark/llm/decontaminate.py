"""Benchmark decontamination by a prefix-filtered join of word windows.

A window is ``window`` consecutive words of an item (a shorter item is one window). Documents and windows are sequences
of word shingles (``shingle`` words, or all words of a shorter window). A document that contains a window contains all
its shingles, so the necessary prefix of a window is one shingle: its rarest, by the number of occurrences in all
documents. Each place of that shingle in a document gives one place for the window; it must lie inside the document
(length and position bounds), and then the words are compared one by one.

One pass over the texts finds and keeps the places of all shingles of windows, which also gives their rarity, and counts the
words; the second reads only documents with a place for a window's prefix. Neither shuffles text as long as the checked size of the other
side is small; beyond that, both are joins by shuffle.

Cases: null or blank text has no words; an item without words has no window; items with the same id count once; an item
with a null id is named by the empty string; repeated rows are reported once each. Further columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.llm.common import ascii_lower, folded, saved, small, unfolded

WHOLE = -(1 << 62) + 1  # stands for the shingle of the row that says how many words a document has
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words; never null."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1)
    first = F.when(F.element_at(parts, 1) == "", 2).otherwise(1)  # blanks before the first word leave an empty part
    last = F.size(parts) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, first, F.greatest(last - first + 1, F.lit(0)))


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """(w, m, words, item_ids) of every distinct window: hash, number of words, the words, the items that hold it."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("all"))
    words = words.where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    words = words.select("item", "all", F.explode(starts).alias("at"))
    words = words.select("item", F.slice("all", F.col("at"), window).alias("words"))
    out = words.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return out.select(F.xxhash64("words").alias("w"), F.size("words").alias("m"), "words", "items")


def shingle_at(words: Column, at: Column, length: int) -> Column:
    """Hash of the ``length`` words from position ``at`` (from 0)."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(length)])


def places(docs: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """(…, words, at, sh): every place of a document with the shingles that start there, and one row at -1 with the hash WHOLE."""
    out = docs.select(*keep, words_of(F.col("text")).alias("words"))
    out = out.select(*keep, "words", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("at"))
    whole = F.col("at") < 0
    if len(lengths) == 1:
        return out.withColumn("sh", F.when(whole, F.lit(WHOLE)).otherwise(shingle_at(F.col("words"), F.col("at"), lengths[0])))
    shingles = F.array(*[shingle_at(F.col("words"), F.col("at"), n) for n in lengths])
    return out.withColumn("sh", F.explode(F.when(whole, F.array(F.lit(WHOLE))).otherwise(shingles)))


def window_shingles(windows: DataFrame, lengths: list[int], shingle: int) -> DataFrame:
    """(w, off, sh): the shingles of every window and where they start in it."""
    def of_length(n: int) -> DataFrame:
        kind = windows.where(F.col("m") == n) if n < shingle else windows.where(F.col("m") >= shingle)
        offs = kind.select("w", F.col("words").alias("all"), F.explode(F.sequence(F.lit(0), F.col("m") - n)).alias("off"))
        return offs.select("w", "off", shingle_at(F.col("all"), F.col("off"), n).alias("sh"))
    return reduce(DataFrame.unionByName, [of_length(n) for n in lengths])


def prefixes(windows: DataFrame, parts: DataFrame, found: DataFrame) -> DataFrame:
    """The windows with their rarest shingle ``sh`` by the places ``found`` in all documents, and its offset ``off``."""
    counts = found.groupBy("sh").agg(F.count("*").alias("n"))
    ranked = parts.join(counts, "sh", "left").select("w", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "sh").alias("p"))
    best = ranked.groupBy("w").agg(F.min("p").alias("p")).where(F.col("p.n") > 0)  # a shingle that never occurs: no match
    return windows.join(best, "w").select("w", "m", F.col("words").alias("wanted"), "p.off", "p.sh")


def contained(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, text_key, w, start, m) for every occurrence of a window; the windows with their items; and for each row of ``docs``
    (doc_id, text_key, n, row): its number of words and its further columns."""
    windows = saved(windows_of(items, window), "windows")
    lengths = sorted({min(r["m"], shingle) for r in windows.select("m").distinct().collect()}) or [shingle]
    parts = saved(window_shingles(windows, lengths, shingle), "window-shingles")
    docs = folded(docs, "doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    found = places(docs, lengths, "doc_id", "text_key", "row")
    whole = F.col("at") < 0
    found = found.select("doc_id", "text_key", "at", "sh", F.when(whole, F.size("words")).alias("n"), F.when(whole, F.col("row")).alias("row"))
    wanted = parts.select("sh").distinct().union(docs.sparkSession.range(1).select(F.lit(WHOLE)))
    found = saved(found.join(small(wanted, 16), "sh"), "shingle-places")
    each = found.where(whole).select("doc_id", "text_key", "n", "row")
    found = found.where(~whole).select("doc_id", "text_key", "at", "sh")
    start = F.col("at") - F.col("off")
    likely = found.join(small(saved(prefixes(windows, parts, found), "prefixes"), 24 * (window + 3)), "sh").where(start >= 0)
    likely = saved(likely.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), start.alias("start"), "w", "m", "wanted"), "candidates")
    same_doc = docs["doc_id"].eqNullSafe(likely["_d"]) & (docs["text_key"] == likely["_t"])
    keys = likely.select("_d", "_t").distinct()
    texts = docs.join(small(keys, 32), same_doc, "left_semi").select("doc_id", "text_key", words_of(F.col("text")).alias("words"))
    met = texts.join(small(likely, 24 * (window + 3)), same_doc)
    same = F.col("start") + F.col("m") <= F.size("words")
    for i in range(window):
        same = same & ((F.col("m") <= i) | (F.get("words", F.col("start") + i) == F.get("wanted", F.lit(i))))
    return met.where(same).select("doc_id", "text_key", "w", "start", "m").distinct(), windows, each


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_words, n_hit, n_items, items_sha256 and contaminated, without the text.

    Further columns pass through whatever their names; one with the name of a result is replaced.
    """
    met, windows, each = contained(docs, items, window, shingle)
    met = saved(met, "occurrences")
    key = ["doc_id", "text_key"]
    words = met.select(*key, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("m") - 1)).alias("at")).distinct()
    hits = words.groupBy(*key).agg(F.count("at").alias("hit"))
    named = met.select(*key, "w").distinct().join(windows.select("w", F.explode("items").alias("item")), "w")
    named = named.groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("items"))
    side = hits.withColumnsRenamed({"doc_id": "_d", "text_key": "_t"})
    other = named.withColumnsRenamed({"doc_id": "_e", "text_key": "_u"})
    side = side.join(other, F.col("_d").eqNullSafe(F.col("_e")) & (F.col("_t") == F.col("_u"))).drop("_e", "_u")
    out = each.join(side, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")), "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return out.select(
        *unfolded(docs, "doc_id", results=("text", *RESULTS)), F.col("n").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """``docs`` without the documents that hold a window of an item."""
    met = contained(docs.select("doc_id", "text"), items, window, shingle)[0]
    met = met.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")).distinct()
    rows = folded(docs, "doc_id", "text").withColumn("_key", F.xxhash64("text"))
    return rows.join(met, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_t")), "left_anti").select(*unfolded(docs, "doc_id", "text"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


SQL3 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item, least(len(w), 10) AS m, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS t
        FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM iw WHERE len(w) > 0)),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS s FROM dw),
g AS (SELECT doc_id, s, k.m, array_to_string(list_slice(w, s, s + k.m - 1), ' ') AS t
      FROM p, (SELECT DISTINCT m FROM win) k WHERE s + k.m - 1 <= len(w)),
o AS (SELECT DISTINCT g.doc_id, g.s, g.m, win.item FROM g JOIN win ON g.t = win.t AND g.m = win.m),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + m - 1)) AS x FROM o) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""
