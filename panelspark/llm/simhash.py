"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits. The anchors are the code words of the perfect Hamming code on bits 0 to 62 (bit 63 is free):
every word is within one bit of exactly one anchor (covering radius 1). Two fingerprints at most two bits apart have a
word between them that is at most one bit from both, and its anchor is within one more bit; so it is enough to replicate
a fingerprint to every anchor within two bits, the covering radius plus half the threshold: 32 anchors. An anchor then
holds at most 2 * (1 + 63 + 63 * 62 / 2) = 4034 different fingerprints, whatever the data, so no anchor is hot, and
fingerprints are made distinct before. Per anchor the fingerprints are compared in numpy, and one link to each group's
smallest member is kept. Groups are joined by repeated halving of the paths to the smallest fingerprint.

Cases: null, empty and blank texts have no words and the fingerprint zero, which links like any other; a null doc_id
never names a group unless the whole group has none; repeated rows stay and share a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from panelspark.llm.common import folded, saved, unfolded

LENGTH, THRESHOLD, CHUNK = 63, 2, 1 << 20


def words_in_chunks(text: str | None) -> Iterator[list[bytes]]:
    """Lower-cased (A-Z) words of a text, about a megabyte at a time."""
    data = (text or "").encode("utf-8", "surrogatepass")
    start = 0
    while start < len(data):
        stop = start + CHUNK
        piece = data[start:stop]
        if stop < len(data):  # end after a blank; a longer word is read whole
            while stop < len(data) and piece[-1:] not in b" \t\n\x0b\x0c\r":
                more = data[stop:stop + 4096]
                cut = next((i for i, b in enumerate(more) if b in b" \t\n\x0b\x0c\r"), len(more) - 1) + 1
                piece, stop = piece + more[:cut], stop + cut
        yield piece.lower().split()
        start = stop


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the XXH64 values of all word shingles, as an unsigned number."""
    ones, n, before, few = np.zeros(64, np.int64), 0, [], []
    for words in words_in_chunks(text):
        words = before + words
        shingles = zip(*(words[i:] for i in range(size)))
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), seed) for s in shingles], np.uint64)
        if len(hashes):
            ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            n += len(hashes)
        few, before = words, words[-(size - 1):] if size > 1 else []
    if not n and few:
        return xxhash.xxh64_intdigest(b" ".join(few), seed)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with fp added: the fingerprint as a signed 64-bit number."""
    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t, size, seed) for t in b["text"].to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))], [*b.schema.names, "fp"])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fp", T.LongType())]))


def anchors_of(fp: np.ndarray) -> np.ndarray:
    """The 32 anchors within two bits of each fingerprint (int64); of a code word, itself only (repeated)."""
    low = fp.view(np.uint64) & np.uint64((1 << LENGTH) - 1)
    fault = np.zeros(len(fp), np.int64)
    for bit in range(LENGTH):
        fault ^= np.where((low >> np.uint64(bit)) & np.uint64(1), bit + 1, 0)

    def flip(numbers):  # number i stands for bit i - 1; 0 for none
        numbers = numbers.astype(np.uint64)
        return np.where(numbers > 0, np.uint64(1) << (np.maximum(numbers, 1) - np.uint64(1)), np.uint64(0))

    first = np.arange(LENGTH + 1)[None, :]
    second = fault[:, None] ^ first
    # pairs (a, b) with a xor b = fault, each once; a = 0 is the nearest anchor
    flips = flip(np.broadcast_to(first, second.shape)) ^ flip(second)
    pairs = np.argsort(first > second, axis=1, kind="stable")[:, :32]
    near = low[:, None] ^ np.take_along_axis(flips, pairs, axis=1)
    return np.where(fault[:, None] == 0, low[:, None], near).view(np.int64)


def replicate(fps: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            for part in np.array_split(fp, max(1, len(fp) // 4096)):
                near = anchors_of(part)
                near[:, 1:][near[:, 1:] == near[:, :1]] = np.iinfo(np.int64).min  # not an anchor: anchors have bit 63 clear
                out = pd.DataFrame({"anchor": near.ravel(), "fp": np.repeat(part, near.shape[1])})
                yield out[out["anchor"] != np.iinfo(np.int64).min]
    return fps.select("fp").mapInPandas(run, "anchor long, fp long")


def links_in(group: np.ndarray, threshold: int) -> Iterator[tuple[int, int]]:
    """For the fingerprints of one anchor: a link from each to the smallest that it reaches within the anchor."""
    group = np.sort(group)
    bits = group.view(np.uint64)
    root = np.full(len(group), -1)
    for i in range(len(group)):
        if root[i] < 0:
            root[i], todo = i, [i]
            while todo:
                near = np.flatnonzero((root < 0) & (np.bitwise_count(bits ^ bits[todo.pop()]) <= threshold))
                root[near] = i
                todo.extend(near.tolist())
    for i, r in enumerate(root):
        if r != i:
            yield int(group[i]), int(group[r])


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b), a > b: links that join all fingerprints at most ``threshold`` (0 to 2) bits apart."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("anchors within two bits cover thresholds up to 2")

    def run(batches):
        for b in batches:
            found = [x for g in b["members"] for x in links_in(np.asarray(g, np.int64), threshold)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
    met = replicate(fps).groupBy("anchor").agg(F.collect_list("fp").alias("members"))
    met = met.where(F.size("members") > 1).select("members")
    return met.mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), a > b; root is the smallest node reachable.

    Each round, a node's neighbours are linked to the smallest of them and of the node, larger side first, then smaller
    side; the number of rounds grows with the logarithm of the longest chain.
    """
    edges, before = saved(edges, "links"), None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = saved(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        state = edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def grouped(each: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(fp, root, component_id) of every fingerprint in ``each`` (doc_id, fp): its group's smallest fp and smallest doc_id."""
    fps = saved(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    groups = components(links(fps, threshold))
    named = fps.join(groups, fps["fp"] == groups["node"], "left")
    named = named.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, size: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text, ...)."""
    each = saved(fingerprints(docs.select("doc_id", "text"), size).drop("text"), "fingerprints")
    return each.join(grouped(each, threshold), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id (none: of the smallest fingerprint)."""
    each = saved(fingerprints(folded(docs, "doc_id", "text"), size), "documents-with-fingerprints")
    groups = grouped(each.select("doc_id", "fp"), threshold)
    rows = each.select("doc_id", "fp").distinct().join(groups, "fp")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("r"))
    first = first.select(F.col("r.doc_id").alias("_doc"), F.col("r.fp").alias("_fp"))
    kept = each.join(first, each["doc_id"].eqNullSafe(first["_doc"]) & (each["fp"] == first["_fp"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "fp"]).select(*unfolded(docs, "doc_id", "text"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
