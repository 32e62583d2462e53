"""Hard negatives from rotated one-bit codes.

Vectors are quantised to whole numbers, rotated by random signs and Walsh-Hadamard transforms, and coded by the signs b of the rotated
components; a code is kept with the vector's length and its alignment a, the inner product of the unit vector with b / sqrt(D).
For an anchor q, rotated and cut into bit slices, popcounts of slice and code give g, the inner product of q with b / sqrt(D),
up to the slices' rounding e. The rest of the unit vector is orthogonal to b and has length sqrt(1 - a^2), so by Cauchy-Schwarz

    | <q, x> / |x| - a g |  <=  a e + sqrt(|q|^2 - g^2) sqrt(1 - a^2),

an interval that holds the score for certain. Rows whose interval misses what is asked for are never scored. Of a block's other
candidates those with the highest upper ends are scored with whole numbers first; their k-th best score is a limit, and the rest is scored
only where the upper end reaches it. Positives: the best rows of the anchor's label. Negatives: for each positive, the best rows of other labels
with a score in a window relative to the positive's. Blocks of anchors meet every block of codes once per step; the best of
each pair of blocks are ranked by a window.

Cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; shorter vectors count as
padded with zeros; an empty or zero vector scores zero with all; rows that repeat an anchor's id are not its candidates, other repeated rows
are candidates of their own; repeated equal anchors are one, unequal ones are mined each; ties go to the smaller id; a negative positive
score leaves no window; vectors whose scores could pass a long raise.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelspark.llm.common import saved, table

SEED, ROUNDS, BITS = 42, 3, 6  # of the rotation; bits of an anchor's slices
CHUNK = 256  # rows scored first, to find a limit
MOST = (1 << 63) - 1


def quantised(vectors: DataFrame, label: Column, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, q): rows that take part, with whole-number components."""
    def fine(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where(F.col("vec_id").isNotNull() & label.isNotNull() & F.forall(v, fine))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                       F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("q"))


def rotated(m: np.ndarray, size: int) -> np.ndarray:
    """Rows padded to ``size`` (a power of two) and rotated; lengths and inner products stay."""
    out = np.zeros((len(m), size))
    out[:, :m.shape[1]] = m
    signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (ROUNDS, size))
    for s in signs:
        out *= s
        half = 1
        while half < size:
            pairs = out.reshape(len(m), size // (2 * half), 2, half)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(m), size)
            half *= 2
        out /= np.sqrt(size)
    return out


def packed_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


class Codes:
    """A block of coded vectors, in order of label and id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray, code: np.ndarray, length: np.ndarray, align: np.ndarray):
        self.ids, self.labels, self.m, self.code, self.length, self.align = ids, labels, m, code, length, align
        self.ones = np.bitwise_count(code).sum(axis=1, dtype=np.float64)
        self.along, self.across = length * align, length * np.sqrt(np.maximum(1 - align ** 2, 0))
        self.largest = int(np.abs(m).max(initial=0))

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, m: np.ndarray, size: int) -> Codes:
        order = np.lexsort((ids, labels))
        turned = rotated(m[order], size)
        length = np.sqrt((turned * turned).sum(axis=1))
        with np.errstate(invalid="ignore", divide="ignore"):
            align = np.where(length > 0, np.abs(turned).sum(axis=1) / (np.sqrt(size) * length), 1.0)
        return cls(ids[order], labels[order], m[order], packed_bits(turned >= 0), length, np.minimum(align, 1.0))

    def row(self) -> dict[str, list]:
        parts = {"ids": self.ids, "labels": self.labels, "m": self.m, "code": self.code, "length": self.length, "align": self.align}
        return {k: [np.ascontiguousarray(x).tobytes()] for k, x in parts.items()}

    @classmethod
    def read(cls, r) -> Codes:
        ids = np.frombuffer(r.ids, np.int64)
        n = len(ids)
        return cls(ids, np.frombuffer(r.labels, np.int64), np.frombuffer(r.m, np.int64).reshape(n, -1), np.frombuffer(r.code, np.uint64).reshape(n, -1),
                   np.frombuffer(r.length, np.float64), np.frombuffer(r.align, np.float64))

    def of_label(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))

    def interval(self, q: np.ndarray, a: int = 0, b: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends that hold the inner products of q with rows a to b for certain."""
        part = slice(a, len(self.ids) if b is None else b)
        code, size = self.code[part], self.code.shape[1] * 64
        turned = rotated(q[None, :], size)[0]
        low, high = turned.min(), turned.max()
        step = (high - low) / ((1 << BITS) - 1) or 1.0
        whole = np.rint((turned - low) / step).astype(np.int64)
        counted = np.zeros(len(code), np.int32)
        for j in range(BITS):
            plane = packed_bits(((whole >> j) & 1).astype(np.uint8)[None, :])[0]
            for word in range(len(plane)):
                counted += np.bitwise_count(code[:, word] & plane[word]).astype(np.int32) << j
        near = low + step * whole
        g = (2 * low / np.sqrt(size)) * self.ones[part] + (2 * step / np.sqrt(size)) * counted - near.sum() / np.sqrt(size)
        e = np.sqrt(((turned - near) ** 2).sum())
        square = (turned * turned).sum()
        least = np.maximum(np.abs(g) - e, 0)
        wide = np.sqrt(np.maximum(square - least * least, 0)) * self.across[part] + e * self.along[part]
        wide += 1e-9 * np.sqrt(square) * self.length[part] + 1e-6  # the rounding of doubles
        middle = self.along[part] * g
        return middle - wide, middle + wide

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        m, whole = self.m[rows], int(np.abs(q).sum()) * self.largest
        if whole < 1 << 53:  # doubles hold every partial sum
            return (m.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
        return m @ q

    def best(self, rows: np.ndarray, upper: np.ndarray, q: np.ndarray, k: int, windows: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, scores) of the k best of ``rows`` with a score inside each window; ties go to smaller ids. ``upper`` goes with ``rows``."""
        def inside(scores, low, high):
            return (scores >= low) & (scores <= high)
        if len(rows) > CHUNK:
            first = np.argpartition(upper, len(rows) - CHUNK)[-CHUNK:]
            known, limits = self.scores(rows[first], q), []
            for low, high in windows:
                s = known[inside(known, low, high)]
                limits.append(np.partition(s, len(s) - k)[len(s) - k] if len(s) >= k else low)
            rows = rows[upper >= min(limits)]
        scores = self.scores(rows, q)
        out = []
        for low, high in windows:
            at = np.flatnonzero(inside(scores, low, high))
            if len(at) > k:
                at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
            at = at[np.lexsort((self.ids[rows[at]], -scores[at]))][:k]
            out.append((rows[at], scores[at]))
        return out


def coded(rows: DataFrame, n_rows: int, width: int) -> DataFrame:
    """Blocks of codes, each with the number of its slot, and how many slots there are."""
    size = 64
    while size < width:
        size *= 2
    per_block = max(256, (1 << 20) // size)
    blocks = max(1, -(-n_rows // per_block))

    def run(batches):
        ids, labels, vectors = [], [], []

        def block():
            m = np.zeros((len(ids), width), np.int64)
            for i, v in enumerate(vectors):
                m[i, :len(v)] = v
            return pd.DataFrame(Codes.of(np.array(ids, np.int64), np.array(labels, np.int64), m, size).row())
        for b in batches:
            for i, label, v in zip(b["vec_id"], b["label"], b["q"]):
                ids.append(i)
                labels.append(label)
                vectors.append(v)
                if len(ids) == per_block:
                    yield block()
                    ids, labels, vectors = [], [], []
        if ids:
            yield block()
    out = rows.repartition(blocks).mapInPandas(run, "ids binary, labels binary, m binary, code binary, length binary, align binary")
    return saved(out.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(blocks))), "codes")


def met(codes: DataFrame, anchors: DataFrame, n_anchors: int, per_anchor_block: int, visit: Callable, schema: str) -> DataFrame:
    """``visit(codes, anchor row)`` for each pair of a block of codes and an anchor; it returns rows of ``schema``."""
    n_slots = codes.agg(F.max("slot")).first()[0] + 1
    groups = max(1, -(-n_anchors // per_anchor_block))
    asked = anchors.withColumn("_group", F.pmod(F.xxhash64("anchor_id", "key"), F.lit(groups)))
    asked = asked.groupBy("_group").agg(F.collect_list(F.struct(*anchors.columns)).alias("asked")).select("asked")
    asked = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n_slots - 1))))
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        kept, block = None, None
        for b in batches:
            for r in b.itertuples():
                if kept != (r.ids, r.m):
                    kept, block = (r.ids, r.m), Codes.read(r)
                rows = [row for anchor in r.asked for row in visit(block, anchor)]
                if rows:
                    yield pd.DataFrame(rows, columns=names)
    return codes.join(asked.hint("shuffle_hash"), "slot").drop("slot").mapInPandas(run, schema)


def positives_in(block: Codes, anchor, k: int):
    q = padded(np.asarray(anchor["q"], np.int64), block.m.shape[1])
    a, b = block.of_label(anchor["label"])
    rows = np.arange(a, b)
    other = block.ids[a:b] != anchor["anchor_id"]
    if not other.any():
        return
    low, upper = block.interval(q, a, b)
    rows, low, upper = rows[other], low[other], upper[other]
    if len(rows) > k:  # the k best lower ends are a limit before anything is scored
        reach = upper >= np.partition(low, len(rows) - k)[len(rows) - k]
        rows, upper = rows[reach], upper[reach]
    got, found = block.best(rows, upper, q, k, [(-MOST, MOST)])[0]
    for i, s in zip(block.ids[got].tolist(), found.tolist()):
        yield anchor["anchor_id"], anchor["key"], i, s


def negatives_in(block: Codes, anchor, k: int, least: int, most: int):
    q = padded(np.asarray(anchor["q"], np.int64), block.m.shape[1])
    windows = [(place, p, -(-least * p["score"] // 100), most * p["score"] // 100) for place, p in enumerate(anchor["positives"])]
    windows = [w for w in windows if w[2] <= w[3]]
    if not windows:
        return
    a, b = block.of_label(anchor["label"])
    lower, upper = block.interval(q)
    reach = (upper >= min(w[2] for w in windows)) & (lower <= max(w[3] for w in windows)) & (block.ids != anchor["anchor_id"])
    reach[a:b] = False
    rows = np.flatnonzero(reach)
    found = block.best(rows, upper[rows], q, k, [w[2:] for w in windows])
    for (place, positive, _, _), (got, scores) in zip(windows, found):
        for i, s in zip(block.ids[got].tolist(), scores.tolist()):
            yield anchor["anchor_id"], anchor["key"], place, positive["vec_id"], positive["score"], i, s


def padded(q: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(width, np.int64)
    out[:len(q)] = q
    return out


def hard_negatives(rows: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 3, least: int = 50, most: int = 95,
                   per_anchor_block: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of quantised (vec_id, label, q) rows.

    A negative's score is from ``least`` to ``most`` hundredths of the positive's.
    """
    rows = saved(rows, "quantised")
    part = F.array_max(F.transform("q", lambda x: F.abs(x)))
    n_rows, width, largest = rows.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(part)).first()
    if (largest or 0) ** 2 * (width or 1) * 100 >= 1 << 63:
        raise ValueError("components are too large: a score could pass a long")
    codes = coded(rows, n_rows, width or 1)
    anchors = rows.where(anchor).select(F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "q").alias("key"), "label", "q")
    anchors = saved(anchors.dropDuplicates(["anchor_id", "label", "q"]), "anchors")
    n_anchors = anchors.count()
    if not n_anchors:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    found = met(codes, anchors, n_anchors, per_anchor_block, lambda b, a: positives_in(b, a, n_positives), "anchor_id long, key long, vec_id long, score long")
    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_positives)
    found = found.groupBy("anchor_id", "key").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("positives"))
    with_positives = saved(anchors.join(found, ["anchor_id", "key"]), "anchors-with-positives")

    out = met(codes, with_positives, n_anchors, per_anchor_block, lambda b, a: negatives_in(b, a, n_negatives, least, most),
              "anchor_id long, key long, place int, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "key", "place").orderBy(F.desc("negative_score"), "negative_id")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), label)
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


SQL13 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
