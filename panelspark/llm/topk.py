"""Exact top-k inner products with a bit-sliced index.

Components are quantised to whole numbers. A block of rows (ascending id) is stored as slices: for each component the
offset from the block's minimum, one bitmap over the rows per bit, and the inverted bitmaps for negative query components.
The score of a query with all rows of a block is the sum of |q| times the slices, made by carry-save addition of bitmaps:
three bitmaps of one weight become one of that weight and one of the next, until each weight has one bitmap left. From
the most significant of these downward the rows are selected: those that surely belong to the best k, and those that
still tie; what is left after the last bitmap ties exactly, and the smallest ids of it fill up. Blocks of queries meet
every index block once; the best k of each pair are ranked per query by a window.

Cases: null vectors and vectors with null, NaN or infinite components take no part; shorter vectors count as padded with
zeros; vectors whose scores could pass a long raise; rows that repeat a query's id are not its candidates; repeated query rows with equal vectors are one query; null ids are no candidates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelspark.llm.common import saved, table

LIMIT = 1 << 61  # of a score, so that all sums fit a long


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, q): whole numbers; rows that take no part are left out."""
    def fine(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where(F.col("vec_id").isNotNull() & F.forall(v, fine))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("q"))


def packed(rows: DataFrame, blocks: int, per_block: int, slot: Column | None = None) -> DataFrame:
    """Blocks of rows as binary ids and matrices; ``blocks`` partitions, at most ``per_block`` rows each."""
    def run(batches):
        ids, vectors = [], []

        def block():
            width = max(len(v) for v in vectors)
            m = np.zeros((len(ids), width), np.int64)
            for i, v in enumerate(vectors):
                m[i, :len(v)] = v
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            return pd.DataFrame({"ids": [np.array(ids, np.int64)[order].tobytes()], "m": [m[order].tobytes()], "width": [width]})
        for b in batches:
            for i, v in zip(b["vec_id"], b["q"]):
                ids.append(i)
                vectors.append(v)
                if len(ids) == per_block:
                    yield block()
                    ids, vectors = [], []
        if ids:
            yield block()
    return rows.repartition(blocks).mapInPandas(run, "ids binary, m binary, width int")


class Slices:
    """The bit-sliced index of one block."""

    def __init__(self, ids: bytes, m: bytes, width: int):
        self.ids = np.frombuffer(ids, np.int64)
        values = np.frombuffer(m, np.int64).reshape(len(self.ids), width)
        self.n, self.width = len(self.ids), width
        self.low = values.min(0) if width else np.zeros(0, np.int64)
        offset = values - self.low
        self.bits = max(int(offset.max()).bit_length() if offset.size else 0, 1)
        words = -(-self.n // 64)
        planes = np.zeros((width, self.bits, words * 64), np.uint8)
        for b in range(self.bits):
            planes[:, b, :self.n] = ((offset >> b) & 1).T
        self.slices = np.packbits(planes, axis=2, bitorder="little").view(np.uint64)
        self.all = np.packbits(np.arange(words * 64) < self.n, bitorder="little").view(np.uint64)
        self.inverted = ~self.slices & self.all

    def sums(self, q: np.ndarray) -> tuple[list[np.ndarray | None], int]:
        """Bitmaps of the score by weight, and what has to be added to the number they spell."""
        q = q[:self.width].astype(np.int64)
        low, slices = self.low[:len(q)], self.slices[:len(q)]
        size, top = np.abs(q), (1 << self.bits) - 1
        add = int((q * low).sum()) + int((q[q < 0] * top).sum())
        piles: list[list[np.ndarray]] = [[] for _ in range(self.bits + int(size.max(initial=0)).bit_length() + 12)]
        for j in range(int(size.max(initial=0)).bit_length()):
            has = (size >> j) & 1 == 1
            up, down = np.flatnonzero(has & (q > 0)), np.flatnonzero(has & (q < 0))
            for b in range(self.bits):
                if len(up):
                    piles[b + j].append(slices[up, b])
                if len(down):
                    piles[b + j].append(self.inverted[down, b])
        out: list[np.ndarray | None] = []
        for weight in range(len(piles)):
            pile = np.concatenate(piles[weight]) if piles[weight] else np.zeros((0, len(self.all)), np.uint64)
            while len(pile) > 1:
                if len(pile) == 2:
                    pile, carry = (pile[:1] ^ pile[1:]), pile[:1] & pile[1:]
                else:
                    n = len(pile) // 3
                    a, b, c = pile[:n], pile[n:2 * n], pile[2 * n:3 * n]
                    ab = a ^ b
                    pile, carry = np.concatenate([ab ^ c, pile[3 * n:]]), (a & b) | (ab & c)
                if weight + 1 == len(piles):
                    piles.append([])
                piles[weight + 1].append(carry)
            out.append(pile[0] if len(pile) else None)
        while len(out) < len(piles):
            out.append(None)
        return out, add

    def best(self, q: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows with another id than ``without``; ties go to smaller ids."""
        bitmaps, add = self.sums(q)
        tied = self.all.copy()
        i, j = np.searchsorted(self.ids, without), np.searchsorted(self.ids, without, "right")
        for row in range(i, j):
            tied[row // 64] &= ~(np.uint64(1) << np.uint64(row % 64))
        sure, n_sure = np.zeros_like(tied), 0
        for bits in reversed(bitmaps):
            if bits is None:
                continue
            ones = tied & bits
            n = int(np.bitwise_count(ones).sum())
            if n_sure + n > k:
                tied = ones
            else:
                sure, n_sure, tied = sure | ones, n_sure + n, tied & ~bits
                if n_sure == k:
                    break
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        if n_sure < k:
            rest = np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little"))[:k - n_sure]
            rows = np.concatenate([rows, rest])
        scores = np.full(len(rows), add, np.int64)
        for weight, bits in enumerate(bitmaps):
            if bits is not None:
                scores += ((bits[rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << weight
        return self.ids[rows], scores


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5, per_block: int = 16384, per_query_block: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of quantised (vec_id, q) queries over quantised rows."""
    def size(df: DataFrame) -> tuple[int, int, int]:
        largest = F.max(F.array_max(F.transform("q", lambda x: F.abs(x))))
        n, width, most = df.agg(F.count(F.lit(1)), F.max(F.size("q")), largest).first()
        return n, width or 0, most or 0
    (n_rows, width, most), (_, _, asked_most) = size(rows), size(queries)
    if width * most * asked_most >= LIMIT:
        raise ValueError("components are too large: a score could pass a long")
    queries = saved(queries.dropDuplicates(["vec_id", "q"]), "queries")
    n_blocks, n_queries = max(1, -(-n_rows // per_block)), queries.count()
    index = packed(rows, n_blocks, per_block).withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(n_blocks)))
    asked = packed(queries, max(1, -(-n_queries // per_query_block)), per_query_block)
    asked = asked.select(F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), F.col("width").alias("q_width"))
    asked = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def run(batches):
        kept, slices = None, None
        for b in batches:
            for r in b.itertuples():
                if kept != (r.ids, r.m):
                    kept, slices = (r.ids, r.m), Slices(r.ids, r.m, r.width)
                q_ids = np.frombuffer(r.q_ids, np.int64)
                q_m = np.frombuffer(r.q_m, np.int64).reshape(len(q_ids), r.q_width)
                out = []
                for qid, q in zip(q_ids, q_m):
                    ids, scores = slices.best(q, k, qid)
                    out.append(pd.DataFrame({"query_id": qid, "key": xxhash.xxh64_intdigest(np.trim_zeros(q, "b").tobytes()) >> 1,
                                             "vec_id": ids, "score": scores}))
                if out:
                    yield pd.concat(out)
    met = index.join(asked.hint("shuffle_hash"), "slot").drop("slot")
    found = met.mapInPandas(run, "query_id long, key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "quantised")
    return top_k(rows.where(F.col("vec_id") % 50 == 0), rows)


SQL2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
