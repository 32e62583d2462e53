"""Exact ranked lexical search with hashed max-sketches.

A document's terms are hashed into a row of small counters, two places each, and a counter keeps the largest frequency of the
terms that fall on it. For a fixed document length the impact of a term grows with its frequency, so the impact computed from
a counter is the maximum of the impacts folded there, and the smaller of a term's two counters bounds its impact from above.
The width of a row grows with the number of its distinct terms. The index holds one row per document, its sketch and its
text, and partial document frequencies of all terms; it does not depend on the queries.

A search looks all query terms up in blocks of sketches and adds weight times impact bound: an upper bound of each score.
A first, small step scores the first block of each task; the k-th best score of each query there is a threshold that the result cannot
fall below. Then each task goes through the documents of its blocks in descending order of bound over threshold and scores exactly
those with a bound that reaches a threshold; its own k-th best scores raise the thresholds as it goes. Every document whose
bound reaches the final threshold is scored, so the result is exact. A window ranks what the tasks kept, at most k rows of each per query.

The queries are one table, asked against all documents, about ``per_pass`` of them at a time: the terms of one pass are
gathered on the driver and travel with the function; more queries mean more passes over the index.

Cases: null texts and texts without terms have no score; a frequency of 255 or more counts as unlimited in the sketch; a null
doc_id ranks behind all others; repeated rows are documents of their own; repeated queries (same id) with the same terms
are one, with other terms each has its own result; items without terms have no result; a query term that no document holds adds nothing.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelspark.llm.common import saved, table

PLACES, PER_TERM, NARROW = 2, 8, 64  # counters of a term; counters per distinct term, at least; narrowest sketch
STAT_TERMS = 1 << 16  # distinct terms of one row of partial frequencies, about
BLOCK = 512  # sketches looked up at a time
# Everything that no term holds becomes a space, and A-Z become small.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Places:
    """64 bits per term; a sketch of a width that is a power of two uses the low bits of each half."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        """Two places of each term, one row each."""
        known = self.known
        if len(known) > STAT_TERMS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w, 42)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        return np.stack([h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)]).astype(np.int64)


def sketch(counts: Counter, places: Places) -> bytes:
    """Coordinatewise maxima of the terms' frequencies, cut at 255."""
    width = NARROW
    while width < PER_TERM * len(counts):
        width *= 2
    out = np.zeros(width, np.uint8)
    at = places.of(list(counts)) & (width - 1)
    n = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), 255).astype(np.uint8)
    for row in at:
        np.maximum.at(out, row, n)
    return out.tobytes()


INDEX = "doc_id long, n long, sketch binary, text binary, frequencies array<struct<term:binary,df:long>>"


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that few texts are held at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def index(docs: DataFrame) -> DataFrame:
    """One row (doc_id, n, sketch, text) per document with terms, and rows that only have frequencies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, df = Places(), Counter()
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("text", pa.binary()),
                            ("frequencies", pa.list_(pa.struct([("term", pa.binary()), ("df", pa.int64())])))])

        def frequencies() -> pa.RecordBatch:
            row = [{"term": t, "df": n} for t, n in df.items()]
            return pa.RecordBatch.from_pylist([{"frequencies": row}], schema)
        for batch in slices(batches):
            ids, ns, sketches, texts = [], [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                text = text.as_buffer()
                text = b"" if text is None else text.to_pybytes()
                counts = Counter(terms(text))
                if not counts:
                    continue
                ids.append(doc_id)
                ns.append(counts.total())
                sketches.append(sketch(counts, places))
                texts.append(text)
                df.update(counts.keys())
                if len(df) > STAT_TERMS:
                    yield frequencies()
                    df.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(sketches, pa.binary()), pa.array(texts, pa.binary()),
                                              pa.nulls(len(ids), schema.field("frequencies").type)], schema=schema)
        if df:
            yield frequencies()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)


class Queries:
    """A pass of queries as arrays: their terms one after another, with weights, places and where each query starts."""

    def __init__(self, asked: list[tuple[object, list[bytes]]], df: dict[bytes, int], n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
        self.asked = [(key, [t for t in words if weight.get(t, 0) > 0]) for key, words in asked]
        self.asked = [(key, words) for key, words in self.asked if words]
        self.terms = sorted({t for _, words in self.asked for t in words})
        number = {t: i for i, t in enumerate(self.terms)}
        self.number = number
        self.weight = np.array([weight[t] for t in self.terms], np.int64)
        self.places = Places().of(self.terms)
        self.flat = np.array([number[t] for _, words in self.asked for t in words], np.int64)
        self.start = np.cumsum([0] + [len(words) for _, words in self.asked])[:-1]

    def length(self, n: np.ndarray | int) -> np.ndarray | int:
        """m of documents with n terms."""
        return 100 - 50 + 50 * n * self.n_docs // self.n_terms

    def bounds(self, sketches: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Upper bounds, documents by queries, from sketches of one width. Single precision; the last factor is above its error."""
        at = self.places & (sketches.shape[1] - 1)
        counter = np.minimum(sketches[:, at[0]], sketches[:, at[1]])
        tf = counter.astype(np.float32)
        best = tf * np.float32(1e9) / (tf * np.float32(1000) + (20 * self.length(n)).astype(np.float32)[:, None])
        best[counter == 255] = 1e6  # no impact reaches it
        best *= self.weight.astype(np.float32)
        return np.add.reduceat(best[:, self.flat], self.start, axis=1) * np.float32(1 + 1e-4)

    def scores(self, text: bytes, n: int) -> np.ndarray:
        """Exact scores of one document with all queries."""
        number = self.number
        counts = Counter(t for t in terms(text) if t in number)
        tf = np.zeros(len(self.terms), np.int64)
        tf[[number[t] for t in counts]] = list(counts.values())
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * self.length(n))
        return np.add.reduceat((impact * self.weight)[self.flat], self.start)


def blocks(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """(sketches of one width as a matrix, n, further columns) of at most BLOCK rows."""
    waiting: dict[int, list[tuple]] = {}

    def block(width: int) -> tuple:
        rows = waiting.pop(width)
        matrix = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(len(rows), width)
        return matrix, np.array([r[1] for r in rows], np.int64), *([r[i] for r in rows] for i in range(2, 2 + len(more)))
    for batch in slices(batches):
        for row in zip(*(batch[c].to_pylist() for c in ("sketch", "n", *more))):
            width = len(row[0])
            waiting.setdefault(width, []).append(row)
            if len(waiting[width]) * max(width, 4096) >= BLOCK * 4096:
                yield block(width)
    for width in list(waiting):
        yield block(width)


class Best:
    """The k best (score, doc_id) of each query, smaller doc_ids first among equals and a null last."""

    def __init__(self, queries: int, k: int, threshold: dict[int, int]):
        self.k, self.heaps = k, [[] for _ in range(queries)]  # worst first
        self.floor = np.array([threshold.get(q, 1) for q in range(queries)], np.int64)

    def add(self, doc_id: int | None, scores: np.ndarray) -> None:
        for query in np.flatnonzero(scores >= self.floor).tolist():
            heap = self.heaps[query]
            entry = (int(scores[query]), doc_id is not None, -(doc_id or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.floor[query] = max(self.floor[query], heap[0][0])

    def rows(self) -> pa.RecordBatch:
        rows = [(q, -d if known else None, score) for q, heap in enumerate(self.heaps) for score, known, d in heap]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                                           pa.array([r[2] for r in rows], pa.int64())], ["query", "doc_id", "score"])


def rescored(indexed: DataFrame, queries: Queries, k: int, threshold: dict[int, int] | None = None) -> DataFrame:
    """(query, doc_id, score): of each task the k best exact scores among the documents whose bound reaches the query's threshold.

    Without thresholds only the first block of each task is scored, to find some.
    """
    def run(batches):
        best = Best(len(queries.asked), k, threshold or {})
        for sketches, n, ids, texts in blocks(batches, "doc_id", "text"):
            bounds = queries.bounds(sketches, n)
            over = bounds / best.floor
            for row in np.argsort(-over.max(axis=1), kind="stable").tolist():
                if (bounds[row] >= best.floor).any():
                    best.add(ids[row], queries.scores(texts[row], int(n[row])))
            if threshold is None:
                break
        yield best.rows()
    return indexed.where("n is not null").select("sketch", "n", "doc_id", "text").mapInArrow(run, "query int, doc_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, per_pass: int = 256) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents (doc_id, text) for each item (item_id, text)."""
    spark = docs.sparkSession
    indexed = saved(index(docs), "max-sketches")
    n_docs, n_terms = indexed.agg(F.count("n"), F.sum("n")).first()

    def split(batches):
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "terms": [sorted(set(terms((t or "").encode()))) for t in b["text"]]})
    kind = items.schema["item_id"].dataType.simpleString()
    asked = saved(items.select("item_id", "text").mapInPandas(split, f"item_id {kind}, terms array<binary>").where(F.size("terms") > 0)
                  .distinct(), "queries")
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    df = indexed.where("frequencies is not null").select(F.inline("frequencies"))
    df = saved(df.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")), "frequencies")

    found, passes = None, -(-asked.count() // per_pass) if n_docs else 0
    for i in range(passes):
        some = asked.where(F.pmod(F.xxhash64("terms"), F.lit(passes)) == i)
        words = some.select(F.explode("terms").alias("term")).distinct()
        counts = {bytes(r.term): r.df for r in df.join(words, "term", "left_semi").collect()}  # terms of one pass
        queries = Queries([(r.item_id, [bytes(t) for t in r.terms]) for r in some.collect()], counts, n_docs, n_terms)
        if not queries.asked:
            continue
        first = ranked(rescored(indexed, queries, k), k).where(F.col("rank") == k)
        reached = {r.query: r.score for r in first.select("query", "score").collect()}  # at most one number per query
        out = ranked(rescored(indexed, queries, k, reached), k)
        names = spark.createDataFrame([(q, key) for q, (key, _) in enumerate(queries.asked)], f"query int, item_id {kind}")
        out = out.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # one row per query of the pass
        found = out if found is None else found.union(out)
    empty = f"item_id {kind}, rank int, doc_id long, score long"
    return spark.createDataFrame([], empty) if found is None else found


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL12 = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, len(ts) AS n, ts FROM d WHERE len(ts) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM c),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
f AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM c)
      WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY term),
s AS (SELECT q.item_id, f.doc_id, CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (50 + (50 * f.n * nn) // ll)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN w USING (term), g GROUP BY q.item_id, f.doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""
