"""Repeated byte strings by suffix arrays.

Every string of ``length`` bytes has an anchor, the leftmost smallest hash among its ``K``-byte strings, which depends on
the string alone; equal strings have equal anchors. Strings with one anchor at one place form a context of at most
2 * length - K bytes.

0. Copies of a text of a smaller document (by 128-bit hash) lose all bytes and cannot hold a string first; they are set
   aside.
1. Anchors of all other documents are counted by hash, as packed arrays per hash range; a string can only repeat if its anchor
   occurs twice. The outcome comes back as two bits for each anchor of a document.
2. Contexts of repeated anchors are made distinct in Spark with the smallest doc_id that holds them and dealt to
   partitions by anchor. Contexts of very frequent anchors are cut to single strings, which are dealt by their own hash,
   so no anchor is a hot key.
3. A partition is read as shards of bounded size. Each shard gets a suffix array by Larsson-Sadakane refinement (only
   groups that are still tied are sorted again, by the rank that many bytes further on), common prefixes by Kasai's method
   (all contexts in step), and thus sorted classes of equal strings with their smallest doc_id. Shards are merged by binary
   search of one's classes in the others'.
4. Each context learns which of its strings occur in a smaller document; its occurrences turn that into byte ranges.

Counts, anchors and classes cover all bytes. Apart from whole copies and the way back of the outcome (128-bit hashes), hash
values only decide what meets; strings are compared as bytes.

Cases: null or empty text has no bytes; documents under ``length`` bytes keep all; a null doc_id neither removes nor loses;
rows with the same doc_id do not remove from each other; long texts are read in overlapping segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm.common import key_pair, partitions, saved, small, table

LENGTH, K, SEGMENT, SHARD = 50, 24, 1 << 18, 1 << 20
HEAVY = 50_000  # occurrences from which an anchor's strings are dealt one by one
WINDOW = LENGTH - K + 1


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    n, base = 2 * SEGMENT + LENGTH, 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (base, inverse))
    return up, down


def rolled(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes from the prefix sums of weighted bytes."""
    h = (sums[size:] - sums[:-size]) * powers()[1][:len(sums) - size]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Bytes of several texts or of a part of a long one, and its pieces: (text, offset in it, start, size)."""
    pieces, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 0), SEGMENT):
            part = t[at:at + SEGMENT + LENGTH - 1]
            if size and size + len(part) > SEGMENT + LENGTH:
                yield np.frombuffer(b"".join(parts), np.uint8), pieces
                pieces, parts, size = [], [], 0
            pieces.append((i, at, size, len(part)))
            parts.append(part)
            size += len(part)
    if size:
        yield np.frombuffer(b"".join(parts), np.uint8), pieces


class Anchors:
    """Anchors of a segment: hash, and the first and last start of the strings that have it there."""

    def __init__(self, data: np.ndarray, pieces: list[tuple[int, int, int, int]]):
        self.data = data
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * powers()[0][:len(data)], dtype=np.uint64)])
        grams = rolled(self.sums, K)
        key = grams >> np.uint64(20) << np.uint64(20) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while span * 2 <= WINDOW:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < WINDOW:
            key = np.minimum(key[:-(WINDOW - span)], key[WINDOW - span:])
        at = (key & np.uint64((1 << 20) - 1)).astype(np.int64)
        valid = np.zeros(len(at), bool)
        for _, _, start, size in pieces:
            valid[start:start + size - LENGTH + 1] = True
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        keep = valid[first]
        self.first, self.last = first[keep], last[keep]
        self.hash = grams[at[self.first]]
        starts = np.array([p[2] for p in pieces])
        self.piece = np.searchsorted(starts, self.first, "right") - 1


def encoded(column: pa.Array) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in column.to_pylist()]


COUNTS = "batch long, r int, hashes binary, doc_ids binary, keys binary, counts binary"


def count_anchors(docs: DataFrame, ranges: int) -> DataFrame:
    """For each batch of documents: its anchors' hashes by hash range (r >= 0), and which range each belongs to (r = -1)."""
    kind = np.uint8 if ranges <= 256 else np.uint16

    def run(batches):
        task = TaskContext.get().partitionId()
        for number, b in enumerate(batches):
            texts = encoded(b["text"])
            found = [(x.hash, np.array([p[0] for p in pieces])[x.piece]) for data, pieces in segments(texts) for x in [Anchors(data, pieces)]]
            hashes = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)
            owner = np.concatenate([o for _, o in found]) if found else np.zeros(0, np.int64)
            r = hashes % np.uint64(ranges)
            rest = (hashes // np.uint64(ranges)).astype("<u8")
            order = np.argsort(r, kind="stable")
            cuts = np.searchsorted(r[order], np.arange(ranges + 1, dtype=np.uint64))
            five = rest[order].view(np.uint8).reshape(-1, 8)[:, :5]
            batch = (task << 32) + number
            rows = [(batch, i, five[cuts[i]:cuts[i + 1]].tobytes(), None, None, None) for i in range(ranges) if cuts[i] < cuts[i + 1]]
            counts = np.bincount(owner, minlength=len(texts)).astype(np.int32)
            ids, keys = (np.asarray(b[c].to_numpy(zero_copy_only=False), np.int64) for c in ("doc_id", "text_key"))
            rows.append((batch, -1, r.astype(kind).tobytes(), ids.tobytes(), keys.tobytes(), counts.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), *[pa.binary()] * 4))],
                ["batch", "r", "hashes", "doc_ids", "keys", "counts"])
    return docs.mapInArrow(run, COUNTS)


def repeated_anchors(docs: DataFrame, n_bytes: int) -> DataFrame:
    """(doc_id, text_key, codes, n): for each anchor of a document 0, 1 (occurs again) or 2 (very often); documents with 0 only are left out."""
    ranges = int(min(65536, max(4, -(-n_bytes // (32 << 20)))))
    kind = np.uint8 if ranges <= 256 else np.uint16
    counted = saved(count_anchors(docs, ranges), "anchors")

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["hashes"].map(len).to_numpy() // 5
        wide = np.zeros((sizes.sum(), 8), np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(rows["hashes"]), np.uint8).reshape(-1, 5)
        values = wide.view("<u8").ravel()
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        group = np.cumsum(new) - 1
        n = np.bincount(group)[group]
        code = np.empty(len(values), np.uint8)
        code[order] = np.where(n < 2, 0, np.where(n < HEAVY, 1, 2))
        ends = np.cumsum(sizes)
        return pd.DataFrame({"batch": rows["batch"], "r": rows["r"], "codes": [code[e - s:e].tobytes() for s, e in zip(sizes, ends)]})

    def assemble(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows[rows["r"] == -1].iloc[0]
        r = np.frombuffer(head["hashes"], kind)
        code = np.zeros(len(r), np.uint8)
        order = np.argsort(r, kind="stable")
        parts = rows[rows["r"] >= 0].sort_values("r")
        code[order] = np.frombuffer(b"".join(parts["codes"]), np.uint8)
        counts = np.frombuffer(head["counts"], np.int32)
        ids, keys = np.frombuffer(head["doc_ids"], np.int64), np.frombuffer(head["keys"], np.int64)
        out, at = [], 0
        for d, k, n in zip(ids, keys, counts):
            part = code[at:at + n]
            at += n
            if part.any():
                packed = np.packbits(np.stack([part & 1, part >> 1], 1).ravel())
                out.append((d, k, packed.tobytes(), n))
        return pd.DataFrame(out, columns=["doc_id", "text_key", "codes", "n"])

    codes = counted.where("r >= 0").select("batch", "r", "hashes").groupBy("r").applyInPandas(judge, "batch long, r int, codes binary")
    heads = counted.where("r = -1").withColumn("codes", F.lit(None).cast("binary"))
    rows = heads.unionByName(codes, allowMissingColumns=True)
    out = rows.groupBy("batch").applyInPandas(assemble, "doc_id long, text_key long, codes binary, n int")
    return saved(out.dropDuplicates(["doc_id", "text_key"]), "repeated-anchors")


def contexts(docs: DataFrame) -> DataFrame:
    """(part, ctx, doc_id, text_key, at): contexts of repeated anchors; docs has text and codes."""
    def run(batches):
        for b in batches:
            ids, keys, codes = b["doc_id"].to_pylist(), b["text_key"].to_pylist(), b["codes"].to_pylist()
            bits = [np.unpackbits(np.frombuffer(c, np.uint8))[:2 * n].reshape(-1, 2) for c, n in zip(codes, b["n"].to_pylist())]
            code, seen = [x[:, 0] + 2 * x[:, 1] for x in bits], [0] * len(bits)
            for data, pieces in segments(encoded(b["text"])):
                x = Anchors(data, pieces)
                own = np.zeros(len(x.hash), np.uint8)
                ends = np.searchsorted(x.piece, np.arange(len(pieces) + 1))
                for j, p in enumerate(pieces):
                    n = ends[j + 1] - ends[j]
                    own[ends[j]:ends[j + 1]] = code[p[0]][seen[p[0]]:seen[p[0]] + n]
                    seen[p[0]] += n
                one = own == 1
                first, last, part, piece = x.first[one], x.last[one], x.hash[one], x.piece[one]
                if (own == 2).any():  # strings one by one
                    n = (x.last - x.first + 1)[own == 2]
                    each = np.repeat(x.first[own == 2], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    first, last = np.concatenate([first, each]), np.concatenate([last, each])
                    part = np.concatenate([part, rolled(x.sums, LENGTH)[each]])
                    piece = np.concatenate([piece, np.repeat(x.piece[own == 2], n)])
                if not len(first):
                    continue
                size = last - first + LENGTH
                ends = np.cumsum(size)
                take = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                ctx = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[take])])
                text = np.array([p[0] for p in pieces])[piece]
                start = first - np.array([p[2] - p[1] for p in pieces])[piece]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.view(np.int64)), ctx, pa.array(np.array(ids, np.int64)[text]), pa.array(np.array(keys, np.int64)[text]), pa.array(start)],
                    ["part", "ctx", "doc_id", "text_key", "at"])
    return docs.mapInArrow(run, "part long, ctx binary, doc_id long, text_key long, at long")


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: groups of suffixes that agree in h bytes are sorted by the rank of what follows; h doubles."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i:n + i]
    sa = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[sa[1:]] != key[sa[:-1]]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1]  # the number of a group is its first place
    h = 8
    if not data.all():  # a zero byte looks like the end in the packed keys: start from one byte instead
        h = 1
        sa = np.argsort(data, kind="stable")
        new = np.concatenate([[True], data[sa[1:]] != data[sa[:-1]]])
        rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1]
    while True:
        ordered = rank[sa]
        places = np.flatnonzero(np.bincount(ordered, minlength=n)[ordered] > 1)  # only tied groups
        if not len(places):
            return sa
        suffixes = sa[places]
        group, further = rank[suffixes], rank[np.minimum(suffixes + h, n)]
        order = np.lexsort((further, group))
        suffixes, group, further = suffixes[order], group[order], further[order]
        sa[places] = suffixes
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (further[1:] != further[:-1])])
        rank[suffixes] = places[np.flatnonzero(new)[np.cumsum(new) - 1]]
        h *= 2


def common_prefixes(data: np.ndarray, sa: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Length of the prefix that each suffix shares with its predecessor, up to ``most``, by Kasai's method.

    A suffix shares at least one byte less than the suffix one place before it did, so each context is walked once; all
    contexts are walked in step.
    """
    n = len(data)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([data, np.zeros(most + 1, np.uint8)])
    lcp, held = np.zeros(n, np.int64), np.zeros(len(starts), np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    for step in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -step))  # contexts longer than step
        i = starts[:live] + step
        j = before[i]
        h = np.maximum(held[:live] - 1, 0)
        h[j < 0] = 0
        open_ = np.flatnonzero((j >= 0) & (h < most))
        while len(open_):
            a, b = i[open_] + h[open_], j[open_] + h[open_]
            open_ = open_[(a < n) & (b < n) & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])]
            h[open_] += 1
            open_ = open_[h[open_] < most]
        lcp[i] = h
        held[:live] = h
    return lcp


class Shard:
    """Distinct contexts with their smallest doc_id; the sorted classes of their strings."""

    def __init__(self, rows: list[tuple[bytes, int]]):
        self.ctx = [c for c, _ in rows]
        self.smallest = np.array([d for _, d in rows], np.int64)
        sizes = np.array([len(c) for c in self.ctx])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(self.ctx), np.uint8)
        sa = suffix_array(data)
        lcp = common_prefixes(data, sa, ends - sizes, sizes, LENGTH)
        self.n = sizes - LENGTH + 1
        owner = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(data)) <= np.repeat(ends, sizes) - LENGTH
        of_sorted = np.cumsum(lcp[sa] < LENGTH) - 1
        kept = inside[sa]
        found, of_kept = np.unique(of_sorted[kept], return_inverse=True)
        places = sa[kept]
        self.min = np.full(len(found), np.iinfo(np.int64).max)
        np.minimum.at(self.min, of_kept, self.smallest[owner[places]])
        head = np.empty(len(found), np.int64)
        head[of_kept] = places
        self.strings = data[head[:, None] + np.arange(LENGTH)].reshape(-1).view(f"S{LENGTH}")
        self.of = np.full(len(data), -1)
        self.of[places] = of_kept
        self.starts = ends - sizes

    def learn(self, others: list[Shard]) -> np.ndarray:
        """Smallest doc_id of every class over all shards, by binary search in the others' sorted classes."""
        out = self.min.copy()
        for o in others:
            if o is not self:
                at = np.minimum(np.searchsorted(o.strings, self.strings), len(o.strings) - 1)
                same = o.strings[at] == self.strings
                out[same] = np.minimum(out[same], o.min[at[same]])
        return out

    def masks(self, low: np.ndarray) -> np.ndarray:
        """For each context the bits of its strings that occur in a document smaller than its smallest."""
        before = np.cumsum(self.n) - self.n
        bit = np.arange(self.n.sum()) - np.repeat(before, self.n)
        less = low[self.of[np.repeat(self.starts, self.n) + bit]] < np.repeat(self.smallest, self.n)
        return np.add.reduceat(less.astype(np.int64) << bit, before)


def judge_contexts(distinct: DataFrame) -> DataFrame:
    """(c1, c2, smallest, mask, n) of distinct (ctx, smallest) rows; a partition holds all contexts of its anchors."""
    def run(batches):
        shards, rows, size = [], [], 0
        for b in batches:
            for c, d in zip(b["ctx"].to_pylist(), b["smallest"].to_pylist()):
                rows.append((c, d))
                size += len(c)
                if size >= SHARD:
                    shards.append(Shard(rows))
                    rows, size = [], 0
        if rows:
            shards.append(Shard(rows))
        for s in shards:
            masks = s.masks(s.learn(shards))
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.ctx, pa.binary()), pa.array(s.smallest), pa.array(masks, pa.int64()), pa.array(s.n.astype(np.int32))],
                ["ctx", "smallest", "mask", "n"])
    out = distinct.mapInArrow(run, "ctx binary, smallest long, mask long, n int")
    return out.select(F.xxhash64("ctx").alias("c1"), F.xxhash64(F.lit(1), "ctx").alias("c2"), "smallest", "mask", "n")


def copied(docs: DataFrame) -> DataFrame:
    """(h1, h2, first) of the texts that several rows hold, by 128-bit hash, with their smallest doc_id."""
    texts = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)).select("doc_id", *key_pair(F.col("text")))
    found = texts.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return saved(found.select("h1", "h2", "first"), "copied-texts")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans) of the documents that lose bytes: starts and stops of the maximal ranges, ascending.

    ``docs`` has no null ids, no texts under ``length`` bytes and no copies of a text of a smaller document.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    codes = repeated_anchors(docs, n_bytes)
    size = codes.agg(F.count("*"), F.sum(F.octet_length("codes"))).first()
    likely = docs.join(small(codes, 48 + (size[1] or 0) // max(size[0], 1)), ["doc_id", "text_key"])
    found = contexts(likely)  # made twice below: cheaper than to keep it
    n = max(partitions(spark), n_bytes // (4 << 20))
    distinct = found.groupBy("part", "ctx").agg(F.min("doc_id").alias("smallest"))
    judged = judge_contexts(distinct.repartition(n, "part").select("ctx", "smallest"))
    places = found.select(F.xxhash64("ctx").alias("c1"), F.xxhash64(F.lit(1), "ctx").alias("c2"), "doc_id", "text_key", "at")
    met = places.join(judged, ["c1", "c2"]).where((F.col("doc_id") > F.col("smallest")) | (F.col("mask") != 0))
    mask = F.when(F.col("doc_id") > F.col("smallest"), F.lit(-1).cast("long")).otherwise(F.col("mask"))
    span = F.struct("at", "n", mask.alias("mask"))
    met = met.groupBy("doc_id", "text_key").agg(F.collect_list(span).alias("s"))

    @F.pandas_udf("start array<long>, stop array<long>")
    def merged(ats: pd.Series, sizes: pd.Series, masks: pd.Series) -> pd.DataFrame:
        starts, stops = [], []
        for at, n, mask in zip(ats, sizes, masks):
            bit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first = np.sort((np.repeat(at, n) + bit)[(np.repeat(mask, n) >> bit) & 1 == 1])
            new = np.concatenate([[True], first[1:] > first[:-1] + LENGTH])
            starts.append(first[new])
            stops.append(first[np.concatenate([new[1:], [True]])] + LENGTH)
        return pd.DataFrame({"start": starts, "stop": stops})
    return met.select("doc_id", "text_key", merged("s.at", "s.n", "s.mask").alias("spans"))


def dedup_strings(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with kept (bytes), n_bytes, n_removed and n_spans."""
    copies = copied(docs).withColumnsRenamed({"h1": "_h1", "h2": "_h2", "first": "_first"})
    rows = docs.withColumns({"_key": F.xxhash64("text"), "_g1": key_pair(F.col("text"))[0], "_g2": key_pair(F.col("text"))[1]})
    rows = rows.join(small(copies, 40), (F.col("_g1") == F.col("_h1")) & (F.col("_g2") == F.col("_h2")), "left")
    whole = (F.octet_length("text") >= LENGTH) & (F.col("doc_id") > F.col("_first"))  # a copy of a smaller document's text
    rows = rows.withColumn("_whole", F.coalesce(whole, F.lit(False))).drop("_g1", "_g2", "_h1", "_h2", "_first")
    long = F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)
    found = saved(repeats(rows.where(long & ~F.col("_whole"))), "spans").withColumnsRenamed({"doc_id": "_d", "text_key": "_t"})
    size = found.agg(F.count("*"), F.sum(F.size("spans.start"))).first()
    rows = rows.join(small(found, 64 + 16 * (size[1] or 0) // max(size[0], 1)), (F.col("doc_id") == F.col("_d")) & (F.col("_key") == F.col("_t")), "left")

    @F.pandas_udf("kept binary, n_removed long, n_spans long")
    def cut(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.DataFrame:
        out = []
        for t, start, stop in zip(texts, starts, stops):
            data = (t or "").encode("utf-8", "surrogatepass")
            if start is None:
                out.append((data, 0, 0))
                continue
            kept = b"".join(data[a:b] for a, b in zip([0, *stop], [*start, len(data)]))
            out.append((kept, len(data) - len(kept), len(start)))
        return pd.DataFrame(out, columns=["kept", "n_removed", "n_spans"])
    left = F.when(~F.col("_whole"), F.col("text"))
    rows = rows.withColumn("_c", cut(left, "spans.start", "spans.stop"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return rows.select(
        *docs.columns, "_c.kept", n_bytes.alias("n_bytes"), F.when(F.col("_whole"), n_bytes).otherwise(F.col("_c.n_removed")).alias("n_removed"),
        F.when(F.col("_whole"), F.lit(1).cast("long")).otherwise(F.col("_c.n_spans")).alias("n_spans"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_strings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
