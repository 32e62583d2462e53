"""Mix sources to target weights from fixed-length blocks of words.

The words of each source are laid end to end (documents in hash order) and cut into blocks. Every output shard draws its
sources slot by slot (alias method on hashed uniforms), so its counts are multinomial. Draws of a source beyond its
number of slots, which is fixed by its target, go over to the sources that came out short, so the totals are exact. A
source's slots are numbered through all shards and mapped to blocks by a pseudorandom permutation of its block numbers
(swap-or-not rounds, a permutation of 0..n-1 for any n); slot number n starts the next pass, so no block and no document
is taken more than twice. Slots and the blocks' pieces of documents meet in a join on (source, block).

Everything is a function of the rows and the seed. Targets: weights 3, 1, 2, repeating over the sources by code point
(null last), share 150 % of all words; a source stops at twice its size and the rest is shared again.

Cases: a null or blank text has no words, takes none and stays; a null source is a source; repeated rows are rows of
their own; an empty table gives an empty result; further columns pass through, the text does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelspark.llm.common import WORD, folded, partitions, saved, unfolded

WEIGHTS = (3, 1, 2)
MAX_SOURCES = 10_000  # a mixture names its sources; more of them are refused, not cut


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> list[float]:
    """Share ``share`` of all words by weight; sources that would pass ``most`` times their size stop there."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left, out, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        unit = left / sum(w[i] for i in free)
        full = [i for i in sorted(free) if unit * w[i] > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * w[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
            free.discard(i)
    return out


def slots_for(size: int, target: float, block: int) -> int:
    """Whole passes over the blocks of a source and single blocks for the rest."""
    if not size:
        return 0
    n = -(-size // block)
    passes = int(target // size)
    return min(2 * n, passes * n + round((target - passes * size) / block))


def alias_table(chances: list[float]) -> tuple[list[float], list[int]]:
    n, total = len(chances), sum(chances)
    keep, other = [c * n / total for c in chances], list(range(n))
    small, large = [i for i in range(n) if keep[i] < 1], [i for i in range(n) if keep[i] >= 1]
    while small and large:
        s, g = small.pop(), large[-1]
        other[s] = g
        keep[g] -= 1 - keep[s]
        if keep[g] < 1:
            small.append(large.pop())
    return keep, other


def uniform(*keys: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def permuted(x: Column, n: Column, seed: Column, rounds: int = 12) -> Column:
    """The image of x in 0..n-1 under a permutation that depends on the seed: swap-or-not rounds."""
    def swap_or_not(at: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(i, seed), n) - at, n)
        return F.when(F.xxhash64(i, seed, F.greatest(at, partner)) % 2 == 0, partner).otherwise(at)
    return F.aggregate(F.array(*[F.lit(i) for i in range(rounds)]), x, swap_or_not)


def sized(docs: DataFrame, seed: int, per_part: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Rows with ``size``, a source number ``s`` and the word offset ``off`` within the source; and the sources.

    Offsets come from sums over parts of about ``per_part`` documents, so no source is summed in one task.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("size", count_words(F.col("text"))).withColumn("text_key", F.xxhash64("text"))
    rows = saved(rows.drop("text"), "sized")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(by_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    by_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goals = targets([r["words"] for r in by_source])
    sources = spark.createDataFrame(
        [(i, r["source"], r["words"], g, -(-r["rows"] // per_part)) for i, (r, g) in enumerate(zip(by_source, goals))],
        "s int, _source string, source_size long, target double, parts long",
    )
    rows = rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), "parts"))
    sums = rows.groupBy("s", "part").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "part", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("s", "part").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "size", "text_key")
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["s", "part"])
    return rows.withColumn("off", F.col("_start") + F.col("_within")).drop("part", "parts", "_start", "_within"), sources


def pieces(rows: DataFrame, block: int) -> DataFrame:
    """(…, block, start, words): the part of every document that lies in a block; start counts words of the document."""
    last = F.floor((F.col("off") + F.col("size") - 1) / F.lit(block)).cast("long")
    first = F.floor(F.col("off") / F.lit(block)).cast("long")
    rows = rows.where(F.col("size") > 0).withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("block") * block, F.col("off"))
    stop = F.least((F.col("block") + 1) * block, F.col("off") + F.col("size"))
    return rows.withColumn("start", start - F.col("off")).withColumn("words", stop - start)


def draw_slots(sources: DataFrame, block: int, per_shard: int, seed: int) -> DataFrame:
    """(s, shard, block): one row per output slot."""
    spark = sources.sparkSession
    src = sources.orderBy("s").collect()
    blocks = [-(-r["source_size"] // block) for r in src]
    goal = [slots_for(r["source_size"], r["target"], block) for r in src]
    total = sum(goal)
    if not total:
        return spark.createDataFrame([], "s int, shard long, block long")
    keep, other = alias_table([float(g) for g in goal])
    ids = spark.range(total).select(F.floor(F.col("id") / F.lit(per_shard)).cast("long").alias("shard"), "id")
    at = F.floor(uniform(F.lit(seed), F.lit("source"), F.col("id")) * len(src)).cast("int")
    table = F.array(*[F.struct(F.lit(k).alias("keep"), F.lit(o).alias("other")) for k, o in zip(keep, other)])
    ids = ids.withColumn("at", at).withColumn("entry", F.element_at(table, F.col("at") + 1))
    own = uniform(F.lit(seed), F.lit("alias"), F.col("id")) < F.col("entry.keep")
    drawn = ids.select("shard", F.when(own, F.col("at")).otherwise(F.col("entry.other")).alias("s"))
    counts = saved(drawn.groupBy("s", "shard").agg(F.count("*").alias("n")), "shard-counts")

    got = {r["s"]: r["n"] for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    over, short, surplus, missing = [], [], 0, 0
    for i, g in enumerate(goal):
        n = got.get(i, 0)
        over.append(surplus)  # number of the first surplus draw of this source
        surplus += max(0, n - g)
        if n < g:
            short.append((missing, i, n))  # first surplus draw it takes, source, its next slot
            missing += g - n
    plan = spark.createDataFrame(
        [(i, goal[i], over[i], blocks[i]) for i in range(len(src))], "s int, goal long, over long, n_blocks long")
    before = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = counts.repartition(max(partitions(spark), total // 1_000_000), "s", "shard")  # few rows that become many slots
    slots = counts.withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
    slots = slots.join(F.broadcast(plan), "s").drop("n_blocks")
    spare = F.col("over") + F.col("slot") - F.col("goal")  # number among all surplus draws, if any
    taker, moved = F.when(F.lit(False), F.lit(0)), F.when(F.lit(False), spare)
    for begin, i, nxt in reversed(short):
        taker, moved = taker.when(spare >= begin, F.lit(i)), moved.when(spare >= begin, spare - begin + nxt)
    fits = F.col("slot") < F.col("goal")
    slots = slots.select("shard", F.when(fits, F.col("s")).otherwise(taker).alias("s"), F.when(fits, F.col("slot")).otherwise(moved).alias("slot"))
    slots = slots.join(F.broadcast(plan.select("s", "n_blocks")), "s")
    pass_no = F.floor(F.col("slot") / F.col("n_blocks"))
    slots = slots.withColumn("key", F.xxhash64(F.lit(seed), "s", pass_no)).withColumn("at", F.pmod("slot", "n_blocks"))
    return slots.select("s", "shard", permuted(F.col("at"), F.col("n_blocks"), F.col("key")).alias("block"))


def mix(docs: DataFrame, block: int = 128, per_shard: int = 8192, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their place in the source, the pieces of documents in blocks, and the slots of the output shards.

    The mixture itself is ``slots.join(pieces, ["s", "block"])``: for each shard the word ranges of documents it holds.
    """
    rows, sources = sized(docs, seed)
    rows = saved(rows, "placed")
    return rows, pieces(rows.select("s", "doc_id", "text_key", "off", "size"), block), draw_slots(sources, block, per_shard, seed)


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) without the text, with size, source_size, target and taken.

    Further columns pass through whatever their names; one with the name of a result is replaced.
    """
    used = ["doc_id", "text", "source"]
    rows, parts, slots = mix(folded(docs, *used), **options)
    times = slots.groupBy("s", "block").agg(F.count("*").alias("times"))
    taken = parts.join(times, ["s", "block"]).groupBy("s", "off").agg(F.sum(F.col("words") * F.col("times")).alias("_taken"))
    taken = taken.withColumnsRenamed({"s": "_s", "off": "_off"})
    out = rows.join(taken, (F.col("s") == F.col("_s")) & (F.col("off") == F.col("_off")) & (F.col("size") > 0), "left")
    own = unfolded(docs, *used, results=("text", "size", "source_size", "target", "taken"))
    return out.select(*own, "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return taken_words(docs).select("doc_id", "size", "source_size", "target", "taken")
