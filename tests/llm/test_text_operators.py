"""Line dedup, decontamination, substrings, SimHash: against plain Python, with nulls, empties, ties and repeated rows."""

import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, line_dedup, simhash, substrings

LONG = "this line is held by many documents and has Forty code points or more"
DOCS = "doc_id long, text string, source string, n_lines string"


def corpus():
    rng = random.Random(5)
    words = ["the", "of", "And", "to", "Été", "ñandú", "cat", "dog", "tree", "stone", "ß", "river", "7"]
    rows = [(None, None), (None, LONG), (0, None), (1, ""), (2, " \t\r\n "), (3, "one"), (3, "one"), (4, "two words"), (30, "x" * 200)]
    for i in range(5, 25):
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 90)))))
    for i in range(31, 38):
        rows.append((i, f"start {i}\n  {LONG.upper() if i % 2 else LONG}\t\nend {i}\n{LONG}"))
    base = " ".join(rng.choice(words) + str(i) for i in range(300))
    rows += [(40, base), (41, base), (42, base.replace("dog", "fox", 1)), (43, base + " tail"), (44, "head " + base[500:] + base[:300])]
    rows += [(45, "ab" * 400_000), (46, "a b " * 50)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "s", "clash") for d, t in corpus()], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def as_rows(df, *columns):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 3), (4, 2)])
def test_lines(docs, batches, fanout):
    out = line_dedup.dedup_lines(docs.drop("n_lines"), batches=batches, fanout=fanout)
    assert as_rows(out, "doc_id", "n_lines", "n_dropped", "kept") == brute.lines(corpus())


def test_no_lines(none):
    assert line_dedup.dedup_lines(none.drop("n_lines")).count() == 0


def test_runs_drop_known_keys(spark):
    index = line_dedup.LineRuns(spark, fanout=2)
    for batch in ([(9, 1, 1), (8, 1, 1), (9, 2, 2)], [(5, 1, 1), (4, 3, 3)], [(1, 1, 1), (1, 3, 3)]):
        index.add(spark.createDataFrame(batch, "doc_id long, h1 long, h2 long"))
    keys = spark.createDataFrame([(1, 1), (4, 4)], "h1 long, h2 long")
    assert as_rows(index.fresh(keys), "h1", "h2") == [(4, 4)]
    assert [len(level) for level in index.levels] == [1, 1]
    assert as_rows(index.frequent(2), "h1", "h2", "keeper") == [(1, 1, 9), (3, 3, 4)]


ITEMS = [(1, "cat dog tree stone river cat dog tree stone river end"), (10, "two words"), (2, "TWO words"), (None, "one"), (7, ""), (8, None),
         (9, "start 31 this line is held by many documents"), (9, "never seen at all in any of these texts here really")]


def test_contamination(spark, docs):
    extra = [(50, "so: CAT dog tree stone river cat, dog tree stone river end cat dog"), (51, "tree stone river cat dog tree stone river cat dog tree")]
    rows = docs.unionByName(spark.createDataFrame([(d, t, "s", "c") for d, t in extra], DOCS))
    out = decontaminate.contamination(rows, spark.createDataFrame(ITEMS, "item_id long, text string"))
    want = [(d, n, h, hashlib.sha256(i.encode()).hexdigest()) for d, n, h, i in brute.contamination(corpus() + extra, ITEMS)]
    assert as_rows(out, "doc_id", "n_words", "n_hit", "items_sha256") == sorted(want, key=str)
    kept = {r.doc_id for r in decontaminate.clean(rows, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert 50 not in kept and 4 not in kept and 40 in kept


def test_contamination_of_nothing(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(none, items).count() == 0
    out = decontaminate.contamination(docs, items.limit(0))
    assert out.count() == docs.count() and out.where("contaminated").count() == 0


@pytest.mark.parametrize("heavy", [2_000, 3])
def test_substrings(docs, monkeypatch, heavy):
    monkeypatch.setattr(substrings, "HEAVY", heavy)
    monkeypatch.setattr(substrings, "SHARD", 2_000)
    rows = [(d, t) for d, t in corpus() if d != 45] + [(47, "ab" * 300)]
    table = docs.sparkSession.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")
    out = substrings.dedup_strings(table)
    assert as_rows(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == brute.substrings(rows)


def test_long_text_in_segments():
    rng = random.Random(2)
    data = bytes(rng.randrange(97, 123) for _ in range(substrings.SEGMENT + 5_000))
    parts = list(substrings.segments([b"short", data, data[-300:]]))
    assert len(parts) == 2
    found = [[(int(h), int(f) + p[j][1] - p[j][2], p[j][0]) for h, f, j in zip(x.hash, x.first, x.piece)]
             for d, p in parts for x in [substrings.Anchors(d, p)]]
    assert len({h for h, *_ in found[0]}) > 0.99 * len(found[0]) and len(found[0]) < 0.12 * len(parts[0][0])
    of_tail = {h for h, _, text in found[1] if text == 2}
    assert of_tail and of_tail <= {h for h, at, text in found[1] if text == 1}


def test_suffix_array_and_common_prefixes():
    rng = random.Random(3)
    for letters in (b"ab", b"\x00a", b"abcdef"):
        for _ in range(20):
            b = bytes(rng.choice(letters) for _ in range(rng.randint(1, 150)))
            data = np.frombuffer(b, np.uint8)
            sa = substrings.suffix_array(data)
            assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
            cuts = sorted({0, rng.randrange(len(b))})
            lcp = substrings.common_prefixes(data, sa, np.array(cuts), np.diff([*cuts, len(b)]), 50)
            for x, y in zip(sa[:-1], sa[1:]):
                same = next((k for k in range(51) if k == 50 or b[x + k:x + k + 1] != b[y + k:y + k + 1]
                             or not b[x + k:x + k + 1]), 50)
                assert lcp[y] == same


def test_no_substrings(none):
    assert substrings.dedup_strings(none).count() == 0


def test_simhash(docs):
    out = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id")
    assert as_rows(out, "doc_id", "f", "component_id") == brute.simhash_components(corpus())


def test_keep_one(docs, none):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 40 in ids and 41 not in ids and 0 in ids and 1 not in ids
    assert simhash.keep_one(none).count() == 0


def test_every_link_has_a_common_anchor():
    rng = np.random.default_rng(1)
    x = rng.integers(-2**63, 2**63 - 1, 300, dtype=np.int64)
    y = x.view(np.uint64).copy()
    for i in range(300):
        for bit in rng.choice(64, 2, replace=False)[:i % 3]:
            y[i] ^= np.uint64(1) << np.uint64(bit)
    for a, b in zip(simhash.anchors_of(x), simhash.anchors_of(y.view(np.int64))):
        assert set(a) & set(b) and len(set(a)) in (1, 32)


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(20)] + [(51, 50)], "a long, b long")
    assert {r.root for r in simhash.components(edges).where("node <= 20").collect()} == {0}
