"""Ranked search against brute force: ties, repeated rows, nulls, very long texts, several passes."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from panelspark.llm import maxsketch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.decode() for t in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().lower())]


def brute(docs, items, k):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    out = []
    for item, text in {(i, frozenset(terms(t))) for i, t in items}:
        rows = []
        for d, c in counted:
            m = 100 - 50 + (50 * c.total() * n_docs) // n_terms
            score = 0
            for t in text:
                if c[t]:
                    df = sum(t in x for _, x in counted)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["Été", "été", "x9", "the", "THE", "漢字"]
    docs = [(None, "the w1 w2"), (None, None), (0, None), (1, ""), (2, " .,;"), (3, "w1 w2 w3"), (3, "w1 w2 w3"), (4, "W1-w2_w3"), (5, "w7 " * 3000 + "w8"),
            (6, " ".join(f"u{i}" for i in range(40_000)) + " w1"), (7, "x" * 100_000)]
    docs += [(i, " ".join(rng.choice(words) for _ in range(rng.choice([2, 5, 5, 40, 200])))) for i in range(8, 120)]
    items = [(f"i{j}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for j in range(12)]
    items += [("i0", "w7 w8"), ("i1", items[1][1]), ("none", None), ("empty", "..."), ("unknown", "nowhere"), (None, "w1"), ("the", "the")]
    return docs, items


@pytest.mark.parametrize("k,per_pass", [(5, 256), (50, 4)])
def test_search(spark, corpus, k, per_pass):
    docs, items = corpus
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, score string").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id string, text string, n int")
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in maxsketch.search(d, q, k, per_pass).collect()), key=str)
    assert got == brute(docs, items, k)


def test_empty(spark, corpus):
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id string, text string")
    assert maxsketch.search(d.limit(0), q).count() == 0
    out = maxsketch.search(d, q.limit(0))
    assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_hold(corpus):
    docs, _ = corpus
    rng, places = random.Random(2), maxsketch.Places()
    for _, text in docs:
        counts = Counter(maxsketch.terms((text or "").encode()))
        if counts:
            df = {t: rng.randint(1, 60) for t in rng.sample(sorted(counts), min(len(counts), 9))} | {b"absent": 3}
            q = maxsketch.Queries([("i", sorted(df))], df, 120, 9000)
            row = np.frombuffer(maxsketch.sketch(counts, places), np.uint8)[None, :]
            assert q.bounds(row, np.array([counts.total()]))[0, 0] >= q.scores(text.encode(), counts.total())[0] > 0


def test_terms_are_those_of_the_pattern():
    text = "".join(map(chr, range(0x250))) + " Ünï-CODE 9a_b 漢 字"
    assert [t.decode() for t in maxsketch.terms(text.encode())] == terms(text)
    assert terms(text) == ["".join(c.lower() if c.isascii() else c for c in t) for t in TERM.findall(text)]
