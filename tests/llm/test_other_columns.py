"""Further columns of any name: they pass through, and those named as a result are replaced. Documents with many lines."""

import random
import time

import brute
import pytest
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, html_text, line_dedup, mixing, pieces, simhash, toxicity

NAMES = ["off", "s", "part", "target", "size", "_taken", "template", "n", "_lost", "lost", "left", "kept", "n_lines", "_d", "_t", "_key", "row", "fp",
         "root", "_node", "at", "sh", "n_hit", "n_words", "item", "text_key", "block", "words", "score", "ids", "t", "h1", "_own", "_host", "none"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"some words of document {i} and a few more words of it\nthis is a line of at least forty characters here", "ab"[i % 2]) for i in range(12)]
    df = spark.createDataFrame([*rows, (None, None, None)], "doc_id long, text string, source string")
    return df.select("*", *[F.concat(F.lit("mine "), F.col("doc_id").cast("string")).alias(c) for c in NAMES])


def run(spark, name, docs):
    items = spark.createDataFrame([(1, "words of document 3 and a few more words of it")], "item_id long, text string")
    if name == "lines":
        return line_dedup.dedup_lines(docs), {"kept", "n_lines", "n_dropped"}
    if name == "contamination":
        return decontaminate.contamination(docs, items), {*decontaminate.RESULTS, "text"}
    if name == "clean":
        return decontaminate.clean(docs, items), set()
    if name == "mixing":
        return mixing.taken_words(docs), {"size", "source_size", "target", "taken", "text"}
    if name == "simhash":
        return simhash.keep_one(docs), set()
    if name == "toxicity":
        labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
        return toxicity.scored(docs, toxicity.fit(docs.select("doc_id", "text"), labels)), {"n", "passages", "score", "predicted"}
    if name == "pages":
        return html_text.extract(docs.withColumnRenamed("text", "html").withColumn("url", F.lit("http://a/b"))), {"text"}
    with open(__import__("public_tokenizers").path("piece_bpe_32k.model"), "rb") as f:
        return pieces.with_ids(docs, f.read()), {"ids"}


@pytest.mark.parametrize("name", ["lines", "contamination", "clean", "mixing", "simhash", "toxicity", "pages", "pieces"])
def test_names(spark, docs, name):
    out, results = run(spark, name, docs)
    assert len(out.columns) == len(set(out.columns)) and set(NAMES) <= set(out.columns)
    rows = out.collect()
    assert rows and all(r[c] == (None if r["doc_id"] is None else f"mine {r['doc_id']}") for r in rows for c in NAMES if c not in results)
    assert all(r[c] is None or not str(r[c]).startswith("mine") for r in rows for c in results & set(out.columns))
    assert run(spark, name, docs.limit(0))[0].count() == 0


def test_documents_with_many_lines(spark):
    rng = random.Random(6)
    many = [f"line number {i} of a long document that others repeat" for i in range(20_000)]
    rows = [(d, "\n".join(many)) for d in range(5)] + [(5, "\n".join(rng.sample(many, 3000) + ["own line"] + many[:400])), (None, "\n".join(many[:600]))]
    rows += [(3, rows[3][1]), (6, many[0]), (7, None)]
    began = time.time()
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)
    assert got == brute.lines(rows) and time.time() - began < 120
