"""Encoding and decoding against the sentencepiece library: whole texts, odd characters, random ids."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from panelspark.llm import pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


ODD = ["\n", "\t", " ", "  ", "a", "the", "▁", "é", "漢", "😀", "\0", "</s>", "<0x0A>", " ", "\r", "e", "23", "''", "aaaa", "́"]


def test_odd_texts(model, library):
    rng, e = random.Random(3), pieces.Encoder(model)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(12))) for _ in range(4000)] + ["", " ", "   ", "▁"]
    for t in texts:
        found = [i for c in e.vocabulary.chunks(t) for i in e.vocabulary.merged(c)]
        assert found == library.encode(t), t
        assert e.vocabulary.text(found) == library.decode(found)


def test_rows_and_heaps_agree(model):
    rng, v = random.Random(4), pieces.Vocabulary(model)
    chunks = list({"".join(rng.choice("▁abethnio,.'é\nß9漢") for _ in range(rng.randrange(1, 44))) for _ in range(5000)} | {"a" * 32, "▁" * 20, "ab" * 20})
    got = v.merged_together(chunks)
    assert {c: pieces.array("i", x).tolist() for c, x in got.items()} == {c: v.merged(c) for c in chunks}


def test_random_ids_decode_as_the_library_does(model, library):
    rng, v = random.Random(5), pieces.Vocabulary(model)
    for _ in range(4000):  # bytes that form no character, names, marks
        ids = [rng.choice([rng.randrange(300), rng.randrange(32000), 259, 29871]) for _ in range(rng.randrange(8))]
        assert v.text(ids) == library.decode(ids), ids


def test_difference_from_the_library_raises(model):
    e = pieces.Encoder(model)
    e.check(e.vocabulary.merged_together(["▁the", "the", "▁", "▁▁x"]))
    with pytest.raises(RuntimeError):
        e.check(e.vocabulary.merged_together(["▁x"]) | {"▁the": b"abcd"})


def test_store_starts_anew(model, library):
    e = pieces.Encoder(model, remembered=10)
    for _ in range(3):
        texts = [" ".join(f"word{i}" for i in range(50)), None, "é"]
        assert e.encoded(pieces.pa.array(texts), True, False).to_pylist() == [library.encode(t or "") for t in texts]
        assert len(e.known) <= 10


@pytest.mark.parametrize("wrong", ["unigram", "broken"])
def test_other_vocabularies_raise(model, wrong):
    fields = b"\x12\x02\x18\x01" if wrong == "unigram" else b"\x0a\x05\n\x03abc"
    with pytest.raises(ValueError):
        pieces.Vocabulary(fields)


def test_tables(spark, model, library):
    rows = [(None, None, "x"), (1, None, "x"), (2, "", "x"), (3, "  two  spaces\n", "x"), (3, "  two  spaces\n", "x"), (4, "ab" * 60_000, "x"),
            (5, "word " * 50_000, "x"), (6, "漢字 😀\0", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = pieces.with_ids(docs, model)
    out = out.withColumn("back", pieces.decoder(model)("ids"))
    got = sorted(((r.doc_id, r.text, list(r.ids), r.back, r.n_tokens) for r in out.collect()), key=str)
    assert got == sorted(((d, t, library.encode(t or "", add_eos=True), t or "", x) for d, t, x in rows), key=str)
    assert pieces.with_ids(docs.limit(0), model).count() == 0
    assert pieces.with_ids(out, model).columns == out.columns
    assert spark.range(1).select(pieces.decoder(model)(F.lit(None).cast("array<int>"))).first()[0] == ""


def test_query(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = pieces.op11(spark, SF).collect()
    assert len(got) == len(docs)

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()
    for r in got:
        ids = library.encode(docs[r.doc_id] or "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_lists_are_decoded_from_the_flat_numbers(model):
    """Null lists, empty lists and a slice of a batch; no Arrow object per id."""
    v = pieces.Vocabulary(model)
    texts = ["Zwei Wörter", "a b  c", "中\U0001f600"]
    ids = [v.merged(v.prefix + t.replace(" ", pieces.MARK)) for t in texts]
    batch = pa.array([[5], ids[0], None, [], ids[1], ids[2], [7]], pa.list_(pa.int32())).slice(1, 5)
    assert pieces.decoded(v, batch).to_pylist() == [texts[0], "", "", texts[1], texts[2]]
    with pytest.raises((IndexError, TypeError)):
        pieces.decoded(v, pa.array([[10 ** 6]], pa.list_(pa.int32())))


def test_every_text_is_encoded_once(spark, model, library):
    """One call for ids and decoded text: the encoder stands once in the plan, not again under the decoder."""
    plan = pieces.op11(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and plan.split("ArrowEvalPython [")[1].split("]")[0].count("run(") == 1
    rows = [(1, None, "x"), (2, "", "x"), (3, " two  spaces\n", "x"), (4, "\u6f22\u5b57 \U0001f600\0", "x"), (5, "word " * 5000, "x")]
    out = pieces.with_round_trip(spark.createDataFrame(rows, "doc_id long, text string, decoded string"), model)
    assert out.columns == ["doc_id", "text", "decoded", "ids"]
    got = {r.doc_id: (list(r.ids), r.decoded) for r in out.collect()}
    assert got == {d: (library.encode(t or "", add_eos=True), t or "") for d, t, _ in rows}
