"""Language id, toxicity, top-k, mixing, pages, archives and the pipeline on small tables."""

import base64
import hashlib
import random
from collections import Counter

import brute
import pytest

from panelspark.llm import html_text, langid, mixing, topk, toxicity, warc

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.op1(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edge_cases(spark):
    rows = [(i, "the of and to in " * 5, "en") for i in range(40)] + [(100 + i, "der die und ist das " * 5, "de") for i in range(40)]
    rows += [(200 + i, "привет как дела " * 3, "ru") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !!", "x"), (4, "THE AND OF " * 100_000, "x"), (None, "das und die", "x")],
                                "doc_id long, text string, score_before string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en" and got[None][0] == "de"
    assert langid.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.predicted(odd, None).collect()} == {"und"}


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.op10(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in out)
    assert docs.count() and hits >= 0.85 * sum(r.toxic for r in out) and hits >= 0.9 * sum(r.predicted for r in out)


def test_toxicity_edge_cases(spark):
    rows = [(i, "plain words here and " * 5 + ("idiot moron " * 2 if i % 4 == 0 else "")) for i in range(200)] + [(None, None), (900, ""), (901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(0, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()}
    assert len(out) == 203 and all(0 <= r.score <= 1 for r in out.values())
    assert out[4].predicted == 1 and out[5].predicted == 0 and out[900].predicted == 0 and out[None].predicted == 0
    assert [(p.first, p.last) for p in out[4].passages] == [(20, 23)]
    none = toxicity.fit(docs.limit(0), labels.limit(0))
    assert {r.predicted for r in toxicity.scored(docs, none).collect()} == {0}


def best_segments(scores, low, high):
    """All maximal segments by splitting at the best (shortest) one."""
    best = max(((sum(scores[i:j]), i - j, -i) for i in range(low, high) for j in range(i + 1, high + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i = -best[2]
    j = i - best[1]
    return best_segments(scores, low, i) + [(i, j - 1, best[0])] + best_segments(scores, j, high)


def test_maximal_segments():
    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.choice([-1, -1, -1, 3, 8]) for _ in range(rng.randint(0, 25))]
        places = [i for i, s in enumerate(scores) if s > 0]
        got = toxicity.maximal_segments(places, [scores[i] for i in places], 1)
        want = best_segments(scores, 0, len(scores))
        assert len(got) == len(want) and sum(s for *_, s in got) == sum(s for *_, s in want)


VECTORS = "vec_id long, embedding array<float>, label int"


def test_top_k(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 460)]  # ties
    rows += [(500, None), (550, [1.0, None]), (600, [float("nan")] * 8), (650, [float("inf")] * 8), (700, [0.5, -0.5]), (750, []), (None, rows[0][1]), (100, rows[100][1])]
    rows += [(800, [1e6] * 8), (850, [-1e6, 2e6] * 4), (851, [3e5, -7e5, 1e6])]  # scores beyond 2^53
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    q = topk.quantised(table).cache()
    out = topk.top_k(q.where("vec_id % 50 = 0"), q, per_block=100, per_query_block=3)
    got = sorted({tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect()})
    want = brute.top_k([(i, None if v is None else [None if x is None else float(spark_float(x)) for x in v]) for i, v in rows])
    assert got == want
    assert topk.top_k(q.limit(0), q.limit(0)).count() == 0
    big = topk.quantised(spark.createDataFrame([(0, [1e9] * 8, 1)], VECTORS))
    with pytest.raises(ValueError):
        topk.top_k(big, big)


def spark_float(x):
    import struct
    return struct.unpack("f", struct.pack("f", x))[0]


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 400))), rng.choice(["a", "b", "c", "d", None])) for i in range(300)]
    rows += [(300, None, "a"), (301, "", "a"), (301, "", "a"), (302, "one two", "a"), (302, "one two", "a"), (303, "solo " * 7, "tiny"), (None, "x y z", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken_words(docs, block=16, per_shard=100).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len((t or "").split())) for d, t, _ in rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    for v in by.values():
        assert v[0].source_size == sum(r.size for r in v) and v[0].target <= 2 * v[0].source_size
        assert abs(sum(r.taken for r in v) - v[0].target) <= 32
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken_words(docs, block=16, per_shard=100).collect()))
    assert mixing.taken_words(docs.limit(0)).count() == 0


def test_targets_and_draws():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([0, 10]) == pytest.approx([0, 15]) and mixing.targets([]) == []
    keep, other = mixing.alias_table([5.0, 1.0, 0.0, 2.0])
    share = [sum((k if i == s else 0) + ((1 - k) if o == s and i != s else 0) for i, (k, o) in enumerate(zip(keep, other))) / 4 for s in range(4)]
    assert share == pytest.approx([5 / 8, 1 / 8, 0, 2 / 8])


def test_permutation(spark):
    from pyspark.sql import functions as F
    for n in (1, 2, 7, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long"))).collect()]
        assert sorted(got) == list(range(n))


PAGE = """<!doctype html><html><head><title>T</title><script>var a='<p>no</p>'</script></head><body class="x"><header>Site</header>
<nav><ul><li>Menu</ul></nav><div class="cookie-notice">Cookies?</div><article><h1>Head &amp; tail</h1><p>First
 para<b> bold</b><p>Second&nbsp;one<br>more<div class="promo-box">Buy</div><ul><li>a<li>b</ul><form><input value=1>Send</form>
<section id="comments"><p>first!</p></section></article><aside>Side</aside><footer>(c)</footer>"""


def test_main_text():
    got = html_text.main_text(html_text.read(PAGE), set())
    assert got.split("\n") == ["Head & tail", "First para bold", "Second one more", "a", "b"]
    for cut in range(0, len(PAGE), 7):
        html_text.main_text(html_text.read(PAGE[:cut]), set())
    assert html_text.main_text(html_text.read("just text"), set()) == "just text"


def test_templates_per_host(spark):
    rows = [(i, f"http://a.example/p{i}", f"<div><span>Welcome to A</span></div><div><p>Own text {i}</p></div>") for i in range(20)]
    rows += [(100 + i, f"http://b{i}.example/", "<div><span>Welcome to A</span></div>") for i in range(12)]
    rows += [(200, None, None), (201, "not a url", ""), (0, rows[0][1], rows[0][2])]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows)
    assert all(r.text == f"Own text {r.page_id}" for r in out if r.page_id < 100)
    assert all(r.text == "Welcome to A" for r in out if 100 <= r.page_id < 200) and all(r.text == "" for r in out if r.page_id >= 200)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archives(spark, tmp_path):
    body = "<p>wörld\r\n\r\nWARC/1.1\r\n\r\n</p>"
    rows = [(1, "http://www.A.example/x?y#z", body), (5, "http://a.example/x?y", body), (3, "http://b.example/a\nb", body), (2, None, None), (9, "u", ""),
            (7, "http://a.example/x?y", "x" * 200_000), (7, "http://a.example/x?y", "x" * 200_000), (None, "n", "only"), (None, "n", body)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, offset int").repartition(3)
    warc.write_archives(pages, str(tmp_path / "w"), per_file=2)
    got = warc.merged(warc.read_archives(spark, str(tmp_path / "w")), 3).collect()
    most = {}
    for p, _, h in rows:
        most[h or ""] = max(most.get(h or "", -1), -1 if p is None else p)
    def sha(h):
        return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = [(p, u, len((h or "").encode()), sha(h), "response" if (-1 if p is None else p) == most[h or ""] else "revisit",
             None if (-1 if p is None else p) == most[h or ""] else most[h or ""]) for p, u, h in rows]
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    keys = [(r.url_key, r.time, -1 if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys)
    warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.merged(warc.read_archives(spark, str(tmp_path / "e"))).count() == 0


def test_loser_tree():
    rng = random.Random(7)
    for _ in range(100):
        runs = [sorted((rng.randint(0, 9),) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 9))]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = {r.doc_id: r.text for r in toxicity.scored(docs, model).where("predicted = 0").collect()}
    left = {d: kept for d, _, _, kept in brute.lines(list(left.items()))}
    keep = {c for _, _, c in brute.simhash_components(list(left.items()))}
    left = {d: t for d, t in left.items() if d in keep}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = {d: n for d, n, hit, _ in brute.contamination(list(left.items()), items) if not hit}
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    assert all(r.source == rows[r.doc_id].source and r.size == len(left[r.doc_id].split()) and r.taken <= 2 * r.size for r in got)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "mixing"]
