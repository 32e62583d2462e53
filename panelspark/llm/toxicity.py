"""Toxic passages by maximum-scoring segments.

Learning: the number of labelled documents that hold a token, toxic and other, gives log-odds with a symmetric Dirichlet
prior and their standard error (all learnable labelled rows are counted, in Spark). Tokens whose log-odds are surely
positive and that occur in a fixed share of the toxic documents form the lexicon; that share bounds its size whatever the
corpus (a toxic document of n different tokens adds at most n, so there are at most n / share). Every other token costs a
constant drift, so the expected score of clean text is negative.

Scoring: one pass over the tokens finds all maximal segments in linear time (Ruzzo and Tompa). A segment of score S in a
document of n tokens has the normalised score lambda * S - ln(K * n) of the extreme-value law: lambda solves
sum p * exp(lambda * s) = 1 over the clean documents' tokens, K comes from the number of segments found in them. The
positive normalised scores of a document are summed, and a logistic curve fitted on binned sums of the learnable
documents turns the sum into a probability; documents without such a segment get the share of toxic ones among those.

Cases: null or empty text has no segment; labels are joined by doc_id, repeated labels count as their maximum, null
labels are not used; without toxic examples every score is the smoothed base rate; further columns pass through.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.llm.common import folded, held_out, learns, saved, small, table, unfolded

NOT_TOKEN = r"[^\p{L}\p{N}_]+"
TOKEN = re.compile(r"\w+")
STEM = 5  # longer tokens also count by their first five characters
PASSAGES = "n long, passages array<struct<first:int,last:int,score:double>>"


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)  # tokens, and stems with a star
    drift: float = 0.25
    lam: float = 1.0
    k: float = 1.0
    base: float = 0.0  # score without a significant segment
    a: float = 0.0
    b: float = 1.0


def maximal_segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal segments; ``places`` are the tokens with a positive score, ascending."""
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum at the end
    gained = 0.0
    for at, s in zip(places, scores):
        left = gained - drift * at  # sum of all tokens before
        first, last, right = at, at, left + s
        gained += s + drift
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                found.append((first, last, left, right))
                break
            first, left = found[j][0], found[j][2]
            del found[j:]
    return [(f, t, r - before) for f, t, before, r in found]


def segments_udf(model: Model):
    lexicon, drift = model.lexicon, model.drift
    stems = {t[:-1]: s for t, s in lexicon.items() if t[-1] == "*"}

    def score(token: str) -> float:
        return max(lexicon.get(token, 0.0), stems.get(token[:STEM], 0.0) if len(token) > STEM else 0.0)

    @F.pandas_udf(PASSAGES)
    def segments(texts: pd.Series) -> pd.DataFrame:
        counts, out = [], []
        for text in texts:
            tokens = TOKEN.findall(text.lower()) if text else []
            counts.append(len(tokens))
            places = [i for i, t in enumerate(tokens) if t[:STEM] in stems or t in lexicon]
            scores = [score(tokens[i]) for i in places]
            found = maximal_segments([i for i, s in zip(places, scores) if s], [s for s in scores if s], drift)
            out.append([{"first": f, "last": t, "score": s} for f, t, s in found])
        return pd.DataFrame({"n": counts, "passages": out})
    return segments


def evidence(model: Model) -> Column:
    """Sum of the positive normalised scores; null if there is none. Needs n and passages."""
    tail = F.log(F.lit(model.k) * F.greatest(F.col("n"), F.lit(1)))
    total = F.aggregate("passages", F.lit(0.0), lambda acc, p: acc + F.greatest(p["score"] * model.lam - tail, F.lit(0.0)))
    return F.when(total > 0, total)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.where(F.col("toxic").isNotNull() & learns()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(small(saved(known, "labels"), 24), "doc_id")


def fit_lexicon(train: DataFrame, prior: float = 0.5, sure: float = 2.5, least: float = 1.0, share: float = 0.003,
                min_docs: int = 3) -> tuple[Model, tuple[int, int]]:
    tokens = F.array_remove(F.array_distinct(F.split(F.lower("text"), NOT_TOKEN)), "")
    stems = F.transform(F.filter(tokens, lambda t: F.length(t) > STEM), lambda t: F.concat(F.substring(t, 1, STEM), F.lit("*")))
    tokens = F.array_union(tokens, stems)
    pairs = train.where(F.col("text").isNotNull()).select("toxic", F.explode(tokens).alias("token"))
    counts = saved(pairs.groupBy("token").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")), "token-counts")
    size = train.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    toxic, docs = int(size[0]), int(size[1])
    v, nt, n = (x or 0 for x in counts.agg(F.count("*"), F.sum("t"), F.sum("n")).first())
    model = Model()
    need = max(min_docs, math.ceil(share * toxic))
    if not toxic or toxic == docs or not v:
        return model, (toxic, docs)
    rows = counts.where(F.col("t") >= need).collect()
    t = np.array([r["t"] for r in rows], float)
    o = np.array([r["n"] - r["t"] for r in rows], float)
    all_prior = prior * v
    odds = np.log((t + prior) / (nt + all_prior - t - prior)) - np.log((o + prior) / (n - nt + all_prior - o - prior))
    z = odds / np.sqrt(1 / (t + prior) + 1 / (o + prior))
    good = (z >= sure) & (odds >= least)
    model.lexicon = {rows[i]["token"]: float(odds[i]) for i in np.flatnonzero(good)}
    p = (o[good] + prior) / max(n - nt + all_prior, 1.0)
    s = odds[good]
    model.drift = max(0.25, 2 * float((p * s).sum()))
    low, high = 0.0, 50.0  # lambda: the positive root
    for _ in range(100):
        mid = (low + high) / 2
        grown = float((p * np.exp(np.minimum(mid * s, 700))).sum()) + (1 - float(p.sum())) * math.exp(-mid * model.drift)
        low, high = (mid, high) if grown < 1 else (low, mid)
    model.lam = max(low, 1e-3)
    return model, (toxic, docs)


def logistic(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Ridge-penalised curve of good out of n at x."""
    w = np.array([0.0, 0.1])
    xs = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(xs @ w, -30, 30)))
        grad = xs.T @ (good - n * p) - 0.1 * (w - [0.0, 0.1])
        hess = (xs * (n * p * (1 - p))[:, None]).T @ xs + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -2, 2)
    return float(w[0]), float(max(w[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, **options) -> Model:
    train = labelled(docs, labels)
    model, (toxic, n_docs) = fit_lexicon(train, **options)
    model.base = (toxic + 0.5) / (n_docs + 5)
    if not model.lexicon:
        return model
    found = saved(train.select("toxic", segments_udf(model)("text").alias("s")).select("toxic", "s.*"), "train-passages")
    clean = found.where("toxic = 0").agg(F.sum("n"), F.sum(F.size("passages"))).first()
    lowest = min(model.lexicon.values())
    model.k = ((clean[1] or 0) + 1) / max(clean[0] or 1, 1) * math.exp(min(model.lam * lowest, 50))
    bins = found.select("toxic", F.round(evidence(model) * 4).alias("bin")).groupBy("bin").agg(
        F.sum("toxic").alias("toxic"), F.count("*").alias("n")).collect()
    none = next((r for r in bins if r["bin"] is None), None)
    if none:
        model.base = (none["toxic"] + 0.5) / (none["n"] + 5)
    some = [r for r in bins if r["bin"] is not None]
    if some:
        model.a, model.b = logistic(*(np.array([float(r[c]) / f for r in some]) for c, f in (("bin", 4), ("toxic", 1), ("n", 1))))
    return model


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score, predicted, n (tokens) and passages (first and last token, score).

    Further columns pass through whatever their names; one with the name of a result is replaced.
    """
    out = folded(docs, "text").withColumn("s", segments_udf(model)("text")).select("text", "row", "s.*")
    x = evidence(model)
    score = F.when(x.isNotNull(), 1 / (1 + F.exp(-(F.lit(model.a) + F.lit(model.b) * x)))).otherwise(F.lit(min(model.base, 1.0)))
    out = out.withColumn("score", score).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    results = ("n", "passages", "score", "predicted")
    return out.select(*unfolded(docs, "text", results=results), *results)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
