"""Language identification in two levels: the family first, then the language among its close relatives.

Features are hashed counts of byte trigrams of the lower-cased letters, square-rooted and scaled to unit length. A linear
support vector machine per family (one against the rest) picks the family; within it, linear machines for every pair of
languages vote. All are trained here, on a bounded sample of the learnable labelled rows: about ``per_language`` rows of
each language (fewer if there are very many languages), chosen by the hash of the text. Prediction reads whole texts.

Cases: null text or text without a letter is ``und`` with score 0; with no labelled rows all texts are ``und``; a language
outside the table of families is a family of its own; further columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm.common import held_out, learns, table

# Families of some languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indo-aryan": "hi ur bn pa mr gu ne si",
    "semitic": "ar he am mt",
    "sinitic": "zh yue",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
BITS, CHUNK = 12, 1 << 20
ONLY_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed trigram counts."""
    data = text.lower().encode("utf-8", "surrogatepass").translate(ONLY_LETTERS)
    counts = np.zeros(1 << BITS)
    for start in range(0, max(len(data) - 2, 0), CHUNK):
        x = np.frombuffer(data[start:start + CHUNK + 2], np.uint8).astype(np.uint32)
        code = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
        code = code[code != 0x202020]
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    norm = np.sqrt(counts.sum())
    return (np.sqrt(counts) / norm if norm else counts).astype(np.float32)


def train_svm(x: np.ndarray, good: np.ndarray, c: float = 10.0, steps: int = 150) -> np.ndarray:
    """Linear machine with squared hinge loss and balanced classes, by accelerated gradient steps; last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = np.where(good, 1.0, -1.0).astype(np.float32)
    cost = (c / np.where(good, max(good.sum(), 1), max((~good).sum(), 1))).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    ahead, rate = w.copy(), 1.0 / (1.0 + 2 * float((cost * (x * x).sum(1)).sum()))
    for i in range(steps):
        gap = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (ahead - 2 * x.T @ (cost * y * gap))
        ahead, w = new + i / (i + 3) * (new - w), new
    return w


@dataclass
class Model:
    families: list[list[str]]
    first: np.ndarray  # one column of weights per family
    pairs: dict[tuple[str, str], np.ndarray]  # margin above 0: the first of the pair

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        margins = 3 * (x @ self.first)
        chance = np.exp(margins - margins.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        family = chance.argmax(1)
        names, scores = [""] * len(x), chance.max(1)
        for f, members in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            if not len(rows):
                continue
            wins = np.zeros((len(rows), len(members)))
            sums = np.zeros((len(rows), len(members)))
            for (i, a), (j, b) in combinations(enumerate(members), 2):
                p = 1 / (1 + np.exp(-3 * np.clip(x[rows] @ self.pairs[a, b], -10, 10)))
                wins[:, i] += p >= 0.5
                wins[:, j] += p < 0.5
                sums[:, i] += p
                sums[:, j] += 1 - p
            best = (wins + sums / (len(members) + 1)).argmax(1)
            share = sums[np.arange(len(rows)), best] / (len(members) - 1) if len(members) > 1 else 1.0
            scores[rows] *= share
            for r, b in zip(rows, best):
                names[r] = members[b]
        return names, scores


def fit(docs: DataFrame, per_language: int = 500, most_rows: int = 10_000) -> Model | None:
    train = docs.where(learns() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    counts = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = min(per_language, max(1, most_rows // len(counts)))
    chance = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(each / n))])
    sample = train.where(chance < F.element_at(share, F.col("lang")))

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t).tobytes())
    rows = sorted(sample.select("lang", packed("text").alias("x")).collect(), key=lambda r: (r["lang"], bytes(r["x"])))
    if not rows:  # a sample that missed every row of a tiny table
        rows = train.select("lang", packed("text").alias("x")).limit(each).collect()
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows])
    lang = np.array([r["lang"] for r in rows])
    groups: dict[str, list[str]] = {}
    for name in sorted(set(lang)):
        groups.setdefault(FAMILY.get(name, f"only {name}"), []).append(str(name))
    families = list(groups.values())
    first = [train_svm(x, np.isin(lang, m)) if len(families) > 1 else np.zeros(x.shape[1] + 1, np.float32) for m in families]
    pairs = {}
    for members in families:
        for a, b in combinations(members, 2):
            two = np.isin(lang, [a, b])
            pairs[a, b] = train_svm(x[two], lang[two] == a)
    return Model(families, np.stack(first, 1), pairs)


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred and score."""
    kind = "lang_pred string, score double"
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})

    @F.pandas_udf(kind)
    def guess(texts: pd.Series) -> pd.DataFrame:
        names, scores = [], []
        for start in range(0, len(texts), 256):
            part = [features(t or "") for t in texts.iloc[start:start + 256]]
            n, s = model.predict(np.stack(part))
            names += n
            scores += s.tolist()
        return pd.DataFrame({"lang_pred": names, "score": scores})
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = docs.withColumn("_g", guess("text"))
    return out.withColumns({
        "lang_pred": F.when(lettered, F.col("_g.lang_pred")).otherwise("und"),
        "score": F.when(lettered, F.col("_g.score")).otherwise(0.0),
    }).drop("_g")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predicted(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
