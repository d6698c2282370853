"""Toxicity: logistic regression on presence of words and word beginnings, regularised by counterfactual swaps of identity terms.

Training takes at most ``train_docs`` labelled documents (lowest hash of doc_id), whose distinct lower-cased words and
their first 3 to 6 characters (for inflected forms) are the features; documents with just the same words count once. Of the features whose chi-square against the label
is larger than chance would make the largest of as many features, but in one of 1 / ``chance`` samples, the ``n_features`` with the largest are kept, and all identity terms. Labels may be wrong: after a first fit, every
document weighs as much as the first fit believes its label (``least`` at least) and the weights are fitted anew. Every labelled sentence with an identity term is paired with copies in which the term is swapped for the others of
its group; the loss adds ``swap_penalty`` times the mean squared change of the logit over all pairs, in which whole words and
beginnings change, so that mentions of a group carry no weight of their own. Scoring reads whole texts.

Defined cases: null and empty texts have no words and get the intercept's score; without training labels of both kinds the
score is the share of toxic ones (0 if there are none); a document with several labels counts as toxic if any says so; null
labels are ignored; very long texts are scored whole; null doc_ids are scored (as held out or not by the checksum of the empty string) and have no labels; repeated rows are scored alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, table

WORDS = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?\n]+")
#: Terms of one line may stand for each other in a sentence.
IDENTITY = [
    "women men girls boys females males",
    "muslims christians jews hindus buddhists atheists",
    "muslim christian jewish hindu buddhist atheist",
    "black white asian latino arab african european american",
    "gay lesbian straight bisexual transgender",
    "immigrants refugees foreigners natives citizens",
    "frauen männer mädchen jungen",
    "juden muslime christen",
    "femmes hommes filles garçons",
    "juifs musulmans chrétiens",
    "mujeres hombres niñas niños",
    "judíos musulmanes cristianos",
]
GROUPS = [x.split() for x in IDENTITY]
GROUP_OF = {w: g for g in GROUPS for w in g}


#: A feature is written as its length, a colon and the beginning; 0 stands for the whole word.
LENGTHS = (0, 3, 4, 5, 6)


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


def swaps_of(text: str | None) -> list[str]:
    """Identity terms of the text, once for each sentence with them."""
    low = (text or "").lower()
    if GROUP_OF.keys().isdisjoint(WORDS.findall(low)):
        return []
    return [w for s in SENTENCE.split(low) for w in sorted(GROUP_OF.keys() & set(WORDS.findall(s)))]


def features_of(words: set[str]) -> set[str]:
    return {f"{n}:{w[:n] if n else w}" for w in words for n in LENGTHS if len(w) >= n}


def changes_of(text: str | None) -> list[str]:
    """For each swap in each sentence the features that go, a tab and those that come; separated by spaces."""
    low = (text or "").lower()
    if GROUP_OF.keys().isdisjoint(WORDS.findall(low)):
        return []
    out = []
    for s in SENTENCE.split(low):
        words = set(WORDS.findall(s))
        for w in sorted(GROUP_OF.keys() & words):
            group = set(GROUP_OF[w])
            # Only these features can change; other words of the sentence may hold some of them.
            rest = features_of(words - {w}) & features_of(group)
            for v in GROUP_OF[w]:
                if v != w:
                    old, new = features_of({w}) - rest, features_of({v}) - rest
                    out.append(" ".join(sorted(old - new)) + "\t" + " ".join(sorted(new - old)))
    return out


def fit_weights(x: np.ndarray, y: np.ndarray, swaps: np.ndarray, l2: float = 0.3, swap_penalty: float = 1.0, rounds: int = 25, trust: np.ndarray | None = None):
    """Newton's method for mean log loss (rows weighted by trust) + l2 / 2n |w|^2 + swap_penalty / 2 mean (swap . w)^2; the last weight is the intercept."""
    n, k = x.shape
    x = np.hstack([x, np.ones((n, 1))])
    ridge = np.full(k + 1, l2 / n)
    ridge[-1] = 1e-9
    curve = np.diag(ridge)
    if len(swaps):
        curve[:k, :k] += swap_penalty * swaps.T @ swaps / len(swaps)
    w = np.zeros(k + 1)
    trust = np.ones(n) if trust is None else trust
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (trust * (p - y)) / n + curve @ w
        hess = (x * (trust * p * (1 - p) / n)[:, None]).T @ x + curve
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        words = [sorted(words_of(t)) for t in b["text"]]
        low = [hashlib.blake2b(" ".join(w).encode("utf-8", "replace"), digest_size=16).hexdigest() for w in words]
        yield pd.DataFrame({"id": b["id"], "toxic": b["toxic"], "copy": low, "words": words, "swaps": [changes_of(t) for t in b["text"]]})


def _beginnings(n: int):
    """The features of length n of the column words."""
    long = F.filter("words", lambda w: F.length(w) >= n)
    return F.transform(long, lambda w: F.concat(F.lit(f"{n}:"), F.substring(w, 1, n) if n else w))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = 12_000, n_features: int = 512, min_docs: int = 5, chance: float = 0.001, least: float = 0.05, **fit) -> dict:
    """Labels (doc_id, toxic) are all for training -> {"bias": float, "weights": {length: {beginning: float}}}."""
    marks = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    dealt = F.xxhash64("doc_id", F.lit("toxicity"))
    marks = marks.orderBy(dealt, "doc_id").limit(train_docs)  # the bound of the broadcast
    sample = documents(docs).join(F.broadcast(marks), "doc_id").select(F.xxhash64("doc_id", "text").alias("id"), "toxic", "text")
    found = sample.mapInPandas(_features, "id long, toxic int, copy string, words array<string>, swaps array<string>")
    one = found.groupBy("copy").agg(F.min_by(F.struct("id", "toxic", "words", "swaps"), F.struct("id", "toxic")).alias("one"))
    rows = materialize(one.select("one.*"), "toxic-words")
    totals = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    n, bad = totals["n"], totals["bad"] or 0
    if not 0 < bad < n:
        return {"bias": math.log((bad + 1e-3) / (n - bad + 1e-3)) if n else -30.0, "weights": {}}
    # chi-square of presence against the label
    a, df = F.col("bad"), F.col("df")
    b, c = df - a, bad - a
    d = n - bad - b
    chi = n * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) * float(bad) * float(n - bad))
    pieces = F.concat(*(_beginnings(n) for n in LENGTHS))
    rows = rows.withColumn("features", F.array_distinct(pieces))
    tried = (
        rows.select("toxic", F.explode("features").alias("word"))
        .groupBy("word")
        .agg(F.count("*").cast("double").alias("df"), F.sum("toxic").cast("double").alias("bad"))
        .where((F.col("df") >= min_docs) & (F.col("df") < n))
    )
    tried = materialize(tried, "toxic-features")
    # The chi-square that one of so many features exceeds by chance with that probability.
    least_chi = NormalDist().inv_cdf(1 - chance / 2 / max(1, tried.count())) ** 2
    top = (
        tried.where(chi >= least_chi)
        .orderBy(chi.desc(), "word")
        .limit(n_features)
    )
    vocabulary = list(dict.fromkeys([r["word"] for r in top.collect()] + [f"0:{w}" for g in GROUPS for w in g]))
    place = {w: i for i, w in enumerate(vocabulary)}
    # At most train_docs rows with words of the vocabulary only.
    known = F.array(*(F.lit(w) for w in vocabulary))
    kept = rows.orderBy("id").select("toxic", F.array_intersect("features", known).alias("features")).collect()
    x, y = np.zeros((len(kept), len(vocabulary)), dtype=np.float64), np.array([float(r["toxic"] > 0) for r in kept])
    for i, r in enumerate(kept):
        x[i, [place[w] for w in r["features"]]] = 1
    # As many rows as there are pairs of terms, times the sets of beginnings that other words of a sentence hold.
    pairs = rows.select(F.explode("swaps").alias("swap")).groupBy("swap").agg(F.count("*").alias("times")).orderBy("swap").collect()
    swaps = np.zeros((len(pairs), len(vocabulary)))
    for i, r in enumerate(pairs):
        for sign, names in zip((-1, 1), r["swap"].split("\t"), strict=True):
            swaps[i, [place[f] for f in names.split() if f in place]] = sign * math.sqrt(r["times"])
    w = fit_weights(x, y, swaps, **fit)
    believed = 1 - np.abs(y - 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))
    w = fit_weights(x, y, swaps, trust=np.maximum(believed, least), **fit)
    weights: dict[int, dict[str, float]] = {n: {} for n in LENGTHS}
    for v, i in place.items():
        length, _, piece = v.partition(":")
        weights[int(length)][piece] = float(w[i])
    return {"bias": float(w[-1]), "weights": weights}


def score_text(text: str | None, model: dict) -> float:
    words, found = words_of(text), []
    for n, weights in model["weights"].items():
        if weights:
            found += [weights[w] for w in weights.keys() & ({w[:n] for w in words if len(w) >= n} if n else words)]
    z = model["bias"] + math.fsum(found)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def scorer(spark: SparkSession, model: dict):
    """A function from a text column to its score."""
    shared = spark.sparkContext.broadcast(model)  # at most n_features features and the identity terms

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([score_text(t, shared.value) for t in texts], dtype="float64")

    return scored


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out documents are not learnt from."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))), **options)
    scored = documents(docs).withColumn("score", scorer(docs.sparkSession, model)("text"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5, **options) -> DataFrame:
    """The rows of docs, with all columns, that score below limit."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))), **options)
    return docs.where(scorer(docs.sparkSession, model)(F.col("text")) < limit)


def op10_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
