"""Benchmark decontamination: a BM25 index of the test items, pruned by block maxima, queried with every passage.

Items are cut into parts of at most ``part_words`` words. A passage (``passage_words`` words, half overlapping the next) is a
bag of terms; its BM25 score for a part is divided by the part's score for itself, so that one threshold serves all parts.
Retrieval is WAND-like and loses nothing above the threshold: the terms of a part, by falling weight, are essential until
those left weigh less than 0.4 of the threshold, so a passage reaches it only by essential terms; postings of essential
terms are kept in blocks of ``block`` parts with the block's largest weight, blocks whose summed maxima plus the largest rest stay
below the threshold are skipped, and the parts of the others are scored in full. Retrieved pairs are verified on the whole
document by the share of the item's 5-word shingles found in it, question (all but the last sentence) and answer (the last
sentence) each, or of the whole item if that is at least ``min_whole`` (a short answer has few shingles, all of which one changed
word can touch); an item of one sentence is all question. An item of fewer than five words is found where a sentence
or line of the document has just its words.

Words are compared lower-cased, without punctuation. Document frequencies and lengths are counted over all items, once. Items are indexed and
broadcast in shards of at most about ``shard_words`` words, however many there are; every shard meets every passage, and scores don't depend on the shards.

Defined cases: null and empty texts and items match nothing; very long texts are queried passage by passage; null doc_ids and
item_ids are reported as such; repeated items (one item_id) are tried each and reported once, with the best overlap; repeated
documents are reported each; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, table

TOKEN = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
LINE_END = re.compile(r"(?<=[.!?])\s+|\n")
PART_WORDS = 32
K1, B = 1.2, 0.75
SHINGLE = 5


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def shingles(tokens: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(tokens))
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} if n else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Tokens of all but the last sentence, and of the last; sentences without words don't count."""
    parts = [t for s in SENTENCE_END.split(text or "") if (t := tokens_of(s))]
    if len(parts) < 2:
        return [w for p in parts for w in p], []
    return [w for p in parts[:-1] for w in p], parts[-1]


def parts_of(tokens: list[str], part_words: int = PART_WORDS) -> list[list[str]]:
    n = math.ceil(len(tokens) / part_words)
    cuts = [len(tokens) * i // n for i in range(n + 1)] if n else [0]
    return [tokens[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Index:
    """The BM25 index of some items; threshold is a share of a part's score for itself.

    counts: (parts, their mean length, term -> parts that have it) of all items; those given, where it is None.
    """

    def __init__(self, items: list[tuple], threshold: float = 0.5, block: int = 4, rest: float = 0.4, counts: tuple | None = None):
        self.threshold, self.block = threshold, block
        self.items, self.parts, self.part_item = [], [], []
        self.short: dict[tuple[str, ...], list] = defaultdict(list)
        for item_id, text in items:
            tokens = tokens_of(text)
            if 0 < len(tokens) < SHINGLE:
                self.short[tuple(tokens)].append(item_id)
            if len(tokens) < SHINGLE:
                continue
            question, answer = question_and_answer(text)
            for part in parts_of(tokens):
                self.parts.append(part)
                self.part_item.append(len(self.items))
            self.items.append((item_id, shingles(question), shingles(answer), shingles(tokens)))
        df = Counter(t for p in self.parts for t in set(p))
        many, mean, df = counts or (len(self.parts), sum(map(len, self.parts)) / max(1, len(self.parts)), df)
        self.weights: list[dict[str, float]] = []
        for p in self.parts:
            norm = K1 * (1 - B + B * len(p) / mean)
            w = {t: math.log1p((many - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in Counter(p).items()}
            whole = math.fsum(w.values())
            self.weights.append({t: x / whole for t, x in w.items()})
        # term -> {block: largest weight of the term in the block, where it is essential}
        essential: dict[str, dict[int, float]] = defaultdict(dict)
        self.rest = np.zeros(math.ceil(len(self.parts) / block) + 1)
        for i, w in enumerate(self.weights):
            left, k = 1.0, i // block
            for t, x in sorted(w.items(), key=lambda tx: (-tx[1], tx[0])):
                if left < rest * threshold:
                    break
                essential[t][k] = max(x, essential[t].get(k, 0.0))
                left -= x
            self.rest[k] = max(self.rest[k], left)
        self.term = {t: i for i, t in enumerate(essential)}
        lists = [sorted(x.items()) for x in essential.values()]
        self.start = np.cumsum([0] + [len(x) for x in lists])
        self.blocks = np.array([k for x in lists for k, _ in x], dtype=np.int64)
        self.maxima = np.array([x for y in lists for _, x in y])

    def retrieve(self, tokens: list[str], passage_words: int = 64) -> dict[int, float]:
        """Item -> best score of a passage, for all items with a part that a passage scores at the threshold or more."""
        half = passage_words // 2
        known = np.fromiter((self.term.get(t, -1) for t in tokens), dtype=np.int64, count=len(tokens))
        at = np.flatnonzero(known >= 0)
        if not len(at):
            return {}
        # Each term once a passage; the passage that starts at half h holds the halves h and h + 1.
        last = max(0, math.ceil(len(tokens) / half) - 2)
        h = at // half
        passage = np.concatenate([np.minimum(h, last), np.clip(h - 1, 0, last)])
        once = np.unique(passage * (len(self.start) - 1) + np.concatenate([known[at]] * 2))
        passage, term = np.divmod(once, len(self.start) - 1)
        many = self.start[term + 1] - self.start[term]
        ends = np.cumsum(many)
        posting = np.arange(ends[-1]) + np.repeat(self.start[term] - ends + many, many)
        cell = np.repeat(passage, many) * len(self.rest) + self.blocks[posting]
        cells, where = np.unique(cell, return_inverse=True)
        bound = np.bincount(where, self.maxima[posting]) + self.rest[cells % len(self.rest)]
        best: dict[int, float] = {}
        of, bag = -1, set()
        for c in cells[bound >= self.threshold - 1e-9].tolist():
            p, k = divmod(c, len(self.rest))
            if p != of:
                of, bag = p, set(tokens[p * half : (p + 2) * half])
            for i in range(k * self.block, min(len(self.parts), (k + 1) * self.block)):
                w = self.weights[i]
                score = math.fsum(w[t] for t in w.keys() & bag)
                if score >= self.threshold - 1e-9:
                    item = self.part_item[i]
                    best[item] = max(score, best.get(item, 0.0))
        return best

    def verified(self, text: str | None, min_question: float, min_answer: float, passage_words: int, min_whole: float = 0.8) -> list[tuple]:
        tokens = tokens_of(text)
        found = self.retrieve(tokens, passage_words)
        own: dict[int, set] = {}  # shingles of the document by length
        rows: dict = {}
        for item, score in found.items():
            item_id, *kinds = self.items[item]
            shares = []
            for part in kinds:
                n = len(next(iter(part))) if part else 0
                if n and n not in own:
                    own[n] = {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)}
                shares.append(len(part & own[n]) / len(part) if part else 1.0)
            if shares[0] >= min_question and shares[1] >= min_answer or shares[2] >= min_whole:
                rows[item_id] = max(rows.get(item_id, (-1.0,)), (shares[0], shares[1], score))
        if self.short:
            for line in LINE_END.split(text or ""):
                for item_id in self.short.get(tuple(tokens_of(line)), ()):
                    rows.setdefault(item_id, (1.0, 1.0, 1.0))
        return [(k, *v) for k, v in rows.items()]


def leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, min_question: float = 0.5, min_answer: float = 0.5, min_whole: float = 0.8,
    passage_words: int = 64, shard_words: int = 2_000_000,
) -> DataFrame:
    """(doc_id, text), (item_id, text) -> one row per document and item that it holds: doc_id, item_id, question_overlap, answer_overlap, score."""
    texts, found = documents(docs), []
    schema = "doc_id long, item_id long, question_overlap double, answer_overlap double, score double"
    for index in indexes(benchmark, threshold, shard_words):

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            items = pickle.loads(index.value)
            for b in batches:
                ids = [None if pd.isna(d) else int(d) for d in b["doc_id"]]
                rows = [(d, *x) for d, t in zip(ids, b["text"], strict=True) for x in items.verified(t, min_question, min_answer, passage_words, min_whole)]
                out = pd.DataFrame(rows, columns=["doc_id", "item_id", "question_overlap", "answer_overlap", "score"])
                out[["doc_id", "item_id"]] = out[["doc_id", "item_id"]].astype("Int64")
                yield out

        found.append(texts.mapInPandas(search, schema))
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out


def indexes(benchmark: DataFrame, threshold: float, shard_words: int) -> Iterator:
    """Broadcast indexes of all items, each of at most about shard_words words: what the driver and a worker hold at once.

    They are pickled with their class, for executors that don't have this package.
    """
    spark = benchmark.sparkSession
    items = benchmark.where("text is not null").select("item_id", "text")
    words = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, math.ceil(words / 5 / shard_words))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, len(p), sorted(set(p))) for s, t in zip(b["shard"].tolist(), b["text"], strict=True) if len(x := tokens_of(t)) >= SHINGLE for p in parts_of(x)]
            yield pd.DataFrame(rows, columns=["shard", "words", "terms"])

    if shards > 1:
        parts = materialize(items.select("shard", "text").mapInPandas(count, "shard long, words long, terms array<string>"), "leak-parts")
        many, mean = parts.agg(F.count("*"), F.coalesce(F.avg("words"), F.lit(1.0))).first()
        terms = parts.select("shard", F.explode("terms").alias("term"))
        df = materialize(terms.groupBy("term").agg(F.count("*").alias("n")), "leak-terms")
    for shard in range(shards):
        own = [tuple(r) for r in items.where(F.col("shard") == shard).select("item_id", "text").collect()]
        counts = None
        if shards > 1:
            of_shard = terms.where(F.col("shard") == shard).select("term").distinct().join(df, "term")
            counts = (many, mean, {r["term"]: r["n"] for r in of_shard.collect()})
        yield spark.sparkContext.broadcast(cloudpickle.dumps(Index(sorted(own, key=repr), threshold, counts=counts)))


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, min_question: float = 0.5, min_answer: float = 0.5, min_whole: float = 0.8,
    passage_words: int = 64, shard_words: int = 2_000_000,
) -> DataFrame:
    """The rows of docs, with all columns, that hold no item. After each shard but the last the rest is written, so that a worker holds one index."""
    def cleaner(index):
        @F.pandas_udf("boolean")
        def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            items = pickle.loads(index.value)
            for texts in batches:
                yield pd.Series([not items.verified(t, min_question, min_answer, passage_words, min_whole) for t in texts], dtype="bool")

        return clean

    for i, index in enumerate(indexes(benchmark, threshold, shard_words)):
        docs = (materialize(docs, "leak-rest") if i else docs).where(cleaner(index)(F.col("text")))
    return docs


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
