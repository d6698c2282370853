"""Suffix and relative Lempel-Ziv deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest

from locusframe.llm import repeats as rp
from locusframe.llm.anchors import anchors, digests, names_of
from locusframe.llm.relz import greedy_factors, parse_factors, word_names, word_symbols
from locusframe.llm.suffix import byte_symbols, dedup_substrings

SCHEMA = "doc_id long, text string, doc string, version string, start string, kept string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "d", "v", "s", "k") for i, t in docs], SCHEMA)


def corpus(seed, n=60, words=None):
    """Texts that share passages, lines and whole copies, some short, empty or long."""
    r = random.Random(seed)
    vocabulary = words or ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(200)]
    passage = [" ".join(r.choice(vocabulary) for _ in range(k)) for k in (9, 14, 40, 90)]
    out = []
    for i in range(n):
        parts = [r.choice([" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 30))), r.choice(passage), r.choice(passage)[r.randint(0, 20) :]]) for _ in range(r.randint(0, 6))]
        out.append((i, r.choice([" ", "\n", "  "]).join(parts)))
    for i in range(n, n + 12):
        t = out[r.randrange(n)][1]
        out.append((i, t if r.random() < 0.5 else t[: len(t) // 2] + "x" + t[len(t) // 2 :]))
    out += [(n + 20, None), (n + 21, ""), (n + 22, "ab " * 900), (n + 23, "z" * 3000), (n + 24, "ab " * 700), (None, out[3][1]), (7, out[7][1]), (n + 25, "퟿🙂" * 60)]
    r.shuffle(out)
    return out


def order(i):
    return -(2**63) if i is None else i


def brute_bytes(docs, window=100):
    first = {}
    bodies = [(order(i), (t or "").encode()) for i, t in docs]
    for i, b in bodies:
        for j in range(len(b) - window + 1):
            k = b[j : j + window]
            first[k] = min(first.get(k, (i, j)), (i, j))
    out = []
    for i, b in bodies:
        gone = [False] * len(b)
        for j in range(len(b) - window + 1):
            if first[b[j : j + window]] < (i, j):
                gone[j : j + window] = [True] * window
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_words(docs, window=13):
    first = {}
    bodies = [(order(i), (t or "").encode().split()) for i, t in docs]
    for i, w in bodies:
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in bodies:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    docs = corpus(seed)
    out = dedup_substrings(frame(spark, docs)).collect()
    assert sorted((order(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == brute_bytes(docs)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in out)


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    docs = corpus(seed)
    out = parse_factors(frame(spark, docs)).collect()
    assert sorted((order(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == brute_words(docs)
    check_factors(docs, out)


def check_factors(docs, out):
    """Factors cover what is removed, each is found where it says, and every word of it lies in a window that is found."""
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).append((t or "").encode().split())
    covered = 0
    for r in out:
        end = 0
        for f in r["factors"]:
            assert f["first"] >= end and f["end"] > f["first"] and order(f["reference"]) < order(r["doc_id"])
            end = f["end"]
            covered += end - f["first"]
            n = end - f["first"]
            assert any(w[f["first"] : end] == x[f["at"] : f["at"] + n] for w in texts[r["doc_id"]] for x in texts[f["reference"]])
        assert sum(f["end"] - f["first"] for f in r["factors"]) == r["n_removed"]
    return covered


def test_greedy_factors():
    # Two runs that go on in one reference are one factor; of two that straddle its end the one that reaches furthest is next.
    runs = tuple(np.array([(3, 2, 7, 43), (0, 3, 7, 40), (5, 1, 2, 0), (60, 1, 1, 5), (6, 4, 3, 9)]).T)
    assert greedy_factors(runs, 13) == [(0, 17, 7, 40), (17, 22, 3, 20), (60, 73, 1, 5)]
    assert greedy_factors(tuple(x[:0] for x in runs), 13) == []


def thue_morse(n):
    """Strings on which sums of powers modulo 2^64 collide with their complements."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return bits, [1 - x for x in bits]


def test_adversarial_words(spark):
    a, b = (["".join("ab"[x] for x in bits)] for bits in thue_morse(512))
    head = [f"w{i}" for i in range(12)]
    out = {r["doc_id"]: r["n_removed"] for r in parse_factors(frame(spark, [(1, " ".join(head + a)), (2, " ".join(head + b))])).collect()}
    assert out == {1: 0, 2: 0}
    texts = [" ".join(["yes", "no"][x] for x in bits) for bits in thue_morse(512)]
    docs = list(enumerate(texts))
    out = parse_factors(frame(spark, docs)).collect()
    assert sorted((order(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == brute_words(docs)
    docs = [(i, "".join("xy"[x] for x in bits)) for i, bits in enumerate(thue_morse(1024))]
    out = dedup_substrings(frame(spark, docs)).collect()
    assert sorted((order(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == brute_bytes(docs)


def test_few_distinct_words(spark):
    docs = corpus(5, 30, ["a", "b"])
    out = parse_factors(frame(spark, docs)).collect()
    assert sorted((order(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == brute_words(docs)
    assert check_factors(docs, out) > 0
    out = dedup_substrings(frame(spark, docs)).collect()
    assert sorted((order(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == brute_bytes(docs)


def test_batches_and_crowds_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(rp, "CROWD", 3)
    monkeypatch.setattr(rp, "SPREAD", 4)
    monkeypatch.setattr(rp, "BATCH", 300)
    docs = corpus(9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        a = dedup_substrings(frame(spark, docs)).collect()
        b = parse_factors(frame(spark, docs)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((order(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in a) == brute_bytes(docs)
    assert sorted((order(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in b) == brute_words(docs)


def test_one_id_with_two_texts(spark):
    passage = "p" * 150
    docs = [(1, passage + "x"), (1, "yy" + passage), (2, passage)]
    out = dedup_substrings(frame(spark, docs)).collect()
    assert sorted((order(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == brute_bytes(docs)


def test_nothing(spark):
    assert dedup_substrings(frame(spark, [])).count() == 0
    assert parse_factors(frame(spark, [])).count() == 0


def test_equal_windows_have_equal_anchors():
    r = random.Random(4)
    a = bytes(r.choice(b"abc ") for _ in range(2000))
    b = bytes(r.choice(b"abc ") for _ in range(333)) + a[500:900] + b"tail"
    served = []
    for body in (a, b):
        pieces = anchors(byte_symbols(body).names, 24, 100, piece=130)
        _, at, low, high = (np.concatenate(x) for x in zip(*pieces))
        served.append({s: p - s for p, lo, hi in zip(at, low, high) for s in range(lo, hi + 1)})
        assert sorted(served[-1]) == list(range(len(body) - 99))
    assert all(served[0][500 + i] == served[1][333 + i] for i in range(301))


def test_names():
    body = b"one two  one\ttwo\x0bone three" + "é".encode()
    words = word_names(body)
    assert len(words) == len(body.split()) and words[0] == words[2] == words[4] and words[1] == words[3] and len(set(words.tolist())) == 3
    grams = names_of(words, 2)
    assert grams[0] == grams[2] and grams[0] != grams[1]
    both = word_symbols(body)
    assert both.data == b" ".join(body.split()) and [both.data[x:y] for x, y in zip(both.starts, both.ends)] == body.split()
    x, y = both.digests(np.array([0, 2, 1]), np.array([2, 4, 3]))
    assert (x[0], y[0]) == (x[1], y[1]) != (x[2], y[2]) and (x[0], y[0]) == tuple(z[0] for z in digests(b"one two", np.array([0]), np.array([7])))
    assert len(word_names(b" \n")) == 0
