"""Near-duplicates against brute force."""

import random

import numpy as np
import pytest

from locusframe.llm import ordermin
from locusframe.llm.ordermin import alike, banded_distance, components, keep_one_of_each, near_duplicates, sketches
from locusframe.llm.relz import word_names

SCHEMA = "doc_id long, text string, content string, words string, class_id string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "c", "w", "x") for i, t in docs], SCHEMA)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        i = r.randrange(len(words) + 1)
        what = r.random()
        if what < 0.4 and words:
            words[min(i, len(words) - 1)] = f"new{r.randrange(10**6)}"
        elif what < 0.7:
            words.insert(i, f"more{r.randrange(10**6)}")
        elif words:
            del words[min(i, len(words) - 1)]
    return words


def test_banded_distance():
    r = random.Random(1)
    for _ in range(1500):
        s = r.choice([2, 3, 8])
        a = [r.randrange(s) for _ in range(r.randrange(40))]
        b = edited(r, a, r.randrange(8)) if r.random() < 0.7 else [r.randrange(s) for _ in range(r.randrange(40))]
        d = distance(a, b)
        for band in (0, 1, 2, 3, 5, 9, 50):
            found = banded_distance(a, b, band)
            assert found == d if d <= band else found > band


def test_groups(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    docs, truth = [], {}
    for g in range(25):
        base = [r.choice(words) for _ in range(r.choice([3, 40, 120, 400]))]
        for k in range(r.choice([1, 2, 9])):
            # Up to 5 % of the words edited against the first of the group.
            text = edited(r, base, r.randrange(len(base) // 20 + 1)) if k else base
            truth[len(docs)] = g
            docs.append((len(docs), " ".join(text)))
    # A passage in many texts makes no class: it is a small part of each.
    passage = " ".join(r.choice(words) for _ in range(40))
    for _ in range(60):
        truth[len(docs)] = len(docs) + 1000
        docs.append((len(docs), passage + " " + " ".join(r.choice(words) for _ in range(120))))
    out = {x["doc_id"]: x for x in near_duplicates(frame(spark, docs)).collect()}
    least = {}
    for i, g in truth.items():
        least.setdefault(g, i)
    assert {i: x["class_id"] for i, x in out.items()} == {i: least[g] for i, g in truth.items()}
    for i, x in out.items():
        assert x["class_size"] == sum(g == truth[i] for g in truth.values())


def test_no_link_is_lost_in_a_large_group_of_copies(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(4000)}" for _ in range(150)]
    docs = [(i, " ".join(edited(r, base, r.randrange(8)))) for i in range(300)] + [(i, " ".join(base)) for i in range(300, 500)]
    out = near_duplicates(frame(spark, docs)).collect()
    assert {x["class_id"] for x in out} == {0} and {x["class_size"] for x in out} == {500}


def test_crowded_buckets_lose_no_pair(spark):
    """Pages of one template, most too far apart to be linked, crowd the buckets of the pairs that are near by chance or because they were made so."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    page = lambda: [w if r.random() < 0.86 else f"p{r.randrange(10**6)}" for w in base]
    texts = [page() for _ in range(240)]
    for _ in range(30):
        near = page()
        places = set(r.sample(range(200), 36))
        texts += [near, [f"n{r.randrange(10**6)}" if i in places else w for i, w in enumerate(near)]]
    buckets, linked = {}, set()
    for i, t in enumerate(texts):
        for b in sketches(word_names(" ".join(t).encode())).tolist():
            buckets.setdefault(b, []).append(i)
    for i, j in sorted({(i, j) for m in buckets.values() for i in m for j in m if i < j}):
        if alike(texts[i], texts[j], 0.8):
            linked.add((i, j))
    assert len(linked) > 15 and max(map(len, buckets.values())) > 50
    df = frame(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
    out = {x["doc_id"]: x["class_id"] for x in near_duplicates(df).collect()}
    assert all(out[i] == out[j] for i, j in linked)
    # No class holds what links don't join: each member is near another one.
    groups = {}
    for i, c in out.items():
        groups.setdefault(c, []).append(i)
    assert all(any(alike(texts[i], texts[j], 0.8) for j in g if i != j) for g in groups.values() if len(g) > 1 for i in g)


@pytest.mark.parametrize("even", [False, True])
def test_recall_at_the_threshold(spark, even):
    """Pairs of 10 to 400 words that are just similar enough are found, whether edits are spread evenly or at random."""
    r = random.Random(7)
    docs, pairs = [], {}
    for n in (5, 10, 11, 14, 20, 50, 100, 400):
        for _ in range(30):
            a, e = [f"w{r.randrange(10**9)}" for _ in range(n)], n // 5
            places = {i * n // e for i in range(e)} if even else set(r.sample(range(n), e))
            b = [f"n{r.randrange(10**9)}" if i in places else w for i, w in enumerate(a)]
            pairs.setdefault(n, []).append(len(docs))
            docs += [(len(docs), " ".join(a)), (len(docs) + 1, " ".join(b))]
    out = {x["doc_id"]: x["class_id"] for x in near_duplicates(frame(spark, docs)).collect()}
    found = {n: sum(out[i + 1] == i for i in at) / len(at) for n, at in pairs.items()}
    assert min(found.values()) >= 0.8 and sum(found.values()) / len(found) >= 0.9, found
    assert sum(i != c for i, c in out.items()) == sum(round(found[n] * len(at)) for n, at in pairs.items())


def test_complements_are_no_copies(spark):
    """Texts whose sums of powers modulo 2^64 are equal, but not a word of which is."""
    bits = [bin(i).count("1") % 2 for i in range(512)]
    out = near_duplicates(frame(spark, [(k, " ".join(["yes", "no"][x ^ k] for x in bits)) for k in (0, 1)])).collect()
    assert {x["doc_id"]: x["class_id"] for x in out} in ({0: 0, 1: 1}, {0: 0, 1: 0})
    assert all(alike(*([str(x ^ k) for x in bits] for k in (0, 1)), 0.8) == (x["class_size"] == 2) for x in out)
    kept = keep_one_of_each(frame(spark, [(None, "one text of no id"), (None, "quite another one"), (None, "one text of no id")])).collect()
    assert sorted(x["text"] for x in kept) == ["one text of no id", "quite another one"]


@pytest.mark.parametrize("block", [3, 1024])
def test_tiles_compare_all_members(spark, monkeypatch, block):
    """Whatever the size of a block, every pair of a bucket that is in different classes is compared; word counts rule out no near pair."""
    monkeypatch.setattr(ordermin, "BLOCK", block)
    r = random.Random(11)
    shared = [f"s{i}" for i in range(30)]
    texts = [shared + [r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(r.randrange(6, 14))] for _ in range(120)]
    texts += [edited(r, t, r.randrange(1, 9)) for t in texts[:40]]
    names = [word_names(" ".join(t).encode()) for t in texts]
    rows = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    bins = np.array([np.frombuffer(ordermin.word_bins(names[i]), np.uint8) for i in rows])
    words, ids = np.array([len(texts[i]) for i in rows]), np.array(rows)
    near = {(i, j) for i in rows for j in rows if i < j and alike(texts[i], texts[j], 0.8)}
    assert near <= set(ordermin.possible_pairs(ids, words, ids, np.zeros(len(rows)), bins, 0.8))
    across = set(ordermin.possible_pairs(ids, words, ids, ids % 2, bins, 0.8))
    assert {(i, j) for i, j in near if (i + j) % 2} <= across and all((i + j) % 2 for i, j in across)
    buckets = {}
    for i, n in enumerate(names):
        for b in sketches(n).tolist():
            buckets.setdefault(b, []).append(i)
    met = {(i, j) for m in buckets.values() for i in m for j in m if i < j}
    out = {x["doc_id"]: x["class_id"] for x in near_duplicates(frame(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert near & met and all(out[i] == out[j] for i, j in near & met)


def test_rows_do_not_grow_with_the_square_of_a_crowd(spark, monkeypatch):
    """Texts of the same words in other orders, whose pairs no count of words rules out: what is written grows with the texts, and near ones are found."""
    r = random.Random(13)
    head, tail = [f"s{i}" for i in range(40)], [f"t{i}" for i in range(20)]
    texts = [head + r.sample(tail, 20) for _ in range(300)]
    for t in texts[:20]:
        texts.append([*t[:40], *t[44:], *t[40:44]])
    written = {}

    def noted(df, what, write=ordermin.materialize):
        out = write(df, what)
        written[what] = max(written.get(what, 0), out.count())
        return out

    monkeypatch.setattr(ordermin, "materialize", noted)
    out = {x["doc_id"]: x["class_id"] for x in near_duplicates(frame(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert all(out[i] == out[300 + i] for i in range(20))
    buckets = {}
    for i, t in enumerate(texts):
        for b in sketches(word_names(" ".join(t).encode())).tolist():
            buckets.setdefault(b, []).append(i)
    met = {(i, j) for m in buckets.values() for i in m for j in m if i < j}
    near = [(i, j) for i, j in met if alike(texts[i], texts[j], 0.8)]
    assert all(out[i] == out[j] for i, j in near)
    # 56 sketches a text; without its hubs, the crowd has more pairs than that.
    assert len(met) > 2 * 56 * len(texts) > 2 * max(written.values()), written


def test_links_of_a_tile_join_its_classes(spark):
    """Fewer links than members, whatever the near pairs; a pair is aligned in the least of its buckets; counts of words don't tell orders apart."""
    r = random.Random(17)
    base = [f"w{i}" for i in range(40)] + ["again"] * 300
    texts = sorted((edited(r, base, r.randrange(18)) for _ in range(40)), key=len) + [[f"x{i}" for i in range(400)]]
    lists, n = [" ".join(t).encode() for t in texts], len(texts)
    words, ids = np.array([len(t) for t in texts]), np.arange(n) + 100
    found = lambda shared, bucket: list(ordermin.new_links(ids, words, ids, np.zeros(n), lists, shared, bucket, 0.95))
    links, above = found([{3, 7}] * n, 3), {i: i for i in range(n)}
    for a, b in links:
        a, b = above[a - 100], above[b - 100]
        assert a != b
        above = {k: a if v == b else v for k, v in above.items()}
    near = [(i, j) for i in range(n) for j in range(i) if alike(texts[i], texts[j], 0.95)]
    assert len(near) > n > len(links) and all(above[i] == above[j] for i, j in near)
    assert all(alike(texts[a - 100], texts[b - 100], 0.95) for a, b in links)
    assert found([{3, 7}] * n, 7) == []


def test_many_distinct_words():
    words = [f"w{i}" for i in range(60_000)]
    other = ["first", *words[:30_000], "middle", *words[30_000:], "last"]
    other[45_000] = "changed"
    assert banded_distance(words, other, 400) == 4 and alike(words, other, 0.99)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "one"), (None, "three words here"), (6, "three  words\nhere"), (4, "one"), (7, "x " * 30000), (8, "x " * 30000 + "y")]
    got = sorted((x["doc_id"] or -1, x["class_id"], x["class_size"]) for x in near_duplicates(frame(spark, docs)).collect())
    assert got == [(-1, None, 2), (1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 3), (4, 4, 3), (5, 4, 3), (6, None, 2), (7, 7, 2), (8, 7, 2)]
    kept = keep_one_of_each(frame(spark, docs)).collect()
    assert sorted((x["doc_id"] or -1) for x in kept) == [-1, 1, 4, 7]
    assert kept[0].asDict().keys() == {"doc_id", "text", "content", "words", "class_id"}
    assert near_duplicates(frame(spark, [])).count() == 0 and keep_one_of_each(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    ids = r.sample(range(10**9), 120)
    edges = [(ids[i], ids[i + 1]) for i in range(60)] + [tuple(r.sample(ids[70:], 2)) for _ in range(30)]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    got = {x["v"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got.keys() == {x for e in edges for x in e}
    for a in got:
        for b in got:
            assert (got[a] == got[b]) == (find(a) == find(b))


def test_alike():
    assert alike([1] * 10, [1] * 8, 0.8) and not alike([1] * 10, [1] * 7, 0.8) and alike([], [], 0.8)
