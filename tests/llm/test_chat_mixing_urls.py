"""The DataFrame-only operators."""

import itertools
import math
import random

import duckdb
import pytest

from locusframe.llm.chat import OP1_SQL, rotate_perspectives
from locusframe.llm.mixing import apportion, mix_sources
from locusframe.llm.urls import RULES, host_and_path, judge_urls, matching_rule

CONVERSATIONS = "conv_id long, turn long, role string, text string, part string"


def rendered(turns, who):
    """Brute force of one rendering; turns are (role, text) in order."""
    text, mask = "", []
    for role, said in turns:
        text += "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == who else f"<|user name={role}|>\n"
        if role == who:
            mask.append(f"{len(text)}:{len(text) + len(said) + 8}")
        text += said + "<|end|>\n"
    return text, ",".join(mask)


def test_perspectives(spark):
    rows = [(1, 0, "system", "be é kind", "x"), (1, 1, "ann", "hi", "x"), (1, 2, "bob", "", "x"), (1, 3, "ann", None, "x"), (1, 3, "ann", None, "x"), (2, 0, "system", "alone", "x"), (3, None, None, "?", "x"), (None, 5, "z", "a", "x")]
    got = {(r["conv_id"], r["perspective"]): (r["rendered"], r["mask"], r["n_turns"], r["n_targets"]) for r in rotate_perspectives(spark.createDataFrame(rows, CONVERSATIONS)).collect()}
    turns = [("system", "be é kind"), ("ann", "hi"), ("bob", ""), ("ann", ""), ("ann", "")]
    assert got == {
        (1, "ann"): (*rendered(turns, "ann"), 5, 3), (1, "bob"): (*rendered(turns, "bob"), 5, 1),
        (3, "unknown"): (*rendered([("unknown", "?")], "unknown"), 1, 1), (None, "z"): (*rendered([("z", "a")], "z"), 1, 1),
    }


def in_parts(turns, size, context):
    """Brute force: (part, perspective) -> rendering, mask, counts; turns are (role, text) in order."""
    out = {}
    head = next((i for i, t in enumerate(turns) if t[0] == "system"), None)
    for k in range(0, len(turns), size):
        before = turns[max(0, k - context) : k]
        if k and head is not None and head < k - context:
            before = [turns[head], *before]
        own = turns[k : k + size]
        for who in {r for r, _ in own} - {"system"}:
            opening = rendered(before, who)[0]
            text, mask = rendered(own, who)
            shifted = ",".join(":".join(str(int(x) + len(opening)) for x in m.split(":")) for m in mask.split(","))
            out[k // size, who] = (opening + text, shifted, len(own), len(before), sum(r == who for r, _ in own))
    return out


@pytest.mark.parametrize("size, context", [(8, 3), (256, 16)])
def test_long_conversations_come_in_parts(spark, size, context):
    r = random.Random(size)
    talks = {
        1: [(0, "system", "be kind")] + [(i, "ab"[i % 2], str(i)) for i in range(1, 300)],
        None: [(None if i % 3 else i % 5, r.choice(["abc", "system"]) if i % 11 == 0 else "abc"[i % 3 if i % 7 else 2], f"{i % 90:02}") for i in range(1200)],
        2: [(0, "a", "same")] * 1100, 3: [(0, "a", str(i)) for i in range(size)], 4: [(0, "a", str(i)) for i in range(size + 1)],
    }
    rows = [(c, *t, "") for c, turns in talks.items() for t in turns]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(7)
    out = {}
    for x in rotate_perspectives(df, size, context).collect():
        out.setdefault(x["conv_id"], {})[x["part"], x["perspective"]] = (x["rendered"], x["mask"], x["n_turns"], x["n_context"], x["n_targets"])
    for conv, turns in talks.items():
        turns = sorted(turns, key=lambda t: (-1 if t[0] is None else t[0], *t[1:]))
        assert out[conv] == in_parts([t[1:] for t in turns], size, context)
    if size == 256:
        conversations = df.toPandas()  # noqa: F841
        found = duckdb.sql(OP1_SQL).fetchall()
        assert sorted(found, key=str) == sorted((tuple(x) for x in rotate_perspectives(df).collect()), key=str)


@pytest.mark.parametrize("silent", [False, True])
def test_context_of_several_parts_and_silent_participants(spark, silent):
    """Context longer than a part is whole; with silent, each participant has all parts of the conversation, whether it speaks there or not."""
    talks = {
        1: [("ann", "hi"), ("system", "be kind"), ("zed", "once")] + [("ann" if i % 3 else "bob", str(i)) for i in range(30)],
        None: [("ann", "a")] * 3 + [("system", str(i)) for i in range(9)] + [("bob", "b")], 2: [("system", "alone")] * 5,
    }
    df = spark.createDataFrame([(c, i, *t, "") for c, turns in talks.items() for i, t in enumerate(turns)], CONVERSATIONS)
    out = {}
    for x in rotate_perspectives(df, 4, 10, silent=silent).collect():
        out.setdefault(x["conv_id"], {})[x["part"], x["perspective"]] = (x["rendered"], x["mask"], x["n_turns"], x["n_context"], x["n_targets"])
    assert out.keys() == {1, None}
    for conv, found in out.items():
        turns, spoken = talks[conv], in_parts(talks[conv], 4, 10)
        head = next(i for i, t in enumerate(turns) if t[0] == "system")
        for k in range(0, len(turns), 4) if silent else ():
            before, own = turns[max(0, k - 10) : k], turns[k : k + 4]
            before = [turns[head], *before] if head < k - 10 else before
            for who in {r for r, _ in turns} - {"system"}:
                spoken.setdefault((k // 4, who), (rendered(before + own, who)[0], "", len(own), len(before), 0))
        assert found == spoken


def test_no_conversations(spark):
    assert rotate_perspectives(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def sainte_lague(votes, seats):
    won = {k: 0 for k in votes}
    for _ in range(seats):
        k = max(votes, key=lambda k: (votes[k] / (2 * won[k] + 1), [-ord(c) for c in k]))
        won[k] += 1
    return won


@pytest.mark.parametrize("seed", range(4))
def test_apportionment_is_sainte_lague(spark, seed):
    r = random.Random(seed)
    votes = {f"p{i:02}": r.choice([r.random() * 3, r.random() * 50, 0.0, 400 * r.random()]) for i in range(20)}
    seats = r.choice([1, 7, 50, round(sum(votes.values()))])
    df = spark.createDataFrame([(k, v, seats) for k, v in votes.items()], "name string, votes double, seats long")
    got = {x["name"]: x["q"] for x in apportion(df, [], "name", "votes", "seats").collect()}
    assert got == sainte_lague(votes, seats)


DOCS = "doc_id long, text string, source string, target string, size string"


def targets(sizes):
    """Shares by weight, capped at three times the size, the excess reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" * (1 + k % 5) for k in range(r.choice([0, 1, 30, 300, 4000]))), r.choice(["big"] * 8 + ["a", "b", "é", None, "tiny"]), "t", "s") for i in range(400)]
    rows += [(None, None, "a", "t", "s"), (5, rows[5][1], rows[5][2], "t", "s"), (900, "one two", "lone", "t", "s")]
    df = spark.createDataFrame(rows, DOCS)
    out = mix_sources(df, block_tokens=32, shard_docs=40).collect()
    again = mix_sources(df.repartition(3), block_tokens=32, shard_docs=40).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again)) and len(out) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = targets(sizes)
    for source, target in want.items():
        own = [x for x in out if x["source"] == source]
        assert all(math.isclose(x["target"], target) and x["source_size"] == sizes[source] for x in own)
        assert abs(sum(x["taken"] for x in own) - target) <= max(64, 0.01 * target)
    assert all(0 <= x["taken"] <= 3 * x["size"] for x in out)


def test_mixing_nothing(spark):
    assert mix_sources(spark.createDataFrame([], DOCS)).count() == 0
    out = mix_sources(spark.createDataFrame([(1, "", "a", "", ""), (2, None, None, "", "")], DOCS)).collect()
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in out] == [(0, 0, 0.0, 0)] * 2


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = [None, "", "no scheme", "http://", "http://x.org", "http://x.org/", "HTTP://A.B.Example.ORG/es/1?q=/en/", "http://example.org/en/12", "http://notexample.org/en/12", "http://org/", "http://com/fr/", "http://x.com/fr", "http://x.com/de/#/fr/", "http://ü.Com/de/\n/x", "http://a?x://b/c", "://y.org//"]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, length string")
    host, path = host_and_path(df["url"])
    from pyspark.sql import functions as F

    parts = df.select("page_id", host.alias("h"), path.alias("p"))
    rule, verdict = matching_rule(F.col("h"), F.col("p"))
    got = {r["page_id"]: (r["h"], r["p"], r["rule"], r["verdict"]) for r in parts.select("page_id", "h", "p", rule.alias("rule"), verdict.alias("verdict")).collect()}
    assert got == {i: brute_rule(u) for i, u in enumerate(URLS)}


def test_url_trees(spark):
    # A made-up rule set whose labels follow the number of parameters; unruled hosts are judged by it.
    rules = [("block", "bad.net", "/"), ("allow", "good.net", "/")]
    rows = [(i, f"http://{h}.net/p{i % 7}" + ("?a=1&b=2&c=3" if h == "bad" or (h == "new" and i % 2) else ""), "h") for i, h in zip(range(600), itertools.cycle(["bad", "good", "new"]))]
    out = judge_urls(spark.createDataFrame(rows + [(601, None, "h")], "page_id long, url string, html string"), rules).collect()
    assert len(out) == 601
    judged = {r["page_id"]: r["verdict"] for r in out if r["rule"] is None and r["page_id"] != 601}
    assert len(judged) == 200 and all(v == ("block" if i % 2 else "allow") for i, v in judged.items())


def auc(scores):
    """Share of (block, allow) pairs in the right order, ties half; scores are (score, is block)."""
    bad, good = ([x for x, b in scores if b == k] for k in (True, False))
    return sum((x > y) + (x == y) / 2 for x in bad for y in good) / (len(bad) * len(good))


def test_trees_on_held_out_urls(spark):
    """Blocked URLs have more digits and deeper paths, with exceptions; trees that don't know a third of the labels find them."""
    r = random.Random(6)
    rows = []
    for i in range(1500):
        bad = r.random() < 0.4
        odd = r.random() < 0.1
        path = "/".join(r.choice(["a", "news", "b12", "x9"]) + (str(r.randrange(10**6)) if bad != odd else "") for _ in range(r.randint(1, 4)))
        rows.append((i, f"http://h{r.randrange(40)}.{'bad' if bad else 'good'}.net/{path}"))
    rows += rows[:40] + [(2000, "http://h1.bad.net/" + "q" * 50_000), (2001, "http://")]
    rules = [("block", "bad.net", "/"), ("allow", "good.net", "/")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "page_id long, url string")
    held = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(3)) == 0
    out = judge_urls(df, rules, held_out=held).collect()
    measured = [(x["score"], ".bad." in x["host"]) for x in out if x["score"] is not None and x["rule"] is not None]
    assert len(out) == len(rows) and 400 < len(measured) < 600 and auc(measured) > 0.8
    # The sample's bound cuts between URLs, not by their number of rows or partitions.
    few = [sorted(map(str, judge_urls(x, rules, train_rows=200, held_out=held).select("page_id", "verdict").collect())) for x in (df, df.repartition(5))]
    assert few[0] == few[1]


def test_urls_without_labels(spark):
    out = judge_urls(spark.createDataFrame([(1, "http://x.net/"), (2, None)], "page_id long, url string")).collect()
    assert {(r["page_id"], r["verdict"], r["rule"]) for r in out} == {(1, "allow", None), (2, "allow", None)}
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
