"""Personal data, quality, decontamination and toxicity."""

import hashlib
import os
import pathlib
import random
import re
import subprocess
import sys
import zlib

import duckdb
import numpy as np
import pytest

from locusframe.llm import decontaminate as dc
from locusframe.llm import pii, quality, toxicity

# --- personal data


def plain_spans(x):
    """The contract's patterns as they stand."""
    ok = {"email": lambda t: True, "ip": lambda t: all(int(p) <= 255 for p in t.split(".")), "card": lambda t: 14 <= len(pii.digits_of(t)) <= 19 and pii.luhn(pii.digits_of(t)), "phone": lambda t: 10 <= len(pii.digits_of(t)) <= 15}
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    return sorted(((m.start(), m.end(), k) for k, p in patterns.items() for m in re.finditer(p, x) if ok[k](m[0])), key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_patterns():
    r = random.Random(1)
    for _ in range(20000):
        x = "".join(r.choice("0123456789.+- ()@ab@.é") for _ in range(r.randrange(1, 40)))
        assert pii.base_spans(x) == plain_spans(x)


def test_base_patterns_are_linear():
    for x in ("a" * 400_000, "1" * 400_000, "a@" * 200_000, "1." * 200_000, "+1 " * 150_000, "1-" * 200_000 + "@"):
        pii.base_spans(x)
    assert pii.base_spans("9" * 5000 + ".1.1.1") == [] and pii.octets("000255.1.1.1") and not pii.octets("256.1.1.1")


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_the_field_finds_variants_and_leaves_others_alone():
    w = pii.trained()
    found = hit = gold = 0
    for text, marks in pii.training_sentences(150, 1234):
        got = {(s, e, pii.KINDS.index(k)) for s, e, k in pii.field_spans(text, w)}
        found, hit, gold = found + len(got), hit + len(got & set(marks)), gold + len(marks)
    assert hit / found > 0.9 and hit / gold > 0.8
    for clean in ("We meet at the house. The dot is red.", "Licensed under CC BY-NC 4.0.", "version 3.2.1 of 2024-01-05", 'token = "ffc3105535f423f352535e4ac53b5fefe076ac6d"'):
        assert pii.find_personal(clean, w) == ([], [])
    assert [k for *_, k in pii.find_personal("write anka at example dot com now", w)[1]] == ["email"]


def test_every_entity_that_is_trained_on_is_a_candidate():
    for text, marks in pii.training_sentences(900, 11):
        tokens = pii.tokens_of(text, 0, len(text))
        candidates = {(tokens[i][0], tokens[j - 1][1]) for i, j, _ in pii.segments(tokens)}
        assert all((s, e) in candidates for s, e, _ in marks)


def test_bracketed_forms_are_found_whole():
    w = pii.trained()
    assert pii.redact_text("write ann[at]host[dot]mail[dot]com now", w) == "write [EMAIL] now"
    assert pii.redact_text("server 10[.]20[.]30[.]41 is down", w) == "server [IP] is down"
    r = random.Random(5)
    found = sum(pii.field_spans(f"ip {(t := '[.]'.join(str(r.randint(1, 255)) for _ in range(4)))}, ", w) == [(3, 3 + len(t), "ip")] for _ in range(300))
    assert found >= 285


def test_decoding_is_the_best_cover():
    r = np.random.default_rng(1)
    for _ in range(50):
        n = 6
        scores = {(i, j): r.normal(size=4) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1)}

        def best(at, scores=scores, n=n):
            if at == n:
                return 0.0
            return max([best(at + 1)] + [float(s.max()) + best(j) for (i, j), s in scores.items() if i == at])

        assert sum(scores[i, j][k] for i, j, k in pii.decode(n, scores)) == pytest.approx(best(0))

        def total(at, scores=scores, n=n):
            return 1.0 if at == n else total(at + 1) + sum(np.exp(s).sum() * total(j) for (i, j), s in scores.items() if i == at)

        def without(span, at=0, scores=scores, n=n):
            return 1.0 if at == n else without(span, at + 1) + sum(np.exp(s).sum() * without(span, j) for (i, j), s in scores.items() if i == at and (i, j) != span)

        chance = pii.expected(n, scores)
        assert chance[0, 2].sum() == pytest.approx(1 - without((0, 2)) / total(0))


def test_pii_rows(spark):
    texts = [(1, None), (2, ""), (3, "mail a.b@x.org or 10.0.0.1, 4111 1111 1111 1111 and +1 (234) 555-0100"), (3, "é a@b.cd"), (None, "1.1.1.1" + " z" * 60000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, spans string, n_email long")
    out = pii.personal_spans(df).collect()
    got = sorted((r["doc_id"] or -1, r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in out)
    want = []
    for i, t in texts:
        base = plain_spans(t or "")
        want.append((i or -1, *(sum(k == x for *_, x in base) for k in pii.KINDS), hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()))
    assert got == sorted(want)
    assert all(s in r["spans"].split(",") for r in out if r["doc_id"] == 3 and r["n_ip"] for s in ["email:5:14", "ip:18:26"])
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df.where("doc_id < 3 or n_email = 1")).collect() if r["doc_id"] in (1, 2)}
    assert clean == {1: None, 2: ""}
    assert pii.redact_text(texts[2][1], pii.trained()) == "mail [EMAIL] or [IP], [CARD] and [PHONE]"
    assert pii.personal_spans(df.limit(0)).count() == 0


# --- quality


def test_base_counts():
    assert quality.base_counts(None) == quality.base_counts("") == (0, 0, 0, 0, 0, 0)
    assert quality.base_counts("a b c a b c\na b c a b c\n \n \n#|x") == (13, 15, 2, 1, 12, 3)
    r = random.Random(1)
    for _ in range(2000):
        words = [bytes([r.choice(b"abc")]) for _ in range(r.randrange(30))]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
        assert quality.repeated_words(words) == len(hit)


def test_tail_is_binomial():
    from math import comb

    for n, k, p in [(10, 0, 0.1), (50, 3, 0.05), (400, 7, 0.0125)]:
        assert quality.tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_false_rejections_stay_below_the_limit():
    """Over many draws, certified cutoffs exceed the limit no more often than delta allows."""
    r = np.random.default_rng(1)
    cuts = np.array(quality.CUTOFFS)
    wrong = used = 0
    for _ in range(300):
        good = np.bincount(np.searchsorted(cuts, r.exponential(0.1, 1500)), minlength=len(cuts) + 1)
        bad = np.bincount(np.searchsorted(cuts, r.exponential(0.8, 1500)), minlength=len(cuts) + 1)
        c = quality.certified_cutoff(good.tolist(), bad.tolist(), 0.02, 0.05 / len(cuts), 1.0)
        if c is not None:
            used += 1
            wrong += np.exp(-c / 0.1) > 0.02
    assert used > 250 and wrong <= 0.05 * 300


def test_quality_rows(spark):
    r = random.Random(2)
    prose = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(80))
    docs = [(i, prose(), "en", "x") for i in range(3000)] + [(i, prose().replace(" ", "## "), "en", "x") for i in range(3000, 3600)]
    docs += [(9000, None, None, "x"), (9001, "", "de", "x"), (9002, "few words", "en", "x"), (9003, "same again " * 200, "en", "x"), (9004, prose(), "de", "x"), (9004, prose(), "de", "x")]
    labels = [(i, int(i < 3000), 0) for i in range(3600)] + [(9004, None, 0), (5, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, kept string")
    lf = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {}
    for x in quality.judge_quality(df, lf).collect():
        out.setdefault(x["doc_id"], x)
    for i, t, *_ in docs:
        counts = quality.base_counts(t)
        if i != 9004:
            assert (out[i]["n_words"], out[i]["word_chars"], out[i]["n_symbols"], out[i]["n_dup_lines"], out[i]["n_repeat_words"]) == counts[:5]
        assert out[i]["base_failed"] == (counts[0] < 50 or counts[4] * 2 > counts[0])
    assert not any(out[i]["kept"] for i in (9000, 9001, 9002, 9003)) and out[9004]["kept"]
    assert sum(out[i]["kept"] for i in range(3000)) >= 2850 and sum(out[i]["kept"] for i in range(3000, 3600)) == 0
    # The SQL agrees where cutoffs act, strata differ and ids are missing.
    more = spark.createDataFrame([(None, prose(), None, "x"), (9100, prose() + " ##" * 9, "", "x"), (9101, prose(), None, "x")], df.schema)
    documents, labels = df.where("doc_id <> 9004").union(more).drop("kept").toPandas(), lf.toPandas()  # noqa: F841
    rows = quality.judge_quality(df.where("doc_id <> 9004").union(more), lf).toPandas()
    rejected = rows["rejected_by"].notna().sum()
    same = duckdb.sql(f"WITH wanted AS ({quality.OP7_SQL}) SELECT count(*) FROM (SELECT CAST(doc_id AS BIGINT) AS doc_id, * EXCLUDE (doc_id) FROM wanted EXCEPT ALL SELECT CAST(doc_id AS BIGINT), * EXCLUDE (doc_id) FROM rows)").fetchall()[0]
    assert rejected >= 600 and same == (0,)
    kept = quality.judge_quality(df, lf.limit(0)).where("kept").count()
    assert kept == 3602 and quality.judge_quality(df.limit(0), lf).count() == 0


# --- decontamination


def words(r, n, vocabulary=1500):
    return [f"w{int(vocabulary * r.random() ** 3)}" for _ in range(n)]


def items(r, n=40):
    return [(i, " ".join(words(r, r.choice([6, 20, 60, 150]))) + ". Answer: " + " ".join(words(r, r.choice([1, 6, 30]))) + ".") for i in range(n)]


def test_retrieval_loses_nothing_above_the_threshold():
    r = random.Random(1)
    index = dc.Index(items(r))
    for k in range(120):
        tokens = words(r, r.choice([3, 40, 64, 65, 400]))
        if k % 3 == 0:
            part = r.choice(index.parts)
            tokens[5:5] = part[: r.randint(1, len(part))]
        want = {}
        half = 32
        for h in range(max(1, -(-len(tokens) // half) - 1)):
            bag = set(tokens[h * half : (h + 2) * half])
            for i, w in enumerate(index.weights):
                score = sum(x for t, x in w.items() if t in bag)
                if score >= 0.5:
                    want[index.part_item[i]] = max(score, want.get(index.part_item[i], 0))
        assert index.retrieve(tokens) == pytest.approx(want)


def test_leaks(spark):
    r = random.Random(2)
    bench = items(r, 60)
    docs, truth = [], set()
    for i in range(200):
        text = words(r, r.choice([0, 30, 200, 3000]))
        if i % 4 == 0:
            k = r.randrange(60)
            text[len(text) // 2 : len(text) // 2] = bench[k][1].upper().split() if i % 8 else bench[k][1].split()
            truth.add((i, k))
        docs.append((i, " ".join(text), "s"))
    docs += [(500, None, "s"), (501, "", "s"), (0, docs[0][1], "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    bf = spark.createDataFrame([*bench, (70, None), (71, ""), (72, "too short"), bench[0]], "item_id long, text string")
    for shard in (2_000_000, 500):
        assert {(x["doc_id"], x["item_id"]) for x in dc.leaks(df, bf, shard_words=shard).collect()} == truth
        kept = [x["doc_id"] for x in dc.drop_leaks(df, bf, shard_words=shard).collect()]
        assert sorted(kept) == sorted(i for i, *_ in docs if i not in {d for d, _ in truth})
    assert dc.leaks(df, bf.limit(0)).count() == 0 and dc.leaks(df.limit(0), bf).count() == 0
    # Statistics are those of all items, whatever the shards; null ids are reported.
    extra = spark.createDataFrame([(None, bench[3][1], "s"), (600, "First this. Too short!\nThen that.", "s"), (601, "this is too short to tell", "s")], df.schema)
    one, some = ({(x["doc_id"], x["item_id"]): round(x["score"], 9) for x in dc.leaks(df.union(extra), bf, shard_words=n).collect()} for n in (2_000_000, 500))
    assert one == some and one.keys() == truth | {(None, 3), (600, 72)}


def test_near_copies_with_a_short_answer(spark):
    r = random.Random(8)
    question = words(r, 40)
    index = dc.Index([(1, " ".join(question) + ". four five six seven.")])
    assert [x[0] for x in index.verified(" ".join(question) + ". four five SIX eight.", 0.5, 0.5, 64)] == [1]
    assert index.verified(" ".join(question[:25]) + ". four five six eight.", 0.5, 0.5, 64) == []


def test_executors_without_the_package(tmp_path):
    """Workers that don't have the package on their path get what they need from the driver."""
    code = """
import sys
sys.path.insert(0, %r)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from locusframe.llm import decontaminate, ordermin, pii, quality, relz, suffix, toxicity
docs = spark.createDataFrame([(i, "en", " ".join("w%%d" %% (i * 100 + j) for j in range(60))) for i in range(6)], "doc_id long, lang string, text string")
bench = spark.createDataFrame([(1, docs.first()["text"])], "item_id long, text string")
labels = spark.createDataFrame([(i, 1, i %% 2) for i in range(6)], "doc_id long, quality int, toxic int")
assert decontaminate.leaks(docs, bench).count() == 1 and decontaminate.drop_leaks(docs, bench).count() == 5
for out in (ordermin.near_duplicates(docs), pii.personal_spans(docs), quality.judge_quality(docs, labels), relz.parse_factors(docs), suffix.dedup_substrings(docs), toxicity.score_documents(docs, labels)):
    assert out.count() == 6
print("all there")
""" % str(pathlib.Path(__file__).parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all there" in done.stdout, "\n".join(x for x in done.stderr.splitlines() if "Error" in x or ".py" in x)[-3000:]


def test_question_without_its_answer_is_no_leak():
    r = random.Random(3)
    question, answer = " ".join(words(r, 40)), " ".join(f"a{i}" for i in range(10))
    index = dc.Index([(1, f"{question}. {answer}.")])
    assert index.verified(question, 0.5, 0.5, 64) == []
    assert [x[0] for x in index.verified(f"{question} {answer}", 0.5, 0.5, 64)] == [1]


# --- toxicity


def test_swap_penalty_takes_weight_off_identity_terms():
    r = np.random.default_rng(1)
    n = 600
    slur, group, other = r.random(n) < 0.3, r.random(n) < 0.4, r.random(n) < 0.4
    y = (slur | (group & (r.random(n) < 0.6))).astype(float)  # mentions of one group are often labelled toxic
    x = np.column_stack([slur, group, other]).astype(float)
    swaps = np.array([[0.0, -1.0, 1.0]] * 50)
    plain, fair = toxicity.fit_weights(x, y, swaps, swap_penalty=0.0), toxicity.fit_weights(x, y, swaps, swap_penalty=10.0)
    assert abs(fair[1] - fair[2]) < 0.1 * abs(plain[1] - plain[2]) and fair[0] > 1


def test_swaps_are_by_sentence():
    assert toxicity.swaps_of("Women and men. No term here! The WOMEN") == ["men", "women", "women"]
    assert toxicity.swaps_of(None) == []


def test_training_takes_weight_off_beginnings_of_identity_terms(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    docs, labels = [], []
    for i in range(900):
        kind = r.choice(["muslim", "christian", "hindu", "", "", ""])
        slur = r.random() < 0.2
        docs.append((i, " ".join([word() for _ in range(12)] + ["vile"] * slur + [kind])))
        labels.append((i, int(slur or (kind == "muslim" and r.random() < 0.6))))
    df, lf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")

    def logit(text, model):
        p = toxicity.score_text(text, model)
        return np.log(p / (1 - p))

    plain, fair = (toxicity.train(df, lf, least=1.0, swap_penalty=x) for x in (0.0, 10.0))
    assert "musl" in plain["weights"][4]
    change = [logit("a muslim came", m) - logit("a hindu came", m) for m in (plain, fair)]
    assert change[0] > 2 and abs(change[1]) < 0.1 * change[0]
    assert logit("a vile one", fair) - logit("a new one", fair) > 1


def test_a_swap_changes_beginnings():
    changes = toxicity.changes_of("Hindu christmas.")
    assert "0:hindu 3:hin 4:hind 5:hindu\t0:muslim 3:mus 4:musl 5:musli 6:muslim" in changes
    assert "0:hindu 3:hin 4:hind 5:hindu\t0:christian" in changes  # christmas has its beginnings
    assert toxicity.changes_of(None) == []


def test_toxic_rows(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    docs, labels = [], []
    for i in range(1500):
        bad = i % 6 == 0
        text = [word() for _ in range(60)]
        if bad:
            for k in range(4):
                text[r.randrange(60)] = r.choice(["vile", "filth", "grumok" + word()])
        docs.append((i, " ".join(text).capitalize(), "x", 0.0))
        labels.append((i, 1, int(bad) if r.random() > 0.03 else int(not bad)))
    docs += [(2000, None, "x", 0.0), (2001, "", "x", 0.0), (2002, "Vile, FILTH! " * 5000, "x", 0.0), (0, docs[0][1], "x", 0.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")
    lf = spark.createDataFrame([*labels, (3, 1, None), (7, 1, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(df, lf).collect()
    assert len(out) == len(docs)
    for x in out:
        assert x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0)
        assert 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5)
    held = [x for x in out if x["held_out"] and x["doc_id"] < 1500]
    assert sum(x["predicted"] == int(x["doc_id"] % 6 == 0) for x in held) / len(held) > 0.95
    assert {x["doc_id"]: x["predicted"] for x in out if x["doc_id"] >= 2000} == {2000: 0, 2001: 0, 2002: 1}
    assert toxicity.score_documents(df, lf.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.score_documents(df.limit(0), lf).count() == 0
    kept = toxicity.drop_toxic(df, lf)
    assert kept.columns == df.columns and kept.where("doc_id = 2001").count() == 1


def test_held_out_labels_are_not_learnt(spark):
    docs = spark.createDataFrame([(i, "vile" if i % 2 else "fine") for i in range(300)], "doc_id long, text string")
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = spark.createDataFrame([(i, i % 2) for i in held], "doc_id long, toxic int")
    assert toxicity.score_documents(docs, labels).select("score").distinct().count() == 1
