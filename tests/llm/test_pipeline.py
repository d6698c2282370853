"""The corpus pipeline on a small corpus in which every stage has something to do."""

import random

import corpus_pipeline as cp
from locusframe.llm.mixing import mix_sources, word_count


def write(spark, folder, docs, labels, bench):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def corpus():
    r = random.Random(1)
    prose = lambda n: [f"w{int(3000 * r.random() ** 2)}" for _ in range(n)]
    bench = [(i, " ".join(prose(40)) + ". " + " ".join(prose(8)) + ".") for i in range(10)]
    texts, toxic = {}, set()
    for i in range(600):
        words = prose(r.choice([30, 80, 200]))
        if i % 5 == 0:
            toxic.add(i)
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(["vile", "filth", "scum"])
        texts[i] = " ".join(words)
    copies, leaks = {}, set()
    for i in range(1, 100, 10):
        copies[1000 + i] = i
        texts[1000 + i] = texts[i] + " more"
    for i in range(2, 50, 10):
        leaks.add(i)
        texts[i] += " " + bench[i % 10][1]
    texts[3] += " write to ann@example.org"
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()] + [(5000, None, None, None, None), (None, "no id at all", "en", "s0", 12)]
    return docs, [(i, 1, int(i in toxic)) for i in range(600)], bench, toxic, copies, leaks


def test_stages(spark, tmp_path):
    docs, labels, bench, toxic, copies, leaks = corpus()
    folder = str(tmp_path / "sf")
    write(spark, folder, docs, labels, bench)
    df = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, df, folder)
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        if i < len(cp.STAGES) - 1:
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r["doc_id"]: r for r in df.collect()})
    want = {i for i, *_ in docs} - toxic
    assert kept[0].keys() == want
    want -= copies.keys()
    assert kept[1].keys() == want
    want -= leaks
    assert kept[2].keys() == kept[3].keys() == kept[4].keys() == want
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken", "shard", "shard_blocks", "shard_quota"]
    assert all(tuple(kept[4][i])[:5] == tuple(kept[3][i]) for i in want)
    assert kept[3][3]["text"].endswith(" write to [EMAIL]") and kept[3][3]["n_chars"] == len(kept[3][3]["text"])
    assert all(kept[3][i]["text"] == kept[2][i]["text"] for i in want if i != 3)
    assert all(r["taken"] <= 3 * r["size"] for r in kept[4].values())
    assert sum(r["taken"] for r in kept[4].values()) > 0
    run = {(r["doc_id"], r["size"], r["taken"]) for r in cp.run(spark, folder).collect()}
    assert run == {(r["doc_id"], r["size"], r["taken"]) for r in kept[4].values()}


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], [], [])
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "s", 9.5, "x")], "doc_id long, text string, source string, size double, row string")
    out = mix_sources(df, whole=True)
    assert out.columns[:4] == ["doc_id", "text", "source", "row"] and out.first()["size"] == 2 and out.first()["row"] == "x"


def test_names():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"] and word_count
