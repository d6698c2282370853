"""Functions, interval operators, statistics, the stream, and the table queries against their SQL."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from locusframe.errors import InputError
from locusframe.functions.matching import Matcher, java_pattern, normalized
from locusframe.functions.text import natural_key, normalize, percent_decode, strip_line_ending, unsigned, varint_length
from locusframe.operators import statistics as st
from locusframe.operators.intervals import coalesce_ranges, out_of_order, overlap_join
from locusframe.operators.query import ranges_over
from locusframe.plans.tables import ORACLES, QUERIES
from locusframe.staging import materialize, numbered, release
from locusframe.streaming.ingest import stream_postings

DATA = "/root/testdata/sf0.001"


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f(F.col("v"))).collect()]


def test_text_functions(spark):
    assert column(spark, ["  Tolq9 ", "\tÉİ\n"], normalize) == ["tolq9", "Éİ"]
    assert [normalized("  Tolq9 "), normalized("x A ", True)] == ["tolq9", "x A"]
    assert column(spark, ["a%20b", "a+b", "100%", "%zz", "%C3%A9"], percent_decode) == ["a b", "a+b", "100%", "%zz", "é"]
    assert column(spark, ["a\r\n", "a\n\r", "a\r", "a"], strip_line_ending) == ["a", "a\n", "a", "a"]
    assert column(spark, ["7", "+7", "-7", " 7", "", "99999999999999999999", None], unsigned) == [7, 7, None, None, None, None, None]
    assert column(spark, [0, 1, 127, 128, 16383, 16384, 2**62], varint_length, "long") == [1, 1, 1, 2, 2, 3, 9]
    names = ["arm10", "arm2", "Zeta1", "arm1", "Arm3"]
    keys = dict(zip(names, column(spark, names, natural_key)))
    assert sorted(names, key=keys.get) == ["arm1", "arm2", "Arm3", "arm10", "Zeta1"]
    # Numbers of any length; runs that begin with 0 are fractions.
    order = ["a0", "a00", "a007", "a01", "a01b", "a02", "a1", "a7", "a00000000000000000000000", "a99999999999999999999", "a100000000000000000000", "a100000000000000000001x", "b1c10", "b1c9"]
    keys = dict(zip(order, column(spark, order, natural_key)))
    assert sorted(order, key=keys.get) == ["a0", "a00", "a00000000000000000000000", "a007", "a01", "a01b", "a02", "a1", "a7", "a99999999999999999999", "a100000000000000000000", "a100000000000000000001x", "b1c9", "b1c10"]


@pytest.mark.parametrize(
    "pattern, text, hit",
    [
        (r"(?P<x>a)b", "AB", True), (r"[[:alpha:]]\d", "x٣", True), (r"^é$", "É", True), (r"a$", "a\n", False), (r"\p{Greek}", "α", True), (r"\P{Greek}", "α", False),
        (r"[]a]+$", "]a", True), (r"[^[:digit:]]", "5", False), (r"a|b{2}", "bb", True), (r"(?m)^b$", "a\nb", True), (r"x*", "", True),
    ],
)
def test_regex(spark, pattern, text, hit):
    m = Matcher.compile(spark, pattern, "regex")
    assert column(spark, [text], m.predicate) == [hit]


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)", r"(a)\1", "a++", "(?>a)", "[a--b]", "a\\", "[[:nope:]]", "missing[", "(", r"a\Z"])
def test_regex_rejects(spark, pattern):
    with pytest.raises(InputError, match="regex"):
        Matcher.compile(spark, pattern, "regex")


def test_pattern_text():
    assert java_pattern("a$") == r"a\z" and java_pattern("[$]") == "[$]" and java_pattern(r"\$") == r"\$"


def test_numbers_are_dense_and_in_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("v")).repartition(7)
    rows = numbered(df, ["v"], "n").orderBy("v").collect()
    assert [r["n"] for r in rows] == list(range(5000))


def test_ranges_over():
    assert ranges_over([9, 1, 2, 30, 31], 2) == [(1, 9), (30, 31)] and ranges_over([5]) == [(5, 5)] and len(ranges_over(list(range(0, 900, 3)))) == 50


def test_release(spark):
    t = materialize(spark.range(5), "t")
    assert t.count() == 5 and os.path.exists(t.staged_path.removeprefix("file:"))
    release(t)
    assert not os.path.exists(t.staged_path.removeprefix("file:"))


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals(spark, seed):
    r = random.Random(seed)
    make = lambda n: [(r.choice("xy"), s, s + r.choice([1, 5, 300])) for s in (r.randrange(3000) for _ in range(n))]
    a, b = make(120), make(80)
    frame = lambda rows: spark.createDataFrame(rows, "reference string, start long, end long")
    got = sorted(tuple(x) for x in overlap_join(frame(a), frame(b), 6).select("a_reference", "a_start", "a_end", "b_start", "b_end").collect())
    assert got == sorted((p[0], p[1], p[2], q[1], q[2]) for p in a for q in b if p[0] == q[0] and p[1] < q[2] and q[1] < p[2])
    want = []
    for ref in "xy":
        at = None
        for s, e in sorted((s, e) for x, s, e in a if x == ref):
            if at and s <= at[1]:
                at = (at[0], max(at[1], e), at[2] + 1)
            else:
                want += [(ref, *at)] if at else []
                at = (s, e, 1)
        want += [(ref, *at)] if at else []
    assert sorted(tuple(x) for x in coalesce_ranges(frame(a), 512).collect()) == sorted(want)


def test_out_of_order(spark):
    rows = [(0, "a", 5), (1, "a", 4), (2, "b", 1), (3, "a", 9), (4, "b", 2)]
    got = out_of_order(spark.createDataFrame(rows, "src_pos long, reference string, start long")).collect()
    assert sorted(x["src_pos"] for x in got) == [1, 3, 4]


def test_structural_bytes(spark):
    postings = spark.createDataFrame([("t", i) for i in (1, 4, 9)], "term string, span_id long")
    assert st.posting_bytes(postings).first()["posting_bytes"] == 4
    spans = spark.createDataFrame([(i, 0, s, n, 0) for i, (s, n) in enumerate([(10, 1), (10, 2), (15, 3), (20, 3)])], "span_id long, reference_id int, start long, length long, block_id long")
    assert st.start_bytes(spans).first()["start_bytes"] == 3
    assert (st.length_bytes(spans).first()["is_packed"], st.length_bytes(spans).first()["length_bytes"]) == (True, 21)


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n in (1, 2):
        (source / f"{n}.gff").write_text(f"##gff-version 3\nchr1\ts\tgene\t{n}\t9\t.\t+\t.\tName=Gene{n}\n")
        stream_postings(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check"), ["Name"], once=True).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).select("contig", "start", "length", "term").distinct().collect()
    assert sorted(tuple(r) for r in rows) == [("chr1", 0, 9, "gene1"), ("chr1", 1, 8, "gene2")]


needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_table_queries(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.select(sorted(df.columns)).collect()]
    if name not in ORACLES:
        assert rows
        return
    with duckdb.connect() as con:
        for t in ("part", "orders", "lineitem", "events"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        cur = con.execute(ORACLES[name])
        names = [d[0] for d in cur.description]
        order = [names.index(c) for c in sorted(names)]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in order)) for r in cur.fetchall())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
