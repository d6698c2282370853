"""Building, querying and checking an index of small files."""

import shutil

import pytest

from locusframe.errors import CorruptIndexError, InputError, StaleIndexError
from locusframe.operators.spans import attribute_tags, posting_lists
from locusframe.plans.index import IndexReader, build_index, inspect_index, open_index, validate_index

GENES = """##gff-version 3
# two loci on one span, a blank in a name, names that differ in case, two spans with one start
scafA\tlab\tlocus\t51\t90\t.\t-\t.\tName=Tolq;Alias=Tolq-old,YB7;label=Tolq
scafA\tlab\tlocus\t51\t90\t.\t-\t.\tAlias=TOLQ;ID=no_name
scafA\tlab\tlocus\t300\t340\t.\t+\t.\tName=Long%20Stem
scafB\tlab\tlocus\t7\t30\t.\t+\t.\tName=Mott
scafB\tlab\tlocus\t7\t19\t.\t+\t.\tName=tolQ
"""
PEAKS = "ctgX\t4\t9\tQuill\nctgX\t30\t44\tFern\nctgX\t60\t61\nctgY\t2\t3\tQuill\nctgY\t2\t3\tMoss\n"
ARMS = """##gff-version 3
arm12\tlab\tmark\t8\t9\t.\t.\t.\tName=Twin
ARM1\tlab\tmark\t400\t460\t.\t.\t.\tName=Twin
arm2\tlab\tmark\t1\t77\t.\t.\t.\tName=Twin
arm1\tlab\tmark\t400\t402\t.\t.\t.\tName=Twin
arm1-b\tlab\tmark\t33\t34\t.\t.\t.\tName=Twin
"""


def built(spark, folder, text, tags, name="a.gff3", **options):
    source = folder / name
    source.write_text(text)
    stats = build_index(spark, source, folder / "index", tags, **options)
    return stats, open_index(spark, source, folder / "index")


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    return built(spark, tmp_path_factory.mktemp("base"), GENES, ["Name", "Alias", "label"])


def ids(index, term, match="exact"):
    return [r["span_id"] for r in index.lookup_span_ids(term, match).collect()]


def test_counts(base):
    stats, index = base
    assert (stats.records_processed, stats.records_indexed, stats.distinct_terms, stats.unique_spans) == (5, 5, 5, 4)
    assert (stats.postings, stats.duplicate_postings_removed, stats.duplicate_spans_removed) == (6, 2, 1)
    assert stats.span_bytes_fixed_width == 80
    assert index.metadata().reference_count == 2


@pytest.mark.parametrize(
    "mode, term, spans, records",
    [
        ("exact", " TOLQ ", [0, 2], 3), ("exact", "tolq-old", [0], 1), ("exact", "yb7", [0], 1), ("exact", "long stem", [1], 1), ("exact", "mott", [3], 1),
        ("prefix", "to", [0, 2], 3), ("contains", " OLQ ", [0, 2], 3), ("regex", "^(tolq|mott)$", [0, 2, 3], 4), ("regex", r"\S", [0, 1, 2, 3], 5),
        ("contains", "", [], 0), ("regex", "  ", [], 0), ("exact", "none", [], 0),
    ],
)
def test_modes(base, mode, term, spans, records):
    _, index = base
    assert ids(index, term, mode) == spans
    rows, stats = index.query_with_stats(term, match=mode)
    assert rows.count() == records
    assert (stats.requested_spans, stats.matching_records) == (len(spans), records)


def test_records_come_back_in_source_order(base):
    _, index = base
    lines = [r["raw_line"] for r in index.query("tolq").collect()]
    assert lines == [x for x in GENES.splitlines()[2:] if "=tolq" in x.lower()]


def test_bad_queries(base):
    _, index = base
    with pytest.raises(InputError, match="regex"):
        index.query("missing[", match="regex")
    with pytest.raises(InputError, match="exact, prefix, contains"):
        index.query("x", match="fuzzy")
    with pytest.raises(InputError):
        index.query("(?=x)", match="regex")


def test_span_lookup_keeps_order_and_repeats(base):
    _, index = base
    assert [r["span_id"] for r in index.resolve_span_ids([2, 0, 2]).collect()] == [2, 0, 2]
    assert [(r["reference_id"], r["start"], r["length"]) for r in index.lookup_spans("to", "prefix").collect()] == [(0, 50, 40), (1, 6, 13)]
    assert {r["term"]: r["span_ids"] for r in posting_lists(index.postings).collect()}["tolq"] == [0, 2]


def test_names_of_queries(base):
    _, index = base
    assert index.resolve_span_id(3) == (1, 6, 24)
    with pytest.raises(InputError):
        index.resolve_span_id(4)
    for query in (index.query_with_mode, index.query_name_with_mode, index.query_on_contigs_with_mode):
        assert query("to", match="prefix", contigs=["scafB"]).count() == 1
    assert index.query_on_contigs_with_mode_and_stats("to", match="prefix", contigs=["scafB"])[1].matching_records == 1
    assert index.lookup_span_ids_with_mode_and_stats("tolq")[1].postings_bytes_decompressed == 3
    rows, stats = index.resolve_span_ids_with_stats([2, 2])
    assert rows.count() == 2 and stats.span_bytes_decompressed == 1 + 21


def test_lookup_stats(base):
    _, index = base
    rows, stats = index.lookup_spans_with_stats("tolq")
    # Postings: a count, the first id and one gap; start gaps of two bytes and of one; two blocks of two lengths that fit one byte of bits.
    assert rows.count() == 2 and (stats.postings_bytes_decompressed, stats.span_bytes_decompressed) == (3, 2 + 21 + 1 + 21)
    assert index.lookup_spans_with_stats(" ")[1] == type(stats)()


def test_case_policy(spark, tmp_path):
    _, index = built(spark, tmp_path, GENES, ["Name"], case_sensitive=True)
    assert ids(index, "Tolq") == [0] and ids(index, "tolQ") == [2] and ids(index, "tolq") == []


def test_other_tag(spark, tmp_path):
    stats, index = built(spark, tmp_path, GENES, ["ID"])
    assert ids(index, "no_name") == [0] and ids(index, "tolq") == []
    assert stats.records_indexed == 1


def test_bed(spark, tmp_path):
    stats, index = built(spark, tmp_path, PEAKS, [], "a.bed")
    assert (stats.records_processed, stats.records_indexed, stats.distinct_terms, stats.unique_spans) == (5, 4, 3, 3)
    assert ids(index, "quill") == [0, 2] and ids(index, "fern") == [1] and ids(index, "moss") == [2]
    first = index.query("quill").first()
    assert (first["start"], first["end"], first["ty"]) == (5, 9, "bed")
    assert [(a["tag"], a["values"]) for a in first["attributes"]] == [("name", ["Quill"])]
    assert [index.query(t, match=m).count() for m, t in [("prefix", "qu"), ("contains", " ui "), ("regex", "^(QUILL|FERN)$"), ("regex", r"\S")]] == [2, 2, 3, 4]


@pytest.fixture(scope="module")
def contigs(spark, tmp_path_factory):
    return built(spark, tmp_path_factory.mktemp("arms"), ARMS, ["Name"])[1]


@pytest.mark.parametrize("wanted, records", [(["arm2"], 1), (["arm1"], 2), (["aRm1", "ARM1"], 2), (["ArM1"], 2), (["arm12"], 1), (["arm1-b", "arm2"], 2), ([], 0), (["nowhere"], 0), (["arm"], 0), (["rm1"], 0), (["arm1-"], 0)])
def test_contigs(contigs, wanted, records):
    rows, stats = contigs.query_with_stats("twin", contigs=wanted)
    assert rows.count() == records == stats.requested_spans == stats.distinct_span_blocks_decoded
    if not records:
        assert stats == type(stats)()


def test_contig_with_prefix(contigs):
    assert contigs.query("tw", match="prefix", contigs=["arm2"]).count() == 1


def gff(*rows):
    return "##gff-version 3\n" + "".join(f"ctg\tlab\tmark\t{a}\t{b}\t.\t+\t.\t{c}\n" for a, b, c in rows)


def test_shared_span_is_verified(spark, tmp_path):
    _, index = built(spark, tmp_path, gff((61, 99, "Name=Cedar"), (61, 99, "Name=Larch")), ["Name"])
    rows, stats = index.query_with_stats("eda", match="contains")
    assert (rows.count(), stats.requested_spans, stats.unique_candidate_records) == (1, 1, 2)


def test_equal_lines_stay_apart(spark, tmp_path):
    _, index = built(spark, tmp_path, gff((4, 70, "Name=pile"), (50, 51, "Name=pile"), (4, 70, "Name=pile")), ["Name"])
    rows, stats = index.query_with_stats("pile")
    assert (rows.count(), stats.requested_spans, stats.distinct_span_blocks_decoded) == (3, 2, 1)


def test_same_start_keeps_file_order(spark, tmp_path):
    _, index = built(spark, tmp_path, gff((8, 12, "Name=fan"), (8, 95, "Name=fan"), (8, 40, "Name=fan")), ["Name"])
    assert [r["end"] for r in index.query("fan").collect()] == [12, 95, 40]


def test_empty_value_beside_an_indexed_span(spark, tmp_path):
    _, index = built(spark, tmp_path, gff((1, 5, "Name=foo"), (1, 5, "Name=")), ["Name"])
    assert index.query(".*", match="regex").count() == 2


def test_repeated_tag_last_counts_in_results(spark, tmp_path):
    _, index = built(spark, tmp_path, gff((1, 5, "Name=a;x=1;Name=b")), ["Name"])
    row = index.query("a").first()
    assert [(a["tag"], a["values"]) for a in row["attributes"]] == [("Name", ["b"]), ("x", ["1"])]


def test_unknown_tag_gives_an_empty_index(spark, tmp_path):
    stats, index = built(spark, tmp_path, GENES, ["nothing"])
    assert (stats.distinct_terms, stats.unique_spans) == (0, 0) and index.query("x").count() == 0
    validate_index(spark, tmp_path / "index")


def test_fasta_tail_is_no_record(spark, tmp_path):
    stats, _ = built(spark, tmp_path, gff((1, 5, "Name=a")) + "##FASTA\n>chr1\nACGT\n", ["Name"])
    assert stats.records_processed == 1


@pytest.mark.parametrize("bad", ["chr1\ts\tgene\t0\t5\t.\t+\t.\tName=a", "chr1\ts\tgene\tx\t5\t.\t+\t.\tName=a", "chr1\ts\tgene\t1\t5\tz\t+\t.\tName=a", "chr1\ts\tgene\t1\t5\t.\tx\t.\tName=a", "chr1\ts\tgene\t1\t5\t.\t+\t3\tName=a", "chr1\ts\tgene\t1\t5\t.\t+\t.\tunused"])
def test_malformed_records(spark, tmp_path, bad):
    with pytest.raises(InputError, match="line 2"):
        built(spark, tmp_path, "##gff-version 3\n" + bad + "\n", ["Name"])


def test_stale_and_corrupt(spark, tmp_path):
    _, _ = built(spark, tmp_path, GENES + "##FASTA\n>a\nAC\n", ["Name"])
    source, index = tmp_path / "a.gff3", tmp_path / "index"
    assert validate_index(spark, index).posting_count == 4
    with pytest.raises(StaleIndexError):
        open_index(spark, source, index, attributes=["Alias"])
    source.write_text(source.read_text() + "G")
    with pytest.raises(StaleIndexError):
        open_index(spark, source, index)
    shutil.rmtree(index / "postings")
    with pytest.raises(CorruptIndexError):
        validate_index(spark, index)
    with pytest.raises(CorruptIndexError):
        inspect_index(spark, tmp_path)


def test_span_blocks(spark, tmp_path):
    rows = "".join(f"chr1\t{i * 10}\t{i * 10 + 5}\tn{i}\n" for i in range(5000)) + "".join(f"chr2\t{i * 10}\t{i * 10 + 5}\tm{i}\n" for i in range(3))
    source = tmp_path / "a.bed"
    source.write_text(rows)
    build_index(spark, source, tmp_path / "index", span_block_size=1024)
    blocks = IndexReader(spark, tmp_path / "index").spans.groupBy("block_id").count().orderBy("block_id").collect()
    assert [r["count"] for r in blocks] == [1024, 1024, 1024, 1024, 904, 3]


def test_arguments():
    assert attribute_tags(["a", "b", "a"]) == ["a", "b"]
    for bad in ([], ["a", ""]):
        with pytest.raises(InputError):
            attribute_tags(bad)


def test_many_spans_are_joined(base):
    from locusframe.operators.query import candidates

    _, index = base
    wanted = index.lookup_span_ids("to", "prefix")
    lines = [sorted(r["raw_line"] for r in candidates(index.records, wanted, few, some).collect()) for few, some in ((9, 9), (1, 9), (0, 1))]
    assert lines[0] == lines[1] == lines[2] and len(lines[0]) == 3


def test_a_build_replaces_an_older_index(spark, tmp_path):
    built(spark, tmp_path, GENES, ["Name"])
    _, index = built(spark, tmp_path, gff((1, 5, "Name=new")), ["Name"])
    assert index.query("new").count() == 1 and index.query("tolq").count() == 0
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.gff3", "index"]
    assert open_index(spark, "no such file", tmp_path / "index", check_source=False).query("new").count() == 1


def test_progress_and_resources(spark, tmp_path):
    seen = []
    built(spark, tmp_path, GENES, ["Name"], progress=seen.append)
    assert seen[0] == "scan" and seen[-1] == "done"
    with pytest.raises(InputError, match="memory_budget"):
        built(spark, tmp_path, GENES, ["Name"], memory_budget=0)


def test_attributes_of_bed_warn(spark, tmp_path):
    with pytest.warns(UserWarning):
        built(spark, tmp_path, PEAKS, ["Name"], "a.bed")
