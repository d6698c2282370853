"""Formats, blocked gzip, coordinate indexes, the command line."""

import gzip
import io
import random

import pytest

from locusframe.cli import parser, run
from locusframe.errors import InputError, SourceIoError
from locusframe.operators.compress import compress_file, sort_and_compress
from locusframe.plans.index import build_index, open_index
from locusframe.sources.bgzf import BgzfWriter, blocks, inflated
from locusframe.sources.coordinate_index import dictionary_fingerprint, discover, read_coordinate_index
from locusframe.sources.formats import source_format
from locusframe.sources.lines import read_lines

SORTED = "##gff-version 3\n" + "".join(f"chr{c}\ts\tgene\t{i}\t{i + 50}\t.\t+\t.\tName=n{i}\n" for c in (1, 2) for i in range(1, 40000, 7))


@pytest.mark.parametrize("path, fmt", [("a.gff", "gff"), ("a.GFF3.gz", "gff"), ("a.gtf.bgz", "gff"), ("x/a.bed.bgzf", "bed")])
def test_format(path, fmt):
    assert source_format(path) == fmt


@pytest.mark.parametrize("path", ["a", "a.txt", "a.gz", "a.bed.gz.gz"])
def test_unknown_format(path):
    with pytest.raises(InputError):
        source_format(path)


def test_blocked_gzip_round_trip(spark, tmp_path):
    path = tmp_path / "a.gff.bgz"
    with open(path, "wb") as f:
        w = BgzfWriter(f)
        w.write(SORTED.encode())
        w.close()
    assert gzip.decompress(path.read_bytes()).decode() == SORTED
    with open(path, "rb") as f:
        assert b"".join(inflated((f.seek(a), f.read(n))[1]) for a, n in blocks(str(path))).decode() == SORTED
    lines = [r["value"] for r in read_lines(spark, path).orderBy("src_pos").collect()]
    assert lines == SORTED.splitlines()


def test_gzip_by_content(spark, tmp_path):
    path = tmp_path / "a.gff"
    with open(path, "wb") as f:
        w = BgzfWriter(f)
        w.write(SORTED.encode())
        w.close()
    assert read_lines(spark, path).count() == len(SORTED.splitlines())
    path.write_bytes(gzip.compress(SORTED.encode()))
    with pytest.raises(InputError, match="gzip"):
        read_lines(spark, path)
    (tmp_path / "a.gff.gz").write_bytes(gzip.compress(b"a\n") + gzip.compress(b"b\n"))
    assert [r["value"] for r in read_lines(spark, tmp_path / "a.gff.gz").orderBy("src_pos").collect()] == ["a", "b"]


@pytest.mark.parametrize("split", [1, 3000, 70000])
def test_blocked_gzip_in_many_splits(spark, tmp_path, split):
    from locusframe.sources.bgzf import BgzfSource, compressed_block

    r = random.Random(split)
    text = "\n".join("x" * r.choice([0, 1, 30, 200, 5000]) + str(i) for i in range(400)) + "\n" * (split % 2)
    raw, at, out = text.encode(), 0, b""
    while at < len(raw):
        n = r.choice([1, 50, 999, 4000])
        out, at = out + compressed_block(raw[at : at + n]), at + n
    path = tmp_path / "a.bgz"
    path.write_bytes(out)
    spark.dataSource.register(BgzfSource)
    rows = spark.read.format("bgzf").option("path", str(path)).option("splitbytes", split).load().orderBy("src_offset").collect()
    assert [x["value"] for x in rows] == text.split("\n")[: len(text.split("\n")) - (text[-1] == "\n")]


def test_plain_lines_in_many_splits(spark, tmp_path):
    (tmp_path / "a.gff").write_text(SORTED)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = read_lines(spark, tmp_path / "a.gff").orderBy("src_pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["value"] for r in rows] == SORTED.splitlines() and [r["src_pos"] for r in rows] == list(range(len(rows)))


def test_compress_and_query(spark, tmp_path):
    (tmp_path / "a.gff").write_text(SORTED)
    out = tmp_path / "a.gff.gz"
    compress_file(tmp_path / "a.gff", out)
    assert gzip.decompress(out.read_bytes()).decode() == SORTED
    assert discover(out) == f"{out}.csi"
    index = read_coordinate_index(f"{out}.csi")
    assert index.names == ["chr1", "chr2"] and index.generic and not index.bed
    raw = out.read_bytes()
    begin, end = min(index.query(1, 6990, 7000))
    text = gzip.decompress(raw[begin >> 16 :])[begin & 0xFFFF :].decode()
    assert "chr2" in text and end > begin
    build_index(spark, out, tmp_path / "index", ["Name"], coordinate_index=f"{out}.csi")
    source = open_index(spark, out, tmp_path / "index", f"{out}.csi")
    assert [r["reference_sequence_name"] for r in source.query("n8").collect()] == ["chr1", "chr2"]
    with pytest.raises(InputError, match="exists"):
        compress_file(tmp_path / "a.gff", out)


def test_overlap_chunks_hold_all_records(tmp_path):
    rows = [(1 + i * 7919 % 3_000_000, i) for i in range(3000)]
    text = "".join(f"chr1\t{s}\t{s + 40 + i % 90000}\tn{i}\n" for s, i in sorted(rows))
    (tmp_path / "a.bed").write_text(text)
    compress_file(tmp_path / "a.bed", tmp_path / "a.bed.gz")
    index = read_coordinate_index(tmp_path / "a.bed.gz.csi")
    raw = (tmp_path / "a.bed.gz").read_bytes()
    for start in (0, 16383, 1_000_000, 2_999_999):
        want = [x for x in text.splitlines() if int(x.split()[1]) < start + 100 and int(x.split()[2]) > start]
        found = set()
        for b, e in index.query(0, start, start + 100):
            data = gzip.decompress(raw[b >> 16 :])[b & 0xFFFF :]
            n = (e & 0xFFFF) - (b & 0xFFFF) if b >> 16 == e >> 16 else len(data)
            found |= set(data[:n].decode().splitlines())
        assert set(want) <= found


def test_compress_keeps_bytes_and_skips_headers(tmp_path):
    text = "track name=x\r\nbrowser position\r\n#c\r\nchr1\t2\t2\tpoint\r\nchr1\t5\t9\tb"
    (tmp_path / "a.bed").write_bytes(text.encode())
    compress_file(tmp_path / "a.bed", tmp_path / "o.bed.gz")
    assert gzip.decompress((tmp_path / "o.bed.gz").read_bytes()) == text.encode()
    assert read_coordinate_index(tmp_path / "o.bed.gz.csi").bed


@pytest.mark.parametrize("text, said", [("chr1\t5\t9\nchr1\t4\t9\n", "sorted"), ("a\t1\t2\nb\t1\t2\na\t3\t4\n", "sorted"), ("a\t34359738367\t34359738369\n", "CSI limit"), ("a\tx\t2\n", "line 1"), ("a\t1_0\t20\n", "line 1"), ("a\t-1\t20\n", "line 1")])
def test_compress_rejects(tmp_path, text, said):
    (tmp_path / "a.bed").write_text(text)
    with pytest.raises(InputError, match=said):
        compress_file(tmp_path / "a.bed", tmp_path / "o.gz")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.bed"]


def test_gtf_attributes_compress(tmp_path):
    (tmp_path / "a.gtf").write_text('chr1\ts\tgene\t1\t5\t.\t+\t.\tgene_id "large"; gene_name "LargeGtf";\n')
    compress_file(tmp_path / "a.gtf", tmp_path / "o.gtf.gz")


def test_sort_and_compress(spark, tmp_path):
    (tmp_path / "a.bed").write_text("chr10\t1\t2\tc\nchr2\t5\t6\tb\nchr2\t1\t2\ta\n")
    sort_and_compress(spark, tmp_path / "a.bed", tmp_path / "o.bed.gz")
    assert gzip.decompress((tmp_path / "o.bed.gz").read_bytes()).decode() == "chr2\t1\t2\ta\nchr2\t5\t6\tb\nchr10\t1\t2\tc\n"
    (tmp_path / "e.gff").write_text("")
    sort_and_compress(spark, tmp_path / "e.gff", tmp_path / "e.gff.gz")
    assert read_coordinate_index(tmp_path / "e.gff.gz.csi").names == []


def test_not_an_index(tmp_path):
    (tmp_path / "x").write_bytes(b"nonsense")
    with pytest.raises(InputError, match="neither TBI nor CSI"):
        read_coordinate_index(tmp_path / "x")
    with pytest.raises(SourceIoError):
        read_coordinate_index(tmp_path / "y")
    with pytest.raises(InputError):
        discover(tmp_path / "x")
    r = random.Random(5)
    for _ in range(256):
        (tmp_path / "x").write_bytes(r.randbytes(r.randrange(200)))
        with pytest.raises(InputError):
            read_coordinate_index(tmp_path / "x")


def test_dictionary_fingerprint_depends_on_bounds():
    assert dictionary_fingerprint(["ab", "c"]) != dictionary_fingerprint(["a", "bc"])


def test_command_line(spark, tmp_path):
    (tmp_path / "a.bed").write_text("ctgX\t4\t9\tQuill\nctgX\t30\t44\tFern\n")
    out = io.StringIO()
    run(spark, parser().parse_args(["build", str(tmp_path / "a.bed"), "--output", str(tmp_path / "i")]), out)
    assert "records_processed: 2" in out.getvalue()
    out = io.StringIO()
    run(spark, parser().parse_args(["query", str(tmp_path / "a.bed"), "qu", "--match", "prefix", "--index", str(tmp_path / "i"), "--contig", "CTGX"]), out)
    assert out.getvalue() == "ctgX\t4\t9\tQuill\n"
    out = io.StringIO()
    run(spark, parser().parse_args(["inspect", str(tmp_path / "i")]), out)
    assert "term_count: 2" in out.getvalue()
    with pytest.raises(InputError):
        run(spark, parser().parse_args(["sort", str(tmp_path / "a.bed"), "--compress"]))
    out = io.BytesIO()
    run(spark, parser().parse_args(["sort", "--ds", str(tmp_path / "a.bed"), "--compress", "--coordinate-index", str(tmp_path / "o.csi")]), out)
    assert gzip.decompress(out.getvalue()) == (tmp_path / "a.bed").read_bytes() and (tmp_path / "o.csi").exists()
    # Defaults: the index beside the file.
    run(spark, parser().parse_args(["build", str(tmp_path / "a.bed")]), io.StringIO())
    out = io.StringIO()
    run(spark, parser().parse_args(["query", str(tmp_path / "a.bed"), "fern"]), out)
    assert out.getvalue() == "ctgX\t30\t44\tFern\n"
