import pytest

from locusframe.errors import InputError
from locusframe.operators.sort import sort_file

SHUFFLED = """##gff-version 3
linkage20\tlab\tregion\t5\t90\t.\t-\t.\tID=later contig
linkage3\tlab\tCDS\t40\t75\t.\t-\t0\tID=piece;Parent=mrna%2D7,lone
Zeta1\tlab\trepeat\t1\t2\t.\t.\t.\tID=last contig
linkage3\tlab\tmRNA\t40\t75\t.\t-\t.\tParent=locus%3B1;ID=mrna-7
#a remark between records
linkage3\tlab\trepeat\t40\t75\t.\t.\t.\tID=lone
linkage3\tlab\tlocus\t40\t75\t.\t-\t.\tID=locus%3B1
linkage3\tlab\trepeat\t40\t41\t.\t.\t.\tID=brief
"""


def run(spark, folder, text, name="a.gff"):
    (folder / name).write_text(text)
    sort_file(spark, folder / name, folder / f"out-{name}")
    return (folder / f"out-{name}").read_text()


def test_hierarchy_and_natural_order(spark, tmp_path):
    lines = run(spark, tmp_path, SHUFFLED).splitlines()
    assert lines[:2] == ["##gff-version 3", "#a remark between records"]
    assert [x.split("ID=")[1].split(";")[0].strip() for x in lines[2:]] == ["brief", "lone", "locus%3B1", "mrna-7", "piece", "later contig", "last contig"]


@pytest.mark.parametrize("pairs", [[("a", "b"), ("b", "a")], [("a", "a")]])
def test_cycles(spark, tmp_path, pairs):
    text = "".join(f"chr1\ts\tgene\t1\t5\t.\t+\t.\tID={i};Parent={p}\n" for i, p in pairs)
    with pytest.raises(InputError, match="cycle among records on contig \"chr1\" at 1..5"):
        run(spark, tmp_path, text)


def test_parent_elsewhere_does_not_move_the_child(spark, tmp_path):
    text = "chr1\ts\texon\t5\t9\t.\t+\t.\tID=c;Parent=p\nchr1\ts\tgene\t5\t12\t.\t+\t.\tID=p\n"
    assert run(spark, tmp_path, text) == text


def test_last_of_repeated_tags(spark, tmp_path):
    text = "chr1\ts\texon\t1\t5\t.\t+\t.\tID=x;Parent=no;Par%65nt=I%44\nchr1\ts\tgene\t1\t5\t.\t+\t.\tID=other;ID=ID\n"
    assert run(spark, tmp_path, text).splitlines() == text.splitlines()[::-1]


def test_bed_ties_are_stable(spark, tmp_path):
    rows = [("p10", 7, 9, "n1"), ("p9", 700, 900, "n2"), ("p9", 50, 60, "n3"), ("p9", 50, 55, "n4"), ("p9", 50, 60, "n0"), ("p9", 50, 60, "n3")]
    text = "".join("\t".join(map(str, r)) + "\n" for r in rows)
    assert [x.split()[-1] for x in run(spark, tmp_path, text, "a.bed").splitlines()] == ["n4", "n3", "n0", "n3", "n2", "n1"]


def test_fasta_and_line_ends(spark, tmp_path):
    text = "chr2\ts\tgene\t1\t5\t.\t+\t.\tID=b\r\nchr1\ts\tgene\t1\t5\t.\t+\t.\tID=a\r\n##FASTA\n>z\nACGT"
    assert run(spark, tmp_path, text).splitlines() == ["chr1\ts\tgene\t1\t5\t.\t+\t.\tID=a", "chr2\ts\tgene\t1\t5\t.\t+\t.\tID=b", "##FASTA", ">z", "ACGT"]


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, "") == ""


@pytest.mark.parametrize("name, text, said", [("a.gff", "chr1\ts\tgene\tbad\t5\t.\t+\t.\tID=b\n", "GFF line 1.*invalid start"), ("a.bed", "chr1 nope 5\n", "BED line 1.*invalid start"), ("a.bed", "# note\n", "BED line 1")])
def test_errors_name_the_line(spark, tmp_path, name, text, said):
    with pytest.raises(InputError, match=said):
        run(spark, tmp_path, text, name)
