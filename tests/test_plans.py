"""What plans read and how they move rows."""

import pytest

from locusframe.functions.matching import Matcher
from locusframe.operators import intervals as iv
from locusframe.operators import query as q
from locusframe.plans.index import build_index, open_index


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("plans")
    (folder / "a.bed").write_text("".join(f"chr{i % 3}\t{i}\t{i + 5}\tname{i % 50}\n" for i in range(2000)))
    build_index(spark, folder / "a.bed", folder / "index")
    return open_index(spark, folder / "a.bed", folder / "index")


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("mode, pushed", [("exact", "EqualTo(term,name7)"), ("prefix", "StringStartsWith(term,name7)"), ("contains", "StringContains(term,name7)")])
def test_term_filters_reach_the_scan(spark, index, mode, pushed):
    text = plan(q.matching_span_ids(index.postings, Matcher.compile(spark, "name7", mode)))
    assert pushed in text and "ReadSchema: struct<term:string,span_id:bigint>" in text


def test_record_queries_read_id_ranges(index):
    text = plan(index.query("name7"))
    assert "In(span_id" in text and "Python" not in text
    many = q.candidates(index.records, index.lookup_span_ids("name", "prefix"), few=5)
    assert "BroadcastHashJoin" in plan(many) and "PushedFilters: [Or(" in plan(many)


def test_scalar_work_stays_in_the_engine(index):
    text = plan(q.scan_matches(index.records, Matcher.compile(index.spark, "x", "contains"), ["name"]))
    assert "Exchange" not in text and "Python" not in text


def test_overlaps_join_on_bins(spark):
    df = spark.createDataFrame([("a", 1, 5)], "reference string, start long, end long")
    text = plan(iv.overlap_join(df, df))
    assert "NestedLoop" not in text and "Cartesian" not in text
