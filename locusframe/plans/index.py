"""The index as a folder of Parquet tables, and its life: build, open, query, inspect."""

from __future__ import annotations

import json
import os
import time
import uuid
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptIndexError, InputError, SourceIoError, StaleIndexError
from ..functions.matching import Matcher
from ..operators import query as q
from ..operators import spans as s
from ..operators import statistics as st
from ..operators.sort import input_errors
from ..sources.coordinate_index import dictionary_fingerprint, discover, read_coordinate_index, sha256_file, validate_format
from ..sources.formats import BED, source_format
from ..sources.lines import read_lines, records_only
from ..sources.records import parse
from ..staging import materialize, release

VERSION = (1, 0)
TABLES = ["records", "references", "spans", "postings", "meta"]
PHASES = ["scan", "merge", "postings", "spans", "serialize", "done"]


@dataclass(frozen=True)
class BuildStats:
    records_processed: int
    records_indexed: int
    distinct_terms: int
    unique_spans: int
    postings: int
    duplicate_postings_removed: int
    duplicate_spans_removed: int
    index_bytes: int
    postings_bytes_before_compression: int
    postings_bytes_after_compression: int
    span_bytes_fixed_width: int
    span_bytes_structural: int
    span_bytes_after_compression: int
    span_starts_bytes_before_compression: int
    span_lengths_bytes_before_compression: int
    delta_start_blocks: int
    length_varint_blocks: int
    length_for_blocks: int
    bytes_per_term: float
    bytes_per_posting: float
    bytes_per_unique_span: float
    scan_seconds: float
    merge_seconds: float
    encode_postings_seconds: float
    encode_spans_seconds: float
    serialize_seconds: float
    total_seconds: float


@dataclass(frozen=True)
class IndexMetadata:
    major_version: int
    minor_version: int
    format: str
    case_sensitive: bool
    attributes: list[str]
    source_fingerprint: str
    coordinate_index_fingerprint: str
    reference_dictionary_fingerprint: str
    term_count: int
    unique_span_count: int
    posting_count: int
    span_block_count: int
    reference_count: int
    span_block_size: int
    postings_uncompressed_bytes: int
    starts_uncompressed_bytes: int
    lengths_uncompressed_bytes: int
    span_uncompressed_bytes: int
    delta_start_blocks: int
    varint_length_blocks: int
    for_length_blocks: int


@dataclass(frozen=True)
class LookupStats:
    postings_bytes_decompressed: int = 0
    span_bytes_decompressed: int = 0


def _size(path: str) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def written(df: DataFrame, path: str) -> DataFrame:
    """Small row groups: lookups skip all but a few."""
    df.write.option("parquet.block.size", 8 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_folder(spark: SparkSession, new: str, old: str) -> None:
    """Puts a finished folder in the place of another, which is moved aside and deleted only then."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(old).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = path(f"{old}.{uuid.uuid4().hex}.old")
    had = fs.exists(path(old))
    if had and not fs.rename(path(old), aside):
        raise SourceIoError(f"cannot replace {old}")
    if not fs.rename(path(new), path(old)):
        if had:
            fs.rename(aside, path(old))
        raise SourceIoError(f"cannot write {old}")
    if had:
        fs.delete(aside, True)


def annotation_of(spark: SparkSession, source) -> DataFrame:
    """All feature records of a file."""
    fmt = source_format(source)
    return parse(records_only(read_lines(spark, source), fmt), fmt)


def build_index(
    spark: SparkSession, source, output, attributes: Iterable[str] = (), *, coordinate_index=None, case_sensitive: bool = False,
    span_block_size: int = 4096, memory_budget: int = 64 << 20, compression_threads: int | None = None, bgzf_threads: int | None = None,
    progress: Callable[[str], None] | None = None,
) -> BuildStats:
    """Builds the index of a source in the folder output, replacing an index that is there.

    Contigs come from the coordinate index if one is given, else by first appearance. The resource arguments are checked but
    left to Spark, which spills and parallelizes by itself.
    """
    for name, n in (("memory_budget", memory_budget), ("compression_threads", compression_threads), ("bgzf_threads", bgzf_threads)):
        if n is not None and n <= 0:
            raise InputError(f"{name} must be positive")
    fmt, began, clock = source_format(source), time.time(), {}

    def phase(name: str, run: Callable[[], Any]) -> Any:
        if progress:
            progress(name)
        at = time.time()
        out = input_errors(run)
        clock[name] = time.time() - at
        return out

    if fmt == BED:
        if list(attributes):
            warnings.warn("attributes are ignored for BED: column 4 is indexed as name", UserWarning, stacklevel=2)
        tags = ["name"]
    else:
        tags = s.attribute_tags(attributes)
    out = str(output)
    building = f"{out}.building-{uuid.uuid4().hex}"
    records = annotation_of(spark, source)
    records = phase("scan", lambda: materialize(records.where(F.concat("score", "strand", "phase").isNotNull()), "index-records"))
    if coordinate_index is not None:
        found = read_coordinate_index(coordinate_index)
        validate_format(found, fmt)
        references = spark.createDataFrame(list(enumerate(found.names)), "reference_id int, name string")
    else:
        references = s.references_of(records)
    references = written(references.coalesce(1), f"{building}/references")
    observed = s.observe(records, references, tags, case_sensitive, keep=True)
    observed = phase("merge", lambda: materialize(observed, "index-observed"))
    spans = phase("spans", lambda: written(s.spans_of(observed, span_block_size), f"{building}/spans"))
    # Row groups hold runs of terms, so exact and prefix queries read few of them.
    ordered = s.postings_of(observed, spans).repartitionByRange("term").sortWithinPartitions("term", "span_id")
    postings = phase("postings", lambda: written(ordered, f"{building}/postings"))
    counts = st.build_counts(observed, spans, postings).first().asDict()
    forms = st.structural_totals(spans, postings).first().asDict()
    names = [r["name"] for r in references.orderBy("reference_id").toLocalIterator()]  # one row a contig
    meta = IndexMetadata(
        *VERSION, fmt, case_sensitive, tags, sha256_file(source), sha256_file(coordinate_index) if coordinate_index else "", dictionary_fingerprint(names),
        counts["distinct_terms"], counts["unique_spans"], counts["postings"], forms["span_blocks"], len(names), span_block_size,
        forms["postings_bytes_before_compression"], forms["span_starts_bytes_before_compression"], forms["span_lengths_bytes_before_compression"],
        forms["span_starts_bytes_before_compression"] + forms["span_lengths_bytes_before_compression"], forms["span_blocks"], forms["length_varint_blocks"], forms["length_for_blocks"],
    )

    def write() -> None:
        # All records of a span, with or without terms of their own, lie in the order of the spans.
        of_span = observed.join(spans.select("span_id", *s.SPAN), s.SPAN).select("record.*", "reference_id", "span_id")
        written(of_span.repartitionByRange("span_id").sortWithinPartitions("span_id", "src_pos"), f"{building}/records")
        written(spark.createDataFrame([(json.dumps(meta.__dict__),)], "meta string").coalesce(1), f"{building}/meta")
        replace_folder(spark, building, out)

    phase("serialize", write)
    release(records, observed)
    total, post, span = _size(out), _size(f"{out}/postings"), _size(f"{out}/spans")
    if progress:
        progress("done")
    return BuildStats(
        **counts, index_bytes=total, postings_bytes_before_compression=forms["postings_bytes_before_compression"], postings_bytes_after_compression=post,
        span_bytes_fixed_width=20 * counts["unique_spans"], span_bytes_structural=meta.span_uncompressed_bytes, span_bytes_after_compression=span,
        span_starts_bytes_before_compression=forms["span_starts_bytes_before_compression"], span_lengths_bytes_before_compression=forms["span_lengths_bytes_before_compression"],
        delta_start_blocks=forms["span_blocks"], length_varint_blocks=forms["length_varint_blocks"], length_for_blocks=forms["length_for_blocks"],
        bytes_per_term=total / max(counts["distinct_terms"], 1), bytes_per_posting=total / max(counts["postings"], 1), bytes_per_unique_span=total / max(counts["unique_spans"], 1),
        scan_seconds=clock["scan"], merge_seconds=clock["merge"], encode_postings_seconds=clock["postings"], encode_spans_seconds=clock["spans"],
        serialize_seconds=clock["serialize"], total_seconds=time.time() - began,
    )


def inspect_index(spark: SparkSession, index) -> IndexMetadata:
    try:
        values = json.loads(spark.read.parquet(f"{index}/meta").first()["meta"])
        meta = IndexMetadata(**{f.name: values[f.name] for f in fields(IndexMetadata)})
    except Exception as e:
        raise CorruptIndexError(f"{index} is not an index: {str(e).splitlines()[0]}") from e
    if (meta.major_version, meta.minor_version) != VERSION:
        raise CorruptIndexError(f"{index} has version {meta.major_version}.{meta.minor_version}")
    if meta.posting_count > meta.term_count * meta.unique_span_count or meta.posting_count < meta.term_count:
        raise CorruptIndexError(f"{index} has impossible counts")
    return meta


def validate_index(spark: SparkSession, index) -> IndexMetadata:
    """inspect_index, and the tables hold what the metadata says."""
    meta = inspect_index(spark, index)
    try:
        tables = {t: spark.read.parquet(f"{index}/{t}") for t in TABLES}
        spans = tables["spans"].agg(F.count("*").alias("n"), F.count_distinct("span_id").alias("ids"), F.max("span_id").alias("last"), F.max("reference_id").alias("reference")).first()
        counted = tables["postings"].agg(F.count("*").alias("n"), F.count_distinct("term").alias("terms")).first()
        lost = tables["postings"].join(tables["spans"], "span_id", "left_anti").limit(1).count()
        names = tables["references"].count()
    except Exception as e:
        raise CorruptIndexError(f"{index}: {str(e).splitlines()[0]}") from e
    dense = spans["n"] == spans["ids"] == (spans["last"] + 1 if spans["n"] else 0)
    fits = spans["n"] == meta.unique_span_count and counted["n"] == meta.posting_count and counted["terms"] == meta.term_count and names == meta.reference_count
    if not dense or not fits or lost or (spans["reference"] or 0) >= max(1, names):
        raise CorruptIndexError(f"{index}: tables and metadata disagree")
    return meta


class IndexReader:
    """Span lookups on the index alone."""

    def __init__(self, spark: SparkSession, index):
        self.spark, self.path, self.meta = spark, str(index), inspect_index(spark, index)
        self.spans, self.postings, self.references = (spark.read.parquet(f"{index}/{t}") for t in ("spans", "postings", "references"))

    def matcher(self, term: str, match: str = "exact") -> Matcher:
        return Matcher.compile(self.spark, term, match, self.meta.case_sensitive)

    def lookup_span_ids(self, term: str, match: str = "exact") -> DataFrame:
        return q.matching_span_ids(self.postings, self.matcher(term, match)).orderBy("span_id")

    def lookup_spans(self, term: str, match: str = "exact") -> DataFrame:
        return q.requested_spans(self.postings, self.spans, self.references, self.matcher(term, match)).orderBy("span_id")

    def lookup_spans_with_stats(self, term: str, match: str = "exact") -> tuple[DataFrame, LookupStats]:
        """Bytes are those of the structural encodings that the lookup touches: matching postings, blocks of requested spans."""
        matcher, rows = self.matcher(term, match), self.lookup_spans(term, match)
        if matcher.empty:
            return rows, LookupStats()
        post = st.posting_bytes(self.postings.where(matcher.predicate(F.col("term")))).agg(F.sum("posting_bytes")).first()[0]
        touched = self.spans.join(rows.select("block_id").distinct(), "block_id", "left_semi")
        span = sum((st.start_bytes(touched).agg(F.sum("start_bytes")).first()[0] or 0, st.length_bytes(touched).agg(F.sum("length_bytes")).first()[0] or 0))
        return rows, LookupStats(post or 0, span)

    def resolve_span_ids(self, ids: list[int]) -> DataFrame:
        """Spans in the order of ids, repeats kept."""
        given = self.spark.createDataFrame(list(enumerate(ids)), "pos long, span_id long")
        return s.resolve_spans(given, self.spans)

    def resolve_span_id(self, span_id: int) -> tuple[int, int, int]:
        """(reference_id, start, length) of one span."""
        found = self.spans.where(F.col("span_id") == span_id).select(*s.SPAN).first()
        if found is None:
            raise InputError(f"no span {span_id}")
        return tuple(found)

    def resolve_span_ids_with_stats(self, ids: list[int]) -> tuple[DataFrame, LookupStats]:
        rows = self.resolve_span_ids(ids)
        touched = self.spans.join(rows.select("block_id").distinct(), "block_id", "left_semi")
        span = sum((st.start_bytes(touched).agg(F.sum("start_bytes")).first()[0] or 0, st.length_bytes(touched).agg(F.sum("length_bytes")).first()[0] or 0))
        return rows, LookupStats(0, span)

    def lookup_span_ids_with_stats(self, term: str, match: str = "exact") -> tuple[DataFrame, LookupStats]:
        """Ids need the postings only."""
        matcher, rows = self.matcher(term, match), self.lookup_span_ids(term, match)
        if matcher.empty:
            return rows, LookupStats()
        return rows, LookupStats(st.posting_bytes(self.postings.where(matcher.predicate(F.col("term")))).agg(F.sum("posting_bytes")).first()[0] or 0, 0)

    lookup_spans_with_mode, lookup_spans_with_mode_and_stats = lookup_spans, lookup_spans_with_stats
    lookup_span_ids_with_mode, lookup_span_ids_with_mode_and_stats = lookup_span_ids, lookup_span_ids_with_stats


class IndexedSource(IndexReader):
    """Record queries; opening it checks that the index belongs to the source as it is (check_source: by reading all of it)."""

    def __init__(
        self, spark: SparkSession, source, index, coordinate_index=None, attributes: Iterable[str] | None = None, case_sensitive: bool | None = None, check_source: bool = True
    ):
        super().__init__(spark, index)
        if check_source and sha256_file(source) != self.meta.source_fingerprint:
            raise StaleIndexError(f"{index} was built from another version of {source}")
        if coordinate_index is None and self.meta.coordinate_index_fingerprint and check_source:
            coordinate_index = next((p for p in (f"{source}.tbi", f"{source}.csi") if os.path.exists(p)), None)
        if self.meta.coordinate_index_fingerprint and coordinate_index is not None and sha256_file(coordinate_index) != self.meta.coordinate_index_fingerprint:
            raise StaleIndexError(f"{index} was built with another coordinate index")
        if attributes is not None and list(attributes) != self.meta.attributes:
            raise StaleIndexError(f"{index} was built for attributes {self.meta.attributes}")
        if case_sensitive is not None and case_sensitive != self.meta.case_sensitive:
            raise StaleIndexError(f"{index} was built with another case policy")
        self.records = spark.read.parquet(f"{index}/records")
        self.coordinate_index_path = coordinate_index

    def metadata(self) -> IndexMetadata:
        return self.meta

    def _verified(self, candidates: DataFrame, matcher: Matcher) -> DataFrame:
        return q.verified(candidates, matcher, self.meta.attributes, self.meta.case_sensitive, self.meta.format == BED)

    def _requested(self, matcher: Matcher, contigs: Iterable[str] | None) -> DataFrame:
        """Ids of the requested spans; without contigs the postings tell them."""
        if contigs is None:
            return q.matching_span_ids(self.postings, matcher)
        return q.requested_spans(self.postings, self.spans, self.references, matcher, contigs)

    def query(self, term: str, *, match: str = "exact", contigs: Iterable[str] | None = None) -> DataFrame:
        """Matching records in source order."""
        matcher = self.matcher(term, match)
        if matcher.empty:
            return q.shaped(self.records.limit(0))
        return q.shaped(self._verified(q.candidates(self.records, self._requested(matcher, contigs)), matcher))

    def query_with_stats(self, term: str, *, match: str = "exact", contigs: Iterable[str] | None = None) -> tuple[DataFrame, q.QueryStats]:
        """Candidates are the records of the requested spans; there are no file chunks, so those counts stay 0."""
        matcher = self.matcher(term, match)
        rows = self.query(term, match=match, contigs=contigs)
        if matcher.empty:
            return rows, q.QueryStats()
        wanted = q.requested_spans(self.postings, self.spans, self.references, matcher, contigs)
        n = wanted.agg(F.count("*").alias("spans"), F.count_distinct("block_id").alias("blocks")).first()
        if not n["spans"]:
            return rows, q.QueryStats()
        found = q.candidates(self.records, wanted)
        stats = q.QueryStats(n["spans"], n["blocks"], n["spans"], unique_candidate_records=found.count(), matching_records=rows.count())
        return rows, stats

    query_name = query_with_mode = query_name_with_mode = query_on_contigs = query_on_contigs_with_mode = query
    query_name_with_stats = query_with_mode_and_stats = query_name_with_mode_and_stats = query_with_stats
    query_on_contigs_with_stats = query_on_contigs_with_mode_and_stats = query_with_stats


def open_index(spark: SparkSession, source, index, coordinate_index=None, **options) -> IndexedSource:
    return IndexedSource(spark, source, index, coordinate_index, **options)


def query_index(spark: SparkSession, source, index, term: str, *, match: str = "exact", contigs=None, coordinate_index=None) -> DataFrame:
    return open_index(spark, source, index, coordinate_index).query(term, match=match, contigs=contigs)


__all__ = ["BuildStats", "IndexMetadata", "IndexReader", "IndexedSource", "annotation_of", "build_index", "discover", "inspect_index", "open_index", "query_index", "validate_index"]
