"""Queries: terms to spans, spans to records, values verified, source order kept."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.matching import Matcher
from ..functions.text import ascii_lower
from ..sources.records import last_of_each_tag
from .spans import SPAN, configured_values

RECORD = ["reference_sequence_name", "source", "ty", "start", "end", "score", "strand", "phase", "attributes", "raw_line"]


@dataclass(frozen=True)
class QueryStats:
    requested_spans: int = 0
    distinct_span_blocks_decoded: int = 0
    exact_interval_queries: int = 0
    raw_chunks: int = 0
    merged_chunks: int = 0
    unique_candidate_records: int = 0
    matching_records: int = 0
    bytes_read: int = 0


def on_contigs(references: DataFrame, contigs: Iterable[str]) -> DataFrame:
    """References named by any of the contigs, ASCII case ignored, whole names only."""
    wanted = [c.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for c in contigs]
    return references.where(ascii_lower(F.col("name")).isin(wanted) if wanted else F.lit(False))


def matching_span_ids(postings: DataFrame, matcher: Matcher) -> DataFrame:
    if matcher.empty:
        return postings.select("span_id").limit(0)
    return postings.where(matcher.predicate(F.col("term"))).select("span_id").distinct()


def requested_spans(postings: DataFrame, spans: DataFrame, references: DataFrame, matcher: Matcher, contigs=None) -> DataFrame:
    found = spans.join(matching_span_ids(postings, matcher), "span_id", "left_semi")
    if contigs is not None:
        found = found.join(on_contigs(references, contigs).select("reference_id"), "reference_id", "left_semi")
    return found


def ranges_over(ids: list[int], most: int = 50) -> list[tuple[int, int]]:
    """At most ``most`` ranges that hold all ids, cut at the widest gaps."""
    ids = sorted(ids)
    cuts = sorted(sorted(range(1, len(ids)), key=lambda i: ids[i - 1] - ids[i])[: most - 1])
    return [(ids[a], ids[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True)]


def candidates(records: DataFrame, requested: DataFrame, few: int = 200, some: int = 100_000) -> DataFrame:
    """Records (with span_id) of the requested spans.

    Records lie in the order of their spans, so up to ``few`` ids in the scan's filter skip most row groups. Up to ``some`` are
    broadcast, with ranges over them in the filter; more are joined.
    """
    ids = [r["span_id"] for r in requested.select("span_id").limit(some + 1).collect()]
    if len(ids) <= few:
        return records.where(F.col("span_id").isin(ids) if ids else F.lit(False))
    if len(ids) <= some:
        listed = records.sparkSession.createDataFrame(pd.DataFrame({"span_id": ids}), "span_id long")
        near = reduce(lambda x, y: x | y, (F.col("span_id").between(a, b) for a, b in ranges_over(ids)))
        return records.where(near).join(F.broadcast(listed), "span_id", "left_semi")
    return records.join(requested.select("span_id"), "span_id", "left_semi")


def verified(records: DataFrame, matcher: Matcher, tags: list[str], case_sensitive: bool = False, skip_empty: bool = False) -> DataFrame:
    """Records with a configured value that matches; BED names that are empty don't count (skip_empty)."""
    values = configured_values(F.col("attributes"), tags, case_sensitive)

    def hit(v):
        return matcher.predicate(v) & (v != "") if skip_empty else matcher.predicate(v)

    return records.where(F.exists(values, hit))


def shaped(records: DataFrame) -> DataFrame:
    """The returned columns, in source order."""
    rows = records.withColumn("attributes", last_of_each_tag(F.col("attributes")))
    return rows.orderBy("src_pos").select(*RECORD)


def scan_matches(annotation: DataFrame, matcher: Matcher, tags: list[str], case_sensitive: bool = False) -> DataFrame:
    """Matches by one scan: equal to the indexed query unless the matcher matches the empty string."""
    return annotation.limit(0) if matcher.empty else verified(annotation, matcher, tags, case_sensitive, True)


__all__ = ["SPAN", "QueryStats", "candidates", "matching_span_ids", "on_contigs", "requested_spans", "scan_matches", "shaped", "verified"]
