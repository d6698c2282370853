"""Observations, spans and postings: the logical plan of the inverted index."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InputError
from ..functions.coords import gff_to_span
from ..functions.text import normalize
from ..staging import numbered

SPAN = ["reference_id", "start", "length"]


def attribute_tags(tags: Iterable[str]) -> list[str]:
    """Distinct tags in order; none or an empty one is an error."""
    found = list(dict.fromkeys(tags))
    if not found or "" in found:
        raise InputError("at least one attribute is needed, and none may be empty")
    return found


def configured_values(attributes: Column, tags: list[str], case_sensitive: bool = False) -> Column:
    """Normalized values of every occurrence of the tags, empty ones and repeats included."""
    own = F.filter(attributes, lambda a: a["tag"].isin(tags))
    return F.transform(F.flatten(F.transform(own, lambda a: a["values"])), lambda v: normalize(v, case_sensitive))


def references_of(annotation: DataFrame) -> DataFrame:
    """(reference_id, name): contigs by first appearance."""
    first = annotation.groupBy(F.col("reference_sequence_name").alias("name")).agg(F.min("src_pos").alias("first"))
    # One row a contig.
    return first.select((F.row_number().over(Window.orderBy("first", "name")) - 1).cast("int").alias("reference_id"), "name")


def observe(annotation: DataFrame, references: DataFrame, tags: list[str], case_sensitive: bool = False, keep: bool = False) -> DataFrame:
    """annotation -> (src_pos, reference_id, start, length, terms), and with keep its own columns; an unknown contig is an error."""
    start, length = gff_to_span(F.col("start"), F.col("end"))
    terms = F.filter(configured_values(F.col("attributes"), tags, case_sensitive), lambda v: v != "")
    known = annotation.join(references.withColumnRenamed("name", "reference_sequence_name"), "reference_sequence_name", "left")
    missing = F.raise_error(F.concat(F.lit("contig is not in the coordinate index: "), "reference_sequence_name", F.lit(" at line "), (F.col("src_pos") + 1).cast("string")))
    record = [F.struct(*annotation.columns).alias("record")] if keep else []
    return known.select("src_pos", F.coalesce("reference_id", missing.cast("int")).alias("reference_id"), start.alias("start"), length.alias("length"), terms.alias("terms"), *record)


def spans_of(observations: DataFrame, block_rows: int = 4096) -> DataFrame:
    """Distinct spans of indexed records: (span_id, reference_id, start, length, block_id).

    Ids are dense and in (reference, start, length) order; blocks are runs of block_rows spans of one reference.
    """
    if not 1 <= block_rows <= 1_000_000:
        raise InputError("span block size must be from 1 to 1000000")
    spans = numbered(observations.where(F.size("terms") > 0).select(*SPAN).distinct(), SPAN, "span_id", "spans")
    # Ids are dense within a reference too: the first id of each tells the place in it. One row a reference.
    first = spans.groupBy("reference_id").agg(F.min("span_id").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("reference_id").rowsBetween(Window.unboundedPreceding, -1)
    blocks = F.ceil(F.col("n") / block_rows)
    first = first.withColumn("blocks_before", F.coalesce(F.sum(blocks).over(before), F.lit(0)))
    block = F.col("blocks_before") + F.floor((F.col("span_id") - F.col("first")) / block_rows)
    return spans.join(F.broadcast(first), "reference_id").select("span_id", *SPAN, block.cast("long").alias("block_id"))


def postings_of(observations: DataFrame, spans: DataFrame) -> DataFrame:
    """Distinct (term, span_id)."""
    pairs = observations.select(*SPAN, F.explode("terms").alias("term")).distinct()
    return pairs.join(spans.select("span_id", *SPAN), SPAN).select("term", "span_id")


def posting_lists(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.sort_array(F.collect_set("span_id")).alias("span_ids"))


def resolve_spans(ids: DataFrame, spans: DataFrame) -> DataFrame:
    """(pos, span_id) to spans by pos, repeats kept; an unknown id is an error."""
    joined = ids.join(spans, "span_id", "left")
    bad = F.raise_error(F.concat(F.lit("corrupt index: no span "), F.col("span_id").cast("string")))
    return joined.withColumn("reference_id", F.coalesce("reference_id", bad.cast("int"))).orderBy("pos")
