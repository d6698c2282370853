"""Build statistics, among them the closed forms of structural encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import varint_length


def observation_counts(observations: DataFrame) -> DataFrame:
    n = F.size("terms")
    return observations.agg(
        F.count("*").alias("records_processed"),
        F.count_if(n > 0).alias("records_indexed"),
        F.coalesce(F.sum(n.cast("long")), F.lit(0)).alias("pair_observations"),
    )


def index_counts(spans: DataFrame, postings: DataFrame) -> DataFrame:
    s = spans.agg(F.count("*").alias("unique_spans"))
    p = postings.agg(F.count_distinct("term").alias("distinct_terms"), F.count("*").alias("postings"))
    return s.crossJoin(p)  # one row each


def build_counts(observations: DataFrame, spans: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: all logical counts."""
    both = observation_counts(observations).crossJoin(index_counts(spans, postings))  # one row each
    return both.select(
        "records_processed", "records_indexed", "distinct_terms", "unique_spans", "postings",
        (F.col("pair_observations") - F.col("postings")).alias("duplicate_postings_removed"),
        (F.col("records_indexed") - F.col("unique_spans")).alias("duplicate_spans_removed"),
    )


def posting_bytes(postings: DataFrame) -> DataFrame:
    """Per term: bytes of count, first id and id gaps as varints."""
    by_term = Window.partitionBy("term").orderBy("span_id")
    gap = F.col("span_id") - F.coalesce(F.lag("span_id").over(by_term), F.lit(0))
    return (
        postings.withColumn("bytes", varint_length(gap))
        .groupBy("term")
        .agg(F.count("*").alias("ids"), F.sum("bytes").alias("bytes"))
        .select("term", "ids", (F.col("bytes") + varint_length(F.col("ids"))).alias("posting_bytes"))
    )


def start_bytes(spans: DataFrame) -> DataFrame:
    """Per block: rows, first id, bytes of start gaps as varints (the first start is in the directory)."""
    in_block = Window.partitionBy("block_id").orderBy("start", "length")
    gap = F.col("start") - F.lag("start").over(in_block)
    return (
        spans.withColumn("bytes", F.when(gap.isNotNull(), varint_length(gap)).otherwise(0))
        .groupBy("block_id")
        .agg(F.count("*").alias("block_rows"), F.min("span_id").alias("first_span_id"), F.sum("bytes").alias("start_bytes"))
    )


def length_bytes(spans: DataFrame) -> DataFrame:
    """Per block: 20 bytes and the lengths as varints, or bit-packed over the least where that is strictly smaller."""
    width = F.when(F.max("length") == F.min("length"), 0).otherwise(F.length(F.bin(F.max("length") - F.min("length"))))
    sums = spans.groupBy("block_id").agg(
        F.sum(varint_length(F.col("length"))).alias("varints"), F.ceil(F.count("*") * width / 8).cast("long").alias("packed"), width.alias("width")
    )
    packed = (F.col("width") <= 63) & (F.col("packed") < F.col("varints"))
    return sums.select("block_id", packed.alias("is_packed"), (20 + F.when(packed, F.col("packed")).otherwise(F.col("varints"))).alias("length_bytes"))


def structural_totals(spans: DataFrame, postings: DataFrame) -> DataFrame:
    s = start_bytes(spans).agg(F.count("*").alias("span_blocks"), F.coalesce(F.sum("start_bytes"), F.lit(0)).alias("span_starts_bytes_before_compression"))
    n = length_bytes(spans).agg(
        F.coalesce(F.sum("length_bytes"), F.lit(0)).alias("span_lengths_bytes_before_compression"),
        F.count_if("is_packed").alias("length_for_blocks"),
        F.count_if(~F.col("is_packed")).alias("length_varint_blocks"),
    )
    p = posting_bytes(postings).agg(F.coalesce(F.sum("posting_bytes"), F.lit(0)).alias("postings_bytes_before_compression"))
    return s.crossJoin(n).crossJoin(p)  # one row each
