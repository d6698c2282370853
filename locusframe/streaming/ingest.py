"""Postings of annotation files as they arrive in a folder (an extension; batch indexing is plans.index)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.coords import gff_to_span
from ..operators.spans import configured_values
from ..sources.formats import GFF
from ..sources.records import parse


def observed_terms(lines: DataFrame, fmt: str, tags: list[str], case_sensitive: bool = False) -> DataFrame:
    """(file, value) lines to (file, contig, start, length, term); comments are skipped, positions are not known in a stream."""
    features = lines.where(~F.col("value").startswith("#")).withColumn("src_pos", F.lit(0).cast("long"))
    rows = parse(features.select("src_pos", "value"), fmt)
    start, length = gff_to_span(F.col("start"), F.col("end"))
    terms = F.explode(F.filter(configured_values(F.col("attributes"), tags, case_sensitive), lambda v: v != ""))
    return rows.select(F.col("reference_sequence_name").alias("contig"), start.alias("start"), length.alias("length"), terms.alias("term"))


def stream_postings(spark: SparkSession, folder: str, output: str, checkpoint: str, tags: list[str], fmt: str = GFF, once: bool = False) -> StreamingQuery:
    """Appends the distinct postings of each micro-batch to output; readers take distinct() over all."""
    lines = spark.readStream.option("lineSep", "\n").text(folder)
    terms = observed_terms(lines, fmt, tags)

    def append(batch: DataFrame, batch_id: int) -> None:
        # Named by the batch, so a batch that runs again replaces itself.
        batch.distinct().write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    writer = terms.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
