"""Lines of a source with their position."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InputError, SourceIoError
from .bgzf import EOF_BLOCK, BgzfSource, blocks
from .formats import BED, COMPRESSED


def is_blocked(path: str) -> bool:
    try:
        next(blocks(path), None)
    except (OSError, SourceIoError):
        return False
    return True


def is_gzip(path: str) -> bool:
    try:
        with open(path, "rb") as f:
            return f.read(2) == b"\x1f\x8b"
    except OSError:
        return False


def read_lines(spark: SparkSession, path) -> DataFrame:
    """(src_pos, value, fasta): positions 0, 1, 2, ... in file order; lines end at a line feed, a carriage return before it is cut.

    fasta is the position of the first ``##FASTA`` line, null if there is none. Plain files are split by Spark; blocked gzip by
    its blocks; other gzip is one task.
    """
    path = str(path)
    local = path.removeprefix("file://")
    suffix = Path(path).suffix.lower()
    if Path(local).is_dir() or (not Path(local).exists() and "://" not in path):
        raise SourceIoError(f"no such file: {path}")
    mid = F.monotonically_increasing_id()
    zipped = suffix in COMPRESSED or is_gzip(local)
    if zipped and is_blocked(local):
        spark.dataSource.register(BgzfSource)
        raw = spark.read.format("bgzf").option("path", local).load().select("value", F.lit(path).alias("file"), mid.alias("mid"))
        raw = raw.withColumn("block", F.shiftright("mid", 33))  # partitions are in file order
    else:
        if is_gzip(local) and suffix != ".gz":
            raise InputError(f"{path} is gzip, but neither blocked nor named .gz")
        text = spark.read.option("lineSep", "\n").text(path)
        raw = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), mid.alias("mid"))
    raw = raw.withColumn("value", F.regexp_replace("value", r"\r\z", ""))
    mark = F.min(F.when(F.col("value") == "##FASTA", F.col("mid")))
    splits = raw.groupBy("file", "block").agg(F.min("mid").alias("first"), F.count("*").alias("n"), mark.alias("mark"))
    # From here one row a split of the file.
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy(F.lit(0))
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    splits = splits.withColumn("fasta", F.min(F.col("before") + F.col("mark") - F.col("first")).over(everywhere)).drop("n", "mark")
    placed = raw.join(F.broadcast(splits), ["file", "block"])
    return placed.select((F.col("before") + F.col("mid") - F.col("first")).cast("long").alias("src_pos"), "value", "fasta")


def records_only(lines: DataFrame, fmt: str) -> DataFrame:
    """Drops what is no record: comments, track and browser lines, and a FASTA tail."""
    if fmt == BED:
        return lines.drop("fasta").where(~F.col("value").startswith("#") & ~F.col("value").startswith("track ") & ~F.col("value").startswith("browser "))
    return feature_lines(lines).drop("fasta")


def feature_lines(lines: DataFrame) -> DataFrame:
    """Lines before the FASTA mark that are no comment. The value depends on the mark, so no later check sees other lines."""
    own = F.when(F.col("fasta").isNull() | (F.col("src_pos") < F.col("fasta")), F.col("value"))
    return lines.withColumn("value", own).where(F.col("value").isNotNull() & ~F.col("value").startswith("#"))


__all__ = ["EOF_BLOCK", "feature_lines", "is_blocked", "read_lines", "records_only"]
