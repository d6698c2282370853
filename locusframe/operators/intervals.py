"""Interval operators: overlap join by bins, merging of touching ranges, sortedness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.coords import bins, overlaps
from ..functions.text import natural_key


def overlap_join(a: DataFrame, b: DataFrame, shift: int = 14) -> DataFrame:
    """Pairs of half-open ranges (reference, start, end) of a and b that share a position; columns a_* and b_*.

    An equi-join on (reference, bin); a pair is emitted in the bin where the later of the two begins, so none is met twice.
    """
    left = a.select(*(F.col(c).alias(f"a_{c}") for c in a.columns)).withColumn("bin", F.explode(bins(F.col("a_start"), F.col("a_end"), shift)))
    right = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns)).withColumn("bin", F.explode(bins(F.col("b_start"), F.col("b_end"), shift)))
    right = right.withColumnRenamed("bin", "b_bin")
    here = F.shiftright(F.greatest("a_start", "b_start"), shift) == F.col("bin")
    meet = overlaps(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    on = (F.col("a_reference") == F.col("b_reference")) & (F.col("bin") == F.col("b_bin"))
    return left.join(right, on).where(meet & here).drop("bin", "b_bin")


def coalesce_ranges(ranges: DataFrame, width: int = 1 << 20) -> DataFrame:
    """(reference, start, end) with touching or overlapping ranges merged, and how many went in: reference, start, end, merged.

    Ranges are merged within tiles of ``width`` positions first (each belongs to the tile of its start), so a window runs over a
    tile's ranges and then over what the tiles left, never over all ranges of a reference at once.
    """

    def merged(df: DataFrame, keys: list[str]) -> DataFrame:
        by = Window.partitionBy(*keys).orderBy("start", "end")
        reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
        fresh = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
        island = F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0))
        numbered = df.withColumn("fresh", fresh).withColumn("island", island)
        return numbered.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("merged").alias("merged")).drop("island")

    tiled = ranges.select("reference", "start", "end", F.lit(1).cast("long").alias("merged"), F.floor(F.col("start") / width).alias("tile"))
    return merged(merged(tiled, ["reference", "tile"]).drop("tile"), ["reference"]).select("reference", "start", "end", "merged")


def out_of_order(rows: DataFrame) -> DataFrame:
    """Rows (src_pos, reference, start) that break the order a coordinate index needs: a contig that comes back, or a start that falls.

    Each contig's rows are compared with those before them; contigs are told apart by where they begin and end.
    """
    by_contig = Window.partitionBy("reference").orderBy("src_pos")
    falls = F.col("start") < F.lag("start").over(by_contig)
    apart = F.col("src_pos") != F.lag("src_pos").over(by_contig) + 1
    return rows.withColumn("falls", falls).withColumn("apart", apart).where("falls or apart").select("src_pos", "reference", "start")


def natural_order(df: DataFrame, column: str) -> DataFrame:
    """(column, natural_rank) of its distinct values; names equal but for case share a rank."""
    names = df.select(column).distinct()
    return names.select(column, F.dense_rank().over(Window.orderBy(natural_key(F.col(column)))).cast("long").alias("natural_rank"))


def byte_offsets(lines: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(src_pos, value) with offset, the byte at which the line begins in a file of all lines, each ended by one byte.

    Lengths are summed per block of positions, blocks before each block, and lines within a block, so no window runs over all lines.
    """
    sized = lines.withColumn("bytes", (F.octet_length("value") + 1).cast("long")).withColumn("block", F.floor(F.col("src_pos") / block))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row a block.
    blocks = sized.groupBy("block").agg(F.sum("bytes").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("src_pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(blocks, "block")
    return placed.select("src_pos", "value", (F.col("base") + F.col("inside")).alias("offset"))
