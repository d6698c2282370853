"""Records from lines, by SQL expressions; a malformed line fails the query with its line number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent_decode, unsigned
from .formats import BED, GFF

ATTRIBUTES = "array<struct<tag:string,values:array<string>>>"


def checked(ok: Column, value: Column, message: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(message))


def _problem(fmt: str, what: str) -> Column:
    return F.concat(F.lit(f"{fmt} line "), (F.col("src_pos") + 1).cast("string"), F.lit(f": {what}; invalid {fmt} record at line "), (F.col("src_pos") + 1).cast("string"))


def attribute_list(text: Column, problem: Column) -> Column:
    """tag=v1,v2;tag2=v to an ordered list; tags and values are percent-decoded after splitting."""
    parts = F.filter(F.split(text, ";"), lambda p: F.trim(p) != "")
    return F.when(text == ".", F.expr(f"cast(array() as {ATTRIBUTES})")).otherwise(
        F.transform(
            parts,
            lambda p: F.when(
                F.locate("=", p) > 0,
                F.struct(
                    percent_decode(F.trim(F.substring_index(p, "=", 1))).alias("tag"),
                    F.transform(F.split(p.substr(F.locate("=", p) + 1, F.length(p)), ","), percent_decode).alias("values"),
                ),
            ).otherwise(F.raise_error(problem)),
        )
    )


def parse_gff(lines: DataFrame) -> DataFrame:
    """(src_pos, value) of feature lines to annotation rows."""
    f = lines.withColumn("f", F.split("value", "\t", 9))
    col = [F.get("f", i) for i in range(9)]
    start, end = unsigned(col[3]), unsigned(col[4])
    nine = F.size("f") == 9
    rows = f.select(
        "src_pos",
        (F.col("src_pos") + 1).alias("line_no"),
        checked(nine & (col[0] != ""), col[0], _problem("GFF", "expected nine fields")).alias("reference_sequence_name"),
        col[1].alias("source"),
        col[2].alias("ty"),
        checked(start.isNotNull() & (start > 0), start, _problem("GFF", "invalid start")).alias("start"),
        checked(end.isNotNull() & (end >= start), end, _problem("GFF", "invalid end")).alias("end"),
        checked((col[5] == ".") | col[5].try_cast("float").isNotNull(), col[5], _problem("GFF", "invalid score")).alias("score"),
        checked(col[6].isin("+", "-", ".", "?"), col[6], _problem("GFF", "invalid strand")).alias("strand"),
        checked(col[7].isin("0", "1", "2", "."), col[7], _problem("GFF", "invalid phase")).alias("phase"),
        attribute_list(col[8], _problem("GFF", "invalid attribute")).alias("attributes"),
        F.col("value").alias("raw_line"),
    )
    return rows


def parse_bed(lines: DataFrame) -> DataFrame:
    """(src_pos, value) of BED lines to annotation rows in GFF convention; column 4 is the name."""
    f = lines.withColumn("f", F.split("value", "\t"))
    start, end = unsigned(F.get("f", F.lit(1))), unsigned(F.get("f", F.lit(2)))
    name = F.coalesce(F.get("f", F.lit(3)), F.lit(""))
    return f.select(
        "src_pos",
        (F.col("src_pos") + 1).alias("line_no"),
        checked((F.size("f") >= 3) & (F.get("f", F.lit(0)) != ""), F.get("f", F.lit(0)), _problem("BED", "expected at least three fields")).alias("reference_sequence_name"),
        F.lit(".").alias("source"),
        F.lit("bed").alias("ty"),
        checked(start.isNotNull(), start + 1, _problem("BED", "invalid start")).alias("start"),
        checked(end.isNotNull() & (end > start), end, _problem("BED", "invalid end")).alias("end"),
        F.lit(".").alias("score"),
        F.lit(".").alias("strand"),
        F.lit(".").alias("phase"),
        F.array(F.struct(F.lit("name").alias("tag"), F.array(name).alias("values"))).alias("attributes"),
        F.col("value").alias("raw_line"),
    )


def parse(lines: DataFrame, fmt: str) -> DataFrame:
    return {GFF: parse_gff, BED: parse_bed}[fmt](lines)


def attribute_values(attributes: Column, tag: str) -> Column:
    """All values of a tag, in order."""
    return F.flatten(F.transform(F.filter(attributes, lambda a: a["tag"] == tag), lambda a: a["values"]))


def last_of_each_tag(attributes: Column) -> Column:
    """The returned form: of a repeated tag the last occurrence counts, at the place of the first."""
    tags = F.array_distinct(F.transform(attributes, lambda a: a["tag"]))
    return F.transform(tags, lambda t: F.element_at(F.filter(attributes, lambda a: a["tag"] == t), -1))
