"""Sorting annotation text: contigs in natural order, then start and end, then parents before children."""

from __future__ import annotations

import heapq
import os
import tempfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions.text import natural_key, unsigned
from ..sources.formats import BED, source_format
from ..sources.lines import feature_lines, read_lines
from ..sources.records import attribute_values, last_of_each_tag, parse_gff
from ..staging import materialize

KEY = ["contig_key", "start", "end"]


def bed_keys(lines: DataFrame) -> DataFrame:
    """BED lines split at any run of blanks; a zero-width range is allowed, any other line an error."""
    f = lines.withColumn("f", F.split(F.regexp_replace("value", r"^[ \t\f]+|[ \t\f]+\z", ""), r"[ \t\f]+"))
    start, end = unsigned(F.get("f", F.lit(1))), unsigned(F.get("f", F.lit(2)))

    def bad(what: str):
        return F.raise_error(F.concat(F.lit("BED line "), (F.col("src_pos") + 1).cast("string"), F.lit(f": {what}")))

    ok = (F.size("f") >= 3) & (F.get("f", F.lit(0)) != "")
    return f.select(
        "src_pos",
        F.when(ok, natural_key(F.get("f", F.lit(0)))).otherwise(bad("expected at least three fields")).alias("contig_key"),
        F.when(start.isNotNull(), start).otherwise(F.when(ok, bad("invalid start")).otherwise(bad("expected at least three fields"))).alias("start"),
        F.when(end >= start, end).otherwise(bad("invalid end")).alias("end"),
        F.col("value").alias("raw_line"),
    )


def sort_bed(lines: DataFrame) -> DataFrame:
    """(raw_line) ordered; equal keys keep file order."""
    return bed_keys(lines).orderBy(*KEY, "src_pos").select("raw_line")


def tie_order(group: pd.DataFrame) -> pd.DataFrame:
    """Parents before children, otherwise the least src_pos first: Kahn's order with a heap. A cycle is an error."""
    rows = group.sort_values("src_pos")
    places = list(zip(rows["src_pos"], rows["ids"], rows["parents"], strict=True))
    owners: dict[str, list[int]] = {}
    for i, (_, ids, _) in enumerate(places):
        for x in set(ids):
            owners.setdefault(x, []).append(i)
    children: list[set[int]] = [set() for _ in places]
    for i, (_, _, parents) in enumerate(places):
        for x in set(parents):
            for p in owners.get(x, ()):
                children[p].add(i)
    waiting = [0] * len(places)
    for c in children:
        for i in c:
            waiting[i] += 1
    ready = [i for i, n in enumerate(waiting) if not n]
    heapq.heapify(ready)
    order = []
    while ready:
        i = heapq.heappop(ready)
        order.append(i)
        for c in children[i]:
            waiting[c] -= 1
            if not waiting[c]:
                heapq.heappush(ready, c)
    if len(order) < len(places):
        first = rows.iloc[0]
        raise ValueError(f'GFF parent hierarchy contains a cycle among records on contig "{first["contig"]}" at {first["start"]}..{first["end"]}')
    return pd.DataFrame({"src_pos": [places[i][0] for i in order], "tie": range(len(order))})


def tie_ranks(rows: DataFrame) -> DataFrame:
    """Adds tie: only groups of equal keys in which a record's parent is present go through tie_order, the rest keep src_pos."""
    ids = rows.select(*KEY, F.explode(F.array_distinct("ids")).alias("id"))
    parents = rows.select(*KEY, F.explode(F.array_distinct("parents")).alias("id"))
    linked = parents.join(ids, [*KEY, "id"], "left_semi").select(*KEY).distinct()
    grouped = rows.join(linked, KEY, "left_semi").select("src_pos", *KEY, "contig", "ids", "parents")
    ranked = grouped.groupBy(*KEY).applyInPandas(tie_order, "src_pos long, tie long")
    return rows.join(ranked, "src_pos", "left").withColumn("tie", F.coalesce("tie", "src_pos"))


def sort_gff(lines: DataFrame) -> DataFrame:
    """(raw_line) ordered: comment lines in file order, features, then the FASTA tail as it is."""
    tail = F.col("fasta").isNotNull() & (F.col("src_pos") >= F.col("fasta"))
    comment = F.col("value").startswith("#")
    others = lines.where(tail | comment).select(
        F.when(tail, 2).otherwise(0).alias("section"), F.lit("").alias("contig_key"), F.lit(0).cast("long").alias("start"),
        F.lit(0).cast("long").alias("end"), F.col("src_pos").alias("tie"), "src_pos", F.col("value").alias("raw_line"),
    )
    parsed = parse_gff(feature_lines(lines).select("src_pos", "value")).withColumn("attributes", last_of_each_tag(F.col("attributes")))

    def named(tag: str):
        return F.filter(attribute_values(F.col("attributes"), tag), lambda v: v != "")

    valid = F.concat("score", "strand", "phase").isNotNull()
    rows = parsed.where(valid).select(
        "src_pos", natural_key(F.col("reference_sequence_name")).alias("contig_key"), F.col("reference_sequence_name").alias("contig"),
        "start", "end", named("ID").alias("ids"), named("Parent").alias("parents"), "raw_line",
    )
    rows = materialize(rows, "sort-gff")
    features = tie_ranks(rows).select(F.lit(1).alias("section"), *KEY, "tie", "src_pos", "raw_line")
    return others.unionByName(features).orderBy("section", *KEY, "tie", "src_pos").select("raw_line")


def sorted_lines(spark: SparkSession, path) -> DataFrame:
    lines = read_lines(spark, path)
    return input_errors(lambda: sort_bed(lines) if source_format(path) == BED else sort_gff(lines))


def input_errors(run):
    """Runs an action; errors that records raised become InputError."""
    try:
        return run()
    except InputError:
        raise
    except Exception as e:
        text = str(e)
        for mark in ("GFF line", "BED line", "GFF parent hierarchy", "contig is not in", "invalid GFF record", "not sorted", "CSI limit"):
            if mark in text:
                # Traces of Python workers quote the source line before the message.
                at = text.rindex(mark) if mark.startswith("GFF parent") else text.index(mark)
                message = text[at:].split("\n")[0]
                raise InputError(message) from e
        raise


def sort_file(spark: SparkSession, path, output, disk_sort: bool = False) -> None:
    """Writes the sorted text to one file. Spark's sort spills by itself, so disk_sort changes nothing.

    Sorted partitions are fetched one after the other, so the driver holds one partition at a time.
    """
    rows = sorted_lines(spark, path)
    folder = os.path.dirname(os.path.abspath(output))
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", newline="\n", dir=folder, delete=False) as out:
        try:
            for r in input_errors(rows.toLocalIterator):
                out.write(r["raw_line"] + "\n")
        except BaseException as e:
            out.close()
            os.unlink(out.name)
            if isinstance(e, Exception) and not isinstance(e, InputError):
                input_errors(lambda: _again(e))
            raise
    os.replace(out.name, output)


def _again(e: Exception):
    raise e
