"""Coordinates: 1-based inclusive records, 0-based half-open spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gff_to_span(start: Column, end: Column) -> tuple[Column, Column]:
    """(start, length) of a 1-based inclusive range."""
    return (start - 1).cast("long"), (end - start + 1).cast("long")


def bed_to_span(start: Column, end: Column) -> tuple[Column, Column]:
    return start.cast("long"), (end - start).cast("long")


def span_end(start: Column, length: Column) -> Column:
    return start + length


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open ranges that share a position."""
    return (a_start < b_end) & (b_start < a_end)


def bins(start: Column, end: Column, shift: int = 14) -> Column:
    """The fixed-width bins that [start, end) touches."""
    last = F.greatest(end - 1, start)
    return F.sequence(F.shiftright(start, shift), F.shiftright(last, shift))
