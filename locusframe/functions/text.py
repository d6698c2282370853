"""String functions of the engine as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Unicode White_Space code points, as a Java character class body.
WHITE_SPACE = r"\u0009-\u000D\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A to Z only."""
    return F.translate(c, UPPER, LOWER)


def trim_unicode(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+\z", "")


def normalize(c: Column, case_sensitive: bool = False) -> Column:
    """Terms are trimmed of Unicode white space and, unless case counts, lower-cased in ASCII."""
    trimmed = trim_unicode(c)
    return trimmed if case_sensitive else ascii_lower(trimmed)


def percent_decode(c: Column) -> Column:
    """Decodes %XX; a malformed % stands for itself, + is no blank."""
    safe = F.regexp_replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.when(c.contains("%"), F.url_decode(safe)).otherwise(c)  # most values need no work


def natural_key(c: Column) -> Column:
    """Sorts like the text, case ignored, with runs of digits as numbers of any length.

    A run that begins with 0 is read as a fraction: such runs come before other numbers and are ordered digit by digit.
    """

    def of(run: Column) -> Column:
        number = F.concat(F.lit("1"), F.lpad(F.length(run).cast("string"), 10, "0"), run)
        return F.when(run.startswith("0"), F.concat(F.lit("0"), run, F.lit("\x01"))).when(run.rlike("^[0-9]"), number).otherwise(run)

    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), of), "")


def strip_line_ending(c: Column) -> Column:
    """One line feed, then one carriage return."""
    return F.regexp_replace(F.regexp_replace(c, r"\n\z", ""), r"\r\z", "")


def varint_length(c: Column) -> Column:
    """Bytes of an unsigned number in 7-bit groups."""
    return F.ceil(F.length(F.bin(c)) / F.lit(7.0)).cast("long")


def unsigned(c: Column) -> Column:
    """A decimal number without sign (a leading + is accepted), null if it is none or exceeds a long."""
    return F.when(c.rlike(r"^\+?[0-9]+\z"), c.try_cast("long"))
