"""Value predicates: exact, prefix, contains and regex over normalized terms."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError
from .text import LOWER, UPPER

MODES = ("exact", "prefix", "contains", "regex")
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: POSIX class names and the Java classes of the same ASCII characters.
POSIX = {
    "alnum": "a-zA-Z0-9", "alpha": "a-zA-Z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": r"0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
SCRIPTS = {"Greek", "Latin", "Cyrillic", "Arabic", "Hebrew", "Han", "Hiragana", "Katakana", "Thai", "Hangul", "Armenian", "Georgian", "Devanagari", "Bengali", "Tamil"}


def normalized(value: str, case_sensitive: bool = False) -> str:
    value = value.strip(_SPACE)
    return value if case_sensitive else value.translate(_ASCII_LOWER)


def java_pattern(pattern: str) -> str:
    """The Java form of a linear-time regular expression; constructs that such engines don't have are errors."""

    def fail(why: str):
        raise InputError(f"invalid regex query: {why} in {pattern!r}")

    out, i, depth, multi = [], 0, 0, False
    while i < len(pattern):
        c, rest = pattern[i], pattern[i:]
        if c == "\\":
            if i + 1 >= len(pattern):
                fail("trailing backslash")
            n = pattern[i + 1]
            if n.isdigit() or n in "kGZQEXRh":
                fail(f"\\{n} is not supported")
            m = re.match(r"\\([pP])\{(\^?)(\w+)\}", rest)
            if m:
                kind = {"p": "P", "P": "p"}[m[1]] if m[2] else m[1]
                out.append(f"\\{kind}{{{'Is' if m[3] in SCRIPTS else ''}{m[3]}}}")
                i += len(m[0])
                continue
            out.append(rest[:2])
            i += 2
        elif depth and (m := re.match(r"\[:(\^?)(\w+):\]", rest)):
            if m[2] not in POSIX:
                fail(f"unknown class {m[2]}")
            out.append(f"[{m[1]}{POSIX[m[2]]}]")
            i += len(m[0])
        elif depth and rest[:2] in ("--", "~~") and pattern[i - 1] != "[":
            fail(f"class operator {rest[:2]}")
        elif c == "[":
            depth += 1
            out.append(c)
            i += 1
            for first in ("^", "]"):
                if pattern[i : i + 1] == first:
                    out.append("\\]" if first == "]" else first)
                    i += 1
        elif c == "]" and depth:
            depth -= 1
            out.append(c)
            i += 1
        elif depth:
            out.append(c)
            i += 1
        elif rest.startswith("(?"):
            if rest[2:3] in ("=", "!", ">") or rest[2:4] in ("<=", "<!"):
                fail("look-around or atomic group")
            flags = re.match(r"\(\?([a-zA-Z-]*)[:)]", rest)
            if flags and "m" in flags[1].split("-")[0]:
                multi = True
            out.append("(?<" if rest.startswith("(?P<") else "(?")
            i += 4 if rest.startswith("(?P<") else 2
        elif c == "$" and not multi:
            out.append("\\z")
            i += 1
        elif c in "*+?}" and rest[1:2] == "+":
            fail("possessive quantifier")
        else:
            out.append(c)
            i += 1
    return "".join(out)


@dataclass(frozen=True)
class Matcher:
    """A compiled query; predicate() is the test of a normalized term."""

    mode: str
    query: str
    pattern: str = ""

    @staticmethod
    def compile(spark: SparkSession, query: str, mode: str = "exact", case_sensitive: bool = False) -> Matcher:
        if mode not in MODES:
            raise InputError(f"invalid match mode {mode!r}: expected exact, prefix, contains, or regex")
        if mode != "regex":
            return Matcher(mode, normalized(query, case_sensitive))
        trimmed = query.strip(_SPACE)
        pattern = ("(?U)" if case_sensitive else "(?Uiu)") + java_pattern(trimmed)
        try:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception as e:
            raise InputError(f"invalid regex query: {trimmed!r}") from e
        return Matcher(mode, trimmed, pattern)

    @property
    def empty(self) -> bool:
        return not self.query

    def predicate(self, term: Column) -> Column:
        if self.mode == "exact":
            return term == F.lit(self.query)
        if self.mode == "prefix":
            return term.startswith(self.query)
        if self.mode == "contains":
            return term.contains(self.query)
        return term.rlike(self.pattern)

    def matches_empty(self, spark: SparkSession) -> bool:
        return self.mode == "regex" and spark._jvm.java.util.regex.Pattern.compile(self.pattern).matcher("").find()
