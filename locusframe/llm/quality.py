"""Quality rules with risk-controlled thresholds.

Each rule is a score of a document (higher: worse) and a cutoff per stratum (language). Labelled documents are the
holdout: a cutoff is certified for a stratum if the exact binomial tail P(X <= rejected good documents | n good, limit)
is at most delta / (strata * rules * cutoffs tried), so that with confidence 1 - delta every certified cutoff of every
stratum at once rejects at most ``limit`` of the good documents (``risk`` shared out over the rules). Of the certified
cutoffs the one with the most bad documents caught, each good one caught counting ``price`` times against it, is used;
ties go to the loosest; a stratum without a certified gain has no cutoff and rejects nothing by that rule.

Defined cases: null text has no words (base_failed); null language is a stratum of its own, the empty one another; very long texts
are counted whole; null doc_ids are judged and have no labels; documents with several labels count
once, as bad if any label says so; null labels are ignored; repeated rows are judged alike (and counted each); empty
tables give no rows or no cutoffs; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SYMBOLS = re.compile(r"[#*$%&|<>]")
SPACES = re.compile(r"[\x20\x09-\x0D]+")
RULES = ["symbols", "dup_lines", "repeats", "word_length"]
#: Cutoffs tried, the same for every rule: 1/64 to 4, three to each doubling.
CUTOFFS = [2 ** (i / 3) for i in range(-18, 7)]


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    if len(often) == len(windows):
        return 0
    total = end = 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def base_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if SPACES.sub("", x)]
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    return len(words), len(text) - spaces, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    for b in batches:
        counts = pd.DataFrame([base_counts(x) for x in b["text"]], columns=names, index=b.index)
        yield pd.concat([b[["doc_id", "stratum"]], counts], axis=1)


COUNTED = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def with_scores(counted: DataFrame) -> DataFrame:
    """Adds the rules' scores; a document without words scores 0."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    mean = F.greatest("word_chars", F.lit(1)) / words
    return (
        counted.withColumn("symbols", F.col("n_symbols") / words)
        .withColumn("dup_lines", F.col("n_dup_lines") / lines)
        .withColumn("repeats", F.col("n_repeat_words") / words)
        .withColumn("word_length", F.when(F.col("n_words") > 0, F.abs(F.ln(mean / 5.0))).otherwise(0.0))
    )


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), exactly."""
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in log))


def certified_cutoff(good: list[int], bad: list[int], limit: float, delta: float, price: float) -> float | None:
    """good[i], bad[i]: documents whose score exceeds CUTOFFS[i - 1] but no higher cutoff. None: no gain is certified."""
    n, best, chosen = sum(good), 0.0, None
    for i in range(len(CUTOFFS), 0, -1):
        k, caught = sum(good[i:]), sum(bad[i:])
        if n == 0 or k > limit * n or tail(k, n, limit) > delta:
            break
        if caught - price * k > best:
            best, chosen = caught - price * k, CUTOFFS[i - 1]
    return chosen


def fit_cutoffs(scored: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, price: float = 5.0) -> DataFrame:
    """(stratum, rule, cutoff); all labelled documents count, summed per stratum, rule and interval between cutoffs."""
    marks = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    step = F.expr("stack(4, " + ", ".join(f"'{r}', {r}" for r in RULES) + ") as (rule, score)")
    at = sum(F.when(F.col("score") > c, 1).otherwise(0) for c in CUTOFFS)
    counts = (
        scored.join(marks, "doc_id")
        .where("not base_failed")
        .select("stratum", "quality", step)
        .groupBy("stratum", "rule", at.alias("at"))
        .agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") == 1, 0).otherwise(1)).alias("bad"))
    )
    counts = materialize(counts, "quality-counts")
    strata = max(1, counts.select("stratum").distinct().count())
    each = delta / (strata * len(RULES) * len(CUTOFFS))

    def choose(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        good, bad = [0] * (len(CUTOFFS) + 1), [0] * (len(CUTOFFS) + 1)
        for i, g, b in zip(group["at"], group["good"], group["bad"], strict=True):
            good[i], bad[i] = int(g), int(b)
        cutoff = certified_cutoff(good, bad, risk / len(RULES), each, price)
        return pd.DataFrame({"stratum": [key[0]], "rule": [key[1]], "cutoff": [cutoff]}).dropna()

    # At most len(CUTOFFS) + 1 rows a group.
    return counts.groupBy("stratum", "rule").applyInPandas(choose, "stratum string, rule string, cutoff double")


def judge_quality(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(doc_id, text, lang) and (doc_id, quality) -> base columns, base_failed, kept, and the rule that rejected (or null)."""
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("n")).alias("stratum"), "text")
    counted = materialize(rows.mapInPandas(_counted, COUNTED), "quality-base")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = with_scores(counted).withColumn("base_failed", failed)
    cutoffs = fit_cutoffs(scored, labels, risk, delta).groupBy("stratum").agg(
        *(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"{r}_cutoff") for r in RULES)
    )
    cutoffs = materialize(cutoffs, "quality-cutoffs")
    judged = scored.join(cutoffs, "stratum", "left").withColumn(
        "rejected_by", F.coalesce(*(F.when(F.col(r) > F.col(f"{r}_cutoff"), F.lit(r)) for r in RULES))
    )
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"),
        "rejected_by",
    )


def op7_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP7_SQL = rf"""
WITH texts AS (
  SELECT doc_id, coalesce('l' || lang, 'n') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
windows AS (SELECT doc_id, i, CASE WHEN i + 2 <= len(ws) THEN ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS w FROM texts, unnest(range(1, len(ws) + 1)) AS u(i)),
often AS (SELECT doc_id, i, w IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w) > 1 AS again FROM windows),
covered AS (SELECT doc_id, i - max(CASE WHEN again THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) <= 2 AS hit FROM often),
repeats AS (SELECT doc_id, count(*) FILTER (WHERE hit) AS n FROM covered GROUP BY doc_id),
base AS (
  SELECT doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM texts LEFT JOIN repeats USING (doc_id)
),
scored AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS symbols, n_dup_lines / greatest(n_lines, 1) AS dup_lines,
         n_repeat_words / greatest(n_words, 1) AS repeats, CASE WHEN n_words > 0 THEN abs(ln(greatest(word_chars, 1) / greatest(n_words, 1) / 5.0)) ELSE 0.0 END AS word_length
  FROM base
),
marks AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
long AS (UNPIVOT (SELECT doc_id, stratum, base_failed, symbols, dup_lines, repeats, word_length FROM scored) ON symbols, dup_lines, repeats, word_length INTO NAME rule VALUE score),
placed AS (
  SELECT stratum, rule, quality, len(list_filter({CUTOFFS}, lambda c: score > c)) AS at_ FROM long JOIN marks USING (doc_id) WHERE NOT base_failed
),
groups AS (SELECT stratum, rule, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS n FROM placed GROUP BY ALL),
tried AS (
  SELECT g.stratum, g.rule, g.n, c.i, sum(CASE WHEN at_ >= c.i AND quality = 1 THEN 1 ELSE 0 END) AS k, sum(CASE WHEN at_ >= c.i AND quality <> 1 THEN 1 ELSE 0 END) AS caught
  FROM groups g JOIN placed p ON g.stratum = p.stratum AND g.rule = p.rule, range(1, {len(CUTOFFS)} + 1) AS c(i) GROUP BY ALL
),
certified AS (
  SELECT *, n > 0 AND k <= 0.0125 * n AND (
    SELECT sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(0.0125) + (n - x) * ln(1 - 0.0125))) FROM unnest(range(0, CAST(CASE WHEN k <= 0.0125 * n THEN k ELSE 0 END AS BIGINT) + 1)) AS q(x)
  ) <= 0.05 / ((SELECT count(DISTINCT stratum) FROM placed) * {len(RULES) * len(CUTOFFS)}) AS ok
  FROM tried
),
chosen AS (
  SELECT stratum, rule, {CUTOFFS}[i] AS cutoff FROM certified WHERE ok AND caught - 5 * k > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY caught - 5 * k DESC, i DESC) = 1
),
rejected AS (
  SELECT doc_id, min_by(rule, list_position({RULES}, rule)) AS rejected_by FROM long JOIN chosen USING (stratum, rule) WHERE score > cutoff GROUP BY doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by IS NULL AS kept, rejected_by
FROM scored LEFT JOIN rejected USING (doc_id)
"""
