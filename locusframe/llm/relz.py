"""Substring dedup by relative Lempel-Ziv parsing against all documents as reference.

The reference is every document with a smaller doc_id, indexed by blocks: the surroundings of the anchors of all 13-word
windows, and in later rounds single windows where a block isn't found, which is at the boundaries of factors (repeats.py). The
index has one place (document, word) for a block. A document is parsed greedily from left to right: a factor starts at the
first word that is not yet covered and lies in a window of the index, and takes the reference that reaches furthest, for as long as
the windows that follow are found where that reference goes on. Factors are (first word, end, reference, its first word). Where one
ends, windows that straddle the boundary may be found in another reference; then the next factor begins there, and may be shorter
than a window, but with the words before it it holds one. All words of factors are duplicates.

Defined cases: null text has no words; texts of fewer words than the window lose nothing; very long texts are indexed in pieces;
null doc_id comes before all others; rows with one doc_id don't remove words from each other; repeated rows are parsed alike;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .anchors import mix
from .common import table
from .repeats import Symbols, find_repeats, listed, texts
from .suffix import BYTE, with_repeats

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_NONE = np.empty(0, np.int64)


def split_words(body: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words (runs of bytes that are no white space) with one space between two, and where each starts and ends there."""
    b = np.frombuffer(body, np.uint8)
    inside = IS_WORD[b]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, end = edges[::2], edges[1::2]
    if not len(first):
        return b"", _NONE, _NONE
    gaps = np.zeros(len(b), dtype=bool)
    gaps[end[:-1]] = True
    ends = np.cumsum(end - first + 1) - 1
    return np.where(gaps, np.uint8(32), b)[inside | gaps].tobytes(), ends - (end - first), ends


def word_symbols(body: bytes) -> Symbols:
    data, starts, ends = split_words(body)
    if not len(starts):
        return Symbols(np.empty(0, np.uint64), data, starts, ends)
    b = np.frombuffer(data, np.uint8)
    offset = np.arange(len(b)) - np.repeat(starts, np.diff(starts, append=len(b)))
    power = np.full(int(offset.max()) + 1, _STEP)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    value = BYTE[b]
    value[ends[:-1]] = 0
    return Symbols(mix(np.add.reduceat(value * power[offset], starts)), data, starts, ends)


def word_names(body: bytes) -> np.ndarray:
    return word_symbols(body).names


def greedy_factors(runs: tuple[np.ndarray, ...], window: int) -> list[tuple[int, int, int, int]]:
    """Runs of found windows (start, n, earlier, earlier_start) -> factors (first word, end, reference, its first word)."""
    start, n, doc, place = (x[np.argsort(runs[0], kind="stable")] for x in runs)
    if not len(start):
        return []
    # Windows that are found one after another in one reference are one stretch.
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1] + n[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] - start[1:] != place[:-1] - start[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    reach = list(zip(start[first].tolist(), (start[last] + n[last] + window - 1).tolist(), doc[first].tolist(), place[first].tolist(), strict=True))
    out, done, i = [], 0, 0
    while i < len(reach):
        # Both starts and ends grow, so the last that begins by the first uncovered word reaches furthest.
        while i + 1 < len(reach) and reach[i + 1][0] <= done:
            i += 1
        first, end, doc, place = reach[i]
        if end > done:
            at = max(first, done)
            out.append((at, end, doc, place + at - first))
            done = end
        i += 1
    return out


def parse_factors(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256, n_spans, spans (first word:end, comma-joined), factors, kept (text).

    factors: (first, end, reference, at): words first to end are those of document reference from word at on (null: one without doc_id).
    """
    repeats = find_repeats(texts(docs), word_symbols, min(4, window), window, [1], False, "relz")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, body, runs in zip(b.column(0).to_pylist(), b.column(1), listed(b.column(2)), strict=True):
                (data, starts, word_ends), factors, spans = split_words(body.as_py()), greedy_factors(runs, window), []
                for first, end, *_ in factors:
                    if spans and spans[-1][1] == first:
                        spans[-1][1] = end
                    else:
                        spans.append([first, end])
                ends = [0, *(x for s in spans for x in s), len(starts)]
                kept = b" ".join(data[starts[x] : word_ends[y - 1]] for x, y in zip(ends[::2], ends[1::2], strict=True) if x < y)
                removed = sum(y - x for x, y in spans)
                parsed = [{"first": x, "end": y, "reference": None if doc == -(2**63) else doc, "at": at} for x, y, doc, at in factors]
                rows.append((doc_id, len(starts), removed, hashlib.sha256(kept).hexdigest(), len(spans), ",".join(f"{x}:{y}" for x, y in spans), parsed, kept.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=names)

    factor = pa.struct([(x, pa.int64()) for x in ("first", "end", "reference", "at")])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(factor), pa.string()]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_spans", "spans", "factors", "kept"]
    schema = (
        "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long, spans string, "
        "factors array<struct<first: long, end: long, reference: long, at: long>>, kept string"
    )
    return with_repeats(docs, repeats).mapInArrow(cut, schema)


def op4_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_factors(table(spark, sf_dir, "documents")).drop("kept", "factors")


OP4_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 12 <= len(ws) THEN md5(array_to_string(ws[i:i + 12], ' ')) END AS name FROM texts, unnest(range(1, len(ws) + 1)) AS t(i)),
firsts AS (SELECT name, min(doc_id) AS first FROM words WHERE name IS NOT NULL GROUP BY name),
marked AS (SELECT doc_id, i, word, i - max(CASE WHEN first < doc_id THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) <= 12 AS hit FROM words LEFT JOIN firsts USING (name)),
placed AS (SELECT doc_id, i, word, coalesce(hit, false) AS gone, coalesce(lag(hit) OVER (PARTITION BY doc_id ORDER BY i), false) AS before FROM marked),
runs AS (SELECT *, sum(CASE WHEN gone AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM placed),
spans AS (SELECT doc_id, run, min(i) - 1 AS a, max(i) AS b FROM runs WHERE gone GROUP BY doc_id, run),
listed AS (SELECT doc_id, count(*) AS n_spans, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM placed GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans, coalesce(spans, '') AS spans
FROM documents LEFT JOIN kept USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
