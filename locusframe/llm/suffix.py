"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier, by prefix doubling.

Spark sorts pairs of a position's rank so far and the name of the bytes further on, at lengths 24, 93 and 100, which is the
threshold: no position is ranked further, and one that is alone drops out at once (repeats.py). Sorting every position at
every doubling would shuffle each text some hundred times over, so positions start as the anchors of the 100-byte windows (one
in about 39), which stand for all of them and lose none. What is equal is decided by 128-bit digests.

Defined cases: null text is empty; texts shorter than the window lose nothing; very long texts are ranked in pieces;
null doc_id comes before all others; rows that repeat a doc_id and text are judged alike and don't remove each other; of
different texts with one doc_id an earlier start is earlier; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import joined
from .common import table
from .repeats import Symbols, find_repeats, listed, texts

BYTE = np.random.default_rng(20240501).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_symbols(body: bytes) -> Symbols:
    return Symbols(BYTE[np.frombuffer(body, np.uint8)], body)


def with_repeats(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """Every row of docs with its repeats (array of start, n, earlier, earlier_start; null if none)."""
    runs = repeats.groupBy("doc", "version").agg(F.collect_list(F.struct("start", "n", "earlier", "earlier_start")).alias("runs"))
    return texts(docs, "doc_id").join(runs, ["doc", "version"], "left").select("doc_id", "body", "runs")


def removed_spans(runs: tuple[np.ndarray, ...], window: int) -> list[tuple[int, int]]:
    start, n = runs[:2]
    return joined(start, start + n - 1 + window)


def dedup_substrings(docs: DataFrame, window: int = 100) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start:end in bytes, comma-joined), kept (bytes)."""
    repeats = find_repeats(texts(docs), byte_symbols, min(24, window), window, [8, 1] if window > 16 else [1], True, "suffix")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, body, runs in zip(b.column(0).to_pylist(), b.column(1), listed(b.column(2)), strict=True):
                body, spans = body.as_py(), removed_spans(runs, window)
                ends = [0, *(x for s in spans for x in s), len(body)]
                kept = b"".join(body[x:y] for x, y in zip(ends[::2], ends[1::2], strict=True)) if spans else body
                rows.append((doc_id, len(body), len(body) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), ",".join(f"{x}:{y}" for x, y in spans), kept))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string, kept binary"
    return with_repeats(docs, repeats).mapInArrow(cut, schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


#: Bytes as hex digits, in pieces of 1,000, because a substring of a long string takes long.
OP2_SQL = r"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, p * 1000 AS base, substr(h, p * 2000 + 1, 2198) AS h FROM texts, unnest(range(0, length(h) // 2000 + 1)) AS t(p)),
bytes AS (SELECT doc_id, base + i AS i, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 200 <= length(h) THEN md5(substr(h, 2 * i + 1, 200)) END AS name FROM pieces, unnest(range(0, least(1000, length(h) // 2))) AS t(i)),
firsts AS (SELECT name, min(doc_id * 1000000000 + i) AS first FROM bytes WHERE name IS NOT NULL GROUP BY name),
marked AS (SELECT doc_id, i, byte, i - max(CASE WHEN first < doc_id * 1000000000 + i THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) <= 99 AS hit FROM bytes LEFT JOIN firsts USING (name)),
placed AS (SELECT doc_id, i, byte, coalesce(hit, false) AS gone, coalesce(lag(hit) OVER (PARTITION BY doc_id ORDER BY i), false) AS before FROM marked),
runs AS (SELECT *, sum(CASE WHEN gone AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM placed),
cut AS (SELECT doc_id, run, min(i) AS a, max(i) + 1 AS b FROM runs WHERE gone GROUP BY doc_id, run),
listed AS (SELECT doc_id, count(*) AS n_spans, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM cut GROUP BY doc_id),
kept AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM placed GROUP BY doc_id)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN kept USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
