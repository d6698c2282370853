"""Windows of texts that also start earlier, by prefix doubling over a text's anchors.

Round 1 ranks the k-grams at the anchors of all windows (anchors.py): Spark deals the (name, position) rows by name, sorts
them and numbers the names; the number is the position's rank. A name met once drops out. Round n + 1 takes the positions that are
left, each with its rank, to a greater length: its row is the pair of that rank and the name of the symbols further on, sorted and
ranked anew, until a position is alone or the length is the window's. Anchors stand for all windows that they serve at first; in
later rounds for chunks of fewer window starts, at last for one.

Rows also bear the digest of their context, which is all symbols of all windows they stand for. Of rows with equal digests
(128 bits) the first position stays and the others are repeats, with the first as their reference; they go no further. Names and
ranks say which rows meet; only digests say what is equal.

A name that many rows of one batch share would go to one task; such rows are dealt on by document, marked to go on in
any case under the rank of the common name, and the last round, whose equal rows meet batch by batch, settles them. What is
marked doesn't depend on the batches; which of several earlier places is the reference may.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import U, anchors, digests, doubled, lengths_to, mix
from .common import materialize, release

ROWS = "name long, context long, check long, doc long, version long, start long, shape int"
#: known: 1 for repeats inside a batch. of, of_start: the earlier place of a known repeat; else of is the common name of a row that was dealt on.
DEALT = ROWS + ", known int, of long, of_start long"
MARKS = "doc long, version long, start long, shape int, repeat boolean, earlier long, earlier_start long, rank long"
#: Rows of a name in one batch from which they are dealt on by document, and among how many names.
CROWD, SPREAD = 64, 256
#: Context and check of rows that only make a name go on; they sort first.
TOKEN = -(2**63)
#: Rows in which repeats are told apart before they are dealt, and rows handed to Spark at once.
BATCH, PIECE = 1 << 20, 1 << 15
_STEP, _SIGN = U(0x9E3779B97F4A7C15), np.int64(-(2**63))


class Symbols(NamedTuple):
    """A text's symbols: names, and the bytes of symbol i, data[starts[i]:ends[i]] (one byte each where starts is None)."""

    names: np.ndarray
    data: bytes
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def digests(self, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            return digests(self.data, first, end)
        return digests(self.data, self.starts[first], self.ends[end - 1])


def version_of(body: Column) -> Column:
    """64 bits of a text's MD5: tells rows of one doc_id with different texts apart."""
    return F.conv(F.substring(F.md5(body), 1, 15), 16, 10).cast("long")


def doc_key() -> Column:
    """doc_id; null comes before all others."""
    return F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long"))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """(doc, version, body, *more): null doc_id comes before all others; rows of one doc_id with different texts differ in version."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(doc_key().alias("doc"), version_of(body).alias("version"), body.alias("body"), *more)


def listed(column: pa.ListArray) -> Iterator[tuple[np.ndarray, ...]]:
    """The rows of a column of arrays of structs of numbers, each as one numpy array a field; none for null."""
    at, fields = column.offsets.to_numpy(), [x.to_numpy(zero_copy_only=False) for x in column.values.flatten()]
    for i in range(len(column)):
        yield tuple(x[at[i] : at[i + 1]] for x in fields)


def _records(columns: list[np.ndarray], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def _dealt(rows: list[tuple[np.ndarray, ...]], within: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """One batch of DEALT: repeats inside the batch are known, crowded names are spread but in the last round."""
    if not rows:
        return
    name, context, check, doc, version, start, shape = columns = [np.concatenate(x) for x in zip(*rows, strict=True)]
    rows.clear()
    # Equal contexts have equal names.
    by = np.lexsort([start, doc, check, context])
    for x in columns:
        x[:] = x[by]
    del by
    new = np.concatenate([[True], (context[1:] != context[:-1]) | (check[1:] != check[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = doc > doc[first]
    if within:
        later |= (doc == doc[first]) & (start > start[first])
    known = later.astype(np.int32)
    of, of_start = np.where(later, doc[first], 0), np.where(later, start[first], 0)
    left = np.flatnonzero(~later)
    names, at, many = np.unique(name[left], return_inverse=True, return_counts=True)
    crowd = many[at] >= CROWD
    if crowd.any() and not last:
        rows_at = left[crowd]
        of[rows_at] = name[rows_at]
        name[rows_at] = mix(name[rows_at].view(U) + (mix(doc[rows_at].view(U)) % U(SPREAD) + U(1)) * _STEP).view(np.int64)
        spread, one = np.unique(name[rows_at], return_index=True)
        common = names[many >= CROWD]
        tokens, origin = np.concatenate([common, spread]), np.concatenate([common, of[rows_at][one]])
        zero = np.zeros(len(tokens), dtype=np.int64)
        name, of = np.concatenate([name, tokens]), np.concatenate([of, origin])
        context, check = np.concatenate([context, zero + TOKEN]), np.concatenate([check, zero + TOKEN])
        doc, version, start, of_start = (np.concatenate([x, zero]) for x in (doc, version, start, of_start))
        shape, known = np.concatenate([shape, zero]), np.concatenate([known, zero])
    for i in range(0, len(name), PIECE):
        yield _records([x[i : i + PIECE] for x in (name, context, check, doc, version, start, shape, known, of, of_start)], DEALT)


def _ranked(within: bool):
    """Streams rows sorted by (name, context, check, doc, start): numbers the names, marks repeats and those that go on; holds one name's first rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = context = check = None  # of the row before
        first_doc = first_start = 0  # of its context
        several = False  # its name has other contexts
        rank = (TaskContext.get().partitionId() + 1) << 40  # of its name; names of this task count on from here
        count = rank
        held: list[tuple] = []  # first rows of a name with one context so far

        def out(rows: list[np.ndarray], repeat: np.ndarray, earlier: np.ndarray, earlier_start: np.ndarray, ranks: np.ndarray) -> pa.RecordBatch:
            return _records([*rows, repeat, earlier, earlier_start, ranks], MARKS)

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            k, c, x, d, v, s, f, o = (b.column(i).to_numpy(zero_copy_only=False) for i in range(8))
            new_name = np.concatenate([[name is None or k[0] != name], k[1:] != k[:-1]])
            new_context = new_name | np.concatenate([[context is None or c[0] != context or x[0] != check], (c[1:] != c[:-1]) | (x[1:] != x[:-1])])
            at = np.maximum.accumulate(np.where(new_context, np.arange(n), -1))
            fd, fs = np.where(at < 0, first_doc, d[at]), np.where(at < 0, first_start, s[at])
            repeat = d > fd
            if within:
                repeat |= (d == fd) & (s > fs)
            run_of = np.cumsum(new_name)
            goes_on = np.bincount(run_of, new_context & ~new_name, minlength=run_of[-1] + 1) > 0
            goes_on[0] |= several
            # A name that begins with a token was spread: its rank is that of the common name, wherever its rows are.
            begins = np.flatnonzero(new_name)
            ranks_of = np.concatenate([[rank], np.where(f[begins] == 0, o[begins] | _SIGN, count + 1 + np.arange(len(begins)))]).astype(np.int64)
            ranks = ranks_of[run_of]
            if held and (new_name.argmax() > 0 or not new_name[0]) and goes_on[0]:
                rows = [np.array(y) for y in zip(*held, strict=True)]
                yield out(rows, np.zeros(len(held), dtype=bool), rows[0], rows[2], np.full(len(held), rank))
                held = []
            if new_name.any():
                held = []
            real = f > 0
            emit = real & (repeat | goes_on[run_of])
            if emit.any():
                yield out([y[emit] for y in (d, v, s, f)], repeat[emit], fd[emit], fs[emit], ranks[emit])
            last = run_of[-1]
            several = bool(goes_on[last])
            if not several:
                wait = np.flatnonzero((run_of == last) & real & ~repeat)
                held += list(zip(d[wait].tolist(), v[wait].tolist(), s[wait].tolist(), f[wait].tolist(), strict=True))
            name, context, check, first_doc, first_start = k[-1], c[-1], x[-1], fd[-1], fs[-1]
            rank, count = int(ranks_of[last]), count + len(begins)

    return run


def _round(rows: DataFrame, within: bool, what: str) -> DataFrame:
    """DEALT -> MARKS, written; the rows themselves are needed no more."""
    rows = materialize(rows, f"{what}-rows")
    known = rows.where("known = 1").selectExpr("doc", "version", "start", "shape", "true AS repeat", "of AS earlier", "of_start AS earlier_start", "0L AS rank")
    rest = rows.where("known = 0").drop("known", "of_start")
    order = ["name", "context", "check", "doc", "start"]
    ranked = rest.repartition("name").sortWithinPartitions(*order).mapInArrow(_ranked(within), MARKS)
    marks = materialize(ranked.unionByName(known), f"{what}-marks")
    release(rows)
    return marks


def _emit(within: bool, of: Callable, last: bool):
    """mapInArrow over documents; of(row) yields the columns of ROWS but doc and version."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for b in batches:
            columns = [listed(c) if pa.types.is_list(c.type) else (x.as_py() for x in c) for c in b.columns]
            for doc, version, *rest in zip(*columns, strict=True):
                for name, context, check, start, shape in of(*rest):
                    rows.append((name, context, check, np.full(len(name), doc), np.full(len(name), version), start, shape))
                    n += len(name)
                    if n >= BATCH:
                        yield from _dealt(rows, within, last)
                        rows, n = [], 0
        yield from _dealt(rows, within, last)

    return run


def _chunks(symbols: Symbols, todo: tuple, window: int, chunk: int, piece: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """The open anchors of a text (start, shape, rank) in chunks of window starts, aligned to the anchor."""
    start, shape, rank = (x.astype(np.int64) for x in todo)
    many, offset = shape & 255, shape >> 8
    last, anchor = start + many - 1, start + offset
    # Chunk j of an anchor p: window starts p - chunk * (j + 1) + 1 .. p - chunk * j.
    low, high = (anchor - last) // chunk, (anchor - start) // chunk
    per = high - low + 1
    owner = np.repeat(np.arange(len(start)), per)
    j = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + low[owner]
    top = anchor[owner] - chunk * j  # the chunk's last start, whole or not
    a, b = np.maximum(top - chunk + 1, start[owner]), np.minimum(top, last[owner])
    core = lengths_to(window - chunk + 1)
    for at in range(0, len(symbols.names), piece):
        mine = np.flatnonzero((a >= at) & (a < at + piece))
        if len(mine):
            grams = symbols.names[at : at + piece + window + 256]
            for x, y in zip(core, core[1:], strict=False):
                grams = doubled(grams, x, y)
            # All windows of the chunk hold the core that begins at its last start.
            further = grams[np.minimum(top[mine] - at, len(grams) - 1)]
            names = mix(rank[owner[mine]].view(U) * _STEP + further).view(np.int64)
            context, check = symbols.digests(a[mine], b[mine] + window)
            yield names, context, check, a[mine], (b[mine] - a[mine] + 1) | ((top[mine] - a[mine]) << 8)


def find_repeats(docs: DataFrame, symbols: Callable, k: int, window: int, chunks: list[int], within: bool, what: str) -> DataFrame:
    """texts() -> (doc, version, start, n, earlier, earlier_start): n windows from start on, all of which also start earlier.

    symbols: body -> Symbols. within: an earlier start in the same document counts; else only one in a document with a
    smaller doc_id. chunks: window starts to a chunk in the rounds after the first; the last is 1. earlier, earlier_start: an
    earlier document (or the same) and the place in it of the same windows.
    """

    def first(body: bytes):
        text = symbols(body)
        for name, at, low, high in anchors(text.names, k, window):
            context, check = text.digests(low, high + window)
            yield name, context, check, low, (high - low + 1) | ((at - low) << 8)

    rows = docs.mapInArrow(_emit(within, first, False), DEALT)
    found = []
    for i, chunk in enumerate([*chunks, None]):
        marks = _round(rows, within, f"{what}-{i}")
        found.append(marks.where("repeat"))
        if chunk is None:
            break

        def later(body: bytes, todo: tuple, chunk: int = chunk):
            return _chunks(symbols(body), todo, window, chunk)

        todo = marks.where("not repeat").groupBy("doc", "version").agg(F.collect_list(F.struct("start", "shape", "rank")).alias("todo"))
        rows = docs.join(todo, ["doc", "version"]).select("doc", "version", "body", "todo").mapInArrow(_emit(within, later, chunk == 1), DEALT)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.select("doc", "version", "start", F.col("shape").bitwiseAND(255).alias("n"), "earlier", "earlier_start")
