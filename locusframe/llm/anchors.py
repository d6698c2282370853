"""Anchors: positions that equal stretches of symbols have in common, wherever they stand.

Of the k-grams of every window the one with the least (mixed) name is the window's anchor, the leftmost of equals. Equal
windows have equal anchors at equal offsets, so whoever looks for repeated windows can meet at anchors, of which there are
about 2 in window - k + 2 positions. Names of stretches are made by doubling: the name of 2 m symbols at a position mixes the
names of m symbols there and m further on. Names only say which stretches may be equal; digests say which are.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xFF51AFD7ED558CCD)


def mix(x: np.ndarray) -> np.ndarray:
    x = x * _C
    x ^= x >> U(32)
    x *= _A
    x ^= x >> U(29)
    return x


def doubled(names: np.ndarray, have: int, want: int) -> np.ndarray:
    """Names of ``want`` symbols (have < want <= 2 have) from names of ``have`` symbols, at every position that has as many."""
    step = want - have
    return mix(names[: max(0, len(names) - step)] * _B + names[step:])


def lengths_to(n: int) -> list[int]:
    """1, 2, 4, ... and then n."""
    out = [1]
    while out[-1] * 2 < n:
        out.append(out[-1] * 2)
    return [*out, n] if n > 1 else out


def names_of(symbols: np.ndarray, n: int) -> np.ndarray:
    """Names of all stretches of n symbols."""
    names, sizes = symbols, lengths_to(n)
    for a, b in zip(sizes, sizes[1:], strict=False):
        names = doubled(names, a, b)
    return names


def digests(data: bytes, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit BLAKE2 digests of data[low:high], as two int64 arrays: what decides that two stretches are equal."""
    found = b"".join([blake2b(data[a:b], digest_size=16).digest() for a, b in zip(low.tolist(), high.tolist(), strict=True)])
    both = np.frombuffer(found, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def anchors(symbols: np.ndarray, k: int, window: int, piece: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """(name of the k-gram, position, first and last window start) of the anchors; int64 arrays, for pieces of a text's window starts.

    An anchor that serves windows of two pieces is given for each.
    """
    n = len(symbols) - window + 1
    for a in range(0, n, piece):
        part = symbols[a : min(a + piece, n) + window - 1]
        grams = names_of(part, k)
        # 40 bits of the mixed name, then the position: the least is the leftmost of the least.
        least = (mix(grams + _A) & ~U((1 << 24) - 1)) | np.arange(len(grams), dtype=U)
        sizes = lengths_to(window - k + 1)
        for x, y in zip(sizes, sizes[1:], strict=False):
            least = np.minimum(least[: len(least) - (y - x)], least[y - x :])
        at = (least & U((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        yield grams[at[first]].view(np.int64), at[first] + a, first + a, last + a


def joined(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the stretches [start, end)."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(starts[1:] > reach[:-1]) + 1
    return list(zip(starts[np.concatenate([[0], cut])].tolist(), reach[np.concatenate([cut - 1, [len(reach) - 1]])].tolist(), strict=True))
