"""Vectorised word and shingle hashes of Arrow string columns (inside tasks).

Texts are worked on in pieces of about ``PIECE`` bytes, so memory is bounded by
the longest text, not by the batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
U = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grows by doubling."""
    have = _POWERS.get(base)
    if have is None:
        have = np.ones(1, U)
    while len(have) < n:
        have = np.concatenate([have, have * U(pow(base, len(have), 1 << 64))])
    if len(have) <= 4 * PIECE:
        _POWERS[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher: spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of rows of about PIECE bytes."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + PIECE, "right")) - 1)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased (A-Z) words, and the number of words before each row and the end."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    ink = ~_SPACE[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    cuts = off[(off > 0) & (off < n)]
    first[cuts] = ink[cuts]
    last[cuts - 1] = ink[cuts - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, U)
    np.cumsum((_LOWER[data].astype(U) + U(1)) * powers(_P, n), out=total[1:])
    h = (total[end] - total[begin]) * powers(_P_INV, n)[begin]
    return mixed(h + (end - begin).astype(U) * U(0xD6E8FEB86659FD93)), np.searchsorted(begin, off)


def shingles(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, offsets): each row's distinct ``width``-word shingles,
    sorted; a row of fewer words has its whole sequence as the only one."""
    mult = [U(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64)) for k in range(width)]
    for i, j, data, off in pieces(column):
        wh, at = word_hashes(data, off)
        n = np.diff(at)
        full = np.zeros(max(0, len(wh) - width + 1), U)
        for k in range(width if len(full) else 0):
            full += wh[k:k + len(full)] * mult[k]
        full = mixed(full)
        size = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        to = np.concatenate([[0], np.cumsum(size)])
        row = np.repeat(np.arange(j - i), size)
        pick = at[:-1][row] + np.arange(to[-1]) - to[:-1][row]
        h = np.zeros(to[-1], U)
        whole = (n >= width)[row]
        h[whole] = full[pick[whole]]
        for r in np.flatnonzero((n > 0) & (n < width)):
            ws = wh[at[r]:at[r + 1]]
            h[to[r]] = mixed(np.array([sum(int(w) * int(m) for w, m in zip(ws, mult)) + len(ws) & (1 << 64) - 1], U))[0]
        for a, b in zip(to[:-1], to[1:]):
            h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[to[:-1][size > 0]] = True
        kept = np.concatenate([[0], np.cumsum(new)])
        yield i, j, h[new], kept[to]
