"""Word and shingle hashing over Arrow string batches, shared by the document operators.

A word is a maximal run of bytes other than ``0x20`` and ``0x09``-``0x0D``. Texts are UTF-8, where these bytes
only ever stand for themselves, so words are found and hashed on raw bytes with numpy, without a Python object
for each word. Work goes in pieces of about a megabyte, so memory follows the Arrow batch and not its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose outputs look independent (the splitmix64 finaliser)."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_R = 0xD6E8FEB86659FD93
_RI = pow(_R, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, r in ((0, _R), (1, _RI)):
            step = np.full(n, r, U64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _bounds(raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words that lie in raw[lo:hi]; lo and hi don't cut a word."""
    inside = ~space[raw[lo:hi]]
    first = np.zeros(hi - lo + 1, bool)
    a, b = np.searchsorted(offsets, [lo, hi])
    cut = offsets[a:b] - lo
    first[cut] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside
    end = end.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    return np.flatnonzero(start) + lo, np.flatnonzero(end) + lo + 1


def _pieces(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> list[tuple[int, int]]:
    out, lo, n = [], 0, len(raw)
    while lo < n:
        hi = min(lo + PIECE, n)
        step = 4096
        while hi < n and not space[raw[hi - 1]]:  # move on to the next white space or text
            window = np.flatnonzero(space[raw[hi : hi + step]])
            k = np.searchsorted(offsets, hi)
            nearest = int(offsets[k]) if k < len(offsets) else n
            if len(window):
                hi = min(nearest, hi + int(window[0]) + 1)
                break
            if nearest <= hi + step:
                hi = nearest
                break
            hi, step = min(hi + step, n), step * 2
        out.append((lo, hi))
        lo = hi
    return out


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False, spans: bool = False, space: np.ndarray = _SPACE):
    """64-bit hash and text index of each word, in order; with spans also its start and end byte. space: separators, by byte."""
    hashes, docs, starts, ends = [], [], [], []
    for lo, hi in _pieces(raw, offsets, space):
        s, e = _bounds(raw, offsets, lo, hi, space)
        if not len(s):
            continue
        piece = raw[lo:hi]
        up, down = _pow(hi - lo + 1)
        total = np.zeros(hi - lo + 1, U64)
        values = _BYTE[_LOWER[piece]] if lower else _BYTE[piece]
        values *= up[: hi - lo]
        np.cumsum(values, out=total[1:])
        h = (total[e - lo] - total[s - lo]) * down[s - lo]
        hashes.append(mix(h ^ ((e - s).astype(U64) * U64(0x9E3779B97F4A7C15))))
        docs.append((np.searchsorted(offsets, s, "right") - 1).astype(np.int64))
        if spans:
            starts.append(s)
            ends.append(e)
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    if spans:
        return cat(hashes, U64), cat(docs, np.int64), cat(starts, np.int64), cat(ends, np.int64)
    return cat(hashes, U64), cat(docs, np.int64)


_STEPS = [int(x) | 1 for x in mix(np.arange(1000, 1064, dtype=U64))]


def windows(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each k consecutive words (those that cross texts included; see inside())."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    base = mix(hashes ^ U64(seed)) if seed else hashes
    total = np.zeros(n, U64)
    for j in range(k):
        total += base[j : j + n] * U64(_STEPS[j])
    return mix(total)


def inside(docs: np.ndarray, k: int) -> np.ndarray:
    """Which windows of k words stay within one text."""
    n = len(docs) - k + 1
    return docs[:n] == docs[k - 1 :] if n > 0 else np.zeros(0, bool)


def counts(docs: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(docs, minlength=n).astype(np.int64)


def byte_table(*sets) -> np.ndarray:
    out = np.zeros(256, bool)
    for s in sets:
        out[list(s)] = True
    return out
