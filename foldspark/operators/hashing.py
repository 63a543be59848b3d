"""Signed feature hashing as column expressions, compatible with 32-bit MurmurHash3 (x86, seed 0): bin |h| mod n, sign of h.

Spark's own hashes have another seed and no sign. `hash_tokens` takes Arrow batches: each distinct token of a batch is hashed once, all tokens
side by side, four bytes a step, and signs are counted by (row, bin). `hashed` is SQL over arrays, for expressions over nested records that
stay in the JVM: words of 4 bytes are mixed and folded with 64-bit arithmetic that can't overflow. Its sums go over bins in two steps,
first by high digits, then by low ones, so a token is looked at some 2 * sqrt(n) times instead of n times.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The constants of MurmurHash3 x86 32.
FIRST, SECOND, ADDED = 0xCC9E2D51, 0x1B873593, 0xE6546B64
FINAL = ((16, 0x85EBCA6B), (13, 0xC2B2AE35))
MASK = 0xFFFFFFFF
#: Entries up to which bins are looked up among them; tokens from which a step of all of them is taken at once.
FEW, MANY = 8, 16


def let(name: str, value: str, body: str) -> str:
    """SQL of body with a name for a value, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _times(x: str, c: int) -> str:
    """x * c modulo 2^32, by halves of x."""
    return f"((({x} & 65535) * {c}L + (((shiftright({x}, 16) * {c}L) & 65535L) * 65536L)) & {MASK}L)"


def _turned(x: str, by: int) -> str:
    return f"((shiftleft({x}, {by}) | shiftright({x}, {32 - by})) & {MASK}L)"


def _pair(at: str) -> str:
    return f"substr(t.x, {at}, 2)"


def murmur3(tokens: str) -> str:
    """SQL for the signed 32-bit hashes of an array of strings (in SQL); nulls in it have the hash of ''."""
    number = lambda pairs: f"CAST(conv(concat({', '.join(pairs)}), 16, 10) AS BIGINT)"
    raw = f"transform({tokens}, s -> named_struct('x', hex(encode(coalesce(s, ''), 'UTF-8')), 'n', octet_length(coalesce(s, ''))))"
    word = number([_pair(f"8 * i + {k}") for k in (7, 5, 3, 1)])
    words = f"IF(t.n < 4, CAST(array() AS ARRAY<BIGINT>), transform(sequence(0, t.n div 4 - 1), i -> {word}))"
    rest = number([_pair("2 * t.n - 1"), f"IF(t.n % 4 > 1, {_pair('2 * t.n - 3')}, '')", f"IF(t.n % 4 > 2, {_pair('2 * t.n - 5')}, '')"])
    split = f"transform({raw}, t -> named_struct('n', t.n, 'w', concat({words}, array(IF(t.n % 4 = 0, 0L, {rest})))))"
    mixed = f"transform(transform(transform(t.w, k -> {_times('k', FIRST)}), k -> {_turned('k', 15)}), k -> {_times('k', SECOND)})"
    mixed = f"transform({split}, t -> named_struct('n', t.n, 'w', {mixed}))"
    fold = f"aggregate(slice(t.w, 1, size(t.w) - 1), 0L, (h, k) -> {let('y', 'h ^ k', f'({_turned("y", 13)} * 5 + {ADDED}L) & {MASK}L')})"
    folded = f"transform({mixed}, t -> {fold} ^ element_at(t.w, -1) ^ CAST(t.n AS BIGINT))"
    last = "h"
    for shift, factor in FINAL:
        last = let("y", f"({last}) ^ shiftright({last}, {shift})" if last == "h" else let("z", last, f"z ^ shiftright(z, {shift})"), _times("y", factor))
    unsigned = let("z", last, "z ^ shiftright(z, 16)")
    return f"transform(transform({folded}, h -> {unsigned}), h -> IF(h >= 2147483648L, h - 4294967296L, h))"


def sums_by_bin(entries: str, bins: int) -> str:
    """SQL for the array of `bins` sums of an array of structs (bin, v)."""
    low = math.isqrt(bins - 1) + 1
    high = -(-bins // low)
    inner = f"transform(sequence(0, {low - 1}), lo -> aggregate(filter(own, e -> e.bin = hi * {low} + lo), CAST(0 AS DOUBLE), (a, e) -> a + e.v))"
    parts = f"transform(transform(sequence(0, {high - 1}), hi -> filter(es, e -> e.bin div {low} = hi)), (own, hi) -> {inner})"
    dense = f"slice(flatten({parts}), 1, {bins})"
    # of few entries, bins are looked up among them: most bins are met by none
    found = "array_distinct(transform(es, e -> e.bin))"
    sums = "transform(found, k -> aggregate(filter(es, e -> e.bin = k), CAST(0 AS DOUBLE), (a, e) -> a + e.v))"
    sparse = let("found", found, let("sums", sums, f"transform(sequence(0, {bins - 1}), k -> IF(array_contains(found, k), sums[array_position(found, k) - 1], CAST(0 AS DOUBLE)))"))
    return let("es", entries, f"IF(size(es) <= {FEW}, {sparse}, {dense})" if bins > FEW else dense)


def hashed(tokens: str, bins: int, values: str | None = None) -> str:
    """SQL for `bins` sums of sign * value over an array of tokens; values: an array beside it, else all 1. A null array gives zeros."""
    some = f"coalesce({tokens}, CAST(array() AS ARRAY<STRING>))"
    signed = "IF(h >= 0, CAST(1 AS DOUBLE), CAST(-1 AS DOUBLE))"
    bin_ = f"CAST(abs(h) % {bins} AS INT)"
    if values is None:
        return sums_by_bin(f"transform({murmur3(some)}, h -> named_struct('bin', {bin_}, 'v', {signed}))", bins)
    numbers = f"coalesce({values}, CAST(array() AS ARRAY<DOUBLE>))"
    return sums_by_bin(f"zip_with({murmur3(some)}, {numbers}, (h, v) -> named_struct('bin', {bin_}, 'v', {signed} * CAST(v AS DOUBLE)))", bins)


def _mixed(k: np.ndarray) -> np.ndarray:
    k = k * np.uint32(FIRST)
    return (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(SECOND)


def hashes(words: pa.Array) -> np.ndarray:
    """Signed 32-bit hashes (as 64-bit integers) of an array of strings without nulls."""
    words = words.cast(pa.large_binary())
    at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset) if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    order = np.argsort(at[:-1] - at[1:], kind="stable")  # longest first, so those with a step left are in front
    start, size = at[:-1][order], np.diff(at)[order]
    steps = size // 4
    ends = np.cumsum(steps)
    byte = np.repeat(start - 4 * (ends - steps), steps) + 4 * np.arange(steps.sum())
    k = np.zeros(len(byte), np.uint32)
    for b in range(4):
        k |= data[byte + b].astype(np.uint32) << np.uint32(8 * b)
    k, first, h = _mixed(k), ends - steps, np.zeros(len(words), np.uint32)
    alive, i = len(words), 0
    while True:
        alive = int(np.searchsorted(-steps[:alive], -i))
        if alive < MANY:
            break
        y = h[:alive] ^ k[first[:alive] + i]
        h[:alive] = (y << np.uint32(13) | y >> np.uint32(19)) * np.uint32(5) + np.uint32(ADDED)
        i += 1
    for j in range(alive):  # few long tokens: one by one
        x = int(h[j])
        for word in k[first[j] + i : ends[j]].tolist():
            x ^= word
            x = ((x << 13 | x >> 19) * 5 + ADDED) & MASK
        h[j] = x
    last = np.zeros(len(words), np.uint32)
    for b in range(3):
        some = size % 4 > b
        last[some] |= data[(start + 4 * steps + b)[some]].astype(np.uint32) << np.uint32(8 * b)
    h ^= _mixed(last) ^ size.astype(np.uint32)
    for shift, factor in FINAL:
        h = (h ^ h >> np.uint32(shift)) * np.uint32(factor)
    out = np.empty(len(words), np.int64)
    out[order] = (h ^ h >> np.uint32(16)).view(np.int32)
    return out


def hash_tokens(tokens: str, bins: int) -> Column:
    """Array of `bins` sums of signs over a column of arrays of tokens. A null array gives zeros, a null token counts as ''."""

    @F.arrow_udf("array<double>")
    def sums(lists: pa.Array) -> pa.Array:
        words = pc.fill_null(lists.flatten(), "").dictionary_encode()
        h, of = hashes(words.dictionary), words.indices.to_numpy()
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        got = np.bincount(row * bins + (np.abs(h) % bins)[of], np.where(h >= 0, 1.0, -1.0)[of], len(lists) * bins)
        return pa.ListArray.from_arrays(np.arange(0, len(got) + 1, bins, dtype=np.int32), got.astype(float))

    return sums(F.coalesce(F.expr(tokens), F.expr("CAST(array() AS ARRAY<STRING>)")))
