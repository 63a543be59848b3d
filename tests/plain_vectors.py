"""Hashes and vectors of records one by one, which the column expressions are held against."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from foldspark.operators.vectorize import DIRECTORIES, GENERAL, SIZES, STRINGS, VERSIONS, WIDTHS

_MASK = 0xFFFFFFFF


def murmur3(data: bytes, seed: int = 0) -> int:
    """Signed 32-bit hash."""
    h, whole = seed, len(data) // 4 * 4
    tail = int.from_bytes(data[whole:], "little")
    blocks = [(int.from_bytes(data[i : i + 4], "little"), True) for i in range(0, whole, 4)]
    if len(data) > whole:
        blocks.append((tail, False))
    for k, full in blocks:
        k = k * 0xCC9E2D51 & _MASK
        k = ((k << 15) | (k >> 17)) & _MASK
        h ^= k * 0x1B873593 & _MASK
        if full:
            h = ((h << 13) | (h >> 19)) & _MASK
            h = (h * 5 + 0xE6546B64) & _MASK
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> shift)) * factor & _MASK
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def hashed(pairs: Iterable[tuple[str, float]], bins: int) -> np.ndarray:
    out = np.zeros(bins)
    for token, value in pairs:
        h = murmur3(token.encode())
        out[abs(h) % bins] += value if h >= 0 else -value
    return out


def _shares(counts: list) -> np.ndarray:
    x = np.asarray(counts, float)
    return x / x.sum() if x.sum() else x


def _tokens(words, bins: int) -> np.ndarray:
    return hashed(((w, 1.0) for w in words or ()), bins)


def _strings(r: dict) -> list:
    return [*(r[c] for c in STRINGS[0]), *(np.asarray(r["printabledist"], float) / max(r["printables"], 1)), *(r[c] for c in STRINGS[1])]


def _header(r: dict) -> np.ndarray:
    coff, optional = r["coff"], r["optional"]
    return np.concatenate([
        [coff["timestamp"]], _tokens([coff["machine"]], 10), _tokens(coff["characteristics"], 10), _tokens([optional["subsystem"]], 10),
        _tokens(optional["dll_characteristics"], 10), _tokens([optional["magic"]], 10), [optional[c] for c in (*VERSIONS, *SIZES)]])


def _section(r: dict) -> np.ndarray:
    """Five counts, three hashes of (name, number), the characters of the entry's name, and its sections' properties."""
    parts, entry = r["sections"] or [], r["entry"]
    props = [set(s["props"] or ()) for s in parts]
    counts = [len(parts), sum(s["size"] == 0 for s in parts), sum(s["name"] == "" for s in parts), sum({"MEM_READ", "MEM_EXECUTE"} <= p for p in props), sum("MEM_WRITE" in p for p in props)]
    numbers = [hashed(((s["name"], s[c]) for s in parts), 50) for c in ("size", "entropy", "vsize")]
    own = [p for s in parts if s["name"] == entry for p in s["props"] or ()]
    return np.concatenate([counts, *numbers, _tokens(list(entry), 50), _tokens(own, 50)])


def _imports(m: dict | list | None) -> np.ndarray:
    entries = dict(m or {})
    libraries = sorted({k.lower() for k in entries})
    return np.concatenate([_tokens(libraries, 256), _tokens([f"{k.lower()}:{f}" for k, fs in entries.items() for f in fs or ()], 1024)])


def _directories(rows: list | None) -> np.ndarray:
    out = np.zeros(2 * DIRECTORIES)
    for i, r in enumerate((rows or [])[:DIRECTORIES]):
        out[2 * i : 2 * i + 2] = r["size"], r["virtual_address"]
    return out


BLOCKS = {
    "histogram": _shares, "byteentropy": _shares, "strings": _strings, "general": lambda r: [r[c] for c in GENERAL], "header": _header,
    "section": _section, "imports": _imports, "exports": lambda x: _tokens(x, 128), "datadirectories": _directories,
}


def vector(record: dict, blocks: tuple[str, ...] = tuple(WIDTHS), version: int = 2) -> np.ndarray:
    """One record's vector of 32-bit floats; blocks restricts it to some, always in the fixed order."""
    if version != 2:
        raise ValueError(f"feature version must be 2, not {version}")
    return np.concatenate([np.asarray(BLOCKS[b](record[b]), float) for b in WIDTHS if b in blocks]).astype(np.float32)
