"""Secret scans: an Aho-Corasick prefilter finds keywords, anchored regular expressions run at the hits only, and tokens
that embed a checksum are kept only when it holds: GitHub's and npm's tokens (CRC-32 in base 62), extended private keys
(Base58Check), and nostr and age secret keys (Bech32).

Cases: a null text is an empty text without spans; repeated rows are scanned each by itself; an empty table gives no rows;
further columns are ignored by `scan` and carried by `redact`. Texts are scanned whole. Spans count code points, ends
exclusive. Where spans of several kinds overlap, each is reported, and `redact` masks their union.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "github", "npm", "xprv", "nsec", "age")
BASE = KINDS[:3]
MASK = "[REDACTED]"

_ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_SUMMED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])")
_NSEC = re.compile(r"nsec1[02-9ac-hj-np-z]{58}(?![A-Za-z0-9])")
_AGE = re.compile(r"AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}(?![A-Za-z0-9])")
#: Keyword (in lower case) and the family of patterns to try where it starts.
_KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
    "xprv": "xprv", "nsec1": "nsec", "age-secret-key-1": "age",
}
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
_automaton = None


def keywords():
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for word, kind in _KEYWORDS.items():
            a.add_word(word, (len(word), kind))
        a.make_automaton()
        _automaton = a
    return _automaton


def checksum(body: str) -> str:
    """CRC-32 of a token's random part, as six digits of base 62."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _DIGITS[r] + out
    return out


def base58_holds(token: str) -> bool:
    """Whether a Base58Check token of 78 bytes ends with four bytes of its double SHA-256."""
    n = 0
    for c in token:
        n = 58 * n + _BASE58.index(c)
    if n >> 656:
        return False
    raw = n.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_sum(name: str, values: list[int]) -> int:
    """The checksum polynomial of a Bech32 string; 1 where it holds."""
    out = 1
    for v in [*[ord(c) >> 5 for c in name], 0, *[ord(c) & 31 for c in name], *values]:
        top = out >> 25
        out = (out & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            out ^= g if top >> i & 1 else 0
    return out


def bech32_holds(token: str) -> bool:
    name, _, data = token.lower().rpartition("1")
    return bech32_sum(name, [_BECH32.index(c) for c in data]) == 1


def _summed(text: str, at: int, kind: str) -> int:
    """The end of a token with a valid checksum that starts here, or -1."""
    if kind in ("github", "npm"):
        m = _SUMMED.match(text, at)
        return m.end() if m and checksum(m[1]) == m[2] else -1
    m = {"xprv": _XPRV, "nsec": _NSEC, "age": _AGE}[kind].match(text, at)
    holds = base58_holds if kind == "xprv" else bech32_holds
    return m.end() if m and holds(m[0]) else -1


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by kind as in KINDS."""
    if not text:
        return []
    lower = text.lower()
    if len(lower) != len(text):  # a letter whose lower case is longer
        lower = text.translate(_ASCII_LOWER)
    hits: dict[str, list[int]] = {}
    for end, (length, kind) in keywords().iter(lower):
        hits.setdefault(kind, []).append(end - length + 1)
    out = [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    for kind, starts in hits.items():
        past = 0
        for at in sorted(starts):
            if at < past:
                continue
            if kind == "assign":
                if m := _ASSIGN.match(text, at):
                    past = m.end()
                    if len(m[1]) >= 8:
                        out.append((at, past, kind))
            elif kind == "access":
                if m := _ACCESS.match(text, at):
                    past = m.end()
                    if past - at >= 16:
                        out.append((at, past, kind))
            elif (end := _summed(text, at, kind)) >= 0:
                past = end
                out.append((at, past, kind))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [[{"kind": k, "start": s, "end": e} for s, e, k in spans(t.as_py())] for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _SPAN)], ["doc_id", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, start, end). One pass over the texts, no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of scan()'s spans."""
    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda x: x["kind"].isin(*kinds))

    def written(*kinds: str) -> Column:
        return F.array_join(F.transform(of(*kinds), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    n = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *n, F.sha2(written(*BASE), 256).alias("base_sha256"), written(*KINDS).alias("spans"))


def redacted(text: str | None) -> str | None:
    found = spans(text)
    if not found:
        return text
    out, past = [], 0
    for start, end, _ in found:
        if end <= past:
            continue
        if start >= past:
            out += [text[past:start], MASK]
        past = end
    return "".join([*out, text[past:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with the secrets in `text` masked; `n_chars`, if there, follows the text. No document goes."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            before = b.column(at)
            after = pa.array([redacted(t.as_py()) for t in before], before.type)
            yield b.set_column(at, b.schema.field(at), after)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(c) for c in names])
