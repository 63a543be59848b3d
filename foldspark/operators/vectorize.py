"""Nested records to vectors of fixed length: histograms, scalars and signed hashes, block by block, as column expressions.

Blocks and their widths: histogram 256, byteentropy 256, strings 104, general 10, header 62, section 255, imports 1280,
exports 128, datadirectories 30; 2,381 in all. All of it is SQL over arrays, maps and structs: no row leaves the JVM.

Cases: null blocks and null arrays, maps or strings in them are empty, and null numbers 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators.hashing import hashed, let

#: Block widths, in the order of the vector.
WIDTHS = {"histogram": 256, "byteentropy": 256, "strings": 104, "general": 10, "header": 62, "section": 255, "imports": 1280, "exports": 128, "datadirectories": 30}
#: Fields that are taken as they are, in the order of the vector.
GENERAL = ("size", "vsize", "has_debug", "exports", "imports", "has_relocations", "has_resources", "has_signature", "has_tls", "symbols")
VERSIONS = tuple(f"{m}_{p}_version" for p in ("image", "linker", "operating_system", "subsystem") for m in ("major", "minor"))
SIZES = ("sizeof_code", "sizeof_headers", "sizeof_heap_commit")
STRINGS = (("numstrings", "avlength", "printables"), ("entropy", "paths", "urls", "registry", "MZ"))
DIRECTORIES = 15

_RECORD = """sha256 string, label int, avclass string, histogram array<bigint>, byteentropy array<bigint>,
strings struct<numstrings:bigint,avlength:double,printabledist:array<bigint>,printables:bigint,entropy:double,paths:bigint,urls:bigint,registry:bigint,MZ:bigint>,
general struct<{general}>,
header struct<coff:struct<timestamp:bigint,machine:string,characteristics:array<string>>,optional:struct<subsystem:string,dll_characteristics:array<string>,magic:string,{optional}>>,
section struct<entry:string,sections:array<struct<name:string,size:bigint,entropy:double,vsize:bigint,props:array<string>>>>,
imports map<string,array<string>>, exports array<string>, datadirectories array<struct<name:string,size:bigint,virtual_address:bigint>>"""
RECORD_SCHEMA = _RECORD.format(general=",".join(f"{c}:bigint" for c in GENERAL), optional=",".join(f"{c}:bigint" for c in (*VERSIONS, *SIZES)))


def _numbers(*fields: str) -> str:
    return f"array({', '.join(f'coalesce(CAST({f} AS DOUBLE), CAST(0 AS DOUBLE))' for f in fields)})"


def _shares(counts: str) -> str:
    """Counts over their sum, or zeros."""
    total = "aggregate(x, CAST(0 AS DOUBLE), (a, v) -> a + v)"
    return let("x", f"transform({counts}, v -> coalesce(CAST(v AS DOUBLE), CAST(0 AS DOUBLE)))", let("n", total, "transform(x, v -> IF(n = 0, v, v / n))"))


def _strings() -> str:
    spread = "transform(strings.printabledist, v -> coalesce(CAST(v AS DOUBLE), CAST(0 AS DOUBLE)) / greatest(coalesce(strings.printables, 0), 1))"
    return f"concat({_numbers(*(f'strings.{c}' for c in STRINGS[0]))}, {spread}, {_numbers(*(f'strings.{c}' for c in STRINGS[1]))})"


def _header() -> str:
    coff, optional = "header.coff", "header.optional"
    hashes = [f"array({coff}.machine)", f"{coff}.characteristics", f"array({optional}.subsystem)", f"{optional}.dll_characteristics", f"array({optional}.magic)"]
    return f"concat({_numbers(f'{coff}.timestamp')}, {', '.join(hashed(f'filter({t}, v -> v IS NOT NULL)', 10) for t in hashes)}, {_numbers(*(f'{optional}.{c}' for c in (*VERSIONS, *SIZES)))})"


def _section() -> str:
    """Five counts, three hashes of (name, number), the characters of the entry's name, and its sections' properties."""
    parts = "coalesce(section.sections, CAST(array() AS {kind}))".format(kind="ARRAY<STRUCT<name: STRING, size: BIGINT, entropy: DOUBLE, vsize: BIGINT, props: ARRAY<STRING>>>")
    has = lambda p: f"coalesce(array_contains(s.props, '{p}'), false)"
    counted = [f"filter({parts}, s -> {c})" for c in ("s.size = 0", "s.name = ''", f"{has('MEM_READ')} AND {has('MEM_EXECUTE')}", has("MEM_WRITE"))]
    counts = _numbers(f"size({parts})", *(f"size({c})" for c in counted))
    numbers = [hashed(f"transform({parts}, s -> s.name)", 50, f"transform({parts}, s -> CAST(s.{c} AS DOUBLE))") for c in ("size", "entropy", "vsize")]
    letters = "IF(coalesce(section.entry, '') = '', CAST(array() AS ARRAY<STRING>), transform(sequence(1, length(section.entry)), i -> substr(section.entry, i, 1)))"
    own = f"flatten(transform(filter({parts}, s -> s.name = section.entry), s -> coalesce(s.props, CAST(array() AS ARRAY<STRING>))))"
    return f"concat({counts}, {', '.join(numbers)}, {hashed(letters, 50)}, {hashed(own, 50)})"


def _imports() -> str:
    entries = "map_entries(coalesce(imports, CAST(map() AS MAP<STRING, ARRAY<STRING>>)))"
    libraries = f"array_distinct(transform({entries}, e -> lower(e.key)))"
    names = f"flatten(transform({entries}, e -> transform(coalesce(e.value, CAST(array() AS ARRAY<STRING>)), f -> concat(lower(e.key), ':', f))))"
    return f"concat({hashed(libraries, 256)}, {hashed(names, 1024)})"


def _directories() -> str:
    at = lambda f: f"coalesce(CAST(get(datadirectories, i).{f} AS DOUBLE), CAST(0 AS DOUBLE))"
    return f"flatten(transform(sequence(0, {DIRECTORIES - 1}), i -> array({at('size')}, {at('virtual_address')})))"


#: SQL of each block.
BLOCKS = {
    "histogram": _shares("histogram"), "byteentropy": _shares("byteentropy"), "strings": _strings(), "general": _numbers(*(f"general.{c}" for c in GENERAL)),
    "header": _header(), "section": _section(), "imports": _imports(), "exports": hashed("exports", 128), "datadirectories": _directories(),
}


def vectorize(records: DataFrame, blocks: tuple[str, ...] = tuple(WIDTHS), keep: tuple[str, ...] = ("sha256", "label", "avclass"), version: int = 2) -> DataFrame:
    """The kept columns and `features`, an array of floats; blocks restricts it to some, always in the fixed order."""
    if version != 2:
        raise ValueError(f"feature version must be 2, not {version}")
    whole = [f"IF(size(b) = {n}, b, array_repeat(CAST(0 AS DOUBLE), {n}))" for n in WIDTHS.values()]  # a null block is zeros
    parts = [let("b", BLOCKS[b], w) for (b, w) in zip(WIDTHS, whole, strict=True) if b in blocks]
    return records.select(*keep, F.expr(f"CAST(concat({', '.join(parts)}) AS ARRAY<FLOAT>)").alias("features"))
