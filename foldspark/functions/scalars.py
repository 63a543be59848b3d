"""Column expressions: labels, prefixes, encodings, guarded arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def binary_label(c: Column, positive: str) -> Column:
    """1 where the trimmed, lower-cased text is `positive`, else 0."""
    return (F.lower(F.trim(c)) == positive).cast("int")


def prefix(c: Column, tokens: int, separator: str = "-") -> Column:
    """The first tokens of a text, joined again and trimmed; all of it, where it has fewer."""
    return F.trim(F.array_join(F.slice(F.split(c, separator), 1, tokens), separator))


def sweep_encoding(values: Column) -> Column:
    """A sweep's encoding from the array of distinct ones in it: the only one, `joint` if several, null if none."""
    return F.when(F.size(values) == 1, F.element_at(values, 1)).when(F.size(values) > 1, F.lit("joint"))


def series(model: Column, encoding: Column, kernel: str) -> Column:
    """Model name, with the encoding where the model is the kernel one."""
    return F.when(model == kernel, F.concat(F.lit(f"{kernel}-"), F.coalesce(encoding, F.lit("")))).otherwise(model)


def softmax(scores: Column) -> Column:
    """Softmax of an array, shifted by its maximum so that no exponent overflows."""
    # the maximum and the sum are named by lambdas: inside a lambda over values they would be worked out for each value
    named = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    powers = named(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return named(powers, lambda p: named(total(p), lambda t: F.transform(p, lambda x: x / t)))


def n_qubits(components: Column, encoding: str) -> Column:
    """Qubits that hold so many components: logarithmic for the amplitude map, one each for others."""
    if encoding == "amplitude":
        return F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(components, F.lit(1)).cast("double"))).cast("int"))
    return components.cast("int")


def sample_size(budget: Column, reference_n: int, reference_s: float, exponent: float) -> Column:
    """Rows that a time budget allows under a power law; an error for a budget that isn't positive."""
    power = F.pow(budget.cast("double") / reference_s, F.lit(1 / exponent)) * reference_n
    return F.when(budget > 0, F.floor(power + 1e-9).cast("int")).otherwise(F.raise_error(F.lit("budget must be positive")).cast("int"))


def gates(n: Column, encoding: str) -> Column:
    """Gates of a feature map and its inverse on n qubits."""
    n = n.cast("long")
    if encoding == "angle":
        return 2 * (3 * n - 1)
    return (2 * (2 * n + n * (n - 1) / 2)).cast("long")


def minmax(x: Column, lo: Column, hi: Column, top: float = math.pi) -> Column:
    """x scaled from [lo, hi] to [0, top] and clipped; 0 where lo = hi."""
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(top), (x - lo) / (hi - lo) * top))
    return F.when(hi > lo, scaled).otherwise(F.lit(0.0))


def pad_normalize(values: Column, width: int) -> Column:
    """An array cut or padded with zeros to a width, with unit length; all zero stays so."""
    padded = F.slice(F.concat(F.transform(values, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), width)), 1, width)
    norm = F.sqrt(F.aggregate(padded, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(padded, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def l1_normalize(values: Column) -> Column:
    """An array divided by its sum; zeros where that is 0."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.transform(values, lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation as an aggregate, 0 for a constant column (corr raises there in ANSI mode)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    varies = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return F.when(varies, F.coalesce(r, F.lit(0.0))).otherwise(F.lit(0.0))


def lcg(key: Column, seed: int = 42) -> Column:
    """A fixed shuffle of integer keys, reduced to 31 bits first: the same order in any engine and for any partitioning.

    Keys whose difference is a multiple of 2 ** 31 - 1 tie; callers order ties by the key.
    """
    return (F.pmod(key.cast("long"), F.lit(2147483647)) * 48271 + seed) % 2147483647
