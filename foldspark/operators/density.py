"""Sums over all pairs of a fidelity kernel, from tensors of the rows' states: linear in rows, and no pair is ever met.

The kernel |<a|b>|^2 is the inner product of the states' density matrices a a*, and its square that of the density matrices of a x a. So
the sum of k over all pairs is the squared size of one summed matrix of d columns, that of k * k of one of d (d + 1) / 2 columns: a x a is
symmetric, so an entry of p < q stands for both orders. These matrices are Hermitian and are summed in strips of rows from the diagonal on.
Rows are dealt out in chunks of at most CHUNK; a task sums a strip from the top and one from the bottom, so all do as much, over a chunk,
and strips of the chunks are added up in two rounds of shuffles.

A row costs d^4 / 8 products, as many as it costs to meet some number of rows: for fewer rows sums() takes pairs by blocks. Both are exact.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.functions.scalars import lcg
from foldspark.operators.kernels import fidelity, kernel_sums, states
from foldspark.operators.stages import rows_of

#: Rows of a chunk; rows whose tensors are held at once; pairs of strips; partial sums that meet in a task of the first round.
CHUNK, ROWS, STRIPS, MEET = 65_536, 1024, 8, 64
#: Rows from which on tensors take less time, on six qubits.
NEAR = 20_000


def squares(s: np.ndarray, first: int) -> np.ndarray:
    """Columns (p, q) of s x s from p = first on, p <= q, those of p < q times the root of 2."""
    d = s.shape[1]
    out, lo = np.empty((len(s), (d - first) * (d - first + 1) // 2), complex), 0
    for p in range(first, d):
        np.multiply(np.sqrt(2) * s[:, p : p + 1], s[:, p:], out=out[:, lo : lo + d - p])
        out[:, lo] = s[:, p] ** 2
        lo += d - p
    return out


def _strips(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Where strips begin, the end included; and where the columns of each p do."""
    columns = d * (d + 1) // 2
    return np.linspace(0, columns, min(2 * STRIPS, columns) + 1).astype(int), np.append(0, np.cumsum(np.arange(d, 0, -1)))


def _added(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), complex) for x in t.column("m"))
    return pa.table({"strip": t.column("strip")[:1], "part": t.column("part")[:1], "rows": pa.array([sum(t.column("rows").to_pylist())], pa.int64()), "m": pa.array([total.tobytes()], pa.binary())})


def tensor_sums(rows: DataFrame, qubits: int, encoding: str, bandwidth: float = 1.0, key: str = "i", vector: str = "x") -> DataFrame:
    """One row (n, k1, k2) of sums over pairs i < j of the kernel and its square. Null vectors are no rows."""
    x = rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("i"), F.col(vector).alias("x"))
    chunks, (ends, begins) = max(1, -(-x.count() // CHUNK)), _strips(1 << qubits)
    dealt = x.select("x", F.pmod(lcg(F.col("i")), F.lit(chunks)).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(STRIPS - 1))).alias("at"))

    def add(t: pa.Table) -> pa.Table:
        chunk, at = t.column("chunk")[0].as_py(), t.column("at")[0].as_py()
        column, sums = t.column("x").combine_chunks(), {}
        own = [k for k in dict.fromkeys((at, len(ends) - 2 - at)) if at <= len(ends) - 2 - at]  # few columns have fewer strips
        first = int(np.searchsorted(begins, ends[own[0]], "right")) - 1 if own else 0
        for lo in range(0, len(column), ROWS):
            s = states(rows_of(column.slice(lo, ROWS)), encoding, bandwidth)
            if at == 0:
                sums[-1] = sums.get(-1, 0) + s.conj().T @ s
            f = squares(s, first) if own else None
            for k in own:
                a, b = ends[k] - begins[first], ends[k + 1] - begins[first]
                sums[k] = sums.get(k, 0) + f[:, a:b].conj().T @ f[:, a:]
        n = [len(column) if k == -1 else 0 for k in sums]
        return pa.table({"strip": pa.array(list(sums), pa.int32()), "part": pa.array([chunk // MEET] * len(sums), pa.int32()), "rows": pa.array(n, pa.int64()), "m": pa.array([np.ascontiguousarray(m).tobytes() for m in sums.values()], pa.binary())})

    def size(t: pa.Table) -> pa.Table:
        t = _added(t)
        strip, m = t.column("strip")[0].as_py(), np.abs(np.frombuffer(t.column("m")[0].as_py(), complex)) ** 2
        if strip >= 0:
            # the strip's own square is in full, what is right of it stands for what is below it, too
            n = ends[strip + 1] - ends[strip]
            m = m.reshape(n, -1) * np.where(np.arange(len(m) // n) < n, 1, 2)
        return pa.table({"strip": t.column("strip"), "rows": t.column("rows"), "size": pa.array([float(m.sum())])})

    ddl = "strip int, part int, rows long, m binary"
    parts = dealt.groupBy("chunk", "at").applyInArrow(add, ddl).groupBy("strip", "part").applyInArrow(_added, ddl)
    s = parts.groupBy("strip").applyInArrow(size, "strip int, rows long, size double")
    s = s.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("strip") < 0, F.col("size"))), F.lit(0.0)).alias("k1"), F.coalesce(F.sum(F.when(F.col("strip") >= 0, F.col("size"))), F.lit(0.0)).alias("k2"))
    # a state's kernel with itself is 1
    return s.select((F.col("rows") * (F.col("rows") - 1) / 2).cast("long").alias("n"), ((F.col("k1") - F.col("rows")) / 2).alias("k1"), ((F.col("k2") - F.col("rows")) / 2).alias("k2"))


def sums(rows: DataFrame, qubits: int, encoding: str, bandwidth: float = 1.0, key: str = "i", vector: str = "x", label: str = "y") -> DataFrame:
    """One row (n, k1, k2) by whichever way takes less time."""
    if rows.count() < NEAR * 16.0 ** (qubits - 6):
        return kernel_sums(rows, partial(fidelity, encoding=encoding, bandwidth=bandwidth), key, vector, label).select("n", "k1", "k2")
    return tensor_sums(rows, qubits, encoding, bandwidth, key, vector)
