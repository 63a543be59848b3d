"""Rolling exact medians: values of short time panes are sorted into runs, and ranks are bisected across runs without merging them.

A row's window holds the values of its series with a time in (its own - length, its own]. A series is cut into blocks of one
window's length; a block gets its own rows and those of the block before it, which hold all its windows. Within a block, panes
are short spans of time, of some 6 * sqrt(n) values where a window has n of them, each sorted by value. A window is the panes
that lie wholly in it, and its two edge panes filtered by time, which keeps their order. A median is found by bisecting the
values: a pivot's rank is the sum of its ranks in the runs. For the median absolute deviation the distance is bisected, and its
rank comes from two pivots of each run.

Rows meet as (series, time, value, times): equal values of one instant are counted before the shuffle and windows of equal times
are taken once, so an instant with a large share of all rows is one window with few distinct values. A task holds a block of a
series: two windows' lengths of distinct (time, value) pairs.

Cases: an id is taken once, whatever its rows (of different ones, the least by arrival, time, series and value, nulls first; a null
id is an id); a null time drops the row; a null series is a series; a null value, NaN, an infinity or a value whose hundredfold is
beyond 2^53 has no cents, and its row is returned all the same; equal times and values all count; an empty table gives no rows;
further columns are ignored. Times are exact microseconds: without a zone they are taken as written, whatever the session's zone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Microseconds of a window.
LENGTH = 15 * 60 * 1_000_000
#: Rows that a task works on at once, if blocks are small; and elements of edge panes that it has at once.
SLAB = 1 << 17
EDGES = 1 << 18
#: A pane has about this many times the root of a window's values.
PANE = 6
#: First distance that is tried for a deviation.
NEAR = 1024
MOST = float(1 << 53)

_RESULT = "series string, us long, n long, median2 long, mad4 long"


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp column; one without a zone isn't moved by the session's zone."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        since = c - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        day, hour, minute, second = (F.extract(F.lit(x), since) for x in ("DAY", "HOUR", "MINUTE", "SECOND"))
        return ((day.cast("long") * 24 + hour) * 60 + minute) * 60_000_000 + (second * 1_000_000).cast("long")
    return F.unix_micros(c)


def cents(value: Column) -> Column:
    """floor(100 * value + 0.5), null where that isn't a number up to 2^53."""
    x = F.floor(value * 100.0 + 0.5)
    return F.when((value * 100.0 < MOST) & (value * 100.0 > -MOST) & ~F.isnan(value), x).cast("long")


def once(clicks: DataFrame) -> DataFrame:
    """(click_id, kind, us, cents): each id once, those with a null time dropped."""
    row = F.struct("arrived_at", "ts", "kind", "value")
    first = clicks.select("click_id", row.alias("row")).groupBy("click_id").agg(F.min("row").alias("row")).select("click_id", "row.*")
    return first.filter("ts IS NOT NULL").select("click_id", "kind", micros(first, "ts").alias("us"), cents(F.col("value")).alias("cents"))


def windows(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(series, us, n, median2, mad4) for each distinct series and time of rows (series string, us long, value long or null).

    n: values in the window; median2: their doubled median; mad4: the doubled median of |2 * value - median2|.
    """
    counted = rows.groupBy("series", "us", "value").agg(F.count("*").alias("times"))
    block = f"(us - pmod(us, {length})) div {length}"
    spread = counted.select("*", F.explode(F.array(F.expr(block), F.expr(f"{block} + 1"))).alias("block"))
    blocks = spread.repartition("series", "block").sortWithinPartitions("series", "block")
    return blocks.mapInArrow(lambda batches: (b for t in whole_blocks(batches) for b in medians(t, length).to_batches()), _RESULT)


def rolling(clicks: DataFrame, length: int = LENGTH) -> DataFrame:
    """(click_id, kind, n, median2, mad4, far) of each click, with the window of its kind and time."""
    rows = once(clicks)
    found = windows(rows.select(F.col("kind").alias("series"), "us", F.col("cents").alias("value")), length)
    found = found.select("series", F.col("us").alias("at"), "n", "median2", "mad4")
    joined = rows.join(found, rows["kind"].eqNullSafe(found["series"]) & (rows["us"] == found["at"]))
    some = F.col("n") >= 1
    far = 2 * F.abs(2 * F.col("cents") - F.col("median2")) > 2 * F.col("mad4")
    return joined.select("click_id", "kind", "n", *[F.when(some, c).alias(a) for a, c in (("median2", F.col("median2")), ("mad4", F.col("mad4")), ("far", far))])


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks, of SLAB rows or one block at least, from rows sorted by series and block."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        if rows + b.num_rows >= SLAB:
            before = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1)]) if held else None
            t = pa.Table.from_batches([b])
            change = np.flatnonzero(_heads(pa.concat_tables([before, t]) if held else t)[1:]) + (0 if held else 1)
            if len(change):
                cut = int(change[-1])
                if held or cut:
                    yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
                held, rows = [], 0
                b = b.slice(cut)
        held.append(b)
        rows += b.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _heads(t: pa.Table) -> np.ndarray:
    """Which rows begin a series or block."""
    series = pc.fill_null(pc.dictionary_encode(t.column("series").combine_chunks()).indices, -1).to_numpy(zero_copy_only=False)
    block = t.column("block").to_numpy()
    head = np.ones(t.num_rows, bool)
    head[1:] = (series[1:] != series[:-1]) | (block[1:] != block[:-1])
    return head


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges in turn, and where each range's begin (with the end)."""
    n = np.maximum(ends - starts, 0)
    at = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(starts - at[:-1], n) + np.arange(at[-1]), at


class Runs:
    """Sorted runs of value places."""

    def __init__(self, run: np.ndarray, place: np.ndarray, times: np.ndarray, bounds: np.ndarray, values: int):
        kind = np.int32 if len(bounds) * values < 1 << 31 else np.int64
        self.values, self.bounds = kind(values), bounds
        self.key = run.astype(kind) * self.values + place.astype(kind)  # runs rise, and places in each
        self.total = None if (times == 1).all() else np.concatenate([[0], np.cumsum(times)])

    def ask(self, of: np.ndarray, at: np.ndarray) -> Asked:
        return Asked(self, of, at)


class Asked:
    """For each query, the runs that are its own: of[at[q] : at[q + 1]]."""

    def __init__(self, runs: Runs, of: np.ndarray, at: np.ndarray):
        self.key, self.total, self.values = runs.key, runs.total, int(runs.values)
        self.base, self.start, self.end, self.at = of.astype(self.key.dtype) * runs.values, runs.bounds[of], runs.bounds[of + 1], at
        self.query = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.some = np.flatnonzero(np.diff(at))

    def _where(self, place: np.ndarray) -> np.ndarray:
        """For each query's runs, how far values below its place reach."""
        return np.searchsorted(self.key, self.base + place.astype(self.key.dtype)[self.query])

    def _sum(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        n = hi - lo if self.total is None else self.total[hi] - self.total[lo]
        total = np.concatenate([[0], np.cumsum(n)])
        return total[self.at[1:]] - total[self.at[:-1]]

    def below(self, place: np.ndarray) -> np.ndarray:
        """For each query, how many of its values lie below the place."""
        return self._sum(self.start, self._where(place))

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self._sum(self._where(lo), self._where(hi))

    def _least(self, x: np.ndarray, none: int) -> np.ndarray:
        out = np.full(len(self.at) - 1, none)
        if len(self.some):
            out[self.some] = np.minimum.reduceat(x, self.at[self.some])
        return out

    def _key(self, where: np.ndarray) -> np.ndarray:
        return self.key[where] - self.base if len(self.key) else where

    def next_from(self, place: np.ndarray) -> np.ndarray:
        """For each query, its least value place from the given one on (values: none)."""
        w = self._where(place)
        return self._least(np.where(w < self.end, self._key(np.minimum(w, max(len(self.key) - 1, 0))), self.values), self.values)

    def last_before(self, place: np.ndarray) -> np.ndarray:
        """For each query, its largest value place below the given one (-1: none)."""
        w = self._where(place)
        return -self._least(np.where(w > self.start, -self._key(np.maximum(w - 1, 0)), 1), 1)


def _bisected(lo: np.ndarray, hi: np.ndarray, rank: np.ndarray, count: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The least x in [lo, hi] of each query with count(x) >= rank; count doesn't fall."""
    lo, hi = lo.copy(), hi.copy()
    while (lo < hi).any():
        mid = (lo + hi) >> 1
        enough = count(mid) >= rank
        hi = np.where(enough, mid, hi)
        lo = np.where(enough, lo, np.minimum(mid + 1, hi))
    return lo


def _select(parts: list[Asked], values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """median2 and mad4 of queries whose runs are in parts; values: by place; n: number of a query's values, 1 or more."""
    low, high = (n + 1) // 2, n // 2 + 1
    total = lambda f: sum(f(p) for p in parts)
    zero = np.zeros(len(n), np.int64)
    first = _bisected(zero, zero + len(values) - 1, low, lambda v: total(lambda p: p.below(v + 1)))
    after = np.minimum.reduce([p.next_from(first + 1) for p in parts])
    second = np.where(total(lambda p: p.below(first + 1)) >= high, first, np.minimum(after, len(values) - 1))
    m = values[first] + values[second]

    def reach(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the values with |2 * value - m| <= d."""
        return np.searchsorted(values, -((d - m) // 2)), np.searchsorted(values, (m + d) // 2, "right")

    def within(d: np.ndarray) -> np.ndarray:
        lo, hi = reach(d)
        return total(lambda p: p.between(lo, hi))

    most = np.maximum(2 * values[-1] - m, m - 2 * values[0])
    lo, hi = zero, np.minimum(most, NEAR)
    while (short := within(hi) < low).any():
        lo, hi = np.where(short, hi + 1, lo), np.where(short, np.minimum(most, 4 * hi), hi)
    near = _bisected(lo, hi, low, within)
    a, b = reach(near)
    up = np.minimum.reduce([p.next_from(b) for p in parts])
    down = np.maximum.reduce([p.last_before(a) for p in parts])
    far = np.iinfo(np.int64).max
    up = np.where(up < len(values), 2 * values[np.minimum(up, len(values) - 1)] - m, far)
    down = np.where(down >= 0, m - 2 * values[np.maximum(down, 0)], far)
    return m, near + np.where(within(near) >= high, near, np.minimum(up, down))


def medians(t: pa.Table, length: int) -> pa.Table:
    """The windows of all times of whole blocks, for those that lie in their block."""
    head = _heads(t)
    block = np.cumsum(head) - 1
    start = t.column("block").to_numpy() * length
    us, times = t.column("us").to_numpy(), t.column("times").to_numpy()
    own = us >= start  # the others are of the block before
    since = us - start + length  # in [0, 2 * length)
    key = block * (2 * length) + since
    asked, row = np.unique(key[own], return_index=True)
    row = np.flatnonzero(own)[row]
    known = t.column("value").is_valid().to_numpy()
    values, place = np.unique(t.column("value").filter(t.column("value").is_valid()).to_numpy(), return_inverse=True)
    order = np.argsort(key[known], kind="stable")
    key, block, since, times, place = key[known][order], block[known][order], since[known][order], times[known][order], place[order]
    lo, hi = np.searchsorted(key, asked - length, "right"), np.searchsorted(key, asked, "right")
    total = np.concatenate([[0], np.cumsum(times)])
    n = total[hi] - total[lo]
    median2, mad4 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    if len(key):
        # panes: a block's two lengths of time, each cut alike
        cuts = np.ceil(np.sqrt(np.bincount(block) / 2) / PANE).astype(np.int64).clip(1)
        pane = (np.concatenate([[0], np.cumsum(2 * cuts)])[block] + since * cuts[block] // length).astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], pane[1:] != pane[:-1]]))
        bounds = np.append(heads, len(pane))
        pane = np.repeat(np.arange(len(heads)), np.diff(bounds))
        run = np.lexsort((place, pane))  # rows by pane and value; a pane has the same bounds as by time
        whole = Runs(pane, place[run], times[run], bounds, len(values))
        some = np.flatnonzero(n)
        a, b = np.searchsorted(bounds, lo[some]), np.searchsorted(bounds, hi[some], "right") - 1  # panes a to b - 1 are whole
        one = a > b  # all in one pane
        left = np.where(bounds[a] > lo[some], a - 1, -1)
        right = np.where(~one & (bounds[b] < hi[some]), b, -1)
        size = np.where(left >= 0, bounds[left + 1] - bounds[left], 0) + np.where(right >= 0, bounds[right + 1] - bounds[right], 0)
        chunk = np.cumsum(size + np.maximum(b - a, 0) + 1) // EDGES
        for at in np.split(np.arange(len(some)), np.flatnonzero(np.diff(chunk)) + 1):
            q = some[at]
            of, first = _ranges(a[at], np.where(one[at], a[at], b[at]))
            parts = [whole.ask(of, first)]
            edge = np.stack([left[at], right[at]], 1).ravel()  # two to a query
            begin, end = np.where(edge >= 0, bounds[edge], 0), np.where(edge >= 0, bounds[edge + 1], 0)
            r, first = _ranges(begin, end)
            which = np.repeat(np.arange(len(edge)), np.diff(first))
            r = run[r]  # a row's rank by time
            inside = (r >= lo[q][which >> 1]) & (r < hi[q][which >> 1])
            r, which = r[inside], which[inside]
            ends = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(edge)))])
            edges = Runs(which, place[r], times[r], ends, len(values))
            parts.append(edges.ask(np.arange(len(edge)), 2 * np.arange(len(q) + 1)))
            median2[q], mad4[q] = _select(parts, values, n[q])
    series = t.column("series").take(pa.array(row))
    return pa.table({"series": series, "us": us[row], "n": n, "median2": median2, "mad4": mad4})
