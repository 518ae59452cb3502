"""Greedy, order-dependent groupings as folds over sorted rows that carry their state from batch to batch.

A safe gap (beyond which no rule can join two rows) first cuts each chromosome into islands with window functions. Islands
go to partitions, where their rows pass in order of position, end and id, so results do not depend on partitions. A task
holds an Arrow batch and what the rule itself keeps open: one anchor for `absorb`, the calls of one window for `CloseCalls`.
An island of any size passes in this memory; it is one task's work, as each step hangs on the one before.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandloom.operators.intervals import merge, with_island

#: Columns of a fold's rows: chrom, st, ed, support, id; other columns are not carried.
FIELDS = ["chrom", "kind", "st", "ed", "support", "id"]
BUNDLE = 2_000_000
ORDER = ("st", "ed", "id")


class Fold(Protocol):
    """Takes a group's rows in order and gives rows when they are settled."""

    def take(self, row: tuple) -> Iterable[tuple]: ...

    def end(self) -> Iterable[tuple]: ...


def stream(rows: DataFrame, group: Sequence[str], order: Sequence[str], make: Callable[[], Fold], schema: StructType, deal: Sequence | None = None) -> DataFrame:
    """Each group's rows, in `order`, through a new `make()`; rows are tuples of all columns.

    deal: what groups are dealt by, columns of the group or of parts of it (the group's columns by default).
    """
    arrow = to_arrow_schema(schema)
    at = [rows.columns.index(c) for c in group]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)] if out else [pa.array([], f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fold = None, None
        for b in batches:
            columns, out = [c.to_pylist() for c in b.columns], []
            for key, row in zip(zip(*(columns[k] for k in at)), zip(*columns)):
                if key != held:
                    if fold:
                        out += fold.end()
                    held, fold = key, make()
                out += fold.take(row)
            yield batch(out)
        if fold:
            yield batch(list(fold.end()))

    dealt = rows.repartition(*(deal or group)).sortWithinPartitions(*group, *order)
    return dealt.mapInArrow(run, schema)


def by_island(rows: DataFrame, keys: Sequence[str], make: Callable[[], Fold], schema: StructType, order: Sequence[str] = ORDER) -> DataFrame:
    """`stream` over islands (columns keys and island). Islands that start in the same BUNDLE bases go to one partition."""
    return stream(rows, [*keys, "island"], order, make, schema, [*keys, F.floor(F.col("island") / BUNDLE)])


class Absorb:
    """The first open row is an anchor that takes the rows behind it, growing, until the first that does not join. Rows are
    FIELDS; joins(st, ed, next st, next ed)."""

    def __init__(self, joins: Callable[[int, int, int, int], bool]) -> None:
        self.joins, self.anchor = joins, None

    def take(self, row: tuple) -> Iterable[tuple]:
        old = self.anchor
        st, ed = row[2], row[3]
        if old and self.joins(old[2], old[3], st, ed):
            old[2], old[3], old[4] = min(old[2], st), max(old[3], ed), old[4] + row[4]
            return ()
        self.anchor = list(row[:6])
        return (tuple(old),) if old else ()

    def end(self) -> Iterable[tuple]:
        return (tuple(self.anchor),) if self.anchor else ()


def fold(df: DataFrame, gap: int, joins: Callable[[int, int, int, int], bool], least: int = 1) -> DataFrame:
    """`Absorb` within each island of chrom and kind; keeps anchors with at least `least` support."""
    keys = ("chrom", "kind")
    rows = with_island(df.select(*FIELDS), gap, keys, ORDER).select(*FIELDS, "island")
    return by_island(rows, keys, lambda: Absorb(joins), df.select(*FIELDS).schema).filter(F.col("support") >= least)


def merge_small(signals: DataFrame, depth: float, near: int = 20) -> DataFrame:
    """Small signals: both ends less than `near` from the growing record's; support of a tenth of the depth, 2 at least."""
    return fold(signals, near, lambda st, ed, x, y: abs(st - x) < near and abs(ed - y) < near, max(int(depth / 10), 2))


def merge_normal(signals: DataFrame, depth: float, near: int = 300) -> DataFrame:
    """Any two ends less than `near` apart, or contained; support counts signals, a tenth of the depth, 1 at least."""

    def joins(st: int, ed: int, x: int, y: int) -> bool:
        return abs(st - x) < near or abs(ed - x) < near or abs(st - y) < near or abs(ed - y) < near or (st <= x and y <= ed)

    return fold(signals, near, joins, max(int(depth * 0.1), 1))


def merge_final(signals: DataFrame, pad: int = 600) -> DataFrame:
    """Signals that overlap once padded on both sides, supports summed: plain islands, without Python."""
    return merge(signals, 2 * pad, ("chrom",), ("support",))


class CloseCalls:
    """Rows (id, st, svlen, ...) by start: a call is settled once all calls within `near` behind it are here; it takes out
    later ones of like length that are no longer, up to the first longer one, which takes it out."""

    def __init__(self, near: int, low: float, high: float) -> None:
        self.near, self.low, self.high = near, low, high
        self.open: deque[list] = deque()  # id, start, length, gone

    def _settle(self) -> Iterable[tuple]:
        key, _, size, gone = self.open.popleft()
        if gone:
            return ()
        for other in self.open:
            if other[3] or not other[2] or not self.low <= size / other[2] <= self.high:
                continue
            if abs(size) < abs(other[2]):
                return ()
            other[3] = True
        return ((key,),)

    def take(self, row: tuple) -> Iterable[tuple]:
        out: list[tuple] = []
        while self.open and row[1] - self.open[0][1] > self.near:
            out += self._settle()
        self.open.append([row[0], row[1], row[2], False])
        return out

    def end(self) -> Iterable[tuple]:
        out: list[tuple] = []
        while self.open:
            out += self._settle()
        return out


def drop_close(calls: DataFrame, near: int = 300, low: float = 0.9, high: float = 1.1) -> DataFrame:
    """Of calls within `near` whose length ratio lies in between, the longer stays. Columns id (unique), chrom, st, svlen."""
    rows = with_island(calls.select("id", "st", "svlen", "chrom", F.col("st").alias("ed")), near).select("id", "st", "svlen", "chrom", "island")
    kept = by_island(rows, ("chrom",), lambda: CloseCalls(near, low, high), calls.select("id").schema, ("st", "svlen", "id"))
    return calls.join(kept, "id", "left_semi")
