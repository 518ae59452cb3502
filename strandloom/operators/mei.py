"""Mobile elements in tandem arrays: periodic groups by DBSCAN, main annotations and their overlaps."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType


def dbscan(points: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Cluster of each point, -1 for noise; clusters in order of their first core point.

    Points are sorted by their first coordinate, so that only neighbours within eps of it are compared.
    """
    n = len(points)
    order = np.argsort(points[:, 0], kind="stable")
    x = points[order]
    lo, hi = np.searchsorted(x[:, 0], x[:, 0] - eps, "left"), np.searchsorted(x[:, 0], x[:, 0] + eps, "right")
    near = [np.arange(a, b)[((x[a:b] - x[i]) ** 2).sum(axis=1) <= eps * eps] for i, (a, b) in enumerate(zip(lo, hi))]
    core = np.array([len(k) >= least for k in near], bool)
    label, found = np.full(n, -1), 0
    for i in np.argsort(order, kind="stable"):
        if not core[i] or label[i] >= 0:
            continue
        stack, label[i] = [i], found
        while stack:
            for j in near[stack.pop()]:
                if label[j] < 0:
                    label[j] = found
                    if core[j]:
                        stack.append(j)
        found += 1
    out = np.empty(n, int)
    out[order] = label
    return out


#: Groups up to this size compare all their points at once.
DENSE = 256


def dense_dbscan(points: np.ndarray, eps: float, least: int) -> np.ndarray:
    """The same labels as `dbscan`, by a matrix of neighbours: core points take the first core point of their cluster, others
    the first of those near them."""
    n = len(points)
    near = (points[:, None, 0] - points[None, :, 0]) ** 2 + (points[:, None, 1] - points[None, :, 1]) ** 2 <= eps * eps
    core = near.sum(axis=1) >= least
    linked = near & core
    first = np.where(core, np.arange(n), n)
    while True:
        low = np.where(linked, first, n).min(axis=1)
        low = np.where(core, np.minimum(low, first), n)
        if (low == first).all():
            break
        first = low
    label = np.where(linked, first, n).min(axis=1)
    ids = np.unique(label[label < n])
    return np.where(label < n, np.searchsorted(ids, label), -1)


def element_gaps(elements: DataFrame) -> DataFrame:
    """Gap of each element from the end of the one before it, by sample and type."""
    by = Window.partitionBy("sample", "type").orderBy("st", "ed")
    return elements.withColumn("gap", F.col("st") - F.lag("st").over(by) - F.lag("length").over(by))


def mei_arrays(elements: DataFrame, eps: float = 0.5, least: int = 3) -> DataFrame:
    """Per sample and type with at least `least` elements (st, ed, length): the largest cluster in standardised length and
    gap, and whether it is periodic: lengths vary by at most 20 %, and gaps don't vary by more than 15 bases and 20 %.

    The gap list, one shorter than the elements, is padded with its mean. A group is one sample's elements of a type in a
    region, a few dozen rows; groups pass sorted through Arrow batches, many in one, and only the open one is carried on.
    """
    sd = lambda v: float(v.std(ddof=1)) if len(v) > 1 else 0.0
    cv = lambda v: sd(v) / abs(float(v.mean())) if len(v) and v.mean() else 0.0
    mean = lambda v: float(v.mean()) if len(v) else None

    def judged(st: np.ndarray, length: np.ndarray) -> tuple:
        gap = st[1:] - st[:-1] - length[:-1]
        gap = np.append(gap, gap.mean())
        both = np.column_stack([length, gap])
        spread = both.std(axis=0)
        label = (dense_dbscan if len(both) <= DENSE else dbscan)((both - both.mean(axis=0)) / np.where(spread == 0, 1, spread), eps, least)
        m = label == np.bincount(label[label >= 0]).argmax() if (label >= 0).any() else np.zeros(len(label), bool)
        l, g = length[m], gap[m]
        periodic = bool(m.any()) and cv(l) <= 0.2 and not (sd(g) > 15 and cv(g) > 0.2)
        return len(st), int(m.sum()), mean(l), mean(g), cv(l), sd(g), periodic

    rows = elements.select("sample", "type", "st", "ed", "length").repartition("sample", "type").sortWithinPartitions("sample", "type", "st", "ed", "length")
    numbers = [("n", LongType()), ("n_cluster", LongType()), *((c, DoubleType()) for c in ("mean_length", "mean_gap", "length_cv", "gap_sd")), ("periodic", BooleanType())]
    schema = StructType([*(StructField(c, rows.schema[c].dataType) for c in ("sample", "type")), *(StructField(*x) for x in numbers)])
    arrow, rows_schema = to_arrow_schema(schema), rows.schema

    def groups(table: pa.Table) -> list[int]:
        """Where groups begin in sorted rows."""
        begins = np.zeros(max(len(table) - 1, 0), bool)
        for c in ("sample", "type"):
            x, y = table[c][1:], table[c][:-1]
            begins |= pc.coalesce(pc.not_equal(x, y), pc.xor(pc.is_null(x), pc.is_null(y))).to_numpy()
        return [0, *(np.flatnonzero(begins) + 1).tolist()] if len(table) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = to_arrow_schema(rows_schema).empty_table()
        for b in itertools.chain(batches, (None,)):
            table = open_ if b is None else pa.concat_tables([open_, pa.Table.from_batches([b]).cast(open_.schema)])
            starts = groups(table)
            ends = starts[1:] + ([len(table)] if b is None else [])
            st, length = (table[c].to_numpy().astype(float) for c in ("st", "length"))
            full = [(a, z) for a, z in zip(starts, ends) if z - a >= least]
            out = list(zip(*(judged(st[a:z], length[a:z]) for a, z in full))) or [()] * 7
            named = table.select(["sample", "type"]).take(pa.array([a for a, _ in full], pa.int64()))
            yield from pa.Table.from_arrays([*named.columns, *(pa.array(v, f.type) for v, f in zip(out, list(arrow)[2:]))], schema=arrow).combine_chunks().to_batches()
            open_ = table.slice(starts[-1]).combine_chunks() if starts else table

    return rows.mapInArrow(run, schema)


def most_frequent(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """For each key the commonest value; of equals the one seen first by `order`."""
    per = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    return per.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "_first"))).filter("_k = 1").select(key, value, "n")
