"""Mixing sources to target weights by the cube method.

Each source gets a target: weights share the budget, no source more than `most` times its size, the excess shared anew by
weight. A document of a source is then wanted target / size times on average: the whole part is taken outright and the
rest is an inclusion probability. The cube method moves these probabilities through the null space of the balancing
constraints (words and documents of the source) until all but a few are 0 or 1; the few meet again at the next level, and
at the end a small landing problem per source picks the rounding nearest to the balance.

Scale: a source, however large, is split into blocks of about `block` rows by a hash of the row, so that no task holds a
source; a block leaves at most two undecided rows, which form the next level's blocks. Only sizes travel, never texts.
Randomness comes from hashes of ids, and rows are ordered by their values, so reruns and other partitionings agree.

Defined results: null text has size 0; null source is a source, ordered last; repeated rows are units of their own;
a source whose size is 0 has target 0 and takes nothing; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import WORD, numbered, pick, scratch, stored

_EPS = 1e-9


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`(doc_id, source, size)`: size counts the words of the whole text."""
    src = pick(docs, **{"doc_id": id_col, "text": text_col, "source": source_col})
    return src.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """`(source, source_size, n_docs, target)`. The windows run over one row per source.

    Sources fill by weight up to a common level; in order of cap over weight, those before the level are capped.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    everything = Window.partitionBy()
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), turn)).withColumn("cap", most * F.col("source_size"))
    per = per.withColumn("budget", share * F.sum("source_size").over(everything)).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("cap").over(by_level), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0))
    per = per.withColumn("level", (F.col("budget") - before) / open_weight)
    per = per.withColumn("capped", F.col("full_at") <= F.col("level"))
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    return per.select("source", "source_size", "n_docs", F.when(F.col("capped"), F.col("cap")).otherwise(rest * F.col("weight") / weight).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Moves probabilities until at most two lie between 0 and 1; the sums of p and of p * size stay.

    Three rows have a direction that changes neither sum: the cross product of (1, 1, 1) and their sizes. u: a number in
    [0, 1) for each row that decides which way, in proportion, so that each row's expectation stays.
    """
    p = p.copy()
    hand: list[int] = []
    for i in range(len(p)):
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = round(p[i])
            continue
        hand.append(i)
        while len(hand) == 3:
            a, b, c = (float(size[k]) for k in hand)
            way = [c - b, a - c, b - a]
            if not any(way):
                way = [1.0, -1.0, 0.0]
            up = min((1 - p[k]) / w if w > 0 else p[k] / -w for k, w in zip(hand, way) if w)
            down = min(p[k] / w if w > 0 else (1 - p[k]) / -w for k, w in zip(hand, way) if w)
            step = up if u[hand[-1]] * (up + down) < down else -down
            for k, w in zip(hand, way):
                p[k] = min(1.0, max(0.0, p[k] + step * w))
            hand = [k for k in hand if _EPS < p[k] < 1 - _EPS]
    return np.where(p < _EPS, 0.0, np.where(p > 1 - _EPS, 1.0, p))


def landing(p: np.ndarray, size: np.ndarray, movable: np.ndarray, trades: int = 8) -> np.ndarray:
    """The rounding of the few open probabilities nearest to their sums of words, then of documents.

    What words that leaves over or missing is then traded away: up to `trades` times the movable row whose change brings
    the sum nearest. That matters where a source is one block and one of its open rows is large.
    """
    open_rows = np.flatnonzero((p > 0) & (p < 1))
    out = p.copy()
    if len(open_rows):
        q, s = p[open_rows], size[open_rows].astype(float)
        best = min(product((0.0, 1.0), repeat=len(q)), key=lambda z: (abs(float((np.array(z) - q) @ s)), abs(sum(z) - q.sum()), z))
        out[open_rows] = best
        off = float((out[open_rows] - q) @ s)
        for _ in range(trades):
            after = np.where(movable, np.abs(off + np.where(out > 0, -size, size)), np.inf)
            k = int(np.argmin(after))
            if not after[k] < abs(off) * 0.99:
                break
            off += -size[k] if out[k] > 0 else size[k]
            out[k] = 1 - out[k]
    return out


def _level(rows: DataFrame, last: bool) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["toss", "doc_id", "size"], kind="stable", na_position="last")
        size = pdf["size"].to_numpy()
        before = pdf["p"].to_numpy(float)
        p = flight(before, size, (pdf["toss"].to_numpy() & 0xFFFFFFFF) / 2.0**32)
        return pdf.assign(p=landing(p, size, (before > _EPS) & (before < 1 - _EPS)) if last else p)

    return rows.groupBy("source", "block").applyInPandas(run, rows.schema)


def _block(n: Column, block: int, salt: int) -> Column:
    return F.pmod(F.xxhash64("toss", F.lit(salt)), F.greatest(F.lit(1), F.ceil(n / block)).cast("long")).cast("long")


def mix(sizes: DataFrame, goal: DataFrame, block: int = 5000, seed: int = 11) -> DataFrame:
    """`(doc_id, source, size, source_size, target, times)`: how often each row of `sized` is taken."""
    fields = ["doc_id", "source", "size", "source_size", "target", "n_docs", "whole", "p", "toss"]
    goal = goal.select(F.col("source").alias("_source"), "source_size", "target", "n_docs")
    rows = sizes.select("doc_id", "source", "size").join(goal, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(wanted + _EPS)).withColumn("p", F.greatest(F.lit(0.0), wanted - F.col("whole")))
    rows = rows.withColumn("toss", F.xxhash64("doc_id", "size", "source", F.lit(seed))).select(*fields)
    rows = rows.withColumn("block", _block(F.col("n_docs"), block, 0))
    done = None
    n, level = rows.agg(F.max("n_docs")).first()[0] or 0, 0
    while True:
        last = n <= block
        out = stored(_level(rows, last), f"mix{level}")
        settled = out if last else out.filter((F.col("p") == 0) | (F.col("p") == 1))
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        level += 1
        left = out.filter((F.col("p") > 0) & (F.col("p") < 1))
        n = 2 * (n // block + 1)
        rows = left.withColumn("n_docs", F.ceil(F.col("n_docs") / block) * 2).withColumn("block", _block(F.col("n_docs"), block, level))
    return done.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("p")).cast("int").alias("times"))


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` with each row as often as the mix takes it, columns as they were, whatever their names. Rows equal in id and
    text pool their share."""
    at = {c: f"_c{docs.columns.index(c)}" for c in (id_col, text_col, source_col)}
    row = numbered(docs).withColumn("_key", F.xxhash64(at[id_col], at[text_col]))
    with scratch(docs.sparkSession):
        sizes = stored(sized(row, "_key", at[text_col], at[source_col]), "sizes")
        times = mix(sizes, stored(targets(sizes), "targets")).groupBy(F.col("doc_id").alias("_key")).agg(F.sum("times").cast("int").alias("_times"))
        times = stored(times.filter("_times > 0"), "times")
    return row.join(times, "_key").dropDuplicates(["_key"]).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).drop("_key", "_times", "_copy").toDF(*docs.columns)
