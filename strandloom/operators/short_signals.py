"""Combining short-read signals: each has two regions (st, ed and st2, ed2), a type, a side (BEGIN or END) and a score."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.folds import by_island
from strandloom.operators.intervals import overlap_join, with_island

FIELDS = ["chrom", "type", "side", "st", "ed", "chrom2", "st2", "ed2", "score", "reads", "id"]
ORDER = ("st", "ed", "st2", "ed2", "id")


def _meets(a: dict, b: dict) -> bool:
    return a["st"] <= b["ed"] and b["st"] <= a["ed"] and a["chrom2"] == b["chrom2"] and a["st2"] <= b["ed2"] and b["st2"] <= a["ed2"]


def _join(a: dict, b: dict) -> None:
    a["st"], a["ed"], a["st2"], a["ed2"] = min(a["st"], b["st"]), max(a["ed"], b["ed"]), min(a["st2"], b["st2"]), max(a["ed2"], b["ed2"])
    a["score"], a["reads"] = a["score"] + b["score"], a["reads"] + b["reads"]


class Sweep:
    """Each open record takes all later open ones that meet its growing regions. Rows come by start, so an anchor is done at
    the first row that starts behind its region, and rows are held from the anchor on until then.

    judge: from a record and its members what is kept of it (or None), and which members (by number) are open again.
    """

    def __init__(self, judge: Callable[[dict, list[dict]], tuple[dict | None, list[int]]] | None = None) -> None:
        self.judge = judge
        self.held: list[dict] = []  # all rows from the anchor on, and some before it
        self.taken: list[bool] = []
        self._open(0)

    def _open(self, first: int) -> None:
        """Row `first` of those held, if there is one, becomes the anchor; seen: rows that it has met."""
        self.anchor: dict | None = None
        if first < len(self.held):
            self.anchor, self.members, self.seen = dict(self.held[first]), [first], first + 1
            self.taken[first] = True
        else:
            self.held, self.taken = [], []

    def _close(self) -> Iterable[tuple]:
        """Settles the anchor and makes the next open row the anchor."""
        kept = self.anchor
        if self.judge:
            kept, back = self.judge(self.anchor, [self.held[k] for k in self.members])
            for k in back:
                self.taken[self.members[k]] = k == 0  # the anchor has had its turn
        first = self.members[0] + 1
        while first < len(self.held) and self.taken[first]:
            first += 1
        if first > 1000 and first > len(self.held) // 2:
            del self.held[:first], self.taken[:first]
            first = 0
        self._open(first)
        return (tuple(kept[c] for c in FIELDS),) if kept else ()

    def _meet(self) -> bool:
        """The anchor meets the rows that it hasn't seen; whether one of them starts behind it."""
        while self.seen < len(self.held):
            row = self.held[self.seen]
            if row["st"] > self.anchor["ed"]:
                return True
            if not self.taken[self.seen] and _meets(self.anchor, row):
                _join(self.anchor, row)
                self.members.append(self.seen)
                self.taken[self.seen] = True
            self.seen += 1
        return False

    def take(self, row: tuple) -> Iterable[tuple]:
        self.held.append(dict(zip(FIELDS, row)))
        self.taken.append(False)
        if not self.anchor:
            self._open(0)
        out: list[tuple] = []
        while self.anchor and self._meet():
            out += self._close()
        return out

    def end(self) -> Iterable[tuple]:
        out: list[tuple] = []
        while self.anchor:
            self._meet()
            out += self._close()
        return out


def likeliest(starts: list[int], spread: list[float], low: int, size: int, forward: bool) -> tuple[int, float]:
    """The place (the first of equals) where the probabilities that spread from each start, forwards or backwards, add up to
    most, and the sum."""
    p = np.zeros(size + len(spread) + 1)
    for s in starts:
        if forward:
            p[s - low : s - low + len(spread)] += spread
        else:
            n = min(len(spread), s - low + 1)
            p[s - low - n + 1 : s - low + 1] += spread[:n][::-1]
    k = int(np.argmax(p[:size]))
    return low + k, float(p[k])


def cuts(depth: float) -> dict[str, int]:
    """Score that a combination needs, and score and reads that a pair needs, by mean depth."""
    return {"combine": max(16, min(29, int(0.4 * depth))), "score": max(2, int(0.08 * depth)), "reads": max(3, int(0.1 * depth))}


def combine(signals: DataFrame, least_reads: int = 3, least_score: float = 16, longest: int = 5000, spread: list[float] | None = None, accept: float | None = None, reach: int | None = None, least: int = 2, half: int = 100) -> DataFrame:
    """Signals of one type and side whose regions overlap become one; kept with enough reads and score and short regions.

    With `spread` (where breakpoints lie, by distance from a signal's region) each combination becomes its likeliest
    breakpoints, `half` bases on both sides; signals farther than `reach` from these go back to the pool. A combination
    goes if neither sum reaches `accept` (twice the largest probability, by default) or its new score, twice the larger sum
    over `accept`, stays below `least`.
    """
    keys = ("chrom", "type", "side")
    rows = with_island(signals.select(*FIELDS), 0, keys, ("st", "ed", "id")).select(*FIELDS, "island")
    accept, reach = accept or 2 * max(spread or [0.5]), reach or len(spread or ())

    def fine(a: dict) -> bool:
        return a["reads"] >= least_reads and a["score"] > least_score and a["ed"] - a["st"] < longest and a["ed2"] - a["st2"] < longest

    def judge(a: dict, members: list[dict]) -> tuple[dict | None, list[int]]:
        if not fine(a):
            return None, []
        size = lambda st, ed: min(5000, ed - st + 2)
        one, p1 = likeliest([m["ed" if a["type"] == "INV_2" else "st"] for m in members], spread, a["st"], size(a["st"], a["ed"]), a["type"] != "INV_2")
        two, p2 = likeliest([m["st2" if a["type"] == "INV_1" else "ed2"] for m in members], spread, a["st2"], size(a["st2"], a["ed2"]), a["type"] == "INV_1")
        if max(p1, p2) < accept:
            return None, []
        near = [(one - reach <= m["st"] <= one, two <= m["ed2"] <= two + reach) for m in members]
        fits = [(x if a["side"] == "BEGIN" else y) if a["type"] == "INS" else x and y for x, y in near]
        back = [k for k, ok in enumerate(fits) if not ok]
        score = int(2 * max(p1, p2) / accept)
        if score < least:
            return None, back
        return a | {"st": one - half, "ed": one + half, "st2": two - half, "ed2": two + half, "score": float(score), "reads": sum(m["reads"] for m, ok in zip(members, fits) if ok)}, back

    out = by_island(rows, keys, lambda: Sweep(judge if spread else None), signals.select(*FIELDS).schema, ORDER)
    if spread:
        return out
    return out.filter((F.col("reads") >= least_reads) & (F.col("score") > least_score) & (F.col("ed") - F.col("st") < longest) & (F.col("ed2") - F.col("st2") < longest))


def pair_sides(combined: DataFrame, score: float = 0, reads: float = 0, others: float = 1.0) -> DataFrame:
    """A BEGIN record with the first END record of its type that both regions overlap becomes SOLID, scores added; records
    without a partner stay as they are. An END record that several could take goes to the first.

    score and reads: what a SOLID record needs; without a partner twice that; `others` times as much for types other than
    DEL. Regions may be of any length.
    """
    b = combined.filter("side = 'BEGIN'").select("chrom", "st", "ed", *(F.col(c).alias(f"b_{c}") for c in FIELDS))
    e = combined.filter("side = 'END'").select("chrom", "st", "ed", *(F.col(c).alias(f"e_{c}") for c in FIELDS))
    c = lambda s, n: F.col(f"{s}_{n}")
    near = overlap_join(b, e, 5000).select(*(c("b", n) for n in FIELDS), *(F.col(f"r_e_{n}").alias(f"e_{n}") for n in FIELDS))
    near = near.filter((c("b", "type") == c("e", "type")) & (c("b", "chrom2") == c("e", "chrom2")) & (c("b", "st2") <= c("e", "ed2")) & (c("e", "st2") <= c("b", "ed2")))
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("b_id").orderBy("e_st", "e_id"))).filter("k = 1")
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("e_id").orderBy("b_st", "b_id"))).filter("k = 1")
    solid = first.select(
        c("b", "chrom").alias("chrom"), c("b", "type").alias("type"), F.lit("SOLID").alias("side"), F.greatest("b_st", "e_st").alias("st"), F.least("b_ed", "e_ed").alias("ed"), c("b", "chrom2").alias("chrom2"),
        F.greatest("b_st2", "e_st2").alias("st2"), F.least("b_ed2", "e_ed2").alias("ed2"), (c("b", "score") + c("e", "score")).alias("score"), (c("b", "reads") + c("e", "reads")).alias("reads"), c("b", "id").alias("id"),
    )
    used = first.select(F.explode(F.array("b_id", "e_id")).alias("id"))
    out = solid.unionByName(combined.select(*FIELDS).join(used, "id", "left_anti").select(*FIELDS))
    times = F.when(F.col("side") == "SOLID", 1).otherwise(2) * F.when(F.col("type") == "DEL", 1.0).otherwise(others)
    return out.filter((F.col("score") >= score * times) & (F.col("reads") >= reads * times))


def union_duplicates(records: DataFrame) -> DataFrame:
    """Records of one type whose regions both overlap, as one, whatever their side."""
    keys = ("chrom", "type")
    rows = with_island(records.select(*FIELDS), 0, keys, ("st", "ed", "id")).select(*FIELDS, "island")
    return by_island(rows, keys, Sweep, records.select(*FIELDS).schema, ORDER)


def combine_inversions(records: DataFrame) -> DataFrame:
    """INV_1 and INV_2 records with both regions overlapping, closed transitively, as INV."""
    inv = records.filter(F.col("type").isin("INV_1", "INV_2")).withColumn("type", F.lit("INV"))
    return union_duplicates(inv)


def vntr_candidates(regions: DataFrame, half: int = 200) -> DataFrame:
    """A candidate window around each repeat found by the repeat index: chrom, pos, k."""
    return regions.select("chrom", F.greatest(F.lit(0), F.col("pos") - half).alias("st"), (F.col("pos") + half).alias("ed"), "k")
