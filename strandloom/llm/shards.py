"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `points` places on a ring of 64-bit hashes. A text's hash is its place, so equal texts share one; it belongs
to the next point clockwise. The stretch before a point is an arc, and all texts of an arc would pass the same shards in the
same order. So loads are settled by arc: in step k each arc offers what it has left to the shard k points on, which takes
arcs in ring order until it is full; the rest goes on clockwise. That needs one sum for each arc, `shards * points` numbers
however large the table. No shard takes more than `1 + slack` times the mean, so none has less than `1 - slack * (shards - 1)`
times the mean, to within a text or a piece at each cut. An arc that a full shard cut in two (at most one for each shard that
fills) has its texts in order of their hashes, by running sums; all others go whole.

A group of equal texts stays together but where a shard is full. A group of more than 1 / PIECE of a shard's mean is cut by
hashes of doc_id into pieces of about that size, at most `2 * shards * PIECE` in all, so that it can go on clockwise in parts
and no task gets all of it.

When a shard is added, texts move to it, and those move on that had overflowed or overflow now; see `tests/llm`.

Defined results: null text is empty and has a size; null ids are placed like others; rows equal in id and text stay
together; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import numbered, pick, stored

#: A larger share of a shard's mean is no whole piece; rows numbered together.
PIECE, CELL = 128, 10_000
#: What a row takes besides its text, in bytes.
ROW_BYTES = 16


def ring(shards: int, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all points, ascending, and the shard of each. A shard's places don't depend on the number of shards."""
    at = np.array([xxhash.xxh3_64_intdigest(f"{s}/{k}") for s in range(shards) for k in range(points)], np.uint64).view(np.int64)
    by = np.argsort(at, kind="stable")
    return at[by], (by // points).astype(np.int32)


def walk(amount: np.ndarray, owner: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where the bytes of each arc go, as intervals: arc, first byte of the arc, shard, by arc and byte.

    owner: shard of each arc's point; room: bytes that each shard takes, in all at least those of the arcs.
    """
    left, room, arcs, firsts, shards = amount.copy(), room.copy(), [], [], []
    live, step = np.flatnonzero(amount), 0
    while len(live):
        to = owner[(live + step) % len(owner)]
        by = np.argsort(to, kind="stable")
        arc, to = live[by], to[by]
        want = left[arc]
        upto = np.cumsum(want)
        head = np.append(True, to[1:] != to[:-1])
        before = upto - want - np.maximum.accumulate(np.where(head, upto - want, 0))
        got = np.clip(room[to] - before, 0, want)
        some = got > 0
        arcs.append(arc[some])
        firsts.append((amount - left)[arc[some]])
        shards.append(to[some])
        left[arc] -= got
        np.subtract.at(room, to, got)
        live, step = live[left[live] > 0], step + 1
    arc, first, shard = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (arcs, firsts, shards))
    by = np.lexsort((first, arc))
    return arc[by], first[by], shard[by]


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, size, text_crc32, h)`: bytes of each row, checksum and hash of its text."""
    src = pick(docs, **{"doc_id": id_col, "text": text_col})
    return src.select("doc_id", *_measures(F.col("text")))


def _measures(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [(F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h")]


def place(rows: DataFrame, shards: int = 40, points: int = 1024, slack: float = 0.002) -> DataFrame:
    """`rows` with `home`, the shard whose point comes next on the ring, and `shard`, the one that takes the row.

    rows: doc_id, size, h and any others; read several times, so preferably a stored table.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum("size")).first()[0] or 0
    most = max(1, total // (shards * PIECE))
    groups = stored(rows.groupBy("h").agg(F.sum("size").alias("bytes")), "groups")
    hot = F.broadcast(stored(groups.filter(F.col("bytes") > most).select("h", F.ceil(F.col("bytes") / most).cast("int").alias("_pieces")), "hot"))
    rows = rows.join(hot, "h", "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("_pieces")), F.lit(0)).cast("int"))
    cut = rows.filter("_pieces is not null").groupBy("h", "_piece").agg(F.sum("size").alias("bytes"))
    whole = groups.join(hot, "h", "left_anti").select("h", F.lit(0).alias("_piece"), "bytes")

    places, owner = ring(shards, points)
    sent = spark.sparkContext.broadcast(places)

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sent.value, h.to_numpy(np.int64)) % len(sent.value))

    items = stored(whole.unionByName(cut).withColumn("arc", arc_of("h")), "items")
    sums = items.groupBy("arc").agg(F.sum("bytes").alias("bytes")).toPandas()  # shards * points rows at most
    amount = np.zeros(len(places), np.int64)
    amount[sums["arc"].to_numpy(np.int64)] = sums["bytes"].to_numpy(np.int64)
    room = np.full(shards, int(np.ceil(total / shards * (1 + slack))), np.int64)
    arc, first, shard = walk(amount, owner, room)
    head = np.searchsorted(arc, np.arange(len(places) + 1))
    told = spark.sparkContext.broadcast((owner, head, first, shard))

    @F.pandas_udf("int")
    def home_of(a: pd.Series) -> pd.Series:
        return pd.Series(told.value[0][a.to_numpy(np.int64)])

    @F.pandas_udf("int")
    def shard_of(a: pd.Series, at: pd.Series) -> pd.Series:
        """Of the byte `at` of arc a; -1 where `at` is negative and the arc is cut."""
        _, head, first, shard = told.value
        a, at = a.to_numpy(np.int64), at.to_numpy(np.int64)
        out = shard[head[a]].astype(np.int32)
        several = head[a + 1] - head[a] > 1
        out[several & (at < 0)] = -1
        for k in np.flatnonzero(several & (at >= 0)):
            lo, hi = head[a[k]], head[a[k] + 1]
            out[k] = shard[lo + np.searchsorted(first[lo:hi], at[k], side="right") - 1]
        return pd.Series(out)

    in_cut = items.withColumn("shard", shard_of("arc", F.lit(-1).cast("long"))).filter("shard < 0")
    upto = F.sum("bytes").over(Window.partitionBy("arc").orderBy("h", "_piece").rowsBetween(Window.unboundedPreceding, 0))
    middle = in_cut.withColumn("at", (upto - F.ceil(F.col("bytes") / 2)).cast("long"))
    settled = middle.select("h", "_piece", shard_of("arc", "at").alias("_settled"))
    known = stored(settled, "settled")
    rows = rows.withColumn("_arc", arc_of("h")).withColumn("home", home_of("_arc")).withColumn("shard", shard_of("_arc", F.lit(-1).cast("long")))
    part = rows.filter("shard < 0").join(known, ["h", "_piece"]).withColumn("shard", F.col("_settled")).drop("_settled")
    return rows.filter("shard >= 0").unionByName(part).drop("_piece", "_pieces", "_arc")


def numbered_slots(rows: DataFrame, n: int, shards: int = 40, cell: int = CELL) -> DataFrame:
    """`rows` (doc_id, h, shard), n of them, with `slot`: 0, 1 and so on in each shard. Rows are numbered in cells of a shard, by hashes."""
    cells = max(1, n // (shards * cell))
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "h"), F.lit(cells)))
    counts = rows.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_cell")) - F.col("_n")  # a row for each cell
    starts = counts.select("shard", "_cell", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("doc_id", "h")) - 1
    return rows.withColumn("_in", inside).join(starts, ["shard", "_cell"]).withColumn("slot", F.col("_before") + F.col("_in")).drop("_cell", "_before", "_in")


def assign(docs: DataFrame, shards: int = 40, points: int = 1024, slack: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, size, text_crc32, h, home, shard, slot)` of every row."""
    rows = stored(sized(docs, id_col, text_col), "sizes")
    placed = stored(place(rows, shards, points, slack), "placed")
    return numbered_slots(placed, rows.count(), shards)


def write(docs: DataFrame, path: str, shards: int = 40, points: int = 1024, slack: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The rows of `docs`, all columns, as Parquet below `path`, a folder `shard=k` for each shard. Copies of a name keep the first."""
    ids, text = docs.columns.index(id_col), docs.columns.index(text_col)
    first = [k for k, name in enumerate(docs.columns) if name.lower() not in {x.lower() for x in docs.columns[:k]} | {"shard"}]
    flat = numbered(docs).withColumn("doc_id", F.col(f"_c{ids}")).select("*", *_measures(F.col(f"_c{text}")))
    placed = place(flat, shards, points, slack)
    placed.select(*[F.col(f"_c{k}").alias(docs.columns[k]) for k in first], "shard").write.partitionBy("shard").parquet(path)
