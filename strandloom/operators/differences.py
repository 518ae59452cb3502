"""Differences between the contigs of a region: where they lie on the reference, what surrounds them, and their class.

An alignment `(region, contig, cigar)` leads from a contig (the read) to the region's reference, from base 0 on. Places are
looked up as of an operation: alignments and their points are sorted together, each alignment as one row before its points,
and a point takes the last operation that begins at or before it by binary search. Operations never leave their row; a task
holds the alignments of one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from strandloom.functions.sequence import shared_kmers
from strandloom.operators.contigs import insert_vntr_length
from strandloom.tables import by_size, kept

KEY = ["region", "contig"]


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], place: str, order: Sequence[str] = (), name: str = "found") -> DataFrame:
    """`left` with `name`: the last row of `right`, as a struct, with equal keys and a `place` up to left's; null if none."""
    row, old = F.struct(*[F.col(c) for c in right.columns if c not in keys]), F.struct(*[F.col(c) for c in left.columns if c not in keys])
    a = right.select(*keys, F.col(place).cast("long").alias("_at"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(order)], F.lit(0).alias("_kind"), row.alias("_right"), F.lit(None).cast(left.select(old.alias("x")).schema["x"].dataType).alias("_left"))
    b = left.select(*keys, F.col(place).cast("long").alias("_at"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"_{k}") for k, c in enumerate(order)], F.lit(1).alias("_kind"), F.lit(None).cast(a.schema["_right"].dataType).alias("_right"), old.alias("_left"))
    upto = Window.partitionBy(*keys).orderBy("_at", "_kind", *[f"_{k}" for k in range(len(order))]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn(name, F.last("_right", ignorenulls=True).over(upto)).filter("_kind = 1")
    return both.select(*[F.col(c) if c in keys else F.col(f"_left.{c}").alias(c) for c in left.columns], name)


def _packed() -> tuple[Column, Column]:
    """An alignment's operations as a text of one letter for each, `_ops`, and their lengths, `_lens`."""
    some = F.filter("cigar", lambda x: x["op"].isin("M", "=", "X", "I", "D") & (x["len"] > 0))
    return F.translate(F.array_join(F.transform(some, lambda x: x["op"]), ""), "=", "M").alias("_ops"), F.transform(some, lambda x: x["len"].cast("int")).alias("_lens")


def operations(alignments: DataFrame) -> DataFrame:
    """A row for each run of equal operations M (matches, also as =), X, I or D: `region, contig, k, op, len`, and where it
    begins among all bases of the alignment (i), on the reference (r) and in the contig (q). Made inside rows, of one
    alignment for each contig."""
    packed = alignments.filter("cigar is not null").select(*KEY, *_packed())
    kinds = packed.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = _Runs([x.encode() for x in b.column(2).to_pylist()], [b.column(3).flatten().to_numpy(zero_copy_only=False)])
            keys = [b.column(k).take(pa.array(runs.of)) for k in (0, 1)]
            numbers = {"k": np.arange(len(runs.op)) - runs.first[runs.of] + 1, "len": runs.len, "i": runs.i, "r": runs.r, "q": runs.q}
            op = pa.array(list(runs.op.tobytes().decode()), pa.string())
            yield pa.RecordBatch.from_arrays([*keys, op, *(pa.array(x, pa.int64()) for x in numbers.values())], names=[*KEY, "op", *numbers])

    return packed.mapInArrow(run, StructType([kinds["region"], kinds["contig"], StructField("op", StringType()), *(StructField(c, LongType()) for c in ("k", "len", "i", "r", "q"))]))


def _sides(sv: DataFrame) -> DataFrame:
    """`sv` with the contig that has the inserted bases, their span in it, and the other contig with its place."""
    ins = F.col("type") == "INS"
    pick = lambda a, b: F.when(ins, F.col(a)).otherwise(F.col(b))
    out = sv.withColumn("base_contig", pick("a_contig", "b_contig")).withColumn("base_pos", pick("a_pos", "b_pos")).withColumn("insert_contig", pick("b_contig", "a_contig")).withColumn("insert_st", pick("b_pos", "a_pos"))
    return out.withColumn("insert_ed", F.col("insert_st") + F.col("length"))


class _Runs:
    """Runs of equal operations of a batch's alignments, in order: `of` is the alignment's number, op one of M, X, I, D, and
    i, r, q where the run begins among all bases, on the reference and in the contig."""

    #: Places are below it, so that alignment and place make one number.
    FAR = 1 << 40

    def __init__(self, texts: list[bytes], lengths: list[np.ndarray]) -> None:
        n = np.array([len(x) for x in texts])
        op, size, of = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([np.zeros(0, np.int64), *lengths]).astype(np.int64), np.repeat(np.arange(len(texts)), n)
        new = np.ones(len(op), bool)
        new[1:] = (op[1:] != op[:-1]) | (of[1:] != of[:-1])
        at = np.flatnonzero(new)
        self.op, self.of = op[at], of[at]
        self.len = np.add.reduceat(size, at) if len(at) else size
        #: Where each alignment's runs begin, and end.
        self.first = np.searchsorted(self.of, np.arange(len(texts) + 1))
        self.i, self.r, self.q = self.before("MXID"), self.before("MXD"), self.before("MXI")

    def sums(self, ops: str, unit: np.ndarray | int | None = None) -> np.ndarray:
        """Sums up to each run, and behind the last, of lengths (or units) of the given operations."""
        x = np.where(np.isin(self.op, np.frombuffer(ops.encode(), np.uint8)), self.len if unit is None else unit, 0)
        return np.concatenate([[0], np.cumsum(x)])

    def before(self, ops: str, unit: int | None = None) -> np.ndarray:
        """Those sums inside each run's alignment."""
        s = self.sums(ops, unit)
        return s[:-1] - s[self.first[self.of]]

    def whole(self, ops: str, unit: int | None = None) -> np.ndarray:
        """Sums of whole alignments, by run."""
        s = self.sums(ops, unit)
        return s[self.first[self.of + 1]] - s[self.first[self.of]]

    def is_(self, op: str) -> np.ndarray:
        return self.op == ord(op)

    def last(self, of: np.ndarray, place: np.ndarray, begins: np.ndarray, only: np.ndarray) -> np.ndarray:
        """The last of the `only` runs of alignment `of` that begins up to `place`; -1 if none."""
        if not len(only):
            return np.full(len(of), -1)
        far = _Runs.FAR
        k = np.searchsorted(self.of[only] * far + begins[only], of * far + np.clip(place, -1, far - 1), side="right") - 1
        found = only[np.maximum(k, 0)]
        return np.where((k >= 0) & (self.of[found] == of) & (place >= 0), found, -1)


#: What `_Runs` gives for points: the numbers of their alignments, and places by column, to columns with their known ones.
_Answer = Callable[["_Runs", np.ndarray, dict[str, np.ndarray]], dict[str, tuple[np.ndarray, np.ndarray]]]


def _answered(places: Sequence[str], known: str, answers: Sequence[str], answer: _Answer) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows sorted so that an alignment (with `_ops` and `_lens`) comes before its points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, lengths = b"", np.zeros(0, np.int64)
        for b in batches:
            column = {n: b.column(k) for k, n in enumerate(b.schema.names)}
            own = np.asarray(column["_kind"]) == 0
            at = np.flatnonzero(own)
            texts, lists = column["_ops"].take(pa.array(at)).to_pylist(), column["_lens"].take(pa.array(at))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            runs = _Runs([text, *(x.encode() for x in texts)], [lengths, flat])
            if len(at):
                text, lengths = texts[-1].encode(), flat[ends[-2] :]
            of = np.cumsum(own)
            place = {n: column[n].fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for n in places}
            asked = ~own & np.asarray(column[known].to_numpy(zero_copy_only=False), bool)
            got = answer(runs, of[asked], {n: p[asked] for n, p in place.items()})
            for n in answers:
                value, ok = np.zeros(len(own), np.int64), np.zeros(len(own), bool)
                value[asked], ok[asked] = got[n]
                column[n] = pa.array(value, pa.int64(), mask=~ok)
            yield pa.RecordBatch.from_arrays(list(column.values()), names=list(column))

    return run


def _with_alignments(rows: DataFrame, alignments: DataFrame, contigs: dict[str, str], places: dict[str, str], columns: Sequence[str] | None = None) -> DataFrame:
    """Alignments, packed, and `rows` in one table that is dealt by region: `_row` has the rows' `columns` (all), `contigs` names the
    columns that become keys, with `_known` of each: whether there is an alignment; sorted for the last of them."""
    kinds = rows.schema
    row = F.struct(*[F.col(c) for c in columns or rows.columns])
    a = alignments.filter("cigar is not null").select("region", F.lit(0).alias("_kind"), *(F.col("contig").cast(kinds[c].dataType).alias(k) for k, c in contigs.items()), *(F.lit(None).cast("long").alias(k) for k in places), *_packed(), F.lit(None).cast(rows.select(row.alias("x")).schema["x"].dataType).alias("_row"))
    b = rows.select("region", F.lit(1).alias("_kind"), *(F.col(c).alias(k) for k, c in contigs.items()), *(F.col(c).cast("long").alias(k) for k, c in places.items()), F.lit(None).cast("string").alias("_ops"), F.lit(None).cast("array<int>").alias("_lens"), row.alias("_row"))
    both = by_size(a.unionByName(b), "region", of=rows)
    for k in contigs:
        upto = Window.partitionBy("region", k).orderBy("_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = both.withColumn(f"{k}_known", F.first("_kind").over(upto) == 0)
    return both.sortWithinPartitions("region", list(contigs)[-1], "_kind")


def _asked(both: DataFrame, places: Sequence[str], known: str, answers: Sequence[str], answer: _Answer) -> DataFrame:
    schema = StructType([*both.schema.fields, *(StructField(n, LongType()) for n in answers)])
    return both.mapInArrow(_answered(places, known, answers, answer), schema)


def _on_reference(places: dict[str, str]) -> _Answer:
    """For places in the contig: where they are on the reference (`<name>_ref`) and the length of the insertion that has
    them, 0 without (`<name>_len`)."""

    def answer(runs: _Runs, of: np.ndarray, place: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        out, only = {}, np.flatnonzero(~runs.is_("D"))
        for name, column in places.items():
            p = place[column]
            k = runs.last(of, p, runs.q, only)
            if not len(runs.op):
                out |= {f"{name}_{x}": (p, k >= 0) for x in ("ref", "len")}
                continue
            ok, ins = (k >= 0) & (p < runs.q[k] + runs.len[k]), runs.is_("I")[k]
            out[f"{name}_ref"] = np.where(ins, runs.r[k], runs.r[k] + p - runs.q[k]), ok
            out[f"{name}_len"] = np.where(ins, runs.len[k], 0), ok
        return out

    return answer


def reference_places(sv: DataFrame, alignments: DataFrame, reference: str | int = "ref") -> DataFrame:
    """Differences (region, a_contig, b_contig, a_pos, b_pos, type, length) with the base contig's place on the reference and
    those of the inserted bases' ends. `base_is_insert`: the base contig has an insertion there (`event` bases).

    A difference whose inserted bases are the reference's own keeps their place as its base. Places behind a contig's last
    aligned base, and all of a contig without alignment, are null. Both tables are dealt by region once, and sorted once for
    each of the two contigs.
    """
    ref, rows = F.lit(reference), _sides(sv)
    both = _with_alignments(rows, alignments, {"_c2": "insert_contig", "_c1": "base_contig"}, {"_p1": "base_pos", "_p2": "insert_st", "_p3": "insert_ed"}, sv.columns)
    both = _asked(both, ["_p1"], "_c1_known", ["_x_ref", "_x_len"], _on_reference({"_x": "_p1"}))
    found = _asked(both.sortWithinPartitions("region", "_c2", "_kind"), ["_p2", "_p3"], "_c2_known", ["_y_ref", "_z_ref"], _on_reference({"_y": "_p2", "_z": "_p3"}))
    out = _sides(found.filter("_kind = 1").select("_row.*", "_x_ref", "_x_len", "_y_ref", "_z_ref"))
    at = lambda contig, place, known: F.when(F.col(contig) == ref, F.col(place).cast("long")).otherwise(F.col(known))
    own = F.col("insert_contig") == ref
    base = F.when(own, F.col("insert_st").cast("long")).otherwise(at("base_contig", "base_pos", "_x_ref"))
    inserted = ~own & F.coalesce((F.col("_x_len") > 0) & ~F.coalesce(F.col("base_contig") == ref, F.lit(False)), F.lit(False))
    out = out.withColumn("base_ref", base).withColumn("base_is_insert", inserted).withColumn("event", F.when(inserted, F.col("_x_len")).otherwise(0))
    return out.withColumn("insert_ref", at("insert_contig", "insert_st", "_y_ref")).withColumn("insert_ref_end", at("insert_contig", "insert_ed", "_z_ref")).drop("_x_ref", "_x_len", "_y_ref", "_z_ref")


def flipped(cigar: str | Column) -> Column:
    """The alignment seen from the other side: insertions are deletions."""
    c = F.col(cigar) if isinstance(cigar, str) else cigar
    return F.transform(c, lambda x: F.struct(F.when(x["op"] == "I", "D").when(x["op"] == "D", "I").otherwise(x["op"]).alias("op"), x["len"].alias("len")))


def _around(clean: int) -> _Answer:
    """For places on the reference the counts between the nearest runs of more than `clean` matches on both sides."""

    def answer(runs: _Runs, of: np.ndarray, place: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        p, names = place["_p"], ("_lo", "_hi", "_gaps", "_x", "_m")
        o = runs.last(of, p, runs.r, np.arange(len(runs.op)))
        if not len(runs.op):
            return {n: (p, o >= 0) for n in names}
        n, match, ins = np.arange(len(runs.op)), runs.is_("M"), runs.is_("I")
        first, behind = np.r_[True, runs.of[1:] != runs.of[:-1]], np.r_[False, ins[:-1]]
        behind &= ~first  # right behind an insertion
        gaps, x, m = runs.before("ID", 1), runs.before("X"), runs.before("M")
        long = match & (runs.len > clean)
        left = np.r_[-1, np.maximum.accumulate(np.where(long, n, -1))[:-1]]
        left = np.where((left >= 0) & (runs.of[left] == runs.of), left, -1)
        right = np.r_[np.minimum.accumulate(np.where(long, n, len(n))[::-1])[::-1][1:], len(n)]
        right = np.where((right < len(n)) & (runs.of[np.minimum(right, len(n) - 1)] == runs.of), right, -1)
        start = np.stack([runs.r - ~behind, gaps, x, m])
        end = np.stack([runs.whole("MXD") - ~ins[runs.first[runs.of + 1] - 1], runs.whole("ID", 1), runs.whole("X"), runs.whole("M")])
        stop = np.stack([runs.r + runs.len, gaps, x, m + runs.len])
        at = np.where(runs.r[o] == p, np.where(behind, runs.i - np.r_[0, runs.len[:-1]], runs.i)[o], runs.i[o] + p - runs.r[o])
        ok = (o >= 0) & ((p < runs.r[o] + np.where(ins, 0, runs.len)[o]) | (ins[o] & (runs.r[o] == p)))
        inside, size = at - runs.i[o], runs.len[o]
        here = np.stack([p, gaps[o], x[o], m[o] + inside])
        lo = np.where(match[o] & (inside > clean), here, np.where(left[o] >= 0, stop[:, left[o]], 0))
        more = np.array([[0], [0], [0], [1]])
        hi = np.where(right[o] >= 0, start[:, right[o]], end[:, o])
        hi = np.where(match[o] & (inside >= 0) & (size - 1 - inside > clean), here + more, hi)
        hi = np.where(match[o] & (inside < 0) & (size > clean), start[:, o], hi)
        return {"_lo": (lo[0], ok), "_hi": (hi[0], ok)} | {c: (hi[k] - lo[k], ok) for k, c in enumerate(("_gaps", "_x", "_m"), 1)}

    return answer


def mismatch_regions(alignments: DataFrame, points: DataFrame, clean: int = 50, span: int = 100, rate: float = 0.1) -> DataFrame:
    """Around each point (region, contig, r: a place on the reference) the stretch between the nearest runs of more than
    `clean` matches on both sides: its first and last place, its gaps (each counts once), mismatches, matches and rate of
    differences, and `many`, whether it is longer than `span` and above `rate`. Points off the alignment have nulls.

    A point's own base belongs to neither side; before an insertion the point is the insertion's first base.
    """
    both = _with_alignments(points, alignments, {"_c": "contig"}, {"_p": "r"})
    got = _asked(both, ["_p"], "_c_known", ["_lo", "_hi", "_gaps", "_x", "_m"], _around(clean)).filter("_kind = 1")
    out = got.select("_row.*", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_gaps").alias("gaps"), F.col("_x").alias("mismatches"), F.col("_m").alias("matches"))
    out = out.withColumn("rate", F.coalesce(F.try_divide(F.col("gaps") + F.col("mismatches"), F.col("gaps") + F.col("mismatches") + F.col("matches")), F.when(F.col("lo").isNotNull(), 0.0)))
    return out.withColumn("many", (F.col("hi") - F.col("lo") > span) & (F.col("rate") > rate))


def outer_inserts(placed: DataFrame, to_reference: DataFrame) -> DataFrame:
    """Nested differences (`reference_places` with base_is_insert, with id) with `outer_ref`: where the contig that has the
    inserted bases has its own insertion against the reference that touches them (the last such; -1 if none).

    to_reference: region, contig, insert_st, insert_ed, ref of contigs' insertions against the reference.
    """
    own = to_reference.select("region", F.col("contig").alias("insert_contig"), F.col("insert_st").alias("_st"), F.col("insert_ed").alias("_ed"), F.col("ref").alias("_ref"))
    hit = placed.filter("base_is_insert").join(own, ["region", "insert_contig"]).filter((F.col("_st") <= F.col("insert_ed")) & (F.col("insert_st") <= F.col("_ed")))
    last = hit.groupBy("id").agg(F.max_by("_ref", "_st").alias("_last"))
    return placed.filter("base_is_insert").join(last, "id", "left").withColumn("outer_ref", F.coalesce("_last", F.lit(-1))).drop("_last")


def nested_report(placed: DataFrame, pairs: DataFrame, alignments: DataFrame, to_reference: DataFrame) -> DataFrame:
    """Each nested difference with the mismatch regions of its three alignments (struct; null where there is no outer
    insertion): `in_pair` around its base in the alignment of the two contigs, `in_base` around its base on the reference,
    `in_insert` around the outer insertion; `many` if one of the first two has many differences.

    pairs: region, a_contig, b_contig, cigar (from b to a).
    """
    rows = kept(outer_inserts(placed, to_reference), "nested")
    some = rows.filter("outer_ref > 0")
    pair = some.select("region", "a_contig", "b_contig", "type").distinct().join(pairs, ["region", "a_contig", "b_contig"])
    seen = pair.select("region", F.struct("a_contig", "b_contig", "type").alias("contig"), F.when(F.col("type") == "INS", F.col("cigar")).otherwise(flipped("cigar")).alias("cigar"))
    in_pair = mismatch_regions(seen, some.select("id", "region", F.struct("a_contig", "b_contig", "type").alias("contig"), F.col("base_pos").cast("long").alias("r")))
    # the two on the reference go with the same alignments, so these are dealt once
    point = lambda name, contig, r: F.struct(F.lit(name).alias("of"), F.col(contig).alias("contig"), F.col(r).cast("long").alias("r"))
    points = some.select("id", "region", F.explode(F.array(point("in_base", "base_contig", "base_ref"), point("in_insert", "insert_contig", "outer_ref"))).alias("x")).select("id", "region", "x.*")
    both = mismatch_regions(alignments, points)
    found = in_pair.withColumn("of", F.lit("in_pair")).select("id", "of", "lo", "hi", "rate", "many").unionByName(both.select("id", "of", "lo", "hi", "rate", "many"))
    names = ("in_pair", "in_base", "in_insert")
    per = found.groupBy("id").agg(*(F.first(F.when(F.col("of") == n, F.struct("lo", "hi", "rate", "many")), ignorenulls=True).alias(n) for n in names))
    out = rows.join(per, "id", "left")
    return out.withColumn("many", F.col("in_pair.many") | F.col("in_base.many"))


def with_vntr(rows: DataFrame, runs: DataFrame, place: str = "base_ref") -> DataFrame:
    """`rows` with the reference's run there: `in_vntr`, `run` (its number among its kind) and, outside VNTR, the distance and
    the span of the nearest VNTR (the earlier of two). runs: region, st, ed, vntr of `contigs.vntr_runs`, closed and without gaps."""
    by = Window.partitionBy("region").orderBy("st")
    kind = F.row_number().over(Window.partitionBy("region", "vntr").orderBy("st")) - 1
    side = lambda f: f(F.when(F.col("vntr"), F.struct("st", "ed"))).over(by)
    around = runs.select("region", F.col("st").alias(place), "st", "ed", "vntr", kind.alias("run"), side(F.lag).alias("before"), side(F.lead).alias("behind"))
    got = as_of(rows, around, ["region"], place, (), "_v")
    v, p = F.col("_v"), F.col(place)
    inside = v.isNotNull() & (p <= v["ed"])
    back, ahead = p - v["before"]["ed"], v["behind"]["st"] - p
    nearer = F.when(ahead.isNull() | (back <= ahead), v["before"]).otherwise(v["behind"])
    plain = inside & ~v["vntr"]
    got = got.withColumn("in_vntr", F.coalesce(inside & v["vntr"], F.lit(False))).withColumn("run", F.when(inside, v["run"]))
    return got.withColumn("vntr_distance", F.when(plain, F.least(back, ahead))).withColumn("near_vntr", F.when(plain, nearer)).drop("_v")


def inserted_masks(rows: DataFrame, rm: DataFrame, trf: DataFrame) -> DataFrame:
    """`(id, vntr, longest_free)` of each difference's inserted bases: `contigs.insert_vntr_length` with the annotation of the
    contig that has them, cut to them. rm: region, contig, st, ed, class; trf: region, contig, st, ed, motif_size; half-open."""
    spans = rows.select("region", F.col("insert_contig").alias("contig"), F.col("id").alias("name"), "insert_st", "insert_ed")

    def cut(annotation: DataFrame, *more: str) -> DataFrame:
        hit = annotation.join(spans, KEY).filter((F.col("st") < F.col("insert_ed")) & (F.col("insert_st") < F.col("ed")))
        return hit.select("name", (F.col("st") - F.col("insert_st")).alias("st"), (F.col("ed") - F.col("insert_st")).alias("ed"), *more)

    masks = insert_vntr_length(rows.select(F.col("id").alias("name"), "length"), cut(rm, "class"), cut(trf, "motif_size"))
    return masks.select(F.col("name").alias("id"), "vntr", "longest_free")


def difference_class(rows: DataFrame, share: float = 0.2, bases: int = 200, near: int = 30, kmers: int = 5, unit: int = 50, copies: float = 2.5) -> DataFrame:
    """Class of differences (in_vntr, length, vntr: bases under repeats, vntr_distance, insert_seq, near_seq, repeats:
    array<struct<unit, copies>> of tandem repeats over all of them).

    1: repeat in VNTR, 2: new bases in VNTR, 3: repeat outside VNTR, 4: new bases outside. New: more than `bases` bases, or
    more than `share` of them, not under repeats. Class 3 becomes 1 within `near` bases of a VNTR that shares `kmers`
    10-mers, else 4 if a repeat of units of at least `unit` bases in at most `copies` copies covers it.
    """
    free = F.col("length") - F.col("vntr")
    new = (free > bases) | (free > share * F.col("length"))
    plain = F.when(F.col("in_vntr") & ~new, 1).when(F.col("in_vntr"), 2).when(~new, 3).otherwise(4)
    like = (F.col("vntr_distance") > 0) & (F.col("vntr_distance") < near) & (shared_kmers("insert_seq", "near_seq", 10) >= kmers)
    doubled = F.exists("repeats", lambda x: (x["unit"] >= unit) & (x["copies"] <= copies))
    return rows.withColumn("class", F.when(plain != 3, plain).when(F.coalesce(like, F.lit(False)), 1).when(F.coalesce(doubled, F.lit(False)), 4).otherwise(3))


def classified(placed: DataFrame, runs: DataFrame, rm: DataFrame, trf: DataFrame, sequences: DataFrame, reference: str | int = "ref", share: float = 0.2, edge: int = 10, near_by: int = 30, letters: Callable[[Column], Column] = lambda x: x["seq"]) -> DataFrame:
    """Differences from `reference_places` (with id) to their classes, by the reference's runs and the contigs' annotation
    (rm: region, contig, st, ed, class; trf: region, contig, st, ed, unit, copies) and sequences (region, contig, seq).
    share: 0.2 for accurate contigs, 0.6 for those of reads with many errors. letters: a sequence's text from its row, where
    that has something shorter to make it from; it is made behind the joins, where a VNTR is less than `near_by` away.

    `placed` is read several times: it should be stored, and have no more columns than are wanted."""
    rows = with_vntr(placed, runs).join(inserted_masks(placed, rm, trf.select("region", "contig", "st", "ed", F.col("unit").alias("motif_size"))), "id", "left")
    over = trf.select("region", F.col("contig").alias("insert_contig"), (F.col("st") - edge).alias("_st"), (F.col("ed") + edge).alias("_ed"), "unit", "copies")
    hit = placed.select("id", "region", "insert_contig", "insert_st", "insert_ed").join(over, ["region", "insert_contig"]).filter((F.col("_st") <= F.col("insert_st")) & (F.col("_ed") >= F.col("insert_ed")))
    rows = rows.join(hit.groupBy("id").agg(F.collect_set(F.struct("unit", "copies")).alias("repeats")), "id", "left")
    inserted = sequences.select("region", F.col("contig").alias("insert_contig"), F.struct(*sequences.columns).alias("_s"))
    refs = sequences.filter(F.col("contig") == F.lit(reference)).select("region", F.struct(*sequences.columns).alias("_r"))
    rows = rows.join(inserted, ["region", "insert_contig"], "left").join(refs, "region", "left")
    compared = (F.col("vntr_distance") > 0) & (F.col("vntr_distance") < near_by)  # the others' letters don't count
    rows = rows.withColumn("_seq", F.when(compared & F.col("_s").isNotNull(), letters(F.col("_s")))).withColumn("_ref", F.when(compared & F.col("_r").isNotNull(), letters(F.col("_r"))))
    near = F.col("near_vntr")
    rows = rows.withColumn("insert_seq", F.substring("_seq", F.col("insert_st") + 1, F.col("length"))).withColumn("near_seq", F.substring("_ref", near["st"] + 1, near["ed"] - near["st"] + 1))
    return difference_class(rows, share, near=near_by).drop("_seq", "_ref", "_s", "_r")
