"""Functions on CIGARs: arrays of `struct<op: string, len: int>`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequence import _col

OPS = "MIDNSHP=X"
ON_REFERENCE, ON_QUERY = ["M", "D", "N", "=", "X"], ["M", "I", "S", "=", "X"]


def parse(text: Column | str) -> Column:
    """Array of operations; `*` and null have none."""
    t = F.coalesce(_col(text), F.lit(""))
    both = F.arrays_zip(F.regexp_extract_all(t, F.lit(rf"(\d+)([{OPS}])"), F.lit(2)).alias("op"), F.regexp_extract_all(t, F.lit(rf"(\d+)([{OPS}])"), F.lit(1)).alias("len"))
    return F.transform(both, lambda x: F.struct(x["op"].alias("op"), x["len"].cast("int").alias("len")))


def total(cigar: Column | str, ops: list[str]) -> Column:
    """Sum of the lengths of the given operations."""
    return F.aggregate(F.filter(_col(cigar), lambda x: x["op"].isin(ops)), F.lit(0), lambda a, x: a + x["len"])


def reference_length(cigar: Column | str) -> Column:
    return total(cigar, ON_REFERENCE)


def query_length(cigar: Column | str) -> Column:
    return total(cigar, ON_QUERY)


def clip_left(cigar: Column | str) -> Column:
    c = _col(cigar)
    first = F.get(c, F.lit(0))
    return F.when(first["op"].isin("S", "H"), first["len"]).otherwise(0)


def clip_right(cigar: Column | str) -> Column:
    c = _col(cigar)
    last = F.get(c, F.size(c) - 1)
    return F.when((F.size(c) > 1) & last["op"].isin("S", "H"), last["len"]).otherwise(0)


def indel_bases(cigar: Column | str) -> Column:
    return total(cigar, ["I", "D"])


def edits(cigar: Column | str, nm: Column | str) -> Column:
    """The larger of the inserted and deleted bases and the NM tag."""
    return F.greatest(indel_bases(cigar), F.coalesce(_col(nm), F.lit(0)))


#: Operations that are numbered together.
PIECE = 256


def with_offsets(cigar: Column | str, start: Column | str) -> Column:
    """Array of `struct<op, len, ref, query>`: where each operation begins on the reference and in the read.

    Within each row, so that no shuffle is needed for running sums: sums of pieces of PIECE operations first, then places
    within each piece, as a growing array is copied at each step.
    """
    ref_len = lambda x: F.when(x["op"].isin(ON_REFERENCE), x["len"]).otherwise(0)
    query_len = lambda x: F.when(x["op"].isin(ON_QUERY), x["len"]).otherwise(0)

    def step(acc: Column, x: Column) -> Column:
        row = F.struct(x["op"].alias("op"), x["len"].alias("len"), acc["ref"].alias("ref"), acc["query"].alias("query"))
        return F.struct(F.array_append(acc["rows"], row).alias("rows"), (acc["ref"] + ref_len(x)).alias("ref"), (acc["query"] + query_len(x)).alias("query"))

    def numbered(piece: Column) -> Column:
        zero = F.struct(F.array().cast("array<struct<op: string, len: int, ref: int, query: int>>").alias("rows"), piece["ref"].alias("ref"), piece["query"].alias("query"))
        return F.aggregate(piece["ops"], zero, step)["rows"]

    def passed(acc: Column, x: Column) -> Column:
        piece = F.struct(x.alias("ops"), acc["ref"].alias("ref"), acc["query"].alias("query"))
        sums = [F.aggregate(x, acc[c], lambda a, y: a + f(y)).alias(c) for c, f in (("ref", ref_len), ("query", query_len))]
        return F.struct(F.array_append(acc["pieces"], piece).alias("pieces"), *sums)

    ops = F.transform(_col(cigar), lambda x: F.struct(x["op"].alias("op"), x["len"].cast("int").alias("len")))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(ops), F.lit(1)) - 1) / PIECE).cast("int")), lambda k: F.slice(ops, k * PIECE + 1, PIECE))
    kind = "array<struct<ops: array<struct<op: string, len: int>>, ref: int, query: int>>"
    zero = F.struct(F.array().cast(kind).alias("pieces"), _col(start).cast("int").alias("ref"), F.lit(0).alias("query"))
    return F.when(_col(cigar).isNotNull(), F.flatten(F.transform(F.aggregate(cut, zero, passed)["pieces"], numbered)))


def exploded(reads: DataFrame, cigar: str = "cigar", pos: str = "pos") -> DataFrame:
    """`reads` with a row for each operation: columns k, op, len, ref, query."""
    rows = reads.withColumn("_o", with_offsets(cigar, pos))
    return rows.select(*reads.columns, F.posexplode("_o").alias("k", "_x")).select(*reads.columns, "k", "_x.*")


def query_to_ref(cigar: Column | str, start: Column | str, query: Column | str) -> Column:
    """`struct<ref, op, len>` for a place in the read: the operation there; ref 0 and op null past the end."""
    q = _col(query)
    at = F.get(F.filter(with_offsets(cigar, start), lambda x: x["op"].isin(ON_QUERY) & (x["query"] <= q) & (q < x["query"] + x["len"])), F.lit(0))
    moved = F.when(at["op"].isin("M", "=", "X"), at["ref"] + q - at["query"]).otherwise(at["ref"])
    return F.struct(F.coalesce(moved, F.lit(0)).alias("ref"), at["op"].alias("op"), F.when(at["op"] == "I", at["len"]).otherwise(0).alias("len"))


def explode_sa(reads: DataFrame) -> DataFrame:
    """A row for each alignment of a read: its own and those of the SA tag, by where they begin in the read.

    Adds: part, a_chrom, a_pos (0-based), a_strand, a_cigar, a_mapq, read_st, read_ed. A reverse alignment's place in
    the read is counted from its other end. SA positions are 1-based in the tag.
    """
    strand = F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+")
    entries = F.transform(F.filter(F.split(F.coalesce("sa", F.lit("")), ";"), lambda x: x != ""), lambda x: F.split(x, ","))
    other = F.transform(entries, lambda x: F.struct(x[0].alias("chrom"), (x[1].cast("int") - 1).alias("pos"), x[2].alias("strand"), parse(x[3]).alias("cigar"), x[4].cast("int").alias("mapq")))
    own = F.struct(F.col("chrom"), F.col("pos").cast("int").alias("pos"), strand.alias("strand"), F.col("cigar"), F.col("mapq").cast("int").alias("mapq"))
    rows = reads.withColumn("_a", F.explode(F.concat(F.array(own), other)))
    length = F.aggregate(F.filter(F.col("_a.cigar"), lambda x: x["op"].isin(*ON_QUERY, "H")), F.lit(0), lambda a, x: a + x["len"])
    left, right = clip_left(F.col("_a.cigar")), clip_right(F.col("_a.cigar"))
    forward = F.col("_a.strand") == "+"
    rows = rows.withColumn("read_st", F.when(forward, left).otherwise(right)).withColumn("read_ed", length - F.when(forward, right).otherwise(left))
    out = rows.select(*reads.columns, *(F.col(f"_a.{c}").alias(f"a_{c}") for c in ("chrom", "pos", "strand", "cigar", "mapq")), "read_st", "read_ed")
    return out.withColumn("part", F.row_number().over(Window.partitionBy("read_name", "chrom", "pos", "flag").orderBy("read_st", "read_ed", "a_chrom", "a_pos")))
