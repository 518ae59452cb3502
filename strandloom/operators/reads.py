"""Filters on reads, signals from their alignments, depth and support of variants. JVM expressions and bin joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.functions.sequence import base_count, counted_kmers, shared_windows
from strandloom.operators.intervals import STRETCH, div, gap_clusters, overlap_join, stretches
from strandloom.operators.order import cumulated, quantiles

PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, SECONDARY, DUPLICATE, SUPPLEMENTARY = 1, 4, 8, 16, 32, 256, 1024, 2048


def has(flag: int, column: str = "flag") -> Column:
    return F.col(column).bitwiseAND(flag) != 0


# Filters


def short_reads(reads: DataFrame) -> DataFrame:
    """Primary, not duplicate; mapped ones well, or with a well mapped mate (mate_mapq) close by."""
    close = (F.coalesce("mate_mapq", F.lit(0)) >= 20) & (F.col("mate_chrom") == F.col("chrom")) & (F.abs("isize") < 20_000)
    return reads.filter(~has(DUPLICATE | SECONDARY | SUPPLEMENTARY) & (has(UNMAPPED) | (F.col("mapq") >= 20) | close))


def long_reads(reads: DataFrame, least_mapq: int = 1, least_supplementary: int = 1200) -> DataFrame:
    """Not secondary, mapped; supplementary ones only if long."""
    return reads.filter(~has(SECONDARY) & (F.col("mapq") >= least_mapq) & (~has(SUPPLEMENTARY) | (cg.query_length("cigar") >= least_supplementary)))


def accurate_reads(reads: DataFrame, block: int = 1000, worst: float = 0.2, total: float = 0.04) -> DataFrame:
    """Reads (columns read_name, length, errors array<int>: places of errors in the read) without a full block of too many
    errors and with few in all. The tail short of a block isn't counted; reads without a full block pass."""
    full = div(F.col("length"), block)
    counted = F.filter("errors", lambda x: x < full * block)
    blocks = F.array_sort(F.transform(counted, lambda x: F.floor(x / block).cast("long")))
    zero = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def step(a: Column, b: Column) -> Column:
        n = F.when(a["b"] == b, a["n"] + 1).otherwise(1)
        return F.struct(b.alias("b"), n.alias("n"), F.greatest(a["most"], n).alias("most"))

    most = F.aggregate(blocks, zero, step)["most"]
    return reads.filter((full == 0) | ((most <= worst * block) & (F.size(counted) <= total * full * block)))


def translocation_reads(reads: DataFrame, least: int = 5000) -> DataFrame:
    """Reads of mates far away or on another chromosome, with their place and the mate's exchanged. A mate at the same
    coordinate drops out, on another chromosome too."""
    kept = reads.filter(~has(SECONDARY | SUPPLEMENTARY | DUPLICATE | UNMAPPED | MATE_UNMAPPED) & (F.col("pos") != F.col("mate_pos")) & ((F.col("isize") == 0) | (F.abs("isize") > least)))
    moved = {"chrom": F.col("mate_chrom"), "pos": F.col("mate_pos"), "mate_chrom": F.col("chrom"), "mate_pos": F.col("pos")}
    return kept.select(*(moved.get(c, F.col(c)).alias(c) for c in reads.columns))


def discordant(least: int, most: int) -> Column:
    """Both mapped, and another chromosome, the same strand, an insert size outside, or facing outwards."""
    outward = F.when(has(REVERSE), F.col("pos") < F.col("mate_pos")).otherwise(F.col("pos") > F.col("mate_pos"))
    size = F.abs("isize")
    return ~has(UNMAPPED | MATE_UNMAPPED) & ((F.col("chrom") != F.col("mate_chrom")) | (has(REVERSE) == has(MATE_REVERSE)) | (size <= least) | (size >= most) | outward)


def normal_depth_signals(signals: DataFrame, depth: DataFrame, most: float = 15, mean: float = 5) -> DataFrame:
    """Signals whose region (id) isn't far deeper than the average."""
    return signals.join(depth.filter((F.col("max_ratio") <= most) & (F.col("mean_ratio") <= mean)).select("id"), "id", "left_semi")


def core_mappings(mappings: DataFrame, length: int = 10_000, mapq: int = 15, chroms: int = 24) -> DataFrame:
    return mappings.filter((F.col("read_ed") - F.col("read_st") >= length) & (F.col("mapq") >= mapq) & (F.col("chrom_id") < chroms))


def region_signals(bed: DataFrame, support: int = 1000) -> DataFrame:
    """A forced signal for each region, also for those that cross a segment's edge."""
    return bed.select("chrom", F.col("st").alias("pos"), F.col("ed").alias("end"), F.lit("X").alias("type"), F.lit(support).alias("support"))


def good_quality_reads(reads: DataFrame, share: float = 0.8) -> DataFrame:
    """Reads whose summed quality is at least a share of their sample's mean."""
    total = reads.withColumn("_q", F.aggregate("qual", F.lit(0), lambda a, x: a + x))
    mean = total.groupBy("sample").agg(F.avg("_q").alias("_m"))  # one row for each sample
    return total.join(mean, "sample").filter(F.col("_q") >= share * F.col("_m")).select(*reads.columns)


def strong_signals(signals: DataFrame) -> DataFrame:
    """Solid signals need a score of 50 and 15 on each side; others 100."""
    total = F.col("score_b") + F.col("score_e")
    return signals.filter(F.when(F.col("solid"), (total >= 50) & (F.least("score_b", "score_e") >= 15)).otherwise(total >= 100))


# Signals


def long_read_signals(reads: DataFrame, least: int = 30, clip: int = 1000, clips: bool = True) -> DataFrame:
    """Insertions and deletions of at least `least` bases and long clips: read_name, chrom, pos, end, type, length."""
    ops = cg.exploded(reads)
    long = F.col("len") >= least
    kind = F.when((F.col("op") == "I") & long, "INS").when((F.col("op") == "D") & long, "DEL")
    if clips:
        kind = kind.when((F.col("op") == "S") & (F.col("len") > clip), F.when(F.col("k") == 0, "CLIP_LEFT").otherwise("CLIP_RIGHT"))
    end = F.when(F.col("op") == "D", F.col("ref") + F.col("len")).otherwise(F.col("ref"))
    return ops.withColumn("type", kind).filter("type is not null").select("read_name", "chrom", F.col("ref").alias("pos"), end.alias("end"), "type", F.col("len").alias("length"))


def small_signals(reads: DataFrame, span: int = 200, edits: int = 10, bases: int = 35) -> DataFrame:
    """Stretches of many edits. reads: read_name, chrom, edits array<struct<pos, len>> (long, int) in order. A queue holds the edits of
    the last `span` bases; when it holds more than `edits` edits or `bases` bases it is emitted and emptied."""
    empty = F.array().cast("array<struct<pos: bigint, len: int>>")

    def step(acc: Column, x: Column) -> Column:
        queue = F.concat(F.filter(acc["queue"], lambda y: x["pos"] - y["pos"] <= span), F.array(F.struct(x["pos"].cast("long").alias("pos"), x["len"].cast("int").alias("len"))))
        full = (F.size(queue) > edits) | (F.aggregate(queue, F.lit(0), lambda a, y: a + y["len"]) > bases)
        found = F.array(F.struct(queue[0]["pos"].alias("st"), x["pos"].cast("long").alias("ed")))
        return F.struct(F.when(full, empty).otherwise(queue).alias("queue"), F.when(full, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(empty.alias("queue"), F.array().cast("array<struct<st: bigint, ed: bigint>>").alias("out"))
    return reads.select("read_name", "chrom", F.explode(F.aggregate("edits", zero, step)["out"]).alias("s")).select("read_name", "chrom", "s.st", "s.ed")


def clip_signals(reads: DataFrame, pad: int = 10, least: int = 1) -> DataFrame:
    """Clips of short reads: right ones BEGIN a variant, left ones END one; score is the mapping quality, 15 at most."""
    end = F.col("pos") + cg.reference_length("cigar")
    both = F.array(F.struct(cg.clip_left("cigar").alias("n"), F.col("pos").alias("p"), F.lit("END").alias("side")), F.struct(cg.clip_right("cigar").alias("n"), end.alias("p"), F.lit("BEGIN").alias("side")))
    return reads.withColumn("c", F.explode(both)).filter(F.col("c.n") >= least).select("read_name", "chrom", (F.col("c.p") - pad).alias("st"), (F.col("c.p") + pad).alias("ed"), "c.side", F.least(F.lit(15), "mapq").alias("score"))


def mismatch_events(places: Column) -> Column:
    """Number of separate runs in an ascending array of mismatch places (equal or following places are one event)."""
    zero = F.struct(F.lit(-10).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(places, zero, lambda a, x: F.struct(x.cast("int").alias("last"), (a["n"] + F.when((x == a["last"]) | (x == a["last"] + 1), 0).otherwise(1)).alias("n")))["n"]


def mismatch_signals(reads: DataFrame, least_nm: int = 3, least_events: int = 3, grid: int = 200) -> DataFrame:
    """Unclipped reads with several independent mismatches (column mismatches), on a grid; score is mapq, 3 at most."""
    unclipped = (cg.clip_left("cigar") == 0) & (cg.clip_right("cigar") == 0)
    rows = reads.filter(unclipped & (F.col("nm") >= least_nm) & (mismatch_events(F.col("mismatches")) >= least_events))
    return rows.select("read_name", "chrom", (F.col("pos") - F.col("pos") % grid).alias("pos"), F.least(F.lit(3), "mapq").alias("score"))


def pair_class(most: int) -> Column:
    """What an abnormal pair hints at."""
    same, one = F.col("chrom") == F.col("mate_chrom"), has(REVERSE) == has(MATE_REVERSE)
    first = F.when(F.col("pos") <= F.col("mate_pos"), ~has(REVERSE)).otherwise(~has(MATE_REVERSE))
    return F.when(~same & one, "TRA_INV").when(~same, "TRA").when(one & ~has(REVERSE), "INV_1").when(one, "INV_2").when(~first, "DUP").when(F.abs("isize") > most, "DEL")


def pair_regions(reads: DataFrame, most: int, read_length: int) -> DataFrame:
    """The class of each abnormal pair with the two regions in which its breakpoints lie: behind a forward read's end, or
    before a reverse read's start, as far as the largest insert size leaves room."""
    room = most - 2 * read_length
    side = lambda p, back: F.when(back, F.struct((p - room).alias("st"), p.alias("ed"))).otherwise(F.struct((p + read_length).alias("st"), (p + read_length + room).alias("ed")))
    rows = reads.withColumn("class", pair_class(most)).filter("class is not null").withColumn("a", side(F.col("pos"), has(REVERSE))).withColumn("b", side(F.col("mate_pos"), has(MATE_REVERSE)))
    return rows.select("read_name", "class", "chrom", "a.st", "a.ed", F.col("mate_chrom").alias("chrom2"), F.col("b.st").alias("st2"), F.col("b.ed").alias("ed2"))


def mate_groups(candidates: DataFrame, gap: int = 20_000, more_than: int = 3) -> DataFrame:
    """Places of mates, grouped by gaps, with more than a few reads each."""
    return gap_clusters(candidates.select(F.col("mate_chrom").alias("chrom"), F.col("mate_pos").alias("pos")), gap).filter(F.col("n") > more_than)


def fetch_mates(candidates: DataFrame, reads: DataFrame, most: int | None = None) -> DataFrame:
    """Reads that are mates of the candidates: name and both places agree. With `most`, a chromosome with more candidates
    than that is skipped as a whole, as its candidates are noise."""
    if most is not None:
        few = candidates.groupBy("chrom").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= most).select("chrom")
        candidates = candidates.join(few, "chrom", "left_semi")
    c = candidates.select("read_name", F.col("mate_chrom").alias("chrom"), F.col("mate_pos").alias("pos"), F.col("chrom").alias("mate_chrom"), F.col("pos").alias("mate_pos"))
    return reads.join(c, ["read_name", "chrom", "pos", "mate_chrom", "mate_pos"], "left_semi")


# Depth, sizes and support


def read_length_stats(reads: DataFrame) -> DataFrame:
    """Mean length, the commonest length and its share (`modal` null under 60 %)."""
    per = reads.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    out = per.agg((F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("mean"), F.max_by("length", F.struct("n", -F.col("length"))).alias("commonest"), (F.max("n") / F.sum("n")).alias("share"))
    return out.withColumn("modal", F.when(F.col("share") > 0.6, F.col("commonest")))


def isize_stats(sizes: DataFrame, column: str = "isize") -> DataFrame:
    """Exact 1 %, 50 % and 99 % quantiles of insert sizes, and their number."""
    return quantiles(sizes, column, least=0.01, median=0.5, most=0.99).withColumnRenamed("n", "pairs")


def isize_histogram(sizes: DataFrame, column: str = "isize") -> DataFrame:
    """Number, percent and cumulative percent of each size."""
    per = cumulated(sizes.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "n")
    return per.select(column, "n", (100.0 * F.col("n") / F.col("total")).alias("percent"), (100.0 * F.col("upto") / F.col("total")).alias("cumulative"))


def isize_density(sizes: DataFrame, column: str = "isize") -> DataFrame:
    """`(isize, d)`: the share of pairs (and one) that each size from the 1 % to below the 99 % quantile has."""
    stats = F.broadcast(isize_stats(sizes, column))  # one row
    per = sizes.groupBy(F.col(column).alias("isize")).agg(F.count(F.lit(1)).alias("n")).join(stats)
    return per.filter((F.col("isize") >= F.floor("least")) & (F.col("isize") < F.floor("most"))).select("isize", (F.col("n") / (F.col("pairs") + 1)).alias("d"))


def breakpoint_distribution(density: DataFrame, read_length: int) -> DataFrame:
    """From the density of insert sizes (isize, d) the probability that a breakpoint lies i bases past a read's end: each
    size spreads evenly over the bases between its two reads."""
    rows = density.filter(F.col("isize") > 2 * read_length).select((F.col("isize") - 2 * read_length).alias("n"), (F.col("d") / (F.col("isize") - 2 * read_length)).alias("w"))
    per = rows.groupBy("n").agg(F.sum("w").alias("w"))
    level = cumulated(per, "n", "w").withColumn("before", F.coalesce("previous", F.lit(0))).withColumn("p", F.col("total") - F.col("upto") + F.col("w"))
    whole = F.broadcast(level.agg(F.sum(F.col("p") * (F.col("n") - F.col("before"))).alias("whole")))  # one row
    spread = level.select(F.explode(F.sequence(F.col("before").cast("int"), (F.col("n") - 1).cast("int"))).alias("i"), "p")
    return spread.join(whole).select("i", (F.col("p") / F.col("whole")).alias("p"))


def clip_distribution(reach: int = 10) -> list[float]:
    """The probability that a breakpoint lies i bases from a clip: falls with the square of what is left of `reach`."""
    total = sum(k * k for k in range(1, reach + 1))
    return [(reach - i) ** 2 / total for i in range(reach)]


def unmapped_distribution(density: DataFrame, read_length: int) -> DataFrame:
    """`(i, p)` where an unmapped mate starts, i bases from its mapped read's start: the density of sizes, less a read."""
    return density.select((F.col("isize") - read_length).alias("i"), F.col("d").alias("p"))


def least_accepted(distribution: DataFrame, times: int) -> DataFrame:
    """The smallest sum of probabilities that a breakpoint needs: so many times the largest one (2 for pairs and clips, 3 for
    unmapped mates)."""
    return distribution.agg((times * F.max("p")).alias("least"))


def block_depth(reads: DataFrame, block: int = 32) -> DataFrame:
    """Reads that start in each block."""
    return reads.groupBy("chrom", div(F.col("st"), block).alias("block")).agg(F.count(F.lit(1)).alias("n"))


def region_depth(regions: DataFrame, depth: DataFrame, average: float, block: int = 32) -> DataFrame:
    """Mean and largest ratio of block depth to the average over each region's blocks, and whether it is high."""
    r = regions.select("id", "chrom", F.explode(F.sequence(div(F.col("st"), block), div(F.col("ed"), block))).alias("block"))
    ratio = F.coalesce("n", F.lit(0)) / average
    out = r.join(depth, ["chrom", "block"], "left").groupBy("id").agg(F.avg(ratio).alias("mean_ratio"), F.max(ratio).alias("max_ratio"))
    return out.withColumn("high", F.col("mean_ratio") > 2)


def mean_depth(reads: DataFrame, region_length: int) -> DataFrame:
    length = F.col("ed") - F.col("st")
    return reads.agg((F.sum(length) / (F.avg(length) + region_length)).alias("depth"))


def pair_support(sv: DataFrame, pairs: DataFrame, read_length: int, most: int) -> DataFrame:
    """Read pairs that speak for a deletion or for the reference. sv: id, chrom, pos, ed; pairs: chrom, st, ed (outer ends).
    A pair starts in the window before the variant and ends in the one behind it (for) or behind its start (reference)."""
    span = most - read_length
    spots = sv.select("id", "chrom", F.col("pos"), F.col("ed").alias("end"), (F.col("pos") - span + 1).alias("st"), (F.col("pos") - 1).alias("ed"))
    starts = pairs.select("chrom", F.col("st"), F.col("st").alias("ed"), F.col("ed").alias("mate_end"))
    j = overlap_join(spots, starts, 1000).withColumn("isize", F.col("r_mate_end") - F.col("r_st"))
    behind = lambda p: (F.col("r_mate_end") > p) & (F.col("r_mate_end") < p + span)
    per = j.groupBy("id").agg(F.count_if(behind(F.col("end"))).alias("n_sv"), F.avg(F.when(behind(F.col("end")), F.col("isize"))).alias("isize_sv"), F.count_if(behind(F.col("pos"))).alias("n_ref"), F.avg(F.when(behind(F.col("pos")), F.col("isize"))).alias("isize_ref"))
    return sv.select("id").join(per, "id", "left").fillna(0, ["n_sv", "n_ref"])


def breakpoint_reads(sv: DataFrame, reads: DataFrame, share: float = 0.3) -> DataFrame:
    """Reads over the first breakpoint with more than a share of their length before it (1), over the second with more
    than it behind (2); both add up to `mode`."""
    one = sv.select("id", "chrom", F.col("pos").alias("st"), F.col("pos").alias("ed"), F.lit(1).alias("side"))
    two = sv.select("id", "chrom", F.col("end").alias("st"), F.col("end").alias("ed"), F.lit(2).alias("side"))
    j = overlap_join(one.unionByName(two), reads.select("chrom", "st", "ed", "read"), 1000)
    length = F.col("r_ed") - F.col("r_st")
    kept = j.filter(F.when(F.col("side") == 1, F.col("st") - F.col("r_st") > share * length).otherwise(F.col("r_ed") - F.col("st") > share * length))
    return kept.select("id", F.col("r_read").alias("read"), "side").distinct().groupBy("id", "read").agg(F.sum("side").alias("mode"))


def flanking_alignments(points: DataFrame, alignments: DataFrame, near: int = 5000, far: tuple[int, ...] = (50_000, 500_000, 10_000_000), longest: int = 1_500_000, most: int | None = None) -> DataFrame:
    """For each point (id, chrom, pos, sample) the nearest alignment that begins more than `near` behind it and the nearest
    that ends more than `near` before it, at the smallest reach at which both are of one read and close.

    The nearest of each side doesn't depend on the reach, which only says whether it is in it. So points and alignment ends
    of a sample and chromosome are sorted together, in bins, and running minima give both sides without a join.
    """
    key, part = ["sample", "chrom"], ["sample", "chrom", "_bin"]
    p = points.select("sample", "chrom", "id", F.explode(F.array(F.struct((F.col("pos") + near).alias("x"), F.lit(1).alias("kind")), F.struct((F.col("pos") - near).alias("x"), F.lit(2).alias("kind")))).alias("e"), "pos", F.lit(None).cast(alignments.schema["read"].dataType).alias("read"))
    a = alignments.select("sample", "chrom", F.lit(None).cast(points.schema["id"].dataType).alias("id"), F.explode(F.array(F.struct(F.col("st").alias("x"), F.lit(3).alias("kind")), F.struct(F.col("ed").alias("x"), F.lit(4).alias("kind")))).alias("e"), F.lit(None).cast(points.schema["pos"].dataType).alias("pos"), "read")
    rows = p.unionByName(a).select(*key, "id", "pos", "read", "e.x", "e.kind")
    rows = stretches(rows, key, "x", STRETCH, most)
    begin = F.when(F.col("kind") == 3, F.struct(F.col("x").alias("x"), F.col("read").alias("read")))
    end = F.when(F.col("kind") == 4, F.struct((-F.col("x")).alias("x"), F.col("read").alias("read")))
    bins_ = Window.partitionBy(*key).orderBy("_bin")
    per = rows.groupBy(*part).agg(F.min(begin).alias("_b"), F.min(end).alias("_e"))
    per = per.select(*part, F.min("_b").over(bins_.rowsBetween(1, Window.unboundedFollowing)).alias("_b"), F.min("_e").over(bins_.rowsBetween(Window.unboundedPreceding, -1)).alias("_e"))
    by = Window.partitionBy(*part).orderBy("x")
    behind, before = Window.partitionBy(*part).orderBy("x").rangeBetween(1, Window.unboundedFollowing), by.rangeBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("b", F.min(begin).over(behind)).withColumn("e", F.min(end).over(before)).filter("kind < 3").join(per, part)
    found = found.groupBy("id", "pos").agg(F.max(F.when(F.col("kind") == 1, F.coalesce("b", "_b"))).alias("b"), F.max(F.when(F.col("kind") == 2, F.coalesce("e", "_e"))).alias("e"))
    d, c = F.col("b.x") - F.col("pos"), F.col("pos") + F.col("e.x")
    reach = F.array_min(F.filter(F.array(*map(F.lit, far)), lambda w: (w > d) & (w > c)))
    return found.filter((F.col("b.read") == F.col("e.read")) & (d < longest) & (c < longest)).select("id", reach.alias("w"), F.col("b.read").alias("read"), c.alias("before"), d.alias("behind")).filter("w is not null")


#: Bases of a stretch whose places `pile_up` counts in one task.
PILE = 4096


def pile_up(reads: DataFrame) -> DataFrame:
    """Bases by place: A, C, G, T, deleted, inserted before, and the commonest base. For bounded regions: a row per base.

    Pieces of reads are shuffled, cut at PILE bases; they become bases where their places are counted."""
    ops = cg.exploded(reads).filter(F.col("op").isin("M", "=", "X", "D", "I"))
    size = F.when(F.col("op") == "I", 1).otherwise(F.col("len"))
    pieces = ops.select("chrom", "op", "ref", "query", "seq", size.alias("size")).filter("size > 0")
    pieces = pieces.withColumn("_bin", F.explode(F.sequence(div(F.col("ref"), PILE), div(F.col("ref") + F.col("size") - 1, PILE))))
    st = F.greatest(F.col("ref"), F.col("_bin") * PILE).cast(ops.schema["ref"].dataType)
    cut = pieces.withColumn("st", st).withColumn("n", (F.least(F.col("ref") + F.col("size"), (F.col("_bin") + 1) * PILE) - F.col("st")).cast("int"))
    text = F.when(F.col("op").isin("D", "I"), F.col("op")).otherwise(F.substring("seq", (F.col("query") + F.col("st") - F.col("ref") + 1).cast("int"), F.col("n")))
    dealt = cut.select("chrom", "_bin", "st", "n", F.col("op").isin("D", "I").alias("gap"), text.alias("text")).repartition("chrom", "_bin")
    each = dealt.select("chrom", "_bin", "st", "gap", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    base = F.when(F.col("gap"), F.col("text")).otherwise(F.substring("text", F.col("i") + 1, F.lit(1)))
    rows = each.select("chrom", "_bin", (F.col("st") + F.col("i")).alias("pos"), base.alias("b"))
    counts = rows.groupBy("chrom", "_bin", "pos").agg(*(F.count_if(F.col("b") == k).alias(k) for k in "ACGTDI")).drop("_bin")
    return counts.withColumn("major", F.array_max(F.array(*(F.struct(F.col(k).alias("n"), F.lit(k).alias("b")) for k in "ACGT")))["b"])


#: Classes of ids by hash: those with an id of several sequences are marked, so that at most so many rows are broadcast.
CLASSES = 1 << 16


def kmer_census(sequences: DataFrame, k: int = 20, least: int = 3) -> DataFrame:
    """k-mers found at least `least` times in a sequence (either strand), their counts summed over sequences.

    A sequence is counted in its row, and only k-mers that reach `least` leave it. Sequences of one id count as one: where
    the id's class has an id with several, all k-mers leave the rows, with their counts, and are summed by id first.
    """

    @F.pandas_udf("array<struct<kmer: string, n: long>>")
    def counted(texts: pd.Series, low: pd.Series) -> pd.Series:
        return pd.Series([[(w, n) for w, n in counted_kmers(x, k, m)] if x is not None else [] for x, m in zip(texts, low)], dtype=object)

    of = lambda c: F.pmod(F.xxhash64(c), F.lit(CLASSES))
    several = sequences.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(of("id").alias("_class")).distinct().withColumn("_low", F.lit(1))
    rows = sequences.select("id", "s", of("id").alias("_class")).join(F.broadcast(several), "_class", "left")
    per = rows.select("id", F.explode(counted("s", F.coalesce("_low", F.lit(least)))).alias("x")).select("id", "x.kmer", "x.n")
    per = per.groupBy("id", "kmer").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return per.groupBy("kmer").agg(F.sum("n").alias("n"))


def shared_kmer_counts(pairs: DataFrame, k: int = 10) -> DataFrame:
    """`(id, n)`: how many k-mer occurrences of `a` are also in `b`. No k-mer leaves its row: memory goes by one pair's length."""

    @F.pandas_udf("long")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([shared_windows(x, y, k) if x is not None and y is not None else 0 for x, y in zip(a, b)], dtype="int64")

    return pairs.select("id", shared("a", "b").alias("n"))


def composition_histogram(sequences: DataFrame, step: int = 16) -> DataFrame:
    """How many sequences have each base composition, counts in steps."""
    return sequences.groupBy(*(F.floor(base_count("s", b) / step).cast("long").alias(b) for b in "ACGT")).agg(F.count(F.lit(1)).alias("n"))


def mapped_by_chromosome(mappings: DataFrame) -> DataFrame:
    """Mapped length of each read by chromosome, and its main chromosome."""
    per = mappings.groupBy("read", "chrom").agg(F.sum(F.col("ed") - F.col("st")).alias("mapped"))
    best = Window.partitionBy("read").orderBy(F.desc("mapped"), "chrom")
    return per.withColumn("main", F.row_number().over(best) == 1)


def mapping_gaps(mappings: DataFrame) -> DataFrame:
    """Gaps in read and on the reference between successive mappings of a read (read_st, read_ed, st, ed)."""
    by = Window.partitionBy("read").orderBy("read_st", "read_ed", "st")
    return mappings.withColumn("read_gap", F.col("read_st") - F.lag("read_ed").over(by)).withColumn("ref_gap", F.col("st") - F.lag("ed").over(by))


def piecewise_depth(mappings: DataFrame) -> DataFrame:
    """Stretches of a read between successive ends of its mappings, with the number of mappings over each."""
    ends = mappings.select("read", F.explode(F.array(F.struct(F.col("read_st").alias("p"), F.lit(1).alias("d")), F.struct(F.col("read_ed").alias("p"), F.lit(-1).alias("d")))).alias("e"))
    per = ends.groupBy("read", F.col("e.p").alias("p")).agg(F.sum("e.d").alias("d"))
    by = Window.partitionBy("read").orderBy("p")
    return per.withColumn("n", F.sum("d").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("to", F.lead("p").over(by)).filter("to is not null").select("read", F.col("p").alias("from"), "to", "n")


def projected_pieces(mappings: DataFrame) -> DataFrame:
    """For each of the `piecewise_depth` stretches of a read the mappings over it (read, read_st, read_ed, st, ed, id), each
    with the place on the reference to which the stretch's start is projected, in proportion: read, from, to, id, at."""
    pieces = piecewise_depth(mappings).filter("n > 0")
    m = mappings.select("read", "read_st", "read_ed", "st", "ed", "id")
    j = pieces.join(m, "read").filter((F.col("read_st") <= F.col("from")) & (F.col("to") <= F.col("read_ed")))
    at = F.col("st") + (F.col("from") - F.col("read_st")) * (F.col("ed") - F.col("st")) / (F.col("read_ed") - F.col("read_st"))
    return j.select("read", "from", "to", "id", F.floor(at).cast("long").alias("at"))


def likeliest_place(density: DataFrame, width: int) -> DataFrame:
    """The start of the window of `width` places with the largest sum (the first of equals): id, pos, p. Windows run over
    stretches; a place within reach of the stretch before goes to that one too."""
    bins = F.sequence(div(F.col("pos") - (width - 1), STRETCH), div(F.col("pos"), STRETCH))
    rows = density.withColumn("_bin", F.explode(bins))
    by = Window.partitionBy("id", "_bin").orderBy("pos").rangeBetween(0, width - 1)
    sums = rows.withColumn("s", F.sum("p").over(by)).filter(F.col("_bin") == div(F.col("pos"), STRETCH))
    return sums.groupBy("id").agg(F.max_by("pos", F.struct("s", -F.col("pos"))).alias("pos"), F.max("s").alias("p"))
