"""Features of genome blocks and regions: entropy of breakpoints, variant density, context counters and the heat map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.functions.sequence import block_ids
from strandloom.operators.intervals import div, overlap_join

#: Centromeres and the like that the heat map leaves out (number of the chromosome from 0, start, end), and
#: chromosomes that it leaves out as a whole.
EXCLUDED = [
    (0, 121751000, 125184587),
    (1, 89816500, 94090557),
    (2, 90533500, 93655574),
    (3, 49091500, 51743951),
    (4, 46485901, 50059807),
    (6, 151855000, 158595000),
    (8, 43236168, 45518558),
    (9, 38485000, 41914000),
    (16, 21894500, 26885980),
    (19, 26436233, 31470500),
    (21, 11212000, 16567000),
]
LEFT_OUT = (23,)


def variant_density(reads: DataFrame, regions: DataFrame, shrink: int = 0, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Small variants of the alignments inside each region (less `shrink` on both sides), from CIGARs with = and X.

    Per region: reads, matched and mismatched bases, insertions and deletions with their bases (a deletion counts with the
    bases inside), and identities without and with them.
    """
    r = regions.select("id", "chrom", (F.col("st") + shrink).alias("st"), (F.col("ed") - shrink).alias("ed")).filter("st < ed")
    # reads meet regions whole; only those that do are cut into operations, and those at the region are kept
    spans = reads.select("read_name", "chrom", F.col("pos").cast("long").alias("st"), (F.col("pos") + cg.reference_length("cigar")).cast("long").alias("ed"), "cigar")
    met = overlap_join(r, spans, 1000).withColumn("_o", F.explode(F.filter(cg.with_offsets("r_cigar", "r_st"), lambda x: x["op"].isin("=", "X", "I", "D"))))
    at, n = F.col("_o.ref"), F.col("_o.len")
    met = met.withColumn("r_op", F.col("_o.op")).withColumn("r_len", n).withColumn("r_st", at).withColumn("r_ed", at + F.when(F.col("r_op") == "I", 0).otherwise(n - 1))
    j = met.drop("r_cigar", "_o").filter("r_st <= r_ed and st <= r_ed and r_st <= ed")
    inside = F.least(F.col("ed") - 1, F.col("r_ed")) - F.greatest("st", "r_st") + 1
    size = F.when(F.col("r_op") == "I", F.col("r_len")).otherwise(F.greatest(F.lit(0), inside))
    of = lambda op, x: F.sum(F.when(F.col("r_op") == op, x).otherwise(0))
    per = j.groupBy(*keys).agg(F.count_distinct("r_read_name").alias("reads"), of("=", size).alias("matches"), of("X", size).alias("mismatches"), of("I", F.lit(1)).alias("insertions"), of("I", size).alias("inserted"), of("D", F.lit(1)).alias("deletions"), of("D", size).alias("deleted"))
    m, s, indel = F.col("matches"), F.col("mismatches"), F.col("inserted") + F.col("deleted")
    return per.withColumn("identity", m / (m + s + 0.001)).withColumn("identity_indel", m / (m + s + indel + 0.001))


def read_density(reads: DataFrame, regions: DataFrame, shrink: int = 0) -> DataFrame:
    """`variant_density` by read: each region's number of reads and the means over its reads of matched and mismatched bases,
    insertions, deletions and their bases, and of the identities without and with them."""
    of_read = variant_density(reads, regions, shrink, ("id", "r_read_name"))
    counted = ["matches", "mismatches", "insertions", "inserted", "deletions", "deleted", "identity", "identity_indel"]
    return of_read.groupBy("id").agg(F.count(F.lit(1)).alias("reads"), *(F.avg(c).alias(f"mean_{c}") for c in counted))


def breakpoint_divergence(regions: DataFrame, reads: DataFrame, points: DataFrame, window: int = 10, expected: Column | None = None) -> DataFrame:
    """Kullback-Leibler divergence of observed breakpoints from those expected, over a region's windows.

    reads: chrom, st, ed, read; points: chrom, pos, read. A window's depth counts reads that strictly span it, its
    breakpoints distinct reads with one in it; expected is the share that the haplotypes predict (0, 0.5 or 1; column
    `expected` of the regions, 0 without one). Windows without reads give null, not NaN.
    """
    share = expected if expected is not None else F.lit(0.0)
    n = div(F.col("ed") - F.col("st"), window) + 1
    spots = regions.withColumn("_e", share.cast("double")).withColumn("n", n).select("id", "chrom", "_e", "st", "n", (F.col("st") + F.col("n") * window - 1).alias("ed"))
    # a read spans windows lo to hi of a region: one more from lo, one less behind hi
    lo, hi = F.greatest(F.lit(0), div(F.col("r_st") - F.col("st"), window) + 1), F.least(F.col("n") - 1, F.ceil((F.col("r_ed") - F.col("st") + 1) / window).cast("long") - 2)
    pairs = overlap_join(spots.drop("_e"), reads.select("chrom", "st", "ed"), 1000).select("id", lo.alias("lo"), hi.alias("hi")).filter("lo <= hi")
    steps = pairs.select("id", F.explode(F.array(F.struct(F.col("lo").alias("w"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("w"), F.lit(-1).alias("d")))).alias("s")).groupBy("id", F.col("s.w").alias("w")).agg(F.sum("s.d").alias("d"))
    p = points.select("chrom", "read", F.col("pos").alias("st"), F.col("pos").alias("ed"))
    broken = overlap_join(spots.drop("_e"), p, 1000).groupBy("id", div(F.col("r_st") - F.col("st"), window).alias("w")).agg(F.count_distinct("r_read").alias("breaks"))
    w = spots.select("id", "_e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("w"))
    rows = w.join(steps, ["id", "w"], "left").join(broken, ["id", "w"], "left")
    upto = Window.partitionBy("id").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("depth", F.coalesce(F.sum("d").over(upto), F.lit(0))).withColumn("breaks", F.coalesce("breaks", F.lit(0)))
    seen = F.least(F.lit(1.0), F.when(F.col("depth") > 0, F.col("breaks") / F.col("depth"))) + 0.01
    want = F.col("_e") + 0.01
    return rows.groupBy("id").agg(F.sum(seen * F.log(seen / want)).alias("kld"), F.sum("breaks").alias("breaks"), F.sum("depth").alias("depth"))


def short_read_context(blocks: DataFrame, reads: DataFrame, pad: int = 50, width: int = 1000, least_mapq: int = 11) -> DataFrame:
    """Counters of the reads at each block. reads: chrom, st, ed, clip, orientation (FF, RR, RF or FR), isize, mate_unmapped,
    mate_elsewhere, nm, events, mapq, length, indel; secondary and supplementary ones are left out before.

    What pairs say counts only from mapq `least_mapq` on: orientations of mapped mates, odd insert sizes, mates elsewhere,
    and pairs that are not plain (`discordant`). Depth counts whole bases of reads per base of the padded block and a read.
    """
    j = overlap_join(blocks.select("id", "chrom", "st", "ed"), reads, width, pad)
    c = lambda name: F.col(f"r_{name}")
    sure, mapped, size = c("mapq") >= least_mapq, ~c("mate_unmapped"), F.abs(c("isize"))
    plain = mapped & (c("orientation") == "FR") & ~c("mate_elsewhere") & (size <= 1000)
    counters = {
        "clipped": c("clip") > 0, "clip_1_10": c("clip").between(1, 10), "clip_11_50": c("clip").between(11, 50), "clip_over_50": c("clip") > 50, "discordant": sure & ~plain,
        **{f"pairs_{o.lower()}": sure & mapped & (c("orientation") == o) for o in ("FF", "RR", "RF")},
        "isize_over_1k": sure & (size > 1000), "isize_over_100k": sure & (size > 100_000), "mate_unmapped": sure & c("mate_unmapped"), "mate_elsewhere": sure & c("mate_elsewhere"),
        "nm_over_2": c("nm") > 2, "nm_over_10": c("nm") > 10, "events_over_2": c("events") > 2, "mapq_under_30": c("mapq") < 30, "mapq_under_10": c("mapq") < 10, "mapq_0": c("mapq") == 0,
    }
    sums = {"bases": "length", "clip_bases": "clip", "indel_bases": "indel", "nm_total": "nm", "mapq_total": "mapq"}
    per = j.groupBy("id").agg(F.count(F.lit(1)).alias("reads"), *(F.sum(c(v)).alias(k) for k, v in sums.items()), *(F.count_if(v).alias(k) for k, v in counters.items()))
    out = blocks.select("id", "st", "ed").join(per, "id", "left").fillna(0)
    return out.withColumn("depth", F.floor(F.col("bases") / (F.col("ed") - F.col("st") + 2 * pad + 148))).drop("st", "ed")


def long_read_context(signals: DataFrame, step: int, length: int) -> DataFrame:
    """Signals by the (one or two) overlapping blocks that hold them: chrom, block, type, n."""
    b = block_ids("pos", step, length)
    rows = signals.select("chrom", "type", F.explode(F.sequence(b["first"], b["last"])).alias("block"))
    return rows.groupBy("chrom", "block", "type").agg(F.count(F.lit(1)).alias("n"))


def label_blocks(blocks: DataFrame, sv: DataFrame, index: DataFrame, step: int, length: int, close: int = 10) -> DataFrame:
    """Blocks (chrom, block) with the types of variants whose ends they hold (BLANK without) and the largest repeat k.
    The two ends of a variant closer than `close` count as their midpoint."""
    ends = F.when(F.col("ed") - F.col("st") < close, F.array(div(F.col("st") + F.col("ed"), 2))).otherwise(F.array(F.col("st").cast("long"), F.col("ed").cast("long")))
    points = sv.select("chrom", F.col("type").alias("label"), F.explode(ends).alias("pos"))
    b = block_ids("pos", step, length)
    labels = points.select("chrom", "label", F.explode(F.sequence(b["first"], b["last"])).alias("block")).groupBy("chrom", "block").agg(F.max("label").alias("label"))
    k = index.select("chrom", "k", F.explode(F.sequence(b["first"], b["last"])).alias("block")).groupBy("chrom", "block").agg(F.max("k").alias("k"))
    out = blocks.join(labels, ["chrom", "block"], "left").join(k, ["chrom", "block"], "left")
    return out.withColumn("label", F.coalesce("label", F.lit("BLANK"))).withColumn("k", F.coalesce("k", F.lit(0)))


def outside_excluded(blocks: DataFrame, excluded=None, left_out: tuple = LEFT_OUT) -> DataFrame:
    """Blocks (chrom a number from 0, pos) outside the excluded places and chromosomes; the list is a dozen rows."""
    bad = F.col("chrom").isin(*left_out) if left_out else F.lit(False)
    for chrom, st, ed in EXCLUDED if excluded is None else excluded:
        bad = bad | ((F.col("chrom") == chrom) & (F.col("pos") > st) & (F.col("pos") < ed))
    return blocks.filter(~bad)


def signal_count(method: int, column: str | None = None) -> Column:
    """What the heat map counts of a block's context: 0 the given column; 1 mean, 2 larger of clips over ten bases and
    discordant pairs; 3 the largest of these and reads of several events; 4 clips over ten bases; 5 over fifty."""
    clips, pairs = F.col("clip_11_50") + F.col("clip_over_50"), F.col("discordant")
    return {0: F.col(column or "reads"), 1: F.floor((clips + pairs) / 2), 2: F.greatest(clips, pairs), 3: F.greatest(clips, pairs, F.col("events_over_2")), 4: clips, 5: F.col("clip_over_50")}[method].cast("long")


def heat_map(blocks: DataFrame, rows: int = 100, columns: int = 300, least_reads: int = 50) -> DataFrame:
    """Cells of signal count (y, column `signals`) by repeat k (x): blocks with and without variants, their share and its
    -10 log10, kept long. Blocks with few reads are left out."""
    cell = blocks.filter(F.col("reads") >= least_reads).select(F.least(F.lit(rows - 1), "signals").alias("y"), F.least(F.lit(columns - 1), "k").alias("x"), (F.col("label") != "BLANK").alias("v"))
    per = cell.groupBy("y", "x").agg(F.count_if("v").alias("n_sv"), F.count_if(~F.col("v")).alias("n_blank"))
    share = F.col("n_sv") / (F.col("n_sv") + F.col("n_blank"))
    return per.withColumn("p", share).withColumn("score", F.when(share > 0, F.abs(-10 * F.log10(share))))


def _scored(cells: DataFrame) -> DataFrame:
    share = F.try_divide("n_sv", F.col("n_sv") + F.col("n_blank"))
    return cells.withColumn("p", share).withColumn("score", F.when(share > 0, F.abs(-10 * F.log10(share))))


def merge_heat_maps(cells: DataFrame) -> DataFrame:
    """The sum of several maps, with shares and scores anew."""
    return _scored(cells.groupBy("y", "x").agg(F.sum("n_sv").alias("n_sv"), F.sum("n_blank").alias("n_blank")))


def full_heat_map(cells: DataFrame, rows: int = 100, columns: int = 300) -> DataFrame:
    """A map with a row for each of its rows * columns cells; those without blocks have counts 0 and no share."""
    grid = cells.sparkSession.range(rows * columns).select((F.floor(F.col("id") / columns)).cast("int").alias("y"), (F.col("id") % columns).cast("int").alias("x"))
    out = grid.join(cells.select("y", "x", "n_sv", "n_blank"), ["y", "x"], "left").fillna(0, ["n_sv", "n_blank"])
    return _scored(out)


def roc(scored: DataFrame, pieces: int = 200) -> DataFrame:
    """True and false positives at each distinct score from the highest, recall and precision. scored: score, positive.

    Scores are cut at quantiles into pieces; a piece passes on its sums to those below.
    """
    per = scored.groupBy("score").agg(F.count_if("positive").alias("tp"), F.count_if(~F.col("positive")).alias("fp"))
    cuts = sorted(set(per.approxQuantile("score", [k / pieces for k in range(1, pieces)], 0.5 / pieces)))
    rows = per.withColumn("_bin", F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= F.col("score"))))
    above = Window.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()  # these two over one row for each piece
    piece = rows.groupBy("_bin").agg(F.sum("tp").alias("t"), F.sum("fp").alias("f"))
    piece = piece.select("_bin", F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t"), F.coalesce(F.sum("f").over(above), F.lit(0)).alias("f"), F.sum("t").over(everything).alias("_all"))
    down = Window.partitionBy("_bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("score", "_bin", F.sum("tp").over(down).alias("tp"), F.sum("fp").over(down).alias("fp")).join(piece, "_bin")
    out = out.select("score", (F.col("tp") + F.col("t")).alias("tp"), (F.col("fp") + F.col("f")).alias("fp"), "_all")
    return out.withColumn("recall", F.try_divide("tp", "_all")).withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).drop("_all")
