"""Calls of many samples: merging, counting and choosing alleles."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequence import homopolymer_equal, kmers
from strandloom.operators.folds import stream
from strandloom.operators.intervals import STRETCH, div, overlap_join, with_island
from strandloom.operators.order import cumulated

LONG_ALLELE = 400


class _Variants:
    """Calls of a block in sample order: adds the number of the variant that each is. Holds a row for each variant."""

    def __init__(self, long_allele: int, crowd: int) -> None:
        self.long_allele, self.crowd, self.n = long_allele, crowd, 0
        self.leaders: dict[int, list[tuple[int, int, str]]] = {}  # by place: number, length, ALT

    def _same(self, size: int, alt: str, lead_size: int, lead_alt: str) -> bool:
        if self.n > self.crowd:
            return bool(lead_alt) and 0.9 < len(alt) / len(lead_alt) < 1.1
        if len(alt) < self.long_allele and len(lead_alt) < self.long_allele:
            return size == lead_size
        return bool(lead_size) and 0.9 < size / lead_size < 1.1

    def take(self, row: tuple) -> Iterable[tuple]:
        _, _, pos, size, _, alt = row[:6]
        mine = self.leaders.setdefault(pos, [])
        k = next((k for k, n, a in mine if self._same(size, alt, n, a)), None)
        if k is None:
            k, self.n = self.n, self.n + 1
            mine.append((k, size, alt))
        return ((*row, k),)

    def end(self) -> Iterable[tuple]:
        return ()


def merge_cohort(sv: DataFrame, long_allele: int = LONG_ALLELE, block: int = 30, crowd: int = 100) -> DataFrame:
    """One row per variant of the cohort with its carriers.

    sv: chrom, pos, svlen, ref, alt, sample (a number that gives the order), a1, a2, qual, id. Calls of one place are the
    same variant if their lengths are equal, or, where an ALT is long, if the length ratio lies in (0.9, 1.1), or, once the
    block of `block` bases holds more than `crowd` variants, if the ratio of their ALTs does; the first in sample order
    that matches wins. Blocks without a long allele and with few variants are a plain grouping; only the others are folded.
    """
    rows = sv.withColumn("_block", div(F.col("pos"), block))
    here = Window.partitionBy("chrom", "_block")  # a few bases; the groupings below keep its partitioning
    rows = rows.withColumn("_nth", F.dense_rank().over(here.orderBy("pos", "svlen")))
    rows = rows.withColumn("_fold", (F.max(F.length("alt")).over(here) >= long_allele) | (F.max("_nth").over(here) > crowd)).drop("_nth")
    carrier = F.struct("sample", "id", "a1", "a2", "qual")
    exact = rows.filter(~F.col("_fold")).groupBy("chrom", "_block", "pos", "svlen").agg(F.min_by(F.struct("ref", "alt"), F.struct("sample", "id")).alias("first"), F.sort_array(F.collect_list(carrier)).alias("support"))
    exact = exact.select("chrom", "pos", "svlen", "first.ref", "first.alt", "support")
    fields = ["chrom", "_block", "pos", "svlen", "ref", "alt", "sample", "id", "a1", "a2", "qual"]

    folded = stream(rows.filter("_fold").select(*fields), ["chrom", "_block"], ["sample", "id"], lambda: _Variants(long_allele, crowd), rows.select(*fields, F.lit(0).alias("lead")).schema, ["chrom", F.floor(F.col("_block") / 5000)])
    folded = folded.groupBy("chrom", "pos", "_block", "lead").agg(F.min_by(F.struct("svlen", "ref", "alt"), F.struct("sample", "id")).alias("first"), F.sort_array(F.collect_list(carrier)).alias("support"))
    return exact.unionByName(folded.select("chrom", "pos", "first.svlen", "first.ref", "first.alt", "support"))


def population_counts(cohort: DataFrame, population: DataFrame) -> DataFrame:
    """Carriers and alternative alleles of each variant by population. Every second allele counts, phased or not."""
    rows = cohort.select("chrom", "pos", "svlen", F.explode("support").alias("s")).select("chrom", "pos", "svlen", "s.*").join(population, "sample")
    alleles = (F.col("a1") == 1).cast("int") + (F.col("a2") == 1).cast("int")
    return rows.groupBy("chrom", "pos", "svlen", "population").agg(F.count_if(alleles > 0).alias("carriers"), F.sum(alleles).alias("ac"), (2 * F.count(F.lit(1))).alias("an"))


def locus_range(sv: DataFrame, loci: DataFrame) -> DataFrame:
    """For each repeat locus the smallest and largest length of the calls in it, the range in units (-1 without calls), and
    the rank over all loci by range, then place: places within a stretch of a chromosome, plus the loci of those before."""
    pairs = overlap_join(loci.select("id", "chrom", "st", "ed"), sv.select("chrom", F.col("pos").alias("st"), F.col("pos").alias("ed"), "svlen"))
    per = pairs.groupBy("id").agg(F.min("r_svlen").alias("least"), F.max("r_svlen").alias("most"), F.count(F.lit(1)).alias("n"))
    out = loci.join(per, "id", "left").withColumn("range", F.coalesce(F.floor((F.col("most") - F.col("least")) / F.col("unit")), F.lit(-1)).cast("long"))
    out = out.withColumn("_bin", div(F.col("st"), STRETCH))
    smaller = cumulated(out.groupBy("range").agg(F.count(F.lit(1)).alias("_n")), "range", "_n").select("range", (F.col("upto") - F.col("_n")).alias("_smaller"))
    part = ["range", "chrom", "_bin"]
    before = Window.partitionBy("range").orderBy("chrom", "_bin").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each stretch
    size = out.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*part).orderBy("st", "id"))
    ranked = out.withColumn("_own", own).join(size, part).join(smaller, "range")
    return ranked.withColumn("rank", F.col("_own") + F.col("_before") + F.col("_smaller")).drop("_bin", "_own", "_before", "_smaller")


def same_variant(a: str, b: str) -> dict:
    """Column predicates that say whether two calls, with prefixes a and b, are the same."""
    c = lambda p, n: F.col(f"{p}{n}")
    near, longer = F.abs(c(a, "pos") - c(b, "pos")), F.abs(c(a, "svlen") - c(b, "svlen"))
    ratio = c(a, "svlen") / c(b, "svlen")
    return {
        "exact": (near == 0) & (c(a, "ref") == c(b, "ref")) & (c(a, "alt") == c(b, "alt")),
        "homopolymer": (near <= 20) & (F.abs(F.length(c(a, "ref")) - F.length(c(b, "ref"))) <= 5) & (F.abs(F.length(c(a, "alt")) - F.length(c(b, "alt"))) <= 5) & homopolymer_equal(c(a, "ref"), c(b, "ref")) & homopolymer_equal(c(a, "alt"), c(b, "alt")),
        "deletion": (near <= 15) & (longer <= 5),
        "insertion": (near == 0) & (longer <= 10),
        "inversion": (near <= 200) & (F.abs(c(a, "pos") + c(a, "svlen") - c(b, "pos") - c(b, "svlen")) <= 200) & (ratio > 0.7) & (ratio < 1.5),
    }


def one_allele_per_region(sv: DataFrame) -> DataFrame:
    """Equal alleles called from different regions: one stays, the best supported (alt_n, ref_n: reads for and against).

    A call goes if one that stays is of another region and has reads on a side on which it has some too. Calls of one
    allele are as many as regions overlap, so they are folded as an array.
    """
    order = F.struct((-F.col("alt_n")).alias("x"), "region", "id", "alt_n", "ref_n")
    every = sv.groupBy("chrom", "pos", "ref", "alt").agg(F.sort_array(F.collect_list(order)).alias("calls"))
    like = lambda a, b: ((F.least(a["alt_n"], b["alt_n"]) > 0) | (F.least(a["ref_n"], b["ref_n"]) > 0)) & (a["region"] != b["region"])
    none = F.slice("calls", 1, 0)
    stay = F.aggregate("calls", none, lambda acc, x: F.when(F.exists(acc, lambda k: like(k, x)), acc).otherwise(F.array_append(acc, x)))
    kept = every.select("chrom", "pos", "ref", "alt", F.explode(stay).alias("k")).select("chrom", "pos", "ref", "alt", "k.region", "k.id").distinct()
    return sv.join(kept, ["chrom", "pos", "ref", "alt", "region", "id"], "left_semi").select(*sv.columns)


def merge_homozygous(sv: DataFrame) -> DataFrame:
    """An allele that both haplotypes of a region carry becomes one call: supports summed; each haplotype's support is
    taken from the other's reads against (0 at least)."""
    rows = sv.groupBy("chrom", "pos", "svlen", "region")
    got = rows.agg(F.min("id").alias("id"), F.count_distinct("hap").alias("n_hap"), F.sum("alt_n").alias("alt_n"), F.min("ref_n").alias("ref_min"), F.max("alt_n").alias("alt_max"))
    against = F.greatest(F.lit(0), F.col("ref_min") - F.when(F.col("n_hap") > 1, F.col("alt_n") - F.col("alt_max")).otherwise(0))
    return got.select("chrom", "pos", "svlen", "region", "id", "n_hap", "alt_n", against.alias("ref_n"))


def force_groups(sv: DataFrame, gap: int = 30) -> DataFrame:
    """Calls less than `gap` from the last of a growing group, with their class and the group's number."""
    ref, alt = F.length("ref"), F.length("alt")
    kind = F.when(F.col("svlen") > 800, "LONG_INS").when(F.col("svlen") < -700, "LONG_DEL").when((ref > 30) & (alt > 30), "CPX").otherwise("SMALL")
    return with_island(sv.withColumn("st", F.col("pos")).withColumn("ed", F.col("pos")).withColumn("class", kind), gap - 1, ("chrom",), ("st", "id")).drop("st", "ed")


def force_candidates(groups: DataFrame, sample) -> DataFrame:
    """Of the groups that `force_groups` made (with support array<struct<sample, ..>>) those to be called in `sample`: it
    carries none of their calls yet, and more than one carrier or call is known."""
    per = groups.groupBy("chrom", "island").agg(F.sum(F.size("support")).alias("n"), F.max(F.exists("support", lambda s: s["sample"] == sample)).alias("carried"))
    return groups.join(per.filter("not carried and n <> 1").select("chrom", "island"), ["chrom", "island"], "left_semi")


def best_haplotype_reads(scores: DataFrame, least: int = 5) -> DataFrame:
    """Reads whose best score is of one haplotype alone, counted by haplotype, and whether that is evidence."""
    best = Window.partitionBy("region", "read")
    top = scores.withColumn("m", F.max("score").over(best)).filter("score = m").withColumn("n", F.count(F.lit(1)).over(best)).filter("n = 1")
    return top.groupBy("region", "hap").agg(F.count(F.lit(1)).alias("n_reads")).withColumn("evidence", F.col("n_reads") >= least)


def pair_alleles(scores: DataFrame, advantage: int = 10, read_length: int | None = None) -> DataFrame:
    """For each region the pair of haplotypes under which its reads score best, and why it is rejected (0: it isn't).

    scores: region, read, hap, score, and optionally indel (whether the read aligns with unexplained indels). The last
    haplotype of a region is the reference, which also stands in where a read lacks a score. Each read counts its better
    haplotype; n1 and n2 are the reads of either side that lead by more than `advantage`, n_unknown the others, n_indel
    those with indels under both. Of equal pairs the last stays. Rejected are: 1 more than one read with indels, 2 the
    reference alone, 3 the reference with a third of its reads at most against it, 4 and 5 hardly better than the
    reference (5 if also far below the reads' length), 6 fewer than three reads on the first side, 7 a case of 5 in which
    unknown reads prevail.
    """
    if "indel" not in scores.columns:
        scores = scores.withColumn("indel", F.lit(False))
    per = scores.groupBy("region", "read").agg(F.map_from_entries(F.collect_list(F.struct("hap", F.struct(F.col("score").cast("long").alias("score"), "indel")))).alias("by"))
    haps = scores.groupBy("region").agg(F.sort_array(F.collect_set("hap")).alias("haps"), F.max("hap").alias("ref"))
    rows = per.join(haps, "region").withColumn("hap1", F.explode("haps")).withColumn("hap2", F.explode(F.filter("haps", lambda h: h >= F.col("hap1"))))
    of = lambda h: F.coalesce(F.element_at("by", F.col(h)), F.element_at("by", F.col("ref")), F.struct(F.lit(0).cast("long").alias("score"), F.lit(False).alias("indel")))
    rows = rows.withColumn("a", of("hap1")).withColumn("b", of("hap2"))
    lead = F.col("a.score") - F.col("b.score")
    pairs = rows.groupBy("region", "ref", "hap1", "hap2").agg(
        F.sum(F.greatest("a.score", "b.score")).alias("total"), F.count_if(lead > advantage).alias("n1"), F.count_if(-lead > advantage).alias("n2"),
        F.count_if(F.abs(lead) <= advantage).alias("n_unknown"), F.count_if(F.col("a.indel") & F.col("b.indel")).alias("n_indel"), F.count(F.lit(1)).alias("n"),
    )
    own = F.struct("total", "hap1", "hap2", "n1", "n2", "n_unknown", "n_indel", "n")
    is_ref = (F.col("hap1") == F.col("ref")) & (F.col("hap2") == F.col("ref"))
    best = pairs.groupBy("region", "ref").agg(F.max(own).alias("m"), F.max(F.when(is_ref, own)).alias("r")).select("region", "ref", "m.*", "r")
    close = F.col("total") < F.col("r.total") + 12 * F.col("n")
    low = F.col("total") + 35 * F.col("n") < (read_length or 0) * F.col("n")
    code = F.when(F.col("n_indel") > 1, 1).when((F.col("hap1") == F.col("ref")) & (F.col("hap2") == F.col("ref")), 2).when((F.col("hap2") == F.col("ref")) & (3 * F.col("n1") <= F.col("n2")), 3)
    code = code.when((F.col("r.n_indel") < 3) & close, 4).when(low & close, F.when(4 * (F.col("n1") + F.col("n2")) < F.col("n_unknown"), 7).otherwise(5)).when(F.col("n1") < 3, 6).otherwise(0)
    return best.select("region", "hap1", "hap2", "total", "n1", "n2", "n_unknown", "n_indel", code.alias("reject"))


def recover_alleles(cohort: DataFrame, singles: DataFrame, near: int = 1000) -> DataFrame:
    """For each cohort row (id, chrom, pos, lengths array<struct<sample, svlen>>) the commonest length, the first sample
    that has it, and that sample's nearest call of equal size within `near`."""
    long = cohort.select("id", "chrom", "pos", F.explode("lengths").alias("l")).select("id", "chrom", "pos", "l.*")
    count = long.groupBy("id", "chrom", "pos", "svlen").agg(F.count(F.lit(1)).alias("n"), F.min("sample").alias("sample"))
    modal = count.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "svlen"))).filter("k = 1")
    s = singles.select(F.col("sample").alias("s_sample"), F.col("chrom").alias("s_chrom"), F.col("pos").alias("s_pos"), F.col("svlen").alias("s_svlen"), "ref", "alt")
    modal = modal.withColumn("_bin", F.explode(F.sequence(div(F.col("pos") - near, 2 * near), div(F.col("pos") + near, 2 * near))))
    s = s.withColumn("s_bin", div(F.col("s_pos"), 2 * near))
    on = (F.col("sample") == F.col("s_sample")) & (F.col("chrom") == F.col("s_chrom")) & (F.abs("svlen") == F.abs("s_svlen")) & (F.col("_bin") == F.col("s_bin")) & F.col("s_pos").between(F.col("pos") - near, F.col("pos") + near)
    hits = modal.join(s, on, "left").withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.abs(F.col("s_pos") - F.col("pos")).asc_nulls_last(), "s_pos", "alt")))
    return hits.filter("k = 1").select("id", "chrom", "pos", "svlen", "sample", F.col("s_pos").alias("allele_pos"), "ref", "alt")


def motif_support(sequences: DataFrame) -> DataFrame:
    """Whether a sequence is made of its motif: gaps of more than five units between hits are not repeat; what is left must
    be 30 bases at least and more than half. Overlapping hits count. Columns seq, motif."""
    n, u = F.length("seq"), F.length("motif")
    hits = F.filter(F.transform(kmers("seq", u, False), lambda x, i: F.when(x == F.col("motif"), i + 1)), lambda i: i.isNotNull())
    rows = sequences.withColumn("_h", hits).withColumn("_edge", F.concat(F.array(1 - u), F.col("_h"), F.array(n + 1)))
    gaps = F.zip_with(F.slice("_edge", 2, F.size("_edge") - 1), F.slice("_edge", 1, F.size("_edge") - 1), lambda b, a: b - a - F.length("motif"))
    rows = rows.withColumn("_gaps", gaps).withColumn("repeat_bases", n - F.aggregate(F.filter("_gaps", lambda g: g > 5 * F.length("motif")), F.lit(0), lambda a, g: a + g))
    return rows.withColumn("n_hits", F.size("_h")).withColumn("supported", (F.col("n_hits") > 0) & (F.col("repeat_bases") >= 30) & (2 * F.col("repeat_bases") > n)).drop("_h", "_edge", "_gaps")
