"""Genotype, quality and filter rules: column expressions on counts of reads for and against a variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequence import phred_add
from strandloom.operators.intervals import overlap_join

HOM_REF, HET, HOM_ALT = "0/0", "0/1", "1/1"


def long_read_genotype(against: Column, support: Column) -> Column:
    """Six times as many reads on one side decide; a single supporting read never makes a homozygote."""
    hom = F.when(support == 1, HET).otherwise(HOM_ALT)
    return F.when(against > 6 * support, HOM_REF).when(6 * against < support, hom).otherwise(HET)


def qualities(ref: Column, alt: Column, unknown: Column, genotype: Column, imprecise: Column | None = None) -> Column:
    """`struct<qual, gq>` from log-likelihoods of the three genotypes. A phased heterozygote counts as heterozygous."""
    rr, aa, ra = -5.0 * alt - 5.3, -5.0 * ref, -0.3 * (ref + alt) - 5.0
    qual = F.greatest((F.greatest(ra, aa) - rr) * 10, F.lit(20.0))
    doubtful = (unknown > 0.1 * alt) & (qual > 100)
    qual = F.least(F.when(doubtful, qual / 10).otherwise(qual), F.lit(500.0))
    if imprecise is not None:
        qual = F.when(imprecise, 20.0).otherwise(qual)
    het = genotype.isin(HET, "0|1", "1|0")
    gq = F.when(genotype.isin(HOM_REF, "0|0"), rr - F.greatest(ra, aa)).when(het, ra - F.greatest(rr, aa)).otherwise(aa - F.greatest(rr, ra))
    return F.struct(F.floor(qual).cast("int").alias("qual"), F.floor(gq * 10).cast("int").alias("gq"))


def short_read_genotype(against: Column, support: Column, unknown: Column) -> Column:
    gt = F.when((support < 2) | (unknown > 3 * (support + against)) | (3 * support < against), HOM_REF)
    return gt.when(support > 4 * against, HOM_ALT).otherwise(HET)


def inversion_genotype(against: Column, support: Column) -> Column:
    return F.when(support > 4 * against, HOM_ALT).when(against > 4 * support, HOM_REF).otherwise(HET)


def long_deletion(genotype: Column, length: Column, pair_genotype: Column, depth_ratio: Column) -> Column:
    """Rules for deletions (negative lengths) by discordant pairs and depth: pairs must agree below -400 and may rescue
    below -700; beyond 50,000 nothing is called; below -1000 a depth ratio over 0.9 speaks against it."""
    gt = F.when((length < -400) & (pair_genotype == HOM_REF), HOM_REF).when((length < -700) & (genotype == HOM_REF), pair_genotype).otherwise(genotype)
    return F.when((length < -50_000) | ((length < -1000) & (depth_ratio > 0.9)), HOM_REF).otherwise(gt)


def read_class(ref_score: Column, alt_score: Column, least: Column | int) -> Column:
    """`alt` or `ref` if that score leads by more than 4 and passes `least`; else `unknown`."""
    return F.when((alt_score > ref_score + 4) & (alt_score > least), "alt").when((ref_score > alt_score + 4) & (ref_score > least), "ref").otherwise("unknown")


def phase(genotype: Column, haplotype: Column, n_haplotypes: Column, region: Column) -> Column:
    """Heterozygotes by haplotype; with one haplotype in the region, by a hash of the region."""
    one = F.when(F.xxhash64(region).bitwiseAND(1) == 0, "0|1").otherwise("1|0")
    het = F.when(n_haplotypes == 1, one).when(haplotype == 0, "0|1").otherwise("1|0")
    return F.when(genotype == HET, het).when(genotype == HOM_ALT, "1|1").when(genotype == HOM_REF, "0|0").otherwise(genotype)


def hybrid(long_gt: Column, long_against: Column, long_support: Column, short_gt: Column, short_ref: Column, short_alt: Column) -> Column:
    """Short reads overrule weak long-read calls."""
    weak = (long_support == 1) & (long_against >= 1) & (short_ref >= 20 * short_alt)
    return F.when(weak, HOM_REF).when((long_against == 0) & (long_support < 4) & short_gt.isNotNull(), short_gt).otherwise(long_gt)


def filter_label(length: Column, duplicate: Column, genotype: Column, pairs_disagree: Column, vntr: Column, qual: Column, short_label: str = "PASS") -> Column:
    """The FILTER of a call. short_label: what calls under 50 bases get; older outputs say `lt50bp`."""
    label = F.when(F.abs(length) < 50, short_label).when(duplicate, "DUPLICATE").when(genotype.isin(HOM_REF, "0|0"), "LOW_DEPTH")
    return label.when(pairs_disagree, "DR_not_support").when(vntr & (qual <= 5), "LOW_QUAL").otherwise("PASS")


def end_of(pos: Column, length: Column) -> Column:
    """Last reference base: a deletion's length is negative."""
    return F.when(length < 0, pos - length).otherwise(pos)


def written_allele(length: Column, alt: Column, kind: Column) -> Column:
    """Long deletions are written symbolically; inversions have sequences up to 2,000 bases."""
    return F.when(length < -50_000, "<DEL>").when((kind == "INV") & (F.abs(length) > 2000), "<INV>").otherwise(alt)


def callable_inversion(length: Column, least: int = 30, most: int = 50_000) -> Column:
    """Whether an inversion is of a length that is called."""
    return F.abs(length).between(least, most)


def allele_length_variants(sv: DataFrame, least: int = 50) -> DataFrame:
    """Variants whose alleles differ by at least `least` bases, with type and length from the alleles, to be split by sample,
    type and chromosome (partitionBy on writing). Symbolic alleles keep their svlen."""
    size = F.when(F.col("alt").startswith("<"), F.col("svlen")).otherwise(F.length("alt") - F.length("ref"))
    return sv.withColumn("allele_length", size.cast("long")).filter(F.abs("allele_length") >= least).withColumn("allele_type", F.when(F.col("allele_length") < 0, "DEL").otherwise("INS"))


def with_short_support(long: DataFrame, short: DataFrame) -> DataFrame:
    """Long-read calls (id, gt, ref_n, alt_n) with the short reads' view of the same ids (gt, ref_n, alt_n) and the genotype
    of both, `gt_hybrid`. Calls that short reads don't know keep theirs."""
    s = short.select("id", F.col("gt").alias("short_gt"), F.col("ref_n").alias("short_ref"), F.col("alt_n").alias("short_alt"))
    both = hybrid(F.col("gt"), F.col("ref_n"), F.col("alt_n"), F.col("short_gt"), F.col("short_ref"), F.col("short_alt"))
    return long.join(s, "id", "left").withColumn("gt_hybrid", F.coalesce(both, F.col("gt")))


def usable_variants(sv: DataFrame, least: int = 50, mode: str = "abs") -> DataFrame:
    """PASS or no filter, a real ALT, and length at least `least`. mode `signed` compares the signed length, which drops
    every deletion; `abs`, the default, does not."""
    size = F.abs("svlen") if mode == "abs" else F.col("svlen")
    return sv.filter((F.col("filter").isNull() | F.col("filter").isin("PASS", ".")) & (F.coalesce("alt", F.lit("")) != "*") & (size >= least))


def spanning_reads(sv: DataFrame, reads: DataFrame, pad: int = 500) -> DataFrame:
    """Short-read calls judged by long reads that span the variant's ends: `gt_long` from their number (halved if two ends)."""
    ends = sv.withColumn("p", F.explode(F.when(F.col("svlen") < 0, F.array("pos", end_of(F.col("pos"), F.col("svlen")))).otherwise(F.array("pos"))))
    spots = ends.select("id", "chrom", (F.col("p") - pad).alias("st"), (F.col("p") + pad).alias("ed"))
    pairs = overlap_join(spots, reads.select("chrom", "st", "ed")).filter((F.col("r_st") <= F.col("st")) & (F.col("ed") <= F.col("r_ed")))
    n = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    out = sv.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("n_spanning", F.when(F.col("svlen") < 0, F.floor(F.col("n") / 2)).otherwise(F.col("n")).cast("long")).drop("n")
    return out.withColumn("gt_long", F.when(F.col("n_spanning") > 3, HOM_REF).when(F.col("n_spanning") >= 1, HET).otherwise(F.col("gt")))


def bayes_genotype(reads: DataFrame, genotypes: dict[str, float], keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """The likeliest genotype of each variant. reads: ref_ll and alt_ll, log10-likelihoods of a read under either allele;
    genotypes: share of alternative alleles. Adds up the log10 of each read's mixture over the genotypes."""
    rows = reads.withColumn("g", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(float(v)).alias("share")) for k, v in genotypes.items()))))
    one = F.log10((1 - F.col("g.share")) * F.pow(F.lit(10.0), "ref_ll") + F.col("g.share") * F.pow(F.lit(10.0), "alt_ll"))
    per = rows.groupBy(*keys, F.col("g.name").alias("gt")).agg(F.sum(one).alias("ll"))
    best = Window.partitionBy(*keys).orderBy(F.desc("ll"), "gt")
    ranked = per.withColumn("k", F.row_number().over(best)).withColumn("next_ll", F.lead("ll").over(best))
    return ranked.filter("k = 1").select(*keys, "gt", "ll", F.round(10 * (F.col("ll") - F.col("next_ll"))).cast("int").alias("gq"))


#: Ten times the log10 of a haplotype's share in a genotype; IMPOSSIBLE for none. Haplotypes are those of the
#: alternative (alt), the reference (ref), noise and a somatic change; a read counts for no less than FLOOR.
IMPOSSIBLE, FLOOR = -10_000, -80
GENOTYPES = {
    "AA": ("1/1", {"alt": 0}), "AR": ("0/1", {"alt": -3, "ref": -3}), "RR": ("0/0", {"ref": 0}),
    "N": ("0/0", {}), "S": ("1/1", {"somatic": -3}),
}
MODES = {"germline": (["alt", "ref"], ["AA", "AR", "RR"]), "somatic": (["alt", "ref", "noise", "somatic"], ["AA", "AR", "RR", "N", "S"])}


def log_genotype(reads: DataFrame, mode: str = "germline", keys: tuple[str, ...] = ("id",), priors: dict[str, int] | None = None) -> DataFrame:
    """The likeliest of three germline or five somatic genotypes of each variant, in whole tenths of log10.

    reads: for each haplotype of the mode ten times the log10-likelihood of a read under it, integers. A read's sum over
    haplotypes is `phred_add` in their order; sums over reads are sums of integers, so they don't hang on partitions or
    order. priors: added to a genotype's sum (none by default). Columns: kind, gt, score (what speaks for it against all
    others), and the sum of each genotype.
    """
    haplotypes, kinds = MODES[mode]
    add = lambda terms: F.aggregate(terms, F.lit(IMPOSSIBLE).cast("long"), lambda a, x: phred_add(a, x).cast("long"))

    def of_read(kind: str) -> Column:
        shares = GENOTYPES[kind][1]
        return F.greatest(F.lit(FLOOR), add(F.array(*(F.col(h).cast("long") + F.lit(shares.get(h, IMPOSSIBLE)) for h in haplotypes))))

    sums = reads.groupBy(*keys).agg(*((F.sum(of_read(k)) + F.lit((priors or {}).get(k, 0))).alias(k) for k in kinds))
    most = F.greatest(*kinds)
    best = F.coalesce(*(F.when((F.col(k) == most) & (most > IMPOSSIBLE), k) for k in kinds), F.lit(kinds[0]))
    out = sums.withColumn("_total", add(F.array(*kinds))).withColumn("kind", best)
    each = F.array(*(F.struct(F.lit(k).alias("k"), (F.col(k) - F.col("_total")).alias("p")) for k in kinds))
    others = add(F.transform(F.filter(each, lambda x: x["k"] != F.col("kind")), lambda x: x["p"]))
    name = F.create_map(*[F.lit(x) for k in kinds for x in (k, GENOTYPES[k][0])])[F.col("kind")]
    return out.select(*keys, "kind", name.alias("gt"), (-others).cast("long").alias("score"), *kinds)


def somatic(tumor: DataFrame, normal: DataFrame, pairs: DataFrame, least_tumor: int = 3, least_normal: int = 2, tumor_only: bool = False) -> DataFrame:
    """Tumour contigs without an equal normal contig. pairs: region, t_contig, n_contig, end_to_end, matches, alignment
    results that come as a table. Contigs are equal if their lengths differ by at most 15 % or 50 bases and they align end to
    end. Regions without any normal contig give nothing, unless `tumor_only`."""
    t, n = tumor.filter(F.col("support") >= least_tumor), normal.filter(F.col("support") >= least_normal)
    long = lambda c: F.length(c)
    same = pairs.join(t.select("region", F.col("contig").alias("t_contig"), long("seq").alias("tl")), ["region", "t_contig"]).join(n.select("region", F.col("contig").alias("n_contig"), long("seq").alias("nl")), ["region", "n_contig"])
    shorter, longer = F.least("tl", "nl"), F.greatest("tl", "nl")
    same = same.filter((longer - shorter <= F.greatest(0.15 * longer, F.lit(50.0))) & F.col("end_to_end") & (F.col("matches") * 1.1 >= shorter))
    out = t.join(same.select("region", F.col("t_contig").alias("contig")).distinct(), ["region", "contig"], "left_anti")
    return out if tumor_only else out.join(n.select("region").distinct(), "region", "left_semi")


def tidy(sv: DataFrame) -> DataFrame:
    """One call per place and length (the best supported), and none whose sign contradicts its type."""
    first = Window.partitionBy("chrom", "pos", "svlen").orderBy(F.desc("alt_n"), "id")
    consistent = ~((F.col("svtype") == "DEL") & (F.col("svlen") > 0)) & ~((F.col("svtype") == "INS") & (F.col("svlen") < 0))
    return sv.filter(consistent).withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")
