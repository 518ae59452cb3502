"""From calls of many samples to the regions where several lie close together, and the contigs to look at there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import intervals as ops
from strandloom.operators.genotype import end_of, usable_variants
from strandloom.sources.regions import well_supported


def haplotype_calls(calls: DataFrame, least: int = 50) -> DataFrame:
    """One row for each haplotype that carries a usable call: id, sample, hap, chrom, st, ed. calls: as `read_vcf` gives
    them, with a column sample and the alleles a1, a2."""
    rows = usable_variants(calls, least).withColumn("hap", F.explode(F.array(*(F.when(F.col(f"a{h}") == 1, F.lit(h)) for h in (1, 2))))).filter("hap is not null")
    key = F.xxhash64("sample", "hap", "chrom", "pos", "ref", "alt")
    return rows.select(key.alias("id"), "sample", "hap", "chrom", F.col("pos").alias("st"), end_of(F.col("pos"), F.col("svlen")).alias("ed"))


def csv_regions(sv: DataFrame, least: int, dist: int = 500, width: int = 500) -> DataFrame:
    """Regions of bins that at least `least` haplotypes carry with variants near each other."""
    return ops.bin_frequency(ops.sv_bins(ops.flag_near(sv, dist), width), least, width)


def region_contigs(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """Well supported local contigs (with chrom, st, ed of their region) that overlap the regions found."""
    return ops.overlap_join(regions.select("chrom", "st", "ed", "max_ac"), well_supported(contigs))
