"""Intervals, annotations, sequences, alignments and small configuration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import cigar
from strandloom.functions.sequence import max_repeat_k
from strandloom.sources.records import records


def read_bed(spark: SparkSession, path: str | list[str], skip_first: bool = False) -> DataFrame:
    """chrom, st, ed, rest, file. skip_first: the first line of each file is a header; lines whose places aren't numbers
    drop out in any case."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_n"))
    if skip_first:  # only the first block of each file holds a header
        head = rows.filter("_at = 0").withColumn("_k", F.row_number().over(Window.partitionBy("file").orderBy("_n"))).filter("_k > 1").drop("_k")
        rows = rows.filter("_at > 0").unionByName(head)
    rows = rows.select(F.get(c, F.lit(0)).alias("chrom"), F.get(c, F.lit(1)).try_cast("int").alias("st"), F.get(c, F.lit(2)).try_cast("int").alias("ed"), F.slice(c, 4, F.greatest(F.size(c) - 3, F.lit(0))).alias("rest"), "file")
    return rows.filter(F.col("st").isNotNull() & F.col("ed").isNotNull())


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name (up to the first blank) and seq of each record; records are split by their `>`."""
    rows = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    return rows.select(F.regexp_extract("value", r"^(\S*)", 1).alias("name"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))


def chunked(sequences: DataFrame, size: int = 100_000) -> DataFrame:
    """Sequences cut to chunks `(chrom, chunk, seq)`, so that a slice reads few of them."""
    n = F.floor((F.greatest(F.length("seq"), F.lit(1)) - 1) / size).cast("int")
    rows = sequences.select(F.col("name").alias("chrom"), "seq", F.explode(F.sequence(F.lit(0), n)).alias("chunk"))
    return rows.select("chrom", "chunk", F.substring("seq", F.col("chunk") * size + 1, F.lit(size)).alias("seq"))


def ref_slice(regions: DataFrame, chunks: DataFrame, size: int = 100_000, key: str = "id") -> DataFrame:
    """The bases of half-open regions `[st, ed)`."""
    r = regions.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("st") / size).cast("int"), F.floor((F.col("ed") - 1) / size).cast("int"))))
    cut = r.join(chunks, ["chrom", "chunk"]).select(key, "chunk", F.substring("seq", F.greatest(F.lit(0), F.col("st") - F.col("chunk") * size) + 1, F.least(F.col("ed"), (F.col("chunk") + 1) * size) - F.greatest("st", F.col("chunk") * size)).alias("part"))
    joined = cut.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("chunk", "part"))).alias("parts")).select(key, F.array_join(F.col("parts.part"), "").alias("seq"))
    return regions.join(joined, key)


def folded(seq, width: int = 70):
    """A sequence as lines of `width` letters."""
    return F.regexp_replace(seq, rf"(.{{{width}}})(?=.)", "$1\n")


def read_alignments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SAM text or Parquet. Positions 0-based; cigar and qual as arrays; tags NM and SA."""
    first = path if isinstance(path, str) else path[0]
    if first.endswith(".parquet"):
        return spark.read.parquet(*([path] if isinstance(path, str) else path))
    c = F.split("value", "\t")
    tags = F.slice(c, 12, F.greatest(F.size(c) - 11, F.lit(0)))
    tag = lambda k: F.get(F.transform(F.filter(tags, lambda x: F.startswith(x, F.lit(k))), lambda x: F.substring(x, F.lit(6), F.length(x))), F.lit(0))
    rows = spark.read.text(path).filter(~F.startswith("value", F.lit("@")) & (F.size(c) >= 11))
    mate = F.when(c[6] == "=", c[2]).otherwise(c[6])
    qual = F.when(c[10] == "*", F.array().cast("array<int>")).otherwise(F.transform(F.split(c[10], ""), lambda x: F.ascii(x) - 33))
    return rows.select(
        c[0].alias("read_name"), c[1].cast("int").alias("flag"), c[2].alias("chrom"), (c[3].cast("int") - 1).alias("pos"), c[4].cast("int").alias("mapq"), cigar.parse(c[5]).alias("cigar"), mate.alias("mate_chrom"),
        (c[7].cast("int") - 1).alias("mate_pos"), c[8].cast("int").alias("isize"), c[9].alias("seq"), qual.alias("qual"), tag("NM:i:").cast("int").alias("nm"), tag("SA:Z:").alias("sa"),
    )


def read_repeatmasker(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Annotations of repeats; header lines and lines of fewer than 15 fields drop out. Positions 1-based as read."""
    c = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(c[0].rlike(r"^\d+$") & (F.size(c) >= 15))
    number = lambda i: F.regexp_replace(c[i], "[()]", "").try_cast("int")
    return rows.select(c[0].cast("int").alias("score"), *(c[i].try_cast("double").alias(k) for i, k in ((1, "diverged"), (2, "deleted"), (3, "inserted"))), c[4].alias("name"), number(5).alias("st"), number(6).alias("ed"), number(7).alias("left"), c[8].alias("strand"), c[9].alias("repeat"), c[10].alias("class"), number(11).alias("r_st"), number(12).alias("r_ed"), number(13).alias("r_left"), c[14].alias("rm_id"))


def read_trf(spark: SparkSession, path: str | list[str], least: int = 30, zero_based: bool = True) -> DataFrame:
    """Tandem repeats: a line `@name` opens a block of lines of 17 fields and more. Spans under `least` drop out."""
    c = F.split(F.trim("value"), r"\s+")
    shift = 1 if zero_based else 0
    lines = records(spark, path, F.col("value").startswith("@"), F.lit(0)).filter(F.col("header").isNotNull() & (F.size(c) >= 17))
    name = F.regexp_extract("header", r"^@(\S*)", 1).alias("name")
    rows = lines.select(name, (c[0].cast("int") - shift).alias("st"), (c[1].cast("int") - shift).alias("ed"), c[2].cast("int").alias("period"), c[3].cast("double").alias("copies"), c[4].cast("int").alias("motif_size"), c[13].alias("motif"), c[14].alias("repeat_seq"))
    return rows.filter(F.col("ed") - F.col("st") >= least)


def extend_trf(trf: DataFrame, contigs: DataFrame, edge: int = 10) -> DataFrame:
    """Spans longer by `edge` on both sides, within the contig (name, length)."""
    return trf.join(contigs.select("name", F.col("length").alias("_n")), "name").withColumn("st", F.greatest(F.lit(0), F.col("st") - edge)).withColumn("ed", F.least("_n", F.col("ed") + edge)).drop("_n")


def read_force_contigs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Local contigs: region, contig id (CI), supporting reads, whether final, and sequence; failure lines drop out."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(F.size(c) >= 5)
    field = lambda k: F.regexp_extract("value", rf"(?:^|[\t:;]){k}[=:]([^\t:;]+)", 1)
    names = F.split(F.regexp_extract(c[2], r"^([A-Z:]+)=", 1), ":")
    values = F.split(F.regexp_replace(c[2], r"^[A-Z:]+=", ""), ":")
    gt = F.when(F.size(names) == F.size(values), F.map_from_arrays(names, values))
    region = F.regexp_extract("value", r"REF_REGION=([^\t]+)", 1)
    return rows.select(region.alias("region"), F.regexp_extract("value", r"STAT=([^\t]+)", 1).alias("stat"), F.coalesce(F.try_element_at(gt, F.lit("CI")), field("CI")).alias("contig"), field("SUP_R").try_cast("int").alias("support"), field("IS_FINAL").alias("is_final"), F.regexp_extract("value", r"CONTIG_STR=([A-Za-z]+)", 1).alias("seq"), "file")


def well_supported(contigs: DataFrame, more_than: int = 1) -> DataFrame:
    return contigs.filter(F.col("support") > more_than)


def write_contigs_by_region(contigs: DataFrame, reference: DataFrame, path: str) -> None:
    """FASTA folders by region: the reference first, then `sample_region_contig`."""
    ref = reference.select("region", F.lit(0).alias("_k"), F.concat(F.lit("ref"), "region").alias("name"), "seq")
    own = contigs.select("region", F.lit(1).alias("_k"), F.concat_ws("_", "sample", "region", "contig").alias("name"), "seq")
    rows = ref.unionByName(own).repartition("region").sortWithinPartitions("region", "_k", "name")
    rows.select("region", F.concat(F.lit(">"), "name", F.lit("\n"), folded(F.col("seq"))).alias("value")).write.partitionBy("region").text(path)


def read_local_repeat(spark: SparkSession, path: str, least_k: int = 0) -> DataFrame:
    """chrom, pos, k of the repeat index; its first line holds `length step 0`."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).filter((F.size(c) >= 3) & c[0].rlike(r"^\S+$") & (c[2] != "0")).select(c[0].alias("chrom"), c[1].try_cast("int").alias("pos"), c[2].try_cast("int").alias("k"))
    return rows.filter((F.col("k") >= max(least_k, 1)) & F.col("pos").isNotNull())


def local_repeat_index(chunks: DataFrame, length: int = 600, step: int = 300, size: int = 100_000) -> DataFrame:
    """The repeat index of a reference `(chrom, pos, k)`: for whole windows of `length` every `step` the largest k with a
    repeated k-mer. chunks: as `chunked` cuts them, of `size` (at least `length`); windows may reach into the next chunk."""
    behind = chunks.select("chrom", (F.col("chunk") - 1).alias("chunk"), F.substring("seq", F.lit(1), F.lit(length)).alias("_more"))
    rows = chunks.join(behind, ["chrom", "chunk"], "left").withColumn("_text", F.concat("seq", F.coalesce("_more", F.lit("")))).withColumn("_at", F.col("chunk").cast("long") * size)
    last = F.least(F.length("seq") - 1, F.length("_text") - length) + F.col("_at")
    first = (F.floor((F.col("_at") + step - 1) / step) * step).cast("long")
    rows = rows.filter(first <= last).select("chrom", "_at", "_text", F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias("pos"))
    return rows.select("chrom", "pos", max_repeat_k(F.substring("_text", (F.col("pos") - F.col("_at") + 1).cast("int"), F.lit(length))).alias("k")).filter("k > 0")


def write_local_repeat(index: DataFrame, path: str, length: int = 600, step: int = 300) -> None:
    """The index as `read_local_repeat` takes it; the line of its settings is the first part's first."""
    spark = index.sparkSession
    head = spark.createDataFrame([("", -1, f"{length}\t{step}\t0")], "chrom string, pos long, value string")
    rows = head.unionByName(index.select("chrom", F.col("pos").cast("long").alias("pos"), F.concat_ws("\t", "chrom", "pos", "k").alias("value")))
    rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "chrom", "pos").sortWithinPartitions("chrom", "pos").select("value").write.text(path)


def read_isize_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def write_isize_json(stats: DataFrame, path: str) -> None:
    stats.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def read_features(spark: SparkSession, path: str | list[str], gff: bool | None = None) -> DataFrame:
    """GFF3 or GTF, gzip or plain: chrom, source, type, st, ed, score, strand, phase, attributes. GFF names get `chr`."""
    first = path if isinstance(path, str) else path[0]
    gff = ".gff" in first if gff is None else gff
    c = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.startswith("value", F.lit("#")) & (F.size(c) >= 9))
    chrom = F.when(F.startswith(c[0], F.lit("chr")) | F.lit(not gff), c[0]).otherwise(F.concat(F.lit("chr"), c[0]))
    return rows.select(chrom.alias("chrom"), c[1].alias("source"), c[2].alias("type"), c[3].try_cast("int").alias("st"), c[4].try_cast("int").alias("ed"), c[5].alias("score"), c[6].alias("strand"), c[7].alias("phase"), c[8].alias("attributes"))


def read_mei_regions(spark: SparkSession, path: str) -> DataFrame:
    """Lines `chr_st_ed`."""
    part = F.split("value", "_")
    return spark.read.text(path).filter(F.size(part) == 3).select(F.col("value").alias("name"), part[0].alias("chrom"), part[1].cast("int").alias("st"), part[2].cast("int").alias("ed"))


def read_kmer_profile(spark: SparkSession, path: str) -> DataFrame:
    """k-mer and its probability, below a header line."""
    c = F.split("value", "\t")
    return spark.read.text(path).filter(c[0].rlike("^[ACGT]+$") & (F.size(c) >= 2)).select(c[0].alias("kmer"), c[1].try_cast("double").alias("prob")).filter("prob is not null")


def read_file_list(spark: SparkSession, path: str) -> list[str]:
    """The paths that a small text file lists, one in each line."""
    return [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]


def read_wigfix(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom, pos (0-based) and value of each base; a `fixedStep` line opens a block that starts at its `start`."""
    filled = (F.trim("value") != "").cast("int")
    rows = records(spark, path, F.col("value").startswith("fixedStep"), filled).filter(F.col("header").isNotNull() & (filled == 1))
    head = lambda k: F.regexp_extract("header", rf"{k}=(\S+)", 1)
    place = head("start").cast("int") - 1 + F.col("before") * F.coalesce(head("step").try_cast("int"), F.lit(1))
    return rows.select(head("chrom").alias("chrom"), place.cast("long").alias("pos"), F.col("value").try_cast("double").alias("value"))
