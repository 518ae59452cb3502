"""Files of records that open with a header line, read by blocks of lines.

A task reads the lines of its block of the file; headers are carried down inside each piece of a block, and what the last
header of a piece says passes on to the pieces behind it, one row for each. So a record of any size is read by as many tasks
as it has pieces. Only a single line is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A block's lines are taken in pieces of 2^16, each a group of its own.
PIECE = 16


def records(spark: SparkSession, path: str | list[str], header: Column, measure: Column) -> DataFrame:
    """`(file, header, before, value)` of each line that is no header: the header that it stands under (null before the
    first), and the sum of `measure` over the lines of its record before it. Both are columns of `value`."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    rows = rows.withColumn("piece", F.shiftright("n", PIECE))
    rows = rows.withColumn("h", F.when(header, F.col("value"))).withColumn("m", F.when(F.col("h").isNull(), measure).otherwise(0).cast("long"))
    inside = Window.partitionBy("file", "block", "piece").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.count("h").over(inside)).withColumn("own", F.last("h", ignorenulls=True).over(inside))
    rows = rows.withColumn("upto", F.sum("m").over(Window.partitionBy("file", "block", "piece", "run").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))

    runs = rows.groupBy("file", "block", "piece", "run").agg(F.sum("m").alias("m"), F.first("own", ignorenulls=True).alias("own"))
    blocks = runs.groupBy("file", "block", "piece").agg(F.max_by("m", "run").alias("tail"), F.max_by("own", "run").alias("last"))
    by = Window.partitionBy("file").orderBy("block", "piece")
    blocks = blocks.withColumn("segment", F.count("last").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.sum("tail").over(Window.partitionBy("file", "segment").orderBy("block", "piece").rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.withColumn("total", total).select("file", "block", "piece", F.lag("total", 1, 0).over(by).alias("passed"), F.last("last", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))

    rows = rows.filter("h is null").join(blocks, ["file", "block", "piece"])
    before = F.col("upto") - F.col("m") + F.when(F.col("run") == 0, F.col("passed")).otherwise(0)
    return rows.select("file", F.coalesce("own", "carried").alias("header"), before.alias("before"), "value")


def fasta_chunks(spark: SparkSession, path: str | list[str], size: int = 100_000) -> DataFrame:
    """Sequences cut to chunks `(chrom, chunk, seq)` of `size` letters, as `regions.chunked` gives, from lines: no record is
    ever whole. A chunk gathers its own letters alone."""
    letters = F.regexp_replace("value", r"\s", "")
    lines = records(spark, path, F.col("value").startswith(">"), F.length(letters)).filter("header is not null").withColumn("s", letters).filter("s <> ''")
    named = lines.select(F.regexp_extract("header", r"^>(\S*)", 1).alias("chrom"), F.col("before").alias("at"), "s")
    first, last = F.floor(F.col("at") / size), F.floor((F.col("at") + F.length("s") - 1) / size)
    cut = named.withColumn("chunk", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    begin = F.greatest(F.col("chunk") * size, F.col("at"))
    piece = F.substring("s", (begin - F.col("at") + 1).cast("int"), ((F.col("chunk") + 1) * size - begin).cast("int"))
    parts = cut.select("chrom", "chunk", F.struct(begin.alias("at"), piece.alias("s")).alias("p")).groupBy("chrom", "chunk").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return parts.select("chrom", "chunk", F.array_join(F.col("p.s"), "").alias("seq"))


def sequence_lengths(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`(name, length)` of each FASTA record with letters."""
    n = F.length(F.regexp_replace("value", r"\s", ""))
    lines = records(spark, path, F.col("value").startswith(">"), n).filter("header is not null")
    return lines.groupBy(F.regexp_extract("header", r"^>(\S*)", 1).alias("name")).agg(F.sum(n).alias("length"))
