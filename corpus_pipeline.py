"""A training corpus from raw documents: quality, near duplicates, personal data, mix, tokens.

Each stage takes `(spark, docs, sf_dir)` and works on all rows that the stage before it kept; `run` writes every stage's
result to the cluster's shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe, jaccard, mixing, pii, quality
from strandloom.llm.common import numbered, scratch, stored
from strandloom.llm.queries import tokenizer


# What holds for each stage: rows with a null id, null or empty text, repeated rows and an empty table are handled as the
# operator's docstring says; columns besides keep their names and values, whatever they are, and of equal names the first
# counts as id, text, source or n_chars.


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, and a rule besides: at most one symbol in ten words. Null, empty and short texts
    (under 50 words) go; repeated rows are judged each."""
    return quality.keep(docs, max_symbols=0.1)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at a similarity of 0.8. Of rows
    equal in id and text one stays; null ids come last, and of a group of one id one row stays too; texts without words link
    with nothing."""
    return jaccard.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by their kind; n_chars follows the text. No row goes; null text stays null."""
    out, names = pii.mask(docs), docs.columns
    flat = numbered(out)
    text = F.col(f"_c{names.index('text')}")
    return flat.withColumn(f"_c{names.index('n_chars')}", F.length(text).cast("long")).toDF(*names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them: never, once or twice. Null is a source; texts without words
    count 0 and go with their source's share; rows equal in id and text pool theirs."""
    return mixing.apply(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, a row for each row; null text has none."""
    return bpe.encode(docs, tokenizer()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", mask_personal_data),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: Not expressible in SQL (suffix arrays, cube method, BPE); tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):  # what a stage stored on its way is no longer needed
            docs = stored(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
