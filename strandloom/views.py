"""Projections of plain business tables onto intervals, variants, reads and sequences, and the same in SQL.

The driver's tables hold no genomics; integer arithmetic makes positions from keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ID = "(((l_orderkey * 10 + l_linenumber) * 200000 + l_partkey) * 10000 + l_suppkey) * 64 + CAST(l_quantity AS INT)"
#: The same in Spark at any size: keys past 2^57 go on from 0 instead of overflowing, so ids stay long and not negative.
_TURNED = "shiftleft((((l_orderkey * 10 + l_linenumber) * 200000 + l_partkey) * 10000 + l_suppkey) & 144115188075855871L, 6) + CAST(l_quantity AS INT)"
_START = "(l_orderkey * 1297 + l_linenumber * 10133) % 20000000"
#: Chromosomes: eight for each 15,000 orders, so that they grow in number with the tables and not in density.
_EIGHT = "CAST(floor({} / 15000) AS BIGINT) * 8"
_CHROM, _PLACE = f"({_EIGHT.format('l_orderkey')} + l_suppkey % 8)", f"({_EIGHT.format('o_orderkey')} + o_custkey % 8)"

#: Each view as a SELECT that Spark and DuckDB both run; {t} is the source table.
SELECTS = {
    "iv": ("lineitem", f"SELECT {_ID} AS id, {_CHROM} AS chrom, {_START} AS st, {_START} + CAST(l_quantity AS INT) * 20 AS ed, l_partkey AS name, l_suppkey % 40 AS sample, l_linenumber % 2 AS hap, l_returnflag AS type FROM {{t}}"),
    "rg": ("orders", f"SELECT o_orderkey AS id, {_PLACE} AS chrom, (o_orderkey * 1311) % 20000000 AS st, (o_orderkey * 1311) % 20000000 + 200 + o_orderkey % 800 AS ed, o_custkey AS name, o_orderpriority AS type FROM {{t}}"),
    "sv": ("lineitem", f"""SELECT {_ID} AS id, {_CHROM} AS chrom, {_START} AS pos, CAST(l_quantity AS INT) * 8 - 200 AS svlen,
        CASE WHEN CAST(l_quantity AS INT) * 8 < 200 THEN 'DEL' ELSE 'INS' END AS svtype, l_suppkey % 40 AS sample, l_linenumber % 2 AS hap,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS a1, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS a2,
        CAST(l_linenumber AS BIGINT) AS ref_n, CAST(CAST(l_quantity AS INT) % 13 AS BIGINT) AS alt_n, l_partkey % 7 AS unknown_n FROM {{t}}"""),
    "al": ("lineitem", f"""SELECT {_ID} AS id, CAST({_ID} AS STRING) AS read_name, CAST((l_partkey * 37 + l_linenumber * 411) % 4096 AS INT) AS flag, {_CHROM} AS chrom, CAST({_START} AS INT) AS pos, CAST(l_partkey % 61 AS INT) AS mapq,
        {_EIGHT.format('l_orderkey')} + (l_suppkey + CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE 0 END) % 8 AS mate_chrom, CAST({_START} + (l_partkey % 5 - 2) * 4000 AS INT) AS mate_pos, CAST((l_partkey % 5 - 2) * 4000 + 150 AS INT) AS isize, CAST(l_partkey % 7 AS INT) AS nm, CAST(l_quantity AS INT) AS q, CAST(l_linenumber AS INT) AS ln,
        concat(CAST(10 + CAST(l_quantity AS INT) AS STRING), '=', CAST(l_linenumber AS STRING), 'X', CAST(5 + CAST(l_quantity AS INT) % 40 AS STRING), 'I30=', CAST(1 + CAST(l_quantity AS INT) * 3 % 60 AS STRING), 'D20=', CAST(l_linenumber * 300 AS STRING), 'S') AS cigar_text FROM {{t}}"""),
    "ev": ("events", "SELECT event_id AS id, user_id AS read, event_type AS op, value FROM {t}"),
    "seq": ("documents", "SELECT doc_id AS id, translate(lower(regexp_replace(text, '[^A-Za-z]', ''G)), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS s FROM {t}"),
}


def sql(name: str) -> str:
    """The view for DuckDB, in brackets."""
    table, select = SELECTS[name]
    return "(" + select.format(t=table).replace("''G", "'', 'g'") + ")"


def in_spark(expression: str) -> str:
    """An expression of the views' SQL as Spark computes it, without overflow of ids."""
    return expression.replace(_ID, _TURNED)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, select = SELECTS[name]
    if name == "ev":
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr("event_id AS id", "user_id AS read", "event_type AS op", "value", "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) AS pos")
    select = select.replace("[^A-Za-z]'", "[^A-Za-z]+'")  # the same letters, with one match for each gap
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(in_spark(select).format(t="{t}").replace("''G", "''"), t=source)
