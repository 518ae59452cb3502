"""Queries of the differences between contigs: places on the reference, mismatch regions, nested differences, classes.

Each order is a region, each of its lines a contig with an alignment to the region's reference, contig 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom import views
from strandloom.functions import cigar as cg
from strandloom.operators import contigs, differences
from strandloom.tables import kept

_ID = f"({views._ID})"
_SPARK_ID = views.in_spark(_ID)
_LENGTHS = ["30 + CAST(l_quantity AS INT)", "1 + l_linenumber % 3", "5 + CAST(l_quantity AS INT) % 40", "40 + l_partkey % 50", "1 + CAST(l_quantity AS INT) * 3 % 60", "20 + l_suppkey % 60", "1 + l_partkey % 2", "53"]
_OPS = "MXIMDMXM"
_STEPS = ", ".join(f"{{'k': {k}, 'op': '{op}', 'len': {n}}}" for k, (op, n) in enumerate(zip(_OPS, _LENGTHS)))

#: All bases of all alignments: i among them, r on the reference, q in the contig.
BASES = f"""o AS (SELECT l_orderkey AS region, {_ID} AS contig, unnest([{_STEPS}]) AS s FROM lineitem),
    e AS (SELECT region, contig, s.k AS k, s.op AS op, s.len::BIGINT AS len, sum(s.len) OVER w - s.len AS i0, sum(CASE WHEN s.op = 'I' THEN 0 ELSE s.len END) OVER w - CASE WHEN s.op = 'I' THEN 0 ELSE s.len END AS r0,
        sum(CASE WHEN s.op = 'D' THEN 0 ELSE s.len END) OVER w - CASE WHEN s.op = 'D' THEN 0 ELSE s.len END AS q0 FROM o WINDOW w AS (PARTITION BY region, contig ORDER BY s.k)),
    b AS (SELECT region, contig, op, len, (i0 + j)::BIGINT AS i, (r0 + CASE WHEN op = 'I' THEN 0 ELSE j END)::BIGINT AS r, (q0 + CASE WHEN op = 'D' THEN 0 ELSE j END)::BIGINT AS q FROM (SELECT *, unnest(generate_series(0, len - 1)) AS j FROM e))"""

_SV = [
    "l_orderkey AS region", f"{_ID} AS id", f"CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE min({_ID}) OVER (PARTITION BY l_orderkey) END AS a_contig", f"{_ID} AS b_contig",
    "l_partkey * 7 % 150 AS a_pos", "(l_suppkey * 13 + l_partkey) % 150 AS b_pos", "CASE WHEN l_partkey % 2 = 0 THEN 'INS' ELSE 'DEL' END AS type", "1 + l_partkey % 40 AS length",
]


def alignments(read, text: bool = False) -> DataFrame:
    steps = ", ".join(f"CAST({n} AS INT), '{'=' if op == 'M' else op}'" for op, n in zip(_OPS, _LENGTHS))
    return read("lineitem").selectExpr("l_orderkey AS region", f"{_SPARK_ID} AS contig", f"concat({steps}) AS text").select("region", "contig", cg.parse("text").alias("cigar"), *(["text"] if text else []))


def placed(read) -> DataFrame:
    return differences.reference_places(read("lineitem").selectExpr(*map(views.in_spark, _SV)), alignments(read), 0)


REFERENCE_PLACES = f"""WITH {BASES}, v AS (SELECT {", ".join(_SV)} FROM lineitem),
    s AS (SELECT *, CASE WHEN type = 'INS' THEN a_contig ELSE b_contig END AS bc, CASE WHEN type = 'INS' THEN a_pos ELSE b_pos END AS bp, CASE WHEN type = 'INS' THEN b_contig ELSE a_contig END AS ic, CASE WHEN type = 'INS' THEN b_pos ELSE a_pos END AS st FROM v)
    SELECT s.id, CASE WHEN ic = 0 THEN st WHEN bc = 0 THEN bp ELSE x.r END AS base_ref, coalesce(ic <> 0 AND x.op = 'I', false) AS base_is_insert, CASE WHEN ic <> 0 AND x.op = 'I' THEN x.len ELSE 0 END AS event,
        CASE WHEN ic = 0 THEN st ELSE y.r END AS insert_ref, CASE WHEN ic = 0 THEN st + s.length ELSE z.r END AS insert_ref_end
    FROM s LEFT JOIN (SELECT * FROM b WHERE op <> 'D') x ON x.region = s.region AND x.contig = bc AND x.q = bp LEFT JOIN (SELECT * FROM b WHERE op <> 'D') y ON y.region = s.region AND y.contig = ic AND y.q = st
        LEFT JOIN (SELECT * FROM b WHERE op <> 'D') z ON z.region = s.region AND z.contig = ic AND z.q = st + s.length"""

MISMATCH_REGIONS = f"""WITH {BASES}, w AS (SELECT *, sum((op = 'M')::INT) OVER (PARTITION BY region, contig ORDER BY i ROWS 50 PRECEDING) AS back, sum((op = 'M')::INT) OVER (PARTITION BY region, contig ORDER BY i ROWS BETWEEN CURRENT ROW AND 50 FOLLOWING) AS ahead, lag(op) OVER (PARTITION BY region, contig ORDER BY i) AS before FROM b),
    p AS (SELECT l_orderkey AS region, {_ID} AS contig, (l_partkey * 11 + l_suppkey * 3) % 330 AS r FROM lineitem), t AS (SELECT p.region, p.contig, p.r, min(b.i) AS x FROM p LEFT JOIN b ON b.region = p.region AND b.contig = p.contig AND b.r = p.r GROUP BY ALL),
    h AS (SELECT t.region, t.contig, t.r, x, coalesce(max(w.i) FILTER (back = 51 AND w.i < x) + 1, 0) AS lo, coalesce(min(w.i) FILTER (ahead = 51 AND w.i > x) - 1, max(w.i)) AS hi FROM t JOIN w ON w.region = t.region AND w.contig = t.contig WHERE x IS NOT NULL GROUP BY ALL),
    g AS (SELECT h.region, h.contig, h.r, min(w.r) AS lo, max(w.r) AS hi, count_if(w.op IN ('I', 'D') AND (w.i = h.lo OR w.before <> w.op)) AS gaps, count_if(w.op = 'X') AS mismatches, count_if(w.op = 'M') AS matches FROM h JOIN w ON w.region = h.region AND w.contig = h.contig AND w.i BETWEEN h.lo AND h.hi GROUP BY ALL)
    SELECT t.contig, t.r, g.lo, g.hi, gaps, mismatches, matches, round((gaps + mismatches) / (gaps + mismatches + matches)::DOUBLE, 6) AS rate, (g.hi - g.lo > 100 AND (gaps + mismatches) / (gaps + mismatches + matches)::DOUBLE > 0.1)::INT AS many
    FROM t LEFT JOIN g ON g.region = t.region AND g.contig = t.contig AND g.r = t.r"""


_SEQUENCE = "translate({}, '0123456789abcdef', 'ACGTACGTACGTACGT')"
_MOTIF = "repeat(substring(sha256(l_orderkey::VARCHAR), 1, 11), 30)"
_MIXED = " || ".join(f"sha256(({_ID} + {k})::VARCHAR)" for k in range(5))
_OVERLAP = "greatest(0, least({}, length) - greatest({}, 0))"

DIFFERENCE_CLASSES = f"""WITH {BASES}, v AS (SELECT {", ".join(_SV)} FROM lineitem),
    s AS (SELECT *, CASE WHEN type = 'INS' THEN a_contig ELSE b_contig END AS bc, CASE WHEN type = 'INS' THEN a_pos ELSE b_pos END AS bp, CASE WHEN type = 'INS' THEN b_contig ELSE a_contig END AS ic, CASE WHEN type = 'INS' THEN b_pos ELSE a_pos END AS st FROM v),
    p AS (SELECT s.*, CASE WHEN ic = 0 THEN st WHEN bc = 0 THEN bp ELSE x.r END AS base_ref FROM s LEFT JOIN (SELECT * FROM b WHERE op <> 'D') x ON x.region = s.region AND x.contig = bc AND x.q = bp),
    k AS (SELECT region, greatest(0, st) AS st, least(329, ed) AS ed FROM (SELECT l_orderkey AS region, l_partkey * 5 % 330 - 10 AS st, l_partkey * 5 % 330 + l_suppkey % 30 + 10 AS ed FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey * 17 % 330, l_suppkey * 17 % 330 + 9 FROM lineitem WHERE l_returnflag = 'R') WHERE greatest(0, st) <= least(329, ed)),
    f AS (SELECT *, max(ed) OVER (PARTITION BY region ORDER BY st, ed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM k), g AS (SELECT *, sum(CASE WHEN st - far <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY region ORDER BY st, ed ROWS UNBOUNDED PRECEDING) AS i FROM f),
    r AS (SELECT region, min(st) AS rst, max(ed) AS red, row_number() OVER (PARTITION BY region ORDER BY min(st)) - 1 AS k FROM g GROUP BY region, i),
    n AS (SELECT p.id, max(k) FILTER (base_ref BETWEEN rst AND red) AS own, count(*) FILTER (red < base_ref) - coalesce((min(rst) = 0)::INT, 0) AS gap, min(least(abs(base_ref - rst), abs(base_ref - red))) AS far, min_by({{'st': rst, 'ed': red}}, least(abs(base_ref - rst), abs(base_ref - red)) * 1000 + k) AS near FROM p LEFT JOIN r ON r.region = p.region WHERE base_ref BETWEEN 0 AND 329 GROUP BY p.id),
    q AS (SELECT l_orderkey AS region, {_ID} AS ic, {_SEQUENCE.format(f"CASE WHEN l_linenumber % 2 = 0 THEN {_MOTIF} ELSE {_MIXED} END")} AS seq, l_partkey % 120 AS ms, l_returnflag AS kind, l_suppkey % 90 AS ts, l_suppkey % 90 + 20 + l_partkey % 90 AS te, 3 + l_partkey % 60 AS unit, 1.5 + l_linenumber AS copies FROM lineitem),
    w AS (SELECT DISTINCT l_orderkey AS region, {_SEQUENCE.format(_MOTIF)} AS ref FROM lineitem),
    a AS (SELECT p.id, p.length, p.base_ref, p.st, n.own, n.gap, n.far, n.near, w.ref, CASE WHEN p.ic = 0 THEN w.ref ELSE q.seq END AS seq, q.unit, q.copies, q.ts, q.te, q.kind, q.ms - p.st AS rs, q.ms + 30 - p.st AS re, CASE WHEN q.te > p.st AND q.ts < p.st + p.length THEN q.ts - p.st END AS t1, CASE WHEN q.te > p.st AND q.ts < p.st + p.length THEN q.te - p.st END AS t2, q.ms + 30 > p.st AND q.ms < p.st + p.length AS hit
        FROM p LEFT JOIN n ON n.id = p.id LEFT JOIN q ON q.region = p.region AND q.ic = p.ic LEFT JOIN w ON w.region = p.region),
    l AS (SELECT *, CASE WHEN t1 IS NULL THEN 0 ELSE {_OVERLAP.format("t2", "t1")} END AS tl, CASE WHEN hit THEN {_OVERLAP.format("re", "rs")} ELSE 0 END AS rl, CASE WHEN hit AND t1 IS NOT NULL THEN {_OVERLAP.format("least(t2, re)", "greatest(t1, rs)")} ELSE 0 END AS tr,
        CASE WHEN t1 IS NOT NULL AND unit < 6 THEN greatest(0, least(t2, re) - greatest(t1, rs)) ELSE 0 END AS cover FROM a),
    m AS (SELECT *, CASE WHEN kind = 'R' THEN tl + rl - tr WHEN hit AND cover < 0.8 * 30 THEN tl - tr ELSE tl END AS vntr FROM l),
    c AS (SELECT *, own IS NOT NULL AS in_vntr, (length - vntr > 200 OR length - vntr > 0.2 * length) AS fresh, CASE WHEN own IS NULL AND near.st IS NOT NULL THEN far END AS vntr_distance FROM m)
    SELECT id, base_ref, in_vntr, CASE WHEN own IS NOT NULL THEN own WHEN base_ref BETWEEN 0 AND 329 THEN gap END AS run, vntr_distance, vntr, length, CASE WHEN in_vntr AND NOT fresh THEN 1 WHEN in_vntr THEN 2 WHEN fresh THEN 4
        WHEN vntr_distance > 0 AND vntr_distance < 30 AND len(list_filter(range(st + 1, least(st + length, length(seq)) - 8), lambda i: contains(substring(ref, near.st + 1, near.ed - near.st + 1), substring(seq, i, 10)))) >= 5 THEN 1
        WHEN ts - 10 <= st AND te + 10 >= st + length AND unit >= 50 AND copies <= 2.5 THEN 4 ELSE 3 END AS class FROM c"""


def reference_places(read) -> DataFrame:
    return placed(read).select("id", "base_ref", "base_is_insert", "event", "insert_ref", "insert_ref_end")


def mismatch_regions(read) -> DataFrame:
    points = read("lineitem").selectExpr("l_orderkey AS region", f"{_SPARK_ID} AS contig", "(l_partkey * 11 + l_suppkey * 3) % 330 AS r")
    out = differences.mismatch_regions(alignments(read), points)
    return out.select("contig", "r", "lo", "hi", "gaps", "mismatches", "matches", F.round("rate", 6).alias("rate"), F.col("many").cast("int").alias("many"))


def nested_differences(read) -> DataFrame:
    """Nested differences with their three mismatch regions; the contigs' own alignment stands for that of a pair."""
    own = alignments(read)
    operations = differences.operations(own).filter("op = 'I'")
    inserts = operations.selectExpr("region", "contig", "q AS insert_st", "q + len AS insert_ed", "r AS ref")
    rows = kept(placed(read).filter("base_is_insert"), "placed")  # the others aren't nested
    texts = alignments(read, True).select("region", F.col("contig").alias("b_contig"), "text")  # shorter than what is parsed from them
    pairs = rows.select("region", "a_contig", "b_contig").distinct().join(texts, ["region", "b_contig"]).withColumn("cigar", cg.parse("text"))
    out = differences.nested_report(rows, pairs, own, inserts)
    return out.select("id", "base_ref", "event", "insert_ref", "insert_ref_end", "outer_ref", "in_pair", "in_base", "in_insert", "many")


def difference_classes(read) -> DataFrame:
    """Differences of contigs to their classes, with repeats of the reference and of the contigs made from the lines."""
    lines = read("lineitem")
    reference = lines.groupBy(F.col("l_orderkey").alias("name")).agg(F.lit(330).alias("length"))
    tandem = lines.selectExpr("l_orderkey AS name", "l_partkey * 5 % 330 AS st", "l_partkey * 5 % 330 + l_suppkey % 30 AS ed")
    simple = lines.selectExpr("l_orderkey AS name", "l_suppkey * 17 % 330 AS st", "l_suppkey * 17 % 330 + 9 AS ed", "IF(l_returnflag = 'R', 'Simple_repeat', 'LINE/L1') AS class")
    runs = contigs.vntr_runs(reference, simple, tandem).select(F.col("name").alias("region"), "st", "ed", "vntr")
    rm = lines.selectExpr("l_orderkey AS region", f"{_SPARK_ID} AS contig", "l_partkey % 120 AS st", "l_partkey % 120 + 30 AS ed", "CASE l_returnflag WHEN 'R' THEN 'Simple_repeat' WHEN 'A' THEN 'LINE/L1' ELSE 'SINE/Alu' END AS class")
    trf = lines.selectExpr("l_orderkey AS region", f"{_SPARK_ID} AS contig", "l_suppkey % 90 AS st", "l_suppkey % 90 + 20 + l_partkey % 90 AS ed", "3 + l_partkey % 60 AS unit", "1.5 + l_linenumber AS copies")
    # a contig's letters hang on its id, its region and its line, so these are joined and not the letters
    sequences = lines.selectExpr("l_orderkey AS region", f"{_SPARK_ID} AS contig", "l_linenumber % 2 = 0 AS even")
    refs = lines.select("l_orderkey").distinct().selectExpr("l_orderkey AS region", "0L AS contig", "true AS even")

    def letters(x):
        motif = F.repeat(F.substring(F.sha2(x["region"].cast("string"), 256), 1, 11), 30)
        mixed = F.concat(*(F.sha2((x["contig"] + k).cast("string"), 256) for k in range(5)))
        return F.translate(F.when(x["even"], motif).otherwise(mixed), "0123456789abcdef", "ACGTACGTACGTACGT")

    rows = kept(placed(read).select("id", "region", "insert_contig", "insert_st", "insert_ed", "length", "base_ref"), "placed")
    return differences.classified(rows, runs, rm, trf, sequences.unionByName(refs), 0, letters=letters).select("id", "base_ref", "in_vntr", "run", "vntr_distance", "vntr", "length", "class")
