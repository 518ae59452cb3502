"""Registered queries of the variant operators, each with DuckDB SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import contig_queries, views
from strandloom.functions import cigar as cg
from strandloom.functions import intervals as iv
from strandloom.functions import sequence as sq
from strandloom.operators import cohort, context, contigs, folds, genotype, mei, reads, short_signals
from strandloom.operators import intervals as ops
from strandloom.plans import cohort as plan
from strandloom.sources import regions, variants
from strandloom.sources.records import fasta_chunks, sequence_lengths
from strandloom.tables import kept, new_folder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

IV, RG, SV, SEQ, AL = (views.sql(n) for n in ("iv", "rg", "sv", "seq", "al"))


def query(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """Registers `f(read)`, where read(view) is a view's DataFrame, with its SQL."""

    def add(f: Callable) -> Callable:
        _QUERIES[name] = lambda spark, sf_dir: f(lambda n: views.view(spark, sf_dir, n) if n in views.SELECTS else spark.read.parquet(f"{sf_dir}/{n}.parquet"))
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Intervals

OVERLAP = "a.chrom = b.chrom AND a.st <= b.ed AND b.st <= a.ed"


@query("interval_algebra", f"""SELECT a.id AS id, b.id AS other, least(a.ed, b.ed) - greatest(a.st, b.st) + 1 AS overlap, (a.st >= b.st AND a.ed <= b.ed) AS within,
    least(a.st, b.st) AS union_st, greatest(a.ed, b.ed) AS union_ed, round((least(a.ed, b.ed) - greatest(a.st, b.st) + 1) / greatest(a.ed - a.st + 1, b.ed - b.st + 1)::DOUBLE, 6) AS share
    FROM {IV} a JOIN {RG} b ON {OVERLAP}""")
def _(read):
    j = ops.overlap_join(read("iv"), read("rg"), 1000)
    a = [F.col(c) for c in ("st", "ed", "r_st", "r_ed")]
    both = iv.union(*a)
    return j.select("id", F.col("r_id").alias("other"), iv.overlap_length(*a).alias("overlap"), iv.within(*a).alias("within"), both["st"].alias("union_st"), both["ed"].alias("union_ed"), F.round(iv.overlap_share(*a), 6).alias("share"))


@query("containment_first", f"""SELECT a.id AS id, min(b.id) AS bed FROM {IV} a LEFT JOIN {RG} b ON a.chrom = b.chrom AND b.st <= a.st AND a.ed <= b.ed GROUP BY a.id""")
def _(read):
    return ops.containment_join(read("iv"), read("rg").withColumn("bed_order", F.col("id"))).select("id", F.col("r_id").alias("bed"))


@query("feature_overlap", f"""WITH p AS (SELECT DISTINCT a.name, b.type FROM {IV} a JOIN {RG} b ON {OVERLAP}), t AS (SELECT count(*) AS total FROM {IV} x),
    u AS (SELECT type, count(*) AS n FROM p GROUP BY type UNION ALL SELECT 'No overlap', (SELECT total FROM t) - (SELECT count(DISTINCT name) FROM p))
    SELECT type, n, round(100.0 * n / total, 2) AS percent FROM u, t""")
def _(read):
    return ops.feature_overlap(read("iv"), read("rg"), 1000)


_ENDS = " OR ".join(f"abs(a.{x} - b.{y}) <= 500" for x in ("st", "ed") for y in ("st", "ed"))


@query("near_variants", f"""SELECT DISTINCT a.id FROM {IV} a JOIN {IV} b ON a.sample = b.sample AND a.hap = b.hap AND a.chrom = b.chrom AND a.id <> b.id AND ({_ENDS})""")
def _(read):
    return ops.flag_near(read("iv")).select("id")


@query("variant_bins", f"""SELECT id, unnest(generate_series(greatest(st - 1, 0) // 500, (ed + 1) // 500)) * 500 AS bin FROM {IV} x""")
def _(read):
    return ops.sv_bins(read("iv")).select("id", "bin")


def _frequency_sql(source: str, least: int) -> str:
    return f"""WITH b AS (SELECT chrom, sample, hap, unnest(generate_series(greatest(st - 1, 0) // 500, (ed + 1) // 500)) * 500 AS bin FROM {source} x),
    c AS (SELECT chrom, bin, count(*) AS ac FROM (SELECT DISTINCT chrom, bin, sample, hap FROM b) GROUP BY chrom, bin HAVING count(*) >= {least}),
    m AS (SELECT *, CASE WHEN bin <= lag(bin) OVER w + 500 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY chrom ORDER BY bin)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY bin) AS island FROM m)
    SELECT chrom, min(bin) AS st, max(bin) + 500 AS ed, max(ac) AS max_ac, count(*) AS n_bins FROM g GROUP BY chrom, island"""


@query("bin_frequency", _frequency_sql(IV, 2))
def _(read):
    return ops.bin_frequency(ops.sv_bins(read("iv")), 2)


@query("csv_regions", _frequency_sql(f"(SELECT * FROM {IV} a WHERE EXISTS (SELECT 1 FROM {IV} b WHERE a.sample = b.sample AND a.hap = b.hap AND a.chrom = b.chrom AND a.id <> b.id AND ({_ENDS})))", 1))
def _(read):
    """The flagship: variants near each other, their bins, counted over haplotypes, merged to regions."""
    return plan.csv_regions(read("iv"), 1)


@query("bed_depth_runs", f"""WITH w AS (SELECT chrom, unnest(generate_series(st // 20, ed // 20)) AS w FROM {IV} x WHERE ed - st >= 100),
    d AS (SELECT chrom, w, count(*) AS n, CASE WHEN count(*) * 20 <= 40 THEN 1 ELSE 2 END AS level FROM w GROUP BY chrom, w),
    r AS (SELECT *, CASE WHEN w - lag(w) OVER o = 1 AND level = lag(level) OVER o THEN 0 ELSE 1 END AS new FROM d WINDOW o AS (PARTITION BY chrom ORDER BY w)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY w) AS run FROM r)
    SELECT chrom, level, min(w) * 20 AS st, (max(w) + 1) * 20 AS ed, count(*) AS windows, sum(n)::BIGINT AS total, round(sum(n) / count(*), 6) AS mean FROM g GROUP BY chrom, run, level HAVING (max(w) + 1) * 20 - min(w) * 20 >= 500""")
def _(read):
    return ops.merge_beds(read("iv"), 40).withColumn("mean", F.round("mean", 6))


def _island_sql(source: str, gap: int, keys: str = "chrom", extra: str = "") -> str:
    return f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY st, ed, id) AS k FROM {source} x), f AS (SELECT *, max(ed) OVER (PARTITION BY {keys} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM o),
    g AS (SELECT *, sum(CASE WHEN st - far <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY k ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT {keys}, min(st) AS st, max(ed) AS ed, count(*) AS n{extra} FROM g GROUP BY {keys}, island"""


@query("merge_regions", _island_sql(IV, 0))
def _(read):
    return ops.merge(read("iv"))


@query("merge_final", _island_sql(f"(SELECT *, 1 AS support FROM {IV} y)", 1200, "chrom", ", sum(support)::BIGINT AS support"))
def _(read):
    return folds.merge_final(read("iv").withColumn("support", F.lit(1)))


@query("gap_clusters", _island_sql(f"(SELECT chrom, pos AS st, pos AS ed, id FROM {SV} y)", 20))
def _(read):
    return ops.gap_clusters(read("sv"))


@query("coverage", f"""WITH c AS (SELECT a.id, greatest(a.st, b.st) AS st, least(a.ed, b.ed) AS ed FROM {RG} a JOIN {IV} b ON {OVERLAP}),
    f AS (SELECT *, max(ed) OVER (PARTITION BY id ORDER BY st, ed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM c),
    p AS (SELECT id, sum(greatest(0, ed - greatest(st, coalesce(far + 1, st)) + 1))::BIGINT AS covered, count(*) AS n FROM f GROUP BY id)
    SELECT a.id, coalesce(covered, 0) AS covered, coalesce(n, 0) AS n, round(100.0 * coalesce(covered, 0) / (ed - st + 1), 6) AS percent FROM {RG} a LEFT JOIN p USING (id)""")
def _(read):
    return ops.coverage(read("rg"), read("iv"), "id", 1000).select("id", "covered", "n", F.round("percent", 6).alias("percent"))


@query("covering_annotation", f"""SELECT a.id, count(b.id) AS n, coalesce(string_agg(greatest(a.st, b.st) || '-' || least(a.ed, b.ed), ',' ORDER BY greatest(a.st, b.st), least(a.ed, b.ed)) FILTER (WHERE b.id IS NOT NULL), '') AS covering FROM {RG} a LEFT JOIN {IV} b ON {OVERLAP} GROUP BY a.id""")
def _(read):
    spans = ops.covering(read("rg"), read("iv"), "id", 1000)
    return spans.select("id", F.size("covering").cast("long").alias("n"), F.array_join(F.transform("covering", lambda x: F.concat_ws("-", x["st"], x["ed"])), ",").alias("covering"))


@query("best_annotation", f"""SELECT id, annotation, overlap FROM (SELECT a.id AS id, b.id AS annotation, least(a.ed, b.ed) - greatest(a.st, b.st) AS overlap,
    row_number() OVER (PARTITION BY a.id ORDER BY least(a.ed, b.ed) - greatest(a.st, b.st) DESC, b.id) AS k FROM {RG} a JOIN {IV} b ON {OVERLAP} AND least(a.ed, b.ed) > greatest(a.st, b.st)) WHERE k = 1""")
def _(read):
    return ops.best_annotation(read("rg"), read("iv").withColumn("ann_order", F.col("id")), "id", "ann_order", 1000).select("id", F.col("r_id").alias("annotation"), "overlap")


@query("nearest_region", f"""SELECT id, target, distance FROM (SELECT p.id, t.id AS target, greatest(0, t.st - p.pos, p.pos - t.ed) AS distance,
    row_number() OVER (PARTITION BY p.id ORDER BY greatest(0, t.st - p.pos, p.pos - t.ed), t.id) AS k FROM (SELECT id, chrom, (id * 7919) % 20000000 AS pos FROM {RG} o) p JOIN {RG} t ON p.chrom = t.chrom) WHERE k = 1""")
def _(read):
    points = read("rg").selectExpr("id", "chrom", "(id * 7919) % 20000000 AS pos")
    return ops.nearest(points, read("rg")).select("id", "target", "distance")


@query("drop_near", f"""SELECT a.id FROM {RG} a WHERE NOT EXISTS (SELECT 1 FROM {IV} b WHERE a.chrom = b.chrom AND a.st - 300 <= b.ed AND b.st <= a.ed + 300)""")
def _(read):
    return ops.drop_near(read("rg"), read("iv"), 300).select("id")


@query("drop_overlapping_inversions", f"""SELECT a.id FROM {RG} a WHERE NOT EXISTS (SELECT 1 FROM {IV} b WHERE b.ed - b.st >= 50 AND a.chrom = b.chrom AND a.st - 50 <= b.ed AND b.st <= a.ed + 50)""")
def _(read):
    return ops.drop_near(read("rg"), read("iv").filter("ed - st >= 50"), 50).select("id")


@query("repeats_in", f"""SELECT r.id AS id, i.pos AS pos, i.k AS k FROM {RG} r JOIN (SELECT DISTINCT chrom, st // 100 * 100 AS pos, chrom * 20 AS k FROM {IV} x) i ON r.chrom = i.chrom AND i.pos BETWEEN r.st // 100 * 100 AND r.ed // 100 * 100 + 100""")
def _(read):
    index = read("iv").select("chrom", (ops.div(F.col("st"), 100) * 100).alias("pos"), (F.col("chrom") * 20).alias("k")).distinct()
    return ops.repeats_in(read("rg"), index, 100).select("id", "pos", "k")


@query("breakpoint_windows", f"""SELECT a.id AS id, (b.pos - a.st) // 10 AS "window", count(*) AS n FROM {RG} a JOIN {SV} b ON a.chrom = b.chrom AND b.pos BETWEEN a.st AND a.ed GROUP BY 1, 2""")
def _(read):
    return ops.breakpoint_windows(read("rg"), read("sv")).groupBy("id", "window").agg(F.count(F.lit(1)).alias("n"))


@query("high_confidence_blocks", f"""WITH m AS (SELECT DISTINCT chrom, unnest(generate_series(st, ed - 1, 100)) // 100 AS block FROM {RG} x), b AS (SELECT DISTINCT chrom, st // 100 AS block FROM {IV} y)
    SELECT b.chrom, b.block, m.block IS NOT NULL AS high FROM b LEFT JOIN m ON b.chrom = m.chrom AND b.block = m.block""")
def _(read):
    return ops.high_confidence_blocks(read("rg"), read("iv").select("chrom", ops.div(F.col("st"), 100).alias("block")).distinct())


@query("compare_calls", f"""WITH s AS (SELECT a.id, max((least(a.ed, b.ed) - greatest(a.st, b.st) + 1) / greatest(a.ed - a.st + 1, b.ed - b.st + 1)::DOUBLE) AS share FROM {IV} a JOIN {IV} b ON {OVERLAP} AND a.sample = b.sample AND a.type = b.type AND a.hap = 0 AND b.hap = 1 GROUP BY a.id)
    SELECT sample, type, chrom, count(*) AS n, count(*) FILTER (share > 0.9) AS over_90, count(*) FILTER (share > 0.5) AS over_50 FROM {IV} a LEFT JOIN s USING (id) WHERE hap = 0 GROUP BY sample, type, chrom""")
def _(read):
    return ops.compare_calls(read("iv").filter("hap = 0"), read("iv").filter("hap = 1"), width=1000)


@query("lift_over", f"""SELECT p.id AS id, b.chrom + 1 AS to_chrom, CASE WHEN b.id % 2 = 0 THEN b.st * 2 + b.ed - p.pos ELSE b.st * 2 + p.pos - b.st END AS to_pos FROM {SV} p JOIN {RG} b ON p.chrom = b.chrom AND p.pos BETWEEN b.st AND b.ed""")
def _(read):
    blocks = read("rg").selectExpr("chrom", "st", "ed", "chrom + 1 AS to_chrom", "st * 2 AS to_st", "CASE WHEN id % 2 = 0 THEN '-' ELSE '+' END AS strand")
    return ops.lift(read("sv"), blocks, 1000).select("id", "to_chrom", "to_pos")


# Sequences

KMERS = "list_transform(generate_series(1, length(s) - {k} + 1), lambda i: substring(s, i, {k}))"


@query("sequence_functions", f"""SELECT id, reverse(translate(s, 'ACGT', 'TGCA')) AS revcomp, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g')) AS collapsed,
    length(s) - length(replace(s, 'G', '')) AS g, greatest(length(s) - length(replace(s, 'A', '')), length(s) - length(replace(s, 'C', '')), length(s) - length(replace(s, 'G', '')), length(s) - length(replace(s, 'T', ''))) > 0.8 * length(s) + 1 AS low FROM {SEQ} x""")
def _(read):
    return read("seq").select("id", sq.revcomp("s").alias("revcomp"), sq.collapsed_length("s").cast("long").alias("collapsed"), sq.base_count("s", "G").cast("long").alias("g"), sq.low_complexity("s").alias("low"))


_GRID = [20, 60, 100]


@query("max_repeat_k", f"""SELECT id, greatest({", ".join(f"CASE WHEN length(s) >= {k} AND len(list_distinct({KMERS.format(k=k)})) < len({KMERS.format(k=k)}) THEN {k} ELSE 0 END" for k in _GRID)}) AS k FROM {SEQ} x""")
def _(read):
    return read("seq").select("id", sq.max_repeat_k("s", 20, 100, 40).alias("k"))


@query("shared_kmers", f"""WITH p AS (SELECT a.id, a.s AS a, b.s AS b FROM {SEQ} a JOIN {SEQ} b ON b.id = a.id + 1 WHERE length(a.s) >= 6 AND length(b.s) >= 6),
    x AS (SELECT id, unnest({KMERS.format(k=6).replace("s,", "a,").replace("(s)", "(a)")}) AS kmer FROM p), y AS (SELECT DISTINCT id, unnest({KMERS.format(k=6).replace("s,", "b,").replace("(s)", "(b)")}) AS kmer FROM p)
    SELECT p.id, count(y.kmer) AS n FROM p LEFT JOIN x ON p.id = x.id LEFT JOIN y ON x.id = y.id AND x.kmer = y.kmer GROUP BY p.id""")
def _(read):
    a = read("seq").filter("length(s) >= 6")
    b = a.select((F.col("id") - 1).alias("id"), F.col("s").alias("b"))
    return reads.shared_kmer_counts(a.withColumnRenamed("s", "a").join(b, "id"), 6)


@query("motif_support", f"""WITH s AS (SELECT id, s, substring(s, 1, 2) AS motif FROM {SEQ} x WHERE length(s) >= 2), h AS (SELECT *, list_filter(generate_series(1, length(s) - 1), lambda i: substring(s, i, 2) = motif) AS h FROM s),
    g AS (SELECT *, list_transform(generate_series(1, len(h) + 1), lambda i: CASE WHEN i <= len(h) THEN h[i] ELSE length(s) + 1 END - CASE WHEN i = 1 THEN -1 ELSE h[i - 1] END - 2) AS gaps FROM h),
    r AS (SELECT *, length(s) - coalesce(list_sum(list_filter(gaps, lambda x: x > 10)), 0)::BIGINT AS rest FROM g) SELECT id, len(h) AS n_hits, rest AS repeat_bases, (len(h) > 0 AND rest >= 30 AND 2 * rest > length(s)) AS supported FROM r""")
def _(read):
    return cohort.motif_support(read("seq").filter("length(s) >= 2").select("id", F.col("s").alias("seq"), F.substring("s", 1, 2).alias("motif"))).select("id", F.col("n_hits").cast("long").alias("n_hits"), F.col("repeat_bases").cast("long").alias("repeat_bases"), "supported")


# Genotypes

_GT = "CASE WHEN ref_n > 6 * alt_n THEN '0/0' WHEN 6 * ref_n < alt_n THEN CASE WHEN alt_n = 1 THEN '0/1' ELSE '1/1' END ELSE '0/1' END"
_SGT = "CASE WHEN alt_n < 2 OR unknown_n > 3 * (alt_n + ref_n) OR 3 * alt_n < ref_n THEN '0/0' WHEN alt_n > 4 * ref_n THEN '1/1' ELSE '0/1' END"


@query("genotypes", f"""SELECT id, {_GT} AS gt_long, {_SGT} AS gt_short, CASE WHEN alt_n > 4 * ref_n THEN '1/1' WHEN ref_n > 4 * alt_n THEN '0/0' ELSE '0/1' END AS gt_inversion,
    CASE WHEN alt_n = 1 AND ref_n >= 1 AND unknown_n >= 20 * alt_n THEN '0/0' WHEN ref_n = 0 AND alt_n < 4 THEN {_SGT} ELSE {_GT} END AS gt_hybrid FROM {SV} x""")
def _(read):
    r, a, u = F.col("ref_n"), F.col("alt_n"), F.col("unknown_n")
    long, short = genotype.long_read_genotype(r, a), genotype.short_read_genotype(r, a, u)
    return read("sv").select("id", long.alias("gt_long"), short.alias("gt_short"), genotype.inversion_genotype(r, a).alias("gt_inversion"), genotype.hybrid(long, r, a, short, u, a).alias("gt_hybrid"))


@query("qualities", f"""WITH g AS (SELECT *, {_GT} AS gt, -5.0::DOUBLE * alt_n - 5.3::DOUBLE AS rr, -5.0::DOUBLE * ref_n AS aa, -0.3::DOUBLE * (ref_n + alt_n) - 5.0::DOUBLE AS ra FROM {SV} x),
    q AS (SELECT *, greatest((greatest(ra, aa) - rr) * 10, 20) AS q0 FROM g)
    SELECT id, floor(least(CASE WHEN unknown_n > 0.1::DOUBLE * alt_n AND q0 > 100 THEN q0 / 10 ELSE q0 END, 500))::INT AS qual, floor(CASE gt WHEN '0/0' THEN rr - greatest(ra, aa) WHEN '0/1' THEN ra - greatest(rr, aa) ELSE aa - greatest(rr, ra) END * 10)::INT AS gq FROM q""")
def _(read):
    sv = read("sv").withColumn("gt", genotype.long_read_genotype(F.col("ref_n"), F.col("alt_n")))
    return sv.select("id", genotype.qualities(F.col("ref_n"), F.col("alt_n"), F.col("unknown_n"), F.col("gt")).alias("q")).select("id", "q.*")


@query("filter_labels", f"""SELECT id, CASE WHEN abs(svlen) < 50 THEN 'PASS' WHEN hap = 1 AND sample = 3 THEN 'DUPLICATE' WHEN {_GT} = '0/0' THEN 'LOW_DEPTH' WHEN unknown_n = 6 THEN 'DR_not_support' WHEN a1 = 1 AND ref_n <= 5 THEN 'LOW_QUAL' ELSE 'PASS' END AS filter,
    CASE WHEN svlen < 0 THEN pos - svlen ELSE pos END AS ed FROM {SV} x""")
def _(read):
    sv = read("sv")
    gt = genotype.long_read_genotype(F.col("ref_n"), F.col("alt_n"))
    label = genotype.filter_label(F.col("svlen"), (F.col("hap") == 1) & (F.col("sample") == 3), gt, F.col("unknown_n") == 6, F.col("a1") == 1, F.col("ref_n"))
    return sv.select("id", label.alias("filter"), genotype.end_of(F.col("pos"), F.col("svlen")).alias("ed"))


@query("long_deletions", f"""WITH d AS (SELECT id, svlen * 20 AS len, {_GT} AS gt, {_SGT} AS pair_gt, ref_n / 7.0::DOUBLE AS ratio FROM {SV} x)
    SELECT id, CASE WHEN len < -50000 OR (len < -1000 AND ratio > 0.9) THEN '0/0' WHEN len < -400 AND pair_gt = '0/0' THEN '0/0' WHEN len < -700 AND gt = '0/0' THEN pair_gt ELSE gt END AS gt FROM d""")
def _(read):
    r, a, u = F.col("ref_n"), F.col("alt_n"), F.col("unknown_n")
    gt = genotype.long_deletion(genotype.long_read_genotype(r, a), F.col("svlen") * 20, genotype.short_read_genotype(r, a, u), r / 7.0)
    return read("sv").select("id", gt.alias("gt"))


@query("tidy_calls", f"""SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, svlen ORDER BY alt_n DESC, id) AS k FROM {SV} x WHERE NOT (svtype = 'DEL' AND svlen > 0) AND NOT (svtype = 'INS' AND svlen < 0)) WHERE k = 1""")
def _(read):
    return genotype.tidy(read("sv")).select("id")


@query("spanning_genotype", f"""WITH e AS (SELECT id, chrom, pos AS p FROM {SV} x UNION ALL SELECT id, chrom, pos - svlen FROM {SV} y WHERE svlen < 0),
    n AS (SELECT e.id, count(*) AS n FROM e JOIN {IV} r ON e.chrom = r.chrom AND r.st <= e.p - 50 AND r.ed >= e.p + 50 GROUP BY e.id),
    m AS (SELECT s.id, CASE WHEN svlen < 0 THEN coalesce(n, 0) // 2 ELSE coalesce(n, 0) END AS n FROM {SV} s LEFT JOIN n USING (id))
    SELECT id, n AS n_spanning, CASE WHEN n > 3 THEN '0/0' WHEN n >= 1 THEN '0/1' ELSE '1/1' END AS gt FROM m""")
def _(read):
    return genotype.spanning_reads(read("sv").withColumn("gt", F.lit("1/1")), read("iv"), 50).select("id", "n_spanning", F.col("gt_long").alias("gt"))


@query("usable_variants", f"""SELECT id FROM {SV} x WHERE a1 = 0 AND abs(svlen) >= 50""")
def _(read):
    sv = read("sv").withColumn("filter", F.when(F.col("a1") == 0, "PASS").otherwise("LOW")).withColumn("alt", F.lit("A"))
    return genotype.usable_variants(sv).select("id")


# Cohort

@query("merge_cohort", f"""SELECT chrom, pos, svlen, count(*) AS n, min(sample) AS first FROM {SV} x GROUP BY chrom, pos, svlen""")
def _(read):
    sv = read("sv").withColumn("ref", F.lit("N")).withColumn("alt", F.lit("A")).withColumn("qual", F.col("alt_n"))
    out = cohort.merge_cohort(sv)
    return out.select("chrom", "pos", "svlen", F.size("support").cast("long").alias("n"), F.expr("support[0].sample").alias("first"))


@query("merge_cohort_long")
def _(read):
    """ALT strings as long as their variants; from 100 bases on lengths may differ by a tenth."""
    sv = read("sv").withColumn("ref", F.lit("N")).withColumn("alt", F.repeat(F.lit("A"), F.abs(F.col("svlen")).cast("int"))).withColumn("qual", F.col("alt_n"))
    sv = sv.withColumn("pos", F.col("pos") - F.col("pos") % 2000)
    out = cohort.merge_cohort(sv, 100)
    return out.select("chrom", "pos", "svlen", F.size("support").cast("long").alias("n"), F.expr("support[0].sample").alias("first"), F.expr("support[0].id").alias("first_id"))


@query("population_counts", f"""SELECT chrom, pos, svlen, sample % 3 AS population, count(*) FILTER (a1 + a2 > 0) AS carriers, sum(a1 + a2)::BIGINT AS ac, 2 * count(*) AS an FROM {SV} x GROUP BY 1, 2, 3, 4""")
def _(read):
    sv = read("sv").withColumn("ref", F.lit("N")).withColumn("alt", F.lit("A")).withColumn("qual", F.col("alt_n"))
    population = sv.select("sample").distinct().withColumn("population", F.col("sample") % 3)
    return cohort.population_counts(cohort.merge_cohort(sv), population)


@query("locus_range", f"""WITH p AS (SELECT l.id, min(svlen) AS least, max(svlen) AS most, count(*) AS n FROM {RG} l JOIN {SV} s ON l.chrom = s.chrom AND s.pos BETWEEN l.st AND l.ed GROUP BY l.id),
    r AS (SELECT l.id, chrom, st, n, coalesce((most - least) // 3, -1) AS "range" FROM {RG} l LEFT JOIN p USING (id)) SELECT id, n, "range", row_number() OVER (ORDER BY "range", chrom, st, id) AS "rank" FROM r""")
def _(read):
    return cohort.locus_range(read("sv"), read("rg").withColumn("unit", F.lit(3))).select("id", "n", "range", F.col("rank").cast("long").alias("rank"))


@query("one_allele_per_region", f"""SELECT id FROM (SELECT id, sample, first_value(sample) OVER (PARTITION BY chrom, pos, svlen ORDER BY alt_n DESC, sample, id) AS first FROM {SV} x) WHERE sample = first""")
def _(read):
    return cohort.one_allele_per_region(read("sv").withColumn("ref", F.lit("N")).withColumn("alt", F.col("svlen").cast("string")).withColumn("region", F.col("sample"))).select("id")


@query("merge_homozygous", f"""SELECT chrom, pos, svlen, sample AS region, min(id) AS id, sum(alt_n)::BIGINT AS alt_n, greatest(0, min(ref_n) - CASE WHEN count(DISTINCT hap) > 1 THEN sum(alt_n) - max(alt_n) ELSE 0 END)::BIGINT AS ref_n FROM {SV} x GROUP BY chrom, pos, svlen, sample""")
def _(read):
    return cohort.merge_homozygous(read("sv").withColumn("region", F.col("sample"))).select("chrom", "pos", "svlen", "region", "id", "alt_n", "ref_n")


@query("force_groups", f"""WITH f AS (SELECT id, chrom, pos, CASE WHEN pos - max(pos) OVER (PARTITION BY chrom ORDER BY pos, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 30 THEN NULL ELSE pos END AS new FROM {SV} x)
    SELECT id, max(new) OVER (PARTITION BY chrom ORDER BY pos, id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM f""")
def _(read):
    return cohort.force_groups(read("sv").withColumn("ref", F.lit("N")).withColumn("alt", F.lit("A"))).select("id", "island")


#: Scores of reads (orders) for haplotypes: a hundred reads to a region, regions grow in number with the orders.
_SCORES = "(SELECT CAST(floor(l_orderkey / 100) AS BIGINT) AS region, l_orderkey AS read, l_linenumber % 3 AS hap, max(CAST(l_quantity AS BIGINT)) AS score FROM lineitem GROUP BY 1, 2, 3)"


def _scores(read):
    rows = read("lineitem").selectExpr("CAST(floor(l_orderkey / 100) AS BIGINT) AS region", "l_orderkey AS read", "l_linenumber % 3 AS hap", "CAST(l_quantity AS BIGINT) AS score")
    return rows.groupBy("region", "read", "hap").agg(F.max("score").alias("score"))


@query("best_haplotype_reads", f"""WITH m AS (SELECT *, max(score) OVER (PARTITION BY region, read) AS m FROM {_SCORES} x), t AS (SELECT *, count(*) OVER (PARTITION BY region, read) AS n FROM m WHERE score = m)
    SELECT region, hap, count(*) AS n_reads, count(*) >= 5 AS evidence FROM t WHERE n = 1 GROUP BY region, hap""")
def _(read):
    return cohort.best_haplotype_reads(_scores(read))


@query("pair_alleles", f"""WITH s AS (SELECT *, score > 45 AS indel FROM {_SCORES} z), h AS (SELECT region, hap, max(hap) OVER (PARTITION BY region) AS ref FROM (SELECT DISTINCT region, hap FROM s)), r AS (SELECT DISTINCT region, read FROM s),
    g AS (SELECT r.region, r.read, h.hap, h.ref, coalesce(s.score, t.score, 0) AS score, CASE WHEN s.hap IS NOT NULL THEN s.indel WHEN t.hap IS NOT NULL THEN t.indel ELSE false END AS indel FROM r JOIN h USING (region) LEFT JOIN s ON s.region = r.region AND s.read = r.read AND s.hap = h.hap LEFT JOIN s t ON t.region = r.region AND t.read = r.read AND t.hap = h.ref),
    p AS (SELECT a.region, a.ref, a.hap AS hap1, b.hap AS hap2, sum(greatest(a.score, b.score))::BIGINT AS total, count(*) FILTER (a.score - b.score > 10) AS n1, count(*) FILTER (b.score - a.score > 10) AS n2, count(*) FILTER (abs(a.score - b.score) <= 10) AS n_unknown, count(*) FILTER (a.indel AND b.indel) AS n_indel, count(*) AS n FROM g a JOIN g b ON a.region = b.region AND a.read = b.read AND a.hap <= b.hap GROUP BY 1, 2, 3, 4),
    k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY total DESC, hap1 DESC, hap2 DESC) AS k FROM p), m AS (SELECT k.*, q.total AS r_total, q.n_indel AS r_indel FROM k JOIN p q ON q.region = k.region AND q.hap1 = q.ref AND q.hap2 = q.ref WHERE k = 1)
    SELECT region, hap1, hap2, total, n1, n2, n_unknown, n_indel, CASE WHEN n_indel > 1 THEN 1 WHEN hap1 = ref AND hap2 = ref THEN 2 WHEN hap2 = ref AND 3 * n1 <= n2 THEN 3 WHEN r_indel < 3 AND total < r_total + 12 * n THEN 4
      WHEN total + 35 * n < 60 * n AND total < r_total + 12 * n THEN CASE WHEN 4 * (n1 + n2) < n_unknown THEN 7 ELSE 5 END WHEN n1 < 3 THEN 6 ELSE 0 END AS reject FROM m""")
def _(read):
    return cohort.pair_alleles(_scores(read).withColumn("indel", F.col("score") > 45), 10, 60)


@query("force_candidates", f"""WITH f AS (SELECT id, chrom, pos, sample, CASE WHEN pos - max(pos) OVER (PARTITION BY chrom ORDER BY pos, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 30 THEN NULL ELSE pos END AS new FROM {SV} x),
    g AS (SELECT *, max(new) OVER (PARTITION BY chrom ORDER BY pos, id ROWS UNBOUNDED PRECEDING) AS island FROM f), n AS (SELECT chrom, island FROM g GROUP BY 1, 2 HAVING count(*) <> 1 AND count(*) FILTER (sample = 3) = 0) SELECT id FROM g JOIN n USING (chrom, island)""")
def _(read):
    sv = read("sv").withColumn("ref", F.lit("N")).withColumn("alt", F.lit("A")).withColumn("support", F.array(F.struct("sample")))
    return cohort.force_candidates(cohort.force_groups(sv), 3).select("id")


@query("recover_alleles", f"""WITH c AS (SELECT chrom, pos // 1000 AS id, svlen, count(*) AS n, min(sample) AS sample FROM {SV} x GROUP BY 1, 2, 3), m AS (SELECT *, row_number() OVER (PARTITION BY chrom, id ORDER BY n DESC, svlen) AS k FROM c),
    h AS (SELECT m.chrom, m.id, m.svlen, m.sample, s.pos, row_number() OVER (PARTITION BY m.chrom, m.id ORDER BY abs(s.pos - m.id * 1000), s.pos) AS j FROM m LEFT JOIN {SV} s ON m.sample = s.sample AND m.chrom = s.chrom AND abs(m.svlen) = abs(s.svlen) AND s.pos BETWEEN m.id * 1000 - 1000 AND m.id * 1000 + 1000 WHERE k = 1)
    SELECT chrom, id * 1000 AS pos, svlen, sample, pos AS allele_pos FROM h WHERE j = 1""")
def _(read):
    sv = read("sv").withColumn("ref", F.lit("N")).withColumn("alt", F.lit("A"))
    rows = sv.groupBy("chrom", ops.div(F.col("pos"), 1000).alias("place")).agg(F.collect_list(F.struct("sample", "svlen")).alias("lengths"))
    rows = rows.select(F.xxhash64("place", "chrom").alias("id"), "chrom", (F.col("place") * 1000).alias("pos"), "lengths")
    return cohort.recover_alleles(rows, sv).select("chrom", "pos", "svlen", "sample", "allele_pos")


# Greedy folds have no SQL; tests compare them with a plain transcription of the rule.


@query("merge_small_signals")
def _(read):
    rows = _signals(read).withColumn("st", F.col("st") - F.col("st") % 5000)  # many signals at few places
    return folds.merge_small(rows.withColumn("ed", F.col("st") + F.col("id") % 30), 10)


@query("merge_normal_signals")
def _(read):
    return folds.merge_normal(_signals(read), 10)


@query("drop_close_calls")
def _(read):
    return folds.drop_close(read("sv").withColumn("st", F.col("pos"))).select("id", "chrom", "st", "svlen")


def _signals(read):
    return read("iv").select("chrom", F.col("type").alias("kind"), "st", "ed", F.lit(1).alias("support"), "id")


# Reads: intervals play alignments


@query("block_depth", f"""SELECT chrom, st // 32 AS block, count(*) AS n FROM {IV} x GROUP BY 1, 2""")
def _(read):
    return reads.block_depth(read("iv"))


@query("region_depth", f"""WITH d AS (SELECT chrom, st // 32 AS block, count(*) AS n FROM {IV} x GROUP BY 1, 2), r AS (SELECT id, chrom, unnest(generate_series(st // 32, ed // 32)) AS block FROM {RG} y)
    SELECT id, round(avg(coalesce(n, 0) / 0.5::DOUBLE), 6) AS mean_ratio, round(max(coalesce(n, 0) / 0.5::DOUBLE), 6) AS max_ratio, avg(coalesce(n, 0) / 0.5::DOUBLE) > 2 AS high FROM r LEFT JOIN d USING (chrom, block) GROUP BY id""")
def _(read):
    out = reads.region_depth(read("rg"), reads.block_depth(read("iv")), 0.5)
    return out.select("id", F.round("mean_ratio", 6).alias("mean_ratio"), F.round("max_ratio", 6).alias("max_ratio"), "high")


@query("mean_depth", f"""SELECT round(sum(ed - st) / (avg(ed - st) + 1000000), 6) AS depth FROM {IV} x""")
def _(read):
    return reads.mean_depth(read("iv"), 1_000_000).select(F.round("depth", 6).alias("depth"))


@query("read_length_stats", f"""WITH p AS (SELECT ed - st AS length, count(*) AS n FROM {IV} x GROUP BY 1) SELECT round(sum(length * n) / sum(n)::DOUBLE, 6) AS mean, (SELECT length FROM p ORDER BY n DESC, length LIMIT 1) AS commonest, round(max(n) / sum(n)::DOUBLE, 6) AS share FROM p""")
def _(read):
    out = reads.read_length_stats(read("iv").select((F.col("ed") - F.col("st")).alias("length")))
    return out.select(F.round("mean", 6).alias("mean"), "commonest", F.round("share", 6).alias("share"))


@query("isize_stats", f"""SELECT quantile_cont(ed - st, 0.01) AS least, quantile_cont(ed - st, 0.5) AS median, quantile_cont(ed - st, 0.99) AS most, count(*) AS pairs FROM {RG} x""")
def _(read):
    return reads.isize_stats(read("rg").select((F.col("ed") - F.col("st")).alias("isize")))


@query("isize_histogram", f"""WITH p AS (SELECT ed - st AS isize, count(*) AS n FROM {RG} x GROUP BY 1) SELECT isize, n, round(100.0 * n / sum(n) OVER (), 6) AS percent, round(100.0 * sum(n) OVER (ORDER BY isize) / sum(n) OVER (), 6) AS cumulative FROM p""")
def _(read):
    out = reads.isize_histogram(read("rg").select((F.col("ed") - F.col("st")).alias("isize")))
    return out.select("isize", "n", F.round("percent", 6).alias("percent"), F.round("cumulative", 6).alias("cumulative"))


@query("breakpoint_distribution", f"""WITH p AS (SELECT ed - st - 300 AS n, count(*)::DOUBLE / (ed - st - 300) AS w FROM {RG} x WHERE ed - st > 300 GROUP BY ed - st), i AS (SELECT unnest(generate_series(0, (SELECT max(n) FROM p) - 1)) AS i),
    s AS (SELECT i, sum(w) AS p FROM i JOIN p ON i.i < p.n GROUP BY i) SELECT i, round(p / sum(p) OVER (), 8) AS p FROM s""")
def _(read):
    density = read("rg").groupBy((F.col("ed") - F.col("st")).alias("isize")).agg(F.count(F.lit(1)).cast("double").alias("d"))
    return reads.breakpoint_distribution(density, 150).select(F.col("i").cast("long").alias("i"), F.round("p", 8).alias("p"))


@query("isize_density", f"""WITH q AS (SELECT floor(quantile_cont(ed - st, 0.01)) AS least, floor(quantile_cont(ed - st, 0.99)) AS most, count(*) AS n FROM {RG} x)
    SELECT ed - st AS isize, round(count(*) / (any_value(q.n) + 1)::DOUBLE, 8) AS d FROM {RG} y, q WHERE ed - st >= q.least AND ed - st < q.most GROUP BY 1""")
def _(read):
    return reads.isize_density(read("rg").select((F.col("ed") - F.col("st")).alias("isize"))).select("isize", F.round("d", 8).alias("d"))


@query("least_accepted", f"""WITH p AS (SELECT ed - st - 300 AS n, count(*)::DOUBLE / (ed - st - 300) AS w FROM {RG} x WHERE ed - st > 300 GROUP BY ed - st) SELECT round(2 * sum(w) / sum(n * w), 8) AS least FROM p""")
def _(read):
    density = read("rg").groupBy((F.col("ed") - F.col("st")).alias("isize")).agg(F.count(F.lit(1)).cast("double").alias("d"))
    return reads.least_accepted(reads.breakpoint_distribution(density, 150), 2).select(F.round("least", 8).alias("least"))


@query("pair_support", f"""WITH v AS (SELECT id, chrom, pos, pos - svlen AS ed FROM {SV} x WHERE svlen < 0), j AS (SELECT v.id, r.ed AS me, r.ed - r.st AS isize, v.pos, v.ed FROM v JOIN {IV} r ON v.chrom = r.chrom AND r.st BETWEEN v.pos - 849 AND v.pos - 1),
    p AS (SELECT id, count(*) FILTER (me > ed AND me < ed + 850) AS n_sv, avg(isize) FILTER (me > ed AND me < ed + 850) AS isize_sv, count(*) FILTER (me > pos AND me < pos + 850) AS n_ref, avg(isize) FILTER (me > pos AND me < pos + 850) AS isize_ref FROM j GROUP BY id)
    SELECT v.id, coalesce(n_sv, 0) AS n_sv, round(isize_sv, 6) AS isize_sv, coalesce(n_ref, 0) AS n_ref, round(isize_ref, 6) AS isize_ref FROM v LEFT JOIN p USING (id)""")
def _(read):
    sv = read("sv").filter("svlen < 0").select("id", "chrom", "pos", (F.col("pos") - F.col("svlen")).alias("ed"))
    out = reads.pair_support(sv, read("iv"), 150, 1000)
    return out.select("id", "n_sv", F.round("isize_sv", 6).alias("isize_sv"), "n_ref", F.round("isize_ref", 6).alias("isize_ref"))


@query("breakpoint_reads", f"""WITH s AS (SELECT v.id, r.id AS read, 1 AS side FROM {SV} v JOIN {IV} r ON v.chrom = r.chrom AND v.pos BETWEEN r.st AND r.ed AND v.pos - r.st > 0.3::DOUBLE * (r.ed - r.st)
    UNION ALL SELECT v.id, r.id, 2 FROM {SV} v JOIN {IV} r ON v.chrom = r.chrom AND v.pos + abs(svlen) BETWEEN r.st AND r.ed AND r.ed - v.pos - abs(svlen) > 0.3::DOUBLE * (r.ed - r.st)) SELECT id, read, sum(side)::BIGINT AS mode FROM s GROUP BY id, read""")
def _(read):
    sv = read("sv").withColumn("end", F.col("pos") + F.abs("svlen"))
    return reads.breakpoint_reads(sv, read("iv").withColumn("read", F.col("id")))


@query("kmer_census", f"""WITH b AS (SELECT id, s FROM {SEQ} x UNION ALL SELECT id, reverse(translate(s, 'ACGT', 'TGCA')) FROM {SEQ} y), k AS (SELECT id, unnest(list_transform(generate_series(1, length(s) - 19), lambda i: substring(s, i, 20))) AS kmer FROM b WHERE length(s) >= 20),
    p AS (SELECT id, kmer, count(*) AS n FROM k GROUP BY id, kmer HAVING count(*) >= 3) SELECT kmer, sum(n)::BIGINT AS n FROM p GROUP BY kmer""")
def _(read):
    return reads.kmer_census(read("seq"))


@query("composition_histogram", f"""SELECT {", ".join(f"(length(s) - length(replace(s, '{b}', ''))) // 16 AS {b}" for b in "ACGT")}, count(*) AS n FROM {SEQ} x GROUP BY 1, 2, 3, 4""")
def _(read):
    return reads.composition_histogram(read("seq"))


@query("mapped_by_chromosome", f"""WITH p AS (SELECT name AS read, chrom, sum(ed - st)::BIGINT AS mapped FROM {IV} x GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY read ORDER BY mapped DESC, chrom) = 1 AS main FROM p""")
def _(read):
    return reads.mapped_by_chromosome(read("iv").withColumn("read", F.col("name")))


@query("mapping_gaps", f"""SELECT id, st - lag(ed) OVER (PARTITION BY name ORDER BY st, ed, id) AS read_gap FROM {IV} x""")
def _(read):
    rows = read("iv").select("id", F.col("name").alias("read"), F.col("st").alias("read_st"), F.col("ed").alias("read_ed"), F.col("id").alias("st"), F.col("id").alias("ed"))
    return reads.mapping_gaps(rows).select("id", "read_gap")


@query("piecewise_depth", f"""WITH e AS (SELECT name AS read, st AS p, 1 AS d FROM {IV} x UNION ALL SELECT name, ed, -1 FROM {IV} y), p AS (SELECT read, p, sum(d) AS d FROM e GROUP BY read, p),
    w AS (SELECT read, p AS "from", lead(p) OVER (PARTITION BY read ORDER BY p) AS "to", sum(d) OVER (PARTITION BY read ORDER BY p)::BIGINT AS n FROM p) SELECT * FROM w WHERE "to" IS NOT NULL""")
def _(read):
    return reads.piecewise_depth(read("iv").select(F.col("name").alias("read"), F.col("st").alias("read_st"), F.col("ed").alias("read_ed")))


_MAPPINGS = "(SELECT name AS read, st AS read_st, ed AS read_ed, st * 2 AS st, ed * 2 + 7 AS ed, id FROM {} x)"


@query("projected_pieces", f"""WITH m AS (SELECT * FROM {_MAPPINGS.format(IV)} y), e AS (SELECT read, read_st AS p FROM m UNION SELECT read, read_ed FROM m), w AS (SELECT read, p AS "from", lead(p) OVER (PARTITION BY read ORDER BY p) AS "to" FROM e)
    SELECT w.read, "from", "to", id, floor(st + ("from" - read_st) * (ed - st) / (read_ed - read_st)::DOUBLE)::BIGINT AS at FROM w JOIN m ON m.read = w.read AND read_st <= "from" AND "to" <= read_ed""")
def _(read):
    return reads.projected_pieces(read("iv").selectExpr("name AS read", "st AS read_st", "ed AS read_ed", "st * 2 AS st", "ed * 2 + 7 AS ed", "id"))


@query("likeliest_place", f"""WITH s AS (SELECT chrom AS id, st AS pos, sum(ed - st) OVER (PARTITION BY chrom ORDER BY st RANGE BETWEEN CURRENT ROW AND 999 FOLLOWING) AS p FROM {IV} x) SELECT id, min(pos) AS pos, max(p)::BIGINT AS p FROM s a WHERE p = (SELECT max(p) FROM s b WHERE b.id = a.id) GROUP BY id""")
def _(read):
    return reads.likeliest_place(read("iv").select(F.col("chrom").alias("id"), F.col("st").alias("pos"), (F.col("ed") - F.col("st")).alias("p")), 1000)


# Context


@query("breakpoint_divergence", f"""WITH w AS (SELECT id, chrom, st, unnest(generate_series(0, (ed - st) // 100)) AS w FROM {RG} x), v AS (SELECT id, chrom, w, st + w * 100 AS st, st + w * 100 + 99 AS ed FROM w),
    d AS (SELECT v.id, w, count(*) AS depth FROM v JOIN {IV} r ON v.chrom = r.chrom AND r.st < v.st AND r.ed > v.ed GROUP BY 1, 2), b AS (SELECT v.id, w, count(DISTINCT p.sample) AS breaks FROM v JOIN {SV} p ON v.chrom = p.chrom AND p.pos BETWEEN v.st AND v.ed GROUP BY 1, 2),
    j AS (SELECT v.id, coalesce(depth, 0) AS depth, coalesce(breaks, 0) AS breaks FROM v LEFT JOIN d USING (id, w) LEFT JOIN b USING (id, w)), s AS (SELECT *, CASE WHEN depth > 0 THEN least(1, breaks / depth::DOUBLE) ELSE 1 END + 0.01::DOUBLE AS o FROM j)
    SELECT id, round(sum(o * ln(o / 0.51::DOUBLE)), 6) AS kld, sum(breaks)::BIGINT AS breaks, sum(depth)::BIGINT AS depth FROM s GROUP BY id""")
def _(read):
    out = context.breakpoint_divergence(read("rg"), read("iv"), read("sv").select("chrom", "pos", F.col("sample").alias("read")), 100, F.lit(0.5))
    return out.select("id", F.round("kld", 6).alias("kld"), "breaks", "depth")


_SURE = "mapq >= 11 AND "
_COUNTERS = {
    "clipped": "clip > 0", "clip_1_10": "clip BETWEEN 1 AND 10", "clip_11_50": "clip BETWEEN 11 AND 50", "clip_over_50": "clip > 50", "discordant": _SURE + "NOT (NOT mate_unmapped AND orientation = 'FR' AND NOT mate_elsewhere AND isize <= 1000)",
    **{f"pairs_{o.lower()}": f"{_SURE}NOT mate_unmapped AND orientation = '{o}'" for o in ("FF", "RR", "RF")}, "isize_over_1k": _SURE + "isize > 1000", "isize_over_100k": _SURE + "isize > 100000",
    "mate_unmapped": _SURE + "mate_unmapped", "mate_elsewhere": _SURE + "mate_elsewhere", "nm_over_2": "nm > 2", "nm_over_10": "nm > 10", "events_over_2": "events > 2", "mapq_under_30": "mapq < 30", "mapq_under_10": "mapq < 10", "mapq_0": "mapq = 0",
}
_SUMS = {"bases": "length", "clip_bases": "clip", "indel_bases": "indel", "nm_total": "nm", "mapq_total": "mapq"}
_READ_FEATURES = ["chrom", "st", "ed", "name % 70 AS clip", "CASE name % 4 WHEN 0 THEN 'FF' WHEN 1 THEN 'RR' WHEN 2 THEN 'RF' ELSE 'FR' END AS orientation", "(name % 300) * 500 AS isize", "name % 11 = 0 AS mate_unmapped", "sample % 6 = 0 AS mate_elsewhere", "name % 14 AS nm", "(st + name) % 5 AS events", "sample AS mapq", "ed - st AS length", "name % 9 AS indel"]
_CONTEXT = f"""(SELECT a.id, a.chrom, a.st, count(b.chrom) AS reads, {", ".join(f"coalesce(sum({v}), 0)::BIGINT AS {k}" for k, v in _SUMS.items())}, {", ".join(f"count(*) FILTER ({v}) AS {k}" for k, v in _COUNTERS.items())}, coalesce(sum(length), 0)::BIGINT // (a.ed - a.st + 248) AS depth
    FROM {RG} a LEFT JOIN (SELECT {", ".join(_READ_FEATURES)} FROM {IV} x) b ON a.chrom = b.chrom AND a.st - 50 <= b.ed AND b.st <= a.ed + 50 GROUP BY a.id, a.chrom, a.st, a.ed)"""


@query("short_read_context", f"SELECT * EXCLUDE (chrom, st) FROM {_CONTEXT} c")
def _(read):
    return context.short_read_context(read("rg"), read("iv").selectExpr(*_READ_FEATURES))


@query("heat_signals", f"""SELECT id, reads AS y0, (clip_11_50 + clip_over_50 + discordant) // 2 AS y1, greatest(clip_11_50 + clip_over_50, discordant) AS y2, greatest(clip_11_50 + clip_over_50, discordant, events_over_2) AS y3, clip_11_50 + clip_over_50 AS y4, clip_over_50 AS y5
    FROM {_CONTEXT} c WHERE chrom % 8 <> 7 AND NOT (chrom = 1 AND st > 5000000 AND st < 9000000) AND NOT (chrom = 4 AND st > 100 AND st < 3000000)""")
def _(read):
    rg = read("rg")
    blocks = context.short_read_context(rg, read("iv").selectExpr(*_READ_FEATURES)).join(rg.select("id", "chrom", F.col("st").alias("pos")), "id").filter("chrom % 8 <> 7")
    kept = context.outside_excluded(blocks, [(1, 5_000_000, 9_000_000), (4, 100, 3_000_000)], ())
    return kept.select("id", *(context.signal_count(k).alias(f"y{k}") for k in range(6)))


@query("long_read_context", f"""SELECT chrom, block, svtype AS type, count(*) AS n FROM (SELECT chrom, svtype, unnest(generate_series(greatest(0, (pos - 200) // 100), pos // 100)) AS block FROM {SV} x) GROUP BY 1, 2, 3""")
def _(read):
    return context.long_read_context(read("sv").withColumn("type", F.col("svtype")), 100, 300)


@query("heat_map", f"""WITH b AS (SELECT chrom, st // 1000 AS block, count(*) AS n, max(name % 400) AS k, max(sample) AS s FROM {IV} x GROUP BY 1, 2)
    SELECT y, x, n_sv, n_blank, round(n_sv / (n_sv + n_blank)::DOUBLE, 6) AS p, round(CASE WHEN n_sv > 0 THEN abs(-10 * log10(n_sv / (n_sv + n_blank)::DOUBLE)) END, 6) AS score FROM (SELECT least(99, n) AS y, least(299, k) AS x, count(*) FILTER (s % 2 = 0) AS n_sv, count(*) FILTER (s % 2 = 1) AS n_blank FROM b GROUP BY 1, 2)""")
def _(read):
    blocks = read("iv").groupBy("chrom", ops.div(F.col("st"), 1000).alias("block")).agg(F.count(F.lit(1)).alias("signals"), F.max(F.col("name") % 400).alias("k"), F.max("sample").alias("s"))
    blocks = blocks.withColumn("reads", F.lit(100)).withColumn("label", F.when(F.col("s") % 2 == 0, "INS").otherwise("BLANK"))
    return context.heat_map(blocks).select("y", "x", "n_sv", "n_blank", F.round("p", 6).alias("p"), F.round("score", 6).alias("score"))


@query("roc", """WITH d AS (SELECT n_chars AS score, quality = 1 AS positive FROM labels JOIN documents USING (doc_id)), p AS (SELECT score, count(*) FILTER (positive) AS tp, count(*) FILTER (NOT positive) AS fp FROM d GROUP BY score),
    c AS (SELECT score, sum(tp) OVER (ORDER BY score DESC)::BIGINT AS tp, sum(fp) OVER (ORDER BY score DESC)::BIGINT AS fp FROM p) SELECT score, tp, fp, round(tp / max(tp) OVER ()::DOUBLE, 6) AS recall, round(tp / (tp + fp)::DOUBLE, 6) AS "precision" FROM c""")
def _(read):
    scored = read("labels").join(read("documents").select("doc_id", "n_chars"), "doc_id").select(F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("positive"))
    return context.roc(scored).select("score", "tp", "fp", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


# Mobile elements and contigs


#: Samples that grow in number with the tables: forty for each eight chromosomes.
_SAMPLED = "sample + 40 * CAST(floor(chrom / 8) AS BIGINT) AS sample"


@query("element_gaps", f"""SELECT sample, type, st, st - lag(st) OVER w - lag(ed - st) OVER w AS gap FROM (SELECT type, st, ed, {_SAMPLED} FROM {IV} x) y WINDOW w AS (PARTITION BY sample, type ORDER BY st, ed)""")
def _(read):
    return mei.element_gaps(read("iv").selectExpr("type", "st", "ed", _SAMPLED).withColumn("length", F.col("ed") - F.col("st"))).select("sample", "type", "st", "gap")


@query("main_annotation", f"""SELECT sample, chrom, n FROM (SELECT sample, chrom, count(*) AS n, row_number() OVER (PARTITION BY sample ORDER BY count(*) DESC, min(id)) AS k FROM (SELECT id, chrom, {_SAMPLED} FROM {IV} x) y GROUP BY sample, chrom) WHERE k = 1""")
def _(read):
    return mei.most_frequent(read("iv").selectExpr("id", "chrom", _SAMPLED), "sample", "chrom", "id")


@query("mei_arrays")
def _(read):
    return mei.mei_arrays(read("iv").select((F.col("name") % 400 + 400 * ops.div(F.col("chrom"), 8)).alias("sample"), "type", "st", "ed", (F.col("ed") - F.col("st")).alias("length")))


_TANDEM, _ANNOTATED = "(l_orderkey * 37 + l_linenumber * 211) % 2000", "(l_partkey * 13) % 2000"


@query("vntr_runs", f"""WITH c AS (SELECT id AS name, 1000 + id % 3000 AS length FROM {RG} x), r AS (SELECT l_orderkey AS name, {_TANDEM} - 10 AS st, {_TANDEM} + CAST(l_quantity AS INT) + 10 AS ed FROM lineitem UNION SELECT l_orderkey, {_ANNOTATED}, {_ANNOTATED} + l_linenumber * 5 FROM lineitem WHERE l_returnflag = 'R'),
    s AS (SELECT DISTINCT name, greatest(0, st) AS st, least(length - 1, ed) AS ed FROM c JOIN r USING (name)), f AS (SELECT *, max(ed) OVER (PARTITION BY name ORDER BY st, ed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s WHERE st <= ed),
    g AS (SELECT *, sum(CASE WHEN st - far <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY name ORDER BY st, ed ROWS UNBOUNDED PRECEDING) AS i FROM f), m AS (SELECT name, min(st) AS st, max(ed) AS ed FROM g GROUP BY name, i),
    v AS (SELECT c.name, coalesce(sum(ed - st + 1), 0)::BIGINT AS bases, count(ed) + 1 - count(*) FILTER (st = 0) - count(*) FILTER (ed = length - 1) AS gaps, count(ed) AS n FROM c LEFT JOIN m USING (name) GROUP BY c.name) SELECT name, bases, n + gaps AS runs FROM v""")
def _(read):
    tracts = read("rg").select(F.col("id").alias("name"), (1000 + F.col("id") % 3000).alias("length"))
    lines = read("lineitem")
    trf = lines.selectExpr("l_orderkey AS name", f"{_TANDEM} AS st", f"{_TANDEM} + CAST(l_quantity AS INT) AS ed")
    rm = lines.selectExpr("l_orderkey AS name", f"{_ANNOTATED} AS st", f"{_ANNOTATED} + l_linenumber * 5 AS ed", "CASE WHEN l_returnflag = 'R' THEN 'Simple_repeat' ELSE 'LINE/L1' END AS class")
    return contigs.vntr_runs(tracts, rm, trf).groupBy("name").agg(F.sum(F.when(F.col("vntr"), F.col("ed") - F.col("st") + 1).otherwise(0)).alias("bases"), F.count(F.lit(1)).alias("runs"))


@query("choose_contigs", f"""WITH c AS (SELECT id, CAST(floor(id / 50) AS BIGINT) AS region, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g')) AS n, length(s) % 7 AS support FROM {SEQ} x),
    g AS (SELECT *, CASE WHEN lag(n) OVER w - n < 10 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY region ORDER BY n DESC, id)), h AS (SELECT *, sum(new) OVER (PARTITION BY region ORDER BY n DESC, id) AS g FROM g),
    b AS (SELECT *, row_number() OVER (PARTITION BY region, g ORDER BY support DESC, id) AS k FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY support DESC, id) AS r FROM b WHERE k = 1 OR support >= 3) SELECT region, id AS contig, support FROM r WHERE r <= 2""")
def _(read):
    rows = read("seq").select(ops.div(F.col("id"), 50).alias("region"), F.col("id").alias("contig"), F.col("s").alias("seq"), (F.length("s") % 7).alias("support"))
    return contigs.choose_contigs(rows).select("region", "contig", F.col("support").cast("long").alias("support"))


# Alignments with flags and CIGARs

@query("short_reads", f"""SELECT id FROM {AL} x WHERE (flag & {1024 + 256 + 2048}) = 0 AND ((flag & 4) <> 0 OR mapq >= 20 OR (nm * 10 >= 20 AND mate_chrom = chrom AND abs(isize) < 20000))""")
def _(read):
    return reads.short_reads(read("al").withColumn("mate_mapq", F.col("nm") * 10)).select("id")


@query("long_reads", f"""SELECT id FROM {AL} x WHERE (flag & 256) = 0 AND mapq >= 1 AND ((flag & 2048) = 0 OR 10 + q + ln + 5 + q % 40 + 30 + 20 + ln * 300 >= 1200)""")
def _(read):
    return reads.long_reads(read("al").withColumn("cigar", cg.parse("cigar_text"))).select("id")


@query("translocation_reads", f"""SELECT id, mate_chrom AS chrom, mate_pos AS pos, chrom AS mate_chrom, pos AS mate_pos FROM {AL} x WHERE (flag & {256 + 2048 + 1024 + 4 + 8}) = 0 AND pos <> mate_pos AND (isize = 0 OR abs(isize) > 5000)""")
def _(read):
    return reads.translocation_reads(read("al")).select("id", "chrom", "pos", "mate_chrom", "mate_pos")


@query("discordant_pairs", f"""SELECT id FROM {AL} x WHERE (flag & 12) = 0 AND (chrom <> mate_chrom OR ((flag & 16) <> 0) = ((flag & 32) <> 0) OR abs(isize) <= 200 OR abs(isize) >= 4500 OR CASE WHEN (flag & 16) <> 0 THEN pos < mate_pos ELSE pos > mate_pos END)""")
def _(read):
    return read("al").filter(reads.discordant(200, 4500)).select("id")


@query("pair_classes", f"""SELECT id, CASE WHEN chrom <> mate_chrom AND s THEN 'TRA_INV' WHEN chrom <> mate_chrom THEN 'TRA' WHEN s AND (flag & 16) = 0 THEN 'INV_1' WHEN s THEN 'INV_2' WHEN NOT f THEN 'DUP' WHEN abs(isize) > 4500 THEN 'DEL' END AS class
    FROM (SELECT *, ((flag & 16) <> 0) = ((flag & 32) <> 0) AS s, CASE WHEN pos <= mate_pos THEN (flag & 16) = 0 ELSE (flag & 32) = 0 END AS f FROM {AL} x)""")
def _(read):
    return read("al").select("id", reads.pair_class(4500).alias("class"))


@query("mate_groups", f"""WITH t AS (SELECT id, pos AS st, chrom FROM {AL} x WHERE (flag & {256 + 2048 + 1024 + 4 + 8}) = 0 AND pos <> mate_pos AND (isize = 0 OR abs(isize) > 5000)), n AS (SELECT *, st - lag(st) OVER (PARTITION BY chrom ORDER BY st, id) AS d FROM t),
    g AS (SELECT *, sum(CASE WHEN d <= 200000 THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY st, id ROWS UNBOUNDED PRECEDING) AS i FROM n) SELECT chrom, min(st) AS st, max(st) AS ed, count(*) AS n FROM g GROUP BY chrom, i HAVING count(*) > 1""")
def _(read):
    return reads.mate_groups(reads.translocation_reads(read("al")), 200_000, 1)


_INS = "pos + 10 + q + ln"


@query("long_read_signals", f"""SELECT id::VARCHAR AS read_name, 'INS' AS type, {_INS} AS pos, {_INS} AS "end", 5 + q % 40 AS length FROM {AL} x WHERE 5 + q % 40 >= 30
    UNION ALL SELECT id::VARCHAR, 'DEL', {_INS} + 30, {_INS} + 30 + 1 + q * 3 % 60, 1 + q * 3 % 60 FROM {AL} y WHERE 1 + q * 3 % 60 >= 30
    UNION ALL SELECT id::VARCHAR, 'CLIP_RIGHT', {_INS} + 50 + 1 + q * 3 % 60, {_INS} + 50 + 1 + q * 3 % 60, ln * 300 FROM {AL} z WHERE ln * 300 > 1000""")
def _(read):
    return reads.long_read_signals(read("al").withColumn("cigar", cg.parse("cigar_text"))).select("read_name", "type", "pos", "end", "length")


@query("cigar_functions", f"""SELECT id, 10 + q + ln + 30 + 1 + q * 3 % 60 + 20 AS ref_length, 10 + q + ln + 5 + q % 40 + 50 + ln * 300 AS query_length, ln * 300 AS clip, greatest(5 + q % 40 + 1 + q * 3 % 60, nm) AS edits, {_INS} + 3 AS lifted FROM {AL} x""")
def _(read):
    al = read("al").withColumn("cigar", cg.parse("cigar_text"))
    place = F.col("q") + 10 + F.col("ln") + 5 + F.col("q") % 40 + 3
    return al.select("id", cg.reference_length("cigar").alias("ref_length"), cg.query_length("cigar").alias("query_length"), cg.clip_right("cigar").alias("clip"), cg.edits("cigar", "nm").alias("edits"), cg.query_to_ref("cigar", "pos", place)["ref"].alias("lifted"))


@query("clip_signals", f"""SELECT id::VARCHAR AS read_name, {_INS} + 41 + q * 3 % 60 AS st, {_INS} + 61 + q * 3 % 60 AS ed, 'BEGIN' AS side, least(15, mapq) AS score FROM {AL} x""")
def _(read):
    return reads.clip_signals(read("al").withColumn("cigar", cg.parse("cigar_text"))).select("read_name", "st", "ed", "side", "score")


@query("variant_density", f"""WITH o AS (SELECT id, chrom, pos AS st, pos + 9 + q AS ed, '=' AS op, 10 + q AS n FROM {AL} a UNION ALL SELECT id, chrom, pos + 10 + q, pos + 9 + q + ln, 'X', ln FROM {AL} b UNION ALL SELECT id, chrom, {_INS}, {_INS}, 'I', 5 + q % 40 FROM {AL} c
    UNION ALL SELECT id, chrom, {_INS}, {_INS} + 29, '=', 30 FROM {AL} d UNION ALL SELECT id, chrom, {_INS} + 30, {_INS} + 30 + q * 3 % 60, 'D', 0 FROM {AL} e UNION ALL SELECT id, chrom, {_INS} + 31 + q * 3 % 60, {_INS} + 50 + q * 3 % 60, '=', 20 FROM {AL} f),
    j AS (SELECT r.id, o.id AS read, op, n, greatest(0, least(r.ed - 1, o.ed) - greatest(r.st, o.st) + 1) AS k FROM {RG} r JOIN o ON r.chrom = o.chrom AND r.st <= o.ed AND o.st <= r.ed)
    SELECT id, count(DISTINCT read) AS reads, (sum(k) FILTER (op = '='))::BIGINT AS matches, coalesce(sum(k) FILTER (op = 'X'), 0)::BIGINT AS mismatches, count(*) FILTER (op = 'I') AS insertions, coalesce(sum(n) FILTER (op = 'I'), 0)::BIGINT AS inserted, coalesce(sum(k) FILTER (op = 'D'), 0)::BIGINT AS deleted FROM j GROUP BY id HAVING count(*) FILTER (op = '=') > 0""")
def _(read):
    out = context.variant_density(read("al").withColumn("cigar", cg.parse("cigar_text")), read("rg"))
    return out.filter("matches IS NOT NULL").select("id", "reads", "matches", "mismatches", "insertions", "inserted", "deleted")


@query("label_blocks", f"""WITH b AS (SELECT DISTINCT chrom, st // 1000 AS block FROM {IV} x), e AS (SELECT chrom, type, st AS pos FROM {RG} y WHERE ed - st >= 10 UNION ALL SELECT chrom, type, ed FROM {RG} z WHERE ed - st >= 10),
    l AS (SELECT chrom, block, max(type) AS label FROM (SELECT chrom, type, unnest(generate_series(greatest(0, (pos - 2000) // 1000), pos // 1000)) AS block FROM e) GROUP BY 1, 2)
    , r AS (SELECT chrom, block, max(k) AS k FROM (SELECT chrom, id % 200 AS k, unnest(generate_series(greatest(0, (st - 2000) // 1000), st // 1000)) AS block FROM {RG} u) GROUP BY 1, 2)
    SELECT b.chrom, b.block, coalesce(label, 'BLANK') AS label, coalesce(k, 0) AS k FROM b LEFT JOIN l ON b.chrom = l.chrom AND b.block = l.block LEFT JOIN r ON b.chrom = r.chrom AND b.block = r.block""")
def _(read):
    index = read("rg").select("chrom", F.col("st").alias("pos"), (F.col("id") % 200).alias("k"))
    blocks = read("iv").select("chrom", ops.div(F.col("st"), 1000).alias("block")).distinct()
    return context.label_blocks(blocks, read("rg"), index, 1000, 3000)


def _two_regions(read):
    return read("iv").selectExpr("chrom", "type", "CASE WHEN hap = 0 THEN 'BEGIN' ELSE 'END' END AS side", "st", "ed", "chrom AS chrom2", "st + 3000 AS st2", "ed + 3000 AS ed2", "CAST(10 AS DOUBLE) AS score", "1L AS reads", "id")


@query("combined_short_signals")
def _(read):
    return short_signals.combine(_two_regions(read), 2, 16)


@query("short_signal_breakpoints")
def _(read):
    """Combined signals with their likeliest breakpoints, paired; the cuts of a mean depth of 20."""
    cut = short_signals.cuts(20)
    rows = short_signals.combine(_two_regions(read), 2, cut["combine"], spread=reads.clip_distribution(400), accept=0.005)
    return short_signals.pair_sides(rows, cut["score"], 1)


@query("solid_short_signals", f"""WITH s AS (SELECT *, CASE WHEN hap = 0 THEN 'BEGIN' ELSE 'END' END AS side FROM {IV} x), n AS (SELECT b.id AS b, e.id AS e, b.st AS bs, row_number() OVER (PARTITION BY b.id ORDER BY e.st, e.id) AS k FROM s b JOIN s e ON b.side = 'BEGIN' AND e.side = 'END' AND b.chrom = e.chrom AND b.type = e.type AND b.st <= e.ed AND e.st <= b.ed),
    f AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY bs, b) AS j FROM n WHERE k = 1) SELECT b AS id FROM f WHERE j = 1""")
def _(read):
    return short_signals.pair_sides(_two_regions(read)).filter("side = 'SOLID'").select("id")


_SNPS = "(SELECT CAST(floor(l_orderkey / 40) AS BIGINT) AS region, l_orderkey AS read, l_suppkey % 7 AS pos, max(l_quantity > 25) AS alt FROM lineitem GROUP BY 1, 2, 3)"


@query("linked_read_scores", f"""WITH b AS (SELECT * FROM {_SNPS} z), g AS (SELECT region, pos FROM b GROUP BY 1, 2 HAVING count(*) FILTER (alt) >= 5 AND count(*) FILTER (NOT alt) >= 5)
    SELECT x.region, x.read AS r1, y.read AS r2, sum(CASE WHEN x.alt <> y.alt THEN -4 WHEN x.alt THEN 3 ELSE 1 END)::BIGINT AS score FROM b x JOIN b y ON x.region = y.region AND x.pos = y.pos AND x.read < y.read JOIN g ON g.region = x.region AND g.pos = x.pos GROUP BY 1, 2, 3""")
def _(read):
    return contigs.linked_read_scores(_snps(read))


@query("linked_read_groups")
def _(read):
    b = _snps(read)
    return contigs.group_linked_reads(contigs.linked_read_scores(b), b)


@query("linked_group_scores")
def _(read):
    b = _snps(read)
    scores = kept(contigs.linked_read_scores(b), "scores")
    return contigs.linked_group_scores(contigs.group_linked_reads(scores, b), scores)


@query("rejected_reads")
def _(read):
    """Reads that back the same line number of their region, judged by the groups that most of them are in."""
    b = _snps(read)
    groups = kept(contigs.group_linked_reads(contigs.linked_read_scores(b), b), "groups")
    backs = read("lineitem").selectExpr("CAST(floor(l_orderkey / 40) AS BIGINT) AS region", "l_orderkey AS read", "l_linenumber AS target")
    return contigs.rejected_backers(groups, backs)


def _snps(read):
    rows = read("lineitem").selectExpr("CAST(floor(l_orderkey / 40) AS BIGINT) AS region", "l_orderkey AS read", "l_suppkey % 7 AS pos", "l_quantity > 25 AS alt")
    return rows.groupBy("region", "read", "pos").agg(F.max("alt").alias("alt"))


# More rules


@query("read_classes", f"""SELECT id, CASE WHEN alt_n * 3 > ref_n + 4 AND alt_n * 3 > 5 THEN 'alt' WHEN ref_n > alt_n * 3 + 4 AND ref_n > 5 THEN 'ref' ELSE 'unknown' END AS class FROM {SV} x""")
def _(read):
    return read("sv").select("id", genotype.read_class(F.col("ref_n"), F.col("alt_n") * 3, 5).alias("class"))


@query("bayes_genotypes", f"""WITH r AS (SELECT name AS v, -(hap * 2.0 + 0.5)::DOUBLE AS rl, -((1 - hap) * 2.0 + 0.5)::DOUBLE AS al FROM {IV} x), g AS (SELECT unnest(['0/0', '0/1', '1/1']) AS gt, unnest([0.0, 0.5, 1.0])::DOUBLE AS s),
    p AS (SELECT v, gt, sum(log10((1 - s) * pow(10, rl) + s * pow(10, al))) AS ll FROM r, g GROUP BY v, gt), k AS (SELECT *, row_number() OVER w AS k, lead(ll) OVER w AS n FROM p WINDOW w AS (PARTITION BY v ORDER BY round(ll, 9) DESC, gt)) SELECT v AS id, gt, round(ll, 6) AS ll FROM k WHERE k = 1""")
def _(read):
    rows = read("iv").selectExpr("name AS id", "-(hap * 2.0D + 0.5D) AS ref_ll", "-((1 - hap) * 2.0D + 0.5D) AS alt_ll")
    return genotype.bayes_genotype(rows, {"0/0": 0.0, "0/1": 0.5, "1/1": 1.0}).select("id", "gt", F.round("ll", 6).alias("ll"))


def _contig_pairs(read):
    return read("al").select((F.col("id") % 100).alias("region"), F.col("id").alias("a_contig"), F.col("ln").alias("b_contig"), cg.parse("cigar_text").alias("cigar"), (F.col("q") + F.col("ln") + F.col("q") * 3 % 60 + 61).alias("a_length"), (F.col("q") + F.col("ln") + F.col("q") % 40 + 65).alias("b_length"))


@query("contig_variants", f"""SELECT id AS a_contig, 10 + q + ln AS a_pos, 10 + q + ln AS b_pos, 'INS' AS type, 5 + q % 40 AS length FROM {AL} x WHERE 5 + q % 40 >= 30
    UNION ALL SELECT id, 40 + q + ln, 45 + q + ln + q % 40, 'DEL', 1 + q * 3 % 60 FROM {AL} y WHERE 1 + q * 3 % 60 >= 30""")
def _(read):
    return contigs.contig_variants(_contig_pairs(read), 30).select("a_contig", "a_pos", "b_pos", "type", "length")


@query("alignment_summary", f"""SELECT id AS a_contig, 61 + q + ln + q * 3 % 60 AS a_aligned, 65 + q + ln + q % 40 AS b_aligned, 60 + q AS matched, (5 + q % 40 >= 40)::INT + (1 + q * 3 % 60 >= 40)::INT AS gaps, true AS "right" FROM {AL} x""")
def _(read):
    return contigs.alignment_summary(_contig_pairs(read), 40).select("a_contig", "a_aligned", "b_aligned", "matched", "gaps", "right")


@query("replacement_pairs", f"""SELECT id AS a_contig, 'INS' AS type, 30 AS distance, round(abs((5 + q % 40) - (1 + q * 3 % 60)) / least(5 + q % 40, 1 + q * 3 % 60)::DOUBLE, 6) AS ratio FROM {AL} x WHERE 5 + q % 40 >= 30 AND 1 + q * 3 % 60 >= 30
    UNION ALL SELECT id, 'DEL', 30, round(abs((5 + q % 40) - (1 + q * 3 % 60)) / least(5 + q % 40, 1 + q * 3 % 60)::DOUBLE, 6) FROM {AL} y WHERE 5 + q % 40 >= 30 AND 1 + q * 3 % 60 >= 30""")
def _(read):
    out = contigs.replacement_pairs(contigs.contig_variants(_contig_pairs(read), 30)).filter("distance IS NOT NULL")
    return out.select("a_contig", "type", "distance", F.round("ratio", 6).alias("ratio"))


@query("core_mappings", f"""SELECT id FROM {IV} x WHERE ed - st >= 500 AND sample >= 5 AND chrom < 6""")
def _(read):
    rows = read("iv").selectExpr("id", "st AS read_st", "ed AS read_ed", "sample AS mapq", "chrom AS chrom_id")
    return reads.core_mappings(rows, 500, 5, 6).select("id")


@query("flanking_alignments", f"""WITH p AS (SELECT id, chrom, st AS pos, name % 40 AS sample FROM {RG} x), w AS (SELECT unnest([20000, 200000]) AS w),
    j AS (SELECT p.id, w, a.st - pos AS f, pos - a.ed AS b, a.hap AS read FROM p, w JOIN {IV} a ON a.chrom = p.chrom AND a.sample = p.sample AND ((a.st - pos > 100 AND a.st - pos < w) OR (pos - a.ed > 100 AND pos - a.ed < w))),
    f AS (SELECT id, w, min(f) AS d, arg_min(read, f * 10 + read) AS r FROM j WHERE f > 100 AND f < w GROUP BY 1, 2), b AS (SELECT id, w, min(b) AS d, arg_min(read, b * 10 + read) AS r FROM j WHERE b > 100 AND b < w GROUP BY 1, 2),
    g AS (SELECT f.id, f.w, f.r AS read, b.d AS before, f.d AS behind, row_number() OVER (PARTITION BY f.id ORDER BY f.w) AS k FROM f JOIN b ON f.id = b.id AND f.w = b.w AND f.r = b.r WHERE f.d < 150000 AND b.d < 150000) SELECT id, w, read, before, behind FROM g WHERE k = 1""")
def _(read):
    points = read("rg").selectExpr("id", "chrom", "st AS pos", "name % 40 AS sample")
    return reads.flanking_alignments(points, read("iv").withColumn("read", F.col("hap")), 100, (20_000, 200_000), 150_000)


@query("strong_signals", f"""SELECT id FROM {SV} x WHERE CASE WHEN hap = 1 THEN (ref_n + alt_n) * 10 >= 50 AND least(ref_n, alt_n) * 10 >= 15 ELSE (ref_n + alt_n) * 10 >= 100 END""")
def _(read):
    rows = read("sv").selectExpr("id", "hap = 1 AS solid", "ref_n * 10 AS score_b", "alt_n * 10 AS score_e")
    return reads.strong_signals(rows).select("id")


@query("small_signals")
def _(read):
    ev = read("ev").groupBy("read").agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.lit(20).alias("len")))).alias("edits"))
    return reads.small_signals(ev.select(F.col("read").alias("read_name"), F.lit(1).alias("chrom"), "edits"), 20_000, 10, 35)


@query("clustered_contigs")
def _(read):
    rows = read("seq").selectExpr("CAST(CAST(floor(id / 30) AS BIGINT) AS STRING) AS region", "CAST(id AS STRING) AS contig", "id AS ord", "length(s) AS n")
    other = rows.selectExpr("region", "contig AS b_contig", "n AS m")
    differ = rows.join(other, "region").filter("contig < b_contig AND abs(n - m) > 400").selectExpr("region", "contig AS a_contig", "b_contig")
    return contigs.cluster_contigs(rows, differ)


@query("insert_vntr_length")
def _(read):
    inserts = read("rg").select(F.col("id").alias("name"), (1000 + F.col("id") % 3000).alias("length"))
    lines = read("lineitem")
    trf = lines.selectExpr("l_orderkey AS name", f"{_TANDEM} AS st", f"{_TANDEM} + CAST(l_quantity AS INT) * 4 AS ed", "l_linenumber + 3 AS motif_size")
    rm = lines.selectExpr("l_orderkey AS name", f"{_ANNOTATED} AS st", f"{_ANNOTATED} + l_linenumber * 40 AS ed", "CASE WHEN l_returnflag = 'R' THEN 'Simple_repeat' ELSE 'LINE/L1' END AS class")
    return contigs.insert_vntr_length(inserts, rm, trf)


@query("hybrid_genotypes", f"""WITH l AS (SELECT id, {_GT} AS gt, ref_n, alt_n FROM {SV} x), s AS (SELECT id, {_SGT} AS gt, ref_n * 4 AS ref_n, alt_n % 3 AS alt_n FROM {SV} y WHERE a1 = 1)
    SELECT l.id, CASE WHEN l.alt_n = 1 AND l.ref_n >= 1 AND s.ref_n >= 20 * s.alt_n THEN '0/0' WHEN l.ref_n = 0 AND l.alt_n < 4 AND s.gt IS NOT NULL THEN s.gt ELSE l.gt END AS gt FROM l LEFT JOIN s USING (id)""")
def _(read):
    r, a, u = F.col("ref_n"), F.col("alt_n"), F.col("unknown_n")
    long = read("sv").withColumn("gt", genotype.long_read_genotype(r, a))
    short = read("sv").filter("a1 = 1").select("id", genotype.short_read_genotype(r, a, u).alias("gt"), (r * 4).alias("ref_n"), (a % 3).alias("alt_n"))
    return genotype.with_short_support(long, short).select("id", F.col("gt_hybrid").alias("gt"))


@query("allele_lengths", f"""WITH v AS (SELECT id, chrom, sample, svlen, greatest(1, 1 - svlen) AS r, greatest(1, 1 + svlen) AS a FROM {SV} x) SELECT id, a - r AS allele_length, CASE WHEN a < r THEN 'DEL' ELSE 'INS' END AS allele_type FROM v WHERE abs(a - r) >= 50""")
def _(read):
    rows = read("sv").withColumn("ref", F.repeat(F.lit("A"), F.greatest(F.lit(1), 1 - F.col("svlen")).cast("int"))).withColumn("alt", F.repeat(F.lit("A"), F.greatest(F.lit(1), 1 + F.col("svlen")).cast("int")))
    return genotype.allele_length_variants(rows).select("id", "allele_length", "allele_type")


@query("colours", f"""WITH c AS (SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS vntr, o_custkey % 2 AS a, o_custkey % 3 AS b, o_custkey % 5 % 2 AS c, o_orderkey % 7 % 3 AS d FROM orders)
    SELECT id, CASE WHEN vntr THEN CASE WHEN b > 0 THEN 'green' WHEN a > 0 THEN 'yellow' ELSE 'black' END WHEN c > 0 AND d > 0 THEN 'red' WHEN c > 0 THEN 'purple' WHEN d > 0 THEN 'blue' ELSE 'black' END AS colour FROM c""")
def _(read):
    rows = read("orders").selectExpr("o_orderkey AS id", "o_orderkey % 2 = 0 AS vntr", "o_custkey % 2 AS class_1", "o_custkey % 3 AS class_2", "o_custkey % 5 % 2 AS class_3", "o_orderkey % 7 % 3 AS class_4")
    return contigs.colours(rows).select("id", "colour")


_PHASES = "CASE WHEN gt = '0/1' THEN CASE WHEN hap = 0 THEN '0|1' ELSE '1|0' END WHEN gt = '1/1' THEN '1|1' ELSE '0|0' END"


@query("phased_genotypes", f"""SELECT id, {_PHASES} AS gt FROM (SELECT *, {_GT} AS gt FROM {SV} x)""")
def _(read):
    gt = genotype.long_read_genotype(F.col("ref_n"), F.col("alt_n"))
    return read("sv").select("id", genotype.phase(gt, F.col("hap"), F.lit(2), F.col("sample")).alias("gt"))


@query("same_variants", f"""SELECT a.id AS id, b.id AS other, abs(a.pos - b.pos) <= 15 AND abs(a.svlen - b.svlen) <= 5 AS deletion, a.pos = b.pos AND abs(a.svlen - b.svlen) <= 10 AS insertion,
    abs(a.pos - b.pos) <= 200 AND abs(a.pos + a.svlen - b.pos - b.svlen) <= 200 AND a.svlen / b.svlen::DOUBLE > 0.7 AND a.svlen / b.svlen::DOUBLE < 1.5 AS inversion FROM {SV} a JOIN {SV} b ON a.chrom = b.chrom AND a.id <> b.id AND abs(a.pos - b.pos) <= 200 AND a.svlen <> 0 AND b.svlen <> 0""")
def _(read):
    sv = read("sv").filter("svlen <> 0").withColumn("st", F.col("pos")).withColumn("ed", F.col("pos")).withColumn("ref", F.lit("N")).withColumn("alt", F.lit("A"))
    pairs = ops.overlap_join(sv, sv, 1000, 200).filter("id <> r_id")
    rules = cohort.same_variant("", "r_")
    return pairs.select("id", F.col("r_id").alias("other"), *(rules[k].alias(k) for k in ("deletion", "insertion", "inversion")))


@query("attached_annotations", f"""SELECT a.id AS annotation, r.id AS region FROM {IV} a JOIN {RG} r ON a.name = r.id""")
def _(read):
    known = read("rg").select(F.col("id").alias("name"), F.col("id").alias("region"), (F.col("ed") - F.col("st")).alias("length"))
    return contigs.attach_annotations(known, read("iv").select("name", F.col("id").alias("annotation"))).select("annotation", "region")


@query("normal_depth_signals", f"""WITH d AS (SELECT chrom, st // 32 AS block, count(*) AS n FROM {IV} x GROUP BY 1, 2), r AS (SELECT id, chrom, unnest(generate_series(st // 32, ed // 32)) AS block FROM {RG} y),
    p AS (SELECT id, avg(coalesce(n, 0) / 0.1::DOUBLE) AS a, max(coalesce(n, 0) / 0.1::DOUBLE) AS m FROM r LEFT JOIN d USING (chrom, block) GROUP BY id) SELECT id FROM p WHERE m <= 15 AND a <= 1""")
def _(read):
    return reads.normal_depth_signals(read("rg"), reads.region_depth(read("rg"), reads.block_depth(read("iv")), 0.1), 15, 1).select("id")


@query("region_signals", f"""SELECT chrom, st AS pos, ed AS "end", 'X' AS type, 1000 AS support FROM {RG} x""")
def _(read):
    return reads.region_signals(read("rg"))


@query("piled_up", f"""WITH b AS (SELECT chrom, pos AS p, q + ln AS k, flag % 4 AS f FROM {AL} x), m AS (SELECT chrom, p + i AS pos, substring('ACGT', 1 + CAST((f + i) % 4 AS INT), 1) AS b FROM b, (SELECT unnest(generate_series(0, 9)) AS i)), d AS (SELECT chrom, p + 10 + i AS pos, 'D' AS b FROM b, (SELECT unnest(generate_series(0, 2)) AS i)),
    n AS (SELECT chrom, p + 13 AS pos, 'I' AS b FROM b), u AS (SELECT * FROM m UNION ALL SELECT * FROM d UNION ALL SELECT * FROM n) SELECT chrom, pos, {", ".join(f"count(*) FILTER (b = '{k}') AS {k}" for k in "ACGTDI")} FROM u GROUP BY 1, 2""")
def _(read):
    rows = read("al").select("chrom", "pos", cg.parse(F.lit("10=3D2I")).alias("cigar"), F.concat(F.substring(F.repeat(F.lit("ACGT"), 4), F.col("flag") % 4 + 1, F.lit(10)), F.lit("GG")).alias("seq"))
    return reads.pile_up(rows).select("chrom", "pos", *"ACGTDI")


# Sources and sinks: lines made of a table's columns are written and read back


def _folder(df: DataFrame) -> str:
    """A new folder that driver and executors share, deleted when the session ends."""
    return new_folder(df.sparkSession, "lines")


def _written(rows: DataFrame, *columns: str, sep: str = "\t") -> str:
    """The folder of a text file with the given expressions as fields."""
    path = _folder(rows)
    rows.select(F.concat_ws(sep, *(F.expr(c).cast("string") for c in columns)).alias("value")).write.text(path)
    return path


@query("vcf_written_and_read", f"""WITH v AS (SELECT *, pos + 1 AS p, {_GT} AS gt FROM {SV} x), w AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY p, svlen, CAST(id AS VARCHAR)) - 1 AS k FROM v WHERE gt <> '0/0')
    SELECT chrom::VARCHAR AS chrom, p::INT AS pos, k || '_' || chrom || '_' || svtype || '_' || p || '_' || (CASE WHEN svlen < 0 THEN p - svlen ELSE p END) || '_' || abs(svlen) AS id, id::VARCHAR AS alt, svtype, svlen::INT AS svlen, (CASE WHEN svlen < 0 THEN p - svlen ELSE p END)::INT AS ed, gt, ref_n || ',' || alt_n || ',' || unknown_n AS lr, svlen::VARCHAR AS sl, sample || ',' || hap || ',2,0,1' AS "if" FROM w""")
def _(read):
    r, a, u = F.col("ref_n"), F.col("alt_n"), F.col("unknown_n")
    sv = read("sv").withColumn("pos", F.col("pos") + 1).withColumn("ref", F.lit("N")).withColumn("alt", F.col("id").cast("string")).withColumn("filter", F.lit("PASS")).withColumn("gt", genotype.long_read_genotype(r, a))
    sv = sv.withColumn("q", genotype.qualities(r, a, u, F.col("gt"))).select("chrom", "pos", "ref", "alt", "q.qual", "q.gq", "filter", "svtype", "svlen", "gt", F.array(r, a, u).cast("array<int>").alias("lr"), F.lit(None).cast("array<int>").alias("sr"), F.array("sample", "hap", F.lit(2), F.lit(0), F.lit(1)).cast("array<int>").alias("if_ids"))
    path = _folder(sv)
    variants.write_vcf(sv, path)
    back = variants.read_vcf(sv.sparkSession, path)
    return back.select("chrom", "pos", "id", "alt", "svtype", "svlen", "ed", "gt", F.array_join(F.col("lr").cast("array<string>"), ",").alias("lr"), F.element_at("format", "SL").alias("sl"), F.element_at("format", "IF").alias("if"))


@query("bed_read", f"""SELECT 'c' || chrom AS chrom, st::INT AS st, ed::INT AS ed, name || ',' || type AS rest FROM {IV} x""")
def _(read):
    path = _written(read("iv"), "concat('c', chrom)", "st", "ed", "name", "type")
    return regions.read_bed(read("iv").sparkSession, path).select("chrom", "st", "ed", F.array_join("rest", ",").alias("rest"))


@query("fasta_slices", f"""SELECT id::VARCHAR AS name, substring(s, 51, 1900) AS seq FROM {SEQ} x WHERE length(s) >= 1950""")
def _(read):
    rows = read("seq")
    path = _folder(rows)
    rows.select(F.concat(F.lit(">"), F.col("id").cast("string"), F.lit(" text\n"), regions.folded(F.col("s"))).alias("value")).write.text(path)
    chunks = fasta_chunks(rows.sparkSession, path, 400)
    spots = sequence_lengths(rows.sparkSession, path).filter("length >= 1950").select(F.col("name").alias("id"), F.col("name").alias("chrom"), F.lit(50).alias("st"), F.lit(1950).alias("ed"))
    return regions.ref_slice(spots, chunks, 400).select(F.col("chrom").alias("name"), "seq")


@query("sam_read", f"""SELECT id::VARCHAR AS read_name, flag, 'c' || chrom AS chrom, pos, mapq, 'c' || mate_chrom AS mate_chrom, mate_pos, isize, nm, 'c1,' || pos || ',+,5M,1,0;' AS sa, 10 + q + ln + 30 + 1 + q * 3 % 60 + 20 AS length FROM {AL} x""")
def _(read):
    mate = "CASE WHEN mate_chrom = chrom THEN '=' ELSE concat('c', mate_chrom) END"
    path = _written(read("al"), "read_name", "flag", "concat('c', chrom)", "pos + 1", "mapq", "cigar_text", mate, "mate_pos + 1", "isize", "'*'", "'*'", "concat('NM:i:', nm)", "concat('SA:Z:c1,', pos, ',+,5M,1,0;')")
    rows = regions.read_alignments(read("al").sparkSession, path)
    return rows.select("read_name", "flag", "chrom", "pos", "mapq", "mate_chrom", "mate_pos", "isize", "nm", "sa", cg.reference_length("cigar").alias("length"))


@query("features_read", f"""SELECT 'chr' || chrom AS chrom, type, st::INT AS st, ed::INT AS ed, 'ID=' || id AS attributes FROM {RG} x""")
def _(read):
    path = _written(read("rg"), "chrom", "'made'", "type", "st", "ed", "'.'", "'+'", "'.'", "concat('ID=', id)")
    return regions.read_features(read("rg").sparkSession, path, True).select("chrom", "type", "st", "ed", "attributes")


@query("repeats_read", f"""SELECT 'n' || name AS name, st::INT AS st, ed::INT AS ed, CASE WHEN hap = 0 THEN 'SINE/Alu' ELSE 'Simple_repeat' END AS class, hap = 0 AS mobile, CASE WHEN hap = 0 THEN 'SINE' END AS type FROM {IV} x""")
def _(read):
    kind = "CASE WHEN hap = 0 THEN 'SINE/Alu' ELSE 'Simple_repeat' END"
    path = _written(read("iv"), "'  239'", "'1.0'", "'2.0'", "'3.0'", "concat('n', name)", "st", "ed", "'(10)'", "'+'", "'AluY'", kind, "1", "45", "'(0)'", "id", sep="  ")
    rows = regions.read_repeatmasker(read("iv").sparkSession, path)
    return rows.select("name", "st", "ed", "class", sq.is_mobile("class").alias("mobile"), sq.mobile_type("class").alias("type"))


@query("tandem_read", f"""SELECT 'n' || id AS name, 0 AS st, least(ed - st + 15, 30 + id % 50 + 10)::INT AS ed, 'AC' AS motif FROM {RG} x WHERE 30 + id % 50 >= 40""")
def _(read):
    rows = read("rg")
    path = _folder(rows)
    fields = F.concat_ws(" ", F.lit(1), F.lit(30) + F.col("id") % 50 + 1, F.lit("2 25.0 2 0 0 0 0 0 0 0 0"), F.lit("AC ACAC L R"))
    rows.select(F.concat(F.lit("@n"), F.col("id").cast("string"), F.lit(" x\n"), fields).alias("value")).write.text(path)
    known = rows.select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), (F.col("ed") - F.col("st") + 15).cast("int").alias("length"))
    return regions.extend_trf(regions.read_trf(rows.sparkSession, path, 40), known).select("name", "st", "ed", "motif")


@query("cohort_written_and_read", f"""SELECT chrom::VARCHAR AS chrom, pos::INT AS pos, svlen::INT AS svlen, count(*) AS n, min(sample)::INT AS first FROM {SV} x GROUP BY chrom, pos, svlen""")
def _(read):
    merged = cohort.merge_cohort(read("sv").withColumn("ref", F.lit("N")).withColumn("alt", F.lit("A")).withColumn("qual", F.col("alt_n")))
    path = _folder(merged)
    variants.write_cohort(merged, path)
    back = variants.read_cohort(merged.sparkSession, path)
    return back.select("chrom", "pos", "svlen", F.size("support").cast("long").alias("n"), F.expr("support[0].sample").alias("first"))


@query("force_contigs_read", f"""SELECT chrom || ':' || st || '-' || ed AS region, 'c' || id AS contig, (name % 5)::INT AS support FROM {RG} x WHERE name % 5 > 1""")
def _(read):
    path = _written(read("rg"), "concat('REF_REGION=', chrom, ':', st, '-', ed)", "'STAT=OK'", "concat('GT:CI=0/1:c', id)", "concat('SUP_R=', name % 5, ':IS_FINAL=1')", "'CONTIG_STR=ACGT'")
    return regions.well_supported(regions.read_force_contigs(read("rg").sparkSession, path)).select("region", "contig", "support")


@query("mappability_read", f"""SELECT 'c' || id AS chrom, st - 1 + i AS pos, (id + i) / 4.0::DOUBLE AS value FROM {RG} x, (SELECT unnest([0, 1, 2]) AS i) WHERE st > 0""")
def _(read):
    rows = read("rg").filter("st > 0")
    path = _folder(rows)
    values = F.array_join(F.transform(F.array(*map(F.lit, range(3))), lambda i: ((F.col("id") + i) / 4).cast("string")), "\n")
    rows.select(F.concat(F.lit("fixedStep chrom=c"), F.col("id").cast("string"), F.lit(" start="), F.col("st").cast("string"), F.lit(" step=1\n"), values).alias("value")).write.text(path)
    return regions.read_wigfix(rows.sparkSession, path).select("chrom", F.col("pos").cast("long").alias("pos"), "value")


@query("mei_regions_read", f"""SELECT 'chr' || chrom || '_' || st || '_' || ed AS name, 'chr' || chrom AS chrom, st::INT AS st, ed::INT AS ed FROM {RG} x""")
def _(read):
    path = _written(read("rg"), "concat('chr', chrom)", "st", "ed", sep="_")
    return regions.read_mei_regions(read("rg").sparkSession, path)


@query("kmer_profile_read", """SELECT translate(o_orderkey::VARCHAR, '0123456789', 'ACGTACGTAC') AS kmer, o_custkey / 8.0::DOUBLE AS prob FROM orders""")
def _(read):
    path = _written(read("orders"), "translate(CAST(o_orderkey AS STRING), '0123456789', 'ACGTACGTAC')", "o_custkey / 8")
    return regions.read_kmer_profile(read("orders").sparkSession, path)


@query("contigs_by_region", f"""SELECT 'r' || chrom AS region, 'refr' || chrom AS name, 'ACGT' AS seq FROM (SELECT DISTINCT chrom FROM {RG} x) UNION ALL SELECT 'r' || chrom, name || '_r' || chrom || '_' || id, repeat('AC', 50) FROM {RG} y""")
def _(read):
    rows = read("rg").withColumn("region", F.concat(F.lit("r"), F.col("chrom").cast("string")))
    path = _folder(rows)
    own = rows.select("region", F.col("name").cast("string").alias("sample"), F.col("id").cast("string").alias("contig"), F.repeat(F.lit("AC"), 50).alias("seq"))
    regions.write_contigs_by_region(own, rows.select("region").distinct().withColumn("seq", F.lit("ACGT")), path)
    back = regions.read_fasta(rows.sparkSession, f"{path}/region=*")
    return back.select(F.concat(F.lit("r"), F.regexp_extract("name", r"r(\d+)(_\d+)?$", 1)).alias("region"), "name", "seq")


@query("local_repeat_index", f"""WITH w AS (SELECT id, unnest(generate_series(0, length(s) - 600, 300)) AS p, s FROM {SEQ} x WHERE length(s) >= 600), t AS (SELECT id, p, substring(s, p + 1, 600) AS s FROM w)
    SELECT id::VARCHAR AS chrom, p::INT AS pos, greatest({", ".join(f"CASE WHEN len(list_distinct({KMERS.format(k=k)})) < len({KMERS.format(k=k)}) THEN {k} ELSE 0 END" for k in range(20, 181, 20))})::INT AS k FROM t WHERE k > 0""")
def _(read):
    chunks = regions.chunked(read("seq").select(F.col("id").cast("string").alias("name"), F.col("s").alias("seq")), 700)
    path = _folder(chunks)
    regions.write_local_repeat(regions.local_repeat_index(chunks, 600, 300, 700), path)
    return regions.read_local_repeat(chunks.sparkSession, path)


@query("isize_json", f"""SELECT quantile_cont(ed - st, 0.01) AS least, quantile_cont(ed - st, 0.5) AS median, count(*) AS pairs FROM {RG} x""")
def _(read):
    stats = reads.isize_stats(read("rg").select((F.col("ed") - F.col("st")).alias("isize")))
    path = _folder(stats)
    regions.write_isize_json(stats, path)
    return regions.read_isize_json(stats.sparkSession, path).select("least", "median", "pairs")


def _compared(read):
    """Regions of fifty lines: clusters, their differences and runs, from keys."""
    sv = read("lineitem").selectExpr("CAST(CAST(floor(l_orderkey / 12) AS BIGINT) AS STRING) AS region", "CAST(l_partkey % 4 AS INT) AS a", "CAST((l_partkey + 1 + l_suppkey % 3) % 4 AS INT) AS b", "CAST((l_partkey * 7 + l_linenumber) % 100 AS INT) AS pos", "CAST(l_suppkey % 5 AS INT) AS class")
    runs = sv.select("region").distinct().withColumn("r", F.explode(F.array(*(F.struct(F.lit(k).alias("run"), F.lit(st).alias("st"), F.lit(ed).alias("ed"), F.lit(v).alias("vntr")) for k, st, ed, v in ((0, 0, 99, False), (1, 0, 39, False), (2, 40, 69, True), (3, 70, 99, False)))))).select("region", "r.*")
    clusters = sv.select("region", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("cluster")).distinct()
    return clusters, sv, runs


@query("subregion_clusters")
def _(read):
    out = contigs.subregion_clusters(*_compared(read))
    return out.withColumn("places", F.concat_ws(",", F.col("places").cast("array<string>")))


@query("corrected_colours")
def _(read):
    """Labels and corrected sizes of the sub-regions' clusters."""
    out = contigs.subregion_clusters(*_compared(read))
    places = out.select("region", "run", F.explode("places").alias("pos"))
    rows = contigs.colours(out).select("region", "run", F.col("n_clusters").alias("size"), "only_purple", "colour")
    return contigs.corrected_colours(rows, places)


@query("complex_runs", """WITH s AS (SELECT CAST(CAST(floor(l_orderkey / 12) AS BIGINT) AS VARCHAR) AS region, l_partkey % 4 AS a, (l_partkey + 1 + l_suppkey % 3) % 4 AS b, (l_partkey * 7 + l_linenumber) % 100 AS pos FROM lineitem),
    r AS (SELECT unnest([0, 1, 3]) AS run, unnest([0, 0, 70]) AS st, unnest([99, 39, 99]) AS ed) SELECT DISTINCT region, run FROM (SELECT region, run, a, b FROM s JOIN r ON pos BETWEEN st AND ed GROUP BY ALL HAVING count(*) >= 2)""")
def _(read):
    _, sv, runs = _compared(read)
    return contigs.complex_runs(sv, runs)


# Differences between contigs

query("reference_places", contig_queries.REFERENCE_PLACES)(contig_queries.reference_places)
query("mismatch_regions", contig_queries.MISMATCH_REGIONS)(contig_queries.mismatch_regions)
query("nested_differences")(contig_queries.nested_differences)
query("difference_classes", contig_queries.DIFFERENCE_CLASSES)(contig_queries.difference_classes)


# Genotypes in whole numbers, and places carried over by alignments

_ADD = "list_reduce({}, lambda x, y: greatest(x, y) + CASE WHEN abs(x - y) >= 20 THEN 0 ELSE floor(10 * log10(1 + pow(10, -abs(x - y) / 10.0)) + 0.5)::BIGINT END)"


def _genotype_sql(haplotypes: dict[str, str], mode: str) -> str:
    """The rule in SQL: haplotypes by their column of `iv`."""
    names, kinds = genotype.MODES[mode]
    none = genotype.IMPOSSIBLE
    of_read = lambda k: "greatest(-80, " + _ADD.format(f"[{none}::BIGINT, " + ", ".join(f"{haplotypes[h]} + {genotype.GENOTYPES[k][1].get(h, none)}" for h in names) + "]") + ")"
    sums = ", ".join(f'sum({of_read(k)})::BIGINT AS "{k}"' for k in kinds)
    columns = ", ".join(f'"{k}"' for k in kinds)
    best = "CASE " + " ".join(f"""WHEN "{k}" = greatest({columns}) AND "{k}" > {none} THEN '{k}'""" for k in kinds) + f" ELSE '{kinds[0]}' END"
    each = ", ".join(f"""{{'k': '{k}', 'p': "{k}" - t}}""" for k in kinds)
    gts = " ".join(f"WHEN '{k}' THEN '{genotype.GENOTYPES[k][0]}'" for k in kinds)
    others = _ADD.format(f"[{none}::BIGINT] || list_transform(list_filter([{each}], lambda x: x.k <> kind), lambda x: x.p)")
    return f"""WITH s AS (SELECT name AS id, {sums} FROM {IV} x GROUP BY 1), t AS (SELECT *, {_ADD.format(f"[{none}::BIGINT, {columns}]")} AS t, {best} AS kind FROM s)
        SELECT id, kind, CASE kind {gts} END AS gt, -({others}) AS score, {columns} FROM t"""


_LIKELIHOODS = {"alt": "-(hap * 23 + id % 7)", "ref": "-((1 - hap) * 19 + id % 5)", "noise": "-20", "somatic": "-(sample % 9)"}


@query("log_genotypes", _genotype_sql(_LIKELIHOODS, "germline"))
def _(read):
    return genotype.log_genotype(read("iv").selectExpr("name AS id", *(f"{v} AS {k}" for k, v in _LIKELIHOODS.items())))


@query("somatic_genotypes", _genotype_sql(_LIKELIHOODS, "somatic"))
def _(read):
    return genotype.log_genotype(read("iv").selectExpr("name AS id", *(f"{v} AS {k}" for k, v in _LIKELIHOODS.items())), "somatic")


_CHAINS = f"""SELECT id AS chain, chrom, q + ln + q % 40 + 65 + ln * 300 AS length, CASE WHEN q % 2 = 0 THEN '-' ELSE '+' END AS strand, mate_chrom AS to_chrom, pos AS to_st, concat(10 + q, '=', ln, 'X', 5 + q % 40, 'I30=', 1 + q * 3 % 60, 'D20=', ln * 300, 'S') AS cigar_text, q, ln FROM {{}}"""
#: Blocks of the chains from the source's beginning: place, size, and place on the other side.
_BLOCKS = f"""c AS ({_CHAINS.format(f"{AL} x")}), b AS (SELECT *, unnest([{{'f': 0, 'n': 10 + q, 't': 0}}, {{'f': 10 + q, 'n': ln, 't': 10 + q}}, {{'f': 15 + q + ln + q % 40, 'n': 30, 't': 10 + q + ln}}, {{'f': 45 + q + ln + q % 40, 'n': 20, 't': 41 + q + ln + q * 3 % 60}}]) AS s FROM c),
    k AS (SELECT chain, chrom, to_chrom, strand, 60 + q + ln AS score, CASE WHEN strand = '-' THEN length - s.f - s.n ELSE s.f END AS st, s.n AS n, to_st + s.t AS tt FROM b)"""


def _chains(read):
    return read("al").selectExpr(*(x.strip() for x in ["id AS chain", "chrom", "q + ln + q % 40 + 65 + ln * 300 AS length", "CASE WHEN q % 2 = 0 THEN '-' ELSE '+' END AS strand", "mate_chrom AS to_chrom", "pos AS to_st", "cigar_text"])).withColumn("cigar", cg.parse("cigar_text")).drop("cigar_text")


@query("lift_points", f"""WITH {_BLOCKS}, p AS (SELECT id, chrom, id % 2500 AS pos FROM {RG} x),
    h AS (SELECT p.id, k.to_chrom, k.strand, k.chain, CASE WHEN k.strand = '-' THEN k.tt + k.st + k.n - 1 - p.pos ELSE k.tt + p.pos - k.st END AS to_pos, row_number() OVER (PARTITION BY p.id ORDER BY score DESC, chain) AS j FROM p JOIN k ON p.chrom = k.chrom AND p.pos BETWEEN k.st AND k.st + k.n - 1)
    SELECT p.id, to_chrom, to_pos, strand, chain FROM p LEFT JOIN (SELECT * FROM h WHERE j = 1) h ON h.id = p.id""")
def _(read):
    points = read("rg").selectExpr("id", "chrom", "id % 2500 AS pos")
    return ops.lift_points(points, _chains(read), width=100).select("id", "to_chrom", "to_pos", "strand", "chain")


@query("lift_spans", f"""WITH {_BLOCKS}, p AS (SELECT id, chrom, id % 2300 AS st, id % 2300 + id % 90 AS ed FROM {RG} x), j AS (SELECT p.id, k.*, greatest(p.st, k.st) AS a, least(p.ed, k.st + k.n - 1) AS z FROM p JOIN k ON p.chrom = k.chrom AND p.st <= k.st + k.n - 1 AND k.st <= p.ed),
    l AS (SELECT id, chain, score, to_chrom, strand, min(CASE WHEN strand = '-' THEN tt + st + n - 1 - z ELSE tt + a - st END) AS to_st, max(CASE WHEN strand = '-' THEN tt + st + n - 1 - a ELSE tt + z - st END) AS to_ed, sum(z - a + 1)::BIGINT AS lifted FROM j GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lifted DESC, score DESC, chain) AS i FROM l) SELECT p.id, to_chrom, to_st, to_ed, strand, chain, lifted FROM p LEFT JOIN (SELECT * FROM r WHERE i = 1) r ON r.id = p.id""")
def _(read):
    spans = read("rg").selectExpr("id", "chrom", "id % 2300 AS st", "id % 2300 + id % 90 AS ed")
    return ops.lift_spans(spans, _chains(read), width=100).select("id", "to_chrom", "to_st", "to_ed", "strand", "chain", "lifted")


# Written calls with all fields, the cohort job, and operators on reads and regions

_FULL = f"""SELECT *, pos + 1 AS p, CASE WHEN id % 5 = 0 THEN 'BND' ELSE svtype END AS kind, id % 3 = 0 AS imprecise, id % 4 = 0 AS vntr, id % 8 = 0 AS low FROM {SV} x"""


@query("vcf_all_fields", f"""SELECT id::VARCHAR AS alt, kind AS svtype, CASE WHEN kind <> 'BND' THEN svlen END::INT AS svlen, CASE WHEN kind <> 'BND' THEN CASE WHEN svlen < 0 THEN p - svlen ELSE p END END::INT AS ed, CASE WHEN kind = 'BND' THEN 'N[' || chrom || ':' || pos || '[' END AS bnd_type,
    imprecise, (kind <> 'BND' AND vntr) AS vntr, (kind <> 'BND' AND low) AS low, CASE WHEN id % 6 = 0 THEN chrom || ':' || pos END AS contig_pos, CASE WHEN id % 6 = 0 THEN '10M' END AS cigar, CASE WHEN id % 6 = 0 THEN 'ACGT' END AS contig, CASE WHEN id % 7 = 0 THEN 'TUMOR_UNIQ' END AS somatic FROM ({_FULL}) v""")
def _(read):
    sv = read("sv").selectExpr(
        "chrom", "pos + 1 AS pos", "'N' AS ref", "CAST(id AS STRING) AS alt", "1 AS qual", "1 AS gq", "'PASS' AS filter", "IF(id % 5 = 0, 'BND', svtype) AS svtype", "svlen", "'0/1' AS gt", "CAST(NULL AS ARRAY<INT>) AS lr", "CAST(NULL AS ARRAY<INT>) AS sr",
        "IF(id % 5 = 0, concat('N[', chrom, ':', pos, '['), NULL) AS bnd_type", "id % 3 = 0 AS imprecise", "id % 4 = 0 AS vntr", "id % 8 = 0 AS vntr_depth_low",
        "concat(chrom, ':', pos) AS contig_pos", "IF(id % 6 = 0, '10M', NULL) AS contig_cigar", "'ACGT' AS contig", "IF(id % 7 = 0, 'TUMOR_UNIQ', NULL) AS somatic",
    )
    path = _folder(sv)
    variants.write_vcf(sv, path, sv.groupBy(F.col("chrom").alias("name")).agg(F.lit(20_000_000).alias("length")))
    back = variants.read_vcf(sv.sparkSession, path)
    tag = lambda k: F.try_element_at("info", F.lit(k))
    flag = lambda k: F.map_contains_key("info", k)
    return back.select("alt", "svtype", "svlen", "ed", tag("BND_TYPE").alias("bnd_type"), flag("IMPRECISE").alias("imprecise"), flag("VNTR").alias("vntr"), flag("VNTR_DepthLow").alias("low"), tag("CONTIG_POSITION").alias("contig_pos"), tag("CIGAR").alias("cigar"), tag("CONTIG").alias("contig"), tag("SOMATIC").alias("somatic"))


_CALLS = f"(SELECT id * 2 + h AS id, sample, h AS hap, chrom, pos AS st, CASE WHEN svlen < 0 THEN pos - svlen ELSE pos END AS ed FROM {SV} s, (SELECT unnest([1, 2]) AS h) WHERE abs(svlen) >= 50 AND CASE WHEN h = 1 THEN a1 ELSE a2 END = 1)"


@query("cohort_job", f"""WITH h AS ({_CALLS}), f AS ({_frequency_sql("(SELECT * FROM h a WHERE EXISTS (SELECT 1 FROM h b WHERE a.sample = b.sample AND a.hap = b.hap AND a.chrom = b.chrom AND a.id <> b.id AND (abs(a.st - b.st) <= 2000 OR abs(a.st - b.ed) <= 2000 OR abs(a.ed - b.st) <= 2000 OR abs(a.ed - b.ed) <= 2000)))", 1)})
    SELECT f.chrom, f.st, f.ed, max_ac, c.id AS contig FROM f JOIN {RG} c ON f.chrom = c.chrom AND f.st <= c.ed AND c.st <= f.ed WHERE c.id % 3 > 1 UNION ALL SELECT chrom, st, ed, max_ac, NULL FROM f""")
def _(read):
    """From calls to the regions where several lie close together, and to the contigs to look at there (regions alone, too)."""
    calls = read("sv").withColumn("filter", F.lit("PASS")).withColumn("ref", F.lit("N")).withColumn("alt", F.col("id").cast("string"))
    found = plan.csv_regions(plan.haplotype_calls(calls), 1, 2000).select("chrom", "st", "ed", "max_ac")
    contigs_ = read("rg").select("chrom", "st", "ed", F.col("id").alias("contig"), (F.col("id") % 3).alias("support"))
    hit = plan.region_contigs(found, contigs_).select("chrom", "st", "ed", "max_ac", F.col("r_contig").alias("contig"))
    return hit.unionByName(found.withColumn("contig", F.lit(None).cast("long")))


@query("read_density", f"""WITH o AS (SELECT id, chrom, pos AS st, pos + 9 + q AS ed, '=' AS op, 10 + q AS n FROM {AL} a UNION ALL SELECT id, chrom, pos + 10 + q, pos + 9 + q + ln, 'X', ln FROM {AL} b UNION ALL SELECT id, chrom, {_INS}, {_INS}, 'I', 5 + q % 40 FROM {AL} c
    UNION ALL SELECT id, chrom, {_INS}, {_INS} + 29, '=', 30 FROM {AL} d UNION ALL SELECT id, chrom, {_INS} + 30, {_INS} + 30 + q * 3 % 60, 'D', 0 FROM {AL} e UNION ALL SELECT id, chrom, {_INS} + 31 + q * 3 % 60, {_INS} + 50 + q * 3 % 60, '=', 20 FROM {AL} f),
    j AS (SELECT r.id, o.id AS read, op, n, greatest(0, least(r.ed - 11, o.ed) - greatest(r.st + 10, o.st) + 1) AS k FROM {RG} r JOIN o ON r.chrom = o.chrom AND r.st + 10 <= o.ed AND o.st <= r.ed - 10),
    p AS (SELECT id, read, coalesce(sum(k) FILTER (op = '='), 0) AS m, coalesce(sum(k) FILTER (op = 'X'), 0) AS x, count(*) FILTER (op = 'I') AS i, coalesce(sum(n) FILTER (op = 'I'), 0) AS ib, coalesce(sum(k) FILTER (op = 'D'), 0) AS db FROM j GROUP BY id, read)
    SELECT id, count(*) AS reads, round(avg(m), 6) AS matches, round(avg(x), 6) AS mismatches, round(avg(i), 6) AS insertions, round(avg(ib), 6) AS inserted, round(avg(db), 6) AS deleted, round(avg(m / (m + x + 0.001)), 6) AS identity FROM p GROUP BY id""")
def _(read):
    out = context.read_density(read("al").withColumn("cigar", cg.parse("cigar_text")), read("rg"), 10)
    names = ["matches", "mismatches", "insertions", "inserted", "deleted", "identity"]
    return out.select("id", "reads", *(F.round(f"mean_{n}", 6).alias(n) for n in names))


_MAP = f"SELECT chrom, st // 1000 AS block, count(*) AS n, max(name % 400) AS k, max(sample) AS s FROM {IV} x GROUP BY 1, 2"
_MAP_SCORES = "round(n_sv / nullif(n_sv + n_blank, 0)::DOUBLE, 6) AS p, round(CASE WHEN n_sv > 0 THEN abs(-10 * log10(n_sv / (n_sv + n_blank)::DOUBLE)) END, 6) AS score"


def _heat_cells(read):
    blocks = read("iv").groupBy("chrom", ops.div(F.col("st"), 1000).alias("block")).agg(F.count(F.lit(1)).alias("signals"), F.max(F.col("name") % 400).alias("k"), F.max("sample").alias("s"))
    blocks = blocks.withColumn("reads", F.lit(100)).withColumn("label", F.when(F.col("s") % 2 == 0, "INS").otherwise("BLANK"))
    halves = [context.heat_map(blocks.filter(F.col("chrom") % 2 == k)) for k in (0, 1)]
    return context.merge_heat_maps(halves[0].unionByName(halves[1]))


@query("merged_heat_map", f"""WITH b AS ({_MAP}) SELECT y, x, n_sv, n_blank, {_MAP_SCORES} FROM (SELECT least(99, n) AS y, least(299, k) AS x, count(*) FILTER (s % 2 = 0) AS n_sv, count(*) FILTER (s % 2 = 1) AS n_blank FROM b GROUP BY 1, 2)""")
def _(read):
    return _heat_cells(read).select("y", "x", "n_sv", "n_blank", F.round("p", 6).alias("p"), F.round("score", 6).alias("score"))


@query("full_heat_map", f"""WITH b AS ({_MAP}), c AS (SELECT least(99, n) AS y, least(299, k) AS x, count(*) FILTER (s % 2 = 0) AS n_sv, count(*) FILTER (s % 2 = 1) AS n_blank FROM b GROUP BY 1, 2), g AS (SELECT y, x FROM generate_series(0, 99) a(y), generate_series(0, 299) b(x)),
    f AS (SELECT g.y, g.x, coalesce(n_sv, 0) AS n_sv, coalesce(n_blank, 0) AS n_blank FROM g LEFT JOIN c ON c.y = g.y AND c.x = g.x) SELECT y, x, n_sv, n_blank, {_MAP_SCORES} FROM f""")
def _(read):
    return context.full_heat_map(_heat_cells(read)).select("y", "x", "n_sv", "n_blank", F.round("p", 6).alias("p"), F.round("score", 6).alias("score"))


@query("pair_regions", f"""WITH c AS (SELECT *, (flag & 16) <> 0 AS r, (flag & 32) <> 0 AS mr, CASE WHEN pos <= mate_pos THEN (flag & 16) = 0 ELSE (flag & 32) = 0 END AS f FROM {AL} x),
    k AS (SELECT *, CASE WHEN chrom <> mate_chrom AND r = mr THEN 'TRA_INV' WHEN chrom <> mate_chrom THEN 'TRA' WHEN r = mr AND NOT r THEN 'INV_1' WHEN r = mr THEN 'INV_2' WHEN NOT f THEN 'DUP' WHEN abs(isize) > 4500 THEN 'DEL' END AS class FROM c)
    SELECT id, class, CASE WHEN r THEN pos - 4200 ELSE pos + 150 END AS st, CASE WHEN r THEN pos ELSE pos + 4350 END AS ed, CASE WHEN mr THEN mate_pos - 4200 ELSE mate_pos + 150 END AS st2, CASE WHEN mr THEN mate_pos ELSE mate_pos + 4350 END AS ed2 FROM k WHERE class IS NOT NULL""")
def _(read):
    out = reads.pair_regions(read("al"), 4500, 150)
    return out.select(F.col("read_name").cast("long").alias("id"), "class", "st", "ed", "st2", "ed2")


@query("fetched_mates", f"""WITH c AS (SELECT DISTINCT id, chrom, pos, mate_chrom, mate_pos FROM {AL} x WHERE isize <> 150) SELECT m.id FROM (SELECT id, mate_chrom AS chrom, mate_pos AS pos, chrom AS mate_chrom, pos AS mate_pos FROM {AL} y WHERE flag % 3 > 0) m JOIN c ON c.id = m.id""")
def _(read):
    al = read("al").select("read_name", "chrom", "pos", "mate_chrom", "mate_pos", "isize", "flag")
    mates = al.filter("flag % 3 > 0").select("read_name", F.col("mate_chrom").alias("chrom"), F.col("mate_pos").alias("pos"), F.col("chrom").alias("mate_chrom"), F.col("pos").alias("mate_pos"))
    return reads.fetch_mates(al.filter("isize <> 150"), mates).select(F.col("read_name").cast("long").alias("id"))


@query("vntr_candidates", f"""SELECT chrom, greatest(0, st - 200) AS st, st + 200 AS ed, id % 200 AS k FROM {RG} x""")
def _(read):
    return short_signals.vntr_candidates(read("rg").select("chrom", F.col("st").alias("pos"), (F.col("id") % 200).alias("k")))


@query("written_alleles", f"""SELECT id, CASE WHEN svlen * 1000 < -50000 THEN '<DEL>' WHEN hap = 1 AND abs(svlen * 1000) > 2000 THEN '<INV>' ELSE id::VARCHAR END AS alt, abs(svlen * 1000) BETWEEN 30 AND 50000 AS callable FROM {SV} x""")
def _(read):
    length, kind = F.col("svlen") * 1000, F.when(F.col("hap") == 1, "INV").otherwise(F.col("svtype"))
    return read("sv").select("id", genotype.written_allele(length, F.col("id").cast("string"), kind).alias("alt"), genotype.callable_inversion(length).alias("callable"))


@query("union_duplicates")
def _(read):
    return short_signals.union_duplicates(_two_regions(read))


@query("combined_inversions")
def _(read):
    rows = _two_regions(read).withColumn("type", F.when(F.col("id") % 2 == 0, "INV_1").otherwise("INV_2"))
    return short_signals.combine_inversions(rows)


@query("insert_strings", f"""SELECT id AS a_contig, 'INS' AS type, substring(sha256(ln::VARCHAR) || sha256(id::VARCHAR), 11 + q + ln, 5 + q % 40) AS insert_seq, substring(sha256(id::VARCHAR) || sha256(id::VARCHAR), 11 + q + ln, 1) AS base_seq FROM {AL} x WHERE 5 + q % 40 >= 30
    UNION ALL SELECT id, 'DEL', substring(sha256(id::VARCHAR) || sha256(id::VARCHAR), 41 + q + ln, 1 + q * 3 % 60), substring(sha256(ln::VARCHAR) || sha256(id::VARCHAR), 46 + q + ln + q % 40, 1) FROM {AL} y WHERE 1 + q * 3 % 60 >= 30""")
def _(read):
    """Each alignment's two contigs are a region of their own here."""
    pairs = _contig_pairs(read).withColumn("region", F.col("a_contig"))
    text = lambda c: F.sha2(F.col(c).cast("string"), 256)
    al = read("al")
    seqs = al.select(F.col("id").alias("region"), F.col("id").alias("contig"), F.concat(text("id"), text("id")).alias("seq")).unionByName(al.select(F.col("id").alias("region"), F.col("ln").cast("long").alias("contig"), F.concat(text("ln"), text("id")).alias("seq")))
    return contigs.with_insert_strings(contigs.contig_variants(pairs, 30), seqs).select("a_contig", "type", "insert_seq", "base_seq")


# Column functions and filters of reads

_LETTERS = "translate({}, '0123456789abcdef', 'AAAACCCCGGGGTTTT')"
_TEXT = _LETTERS.format("substring(md5(CAST(id AS VARCHAR)), 1, 12)")
_SPARK_TEXT = _TEXT.replace("VARCHAR", "STRING")
_OTHER = "CASE WHEN id % 2 = 0 THEN concat(substring(t, 1, 1), t) ELSE reverse(t) END"
_COLLAPSED = "array_to_string(list_transform(list_filter(range(1, length({0}) + 1), lambda i: i = 1 OR {0}[i] <> {0}[i - 1]), lambda i: {0}[i]), '')"
_CLIP = "concat(repeat('A', CAST(q % 25 AS INT)), repeat('C', 8), repeat('T', 9))"


@query("sequence_checks", f"""WITH t AS (SELECT *, {_TEXT} AS t FROM {AL} x), o AS (SELECT *, {_OTHER} AS o, {_CLIP} AS c FROM t)
    SELECT id, {_COLLAPSED.format("t")} = {_COLLAPSED.format("o")} AS equal, (len(string_split(c[1:20], 'A')) - 1 > 18 OR len(string_split(c[1:20], 'T')) - 1 > 18 OR q + ln < 20) AS poly_at, (q + mapq) / 2.0 < 0.6 * (ln * 9 + q + 11) / 2.0 AS poor FROM o""")
def _(read):
    rows = read("al").selectExpr("*", f"{_SPARK_TEXT} AS t").selectExpr("*", f"{_OTHER} AS o", f"{_CLIP} AS c")
    return rows.select("id", sq.homopolymer_equal("t", "o").alias("equal"), sq.poly_at_rejects("c", F.col("q") + F.col("ln")).alias("poly_at"), sq.clip_is_poor(F.array("q", "mapq"), F.array(F.col("ln") * 9, F.col("q") + 11)).alias("poor"))


@query("region_names", f"""SELECT id, chrom::VARCHAR AS chrom, st::INT AS st, ed::INT AS ed, chrom || ':' || st || '-' || ed AS name, CASE WHEN ed - st <= 1000 THEN ed - st WHEN (ed - st) // 10 <= 1000 THEN (ed - st) // 10 * 10 END AS size, CASE WHEN st <= 1000 THEN st WHEN st // 10 <= 1000 THEN st // 10 * 10 WHEN st // 100 <= 1000 THEN st // 100 * 100 WHEN st // 1000 <= 1000 THEN st // 1000 * 1000 WHEN st // 10000 <= 1000 THEN st // 10000 * 10000 ELSE st // 100000 * 100000 END AS rounded FROM {IV} x""")
def _(read):
    text = F.when(F.col("id") % 2 == 0, sq.format_region("chrom", "st", "ed")).otherwise(sq.format_region("chrom", "st", "ed", "__"))
    rows = read("iv").select("id", sq.parse_region(text).alias("r"))
    return rows.select("id", "r.*").select("id", "chrom", "st", "ed", sq.format_region("chrom", "st", "ed").alias("name"), sq.round_insert_size(F.col("ed") - F.col("st")).alias("size"), sq.round_insert_size("st").alias("rounded"))


@query("phred_sums", f"""SELECT id, greatest(a, b) + CASE WHEN abs(a - b) >= 20 THEN 0 ELSE floor(10 * log10(1 + pow(10, -abs(a - b) / 10.0)) + 0.5) END::INT AS total FROM (SELECT id, -q::INT AS a, -(mapq::INT) AS b FROM {AL} x) y""")
def _(read):
    return read("al").select("id", sq.phred_add(-F.col("q"), -F.col("mapq")).cast("int").alias("total"))


_KMERS = ["l_orderkey AS read", "l_linenumber * 9 + l_partkey % 9 AS i", "CASE WHEN l_suppkey % 5 = 0 THEN repeat('A', 5) ELSE concat('AC', repeat('G', 3)) END AS kmer", "l_discount * 10 AS prob"]


@query("kmer_error_mask", f"""WITH k AS (SELECT {", ".join(_KMERS)} FROM lineitem), b AS (SELECT *, (kmer = 'AAAAA' OR prob < 0.2)::INT AS bad FROM k) SELECT read, i, kmer, CASE WHEN bad = 1 THEN 'P' WHEN max(bad) OVER (PARTITION BY read ORDER BY i RANGE BETWEEN 12 PRECEDING AND 12 FOLLOWING) = 1 THEN 'E' ELSE 'N' END AS mask FROM b""")
def _(read):
    return sq.error_mask(read("lineitem").selectExpr(*_KMERS), 0.2, 12).select("read", "i", "kmer", "mask")


@query("supplementary_parts", f"""WITH r AS (SELECT id, 'c' || chrom AS chrom, pos, flag, mapq, ln * 300 AS clip, 10 + q + ln + 5 + q % 40 + 50 + ln * 300 AS n FROM {AL} x),
    p AS (SELECT id, chrom AS a_chrom, pos AS a_pos, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS a_strand, mapq AS a_mapq, CASE WHEN flag & 16 <> 0 THEN clip ELSE 0 END AS read_st, CASE WHEN flag & 16 <> 0 THEN n ELSE n - clip END AS read_ed FROM r UNION ALL SELECT id, 'c1', pos + 6, '-', 7, 3, 8 FROM r)
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY read_st, read_ed, a_chrom, a_pos)::INT AS part FROM p""")
def _(read):
    al = read("al").withColumn("chrom", F.concat(F.lit("c"), F.col("chrom").cast("string"))).withColumn("cigar", cg.parse("cigar_text")).withColumn("sa", F.concat(F.lit("c1,"), (F.col("pos") + 7).cast("string"), F.lit(",-,4S5M3S,7,0;")))
    return cg.explode_sa(al).select("id", "a_chrom", "a_pos", "a_strand", "a_mapq", "read_st", "read_ed", "part")


_ERRORS = "l_partkey % 100"


@query("accurate_reads", f"""WITH e AS (SELECT l_orderkey AS read, 55 + l_orderkey % 60 AS length, {_ERRORS} AS e FROM lineitem), f AS (SELECT *, length // 10 AS blocks FROM e), c AS (SELECT read, blocks, e // 10 AS b, count(*) AS n FROM f WHERE e < blocks * 10 GROUP BY ALL),
    s AS (SELECT read, any_value(blocks) AS blocks, max(n) AS most, sum(n) AS total FROM c GROUP BY read) SELECT DISTINCT f.read FROM f LEFT JOIN s USING (read) WHERE coalesce(most, 0) <= 2 AND coalesce(total, 0) <= 0.05 * f.blocks * 10""")
def _(read):
    rows = read("lineitem").selectExpr("l_orderkey AS read_name", "55 + l_orderkey % 60 AS length", f"{_ERRORS} AS e").groupBy("read_name", "length").agg(F.collect_list("e").alias("errors"))
    return reads.accurate_reads(rows, 10, 0.2, 0.05).select(F.col("read_name").alias("read"))


@query("good_quality_reads", """WITH r AS (SELECT l_orderkey AS read, CAST(floor(l_orderkey / 1000) AS BIGINT) AS sample, sum(CAST(l_quantity AS INT)) AS q FROM lineitem GROUP BY 1, 2) SELECT read FROM (SELECT *, avg(q) OVER (PARTITION BY sample) AS m FROM r) WHERE q >= 0.8 * m""")
def _(read):
    rows = read("lineitem").selectExpr("l_orderkey AS read", "CAST(floor(l_orderkey / 1000) AS BIGINT) AS sample", "CAST(l_quantity AS INT) AS q").groupBy("read", "sample").agg(F.collect_list("q").alias("qual"))
    return reads.good_quality_reads(rows).select("read")


@query("mismatch_signals", f"""WITH m AS (SELECT *, list_sort([flag % 9, flag % 9 + 1, mapq, mapq * 2 + 20]) AS a FROM {AL} x WHERE q % 2 = 0 AND nm >= 3), e AS (SELECT *, len(list_filter(range(1, 5), lambda i: i = 1 OR a[i] - a[i - 1] > 1)) AS n FROM m)
    SELECT id::VARCHAR AS read_name, chrom, pos - pos % 200 AS pos, least(3, mapq) AS score FROM e WHERE n >= 3""")
def _(read):
    al = read("al").withColumn("cigar", cg.parse(F.when(F.col("q") % 2 == 0, "50=").otherwise("9S41=")))
    al = al.withColumn("mismatches", F.array_sort(F.array(F.col("flag") % 9, F.col("flag") % 9 + 1, "mapq", F.col("mapq") * 2 + 20)))
    return reads.mismatch_signals(al).select("read_name", "chrom", "pos", "score")


@query("cluster_report", """WITH c AS (SELECT DISTINCT l_orderkey AS region, l_partkey AS contig, l_partkey % 3 AS cluster FROM lineitem), a AS (SELECT DISTINCT l_orderkey AS region, l_partkey AS contig, l_returnflag AS class FROM lineitem WHERE l_suppkey % 3 > 0)
    SELECT c.region, cluster, count(DISTINCT c.contig) AS size, string_agg(DISTINCT c.contig::VARCHAR, ',' ORDER BY c.contig::VARCHAR) AS contigs, coalesce(string_agg(DISTINCT class, ',' ORDER BY class), '') AS classes FROM c LEFT JOIN a ON a.region = c.region AND a.contig = c.contig GROUP BY c.region, cluster""")
def _(read):
    lines = read("lineitem")
    held = lines.selectExpr("l_orderkey AS region", "CAST(l_partkey AS STRING) AS contig", "l_partkey % 3 AS cluster").distinct()
    kinds = lines.filter("l_suppkey % 3 > 0").selectExpr("l_orderkey AS region", "CAST(l_partkey AS STRING) AS contig", "l_returnflag AS class")
    out = contigs.cluster_report(held, kinds)
    return out.select("region", "cluster", "size", F.array_join("contigs", ",").alias("contigs"), F.array_join("classes", ",").alias("classes"))


_PIECES = """SELECT id, seq, k, v.ref, v.alt, (v.ref IS NOT NULL AND substring(seq, k * 9 + 1, length(v.ref)) = v.ref) AS fits FROM (SELECT DISTINCT l_orderkey AS id, sha256(l_orderkey::VARCHAR) AS seq FROM lineitem) r CROSS JOIN (SELECT unnest(range(0, 8)) AS k) n
    LEFT JOIN (SELECT l_orderkey, l_linenumber, min_by(ref, o) AS ref, min_by(alt, o) AS alt FROM (SELECT *, l_partkey * 100 + l_suppkey AS o, CASE WHEN l_partkey % 5 = 0 THEN 'X' ELSE substring(sha256(l_orderkey::VARCHAR), l_linenumber * 9 + 1, 1 + l_partkey % 3) END AS ref, repeat('T', (l_suppkey % 4)::INT) AS alt FROM lineitem) GROUP BY ALL) v ON v.l_orderkey = r.id AND v.l_linenumber = k"""


@query("applied_variants", f"""WITH p AS ({_PIECES}) SELECT id, string_agg(CASE WHEN fits THEN alt || substring(seq, k * 9 + 1 + length(ref), 9 - length(ref)) ELSE substring(seq, k * 9 + 1, 9) END, '' ORDER BY k) AS haplotype, count_if(fits AND length(alt) > length(ref))::INT AS insertions, count_if(fits AND length(alt) < length(ref))::INT AS deletions FROM p GROUP BY id""")
def _(read):
    lines = read("lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS n", "l_partkey * 100 + l_suppkey AS o", "l_partkey AS p", "repeat('T', CAST(l_suppkey % 4 AS INT)) AS alt")
    one = lines.groupBy("id", "n").agg(F.min_by(F.struct("p", "alt"), "o").alias("x")).select("id", "n", "x.*")
    seq = F.sha2(F.col("id").cast("string"), 256)
    ref = F.when(F.col("p") % 5 == 0, "X").otherwise(F.substring(seq, F.col("n") * 9 + 1, (1 + F.col("p") % 3).cast("int")))
    changes = one.select("id", (F.col("n") * 9 + 100).cast("long").alias("pos"), ref.alias("ref"), "alt")
    places = lines.select("id").distinct().select("id", F.lit(100).alias("st"), seq.alias("seq"))
    return contigs.apply_variants(places, changes)


_PAIRS = "x.l_orderkey AS region, x.l_linenumber AS t_contig, y.l_linenumber AS n_contig, (x.l_suppkey + y.l_suppkey) % 3 > 0 AS end_to_end, 60 + (x.l_partkey + y.l_partkey) % 120 AS matches"


@query("somatic_contigs", f"""WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2), t AS (SELECT l_orderkey AS region, l_linenumber AS contig, 100 + l_partkey % 90 AS n FROM l WHERE l_suppkey % 2 = 0 AND l_partkey % 6 >= 3),
    m AS (SELECT l_orderkey AS region, l_linenumber AS contig, 100 + l_partkey % 90 AS n FROM l WHERE l_suppkey % 2 = 1 AND l_partkey % 6 >= 2), p AS (SELECT {_PAIRS} FROM l x JOIN l y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey % 2 = 0 AND y.l_suppkey % 2 = 1),
    s AS (SELECT DISTINCT t.region, t.contig FROM p JOIN t ON t.region = p.region AND t.contig = t_contig JOIN m ON m.region = p.region AND m.contig = n_contig WHERE greatest(t.n, m.n) - least(t.n, m.n) <= greatest(0.15 * greatest(t.n, m.n), 50.0) AND end_to_end AND matches * 1.1 >= least(t.n, m.n))
    SELECT t.region, t.contig FROM t ANTI JOIN s ON s.region = t.region AND s.contig = t.contig WHERE t.region IN (SELECT region FROM m)""")
def _(read):
    lines = read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    rows = lines.selectExpr("l_orderkey AS region", "l_linenumber AS contig", "l_partkey % 6 AS support", "repeat('A', CAST(100 + l_partkey % 90 AS INT)) AS seq", "l_suppkey % 2 AS side")
    a, b = lines.filter("l_suppkey % 2 = 0").alias("x"), lines.filter("l_suppkey % 2 = 1").alias("y")
    pairs = a.join(b, F.col("x.l_orderkey") == F.col("y.l_orderkey")).selectExpr("x.l_orderkey AS region", "x.l_linenumber AS t_contig", "y.l_linenumber AS n_contig", "(x.l_suppkey + y.l_suppkey) % 3 > 0 AS end_to_end", "60 + (x.l_partkey + y.l_partkey) % 120 AS matches")
    return genotype.somatic(rows.filter("side = 0"), rows.filter("side = 1"), pairs).select("region", "contig")


@query("unmapped_distribution", f"""WITH q AS (SELECT floor(quantile_cont(ed - st, 0.01)) AS least, floor(quantile_cont(ed - st, 0.99)) AS most, count(*) AS n FROM {RG} x)
    SELECT ed - st - 150 AS i, round(count(*) / (any_value(q.n) + 1)::DOUBLE, 8) AS p FROM {RG} y, q WHERE ed - st >= q.least AND ed - st < q.most GROUP BY 1""")
def _(read):
    density = reads.isize_density(read("rg").select((F.col("ed") - F.col("st")).alias("isize")))
    return reads.unmapped_distribution(density, 150).select("i", F.round("p", 8).alias("p"))


@query("interval_intersections", f"""SELECT a.id AS id, b.id AS other, greatest(a.st, b.st) AS st, least(a.ed, b.ed) AS ed FROM {IV} a JOIN {RG} b ON {OVERLAP}""")
def _(read):
    j = ops.overlap_join(read("iv"), read("rg"), 1000)
    both = iv.intersection(*(F.col(c) for c in ("st", "ed", "r_st", "r_ed")))
    return j.select("id", F.col("r_id").alias("other"), both["st"].alias("st"), both["ed"].alias("ed"))
