"""What leaves a task: rows are shuffled once, packed, and neither operations nor k-mers nor pairs are."""

import random
from collections import Counter

from strandloom.functions import cigar as cg
from strandloom.functions import sequence as sq
from strandloom.operators import context, contigs, reads
from strandloom.operators import differences as diff

CIGARS = "region int, contig int, cigar array<struct<op: string, len: int>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning")


def test_places_and_points_are_dealt_once(spark):
    alignments = spark.createDataFrame([(1, 1, [("=", 5), ("=", 5), ("I", 3), ("=", 9)]), (1, 2, None), (2, 1, [])], CIGARS)
    points = spark.createDataFrame([(1, 1, 10), (1, 1, -1), (1, 1, None), (1, 2, 0), (2, 1, 0), (2, 7, 0), (3, 1, 0)], "region int, contig int, r int")
    got = diff.mismatch_regions(alignments, points)
    assert exchanges(got) == 1
    assert sorted((x.region, x.contig, x.r, x.lo, x.hi, x.gaps, x.matches) for x in got.collect() if x.lo is not None) == [(1, 1, 10, 0, 18, 1, 19)]
    sv = spark.createDataFrame([(1, 1, 2, 4, 9, "INS", 2), (1, 1, 7, 11, 0, "INS", 2), (4, 0, 1, 6, 8, "DEL", 3)], "region int, a_contig int, b_contig int, a_pos int, b_pos int, type string, length int")
    placed = diff.reference_places(sv, alignments, 0)
    assert exchanges(placed) == 1
    assert {(x.region, x.a_pos): (x.base_ref, x.base_is_insert, x.event, x.insert_ref, x.insert_ref_end) for x in placed.collect()} == {(1, 4): (4, False, 0, None, None), (1, 11): (10, True, 3, None, None), (4, 6): (6, False, 0, 6, 9)}


def test_kmers_are_counted_in_their_rows(spark):
    r = random.Random(5)
    texts = [(i % 7 if i % 3 else None, "".join(r.choice("ACGN") for _ in range(r.randrange(0, 60)))) for i in range(20)] + [(50 + i, "".join(r.choice("AC") for _ in range(30))) for i in range(9)] + [(99, None)]
    per = Counter()
    for i, s in texts:
        for t in (s, s[::-1].translate(str.maketrans("ACGT", "TGCA"))) if s is not None else ():
            per.update((i, t[k : k + 3]) for k in range(len(t) - 2))
    want = Counter()
    for (_, w), n in per.items():
        want[w] += n if n >= 3 else 0
    got = reads.kmer_census(spark.createDataFrame(texts, "id int, s string").repartition(4), 3, 3)
    assert {x.kmer: x.n for x in got.collect()} == {w: n for w, n in want.items() if n}
    assert dict(sq.counted_kmers("AAAA", 3, 2)) == {"AAA": 2, "TTT": 2}


def test_reads_meet_regions_before_their_operations_are_made(spark):
    al = spark.createDataFrame([("a", "c", 0, "10=2X3I10=5D20="), ("b", "c", 500, "50="), ("c", "c", 30, "4S20N3=")], "read_name string, chrom string, pos int, t string").withColumn("cigar", cg.parse("t"))
    got = context.variant_density(al, spark.createDataFrame([(1, "c", 5, 15), (2, "c", 40, 60)], "id int, chrom string, st int, ed int"))
    text = plan(got)
    assert text.index("Generate explode(filter(") < text.index("Join")
    assert {(x.id, x.reads, x.matches, x.mismatches, x.insertions, x.inserted) for x in got.collect()} == {(1, 1, 8, 2, 1, 3), (2, 2, 10, 0, 0, 0)}


def test_reads_that_back_a_target_are_counted_by_group(spark):
    r = random.Random(3)
    groups = [(g, x, r.choice([-1, 0, 1, None])) for g in (1, 2) for x in range(12)] + [(None, 1, 0)]
    backs = [(g, r.randrange(14), r.choice([0, 1, None])) for g in (1, 2, None) for _ in range(40)]
    mine, rows = spark.createDataFrame(groups, "region int, read int, grp int"), spark.createDataFrame(backs, "region int, read int, target int")
    one = rows.distinct()
    want = contigs.rejected_reads(mine, one.join(one.withColumnRenamed("read", "supporter"), ["region", "target"]).filter("read <> supporter"))
    got = contigs.rejected_backers(mine, rows)
    assert "Join" not in plan(got) and exchanges(got) == 1
    columns = ["region", "target", "read", "same", "other", "rejected"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_operations_are_made_in_their_rows(spark):
    alignments = spark.createDataFrame([(1, 1, [("=", 5), ("M", 5), ("S", 2), ("D", 3), ("X", 0), ("D", 1), ("I", 4)]), (1, 2, None), (2, 1, [])], CIGARS)
    got = diff.operations(alignments)
    assert exchanges(got) == 0
    assert sorted(map(tuple, got.select("k", "op", "len", "i", "r", "q").collect())) == [(1, "M", 10, 0, 0, 0), (2, "D", 4, 10, 10, 10), (3, "I", 4, 14, 14, 10)]


def test_letters_are_made_behind_the_joins(spark):
    from pyspark.sql import functions as F

    sv = spark.createDataFrame([(1, 1, 2, 50, 5, "INS", 20, 7)], "region int, a_contig int, b_contig int, a_pos int, b_pos int, type string, length int, id int")
    placed = diff.reference_places(sv, spark.createDataFrame([(1, 1, [("=", 100)]), (1, 2, [("=", 100)])], CIGARS), 0)
    runs = spark.createDataFrame([(1, 0, 59, False), (1, 60, 79, True), (1, 80, 99, False)], "region int, st int, ed int, vntr boolean")
    rm = spark.createDataFrame([(1, 2, 0, 40, "Simple_repeat")], "region int, contig int, st int, ed int, class string")
    trf = spark.createDataFrame([], "region int, contig int, st int, ed int, unit int, copies double")
    short = spark.createDataFrame([(1, 2, "ACGTT"), (1, 0, "ACGTT")], "region int, contig int, part string")
    got = diff.classified(placed, runs, rm, trf, short, 0, letters=lambda x: F.repeat(x["part"], 20)).first()
    assert (got["base_ref"], got["vntr_distance"], got["insert_seq"], got["class"]) == (50, 10, "ACGTT" * 4, 1)


def test_of_chains_alike_only_the_first_meets_points(spark):
    from strandloom.operators import intervals as ops

    same = [(k, 1, 100, "+", 2, 1000 * k, "40=2D60=") for k in (9, 3, 5)] + [(4, 1, 100, "-", 2, 7, "40=2D60="), (2, 1, 90, "+", 2, 0, "90=")]
    chains = spark.createDataFrame(same, "chain long, chrom int, length int, strand string, to_chrom int, to_st int, t string").withColumn("cigar", cg.parse("t")).drop("t")
    assert sorted(x.chain for x in ops._first_alike(chains).collect()) == [2, 3, 4]
    spots = spark.createDataFrame([(1, 1, 45), (2, 1, 200)], "id int, chrom int, pos int")
    assert sorted(map(tuple, ops.lift_points(spots, chains, width=10).select("id", "to_pos", "chain").collect()), key=str) == [(1, 3047, 3), (2, None, None)]
    spans = spark.createDataFrame([(1, 1, 30, 49)], "id int, chrom int, st int, ed int")
    assert [tuple(x) for x in ops.lift_spans(spans, chains, width=10).select("chain", "to_st", "to_ed", "lifted").collect()] == [(3, 3030, 3051, 20)]


def test_calls_are_dealt_by_stretch_once(spark):
    from strandloom.sources import variants

    calls = [("1", 5, "A", "T", 9.0), ("1", 5, "A", "T", 8.0), ("1", 2_000_001, "A", None, 9.0), ("1", 2_000_001, "A", None, 7.0), ("1", 2_000_009, "A", "C", 9.0)]
    rows = spark.createDataFrame([(*x, "PASS", "INS", 60, "0/1", 3, [1, 2, 3], [1, 2, 3]) for x in calls], "chrom string, pos int, ref string, alt string, qual double, filter string, svtype string, svlen int, gt string, gq int, lr array<int>, sr array<int>")
    got = variants.vcf_lines(rows)
    assert sum("Exchange hashpartitioning" in x and "REPARTITION_BY_COL" not in x and "alt" in x for x in plan(got).split("\n")) == 1  # the count of alleles only
    assert sorted(x.line.split("\t")[2].split("_")[0] for x in got.collect()) == ["0", "1", "2"]
