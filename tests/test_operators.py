"""Rules with known values, greedy folds against a plain transcription, readers on small files, and properties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.functions import sequence as sq
from strandloom.operators import cohort, contigs, folds, genotype, mei, reads
from strandloom.operators import intervals as ops
from strandloom.sources import regions, variants


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_quality_of_the_published_calls(spark):
    rows = spark.createDataFrame([(0, 7, 0, "1/1"), (0, 5, 2, "1/1"), (0, 34, 0, "1/1")], "r int, a int, u int, gt string")
    got = rows.select(genotype.qualities(F.col("r"), F.col("a"), F.col("u"), F.col("gt")).alias("q")).select("q.*").collect()
    assert [tuple(r) for r in got] == [(403, 71), (30, 65), (500, 152)]


def test_long_read_genotype_edges(spark):
    cases = [(7, 1, "0/0"), (6, 1, "0/1"), (0, 1, "0/1"), (0, 2, "1/1"), (1, 7, "1/1"), (1, 6, "0/1")]
    df = spark.createDataFrame(cases, "n int, s int, want string")
    assert df.filter(genotype.long_read_genotype(F.col("n"), F.col("s")) != F.col("want")).count() == 0


def test_near_by_ends_not_by_nesting(spark):
    schema = "id int, sample int, hap int, chrom int, st int, ed int"
    near = lambda rows: {r.id for r in ops.flag_near(spark.createDataFrame(rows, schema), 500).collect()}
    assert near([(1, 0, 0, 1, 1000, 9000), (2, 0, 0, 1, 4000, 5000)]) == set()
    assert near([(1, 0, 0, 1, 1000, 1001), (2, 0, 0, 1, 1400, 1401)]) == {1, 2}
    assert near([(1, 0, 0, 1, 1000, 1001), (2, 0, 1, 1, 1400, 1401)]) == set()


def test_near_equals_brute_force(spark):
    r = random.Random(2)
    rows = [(i, 0, r.randrange(2), 1, s := r.randrange(8000), s + r.randrange(0, 3000)) for i in range(150)]
    want = {a[0] for a in rows for b in rows if a[0] != b[0] and a[2] == b[2] and any(abs(a[x] - b[y]) <= 60 for x in (4, 5) for y in (4, 5))}
    df = spark.createDataFrame(rows, "id int, sample int, hap int, chrom int, st int, ed int")
    assert {x.id for x in ops.flag_near(df, 60).collect()} == want


def test_bins_containment_and_levels(spark):
    sv = spark.createDataFrame([(1, 1, 499, 999)], "id int, chrom int, st int, ed int")
    assert sorted(r.bin for r in ops.sv_bins(sv).collect()) == [0, 500, 1000]
    bed = spark.createDataFrame([(1, 0, 15, 0), (1, 5, 30, 1), (1, 0, 40, 2)], "chrom int, st int, ed int, bed_order int")
    q = spark.createDataFrame([(1, 1, 10, 20), (2, 1, 50, 60)], "id int, chrom int, st int, ed int")
    assert {r.id: r.r_bed_order for r in ops.containment_join(q, bed).collect()} == {1: 1, 2: None}
    points = spark.createDataFrame([(1, p) for p in (5, 20, 41, 100)], "chrom int, pos int")
    assert sorted((r.st, r.ed, r.n) for r in ops.gap_clusters(points).collect()) == [(5, 20, 2), (41, 41, 1), (100, 100, 1)]


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
def test_overlap_join_for_any_bin_width(spark, width):
    r = random.Random(width)
    make = lambda n: [(i, 1, s := r.randrange(300), s + r.randrange(40)) for i in range(n)]
    a, b = make(40), make(40)
    schema = "id int, chrom int, st int, ed int"
    got = sorted((x.id, x.r_id) for x in ops.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), width).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[2] <= y[3] and y[2] <= x[3])


def plain_fold(rows, joins, least):
    left, out = sorted(rows, key=lambda x: (x["chrom"], x["kind"], x["st"], x["ed"], x["id"])), []
    while left:
        a = dict(left.pop(0))
        while left and (left[0]["chrom"], left[0]["kind"]) == (a["chrom"], a["kind"]) and joins(a, left[0]):
            b = left.pop(0)
            a["st"], a["ed"], a["support"] = min(a["st"], b["st"]), max(a["ed"], b["ed"]), a["support"] + b["support"]
        out.append(a)
    return sorted((x["chrom"], x["kind"], x["st"], x["ed"], x["support"]) for x in out if x["support"] >= least)


@pytest.mark.parametrize("parts", [1, 5])
def test_folds_equal_a_plain_transcription(spark, parts):
    r = random.Random(8)
    rows = [{"chrom": r.randrange(2), "kind": r.choice("ID"), "st": (s := r.randrange(6000)), "ed": s + r.randrange(200), "support": 1, "id": i} for i in range(250)]
    df = spark.createDataFrame(rows, "chrom int, kind string, st int, ed int, support int, id int").repartition(parts)
    near = lambda a, b: abs(a["st"] - b["st"]) < 20 and abs(a["ed"] - b["ed"]) < 20
    got = sorted((x.chrom, x.kind, x.st, x.ed, x.support) for x in folds.merge_small(df, 10).collect())
    assert got == plain_fold(rows, near, 2)

    def normal(a, b):
        return any(abs(x - y) < 300 for x in (a["st"], a["ed"]) for y in (b["st"], b["ed"])) or (a["st"] <= b["st"] and b["ed"] <= a["ed"])

    got = sorted((x.chrom, x.kind, x.st, x.ed, x.support) for x in folds.merge_normal(df, 10).collect())
    assert got == plain_fold(rows, normal, 1)


def test_cohort_merge_of_long_alleles(spark):
    long = "A" * 500
    rows = [(1, 100, 500, "N", long, 1, 10, 0, 1, 9.0), (1, 100, 520, "N", long + "C" * 20, 2, 11, 1, 1, 9.0), (1, 100, 700, "N", "A" * 700, 3, 12, 0, 1, 9.0), (1, 200, 60, "N", "A", 2, 13, 0, 1, 9.0), (1, 200, 60, "N", "A", 1, 14, 0, 1, 9.0)]
    df = spark.createDataFrame(rows, "chrom int, pos int, svlen int, ref string, alt string, sample int, id int, a1 int, a2 int, qual double")
    got = sorted((r.pos, r.svlen, [s.sample for s in r.support]) for r in cohort.merge_cohort(df).collect())
    assert got == [(100, 500, [1, 2]), (100, 700, [3]), (200, 60, [1, 2])]


def test_sequence_functions(spark):
    c = F.lit
    got = one(spark, a=sq.revcomp(c("ACGTN")), b=sq.collapse(c("AACCCGT")), k=sq.max_repeat_k(c("ACGTACGTAC"), 2, 8, 1), n=sq.kmers(c("ACNGT"), 2), e=sq.kmers(c("A"), 2), s=sq.shared_kmers(c("AAAA"), c("CAAC"), 2), r=sq.parse_region(c("chr1_5_9")), f=sq.format_region(c("x"), c(1), c(2)), p=sq.phred_add(c(10), c(10)), i=sq.round_insert_size(c(12345)), t=sq.mobile_type(c("LINE/L1")), b2=sq.block_ids(c(250), 100, 300))
    assert (got.a, got.b, got.k, got.n, got.e, got.s) == ("NACGT", "ACGT", 6, ["AC", "GT"], [], 3)
    assert tuple(got.r) == ("chr1", 5, 9) and got.f == "x:1-2" and got.p == 13 and got.i == 12300 and got.t == "LINE" and tuple(got.b2) == (0, 2)


def test_cigar_functions_and_signals(spark):
    c = cg.parse(F.lit("5S10M3I4D20M1200S"))
    got = one(spark, r=cg.reference_length(c), q=cg.query_length(c), l=cg.clip_left(c), e=cg.clip_right(c), i=cg.indel_bases(c), m=cg.query_to_ref(c, F.lit(100), F.lit(20)), z=cg.query_to_ref(c, F.lit(100), F.lit(9999)), n=cg.parse(F.lit("*")))
    assert (got.r, got.q, got.l, got.e, got.i, got.n) == (34, 1238, 5, 1200, 7, [])
    assert tuple(got.m) == (116, "M", 0) and tuple(got.z) == (0, None, 0)
    df = spark.range(1).select(F.lit("r").alias("read_name"), F.lit("1").alias("chrom"), F.lit(100).alias("pos"), c.alias("cigar"))
    assert sorted((r.type, r.pos, r.end, r.length) for r in reads.long_read_signals(df, 3).collect()) == [("CLIP_RIGHT", 134, 134, 1200), ("DEL", 110, 114, 4), ("INS", 110, 110, 3)]
    edits = [(10 * k, 1) for k in range(12)] + [(5000, 40)]
    df = spark.createDataFrame([("r", "1", edits)], "read_name string, chrom string, edits array<struct<pos: int, len: int>>")
    assert sorted((r.st, r.ed) for r in reads.small_signals(df).collect()) == [(0, 100), (5000, 5000)]


def test_sam_and_supplementary(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nr1\t0\tchr1\t11\t60\t5S10M\t*\t0\t0\tACGTACGTACGTACG\t*\tNM:i:1\tSA:Z:chr2,21,-,10M5S,30,0;\n")
    df = regions.read_alignments(spark, str(tmp_path / "a.sam"))
    r = df.first()
    assert (r.pos, r.nm, r.sa) == (10, 1, "chr2,21,-,10M5S,30,0;")
    got = sorted((x.a_chrom, x.a_pos, x.a_strand, x.read_st, x.read_ed) for x in cg.explode_sa(df).collect())
    assert got == [("chr1", 10, "+", 5, 15), ("chr2", 20, "-", 5, 15)]


VCF = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n1\t5\ta\tN\tA\t30\tPASS\tSVTYPE=DEL;SVLEN=-840;END=845;IMPRECISE\tGT:GQ:LR\t0|1:7:0,7,1\n1\t9\tb\tN\tC\t.\tLOW\tSVTYPE=INS;SVLEN=60\tGT\t0/0\n"


def test_vcf_round_trip(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    df = variants.read_vcf(spark, str(tmp_path / "a.vcf"))
    a, b = df.orderBy("pos").collect()
    assert (a.svtype, a.svlen, a.ed, a.gt, a.gq, a.lr, b.qual, b.svlen) == ("DEL", -840, 845, "0|1", 7, [0, 7, 1], None, 60)
    assert tuple(df.orderBy("pos").select(variants.alleles(F.col("gt")).alias("x")).first().x) == (0, 1, True)
    variants.write_vcf(df, str(tmp_path / "out"))
    again = variants.read_vcf(spark, str(tmp_path / "out")).collect()
    assert [(r.pos, r.svlen, r.id) for r in again] == [(5, -840, "0_1_DEL_5_845_840")]
    sv = df.select("*")
    assert genotype.usable_variants(sv).count() == 1 and genotype.usable_variants(sv, mode="signed").count() == 0


def test_annotation_readers(spark, tmp_path):
    p = tmp_path
    (p / "a.bed").write_text("chrom\tst\ted\n1\t5\t9\tx\n")
    assert [tuple(r)[:3] for r in regions.read_bed(spark, str(p / "a.bed"), True).collect()] == [("1", 5, 9)]
    (p / "a.fa").write_text(">ref1 x\nACGT\nAC\n>b\nGG\n")
    fa = regions.read_fasta(spark, str(p / "a.fa"))
    assert sorted(tuple(r) for r in fa.collect()) == [("b", "GG"), ("ref1", "ACGTAC")]
    cut = regions.ref_slice(spark.createDataFrame([(1, "ref1", 1, 5)], "id int, chrom string, st int, ed int"), regions.chunked(fa, 2), 2)
    assert cut.first().seq == "CGTA"
    (p / "a.out").write_text("SW x\nscore\n\n 239 1.0 2.0 3.0 c1 5 50 (10) + AluY SINE/Alu 1 45 (0) 7\nshort line\n")
    assert [(r.name, r.st, r.ed, r["class"]) for r in regions.read_repeatmasker(spark, str(p / "a.out")).collect()] == [("c1", 5, 50, "SINE/Alu")]
    (p / "a.ngs").write_text("@c1 x\n" + " ".join(["11", "60", "2", "25.0", "2"] + ["0"] * 8 + ["AC", "ACAC", "L", "R"]) + "\n" + " ".join(["1", "5"] + ["0"] * 15) + "\n@c2\n")
    assert [(r.name, r.st, r.ed, r.motif) for r in regions.read_trf(spark, str(p / "a.ngs")).collect()] == [("c1", 10, 59, "AC")]
    (p / "f.txt").write_text("REF_REGION=1:5-9\tSTAT=OK\tGT:CI=0/1:c7\tSUP_R=3:IS_FINAL=1\tCONTIG_STR=ACGT\nSTAT=FAIL\n")
    assert [(r.region, r.contig, r.support, r.seq) for r in regions.well_supported(regions.read_force_contigs(spark, str(p / "f.txt"))).collect()] == [("1:5-9", "c7", 3, "ACGT")]
    (p / "a.gff3").write_text("#h\n1\ts\tgene\t5\t9\t.\t+\t.\tID=x\n")
    assert regions.read_features(spark, str(p / "a.gff3")).first().chrom == "chr1"
    (p / "w.wig").write_text("fixedStep chrom=chr1 start=11 step=1\n0.5\n1\nfixedStep chrom=chr2 start=1 step=1\n0\n")
    assert sorted(tuple(r) for r in regions.read_wigfix(spark, str(p / "w.wig")).collect()) == [("chr1", 10, 0.5), ("chr1", 11, 1.0), ("chr2", 0, 0.0)]
    (p / "c.txt").write_text("1:5\t60\tN\tA\tSA:1:0:1:9.0\t2:1:1:8.0\n")
    co = variants.read_cohort(spark, str(p / "c.txt"))
    assert [(s.sample, s.a1, s.a2) for s in co.first().support] == [(1, 0, 1), (2, 1, 1)]
    variants.write_cohort(co, str(p / "c_out"))
    assert variants.read_cohort(spark, str(p / "c_out")).collect() == co.collect()


def test_dbscan_and_arrays(spark):
    x = np.array([[0, 0], [0.1, 0], [0.2, 0], [5, 5], [5.1, 5], [9, 9]])
    assert mei.dbscan(x, 0.5, 3).tolist() == [0, 0, 0, -1, -1, -1]
    rows = [("s", "SINE", 1000 * k, 1000 * k + 300, 300) for k in range(6)] + [("s", "LINE", 0, 5, 5), ("s", "LINE", 9, 12, 3)]
    got = mei.mei_arrays(spark.createDataFrame(rows, "sample string, type string, st int, ed int, length int")).collect()
    assert [(r.type, r.n_cluster, r.periodic) for r in got] == [("SINE", 6, True)]


def test_contig_clusters_and_haplotypes(spark):
    c = spark.createDataFrame([("r", x, k) for k, x in enumerate(["ref", "a", "b", "c"])], "region string, contig string, ord int")
    d = spark.createDataFrame([("r", "a", "ref"), ("r", "ref", "b"), ("r", "a", "c")], "region string, a_contig string, b_contig string")
    assert sorted((x.contig, x.cluster) for x in contigs.cluster_contigs(c, d).collect()) == [("a", 1), ("b", 1), ("c", 0), ("ref", 0)]
    region = spark.createDataFrame([(1, 100, "ACGTACGT")], "id int, st long, seq string")
    v = spark.createDataFrame([(1, 101, "C", "CTT"), (1, 104, "AC", "A"), (1, 105, "C", "G"), (1, 106, "T", "A")], "id int, pos long, ref string, alt string")
    r = contigs.apply_variants(region, v).first()
    assert (r.haplotype, r.insertions, r.deletions) == ("ACTTGTAGT", 1, 1)
    runs = contigs.vntr_runs(spark.createDataFrame([("c", 100)], "name string, length int"), spark.createDataFrame([], "name string, st int, ed int, class string"), spark.createDataFrame([("c", 30, 40)], "name string, st int, ed int"))
    assert [(x.st, x.ed, x.vntr) for x in runs.orderBy("st").collect()] == [(0, 19, False), (20, 50, True), (51, 99, False)]


def test_cohort_plan_from_calls_to_regions(spark):
    from strandloom.plans import cohort as plan

    rows = [("s1", 1, "1", 1000, "N", "A", "PASS", 60, 1, 1), ("s1", 2, "1", 1300, "N", "A", "PASS", -80, 1, 0), ("s2", 3, "1", 1000, "N", "A", "PASS", 60, 0, 1), ("s1", 4, "1", 9000, "N", "A", "LOW", 60, 1, 1)]
    calls = spark.createDataFrame(rows, "sample string, id int, chrom string, pos int, ref string, alt string, filter string, svlen int, a1 int, a2 int")
    regions_ = plan.csv_regions(plan.haplotype_calls(calls), 1)
    assert [(r.chrom, r.st, r.ed, r.max_ac) for r in regions_.collect()] == [("1", 500, 1500, 1)]
    contig = spark.createDataFrame([("1", 900, 1100, "c", 3), ("1", 900, 1100, "d", 1)], "chrom string, st int, ed int, contig string, support int")
    assert [r.r_contig for r in plan.region_contigs(regions_, contig).collect()] == ["c"]


def test_short_read_signals_and_masks(spark):
    from strandloom.operators import short_signals as ss

    row = lambda i, side, st, kind="DEL": ("1", kind, side, st, st + 50, "1", st + 900, st + 950, 10.0, 1, i)
    df = spark.createDataFrame([row(1, "BEGIN", 100), row(2, "BEGIN", 120), row(3, "END", 110), row(4, "END", 9000), row(5, "BEGIN", 140)], "chrom string, type string, side string, st int, ed int, chrom2 string, st2 int, ed2 int, score double, reads int, id int")
    got = ss.combine(df, 1, 0)
    assert sorted((r.side, r.st, r.ed, r.reads) for r in got.collect()) == [("BEGIN", 100, 190, 3), ("END", 110, 160, 1), ("END", 9000, 9050, 1)]
    assert sorted((r.side, r.st, r.ed, r.reads) for r in ss.pair_sides(got).collect()) == [("END", 9000, 9050, 1), ("SOLID", 110, 160, 4)]
    inv = spark.createDataFrame([row(1, "BEGIN", 100, "INV_1"), row(2, "END", 120, "INV_2")], df.schema)
    assert [(r.type, r.reads) for r in ss.combine_inversions(inv).collect()] == [("INV", 2)]
    k = spark.createDataFrame([("r", i, "AAAA" if i == 40 else "ACGT", 0.9) for i in range(80)], "read string, i int, kmer string, prob double")
    mask = "".join(r["mask"] for r in sq.error_mask(k).orderBy("i").collect())
    assert mask == "N" * 15 + "E" * 25 + "P" + "E" * 25 + "N" * 14


def test_read_filters(spark):
    df = spark.createDataFrame([("a", 0, 2500, [1, 5]), ("b", 1, 2500, list(range(250))), ("c", 2, 900, list(range(500)))], "read_name string, k int, length int, errors array<int>")
    assert sorted(r.read_name for r in reads.accurate_reads(df).collect()) == ["a", "c"]
    assert one(spark, n=reads.mismatch_events(F.array(*map(F.lit, [1, 2, 2, 7, 9])))).n == 3
    q = spark.createDataFrame([("s", [10, 10]), ("s", [30, 30]), ("s", [30, 30])], "sample string, qual array<int>")
    assert reads.good_quality_reads(q).count() == 2
    g = spark.createDataFrame([("v", -1.0, -5.0)] * 6 + [("v", -5.0, -1.0)] * 6 + [("w", -1.0, -6.0)] * 9, "id string, ref_ll double, alt_ll double")
    assert {r.id: r.gt for r in genotype.bayes_genotype(g, {"0/0": 0.0, "0/1": 0.5, "1/1": 1.0}).collect()} == {"v": "0/1", "w": "0/0"}


def test_sample_populations_and_file_lists(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("\n".join("\t".join(["s", "a", "b", "c", "d", "e", str(n)]) for n in (3, 1, 2)) + "\n\n")
    assert [(x.sample, x.population) for x in variants.read_sample_population(spark, f"{tmp_path}/p.tsv").orderBy("sample").collect()] == [(0, 2), (1, 0), (2, 1)]
    (tmp_path / "list.txt").write_text("a.vcf\n\n b.vcf \n")
    assert regions.read_file_list(spark, f"{tmp_path}/list.txt") == ["a.vcf", "b.vcf"]


def test_vcf_header_and_set_of_files(spark, tmp_path):
    schema = "chrom string, pos int, ref string, alt string, qual int, filter string, svtype string, svlen int, gt string, gq int, lr array<int>, sr array<int>, imprecise boolean"
    for k, chrom in enumerate("21"):
        calls = spark.createDataFrame([(chrom, 9, "N", "A", 1, "PASS", "INS", 60, "0/1", 1, None, None, True), (chrom, 5, "N", "C", 1, "PASS", "DEL", -60, "1/1", 1, None, None, None)], schema)
        variants.write_vcf(calls, f"{tmp_path}/{k}", spark.createDataFrame([("1", 500), ("2", 400)], "name string, length int"))
    lines = [x for part in sorted((tmp_path / "0").glob("part-*")) for x in part.read_text().splitlines()]
    head = [x for x in lines if x.startswith("#")]
    assert head[0] == "##fileformat=VCFv4.2" and head[-1] == variants.COLUMNS_LINE and head[-3:-1] == ["##contig=<ID=1,length=500>", "##contig=<ID=2,length=400>"]
    assert {x.split("=<ID=")[0] for x in head[1:-1]} == {"##INFO", "##FORMAT", "##FILTER", "##ALT", "##contig"}
    both = variants.concat_vcf(spark, [f"{tmp_path}/0", f"{tmp_path}/1"]).collect()
    assert [(x.chrom, x.pos, x.svlen, "IMPRECISE" in x.info) for x in both] == [("1", 5, -60, False), ("1", 9, 60, True), ("2", 5, -60, False), ("2", 9, 60, True)]
