"""Operators that work in bins, pieces or islands against plain loops, for any width; rules in full tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequence as sq
from strandloom.operators import cohort, contigs, folds, genotype, reads, short_signals
from strandloom.operators import intervals as ops


def spans(seed, n=120, top=3000, longest=120):
    r = random.Random(seed)
    return [(i, r.randrange(2), s := r.randrange(top), s + r.randrange(longest)) for i in range(n)]


SCHEMA = "id int, chrom int, st int, ed int"


@pytest.mark.parametrize("stretch", [1, 37, 500, 10_000])
@pytest.mark.parametrize("gap", [0, 15])
def test_islands_for_any_stretch(spark, stretch, gap):
    rows = spans(stretch) + [(900, 0, 50, 50), (901, 0, 50, 50), (902, 1, 0, 2900)] * (gap > 0)
    want, far, start = {}, {}, {}
    for i, c, st, ed in sorted(rows, key=lambda x: (x[1], x[2], x[3])):
        if c not in far or st - far[c] > gap:
            start[c] = st
        want[i], far[c] = (c, start[c]), max(far.get(c, ed), ed)
    got = ops.with_island(spark.createDataFrame(rows, SCHEMA).repartition(3), gap, stretch=stretch).collect()
    assert {r.id: (r.chrom, r.island) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("stretch", [1, 64, 10_000])
def test_depth_steps_for_any_stretch(spark, stretch):
    rows = spans(5)
    depth = {}
    for _, c, st, ed in rows:
        for p in range(st, ed + 1):
            depth[c, p] = depth.get((c, p), 0) + 1
    got = ops.depth_steps(spark.createDataFrame(rows, SCHEMA), stretch).collect()
    assert {(r.chrom, p): r.n for r in got for p in range(r.st, r.ed + 1)} == depth and sum(r.ed - r.st + 1 for r in got) == len(depth)


@pytest.mark.parametrize("stretch", [7, 400, 10_000])
def test_nearest_and_flanking_for_any_stretch(spark, stretch, monkeypatch):
    monkeypatch.setattr(ops, "STRETCH", stretch)
    monkeypatch.setattr(reads, "STRETCH", stretch)
    rows, r = spans(9, 60), random.Random(4)
    points = [(i, r.randrange(3), r.randrange(3200)) for i in range(80)]
    p, t = spark.createDataFrame(points, "id int, chrom int, pos int"), spark.createDataFrame(rows, SCHEMA)
    want = {i: min(((max(0, st - x, x - ed), k) for k, d, st, ed in rows if d == c), default=(None, None)) for i, c, x in points}
    assert {x.id: (x.distance, x.target) for x in ops.nearest(p, t).collect()} == want
    want = {}
    for i, c, x in points:
        front = min(((st - x, k % 5) for k, d, st, ed in rows if d == c and st - x > 20), default=None)
        back = min(((x - ed, k % 5) for k, d, st, ed in rows if d == c and x - ed > 20), default=None)
        if front and back and front[1] == back[1] and max(front[0], back[0]) < 600 and (w := min((w for w in (60, 900) if w > max(front[0], back[0])), default=None)):
            want[i] = (w, front[1], back[0], front[0])
    a = t.withColumn("sample", F.lit(1)).withColumn("read", F.col("id") % 5)
    got = reads.flanking_alignments(p.withColumn("sample", F.lit(1)), a, 20, (60, 900), 600).collect()
    assert {x.id: (x.w, x.read, x.before, x.behind) for x in got} == want and want


def test_kmers_of_long_strings(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("ACGTN") for _ in range(n)) for n in (0, 3, 4, 511, 512, 513, 514, 515, 516, 1030, 3000)]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, s string").select("id", sq.kmers("s", 4).alias("k"), sq.kmers("s", F.lit(3), False).alias("m")).collect()
    for x in got:
        t = texts[x.id]
        assert x.k == [w for i in range(len(t) - 3) if "N" not in (w := t[i : i + 4])] and x.m == [t[i : i + 3] for i in range(len(t) - 2)]
    pairs = spark.createDataFrame([(1, texts[-1], texts[-2]), (2, "AAAA", "CAAC"), (3, "A", "A")], "id int, a string, b string")
    other = {texts[-2][i : i + 2] for i in range(len(texts[-2]) - 1)}
    assert {x.id: x.n for x in reads.shared_kmer_counts(pairs, 2).collect()} == {1: sum(texts[-1][i : i + 2] in other for i in range(len(texts[-1]) - 1)), 2: 3, 3: 0}


def test_colours_in_full(spark):
    rows = [(k, v, *n) for k, (v, n) in enumerate(itertools.product([True, False], itertools.product([0, 2], repeat=4)))]
    got = {r.id: r.colour for r in contigs.colours(spark.createDataFrame(rows, "id int, vntr boolean, class_1 int, class_2 int, class_3 int, class_4 int")).collect()}
    for k, v, a, b, c, d in rows:
        inside = {(False, False): "black", (True, False): "yellow", (False, True): "green", (True, True): "green"}[a > 0, b > 0]
        outside = {(False, False): "black", (True, False): "purple", (False, True): "blue", (True, True): "red"}[c > 0, d > 0]
        assert got[k] == (inside if v else outside)


def test_corrected_colours(spark):
    rows = spark.createDataFrame([("a", 0, 9, 9), ("a", 1, 7, 5), ("a", 2, 7, 5), ("b", 0, 4, 1)], "region string, run int, size int, only_purple int")
    places = spark.createDataFrame([("a", 1, p) for p in (5, 20, 41, 100)], "region string, run int, pos int")
    assert {(r.region, r.run): r.corrected for r in contigs.corrected_colours(rows, places).collect()} == {("a", 1): 5, ("a", 2): 7, ("b", 0): 4}


def test_insert_vntr_length_equals_masks(spark):
    r = random.Random(6)
    inserts = [(f"n{k}", 80 + k) for k in range(12)]
    trf = [(f"n{r.randrange(12)}", s := r.randrange(90), s + r.randrange(1, 30), r.randrange(3, 9)) for _ in range(40)]
    rm = [(f"n{r.randrange(12)}", s := r.randrange(90), s + r.randrange(1, 40), r.choice(["Simple_repeat", "LINE/L1", "SINE/Alu", "other"])) for _ in range(50)]
    want = {}
    for name, n in inserts:
        mask = [0] * n
        for x in [t[:3] for t in trf if t[0] == name] + [x[:3] for x in rm if x[0] == name and x[3] == "Simple_repeat"]:
            for p in range(max(0, x[1]), min(n, x[2])):
                mask[p] = 1
        for _, st, ed, kind in [x for x in rm if x[0] == name and x[3] in ("LINE/L1", "SINE/Alu")]:
            if sum(max(0, min(ed, t[2]) - max(st, t[1])) for t in trf if t[0] == name and t[3] < 6) < 0.8 * (ed - st):
                for p in range(max(0, st), min(n, ed)):
                    mask[p] = 0
        want[name] = (sum(mask), max((len(list(g)) for k, g in itertools.groupby(mask) if not k), default=0))
    got = contigs.insert_vntr_length(spark.createDataFrame(inserts, "name string, length int"), spark.createDataFrame(rm, "name string, st int, ed int, class string"), spark.createDataFrame(trf, "name string, st int, ed int, motif_size int"))
    assert {x.name: (x.vntr, x.longest_free) for x in got.collect()} == want


def plain_combine(rows, spread, accept, reach, least_reads, least_score):
    """The rule for one type and side, written with whole lists and no early end of the search."""
    rows, used, out = sorted(rows, key=lambda r: (r["st"], r["ed"], r["st2"], r["ed2"], r["id"])), set(), []
    for i, r in enumerate(rows):
        if i in used:
            continue
        lo, hi, lo2, hi2, mine = r["st"], r["ed"], r["st2"], r["ed2"], [i]
        for j in range(i + 1, len(rows)):
            x = rows[j]
            if j not in used and x["st"] <= hi and lo <= x["ed"] and x["st2"] <= hi2 and lo2 <= x["ed2"] and x["chrom2"] == r["chrom2"]:
                lo, hi, lo2, hi2 = min(lo, x["st"]), max(hi, x["ed"]), min(lo2, x["st2"]), max(hi2, x["ed2"])
                mine.append(j)
        used |= set(mine)
        if sum(rows[k]["reads"] for k in mine) < least_reads or sum(rows[k]["score"] for k in mine) <= least_score:
            continue
        p1, p2 = {}, {}
        for k in mine:
            for d, w in enumerate(spread):
                p1[rows[k]["st"] + d] = p1.get(rows[k]["st"] + d, 0) + w
                if rows[k]["ed2"] - d >= lo2:
                    p2[rows[k]["ed2"] - d] = p2.get(rows[k]["ed2"] - d, 0) + w
        one = max((x for x in p1 if x <= hi + 1), key=lambda x: (round(p1[x], 9), -x))
        two = max((x for x in p2 if x <= hi2 + 1), key=lambda x: (round(p2[x], 9), -x))
        if max(p1[one], p2[two]) < accept:
            continue
        fits = [k for k in mine if one - reach <= rows[k]["st"] <= one and two <= rows[k]["ed2"] <= two + reach]
        used -= set(mine) - set(fits)
        out.append((one, two, sum(rows[k]["reads"] for k in fits), int(2 * max(p1[one], p2[two]) / accept)))
    return sorted(out)


def test_combined_signals_take_likeliest_breakpoints(spark):
    r, spread = random.Random(3), reads.clip_distribution(40)
    rows = [{"chrom": 1, "type": "DEL", "side": "BEGIN", "st": (s := r.randrange(1500)), "ed": s + 60, "chrom2": 1, "st2": 4000 + s + r.randrange(90), "ed2": 0, "score": 10.0, "reads": 1, "id": i} for i in range(120)]
    for x in rows:
        x["ed2"] = x["st2"] + 60
    df = spark.createDataFrame([tuple(x[f] for f in short_signals.FIELDS) for x in rows], "chrom int, type string, side string, st int, ed int, chrom2 int, st2 int, ed2 int, score double, reads int, id int")
    got = short_signals.combine(df, 2, 16, spread=spread, accept=2 * max(spread)).collect()
    assert sorted((x.st + 100, x.st2 + 100, x.reads, int(x.score)) for x in got) == plain_combine(rows, spread, 2 * max(spread), 40, 2, 16) and len(got) > 3
    assert short_signals.cuts(66) == {"combine": 26, "score": 5, "reads": 6} and short_signals.cuts(10) == {"combine": 16, "score": 2, "reads": 3}


def test_sides_pair_over_wide_regions_and_need_more_alone(spark):
    schema = "chrom int, type string, side string, st int, ed int, chrom2 int, st2 int, ed2 int, score double, reads int, id int"
    rows = [(1, "DEL", "BEGIN", 0, 40_000, 1, 0, 9, 8.0, 4, 1), (1, "DEL", "END", 39_000, 39_500, 1, 5, 9, 8.0, 4, 2), (1, "DUP", "BEGIN", 0, 9, 1, 0, 9, 25.0, 9, 3), (1, "DEL", "BEGIN", 90_000, 90_009, 1, 0, 9, 19.0, 9, 4)]
    got = short_signals.pair_sides(spark.createDataFrame(rows, schema), 10, 4, 1.5).collect()
    assert sorted((x.side, x.id) for x in got) == [("SOLID", 1)]
    assert sorted((x.side, x.id) for x in short_signals.pair_sides(spark.createDataFrame(rows, schema)).collect()) == [("BEGIN", 3), ("BEGIN", 4), ("SOLID", 1)]


def test_crowded_blocks_compare_alleles(spark):
    rows = [(1, 30 + k % 5, 60 + k, "N", "A" * (60 + k), 1, k, 0, 1, 9.0) for k in range(101)] + [(1, 30, 10**6, "N", "A" * 61, 2, 500, 1, 1, 9.0), (1, 900, 70, "N", "A" * 70, 2, 501, 1, 1, 9.0)]
    df = spark.createDataFrame(rows, "chrom int, pos int, svlen int, ref string, alt string, sample int, id int, a1 int, a2 int, qual double")
    got = {(r.pos, r.svlen): [s.id for s in r.support] for r in cohort.merge_cohort(df).collect()}
    assert got[30, 60] == [0, 500] and got[900, 70] == [501] and len(got) == 102  # the hundred and second goes by its ALT


def test_one_allele_per_region_needs_like_support(spark):
    rows = [(1, 5, "N", "A", 1, 10, 9, 0), (1, 5, "N", "A", 2, 11, 3, 4), (1, 5, "N", "A", 1, 12, 2, 1), (1, 5, "N", "A", 3, 13, 0, 6)]
    df = spark.createDataFrame(rows, "chrom int, pos int, ref string, alt string, region int, id int, alt_n int, ref_n int")
    assert {r.id for r in cohort.one_allele_per_region(df).collect()} == {10, 12}  # 11 is like 10; 13 is like 12
    assert {r.id for r in cohort.one_allele_per_region(df.filter("id in (10, 13)")).collect()} == {10, 13}


def test_drop_close_keeps_the_longer(spark):
    rows = [(1, 1, 100, 500), (2, 1, 150, 520), (3, 1, 160, 900), (4, 1, 500, 505), (5, 2, 100, 500), (6, 1, 3000, -80), (7, 1, 3001, 80)]
    df = spark.createDataFrame(rows, "id int, chrom int, st int, svlen int")
    assert {r.id for r in folds.drop_close(df).collect()} == {2, 3, 4, 5, 6, 7}


def test_linked_reads_and_contig_clusters(spark):
    scores = spark.createDataFrame([("r", 1, 2, 6), ("r", 1, 3, -4), ("r", 2, 3, -4), ("r", 3, 4, 3)], "region string, r1 int, r2 int, score int")
    members = spark.createDataFrame([("r", k) for k in (1, 2, 3, 4, 5)] + [("s", 9)], "region string, read int")
    assert {(r.region, r.read): r.grp for r in contigs.group_linked_reads(scores, members).collect()} == {("r", 1): 0, ("r", 2): 0, ("r", 3): 1, ("r", 4): 1, ("r", 5): -1, ("s", 9): 0}
    rows = spark.createDataFrame([("r", c, k) for k, c in enumerate("abcd")] + [("q", "x", 0)], "region string, contig string, ord int")
    differ = spark.createDataFrame([("r", "b", "a"), ("r", "a", "d"), ("r", "d", "b")], "region string, a_contig string, b_contig string")
    assert {(r.region, r.contig): r.cluster for r in contigs.cluster_contigs(rows, differ).collect()} == {("r", "a"): 0, ("r", "b"): 1, ("r", "c"): 0, ("r", "d"): 2, ("q", "x"): 0}


def test_phase_and_somatic(spark):
    rows = spark.createDataFrame([("0/1", 0, 2, "x"), ("0/1", 1, 2, "x"), ("1/1", 0, 1, "x"), ("0/0", 1, 2, "x"), ("0/1", 0, 1, "x"), ("./.", 0, 2, "x")], "gt string, hap int, n int, region string")
    got = [r.p for r in rows.select(genotype.phase(F.col("gt"), F.col("hap"), F.col("n"), F.col("region")).alias("p")).collect()]
    assert got[:4] == ["0|1", "1|0", "1|1", "0|0"] and got[4] in ("0|1", "1|0") and got[5] == "./."
    schema = "region string, contig string, seq string, support int"
    tumor = spark.createDataFrame([("r", "t1", "A" * 100, 5), ("r", "t2", "C" * 100, 5), ("r", "t3", "G" * 9, 2), ("u", "t4", "A" * 50, 9)], schema)
    normal = spark.createDataFrame([("r", "n1", "A" * 110, 4)], schema)
    pairs = spark.createDataFrame([("r", "t1", "n1", True, 95), ("r", "t2", "n1", True, 10)], "region string, t_contig string, n_contig string, end_to_end boolean, matches int")
    assert {r.contig for r in genotype.somatic(tumor, normal, pairs).collect()} == {"t2"}
    assert {r.contig for r in genotype.somatic(tumor, normal, pairs, tumor_only=True).collect()} == {"t2", "t4"}


def test_clips_and_homopolymers(spark):
    c = F.lit
    got = spark.range(1).select(
        sq.homopolymer_equal(c("AACCG"), c("ACCCGG")).alias("a"), sq.homopolymer_equal(c("ACG"), c("AGC")).alias("b"), sq.poly_at_rejects(c("A" * 19 + "C"), c(100)).alias("d"), sq.poly_at_rejects(c("ACGT" * 5), c(100)).alias("e"),
        sq.poly_at_rejects(c("ACGT" * 5), c(10)).alias("f"), sq.clip_is_poor(F.array(c(10), c(10)), F.array(c(30), c(20))).alias("g"), sq.clip_is_poor(F.array(c(20)), F.array(c(30))).alias("h"), sq.strand_bias(c("G" * 80)).alias("i"), sq.strand_bias(c("GC" * 80)).alias("j"),
    ).first()
    assert tuple(got) == (True, False, True, False, True, True, False, True, False)


def test_pair_regions_and_mates(spark):
    schema = "read_name string, flag int, chrom int, pos int, mate_chrom int, mate_pos int, isize int"
    rows = spark.createDataFrame([("a", 1 + 32, 1, 1000, 1, 9000, 8150), ("b", 1, 1, 5000, 2, 700, 0)], schema)
    got = {r["class"]: (r.st, r.ed, r.st2, r.ed2) for r in reads.pair_regions(rows, 1000, 150).collect()}
    assert got == {"DEL": (1150, 1850, 8300, 9000), "TRA_INV": (5150, 5850, 850, 1550)}
    mates = spark.createDataFrame([("a", 1 + 16, 1, 9000, 1, 1000, -8150), ("b", 1, 2, 700, 1, 5000, 0)], schema)
    assert {r.read_name for r in reads.fetch_mates(rows, mates).collect()} == {"a", "b"} and reads.fetch_mates(rows, mates, 1).count() == 0


def test_report_of_regions(spark):
    sv = spark.createDataFrame([("r", 0, 1, 15, 3), ("r", 0, 1, 16, 4), ("r", 1, 2, 35, 1)], "region string, a int, b int, pos int, class int")
    runs = spark.createDataFrame([("r", 0, 0, 9, True), ("r", 1, 10, 29, False), ("r", 2, 30, 39, True)], "region string, run int, st int, ed int, vntr boolean")
    clusters = spark.createDataFrame([("r", k) for k in range(3)], "region string, cluster int")
    got = {x.run: (x.n_clusters, x.class_3, x.class_4) for x in contigs.subregion_clusters(clusters, sv, runs).collect()}
    assert got == {0: (3, 0, 0), 1: (2, 1, 1), 2: (3, 0, 0)}
    assert [(x.region, x.run) for x in contigs.complex_runs(sv, runs).collect()] == [("r", 1)]
    held = spark.createDataFrame([("r", "a", 0), ("r", "b", 0), ("r", "c", 1)], "region string, contig string, cluster int")
    kinds = spark.createDataFrame([("r", "a", "LINE"), ("r", "b", "SINE"), ("r", "b", "LINE")], "region string, contig string, class string")
    assert {x.cluster: (x.size, x.contigs, x.classes) for x in contigs.cluster_report(held, kinds).collect()} == {0: (2, ["a", "b"], ["LINE", "SINE"]), 1: (1, ["c"], [])}


def test_subregion_clusters_equal_plain_loops(spark):
    r = random.Random(12)
    runs = [("r", 0, 0, 99, False), ("r", 1, 0, 39, False), ("r", 2, 40, 69, True), ("r", 3, 70, 99, False)]
    sv = [("r", *r.sample(range(5), 2), r.randrange(100), r.choice([0, 1, 2, 3, 3, 4])) for _ in range(60)]
    want = {}
    for _, run, st, ed, vntr in runs:
        n = [0] * 5
        for *_, pos, k in sv:
            n[k] += st <= pos <= ed and k == 1
        stay, purple, places = 0, 0, []
        for c in range(5):
            new, blue, mine = True, False, []
            for t in range(c if not vntr else 0):
                hit = [(pos, k) for _, a, b, pos, k in sv if {a, b} == {c, t} and st <= pos <= ed and k != 1]
                for pos, k in hit:
                    n[k] += 1
                    mine += [pos] * (k == 3)
                    blue |= k == 4
                if not hit:
                    new = False
                    break
            stay += new
            if new and not vntr:
                purple += not blue
                places += mine
        want[run] = (stay, purple, n, sorted(places))
    args = (spark.createDataFrame([("r", k) for k in range(5)], "region string, cluster int"), spark.createDataFrame(sv, "region string, a int, b int, pos int, class int"), spark.createDataFrame(runs, "region string, run int, st int, ed int, vntr boolean"))
    got = contigs.subregion_clusters(*args).collect()
    assert {x.run: (x.n_clusters, x.only_purple, [x[f"class_{k}"] for k in range(5)], x.places) for x in got} == want


def plain_clusters(order, differ):
    """Each contig meets the leaders, the reference's first, then larger clusters first."""
    leader, size, out = [], [], {}
    for c in order:
        for k in sorted(range(len(leader)), key=lambda k: (k > 0, -size[k], k)):
            if (c, leader[k]) not in differ and (leader[k], c) not in differ:
                break
        else:
            k = len(leader)
            leader.append(c)
            size.append(0)
        size[k] += 1
        out[c] = k
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_contig_clusters_of_200_regions_equal_a_plain_loop(spark, parts):
    rows, pairs, want = [], [], {}
    for g in range(200):
        r = random.Random(g)
        names = [f"c{k}" for k in r.sample(range(99), r.randrange(1, 14))]
        differ = {(a, b) for a, b in itertools.combinations(names, 2) if r.random() < (0.2, 0.5, 0.9, 1.0)[g % 4]}
        rows += [(g, c, k // 2) for k, c in enumerate(sorted(names))]
        pairs += [(g, *r.sample(p, 2)) for p in differ for _ in range(r.randrange(1, 3))]
        want |= {(g, c): k for c, k in plain_clusters(sorted(names), differ).items()}
    both = spark.createDataFrame([(g, c, k, None, None) for g, c, k in rows] + [(g, None, None, a, b) for g, a, b in pairs], "region int, contig string, ord int, a_contig string, b_contig string").repartition(parts)
    got = contigs.cluster_contigs(both.filter("contig is not null").select("region", "contig", "ord"), both.filter("contig is null").select("region", "a_contig", "b_contig"))  # one table on both sides
    assert {(x.region, x.contig): x.cluster for x in got.collect()} == want
    assert contigs.cluster_contigs(both.limit(0).select("region", "contig", "ord"), both.limit(0).select("region", "a_contig", "b_contig")).count() == 0


def plain_read_groups(reads_, score):
    groups, out = [], {}
    for x in sorted(reads_):
        sums = [sum(score.get((min(x, y), max(x, y)), 0) for y in g) for g in groups]
        if any(s > 0 for s in sums):
            k = sums.index(max(sums))
        elif not groups or any(s < 0 for s in sums):
            k = len(groups)
            groups.append([])
        else:
            k = -1
        out[x] = k
        if k >= 0:
            groups[k].append(x)
    return out, groups


@pytest.mark.parametrize("parts", [1, 5])
def test_read_groups_scores_and_majority_of_200_regions(spark, parts):
    rows, pairs, back, want, sums, rejected = [], [], [], {}, {}, {}
    for g in range(200):
        r = random.Random(g)
        names = r.sample(range(500), r.randrange(1, 12))
        score = {(a, b): r.choice([-4, 3, 1, 0, 45]) for a, b in itertools.combinations(sorted(names), 2) if r.random() < 0.6}
        out, groups = plain_read_groups(names, score)
        rows += [(g, x) for x in names for _ in range(1 + x % 2)]
        pairs += [(g, *r.sample(p, 2), s) for p, s in score.items()]
        want |= {(g, x): k for x, k in out.items()}
        for k, m in enumerate(groups):
            each = [sum(score.get((min(x, y), max(x, y)), 0) for y in m if y != x) for x in m]
            sums[g, k] = (len(m), sum(each), sum(e < 40 for e in each))
        for target in range(2):
            mine = r.sample(names, r.randrange(0, len(names) + 1))
            for x in mine:
                others = [y for y in mine if y != x]
                back += [(g, x, target, y) for y in others]
                same = sum(out[y] == out[x] for y in others)
                if others:
                    rejected[g, target, x] = (same, len(others) - same, same < len(others) - same)
    members, scores = spark.createDataFrame(rows, "region int, read int").repartition(parts), spark.createDataFrame(pairs, "region int, r1 int, r2 int, score long").repartition(parts)
    groups = contigs.group_linked_reads(scores, members)
    assert {(x.region, x.read): x.grp for x in groups.collect()} == want
    assert {(x.region, x.grp): (x.reads, x.score, x.low) for x in contigs.linked_group_scores(groups, scores).collect()} == sums
    got = contigs.rejected_reads(groups, spark.createDataFrame(back, "region int, read int, target int, supporter int"))
    assert {(x.region, x.target, x.read): (x.same, x.other, x.rejected) for x in got.collect()} == rejected


def plain_absorb(rows, joins):
    out = []
    for st, ed, n in sorted(rows):
        if out and joins(out[-1][0], out[-1][1], st, ed):
            a = out[-1]
            out[-1] = [min(a[0], st), max(a[1], ed), a[2] + n]
        else:
            out.append([st, ed, n])
    return out


def test_a_million_rows_in_one_island_pass_a_fold(spark):
    """One island, from one task, that holds an anchor and a batch: it neither fails nor lists the island."""
    rows = spark.range(1_000_000).selectExpr("1 AS chrom", "'x' AS kind", "id * 10 AS st", "id * 10 + (id * 7919) % 900 AS ed", "1L AS support", "id")
    got = folds.merge_normal(rows, 1)
    n, total = got.selectExpr("count(1)", "sum(support)").first()
    assert total == 1_000_000
    joins = lambda st, ed, x, y: any(abs(p - q) < 300 for p in (st, ed) for q in (x, y)) or (st <= x and y <= ed)
    assert n == len(plain_absorb([(i * 10, i * 10 + i * 7919 % 900, 1) for i in range(1_000_000)], joins))
    fold = folds.Absorb(joins)
    for i in range(1000):
        list(fold.take((1, "x", i, i, 1, i)))
    assert len(fold.anchor) == 6


def plain_drop_close(rows, near=300, low=0.9, high=1.1):
    rows, gone = sorted(rows, key=lambda x: (x[1], x[2], x[0])), set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[0] in gone or b[1] - a[1] > near:
                break
            if b[0] not in gone and b[2] and low <= a[2] / b[2] <= high:
                gone.add(b[0] if abs(a[2]) >= abs(b[2]) else a[0])
    return {x[0] for x in rows} - gone


def test_close_calls_equal_a_plain_loop(spark):
    r = random.Random(17)
    rows = [(i, r.randrange(4), r.randrange(9000), r.choice([-1, 1]) * r.randrange(0, 60)) for i in range(1500)]
    want = set().union(*(plain_drop_close([(i, st, n) for i, c, st, n in rows if c == k]) for k in range(4)))
    for parts in (1, 6):
        assert {x.id for x in folds.drop_close(spark.createDataFrame(rows, "id int, chrom int, st int, svlen int").repartition(parts)).collect()} == want
    held = folds.CloseCalls(300, 0.9, 1.1)
    for i in range(100_000):
        list(held.take((i, i * 10, 5)))
        assert len(held.open) <= 31


def test_sweeps_hold_an_anchor_s_window_alone():
    held, out = short_signals.Sweep(), []
    for i in range(50_000):
        out += held.take((1, "DEL", "BEGIN", i * 10, i * 10 + 5, 1, i * 10, i * 10 + 5, 1.0, 1, i))
        assert len(held.held) < 2500
    assert len(out) + len(list(held.end())) == 50_000


@pytest.mark.parametrize("width", [1, 10, 1000])
@pytest.mark.parametrize("levels", [None, 1, 3])
def test_overlaps_of_lengths_from_1_to_100_million(spark, width, levels):
    r = random.Random(width)
    top = 50 * SPAN if levels != 1 else 5000 * width
    make = lambda n: [(i, r.randrange(2), s := r.randrange(-1000, top), s + min(int(10 ** r.uniform(0, 8)), top) - 1) for i in range(n)]
    a, b = make(150), make(150)
    left, right = spark.createDataFrame(a, LONG), spark.createDataFrame(b, LONG)
    for pad in (0, 700):
        got = sorted((x.id, x.r_id) for x in ops.overlap_join(left, right, width, pad, levels=levels).collect())
        assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] - pad <= y[3] and y[2] <= x[3] + pad)
    bed = right.withColumnRenamed("id", "bed_order")
    got = {x.id: x.r_bed_order for x in ops.containment_join(left, bed, width).collect()}
    assert got == {x[0]: min((y[0] for y in b if y[1] == x[1] and y[2] <= x[2] and x[3] <= y[3]), default=None) for x in a}


SPAN, LONG = 1_000_000, "id int, chrom int, st long, ed long"


def test_rows_go_to_few_bins_whatever_their_length(spark):
    rows = spark.createDataFrame([(i, 1, 7, 7 + int(10 ** (i / 12))) for i in range(101)], LONG)
    n = ops.dealt(rows, "st", "ed", 10, 0).groupBy("id").count().agg(F.max("count")).first()[0]
    assert n <= ops.SPREAD + 1
    both = ops.dealt(rows, "st", "ed", 10, ops.LEVELS - 1).groupBy("id").count().agg(F.max("count")).first()[0]
    assert both <= ops.SPREAD + 1 + 2 * (ops.LEVELS - 1)


@pytest.mark.parametrize("most", [1, 5, 40, 10_000])
def test_stretches_by_rows(spark, most):
    """Results don't hang on where stretches are cut, and a stretch has about `most` rows, but for a pile at one place."""
    rows = spans(most, 300) + [(2000 + k, 0, 1500, 1500 + k % 7) for k in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    a, b = ops.with_island(df, 3, stretch=10**6), ops.with_island(df, 3, most=most)
    assert sorted(map(tuple, a.select("id", "island").collect())) == sorted(map(tuple, b.select("id", "island").collect()))
    assert sorted(map(tuple, ops.depth_steps(df, 10**6).collect())) == sorted(map(tuple, ops.depth_steps(df, 10**6, most).collect()))
    points = df.select("id", "chrom", F.col("st").alias("pos"))
    assert sorted(map(tuple, ops.nearest(points, df).select("id", "target", "distance").collect())) == sorted(map(tuple, ops.nearest(points, df, most=most).select("id", "target", "distance").collect()))
    cut = ops.stretches(df, ("chrom",), "st", 1, most, fine=1)
    per = cut.groupBy("chrom", "_bin").agg(F.count(F.lit(1)).alias("n"), F.min("st").alias("lo"), F.max("st").alias("hi")).collect()
    assert all(x.n <= 2 * most + 3 or x.lo == x.hi or x.lo <= 1500 <= x.hi for x in per)
    order = sorted((x.chrom, x["_bin"], x.lo, x.hi) for x in per)
    assert all(p[0] != q[0] or p[3] < q[2] for p, q in zip(order, order[1:]))


def test_ids_of_tables_sixty_times_as_large(spark):
    """Keys of 60 times sf0.1 pass the long range of the views' ids: they stay long, not negative and distinct; smaller ones are unchanged."""
    from strandloom import contig_queries, views

    rest = ["CAST(id % 7 AS INT) AS l_linenumber", "1199000 + id AS l_partkey", "59900 + id % 90 AS l_suppkey", "CAST(1 + id % 50 AS DOUBLE) AS l_quantity"]
    far, near = (spark.range(500).selectExpr(f"{k} AS l_orderkey", *rest) for k in ("8999000 + id", "7000000 - id"))
    ids = [r.i for r in far.selectExpr(f"{views.in_spark(views._ID)} AS i", f"{contig_queries._SPARK_ID} AS j").collect()]
    assert len(set(ids)) == 500 and min(ids) >= 0
    assert near.filter(f"{views.in_spark(views._ID)} = {views._ID}").count() == 500


def test_window_numbers_are_those_of_windows(spark):
    """k-mers are compared inside their row, without a shuffle of k-mers, for any k and letters."""
    import random

    from strandloom.functions.sequence import shared_windows, windows
    from strandloom.operators import reads

    rng = random.Random(5)
    for letters, n in (("AC", 300), ("ACGT", 900), ("aé漢🙂", 200)):
        a, b = ("".join(rng.choice(letters) for _ in range(n)) for _ in range(2))
        b += a[10:90]
        for k in (1, 3, 6, 17, 40, 64):
            cut = [a[i : i + k] for i in range(len(a) - k + 1)]
            x = windows(a, k)
            assert len(x) == len(cut) and len(set(zip(x, cut))) == len(set(cut)) == len(set(x.tolist()))
            assert shared_windows(a, b, k) == sum(c in b for c in cut)
    pairs = spark.createDataFrame([(1, "ACGTACGT", "GTAC"), (2, "A", "ACG"), (3, None, "ACG")], "id long, a string, b string")
    out = reads.shared_kmer_counts(pairs, 3)
    assert {r.id: r.n for r in out.collect()} == {1: 2, 2: 0, 3: 0}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_largest_repeat_climbs_the_grid(spark):
    """the same as with every k-mer in a set, in O(length) numbers for each k and no further k than the first without repeat."""
    import random

    from strandloom.functions import sequence as sq

    rng = random.Random(8)
    texts = ["".join(rng.choice("ACGTN" if i % 3 else "AC") for _ in range(rng.choice((0, 3, 60, 500)))) for i in range(40)] + [None]
    texts += [t + t[5:70] for t in texts[:-1]]

    def plain(t, skip):
        best = 0
        for k in range(2, 41, 3):
            every = [t[i : i + k] for i in range(len(t or "") - k + 1) if not (skip and "N" in t[i : i + k])]
            best = k if len(set(every)) < len(every) else best
        return best

    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    got = df.select("id", sq.max_repeat_k("s", 2, 40, 3).alias("k"), sq.max_repeat_k("s", 2, 40, 3, False).alias("all")).collect()
    assert {r.id: (r.k, r.all) for r in got} == {i: (plain(t, True), plain(t, False)) for i, t in enumerate(texts)}
    plan = df.select(sq.max_repeat_k("s").alias("k"))._jdf.queryExecution().executedPlan().toString()
    assert "array_distinct" not in plan


def test_arrays_of_elements_pass_in_batches(spark):
    """groups that batches cut give the same as whole ones, and the matrix of neighbours the same labels as the search."""
    import numpy as np

    from strandloom.operators import mei

    rng = np.random.default_rng(3)
    for n in (3, 20, 90):
        for _ in range(30):
            points = rng.normal(size=(n, 2)).round(1)
            assert mei.dense_dbscan(points, 0.45, 3).tolist() == mei.dbscan(points, 0.45, 3).tolist()
    rows = [(s, t, int(x), int(x) + 20 * (k % 4), 20 * (k % 4)) for s in (None, "a", "b", "c") for t in (1, 2) for k, x in enumerate(rng.integers(0, 9000, 2 if s == "b" else 60))]
    df = spark.createDataFrame(rows, "sample string, type int, st long, ed long, length long")
    whole = sorted(map(str, mei.mei_arrays(df).collect()))
    assert len(whole) == 6
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert sorted(map(str, mei.mei_arrays(df).collect())) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert "FlatMapGroupsInPandas" not in mei.mei_arrays(df)._jdf.queryExecution().executedPlan().toString()


def test_pairs_and_bases_stay_in_the_task_of_their_group(spark):
    """F30, F32: pieces of reads and bases of regions are shuffled, not the rows made of them."""
    from strandloom.functions import cigar as cg
    from strandloom.operators import contigs, reads

    rows = spark.createDataFrame([("c", 4090, "6M1I2D4M", "ACGTACTGGGG"), ("c", 4094, "4M", "AC")], "chrom string, pos int, text string, seq string").withColumn("cigar", cg.parse("text")).drop("text")
    out = reads.pile_up(rows)
    assert {r.pos: (r.A, r.C, r.G, r.T, r.D, r.I) for r in out.collect()} == {
        4090: (1, 0, 0, 0, 0, 0), 4091: (0, 1, 0, 0, 0, 0), 4092: (0, 0, 1, 0, 0, 0), 4093: (0, 0, 0, 1, 0, 0), 4094: (2, 0, 0, 0, 0, 0), 4095: (0, 2, 0, 0, 0, 0),
        4096: (0, 0, 0, 0, 1, 1), 4097: (0, 0, 0, 0, 1, 0), **{p: (0, 0, 1, 0, 0, 0) for p in range(4098, 4102)}}
    assert reads.pile_up(rows)._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    bases = spark.createDataFrame([("r", p, k, k % 2 == 0) for p in (1, 2) for k in range(10)], "region string, pos int, read int, alt boolean")
    scores = contigs.linked_read_scores(bases)
    assert {(r.r1, r.r2): r.score for r in scores.collect()} == {(a, b): 2 * (-4 if (a + b) % 2 else 1 if a % 2 else 3) for a in range(10) for b in range(a + 1, 10)}
    assert contigs.linked_read_scores(bases)._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1


def test_groups_of_reads_need_no_join(spark):
    """links go to their fold in one shuffle besides that of their sums."""
    from strandloom.operators import contigs

    scores = spark.createDataFrame([("r", 1, 2, 6), ("r", 1, 7, 9)], "region string, r1 int, r2 int, score int")
    groups = contigs.group_linked_reads(scores, spark.createDataFrame([("r", 1), ("r", 2), ("r", 3)], "region string, read int"))
    assert {r.read: r.grp for r in groups.collect()} == {1: 0, 2: 0, 3: -1}
    assert "Join" not in groups._jdf.queryExecution().executedPlan().toString()


def test_headers_pass_from_piece_to_piece(spark, tmp_path, monkeypatch):
    """a block of lines is taken in pieces, so that no task has to sort it whole."""
    from strandloom.sources import records, regions

    (tmp_path / "m.wig").write_text("".join(f"fixedStep chrom=c{k} start=5 step=1\n" + "".join(f"{i}\n" for i in range(k % 9)) for k in range(30)))
    monkeypatch.setattr(records, "PIECE", 2)
    assert sorted(map(tuple, regions.read_wigfix(spark, f"{tmp_path}/m.wig").collect())) == sorted((f"c{k}", 4 + i, float(i)) for k in range(30) for i in range(k % 9))


def test_runs_of_contigs_take_one_shuffle_and_one_sort(spark, tmp_path, monkeypatch):
    """a task holds the spans of its contigs once, and large files are dealt to more tasks."""
    from strandloom import tables

    rng = random.Random(33)
    lengths = {f"c{k}": rng.choice([0, 1, 2, 30, 100, 200]) for k in range(60)}
    trf = [(f"c{rng.randrange(66)}", st, st + rng.randrange(-25, 30)) for st in (rng.randrange(-20, 210) for _ in range(140))] + [(None, 1, 9)]
    rm = [(f"c{rng.randrange(66)}", st, st + rng.randrange(-2, 9), rng.choice(["Simple_repeat", "LINE/L1"])) for st in (rng.randrange(-5, 210) for _ in range(140))]
    want = []
    for name, length in lengths.items():
        spans = [(st - 10, ed + 10) for n, st, ed in trf if n == name] + [(st, ed) for n, st, ed, kind in rm if n == name and kind == "Simple_repeat"]
        inside = [any(st <= p <= ed for st, ed in spans) for p in range(length)]
        starts = [p for p in range(length) if not p or inside[p] != inside[p - 1]]
        want += [(name, p, e - 1, inside[p], k) for k, (p, e) in enumerate(zip(starts, [*starts[1:], length]))]
    tracts, repeats, tandem = spark.createDataFrame(list(lengths.items()), "name string, length long"), spark.createDataFrame(rm, "name string, st int, ed int, class string"), spark.createDataFrame(trf, "name string, st int, ed int")
    out = contigs.vntr_runs(tracts, repeats, tandem)
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = contigs.vntr_runs(tracts, repeats, tandem)._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange "), plan.count("Sort ["), plan.count("Join")) == (1, 1, 0)
    tandem.write.parquet(f"{tmp_path}/trf")
    monkeypatch.setattr(tables, "TASK_BYTES", 100)
    assert tables.by_size(spark.read.parquet(f"{tmp_path}/trf"), "name").rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_complex_runs_hold_no_counts(spark):
    """a task sorts the differences of its regions once, and counts none of them by run and comparison."""
    rng = random.Random(34)
    sv = [(rng.choice(["r", "s", "t", None]), rng.choice([0, 1, None]), rng.choice([2, 3]), rng.choice([None, *range(0, 400, 7)])) for _ in range(90)]
    runs = [(r, k, st, st + rng.randrange(60), rng.random() < 0.3) for r in ("r", "s", "u") for k, st in enumerate(range(0, 400, 40))] + [("s", 99, 0, 400, False)]
    want = set()
    for region, run, st, ed, vntr in runs:
        inside = [(a, b) for r, a, b, pos in sv if r == region and pos is not None and st <= pos <= ed]
        if not vntr and len(inside) > len(set(inside)):
            want.add((region, run))
    assert want and len(want) < sum(not x[4] for x in runs)
    tables = spark.createDataFrame(sv, "region string, a int, b int, pos int"), spark.createDataFrame(runs, "region string, run int, st int, ed int, vntr boolean")
    got = contigs.complex_runs(*tables).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    plan = contigs.complex_runs(*tables)._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("HashAggregate("), plan.count("Exchange ")) == (2, 2)
