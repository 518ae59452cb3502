"""Readers by blocks, order statistics by ranges, integer genotypes and lifting, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import cohort, genotype, reads
from strandloom.operators import intervals as ops
from strandloom.operators import order
from strandloom.sources import records, regions


@pytest.fixture
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_fasta_records_across_blocks(spark, tmp_path, small_blocks):
    r = random.Random(1)
    want, text = {}, ""
    for k, n in enumerate([0, 1, 59, 60, 61, 5000, 3, 1200, 0, 20_000]):
        seq = "".join(r.choice("ACGTN") for _ in range(n))
        want[f"r{k}"] = seq
        text += f">r{k} about it\n" + "".join(seq[i : i + 60] + ("\r\n" if k % 2 else "\n") for i in range(0, n, 60))
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "b.fa").write_text("lost\n>other\nAC\n\nGT\n")
    path = [f"{tmp_path}/a.fa", f"{tmp_path}/b.fa"]
    want["other"] = "ACGT"
    for size in (7, 100, 100_000):
        got: dict[str, list] = {}
        for x in records.fasta_chunks(spark, path, size).collect():
            got.setdefault(x.chrom, []).append((x.chunk, x.seq))
        assert {k: "".join(s for _, s in sorted(v)) for k, v in got.items()} == {k: v for k, v in want.items() if v}
        assert all(len(s) == size for v in got.values() for _, s in sorted(v)[:-1])
    assert {x.name: x.length for x in records.sequence_lengths(spark, path).collect()} == {k: len(v) for k, v in want.items() if v}
    blocks = spark.read.text(path[0]).select("_metadata.file_block_start").distinct().count()
    assert blocks > 20  # so records do cross blocks
    assert spark.read.text(path[0]).rdd.getNumPartitions() > 8


def test_wig_and_tandem_repeats_across_blocks(spark, tmp_path, small_blocks):
    r = random.Random(2)
    lines, want = [], []
    for k in range(6):
        start, step = r.randrange(1, 10**6), r.choice([1, 5])
        lines.append(f"fixedStep chrom=c{k} start={start} step={step}" if step > 1 else f"fixedStep chrom=c{k} start={start}")
        for i in range(r.choice([0, 3, 700])):
            lines.append(f"{i % 10 / 10}")
            want.append((f"c{k}", start - 1 + i * step, i % 10 / 10))
    (tmp_path / "m.wig").write_text("\n".join(lines) + "\n\n")
    assert sorted(map(tuple, regions.read_wigfix(spark, f"{tmp_path}/m.wig").collect())) == sorted(want)
    lines, want = [], []
    for k in range(5):
        lines.append(f"@n{k} x")
        for i in range(r.choice([0, 2, 60])):
            st = r.randrange(1, 5000)
            lines.append(f"{st} {st + 50} 2 25.5 2 100 0 90 1 1 1 1 1.9 AC ACAC . .")
            want.append((f"n{k}", st - 1, st + 49))
    (tmp_path / "t.ngs").write_text("\n".join(lines) + "\n")
    assert sorted((x.name, x.st, x.ed) for x in regions.read_trf(spark, f"{tmp_path}/t.ngs").collect()) == sorted(want)


@pytest.mark.parametrize("ranges", [1, 3, 4096])
def test_running_sums_and_quantiles_by_ranges(spark, ranges, monkeypatch):
    monkeypatch.setattr(order.cumulated, "__defaults__", (ranges,))
    r = random.Random(ranges)
    for values in ([r.randrange(-500, 5000) for _ in range(999)], [7], [7, 7, 7, None], [r.choice([1, 10**9]) for _ in range(40)], []):
        df = spark.createDataFrame([(v,) for v in values], "v int")
        real = sorted(v for v in values if v is not None)
        got = order.quantiles(df, "v", a=0.01, b=0.5, c=0.99).first()
        assert got.n == len(real)
        for k, q in (("a", 0.01), ("b", 0.5), ("c", 0.99)):
            if real:
                at = q * (len(real) - 1)
                lo, hi = real[math.floor(at)], real[math.ceil(at)]
                assert got[k] == pytest.approx(lo + (at - math.floor(at)) * (hi - lo))
            else:
                assert got[k] is None
        counts = df.filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        rows = sorted((x.v, x.upto, x.total, x.previous) for x in order.cumulated(counts, "v", "n").collect())
        distinct = sorted(set(real))
        assert rows == [(v, sum(x <= v for x in real), len(real), distinct[k - 1] if k else None) for k, v in enumerate(distinct)]


def test_no_task_takes_all_sizes(spark):
    """Plans without a window or sort over one partition of the whole table."""
    sizes = spark.range(1000).selectExpr("id % 300 + 301 AS isize")
    density = sizes.groupBy("isize").agg(F.count(F.lit(1)).cast("double").alias("d"))
    sv, loci = spark.range(50).selectExpr("id AS pos", "1 AS chrom", "id AS svlen"), spark.range(9).selectExpr("id", "1 AS chrom", "id * 5 AS st", "id * 5 + 4 AS ed", "3 AS unit")
    for df in (reads.isize_histogram(sizes), reads.breakpoint_distribution(density, 150), cohort.locus_range(sv, loci)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any("Window" in b or "Sort" in b for a, b in zip(plan.split("\n")[1:], plan.split("\n")) if "SinglePartition" in a)


def plain_add(a, b):
    gap = abs(a - b)
    return max(a, b) + (int(10 * math.log10(1 + 10 ** (-gap / 10)) + 0.5) if gap < 20 else 0)


def plain_genotype(rows, mode):
    none, names = -10_000, {"germline": "AA AR RR", "somatic": "AA AR RR N S"}[mode].split()
    share = {("alt", "AA"): 0, ("alt", "AR"): -3, ("ref", "AR"): -3, ("ref", "RR"): 0, ("somatic", "S"): -3}
    sums = {}
    for g in names:
        sums[g] = 0
        for read in rows:
            p = none
            for hap in ("alt", "ref", "noise", "somatic")[: 2 if mode == "germline" else 4]:
                p = plain_add(p, read[hap] + share.get((hap, g), none))
            sums[g] += max(p, -80)
    total, best, most = none, 0, none
    for k, g in enumerate(names):
        total = plain_add(total, sums[g])
        if sums[g] > most:
            best, most = k, sums[g]
    other = none
    for k, g in enumerate(names):
        if k != best:
            other = plain_add(other, sums[g] - total)
    return names[best], -other, [sums[g] for g in names]


@pytest.mark.parametrize("mode", ["germline", "somatic"])
def test_integer_genotypes_for_any_partitioning(spark, mode):
    r = random.Random(5)
    rows = [(v, *(-r.choice([0, 1, 3, 10, 30, 70, 200]) for _ in range(4))) for v in range(60) for _ in range(r.randrange(1, 200 if v == 0 else 25))]
    want = {v: plain_genotype([dict(zip(("alt", "ref", "noise", "somatic"), x[1:])) for x in rows if x[0] == v], mode) for v in range(60)}
    schema = "id int, alt int, ref int, noise int, somatic int"
    for parts in (1, 7):
        got = genotype.log_genotype(spark.createDataFrame(rows, schema).repartition(parts), mode).collect()
        assert {x.id: (x.kind, x.score, [x[k] for k in genotype.MODES[mode][1]]) for x in got} == want
    assert len({w[0] for w in want.values()}) >= 3
    lean = genotype.log_genotype(spark.createDataFrame([(1, -3, 0, -9, -9)], schema), mode, priors={"AA": 50}).first()
    assert lean.kind == "AA" and lean.gt == "1/1"


def test_lifting_equals_a_walk(spark):
    r = random.Random(6)
    chains = []
    for k in range(12):
        ops_, last = [("S", r.randrange(1, 9))] if k % 3 else [("H", 4)], ""
        for _ in range(r.randrange(1, 7)):
            op = r.choice([x for x in "=XID" if x != last])
            ops_.append((op, r.randrange(1, 40)))
            last = op
        chains.append((k, r.randrange(3), sum(n for op, n in ops_ if op in "SH=XI"), r.choice("+-"), r.randrange(5), r.randrange(1000), ops_))
    moved: dict = {}
    for k, c, length, strand, to, at, ops_ in chains:
        ref, q, score = at, 0, sum(n for op, n in ops_ if op in "=X")
        for op, n in ops_:
            for _ in range(n):
                if op in "=X":
                    moved.setdefault((c, length - 1 - q if strand == "-" else q), []).append((-score, k, to, ref, strand))
                ref += op in "=XD"
                q += op in "SH=XI"
    df = spark.createDataFrame(chains, "chain int, chrom int, length int, strand string, to_chrom int, to_st int, cigar array<struct<op: string, len: int>>")
    points = [(i, i % 3, i // 3) for i in range(900)]
    got = ops.lift_points(spark.createDataFrame(points, "id int, chrom int, pos int"), df, width=10).collect()
    best = {i: min(moved.get((c, p), [(0, None, None, None, None)])) for i, c, p in points}
    assert {x.id: (x.chain, x.to_chrom, x.to_pos, x.strand) for x in got} == {i: b[1:] for i, b in best.items()}
    spans = [(i, r.randrange(3), s := r.randrange(200), s + r.randrange(60)) for i in range(300)]
    want = {}
    for i, c, st, ed in spans:
        per: dict = {}
        for p in range(st, ed + 1):
            for m, k, to, ref, strand in moved.get((c, p), []):
                per.setdefault((m, k, to, strand), []).append(ref)
        top = min(((-len(v), m, k, to, strand, min(v), max(v)) for (m, k, to, strand), v in per.items()), default=None)
        want[i] = (top[2], top[3], top[5], top[6], top[4], -top[0]) if top else (None,) * 6
    got = ops.lift_spans(spark.createDataFrame(spans, "id int, chrom int, st int, ed int"), df, width=10).collect()
    assert {x.id: (x.chain, x.to_chrom, x.to_st, x.to_ed, x.strand, x.lifted) for x in got} == want
