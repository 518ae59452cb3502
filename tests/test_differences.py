"""Differences between contigs against walks base by base, for random alignments."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.operators import differences as diff


def random_cigar(r, long=False):
    ops, last = [], ""
    for _ in range(r.randrange(1, 9)):
        op = r.choice([x for x in "=XID" if x != last])
        ops.append((op, r.choice([1, 2, 49, 50, 51, 52, 120]) if op == "=" else r.choice([1, 2, 7, 60 if long else 3])))
        last = op
    return ops


def bases(ops):
    """(op, place on the reference, place in the contig) of each base of the alignment."""
    out, ref, query = [], 0, 0
    for op, n in ops:
        for _ in range(n):
            out.append(("M" if op == "=" else op, ref, query))
            ref += op != "I"
            query += op != "D"
    return out


def plain_region(ops, place):
    b = bases(ops)
    at = next((i for i, x in enumerate(b) if x[1] == place), None)
    if at is None:
        return (None,) * 5
    lo, hi, run = 0, len(b) - 1, 0
    for i in range(at - 1, -1, -1):
        run = run + 1 if b[i][0] == "M" else 0
        if run > 50:
            lo = i + run
            break
    run = 0
    for i in range(at + 1, len(b)):
        run = run + 1 if b[i][0] == "M" else 0
        if run > 50:
            hi = i - run
            break
    part = [x[0] for x in b[lo : hi + 1]]
    gaps = sum(x in "ID" and (k == 0 or part[k - 1] != x) for k, x in enumerate(part))
    return b[lo][1], b[hi][1], gaps, part.count("X"), part.count("M")


CIGARS = "region int, contig int, cigar array<struct<op: string, len: int>>"


@pytest.mark.parametrize("parts", [1, 5])
def test_mismatch_regions_equal_a_walk(spark, parts):
    r = random.Random(parts)
    rows = [(g, c, random_cigar(r, c % 2)) for g in range(15) for c in range(4)] + [(99, 0, [("=", 200)]), (99, 1, [("I", 5)]), (99, 2, [("=", 60), ("S", 4), ("=", 60)])]
    points = [(g, c, p) for g, c, ops in rows for p in {r.randrange(0, 320) for _ in range(25)} | {0, 50, 51, 52}]
    want = {(g, c, p): plain_region([x for x in ops if x[0] != "S"], p) for g, c, ops in rows for g2, c2, p in points if (g, c) == (g2, c2)}
    got = diff.mismatch_regions(spark.createDataFrame(rows, CIGARS).repartition(parts), spark.createDataFrame(points, "region int, contig int, r int").repartition(parts)).collect()
    assert {(x.region, x.contig, x.r): (x.lo, x.hi, x.gaps, x.mismatches, x.matches) for x in got} == want and len(got) == len(points)
    for x in got:
        if x.lo is not None:
            total = x.gaps + x.mismatches + x.matches
            assert x.rate == pytest.approx((x.gaps + x.mismatches) / total) and x.many == (x.hi - x.lo > 100 and (x.gaps + x.mismatches) / total > 0.1)


def test_reference_places_equal_a_walk(spark):
    r = random.Random(4)
    rows = [(g, c, random_cigar(r, True)) for g in range(20) for c in range(1, 5)]
    ops = {(g, c): bases(o) for g, c, o in rows}
    sv = [(k, r.randrange(21), r.randrange(6), r.randrange(6), r.randrange(200), r.randrange(200), r.choice(["INS", "DEL"]), r.randrange(1, 50)) for k in range(800)]

    def place(g, c, q):
        if c == 0:
            return q, None
        return next(((x[1], x[0]) for x in ops.get((g, c), []) if x[2] == q and x[0] != "D"), (None, None))

    def event(g, c, q):
        return sum(x[0] == "I" and x[1] == place(g, c, q)[0] for x in ops[g, c])

    want = {}
    for k, g, a, b, pa, pb, kind, n in sv:
        base, at, ins, st = (a, pa, b, pb) if kind == "INS" else (b, pb, a, pa)
        ref, op = place(g, base, at)
        inside = ins != 0 and op == "I"
        want[k] = (st if ins == 0 else ref, inside, event(g, base, at) if inside else 0, place(g, ins, st)[0], place(g, ins, st + n)[0])
    df = spark.createDataFrame(sv, "id int, region int, a_contig int, b_contig int, a_pos int, b_pos int, type string, length int").repartition(4)
    got = diff.reference_places(df, spark.createDataFrame(rows, CIGARS), 0).collect()
    assert {x.id: (x.base_ref, x.base_is_insert, x.event, x.insert_ref, x.insert_ref_end) for x in got} == want


def test_nested_report(spark):
    # contig 2 has 80 bases of its own at 60, in which contig 1 has 30 more; contig 1's own insertion against the reference is 110 bases there
    alignments = spark.createDataFrame([(1, 2, [("=", 60), ("I", 80), ("=", 60)]), (1, 1, [("=", 60), ("I", 110), ("=", 60)])], CIGARS)
    pairs = spark.createDataFrame([(1, 2, 1, [("=", 100), ("I", 30), ("X", 2), ("=", 98)])], "region int, a_contig int, b_contig int, cigar array<struct<op: string, len: int>>")
    sv = spark.createDataFrame([(7, 1, 2, 1, 100, 100, "INS", 30), (8, 1, 2, 1, 10, 10, "INS", 30)], "id int, region int, a_contig int, b_contig int, a_pos int, b_pos int, type string, length int")
    placed = diff.reference_places(sv, alignments, 0)
    own = diff.operations(alignments).filter("op = 'I'").selectExpr("region", "contig", "q AS insert_st", "q + len AS insert_ed", "r AS ref")
    (x,) = diff.nested_report(placed, pairs, alignments, own).collect()
    assert (x.id, x.base_ref, x.event, x.outer_ref, x.insert_ref) == (7, 60, 80, 60, 60)
    assert tuple(x.in_pair[:2]) == plain_region([("=", 100), ("I", 30), ("X", 2), ("=", 98)], 100)[:2]
    assert tuple(x.in_base[:2]) == plain_region([("=", 60), ("I", 80), ("=", 60)], 60)[:2] and x.many is False
    none = diff.nested_report(placed, pairs, alignments, own.filter("contig = 9")).first()
    assert none.outer_ref == -1 and none.in_pair is None


def test_as_of_and_flipped(spark):
    r = random.Random(8)
    left, right = [(i, r.randrange(3), r.randrange(40)) for i in range(60)], [(r.randrange(3), r.randrange(40), k) for k in range(30)]
    got = diff.as_of(spark.createDataFrame(left, "id int, k int, p int"), spark.createDataFrame(right, "k int, p int, n int"), ["k"], "p", ("n",)).collect()
    for x in got:
        before = [(p, n) for k, p, n in right if k == x.k and p <= x.p]
        assert (tuple(x.found) if x.found else None) == (max(before) if before else None)
    assert [tuple(o) for o in spark.createDataFrame([(1, 1, [("=", 3), ("I", 2), ("D", 1)])], CIGARS).select(diff.flipped("cigar").alias("c")).first().c] == [("=", 3), ("D", 2), ("I", 1)]


def plain_vntr(runs, p):
    """Whether p is in a VNTR, its number among its kind, and outside the distance and span of the nearest VNTR."""
    own = next(((st, ed, v) for st, ed, v in runs if p is not None and st <= p <= ed), None)
    if own is None:
        return False, None, None, None
    number = [x for x in runs if x[2] == own[2]].index(own)
    if own[2]:
        return True, number, None, None
    near = min(((min(abs(p - st), abs(p - ed)), k, (st, ed)) for k, (st, ed, v) in enumerate(runs) if v), default=(None, None, None))
    return False, number, near[0], near[2]


def test_classes_from_tables_equal_plain_rules(spark):
    r = random.Random(21)
    letters = lambda n, kinds="ACGT": "".join(r.choice(kinds) for _ in range(n))
    motif = letters(11)
    runs, seqs, trf, rm, rows = [], {}, [], [], []
    for g in range(12):
        at, vntr = 0, bool(g % 2)
        for _ in range(5):
            n = r.randrange(5, 90)
            runs.append((g, at, at + n - 1, vntr))
            at, vntr = at + n, not vntr
        seqs[g, 0] = (motif * 60)[:500] if g % 3 else letters(500)
        for c in range(1, 4):
            seqs[g, c] = (motif * 60)[: r.randrange(400, 600)] if r.random() < 0.5 else letters(500)
            for _ in range(6):
                st = r.randrange(380)
                trf.append((g, c, st, st + r.randrange(1, 200), r.choice([2, 5, 50, 70]), r.choice([1.9, 2.5, 3.0])))
                st = r.randrange(380)
                rm.append((g, c, st, st + r.randrange(1, 120), r.choice(["Simple_repeat", "LINE/L1", "SINE/Alu", "other"])))
    for k in range(1500):
        st = r.randrange(350)
        rows.append((k, r.randrange(12), r.randrange(1, 4), st, n := r.choice([5, 20, 60, 150, 400]), st + n, None if k % 40 == 0 else r.randrange(420)))

    def masked(g, c, lo, hi):
        mask = [0] * (hi - lo)
        mine = lambda t: [(max(0, x[2] - lo), min(hi - lo, x[3] - lo), *x[4:]) for x in t if x[:2] == (g, c) and x[2] < hi and lo < x[3]]
        short = [(x[2] - lo, x[3] - lo) for x in trf if x[:2] == (g, c) and x[4] < 6 and x[2] < hi and lo < x[3]]
        for st, ed, *_ in mine(trf) + [x for x in mine(rm) if x[2] == "Simple_repeat"]:
            mask[st:ed] = [1] * (ed - st)
        for x in rm:
            if x[:2] == (g, c) and x[4] in ("LINE/L1", "SINE/Alu") and x[2] < hi and lo < x[3]:
                st, ed = x[2] - lo, x[3] - lo
                if sum(max(0, min(ed, b) - max(st, a)) for a, b in short) < 0.8 * (ed - st):
                    a, b = max(0, st), min(hi - lo, ed)
                    mask[a:b] = [0] * (b - a)
        return sum(mask)

    want, reasons = {}, set()
    for k, g, c, st, n, ed, base in rows:
        inside, number, far, near = plain_vntr([x[1:] for x in runs if x[0] == g], base)
        free = n - masked(g, c, st, ed)
        new = free > 200 or free > 0.2 * n
        kind = {(True, False): 1, (True, True): 2, (False, False): 3, (False, True): 4}[inside, new]
        if kind == 3 and near and 0 < far < 30:
            a, b = seqs[g, c][st : st + n], seqs[g, 0][near[0] : near[1] + 1]
            other = {b[i : i + 10] for i in range(len(b) - 9)}
            if sum(a[i : i + 10] in other for i in range(len(a) - 9)) >= 5:
                kind = 1
                reasons.add("near")
        if kind == 3 and any(x[:2] == (g, c) and x[2] - 10 <= st and x[3] + 10 >= ed and x[4] >= 50 and x[5] <= 2.5 for x in trf):
            kind = 4
            reasons.add("doubled")
        want[k] = (inside, number, far, kind)
    placed = spark.createDataFrame(rows, "id int, region int, insert_contig int, insert_st int, length int, insert_ed int, base_ref long").repartition(3)
    tables = [
        spark.createDataFrame(runs, "region int, st int, ed int, vntr boolean"), spark.createDataFrame(rm, "region int, contig int, st int, ed int, class string"),
        spark.createDataFrame(trf, "region int, contig int, st int, ed int, unit int, copies double"), spark.createDataFrame([(*k, s) for k, s in seqs.items()], "region int, contig int, seq string"),
    ]
    got = diff.classified(placed, *tables, reference=0).collect()
    assert {x.id: (x.in_vntr, x.run, x.vntr_distance, x["class"]) for x in got} == want
    assert reasons == {"near", "doubled"} and {x[3] for x in want.values()} == {1, 2, 3, 4}


def test_offsets_of_long_alignments(spark):
    r = random.Random(2)
    for n in (0, 1, 255, 256, 257, 1000):
        ops = [(r.choice("=XIDSN"), r.randrange(1, 9)) for _ in range(n)]
        got = spark.createDataFrame([(5, ops)], "pos int, cigar array<struct<op: string, len: int>>").select(cg.with_offsets("cigar", "pos").alias("o")).first().o
        ref, query, want = 5, 0, []
        for op, k in ops:
            want.append((op, k, ref, query))
            ref += k * (op in "=XDN")
            query += k * (op in "=XIS")
        assert [tuple(x) for x in got] == want
    many = spark.range(20).select(F.lit(0).alias("pos"), F.transform(F.sequence(F.lit(1), F.lit(50_000)), lambda k: F.struct(F.when(k % 2 == 0, "I").otherwise("=").alias("op"), (k % 7 + 1).cast("int").alias("len"))).alias("cigar"))
    assert many.select(F.explode(cg.with_offsets("cigar", "pos"))).count() == 1_000_000
