"""Local contigs of a region compared with each other: runs of tandem repeat, differences from CIGARs, clusters.

Alignments between contigs (their CIGARs) are input columns.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from strandloom.functions import cigar as cg
from strandloom.functions.sequence import collapsed_length, is_mobile, is_simple
from strandloom.operators.folds import stream
from strandloom.operators.intervals import gap_clusters
from strandloom.tables import by_size, drop, kept


def attach_annotations(contigs: DataFrame, annotation: DataFrame) -> DataFrame:
    """Annotation rows of known contigs, by name."""
    return annotation.join(contigs.select("name", "region", "length"), "name")


def vntr_runs(contigs: DataFrame, rm: DataFrame, trf: DataFrame, edge: int = 10) -> DataFrame:
    """Alternating runs `(name, st, ed, vntr, run)` of each contig, closed and in order: tandem repeats (longer by `edge`
    on both sides) and simple repeats are VNTR, the rest isn't. Intervals only, no row per base.

    One shuffle and one sort: a contig goes before its repeats as one that ends before its first base, so each island of
    repeats has the other bases behind it, and the windows of a contig all go over the same order.
    """
    spans = trf.select("name", (F.col("st") - edge).alias("st"), (F.col("ed") + edge).alias("ed")).unionByName(rm.filter(is_simple("class")).select("name", "st", "ed"))
    spans = spans.select("name", F.greatest(F.lit(0), "st").alias("st"), "ed").withColumn("length", F.lit(None).cast(contigs.schema["length"].dataType)).withColumn("_known", F.lit(False))
    first = contigs.select("name", F.lit(-1).alias("st"), F.lit(-1).alias("ed"), "length").withColumn("_known", F.lit(True))
    by = Window.partitionBy("name").orderBy("st")
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = by_size(spans.filter("name is not null").unionByName(first), "name")
    rows = rows.withColumn("_last", F.first("length").over(by) - 1).withColumn("_of", F.first("_known").over(by)).filter("_of")
    rows = rows.withColumn("ed", F.when(F.col("_known"), F.col("ed")).otherwise(F.least("_last", "ed"))).filter("st <= ed")
    rows = rows.withColumn("_far", F.max("ed").over(before)).withColumn("_most", F.max("ed").over(whole))
    heads = rows.filter("_far is null or st - _far > 1")
    heads = heads.select("name", "st", F.coalesce(F.lead("_far").over(by), "_most").alias("ed"), F.coalesce(F.lead("st").over(by) - 1, "_last").alias("_next"), (2 * F.row_number().over(by) - 2).alias("_run"))
    kind = heads.select(F.coalesce("_next", "ed", "st").alias("x")).schema["x"].dataType
    run = F.col("_run") - (F.first("ed").over(by) < 0).cast("int")  # without bases a contig's first island is no run
    heads = heads.withColumn("_run", run)
    parts = [(F.greatest(F.lit(0), "st"), F.col("ed"), True, F.col("_run")), (F.col("ed") + 1, F.col("_next"), False, F.col("_run") + 1)]
    runs = F.explode(F.array(*(F.struct(st.cast(kind).alias("st"), ed.cast(kind).alias("ed"), F.lit(vntr).alias("vntr"), k.alias("run")) for st, ed, vntr, k in parts)))
    return heads.select("name", runs.alias("_x")).select("name", "_x.*").filter("st <= ed")


def contig_variants(pairs: DataFrame, least: int = 50) -> DataFrame:
    """Insertions and deletions of at least `least` bases of alignments `(region, a_contig, b_contig, cigar)`, never the
    first or last operation: place in both contigs, type, length."""
    rows = pairs.withColumn("_last", F.size("cigar") - 1).withColumn("_zero", F.lit(0))
    ops = cg.exploded(rows, "cigar", "_zero").filter(F.col("op").isin("I", "D") & (F.col("len") >= least) & (F.col("k") > 0) & (F.col("k") < F.col("_last")))
    return ops.select("region", "a_contig", "b_contig", F.col("ref").alias("a_pos"), F.col("query").alias("b_pos"), F.when(F.col("op") == "I", "INS").otherwise("DEL").alias("type"), F.col("len").alias("length"))


def with_insert_strings(sv: DataFrame, sequences: DataFrame) -> DataFrame:
    """Differences with `insert_seq`, the inserted bases, and `base_seq`, the other contig's base at its place (empty behind its
    end). sequences: region, contig, seq."""
    ins = F.col("type") == "INS"
    a, b = (sequences.select("region", F.col("contig").alias(f"{k}_contig"), F.col("seq").alias(f"_{k}")) for k in "ab")
    rows = sv.join(a, ["region", "a_contig"], "left").join(b, ["region", "b_contig"], "left")
    taken = F.when(ins, F.substring("_b", F.col("b_pos") + 1, F.col("length"))).otherwise(F.substring("_a", F.col("a_pos") + 1, F.col("length")))
    base = F.when(ins, F.substring("_a", F.col("a_pos") + 1, F.lit(1))).otherwise(F.substring("_b", F.col("b_pos") + 1, F.lit(1)))
    return rows.select(*sv.columns, taken.alias("insert_seq"), base.alias("base_seq"))


def insert_vntr_length(inserts: DataFrame, rm: DataFrame, trf: DataFrame) -> DataFrame:
    """Bases of each insert (name, length) under tandem or simple repeats but not under mobile elements, and the longest run
    of other bases; a mobile element stays masked where small-unit repeats (motif_size < 6) cover 80 % of it, overlaps
    counted as often as they occur. Spans are half-open."""
    mobile = rm.filter(is_mobile("class") & ~is_simple("class")).withColumn("m", F.monotonically_increasing_id()).select("name", "m", F.col("st").alias("mst"), F.col("ed").alias("med"))
    t = trf.filter("motif_size < 6").select("name", F.col("st").alias("t_st"), F.col("ed").alias("t_ed"))
    cover = mobile.join(t, "name", "left").groupBy("name", "m", "mst", "med").agg(F.coalesce(F.sum(F.when(F.col("t_st").isNotNull(), F.greatest(F.lit(0), F.least("med", "t_ed") - F.greatest("mst", "t_st")))), F.lit(0)).alias("c"))
    unmask = cover.filter(F.col("c") < 0.8 * (F.col("med") - F.col("mst"))).select("name", F.col("mst").alias("st"), F.col("med").alias("ed"), F.lit(0).alias("m"), F.lit(1).alias("u"))
    spans = trf.select("name", "st", "ed").unionByName(rm.filter(is_simple("class")).select("name", "st", "ed")).withColumn("m", F.lit(1)).withColumn("u", F.lit(0))
    whole = inserts.select("name", F.lit(0).alias("st"), F.col("length").alias("ed"), F.lit(0).alias("m"), F.lit(0).alias("u"))
    clipped = spans.unionByName(unmask).join(inserts.select("name", "length"), "name").select("name", F.greatest(F.lit(0), "st").alias("st"), F.least("length", "ed").alias("ed"), "m", "u").filter("st < ed").unionByName(whole)
    ends = F.explode(F.array(F.struct(F.col("st").alias("p"), "m", "u"), F.struct(F.col("ed").alias("p"), (-F.col("m")).alias("m"), (-F.col("u")).alias("u")))).alias("e")
    at = clipped.select("name", ends).groupBy("name", F.col("e.p").alias("p")).agg(F.sum("e.m").alias("m"), F.sum("e.u").alias("u"))
    by = Window.partitionBy("name").orderBy("p")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    steps = at.select("name", (F.lead("p").over(by) - F.col("p")).alias("size"), ((F.sum("m").over(upto) > 0) & (F.sum("u").over(upto) == 0)).alias("masked"), "p").filter("size is not null")
    runs = steps.withColumn("run", F.sum(F.col("masked").cast("long")).over(upto)).groupBy("name", "run").agg(F.sum(F.when(F.col("masked"), F.col("size")).otherwise(0)).alias("vntr"), F.sum(F.when(F.col("masked"), 0).otherwise(F.col("size"))).alias("free"))
    out = runs.groupBy("name").agg(F.sum("vntr").alias("vntr"), F.max("free").alias("longest_free"))
    return inserts.select("name", "length").join(out, "name", "left").fillna(0, ["vntr", "longest_free"])


def leaders(contigs: DataFrame, differences: DataFrame) -> DataFrame:
    """`(region, contig, ord, number)`: contigs that differ from all leaders before them, numbered from 0 in their region.

    In rounds over all regions: an open contig that differs from every open one before it is a leader, for no leader was
    missing among those that are settled; a later one that doesn't differ from a new leader is none. So the first open contig
    of each region is settled in each round, and all that hang on none other. Rows: one for each contig and difference; a
    contig counts its differences, and no pair without one is made.
    """
    place = Window.partitionBy("region").orderBy("ord", "contig")
    pairs = differences.select("region", F.col("a_contig").alias("x"), F.col("b_contig").alias("y")).filter("x <> y")
    pairs = pairs.unionByName(pairs.select("region", F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    order = kept(contigs.select("region", "contig", "ord").withColumn("n", F.row_number().over(place)))
    first, second = (order.select("region", F.col("contig").alias(c), F.col("n").alias(n)) for c, n in (("x", "nx"), ("y", "ny")))
    pairs = kept(pairs.join(first, ["region", "x"]).join(second, ["region", "y"]).filter("nx < ny").select("region", "nx", "ny"))
    open_, found = order.select("region", "n"), None
    while not open_.isEmpty():
        rank = open_.withColumn("before", F.row_number().over(Window.partitionBy("region").orderBy("n")) - 1)
        met = pairs.groupBy("region", F.col("ny").alias("n")).agg(F.count(F.lit(1)).alias("differ"))
        new = kept(rank.join(met, ["region", "n"], "left").filter(F.coalesce("differ", F.lit(0)) == F.col("before")).select("region", "n"))
        found = new if found is None else found.unionByName(new)
        rest = open_.join(new, ["region", "n"], "left_anti").withColumn("is", F.lit(0)).unionByName(new.withColumn("is", F.lit(1)))
        passed = rest.withColumn("leaders", F.sum("is").over(Window.partitionBy("region").orderBy("n"))).filter("is = 0")
        apart = pairs.join(new.select("region", F.col("n").alias("nx")), ["region", "nx"], "left_semi").groupBy("region", F.col("ny").alias("n")).agg(F.count(F.lit(1)).alias("apart"))
        open_ = kept(passed.join(apart, ["region", "n"], "left").filter(F.coalesce("apart", F.lit(0)) == F.col("leaders")).select("region", "n"))
        old = pairs
        for side in ("nx", "ny"):
            pairs = pairs.join(open_.select("region", F.col("n").alias(side)), ["region", side], "left_semi")
        pairs = kept(pairs)
        drop(old)
    found = order.join(order.select("region", "n").limit(0) if found is None else found, ["region", "n"], "left_semi")
    return found.select("region", "contig", "ord", (F.row_number().over(place) - 1).alias("number"))


class _Sizes:
    """Rows (region, contig, ord, number, differ) of a region in order: the cluster of each, by the sizes so far."""

    def __init__(self) -> None:
        self.size: list[int] = []

    def take(self, row: tuple) -> Iterable[tuple]:
        region, contig, _, number, differ = row
        if number is not None:
            self.size.append(0)
        else:
            apart = set(differ or ())
            number = min((k for k in range(len(self.size)) if k not in apart), key=lambda k: (k != 0, -self.size[k], k))
        self.size[number] += 1
        return ((region, contig, number),)

    def end(self) -> Iterable[tuple]:
        return ()


def cluster_contigs(contigs: DataFrame, differences: DataFrame) -> DataFrame:
    """Greedy clusters of each region's contigs (region, contig, ord), in order; the reference comes first.

    differences: region, a_contig, b_contig of pairs with a difference outside VNTR, or that failed to align. A contig joins
    the first cluster whose leader it doesn't differ from: cluster 0, then by size, then by number; else it opens one. Who
    leads doesn't hang on sizes, so `leaders` finds them in rounds; sizes are then counted in one pass in order, which holds a
    region's sizes and no rows.
    """
    lead = kept(leaders(contigs, differences))
    pairs = differences.select("region", F.col("a_contig").alias("contig"), F.col("b_contig").alias("other"))
    pairs = pairs.unionByName(pairs.select("region", F.col("other").alias("contig"), F.col("contig").alias("other")))
    met = pairs.join(lead.select("region", F.col("contig").alias("other"), "number"), ["region", "other"]).groupBy("region", "contig").agg(F.collect_set("number").alias("differ"))
    rows = contigs.select("region", "contig", "ord").join(lead.select("region", "contig", "number"), ["region", "contig"], "left").join(met, ["region", "contig"], "left")
    kinds = rows.schema
    schema = StructType([kinds["region"], kinds["contig"], StructField("cluster", IntegerType())])
    return stream(rows.select("region", "contig", "ord", "number", "differ"), ["region"], ["ord", "contig"], _Sizes, schema)


def subregion_clusters(clusters: DataFrame, sv: DataFrame, runs: DataFrame) -> DataFrame:
    """Clusters that differ within each run of the reference. clusters: region, cluster; sv: region, a, b (clusters), pos,
    class; runs: region, run, st, ed, vntr.

    In a run outside VNTR a cluster merges into the first earlier one from which no difference inside the run separates
    it, other than of class 1; in VNTR every cluster stays by itself. Counts of the classes come along: all but 1 only
    outside VNTR and from comparisons up to the one that merges. `places` are those of class 3 of the clusters that stay, `only_purple` the
    number of these without a difference of class 4.
    """
    inside = sv.join(runs, "region").filter((F.col("st") <= F.col("pos")) & (F.col("pos") <= F.col("ed"))).select("region", "run", "vntr", F.greatest("a", "b").alias("cluster"), F.least("a", "b").alias("other"), "pos", "class")
    apart = F.col("class") != 1
    order = Window.partitionBy("region").orderBy("cluster")
    ranked = clusters.select("region", "cluster").distinct().withColumn("rank", F.row_number().over(order) - 1)
    every = ranked.join(runs.select("region", "run", "vntr"), "region")
    # pairs that differ, by rank of the earlier cluster; the first rank that is missing is the one that it merges into
    pairs = inside.filter(apart & ~F.col("vntr")).join(ranked.select("region", F.col("cluster").alias("other"), F.col("rank").alias("t")), ["region", "other"])
    met = pairs.groupBy("region", "run", "cluster").agg(F.sort_array(F.collect_set("t")).alias("ts"), F.sort_array(F.collect_list(F.struct("t", "class", "pos"))).alias("all"))
    rows = every.join(met, ["region", "run", "cluster"], "left").withColumn("ts", F.coalesce("ts", F.array().cast("array<int>")))
    gap = F.array_min(F.filter(F.transform(F.sequence(F.lit(0), F.size("ts")), lambda i: F.when(F.coalesce(F.get(F.col("ts"), i), F.lit(-1)) != i, i)), lambda i: i.isNotNull()))
    rows = rows.withColumn("to", gap).withColumn("new", F.col("vntr") | (F.col("to") >= F.col("rank")))
    compared = F.filter(F.coalesce("all", F.array().cast(met.schema["all"].dataType)), lambda x: x["t"] < F.col("to"))
    rows = rows.withColumn("seen", F.when(F.col("vntr"), F.array().cast(met.schema["all"].dataType)).otherwise(compared))
    of = lambda k: F.size(F.filter("seen", lambda x: x["class"] == k))
    stays = F.col("new") & ~F.col("vntr")
    places = F.when(stays, F.transform(F.filter("seen", lambda x: x["class"] == 3), lambda x: x["pos"])).otherwise(F.array().cast("array<int>"))
    got = rows.groupBy("region", "run").agg(F.count_if("new").alias("n_clusters"), F.count_if(stays & (of(4) == 0)).alias("only_purple"), *(F.sum(of(k)).alias(f"class_{k}") for k in (0, 2, 3, 4)), F.sort_array(F.flatten(F.collect_list(places))).alias("places"))
    counts = inside.filter(~apart).groupBy("region", "run").agg(F.count(F.lit(1)).alias("class_1"))
    out = runs.select("region", "run", "st", "ed", "vntr").join(got, ["region", "run"]).join(counts, ["region", "run"], "left")
    return out.fillna(0, ["class_1"])


def complex_runs(sv: DataFrame, runs: DataFrame) -> DataFrame:
    """Comparisons (a, b) with two or more differences, outside VNTR, in one non-VNTR run (a run is one interval).

    Two differences of a comparison lie in a run if one and the next do: windows over sorted differences, no counts to hold.
    """
    by = Window.partitionBy("region", "a", "b").orderBy("pos")
    places = by_size(sv.select("region", "a", "b", "pos").filter("region is not null and pos is not null"), "region")
    pairs = places.select("region", F.col("pos").alias("_pos"), F.lead("pos").over(by).alias("_next")).filter("_next is not null")
    plain = by_size(runs.filter("not vntr").select("region", "run", "st", "ed"), "region", of=sv)
    both = plain.join(pairs.hint("merge"), (plain["region"] == pairs["region"]) & (F.col("st") <= F.col("_pos")) & (F.col("_next") <= F.col("ed")), "left_semi")
    return both.select("region", "run").distinct()


def colours(row: DataFrame) -> DataFrame:
    """Colour label of a sub-region: in VNTR by its counts of classes 1 and 2, elsewhere by those of classes 3 and 4."""
    one, two, three, four = (F.coalesce(F.col(f"class_{k}"), F.lit(0)) > 0 for k in range(1, 5))
    inside = F.when(two, "green").when(one, "yellow")
    outside = F.when(three & four, "red").when(three, "purple").when(four, "blue")
    return row.withColumn("colour", F.coalesce(F.when(F.col("vntr"), inside).otherwise(outside), F.lit("black")))


def alignment_summary(pairs: DataFrame, gap: int = 50) -> DataFrame:
    """Aligned lengths, matched bases and long gaps of each alignment; right if both contigs are spanned."""
    gaps = F.size(F.filter("cigar", lambda x: x["op"].isin("I", "D") & (x["len"] >= gap)))
    out = pairs.withColumn("a_aligned", cg.reference_length("cigar")).withColumn("b_aligned", cg.total("cigar", ["M", "I", "=", "X"])).withColumn("matched", cg.total("cigar", ["M", "="])).withColumn("gaps", gaps)
    return out.withColumn("right", (F.col("a_aligned") == F.col("a_length")) & (F.col("b_aligned") == F.col("b_length")))


def apply_variants(regions: DataFrame, variants: DataFrame) -> DataFrame:
    """The haplotype of each region `(id, st, seq)` with its variants `(id, pos, ref, alt)` put in, by place.

    A variant whose REF differs from the sequence, or that overlaps the one before it, is left out and moves nothing.
    """
    v = variants.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "ref", "alt"))).alias("v"))
    rows = regions.join(v, "id", "left").withColumn("v", F.coalesce("v", F.array().cast(v.schema["v"].dataType)))

    def step(acc, x):
        at = x["pos"] - F.col("st")
        fits = (at >= acc["at"]) & (F.substring(F.col("seq"), (at + 1).cast("int"), F.length(x["ref"])) == x["ref"])
        text = F.concat(acc["text"], F.substring(F.col("seq"), (acc["at"] + 1).cast("int"), (at - acc["at"]).cast("int")), x["alt"])
        grows = F.length(x["alt"]) > F.length(x["ref"])
        shrinks = F.length(x["alt"]) < F.length(x["ref"])
        return F.when(fits, F.struct(text.alias("text"), (at + F.length(x["ref"])).cast("long").alias("at"), (acc["ins"] + F.when(grows, 1).otherwise(0)).alias("ins"), (acc["dels"] + F.when(shrinks, 1).otherwise(0)).alias("dels"))).otherwise(acc)

    zero = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("ins"), F.lit(0).alias("dels"))
    done = rows.withColumn("_d", F.aggregate("v", zero, step))
    return done.select("id", F.concat("_d.text", F.substring("seq", (F.col("_d.at") + 1).cast("int"), F.length("seq"))).alias("haplotype"), F.col("_d.ins").alias("insertions"), F.col("_d.dels").alias("deletions"))


def choose_contigs(contigs: DataFrame, near: int = 10, least: int = 3) -> DataFrame:
    """At most two contigs of each region by support: the best of each group of like collapsed lengths, and any with at
    least `least` reads."""
    rows = contigs.withColumn("_n", collapsed_length("seq"))
    by = Window.partitionBy("region").orderBy(F.desc("_n"), "contig")
    rows = rows.withColumn("_g", F.sum(F.when(F.lag("_n").over(by) - F.col("_n") < near, 0).otherwise(1)).over(by))
    best = rows.withColumn("_k", F.row_number().over(Window.partitionBy("region", "_g").orderBy(F.desc("support"), "contig")))
    kept = best.filter((F.col("_k") == 1) | (F.col("support") >= least))
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("support"), "contig"))).filter("_r <= 2").drop("_n", "_g", "_k", "_r")


def replacement_pairs(sv: DataFrame) -> DataFrame:
    """Each difference of an alignment with the nearer neighbour of the other type: distance of ends and length ratio."""
    by = Window.partitionBy("region", "a_contig", "b_contig").orderBy("a_pos", "length")
    end = F.col("a_pos") + F.when(F.col("type") == "DEL", F.col("length")).otherwise(0)
    row = F.struct("type", "length", F.col("a_pos").alias("st"), end.alias("ed"))
    rows = sv.withColumn("_ed", end).withColumn("_p", F.lag(row).over(by)).withColumn("_n", F.lead(row).over(by))

    def apart(o: str):
        d = F.least(*(F.abs(x - y) for x in (F.col("a_pos"), F.col("_ed")) for y in (F.col(f"{o}.st"), F.col(f"{o}.ed"))))
        return F.when(F.col(f"{o}.type") != F.col("type"), F.struct(d.alias("distance"), (F.abs(F.col("length") - F.col(f"{o}.length")) / F.least("length", f"{o}.length")).alias("ratio")))

    return rows.withColumn("_b", F.least(apart("_p"), apart("_n"))).select(*sv.columns, "_b.distance", "_b.ratio")


def cluster_report(clusters: DataFrame, annotation: DataFrame) -> DataFrame:
    """Per region and cluster the contigs, their number, and the annotation classes found on them."""
    kinds = annotation.groupBy("region", "contig").agg(F.collect_set("class").alias("kinds"))
    per = clusters.join(kinds, ["region", "contig"], "left").groupBy("region", "cluster")
    return per.agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("contig")).alias("contigs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("kinds", F.array().cast("array<string>")))))).alias("classes"))


def corrected_colours(rows: DataFrame, clusters: DataFrame, gap: int = 20) -> DataFrame:
    """Cluster counts of sub-regions (region, run, size, only_purple) less the purple differences that fall together:
    their places (region, run, pos) are clustered by gaps, and what exceeds the number of clusters is taken off. A
    sub-region without places keeps its size. The row of a whole region (`run` 0, its first) drops out if it has others."""
    n = gap_clusters(clusters, gap, ("region", "run")).groupBy("region", "run").agg(F.count(F.lit(1)).alias("_n"))
    several = rows.groupBy("region").agg(F.count(F.lit(1)).alias("_rows"))
    out = rows.join(several, "region").filter("run <> 0 or _rows = 1").join(n, ["region", "run"], "left")
    return out.withColumn("corrected", F.col("size") - F.coalesce(F.greatest(F.lit(0), F.col("only_purple") - F.col("_n")), F.lit(0))).drop("_n", "_rows")


def linked_read_scores(bases: DataFrame, least: int = 5) -> DataFrame:
    """Scores of read pairs by the SNPs (region, pos, read, alt boolean) that they share: 3 for each alternative in common,
    -4 for each difference, 1 for each reference base in common. SNPs need `least` reads of either kind."""
    # dealt by region once: the reads of a place, its pairs and their sums then stay where they are
    per = bases.select("region", "pos", "read", "alt").filter("pos is not null").repartition("region").groupBy("region", "pos")
    good = per.agg(F.count_if("alt").alias("a"), F.count_if(~F.col("alt")).alias("r"), F.sort_array(F.collect_list(F.struct("read", "alt"))).alias("all")).filter((F.col("a") >= least) & (F.col("r") >= least))
    first = good.filter("region is not null").select("region", "all", F.posexplode("all").alias("i", "x"))
    pairs = first.select("region", "x", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("y")).filter("x.read < y.read")
    score = F.when(F.col("x.alt") != F.col("y.alt"), -4).when(F.col("x.alt"), 3).otherwise(1)
    return pairs.groupBy("region", F.col("x.read").alias("r1"), F.col("y.read").alias("r2")).agg(F.sum(score).alias("score"))


class _Groups:
    """Rows (region, read, links) of a region in order, links being (earlier read, score), or null for the read itself: each
    read's group."""

    def __init__(self) -> None:
        self.group: dict = {}
        self.groups = 0
        self.read, self.links, self.known = None, [], False

    def take(self, row: tuple) -> Iterable[tuple]:
        region, read, links = row
        out = self.end() if self.read is not None and read != self.read[1] else ()
        self.read = region, read
        if links is None:
            self.known = True
        else:
            self.links += links
        return out

    def end(self) -> Iterable[tuple]:
        links, known, self.links, self.known = self.links, self.known, [], False
        if not known:
            return ()
        score: dict[int, int] = {}
        for link in links:
            g = self.group.get(link["first"], -1)
            score[g] = score.get(g, 0) + link["score"]
        score.pop(-1, None)
        best = max(score.items(), key=lambda x: (x[1], -x[0]), default=(-1, 0))
        if best[1] > 0:
            mine = best[0]
        elif not self.group or any(s < 0 for s in score.values()):
            mine = self.groups
            self.groups += 1
        else:
            mine = -1
        self.group[self.read[1]] = mine
        return ((*self.read, mine),)


def group_linked_reads(scores: DataFrame, reads: DataFrame) -> DataFrame:
    """Greedy groups of a region's reads, in order: a read joins the group with the best positive score (the first of equals);
    without one it opens a group if some score is negative or it is the region's first, else it stays without (-1).

    One pass in order; a task holds the group of each earlier read of the region, and the links of one read.
    """
    pairs = scores.select("region", F.least("r1", "r2").alias("first"), F.greatest("r1", "r2").alias("read"), "score")
    links = pairs.groupBy("region", "read").agg(F.collect_list(F.struct("first", "score")).alias("links"))
    own = reads.select("region", "read").distinct().withColumn("links", F.lit(None).cast(links.schema["links"].dataType))
    rows = own.unionByName(links)
    schema = StructType([own.schema["region"], own.schema["read"], StructField("grp", IntegerType())])
    return stream(rows, ["region"], ["read"], _Groups, schema)


def linked_group_scores(groups: DataFrame, scores: DataFrame, low: int = 40) -> DataFrame:
    """For each group its reads, the sum of its members' scores with each other, and how many members have less than `low`."""
    grouped = groups.filter("grp >= 0").select("region", "read", "grp")
    ends = [grouped.select("region", F.col("read").alias(r), F.col("grp").alias(g)) for r, g in (("r1", "g1"), ("r2", "g2"))]
    inside = scores.join(ends[0], ["region", "r1"]).join(ends[1], ["region", "r2"]).filter("g1 = g2")
    each = inside.select("region", F.explode(F.array("r1", "r2")).alias("read"), "score").groupBy("region", "read").agg(F.sum("score").alias("score"))
    members = grouped.join(each, ["region", "read"], "left").withColumn("score", F.coalesce("score", F.lit(0)))
    return members.groupBy("region", "grp").agg(F.count(F.lit(1)).alias("reads"), F.sum("score").alias("score"), F.count_if(F.col("score") < low).alias("low"))


def rejected_reads(groups: DataFrame, support: DataFrame) -> DataFrame:
    """`support` (region, read, target, supporter: reads that back the same target) by read and target with the supporters in
    the read's group and elsewhere, and `rejected` where most are elsewhere. Reads without group count as one group."""
    mine = groups.select("region", "read", F.col("grp").alias("mine"))
    theirs = groups.select("region", F.col("read").alias("supporter"), F.col("grp").alias("theirs"))
    both = support.join(mine, ["region", "read"]).join(theirs, ["region", "supporter"])
    per = both.groupBy("region", "target", "read").agg(F.count_if(F.col("mine") == F.col("theirs")).alias("same"), F.count_if(F.col("mine") != F.col("theirs")).alias("other"))
    return per.withColumn("rejected", F.col("same") < F.col("other"))


def rejected_backers(groups: DataFrame, backs: DataFrame) -> DataFrame:
    """`rejected_reads` for all pairs of reads that back the same target, from backs: region, read, target. Pairs aren't made:
    the reads of each group are counted by target. Both tables are dealt by region once."""
    mine = groups.select("region", "read", F.lit(None).cast(backs.schema["target"].dataType).alias("target"), "grp", F.lit(True).alias("_known"))
    theirs = backs.select("region", "read", "target", F.lit(None).cast(groups.schema["grp"].dataType).alias("grp"), F.lit(False).alias("_known")).filter("target is not null")
    rows = mine.unionByName(theirs).filter("region is not null and read is not null").repartition("region").distinct()
    read = Window.partitionBy("region", "read")
    rows = rows.withColumn("grp", F.max("grp").over(read)).withColumn("_some", F.max("_known").over(read)).filter("_some and not _known")
    target = Window.partitionBy("region", "target")
    rows = rows.withColumn("_all", F.count(F.lit(1)).over(target)).withColumn("_grouped", F.count("grp").over(target)).withColumn("_own", F.count("grp").over(Window.partitionBy("region", "target", "grp"))).filter("_all > 1")
    grouped = F.col("grp").isNotNull()
    rows = rows.withColumn("same", F.when(grouped, F.col("_own") - 1).otherwise(0)).withColumn("other", F.when(grouped, F.col("_grouped") - F.col("_own")).otherwise(0))
    return rows.select("region", "target", "read", "same", "other", (F.col("same") < F.col("other")).alias("rejected"))
