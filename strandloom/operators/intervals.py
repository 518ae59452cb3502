"""Joins and groupings of intervals.

Range predicates become equi-joins: each interval is dealt to the few bins it touches on the level of bins that fits its
length, bins join level by level, and a pair is kept in one bin only (the one in which the later start lies), so no distinct
is needed. Groupings of neighbours are gaps and islands
by window functions in two levels: rows meet in bins of a chromosome, and what a bin passes on to the next (a running
maximum or sum) is one row for each bin. No window takes the rows of a whole chromosome. Everything stays in the JVM.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.functions import intervals as iv
from strandloom.tables import kept


def div(x: Column, by: int) -> Column:
    """Floor division that stays an integer."""
    return F.floor(x / F.lit(by)).cast("long")


def bins(st: Column, ed: Column, width: int) -> Column:
    """The bins that a closed interval touches; an interval that ends before it starts touches none."""
    return F.when(st <= ed, F.sequence(div(st, width), div(ed, width))).otherwise(F.array().cast("array<bigint>"))


#: Bases of a chromosome that one window takes, and that are counted together where stretches go by rows.
STRETCH, FINE = 1_000_000, 1024


def stretches(rows: DataFrame, keys: Sequence[str], place: str, stretch: int, most: int | None = None, fine: int = FINE) -> DataFrame:
    """`rows` with `_bin`, which ascends with `place`: equal stretches of bases, or with `most` stretches of about so many
    rows, for tables that lie deep in some places.

    Rows are then counted in steps of `fine` bases, a first pass over keys and places; a stretch takes steps until it has
    `most` rows, so it has less than that and one step more. A step, and so all rows of one place, is never cut: a pile
    of rows at one place stays one stretch.
    """
    if most is None:
        return rows.withColumn("_bin", div(F.col(place), stretch))
    step = div(F.col(place), fine)
    counts = rows.groupBy(*keys, step.alias("_step")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_step")) - F.col("_n")  # a row for each step
    cuts = kept(counts.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), "_step", F.floor(upto / most).alias("_bin")), "stretches")
    known = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)] + [step == F.col("_step")]
    return rows.join(cuts, functools.reduce(Column.__and__, known)).select(*rows.columns, "_bin")


#: A row touches at most SPREAD + 1 bins of its own level, and bins are RATIO times as wide on the next of LEVELS levels.
SPREAD, RATIO, LEVELS = 4, 16, 8


def level(length: Column, width: int) -> Column:
    """The first level of bins on which a row of this length touches few."""
    out = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        out = F.when(length <= SPREAD * width * RATIO**k, k).otherwise(out)
    return out


def dealt(rows: DataFrame, st: str, ed: str, width: int, highest: Column | int, last: int = LEVELS - 1) -> DataFrame:
    """`rows` with a row for each `_bin` on its own `_level` and on each up to `highest`; `_own` is its own level, `last` at most."""
    own = F.least(level(F.col(ed) - F.col(st), width), F.lit(last))
    rows = rows.withColumn("_own", own).withColumn("_level", F.explode(F.sequence(F.col("_own"), F.greatest(F.col("_own"), F.lit(highest) if isinstance(highest, int) else highest))))
    wide = F.lit(width * RATIO ** (LEVELS - 1)).cast("long")
    for k in range(LEVELS - 2, -1, -1):
        wide = F.when(F.col("_level") == k, F.lit(width * RATIO**k).cast("long")).otherwise(wide)
    rows = rows.withColumn("_w", wide)
    touched = F.sequence(F.floor(F.col(st) / F.col("_w")).cast("long"), F.floor(F.col(ed) / F.col("_w")).cast("long"))
    return rows.withColumn("_bin", F.explode(F.when(F.col(st) <= F.col(ed), touched).otherwise(F.array().cast("array<bigint>"))))


def passed_on(rows: DataFrame, keys: Sequence[str], **what: Column) -> DataFrame:
    """`rows` (with `_bin`) with, for each name, the largest value of the bins before their own; null in the first."""
    here, before = [*keys, "_bin"], Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(*here).agg(*(F.max(v).alias(k) for k, v in what.items()))
    return rows.join(per.select(*here, *(F.max(k).over(before).alias(k) for k in what)), here, "left")


def overlap_join(left: DataFrame, right: DataFrame, width: int = 10_000, pad: int = 0, keys: Sequence[str] = ("chrom",), levels: int | None = None) -> DataFrame:
    """All pairs of rows that overlap (closed) once the left is padded on both sides. Right columns get the prefix r_.

    `width` is that of the lowest level's bins: choose it near the typical length. A row goes to at most five bins on its own
    level and to one or two on each higher one that the other table has rows on, whatever its length; a pair meets on the
    higher of its two levels. The other table's highest level takes a pass over its lengths; `levels` states it instead (with
    fewer than there are, results stay and long rows go to more bins). A bin with very many rows on one side is split by
    Spark's skew join, as both sides are plain shuffles.
    """
    right = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    a = left.withColumn("_st", F.col("st") - pad).withColumn("_ed", F.col("ed") + pad)
    b = right
    if levels is None:
        top = lambda rows, st, ed, name: rows.agg(F.coalesce(F.max(level(F.col(ed) - F.col(st), width)), F.lit(0)).alias(name))
        tops = [top(b, "r_st", "r_ed", "_top"), top(a, "_st", "_ed", "_top")]
        a, b = (dealt(rows.join(F.broadcast(t)), st, ed, width, F.col("_top")).drop("_top") for rows, t, st, ed in ((a, tops[0], "_st", "_ed"), (b, tops[1], "r_st", "r_ed")))
    else:
        a, b = (dealt(rows, st, ed, width, levels - 1, levels - 1) for rows, st, ed in ((a, "_st", "_ed"), (b, "r_st", "r_ed")))
    b = b.drop("_w").withColumnsRenamed({"_bin": "_rbin", "_level": "_rlevel", "_own": "_rown"})
    on = (F.col("_bin") == F.col("_rbin")) & (F.col("_level") == F.col("_rlevel")) & (F.col("_level") == F.greatest("_own", "_rown"))
    on = on & iv.overlaps(F.col("_st"), F.col("_ed"), F.col("r_st"), F.col("r_ed")) & (F.col("_bin") == F.floor(F.greatest("_st", "r_st") / F.col("_w")).cast("long"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    return a.join(b, on).drop("_st", "_ed", "_bin", "_level", "_own", "_w", "_rbin", "_rlevel", "_rown")


def containment_join(query: DataFrame, bed: DataFrame, width: int = 1000, order: str = "bed_order", key: str = "id") -> DataFrame:
    """Every query (unique by `key`) with the first row of `bed`, in its order, that contains it; null columns if none does.

    A row of `bed` goes to the bins of the level that fits its length, and a query looks up the bin of its start on each
    level. Hits are reduced by key right after the join, query columns with them.
    """
    b = dealt(bed.select(*(F.col(c).alias(f"r_{c}") for c in bed.columns)), "r_st", "r_ed", width, 0)
    top = bed.agg(F.coalesce(F.max(level(F.col("ed") - F.col("st"), width)), F.lit(0)).alias("_top"))
    on_each = F.explode(F.transform(F.sequence(F.lit(0), F.col("_top")), lambda k: F.struct(k.alias("k"), F.floor(F.col("st") / (F.pow(F.lit(RATIO), k).cast("long") * width)).cast("long").alias("b"))))
    q = query.join(F.broadcast(top)).withColumn("_q", on_each).withColumn("_qlevel", F.col("_q.k")).withColumn("_qbin", F.col("_q.b")).drop("_q", "_top")
    on = (q["chrom"] == b["r_chrom"]) & (q["_qbin"] == b["_bin"]) & (q["_qlevel"] == b["_level"]) & iv.within(q["st"], q["ed"], b["r_st"], b["r_ed"])
    rest = [c for c in query.columns if c != key]
    hit = F.when(F.col("_bin").isNotNull(), F.struct(*(f"r_{c}" for c in bed.columns)))
    per = q.join(b, on, "left").groupBy(key).agg(F.first(F.struct(*rest)).alias("_q"), F.min_by(hit, f"r_{order}").alias("_hit"))
    return per.select(*(F.col(c) if c == key else F.col(f"_q.{c}") for c in query.columns), *(F.col(f"_hit.r_{c}").alias(f"r_{c}") for c in bed.columns))


def feature_overlap(regions: DataFrame, features: DataFrame, width: int = 10_000) -> DataFrame:
    """Regions per feature type (a region once per type), those without any, and each one's percent of all regions."""
    pairs = overlap_join(regions.select("chrom", "st", "ed", "name"), features.select("chrom", "st", "ed", "type"), width)
    per_type = pairs.select("name", F.col("r_type").alias("type")).distinct().groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    total = regions.agg(F.count(F.lit(1)).alias("total"))
    hit = pairs.agg(F.count_distinct("name").alias("hit"))
    none = total.join(hit).select(F.lit("No overlap").alias("type"), (F.col("total") - F.col("hit")).alias("n"))
    return per_type.unionByName(none).join(total).select("type", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent"))


def flag_near(sv: DataFrame, dist: int = 500, keys: Sequence[str] = ("sample", "hap", "chrom"), id_col: str = "id") -> DataFrame:
    """Rows with an end of another row, equal in `keys`, within `dist` of one of their ends. Nesting alone is not near.

    The nearest ends are neighbours in the order of all ends: windows over stretches of each key find them, with no join,
    however many rows lie close together. An end within `dist` of another stretch goes to that one too. Both ends of one row
    may be neighbours, so the nearest end of another row is taken from the last and next row change.
    """
    ends = sv.select(*keys, F.col(id_col).alias("_id"), F.explode(F.array("st", "ed")).alias("p"))
    ends = ends.withColumn("_bin", F.explode(F.sequence(div(F.col("p") - dist, STRETCH), div(F.col("p") + dist, STRETCH))))
    part = [*keys, "_bin"]
    by = Window.partitionBy(*part).orderBy("p", "_id")
    ends = ends.withColumn("_new", F.coalesce(F.lag("_id").over(by) != F.col("_id"), F.lit(True)))
    run = ends.withColumn("_run", F.sum(F.col("_new").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    edge = run.groupBy(*part, "_run").agg(F.first("_id").alias("_id"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    order = Window.partitionBy(*part).orderBy("_run")
    edge = edge.withColumn("_before", F.lag("hi").over(order)).withColumn("_after", F.lead("lo").over(order))
    near = edge.filter((F.col("lo") - F.col("_before") <= dist) | (F.col("_after") - F.col("hi") <= dist)).select(F.col("_id").alias(id_col)).distinct()
    return sv.join(near, id_col, "left_semi")


def with_island(df: DataFrame, gap: int, keys: Sequence[str] = ("chrom",), order: Sequence[str] = ("st", "ed"), stretch: int = STRETCH, most: int | None = None) -> DataFrame:
    """Adds `island`: rows follow each other in one island while a start is at most `gap` (0 at least) past the largest end
    so far. Its value is the start of the island's first row, whatever the stretch (see `stretches`)."""
    rows = stretches(df, keys, "st", stretch, most)
    by = Window.partitionBy(*keys, "_bin").orderBy(*order)
    far = F.greatest("_far", F.max("ed").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    rows = passed_on(rows, keys, _far=F.col("ed")).withColumn("_new", F.when(F.col("st") - far <= gap, None).otherwise(F.col("st")))
    rows = rows.withColumn("_own", F.max("_new").over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow)))  # with its ties
    rows = passed_on(rows, keys, _old=F.col("_new"))
    return rows.withColumn("island", F.coalesce("_own", "_old").cast("long")).drop("_bin", "_far", "_new", "_own", "_old")


def merge(df: DataFrame, gap: int = 0, keys: Sequence[str] = ("chrom",), sums: Sequence[str] = ()) -> DataFrame:
    """One row per island: its span, its rows `n`, and sums of the given columns."""
    rows = with_island(df, gap, keys).groupBy(*keys, "island")
    return rows.agg(F.min("st").alias("st"), F.max("ed").alias("ed"), F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in sums)).drop("island")


def gap_clusters(points: DataFrame, gap: int = 20, keys: Sequence[str] = ("chrom",), pos: str = "pos") -> DataFrame:
    """Clusters of positions whose neighbours are at most `gap` apart: start, end and number."""
    return merge(points.select(*keys, F.col(pos).alias("st"), F.col(pos).alias("ed")), gap, keys)


def sv_bins(sv: DataFrame, width: int = 500) -> DataFrame:
    """A row for each bin (its start) of every variant, from one base before it to one behind its end."""
    first, last = F.greatest(F.lit(0), F.col("st") - 1), F.col("ed") + 1
    return sv.withColumn("bin", F.explode(F.sequence(div(first, width), div(last, width)))).withColumn("bin", F.col("bin") * width)


def bin_frequency(binned: DataFrame, least: int, width: int = 500) -> DataFrame:
    """Regions of touching bins that at least `least` haplotypes (sample and hap) carry, with the largest count."""
    carried = binned.select("chrom", "bin", "sample", "hap").distinct().groupBy("chrom", "bin").agg(F.count(F.lit(1)).alias("ac")).filter(F.col("ac") >= least)
    spans = carried.select("chrom", F.col("bin").alias("st"), (F.col("bin") + width).alias("ed"), "ac")
    rows = with_island(spans, 0).groupBy("chrom", "island")
    return rows.agg(F.min("st").alias("st"), F.max("ed").alias("ed"), F.max("ac").alias("max_ac"), F.count(F.lit(1)).alias("n_bins")).drop("island")


def depth_steps(spans: DataFrame, stretch: int, most: int | None = None) -> DataFrame:
    """`(chrom, st, ed, n)`: the stretches of places (closed) that equally many, at least one, of the spans cover.

    Two rows for each span, whatever its length: one more from its start, one less behind its end; running sums in bins.
    """
    step = F.explode(F.array(F.struct(F.col("st").alias("p"), F.lit(1).alias("d")), F.struct((F.col("ed") + 1).alias("p"), F.lit(-1).alias("d")))).alias("e")
    at = spans.select("chrom", step).groupBy("chrom", F.col("e.p").alias("st")).agg(F.sum("e.d").alias("d")).filter("d <> 0")
    at = stretches(at, ("chrom",), "st", stretch, most)
    by, bins_ = Window.partitionBy("chrom", "_bin").orderBy("st"), Window.partitionBy("chrom").orderBy("_bin")
    per = at.groupBy("chrom", "_bin").agg(F.sum("d").alias("d"), F.min("st").alias("first"))
    per = per.select("chrom", "_bin", F.coalesce(F.sum("d").over(bins_.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.lead("first").over(bins_).alias("_next"))
    rows = at.withColumn("n", F.sum("d").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("ed", F.lead("st").over(by)).join(per, ["chrom", "_bin"])
    return rows.select("chrom", "st", (F.coalesce("ed", "_next") - 1).alias("ed"), (F.col("n") + F.col("_base")).alias("n")).filter("n > 0")


def merge_beds(beds: DataFrame, n_samples: int, window: int = 20, least_row: int = 100, least_run: int = 500) -> DataFrame:
    """Depth of samples' regions in small windows, as runs of equal level: level 1 up to a twentieth of the samples, else 2."""
    spans = beds.filter((F.col("ed") - F.col("st") >= least_row) & (F.col("st") <= F.col("ed"))).select("chrom", div(F.col("st"), window).alias("st"), div(F.col("ed"), window).alias("ed"))
    steps = depth_steps(spans, STRETCH // window).withColumn("level", F.when(F.col("n") * 20 <= n_samples, 1).otherwise(2))
    size = F.col("ed") - F.col("st") + 1
    rows = with_island(steps.withColumn("windows", size).withColumn("total", F.col("n") * size), 1, ("chrom", "level"), ("st",), STRETCH // window)
    runs = rows.groupBy("chrom", "level", "island").agg((F.min("st") * window).alias("st"), ((F.max("ed") + 1) * window).alias("ed"), F.sum("windows").alias("windows"), F.sum("total").alias("total"))
    return runs.filter(F.col("ed") - F.col("st") >= least_run).withColumn("mean", F.col("total") / F.col("windows")).drop("island")


def coverage(spans: DataFrame, annotation: DataFrame, key: str = "id", width: int = 10_000, half_open: bool = False) -> DataFrame:
    """For every span the bases that annotation covers (overlaps counted once), the percent, and how many rows cover it."""
    last = 1 if half_open else 0
    pairs = overlap_join(spans.select(key, "chrom", "st", (F.col("ed") - last).alias("ed")), annotation.select("chrom", "st", (F.col("ed") - last).alias("ed")), width)
    clipped = pairs.select(key, F.greatest("st", "r_st").alias("st"), F.least("ed", "r_ed").alias("ed"))
    covered = merge(clipped, 0, (key,)).groupBy(key).agg(F.sum(F.col("ed") - F.col("st") + 1).alias("covered"), F.sum("n").alias("n"))
    size = F.col("ed") - F.col("st") + 1 - last
    out = spans.join(covered, key, "left").withColumn("covered", F.coalesce("covered", F.lit(0))).withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("percent", F.when(size > 0, 100.0 * F.col("covered") / size).otherwise(0.0))


def covering(spans: DataFrame, annotation: DataFrame, key: str = "id", width: int = 10_000) -> DataFrame:
    """For every span the annotation that overlaps it, cut to the span and in order: `(key, covering array<struct<st, ed>>)`."""
    pairs = overlap_join(spans.select(key, "chrom", "st", "ed"), annotation.select("chrom", "st", "ed"), width)
    per = pairs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.greatest("st", "r_st").alias("st"), F.least("ed", "r_ed").alias("ed")))).alias("covering"))
    return spans.select(key).join(per, key, "left").withColumn("covering", F.coalesce("covering", F.array().cast(per.schema["covering"].dataType)))


def best_annotation(spans: DataFrame, annotation: DataFrame, key: str = "id", order: str = "ann_order", width: int = 10_000) -> DataFrame:
    """For every span with an overlap the annotation with the longest (half-open) overlap; of equals the first by `order`."""
    pairs = overlap_join(spans, annotation, width).withColumn("overlap", F.least("ed", "r_ed") - F.greatest("st", "r_st")).filter("overlap > 0")
    best = Window.partitionBy(key).orderBy(F.desc("overlap"), f"r_{order}")
    return pairs.withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k")


def nearest(points: DataFrame, targets: DataFrame, key: str = "id", order: str = "id", most: int | None = None) -> DataFrame:
    """For every point the nearest interval of its chromosome and the distance (0 inside); of equals the first by `order`.

    Sorted by place, the candidates are the interval that ends last among those that start before the point and the first
    that starts behind it: running aggregates over both tables in bins, with the best of all bins before and behind.
    """
    p = points.select("chrom", F.col("pos").alias("x"), F.lit(1).alias("kind"), F.col(key).alias("_key"), F.lit(None).cast("struct<ed: bigint, neg: bigint, st: bigint>").alias("t"))
    t = targets.select("chrom", F.col("st").alias("x"), F.lit(0).alias("kind"), F.lit(None).cast(points.schema[key].dataType).alias("_key"), F.struct(F.col("ed").cast("long").alias("ed"), (-F.col(order)).cast("long").alias("neg"), F.col("st").cast("long").alias("st")).alias("t"))
    both = stretches(p.unionByName(t), ("chrom",), "x", STRETCH, most)
    start = F.when(F.col("t").isNotNull(), F.struct(F.col("t.st").alias("st"), (-F.col("t.neg")).alias("k")))
    bins_ = Window.partitionBy("chrom").orderBy("_bin")
    per = both.groupBy("chrom", "_bin").agg(F.max("t").alias("_t"), F.min(start).alias("_s"))
    per = per.select("chrom", "_bin", F.max("_t").over(bins_.rowsBetween(Window.unboundedPreceding, -1)).alias("_a"), F.min("_s").over(bins_.rowsBetween(1, Window.unboundedFollowing)).alias("_b"))
    by = Window.partitionBy("chrom", "_bin").orderBy("x", "kind")
    after = Window.partitionBy("chrom", "_bin").orderBy(F.desc("x"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("a", F.max("t").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("b", F.min(start).over(after)).filter("kind = 1").join(per, ["chrom", "_bin"], "left")
    seen = seen.withColumn("a", F.greatest("a", "_a")).withColumn("b", F.coalesce("b", "_b"))
    da = F.when(F.col("a").isNotNull(), F.greatest(F.lit(0), F.col("x") - F.col("a.ed")))
    db = F.when(F.col("b").isNotNull(), F.col("b.st") - F.col("x"))
    pick_a = F.coalesce((da < db) | ((da == db) & (-F.col("a.neg") <= F.col("b.k"))), F.col("a").isNotNull())
    found = seen.select("_key", F.when(pick_a, -F.col("a.neg")).otherwise(F.col("b.k")).alias("_t"), F.when(pick_a, da).otherwise(db).alias("_d"))
    spots = points.select(F.col(key).alias("_ikey"), "chrom", F.col("pos").alias("st"), F.col("pos").alias("ed"))
    inside = overlap_join(spots, targets).groupBy("_ikey").agg(F.min(f"r_{order}").alias("_inside"))
    out = points.join(found, points[key] == found["_key"], "left").join(inside, points[key] == inside["_ikey"], "left")
    return out.select(*points.columns, F.coalesce("_inside", "_t").alias("target"), F.when(F.col("_inside").isNotNull(), 0).otherwise(F.col("_d")).alias("distance"))


def drop_near(query: DataFrame, target: DataFrame, dist: int, width: int = 10_000, key: str = "id") -> DataFrame:
    """Rows of `query` with no row of `target` overlapping once padded by `dist`."""
    hit = overlap_join(query, target, width, dist).select(F.col(key).alias("_hit")).distinct()
    return query.join(hit, query[key] == hit["_hit"], "left_anti")


def repeats_in(regions: DataFrame, index: DataFrame, step: int, key: str = "id") -> DataFrame:
    """Index rows at the multiples of `step` from the one at a region's start to one behind that at its end."""
    r = regions.withColumn("_p", F.explode(F.transform(F.sequence(div(F.col("st"), step), div(F.col("ed"), step) + 1), lambda i: i * step)))
    i = index.select(F.col("chrom").alias("_c"), F.col("pos").alias("_q"), "k")
    return r.join(i, (r["chrom"] == i["_c"]) & (r["_p"] == i["_q"])).select(*regions.columns, F.col("_p").alias("pos"), "k")


def breakpoint_windows(regions: DataFrame, points: DataFrame, window: int = 10, key: str = "id") -> DataFrame:
    """Points inside regions with the number of their window, counted from the region's start."""
    pairs = overlap_join(regions, points.withColumn("st", F.col("pos")).withColumn("ed", F.col("pos")), 1000)
    return pairs.withColumn("window", div(F.col("r_pos") - F.col("st"), window))


def high_confidence_blocks(regions: DataFrame, blocks: DataFrame, step: int = 100) -> DataFrame:
    """`blocks` with `high`: whether a region, sampled every `step` bases from its start, falls in the block."""
    marked = regions.filter("ed > st").select("chrom", F.explode(F.sequence(F.col("st"), F.col("ed") - 1, F.lit(step))).alias("p")).select("chrom", div(F.col("p"), step).alias("block")).distinct()
    return blocks.join(marked.withColumn("high", F.lit(True)), ["chrom", "block"], "left").withColumn("high", F.coalesce("high", F.lit(False)))


def compare_calls(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("sample", "type", "chrom"), width: int = 10_000) -> DataFrame:
    """Per key: calls of `a`, and those whose best overlap share with a call of `b` exceeds 0.9 and 0.5."""
    pairs = overlap_join(a, b, width, 0, keys)
    share = iv.overlap_share(F.col("st"), F.col("ed"), F.col("r_st"), F.col("r_ed"))
    best = pairs.groupBy("id").agg(F.max(share).alias("share"))
    return a.join(best, "id", "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("share") > 0.9).alias("over_90"), F.count_if(F.col("share") > 0.5).alias("over_50"))


def lift(points: DataFrame, blocks: DataFrame, width: int = 10_000) -> DataFrame:
    """Positions carried over by alignment blocks: columns chrom, st, ed (source), to_chrom, to_st, strand."""
    p = points.withColumn("st", F.col("pos")).withColumn("ed", F.col("pos"))
    hit = overlap_join(p, blocks, width)
    moved = F.when(F.col("r_strand") == "-", F.col("r_to_st") + F.col("r_ed") - F.col("pos")).otherwise(F.col("r_to_st") + F.col("pos") - F.col("r_st"))
    return hit.select(*points.columns, F.col("r_to_chrom").alias("to_chrom"), moved.alias("to_pos"))


def lift_blocks(chains: DataFrame) -> DataFrame:
    """Blocks of matches and mismatches of alignments `(chain, chrom, length, strand, to_chrom, to_st, cigar)`: chrom, st, ed in
    forward places of the source sequence (closed), to_chrom, to_st (at st if forward, at ed if reverse), strand, chain, score.

    A chain's score is its number of matches and mismatches. Clipped ends of the source (S, H) count as its bases.
    """
    hard = F.transform("cigar", lambda x: F.struct(F.when(x["op"] == "H", "S").otherwise(x["op"]).alias("op"), x["len"].alias("len")))
    matched = F.aggregate(F.filter("cigar", lambda x: x["op"].isin("M", "=", "X")), F.lit(0).cast("long"), lambda a, x: a + x["len"])
    ops = cg.exploded(chains.withColumn("_c", hard).withColumn("score", matched), "_c", "to_st").filter(F.col("op").isin("M", "=", "X"))
    forward = F.col("strand") != "-"
    st = F.when(forward, F.col("query")).otherwise(F.col("length") - F.col("query") - F.col("len"))
    return ops.select("chrom", st.cast("long").alias("st"), (st + F.col("len") - 1).cast("long").alias("ed"), "to_chrom", F.col("ref").cast("long").alias("to_st"), "strand", "chain", "score")


def _first_alike(chains: DataFrame) -> DataFrame:
    """Of chains with the same blocks in the source, which have the same score and the same bases of any span, the first: the
    best chain of a point or span is never one of the others."""
    first = chains.groupBy("chrom", "length", "strand", "cigar").agg(F.min_by(F.struct("chain", "to_chrom", "to_st"), "chain").alias("_x"))
    return first.select("chrom", "length", "strand", "cigar", "_x.*")


def lift_points(points: DataFrame, chains: DataFrame, key: str = "id", width: int = 10_000) -> DataFrame:
    """`points` (id, chrom, pos) with their place on the other assembly, by the best chain that has it in a block (of the
    highest score, then the first): to_chrom, to_pos, strand, chain. Without one, all are null: places that no chain covers,
    and those in a gap, which have no base there."""
    best_first = F.struct(-F.col("score"), "chain")  # of blocks at the same place, only one can be a point's best
    blocks = lift_blocks(_first_alike(chains)).groupBy("chrom", "st", "ed").agg(F.min_by(F.struct("to_chrom", "to_st", "strand", "chain", "score"), best_first).alias("_x")).select("chrom", "st", "ed", "_x.*")
    pairs = overlap_join(points.select(key, "chrom", F.col("pos").alias("st"), F.col("pos").alias("ed")), blocks, width)
    at = F.col("st") - F.col("r_st")
    moved = F.col("r_to_st") + F.when(F.col("r_strand") == "-", F.col("r_ed") - F.col("st")).otherwise(at)
    best = pairs.groupBy(key).agg(F.min_by(F.struct(F.col("r_to_chrom").alias("to_chrom"), moved.alias("to_pos"), F.col("r_strand").alias("strand"), F.col("r_chain").alias("chain")), F.struct(-F.col("r_score"), "r_chain")).alias("_x"))
    return points.join(best, key, "left").select(*points.columns, "_x.*")


def lift_spans(spans: DataFrame, chains: DataFrame, key: str = "id", width: int = 10_000) -> DataFrame:
    """`spans` (id, chrom, st, ed, closed) on the other assembly: from the first to the last base that the best chain has in
    blocks, the span clipped at block edges: to_chrom, to_st, to_ed, strand, chain, lifted (bases in blocks). The best chain has
    the most of the span's bases, then the highest score; without one all are null."""
    pairs = overlap_join(spans.select(key, "chrom", "st", "ed"), lift_blocks(_first_alike(chains)), width)
    st, ed = F.greatest("st", "r_st"), F.least("ed", "r_ed")
    reverse = F.col("r_strand") == "-"
    low = F.col("r_to_st") + F.when(reverse, F.col("r_ed") - ed).otherwise(st - F.col("r_st"))
    per = pairs.groupBy(key, "r_chain", "r_score", "r_to_chrom", "r_strand").agg(F.min(low).alias("to_st"), F.max(low + ed - st).alias("to_ed"), F.sum(ed - st + 1).alias("lifted"))
    best = per.groupBy(key).agg(F.min_by(F.struct(F.col("r_to_chrom").alias("to_chrom"), "to_st", "to_ed", F.col("r_strand").alias("strand"), F.col("r_chain").alias("chain"), "lifted"), F.struct(-F.col("lifted"), -F.col("r_score"), "r_chain")).alias("_x"))
    return spans.join(best, key, "left").select(*spans.columns, "_x.*")
