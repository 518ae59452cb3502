"""Running sums and exact quantiles over all values of a table, range by range.

Values are dealt to RANGES equal ranges between the least and the largest. Each range is summed up by itself; what comes
before a range is a window over one row for each range, RANGES at most, and joins its rows again. No task takes all values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 4096


def cumulated(counts: DataFrame, value: str, amount: str, ranges: int = RANGES) -> DataFrame:
    """`counts` (one row for each value, numbers) with `upto`, the sum of `amount` up to the value, `total` of all, and
    `previous`, the next smaller value."""
    ends = counts.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (ranges - 1))).otherwise(0)
    rows = counts.join(F.broadcast(ends)).withColumn("_range", at.cast("long")).drop("_lo", "_hi")
    per = rows.groupBy("_range").agg(F.sum(amount).alias("_sum"), F.max(value).alias("_last")).withColumn("_all", F.floor(F.col("_range") / ranges))
    before = Window.partitionBy("_all").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy("_all")).alias("total"), F.max("_last").over(before).alias("_previous"))
    inside = Window.partitionBy("_range").orderBy(value)
    rows = rows.withColumn("_own", F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_lag", F.lag(value).over(inside))
    out = rows.join(F.broadcast(per), "_range")
    return out.select(*counts.columns, (F.col("_own") + F.col("_before")).alias("upto"), "total", F.coalesce("_lag", "_previous").alias("previous"))


def quantiles(rows: DataFrame, value: str, **shares: float) -> DataFrame:
    """One row with the exact quantile for each name, between neighbours in proportion, and the number `n` of values that
    aren't null: found by their ranks in counts of equal values."""
    counts = cumulated(rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n")), value, "_n")
    place = {k: q * (F.col("total") - 1) for k, q in shares.items()}
    least = lambda at: F.min(F.when(F.col("upto") > at, F.col(value)))
    found = counts.agg(F.max("total").alias("total"), *(least(f(p)).alias(f"{k}_{n}") for k, p in place.items() for n, f in (("lo", F.floor), ("hi", F.ceil))))
    between = lambda k: (F.col(f"{k}_lo") + (place[k] - F.floor(place[k])) * (F.col(f"{k}_hi") - F.col(f"{k}_lo"))).cast("double").alias(k)
    return found.select(*map(between, shares), F.coalesce("total", F.lit(0)).alias("n"))
