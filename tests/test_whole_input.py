"""Registered queries take their whole input: compared with brute force, without the SQL."""

import random

from strandloom import queries as core


def test_nearest_region_answers_every_order(spark, tmp_path):
    r = random.Random(7)
    orders = [(k, r.randrange(1, 40), "1-URGENT") for k in sorted(r.sample(range(1, 60_000), 400))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    want = []
    for k, c, _ in orders:
        at = k * 7919 % 20_000_000
        spans = ((t, t * 1311 % 20_000_000, t * 1311 % 20_000_000 + 200 + t % 800) for t, d, _ in orders if (t // 15000, d % 8) == (k // 15000, c % 8))
        distance, target = min((max(0, st - at, at - ed), t) for t, st, ed in spans)
        want.append((k, target, distance))
    got = core.queries()["nearest_region"](spark, str(tmp_path)).collect()
    assert sorted((x.id, x.target, x.distance) for x in got) == sorted(want)
