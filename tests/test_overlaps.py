"""Overlaps of intervals of all lengths, and plans that store nothing."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import intervals as I

ROWS = "seqname string, start long, end long, id long"


def mixed(n, seed, lengths=(0, 1, 7, 128, 129, 5000, 1 << 17, 1 << 24, 3 << 31)):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.choice([r.randrange(-300, 3000), r.randrange(1 << 18), r.randrange(1 << 25)])
        out.append((r.choice("ab"), s, s + r.choice(lengths), i))
    return out


def meet(a, b):
    return a[0] == b[0] and a[1] < b[2] and b[1] < a[2]


@pytest.mark.parametrize("lengths", [(0, 1, 7, 128, 129, 5000, 1 << 17, 1 << 24, 3 << 31), (50,), (1, 1 << 30)])
def test_join(spark, lengths):
    a, b = mixed(300, 1, lengths), mixed(400, 2)
    left, right = spark.createDataFrame(a, ROWS), spark.createDataFrame(b, ROWS)
    for x, y, p, q in ((left, right, a, b), (right, left, b, a), (left, left, a, a)):
        got = sorted((r.id, r.id_b) for r in I.interval_join(x, y, ["seqname"]).collect())
        assert got == sorted((u[3], v[3]) for u in p for v in q if meet(u, v))
    assert I.interval_join(left, right.limit(0), ["seqname"]).count() == I.interval_join(left.limit(0), right, ["seqname"]).count() == 0


def test_counts(spark):
    a, b = mixed(300, 3), mixed(500, 4) + [("a", 5, 5, 900)] * 3 + [("b", 1000, 1000, 901)]
    a += [("a", 5, 5, 1000), ("a", 5, 6, 1001), ("a", 4, 5, 1002), ("a", 4, 6, 1003), ("c", 0, 10, 1004), (None, 0, 10, 1005), ("a", None, 10, 1006)]
    got = I.count_overlaps(spark.createDataFrame(a, ROWS), spark.createDataFrame(b, ROWS), ["seqname"], ["id"])
    assert sorted(map(tuple, got.collect())) == sorted((u[3], sum(meet(u, v) for v in b) if u[0] and u[1] is not None else 0) for u in a)


def test_a_row_is_few_rows(spark):
    a, b = spark.createDataFrame(mixed(300, 5), ROWS), spark.createDataFrame(mixed(300, 6), ROWS)
    assert I._dealt(a, b, 1, 2, "").groupBy("id").count().agg(F.max("count")).first()[0] <= 2 * (len(I.LEVELS) + 1)
    reads = spark.range(1000).selectExpr("'a' as seqname", "id * 50 as start", "id * 50 + 100 as end", "id")
    assert I._dealt(reads, reads, 1, 2, "").count() < 2000  # one level on both sides: home alone


def test_a_million_rows_in_a_bin(spark):
    """A stack of a million reads and a few regions: pairs are those that overlap, and a count makes none."""
    stack = spark.range(1_000_000, numPartitions=8).selectExpr("'a' as seqname", "1000 + id % 3 as start", "1050 + id % 3 as end", "id")
    regions = spark.createDataFrame([("a", 0, 900, 1), ("a", 900, 1001, 2), ("a", 1052, 1053, 3), ("a", 0, 1 << 28, 4)], ROWS)
    want = {1: 0, 2: 333334, 3: 0, 4: 1000000}
    got = I.count_overlaps(regions, stack, ["seqname"], ["id"])
    assert {r.id: r.n for r in got.collect()} == want
    pairs = I.interval_join(regions, stack, ["seqname"]).groupBy("id").count()
    assert {r.id: r["count"] for r in pairs.collect()} == {k: n for k, n in want.items() if n}
    events = [p for p in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in p]
    assert len(events) == 1 and "_bin" in events[0]  # one row a bin


def test_sweeps_run_no_job(spark):
    rows = spark.createDataFrame(mixed(200, 7, (1, 50, 3000)), ROWS)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sweeps", "none")
    try:
        made = [I.merge(rows, ["seqname"], F.count("*").alias("n")), I.disjoin_unique(rows, ["seqname"], "id"), I.nearest(rows, rows, ["seqname"], "start", "end", "left", "id")]
        assert not tracker.getJobIdsForGroup("sweeps")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for df in made:
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert "ExistingRDD[seqname" not in text.replace("LogicalRDD", "ExistingRDD") or "Scan" in text
    merged = made[0]
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("REPARTITION_BY_COL") == 2  # named twice, made once
