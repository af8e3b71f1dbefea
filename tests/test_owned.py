"""Counts over segments of one owner: equal reads are one row, both sides of the join have the input's parts."""

from collections import Counter

from pyspark.sql import functions as F
from test_growth import many, planned, segments  # noqa: F401

from strandloom import shared
from strandloom.operators import annotation as A


def test_unique_segment_counts(many):  # noqa: F811
    rows, df, n = many
    features, samples = df.select("seqname", "owner", "start", "end"), df.select("seqname", "sample", (F.col("start") + 5).alias("start"), (F.col("start") + 6).alias("end"), "w")
    found = {(s, p): o for s, o, a, b in segments(rows) for p in range(a, b)}
    count, weight = Counter(), Counter()
    for s, _, a, _, sample, w in rows:
        if (s, a + 5) in found:
            count[found[s, a + 5], sample] += 1
            weight[found[s, a + 5], sample] += w
    for column, want in ((None, count), ("w", weight)):
        got = A.unique_segment_counts(features, "owner", samples, column)
        assert {(r.owner, r.sample): r.n for r in got.collect()} == want
    assert planned(got, "_role") == {shared.parts(features.union(features))} and shared.parts(features.union(features)) >= 2 * n
    alike = [line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [sample" in line]
    assert alike
