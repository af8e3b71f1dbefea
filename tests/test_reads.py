"""Rows whose key stands once, with a hot key."""

from pyspark.sql import functions as F

from strandloom.operators import reads as R


def test_unique_with_a_hot_key(spark):
    hot = spark.range(30_000, numPartitions=6).select(F.lit("hot").alias("key"), "id", F.array(F.col("id")).alias("a b"))
    few = spark.createDataFrame([("x", 1, [1]), ("y", 2, None), ("y", 3, [3]), (None, 4, [4])], "key string, id long, `a b` array<long>")
    out = R.unique(hot.union(few), F.col("key"))
    assert out.columns == ["key", "id", "a b"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == [("x", 1, [1]), (None, 4, [4])]
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert not R.unique(few.filter("id > 9"), F.col("key")).count()
