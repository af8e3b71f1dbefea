"""Progress of streams, and sequences through an external command."""

import time

import pytest

from strandloom.operators import sampling
from strandloom.streaming.pipelines import Progress


def test_progress(spark, tmp_path):
    spark.range(50).write.parquet(str(tmp_path / "in"))
    told = []
    listener = Progress(told.append)
    spark.streams.addListener(listener)
    try:
        query = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").queryName("counted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        assert query.awaitTermination(60)
        for _ in range(100):
            if told and told[-1]["state"] == "ended":
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [t["state"] for t in told][0] == "started" and told[-1]["state"] == "ended"
    assert sum(t["rows"] for t in told if t["state"] == "running") == 50 and told[0]["query"] == "counted"


def test_external_command(spark):
    rows = spark.createDataFrame([(1, "ACGT"), (2, "GG")], "id long, seq string")
    with pytest.raises(PermissionError):
        sampling.pipe_sequences(rows, "id", "seq", ["cat"])
    got = {r.id: r.output for r in sampling.pipe_sequences(rows, "id", "seq", ["tr", "ACGT", "TGCA"], allow=True).collect()}
    assert got == {1: ">1\nTGCA\n", 2: ">2\nCC\n"}
