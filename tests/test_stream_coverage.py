"""Coverage of a stream, flushed as it goes: the runs of the whole, bounded state, late blocks, batches run again."""

import random

import pytest

from strandloom.operators import intervals
from strandloom.streaming.pipelines import Coverage, depth_changes, finished_coverage

ROWS = "seqname string, pos long, start long, end long"


def reads(n, seed=1, step=9):
    """Blocks of reads by rising position, some with a gap."""
    rand, out = random.Random(seed), []
    for name in ("a", "b"):
        pos = 0
        for _ in range(n):
            pos += rand.randrange(step)
            length, gap = rand.randrange(1, 30), rand.choice([0, 0, 60])
            out.append((name, pos, pos, pos + length))
            if gap:
                out.append((name, pos, pos + length + gap, pos + length + gap + 5))
    return out


def brute(rows, lengths):
    out = []
    for name in sorted({r[0] for r in rows}):
        depth = [0] * lengths[name]
        for r in rows:
            if r[0] == name:
                for p in range(r[2], min(r[3], lengths[name])):
                    depth[p] += 1
        begin = 0
        for p in range(1, len(depth) + 1):
            if p == len(depth) or depth[p] != depth[begin]:
                out.append((name, begin, p, depth[begin]))
                begin = p
    return sorted(out)


def folder_of(spark, path, batches):
    import os

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{path}/in{i}")
        for f in os.listdir(f"{path}/in{i}"):
            if f.endswith(".parquet"):
                os.makedirs(f"{path}/in", exist_ok=True)
                os.rename(f"{path}/in{i}/{f}", f"{path}/in/{i:04}.parquet")
                os.utime(f"{path}/in/{i:04}.parquet", (1_700_000_000 + i * 10,) * 2)
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def plain(df):
    return sorted(tuple(r) for r in df.select("seqname", "start", "end", "depth").collect())


def test_runs_of_a_stream(spark, tmp_path):
    rows = reads(60)
    rows.sort(key=lambda r: r[1])  # both sequences advance together
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    random.Random(2).shuffle(batches[1])
    lengths = {"a": 900, "b": 1000, "c": 50}
    targets = spark.createDataFrame(list(lengths.items()), "seqname string, length long")
    got = plain(finished_coverage(folder_of(spark, tmp_path, batches), targets, 0, str(tmp_path / "out")))
    assert got == brute(rows, lengths)
    sink = Coverage(spark, str(tmp_path / "out"))
    assert plain(sink.runs(False)) != got and set(plain(sink.runs(False))) <= set(got)
    assert all(sink.open_rows(i).count() <= 70 for i in range(len(batches)))


def test_state_does_not_grow(spark, tmp_path):
    sink = Coverage(spark, str(tmp_path / "out"))
    open_rows = []
    for i in range(5):
        deep = [("a", i * 1000 + k, i * 1000 + k, i * 1000 + k + 15) for k in range(0, 1000, 10)] * 3
        sink(spark.createDataFrame(deep, ROWS), i)
        open_rows.append(sink.open_rows(i).count())
    assert max(open_rows) <= 6 and open_rows[-1] <= open_rows[1]
    assert sink.runs(False).count() > 400


def test_slack_late_and_again(spark, tmp_path):
    lengths = {"a": 400}
    targets = spark.createDataFrame(list(lengths.items()), "seqname string, length long")
    first, second = [("a", 100, 100, 120), ("a", 130, 130, 140)], [("a", 95, 95, 110), ("a", 300, 300, 310)]
    own = Coverage(spark, str(tmp_path / "slack"), 50)
    for _ in range(2):  # a batch that is run again replaces itself
        own(spark.createDataFrame(first, ROWS), 0)
    for _ in range(2):
        own(spark.createDataFrame(second, ROWS), 1)
    own.close(targets)
    assert plain(own.runs()) == brute(first + second, lengths) and own.late().isEmpty()
    strict = Coverage(spark, str(tmp_path / "strict"))
    strict(spark.createDataFrame(first, ROWS), 0)
    strict(spark.createDataFrame(second, ROWS), 1)
    strict.close(targets)
    assert [tuple(r)[:4] for r in strict.late().collect()] == [("a", 95, 95, 110)]
    assert plain(strict.runs()) == brute(first + second[1:], lengths)
    with pytest.raises(ValueError):
        finished_coverage(folder_of(spark, tmp_path / "files", [first, second]), targets)


def test_odd_rows_and_empty(spark, tmp_path):
    targets = spark.createDataFrame([("a", 30), ("b", 5)], "seqname string, length long")
    odd = [(None, 1, 1, 2), ("a", None, 1, 2), ("a", 1, None, 2), ("a", 1, 1, None), ("a", 3, 3, 3), ("a", 0, 0, 4), ("a", 0, 0, 4), ("a", 4, 4, 8), ("a", 4, 4, 8), ("a", 20, 20, 30)]
    sink = Coverage(spark, str(tmp_path / "odd"))
    sink(spark.createDataFrame(odd, ROWS), 0)
    sink(spark.createDataFrame([], ROWS), 1)
    sink.close(targets)
    assert plain(sink.runs()) == [("a", 0, 8, 2), ("a", 8, 20, 0), ("a", 20, 30, 1)]
    none = Coverage(spark, str(tmp_path / "none"))
    none(spark.createDataFrame([], ROWS), 0)
    none.close(targets)
    assert none.runs().count() == 0


def test_same_as_the_batch_form(spark, tmp_path):
    rows = spark.createDataFrame(reads(300, 7, 3), ROWS)
    targets = spark.createDataFrame([("a", 2000), ("b", 2000)], "seqname string, length long")
    sink = Coverage(spark, str(tmp_path / "out"))
    for i, (low, high) in enumerate([(0, 100), (100, 101), (101, 400), (400, 5000)]):
        sink(rows.filter(f"pos >= {low} and pos < {high}"), i)
    sink.close(targets)
    assert plain(sink.runs()) == plain(intervals.coverage(rows, targets))
    assert depth_changes(rows).count() > 0
