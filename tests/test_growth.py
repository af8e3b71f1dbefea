"""Steps after a sweep are dealt out in as many parts as the input asks for, with the same results."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandloom import shared
from strandloom.operators import intervals as I

ROWS = "seqname string, owner long, start long, end long, sample string, w long"


@pytest.fixture
def many(spark, tmp_path, monkeypatch):
    """(rows, a frame of their file, its parts): more parts than the session's 4."""
    r = random.Random(3)
    rows = [(r.choice("ab"), r.randrange(4), s, s + r.randrange(1, 30), r.choice("xy"), r.randrange(5)) for s in (r.randrange(200000) for _ in range(3000))]
    rows += [("a", 1, 500, 540, "x", 2)] * 50
    path = str(tmp_path / "rows.parquet")
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(path)
    size = sum(f.stat().st_size for f in Path(path).glob("*.parquet"))
    monkeypatch.setattr(shared, "PART_BYTES", size // 9)
    df = spark.read.parquet(path)
    return rows, df, shared.parts(df)


def segments(rows):
    """(seqname, owner, start, end) of the stretches that one owner alone covers."""
    out = []
    for name in "ab":
        cover = {}
        for s, o, a, b, *_ in rows:
            if s == name:
                for p in range(a, b):
                    cover.setdefault(p, set()).add(o)
        run = None
        for p in sorted(cover):
            one = next(iter(cover[p])) if len(cover[p]) == 1 else None
            if run and run[1] == one and run[3] == p:
                run[3] = p + 1
                continue
            if run:
                out.append(tuple(run))
            run = [name, one, p, p + 1] if one is not None else None
        if run:
            out.append(tuple(run))
    return out


def planned(df, key):
    """Parts of the exchanges by columns of which one is `key`."""
    return {int(n) for text, n in re.findall(r"hashpartitioning\(([^)]*), (\d+)\)", df._jdf.queryExecution().executedPlan().toString()) if re.search(rf"\b{key}(_b)?#", text)}


def test_disjoin_has_the_parts_of_its_input(many):
    rows, df, n = many
    assert n > 4
    got = I.disjoin_unique(df.select("seqname", "owner", "start", "end"), ["seqname"], "owner")
    assert sorted(tuple(r) for r in got.select("seqname", "owner", "start", "end").collect()) == sorted(segments(rows))
    assert planned(got, "_island") == {n} and planned(got, "_bin") == {n} and not planned(got, "p")
    counted = I.merge(df, ["seqname"], F.count("*").alias("n"))
    assert planned(counted, "_island") == {n} and counted.agg(F.sum("n")).first()[0] == len(rows)
