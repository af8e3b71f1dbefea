"""Interval operators against brute force on random small inputs, with bins so narrow that every case crosses some."""

import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from strandloom.operators import intervals as I
from strandloom.operators import sweep

ROWS = "seqname string, strand string, start long, end long, name string, score double, id long"


def some(n, seed, span=300, most=40):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.randrange(span)
        out.append((r.choice("ab"), r.choice("+-"), s, s + r.randint(1, most), f"n{r.randrange(5)}", float(r.randrange(9)), i))
    return out


@pytest.fixture(autouse=True)
def narrow(monkeypatch):
    for f in (sweep.with_bin, sweep.binned, sweep.merge_runs, I.interval_join):
        monkeypatch.setattr(f, "__defaults__", tuple(16 if d == 1 << 16 else d for d in f.__defaults__))
    for f in (I.running, I.neighbours):
        if f.__kwdefaults__ and "width" in f.__kwdefaults__:
            monkeypatch.setitem(f.__kwdefaults__, "width", 16)
        elif f.__defaults__:
            monkeypatch.setattr(f, "__defaults__", tuple(16 if d == 1 << 16 else d for d in f.__defaults__))


def bases(rows, key):
    out = {}
    for r in rows:
        out.setdefault(key(r), set()).update(range(r[2], r[3]))
    return out


def runs(points):
    out = []
    for p in sorted(points):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [tuple(x) for x in out]


def test_merge(spark):
    rows = some(150, 1)
    got = I.merge(spark.createDataFrame(rows, ROWS), ["seqname", "strand"]).collect()
    want = {(*k, *r) for k, v in bases(rows, lambda r: r[:2]).items() for r in runs(v)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_merge_apart_and_ties(spark):
    rows = [("a", "+", s, e, "x", 0.0, i) for i, (s, e) in enumerate([(0, 10), (10, 20), (10, 20), (15, 18), (20, 21), (40, 41), (40, 41)])]
    df = spark.createDataFrame(rows, ROWS)
    assert sorted((r.start, r.end) for r in I.merge(df, ["seqname"], touching=False).collect()) == [(0, 10), (10, 20), (20, 21), (40, 41)]
    assert sorted((r.start, r.end) for r in I.merge(df, ["seqname"]).collect()) == [(0, 21), (40, 41)]


def test_join(spark):
    a, b = some(80, 2), some(80, 3)
    got = [(r.id, r.id_b) for r in I.interval_join(spark.createDataFrame(a, ROWS), spark.createDataFrame(b, ROWS), ["seqname"]).collect()]
    want = [(x[6], y[6]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3]]
    assert sorted(got) == sorted(want)


def test_subtract(spark):
    a, b = some(60, 4), some(40, 5)
    got = I.subtract(spark.createDataFrame(a, ROWS), spark.createDataFrame(b, ROWS), ["seqname", "strand"], "id").collect()
    gone = bases(b, lambda r: r[:2])
    want = []
    for x in a:
        left = runs(set(range(x[2], x[3])) - gone.get(x[:2], set()))
        cut = len(set(range(x[2], x[3])) & gone.get(x[:2], set())) > 0
        want += [(x[6], s, e, i + 1 if cut else 0) for i, (s, e) in enumerate(left)]
    assert sorted((r.id, r.start, r.end, r.piece) for r in got) == sorted(want)


def test_disjoin(spark):
    rows = [(r[0], r[6] % 4, r[2], r[3]) for r in some(60, 6)]
    got = I.disjoin_unique(spark.createDataFrame(rows, "seqname string, owner long, start long, end long"), ["seqname"], "owner").collect()
    want = set()
    for name in "ab":
        by = {p: {o for s, o, a, b in rows if s == name and a <= p < b} for p in range(400)}
        for o in range(4):
            want |= {(name, o, *r) for r in runs(p for p, v in by.items() if v == {o})}
    assert {tuple(r) for r in got} == want


def test_coverage(spark):
    rows = some(50, 7)
    targets = spark.createDataFrame([("a", 400), ("b", 350), ("c", 9)], "seqname string, length long")
    got = I.coverage(spark.createDataFrame(rows, ROWS), targets).collect()
    want = []
    for name, size in (("a", 400), ("b", 350)):
        depth = [sum(r[0] == name and r[2] <= p < r[3] for r in rows) for p in range(size)]
        start = 0
        for p in range(1, size + 1):
            if p == size or depth[p] != depth[start]:
                want.append((name, start, p, depth[start]))
                start = p
    assert sorted(tuple(r) for r in got) == want


def test_nearest(spark):
    a, b = some(50, 8), some(30, 9)
    ends, starts = ({n: sorted(r[k] for r in b if r[0] == n) for n in "ab"} for k in (3, 2))
    pa, pb = spark.createDataFrame(a, ROWS), spark.createDataFrame(b, ROWS)
    for r in I.nearest(pa, pb, ["seqname"], "start", "end", "left", "name").collect():
        i = bisect_right(ends[r.seqname], r.start)
        assert r._distance == (r.start - ends[r.seqname][i - 1] if i else None)
    for r in I.nearest(pa, pb, ["seqname"], "end", "start", "right", "name").collect():
        i = bisect_left(starts[r.seqname], r.end)
        assert r._distance == (starts[r.seqname][i] - r.end if i < len(starts[r.seqname]) else None)


def test_gaps_of_nested_rows(spark):
    rows = [("t", "+", s, e, "x", 0.0, i) for i, (s, e) in enumerate([(0, 100), (10, 20), (50, 60), (200, 300), (300, 310)])]
    got = I.gaps(spark.createDataFrame(rows, ROWS), ["seqname"]).collect()
    assert [(r.start, r.end) for r in got] == [(100, 200)]


def test_nearest_of_both(spark):
    a, b = some(50, 12), some(30, 13)
    for ties in ("left", "right"):
        got = I.nearest_of_both(spark.createDataFrame(a, ROWS), spark.createDataFrame(b, ROWS), ["seqname"], ties, "name").collect()
        assert len(got) == 50
        for r in got:
            left = [(r.start - x[3], 0 if ties == "left" else 1, "left") for x in b if x[0] == r.seqname and x[3] <= r.start]
            right = [(x[2] - r.end, 0 if ties == "right" else 1, "right") for x in b if x[0] == r.seqname and x[2] >= r.end]
            best = min(left + right, default=(None, 0, None))
            assert (r._distance, r._side) == (best[0], best[2])


def test_merge_first(spark):
    rows = [("a", 5, 9, "second", 2.0, "2"), ("a", 1, 6, "first", 0.5, "0.50"), ("a", 1, 3, "tie", 7.0, "7e0"), ("a", 20, 21, "alone", 1.0, "1")]
    got = I.merge_first(spark.createDataFrame(rows, "seqname string, start long, end long, name string, score double, score_text string"), ["seqname"], ["end", "name"], "name", "score").collect()
    assert sorted((r.start, r.end, r.name, r.score, r.top) for r in got) == [(1, 9, "tie", 7.0, "7e0"), (20, 21, "alone", 1.0, "1")]


def test_neighbours(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.randrange(300), i) for i in range(60)]
    got = I.neighbours(spark.createDataFrame(rows, "seqname string, at long, id long"), ["seqname"], ["at", "id"], left="lag:id", right="lead:id").collect()
    for name in "ab":
        line = [i for _, _, i in sorted(x for x in rows if x[0] == name)]
        around = {i: (p, n) for p, i, n in zip([None, *line], line, [*line[1:], None])}
        assert all((x.left, x.right) == around[x.id] for x in got if x.seqname == name)


def test_runs(spark):
    points = [("a", p, v) for p, v in [(0, 1), (5, 1), (9, 2), (40, 2), (41, 0), (90, 2)]] + [("b", 3, 7)]
    targets = spark.createDataFrame([("a", 100), ("b", 3)], "seqname string, length long")
    got = I.run_lengths(spark.createDataFrame(points, "seqname string, p long, v int"), ["seqname"], "v", targets).collect()
    assert sorted(map(tuple, got)) == [("a", 0, 9, 1), ("a", 9, 41, 2), ("a", 41, 90, 0), ("a", 90, 100, 2)]


def test_empty(spark):
    none = spark.createDataFrame([], ROWS)
    some_rows = spark.createDataFrame(some(5, 1), ROWS)
    targets = spark.createDataFrame([("a", 5)], "seqname string, length long")
    assert I.merge(none, ["seqname"]).count() == 0
    assert I.subtract(some_rows, none, ["seqname"], "id").count() == 5
    assert I.coverage(none, targets).count() == 0
    assert I.nearest(some_rows, none, ["seqname"], "start", "end", "left", "name").filter(F.col("_distance").isNull()).count() == 5


def test_looking_ahead_is_linear(spark):
    """A frame up to the last row is worked anew for every row."""
    rows = spark.createDataFrame(some(9, 1), ROWS)
    near = I.neighbours(rows, ["seqname"], ["start", "id"], after="lead:start")
    ends = I.running(rows.select("seqname", F.col("start").alias("p"), F.lit(1).alias("d")).distinct(), ["seqname"], "d")
    for df in (near, ends):
        assert "unboundedfollowing" not in df._jdf.queryExecution().analyzed().toString().lower()
