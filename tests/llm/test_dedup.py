"""Substring dedup, near-duplicates and components against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import components, neardup, repeats, runtime
from strandloom.llm import words as W


def expect_removed(rows, window):
    first, out = {}, []
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    for i, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_repeats_random(make):
    r = random.Random(1)
    vocabulary = [f"v{i}" for i in range(40)]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(8, 60))] for _ in range(12)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(r.randint(0, 5)):
            text += r.choice(passages) if r.random() < 0.7 else [r.choice(vocabulary) for _ in range(20)]
        rows.append((r.randrange(10_000), r.choice([" ", "\n", "  "]).join(text)))
    for window in (10, 16, 50):
        got = repeats.digest(repeats.remove_repeats(make(rows), window)).collect()
        assert sorted(map(tuple, got), key=str) == expect_removed(rows, window)


def test_repeats_odd(make, odd):
    got = repeats.digest(repeats.remove_repeats(make(odd), 50)).collect()
    assert sorted(map(tuple, got), key=str) == expect_removed(odd, 50)
    assert repeats.remove_repeats(make([]), 50).count() == 0
    with pytest.raises(ValueError):
        repeats.repeated_spans(make([]), 7)


def test_hot_passages_send_few_entries():
    """A passage that all documents of a chunk share: what a chunk sends does not grow with the documents."""
    passage = " ".join(f"p{i}" for i in range(80))
    sizes = []
    for n in (500, 4000):
        texts = [f"{' '.join(f'd{i}w{j}' for j in range(i % 25))} {passage}" for i in range(n)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts)], ["doc_id", "text"])
        rows = pa.Table.from_batches(repeats._anchor_rows(iter([batch]), 16, 4, 50))
        fresh = rows.filter(pa.compute.is_null(rows.column("part")))
        parts = [repeats._parts(x.as_py(), 1) for x in fresh.column("payload")]
        sizes.append(sum(int((place >= ids[doc] % 25).sum()) for ids, _, doc, place, _ in parts))  # runs inside the passage
    assert 0 < sizes[1] < 1.2 * sizes[0]


def test_payloads_do_not_repeat_documents():
    """What a chunk sends stays near its words, however many buckets there are, and reads back as it was."""
    rand = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rand.integers(0, 1 << 30, 60)) for _ in range(400)]
    ids = rand.permutation(np.array([-(1 << 63), (1 << 63) - 1, 0, *range(7, 404)], np.int64))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], ["doc_id", "text"])
    size = sum(len(t) for t in texts)
    whole = None
    for buckets in (1, 64, 4096, 1 << 17):
        rows = pa.Table.from_batches(repeats._anchor_rows(iter([batch]), buckets, 4, 50))
        assert sum(len(x.as_py()) for x in rows.column("payload")) < 4 * size
        found = set()
        for x in rows.column("payload"):
            own, _, doc, place, (key,) = repeats._parts(x.as_py(), 1)
            found |= set(zip(own[doc].tolist(), place.tolist(), key.tolist()))
        assert len(found) == 400 * 36 and (whole is None or found == whole)
        whole = found


def test_inputs_of_unknown_size_are_measured(spark):
    from pyspark.sql import functions as F

    from strandloom.llm.runtime import planned_bytes, spread

    rows = spark.createDataFrame(spark.sparkContext.range(64).map(lambda i: (i,)), "doc_id long").select("doc_id", F.repeat(F.lit("x"), 1 << 20).alias("text"))
    unknown = spark.createDataFrame(rows.rdd, rows.schema)
    assert planned_bytes(unknown) >= 1 << 50
    assert spread(unknown.select("text")) == 8 and spread(unknown.select("text"), 1 << 20) == 64
    assert spread(unknown.select("text"), 1 << 20, 5) == 5


def test_spans_are_maximal(make):
    a = [f"a{i}" for i in range(100)]
    rows = [(1, " ".join(a)), (2, " ".join(["x"] + a[10:80] + ["y"])), (3, " ".join(a[:30] + ["z"] + a[30:]))]
    got = {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in repeats.repeated_spans(make(rows), 20).collect()}
    assert got == {1: [], 2: [(1, 71)], 3: [(0, 30), (31, 101)]}


def test_words():
    texts = ["Ab c\tdé", None, "", "x", "  y  z\x00w "]
    raw, offsets = W.column_bytes(pa.array(texts))
    starts, ends, first = W.split(raw, offsets, W.spaces_split())
    assert [raw[a:b].tobytes() for a, b in zip(starts, ends)] == [w for t in texts for w in (t or "").encode().split()]
    assert np.diff(first).tolist() == [3, 0, 0, 1, 2]
    hashes = W.word_hashes(raw, starts, ends)
    assert len(set(hashes.tolist())) == 6
    runs = W.window_hashes(hashes, 2)
    assert len(runs) == 5 and W.inside(first, 2).tolist() == [0, 1, 4]
    assert (W.unpack(W.pack(np.array([0, 5, 1 << 31], np.uint32))) == [0, 5, 1 << 31]).all()


def brute_components(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, t in sets.items() for s in t), key=str)


def near_rows(seed, n, edits):
    r = random.Random(seed)
    base = [[f"b{j}w{r.randrange(3000)}" for _ in range(r.randint(3, 120))] for j in range(6)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(50)}"
        rows.append((i * 3 + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(make, k):
    rows = near_rows(2, 150, 14)
    got = sorted(map(tuple, neardup.near_duplicates(make(rows), k).collect()), key=str)
    assert got == brute_components(rows, k)


def test_near_tiles(make, monkeypatch):
    rows = near_rows(5, 120, 20)
    small = neardup.still_apart
    monkeypatch.setattr(neardup, "still_apart", lambda *a: small(*a, tile=8, small=3))
    got = sorted(map(tuple, neardup.near_duplicates(make(rows), 2).collect()), key=str)
    assert got == brute_components(rows, 2)


def test_low_limits(make, monkeypatch):
    """Sets of very different sizes link at 30 percent, in tiles too; bands that would miss such pairs are an error."""
    rows = near_rows(7, 60, 4) + [(1000 + i, " ".join(f"t{j}" for j in range(40 if i % 2 else 120))) for i in range(6)]
    with pytest.raises(ValueError):
        neardup.near_duplicates(make(rows), 2, percent=30)
    small = neardup.still_apart
    for tile in (256, 8):
        monkeypatch.setattr(neardup, "still_apart", lambda *a, t=tile: small(*a, tile=t, small=3))
        got = sorted(map(tuple, neardup.near_duplicates(make(rows), 2, percent=30, bands=80, rows=2).collect()), key=str)
        assert got == brute_components(rows, 2, 30)


def test_clashing_names(make, odd):
    docs = make(odd).withColumnsRenamed({"lang": "gone", "source": "component_id"})
    assert neardup.remove_near_duplicates(docs, shingle=2).columns == docs.columns


def test_near_odd(make, odd):
    got = sorted(map(tuple, neardup.near_duplicates(make(odd), 2).collect()), key=str)
    assert got == brute_components(odd, 2)
    assert neardup.near_duplicates(make([]), 2).count() == 0
    kept = neardup.remove_near_duplicates(make(odd), shingle=2)
    assert kept.columns == make([]).columns and 6 not in [r.doc_id for r in kept.collect()]


def test_ids_are_filtered_before_texts_move(make, spark):
    rows = [(i, f"text {i}") for i in range(500)] + [(None, "no id")] * 300
    ids = spark.createDataFrame([(i,) for i in (0, 7, 499, -5, 1 << 62)], "doc_id long")
    for bitmaps in (1, 8, 1 << 13):
        out = runtime.perhaps(make(rows), "doc_id", runtime.id_filter(ids, "doc_id", bitmaps), bitmaps, "near").collect()
        near = [r.doc_id for r in out if r.near]
        assert len(out) == 800 and {0, 7, 499} <= set(near) and None not in near and len(near) < 20
    assert not runtime.perhaps(make(rows), "doc_id", runtime.id_filter(ids.limit(0), "doc_id", 4), 4, "near").filter("near").count()


def test_many_null_ids(make):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text)] * 400 + [(i, text) for i in (5, 3, 9)] + [(20, "something else " * 9)]
    kept = neardup.remove_near_duplicates(make(rows)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [3, 20] and len(kept) == 402
    plan = neardup.remove_near_duplicates(make(rows))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_superminhash():
    r = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        both, own = r.integers(1 << 62, size=int(1000 * share)).astype(np.uint64), r.integers(1 << 62, size=1000 - int(1000 * share)).astype(np.uint64)
        a, b = np.unique(np.concatenate([both, own[::2]])), np.unique(np.concatenate([both, own[1::2]]))
        s = neardup.superminhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 512)
        assert abs((s[0] == s[1]).mean() - len(both) / 1000) < 0.07
    tiny = neardup.superminhash(np.array([7, 9], np.uint64), np.array([0, 1, 1, 2]), 64)
    assert sorted(int(x) >> 48 for x in tiny[0]) == list(range(64)) and (tiny[1] == np.iinfo(np.uint64).max).all()


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(150)] + [(None, 3), (7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    assert sorted(map(tuple, components.components(df).collect())) == sorted((x, root(x)) for x in list(parent))
    assert sorted(map(tuple, components.components(df, finish=0).collect())) == sorted((x, root(x)) for x in list(parent))
    assert components.components(df.limit(0)).count() == 0


def test_forests_are_bounded(monkeypatch):
    monkeypatch.setattr(components, "HELD", 50)
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(400)]
    batches = [pa.RecordBatch.from_arrays([pa.array([a for a, _ in e]), pa.array([b for _, b in e])], ["u", "v"]) for e in (edges[i : i + 20] for i in range(0, 400, 20))]
    out = [x for b in components._forest(iter(batches)) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    u, v = np.array(edges).T
    nodes, roots = components.union_find(u, v)
    a, b = np.array(out).T
    again = dict(zip(*(x.tolist() for x in components.union_find(a, b))))
    assert {x: again.get(x, x) for x in nodes.tolist()} == dict(zip(nodes.tolist(), roots.tolist()))
