"""Sharding, chat, mixing, line rules: SQL and small cases."""

import glob
import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from strandloom.llm import chat, linerules, mixing, queries, sharding


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, sf, name):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    rel = duck.sql(queries.SQL[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns and got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


def filled(store, rows, make):
    """An arrival for each 256 ids."""
    store.append(make(rows), F.shiftright("doc_id", 8))
    return store


def test_tiers(spark, make, tmp_path):
    rows = [(256 * i + j, "x" * (4000 if i == 5 else 100)) for i in range(12) for j in range(4)]
    store = filled(sharding.Store(spark, str(tmp_path / "s")), rows, make)
    store.compact(target=3000, fanout=2, base=100)
    out = store.read()
    by = {r[sharding.RUN]: (r.n_docs, r.n_bytes) for r in out.collect()}
    big = f"L0-{5:019d}"
    assert out.count() == 48 and sum(d for d, _ in by.values()) == 48
    assert by[big] == (4, 16000)  # already above the target, never merged
    assert all(b <= 2 * 3000 for s, (_, b) in by.items() if s != big) and len(by) < 12
    assert store.version() >= 2 and store.manifest(1).count() == 12
    assert {os.path.basename(p).split("=")[1] for p in glob.glob(str(tmp_path / "s/data/*/shard_run=*"))} == set(by)
    assert sorted(a for r in store.manifest().collect() for a in r.arrivals) == list(range(12))
    with pytest.raises(Exception):  # noqa: B017
        store.commit(store.manifest(1), store.version())
    assert store.manifest().count() == len(by)


def test_append_to_a_store(spark, make, tmp_path):
    store = sharding.Store(spark, str(tmp_path / "s"))
    store.append(make([(1, "a"), (300, "b")]), F.lit(7).cast("long"))
    store.append(make([(2, None)]), F.lit(8).cast("long"))
    assert store.version() == 2 and store.read().count() == 3
    assert store.compact(target=1000, fanout=2, base=10) == 1 and store.read().count() == 3 and store.manifest().count() == 1
    store.append(make([(1, "a"), (300, "b")]), F.lit(7).cast("long"))  # again, after its run was merged
    store.append(make([(1, "a"), (9, "new")]), F.when(F.col("doc_id") == 9, 9).otherwise(7).cast("long"))
    assert sorted(r.doc_id for r in store.read().collect()) == [1, 2, 9, 300]


def test_interrupted_writers(spark, make, tmp_path, monkeypatch):
    rows = [(256 * i + j, f"t{i}") for i in range(6) for j in range(4)]
    store = filled(sharding.Store(spark, str(tmp_path / "s")), rows, make)
    ids = sorted(r[0] for r in rows)
    own = sharding.Store.commit

    def lost(*_):
        raise RuntimeError("the writer dies before its commit")

    for work in (lambda: store.compact(1000, 2, 10), lambda: store.append(make([(5000, "x")]), F.lit(99))):
        monkeypatch.setattr(sharding.Store, "commit", lost)
        with pytest.raises(RuntimeError):
            work()
        monkeypatch.setattr(sharding.Store, "commit", own)
        assert store.version() == 1 and sorted(r.doc_id for r in store.read().collect()) == ids
    store.compact(1000, 2, 10)
    assert sorted(r.doc_id for r in store.read().collect()) == ids and store.manifest().count() == 1
    store.append(make([(5000, "x")]), F.lit(99))
    assert sorted(r.doc_id for r in store.read().collect()) == ids + [5000]
    assert store.vacuum() == 2 and store.vacuum() == 0 and store.read().count() == len(ids) + 1


def test_arrivals_do_not_hang_on_ids(make):
    rows = [(None, f"some text {i}") for i in range(300)] + [(i << 40, "x" * 50) for i in range(300)] + [(7, f"another {i}") for i in range(300)]
    out = sharding.sharded(make(rows), target=1 << 20, fanout=100).groupBy("shard").count().collect()
    assert len(out) == sharding.ARRIVALS_PER_TARGET and sum(r["count"] for r in out) == 900 and max(r["count"] for r in out) < 200


def test_shard_odd(spark, make, odd):
    clash = make(odd).withColumnRenamed("lang", "level").withColumnRenamed("source", "Shard_Run")
    out = sharding.sharded(clash)
    assert out.count() == len(odd) and {"level_", "Shard_Run_", "level"} <= set(out.columns)
    assert sharding.sharded(make([])).count() == 0


def talk(*turns):
    return [(i + 1, r, t) for i, (r, t) in enumerate(turns)]


def test_snapshots(spark):
    a, b, c, d = ("user", "hi"), ("bot", "yo"), ("user", "more"), ("user", None)
    logs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [b], 6: [a, c], 7: [d], 8: [("user", "")], 9: [a, b, d]}
    rows = [(k, *t) for k, v in logs.items() for t in talk(*v)] + [(3, 2, "bot", "yo"), (None, 1, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat.formatted(df.withColumn("n_turns", F.lit(0))).collect()}
    assert sorted(got) == [3, 5, 6, 7, 8, 9]
    assert got[3] == (3, "<|user|>\nhi\n<|end|>\n<|bot|>\nyo\n<|end|>\n<|user|>\nmore\n<|end|>\n")
    assert chat.formatted(df.limit(0)).count() == 0


def test_mixture_fits_marginals(spark, make):
    r = random.Random(1)
    rows = [(i, "word " * r.choice([5, 9, 200, 400]), r.choice(["en", "en", "fr", "de"]), r.choice(["hot"] * 6 + ["s1", "s2", "s3"]), 0) for i in range(900)]
    out = mixing.mixture(make(rows), power=0.3, rounds=40).collect()
    cells = {(r.source, r.lang, r.topic): r.weight for r in out}
    tokens = Counter()
    for r in out:
        tokens[r.source] += r.n_tokens
    want = {s: n**0.3 for s, n in tokens.items()}
    for s in tokens:
        share = sum(w for k, w in cells.items() if k[0] == s) / sum(cells.values())
        assert abs(share - want[s] / sum(want.values())) < 0.02
    assert max(r.probability for r in out) == 1 and all(r.kept for r in out if r.probability == 1)
    drawn = mixing.sampled(make(rows), power=0.5, budget=0.6)
    total = lambda df: df.agg(F.sum(F.length("text"))).first()[0]
    assert abs(total(drawn) / total(make(rows)) - 0.6) < 0.08 and drawn.columns == make([]).columns


def test_mixture_odd(make, odd):
    assert mixing.mixture(make(odd)).count() == len(odd)
    assert mixing.mixture(make([])).count() == 0
    none = make([(1, None, None, None, 0), (2, "", None, "s", 0)])
    assert [r.kept for r in mixing.mixture(none).collect()] == [False, False]
    clash = make(odd).withColumnsRenamed({"n_chars": "tokens"}).withColumns({"p": F.lit(1), "_p": F.lit(2), "kept": F.lit("x"), "weight": F.lit(0), "topic": F.lit("t"), "row": F.lit(3)})
    drawn = mixing.sampled(clash, budget=0.9)
    assert drawn.columns == clash.columns and {r.kept for r in drawn.collect()} == {"x"}


def test_stated_targets(spark, make):
    r = random.Random(2)
    rows = [(i, "word " * r.choice([5, 9, 200, 400]), r.choice(["en", "en", "fr", "de"]), r.choice(["hot"] * 6 + ["s1", "s2", "s3"]), 0) for i in range(900)]
    share = lambda **v: spark.createDataFrame(list(v.items()), "value string, share double")
    targets = {"source": share(hot=1.0, s1=1.0, s2=2.0, absent=9.0), "lang": share(en=0.2, fr=0.3, de=0.5)}
    got = {(r.marginal, r.value): r for r in mixing.fit(make(rows), rounds=60, targets=targets).collect()}
    want = {("source", "hot"): 0.25, ("source", "s1"): 0.25, ("source", "s2"): 0.5, ("source", "s3"): 0.0, ("lang", "en"): 0.2, ("lang", "fr"): 0.3, ("lang", "de"): 0.5}
    assert all(abs(got[k].target - v) < 1e-9 and abs(got[k].residual) < 1e-3 for k, v in want.items()) and ("source", "absent") not in got
    assert {r.source for r in mixing.sampled(make(rows), targets=targets).collect()} == {"hot", "s1", "s2"}


def test_mixture_keeps_rare_values(make):
    names = [f"s{i}" for i in range(40)] + ["other"]
    rows = [(100 * i + j, "word " * (5 + i), "en" if j % 2 else "fr", s, 0) for i, s in enumerate(names) for j in range(4)]
    cells = {(r.source, r.lang, r.topic): r.weight for r in mixing.mixture(make(rows), power=0.0).collect()}
    for s in names:  # equal targets for all 41 sources
        assert abs(sum(w for k, w in cells.items() if k[0] == s) - 1 / 41) < 1e-6


def brute_rules(text):
    w = (text or "").encode().split()
    w = [x.decode() for x in w]
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(runs)
    covered = {j for i, r in enumerate(runs) if count[r] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules(make, odd):
    rows = odd + [(20, "a b c a b c x y\na b\n\na b\n \n#$|"), (21, "a a a a a"), (22, "x\x1cy z")]
    got = linerules.quality_rules(make(rows)).collect()
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(((i, *brute_rules(t)) for i, t in rows), key=key)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert linerules.quality_rules(make([])).count() == 0


def test_frequent_lines(make):
    own = lambda i, n=60: " ".join(f"w{i}x{j}" for j in range(n))
    banner = own("b", 55)
    rows = [(i, f"{banner.upper() if i % 2 else banner}\n{own(i, 60 if i < 10 else 3)}", "en", "host", 0) for i in range(30)] + [(100, banner, "en", "elsewhere", 0)] + [(200 + i, own("copy"), "en", "host", 0) for i in range(50)]
    got = {r.doc_id: r for r in linerules.quality_rules(make(rows), least=20).collect()}
    assert all(got[i].kept == (i < 10) and got[i].n_removed_words == 55 for i in range(30))
    assert got[100].kept and got[200].kept  # another host; copies count once
    texts = {r.doc_id: r.text for r in linerules.without_frequent_lines(make(rows), least=20).collect()}
    assert texts[3] == own(3) and texts[100] == banner


def test_frequent_lines_of_repeated_rows(make):
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    banner = own("b", 45)
    text = lambda i: f"{banner}\n{own(i, 55)}"
    rows = [(i, text(i), "en", "host", 0) for i in range(30)] + [(1, text(1), "en", "host", 0)] + [(None, text("null"), "en", "host", 0)] * 3
    got = linerules.quality_rules(make(rows), least=20).collect()
    assert len(got) == 34 and all(r.n_removed_words == 45 and r.kept for r in got)


def test_repeats_of_long_texts(spark):
    """Six million different words; and one window that stands twice in a text of 100,000 words."""
    n = 6_000_000
    numbers = lambda k: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ")
    docs = spark.range(2).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, numbers(n)).otherwise(F.concat(numbers(100_000), F.lit(" w5 w6 w7"))).alias("text"), F.lit("s").alias("source"))
    got = {r.doc_id: (r.n_words, r.n_repeat_words) for r in linerules.quality_rules(docs).collect()}
    assert got == {0: (n, 0), 1: (100_003, 6)}
