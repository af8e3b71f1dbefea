"""Decontamination and the pipeline against brute force."""

import hashlib
import random
import re
import tracemalloc

import duckdb
import pyarrow as pa

import corpus_pipeline
from strandloom.llm import decontaminate, neardup, sharding, toxicity
from strandloom.llm.runtime import read

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, window=13):
    known = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            known.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in known}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in known:
                    found |= known[tuple(w[s : s + n])]
                    hit |= set(range(s, s + n))
        listed = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((i, len(w), len(hit), len(found - {None}), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination(spark, make, odd):
    items = [(1, " ".join(f"q{i}" for i in range(40))), (2, "Short ITEM"), (3, None), (4, ""), (5, "one"), (None, "same id other"), (6, " ".join(f"q{i}" for i in range(10, 30))), (2, "Short ITEM")]
    rows = odd + [(30, "x " + " ".join(f"Q{i}," for i in range(5, 35)) + " y"), (31, "a short-item! here, ONE"), (32, " ".join(f"q{i}" for i in range(12))), (33, "q0 " * 50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = sorted(((i, t) for i, t in rows if not brute([(i, t)], items)[0][5]), key=str)
    for block in (decontaminate.BLOCK_BYTES, 30, 1):
        got = decontaminate.digest(decontaminate.contamination(make(rows), bench, block_bytes=block)).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, items)
        left = decontaminate.remove_contaminated(make(rows), bench, block_bytes=block).collect()
        assert sorted(((r.doc_id, r.text) for r in left), key=str) == clean  # every row by its own text, null ids too
    assert decontaminate.contamination(make([]), bench).count() == 0
    assert not any(r.n_hit for r in decontaminate.contamination(make(rows), bench.limit(0)).collect())


def test_blocks_judge_rows_alike(spark, make, odd):
    items = [(1, " ".join(f"q{i}" for i in range(40))), (5, "one"), (None, "same id other"), (6, " ".join(f"p{i}" for i in range(30)))]
    rows = odd + [(None, "x q1 " + items[0][1]), (None, items[3][1]), (40, "one"), (40, "clean"), (41, items[0][1] + " " + items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((t for i, t in rows if not brute([(i, t)], items)[0][5]), key=str)
    for block in (decontaminate.BLOCK_BYTES, 30):
        left = decontaminate.remove_contaminated(make(rows), bench, block_bytes=block)
        assert left.columns == make(rows).columns and sorted((r.text for r in left.collect()), key=str) == want
    assert decontaminate.remove_contaminated(make([]), bench, block_bytes=30).count() == 0


def test_matches_are_longest(spark, make):
    item = [f"q{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = make([(9, " ".join(["a"] + item[3:20] + ["b"] + item[20:40]))])
    got = decontaminate.benchmark_matches(docs, bench).collect()
    assert sorted((m.item_start, m.doc_start, m.n_words) for m in got) == [(3, 1, 17), (20, 19, 20)]
    assert decontaminate.contamination(docs, bench).first().n_hit == 37


def brute_matches(rows, items, window):
    out = []
    for d, t in rows:
        for i, u in items:
            a, b = words(t), words(u)
            least = min(window, len(b))
            for p in range(len(a)):
                for q in range(len(b)):
                    n = 0
                    while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                        n += 1
                    if n >= least > 0 and (least < window or not (p and q and a[p - 1] == b[q - 1])):
                        out.append((d, i, q, p, n))
    return sorted(out, key=str)


def test_matches_of_few_words(spark, make):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    rows, items = [(i, text(r.randrange(40))) for i in range(30)] + [(None, "a b a"), (5, None)], [(i, text(r.randrange(20))) for i in range(15)] + [(None, "c c c c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 100):
        got = decontaminate.benchmark_matches(make(rows), bench, window=4, block_bytes=block).collect()
        assert sorted(map(tuple, got), key=str) == brute_matches([(d, t) for d, t in rows], items, 4)


def test_equal_words_are_linear():
    """A text and an item of 20,000 equal words: memory by words, not by pairs."""
    n = 20_000
    column = pa.array(["same " * n, "one other text"])
    words_of, first = decontaminate._words(column)
    block = decontaminate.test_side([1], [words_of[:n].tobytes()])
    tracemalloc.start()
    test = decontaminate.test_suffixes(block, 13)
    doc, start, stop, holder, item = decontaminate.shard_hits(test, words_of, first)
    matches = decontaminate.shard_matches(test, words_of, first)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (doc.tolist(), start.tolist(), stop.tolist(), holder.tolist(), item.tolist()) == ([0], [0], [n], [0], [1])
    assert len(matches[0]) == 2 * (n - 12) - 1 and peak < 200 << 20


def brute_mixture(rows, power=0.9, budget=0.9, rounds=12):
    """The ids that the mixing stage draws, with plain loops."""
    cells, size = {}, {}
    for r in rows:
        t, n = r.text or "", len(r.text or "")
        bars, digits = (n - len(re.sub(p, "", t)) for p in (r"\|+", r"[0-9]+"))
        topic = "listing" if bars * 50 > n else "numeric" if digits * 20 > n else "brief" if n < 600 else "prose"
        cells[r.doc_id] = (r.source or "", r.lang or "", topic)
        size[r.doc_id] = len(t.encode().split())
    mass = {}
    for i, c in cells.items():
        mass[c] = mass.get(c, 0) + size[i]
    mass = {c: float(n) for c, n in mass.items() if n}
    total = lambda w, k: {v: sum(x for c, x in w.items() if c[k] == v) for v in {c[k] for c in w}}
    target = []
    for k in range(3):
        power_of = {v: n**power for v, n in total(mass, k).items()}
        target.append({v: n / sum(power_of.values()) for v, n in power_of.items()})
    weight = dict(mass)
    for _ in range(rounds):
        for k in range(3):
            now = total(weight, k)
            weight = {c: w * target[k][c[k]] / now[c[k]] for c, w in weight.items()}
    rate = {c: weight[c] / mass[c] for c in mass}
    low, high = 0.0, 1 / min(rate.values())
    for _ in range(200):  # the scale at which the expected tokens are the budget's
        middle = (low + high) / 2
        kept = sum(n * min(1, rate[c] * middle) for c, n in mass.items())
        low, high = (middle, high) if kept < budget * sum(mass.values()) else (low, middle)
    draw = lambda i: int(hashlib.md5(f"{i}/mix".encode()).hexdigest()[:12], 16) / 2**48
    return {i for i, c in cells.items() if draw(i) < min(1, rate.get(c, 0) * high)}


def test_stages(spark, sf, tmp_path):
    docs = read(spark, sf, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    texts = {i: r.text for i, r in before.items()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "toxicity":
            model = toxicity.fit(docs, read(spark, sf, "labels"))
            want = {r.doc_id for r in toxicity.score(docs, model).collect() if not r.predicted}
        elif name == "near_duplicates":
            want = {r.doc_id for r in neardup.near_duplicates(docs, 5).collect() if r.kept}
            clear = set(ids)
            shingles = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i in clear for w in [texts[i].lower().encode().split()]}
            assert all(100 * len(shingles[a] & shingles[b]) < 80 * len(shingles[a] | shingles[b]) for a in want for b in want if a < b and shingles[a])
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in read(spark, sf, "benchmark").collect()]
            want = {r[0] for r in brute([(i, texts[i]) for i in ids], items) if not r[5]}
        elif name == "mixing":
            want = brute_mixture(docs.collect())
        else:
            want = set(ids)
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert set(got) <= set(ids) and (k == 4 or docs.columns == columns)
    columns = ["doc_id", "shard", "level", "shard_docs", "shard_bytes"]
    duck = duckdb.sql(f"WITH documents AS (FROM '{tmp_path}/mixing/*.parquet') SELECT * FROM ({sharding.sql()})").project(", ".join(columns)).fetchall()
    assert sorted(duck) == sorted(tuple(r[c] for c in columns) for r in docs.collect())
    assert all(r.text == before[r.doc_id].text for r in docs.collect())
    assert corpus_pipeline.run(spark, sf).count() == len(got)


def test_stages_on_odd_rows(spark, make, odd, tmp_path):
    """Nulls in every column, empty, repeated and contaminated rows, and an empty table."""
    item = " ".join(f"q{i}" for i in range(30))
    rows = [(*r, "en", "src", 1) for r in odd] + [(None, None, None, None, None), (50, item, None, None, 5), (51, "a trash text " * 9, "en", None, 5), (52, "clean words only here", None, "s", 5)]
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(51, 0, 1), (52, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, table in (("some", make(rows)), ("none", make([]))):
        table.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept = {}
        for stage, f in corpus_pipeline.STAGES:
            f(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{name}-{stage}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}-{stage}"))
            kept[stage] = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "none":
            assert not any(kept.values())
            continue
        assert (50, item) in kept["near_duplicates"] and (50, item) not in kept["decontamination"]
        long = [t for i, t in kept["near_duplicates"] if i in (5, 6)]
        assert len(long) == 1 and (None, None) in kept["decontamination"] and (2, "") in kept["decontamination"]
        assert sorted(kept["mixing"], key=str) == sorted(kept["sharding"], key=str)


def test_sharding_module_is_last():
    assert corpus_pipeline.STAGES[-1][1].__name__ == "shard" and sharding.TARGET_BYTES == 128 << 20
