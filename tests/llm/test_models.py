"""Classifiers: held-out accuracy, folding, exceptions, odd inputs."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import quality, toxicity
from strandloom.llm.runtime import read

SF = "/root/testdata/sf0.1"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize("name, threshold, least", [("toxic", 0.5, 0.97), ("quality", 0.3, 0.97)])
def test_held_out(spark, name, threshold, least):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    module = toxicity if name == "toxic" else quality
    scored = {r.doc_id: r for r in module.score(docs, module.fit(docs, labels)).collect()}
    truth = {r.doc_id: r[name] for r in labels.collect()}
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for i, r in scored.items())
    right = [scored[i].predicted == y for i, y in truth.items() if held(i)]
    assert len(right) > 500 and np.mean(right) >= least


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    other = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, other)
    assert (quality.fit(docs, labels)[0] == quality.fit(docs, other)[0]).all()


def test_folding():
    table = toxicity.fold_table()
    same = {toxicity.fold(t, table) for t in ("Loser", "l0ser", "1OSER", "lоser", "ＬＯＳＥＲ", "lo​ser", "lo$er")}
    assert len(same) == 1
    assert toxicity.fold("word$$$ a@", table).split() == ["word", "a"]


def test_matches():
    table = toxicity.fold_table()
    f = lambda t: toxicity.fold(t, table)
    m = toxicity.Matcher({"w=" + f("trash"): 5.0, "p=" + f("vequ"): 3.0}, [f("trash can")])
    found = lambda t: [f(t)[h[0] : h[1]] for h in m.found(f(t))]
    assert found("tra5h, Trashy trash can (trash)") == ["trash", "trash"]
    assert found("vequ vequance unvequa") == ["vequ"]
    assert toxicity.Matcher({}, []).found("x") == []


def test_learned_exceptions(spark):
    texts = [("you scum here", 1)] * 9 + [("pond scum is green", 0)] * 9 + [("nothing at all", 0)] * 200
    free = [i for i in range(1000) if not held(i)]
    docs = spark.createDataFrame([(i, f"{t} {i}") for i, (t, _) in zip(free, texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in zip(free, texts)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, purity=2.0)
    assert "pond scum" in model["exceptions"] and "scum here" not in model["exceptions"]
    got = {r.text.split()[0]: r.score for r in toxicity.score(docs, model).join(docs, "doc_id").collect()}
    assert got["you"] > 0.5 > max(got["pond"], got["nothing"])


def test_scores_follow_from_the_parts(spark):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    model, table = toxicity.fit(docs, labels), toxicity.fold_table()
    lexicon, exceptions = model["lexicon"], model["exceptions"]

    def plain(text):
        """Every word and stem looked up on its own, without the automaton."""
        folded, total = toxicity.fold(text or "", table), 0.0
        free = [(m.start(), m.end()) for p in exceptions for m in re.finditer(rf"(?<!\w)(?={re.escape(p)}(?!\w))", folded) for m in [re.compile(re.escape(p)).match(folded, m.start())]]
        for m in re.finditer(r"\w+", folded):
            w = m[0]
            kinds = [(lexicon.get("w=" + w, 0), len(w))] + [(lexicon.get("p=" + w[:n], 0), n) for n in toxicity.STEMS if len(w) > n]
            weight, size = max(kinds)
            if weight and not any(a <= m.start() and m.start() + size <= b for a, b in free):
                total += weight
        a, b = np.log1p(total), np.log1p(100 * total / (folded.count(" ") + folded.count("\n") + 20))
        return 1 / (1 + np.exp(-np.clip(model["curve"] @ np.array([a, b, 1.0]), -30, 30)))

    scored = toxicity.score(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert max(abs(r.score - plain(r.text)) for r in scored) < 1e-9 and any(r.predicted for r in scored)


@pytest.mark.parametrize("module, name", [(toxicity, "toxic"), (quality, "quality")])
def test_odd(spark, make, odd, module, name):
    docs = make(odd)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, 1, 1), (None, 1, 1), (7, None, None), (9, 1, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        rows = module.score(docs, module.fit(docs, given)).collect()
        assert len(rows) == len(odd) and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert module.score(make([]), module.fit(make([]), labels)).count() == 0


def test_quality_scores_follow_from_features(spark, make, odd):
    """Scores against the plain sum over a text's features; equal texts score alike in any batch."""
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    values, bias = model = quality.fit(docs, labels)
    rows = [(10_000 + r.doc_id, r.text) for r in docs.select("doc_id", "text").limit(200).collect()] + odd + [(5000 + i, odd[5][1]) for i in range(3)]
    both = make(rows).repartition(3)
    want = {t: 1 / (1 + np.exp(-(float(w.astype(np.float64) @ values[s]) + bias))) for (_, t), (s, w) in zip(rows, quality.features(pa.array([t for _, t in rows], pa.string())))}
    texts = both.select("doc_id", "text").withColumnRenamed("text", "t").distinct()
    got = quality.score(both, model).join(texts, "doc_id").collect()
    by = {}
    for r in got:
        if r.doc_id != 8:  # that id stands on two texts
            by.setdefault(r.t, set()).add(r.score)
            assert abs(r.score - want[r.t]) < 1e-6
    assert all(len(v) == 1 for v in by.values())


def test_subwords():
    raw = np.frombuffer("abc né x".encode(), np.uint8)
    starts, ends = np.array([0, 4, 8]), np.array([3, 7, 9])
    slots, count = quality.subwords(raw, starts, ends)
    assert count.tolist() == [1 + 3 + 2, 1 + 2 + 1, 1 + 1] and len(slots) == count.sum()
