"""Structures: energies and pair probabilities against all structures written out, z-scores against plain Python."""

import math
from itertools import product

import numpy as np
import pytest

from strandloom.operators import folding, sampling
from strandloom.operators.folding import WEIGHTS, Batch, Model


def structures(seq, model, i=0, j=None):
    """All structures of seq[i:j] as lists of pairs."""
    j = len(seq) if j is None else j
    if i >= j:
        yield []
        return
    for rest in structures(seq, model, i + 1, j):
        yield rest
    for k in range(i + model.loop + 1, min(j, i + model.span)):
        if worth(seq[i], seq[k]):
            for a in structures(seq, model, i + 1, k):
                for b in structures(seq, model, k + 1, j):
                    yield [(i, k), *a, *b]


def worth(a, b):
    return WEIGHTS.get((a + b).upper(), WEIGHTS.get((b + a).upper(), 0))


def expected(seq, model):
    best, total, pairs = 0.0, 0.0, {}
    for s in structures(seq, model):
        w = sum(worth(seq[i], seq[j]) for i, j in s)
        best = max(best, w)
        total += math.exp(w / model.temperature)
        for p in s:
            pairs[p] = pairs.get(p, 0.0) + math.exp(w / model.temperature)
    return best, {p: v / total for p, v in pairs.items()}


def found(seqs, model):
    out = [{} for _ in seqs]
    for which, i, j, p in Batch([folding.letters(s) for s in seqs], model, True).pairs():
        for w, a, b, v in zip(which, i, j, p):
            out[w][int(a), int(b)] = out[w].get((int(a), int(b)), 0.0) + float(v)
    return out


def check(seqs, model):
    best = Batch([folding.letters(s) for s in seqs], model, False).best()
    for s, b, own in zip(seqs, best, found(seqs, model)):
        want, pairs = expected(s, model)
        assert b == want, (s, model)
        assert own.keys() == pairs.keys() and all(abs(own[p] - pairs[p]) < 1e-9 for p in pairs), (s, model)


@pytest.mark.parametrize("model", [Model(20, 0), Model(20, 1), Model(3, 0), Model(4, 1), Model(2, 0), Model(5, 3), Model(2, 3)])
def test_all_short_sequences(model):
    seqs = ["".join(s) for n in range(6) for s in product("ACGT", repeat=n)]
    check(seqs, model)


def test_longer_sequences_and_odd_letters():
    random = np.random.default_rng(4)
    seqs = ["".join(random.choice(list("ACGTUacgN-"), int(n))) for n in random.integers(0, 15, 40)] + ["GGGGAAACCCC", "né漢GAAC", "GCGCAAAGCGC"]
    for model in (Model(8, 2), Model(12, 3), Model(40, 1, temperature=2.5)):
        check(seqs, model)


def test_tiles(monkeypatch):
    random = np.random.default_rng(5)
    seq, model = "".join(random.choice(list("ACGT"), 700)), Model(24, 3)
    best, pairs = Batch([folding.letters(seq)], model, False).best()[0], found([seq], model)[0]
    together = found(["ACG", seq, "", seq[:90]], model)
    for size in (1, 7, 100, 699):
        if size == 1 and len(seq) > 200:
            continue
        monkeypatch.setattr(folding, "TILE", size)
        assert Batch([folding.letters(seq)], model, False).best()[0] == best
        again = found([seq], model)[0]
        assert again.keys() == pairs.keys() and all(abs(again[p] - pairs[p]) < 1e-9 for p in pairs)
    assert together[1].keys() == pairs.keys() and all(abs(together[1][p] - pairs[p]) < 1e-9 for p in pairs)
    assert not together[0] and not together[2]


def test_long_sequence_is_linear_and_finite():
    seq = "".join(np.random.default_rng(6).choice(list("ACGT"), 100_000))
    total = np.zeros(len(seq))
    for _, i, j, p in Batch([folding.letters(seq)], Model(16, 3), True).pairs():
        total += np.bincount(i, p, len(seq)) + np.bincount(j, p, len(seq))
    assert np.isfinite(total).all() and 0 < total.min() + 1e-300 and total.max() <= 1 + 1e-6


def test_model():
    with pytest.raises(ValueError):
        Model(1)
    with pytest.raises(ValueError):
        Model(8, weights=(("AT", -1.0),))
    with pytest.raises(ValueError):
        Model(1000).table(True)


def test_rows(spark):
    model = Model(12, 2)
    texts = [(1, "GGGAAACCCATGC"), (2, None), (3, ""), (4, "ACGGTTACGGA"), (5, "AAAA"), (6, "né漢")]
    rows = spark.createDataFrame(texts, "id long, seq string").repartition(3)
    known = {i: expected(s, model) for i, s in texts if s is not None}
    assert {r.id: r.energy for r in folding.energies(rows, ["id"], "seq", model).collect()} == {i: -b for i, (b, _) in known.items()}
    pairs = {(r.id, r.i, r.j): r.p for r in folding.pair_probabilities(rows, "id", "seq", model).collect()}
    want = {(i, *p): v for i, (_, ps) in known.items() for p, v in ps.items()}
    assert pairs.keys() == want.keys() and all(abs(pairs[p] - want[p]) < 1e-9 for p in want)
    at = {(r.id, r.pos): r.p for r in folding.position_marginals(rows, "id", "seq", model).collect()}
    assert at.keys() == {(i, k) for i, s in texts for k in range(len(s or ""))}
    assert all(abs(v - sum(p for (i, a, b), p in want.items() if i == key[0] and key[1] in (a, b))) < 1e-9 for key, v in at.items())
    assert folding.energies(rows.limit(0), ["id"], "seq", model).count() == 0

    z = {r.id: (r.energy, r.z) for r in folding.energy_z(rows, "id", "seq", 7, 2, 3, model).collect()}
    drawn = {}
    for r in sampling.klet_shuffle(rows, "id", "seq", 2, 7, 3).collect():
        if r.shuffled is not None:
            drawn.setdefault(r.id, []).append(-expected(r.shuffled, model)[0])
    assert z.keys() == drawn.keys() == known.keys()
    for i, (energy, score) in z.items():
        mean, deviation = np.mean(drawn[i]), np.std(drawn[i])
        assert energy == -known[i][0]
        assert score is None if deviation == 0 else abs(score - (energy - mean) / deviation) < 1e-9
