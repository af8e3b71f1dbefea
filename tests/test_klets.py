"""Shuffles that keep k-lets: counts, uniformity, one preparation for many draws, time."""

import time
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.operators import sampling


def counts(s, k):
    return Counter(s[i : i + k] for i in range(len(s) - k + 1))


@pytest.mark.parametrize("k", [1, 2, 3, 4, 6, 50])
def test_counts_stay(k):
    random = np.random.default_rng(3)
    for seq in ("", "A", "AB", "GATTACA", "AAAAAAA", "ACGT" * 9 + "TTGACA", "né漢字né字漢né" * 3, "".join(random.choice(list("ACGTN"), 500))):
        own = sampling.Klets(seq, k)
        for _ in range(5):
            got = own.draw(random)
            assert counts(got, k) == counts(seq, k) and Counter(got) == Counter(seq)
            assert k == 1 or got[: k - 1] == seq[: k - 1] and got[len(got) - k + 1 :] == seq[len(seq) - k + 1 :]


@pytest.mark.parametrize("seq, k", [("ABACABCA", 2), ("AABABBA", 2), ("ABCABDABCB", 3)])
def test_all_shuffles_are_as_likely(seq, k):
    every = {"".join(p) for p in set(permutations(seq)) if counts("".join(p), k) == counts(seq, k)} if len(seq) < 9 else None
    own, random, n = sampling.Klets(seq, k), np.random.default_rng(11), 6000
    found = Counter(own.draw(random) for _ in range(n))
    assert every is None or set(found) == every
    mean = n / len(found)
    assert sum((c - mean) ** 2 / mean for c in found.values()) < len(found) + 5 * (2 * len(found)) ** 0.5


def test_trees_are_uniform():
    """Last exits towards the last node: each spanning tree as often as the product of its edges' multiplicities asks for."""
    own, random, n = sampling.Klets("ABCACBABCA", 2), np.random.default_rng(5), 8000
    names = "ABC"
    trees = Counter(tuple(int(own.target[e]) if e >= 0 else -1 for e in own.last_exits(random)) for _ in range(n))
    edges, weight = counts("ABCACBABCA", 2), {}
    for b in "AC":
        for c in "AB":
            tree = {"B": b, "C": c}
            if not (b == "C" and c == "B"):
                weight[-1, names.index(b), names.index(c)] = edges["B" + b] * edges["C" + c]
    total = sum(weight.values())
    assert set(trees) == {t for t, w in weight.items() if w}
    assert all(abs(trees[t] - n * w / total) < 5 * (n * w / total) ** 0.5 for t, w in weight.items())


def test_time_is_linear():
    seq = "".join(np.random.default_rng(1).choice(list("ACGT"), 400_000))
    for k in (2, 4):
        began = time.time()
        sampling.Klets(seq[:100_000], k).draw(np.random.default_rng(2))
        short = time.time() - began
        began = time.time()
        sampling.Klets(seq, k).draw(np.random.default_rng(2))
        assert short < 1 and time.time() - began < 8 * short + 0.5


def test_rows(spark):
    rows = spark.createDataFrame([(1, "GATTACA" * 9), (2, None), (3, ""), (4, "né漢né漢")], "id long, seq string")
    got = {(r.id, r.draw): r.shuffled for r in sampling.klet_shuffle(rows, "id", "seq", 2, 3).collect()}
    again = {(r.id, r.draw): r.shuffled for r in sampling.klet_shuffle(rows.repartition(3), "id", "seq", 2, 4).collect()}
    assert len(got) == 12 and got == {k: v for k, v in again.items() if k[1] < 3}
    assert got[2, 0] is None and got[3, 1] == "" and counts(got[1, 2], 2) == counts("GATTACA" * 9, 2)
    assert len({got[1, d] for d in range(3)}) == 3


def test_klets(spark):
    row = spark.createDataFrame([("GATTé",)], "s string").select(*(S.klets(F.col("s"), k).alias(f"k{k}") for k in (1, 2, 5, 6))).first()
    assert list(row) == [list("GATTé"), ["GA", "AT", "TT", "Té"], ["GATTé"], []]
    began = time.time()
    assert spark.range(1).select(F.size(S.klets(F.repeat(F.lit("ACGT"), 100_000), 2)).alias("n")).first().n == 399_999
    assert time.time() - began < 10
