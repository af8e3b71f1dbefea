"""Sequence functions and seeded random operators."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.operators import sampling
from strandloom.operators import reads as R

# The transition table of the two-base code.
NEXT = {"A": "ACGT", "C": "CATG", "G": "GTAC", "T": "TGCA"}


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_dibase(spark):
    r = random.Random(1)
    reads = ["T" + "".join(r.choice("0123") for _ in range(20)) for _ in range(20)] + ["A01.23", "G", "C..1"]
    got = [x.y for x in spark.createDataFrame([(c,) for c in reads], "x string").select(S.dibase_decode(F.col("x")).alias("y")).collect()]
    for colors, bases in zip(reads, got):
        out = colors[0]
        for c in colors[1:]:
            out += NEXT[out[-1]][int(c)] if out[-1] in NEXT and c in "0123" else "N"
        assert bases == out


def test_small_functions(spark):
    assert one(spark, "ACGTNacgtRY", S.reverse_complement) == "RYacgtNACGT"
    assert one(spark, "A" * 161, lambda x: S.wrap(x, 80)).split("\n") == ["A" * 80, "A" * 80, "A"]
    assert one(spark, "A" * 160, lambda x: S.wrap(x, 80)).count("\n") == 1
    assert one(spark, "ACGTACGT", lambda x: S.fetch(x, F.lit(2), F.lit(4))) == "GTA"
    assert one(spark, "ACGTACGT", lambda x: S.fetch(x, F.lit(-3), F.lit(99), F.lit("-"))) == "ACGTACGT"
    assert one(spark, "GGNNAA", S.gc_fraction) == 0.5 and one(spark, "", S.gc_fraction) is None
    assert one(spark, "TAGTAATGATAG", S.stop_codons) == 4
    assert one(spark, "T0123.", S.double_encode) == "CGTN"
    assert one(spark, [5, -1, 3], S.quality_text, "array<int>") == "&!$"
    assert one(spark, [5, 1, 3], S.pair_sums, "array<int>") == [6, 4, 3]
    assert one(spark, "T0120.0", S.color_tail) == 2 and one(spark, "T000", S.color_tail) == -1
    assert [one(spark, n, S.to_ucsc) for n in ("1", "12a", "100", "X", "MT", "NT_random", "GL1")] == ["chr1", "chr12a", "100", "chrX", "chrM", "chrNT_random", "GL1"]
    assert [one(spark, n, S.alignment_to_ucsc) for n in ("007", "MT2", "X")] == ["chr7", "chrM", "X"]
    assert [one(spark, n, S.score_to_phred) for n in ("1e-5", "0.5", "17", ".", "-1.0", "x", "0.0")] == [50, 3, 17, 0, 0, 0, 0]
    assert one(spark, "10M5I20N3=2X", R.cigar) == [("M", 10), ("I", 5), ("N", 20), ("M", 3), ("M", 2)]


def test_shuffle_keeps_counts():
    r = random.Random(2)
    for n, k in [(0, 2), (1, 2), (30, 1), (50, 2), (80, 3), (200, 2), (40, 4)]:
        seq = "".join(r.choice("ACG") for _ in range(n))
        seen = set()
        for draw in range(20):
            out = sampling.shuffled(seq, k, np.random.default_rng([1, draw]))
            for m in range(1, k + 1):
                count = lambda s: Counter(s[i : i + m] for i in range(len(s) - m + 1))  # noqa: B023, E731
                assert count(out) == count(seq)
            seen.add(out)
        assert n < 30 or len(seen) > 1


def test_resample_and_random(spark):
    lines = spark.range(103).select(F.col("id").alias("ord"))
    rows = sampling.resample(lines, 40, 4).collect()
    assert len(rows) == 160 and max(r.ord for r in rows) < 100
    assert rows == sampling.resample(lines, 40, 4).collect()
    assert sampling.resample(lines.limit(0), 5, 2).count() == 0
    seqs = sampling.random_sequences(spark, 3, 4000, 0.8).collect()
    assert all(abs(sum(c in "GC" for c in r.seq) / 4000 - 0.8) < 0.05 for r in seqs)
    assert all(max(map(len, r.wrapped.split("\n"))) == 80 for r in seqs)


def test_hamming(spark):
    r = random.Random(3)
    seqs = ["".join(r.choice("AC") for _ in range(5)) for _ in range(60)]
    got = {x.key: (x.n, x.neighbours) for x in R.hamming_counts(spark.createDataFrame([(s,) for s in seqs], "s string"), F.col("s"), 4, 2).collect()}
    counts = Counter(s[:4] for s in seqs)
    far = lambda a, b: sum(x != y for x, y in zip(a, b))
    assert got == {a: (n, sum(m for b, m in counts.items() if 0 < far(a, b) <= 2)) for a, n in counts.items()}


def test_numbers_are_printed_as_c_does(spark):
    values = [100005.0, 100015.0, 1.000005, 2.5e-7, 0.125, 1e300, -3.00005, float("inf"), None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", S.scientific(F.col("x"), 4).alias("e"), S.fixed(F.col("x"), 2).alias("f"), S.fixed(F.col("x"), 5).alias("g"))
    got = [tuple(r)[1:] for r in rows.orderBy("i").collect()]
    assert got == [(None,) * 3 if x is None else ("%.4e" % x, "%.2f" % x, "%.5f" % x) for x in values]
    assert got[0][0] == "1.0000e+05" and got[4][1] == "0.12"
