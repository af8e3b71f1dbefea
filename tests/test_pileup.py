"""Pileup against a walk over each read."""

import random
from collections import Counter

from strandloom.operators.pileup import MASK, pileup
from strandloom.operators.reads import blocks, cigar

READS = "seqname string, pos long, flag int, mapq int, cigar array<struct<op:string,len:int>>, seq string, qual string, sample string"


def some(n, seed=1):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        walk = [(r.choice("MMMIDNSHP=X"), r.randint(1, 6)) for _ in range(r.randint(0, 7))]
        size = sum(k for op, k in walk if op in "MIS=X")
        seq = r.choice(["".join(r.choice("ACGTNacgtRy") for _ in range(size))] * 6 + [None])
        out.append((r.choice("ab"), r.randrange(30), r.choice([0, 16, 0, 4, 256, 1024, 512, 2048]), r.randrange(60), walk, seq, r.choice(["".join(chr(33 + r.randrange(40)) for _ in range(size)), None]), r.choice(["x", "y", None])))
    return [*out, (None, 5, 0, 9, [("M", 3)], "ACG", "III", "x"), ("a", None, 0, 9, [("M", 3)], "ACG", "III", "x"), ("a", 3, 0, None, [("M", 5)], "ACG", "III", "x"), ("a", 3, 0, 50, None, "ACG", "III", "x")]


def expected(rows, quality, mapq, mask):
    count = Counter()
    for name, pos, flag, mq, walk, seq, qual, sample in rows:
        if name is None or pos is None or seq is None or flag & mask or (mq or 0) < mapq:
            continue
        at, q = pos, 0
        for op, n in walk or []:
            for i in range(n):
                if op in "M=X" and q + i < len(seq) and (qual is None or q + i >= len(qual) or ord(qual[q + i]) - 33 >= quality):
                    b = seq[q + i].upper()
                    count[name, at + i, sample, b if b in "ACGT" else "N"] += 1
                if op == "D":
                    count[name, at + i, sample, "del"] += 1
            if op == "I" and at > pos:
                count[name, at - 1, sample, "ins"] += 1
            at += n * (op in "MDN=X")
            q += n * (op in "MIS=X")
    kinds = ["A", "C", "G", "T", "N", "del", "ins"]
    return sorted(((*k, sum(count[*k, x] for x in kinds[:-1]), *(count[*k, x] for x in kinds)) for k in {c[:3] for c in count}), key=str)


def test_pileup(spark):
    rows = some(600)
    df = spark.createDataFrame(rows, READS)
    for quality, mapq, mask in ((0, 0, MASK), (20, 0, MASK), (13, 30, 4)):
        got = pileup(df, "sample", min_quality=quality, min_mapq=mapq, mask=mask)
        assert sorted(map(tuple, got.collect()), key=str) == expected(rows, quality, mapq, mask)
    assert sum(r.depth for r in pileup(df).collect()) == sum(r[3] for r in expected(rows, 0, 0, MASK))
    assert pileup(df.limit(0)).count() == 0


def test_long_walks(spark):
    """Blocks of a read of many elements lie where a running sum puts them."""
    text = "3M1D2M7N" * 2000
    got = blocks(spark.createDataFrame([(100, text)], "pos long, t string").select("pos", cigar("t").alias("cigar")), "M").orderBy("i").collect()
    assert [(r.i, r.start, r.end) for r in got] == [(4 * k + 2 * j, 100 + 13 * k + 4 * j, 100 + 13 * k + 4 * j + (3, 2)[j]) for k in range(2000) for j in (0, 1)]
