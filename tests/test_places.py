"""Bases at places of a genome: each place is looked up once, in the order of the exons."""

import pandas as pd
from pyspark.sql import functions as F

from strandloom.operators import annotation as A

EXONS = "transcript_id string, gene_id string, seqname string, strand string, start long, end long"
TEXT = "ACGTTAGNCTAAGGTGACC"


def genome(spark, width=3):
    return spark.createDataFrame([("c", i, TEXT[i : i + width]) for i in range(0, len(TEXT), width)], "seqname string, chunk_start long, seq string")


def test_overlapping_exons_stay_whole(spark):
    exons = spark.createDataFrame([("a", "g", "c", "+", 0, 4), ("a", "g", "c", "+", 1, 6), ("b", "g", "c", "-", 2, 5), ("n", "g", "none", "+", 0, 4)], EXONS)
    got = {r.transcript_id: r.seq for r in A.spliced_sequences(exons, genome(spark), width=3).collect()}
    assert got == {"a": TEXT[0:4] + TEXT[1:6], "b": TEXT[2:5][::-1].translate(str.maketrans("ACGT", "TGCA"))}


def test_equal_places_are_one_lookup(spark):
    rows = [(f"t{i}", "g", "c", "+-"[i % 2], s, e) for i in range(40) for s, e in ((0, 4), (9, 12), (17, 19))] + [("none", "g", "x", "+", 0, 2), ("none", "g", "x", "+", 4, 6)]
    exons = spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in EXONS.split(", ")]), EXONS)
    out = A.transcript_statistics(exons, genome(spark), exons.filter("transcript_id = 't0'"), width=3)
    got = {r.transcript_id: r for r in out.collect()}
    gaps, own = (TEXT[4:9], TEXT[12:17]), TEXT[0:4] + TEXT[9:12] + TEXT[17:19]
    share = lambda s: sum(c in "GC" for c in s) / sum(c != "N" for c in s)
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    stops = lambda s: sum(s[i : i + 3] in ("TAG", "TAA", "TGA") for i in range(len(s)))
    for i in range(40):
        r, k = got[f"t{i}"], [stops(back(g) if i % 2 else g) for g in gaps]
        assert abs(r.exonic_gc - share(own)) < 1e-12 and abs(r.intronic_gc - share("".join(gaps))) < 1e-12
        assert (r.intronic_tc_count, r.tc_intron_count, r.defined_start_codon) == (sum(k), sum(x > 0 for x in k), i == 0)
    none = got["none"]
    assert none.intron_count == 1 and (none.exonic_gc, none.intronic_gc, none.intronic_tc_count, none.tc_intron_count) == (None,) * 4
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(sequence(") == 1  # exons and introns in one lookup
    assert A.placed(exons, genome(spark), 3, n=F.length("seq")).count() == 120
