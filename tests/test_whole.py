"""Queries that take every row of their view, long and short."""

from collections import Counter

from pyspark.sql import functions as F

from strandloom.operators import sampling
from strandloom.plans import queries as own


def documents(spark, path, texts):
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_long_colors(spark, tmp_path):
    texts = [(i, "GATTACA" * n) for i, n in enumerate([1, 57, 58, 300, 1000])]
    d = documents(spark, tmp_path, texts)
    ends = {0: "0.00", 1: ".12"}
    colors = {i: "T" + t.translate(str.maketrans("ACGT", "0123")) + ends.get(i % 4, "") for i, t in texts}

    def decoded(c):
        code, out = 3, "T"
        for x in c[1:]:
            code = -1 if code < 0 or x not in "0123" else code ^ int(x)
            out += "N" if code < 0 else "ACGT"[code]
        return out

    assert {r.doc_id: r.bases for r in own.QUERIES["dibase_decode"](spark, d).collect()} == {i: decoded(c) for i, c in colors.items()}
    assert {r.doc_id: r.encoded for r in own.QUERIES["double_encode"](spark, d).collect()} == {i: c[2:].translate(str.maketrans("0123.", "ACGTN")) for i, c in colors.items()}
    assert {r.doc_id: r.tail for r in own.QUERIES["tail_trim"](spark, d).collect()} == {i: len(c.rstrip("0.")) - 2 for i, c in colors.items()}


def test_long_shuffles(spark):
    rows = spark.createDataFrame([(1, "GATTACA"), (2, "GATTACA" * 500)], "doc_id long, seq string")
    got = sampling.klet_shuffle(rows, "doc_id", "seq", 2, 2).collect()
    assert Counter(r.doc_id for r in got) == {1: 2, 2: 2}
    pairs = lambda s: Counter(zip(s, s[1:]))
    assert all(pairs(r.shuffled) == pairs("GATTACA" * (500 if r.doc_id == 2 else 1)) for r in got)
    found = sampling.shuffled_matches(rows, "doc_id", "seq", "^GA", 2, 5).collect()
    assert found and all(r.shuffled.startswith("GA") for r in found)


def test_whole_views(spark):
    d = "/root/testdata/sf0.001"
    rows = own.V.iv(spark, d)
    spans = rows.select("seqname", "start", "end").distinct().count()
    assert own.QUERIES["nearest_left"](spark, d).count() == own.QUERIES["nearest_right"](spark, d).count() == spans
    assert own.QUERIES["splice_sequence"](spark, d).count() == own.V.table(spark, d, "lineitem").select("l_orderkey").distinct().count()
    reads = own.V.reads(spark, d)
    assert own.QUERIES["region_read_count"](spark, d).count() == reads.select("seqname", F.floor(F.col("pos") / 100)).distinct().count()
    at = {}
    for r in rows.collect():
        at.setdefault(r.seqname, []).append((r.start, r.end))
    pairs = sum(a < y and x < b for v in at.values() for a, b in v for x, y in v)
    assert own.QUERIES["interval_overlap_join"](spark, d).count() == pairs
    owners = {}
    for r in rows.collect():
        for p in range(r.start, r.end):
            owners.setdefault((r.seqname, p), set()).add(r.supp % 7)
    alone = sum(len(v) == 1 for v in owners.values())
    assert own.QUERIES["interval_disjoin_unique"](spark, d).agg(F.sum(F.col("end") - F.col("start"))).first()[0] == alone
