"""Readers and writers on small hand-written files."""

import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from strandloom import coords
from strandloom.coords import ALIGNMENTS
from strandloom.operators import alignments, annotation
from strandloom.operators import reads as R
from strandloom.sources import bam, formats, sinks

SAM = """@HD\tVN:1.0
@SQ\tSN:c1\tLN:1000
@SQ\tSN:c2\tLN:500
r1\t0\tc1\t101\t60\t10M60N15M\t*\t0\t0\tACGT\tIIII\tXS:A:+\tNM:i:1
r2\t16\tc1\t201\t60\t5S20M\t=\t301\t50\tACGT\t*
r3\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII
r4\t0\tc2\t7\t9\t*\t*\t0\t0\t*\t*
"""
GTF = """# comment
c1\tsrc\texon\t11\t20\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
c1\tsrc\texon\t31\t40\t5.5\t+\t0\tgene_id g1; transcript_id "t-1 x"; gene_id 'g:2'
c1\tsrc\tCDS\t31\t40\t.\t-\t2\t
short\tline
"""


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_sam(spark, tmp_path):
    rows = {r.qname: r for r in formats.read_sam(spark, put(tmp_path, "a.sam", SAM)).collect()}
    assert rows["r1"].pos == 100 and [tuple(c) for c in rows["r1"].cigar] == [("M", 10), ("N", 60), ("M", 15)]
    assert rows["r1"].aux["XS"].value == "+" and rows["r2"].mseqname == "c1" and rows["r2"].mpos == 300
    assert rows["r3"].seqname is None and rows["r4"].flag == 4
    df = formats.read_sam(spark, str(tmp_path / "a.sam"))
    assert [tuple(r) for r in R.junctions(df).collect()] == [("r1", "c1", 110, 170)]
    assert [r.junction for r in R.junction_labels(df).collect()] == ["c1:110..170"]
    lines = sorted(r.value for r in sinks.sam(df).collect())
    assert lines[0] == "r1\t0\tc1\t101\t60\t10M60N15M\t*\t0\t0\tACGT\tIIII\tXS:A:+\tNM:i:1" and len(lines) == 4
    targets = formats.read_sam_targets(spark, str(tmp_path / "a.sam"))
    assert sorted(map(tuple, targets.collect())) == [("c1", 1000), ("c2", 500)]
    assert sinks.sam_header(targets).count() == 3


def test_bam_round_trip(spark, tmp_path):
    targets = [("c1", 1000), ("c2", 500)]
    rows = [(f"read{i}", [0, 16, 4][i % 3], ["c1", "c2", None][i % 3], 3 * i if i % 3 < 2 else -1, i % 60, [("M", 5), ("N", 60), ("M", 3)] if i % 3 < 2 else [], None, -1, 0, "ACGTNACG", "IIIIIIII" if i % 2 else None, {"XS": ("A", "+"), "NM": ("i", str(i)), "ZZ": ("Z", "text")}) for i in range(3000)]
    bam.write_bam(rows, targets, str(tmp_path / "x.bam"), block=5000)
    for split in (1 << 25, 3000, 700):
        got = bam.read_bam(spark, str(tmp_path / "x.bam"), split).collect()
        assert sorted(r.qname for r in got) == sorted(r[0] for r in rows)
    by = {r.qname: r for r in got}
    for r in rows[:50]:
        g = by[r[0]]
        assert (g.flag, g.seqname, g.pos, g.mapq, [tuple(c) for c in g.cigar], g.seq, g.qual) == (r[1], r[2], r[3], r[4], r[5], r[9], r[10])
        assert {k: tuple(v) for k, v in g.aux.items()} == r[11]
    assert bam.read_bam_targets(spark, str(tmp_path / "x.bam")).count() == 2


def test_gtf(spark, tmp_path):
    df = formats.read_gtf(spark, put(tmp_path, "a.gtf", GTF))
    rows = df.collect()
    assert [(r.start, r.end, r.score, r.frame) for r in rows] == [(10, 20, 0.0, -1), (30, 40, 5.5, 0), (30, 40, 0.0, 2)]
    assert rows[0].attributes == {"gene_id": "g1", "transcript_id": "t1"} and rows[1].attributes == {"transcript_id": "t-1 x", "gene_id": "g:2"}
    assert formats.exons(df).count() == 2
    assert sinks.gtf(df).collect()[0].value == 'c1\tsrc\texon\t11\t20\t.\t+\t.\tgene_id "g1"; transcript_id "t1";'


def test_bed(spark, tmp_path):
    df = formats.read_bed(spark, put(tmp_path, "a.bed", "c1\t1\t5\nc1\t2\nc2\t3\t9\tn\t1e-5\t-\tx\ty\nc3\t1\t2\tn\n"))
    rows = df.collect()
    assert [(r.seqname, r.name, r.score, r.strand, r.extra) for r in rows] == [("c1", "", 0.0, ".", []), ("c2", "n", 1e-5, "-", ["x", "y"]), ("c3", "n", 0.0, ".", [])]
    assert sinks.bed(df).collect()[1].value == "c2\t3\t9\tn\t1.0E-5\t-\tx\ty"
    assert sinks.bedgraph(df.withColumn("depth", F.lit(3))).collect()[0].value == "c1\t1\t5\t3"
    assert formats.read_sizes(spark, put(tmp_path, "s", "c1\t10\nc2\t20\n")).count() == 2


def test_fasta(spark, tmp_path):
    df = formats.read_fasta(spark, put(tmp_path, "a.fa", ">s1 first one\nACGT\nacgn\n>s2\n\n>s3\nA>C\nGG"))
    rows = sorted(df.collect(), key=lambda r: r.ord)
    assert [(r.id, r.seq, r.ord) for r in rows] == [("s1", "ACGTacgn", 0), ("s2", "", 1), ("s3", "A>CGG", 2)]
    assert rows[0].description == "s1 first one"
    assert formats.read_reference(spark, str(tmp_path / "a.fa")).first().seq == "ACGTacgn"
    chunks = formats.chunked(df, 3).filter("seqname = 's1'").orderBy("chunk_start").collect()
    assert [(c.chunk_start, c.seq) for c in chunks] == [(0, "ACG"), (3, "Tac"), (6, "gn")]
    exons = spark.createDataFrame([("t", "s1", "-", 1, 3), ("t", "s1", "-", 4, 8)], "transcript_id string, seqname string, strand string, start long, end long")
    assert annotation.spliced_sequences(exons, formats.chunked(df, 3)).first().seq == "ncgtCG"[0:0] + "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(c, {"a": "t", "c": "g", "g": "c", "n": "n"}.get(c)) for c in reversed("CG" + "acgn"))


def test_fastq(spark, tmp_path):
    df = formats.read_fastq(spark, put(tmp_path, "a.fq", "@r1/1 x\nACGT\n+\nIIII\n@r2\nAC\n+r2\n@I\n"))
    rows = sorted(df.collect(), key=lambda r: r.ord)
    assert [(r.id1, r.seq, r.id2, r.qual) for r in rows] == [("r1/1 x", "ACGT", "", "IIII"), ("r2", "AC", "r2", "@I")]
    ids = spark.createDataFrame([("r1",)], "qname string")
    assert [r.id1 for r in R.unmapped_pairs(df, ids).collect()] == ["r2"]
    assert sinks.fastq(df).count() == 2


def test_csfasta(spark, tmp_path):
    a = put(tmp_path, "a.csfasta", "# c\n>x\nT012\n>y\nT3..\n")
    rows = formats.read_csfasta(spark, a, put(tmp_path, "a.qual", ">x\n1 2 3\n>y\n-1 0 5\n")).orderBy("ord").collect()
    assert [(r.name, r.colors, r.qual) for r in rows] == [("x", "T012", [1, 2, 3]), ("y", "T3..", [-1, 0, 5])]
    with pytest.raises(Exception, match="names differ"):
        formats.read_csfasta(spark, a, put(tmp_path, "b.qual", ">x\n1\n>z\n2\n")).collect()


def test_emf(spark, tmp_path):
    text = "##FORMAT\nSEQ human 1 11 14 1\nSEQ mouse 2 5 8 1\nDATA\nAG\n-T\nC-\nGA\nTT\n//\nSEQ human 1 21 22 -1\nSEQ mouse 2 5 8 1\nDATA\nAC\nGT\n//\n"
    cells = formats.read_emf(spark, put(tmp_path, "a.emf", text))
    got = sorted((r.species, r.pos, r.base) for r in alignments.project(cells, "human", ["human", "mouse"]).collect())
    assert got == sorted([("human", 10, "A"), ("mouse", 10, "G"), ("human", 11, "C"), ("mouse", 11, "-"), ("human", 12, "G"), ("mouse", 12, "A"), ("human", 13, "T"), ("mouse", 13, "T"), ("human", 21, "T"), ("mouse", 21, "G"), ("human", 20, "C"), ("mouse", 20, "A")])
    seqs = {r.species: r.seq for r in alignments.projected_sequences(cells, "human", ["human", "mouse"], spark.createDataFrame([(cells.first().seqname, 24)], "seqname string, length long")).collect()}
    assert seqs["human"] == "-" * 10 + "ACGT" + "-" * 6 + "CT--"


def test_tables_and_bytes(spark, tmp_path):
    df = spark.createDataFrame([("k", "ACGT" * 50), (None, None)], "name string, seq string")
    packed = sinks.compressed(df, "seq")
    assert dict(packed.dtypes)["seq"] == "binary" and sinks.decompressed(packed, "seq").collect() == df.collect()
    sinks.write_lines(df.select("seq").filter("seq is not null"), str(tmp_path / "out"), True)
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "ACGT" * 50
    assert coords.region("chr1:1,001-2 000") == ("chr1", 1000, 2000) and coords.region("x") == ("x", 0, 1 << 29)


def test_lift_and_isolation(spark):
    exons = spark.createDataFrame([("t", "c", "+", 100, 110), ("t", "c", "+", 120, 140), ("u", "c", "+", 135, 150), ("v", "c", "+", 300, 310)], "transcript_id string, seqname string, strand string, start long, end long")
    aln = spark.createDataFrame([("a", "t", 5, 10), ("b", "t", 10, 20), ("c", "t", 25, 9)], "qname string, transcript_id string, tpos long, length long")
    assert sorted(map(tuple, annotation.lift(aln, exons).collect())) == [("a", "c", 105, "5M10N5M"), ("b", "c", 120, "20M")]
    assert [r.transcript_id for r in annotation.isolated(exons).collect()] == ["v"]


def test_streams(spark, tmp_path):
    from strandloom.streaming import pipelines

    for i in range(2):
        spark.createDataFrame([("1", "ACGT", 5 + i), ("X", "TTTT", 250)], "seqname string, seq string, pos long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seqname string, seq string, pos long").parquet(str(tmp_path / "in"))

    def run(df, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName("t").start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(tuple, spark.table("t").collect()))

    assert run(pipelines.binned_counts(stream, 100), "complete") == [("1", 0, 2), ("X", 2, 2)]
    assert run(pipelines.filtered(pipelines.renamed(stream), "^AC"), "append") == [("chr1", "ACGT", 5), ("chr1", "ACGT", 6)]
    ids = spark.createDataFrame([("X",)], "seqname string")
    assert len(run(pipelines.listed(stream, ids, "seqname", keep=False), "append")) == 2


def test_trims(spark):
    from strandloom.operators import trimming as T

    colors = spark.createDataFrame([("a", "T0120000000", [20] * 10, 0), ("b", "T01200", [20] * 5, 1), ("c", "T0120000000", [20] * 3 + [1] * 7, 2)], "name string, colors string, qual array<int>, ord long")
    assert [(r.name, r.colors, len(r.qual)) for r in T.trim_color_tails(colors).collect()] == [("a", "T01", 2)]
    assert [(r.id1, r.seq, r.qual) for r in T.colors_to_fastq(colors.limit(1)).collect()] == [("a", "CGAAAAAAA", "5" * 9)]
    assert T.colors_to_fastq(colors.limit(1), decode=True).first().seq == "TGAAAAAAAA"
    fq = spark.createDataFrame([("x", "TTTTTACGAAAA", "", "hhhhhBBBhhhh", 0), ("y", "ACG", "", "hhh", 1), ("z", "ACAAAA", "", "hhBBBB", 2)], "id1 string, seq string, id2 string, qual string, ord long")
    assert [(r.id1, r.seq, r.qual) for r in T.trim_poly(fq).collect()] == [("x", "ACG", "BBB")]
    assert [r.seq for r in T.trim_poly(fq, stranded=True).collect()] == ["TTTTTACG"]
    assert T.first_records(fq, 2).count() == 2


def test_bed_tables(spark, tmp_path):
    from strandloom.operators import trimming as T

    df = formats.read_bed(spark, put(tmp_path, "a.bed", "c2\t3\t9\tn\t1e-5\t-\t7\t\nc1\t1\t5\tm\t3\t+\tx\tq\n"))
    sizes = spark.createDataFrame([("c1", 10)], "seqname string, length long")
    assert [(r.seqname, r.score) for r in T.big_bed_rows(df, sizes).collect()] == [("c1", 3)]
    assert [(r.seqname, r.score) for r in T.big_bed_rows(df, sizes.limit(0)).collect()] == [("c1", 3), ("c2", 50)]
    assert [(r.a, r.b) for r in T.with_extra_columns(df, "1:a:int", "2:b:string").collect()] == [(7, None), (None, "q")]


def test_regions(spark, tmp_path):
    df = formats.read_sam(spark, put(tmp_path, "a.sam", SAM))
    targets = formats.read_sam_targets(spark, str(tmp_path / "a.sam"))
    assert {r.qname for r in R.in_region(df, "c1", 150, 190).collect()} == {"r1"} and R.in_region(df, "c1", 185, 200).count() == 0
    assert R.in_region(df, "c1", only_strand="-").count() == 1
    assert [(r.at, r.n) for r in R.end_counts(df, "c1", 217, 221, "-").collect()] == [(220, 0), (219, 1), (218, 0), (217, 0)]
    assert sorted(map(tuple, R.region_depth(df, targets, "c1", 105, 175).collect())) == [(105, 110, 1), (110, 170, 0), (170, 175, 1)]


def bam_rows(n, names, length=20):
    return [(f"r{i}", 16 * (i % 2), names[i * len(names) // n], 10 * i, 30, [("M", length)], None, -1, 0, "ACGT" * (length // 4) if length >= 4 else "A" * length, None, {"NM": ("i", str(i))}) for i in range(n)]


@pytest.mark.parametrize("aligned", [False, True])
@pytest.mark.parametrize("length", [20, 4000])
def test_bam_splits(tmp_path, aligned, length):
    """Every record once, whatever the split size and however blocks cut records, long ones too."""
    targets, path = [("a", 10**6), ("b", 10**6)], str(tmp_path / "x.bam")
    n = 3000 if length == 20 else 200
    bam.write_bam(bam_rows(n, ["a", "b"], length), targets, path, block=3000, aligned=aligned)
    size = Path(path).stat().st_size
    for split in (size + 1, size // 3, size // 40, 701):
        reader = bam.BamReader({"path": path, "splitbytes": split})
        got = [name for part in reader.partitions() for batch in reader.read(part) for name in batch.column("qname").to_pylist()]
        assert sorted(got) == sorted(f"r{i}" for i in range(n))


def test_bam_filters_and_index(spark, tmp_path):
    targets, path = [("a", 10**6), ("b", 10**6), ("c", 10)], str(tmp_path / "x.bam")
    bam.write_bam(bam_rows(4000, ["a", "b"]), targets, path, block=2000)
    reader = bam.BamReader({"path": path, "splitbytes": 5000})
    whole = reader.partitions()
    filters = [EqualTo(("seqname",), "b"), LessThan(("pos",), 30000), GreaterThanOrEqual(("pos",), 25000)]
    assert list(reader.pushFilters(filters)) == filters
    rows = lambda: sorted(x for part in reader.partitions() for batch in reader.read(part) for x in batch.column("pos").to_pylist())
    want = [10 * i for i in range(2500, 3001)]
    assert len(reader.partitions()) == len(whole) and rows() == want  # bounds are tested by Spark again, so 30000 may come
    marks = [o for o, _ in bam._blocks(open(path, "rb"), 0)]
    ends = {"a": (marks[0] << 16, marks[len(marks) // 2 + 1] << 16), "b": (marks[len(marks) // 2 - 2] << 16, marks[-2] << 16)}
    index = b"BAI\1" + struct.pack("<i", 3)
    for name in "abc":
        chunk = ends.get(name)
        index += struct.pack("<iIiQQ", 1, 4681, 1, *chunk) if chunk else struct.pack("<i", 0)
        index += struct.pack("<i", 0)
    Path(path + ".bai").write_bytes(index)
    assert len(reader.partitions()) < len(whole) and rows() == want
    reader.seqname = "c"
    assert reader.partitions() == []
    df = bam.read_bam(spark, path, 5000).filter("seqname = 'b' and pos < 30000 and pos >= 25000")
    assert sorted(r.pos for r in df.select("pos").collect()) == want[:-1]


def test_bam_folder(spark, tmp_path):
    rows, targets = bam_rows(500, ["a", "b"]), [("a", 10**6), ("b", 10**6)]
    cells = [(*r[:5], [{"op": o, "len": n} for o, n in r[5]], *r[6:11], {k: {"type": t, "value": v} for k, (t, v) in r[11].items()}) for r in rows]
    df = spark.createDataFrame(cells, ALIGNMENTS).repartition(3)
    assert bam.save_bam(df, targets, str(tmp_path / "folder")) == 500
    back = bam.read_bam(spark, str(tmp_path / "folder"), 4000)
    key = lambda r: r.qname
    assert sorted(back.collect(), key=key) == sorted(df.collect(), key=key)
    assert bam.read_bam_targets(spark, str(tmp_path / "folder")).collect() == [("a", 10**6), ("b", 10**6)]


def test_numbered_files(spark, tmp_path):
    """Lines are numbered file by file, though tasks scan parts of different files."""
    for i, n in enumerate([5, 4000, 1, 900]):
        (tmp_path / f"{i}.txt").write_text("".join(f"{i}-{j}\n" for j in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = [r.value for r in formats.read_lines(spark, str(tmp_path)).orderBy("ord").collect()]
        numbers = [r.ord for r in formats.read_lines(spark, str(tmp_path)).select("ord").orderBy("ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"{i}-{j}" for i, n in enumerate([5, 4000, 1, 900]) for j in range(n)] and numbers == list(range(len(got)))


def test_fetch(spark):
    genome = formats.chunked(spark.createDataFrame([("a", "ACGTACGTAC"), ("b", "GGG")], "id string, seq string"), 4)
    regions = spark.createDataFrame([("a", 1, 9, "x"), ("a", 1, 9, "again"), ("a", 8, 99, "y"), ("b", 0, 3, "z"), ("none", 0, 3, "w"), ("b", 3, 5, "v")], "seqname string, start long, end long, name string")
    got = {r.name: r.seq for r in formats.fetch(genome, regions, 4).collect()}
    assert got["x"] == got["again"] == "CGTACGTA" and got["y"] == "AC" and got["z"] == "GGG" and got["w"] is None and not got["v"]


def test_species_and_pairs(spark, tmp_path):
    assert [r.species for r in formats.read_species(spark, put(tmp_path, "s.txt", "homo\n\n  pan \nmus\n")).orderBy("ord").collect()] == ["homo", "pan", "mus"]
    sinks.save_pairs(spark.createDataFrame([("b", 2), ("a", 3), ("b", 1)], "k string, v int"), str(tmp_path / "kv"), "k", "v")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "kv")).collect())) == [("a", 3), ("b", 1)]


def test_sequences_by_first_sign(spark, tmp_path):
    assert [tuple(r)[:4] for r in formats.read_sequences(spark, put(tmp_path, "a.fa", ">x y\nAC\nGT\n>z\nA\n")).orderBy("ord").collect()] == [("x y", "ACGT", "", ""), ("z", "A", "", "")]
    assert [tuple(r)[:4] for r in formats.read_sequences(spark, put(tmp_path, "a.fq", "@x\nAC\n+x\nII\n")).collect()] == [("x", "AC", "x", "II")]
    alone = formats.read_csfasta(spark, put(tmp_path, "a.csfasta", "# c\n>x\nT01\n")).first()
    assert (alone.name, alone.colors, alone.qual) == ("x", "T01", None)


def test_attributes_are_searched_once(spark):
    from strandloom.sources.formats import attributes

    assert attributes(F.col("value"))._jc.toString().count("regexp_extract_all") == 1
    texts = ['a "x; y"; b \'q "r\'; c 5; a "2"', "k  v;k\tw", "", None, 'e ""; f \'\'', "lone; p=q r s"]
    want = [{"a": "2", "b": 'q "r', "c": "5"}, {"k": "w"}, {}, None, {"e": "", "f": ""}, {"q": "r"}]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, value string").select("i", attributes(F.col("value")).alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == want
