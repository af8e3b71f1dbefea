"""Registered queries through text formats: sinks write the view's rows to files, sources read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import alignments, trimming
from ..operators import annotation as A
from ..operators import reads as R
from ..shared import scratch
from ..sources import bam, fasta, formats, sinks
from . import queries as Q
from . import view as V
from .registry import SQL, query


def _file(spark: SparkSession, *lines: DataFrame) -> str:
    """A fresh folder of text files with all these lines."""
    path = scratch(spark, "text")
    for one in lines:
        one.select("value").write.mode("append").text(path)
    return path


def _remark(spark: SparkSession, text: str) -> DataFrame:
    return spark.range(1).select(F.lit(text).alias("value"))


# --- alignments ---


@query(f"""WITH {V.READS} SELECT 'r' || event_id AS qname, flag, seqname, pos, (event_id % 60)::INTEGER AS mapq, cigar_text AS cigar, CASE event_id % 3 WHEN 0 THEN seqname WHEN 1 THEN 'other' END AS mseqname, pos + 100 AS mpos, 250::BIGINT AS isize,
  CASE WHEN event_id % 2 = 0 THEN 'ACGTN' END AS seq, CASE WHEN event_id % 2 = 0 THEN 'II#I!' END AS qual, CASE WHEN (flag & 16) > 0 THEN '-' ELSE '+' END AS xs, event_id::VARCHAR AS nh FROM reads""")
def sam_exchange(spark, d):
    return _alignment_columns(formats.read_sam(spark, _file(spark, sinks.sam_header(V.targets(spark, d)), sinks.sam(_alignments(spark, d)))))


@query(SQL["sam_exchange"])
def bam_exchange(spark, d):
    """The same rows as a folder of BAM files, read in small splits."""
    path = scratch(spark, "bam")
    names = [r[0] for r in V.targets(spark, d).select("seqname").orderBy("seqname").collect()]
    bam.save_bam(_alignments(spark, d), [(n, 1 << 28) for n in [*names, "other"]], path)
    return _alignment_columns(bam.read_bam(spark, path, 1 << 18))


def _regions(spark, d: str) -> list[tuple[str, int, int]]:
    """Every sequence of the view by its first part, a thin slice of its middle and its last bases."""
    return [(r.seqname, a, b) for r in V.targets(spark, d).collect() for a, b in ((100, 5000), (r.length // 2, r.length // 2 + 40), (r.length - 560, r.length))]


@query(f"""WITH {V.WALK}, {V.TARGETS}, spans AS (SELECT DISTINCT event_id, seqname, pos, flag, pos + sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN len ELSE 0 END) OVER (PARTITION BY event_id) AS rend FROM walk),
regions AS (SELECT seqname AS sn, unnest([100, length // 2, length - 560]) AS a, unnest([5000, length // 2 + 40, length]) AS b FROM targets)
SELECT DISTINCT 'r' || event_id AS qname, seqname, pos, flag FROM spans JOIN regions ON seqname = sn AND pos < b AND greatest(rend, pos + 1) > a""")
def indexed_reads(spark, d):
    """Reads of three regions of each sequence, by way of BAM files and the indexes built for them."""
    path = scratch(spark, "bam")
    targets = [(r.seqname, r.length) for r in V.targets(spark, d).orderBy("seqname").collect()]
    bam.save_bam(_alignments(spark, d).withColumn("mseqname", F.lit(None).cast("string")).repartitionByRange("seqname", "pos").sortWithinPartitions("seqname", "pos"), targets, path)
    bam.index_bam(spark, path)
    return bam.read_bam_regions(spark, path, _regions(spark, d)).select("qname", "seqname", "pos", "flag")


def _alignments(spark, d):
    """The reads of the view with all columns of an alignment."""
    i = F.col("event_id")
    tag = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    return V.reads(spark, d).select(
        F.concat(F.lit("r"), i.cast("string")).alias("qname"), "flag", "seqname", "pos", (i % 60).cast("int").alias("mapq"), "cigar", F.when(i % 3 == 0, F.col("seqname")).when(i % 3 == 1, "other").alias("mseqname"),
        (F.col("pos") + 100).alias("mpos"), F.lit(250).cast("long").alias("isize"), F.when(i % 2 == 0, "ACGTN").alias("seq"), F.when(i % 2 == 0, "II#I!").alias("qual"),
        F.create_map(F.lit("XS"), tag("A", R.strand(F.col("flag"))), F.lit("NH"), tag("i", i.cast("string"))).alias("aux"),
    )


def _alignment_columns(back):
    tags = [F.col("aux")[k]["value"].alias(k.lower()) for k in ("XS", "NH")]
    return back.select("qname", "flag", "seqname", "pos", "mapq", sinks.cigar_text(F.col("cigar")).alias("cigar"), "mseqname", "mpos", "isize", "seq", "qual", *tags)


@query(f"WITH {V.READS}, {V.TARGETS} SELECT * FROM targets")
def sam_targets(spark, d):
    return formats.read_sam_targets(spark, _file(spark, sinks.sam_header(V.targets(spark, d))))


# --- annotation ---


@query(f"""WITH {V.EXON} SELECT transcript_id::VARCHAR AS transcript_id, gene_id::VARCHAR AS gene_id, seqname, strand, start, "end" FROM exon WHERE start % 7 <> 3""")
def gtf_exchange(spark, d):
    """Exons through three dialects of GTF: quoted, bare and without the last ';'; genes without a transcript id are skipped, other features too."""
    rows = V.exon(spark, d)
    t, g = F.col("transcript_id").cast("string"), F.col("gene_id").cast("string")
    whole = rows.select("seqname", F.lit("view").alias("source"), F.when(F.col("start") % 7 == 3, "CDS").otherwise("exon").alias("feature"), "start", "end", F.lit(0.0).alias("score"), "strand", F.lit(-1).alias("frame"), F.create_map(F.lit("gene_id"), g, F.lit("transcript_id"), t, F.lit("note"), F.lit("a b")).alias("attributes"), "transcript_id")
    bare = whole.withColumn("attributes", F.map_filter("attributes", lambda k, _: k != "note"))
    genes = whole.withColumns({"feature": F.lit("exon"), "attributes": F.map_filter("attributes", lambda k, _: k == "gene_id")}).filter("transcript_id % 10 = 0")
    part = lambda df, k: df.filter(F.col("transcript_id") % 3 == k)
    lines = [_remark(spark, "# a remark"), sinks.gtf(part(whole, 0)), sinks.gtf(part(bare, 1), quoted=False), sinks.gtf(part(whole, 2)).select(F.rtrim("value", F.lit(";")).alias("value")), sinks.gtf(genes)]
    return formats.exons(formats.read_gtf(spark, _file(spark, *lines)))


@query(f"""WITH {V.EXON} SELECT gene_id::VARCHAR AS gene_id, start + 1 AS "first", "end" AS "last", count(*) AS n, score, frame, attr FROM (SELECT *, round(start % 10 / 4.0, 2)::DOUBLE AS score, (start % 3)::INTEGER AS frame, 'x y' AS attr FROM exon) GROUP BY ALL""")
def gtf_columns(spark, d):
    rows = V.exon(spark, d).select("seqname", F.lit("view").alias("source"), F.lit("exon").alias("feature"), "start", "end", F.round(F.col("start") % 10 / 4.0, 2).alias("score"), "strand", (F.col("start") % 3).cast("int").alias("frame"), F.create_map(F.lit("gene_id"), F.col("gene_id").cast("string"), F.lit("note"), F.lit("x y")).alias("attributes"))
    back = formats.read_gtf(spark, _file(spark, sinks.gtf(rows)))
    return back.groupBy(F.col("attributes")["gene_id"].alias("gene_id"), (F.col("start") + 1).alias("first"), F.col("end").alias("last"), "score", "frame", F.col("attributes")["note"].alias("attr")).agg(F.count("*").alias("n"))


# --- intervals ---


@query(f"""WITH {V.IV} SELECT seqname, start, "end", CASE WHEN line > 2 THEN name ELSE '' END AS name, CASE WHEN line > 3 THEN score ELSE 0 END::DOUBLE AS score, CASE WHEN line > 3 THEN strand ELSE '.' END AS strand, CASE WHEN line > 4 THEN supp END AS supp, CASE WHEN line > 4 THEN part / 2.0 END::DOUBLE AS half FROM iv""")
def bed_exchange(spark, d):
    """BED rows of three to nine columns; extra columns by number, name and type, empty ones are null."""
    rows = V.iv(spark, d)
    six = rows.filter("line > 3").withColumn("extra", F.when(F.col("line") > 4, F.array(F.col("supp").cast("string"), F.lit(""), (F.col("part") / 2.0).cast("string"))).otherwise(F.array().cast("array<string>")))
    four = rows.filter("line = 3").select(F.concat_ws("\t", "seqname", F.col("start").cast("string"), F.col("end").cast("string"), "name").alias("value"))
    three = rows.filter("line < 3").select(F.concat_ws("\t", "seqname", F.col("start").cast("string"), F.col("end").cast("string")).alias("value"))
    path = _file(spark, _remark(spark, "track name=x"), _remark(spark, "#seqname"), _remark(spark, "short\t1"), sinks.bed(six), four, three)
    back = trimming.with_extra_columns(formats.read_bed(spark, path), "1:supp:long", "2:none:string", "3:half:double")
    return back.filter("none is null").select("seqname", "start", "end", "name", "score", "strand", "supp", "half")


@query(f"""WITH {V.IV} SELECT seqname, start, "end", name || CASE WHEN line > 2 THEN '.' || line ELSE '' END AS name, name AS first, trunc(-10 * log10(score + 0.001))::BIGINT AS score FROM iv""")
def split_bed_exchange(spark, d):
    """Pieces of cut rows as seven columns, read back by blanks; scores of 0 to 1 as whole numbers."""
    rows = V.iv(spark, d).withColumns({"piece": F.when(F.col("line") > 2, F.col("line")).otherwise(0), "score": F.col("score") + 0.001})
    back = formats.read_bed(spark, _file(spark, sinks.split_bed(rows)), blanks=True)
    return back.select("seqname", "start", "end", "name", F.col("extra")[0].alias("first"), S.score_to_phred(F.col("score_text")).alias("score"))


@query(SQL["coverage_bedgraph"])
def bedgraph_exchange(spark, d):
    back = formats.read_bed(spark, _file(spark, sinks.bedgraph(Q.coverage_bedgraph(spark, d))))
    return back.select("seqname", "start", "end", F.col("name").cast("long").alias("depth"))


@query(f"WITH {V.READS}, {V.TARGETS} SELECT seqname, length FROM targets")
def sizes_exchange(spark, d):
    return formats.read_sizes(spark, _file(spark, sinks.tsv(V.targets(spark, d).select("seqname", "length"))))


@query(f"WITH {V.IV} SELECT strand, seqname || ' ' || start AS value, count(*) AS n FROM iv GROUP BY ALL")
def by_name_exchange(spark, d):
    """A folder for each name, whose lines come back with it."""
    path = scratch(spark, "named")
    sinks.write_by_name(V.iv(spark, d).select("strand", F.concat_ws(" ", "seqname", F.col("start").cast("string")).alias("value")), path, "strand")
    return spark.read.schema("value string, strand string").text(path).groupBy("strand", "value").agg(F.count("*").alias("n"))


@query("SELECT doc_id, text FROM documents")
def zlib_exchange(spark, d):
    rows = V.table(spark, d, "documents").select("doc_id", "text")
    return sinks.decompressed(sinks.compressed(rows, "text"), "text")


# --- sequences and reads ---


@query(f"WITH {V.SEQS} SELECT 'd' || doc_id AS id, 'd' || doc_id || ' a text' AS description, seq, length(seq)::BIGINT AS length FROM seqs")
def fasta_exchange(spark, d):
    rows = V.seqs(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(" a text")).alias("id"), "seq")
    back = formats.read_fasta(spark, _file(spark, sinks.fasta(rows)))
    return back.join(formats.fasta_index(back).withColumnRenamed("seqname", "id"), "id").select("id", "description", "seq", "length")


@query(f"WITH {V.SEQS} SELECT doc_id, s AS start, e AS \"end\", CASE WHEN length(seq) > 0 THEN substr(seq, s + 1, e - s) END AS seq FROM (SELECT *, doc_id % 300 AS s, doc_id % 300 + 150 AS e FROM seqs)")
def fasta_fetch(spark, d):
    """Stretches of a chunked FASTA by position; they end where the sequence does."""
    rows = V.seqs(spark, d).select(F.col("doc_id").cast("string").alias("id"), "seq")
    genome = formats.chunked(formats.read_fasta(spark, _file(spark, sinks.fasta(rows))).filter("seq != ''"), width=100)
    at = F.col("doc_id") % 300
    regions = V.seqs(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("seqname"), at.alias("start"), (at + 150).alias("end"))
    return formats.fetch(genome, regions, width=100).select("doc_id", "start", "end", "seq")


@query(f"WITH {V.SEQS} SELECT doc_id, s AS start, e AS \"end\", substr(seq, s + 1, e - s) AS seq FROM (SELECT *, doc_id % 300 AS s, doc_id % 300 + 150 AS e FROM seqs)")
def fasta_ranges(spark, d):
    """The same stretches, and those of empty records, read by their byte ranges."""
    rows = V.seqs(spark, d).select(F.col("doc_id").cast("string").alias("id"), "seq")
    found = fasta.segments(spark, _file(spark, sinks.fasta(rows)), 1 << 16)
    at = F.col("doc_id") % 300
    regions = V.seqs(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("seqname"), at.alias("start"), (at + 150).alias("end"))
    return fasta.fetch_ranges(regions, found).select("doc_id", "start", "end", "seq")


_READ = f"{V.SEQS}, r AS (SELECT doc_id, seq || CASE doc_id % 4 WHEN 0 THEN 'AAAAAAA' WHEN 1 THEN 'aaaa' ELSE 'C' END AS seq FROM seqs), q AS (SELECT *, repeat(chr((97 + doc_id % 13)::INTEGER), length(seq)) AS qual FROM r)"


def _reads(spark, d):
    i = F.col("doc_id")
    seq = F.concat("seq", F.when(i % 4 == 0, "AAAAAAA").when(i % 4 == 1, "aaaa").otherwise("C"))
    rows = V.seqs(spark, d).select("doc_id", seq.alias("seq"))
    return rows.select(F.concat(F.lit("d"), i.cast("string")).alias("id1"), "seq", F.lit("again").alias("id2"), F.repeat(F.chr(97 + i % 13), F.length("seq")).alias("qual"))


@query(f"WITH {_READ} SELECT 'd' || doc_id AS id1, seq, 'again' AS id2, qual FROM q")
def fastq_exchange(spark, d):
    return formats.read_sequences(spark, _file(spark, sinks.fastq(_reads(spark, d)))).select("id1", "seq", "id2", "qual")


@query(f"WITH {_READ} SELECT 'd' || doc_id AS id1, seq, 'again' AS id2, qual FROM q")
def fastq_remarks(spark, d):
    """FASTQ with remark lines between the records."""
    lines = sinks.fastq(_reads(spark, d)).select(F.concat(F.lit("# a remark\n"), "value").alias("value"))
    return formats.read_fastq(spark, _file(spark, lines), comments=True).select("id1", "seq", "id2", "qual")


@query(f"WITH {_READ} SELECT 'd' || doc_id AS id1, seq, '' AS qual FROM q")
def fasta_reads(spark, d):
    """Reads without qualities are written as FASTA and told apart by the reader."""
    return formats.read_sequences(spark, _file(spark, sinks.fastq(_reads(spark, d).withColumn("qual", F.lit(""))))).select("id1", "seq", "qual")


@query(f"""WITH {_READ}, h AS (SELECT *, length(regexp_extract(seq, '(?i)^T{{4,}}')) AS head FROM q), k AS (SELECT *, length(regexp_replace(substr(seq, head + 1), '(?i)A{{4,}}$', '')) AS n FROM h)
SELECT 'd' || doc_id AS id1, substr(seq, head + 1, n) AS seq, substr(qual, head + 1, n) AS qual FROM k WHERE n < length(seq) AND ascii(qual) - 64 >= 38""")
def fastq_poly_trim(spark, d):
    return trimming.trim_poly(_reads(spark, d), least_quality=38).select("id1", "seq", "qual")


_COLOR = f"""{V.SEQS}, c AS (SELECT doc_id, 'T' || translate(seq, 'ACGT', '0123') || CASE doc_id % 4 WHEN 0 THEN '100000000' WHEN 1 THEN '2.0.0.0.0' ELSE '12' END AS colors FROM seqs),
q AS (SELECT *, list_transform(range(1, length(colors)), lambda i: ((i * 7 + doc_id) % 30)::INTEGER) AS qual FROM c)"""


def _color_reads(spark, d):
    i = F.col("doc_id")
    colors = F.concat(F.lit("T"), F.translate("seq", "ACGT", "0123"), F.when(i % 4 == 0, "100000000").when(i % 4 == 1, "2.0.0.0.0").otherwise("12"))
    rows = V.seqs(spark, d).select("doc_id", colors.alias("colors"))
    quals = F.transform(F.sequence(F.lit(1), F.length("colors") - 1), lambda k: ((k * 7 + i) % 30).cast("int"))
    return rows.select(F.concat(F.lit("d"), i.cast("string")).alias("name"), "colors", quals.alias("qual"), i.alias("ord"))


@query("""SELECT s_name AS name, 'T' || translate(md5(s_name), '456789abcdef', '012301230123') AS colors, array_to_string(list_transform(range(1, 33), lambda i: (i * 7 + s_suppkey) % 30), ' ') AS qual FROM supplier""")
def csfasta_exchange(spark, d):
    """Colour reads through a pair of files, one file each so that record numbers agree: the suppliers, a table of few rows."""
    rows = V.table(spark, d, "supplier")
    quals = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda k: ((k * 7 + F.col("s_suppkey")) % 30).cast("int"))
    reads = rows.select(F.col("s_name").alias("name"), F.concat(F.lit("T"), F.translate(F.md5(F.col("s_name").cast("binary")), "456789abcdef", "012301230123")).alias("colors"), quals.alias("qual"))
    colors, scores = (one.coalesce(1) for one in sinks.csfasta(reads))
    back = formats.read_csfasta(spark, _file(spark, colors), _file(spark, scores))
    return back.select("name", "colors", F.array_join(F.col("qual").cast("array<string>"), " ").alias("qual"))


@query(f"WITH {_COLOR} SELECT 'd' || doc_id AS name, colors FROM q")
def csfasta_alone(spark, d):
    return formats.read_csfasta(spark, _file(spark, sinks.csfasta(_color_reads(spark, d))[0])).filter("qual is null").select("name", "colors")


@query(f"""WITH {_COLOR}, k AS (SELECT *, greatest(length(rtrim(colors, '0.')) - 2, 0) AS k FROM q), m AS (SELECT *, list_avg(qual[k + 1:]) AS m, len(qual) - k AS n FROM k)
SELECT 'd' || doc_id AS name, substr(colors, 1, k + 1) AS colors, array_to_string(qual[1:k], ' ') AS qual FROM m WHERE n >= 6 AND m >= 12""")
def color_tail_trim(spark, d):
    return trimming.trim_color_tails(_color_reads(spark, d)).select("name", "colors", F.array_join(F.col("qual").cast("array<string>"), " ").alias("qual"))


@query(f"""WITH {_COLOR} SELECT 'd' || doc_id AS id1, regexp_replace(translate(substr(colors, 3), '0123.', 'ACGTN'), '[^ACGTN]', '', 'g') AS seq, array_to_string(list_transform(qual[2:], lambda x: chr(x + 33)), '') AS qual FROM q""")
def colors_as_letters(spark, d):
    return trimming.colors_to_fastq(_color_reads(spark, d)).select("id1", "seq", "qual")


@query(f"""WITH {_COLOR}, x AS (SELECT doc_id, unnest(string_split(colors, '')) AS ch, generate_subscripts(string_split(colors, ''), 1) AS i FROM q),
n AS (SELECT doc_id, i, CASE WHEN i = 1 THEN 3 WHEN ch IN ('0', '1', '2', '3') THEN ch::INTEGER ELSE 0 END AS v, CASE WHEN i > 1 AND ch NOT IN ('0', '1', '2', '3') THEN 1 ELSE 0 END AS bad FROM x),
b AS (SELECT doc_id, i, (sum(v & 1) OVER w % 2 + 2 * (sum(v >> 1) OVER w % 2))::INTEGER AS code, sum(bad) OVER w AS bad FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, string_agg(CASE WHEN bad > 0 THEN 'N' ELSE substr('ACGT', code + 1, 1) END, '' ORDER BY i) AS seq FROM b WHERE i > 1 GROUP BY doc_id)
SELECT 'd' || doc_id AS id1, seq, array_to_string(list_transform(qual, lambda x, i: chr(x + coalesce(qual[i + 1], 0) + 35)), '') AS qual FROM q JOIN s USING (doc_id)""")
def colors_as_bases(spark, d):
    return trimming.colors_to_fastq(_color_reads(spark, d), decode=True).select("id1", "seq", "qual")


# --- alignments of several species ---

_CELLS = """l AS (SELECT l_orderkey AS block, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS row, l_partkey AS p, l_suppkey AS s FROM lineitem),
c AS (SELECT block, row, substr('ACGT-', p % 5 + 1, 1) AS ref, substr('ACGT-', s % 5 + 1, 1) AS other FROM l),
k AS (SELECT *, sum(CASE WHEN ref <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY block ORDER BY row) AS k, block % 2 = 0 AS back, block * 20 + 1 AS first, block * 20 + 18 AS last FROM c)"""
_PLACED = """CASE WHEN back THEN last - k ELSE first + k - 2 END AS pos"""


def _block_file(spark, d):
    """Alignment blocks as text: for each order two species, a row for each line item; every block with its own stretch of the reference."""
    rows = V.table(spark, d, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    letter = lambda c: F.substr(F.lit("ACGT-"), (F.col(c) % 5 + 1).cast("int"), F.lit(1))
    blocks = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*order, F.concat(letter("l_partkey"), letter("l_suppkey")).alias("t")))).alias("r"))
    first, back = F.col("l_orderkey") * 20 + 1, F.col("l_orderkey") % 2 == 0
    head = lambda name, seq: F.concat(F.lit(f"SEQ {name} {seq} "), first.cast("string"), F.lit(" "), (first + 17).cast("string"), F.when(back, " -1").otherwise(" 1"), F.lit(" (x)"))
    return blocks.select(F.concat_ws("\n", head("homo", "7"), head("pan", "8"), F.lit("TREE x"), F.lit("DATA"), F.concat_ws("\n", F.transform("r", lambda x: x["t"])), F.lit("//")).alias("value"))


@query(f"""WITH {_CELLS}, u AS (SELECT block, 'homo' AS species, {_PLACED}, ref AS base, back FROM k WHERE ref <> '-' UNION ALL SELECT block, 'pan', {_PLACED}, other, back FROM k WHERE ref <> '-')
SELECT '7' AS ref_seqname, species, pos::BIGINT AS pos, CASE WHEN back THEN translate(base, 'ACGT', 'TGCA') ELSE base END AS base FROM u""")
def alignment_projection(spark, d):
    cells = formats.read_emf(spark, _file(spark, _block_file(spark, d)))
    return alignments.project(cells, "homo", ["homo", "pan"]).select("ref_seqname", "species", "pos", "base")


@query(f"""WITH {_CELLS}, g AS (SELECT max(last) AS length FROM k), u AS (SELECT 'homo' AS species, {_PLACED}, ref AS base, back FROM k WHERE ref <> '-' UNION ALL SELECT 'pan', {_PLACED}, other, back FROM k WHERE ref <> '-'),
e AS (SELECT species, unnest(range(0, length)) AS pos FROM g, (SELECT unnest(['homo', 'pan']) AS species)),
b AS (SELECT species, pos, coalesce(CASE WHEN back THEN translate(base, 'ACGT', 'TGCA') ELSE base END, '-') AS base FROM e LEFT JOIN u USING (species, pos))
SELECT '7' AS seqname, species, pos // 1000 * 1000 AS chunk_start, string_agg(base, '' ORDER BY pos) AS seq FROM b GROUP BY ALL""")
def projected_sequences(spark, d):
    cells = formats.read_emf(spark, _file(spark, _block_file(spark, d)))
    targets = V.table(spark, d, "lineitem").agg((F.max("l_orderkey") * 20 + 18).alias("length")).select(F.lit("7").alias("seqname"), "length")
    return alignments.projected_sequences(cells, "homo", ["homo", "pan"], targets, width=1000)


@query(f"""WITH {V.EXON}, x AS (SELECT DISTINCT seqname, strand, start, "end", gene_id FROM exon) SELECT seqname, count(*) AS n FROM x GROUP BY seqname""")
def distinct_lines(spark, d):
    """Rows that repeat in their first fields count once."""
    rows = V.exon(spark, d).union(V.exon(spark, d))
    return A.distinct_rows(rows, "seqname", "strand", "start", "end", "gene_id").groupBy("seqname").agg(F.count("*").alias("n"))
