"""More registered queries: both-sided neighbours, keep-first unions, transcript statistics, matrices, regions, names, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..coords import region
from ..functions import sequences as S
from ..operators import alignments, folding, sampling
from ..operators import annotation as A
from ..operators import intervals as I
from ..operators import reads as R
from ..operators.pileup import pileup
from ..streaming import pipelines
from . import queries as Q
from . import view as V
from .registry import SQL, query

# --- intervals ---


@query(f"""WITH {V.IV}, l AS (SELECT seqname, "end" AS at, min(name) AS name FROM iv GROUP BY ALL), r AS (SELECT seqname, start AS at, min(name) AS name FROM iv GROUP BY ALL), p AS (SELECT DISTINCT seqname, start, "end" FROM iv),
a AS (SELECT p.*, l.name AS ln, p.start - l.at AS ld FROM p ASOF LEFT JOIN l ON p.seqname = l.seqname AND p.start >= l.at),
b AS (SELECT a.*, r.name AS rn, r.at - a."end" AS rd FROM a ASOF LEFT JOIN r ON a.seqname = r.seqname AND a."end" <= r.at)
SELECT seqname, start, "end", CASE WHEN rd IS NULL OR ld < rd THEN ln ELSE rn END AS name_near, least(ld, rd)::BIGINT AS _distance,
 CASE WHEN ld IS NULL AND rd IS NULL THEN NULL WHEN rd IS NULL OR ld < rd THEN 'left' ELSE 'right' END AS _side FROM b""")
def nearest_both(spark, d):
    rows = V.iv(spark, d)
    return I.nearest_of_both(rows.select("seqname", "start", "end").distinct(), rows, ["seqname"], "right", "name")


_FIRST = """, arg_min({'n': name, 's': score}, {'a': start, 'b': "end", 'c': name, 'd': score}) AS f, max(score)::VARCHAR AS top"""


@query(f"""WITH {V.IV}, {V.merged_sql("iv", "seqname, strand", aggregates=_FIRST)} SELECT seqname, strand, start, "end", top, f.n AS name, f.s AS score FROM merged""")
def interval_merge_first(spark, d):
    rows = V.iv(spark, d).withColumn("score_text", F.col("score").cast("string"))
    return I.merge_first(rows, ["seqname", "strand"], ["end", "name", "score"], "name", "score")


@query(f"""WITH {V.IV}, {V.merged_sql("iv", "seqname, strand")} SELECT * FROM merged ORDER BY seqname, strand, start""")
def interval_merge_sorted(spark, d):
    return I.merge(V.iv(spark, d), ["seqname", "strand"]).orderBy("seqname", "strand", "start")


@query(f"WITH {V.SEQS} SELECT substr(seq, 1, 4) AS key, count(*) AS n FROM seqs GROUP BY ALL ORDER BY n DESC, key")
def prefix_counts_sorted(spark, d):
    return R.multiplicity(V.seqs(spark, d), F.substring("seq", 1, 4), ordered=True)


@query(f"""WITH {V.EXON}, c AS (SELECT seqname, strand, transcript_id, min(start) + 7 AS c5 FROM exon WHERE transcript_id % 3 > 0 GROUP BY ALL),
x AS (SELECT seqname, strand, transcript_id, min(start) AS start, max("end" + 600) AS "end" FROM exon GROUP BY ALL),
w AS (SELECT *, lag("end") OVER o AS pe, lead(start) OVER o AS ns FROM (SELECT x.*, coalesce(c5, 0) AS c5 FROM x LEFT JOIN c USING (seqname, strand, transcript_id)) WINDOW o AS (PARTITION BY seqname, strand ORDER BY c5, transcript_id))
SELECT transcript_id, seqname, strand, start, "end" FROM w WHERE NOT coalesce(pe > start, false) AND NOT coalesce(ns < "end", false)""")
def isolate_by_coding_start(spark, d):
    wide = V.exon(spark, d).withColumn("end", F.col("end") + 600)
    coding = V.exon(spark, d).filter("transcript_id % 3 > 0").withColumn("start", F.col("start") + 7)
    return A.isolated(wide, coding)


# --- owners and samples ---

_SAMPLES = f"""WITH {V.IV}, seg AS ({SQL["interval_disjoin_unique"]}), s AS (SELECT seqname, 's' || (line % 3) AS sample, start + 5 AS p, line AS w FROM iv),
h AS (SELECT owner, sample, w FROM s ASOF JOIN seg ON s.seqname = seg.seqname AND s.p >= seg.start WHERE p < "end")"""


def _samples(spark, d):
    return V.iv(spark, d).select("seqname", F.concat(F.lit("s"), (F.col("line") % 3).cast("string")).alias("sample"), (F.col("start") + 5).alias("start"), (F.col("start") + 6).alias("end"), "line")


def _owned(spark, d):
    return V.iv(spark, d).select("seqname", (F.col("supp") % 7).alias("owner"), "start", "end")


@query(f"{_SAMPLES} SELECT owner, count(*) FILTER (sample = 's0') AS s0, count(*) FILTER (sample = 's1') AS s1, count(*) FILTER (sample = 's2') AS s2 FROM h GROUP BY owner")
def owner_matrix(spark, d):
    return A.count_matrix(A.unique_segment_counts(_owned(spark, d), "owner", _samples(spark, d)), "owner", ["s0", "s1", "s2"])


@query(f"{_SAMPLES} SELECT owner, sample, sum(w)::BIGINT AS n FROM h GROUP BY ALL")
def owner_weights(spark, d):
    return A.unique_segment_counts(_owned(spark, d), "owner", _samples(spark, d), "line")


@query("""WITH s AS (SELECT l_orderkey AS id, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem GROUP BY 1)
SELECT id, round((o_totalprice - m) / CASE WHEN s > 0 THEN s END, 4) AS z FROM orders JOIN s ON o_orderkey = id""")
def permutation_scores(spark, d):
    scores = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    permuted = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("other"))
    return sampling.permutation_z(scores, "id", "score", permuted, "other").withColumn("z", F.round("z", 4))


# --- transcripts ---

_GENES = f"{V.SEQS}, {Q._GENOME}, {Q._FEATURES}, x AS (SELECT *, lead(start) OVER (PARTITION BY transcript_id ORDER BY start, \"end\") AS nx FROM feat)"


@query(f"""WITH {_GENES},
o AS (SELECT transcript_id, strand, start, "end", "end" - start AS l, nx - "end" AS g, row_number() OVER w AS i, count(*) OVER (PARTITION BY transcript_id) AS n FROM x WINDOW w AS (PARTITION BY transcript_id ORDER BY start, "end")),
t AS (SELECT transcript_id, (count(*) - 1)::BIGINT AS intron_count, sum(g)::BIGINT AS intronic_length, median(g)::DOUBLE AS median_intron_length,
 CASE WHEN min(strand) = '-' THEN max(g) FILTER (i = 1) ELSE max(g) FILTER (i = n - 1) END AS terminal_intron_length,
 CASE WHEN min(strand) = '-' THEN max(l) FILTER (i = n) ELSE max(l) FILTER (i = 1) END AS five_prime_utr_length, CASE WHEN min(strand) = '-' THEN max(l) FILTER (i = 1) ELSE max(l) FILTER (i = n) END AS three_prime_utr_length,
 sum(l)::BIGINT AS exonic_length, median(l)::DOUBLE AS median_exonic_length FROM o GROUP BY transcript_id),
s AS (SELECT transcript_id, strand, nx, substr(seq, start + 1, "end" - start) AS e, CASE WHEN nx > "end" THEN substr(seq, "end" + 1, nx - "end") END AS i FROM x JOIN genome ON sn = seqname),
c AS (SELECT *, length(regexp_replace(e, '[^GC]+', '', 'g')) AS ge, length(regexp_replace(i, '[^GC]+', '', 'g')) AS gi,
  len(regexp_extract_all(CASE WHEN strand = '-' THEN reverse(translate(i, 'ACGT', 'TGCA')) ELSE i END, 'TAG|TAA|TGA')) AS k FROM s),
q AS (SELECT transcript_id, sum(ge) / nullif(sum(length(e)), 0) AS exonic_gc, sum(gi) / nullif(sum(length(i)), 0) AS intronic_gc, sum(k)::BIGINT AS intronic_tc_count, CASE WHEN count(i) > 0 THEN count_if(k > 0) END::BIGINT AS tc_intron_count FROM c GROUP BY transcript_id)
SELECT transcript_id::VARCHAR AS transcript_id, intron_count, intronic_length, median_intron_length, terminal_intron_length, five_prime_utr_length, three_prime_utr_length, exonic_length, median_exonic_length,
 round(exonic_gc, 9) AS exonic_gc, round(intronic_gc, 9) AS intronic_gc, intronic_tc_count, tc_intron_count, transcript_id % 3 = 0 AS defined_start_codon FROM t JOIN q USING (transcript_id)""")
def transcript_statistics(spark, d):
    own = Q._features(spark, d).withColumn("gene_id", F.col("transcript_id") % 10)
    out = A.transcript_statistics(own, Q._genome(spark, d), own.filter("transcript_id % 3 = 0"), width=1000)
    return out.withColumns({c: F.round(c, 9) for c in ("exonic_gc", "intronic_gc")})


@query(f"""WITH {V.SEQS}, a AS (SELECT 'd' || doc_id AS seqname, 'x' AS species, seq FROM seqs UNION ALL SELECT 'd' || doc_id, 'y', reverse(seq) FROM seqs),
r AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS name, 'd' || (l_orderkey % (SELECT max(doc_id) + 1 FROM documents)) AS seqname, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_linenumber * 3 AS start, l_linenumber * 3 + floor(l_quantity)::BIGINT AS "end" FROM lineitem)
SELECT name, species, CASE WHEN strand = '-' THEN reverse(translate(p, 'ACGT', 'TGCA')) ELSE p END AS seq FROM (SELECT name, strand, species, substr(seq, start + 1, "end" - start) AS p FROM r JOIN a USING (seqname))""")
def alignment_slices(spark, d):
    seqs = V.seqs(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("seqname"), "seq")
    both = seqs.select("seqname", F.explode(F.array(F.struct(F.lit("x").alias("species"), F.col("seq").alias("seq")), F.struct(F.lit("y").alias("species"), F.reverse("seq").alias("seq")))).alias("a")).select("seqname", "a.species", "a.seq")
    rows, start = V.table(spark, d, "lineitem"), F.col("l_linenumber") * 3
    last = V.table(spark, d, "documents").agg(F.max("doc_id") + 1).scalar()
    regions = rows.select(
        F.concat_ws(":", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("name"), F.concat(F.lit("d"), (F.col("l_orderkey") % last).cast("string")).alias("seqname"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), start.alias("start"), (start + F.floor("l_quantity")).alias("end"),
    )
    return alignments.slices(regions, both)


# --- regions of reads ---


@query(f"""WITH {Q._ENDS}, c AS (SELECT "at", count(*) AS n FROM ends WHERE (flag & 4) = 0 AND seqname = 'click' AND pos < 30000 AND rend > 2000 AND strand = '-' GROUP BY ALL)
SELECT g.at, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(2000, 30000)) AS at) g LEFT JOIN c ON g.at = c.at""")
def end_positions(spark, d):
    return R.end_counts(V.reads(spark, d), "click", 2000, 30000, "-")


@query(f"""WITH {Q._ENDS} SELECT count(*)::BIGINT AS n FROM ends WHERE (flag & 4) = 0 AND seqname = 'click' AND "at" >= 2000 AND "at" < 30000""")
def end_total(spark, d):
    return R.end_count(V.reads(spark, d), "click", 2000, 30000)


@query(f"""WITH {Q._ENDS} SELECT event_id, qname, pos FROM ends WHERE (flag & 4) = 0 AND seqname = 'click' AND pos < 20000 AND rend > 999 AND strand = '+' AND (flag & 64) > 0""")
def region_reads(spark, d):
    return R.in_region(V.reads(spark, d), *region("click:1,000-20,000"), "+", 1).select("event_id", "qname", "pos")


_SPANS = "(SELECT *, pos + sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN len ELSE 0 END) OVER (PARTITION BY event_id) AS rend FROM walk)"


@query(f"""WITH c AS ({Q._coverage_sql(f"SELECT seqname, s, s + len AS e FROM {_SPANS} WHERE op = 'M' AND (flag & 4) = 0 AND seqname = 'click' AND pos < 30000 AND rend > 2000")})
SELECT greatest(start, 2000)::BIGINT AS start, least("end", 30000)::BIGINT AS "end", depth FROM c WHERE "end" > 2000 AND start < 30000""")
def region_depth(spark, d):
    return R.region_depth(V.reads(spark, d), V.targets(spark, d), "click", 2000, 30000)


# --- pileup ---

_LETTERS, _SCORES = "ACGTACGTACGTacNN", "%&+,-/0123456789"  # by hexadecimal digit


def _sequenced(spark, d):
    """Reads of the view with bases and qualities from the digits of their id's md5, and two samples."""
    digits = F.concat(F.md5(F.col("event_id").cast("string").cast("binary")), F.md5(F.col("event_id").cast("string").cast("binary")))
    hexa = "0123456789abcdef"
    size = R.query_length(F.col("cigar")).cast("int")
    cut = lambda letters, k: F.translate(F.substr(digits, F.lit(k), size), hexa, letters)
    return V.reads(spark, d).select("seqname", "pos", "flag", "cigar", F.lit(None).cast("int").alias("mapq"), (F.col("event_id") % 2).alias("sample"), cut(_LETTERS, 1).alias("seq"), F.when(F.col("event_id") % 3 > 0, cut(_SCORES, 2)).alias("qual"))


_PILE = f"""{V.WALK}, x AS (SELECT *, event_id % 2 AS sample, coalesce(sum(CASE WHEN op IN ('M', 'I', 'S') THEN len ELSE 0 END) OVER (PARTITION BY event_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS q,
  md5(event_id::VARCHAR) || md5(event_id::VARCHAR) AS digits FROM walk WHERE (flag & 1796) = 0),
e AS (SELECT event_id, seqname, sample, op, s, q, pos, digits, unnest(range(0, CASE WHEN op = 'I' THEN 1 WHEN op IN ('M', 'D') THEN len ELSE 0 END)) AS j FROM x),
b AS (SELECT seqname, sample, CASE op WHEN 'I' THEN s - 1 ELSE s + j END AS place, CASE op WHEN 'D' THEN 'del' WHEN 'I' THEN (CASE WHEN s > pos THEN 'ins' END) ELSE
  (CASE WHEN event_id % 3 = 0 OR ascii(substr('{_SCORES}', strpos('0123456789abcdef', substr(digits, q + j + 2, 1)), 1)) - 33 >= 13 THEN upper(substr('{_LETTERS}', strpos('0123456789abcdef', substr(digits, q + j + 1, 1)), 1)) END) END AS k FROM e)
SELECT seqname, sample, place AS pos, count_if(k <> 'ins')::BIGINT AS depth, count_if(k = 'A')::BIGINT AS "A", count_if(k = 'C')::BIGINT AS "C", count_if(k = 'G')::BIGINT AS "G", count_if(k = 'T')::BIGINT AS "T", count_if(k = 'N')::BIGINT AS "N",
  count_if(k = 'del')::BIGINT AS "del", count_if(k = 'ins')::BIGINT AS "ins" FROM b WHERE k IS NOT NULL GROUP BY seqname, sample, place"""


@query(f"WITH {_PILE}")
def base_pileup(spark, d):
    return pileup(_sequenced(spark, d), "sample", min_quality=13)


# --- names and numbers ---


@query(r"""WITH p AS (SELECT DISTINCT l_partkey AS p FROM lineitem),
t AS (SELECT p, CASE p % 4 WHEN 0 THEN 'SEQ  homo   MT 1 2' WHEN 1 THEN 'SEQ homo ' || p || ' 5 9 1' WHEN 2 THEN 'SEQ homo X 1' ELSE 'DATA  ' || p END AS line, '/data/v.1/t' || p || CASE WHEN p % 3 = 0 THEN '.bed' ELSE '.txt' END AS path,
  '/aln/chr' || p || '.human.fasta' AS file, CASE WHEN p % 5 = 0 THEN 'scaffold' ELSE 'chr' || p || 'b' END AS name, p / 7.0::DOUBLE AS x FROM p)
SELECT p, CASE WHEN starts_with(line, 'SEQ') THEN array_to_string(list_transform(string_split_regex(line, '\s+'), lambda x, i: CASE WHEN i <> 3 THEN x WHEN x = 'MT' THEN 'chrM' WHEN regexp_matches(x, '^[0-9]') THEN 'chr' || x ELSE x END), ' ') ELSE line END AS renamed,
  't' || p || CASE WHEN p % 3 = 0 THEN '' ELSE '.txt' END AS table_name, 'chr' || p AS chromosome, CASE WHEN name = 'scaffold' THEN 99999 ELSE p END::INTEGER AS number,
  printf('%.4e', x) AS e, printf('%.5f', x) AS f, regexp_replace(upper(line), '[^ACGTU]+', '', 'g') AS bases FROM t""")
def name_helpers(spark, d):
    p = F.col("p").cast("string")
    rows = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("p")).distinct().select(
        "p", F.when(F.col("p") % 4 == 0, "SEQ  homo   MT 1 2").when(F.col("p") % 4 == 1, F.concat(F.lit("SEQ homo "), p, F.lit(" 5 9 1"))).when(F.col("p") % 4 == 2, "SEQ homo X 1").otherwise(F.concat(F.lit("DATA  "), p)).alias("line"),
        F.concat(F.lit("/data/v.1/t"), p, F.when(F.col("p") % 3 == 0, ".bed").otherwise(".txt")).alias("path"), F.concat(F.lit("/aln/chr"), p, F.lit(".human.fasta")).alias("file"),
        F.when(F.col("p") % 5 == 0, "scaffold").otherwise(F.concat(F.lit("chr"), p, F.lit("b"))).alias("name"), (F.col("p") / 7.0).alias("x"),
    )
    return rows.select(
        "p", S.block_line_to_ucsc(F.col("line")).alias("renamed"), S.table_name(F.col("path")).alias("table_name"), S.file_chromosome(F.col("file")).alias("chromosome"), S.chromosome_number(F.col("name")).alias("number"),
        S.scientific(F.col("x"), 4).alias("e"), S.fixed(F.col("x"), 5).alias("f"), S.bases_only(F.col("line")).alias("bases"),
    )


# --- structures: recursions over stretches that SQL cannot say; tested against all structures of short sequences ---


@query()
def structure_scores(spark, d):
    """Energy of each document's bases, and its z-score against ten shuffles that keep its pairs of letters."""
    return folding.energy_z(V.seqs(spark, d), "doc_id", "seq", 10, 2, 1, folding.Model(24)).select("doc_id", "energy", F.round("z", 6).alias("z"))


@query()
def structure_marginals(spark, d):
    """How likely each base of each document is paired."""
    return folding.position_marginals(V.seqs(spark, d), "doc_id", "seq", folding.Model(24)).select("doc_id", "pos", F.round("p", 6).alias("p"))


# --- streams: the same operators over a stream of the table's files, run until what is there has been read ---


@query("SELECT time_bucket(INTERVAL '1 hour', ts::TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, d):
    counts = pipelines.windowed_counts(pipelines.table_stream(spark, d, "events"))
    return pipelines.finished(counts).select(F.col("window.start").alias("start"), "event_type", "n")


@query(SQL["coverage_bedgraph"])
def stream_coverage(spark, d):
    rows = V.reads_of(pipelines.table_stream(spark, d, "events"))
    return pipelines.finished_coverage(R.blocks(R.mapped(rows), "M", "seqname", "pos"), V.targets(spark, d))
