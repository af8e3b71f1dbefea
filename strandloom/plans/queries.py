"""Registered queries over the genomic view, each with SQL that DuckDB can run where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import annotation as A
from ..operators import intervals as I
from ..operators import reads as R
from ..operators import sampling
from ..shared import dealt, ordered
from . import view as V
from .registry import QUERIES, SQL, query

# --- interval algebra ---


@query(f"""WITH {V.EXON}, {V.merged_sql("exon", "gene_id, seqname, strand")}
SELECT gene_id, sum("end" - start)::BIGINT AS length FROM merged GROUP BY gene_id""")
def gene_union_length(spark, d):
    return I.union_length(V.exon(spark, d), ["gene_id"], ["seqname", "strand"])


@query(f"""WITH {V.IV}, {V.merged_sql("iv", "seqname", aggregates=", max(score) AS score, count(*) AS n")} SELECT * FROM merged""")
def interval_merge(spark, d):
    return I.merge(V.iv(spark, d), ["seqname"], F.max("score").alias("score"), F.count("*").alias("n"))


@query(f"""WITH {V.IV}, {V.merged_sql("iv", "seqname, strand", aggregates=", array_to_string(list_sort(list(DISTINCT name)), ';') AS name, max(score) AS score, count(*) AS n")} SELECT * FROM merged""")
def interval_merge_stranded(spark, d):
    return I.merge_named(V.iv(spark, d), ["seqname", "strand"])


@query(f"""WITH {V.IV}, {V.merged_sql("iv", "seqname, strand", touching=False)} SELECT * FROM merged""")
def interval_merge_apart(spark, d):
    return I.merge(V.iv(spark, d), ["seqname", "strand"], touching=False)


def _a(spark, d):
    return V.iv(spark, d).filter("line <= 3").groupBy("seqname", "strand", "start", "end", "name").agg(F.max("score").alias("score")).withColumn("id", F.concat_ws("|", "seqname", "strand", "start", "end", "name"))


_AB = f"""{V.IV}, a AS (SELECT seqname, strand, start, "end", name, max(score) AS score FROM iv WHERE line <= 3 GROUP BY ALL), b AS (SELECT * FROM iv WHERE line > 3)"""


@query(f"""WITH {_AB}, {V.merged_sql("b", "seqname, strand", "m")},
c AS (SELECT a.*, m.start AS s, m."end" AS e FROM a JOIN m ON a.seqname = m.seqname AND a.strand = m.strand AND a.start < m."end" AND m.start < a."end"),
cuts AS (SELECT seqname, strand, start, "end", name, score, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM c GROUP BY ALL),
p AS (SELECT seqname, strand, name, score, unnest(list_concat([start], es)) AS s, unnest(list_concat(ss, ["end"])) AS e, generate_subscripts(list_concat([start], es), 1) AS i, start AS s0, "end" AS e0 FROM cuts),
q AS (SELECT * FROM p WHERE s < e)
SELECT seqname, strand, s AS start, e AS "end", name, score, row_number() OVER (PARTITION BY seqname, strand, s0, e0, name ORDER BY i)::INTEGER AS piece FROM q
UNION ALL SELECT seqname, strand, start, "end", name, score, 0 FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE a.seqname = m.seqname AND a.strand = m.strand AND a.start < m."end" AND m.start < a."end")""")
def interval_subtract(spark, d):
    return I.subtract(_a(spark, d), V.iv(spark, d).filter("line > 3"), ["seqname", "strand"], "id").drop("id")


@query(f"""WITH {V.IV}, o AS (SELECT seqname, strand, supp % 7 AS owner, start, "end" FROM iv), {V.merged_sql("o", "seqname, owner", "m")},
ev AS (SELECT seqname, p, sum(d) AS d, sum(o) AS o FROM (SELECT seqname, start AS p, 1 AS d, owner AS o FROM m UNION ALL SELECT seqname, "end", -1, -owner FROM m) GROUP BY seqname, p),
run AS (SELECT seqname, p, sum(d) OVER w AS n, sum(o) OVER w AS owner, lead(p) OVER (PARTITION BY seqname ORDER BY p) AS nx FROM ev WINDOW w AS (PARTITION BY seqname ORDER BY p)),
seg AS (SELECT seqname, owner::BIGINT AS owner, p AS start, nx AS "end" FROM run WHERE n = 1), {V.merged_sql("seg", "seqname, owner", "f")} SELECT * FROM f""")
def interval_disjoin_unique(spark, d):
    owned = V.iv(spark, d).withColumn("owner", F.col("supp") % 7)
    return I.disjoin_unique(owned, ["seqname"], "owner")


@query(f"""WITH {V.IV}, a AS (SELECT seqname, start, "end", name FROM iv), b AS (SELECT seqname, start AS start_b, "end" AS end_b, name AS name_b FROM iv)
SELECT a.seqname, start, "end", name, start_b, end_b, name_b FROM a JOIN b ON a.seqname = b.seqname AND start < end_b AND start_b < "end" """)
def interval_overlap_join(spark, d):
    rows = V.iv(spark, d).select("seqname", "start", "end", "name")
    return I.interval_join(rows, rows, ["seqname"]).drop("seqname_b")


@query(f"""WITH {V.EXON}, x AS (SELECT *, lead(start) OVER (PARTITION BY transcript_id ORDER BY start, "end") AS nx FROM exon)
SELECT transcript_id, gene_id, seqname, strand, "end" AS start, nx AS "end" FROM x WHERE nx > "end" """)
def introns(spark, d):
    return A.introns(V.exon(spark, d))


@query(f"""WITH {V.EXON}, x AS (SELECT *, lead(start) OVER (PARTITION BY transcript_id ORDER BY start, "end") AS nx FROM exon)
SELECT 'exon' AS feature, transcript_id, gene_id, seqname, strand, start, "end" FROM exon UNION ALL
SELECT 'intron', transcript_id, gene_id, seqname, strand, "end", nx FROM x WHERE nx > "end" """)
def introns_union_sorted(spark, d):
    return ordered(A.exons_and_introns(V.exon(spark, d)), "seqname", "start", "end", "transcript_id")


@query(f"""WITH {V.EXON} SELECT transcript_id, min(gene_id) AS gene_id, min(seqname) AS seqname, min(strand) AS strand, min(start) AS start, max("end") AS "end" FROM exon
GROUP BY transcript_id HAVING count(DISTINCT seqname || strand) = 1""")
def transcript_extent(spark, d):
    return A.extents(V.exon(spark, d), ["transcript_id"], "gene_id")


@query(f"""WITH {V.EXON} SELECT gene_id, min(seqname) AS seqname, min(strand) AS strand, min(start) AS start, max("end") AS "end" FROM exon
GROUP BY gene_id HAVING count(DISTINCT seqname || strand) = 1""")
def gene_extent(spark, d):
    return A.extents(V.exon(spark, d), ["gene_id"])


@query(f"""WITH {V.EXON}, x AS (SELECT transcript_id, min(seqname) AS seqname, min(strand) AS strand, min(start) AS start, max("end") AS "end" FROM exon GROUP BY transcript_id),
{V.merged_sql("x", "seqname, strand")} SELECT * FROM merged""")
def annotated_regions(spark, d):
    return A.annotated_regions(V.exon(spark, d), ["transcript_id"])


@query(f"""WITH {V.EXON}, wide AS (SELECT *, "end" + (CASE WHEN transcript_id % 5 = 0 THEN 900 ELSE 0 END) AS e FROM exon),
x AS (SELECT seqname, strand, transcript_id, min(start) AS start, max(e) AS "end" FROM wide GROUP BY ALL),
w AS (SELECT *, lag("end") OVER o AS pe, lead(start) OVER o AS ns FROM x WINDOW o AS (PARTITION BY seqname, strand ORDER BY start, transcript_id))
SELECT transcript_id, seqname, strand, start, "end" FROM w WHERE NOT coalesce(pe > start, false) AND NOT coalesce(ns < "end", false)""")
def isolate_transcripts(spark, d):
    wide = V.exon(spark, d).withColumn("end", F.col("end") + F.when(F.col("transcript_id") % 5 == 0, 900).otherwise(0))
    return A.isolated(wide)


def _iv_reads(spark, d):
    return V.iv(spark, d).select(F.col("seqname"), F.col("strand"), "start", "end")


@query(f"""WITH {V.READS}, r AS (SELECT seqname, pos AS start, pos + 10 AS e FROM reads),
g AS (SELECT DISTINCT seqname, pos // 100 * 100 AS start, pos // 100 * 100 + 150 AS "end" FROM reads)
SELECT g.seqname, g.start, g."end", count(r.start)::BIGINT AS n FROM g LEFT JOIN r ON g.seqname = r.seqname AND g.start < r.e AND r.start < g."end" GROUP BY ALL""")
def region_read_count(spark, d):
    rows = V.reads(spark, d)
    low = F.floor(F.col("pos") / 100) * 100
    regions = rows.select("seqname", low.alias("start"), (low + 150).alias("end")).distinct()
    spans = rows.select("seqname", F.col("pos").alias("start"), (F.col("pos") + 10).alias("end"))
    return I.count_overlaps(regions, spans, ["seqname"], ["seqname", "start", "end"])


_ENDS = V.WALK + """, span AS (SELECT event_id, sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN len ELSE 0 END)::BIGINT AS l FROM w0 GROUP BY event_id),
ends AS (SELECT reads.*, pos + l AS rend, CASE WHEN (flag & 16) > 0 THEN pos + l - 1 ELSE pos END AS "at", CASE WHEN (flag & 16) > 0 THEN '-' ELSE '+' END AS strand FROM reads JOIN span USING (event_id))"""


@query(f'WITH {_ENDS} SELECT seqname, strand, "at", count(*) AS n FROM ends WHERE (flag & 64) > 0 OR (flag & 128) = 0 GROUP BY ALL')
def five_prime_counts(spark, d):
    rows = R.five_prime(V.reads(spark, d)).filter(R.has(F.col("flag"), R.READ1) | ~R.has(F.col("flag"), R.READ2))
    return rows.groupBy("seqname", R.strand(F.col("flag")).alias("strand"), "at").agg(F.count("*").alias("n"))


@query(f"""WITH {V.READS}, {V.TARGETS}, g AS (SELECT seqname, unnest(range(0, length // 1000 + 1)) AS bin FROM targets), c AS (SELECT seqname, pos // 1000 AS bin, count(*) AS n FROM reads GROUP BY ALL)
SELECT seqname, bin, coalesce(n, 0)::BIGINT AS n FROM g LEFT JOIN c USING (seqname, bin)""")
def binned_coverage(spark, d):
    return I.bin_counts(V.reads(spark, d), V.targets(spark, d), 1000)


@query(f"""WITH {V.READS}, {V.TARGETS}, g AS (SELECT seqname, unnest(range(0, length // 500 + 1)) AS bin FROM targets),
u AS (SELECT seqname, pos FROM reads WHERE event_id % 2 = 0 UNION ALL SELECT seqname, pos FROM reads WHERE event_id % 2 = 1 OR event_id % 3 = 0), c AS (SELECT seqname, pos // 500 AS bin, count(*) AS n FROM u GROUP BY ALL)
SELECT seqname, bin, coalesce(n, 0)::BIGINT AS n FROM g LEFT JOIN c USING (seqname, bin)""")
def binned_coverage_multi(spark, d):
    rows = V.reads(spark, d)
    return I.bin_counts(rows.filter("event_id % 2 = 0").union(rows.filter("event_id % 2 = 1 or event_id % 3 = 0")), V.targets(spark, d), 500)


def _coverage_sql(blocks: str) -> str:
    return f"""WITH {V.WALK}, {V.TARGETS}, b AS ({blocks}),
ev AS (SELECT seqname, p, sum(d) AS d FROM (SELECT seqname, s AS p, 1 AS d FROM b UNION ALL SELECT seqname, e, -1 FROM b UNION ALL SELECT DISTINCT seqname, 0, 0 FROM b) GROUP BY ALL),
dp AS (SELECT seqname, p, sum(d) OVER (PARTITION BY seqname ORDER BY p)::BIGINT AS depth FROM ev),
ch AS (SELECT *, lag(depth) OVER (PARTITION BY seqname ORDER BY p) AS prev FROM dp),
rl AS (SELECT seqname, p AS start, lead(p) OVER (PARTITION BY seqname ORDER BY p) AS nx, depth FROM ch WHERE prev IS NULL OR prev <> depth)
SELECT seqname, start, coalesce(nx, length) AS "end", depth FROM rl JOIN targets USING (seqname) WHERE coalesce(nx, length) > start"""


@query(_coverage_sql("SELECT seqname, s, s + len AS e FROM walk WHERE op = 'M' AND (flag & 4) = 0"))
def coverage_bedgraph(spark, d):
    return R.depth_runs(V.reads(spark, d), V.targets(spark, d))


@query(_coverage_sql("SELECT seqname, pos AS s, pos + 1 AS e FROM reads WHERE (flag & 20) = 0"))
def coverage_starts(spark, d):
    return R.depth_runs(V.reads(spark, d), V.targets(spark, d), "+", True)


@query(f"WITH {V.WALK} SELECT qname, seqname, s AS start, s + len AS \"end\" FROM walk WHERE op = 'N' AND (flag & 4) = 0")
def junctions(spark, d):
    return R.junctions(V.reads(spark, d))


@query(f"""WITH {V.WALK} SELECT CASE WHEN (flag & 16) > 0 THEN seqname || ':' || (s + len) || '..' || s ELSE seqname || ':' || s || '..' || (s + len) END AS junction FROM walk WHERE op = 'N' AND val % 2 = 0 AND (flag & 4) = 0""")
def junctions_stranded(spark, d):
    tag = F.when(F.col("val") % 2 == 0, F.create_map(F.lit("XS"), F.struct(F.lit("A").alias("type"), R.strand(F.col("flag")).alias("value"))))
    return R.junction_labels(V.reads(spark, d).withColumn("aux", tag))


@query(f"""WITH {V.WALK}, a AS (SELECT event_id, qname || CASE WHEN (flag & 64) > 0 THEN '/1' WHEN (flag & 128) > 0 THEN '/2' ELSE '' END || '#' || (event_id // 3) AS key, bool_or(op IN ('S', 'H')) AS clipped,
  bool_or(op = 'N' AND len >= 50) AS spliced, bool_or(op = 'N' AND len < 50) AS gapped, bool_and(op IN ('M', 'N')) AS perfect FROM walk WHERE (flag & 4) = 0 GROUP BY ALL),
k AS (SELECT key, count(*) AS n, count_if(NOT spliced AND perfect) AS up, count_if(spliced AND perfect) AS sp, count_if(spliced) AS s, count_if(gapped) AS g FROM a WHERE NOT clipped GROUP BY key)
SELECT (SELECT count(*) FROM a) AS alignment_count, count(*) AS read_count, count_if(n > 1)::BIGINT AS multi_count, sum(up)::BIGINT AS unspliced_perfect_cnt, sum(sp)::BIGINT AS spliced_perfect_cnt, sum(s)::BIGINT AS spliced_cnt, sum(g)::BIGINT AS gapped_cnt,
 coalesce(sum(up) FILTER (n = 1), 0)::BIGINT AS unique_unspliced_perfect_cnt, coalesce(sum(sp) FILTER (n = 1), 0)::BIGINT AS unique_spliced_perfect_cnt, coalesce(sum(s) FILTER (n = 1), 0)::BIGINT AS unique_spliced_cnt, coalesce(sum(g) FILTER (n = 1), 0)::BIGINT AS unique_gapped_cnt FROM k""")
def read_summary(spark, d):
    rows = V.reads(spark, d)
    # names repeat too often in this view: a third of an event number tells reads apart
    sep = F.concat(F.lit("#"), F.floor(F.col("event_id") / 3).cast("string"))
    return R.summary(rows.withColumn("qname", F.concat("qname", sep)))


@query(f"WITH {V.READS} SELECT event_id, qname, seqname, pos FROM (SELECT *, count(*) OVER (PARTITION BY qname, seqname, pos // 600) AS k FROM reads) WHERE k = 1")
def unique_reads(spark, d):
    rows = V.reads(spark, d)
    return R.unique(rows, F.struct("qname", "seqname", F.floor(F.col("pos") / 600))).select("event_id", "qname", "seqname", "pos")


_LISTED = "listed AS (SELECT DISTINCT qname FROM reads WHERE val > 300)"


@query(f"WITH {V.READS}, {_LISTED} SELECT event_id, qname FROM reads WHERE qname IN (SELECT qname FROM listed)")
def mapped_semi(spark, d):
    rows = V.reads(spark, d)
    return R.with_ids(rows, rows.filter("val > 300")).select("event_id", "qname")


@query(f"WITH {V.READS}, {_LISTED} SELECT event_id, qname FROM reads WHERE qname NOT IN (SELECT qname FROM listed)")
def mapped_anti(spark, d):
    rows = V.reads(spark, d)
    return R.with_ids(rows, rows.filter("val > 300"), keep=False).select("event_id", "qname")


@query(f"""WITH {V.READS} SELECT event_id AS ord, qname || '/1' AS id1 FROM reads WHERE qname NOT IN (SELECT qname FROM reads WHERE val > 350 UNION SELECT qname FROM reads WHERE event_id % 97 = 0)""")
def pair_anti(spark, d):
    rows = V.reads(spark, d)
    pairs = rows.select(F.col("event_id").alias("ord"), F.concat("qname", F.lit("/1")).alias("id1"))
    return R.unmapped_pairs(pairs, rows.filter("val > 350"), rows.filter("event_id % 97 = 0"))


@query(f"WITH {V.READS}, a AS (SELECT event_id // 2 AS ord, qname, val FROM reads WHERE event_id % 2 = 0), b AS (SELECT event_id // 2 AS ord, qname AS qname_2, val AS val_2 FROM reads WHERE event_id % 2 = 1) SELECT * FROM a JOIN b USING (ord)")
def zip_files(spark, d):
    rows = V.reads(spark, d).withColumn("ord", F.floor(F.col("event_id") / 2))
    half = lambda k: rows.filter(F.col("event_id") % 2 == k).select("ord", "qname", "val")
    return R.zipped(half(0), half(1))


def _nearest_sql(best: str, sign: str, side: str, at: str, probe: str) -> str:
    return f"""WITH {V.IV}, g AS (SELECT seqname, {at} AS at, min(name) AS name FROM iv GROUP BY ALL), p AS (SELECT DISTINCT seqname, start, "end" FROM iv)
SELECT p.seqname, p.start, p."end", g.name AS name_near, abs(g.at - p.{probe})::BIGINT AS _distance FROM p ASOF LEFT JOIN g ON p.seqname = g.seqname AND p.{probe} {sign} g.at"""


@query(_nearest_sql("max", ">=", "left", '"end"', "start"))
def nearest_left(spark, d):
    rows = V.iv(spark, d)
    return I.nearest(rows.select("seqname", "start", "end").distinct(), rows, ["seqname"], "start", "end", "left", "name")


@query(_nearest_sql("min", "<=", "right", "start", '"end"'))
def nearest_right(spark, d):
    rows = V.iv(spark, d)
    return I.nearest(rows.select("seqname", "start", "end").distinct(), rows, ["seqname"], "end", "start", "right", "name")


# --- counts and summaries ---


@query(f"WITH {V.SEQS} SELECT substr(seq, 1, 6) AS key, count(*) AS n FROM seqs GROUP BY ALL")
def prefix_counts(spark, d):
    return R.multiplicity(V.seqs(spark, d), F.substring("seq", 1, 6))


@query(f"""WITH {V.SEQS}, c AS (SELECT substr(seq, 1, 6) AS key, count(*) AS n FROM seqs WHERE length(seq) >= 6 GROUP BY ALL),
j AS (SELECT a.key, sum(b.n) AS m FROM c a JOIN c b ON a.key <> b.key AND hamming(a.key, b.key) <= 2 GROUP BY a.key)
SELECT c.key, n, coalesce(m, 0)::BIGINT AS neighbours FROM c LEFT JOIN j USING (key)""")
def hamming_counts(spark, d):
    return R.hamming_counts(V.seqs(spark, d), F.col("seq"), 6, 2)


@query(f"""WITH {V.SEQS.replace("seqs AS", "s0 AS")}, seqs AS (SELECT CASE doc_id % 9 WHEN 1 THEN seq || 'N' WHEN 2 THEN '.' || seq ELSE seq END AS seq FROM s0), c AS (SELECT seq, count(*) AS n FROM seqs WHERE NOT contains(seq, '.') AND NOT contains(seq, 'N') GROUP BY seq)
SELECT n, count(*) AS distinct_seqs FROM c GROUP BY n UNION ALL SELECT 0, count(*) FILTER (contains(seq, '.') OR contains(seq, 'N')) FROM seqs""")
def duplicate_reads(spark, d):
    i = F.col("doc_id") % 9
    some = F.when(i == 1, F.concat("seq", F.lit("N"))).when(i == 2, F.concat(F.lit("."), "seq")).otherwise(F.col("seq"))
    return R.duplicates(V.seqs(spark, d).withColumn("seq", some), "seq")


@query(f"""WITH {V.READS}, c AS (SELECT qname, count(*) AS n FROM reads GROUP BY qname)
SELECT qname, n, row_number() OVER (ORDER BY n DESC, qname) AS rank, sum(n) OVER (ORDER BY n DESC, qname ROWS UNBOUNDED PRECEDING) / (SELECT sum(n) FROM c) AS share FROM c""")
def cumulative_share(spark, d):
    counts = V.reads(spark, d).groupBy("qname").agg(F.count("*").alias("n"))
    return R.cumulative_share(counts, "n", "qname")


@query(f"WITH {V.READS} SELECT seqname, count_if((flag & 4) = 0)::BIGINT AS mapped, count_if((flag & 4) > 0)::BIGINT AS unmapped FROM reads GROUP BY seqname")
def index_statistics(spark, d):
    return R.flagstats(V.reads(spark, d))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(f"""SELECT k, {", ".join(f"count_if(event_type = '{t}')::BIGINT AS {t}" for t in _TYPES)} FROM (SELECT (props->>'k')::BIGINT AS k, event_type FROM events) GROUP BY k""")
def attribute_pivot(spark, d):
    rows = V.table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")
    return rows.groupBy("k").pivot("event_type", _TYPES).agg(F.count(F.lit(1))).select("k", *(F.coalesce(t, F.lit(0)).cast("long").alias(t) for t in _TYPES))


@query("SELECT l_returnflag AS g, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 6) AS slope FROM lineitem WHERE l_discount < 0.05 GROUP BY 1")
def ratio_regression(spark, d):
    rows = V.table(spark, d, "lineitem").filter("l_discount < 0.05").withColumnRenamed("l_returnflag", "g")
    return A.slope_through_origin(rows, "l_quantity", "l_extendedprice", "g").withColumn("slope", F.round("slope", 6))


@query(f"""WITH {V.IV}, u AS (SELECT supp % 20 AS i, supp % 13 AS j, score AS p FROM iv) SELECT k, round(sum(p), 6) AS p FROM (SELECT i AS k, p FROM u UNION ALL SELECT j, p FROM u) GROUP BY k""")
def pair_marginals(spark, d):
    u = V.iv(spark, d).select((F.col("supp") % 20).alias("i"), (F.col("supp") % 13).alias("j"), F.col("score").alias("p"))
    return A.pair_marginals(u).withColumn("p", F.round("p", 6))


@query(f"WITH {V.IV} SELECT seqname, start, \"end\", strand, part, score FROM (SELECT *, row_number() OVER (PARTITION BY seqname, start, \"end\", strand ORDER BY line, part, score, supp) AS r FROM iv) WHERE r = 1")
def first_row_wins(spark, d):
    w = Window.partitionBy("seqname", "start", "end", "strand").orderBy("line", "part", "score", "supp")
    return V.iv(spark, d).withColumn("r", F.row_number().over(w)).filter("r = 1").select("seqname", "start", "end", "strand", "part", "score")


@query("SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region UNION ALL SELECT s_name, 'supplier' FROM supplier")
def union_all_tables(spark, d):
    part = lambda t, c: V.table(spark, d, t).select(F.col(c).alias("name"), F.lit(t).alias("kind"))
    return part("nation", "n_name").unionByName(part("region", "r_name")).unionByName(part("supplier", "s_name"))


# --- annotation ---


@query(f"""WITH {V.EXON}, t AS (SELECT transcript_id, min(gene_id) AS gene_id, min(seqname) AS seqname, min(strand) AS strand, min(start) // 100000 * 100000 AS start, max("end") // 100000 * 100000 + 100000 AS "end" FROM exon GROUP BY transcript_id HAVING count(*) > 1),
o AS (SELECT seqname, strand, start, "end", min(gene_id) AS gene_id, array_to_string(list_sort(list(DISTINCT transcript_id::VARCHAR)), ',') AS spliced_transcript_ids FROM t GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY seqname, start, "end", strand)::VARCHAR AS k FROM o)
SELECT seqname, strand, start, "end", gene_id, spliced_transcript_ids, gene_id || '.pre-mrna.' || CASE WHEN length(k) < 3 THEN lpad(k, 3, '0') ELSE k END AS transcript_id FROM n""")
def premrna(spark, d):
    # extents are widened to whole blocks of 100 kb so that transcripts of this view share some
    ends = A.consistent(V.exon(spark, d)).groupBy("transcript_id").agg(F.min("start").alias("a"), F.max("end").alias("b"), F.count("*").alias("k"))
    wide = V.exon(spark, d).join(ends, "transcript_id").withColumn("start", F.when(F.col("start") == F.col("a"), F.floor(F.col("a") / 100000) * 100000).otherwise(F.col("start"))).withColumn("end", F.when(F.col("end") == F.col("b"), F.floor(F.col("b") / 100000) * 100000 + 100000).otherwise(F.col("end")))
    return A.pre_mrna(wide.drop("a", "b", "k"))


_LIFT = f"""{V.EXON}, off AS (SELECT *, coalesce(sum("end" - start) OVER (PARTITION BY transcript_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM exon),
aln AS (SELECT 'r' || transcript_id || '.' || k AS qname, transcript_id, k * 7 AS tpos, 25 AS length FROM (SELECT DISTINCT transcript_id FROM exon), (SELECT unnest(range(0, 3)) AS k))"""


@query(f"""WITH {_LIFT}, p AS (SELECT qname, transcript_id, tpos, length, seqname, greatest(tpos, before) AS a, least(tpos + length, before + "end" - start) AS b, start + greatest(tpos, before) - before AS s FROM aln JOIN off USING (transcript_id)),
m AS (SELECT *, b - a AS m, lag(s + b - a) OVER (PARTITION BY qname ORDER BY s) AS pe FROM p WHERE b > a)
SELECT qname, seqname, min(s) AS pos, string_agg(CASE WHEN pe IS NULL THEN '' ELSE (s - pe) || 'N' END || m || 'M', '' ORDER BY s) AS cigar FROM m GROUP BY qname, seqname, length HAVING sum(m) = length""")
def coordinate_lift(spark, d):
    ids = V.exon(spark, d).select("transcript_id").distinct()
    aln = ids.select("transcript_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select(F.concat(F.lit("r"), F.col("transcript_id").cast("string"), F.lit("."), F.col("k").cast("string")).alias("qname"), "transcript_id", (F.col("k") * 7).alias("tpos"), F.lit(25).alias("length"))
    return A.lift(aln, V.exon(spark, d))


@query(f"""WITH {V.EXON}, {V.merged_sql("exon", "gene_id, seqname, strand", "m", touching=False)}, g AS (SELECT *, coalesce(sum("end" - start) OVER (PARTITION BY gene_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum("end" - start) OVER (PARTITION BY gene_id) + 1 AS glen FROM m),
r AS (SELECT seqname, strand, start + 3 AS a5 FROM exon WHERE transcript_id % 2 = 0 UNION ALL SELECT seqname, strand, start + 5 FROM exon),
h AS (SELECT gene_id, glen, strand, before + a5 - start AS o FROM g JOIN r USING (seqname, strand) WHERE a5 >= start AND a5 < "end" AND glen >= 200),
c AS (SELECT gene_id, floor(20 * (CASE WHEN strand = '+' THEN o ELSE glen - 1 - o END) / glen)::BIGINT AS bin, count(*) AS k FROM h GROUP BY ALL),
t AS (SELECT *, sum(k) OVER (PARTITION BY gene_id) AS total FROM c), y AS (SELECT bin, sum(k / total) AS y FROM t WHERE total >= 10 GROUP BY bin)
SELECT b.bin, 100.0::DOUBLE * b.bin / 20 AS x, round(coalesce(y, 0) / (SELECT sum(y) FROM y), 9) AS y FROM (SELECT unnest(range(0, 20)) AS bin) b LEFT JOIN y USING (bin)""")
def metagene_profile(spark, d):
    ex = V.exon(spark, d)
    at = lambda df, k: df.select("seqname", "strand", (F.col("start") + k).alias("at"))
    rows = at(ex.filter("transcript_id % 2 = 0"), 3).union(at(ex, 5))
    return A.metagene(ex, rows, 20, 200, 10).select("bin", "x", F.round("y", 9).alias("y"))


@query(f"""WITH {V.EXON}, o AS (SELECT transcript_id, strand, start, "end", "end" - start AS l, lead(start) OVER w - "end" AS g, row_number() OVER w AS i, count(*) OVER (PARTITION BY transcript_id) AS n FROM exon WINDOW w AS (PARTITION BY transcript_id ORDER BY start, "end"))
SELECT transcript_id, (count(*) - 1)::BIGINT AS intron_count, sum(g)::BIGINT AS intronic_length, median(g)::DOUBLE AS median_intron_length,
 CASE WHEN min(strand) = '-' THEN max(g) FILTER (i = 1) ELSE max(g) FILTER (i = n - 1) END AS terminal_intron_length,
 CASE WHEN min(strand) = '-' THEN max(l) FILTER (i = n) ELSE max(l) FILTER (i = 1) END AS five_prime_utr_length, CASE WHEN min(strand) = '-' THEN max(l) FILTER (i = 1) ELSE max(l) FILTER (i = n) END AS three_prime_utr_length,
 sum(l)::BIGINT AS exonic_length, median(l)::DOUBLE AS median_exonic_length FROM o GROUP BY transcript_id""")
def transcript_structure(spark, d):
    return A.transcript_structure(V.exon(spark, d))


@query(f"""WITH {V.EXON}, x AS (SELECT *, lead(start) OVER (PARTITION BY transcript_id ORDER BY start, "end") AS nx FROM exon),
f AS (SELECT transcript_id, seqname, strand, start, "end", 'exon' AS kind FROM exon UNION ALL SELECT transcript_id, seqname, strand, "end", nx, 'intron' FROM x WHERE nx > "end"),
r AS (SELECT seqname, strand, start + 40 AS s, start + 70 AS e FROM exon),
h AS (SELECT transcript_id, kind, count(r.s) AS reads FROM f JOIN r ON f.seqname = r.seqname AND f.strand = r.strand AND f.start < r.e AND r.s < f."end" GROUP BY ALL),
l AS (SELECT transcript_id, kind, sum("end" - start) AS length FROM f GROUP BY ALL)
SELECT transcript_id, coalesce(sum(reads) FILTER (kind = 'exon'), 0)::BIGINT AS exon_reads, coalesce(sum(reads) FILTER (kind = 'intron'), 0)::BIGINT AS intron_reads, sum(length) FILTER (kind = 'exon')::BIGINT AS exon_length, sum(length) FILTER (kind = 'intron')::BIGINT AS intron_length
FROM l LEFT JOIN h USING (transcript_id, kind) GROUP BY transcript_id HAVING coalesce(sum(length) FILTER (kind = 'exon'), 0) > 0 AND coalesce(sum(length) FILTER (kind = 'intron'), 0) > 0""")
def exon_intron_reads(spark, d):
    ex = V.exon(spark, d)
    rows = ex.select("seqname", "strand", (F.col("start") + 40).alias("start"), (F.col("start") + 70).alias("end"))
    return A.reads_per_feature(ex.select("transcript_id").distinct(), ex, rows)


_GENOME = "genome AS (SELECT seqname, string_agg(seq, '' ORDER BY doc_id) AS seq FROM (SELECT doc_id, 'c' || (doc_id % 5) AS seqname, seq FROM seqs) GROUP BY seqname)"
_FEATURES = """feat AS (SELECT f.*, 'c' || (transcript_id % 5) AS sn FROM (SELECT transcript_id, strand, (transcript_id % 50) * 20 + i * 60 AS start, (transcript_id % 50) * 20 + i * 60 + len AS "end" FROM
 (SELECT l_orderkey AS transcript_id, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, l_linenumber AS i, floor(max(l_quantity))::BIGINT AS len FROM lineitem GROUP BY ALL)) f)"""


def _genome(spark, d, width=1000):
    """Five artificial chromosomes, the sequences of every fifth document in order of id, in chunks of `width`."""
    parts = V.seqs(spark, d).withColumn("seqname", F.concat(F.lit("c"), (F.col("doc_id") % 5).cast("string")))
    ends = I.running(parts.select("seqname", F.col("doc_id").alias("p"), F.length("seq").cast("long").alias("size")), ["seqname"], "size")
    at = parts.join(ends.select("seqname", F.col("p").alias("doc_id"), F.col("size").alias("stop")), ["seqname", "doc_id"]).withColumn("begin", F.col("stop") - F.length("seq"))
    dealt = at.filter("stop > begin").select("seqname", "seq", "begin", F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("stop") - 1) / width))).alias("c"))
    first = F.greatest(F.col("c") * width - F.col("begin"), F.lit(0))
    piece = F.struct(F.col("begin"), F.substr("seq", (first + 1).cast("int"), F.least((F.col("c") + 1) * width - F.col("begin") - first, F.lit(width)).cast("int")).alias("seq"))
    chunks = dealt.groupBy("seqname", "c").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    return chunks.select("seqname", (F.col("c") * width).alias("chunk_start"), F.array_join(F.transform("p", lambda x: x["seq"]), "").alias("seq"))


def _features(spark, d):
    lines = dealt(V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey")
    own = lines.groupBy(F.col("l_orderkey").alias("transcript_id"), F.col("l_linenumber").alias("i")).agg(F.floor(F.max("l_quantity")).alias("len"))
    start = (F.col("transcript_id") % 50) * 20 + F.col("i") * 60
    return own.select("transcript_id", F.when(F.col("transcript_id") % 2 == 0, "+").otherwise("-").alias("strand"), F.concat(F.lit("c"), (F.col("transcript_id") % 5).cast("string")).alias("seqname"), start.alias("start"), (start + F.col("len")).alias("end"))


@query(f"""WITH {V.SEQS}, {_GENOME}, {_FEATURES}, s AS (SELECT transcript_id, min(strand) AS strand, string_agg(substr(seq, start + 1, "end" - start), '' ORDER BY start) AS seq FROM feat JOIN genome ON sn = seqname GROUP BY transcript_id)
SELECT transcript_id, CASE WHEN strand = '-' THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq FROM s""")
def splice_sequence(spark, d):
    return A.spliced_sequences(_features(spark, d), _genome(spark, d), width=1000)


# --- strings ---


@query("""WITH n AS (SELECT l_partkey % 130 AS k, l_partkey % 7 AS m FROM lineitem), t AS (SELECT CASE m WHEN 0 THEN 'X' WHEN 1 THEN 'MT' WHEN 2 THEN k || 'a' WHEN 3 THEN k || '_random' WHEN 4 THEN 'GL' || k ELSE k::VARCHAR END AS name FROM n)
SELECT name, CASE WHEN regexp_matches(name, '^[0-9]{1,2}[a-z]?$') OR name IN ('X', 'Y') OR contains(name, 'random') THEN 'chr' || name WHEN name = 'MT' THEN 'chrM' ELSE name END AS ucsc, count(*) AS n FROM t GROUP BY name""")
def chrom_rename(spark, d):
    k, m = (F.col("l_partkey") % 130).cast("string"), F.col("l_partkey") % 7
    name = F.when(m == 0, "X").when(m == 1, "MT").when(m == 2, F.concat(k, F.lit("a"))).when(m == 3, F.concat(k, F.lit("_random"))).when(m == 4, F.concat(F.lit("GL"), k)).otherwise(k)
    return V.table(spark, d, "lineitem").groupBy(name.alias("name")).agg(F.count("*").alias("n")).withColumn("ucsc", S.to_ucsc(F.col("name")))


@query("""WITH t AS (SELECT l_partkey, CASE l_partkey % 5 WHEN 0 THEN l_partkey::VARCHAR WHEN 1 THEN '1e-' || (l_partkey % 40) WHEN 2 THEN '0.0' || (l_partkey % 97) WHEN 3 THEN '.' ELSE '-0.5' END AS score FROM lineitem)
SELECT score, count(*) AS n, CASE WHEN contains(score, 'e') OR contains(score, '.') THEN CASE WHEN try_cast(score AS DOUBLE) > 0 THEN trunc(-10 * log10(try_cast(score AS DOUBLE)))::BIGINT ELSE 0 END ELSE coalesce(try_cast(score AS BIGINT), 0) END AS phred FROM t GROUP BY score""")
def score_to_phred(spark, d):
    p = F.col("l_partkey")
    text = F.when(p % 5 == 0, p.cast("string")).when(p % 5 == 1, F.concat(F.lit("1e-"), (p % 40).cast("string"))).when(p % 5 == 2, F.concat(F.lit("0.0"), (p % 97).cast("string"))).when(p % 5 == 3, ".").otherwise("-0.5")
    return V.table(spark, d, "lineitem").groupBy(text.alias("score")).agg(F.count("*").alias("n")).withColumn("phred", S.score_to_phred(F.col("score")))


@query(f"WITH {V.IV} SELECT seqname, start, name FROM iv WHERE seqname IN ('A', 'N')")
def chrom_semi_filter(spark, d):
    sizes = spark.createDataFrame([("A", 1), ("N", 2)], "seqname string, length long")
    return V.iv(spark, d).join(F.broadcast(sizes), "seqname", "left_semi").select("seqname", "start", "name")


@query(f"WITH {V.SEQS} SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM seqs")
def reverse_complement(spark, d):
    return V.seqs(spark, d).select("doc_id", S.reverse_complement(F.col("seq")).alias("rc"))


@query(f"WITH {V.SEQS} SELECT doc_id, length(regexp_replace(seq, '[^GC]', '', 'g'))::BIGINT AS gc, round(length(regexp_replace(seq, '[^GC]', '', 'g')) / nullif(length(seq), 0), 9) AS share FROM seqs")
def gc_stats(spark, d):
    return V.seqs(spark, d).select("doc_id", S.count_of(F.col("seq"), "GC").alias("gc"), F.round(S.gc_fraction(F.col("seq")), 9).alias("share"))


@query(f"WITH {V.SEQS} SELECT doc_id, len(regexp_extract_all(seq, 'TAG|TAA|TGA'))::BIGINT AS stops, len(regexp_extract_all(seq, 'CTA|TTA|TCA'))::BIGINT AS reverse_stops FROM seqs")
def stop_codon_counts(spark, d):
    return V.seqs(spark, d).select("doc_id", S.stop_codons(F.col("seq")).alias("stops"), S.stop_codons(F.col("seq"), True).alias("reverse_stops"))


@query(f"WITH {V.SEQS} SELECT doc_id, regexp_replace(regexp_replace(seq, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10) || '$', '') AS wrapped FROM seqs")
def line_wrap(spark, d):
    return V.seqs(spark, d).select("doc_id", S.wrap(F.col("seq"), 80).alias("wrapped"))


@query(f"WITH {V.SEQS} SELECT doc_id, CASE WHEN least(30, length(seq) - 1) >= 5 THEN substr(seq, 6, least(30, length(seq) - 1) - 4) ELSE '' END AS part FROM seqs")
def sequence_fetch(spark, d):
    return V.seqs(spark, d).select("doc_id", S.fetch(F.col("seq"), F.lit(5), F.lit(30)).alias("part"))


@query(f"WITH {V.SEQS} SELECT doc_id, seq FROM seqs WHERE regexp_matches(seq, 'TA[AC]T')")
def regex_filter(spark, d):
    return V.seqs(spark, d).filter(F.col("seq").rlike("TA[AC]T"))


@query(f"WITH {V.SEQS} SELECT doc_id, seq FROM seqs WHERE NOT regexp_matches(seq, 'TA[AC]T')")
def regex_filter_invert(spark, d):
    return V.seqs(spark, d).filter(~F.col("seq").rlike("TA[AC]T"))


@query(f"WITH {V.SEQS} SELECT doc_id, seq FROM seqs ORDER BY doc_id LIMIT 10")
def seq_head(spark, d):
    return V.seqs(spark, d).orderBy("doc_id").limit(10)


_TAILED = f"{V.SEQS}, tailed AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'TTTTTT' || seq || 'AAAAA' WHEN 1 THEN seq || 'aaaa' ELSE seq END AS seq FROM seqs)"


@query(f"""WITH {_TAILED}, h AS (SELECT doc_id, seq, length(regexp_extract(seq, '(?i)^T{{4,}}')) AS head FROM tailed)
SELECT doc_id, head::INTEGER AS head, regexp_replace(substr(seq, head + 1), '(?i)A{{4,}}$', '') AS kept FROM h WHERE length(regexp_replace(substr(seq, head + 1), '(?i)A{{4,}}$', '')) < length(seq)""")
def poly_trim(spark, d):
    seq = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("TTTTTT"), F.col("seq"), F.lit("AAAAA"))).when(F.col("doc_id") % 3 == 1, F.concat(F.col("seq"), F.lit("aaaa"))).otherwise(F.col("seq"))
    rows = V.seqs(spark, d).select("doc_id", seq.alias("seq"))
    head, size = S.trim_tails(F.col("seq"))
    cut = rows.select("doc_id", "seq", head.alias("head"), size.alias("size"))
    return cut.filter(F.col("size") < F.length("seq")).select("doc_id", "head", F.substr("seq", F.col("head") + 1, F.col("size")).alias("kept"))


_COLORS = f"{V.SEQS}, colors AS (SELECT doc_id, 'T' || translate(seq, 'ACGT', '0123') || CASE WHEN doc_id % 4 = 0 THEN '0.00' WHEN doc_id % 4 = 1 THEN '.12' ELSE '' END AS c FROM seqs)"


def _colors(spark, d):
    i = F.col("doc_id") % 4
    return V.seqs(spark, d).select("doc_id", F.concat(F.lit("T"), F.translate("seq", "ACGT", "0123"), F.when(i == 0, "0.00").when(i == 1, ".12").otherwise("")).alias("c"))


@query(f"WITH {_COLORS} SELECT doc_id, (length(regexp_replace(c, '[0.]+$', '')) - 2)::INTEGER AS tail, regexp_extract(c, '([0123.]*[123])[0.]+$', 1) AS trimmed FROM colors")
def tail_trim(spark, d):
    return _colors(spark, d).select("doc_id", S.color_tail(F.col("c")).alias("tail"), S.trimmed_colors(F.col("c")).alias("trimmed"))


@query(f"WITH {_COLORS} SELECT doc_id, regexp_replace(translate(substr(c, 3), '0123.', 'ACGTN'), '[^ACGTN]', '', 'g') AS encoded FROM colors")
def double_encode(spark, d):
    return _colors(spark, d).select("doc_id", S.double_encode(F.col("c")).alias("encoded"))


@query(f"""WITH {_COLORS}, x AS (SELECT doc_id, unnest(string_split(c, '')) AS ch, generate_subscripts(string_split(c, ''), 1) AS i FROM colors),
n AS (SELECT doc_id, i, CASE WHEN i = 1 THEN 3 WHEN ch IN ('0', '1', '2', '3') THEN ch::INTEGER ELSE 0 END AS v, CASE WHEN i > 1 AND ch NOT IN ('0', '1', '2', '3') THEN 1 ELSE 0 END AS bad FROM x),
b AS (SELECT doc_id, i, (sum(v & 1) OVER w % 2 + 2 * (sum(v >> 1) OVER w % 2))::INTEGER AS code, sum(bad) OVER w AS bad FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, string_agg(CASE WHEN bad > 0 THEN 'N' ELSE substr('ACGT', code + 1, 1) END, '' ORDER BY i) AS bases FROM b GROUP BY doc_id""")
def dibase_decode(spark, d):
    return _colors(spark, d).select("doc_id", S.dibase_decode(F.col("c")).alias("bases"))


_QUALS = "q AS (SELECT l_orderkey, list(floor(l_quantity)::INTEGER - 1 ORDER BY l_linenumber, l_quantity, l_partkey, l_suppkey, l_extendedprice) AS q FROM lineitem GROUP BY l_orderkey)"


def _quals(spark, d):
    rows = V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("s"))
    return rows.select("l_orderkey", F.transform("s", lambda x: (F.floor(x["l_quantity"]) - 1).cast("int")).alias("q"))


@query(f"WITH {_QUALS} SELECT l_orderkey, array_to_string(list_transform(q, lambda x, i: x + coalesce(q[i + 1], 0)), ',') AS sums, round(list_avg(q), 6) AS mean FROM q")
def quality_pair_sum(spark, d):
    return _quals(spark, d).select("l_orderkey", F.array_join(S.pair_sums(F.col("q")).cast("array<string>"), ",").alias("sums"), F.round(S.mean_of(F.col("q")), 6).alias("mean"))


@query(f"WITH {_QUALS} SELECT l_orderkey, array_to_string(list_transform(q, lambda x: chr(greatest(x, 0) + 33)), '') AS text FROM q")
def quality_text(spark, d):
    return _quals(spark, d).select("l_orderkey", S.quality_text(F.col("q")).alias("text"))


# --- random operators: numbers are md5 sums of a row and a seed, so SQL can draw the same ---


@query(f"""WITH {V.SEQS}, n AS (SELECT (max(doc_id) + 1) // 4 AS n FROM seqs), t AS (SELECT floor({V.uniform_sql("1", "id")} * n)::BIGINT AS g, count(*) AS c FROM (SELECT unnest(range(0, 500)) AS id), n WHERE n > 0 GROUP BY g)
SELECT doc_id AS ord, seq, unnest(range(0, c)) AS copy FROM seqs JOIN t ON doc_id // 4 = g""")
def resample(spark, d):
    lines = V.seqs(spark, d).select(F.col("doc_id").alias("ord"), "seq")
    return sampling.resample(lines, 500, 4)


_KLETS = "unnest(list_transform(range(1, length(seq)), lambda i: substr(seq, i, 2)))"


@query(f"""WITH {V.SEQS}, k AS (SELECT doc_id, unnest(range(0, 2))::INTEGER AS draw, seq FROM seqs), e AS (SELECT doc_id, draw, {_KLETS} AS klet FROM k WHERE length(seq) > 1) SELECT doc_id, draw, klet, count(*) AS n FROM e GROUP BY ALL""")
def shuffle(spark, d):
    """How often each k-let stands in the shuffles, which is how often it stands in the sequences."""
    drawn = sampling.klet_shuffle(V.seqs(spark, d), "doc_id", "seq", 2, 2)
    return drawn.select("doc_id", "draw", F.explode(S.klets(F.col("shuffled"), 2)).alias("klet")).groupBy("doc_id", "draw", "klet").agg(F.count("*").alias("n"))


@query(f"""WITH b AS (SELECT id, i, {V.uniform_sql("1", "id", "i")} AS u FROM (SELECT s_suppkey AS id, unnest(range(1, s_suppkey % 400 + 2)) AS i FROM supplier)),
s AS (SELECT id, string_agg(CASE WHEN u < 0.3 THEN 'G' WHEN u < 0.6 THEN 'C' WHEN u < 0.8 THEN 'A' ELSE 'T' END, '' ORDER BY i) AS seq FROM b GROUP BY id)
SELECT id, seq, regexp_replace(regexp_replace(seq, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10) || '$', '') AS wrapped FROM s""")
def randseq(spark, d):
    """A sequence for each supplier, of a length that its key gives."""
    return sampling.random_bases(V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 400 + 1).alias("length")), 0.6)


from . import details, exchange  # noqa: E402, F401

__all__ = ["QUERIES", "SQL"]
