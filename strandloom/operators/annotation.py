"""Operators on gene annotation: exons (0-based, half-open) with transcript_id, gene_id, seqname, strand."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..shared import dealt, parts
from . import intervals

_TID = ["transcript_id"]
#: Width of the pieces of a chunked sequence.
CHUNK = 1 << 16


def _place() -> Column:
    """Sequence and strand as one value; null if either is."""
    return F.when(F.col("seqname").isNotNull() & F.col("strand").isNotNull(), F.struct("seqname", "strand"))


def consistent(exons: DataFrame, group: list[str] = _TID) -> DataFrame:
    """Exons of groups that lie on one sequence and strand; others are skipped.

    The rows are looked at where they lie sorted for what comes next, so exons are not worked out twice.
    """
    w = Window.partitionBy(*group).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = exons.filter(reduce(and_, (F.col(c).isNotNull() for c in group)))
    return known.withColumns({"_a": F.min(_place()).over(w), "_b": F.max(_place()).over(w)}).filter("_a = _b").drop("_a", "_b")


def extents(exons: DataFrame, group: list[str], *carry: str) -> DataFrame:
    """group, carry (smallest), seqname, strand, start, end over each consistent group."""
    known = exons.filter(reduce(and_, (F.col(c).isNotNull() for c in group)))
    ends = known.groupBy(*group).agg(*(F.min(c).alias(c) for c in [*carry, "seqname", "strand"]), F.min("start").alias("start"), F.max("end").alias("end"), F.min(_place()).alias("_a"), F.max(_place()).alias("_b"))
    return ends.filter("_a = _b").drop("_a", "_b")


def annotated_regions(exons: DataFrame, group: list[str], stranded: bool = True) -> DataFrame:
    """Union of the groups' extents."""
    return intervals.merge(extents(exons, group), ["seqname", "strand"] if stranded else ["seqname"])


def introns(exons: DataFrame) -> DataFrame:
    """Gaps between a transcript's exons, with the attributes of the exon before."""
    return intervals.gaps(consistent(exons), ["transcript_id"], "gene_id", "seqname", "strand")


def exons_and_introns(exons: DataFrame) -> DataFrame:
    """Both kinds of rows, named by feature."""
    columns = ["feature", "transcript_id", "gene_id", "seqname", "strand", "start", "end"]
    return exons.withColumn("feature", F.lit("exon")).select(columns).unionByName(introns(exons).withColumn("feature", F.lit("intron")).select(columns))


def pre_mrna(exons: DataFrame) -> DataFrame:
    """One row for each distinct extent of spliced transcripts, numbered within its gene (the smallest of several)."""
    spliced = consistent(exons).groupBy("transcript_id").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("gene_id", "seqname", "strand", "start")), F.max("end").alias("end")).filter("n > 1")
    one = spliced.groupBy("seqname", "strand", "start", "end").agg(F.min("gene_id").alias("gene_id"), F.array_join(F.array_sort(F.collect_set(F.col("transcript_id").cast("string"))), ",").alias("spliced_transcript_ids"))
    number = F.row_number().over(Window.partitionBy("gene_id").orderBy("seqname", "start", "end", "strand"))
    digits = number.cast("string")
    padded = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    return one.withColumn("transcript_id", F.concat(F.col("gene_id").cast("string"), F.lit(".pre-mrna."), padded))


def isolated(exons: DataFrame, cds: DataFrame | None = None) -> DataFrame:
    """Transcripts that overlap neither neighbour in order of their first coding start (first exon start without cds).

    Columns transcript_id, seqname, strand, start, end.
    """
    spans = exons.groupBy("seqname", "strand", "transcript_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    if cds is not None:
        firsts = cds.groupBy("seqname", "strand", "transcript_id").agg(F.min("start").alias("at"))
        spans = spans.join(firsts, ["seqname", "strand", "transcript_id"], "left").withColumn("at", F.coalesce("at", F.lit(0)))
    else:
        spans = spans.withColumn("at", F.col("start"))
    near = intervals.neighbours(spans, ["seqname", "strand"], ["at", "transcript_id"], before="lag:end", after="lead:start")
    alone = ~F.coalesce(F.col("before") > F.col("start"), F.lit(False)) & ~F.coalesce(F.col("after") < F.col("end"), F.lit(False))
    return near.filter(alone).select("transcript_id", "seqname", "strand", "start", "end")


def reads_per_feature(isolated_ids: DataFrame, exons: DataFrame, reads: DataFrame) -> DataFrame:
    """Exon and intron reads and lengths of isolated transcripts with both; a read in two exons counts twice.

    reads has seqname, strand, start, end.
    """
    own = exons.join(isolated_ids.select("transcript_id"), "transcript_id", "left_semi")
    parts = own.select("transcript_id", "seqname", "strand", "start", "end", F.lit("exon").alias("kind")).unionByName(intervals.gaps(own, ["transcript_id"], "seqname", "strand").withColumn("kind", F.lit("intron")))
    hits = intervals.count_overlaps(parts, reads, ["seqname", "strand"], ["transcript_id", "kind"]).withColumnRenamed("n", "reads")
    lengths = parts.groupBy("transcript_id", "kind").agg(F.sum(F.col("end") - F.col("start")).alias("length"))
    rows = lengths.join(hits, ["transcript_id", "kind"], "left")
    pick = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0)).alias(f"{kind}_{c}")
    return rows.groupBy("transcript_id").agg(*(pick(k, c) for c in ("reads", "length") for k in ("exon", "intron"))).filter("exon_length > 0 and intron_length > 0")


def unique_segment_counts(features: DataFrame, owner: str, samples: DataFrame, weight: str | None = None) -> DataFrame:
    """Reads of each sample over segments that one owner alone covers: owner, sample, n (long form of the matrix).

    features: seqname, owner (long), start, end; samples: sample, seqname, start, end.
    With `weight`, a column of samples, n is its sum.  Equal reads of a sample
    are one row by then, so no bin has more rows than stretches that lie in it.
    """
    segments = intervals.disjoin_unique(features, ["seqname"], owner)
    place = ["sample", "seqname", "start", "end"]
    of = features.select(F.lit(0)).union(samples.select(F.lit(0)))
    own = samples.select(*place, *([weight] if weight else []))
    alike = (dealt(own, *place, of=of) if parts(of) else own).groupBy(*place).agg((F.count("*") if weight is None else F.sum(weight)).alias("_n"))
    n = F.sum("_n_b")
    return intervals.interval_join(segments, alike, ["seqname"], of=of).groupBy(owner, F.col("sample_b").alias("sample")).agg(n.alias("n"))


def count_matrix(counts: DataFrame, owner: str, samples: list[str]) -> DataFrame:
    """The long form as a matrix: owner and a column for each sample, 0 where there is none."""
    wide = counts.groupBy(owner).pivot("sample", samples).agg(F.sum("n"))
    return wide.select(owner, *(F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias(s) for s in samples))


def slope_through_origin(rows: DataFrame, x: str, y: str, *group: str) -> DataFrame:
    """group and slope: the least-squares line y = slope * x."""
    return rows.groupBy(*group).agg(F.try_divide(F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x))).alias("slope"))


def pair_marginals(pairs: DataFrame, i: str = "i", j: str = "j", p: str = "p") -> DataFrame:
    """k and p: for each position the sum of the probabilities of its pairs, on either side."""
    return pairs.select(F.explode(F.array(i, j)).alias("k"), F.col(p).alias("p")).groupBy("k").agg(F.sum("p").alias("p"))


def exon_offsets(exons: DataFrame) -> DataFrame:
    """exons with `before`: transcript bases ahead of each exon in genome order."""
    w = Window.partitionBy("transcript_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return exons.withColumn("before", F.coalesce(F.sum(F.col("end") - F.col("start")).over(w), F.lit(0)))


def lift(alignments: DataFrame, exons: DataFrame) -> DataFrame:
    """Alignments on transcripts (qname, transcript_id, tpos, length) lifted to the genome: distinct qname, seqname, pos, cigar.

    Each exon that the read meets adds its bases as M, each gap between such exons N.
    Reads that run beyond the transcript are dropped.
    """
    parts = alignments.join(exon_offsets(exons), "transcript_id")
    size = F.col("end") - F.col("start")
    a = F.greatest(F.col("tpos"), F.col("before"))
    b = F.least(F.col("tpos") + F.col("length"), F.col("before") + size)
    parts = parts.withColumns({"s": F.col("start") + a - F.col("before"), "m": b - a}).filter("m > 0")
    rows = parts.groupBy("qname", "transcript_id", "tpos", "length", "seqname").agg(F.sort_array(F.collect_list(F.struct("s", "m"))).alias("p")).filter(F.aggregate("p", F.lit(0).cast("long"), lambda x, y: x + y["m"]) == F.col("length"))
    text = lambda x, i: F.concat(F.when(i > 0, F.concat((x["s"] - F.get("p", i - 1)["s"] - F.get("p", i - 1)["m"]).cast("string"), F.lit("N"))).otherwise(""), x["m"].cast("string"), F.lit("M"))
    return dealt(rows.select("qname", "seqname", F.col("p")[0]["s"].alias("pos"), F.array_join(F.transform("p", text), "").alias("cigar")), "qname").distinct()


def distinct_rows(rows: DataFrame, *fields: str) -> DataFrame:
    """One row for each value of the fields, in their order: of several the smallest."""
    rest = [c for c in rows.columns if c not in fields]
    one = rows.groupBy(*fields).agg(F.min(F.struct(*rest)).alias("_r")).select(*fields, "_r.*") if rest else rows.distinct()
    return one.select(rows.columns).orderBy(*fields)


def metagene(exons: DataFrame, reads: DataFrame, n: int = 100, min_length: int = 1000, min_count: int = 25) -> DataFrame:
    """Average profile of 5' ends along genes: bin, x (percent), y (sums to 1), over genes long and deep enough.

    reads: seqname, strand, at.  A gene's length is its exon union plus 1, as
    in the definition of the profile; reverse genes are mirrored.
    """
    rows, _ = gene_bins(exons, reads, n, min_length, min_count)
    total = rows.groupBy("bin").agg(F.sum(F.col("k") / F.col("total")).alias("y"))
    grid = exons.sparkSession.range(n).select(F.col("id").alias("bin"))
    profile = grid.join(total, "bin", "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    whole = total.agg(F.sum("y").alias("whole"))
    return profile.join(whole, F.lit(True)).select("bin", (100.0 * F.col("bin") / n).alias("x"), (F.col("y") / F.col("whole")).alias("y"))


def gene_bins(exons: DataFrame, reads: DataFrame, n: int, min_length: int, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(gene_id, bin, k, total) of the genes in a metagene profile, and their ids."""
    parts = intervals.merge(exons, ["gene_id", "seqname", "strand"], touching=False)
    w = Window.partitionBy("gene_id")
    before = F.coalesce(F.sum(F.col("end") - F.col("start")).over(w.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"before": before, "glen": F.sum(F.col("end") - F.col("start")).over(w) + 1}).filter(F.col("glen") >= min_length)
    ends = reads.select("seqname", "strand", F.col("at").alias("start"), (F.col("at") + 1).alias("end"))
    hits = intervals.interval_join(parts, ends, ["seqname", "strand"]).withColumn("o", F.col("before") + F.col("start_b") - F.col("start"))
    at = F.when(F.col("strand") == "+", F.col("o")).otherwise(F.col("glen") - 1 - F.col("o"))
    counts = hits.groupBy("gene_id", F.floor(F.lit(n) * at / F.col("glen")).alias("bin")).agg(F.count("*").alias("k"))
    counts = counts.withColumn("total", F.sum("k").over(w)).filter(F.col("total") >= min_count)
    return counts, counts.select("gene_id").distinct()


def transcript_structure(exons: DataFrame) -> DataFrame:
    """Lengths per transcript: introns, exons, medians, terminal intron and first and last exon in order of transcription."""
    own = consistent(exons).groupBy("transcript_id", "strand").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("e"))
    e = F.when(F.col("strand") == "-", F.reverse("e")).otherwise(F.col("e"))
    lens = own.select(
        "transcript_id", F.transform(e, lambda x: x["end"] - x["start"]).alias("exon"),
        F.transform(F.slice("e", 1, F.size("e") - 1), lambda x, i: F.get("e", i + 1)["start"] - x["end"]).alias("gap"), F.col("strand"),
    )
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return lens.select(
        "transcript_id", F.size("gap").cast("long").alias("intron_count"), F.when(F.size("gap") > 0, total("gap")).alias("intronic_length"), median("gap").alias("median_intron_length"),
        F.when(F.size("gap") > 0, F.when(F.col("strand") == "-", F.col("gap")[0]).otherwise(F.element_at("gap", -1))).alias("terminal_intron_length"),
        F.col("exon")[0].alias("five_prime_utr_length"), F.element_at("exon", -1).alias("three_prime_utr_length"), total("exon").alias("exonic_length"), median("exon").alias("median_exonic_length"),
    )


def median(array: str) -> Column:
    """Exact median of an array, null if empty."""
    s, n = F.sort_array(F.col(array)), F.size(F.col(array))
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(s, low) + F.get(s, high)) / 2.0)


def placed(rows: DataFrame, genome: DataFrame, width: int = CHUNK, **values: Column) -> DataFrame:
    """rows (seqname, start, end) with values of the genome's bases there, of which the columns read `seq`; rows of other sequences are skipped.

    Rows are dealt out by place.  Each place is looked up once, however many
    rows have it, in the chunks that it touches, so no chunk draws all rows of a
    crowded stretch into one task.  Both uses of the rows begin at one exchange,
    for which a digest asks for all columns (see sweep.per_bin).
    """
    place, rest = ["seqname", "start", "end"], [c for c in rows.columns if c not in ("seqname", "start", "end")]
    known = dealt(rows.filter(reduce(and_, (F.col(c).isNotNull() for c in place))), *place)
    once = known.groupBy(*place).agg(F.max(F.xxhash64(*rest)).alias("_all")).filter("_all is not null")
    parts = once.select(*place, F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("c"))
    chunks = genome.select("seqname", F.floor(F.col("chunk_start") / width).alias("c"), "chunk_start", "seq")
    cut = parts.join(chunks, ["seqname", "c"]).withColumn("from", F.greatest(F.col("start"), F.col("chunk_start")))
    cut = cut.withColumn("piece", F.substr("seq", (F.col("from") - F.col("chunk_start") + 1).cast("int"), (F.least(F.col("end"), F.col("chunk_start") + F.length("seq")) - F.col("from")).cast("int")))
    whole = cut.groupBy(*place).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("from", "piece"))), lambda x: x["piece"]), "").alias("seq"))
    return known.join(whole.select(*place, *(v.alias(name) for name, v in values.items())), place)


def spliced_sequences(exons: DataFrame, genome: DataFrame, group: str = "transcript_id", width: int = CHUNK) -> DataFrame:
    """group, seq: exon sequences joined in genome order, reverse-complemented on the reverse strand.

    genome is cut into chunks of `width`: seqname, chunk_start, seq.
    """
    cut = placed(exons.select(group, "seqname", "strand", "start", "end"), genome, width, piece=F.col("seq"))
    joined = cut.groupBy(group).agg(F.min("strand").alias("strand"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "piece"))), lambda x: x["piece"]), "").alias("seq"))
    return joined.select(group, F.when(F.col("strand") == "-", S.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))


def transcript_statistics(exons: DataFrame, genome: DataFrame, start_codons: DataFrame | None = None, width: int = CHUNK) -> DataFrame:
    """transcript_structure() with GC shares, stop-codon counts over introns, and whether a start codon is annotated.

    Exons and introns are looked up in one pass; what is counted in them adds up, so no transcript's sequence is put together.
    """
    seq, gap = F.col("seq"), F.col("gap")
    w = Window.partitionBy("transcript_id").orderBy("start", "end")
    near = consistent(exons).withColumns({"_next": F.lead("start").over(w), "_reach": F.max("end").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    part = lambda gap, start, end: F.struct(F.lit(gap).alias("gap"), F.col(start).alias("start"), F.col(end).alias("end"))
    parts = F.array(part(False, "start", "end"), F.when(F.col("_next") > F.col("_reach"), part(True, "_reach", "_next")))
    rows = placed(
        near.select("transcript_id", "seqname", "strand", F.explode(parts).alias("x")).select("transcript_id", "seqname", "strand", "x.*"), genome, width, gc=S.count_of(seq, "GCgc"), known=F.length(seq) - S.count_of(seq, "Nn"),
        stops=S.stop_codons(seq), stops_back=S.stop_codons(S.reverse_complement(seq)),
    )
    rows = rows.select("transcript_id", "gap", "gc", "known", F.when(gap, F.when(F.col("strand") == "-", F.col("stops_back")).otherwise(F.col("stops"))).alias("k"))
    share = lambda of: F.try_divide(F.sum(F.when(of, F.col("gc"))).cast("double"), F.sum(F.when(of, F.col("known"))).cast("double"))
    sums = dealt(rows, "transcript_id", of=exons).groupBy("transcript_id").agg(
        share(~gap).alias("exonic_gc"), share(gap).alias("intronic_gc"), F.sum("k").alias("intronic_tc_count"), F.when(F.count("k") > 0, F.count_if(F.col("k") > 0)).alias("tc_intron_count"),
    )
    text = F.col("transcript_id").cast("string")
    out = transcript_structure(exons).join(sums, "transcript_id", "left")
    if start_codons is None:
        return out.withColumns({"transcript_id": text, "defined_start_codon": F.lit(False)})
    known = start_codons.select("transcript_id").distinct().withColumn("defined_start_codon", F.lit(True))
    return out.join(known, "transcript_id", "left").fillna(False, ["defined_start_codon"]).withColumn("transcript_id", text)
