"""Trims and conversions of reads: colour tails, poly-A and poly-T, colour reads to FASTQ, BED scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S


def tail_quality(reads: DataFrame) -> DataFrame:
    """csfasta reads with k (first colour of the tail, without the primer) and tail_mean, its mean quality."""
    k = F.greatest(S.color_tail(F.col("colors")), F.lit(0))
    return reads.withColumn("k", k).withColumn("tail_mean", S.mean_of(F.slice("qual", F.col("k") + 1, F.greatest(F.size("qual") - F.col("k"), F.lit(0)))))


def trim_color_tails(reads: DataFrame, least_quality: float = 12, least_tail: int = 6) -> DataFrame:
    """csfasta reads with a tail of `least_tail` colours and that mean quality, cut to primer and k colours and k qualities."""
    rows = tail_quality(reads).filter((F.col("tail_mean") >= least_quality) & (F.size("qual") - F.col("k") >= least_tail))
    return rows.withColumns({"colors": F.substr("colors", F.lit(1), F.col("k") + 1), "qual": F.slice("qual", 1, F.col("k"))}).drop("k", "tail_mean")


def trim_poly(reads: DataFrame, m: int = 4, stranded: bool = False, least_quality: float = 30, base: int = 64) -> DataFrame:
    """FASTQ reads without their poly-A tail (and poly-T head), of those that have one whose mean quality is high enough."""
    head, size = S.trim_tails(F.col("seq"), m, stranded)
    rows = reads.withColumns({"_a": head, "_n": size}).filter(F.col("_n") < F.length("seq"))
    gone = F.concat(F.substr("qual", F.lit(1), F.col("_a")), F.substr("qual", F.col("_a") + F.col("_n") + 1))
    quals = F.transform(F.filter(F.split(gone, ""), lambda c: c != ""), lambda c: F.ascii(c) - base)
    rows = rows.filter(S.mean_of(quals) >= least_quality)
    return rows.withColumns({c: F.substr(c, F.col("_a") + 1, F.col("_n")) for c in ("seq", "qual")}).drop("_a", "_n")


def colors_to_fastq(reads: DataFrame, decode: bool = False) -> DataFrame:
    """id1, seq, id2, qual, ord: colours as letters for an aligner of colour reads, or decoded to bases."""
    if decode:
        seq, qual = S.dibase_decode(F.col("colors")), S.quality_text(S.pair_sums(F.col("qual")), 35)
        return reads.select(F.col("name").alias("id1"), F.substr(seq, F.lit(2)).alias("seq"), F.lit("").alias("id2"), qual.alias("qual"), "ord")
    rest = F.slice("qual", 2, F.greatest(F.size("qual") - 1, F.lit(0)))
    return reads.select(F.col("name").alias("id1"), S.double_encode(F.col("colors")).alias("seq"), F.lit("").alias("id2"), S.quality_text(rest).alias("qual"), "ord")


def big_bed_rows(bed: DataFrame, sizes: DataFrame) -> DataFrame:
    """BED rows of listed sequences (all rows if the list is empty), integer scores, in sorted order."""
    known = bed if sizes.isEmpty() else bed.join(sizes.select("seqname"), "seqname", "left_semi")
    return known.withColumn("score", S.score_to_phred(F.col("score_text"))).orderBy("seqname", "start", "end", "name", "score", "strand")


def with_extra_columns(bed: DataFrame, *specs: str) -> DataFrame:
    """Columns from `extra` by 'N:name:type' (N counts from 1); empty values are null."""
    for spec in specs:
        n, name, kind = spec.split(":")
        value: Column = F.get("extra", F.lit(int(n) - 1))
        bed = bed.withColumn(name, F.when(value != "", value).try_cast(kind))
    return bed


def first_records(records: DataFrame, n: int) -> DataFrame:
    """The first n records of a file by their number."""
    return records.filter(F.col("ord") < n)
