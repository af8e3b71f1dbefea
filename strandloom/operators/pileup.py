"""Pileup: what reads say at each position of the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reads import has, walked

# Fixed value: flags of reads that a pileup leaves out unless told otherwise - unmapped, secondary, failed, duplicate.
MASK = 4 | 256 | 512 | 1024
BASES = "ACGT"


def pileup(reads: DataFrame, *samples: str, min_quality: int = 0, min_mapq: int = 0, mask: int = MASK, seq: str = "seq", qual: str = "qual") -> DataFrame:
    """seqname, pos, the sample columns, depth, A, C, G, T, N, del, ins for each position that a read covers.

    reads: alignments with seqname, pos, flag, mapq, cigar and read sequence.
    Aligned bases count under their letter in either case (others as N), those
    below min_quality (where a read has qualities) not at all.  A deleted position counts
    under del, and depth is both together; skipped stretches count nowhere.  An
    insertion counts under ins at the base before it, if the read has one there;
    whether it does is not asked of that base's quality.  Reads with a flag of
    `mask`, of mapping quality under min_mapq or without seqname, pos or
    sequence are left out.

    A read is one row for each of its CIGAR elements and then one for each base;
    tasks count those by position before they are sent, so a deep position is a
    row a task.  Positions that nothing remains of are left out.
    """
    rows = reads.filter(~has(F.col("flag"), mask) & F.col("seqname").isNotNull() & F.col("pos").isNotNull() & F.col(seq).isNotNull())
    rows = rows.filter(F.coalesce("mapq", F.lit(0)) >= min_mapq) if min_mapq else rows
    keys = ["seqname", *samples]
    letters = F.split(F.upper(seq), "")
    step = rows.select(*keys, F.col("pos").alias("_pos"), letters.alias("_l"), F.split(qual, "").alias("_q"), F.explode(walked(F.col("cigar"), F.col("pos"))).alias("_e"))
    op, size, first = F.col("_e.op"), F.col("_e.len"), (F.col("_e.query") + 1).cast("int")
    part = lambda c: F.slice(c, first, F.greatest(size, F.lit(0)))
    seen = F.arrays_zip(part("_l").alias("b"), F.coalesce(part("_q"), F.array().cast("array<string>")).alias("q"))
    none = F.array(F.struct(F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("q")))
    aligned = op.isin("M", "=", "X")
    items = F.when(aligned, seen).when(op == "D", F.array_repeat(none[0], size)).when((op == "I") & (F.col("_e.start") > F.col("_pos")), none)
    each = step.select(*keys, op.alias("_op"), F.col("_e.start").alias("_start"), F.posexplode(items).alias("_i", "_x"))
    at = F.when(F.col("_op") == "I", F.col("_start") - 1).otherwise(F.col("_start") + F.col("_i"))
    good = F.coalesce(F.ascii("_x.q") - 33 >= min_quality, F.lit(True))
    base = F.when(F.col("_op").isin("M", "=", "X") & F.col("_x.b").isNotNull(), F.when(F.col("_x.b").isin(*BASES), F.col("_x.b")).otherwise("N"))
    each = each.select(*keys, at.alias("pos"), F.when(base.isNotNull() & good, base).when(F.col("_op") == "D", "del").when(F.col("_op") == "I", "ins").alias("_k")).filter("_k is not null")
    count = lambda k: F.count_if(F.col("_k") == k).alias(k)
    return each.groupBy("seqname", "pos", *samples).agg(F.count_if(F.col("_k") != "ins").alias("depth"), *map(count, (*BASES, "N", "del", "ins")))
