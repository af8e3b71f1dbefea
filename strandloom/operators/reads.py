"""Operators on alignments and reads: flags, CIGAR walks, counts, duplicates, joins by read id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from . import intervals

UNMAPPED, REVERSE, READ1, READ2, PAIRED = 4, 16, 64, 128, 1
_WALK = ["M", "D", "N", "=", "X"]


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(bit) != 0


def strand(flag: Column) -> Column:
    return F.when(has(flag, REVERSE), "-").otherwise("+")


def cigar(text: Column) -> Column:
    """'10M5N' as an array of (op, len); '=' and 'X' count as M; '*' and null are empty."""
    lens = F.regexp_extract_all(text, F.lit("([0-9]+)[MIDNSHP=X]"), F.lit(1))
    ops = F.regexp_extract_all(text, F.lit("[0-9]+([MIDNSHP=X])"), F.lit(1))
    return F.coalesce(F.zip_with(ops, lens, lambda o, n: F.struct(F.when(o.isin("=", "X"), "M").otherwise(o).alias("op"), n.cast("int").alias("len"))), F.array().cast("array<struct<op:string,len:int>>"))


def reference_end(pos: Column, walk: Column) -> Column:
    """Exclusive end on the reference; a read without CIGAR covers one base."""
    span = F.aggregate(walk, F.lit(0).cast("long"), lambda a, x: a + F.when(x["op"].isin(*_WALK), x["len"]).otherwise(0))
    return pos + F.when(F.size(walk) == 0, 1).otherwise(span)


def query_length(walk: Column) -> Column:
    return F.aggregate(walk, F.lit(0).cast("long"), lambda a, x: a + F.when(x["op"].isin("M", "I", "S"), x["len"]).otherwise(0))


def walked(walk: Column, pos: Column) -> Column:
    """The elements of a CIGAR with their places: array of (op, len, start on the reference, query: first base of the read), in one pass."""
    none = F.array().cast("array<struct<op:string,len:int,start:bigint,query:bigint>>")
    step = lambda x, *ops: F.when(x["op"].isin(*ops), x["len"]).otherwise(0)
    one = lambda a, x: F.struct(x["op"].alias("op"), x["len"].cast("int").alias("len"), a["r"].alias("start"), a["q"].alias("query"))
    fold = lambda a, x: F.struct(F.concat(a["w"], F.array(one(a, x))).alias("w"), (a["r"] + step(x, *_WALK)).alias("r"), (a["q"] + step(x, "M", "I", "S", "=", "X")).alias("q"))
    begin = F.struct(none.alias("w"), pos.cast("long").alias("r"), F.lit(0).cast("long").alias("q"))
    return F.aggregate(walk, begin, fold, lambda a: a["w"])


def blocks(reads: DataFrame, op: str, *carry: str) -> DataFrame:
    """One row for each CIGAR element of kind `op`: carry columns, start, end on the reference, i (element number)."""
    rows = reads.select(*carry, F.posexplode(walked(F.col("cigar"), F.col("pos"))).alias("i", "s")).filter(F.col("s.op") == op)
    return rows.select(*carry, "i", F.col("s.start").alias("start"), (F.col("s.start") + F.col("s.len")).alias("end"))


def mapped(reads: DataFrame) -> DataFrame:
    return reads.filter(~has(F.col("flag"), UNMAPPED) & F.col("seqname").isNotNull())


def of_mate(reads: DataFrame, mate: int) -> DataFrame:
    return reads.filter(has(F.col("flag"), READ1 if mate == 1 else READ2))


def depth_runs(reads: DataFrame, targets: DataFrame, only_strand: str | None = None, starts: bool = False) -> DataFrame:
    """Coverage as bedGraph rows: aligned bases, or read starts only, of one strand or both."""
    rows = mapped(reads)
    if only_strand:
        rows = rows.filter(strand(F.col("flag")) == only_strand)
    spans = rows.select("seqname", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")) if starts else blocks(rows, "M", "seqname").select("seqname", "start", "end")
    return intervals.coverage(spans, targets)


def five_prime(reads: DataFrame) -> DataFrame:
    """reads with `at`: pos on the forward strand, last base on the reverse."""
    return reads.withColumn("at", F.when(has(F.col("flag"), REVERSE), reference_end(F.col("pos"), F.col("cigar")) - 1).otherwise(F.col("pos")))


def junctions(reads: DataFrame) -> DataFrame:
    """Splice junctions, one row for each N of each alignment: qname, seqname, start, end."""
    return blocks(mapped(reads), "N", "qname", "seqname").drop("i")


def junction_labels(reads: DataFrame, tag: str = "XS") -> DataFrame:
    """Junctions of alignments with a strand tag as `seqname:a..b`, ends swapped on the reverse strand."""
    rows = mapped(reads).filter(F.col("aux")[tag].isNotNull()).withColumn("_tag", F.col("aux")[tag]["value"])
    spans = blocks(rows, "N", "seqname", "_tag")
    a, b = F.col("start").cast("string"), F.col("end").cast("string")
    minus = F.col("_tag") == "-"
    return spans.select(F.concat("seqname", F.lit(":"), F.when(minus, b).otherwise(a), F.lit(".."), F.when(minus, a).otherwise(b)).alias("junction"))


def key(reads: DataFrame) -> Column:
    """Read key: the name, with /1 or /2 for mates."""
    return F.concat(F.col("qname"), F.when(has(F.col("flag"), READ1), "/1").when(has(F.col("flag"), READ2), "/2").otherwise(""))


def summary(reads: DataFrame, long_gap: int = 50) -> DataFrame:
    """One row of counts over reads, in two levels: per read key, then totals; clipped alignments only count as alignments."""
    c = F.col("cigar")
    any_ = lambda f: F.exists(c, f)
    rows = mapped(reads).select(
        key(reads).alias("key"), any_(lambda x: x["op"].isin("S", "H")).alias("clipped"),
        any_(lambda x: (x["op"] == "N") & (x["len"] >= long_gap)).alias("spliced"), any_(lambda x: (x["op"] == "N") & (x["len"] < long_gap)).alias("gapped"),
        F.forall(c, lambda x: x["op"].isin("M", "N")).alias("perfect"),
    )
    kinds = {"unspliced_perfect": "not spliced and perfect", "spliced_perfect": "spliced and perfect", "spliced": "spliced", "gapped": "gapped"}
    per = rows.filter("not clipped").groupBy("key").agg(F.count("*").alias("n"), *(F.count_if(F.expr(e)).alias(k) for k, e in kinds.items()))
    counts = per.agg(
        F.count("*").alias("read_count"), F.count_if(F.col("n") > 1).alias("multi_count"),
        *(F.coalesce(F.sum(k), F.lit(0)).alias(f"{k}_cnt") for k in kinds),
        *(F.coalesce(F.sum(F.when(F.col("n") == 1, F.col(k))), F.lit(0)).alias(f"unique_{k}_cnt") for k in kinds),
    )
    return rows.agg(F.count("*").alias("alignment_count")).join(counts, F.lit(True))


def unique(reads: DataFrame, columns: Column) -> DataFrame:
    """Rows whose key stands once: counted with map-side combine, each key carrying one of its rows, so a hot key is a row a task."""
    one = F.any_value(F.struct(*(F.col(f"`{c}`") for c in reads.columns)))
    return reads.groupBy(columns.alias("_key")).agg(F.count("*").alias("_n"), one.alias("_row")).filter("_n = 1").select("_row.*")


def with_ids(reads: DataFrame, ids: DataFrame, column: str = "qname", keep: bool = True) -> DataFrame:
    """Rows whose id is listed (or is not): a semi or anti join, so repeated ids do no harm."""
    return reads.join(ids.select(column).distinct(), column, "left_semi" if keep else "left_anti")


def pair_key(id1: Column) -> Column:
    """A read id up to its first '/' or space."""
    return F.regexp_extract(id1, "^[^/ ]*", 0)


def unmapped_pairs(pairs: DataFrame, *alignments: DataFrame) -> DataFrame:
    """Pairs (id1 and any columns) whose id is in none of the alignments; both mates stay or go together."""
    ids = alignments[0].select("qname")
    for a in alignments[1:]:
        ids = ids.union(a.select("qname"))
    return pairs.withColumn("qname", pair_key(F.col("id1"))).join(ids.distinct(), "qname", "left_anti").drop("qname")


def zipped(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two files by record number `ord`; columns of b get the suffix _2."""
    return a.join(b.select("ord", *(F.col(c).alias(f"{c}_2") for c in b.columns if c != "ord")), "ord")


def multiplicity(rows: DataFrame, column: Column, ordered: bool = False) -> DataFrame:
    """key and n for each distinct key, map-side combined; `ordered`: by falling n, then key."""
    counts = rows.groupBy(column.alias("key")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "key") if ordered else counts


def duplicates(rows: DataFrame, seq: str, ignore_n: bool = True) -> DataFrame:
    """How many distinct sequences stand n times, and the number of ignored reads (with '.' or N) as the row of n = 0."""
    bad = F.col(seq).contains(".") | F.col(seq).contains("N")
    used = rows.filter(~bad) if ignore_n else rows
    counts = multiplicity(used, F.col(seq)).groupBy("n").agg(F.count("*").alias("distinct_seqs"))
    ignored = rows.agg(F.count_if(bad if ignore_n else F.lit(False)).alias("distinct_seqs")).select(F.lit(0).cast("long").alias("n"), "distinct_seqs")
    return counts.unionByName(ignored)


def hamming_counts(rows: DataFrame, seq: Column, k: int, distance: int = 1, letters: str = "ATCGN") -> DataFrame:
    """For each distinct k-prefix its count n and the sum over prefixes at distance 1 .. `distance`.

    Neighbours are generated and joined by equality; each neighbour counts once.
    """
    counts = stored(multiplicity(rows.filter(F.length(seq) >= k), F.substring(seq, 1, k)))  # read three times
    near = counts.select("key", F.array("key").alias("seen"))
    variants = lambda s: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.transform(F.array(*map(F.lit, letters)), lambda c: F.concat(F.substr(s, F.lit(1), i - 1), c, F.substr(s, i + 1)))))
    for _ in range(distance):
        near = near.select("key", F.array_distinct(F.concat("seen", F.flatten(F.transform("seen", variants)))).alias("seen"))
    found = near.select("key", F.explode("seen").alias("other")).filter("key != other").join(counts.toDF("other", "m"), "other").groupBy("key").agg(F.sum("m").alias("neighbours"))
    return counts.join(found, "key", "left").select("key", "n", F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


def cumulative_share(counts: DataFrame, value: str, tie: str) -> DataFrame:
    """Rank, value and running share of the total, by falling value.

    Values are first summed per distinct value, so the running sum is over few rows.
    """
    per = counts.filter(F.col(value) > 0).groupBy(value).agg(F.count("*").alias("k"))
    order = Window.orderBy(F.desc(value))
    before = per.select(value, F.coalesce(F.sum(F.col("k") * F.col(value)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("sum_before"), F.coalesce(F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rank_before"), F.sum(F.col("k") * F.col(value)).over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy(value).orderBy(tie)
    rows = counts.join(before, value).withColumn("i", F.row_number().over(inside))
    return rows.select(tie, value, (F.col("rank_before") + F.col("i")).cast("long").alias("rank"), ((F.col("sum_before") + F.col("i") * F.col(value)) / F.col("total")).alias("share"))


def flagstats(reads: DataFrame) -> DataFrame:
    """Mapped and unmapped reads of each sequence."""
    gone = has(F.col("flag"), UNMAPPED)
    return reads.groupBy("seqname").agg(F.count_if(~gone).alias("mapped"), F.count_if(gone).alias("unmapped"))


def in_region(reads: DataFrame, seqname: str, start: int = 0, end: int | None = None, only_strand: str | None = None, mate: int | None = None) -> DataFrame:
    """Mapped reads that overlap [start, end), of one strand or mate if given.  The filter on seqname and pos reaches the scan."""
    rows = mapped(reads).filter(F.col("seqname") == seqname)
    if end is not None:
        rows = rows.filter(F.col("pos") < end)
    rows = rows.filter(reference_end(F.col("pos"), F.col("cigar")) > start)
    if only_strand:
        rows = rows.filter(strand(F.col("flag")) == only_strand)
    return rows if mate is None else of_mate(rows, mate)


def end_counts(reads: DataFrame, seqname: str, start: int, end: int, only_strand: str | None = None, mate: int | None = None) -> DataFrame:
    """at, n for every position of [start, end): 5' ends, zeros included; from the far end on the reverse strand."""
    ends = five_prime(in_region(reads, seqname, start, end, only_strand, mate)).filter((F.col("at") >= start) & (F.col("at") < end))
    counts = ends.groupBy("at").agg(F.count("*").alias("n"))
    grid = reads.sparkSession.range(start, end).select(F.col("id").alias("at"))
    out = grid.join(counts, "at", "left").select("at", F.coalesce("n", F.lit(0)).alias("n"))
    return out.orderBy(F.desc("at") if only_strand == "-" else "at")


def end_count(reads: DataFrame, seqname: str, start: int, end: int, only_strand: str | None = None) -> DataFrame:
    """n: 5' ends inside [start, end)."""
    ends = five_prime(in_region(reads, seqname, start, end, only_strand)).filter((F.col("at") >= start) & (F.col("at") < end))
    return ends.agg(F.count("*").alias("n"))


def region_depth(reads: DataFrame, targets: DataFrame, seqname: str, start: int, end: int, only_strand: str | None = None) -> DataFrame:
    """start, end, depth runs of coverage inside a region."""
    runs = depth_runs(in_region(reads, seqname, start, end, only_strand), targets.filter(F.col("seqname") == seqname))
    cut = runs.filter((F.col("end") > start) & (F.col("start") < end))
    return cut.select(F.greatest("start", F.lit(start)).alias("start"), F.least("end", F.lit(end)).alias("end"), "depth")
