"""Readers of genomic text formats.  All return the canonical 0-based, half-open coordinates of `coords`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reads as R
from ..shared import dealt
from .lines import numbered, text

_ATTRIBUTE = r"""([^\s;"'=]+)[ \t]+(?:"([^"]*)"|'([^']*)'|([^\s;"']+))"""


class Fields:
    """Elements of an array column; null beyond its end, also where a filter on the size is applied later."""

    def __init__(self, array: Column):
        self.array = array

    def __getitem__(self, i: int) -> Column:
        return F.get(self.array, F.lit(i))


def attributes(column: Column) -> Column:
    """GTF column 9 as a map: quoted or bare values, a missing last ';' allowed, of repeated keys the last.

    One pass finds the pairs as they stand; what several steps need is the element of an array of one, as it would be worked out for each of them otherwise.
    """
    found = F.regexp_extract_all(column, F.lit(_ATTRIBUTE), F.lit(0))
    bare = lambda v: F.when(F.substring(v, 1, 1).isin('"', "'"), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    halves = F.transform(found, lambda m: F.split(m, "[ \t]+", 2))
    pairs = F.transform(halves, lambda h: F.struct(h[0].alias("key"), bare(h[1]).alias("value")))
    last = lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.greatest(F.size(p) - i - 1, F.lit(0))), lambda q: q["key"] == x["key"]))
    keys = lambda p: F.transform(p, lambda x: x["key"])
    return F.transform(F.array(pairs), lambda p: F.map_from_entries(F.when(F.size(F.array_distinct(keys(p))) == F.size(p), p).otherwise(last(p))))[0]


def read_gtf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_gtf(text(spark, path))


def parse_gtf(lines: DataFrame) -> DataFrame:
    """seqname, source, feature, start, end, score, strand, frame, attributes; comments and short lines are skipped."""
    f = Fields(F.split("value", "\t"))
    rows = lines.filter(~F.col("value").startswith("#") & (F.size(F.split("value", "\t")) >= 8))
    dot = lambda i: F.when(f[i] != ".", f[i])
    return rows.select(
        f[0].alias("seqname"), f[1].alias("source"), f[2].alias("feature"), (f[3].try_cast("long") - 1).alias("start"), f[4].try_cast("long").alias("end"),
        F.coalesce(dot(5).try_cast("double"), F.lit(0.0)).alias("score"), f[6].alias("strand"), F.coalesce(dot(7).try_cast("int"), F.lit(-1)).alias("frame"),
        attributes(F.coalesce(f[8], F.lit(""))).alias("attributes"),
    )


def exons(gtf: DataFrame, feature: str = "exon") -> DataFrame:
    """Rows of one feature with transcript_id and gene_id as columns; rows without a transcript are skipped."""
    rows = gtf.filter(F.col("feature") == feature)
    return rows.select(F.col("attributes")["transcript_id"].alias("transcript_id"), F.col("attributes")["gene_id"].alias("gene_id"), "seqname", "strand", "start", "end").filter("transcript_id is not null")


def read_bed(spark: SparkSession, path: str | list[str], blanks: bool = False) -> DataFrame:
    return parse_bed(text(spark, path), blanks)


def parse_bed(lines: DataFrame, blanks: bool = False) -> DataFrame:
    """seqname, start, end, name ('' if absent), score (0), score_text, strand ('.'), extra; rows of under three columns are skipped."""
    f = F.split(F.trim("value"), r"\s+" if blanks else "\t")
    rows = lines.filter(~F.col("value").rlike("^(#|track|browser)")).select(f.alias("f")).filter(F.size("f") >= 3)
    get = lambda i, default: F.coalesce(F.get("f", F.lit(i)), F.lit(default))
    return rows.select(
        F.get("f", F.lit(0)).alias("seqname"), F.get("f", F.lit(1)).try_cast("long").alias("start"), F.get("f", F.lit(2)).try_cast("long").alias("end"), get(3, "").alias("name"),
        F.coalesce(get(4, "0").try_cast("double"), F.lit(0.0)).alias("score"), get(4, "0").alias("score_text"), get(5, ".").alias("strand"), F.slice("f", 7, F.greatest(F.size("f") - 6, F.lit(0))).alias("extra"),
    )


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """seqname, length."""
    f = Fields(F.split("value", "\t"))
    return text(spark, path).filter("value != ''").select(f[0].alias("seqname"), f[1].try_cast("long").alias("length"))


def parse_sam(lines: DataFrame) -> DataFrame:
    """Alignment lines (value) in the canonical schema; header lines are skipped.  Mapped reads without CIGAR become unmapped."""
    whole = F.split("value", "\t")
    f = Fields(whole)
    rows = lines.filter(~F.col("value").startswith("@") & (F.size(whole) >= 11))
    star = lambda i: F.when(f[i] != "*", f[i])
    tags = F.transform(F.slice(whole, 12, F.greatest(F.size(whole) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.struct(F.substring(t, 4, 1).alias("type"), F.substr(t, F.lit(6)).alias("value")).alias("value")))
    flag = f[1].try_cast("int")
    return rows.select(
        star(0).alias("qname"), F.when((f[5] == "*") & ~R.has(flag, R.UNMAPPED), flag.bitwiseOR(R.UNMAPPED)).otherwise(flag).alias("flag"), star(2).alias("seqname"),
        (F.coalesce(f[3].try_cast("long"), F.lit(0)) - 1).alias("pos"), f[4].try_cast("int").alias("mapq"), R.cigar(f[5]).alias("cigar"),
        F.when(f[6] == "=", star(2)).otherwise(star(6)).alias("mseqname"), (F.coalesce(f[7].try_cast("long"), F.lit(0)) - 1).alias("mpos"), f[8].try_cast("long").alias("isize"),
        star(9).alias("seq"), star(10).alias("qual"), F.map_from_entries(tags).alias("aux"),
    )


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_sam(text(spark, path))


def read_sam_targets(spark: SparkSession, path: str) -> DataFrame:
    """seqname, length from @SQ lines."""
    rows = text(spark, path).filter(F.col("value").startswith("@SQ"))
    return rows.select(F.regexp_extract("value", "\tSN:([^\t]+)", 1).alias("seqname"), F.regexp_extract("value", "\tLN:([0-9]+)", 1).cast("long").alias("length"))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """id, description, seq, ord.  Records are split at '\\n>', so a large file is read by many tasks."""
    rows = numbered(text(spark, path, "\n>", placed=True).filter(F.trim("value") != ""))
    head = F.regexp_replace(F.split("value", "\n", 2)[0], "^>", "")
    body = F.coalesce(F.get(F.split("value", "\n", 2), F.lit(1)), F.lit(""))
    return rows.select(F.split(head, r"\s", 2)[0].alias("id"), head.alias("description"), F.regexp_replace(body, r"\s", "").alias("seq"), "ord")


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """The first record alone, with nothing but A, C, G, T and N."""
    return read_fasta(spark, path).filter("ord = 0").withColumn("seq", F.regexp_replace("seq", "[^ACGTNacgtn]", ""))


def chunked(fasta: DataFrame, width: int = 1 << 16) -> DataFrame:
    """seqname, chunk_start, seq: sequences cut so that positions are found by a join.

    For sequences that fit a row; fasta.read_chunks() makes the same rows of a
    file without that.  Bytes are cut where every letter is one, which takes no
    count from the sequence's start.
    """
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(width)))
    rows = fasta.select(F.col("id").alias("seqname"), at.alias("chunk_start"), F.when(F.octet_length("seq") == F.length("seq"), F.col("seq").cast("binary")).alias("_b"), "seq")
    piece = lambda c: F.substr(c, F.col("chunk_start") + 1, F.lit(width))
    return rows.select("seqname", F.col("chunk_start").cast("long").alias("chunk_start"), F.coalesce(piece(F.col("_b")).cast("string"), piece(F.col("seq"))).alias("seq"))


def fetch(genome: DataFrame, regions: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Columns of regions (seqname, start, end, half-open) with seq, from a sequence in chunks of `width`.

    Ends beyond the sequence are cut, so what lies beyond it is empty; a sequence that the genome lacks gives null.
    """
    key = ["seqname", "start", "end"]
    parts = regions.select(*key).distinct().withColumn("c", F.explode(F.sequence(F.floor(F.greatest("start", F.lit(0)) / width), F.floor((F.greatest("end", F.lit(1)) - 1) / width))))
    hits = parts.join(genome.select("seqname", F.floor(F.col("chunk_start") / width).alias("c"), "chunk_start", F.col("seq").alias("_s")), ["seqname", "c"])
    low = F.greatest(F.col("start") - F.col("chunk_start"), F.lit(0))
    piece = F.struct("c", F.substr("_s", (low + 1).cast("int"), F.greatest(F.col("end") - F.col("chunk_start") - low, F.lit(0)).cast("int")).alias("s"))
    found = hits.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["s"]), "").alias("seq"))
    known = genome.select("seqname").distinct().withColumn("_known", F.lit(""))
    return regions.join(found, key, "left").join(known, "seqname", "left").select(*regions.columns, F.coalesce("seq", "_known").alias("seq"))


def fasta_index(fasta: DataFrame) -> DataFrame:
    """seqname, length of each record."""
    return fasta.select(F.col("id").alias("seqname"), F.length("seq").cast("long").alias("length"))


def read_fastq(spark: SparkSession, path: str | list[str], comments: bool = False) -> DataFrame:
    """id1, seq, id2, qual, ord from four lines a record; with comments, '#' lines are skipped first."""
    lines = text(spark, path, placed=True)
    lines = numbered(lines.filter(~F.col("value").startswith("#")) if comments else lines, "line")
    rows = lines.groupBy(F.floor(F.col("line") / 4).alias("ord")).agg(*(F.max(F.when(F.col("line") % 4 == i, F.col("value"))).alias(c) for i, c in enumerate(("id1", "seq", "id2", "qual"))))
    return rows.select(F.regexp_replace("id1", "^@", "").alias("id1"), "seq", F.regexp_replace("id2", r"^\+", "").alias("id2"), "qual", "ord").filter("seq is not null")


def read_sequences(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """id1, seq, id2, qual, ord from FASTQ or FASTA, told apart by the first sign; reads of FASTA have no qualities."""
    first = text(spark, path).filter("value != ''").select(F.substring("value", 1, 1)).first()
    if first and first[0] == ">":
        return read_fasta(spark, path).select(F.col("description").alias("id1"), "seq", F.lit("").alias("id2"), F.lit("").alias("qual"), "ord")
    return read_fastq(spark, path)


def read_csfasta(spark: SparkSession, colors: str, quals: str | None = None) -> DataFrame:
    """name, colors, qual, ord from a pair of files; a pair of names that differ is an error.  Without a quality file qual is null."""

    def pairs(path: str) -> DataFrame:
        lines = numbered(text(spark, path, placed=True).filter(~F.col("value").startswith("#")), "line")
        return lines.groupBy(F.floor(F.col("line") / 2).alias("ord")).agg(F.max(F.when(F.col("line") % 2 == 0, F.col("value"))).alias("name"), F.max(F.when(F.col("line") % 2 == 1, F.col("value"))).alias("body"))

    plain = F.regexp_replace("name", "^>", "")
    if quals is None:
        return pairs(colors).select(plain.alias("name"), F.col("body").alias("colors"), F.lit(None).cast("array<int>").alias("qual"), "ord")
    both = R.zipped(pairs(colors), pairs(quals))
    same = F.when(F.col("name") != F.col("name_2"), F.raise_error(F.concat(F.lit("names differ: "), "name", F.lit(" "), "name_2"))).otherwise(plain)
    return both.select(same.alias("name"), F.col("body").alias("colors"), F.transform(F.split(F.trim("body_2"), r"\s+"), lambda q: q.cast("int")).alias("qual"), "ord")


def read_emf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """block, col (of the species), row (1, 2, ...), species, seqname, start, end, strand, base from alignment blocks.

    Blocks are dealt out before they are cells, so what is done within a block needs no other exchange; each line is split once.
    """
    blocks = dealt(numbered(text(spark, path, "\n//", placed=True).filter(F.col("value").contains("DATA")), "block"), "block")
    lines = blocks.select("block", F.filter(F.split("value", "\n"), lambda x: ~x.startswith("#") & (F.trim(x) != "")).alias("l"))
    heads = F.transform(F.filter("l", lambda x: x.startswith("SEQ")), lambda x: F.split(x, r"\s+"))
    rows = F.slice("l", F.array_position("l", F.lit("DATA")).cast("int") + 1, F.size("l"))
    cells = lines.select("block", heads.alias("h"), F.transform(rows, lambda x: F.split(x, r"\s+")[0]).alias("r")).select("block", F.posexplode("h").alias("col", "head"), "r")
    f = Fields(F.col("head"))
    each = cells.select("block", "col", f[1].alias("species"), f[2].alias("seqname"), f[3].try_cast("long").alias("start"), f[4].try_cast("long").alias("end"), F.when(f[5].try_cast("int") < 0, "-").otherwise("+").alias("strand"), "r")
    each = each.select("*", F.posexplode("r").alias("row", "line"))
    return each.select("block", "col", (F.col("row") + 1).alias("row"), "species", "seqname", "start", "end", "strand", F.substr("line", F.col("col") + 1, F.lit(1)).alias("base"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """ord, value."""
    return numbered(text(spark, path, placed=True))


def read_species(spark: SparkSession, path: str) -> DataFrame:
    """species, ord: one name a line; blanks around it and empty lines go."""
    name = F.trim("value")
    return numbered(text(spark, path, placed=True).filter(name != "")).select(name.alias("species"), "ord")
