"""Operators on multiple alignments: projection to a reference, slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..shared import dealt, parts


def project(cells: DataFrame, reference: str, species: list[str]) -> DataFrame:
    """ref_seqname, block, col, species, pos (0-based on the reference), base: alignment columns at reference bases; insertions are dropped.

    cells as from read_emf.  On the reverse strand positions run down and bases
    are complemented; species that are not listed are left out.  The cells of a
    row meet where their block lies, so they are read once and not joined.
    """
    along = Window.partitionBy("block", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    step = cells.withColumn("_k", F.sum(F.when(F.col("base") != "-", 1).otherwise(0)).over(along))
    place = F.when(F.col("strand") == "-", F.col("end") - F.col("_k")).otherwise(F.col("start") + F.col("_k") - 2)
    ref = F.when((F.col("species") == reference) & (F.col("base") != "-"), F.struct(place.alias("pos"), F.col("strand").alias("strand"), F.col("seqname").alias("seqname")))
    met = step.withColumn("_refs", F.collect_list(ref).over(Window.partitionBy("block", "row")))
    own = met.filter(F.col("species").isin(species)).select("block", "col", "species", "base", F.explode("_refs").alias("_ref"))
    return own.select(F.col("_ref.seqname").alias("ref_seqname"), "block", "col", "species", F.col("_ref.pos").alias("pos"), F.when(F.col("_ref.strand") == "-", S.complement(F.col("base"))).otherwise(F.col("base")).alias("base"))


def projected_sequences(cells: DataFrame, reference: str, species: list[str], targets: DataFrame, width: int = 1 << 16) -> DataFrame:
    """seqname, species, chunk_start, seq: each species along the reference in chunks of `width`, '-' where nothing aligns.

    targets: seqname, length of the reference's sequences.  Where several blocks
    lie over a base the last block's counts, and of several rows of one species
    in a block the last column's.
    """
    share = lambda df, *columns: dealt(df, *columns, of=cells) if parts(cells) else df
    bases = share(project(cells, reference, species), "ref_seqname", "species", "pos").groupBy("ref_seqname", "species", "pos").agg(F.max_by("base", F.struct("block", "col")).alias("base"))
    chunk = F.floor(F.col("pos") / width) * width
    bases = share(bases.select(F.col("ref_seqname").alias("seqname"), "species", chunk.alias("chunk_start"), "pos", "base"), "seqname", "species", "chunk_start")
    pieces = bases.groupBy("seqname", "species", "chunk_start").agg(F.sort_array(F.collect_list(F.struct("pos", "base"))).alias("b"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(width).cast("long"))
    grid = targets.filter("length > 0").select("seqname", "length", F.explode(starts).alias("chunk_start")).select("*", F.explode(F.array(*map(F.lit, species))).alias("species"))
    rows = grid.join(pieces, ["seqname", "species", "chunk_start"], "left").withColumn("b", F.filter(F.coalesce("b", F.array().cast("array<struct<pos:bigint,base:string>>")), lambda x: x["pos"] < F.col("length")))
    end = F.least(F.col("length"), F.col("chunk_start") + width)
    blank = lambda n: F.repeat(F.lit("-"), n.cast("int"))
    after = lambda i: F.coalesce(F.get("b", i - 1)["pos"] + 1, F.col("chunk_start"))
    text = F.array_join(F.transform("b", lambda x, i: F.concat(blank(x["pos"] - F.when(i > 0, after(i)).otherwise(F.col("chunk_start"))), x["base"])), "")
    rest = blank(end - F.coalesce(F.try_element_at("b", F.lit(-1))["pos"] + 1, F.col("chunk_start")))
    return rows.select("seqname", "species", "chunk_start", F.concat(text, rest).alias("seq"))


def slices(regions: DataFrame, alignment: DataFrame) -> DataFrame:
    """name, species, seq: alignment columns [start, end) of each region, reverse-complemented on the reverse strand.

    alignment: seqname, species, seq; regions of other sequences are skipped.
    """
    cut = regions.join(alignment, "seqname").withColumn("part", F.substr("seq", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    return cut.select("name", "species", F.when(F.col("strand") == "-", S.reverse_complement(F.col("part"))).otherwise(F.col("part")).alias("seq"))
