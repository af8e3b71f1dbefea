"""Writers: each turns rows into lines with built-in expressions; `write_lines` stores them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import wrap


def _tabs(*columns: Column) -> Column:
    return F.concat_ws("\t", *(c.cast("string") for c in columns)).alias("value")


def bed(df: DataFrame) -> DataFrame:
    """BED6 lines and the extra columns, if there are any."""
    extra = [F.col("extra")] if "extra" in df.columns else []
    return df.select(F.concat_ws("\t", F.col("seqname"), F.col("start").cast("string"), F.col("end").cast("string"), F.coalesce("name", F.lit("")), F.coalesce(F.col("score").cast("string"), F.lit("0")), "strand", *extra).alias("value"))


def bedgraph(df: DataFrame, value: str = "depth") -> DataFrame:
    return df.select(_tabs(F.col("seqname"), F.col("start"), F.col("end"), F.col(value)))


def split_bed(df: DataFrame) -> DataFrame:
    """Pieces of subtracted rows: name.k for cut rows, the first name in column 7."""
    name = F.when(F.col("piece") > 0, F.concat("name", F.lit("."), F.col("piece").cast("string"))).otherwise(F.col("name"))
    return df.select(_tabs(F.col("seqname"), F.col("start"), F.col("end"), name, F.col("score"), F.col("strand"), F.col("name")))


def gtf(df: DataFrame, quoted: bool = True) -> DataFrame:
    mark = '"' if quoted else ""
    pairs = F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit(f" {mark}"), e["value"], F.lit(f"{mark};")))
    dot = lambda c, none: F.when(F.col(c) == none, ".").otherwise(F.col(c).cast("string"))
    return df.select(_tabs(F.col("seqname"), F.col("source"), F.col("feature"), F.col("start") + 1, F.col("end"), dot("score", 0), F.col("strand"), dot("frame", -1), F.array_join(pairs, " ")))


def cigar_text(walk: Column) -> Column:
    return F.when(F.size(walk) == 0, "*").otherwise(F.array_join(F.transform(walk, lambda x: F.concat(x["len"].cast("string"), x["op"])), ""))


def sam(df: DataFrame) -> DataFrame:
    star = lambda c: F.coalesce(c, F.lit("*"))
    tags = F.transform(F.map_entries(F.coalesce("aux", F.create_map().cast("map<string,struct<type:string,value:string>>"))), lambda e: F.concat_ws(":", e["key"], e["value"]["type"], e["value"]["value"]))
    mate = F.when(F.col("mseqname") == F.col("seqname"), "=").otherwise(star(F.col("mseqname")))
    fields = [F.col("qname"), F.col("flag"), star(F.col("seqname")), F.col("pos") + 1, F.col("mapq"), cigar_text(F.col("cigar")), mate, F.col("mpos") + 1, F.col("isize"), star(F.col("seq")), star(F.col("qual"))]
    return df.select(F.concat_ws("\t", *(f.cast("string") for f in fields), tags).alias("value"))


def sam_header(targets: DataFrame) -> DataFrame:
    """@HD and @SQ lines with their order `ord`."""
    top = targets.sparkSession.createDataFrame([(0, "@HD\tVN:1.0\tSO:unsorted")], "ord int, value string")
    return top.union(targets.select(F.lit(1), F.concat(F.lit("@SQ\tSN:"), "seqname", F.lit("\tLN:"), F.col("length").cast("string"))))


def fasta(df: DataFrame, width: int = 80) -> DataFrame:
    return df.select(F.concat(F.lit(">"), "id", F.lit("\n"), wrap(F.col("seq"), width)).alias("value"))


def fastq(df: DataFrame) -> DataFrame:
    """FASTQ, or FASTA for reads without qualities."""
    full = F.concat(F.lit("@"), "id1", F.lit("\n"), "seq", F.lit("\n+"), F.coalesce("id2", F.lit("")), F.lit("\n"), "qual")
    return df.select(F.when(F.coalesce("qual", F.lit("")) == "", F.concat(F.lit(">"), "id1", F.lit("\n"), "seq")).otherwise(full).alias("value"))


def csfasta(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of the colour file and of the quality file."""
    head = F.concat(F.lit(">"), "name", F.lit("\n"))
    return df.select(F.concat(head, "colors").alias("value")), df.select(F.concat(head, F.array_join(F.col("qual").cast("array<string>"), " ")).alias("value"))


def tsv(df: DataFrame, null: str = "NA") -> DataFrame:
    return df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in df.columns)).alias("value"))


def write_lines(lines: DataFrame, path: str, one_file: bool = False) -> None:
    (lines.coalesce(1) if one_file else lines).write.mode("overwrite").text(path)


def save_table(df: DataFrame, name: str, key: list[str], order: list[str]) -> None:
    """A catalog table in which the first row of each key stays."""
    from pyspark.sql import Window

    first = df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")
    first.write.mode("overwrite").saveAsTable(name)


def save_pairs(df: DataFrame, path: str, key: str, value: str) -> None:
    """Key and value as Parquet, sorted by key within files that have ranges of keys of their own; of a repeated key the smallest value."""
    pairs = df.groupBy(F.col(key).alias("key")).agg(F.min(value).alias("value"))
    pairs.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def read_tables(spark, *names: str) -> DataFrame:
    """Rows of several tables under one another."""
    out = spark.table(names[0])
    for n in names[1:]:
        out = out.unionByName(spark.table(n))
    return out


def write_by_name(df: DataFrame, path: str, name: str = "name") -> None:
    """One folder of lines for each name."""
    df.write.mode("overwrite").partitionBy(name).text(path)


def compressed(df: DataFrame, column: str) -> DataFrame:
    """A text column as zlib bytes."""
    return _bytes(df, column, lambda s: zlib.compress(s.encode()), "binary")


def decompressed(df: DataFrame, column: str) -> DataFrame:
    return _bytes(df, column, lambda b: zlib.decompress(b).decode(), "string")


def _bytes(df: DataFrame, column: str, f, kind: str) -> DataFrame:
    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{column: [None if v is None else f(v) for v in frame[column]]})

    schema = ", ".join(f"`{c}` {kind if c == column else t}" for c, t in df.dtypes)
    return df.mapInPandas(each, schema)
