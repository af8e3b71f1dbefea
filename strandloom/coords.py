"""Canonical coordinates: (seqname, start, end, strand), 0-based and half-open; sources and sinks convert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the position bins that split a sequence for sweeps.
BIN = 1 << 16

CIGAR = "array<struct<op:string,len:int>>"
ALIGNMENTS = f"qname string, flag int, seqname string, pos long, mapq int, cigar {CIGAR}, mseqname string, mpos long, isize long, seq string, qual string, aux map<string,struct<type:string,value:string>>"
GTF = "seqname string, source string, feature string, start long, end long, score double, strand string, frame int, attributes map<string,string>"
BED = "seqname string, start long, end long, name string, score double, strand string, extra array<string>"


def one_based_closed(start: Column, end: Column) -> tuple[Column, Column]:
    """Half-open to GTF coordinates."""
    return start + 1, end


def from_one_based_closed(df: DataFrame) -> DataFrame:
    """GTF coordinates to half-open."""
    return df.withColumn("start", F.col("start") - 1)


def region(text: str) -> tuple[str, int, int]:
    """'chr:beg-end', 1-based and closed, commas and blanks allowed, to half-open; a missing end is 2 ** 29."""
    name, _, span = text.replace(",", "").replace(" ", "").partition(":")
    first, _, last = span.partition("-")
    begin = int(first) if first else 0
    return name, max(0, begin - 1), int(last) if last else 1 << 29
