"""Column functions on sequences, colours and qualities; all but the decoding of colours and the printing of numbers are built-in expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements of bases and ambiguity codes.
BASES, COMPLEMENTS = "ACGTUacgtuRYKMBVDHrykmbvdh", "TGCAAtgcaaYRMKVBHDyrmkvbhd"
# Stop codons and their reverse complements.
STOPS, REVERSE_STOPS = "TAG|TAA|TGA", "CTA|TTA|TCA"


def complement(seq: Column) -> Column:
    """Case and all characters that are no bases stay."""
    return F.translate(seq, BASES, COMPLEMENTS)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def fetch(seq: Column, start: Column, end: Column, strand: Column | None = None) -> Column:
    """Bases start .. end, 0-based with both ends included and clamped; reverse-complemented unless strand is '+'."""
    low = F.greatest(start, F.lit(0))
    part = F.substr(seq, (low + 1).cast("int"), F.greatest(F.least(end, F.length(seq) - 1) - low + 1, F.lit(0)).cast("int"))
    return part if strand is None else F.when(strand == "+", part).otherwise(reverse_complement(part))


def wrap(seq: Column, width: int) -> Column:
    """Line feeds after every `width` characters, none at the end."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def bases_only(seq: Column, keep: str = "ACGTU") -> Column:
    return F.regexp_replace(F.upper(seq), f"[^{keep}]", "")


def count_of(seq: Column, letters: str) -> Column:
    return (F.length(seq) - F.length(F.translate(seq, letters, ""))).cast("long")


def gc_fraction(seq: Column) -> Column:
    """G and C by all bases but N; null without bases."""
    return F.try_divide(count_of(seq, "GCgc").cast("double"), (F.length(seq) - count_of(seq, "Nn")).cast("double"))


def stop_codons(seq: Column, reverse: bool = False) -> Column:
    """Stop codons at any offset, not overlapping."""
    return F.regexp_count(seq, F.lit(REVERSE_STOPS if reverse else STOPS)).cast("long")


def _decoded(colors: str) -> str:
    """A running exclusive or over the codes of primer and colours; N from the first unknown on."""
    points = np.frombuffer(colors.encode("utf-32-le"), np.uint32)
    if not len(points):
        return ""
    codes = np.where((points >= ord("0")) & (points <= ord("3")), points - np.uint32(ord("0")), 4).astype(np.uint8)
    codes[0] = max(0, "ACGT".find(colors[0])) if colors[0] in "ACGT" else 4
    known = np.logical_and.accumulate(codes < 4)
    bases = np.frombuffer(b"ACGT", np.uint8)[np.bitwise_xor.accumulate(np.where(known, codes, 0))]
    return colors[0] + np.where(known, bases, ord("N"))[1:].astype(np.uint8).tobytes().decode()


def _decoded_rows(rows: pd.Series) -> pd.Series:
    return rows.map(_decoded, na_action="ignore")


def dibase_decode(colors: Column) -> Column:
    """Primer base and colours to bases: a base's code (A C G T) is the one before xor the colour; from the first unknown on, N.

    A running sum of codes is no built-in expression, so this one runs in numpy, an array for each read.
    """
    return F.pandas_udf(_decoded_rows, "string")(colors)


def double_encode(colors: Column) -> Column:
    """Colours as letters without the primer and the first colour; other characters go."""
    return F.regexp_replace(F.translate(F.substr(colors, F.lit(3)), "0123.", "ACGTN"), "[^ACGTN]", "")


def quality_text(quals: Column, base: int = 33) -> Column:
    """Qualities as characters; negative ones count as 0."""
    return F.array_join(F.transform(quals, lambda q: F.chr(F.greatest(q, F.lit(0)) + base)), "")


def pair_sums(quals: Column) -> Column:
    """Sums of neighbours, the last alone."""
    return F.transform(quals, lambda q, i: q + F.coalesce(F.get(quals, i + 1), F.lit(0)))


def mean_of(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def color_tail(colors: Column) -> Column:
    """Index of the last colour that is not 0 or '.', counted without the primer; -1 if there is none."""
    return F.length(F.rtrim(colors, F.lit("0."))) - 2


def trimmed_colors(colors: Column) -> Column:
    """Colours up to the last that is not 0 or '.', where a tail follows; the primer is not part of it."""
    return F.reverse(F.regexp_extract(F.reverse(colors), r"^[0.]+([123][0123.]*)", 1))  # anchored: linear in long texts


def trim_tails(seq: Column, m: int = 4, stranded: bool = False) -> tuple[Column, Column]:
    """(kept start, kept length): without a tail of m or more A, and without a head of m or more T unless stranded."""
    head = F.lit(0) if stranded else F.length(F.regexp_extract(seq, f"(?i)^(T{{{m},}})", 1))
    rest = F.substr(seq, head + 1)
    return head, F.length(F.regexp_replace(rest, f"(?i)A{{{m},}}$", ""))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def to_ucsc(name: Column) -> Column:
    """Chromosome names with 'chr': numbers below 100, X, Y, MT as M, and names with 'random'."""
    number = F.regexp_extract(name, "^([0-9]+)[a-z]?$", 1)
    small = (number != "") & (F.length(F.regexp_replace(number, "^0+", "")) <= 2)
    return F.when(small | name.isin("X", "Y") | name.contains("random"), F.concat(F.lit("chr"), name)).when(name == "MT", "chrM").otherwise(name)


def alignment_to_ucsc(name: Column) -> Column:
    """The same for alignment blocks: whole numbers without leading zeros, and names that begin with MT."""
    return F.when(name.rlike("^[0-9]+$"), F.concat(F.lit("chr"), F.regexp_replace(name, "^0+(?=[0-9])", ""))).when(name.startswith("MT"), "chrM").otherwise(name)


def chromosome_number(name: Column) -> Column:
    """Sort key of natural order; names without a number come last."""
    digits = F.regexp_extract(name, "([0-9]+)", 1)
    return F.when(digits == "", 99999).otherwise(digits.try_cast("int"))


def score_to_phred(text: Column) -> Column:
    """Integer score: -10 log10 of values written with '.' or 'e', truncated; whole numbers as they are; else 0."""
    x = text.try_cast("double")
    log = F.when(x > 0, F.when(x * 0 == 0, -10 * F.log10(x)))
    value = F.when(text.rlike(r"[e.]"), log.try_cast("long")).otherwise(text.try_cast("long"))
    return F.coalesce(value, F.lit(0).cast("long"))


def klets(seq: Column, k: int) -> Column:
    """All substrings of length k, in order; none in shorter sequences."""
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    n = F.greatest(F.size(letters) - (k - 1), F.lit(0))
    stacked = F.arrays_zip(*(F.slice(letters, j + 1, n).alias(f"c{j}") for j in range(k)))  # inside a function of its elements the letters would be split each time
    return F.transform(stacked, lambda x: F.concat(*(x[f"c{j}"] for j in range(k))))


def block_line_to_ucsc(line: Column, field: int = 2) -> Column:
    """A SEQ line of an alignment file with the chromosome in `field` renamed: MT as chrM, names that begin with a digit after 'chr'.

    Blanks between fields become single ones; other lines stay as they are.
    """
    parts = F.split(F.trim(line), r"\s+")
    name = lambda x: F.when(x == "MT", "chrM").when(x.rlike("^[0-9]"), F.concat(F.lit("chr"), x)).otherwise(x)
    return F.when(line.startswith("SEQ"), F.array_join(F.transform(parts, lambda x, i: F.when(i == field, name(x)).otherwise(x)), " ")).otherwise(line)


def table_name(path: Column, ending: str = ".bed") -> Column:
    """A file's name without folders and `ending`."""
    base = F.substring_index(path, "/", -1)
    return F.when(base.endswith(ending), F.substr(base, F.lit(1), F.length(base) - len(ending))).otherwise(base)


# Fixed value: which part of an alignment file's path names its chromosome.
ALIGNMENT_FILE = r"([^\/^\.]+)[^\/]+\.fasta$"


def file_chromosome(path: Column) -> Column:
    """The chromosome that an alignment file's name begins with; other paths as they are."""
    name = F.regexp_extract(path, ALIGNMENT_FILE, 1)
    return F.when(name == "", path).otherwise(name)


def _printed(value: Column, form: str) -> Column:
    """A number as C prints it: the nearest text to its binary value, of two equally near the even one.

    Java's formatter, and so format_string(), rounds halves up, and rounds the shortest decimal form instead of the value.
    """
    each = F.pandas_udf(lambda rows: rows.map(lambda x: form % x).astype(object), "string")
    return F.when(value.isNotNull(), each(value.cast("double")))


def scientific(value: Column, digits: int = 6) -> Column:
    """A number as %e prints it, with `digits` decimals."""
    return _printed(value, f"%.{digits}e")


def fixed(value: Column, digits: int = 6) -> Column:
    """A number as %f prints it, with `digits` decimals."""
    return _printed(value, f"%.{digits}f")
