"""FASTA files by byte ranges: where each sequence's bases lie, and stretches read from there.

Splits of the files are scanned for runs of lines of equal length.  With what
comes before them summed up, these segments say at which byte any base stands;
no sequence is ever one row.  A stretch, or a chunk of a genome, is then read by
seeking to its bytes.  Files have to be uncompressed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.intervals import interval_join
from .bam import SPLIT, _opened, _qualified, _system

_SCHEMA = "path string, offset long, head string, lines long, line_bases long, line_bytes long, blanks boolean"
#: Bases in a batch.
HELD = 16 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Part(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the file, or of each file of a folder that is not hidden."""
    import pyarrow.fs as fs

    system, name = _system(path)
    info = system.get_file_info(name)
    if info.type != fs.FileType.Directory:
        return [(path, info.size)]
    inside = sorted(system.get_file_info(fs.FileSelector(name)), key=lambda f: f.base_name)
    return [(f"{path.rstrip('/')}/{f.base_name}", f.size) for f in inside if f.is_file and f.base_name[0] not in "._"]


def scan(file, start: int, stop: int) -> list[tuple]:
    """Rows (offset, head, lines, line_bases, line_bytes, blanks) of the lines that begin in [start, stop).

    A header is a row with its text; a run of lines with equal numbers of bases
    and bytes is a row without.  blanks: bases are not in one piece.
    """
    file.seek(max(0, start - 1))
    data = file.read(stop - max(0, start - 1))
    skip = 0
    if start:  # the first line begins after a line's end
        skip = data.find(b"\n") + 1
        if not skip:
            return []
    origin = max(0, start - 1) + skip
    tail, ends_here = b"", data[-1:] == b"\n"
    while not ends_here and skip < len(data):
        more = file.read(1 << 20)
        at = more.find(b"\n")
        tail += more if at < 0 else more[: at + 1]
        ends_here = at >= 0 or not more
    raw = np.frombuffer(data[skip:] + tail, np.uint8)
    if not len(raw):
        return []
    closed = np.flatnonzero(raw == 10)
    begin = np.concatenate([[0], closed + 1])
    begin = begin[begin < len(raw)]
    end = closed if len(closed) == len(begin) else np.append(closed, len(raw))
    base = ~_BLANK[raw]
    total = np.concatenate([[0], np.cumsum(base)])
    bases = total[end] - total[begin]
    last = np.maximum.accumulate(np.where(base, np.arange(len(raw)), -1))[np.maximum(end - 1, 0)] + 1
    blanks = (bases > 0) & (last - begin != bases)
    head = raw[begin] == ord(">")
    size = end + 1 - begin
    kept = np.flatnonzero(head | (bases > 0))
    change = np.ones(len(kept), bool)
    a, b = kept[1:], kept[:-1]
    change[1:] = head[a] | head[b] | (a != b + 1) | (bases[a] != bases[b]) | (size[a] != size[b]) | blanks[a] | blanks[b]
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(kept)))
    out = []
    for i, n in zip(kept[first].tolist(), count.tolist()):
        text = raw[begin[i] + 1 : end[i]].tobytes().decode(errors="replace").rstrip() if head[i] else None
        out.append((origin + int(begin[i]), text, n, 0 if head[i] else int(bases[i]), int(size[i]), bool(blanks[i])))
    return out


class SegmentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("splitbytes", SPLIT))

    def partitions(self):
        return [Part(path, a, min(size, a + self.size)) for path, size in _files(self.path) for a in range(0, max(1, size), self.size)]

    def read(self, part: Part):
        rows = [(part.path, *r) for r in scan(_opened(part.path)[0], part.start, part.stop)]
        if rows:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in _SCHEMA.split(", ")])


class SegmentSource(DataSource):
    """format('fasta_segments'): headers and runs of lines of a file or folder in `path`; option splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "fasta_segments"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> SegmentReader:
        return SegmentReader(self.options)


def segments(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """seqname, description, ord, start, end, and where these bases are: path, offset, line_bases, line_bytes, blanks.

    ord numbers a file's records.  A record without bases has one row with
    start = end = 0.  Lines before the first header belong to none and are left
    out.  A window a file works on one row for each record and split.
    """
    spark.dataSource.register(SegmentSource)
    rows = spark.read.format("fasta_segments").option("splitBytes", split_bytes).load(_qualified(spark, path))
    order = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ord", F.count("head").over(order) - 1).filter("ord >= 0")
    record = Window.partitionBy("path", "ord")
    bases = F.col("lines") * F.col("line_bases")
    rows = rows.withColumns({"end": F.sum(bases).over(record.orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)), "description": F.max("head").over(record), "_n": F.count("*").over(record)})
    return rows.filter("head is null or _n = 1").select(F.split("description", r"\s", 2)[0].alias("seqname"), "description", "ord", (F.col("end") - bases).alias("start"), "end", "path", "offset", "line_bases", "line_bytes", "blanks")


def offsets(found: DataFrame) -> DataFrame:
    """The offset table of segments: seqname, length, offset (of the first base), line_bases, line_bytes, uniform.

    uniform: all lines but the last are alike, so that these numbers place every base.
    """
    first = F.min(F.struct("offset", "line_bases", "line_bytes"))
    rows = found.groupBy("path", "ord", "seqname").agg(F.max("end").alias("length"), first.alias("f"), F.max("offset").alias("last"), F.max("blanks").alias("blanks"))
    alike = found.select("path", "ord", "start", "end", "offset", F.col("line_bases").alias("b"), F.col("line_bytes").alias("w")).join(rows, ["path", "ord"])
    odd = (F.col("b") != F.col("f.line_bases")) & ~((F.col("offset") == F.col("last")) & (F.col("b") < F.col("f.line_bases")) & (F.col("end") - F.col("start") == F.col("b"))) | (F.col("b") == F.col("f.line_bases")) & (F.col("w") != F.col("f.line_bytes")) & (F.col("offset") != F.col("last"))
    out = alike.groupBy("path", "ord", "seqname").agg(F.max("length").alias("length"), F.first("f").alias("f"), (~(F.max(odd) | F.max("blanks"))).alias("uniform"))
    return out.select("seqname", "length", F.when(F.col("length") > 0, F.col("f.offset")).alias("offset"), "f.line_bases", "f.line_bytes", "uniform")


def _stretch(file, piece: dict) -> bytes:
    """The bases [first, last) of a segment."""
    first, last, width, line = piece["first"], piece["last"], piece["line_bases"], piece["line_bytes"]
    if piece["blanks"]:
        file.seek(piece["offset"])
        return b"".join(file.read(line).split())[first:last]
    begin, end = (piece["offset"] + i // width * line + i % width for i in (first, last - 1))
    file.seek(begin)
    return b"".join(file.read(end + 1 - begin).split())


def fetch_ranges(regions: DataFrame, found: DataFrame, parts: int | None = None) -> DataFrame:
    """Columns of regions (seqname, start, end, half-open) with seq, read from the files of segments.

    Regions meet segments by overlap; what moves are numbers, and each task
    reads its regions' bytes in the files' order.  Ends beyond the sequence are
    cut; a sequence that no file has gives null.  `parts` is the number of tasks
    that read (the session's shuffle partitions).
    """
    key = ["seqname", "start", "end"]
    spark, own = regions.sparkSession, regions.select(*key).distinct()
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    piece = F.struct(
        F.col("start_b").alias("at"), F.col("path_b").alias("path"), F.col("offset_b").alias("offset"), (F.greatest("start", "start_b") - F.col("start_b")).alias("first"),
        (F.least("end", "end_b") - F.col("start_b")).alias("last"), F.col("line_bases_b").alias("line_bases"), F.col("line_bytes_b").alias("line_bytes"), F.col("blanks_b").alias("blanks"),
    )
    asked = interval_join(own.filter("start < end"), found.filter("start < end").drop("description", "ord"), ["seqname"]).groupBy(*key).agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    asked = asked.withColumn("_to", F.struct("pieces.path", "pieces.offset")).repartitionByRange(parts, "_to").sortWithinPartitions("_to").drop("_to")

    def read(stream):
        name, file = None, None
        for batch in stream:
            done, out, size = 0, [], 0
            for i, pieces in enumerate(batch.column("pieces").to_pylist()):
                text = []
                for p in pieces:
                    if p["path"] != name:
                        name, file = p["path"], _opened(p["path"])[0]
                    text.append(_stretch(file, p))
                out.append(b"".join(text).decode())
                size += len(out[-1])
                if size > HELD or i + 1 == batch.num_rows:
                    rows = batch.slice(done, len(out))
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in key), pa.array(out, pa.string())], [*key, "seq"])
                    done, out, size = i + 1, [], 0

    got = asked.mapInArrow(read, "seqname string, start long, end long, seq string")
    known = found.select("seqname").distinct().withColumn("_known", F.lit(""))
    return regions.join(got, key, "left").join(known, "seqname", "left").select(*regions.columns, F.coalesce("seq", "_known").alias("seq"))


def read_chunks(spark: SparkSession, path: str, width: int = 1 << 16, split_bytes: int = SPLIT) -> DataFrame:
    """seqname, chunk_start, seq of all sequences of a file or folder, cut into `width` bases; a name should be there once."""
    found = segments(spark, path, split_bytes)
    size = found.groupBy("path", "ord", "seqname").agg(F.max("end").alias("length")).filter("length > 0")
    cuts = size.select("seqname", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(width).cast("long"))).alias("start"))
    regions = cuts.select("seqname", "start", F.least(F.col("start") + width, "length").alias("end"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(n for _, n in _files(_qualified(spark, path))) // split_bytes + 1)
    return fetch_ranges(regions, found, parts).select("seqname", F.col("start").alias("chunk_start"), "seq")
