"""BAM as a Python data source: block-gzip files split at compressed offsets, records found inside the splits.

A split has the records that begin in a block at or after its start and before
its end.  Where its first block does not begin with the header's end, the first
record is the first place from which a chain of plausible records runs, over a
few records and all that the blocks read so far hold.  Filters on seqname and
pos are tried before a record is decoded, and an index beside the file (.bai)
rules out splits.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..coords import ALIGNMENTS
from . import bam_index

# Nucleotide codes, CIGAR operations and the sizes of numeric tag types.
NUCLEOTIDES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
TAG_TYPES = {"c": ("b", 1), "C": ("B", 1), "s": ("h", 2), "S": ("H", 2), "i": ("i", 4), "I": ("I", 4), "f": ("f", 4)}
#: Operations that take reference bases, by number.
CONSUMING = frozenset(i for i, op in enumerate(OPERATIONS) if op in "MDN=X")
SPLIT, LONGEST = 32 << 20, 1 << 29
#: Records in a batch, and records in a row that tell where one begins.
BATCH, CHAIN = 4096, 4
_TAG = pa.struct([("type", pa.string()), ("value", pa.string())])
_KINDS = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())])), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), _TAG)]
_NAMES = ["qname", "flag", "seqname", "pos", "mapq", "cigar", "mseqname", "mpos", "isize", "seq", "qual", "aux"]


class Split(InputPartition):
    def __init__(self, path: str, spans: list[tuple[int, int, int | None, int | None]]):
        self.path, self.spans = path, spans


def _system(path: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _opened(path: str):
    system, name = _system(path)
    return system.open_input_file(name), system.get_file_info(name).size


def _files(path: str) -> list[str]:
    """The file, or the .bam files of a folder."""
    import pyarrow.fs as fs

    system, name = _system(path)
    if system.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    return [f"{path.rstrip('/')}/{f.base_name}" for f in sorted(system.get_file_info(fs.FileSelector(name)), key=lambda f: f.base_name) if f.base_name.endswith(".bam")]


def _block_size(head: bytes) -> int:
    """Size of the block that begins here; 0 if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at < 12 + extra and at + 4 <= len(head):
        tag, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if tag == b"BC" and size == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return 0


def _blocks(file, at: int, wanted=lambda offset: True) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of blocks from the one at `at`, as long as they are wanted."""
    while wanted(at):
        file.seek(at)
        head = file.read(64)
        size = _block_size(head)
        if not size:
            return
        data = head[:size] + file.read(max(0, size - len(head)))
        yield at, zlib.decompress(data[12 + struct.unpack_from("<H", data, 10)[0] : -8], -15)
        at += size


def _first_block(file, start: int, size: int) -> int | None:
    """Offset of the first block at or after start: one that is followed by another or by the end."""
    file.seek(start)
    data = file.read(1 << 17)
    at = data.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        own = _block_size(data[at : at + 64])
        if own:
            after = start + at + own
            file.seek(after)
            if after >= size or _block_size(file.read(64)):
                return start + at
        at = data.find(b"\x1f\x8b\x08\x04", at + 1)
    return None


def _header(file) -> tuple[list[tuple[str, int]], int, int]:
    """(targets, offset of the block that holds the first record, its place in that block)."""
    data, marks = b"", []
    for offset, content in _blocks(file, 0):
        marks.append((len(data), offset))
        data += content
        try:
            at = 8 + struct.unpack_from("<i", data, 4)[0]
            n, at, targets = struct.unpack_from("<i", data, at)[0], at + 4, []
            for _ in range(n):
                size = struct.unpack_from("<i", data, at)[0]
                if len(data) < at + 8 + size:
                    raise struct.error
                targets.append((data[at + 4 : at + 3 + size].decode(), struct.unpack_from("<i", data, at + 4 + size)[0]))
                at += 8 + size
            if data[:4] != b"BAM\1":
                raise ValueError("not a BAM file")
            begin, block = max(m for m in marks if m[0] <= at)
            return targets, block, at - begin
        except struct.error:
            continue
    return [], 0, 0


def _plausible(data: bytes, at: int, n_targets: int) -> int:
    """Where the record that may begin here ends; 0 if none can."""
    if at + 36 > len(data):
        return 0
    size, tid, pos, bits, fn, l_seq, mtid, mpos = struct.unpack_from("<iiiIIiii", data, at)
    name, ops = bits & 0xFF, fn & 0xFFFF
    least = 32 + name + 4 * ops + (l_seq + 1) // 2 + l_seq
    good = 32 < size < 1 << 27 and -1 <= tid < n_targets and -1 <= mtid < n_targets and pos >= -1 and mpos >= -1 and 0 <= l_seq < 1 << 26 and name and least <= size
    if good and at + 36 + name <= len(data):
        text = data[at + 36 : at + 36 + name]
        good = text[-1] == 0 and all(33 <= c <= 126 for c in text[:-1])
    return at + 4 + size if good else 0


def _first_record(data: bytes, n_targets: int, whole: bool) -> int | None:
    """The first place from which CHAIN plausible records run (or, at the end of the file, as many as there are up to it)."""
    for at in range(len(data) - 3):
        end, run = at, 0
        while run < CHAIN and end + 36 <= len(data):
            after = _plausible(data, end, n_targets)
            if not after:
                end = -1
                break
            end, run = after, run + 1
        if run == CHAIN or whole and run and end == len(data):
            return at
    return None


def decode(data: bytes, names: list[str]) -> tuple:
    """One record (without its size) as a row of the canonical schema."""
    tid, pos, bits, fn, l_seq, mtid, mpos, isize = struct.unpack_from("<iiIIiiii", data, 0)
    l_name, n_ops, flag, at = bits & 0xFF, fn & 0xFFFF, fn >> 16, 32
    qname = data[at : at + l_name - 1].decode()
    at += l_name
    walk = [{"op": "M" if v & 15 > 6 else OPERATIONS[v & 15], "len": v >> 4} for v in struct.unpack_from(f"<{n_ops}I", data, at)]
    at += 4 * n_ops
    packed = data[at : at + (l_seq + 1) // 2]
    seq = "".join(NUCLEOTIDES[b >> 4] + NUCLEOTIDES[b & 15] for b in packed)[:l_seq] or None
    at += (l_seq + 1) // 2
    qual = data[at : at + l_seq]
    at += l_seq
    aux = {}
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in TAG_TYPES:  # integers of all sizes are one type in the canonical schema
            form, size = TAG_TYPES[kind]
            value = str(struct.unpack_from("<" + form, data, at)[0])
            at += size
            kind = "f" if kind == "f" else "i"
        elif kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind == "B":
            form, size = TAG_TYPES[chr(data[at])]
            n = struct.unpack_from("<i", data, at + 1)[0]
            value = ",".join([chr(data[at]), *map(str, struct.unpack_from(f"<{n}{form}", data, at + 5))])
            at += 5 + n * size
        else:
            break
        aux[tag] = {"type": kind, "value": value}
    if not n_ops and not flag & 4:
        flag |= 4
    name = lambda i: names[i] if i >= 0 else None
    return (None if qname == "*" else qname, flag, name(tid), pos, bits >> 8 & 0xFF, walk, name(mtid), mpos, isize, seq, None if not l_seq or qual[0] == 0xFF else "".join(chr(q + 33) for q in qual), aux)


def read_index(path: str) -> bam_index.Index | None:
    """The index beside the file, if there is one."""
    system, name = _system(path + ".bai")
    return bam_index.load(system.open_input_file(name).read()) if system.get_file_info(name).is_file else None


def reference_end(data: bytes, at: int) -> int:
    """Where the record at `at` (without its size) ends on the reference; at least one base after its start."""
    pos, bits, fn = struct.unpack_from("<iII", data, at + 4)
    walk = struct.unpack_from(f"<{fn & 0xFFFF}I", data, at + 32 + (bits & 0xFF))
    return max(pos + 1, pos + sum(v >> 4 for v in walk if v & 15 in CONSUMING))


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("splitbytes", SPLIT))
        self.regions = bam_index.Regions([tuple(r) for r in json.loads(options["regions"])]) if "regions" in options else None
        self.seqname, self.low, self.high = None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """seqname = x and bounds of pos skip records before they are decoded; Spark tests all filters again."""
        for f in filters:
            column = f.attribute[0].lower() if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column == "seqname" and isinstance(f, EqualTo):
                self.seqname = f.value
            elif column == "pos" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.low = f.value if self.low is None else max(self.low, f.value)
            if column == "pos" and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.high = f.value if self.high is None else min(self.high, f.value)
            yield f

    def _asked(self) -> list[tuple[str, int, int]] | None:
        """The regions that records have to overlap; None if there is no such limit."""
        if self.regions is not None:
            return [(name, *span) for name, own in self.regions.by.items() for span in own]
        if self.seqname is None:
            return None
        return [(self.seqname, max(0, self.low or 0), LONGEST if self.high is None else self.high + 1)]

    def _spans(self, path: str) -> list[tuple[int, int, int | None, int | None]]:
        """(from, to, first record, end): compressed offsets, and virtual ones where an index tells them."""
        file, size = _opened(path)
        asked = self._asked()
        index = read_index(path) if asked is not None else None
        if index is None:
            return [(a, min(size, a + self.size), None, None) for a in range(0, max(1, size), self.size)]
        tids = {name: i for i, (name, _) in enumerate(_header(file)[0])}
        asked = [(tids[name], start, end) for name, start, end in asked if name in tids and start < end]
        chunks = bam_index.joined(c for region in asked for c in index.chunks(*region))
        exact, out = all(index.linear[tid] for tid, *_ in asked), []
        for begin, end in chunks:
            first, last = begin >> 16, (end >> 16) + 1
            out += [(a, min(last, a + self.size), begin if exact and a == first else None, end) for a in range(first, last, self.size)]
        return out

    def partitions(self):
        """One part for about splitBytes of the files' spans; a part has the spans of one file."""
        out = []
        for path in _files(self.path):
            held, size = [], 0
            for span in self._spans(path):
                if held and size + span[1] - span[0] > self.size:
                    out.append(Split(path, held))
                    held, size = [], 0
                held.append(span)
                size += span[1] - span[0]
            if held:
                out.append(Split(path, held))
        return out

    def read(self, split: Split):
        rows = []
        for row in self._rows(split):
            rows.append(row)
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _rows(self, split: Split):
        file, size = _opened(split.path)
        head = _header(file)
        names = [t[0] for t in head[0]]
        wanted = names.index(self.seqname) if self.seqname in names else None
        for span in split.spans:
            for _, data, at, length in records(file, size, head, span):
                tid, pos = struct.unpack_from("<ii", data, at)
                if self.seqname is not None and tid != wanted or self.low is not None and pos < self.low or self.high is not None and pos > self.high:
                    continue
                if self.regions is not None and not (tid >= 0 and self.regions.meet(names[tid], pos, reference_end(data, at))):
                    continue
                yield decode(data[at : at + length], names)


def records(file, size: int, head: tuple, span: tuple[int, int, int | None, int | None]) -> Iterator[tuple[int, bytes, int, int]]:
    """(virtual offset, data, place of the record after its size, its length) of the records that begin in a span of the file."""
    (targets, block, place), (start, stop, known, end) = head, span
    end = size << 16 if end is None else end
    if stop <= block:
        return
    if known is not None:
        at, begin = known >> 16, known & 0xFFFF
    elif start <= block:
        at, begin = block, place
    else:
        at, begin = _first_block(file, start, size), None
    if at is None or at >= stop:
        return
    data, marks = b"", []
    # a block at or beyond the end is read only for a record that began before it, or to find where a record begins
    for offset, content in chain(_blocks(file, at, lambda offset: begin is None or begin < len(data) or offset < stop and offset << 16 < end), [(size, b"")]):
        marks.append((len(data), offset))
        data += content
        if begin is None:
            begin = _first_record(data, len(targets), whole=offset == size)
            if begin is None:
                continue
        i = 0
        while begin + 4 <= len(data):
            while i + 1 < len(marks) and marks[i + 1][0] <= begin:
                i += 1
            here = marks[i][1] << 16 | begin - marks[i][0]
            if marks[i][1] >= stop or here >= end:
                return
            length = struct.unpack_from("<i", data, begin)[0]
            if begin + 4 + length > len(data):
                break
            yield here, data, begin + 4, length
            begin += 4 + length
        while i + 1 < len(marks) and marks[i + 1][0] <= begin:
            i += 1
        if begin < len(data):
            data, marks, begin = data[begin:], [(m - begin, o) for m, o in marks[i:]], 0
        else:
            data, marks, begin = b"", [], 0


class IndexRows(BamReader):
    """Index rows of each split, instead of its records."""

    def read(self, split: Split):
        file, size = _opened(split.path)
        head, built = _header(file), bam_index.Builder()
        for span in split.spans:
            last = None
            for here, data, at, length in records(file, size, head, span):
                if last is not None:
                    built.add(*last, here)
                tid, pos, _, fn = struct.unpack_from("<iiII", data, at)
                last = (tid, pos, reference_end(data, at), bool(fn >> 16 & 4), here)
            if last is not None:  # the last one ends where the next record, which another split has, begins
                built.add(*last, next((x for x, *_ in records(file, size, head, (last[4] >> 16, size, last[4], None)) if x > last[4]), size << 16))
        rows = [(split.path, *row) for row in built.all()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()])], ["path", "tid", "kind", "number", "begin", "end"])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    columns[-1] = [list(x.items()) for x in columns[-1]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS)], _NAMES)


class BamSource(DataSource):
    """format('bam'): a file, or a folder of .bam files, in `path`; options splitBytes and regions (JSON: name, start, end)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return ALIGNMENTS

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


class BamIndexSource(DataSource):
    """format('bam_index_rows'): what splits add to the index of their file."""

    @classmethod
    def name(cls) -> str:
        return "bam_index_rows"

    def schema(self) -> str:
        return "path string, tid int, kind string, number long, begin long, end long"

    def reader(self, schema) -> IndexRows:
        return IndexRows(self.options)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, the session's default one where none is named."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _reader(spark: SparkSession, source: type[DataSource], split_bytes: int):
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(source.name()).option("splitBytes", split_bytes)


def read_bam(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """Alignments of a file or folder.  Filters reach the reader where the session allows it for Python sources."""
    return _reader(spark, BamSource, split_bytes).load(_qualified(spark, path))


def read_bam_regions(spark: SparkSession, path: str, regions: list[tuple[str, int, int]], split_bytes: int = SPLIT) -> DataFrame:
    """Alignments that overlap any of the regions (name, start, end; half-open), each once.

    Where files have an index, only the chunks that it names are opened.  Reads
    without reference bases count as one base.  For more regions than a driver
    plans, join with intervals.interval_join().
    """
    return _reader(spark, BamSource, split_bytes).option("regions", json.dumps([list(r) for r in regions])).load(_qualified(spark, path))


def index_bam(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> int:
    """Writes the index (.bai) of a file, or of each .bam file of a folder, beside it; returns the number of files.

    Tasks scan splits and send chunks, windows and counts; one task for each
    file joins them, which is as much as the index holds.  Files without a
    record on a sequence get none.  An index is written aside and moved.
    """
    rows = _reader(spark, BamIndexSource, split_bytes).load(_qualified(spark, path))

    def written(table: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        name = table.column("path")[0].as_py()
        n = len(_header(_opened(name)[0])[0])
        index = bam_index.merged(zip(*(table.column(c).to_pylist() for c in ("tid", "kind", "number", "begin", "end"))), n)
        system, place = _system(name + ".bai")
        aside = f"{place}._aside-{TaskContext.get().taskAttemptId()}"
        with system.open_output_stream(aside) as out:
            out.write(index.dump())
        system.move(aside, place)
        return pa.table({"path": [name]})

    return rows.groupBy("path").applyInArrow(written, "path string").count()


def read_bam_targets(spark: SparkSession, path: str) -> DataFrame:
    """seqname, length of the header (of a folder's first file)."""
    return spark.createDataFrame(_header(_opened(_files(_qualified(spark, path))[0])[0])[0], "seqname string, length long")


def _tag(kind: str, value: str) -> bytes:
    """A tag's type and value; integers are signed 32-bit where they fit, else unsigned."""
    if kind == "i":
        return b"i" + struct.pack("<i", int(value)) if int(value) < 1 << 31 else b"I" + struct.pack("<I", int(value))
    if kind == "f":
        return b"f" + struct.pack("<f", float(value))
    if kind == "B":
        form, *values = value.split(",")
        return b"B" + form.encode() + struct.pack(f"<i{len(values)}{TAG_TYPES[form][0]}", len(values), *map(float if form == "f" else int, values))
    return kind.encode() + value.encode() + (b"" if kind == "A" else b"\0")


def encode(row: tuple, index: dict[str, int]) -> bytes:
    """One row of the canonical schema as a record with its size.

    A null name is '*', a null place -1, a null mapping quality 255; other null
    numbers are 0.
    """
    qname, flag, seqname, pos, mapq, walk, mseqname, mpos, isize, seq, qual, aux = row
    qname, walk, pos = "*" if qname is None else qname, walk or [], -1 if pos is None else pos
    codes = [NUCLEOTIDES.index(c) for c in seq or ""]
    codes += [0] * (len(codes) % 2)
    end = pos + sum(n for op, n in walk if op in "MDN=X")
    number = bam_index.bin_of(pos, end) if pos >= 0 else 4680  # what the format gives to unplaced reads
    bits = len(qname.encode()) + 1 | (255 if mapq is None else mapq) << 8 | (number & 0xFFFF) << 16
    body = struct.pack("<iiIIiiii", index.get(seqname, -1), pos, bits, len(walk) | (flag or 0) << 16, len(seq or ""), index.get(mseqname, -1), -1 if mpos is None else mpos, isize or 0)
    body += qname.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | OPERATIONS.index(op)) for op, n in walk)
    body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + (bytes(ord(c) - 33 for c in qual) if qual else b"\xff" * len(seq or ""))
    body += b"".join(tag.encode() + _tag(kind, value) for tag, (kind, value) in (aux or {}).items())
    return struct.pack("<i", len(body)) + body


def _compressed(part: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = deflate.compress(part) + deflate.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(part), len(part))


def _start(targets: list[tuple[str, int]]) -> bytes:
    text = "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in targets).encode()
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(targets)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in targets)


def bam_blocks(rows: Iterable[tuple], targets: list[tuple[str, int]], block: int = 60000, aligned: bool = False) -> Iterator[bytes]:
    """The compressed blocks of a file; aligned: records do not cross from one block into the next (unless longer than one)."""
    index, held = {n: i for i, (n, _) in enumerate(targets)}, _start(targets)
    if aligned:
        yield _compressed(held)
        held = b""
    for row in rows:
        record = encode(row, index)
        if aligned and held and len(held) + len(record) > block:
            yield _compressed(held)
            held = b""
        held += record
        while len(held) > block:
            yield _compressed(held[:block])
            held = held[block:]
    if held:
        yield _compressed(held)
    yield _compressed(b"")


def write_bam(rows: list[tuple], targets: list[tuple[str, int]], path: str, block: int = 60000, aligned: bool = False) -> None:
    """A small BAM file from rows of the canonical schema, for exchange and tests."""
    system, name = _system(path)
    with system.open_output_stream(name) as out:
        for part in bam_blocks(rows, targets, block, aligned):
            out.write(part)


def save_bam(df: DataFrame, targets: list[tuple[str, int]], path: str) -> int:
    """Rows of the canonical schema as a folder of BAM files, one for each partition; returns the number of rows.

    A task writes its file aside and moves it to its place, so tasks that are tried again do no harm.
    """
    place = _qualified(df.sparkSession, path)
    system, name = _system(place)
    system.create_dir(name)

    def written(stream):
        from pyspark import TaskContext

        count = 0

        def rows():
            nonlocal count
            for batch in stream:
                for row in batch.select(_NAMES).to_pylist():
                    count += 1
                    yield (*[row[c] for c in _NAMES[:5]], [(x["op"], x["len"]) for x in row["cigar"] or []], *[row[c] for c in _NAMES[6:11]], {k: (v["type"], v["value"]) for k, v in row["aux"] or []})

        own, folder = _system(place)
        task = TaskContext.get()
        aside, at = f"{folder}/_aside-{task.taskAttemptId()}", f"{folder}/part-{task.partitionId():06d}.bam"
        with own.open_output_stream(aside) as out:
            for part in bam_blocks(rows(), targets):
                out.write(part)
        own.move(aside, at)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["n"])

    return df.select(*_NAMES).mapInArrow(written, "n long").groupBy().sum("n").first()[0] or 0
