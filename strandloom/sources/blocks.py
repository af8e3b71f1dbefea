"""Lines of block-gzip files, split anywhere: a record belongs to the split that holds the separator before it.

A split begins with its first block, drops what is before the first separator
and reads beyond its end until its last record does.  A separator counts where
its first byte is.  The file's first record belongs to its first split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .bam import SPLIT, _block_size, _blocks, _first_block, _opened, _qualified

_SCHEMA = "value string, _file string, _block long"
_NAMED = (".gz", ".bgz", ".bgzf")


def is_blocked(spark: SparkSession, path: str) -> bool:
    """Whether a file is named as compressed and begins with a block of the format; plain gzip does not."""
    return path.endswith(_NAMED) and _block_size(_opened(_qualified(spark, path))[0].read(64)) > 0


def records(file, size: int, start: int, stop: int, separator: bytes) -> Iterator[list[bytes]]:
    """Lists of the records that belong to the compressed range [start, stop)."""
    at = _first_block(file, start, size) if start else 0
    if at is None or at >= stop:
        return
    held, known, beyond = b"", start == 0, None
    for offset, content in _blocks(file, at):
        if offset >= stop and beyond is None:
            beyond = len(held)  # separators that begin at or after this place are of the next split
        held += content
        if not known:
            place = held.find(separator)
            if beyond is not None and not 0 <= place < beyond:
                return
            if place < 0:
                held = held[len(held) - len(separator) + 1 :]
                continue
            held, known = held[place + len(separator) :], True
            beyond = None if beyond is None else max(0, beyond - place - len(separator))
        if beyond is None:
            *whole, held = held.split(separator)
            yield whole
            continue
        while (place := held.find(separator)) >= 0:
            yield [held[:place]]
            if place >= beyond:
                return
            held, beyond = held[place + len(separator) :], max(0, beyond - place - len(separator))
    if known and held:
        yield [held]


class Part(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class BlockedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size, self.separator = options["path"], int(options.get("splitbytes", SPLIT)), options.get("separator", "\n").encode()

    def partitions(self):
        size = _opened(self.path)[1]
        return [Part(self.path, a, min(size, a + self.size)) for a in range(0, size, self.size)]

    def read(self, part: Part):
        file, size = _opened(part.path)
        for lines in records(file, size, part.start, part.stop, self.separator):
            if lines:
                raw = pa.array(lines, pa.binary())  # the bytes are text as they are
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.string(), len(raw), raw.buffers()), pa.array([part.path] * len(raw)), pa.array([part.start] * len(raw), pa.int64())], ["value", "_file", "_block"])


class BlockedText(DataSource):
    """format('blocked_text'): records of a block-gzip file; options splitBytes and separator."""

    @classmethod
    def name(cls) -> str:
        return "blocked_text"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> BlockedReader:
        return BlockedReader(self.options)


def read_blocked(spark: SparkSession, path: str, separator: str = "\n", split_bytes: int = SPLIT) -> DataFrame:
    """value, _file, _block: records in the file's order within a block range, which begins at _block."""
    spark.dataSource.register(BlockedText)
    return spark.read.format("blocked_text").option("splitBytes", split_bytes).option("separator", separator).load(_qualified(spark, path))
