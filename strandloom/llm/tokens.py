"""Token ids as ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

Texts are encoded with a published tokenizer, sorted by document id across
files (a range partitioning, so a file's and a stripe's id range are narrow and
metadata rule out the rest) and written as stripes that tasks read in parallel.
"""

from __future__ import annotations

import re
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import cut, spread

#: Encoded words that are remembered, in each of two generations.
MEMORY = 500_000
#: A lone space between two characters that are no white space ends a pre-token of a byte-level BPE
#: and begins the next one, so texts may be cut there.
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?= [^\s\x1c-\x1f\x85])")
#: Texts without these, or a space at either end, are words between lone spaces and line feeds.
_UNEVEN = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
_BLANKS = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


#: ASCII characters that are neither letters nor digits nor blank.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    table, n = {}, 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            table[b] = chr(b)
        else:
            table[b], n = chr(n), n + 1
    return table


class _Words(dict):
    """Ids of words after `lead` ('' or ' '), as little-endian bytes; what is long unused is forgotten."""

    def __init__(self, tokenizer, lead: str):
        super().__init__()
        self.tokenizer, self.model, self.lead, self.letters, self.old = tokenizer, tokenizer.model, lead, _byte_letters(), {}
        self.mark = lead.translate(self.letters)
        self.packed = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
        self.runs: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
            self.runs.clear()
        ids = self.old.get(word)
        if ids is None:
            stem = word.rstrip(_SIGNS)
            if not stem.isalpha():
                ids = self.whole(self.lead + word)
            elif len(stem) < len(word):  # signs after letters are a pre-token of their own
                run = word[len(stem) :]
                ids = self[stem] + (self.runs.get(run) or self.runs.setdefault(run, self.whole(run)))
            else:  # one pre-token
                mapped = self.mark + word if word.isascii() else (self.lead + word).encode().decode("latin-1").translate(self.letters)
                ids = b"".join([self.packed[t.id] for t in self.model.tokenize(mapped)])
        self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(path: str, end_id: int = 0):
    """A function from a list of texts to a list of little-endian unsigned 32-bit id strings, end_id after each.

    Equal words are encoded once and remembered; that holds for tokenizers that
    split texts by the usual byte-level pattern, for others use the library itself.
    """
    import tokenizers

    # Functions arrive anew with each task; a module of our own lives as long as the worker.
    kept = vars(sys.modules.setdefault("strandloom_encoders", types.ModuleType("strandloom_encoders"))).setdefault("kept", {})
    if path not in kept:
        tokenizer = tokenizers.Tokenizer.from_file(path)
        kept[path] = (_Words(tokenizer, ""), _Words(tokenizer, " "))
    first, later = kept[path]
    line_feed, end = first.whole("\n"), np.array([end_id], "<u4").tobytes()

    def line(text: str) -> bytes:
        words = text.split(" ")
        return first[words[0]] + b"".join(map(later.__getitem__, words[1:]))

    def encode(text: str | None) -> bytes:
        if not text:
            return end
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _UNEVEN) or not text.isascii() and _BLANKS.search(text):
            return b"".join(map(first.whole, _CUT.split(text))) + end
        return line_feed.join(map(line, text.split("\n"))) + end

    return lambda texts: [encode(t) for t in texts]


def encoded(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """doc_id, tokens (array<int>) for each row of docs; a null text is empty, so only end_id remains."""

    def rows(stream):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(path, end_id)
        for batch in stream:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                ids = encode(part.column("text").to_pylist())
                bounds = np.cumsum([0, *(len(x) // 4 for x in ids)])
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)], ["doc_id", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, tokens array<int>")


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = 0, stripe_bytes: int = 32 << 20, index_stride: int = 1000) -> None:
    """Writes docs' token ids to ORC files below `out`, in ascending doc_id order over files and within each.

    docs needs doc_id (long) and text (string); other columns are ignored.
    Rows with a null id come first, repeated rows are written as often as they
    stand.  Ids are integer run-length encoded by the ORC writer; each stripe
    has a row index every index_stride rows and a Bloom filter on doc_id.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = spread(own)
    (
        encoded(own.repartitionByRange(parts, "doc_id"), path, end_id)
        .sortWithinPartitions("doc_id")
        .write.option("compression", "none")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", index_stride)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(out)
    )


def read_tokens(spark: SparkSession, out: str, ids: Column | None = None) -> DataFrame:
    """doc_id and tokens from files; a predicate on doc_id is pushed to stripe statistics, row indexes and Bloom filters."""
    df = spark.read.schema("doc_id long, tokens array<int>").orc(out)
    return df if ids is None else df.filter(ids)


def _checksums(stream):
    for batch in stream:
        tokens = batch.column("tokens")
        bounds = tokens.offsets.to_numpy()
        values = tokens.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        sums = [zlib.crc32(values[a:b]) for a, b in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(sums, pa.int64()), batch.column("file")], ["doc_id", "n_tokens", "ids_crc32", "file"])


def token_table(spark: SparkSession, out: str) -> DataFrame:
    """From written files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Offsets are summed in two steps: a total for each file, running totals over
    the few files, then running sums inside each file.  Rows that share an id
    follow each other by checksum.
    """
    stored = read_tokens(spark, out).select("doc_id", "tokens", F.col("_metadata.file_name").alias("file"))
    docs = cut(stored.mapInArrow(_checksums, "doc_id long, n_tokens long, ids_crc32 long, file string"))
    files = docs.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min(F.struct("doc_id", "file")).alias("at"))
    # One row a file; the range partitioning keeps equal ids in one file.
    offsets = files.select("file", (F.sum("n").over(Window.orderBy("at")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("file").orderBy("doc_id", "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    return docs.join(offsets, "file").select("doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")
