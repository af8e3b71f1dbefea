"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word's letters are a set: its first e, its second e, and so on, each a place
of a binary vector.  Words that differ by one replaced letter have vectors of
equal size at Hamming distance 2, words that differ by one more letter sizes
next to each other and distance 1.  The places are dealt to a few parts.  For
distance k at most k parts differ, so of the signatures that leave out k parts
and hash the others such words have one in common.  Signatures are met by an
equi-join and words are verified by their edit distance.  As letters alone do
not tell anagrams apart, a signature also holds the half of the word that the
edit leaves as it is - the first or the last, so each signature comes twice.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .runtime import cut

#: Parts of the letter places for a replaced and for an inserted letter, of which 2 and 1 are left out.
REPLACED, INSERTED = 4, 3
#: Letters from frequent to rare, by which places are dealt to parts evenly; others are dealt by their code.
FREQUENT = "enitaroshuldcgmbpfvyéw"


def letter_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words.split() for runs of A-Z, a-z and U+00C0 to U+00FF, whose two bytes are C3 and one more."""
    lead = raw == 0xC3
    letter = np.zeros(256, bool)
    letter[0x41:0x5B] = letter[0x61:0x7B] = letter[0xC3] = True
    inside = letter[raw]
    inside[1:] |= lead[:-1]
    n = len(raw)
    word = np.zeros(n + 2, bool)
    word[1:-1] = inside
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    here, before = word[1:], word[:-1]
    starts, ends = np.flatnonzero(here & (~before | edge)), np.flatnonzero(before & (~here | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def crc_after(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of a text with each span after it: state is the CRC-32 of what comes before each one."""
    table, crc, size = _crc_table(), ~state, ends - starts
    order = np.argsort(-size, kind="stable")  # at each byte the words that are long enough stand in front
    crc, at, size = crc[order], starts[order], size[order]
    for j in range(int(size[0]) if len(size) else 0):
        n = np.searchsorted(-size, -j, "left")
        crc[:n] = table[(crc[:n] ^ raw[at[:n] + j]) & 0xFF] ^ (crc[:n] >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


def _gather(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after another, and their offsets."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    return raw[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])], offsets


def _strings(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])


def _counted(least: int, every: int):
    import zlib

    fold = W.folded()

    def rows(stream):
        for batch in W.batches(stream, 1 << 16, 4 << 20):
            raw, offsets = W.column_bytes(batch.column("text"))
            raw = fold[raw]
            starts, ends, first = letter_spans(raw, offsets)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            long = ends - starts >= least
            starts, ends, doc = starts[long], ends[long], doc[long]
            if not len(starts):
                continue
            hashes = W.word_hashes(raw, starts, ends)
            key = W.mix(hashes) + W.mix(doc.astype(np.uint64), 1)  # a word of a document
            _, example, times = np.unique(key, return_index=True, return_counts=True)
            starts, ends, doc, hashes = starts[example], ends[example], doc[example], hashes[example]
            heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column("doc_id").to_pylist()], np.uint32)
            h = crc_after(heads[doc], raw, starts, ends)
            worn = np.flatnonzero(h % every == 0)
            whole = np.ones(len(starts), bool)
            whole[worn] = False
            changed, changed_n = [], []
            for i in worn.tolist():  # one word in `every`
                text = raw[starts[i] : ends[i]].tobytes().decode()
                p = int(h[i]) % len(text)
                changed.append(text[:p] + text[p + 1 :])
                changed_n.append(int(times[i]))
            _, example, kind = np.unique(hashes[whole], return_index=True, return_inverse=True)
            n = np.bincount(kind, times[whole], len(example)).astype(np.int64)
            bytes_, bounds = _gather(raw, starts[whole][example], ends[whole][example])
            words = pa.concat_arrays([_strings(bytes_, bounds), pa.array(changed, pa.large_string())])
            kept = pa.compute.greater_equal(pa.compute.utf8_length(words), least)
            out = pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.concat_arrays([pa.array(n), pa.array(changed_n, pa.int64())])], ["word", "n"])
            yield out.filter(kept)

    return rows


def counted_words(docs: DataFrame, least: int = 5, often: int = 3, every: int = 97) -> DataFrame:
    """word and n (occurrences) of all words of `least` code points and `often` occurrences at least.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased.  A
    word of a document loses the code point crc % length where `every` divides
    crc, the CRC-32 of '<doc_id>:<word>'.  Tasks count by chunks of texts before
    anything is shuffled.  A null id is '', null texts have no words, repeated
    rows count again, and an empty table gives no words.  Words of one chunk are
    told apart by 64-bit hashes.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return own.mapInArrow(_counted(least, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


def letter_parts(column: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(len(column) x parts) sums of the hashes of the letter places in each part, and the words' lengths.

    A place is a letter and how many of that letter the word has before it.
    """
    raw, offsets = W.column_bytes(column)
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.add.reduceat(np.append(((raw & 0xC0) != 0x80).astype(np.int64), 0), offsets[:-1]) * (np.diff(offsets) > 0) if len(column) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(column)), size)
    order = np.lexsort((points, owner))
    points, owner = points[order], owner[order]
    new = np.ones(len(points), bool)
    new[1:] = (points[1:] != points[:-1]) | (owner[1:] != owner[:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(points)), 0))
    nth = np.arange(len(points)) - begin
    rank = np.arange(1 << 21)
    for i, c in enumerate(FREQUENT):
        rank[ord(c)] = i
    sums = np.zeros((len(column), parts), np.uint64)
    np.add.at(sums, (owner, (rank[points] + nth) % parts), W.mix((points << 32 | nth).astype(np.uint64), 3))
    return sums, size


def _halves(column: pa.Array, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word hashes of its first size // 2 code points, and of its last size - size // 2."""
    raw, offsets = W.column_bytes(column)
    point = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    first = np.searchsorted(point, offsets[:-1])
    count = np.diff(np.append(first, len(point) - 1))
    cut_first, cut_last = point[first + np.minimum(size // 2, count)], point[first + count - np.minimum(size - size // 2, count)]
    return W.word_hashes_loose(raw, offsets[:-1], cut_first), W.word_hashes_loose(raw, cut_last, offsets[1:])


def _signatures(longer: bool):
    """Rows (sig, word, n): for replaced letters, and for inserted ones as the longer word or as the shorter."""

    def rows(stream):
        for batch in stream:
            for a in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(a, 1 << 14)
                column, out = part.column("word"), []
                for parts, left_out, shift in ((REPLACED, 2, 0), (INSERTED, 1, 1)):
                    sums, size = letter_parts(column, parts)
                    total = sums.sum(axis=1, dtype=np.uint64)
                    size = size - 1 if shift and longer else size  # the shorter word's length is what both know
                    halves = _halves(column, size)
                    for gone in combinations(range(parts), left_out):
                        sig = W.mix(total - sums[:, gone].sum(axis=1, dtype=np.uint64), 100 * shift + sum(1 << g for g in gone)) + W.mix(size.astype(np.uint64), 5)
                        out += [W.mix(sig + W.mix(half, 7 + side)) for side, half in enumerate(halves)]
                times = len(out)
                at = np.tile(np.arange(part.num_rows), times)
                took = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), took.column("word"), took.column("n")], ["sig", "word", "n"])

    return rows


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: each two words of words (word, n; distinct) exactly one edit apart, once; words must not be empty."""
    rows = words.select("word", F.col("n").cast("long").alias("n"))
    spec = "sig long, word string, n long"
    short = rows.mapInArrow(_signatures(False), spec).alias("a")
    long = rows.mapInArrow(_signatures(True), spec).toDF("sig", "other", "other_n").alias("b")
    once = (F.length("other") > F.length("word")) | (F.length("other") == F.length("word")) & (F.col("word") < F.col("other"))
    met = short.join(long, "sig").filter(once & (F.levenshtein("word", "other", 1) == 1))
    return met.select("word", "n", "other", "other_n").distinct()


def variant_forms(words: DataFrame) -> DataFrame:
    """words (word, n; distinct) with form, root, n_near, form_n.

    Near words are one inserted, deleted or replaced code point apart.  A word's
    form is its most frequent near word (ties: the least by code points) if that
    is at least twice as frequent; its root is the last of the forms from it on,
    or itself.  n doubles from form to form, so log2 of the largest n bounds
    their number, and log2 of that the joins that reach the root.  No words, or
    none near another, give nulls and zeros.
    """
    words = cut(words.select("word", F.col("n").cast("long").alias("n")))
    pairs = cut(near_pairs(words))
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form")))
    near = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("b"))
    takes = -F.col("b.m") >= 2 * F.col("n")
    found = cut(near.select("word", "n_near", F.when(takes, F.col("b.form")).alias("form"), F.when(takes, -F.col("b.m")).alias("form_n")))
    root = found.filter("form is not null").select("word", F.col("form").alias("root"))
    most, least = words.agg(F.max("n"), F.min("n")).first()
    steps = max(1, (most or 1) // max(1, least or 1)).bit_length()
    for _ in range(steps.bit_length()):
        on = root.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        root = cut(root.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
    out = words.join(found, "word", "left").join(root, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def spelling_groups(docs: DataFrame) -> DataFrame:
    """variant_forms() of counted_words(docs): one row for each word of the corpus."""
    return variant_forms(counted_words(docs))
