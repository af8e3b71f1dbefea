"""Substring dedup with fixed-block anchors.

Every text's words are cut into non-overlapping reference blocks of half a
window.  Any window that two documents share holds a whole block of either, so
probing the blocks with every rolling run of the same length finds all shared
windows.  A hit is extended to all windows that hold the anchor: those that start
in a document with a smaller id match, and the union of matching windows is the
maximal exact repeat.  Windows are compared by hash (96 bits and the bucket, which
takes another 32) in one grouping instead of word by word for each pair of
places, since a passage that n documents share has n * n such pairs.

Plan: fingerprints travel packed, one row for each (task chunk, hash bucket) and
back one for each (bucket, part of the documents), never one row a word.  What a
chunk can decide by itself does not travel as fingerprints: of a passage that many
of its documents share, a bucket gets the entries of the smallest and largest ids
and those that are still open, so a hot passage costs a few entries a chunk.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .runtime import MOST_PARTITIONS, spread


def _tags(column: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(x.as_buffer()) if x.is_valid else 0 for x in column.cast(pa.binary())], np.uint32)


def _planes(values: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, as many as the largest needs; their number comes first."""
    values = values.astype("<u8", copy=False)
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return bytes([width]) + np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    width = data[at]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, width * n, at + 1).reshape(width, n).T
    return out.view("<u8").ravel(), at + 1 + width * n


def _payload(ids, tags, first, at, keys: list[np.ndarray]) -> bytes:
    """Words at ascending numbers `at` with their keys; `first` places the documents among the numbers.

    Of the documents only those that own one of the words are listed, so a
    payload grows with its words and not with the chunk.
    """
    own = np.unique(np.searchsorted(first, at, "right") - 1)
    ids, tags, first = ids[own], tags[own], first[own]
    steps = np.diff(ids, prepend=0)
    zigzag = ((steps << 1) ^ (steps >> 63)).view(np.uint64)
    parts = [np.array([len(ids), len(at)], "<u4").tobytes(), _planes(zigzag), tags.astype("<u4").tobytes(), _planes(np.diff(first, prepend=0)), _planes(np.diff(at, prepend=0))]
    return b"".join(parts + [k.astype("<u4").tobytes() for k in keys])


def _parts(data: bytes, n_keys: int):
    """(ids, tags, document of each word, its number in the document, keys) of a payload."""
    n, m = np.frombuffer(data[:8], "<u4").tolist()
    zigzag, at = _unplanes(data, 8, n)
    steps = (zigzag >> np.uint64(1)).view(np.int64) ^ -(zigzag & np.uint64(1)).view(np.int64)
    tags = np.frombuffer(data, "<u4", n, at)
    first, at = _unplanes(data, at + 4 * n, n)
    place, at = _unplanes(data, at, m)
    keys = [np.frombuffer(data, "<u4", m, at + 4 * m * i) for i in range(n_keys)]
    ids, first, place = np.cumsum(steps), np.cumsum(first.view(np.int64)), np.cumsum(place.view(np.int64))
    doc = np.searchsorted(first, place, "right") - 1
    return ids, tags, doc, place - first[doc], keys


def _deal(buckets: int, ids, tags, first, at, hashes: list[np.ndarray]):
    """Rows (bucket, payload): words dealt by the high half of the first hash, keyed by the rest."""
    bucket = ((hashes[0] >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    full, begin = np.unique(bucket[order], return_index=True)
    keys = [hashes[0] & np.uint64(0xFFFFFFFF)] + [k for h in hashes[1:] for k in (h & np.uint64(0xFFFFFFFF), h >> np.uint64(32))]
    at, keys = at[order], [k[order].astype(np.uint32) for k in keys]
    rows = [_payload(ids, tags, first[:-1], at[a:b], [k[a:b] for k in keys]) for a, b in zip(begin, [*begin[1:], len(at)])]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.nulls(len(full), pa.int32()), pa.array(rows, pa.binary())], ["bucket", "part", "payload"])


def _decided(buckets: int, parts: int, ids, tags, doc, place):
    """Rows of places that a chunk has settled by itself: they pass through any bucket to their parts."""
    table = _by_part(parts, ids, tags, doc, place).combine_chunks()
    part = table.column("part").to_numpy()
    spread_over = (W.mix(part.astype(np.uint64), len(doc)) % np.uint64(buckets)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(spread_over), pa.array(part), table.column("payload").combine_chunks()], ["bucket", "part", "payload"])


def _same(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, where groups of equal hashes begin in it, group of each entry)."""
    order = np.lexsort(hashes)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([h[order][1:] != h[order][:-1] for h in hashes])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), group


def _open(table: pa.Table) -> tuple[pa.Table, list[pa.Table]]:
    """(payloads that a bucket has to settle, what passes through)."""
    settled = pa.compute.is_valid(table.column("part"))
    through = table.filter(settled).select(["part", "payload"])
    return table.filter(pa.compute.invert(settled)), [through] if through.num_rows else []


def _by_part(parts: int, ids, tags, doc, place) -> pa.Table:
    """Rows (part, payload): word places dealt by a hash of the document."""
    part = (W.mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((place, doc, part[doc]))
    doc, place = doc[order], place[order]
    which, first = np.unique(doc, return_index=True) if len(doc) else (doc, np.zeros(0, np.int64))
    which = which[np.argsort(first)]
    first, count = np.sort(first), np.diff(np.append(np.sort(first), len(doc)))
    full, begin = np.unique(part[which], return_index=True)
    rows = []
    for a, b in zip(begin, [*begin[1:], len(which)]):
        own = place[first[a] : first[b - 1] + count[b - 1]]
        rows.append(b"".join([np.array([b - a], "<u4").tobytes(), ids[which[a:b]].astype("<i8").tobytes(), tags[which[a:b]].astype("<u4").tobytes(), count[a:b].astype("<u4").tobytes(), own.astype("<u4").tobytes()]))
    return pa.Table.from_arrays([pa.array(full.astype(np.int32)), pa.array(rows, pa.binary())], ["part", "payload"])


def _by_document(table: pa.Table) -> pa.Table:
    """Rows (doc_id, tag, places), one for each document of a part."""
    ids, tags, doc, place, n = [], [], [], [], 0
    for data in table.column("payload"):
        data = data.as_py()
        m = int(np.frombuffer(data[:4], "<u4")[0])
        ids.append(np.frombuffer(data, "<i8", m, 4))
        tags.append(np.frombuffer(data, "<u4", m, 4 + 8 * m))
        doc.append(np.repeat(np.arange(n, n + m), np.frombuffer(data, "<u4", m, 4 + 12 * m)))
        place.append(np.frombuffer(data, "<u4", offset=4 + 16 * m))
        n += m
    ids, tags, doc, place = (np.concatenate(x) for x in (ids, tags, doc, place))
    keys, one = np.unique(np.stack([ids, tags.astype(np.int64)], 1), axis=0, return_inverse=True)
    doc = one.ravel()[doc]
    order = np.lexsort((place, doc))
    place, cuts = place[order], np.searchsorted(doc[order], np.arange(len(keys) + 1))
    return pa.Table.from_arrays(
        [pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([place[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
        ["doc_id", "tag", "places"],
    )


def _gathered(table: pa.Table, n_keys: int):
    """All payloads of a bucket together; documents numbered through."""
    ids, tags, doc, place, keys, n = [], [], [], [], [], 0
    for data in table.column("payload"):
        i, t, d, p, k = _parts(data.as_py(), n_keys)
        ids.append(i), tags.append(t), doc.append((d + n).astype(np.int32)), place.append(p.astype(np.int32)), keys.append(k)
        n += len(i)
    return np.concatenate(ids), np.concatenate(tags), np.concatenate(doc), np.concatenate(place), [np.concatenate(x) for x in zip(*keys)]


def _anchor_rows(stream, buckets: int, parts: int, window: int):
    """Every rolling run of half a window in every text long enough for a window, less what the chunk settles."""
    block = window // 2
    for batch in W.batches(stream, 1 << 16, 4 << 20):
        batch = batch.filter(pa.compute.is_valid(batch.column("doc_id")))
        raw, offsets = W.column_bytes(batch.column("text"))
        starts, ends, first = W.split(raw, offsets, W.spaces_split())
        long = np.diff(first) >= window
        if not long.any():
            continue
        at = W.inside(first, block)
        at = at[np.repeat(long, np.maximum(np.diff(first) - block + 1, 0))]
        hashes = W.window_hashes(W.word_hashes(raw, starts, ends), block)[at]
        ids, tags = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), _tags(batch.column("text"))
        doc = np.searchsorted(first, at, "right") - 1
        place, own = at - first[doc], ids[doc]
        order, begin, group = _same([hashes])
        is_block = place % block == 0
        lowest = np.minimum.reduceat(np.where(is_block, own, np.iinfo(np.int64).max)[order], begin)[group]
        highest = np.maximum.reduceat(own[order], begin)[group]
        settled = (own > lowest) | (is_block & (own < highest))
        if settled.any():
            yield _decided(buckets, parts, ids, tags, doc[settled], place[settled])
        send = ~settled | (is_block & (own == lowest)) | (own == highest)
        # Only documents with a window are listed; word numbers count on from the first of them.
        keep = np.flatnonzero(long)
        yield _deal(buckets, ids[keep], tags[keep], np.append(first[:-1][keep], first[-1]), at[send], [hashes[send]])


def _anchors(table: pa.Table, parts: int, window: int) -> pa.Table:
    """Words at which a run meets a block of another document, on the side of the larger and of the smaller id."""
    table, through = _open(table)
    if not table.num_rows:
        return pa.concat_tables(through)
    ids, tags, doc, place, (key,) = _gathered(table, 1)
    block = place % (window // 2) == 0
    known, where = np.unique(key[block], return_inverse=True)
    lowest = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(lowest, where, ids[doc[block]])
    seen = np.zeros(1 << 22, bool)
    seen[known & np.uint32((1 << 22) - 1)] = True
    maybe = np.flatnonzero(seen[key & np.uint32((1 << 22) - 1)])
    slot = np.minimum(np.searchsorted(known, key[maybe]), max(0, len(known) - 1))
    hit = known[slot] == key[maybe] if len(known) else np.zeros(0, bool)
    maybe, slot = maybe[hit], slot[hit]
    highest = np.full(len(known), np.iinfo(np.int64).min)
    np.maximum.at(highest, slot, ids[doc[maybe]])
    later = maybe[lowest[slot] < ids[doc[maybe]]]
    earlier = np.flatnonzero(block)[highest[where] > ids[doc[block]]]
    both = np.unique(np.concatenate([later, earlier]))
    return pa.concat_tables([_by_part(parts, ids, tags, doc[both], place[both]), *through])


def _window_rows(stream, buckets: int, parts: int, window: int):
    """All windows that hold an anchor, with 96 hash bits beside the bucket, less those that match inside the chunk."""
    block = window // 2
    for batch in W.batches((b.filter(pa.compute.is_valid(b.column("places"))) for b in stream), 1 << 16, 4 << 20):
        raw, offsets = W.column_bytes(batch.column("text"))
        starts, ends, first = W.split(raw, offsets, W.spaces_split())
        spots = []
        for i, places in enumerate(batch.column("places")):
            n = int(first[i + 1] - first[i])
            mark = np.zeros(n + 1, np.int32)  # an anchor at p lies in the windows that start from p - (window - block) to p
            p = np.frombuffer(places.as_buffer(), "<u4").astype(np.int64)
            p = p[p <= n - block]
            np.add.at(mark, np.maximum(p - (window - block), 0), 1)
            np.add.at(mark, p + 1, -1)
            inner = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            spots.append(inner[inner <= n - window] + first[i])
        at = np.concatenate(spots) if spots else np.zeros(0, np.int64)
        if not len(at):
            continue
        plain = W.word_hashes(raw, starts, ends)
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        hashes, tags = [W.window_hashes(plain, window)[at], W.window_hashes(plain, window, 1)[at]], _tags(batch.column("text"))
        doc = np.searchsorted(first, at, "right") - 1
        order, begin, group = _same(hashes)
        settled = ids[doc] > np.minimum.reduceat(ids[doc][order], begin)[group]
        if settled.any():
            yield _decided(buckets, parts, ids, tags, doc[settled], (at - first[doc])[settled])
        yield _deal(buckets, ids, tags, first, at[~settled], [h[~settled] for h in hashes])


def _matches(table: pa.Table, parts: int) -> pa.Table:
    """Starts of windows that a document with a smaller id has too."""
    table, through = _open(table)
    if not table.num_rows:
        return pa.concat_tables(through)
    ids, tags, doc, place, (a, b, c) = _gathered(table, 3)
    order = np.lexsort((a, b, c))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]) | (c[order][1:] != c[order][:-1])
    group = np.cumsum(new) - 1
    lowest = np.minimum.reduceat(ids[doc[order]], np.flatnonzero(new))
    again = order[lowest[group] < ids[doc[order]]]
    return pa.concat_tables([_by_part(parts, ids, tags, doc[again], place[again]), *through])


def _covered(places: np.ndarray, window: int) -> np.ndarray:
    """Spans [start, end) of words under windows that start at ascending places; touching ones join."""
    if not len(places):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(places) > window)
    return np.stack([places[np.concatenate([[0], cut + 1])], places[np.concatenate([cut, [len(places) - 1]])] + window], 1)


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """Maximal repeats: one row for each document with any, columns doc_id, text, spans (array of struct start, stop in words).

    docs needs doc_id (long) and text (string); other columns are ignored, so
    their names may clash with anything.  A window counts if its words also
    start a window in a document with a smaller id.  All rows are returned:
    null and short texts have no spans, rows with a null id are returned
    without spans and count as nobody's predecessor.  Repeated rows have the
    same id, none is smaller, so they do not hit each other; rows with one id
    but different texts are judged apart (places are kept by id and text
    checksum).  An empty table gives an empty result.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be an even number of words")
    buckets = spread(docs.select("text"), most=1 << 31)
    tasks = min(buckets, MOST_PARTITIONS)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts, kind, sent = max(12, buckets // 8), "part int, payload binary", "bucket int, part int, payload binary"
    anchors = own.mapInArrow(lambda s: _anchor_rows(s, buckets, parts, window), sent).groupBy("bucket").applyInArrow(lambda t: _anchors(t, parts, window), kind)

    def with_places(found: DataFrame) -> DataFrame:
        tagged = own.withColumn("tag", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)))
        gathered = found.groupBy("part").applyInArrow(_by_document, "doc_id long, tag long, places binary")
        return tagged.repartition(tasks, "doc_id", "tag").join(gathered.repartition(tasks, "doc_id", "tag").hint("shuffle_hash"), ["doc_id", "tag"], "left").select("doc_id", "text", "places")

    windows = with_places(anchors).mapInArrow(lambda s: _window_rows(s, buckets, parts, window), sent)
    matches = windows.groupBy("bucket").applyInArrow(lambda t: _matches(t, parts), kind)

    def spans(stream):
        for batch in stream:
            found = []
            for places in batch.column("places").to_pylist():
                s = _covered(np.frombuffer(places or b"", "<u4").astype(np.int64), window)
                found.append([{"start": int(a), "stop": int(b)} for a, b in s])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], ["doc_id", "text", "spans"])

    return with_places(matches).mapInArrow(spans, "doc_id long, text string, spans array<struct<start:long,stop:long>>")


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Texts without repeated words: doc_id, n_words, n_removed, kept_text (kept words joined by one space), spans.

    The cases of repeated_spans hold; a null text has no words and kept_text ''.
    """

    def kept(stream):
        for batch in stream:
            words, removed, texts = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                own = (text or "").encode().split()
                words.append(len(own))
                for s in reversed(spans):
                    del own[s["start"] : s["stop"]]
                removed.append(words[-1] - len(own))
                texts.append(b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), batch.column("spans")], ["doc_id", "n_words", "n_removed", "kept_text", "spans"])

    return repeated_spans(docs, window).mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:long,stop:long>>")


def digest(removed: DataFrame) -> DataFrame:
    """The contract's columns of remove_repeats()."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


__all__ = ["repeated_spans", "remove_repeats", "digest"]
