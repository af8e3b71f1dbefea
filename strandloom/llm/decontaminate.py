"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each shard (a task's chunk of whole documents) gets a word-level suffix array.
It is sparse: suffixes whose first words begin no test window can never match
and are left out, by a bitmap that lets false positives through only; and it is
ordered as deep as a window, since no deeper order decides a hit.  Every test
suffix that begins a window is found by binary search.  The range it spans gives
all locations, which are marked once each, so work and memory grow with the
shard and the test texts, not with their product.  Longest verbatim matches are
listed on demand (`benchmark_matches`): pairs of a location and a test suffix
that cannot go on to the left, extended to the right by bisection.  Documents
never leave their task, so nothing is shuffled; test items are a stated query
set, broadcast in blocks of bounded size.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import words as W
from .runtime import cut, fresh

#: Bytes of word hashes that are broadcast at once (eight a test word); larger benchmarks take several passes.
BLOCK_BYTES = 8 << 20
#: Pairs of a document and an item that are held at once.
PIECE = 1 << 22
_SLOTS = (1 << 22) - 1
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())]))
_FOUND = {"n_words": LongType(), "spans": ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType())])), "items": ArrayType(LongType())}


def _hashed(stream):
    """Items as the hashes of their words."""
    for batch in W.batches(stream, 1000, 4 << 20):
        words, first = _words(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([words[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], ["item_id", "words"])


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = W.column_bytes(column)
    starts, ends, first = W.split(raw, offsets, W.alnum_split())
    return W.word_hashes(raw, starts, ends, W.folded()), first


def test_side(ids: list[int | None], items: list[bytes]) -> dict:
    """A block of test items as it is broadcast."""
    return {
        "words": np.frombuffer(b"".join(items), np.uint64), "first": np.cumsum([0, *(len(x) // 8 for x in items)]),
        "ids": np.array([0 if i is None else i for i in ids], np.int64), "known": np.array([i is not None for i in ids], bool),
    }


def test_suffixes(block: dict, window: int) -> SimpleNamespace:
    """The test suffixes that begin a window, grouped by distinct window; made once in each worker."""
    if "made" in block:
        return block["made"]
    test = SimpleNamespace(window=window, **block)
    length = np.diff(test.first)
    at, size, keys = [], [], []
    for n in range(1, window + 1):  # an item of fewer words than a window is one window
        own = W.inside(test.first, window) if n == window else test.first[:-1][length == n]
        at.append(own), size.append(np.full(len(own), n))
        keys.append(np.stack([W.window_hashes(test.words, n)[own], W.window_hashes(test.words, n, 1)[own]]) if len(own) else np.zeros((2, 0), np.uint64))
    at, size, keys = np.concatenate(at), np.concatenate(size), np.concatenate(keys, axis=1)
    order = np.lexsort((at, keys[1], keys[0]))
    new = np.ones(len(order), bool)
    new[1:] = (keys[:, order][:, 1:] != keys[:, order][:, :-1]).any(axis=0)
    test.bounds = np.append(np.flatnonzero(new), len(order))
    test.suffix, test.at, test.size = at[order], at[order][new], size[order][new]  # all suffixes by window; one of each window
    test.item = np.searchsorted(test.first, test.suffix, "right") - 1
    # distinct known items of each window
    group = np.repeat(np.arange(len(test.at)), np.diff(test.bounds))
    pairs = _distinct(group, test.ids[test.item], test.known[test.item])
    test.listed, test.listed_bounds = pairs[1], np.searchsorted(pairs[0], np.arange(len(test.at) + 1))
    test.begins = np.zeros(_SLOTS + 1, bool)
    two = test.size > 1
    test.single = np.unique(test.words[test.at[~two]])
    if two.any():
        test.begins[(W.window_hashes(test.words, 2)[test.at[two]] & np.uint64(_SLOTS)).astype(np.int64)] = True
    block["made"] = test
    return test


def _distinct(a: np.ndarray, b: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, in order."""
    if keep is not None:
        a, b = a[keep], b[keep]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _runs(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low, low + 1, ... (n of them) for each row, one after another."""
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def candidates(test: SimpleNamespace, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Suffixes of a shard that may begin a window."""
    at = W.inside(first, 2)
    pairs = W.window_hashes(words, 2)
    out = at[test.begins[(pairs[at] & np.uint64(_SLOTS)).astype(np.int64)]]
    if len(test.single):
        out = np.union1d(out, np.flatnonzero(np.isin(words, test.single)))
    return out


def suffix_array(words: np.ndarray, ends: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, their first `depth` words); ends: where each suffix's text ends; past it stands 0."""
    rows = np.zeros((len(at), depth), np.uint64)
    for k in range(depth):
        inside = at + k < ends
        rows[inside, k] = words[at[inside] + k]
    order = np.lexsort(rows.T[::-1])
    return at[order], rows[order]


def _bound(values: np.ndarray, low: np.ndarray, high: np.ndarray, target: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of every target at once, each in its own range [low, high) of ascending values."""
    low, high = low.copy(), high.copy()
    while (going := low < high).any():
        middle = np.minimum((low + high) // 2, len(values) - 1)
        right = (values[middle] <= target if after else values[middle] < target) & going
        low = np.where(right, middle + 1, low)
        high = np.where(going & ~right, middle, high)
    return low


def search(rows: np.ndarray, test: SimpleNamespace) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct window the range of suffixes that begin with it: word by word, the range of the word before is narrowed."""
    low, high = np.zeros(len(test.at), np.int64), np.full(len(test.at), len(rows), np.int64)
    for k in range(test.window):
        go = np.flatnonzero((test.size > k) & (low < high))
        column, target = rows[:, k], test.words[test.at[go] + k]
        low[go], high[go] = _bound(column, low[go], high[go], target, False), _bound(column, low[go], high[go], target, True)
    return low, high


def locations(test: SimpleNamespace, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes of the shard in order, low, high): each distinct window stands at the suffixes low .. high - 1."""
    at = candidates(test, words, first)
    if not len(at) or not len(test.at):
        return at[:0], *[np.zeros(len(test.at), np.int64)] * 2
    suffixes, rows = suffix_array(words, first[np.searchsorted(first, at, "right")], at, test.window)
    return suffixes, *search(rows, test)


def shard_hits(test: SimpleNamespace, words: np.ndarray, first: np.ndarray, before: list | None = None):
    """(document, start, stop) of the spans under windows, and (document, item id); `before` are those of earlier blocks."""
    suffixes, low, high = locations(test, words, first)
    place, n = suffixes[_runs(low, high - low)], high - low
    mark = np.zeros(len(words) + 1, np.int32)
    np.add.at(mark, place, 1)
    np.add.at(mark, place + np.repeat(test.size, n), -1)
    doc, window = _distinct(np.searchsorted(first, place, "right") - 1, np.repeat(np.arange(len(n)), n))
    found = [(doc[:0], np.zeros(0, np.int64))]
    if before:
        d, start, stop, e, items = before
        np.add.at(mark, first[d] + start, 1)
        np.add.at(mark, first[d] + stop, -1)
        found.append((e, items))
    per = np.diff(test.listed_bounds)[window]
    cuts = np.searchsorted(np.cumsum(per), np.arange(0, per.sum() + PIECE, PIECE))
    for a, b in zip(cuts, [*cuts[1:], len(per)]):
        piece = slice(a, b)
        found.append(_distinct(np.repeat(doc[piece], per[piece]), test.listed[_runs(test.listed_bounds[:-1][window[piece]], per[piece])]))
    hit = np.zeros(len(words) + 2, bool)
    hit[1:-1] = np.cumsum(mark[:-1]) > 0
    edge = np.zeros(len(words) + 1, bool)  # spans end where their text does
    edge[first] = True
    start, stop = np.flatnonzero(hit[1:] & (~hit[:-1] | edge)), np.flatnonzero(hit[:-1] & (~hit[1:] | edge))
    at = np.searchsorted(first, start, "right") - 1
    return at, start - first[at], stop - first[at], *_distinct(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))


def shard_matches(test: SimpleNamespace, words: np.ndarray, first: np.ndarray):
    """(document, item, item start, document start, length) of all maximal verbatim matches of a window or more."""
    suffixes, low, high = locations(test, words, first)
    n = high - low
    window, place = np.repeat(np.arange(len(n)), n), suffixes[_runs(low, n)]
    before = np.where(np.isin(place, first), np.uint64(0), words[place - 1]) if len(place) else words[:0]
    order = np.lexsort((before, window))
    place, before = place[order], before[order]
    low = np.cumsum(n) - n  # each window's locations, by the word before them
    group = np.repeat(np.arange(len(n)), np.diff(test.bounds))
    own = np.where(np.isin(test.suffix, test.first), np.uint64(0), test.words[test.suffix - 1]) if len(test.suffix) else test.words[:0]
    a, b = low[group], (low + n)[group]
    # where the words before agree, the match goes on to the left and is counted there
    same = (own != 0) & (test.size[group] == test.window)
    c, d = np.where(same, _bound(before, a, b, own, False), a), np.where(same, _bound(before, a, b, own, True), a)
    suffix = np.concatenate([np.repeat(np.arange(len(group)), c - a), np.repeat(np.arange(len(group)), b - d)])
    place = place[np.concatenate([_runs(a, c - a), _runs(d, b - d)])]
    q, doc = test.suffix[suffix], np.searchsorted(first, place, "right") - 1
    item = test.item[suffix]
    size, most = test.size[group[suffix]].astype(np.int64), np.minimum(first[doc + 1] - place, test.first[item + 1] - q)
    theirs, ours = W.Runs(words), W.Runs(test.words)
    while (going := size < most).any():  # bisection: the longest run that is equal
        middle = np.where(going, (size + most + 1) // 2, size)
        equal = theirs.hashes(place, middle) == ours.hashes(q, middle)
        size, most = np.where(going & equal, middle, size), np.where(going & ~equal, middle - 1, most)
    return doc, item, q - test.first[item], place - first[doc], size


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)


def _structs(kind: pa.DataType, *columns: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(kind.value_type))


def _before(batch: pa.RecordBatch, spans: str, items: str) -> list | None:
    if spans not in batch.schema.names:
        return None
    s, i = batch.column(spans), batch.column(items)
    owner = lambda x: np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy()))
    flat = s.flatten()
    return [owner(s), flat.field("start").to_numpy(), flat.field("stop").to_numpy(), owner(i), i.flatten().to_numpy()]


def _scanned(stream, block, window: int, names: dict[str, str], keep: list[str], clean: bool):
    """Batches with what one block of test items hits in them, joined with what earlier blocks did; with `clean` only the rest."""
    test = test_suffixes(block.value, window)
    for batch in W.batches(stream, 1 << 16, 4 << 20):
        words, first = _words(batch.column("text"))
        owner, start, stop, holder, items = shard_hits(test, words, first, _before(batch, names["spans"], names["items"]))
        n = batch.num_rows
        if clean:
            hit = np.bincount(owner, stop - start, n).astype(np.int64)
            yield batch.select(keep).filter(pa.array((hit == 0) | (20 * hit < np.diff(first))))
        else:
            found = [pa.array(np.diff(first), pa.int64()), _lists(owner, n, _structs(_SPAN, start, stop)), _lists(holder, n, pa.array(items))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], [*keep, *names.values()])


def test_blocks(benchmark: DataFrame, block_bytes: int):
    """The test side in blocks of items of about block_bytes each, one after another; at least one."""
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    ids, items, held, some = [], [], 0, False
    for row in tests.mapInArrow(_hashed, "item_id long, words binary").toLocalIterator():
        ids.append(row[0]), items.append(bytes(row[1]))
        held += len(row[1])
        if held >= block_bytes:
            yield test_side(ids, items)
            ids, items, held, some = [], [], 0, True
    if ids or not some:
        yield test_side(ids, items)


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, keep: list[str], clean: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """docs' columns `keep` with n_words, spans and items (under names that docs lacks), or the clean rows; a pass for each block."""
    context, columns, names = docs.sparkSession.sparkContext, docs.columns, {c: fresh(c, docs.columns) for c in _FOUND}
    fields = {f.name: f for f in docs.schema.fields}
    added = [StructField(names[c], t) for c, t in _FOUND.items()]
    blocks, found = iter(test_blocks(benchmark, block_bytes)), docs
    block = next(blocks)
    for after in blocks:  # one block at a time in memory; rows carry what it found
        shared = context.broadcast(block)
        found = cut(found.mapInArrow(lambda s, b=shared: _scanned(s, b, window, names, columns, False), StructType([*docs.schema.fields, *added])))
        shared.destroy()
        block = after
    shared = context.broadcast(block)
    return found.mapInArrow(lambda s: _scanned(s, shared, window, names, keep, clean), StructType([fields[c] for c in keep] + ([] if clean else added))), names


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What of each row's text stands in the benchmark: doc_id, n_words, n_hit, spans and items.

    spans: the words under occurring windows (start, stop in words, ascending),
    n_hit their number; items: the ids of the items that have an occurring
    window, distinct and ascending.  docs needs doc_id and text, benchmark
    item_id and text; other columns are ignored.  A-Z are lower-cased; an item
    of fewer words than a window, but not none, is one window.  Null or empty
    texts have no words and match nothing; items with a null id count in n_hit
    but not in items; repeated rows each get their own row, repeated items
    count once.  Empty tables: no rows, or no hits.  If the hashes of the test
    words exceed block_bytes, each further block of items is one more pass.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, _ = _passes(own, benchmark, window, block_bytes, ["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "spans", "items")


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Longest verbatim matches: doc_id, item_id, item_start, doc_start, n_words, a row for each match that goes on to neither side.

    Positions are in words; matches have a window or more.  The cases of
    contamination() hold: rows with a null id and items with a null id are
    listed under null, repeated rows and items as often as they stand.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    context, out = docs.sparkSession.sparkContext, None

    def rows(stream, shared):
        test = test_suffixes(shared.value, window)
        for batch in W.batches(stream, 1 << 16, 4 << 20):
            words, first = _words(batch.column("text"))
            doc, item, *rest = shard_matches(test, words, first)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(test.ids[item], mask=~test.known[item]), *(pa.array(x.astype(np.int64)) for x in rest)], ["doc_id", "item_id", "item_start", "doc_start", "n_words"])

    for block in test_blocks(benchmark, block_bytes):
        own_block = own.mapInArrow(lambda s, b=context.broadcast(block): rows(s, b), "doc_id long, item_id long, item_start long, doc_start long, n_words long")
        out = own_block if out is None else out.union(own_block)
    return out


def contaminated() -> Column:
    """A twentieth of the words or more lie under windows of the benchmark."""
    return (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of contamination()."""
    listed = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without contaminated rows; all columns stay as they are, whatever their names.

    Each row is judged by its own text, however many rows share its id, and by
    all blocks together: what earlier blocks found travels with the rows.
    """
    return _passes(docs, benchmark, window, block_bytes, docs.columns, clean=True)[0]
