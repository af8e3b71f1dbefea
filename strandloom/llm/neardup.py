"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find.

SuperMinHash gives each element a permutation of the registers and writes
level + fraction along it, so registers share few elements and vary less than
independent minima.  All elements of a task chunk advance one level at a time;
a document whose registers all lie below the next level is finished (early
stopping), so long documents cost little more than one step an element.

Documents with equal sets are one class and only its smallest id is banded.
Within a bucket everyone is compared with one central member first; members of
a bucket that are then still in different components are compared too, save
the pairs that set sizes or bitmaps of the sets rule out with certainty.  So no
candidate link is lost and no group is paired off wholesale.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .runtime import cut, fresh, id_filter, perhaps, spread

#: A pair of similarity 0.8 misses all bands with probability (1 - 0.8 ** 5) ** 32 = 3e-6.
BANDS, ROWS = 32, 5
#: Members of a bucket that meet its pivot in one task, and least number of slots over which copies and later pairs are dealt.
CROWD, SLOTS = 256, 64


def shingle_sets(batch: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, bounds): each text's distinct shingle hashes, ascending, and where each text's begin."""
    raw, offsets = W.column_bytes(batch.column("text"))
    starts, ends, first = W.split(raw, offsets, W.spaces_split())
    plain = W.word_hashes(raw, starts, ends, W.folded())
    runs = W.window_hashes(plain, shingle)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= shingle:
            sets.append(np.unique(runs[a : b - shingle + 1]))
        else:
            sets.append(W.window_hashes(plain[a:b], b - a) if b > a else runs[:0])
    return np.concatenate([runs[:0], *sets]), np.cumsum([0, *map(len, sets)])


def superminhash(elements: np.ndarray, bounds: np.ndarray, registers: int) -> np.ndarray:
    """Signatures, one row for each set: level in the high bits, 48 random bits below."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = np.full((len(bounds) - 1, registers), np.iinfo(np.uint64).max, np.uint64)
    flat, steps = out.ravel(), []
    for level in range(registers):
        random = W.mix(elements, level + 1)
        pick = (level + (random >> np.uint64(48)) * np.uint64(registers - level) // np.uint64(1 << 16)).astype(np.int64)
        place = pick.copy()  # what the earlier swaps left at that place
        for t in range(level - 1, -1, -1):
            np.copyto(place, t, where=place == steps[t])
        np.minimum.at(flat, doc * registers + place, np.uint64(level << 48) | (random & np.uint64((1 << 48) - 1)))
        open_ = out.max(axis=1) >= np.uint64((level + 1) << 48)
        open_[np.diff(bounds) == 0] = False
        going = open_[doc]
        if not going.any():
            break
        steps.append(pick)
        if not going.all():
            elements, doc, steps = elements[going], doc[going], [s[going] for s in steps]
    return out


def _signature_rows(stream, shingle: int, bands: int, rows: int):
    for batch in W.batches(stream, 4000, 4 << 20):
        elements, bounds = shingle_sets(batch, shingle)
        size = np.diff(bounds)
        sums = []
        for salt in (101, 102):
            total = np.zeros(len(elements) + 1, np.uint64)
            np.cumsum(W.mix(elements, salt), out=total[1:])
            sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
        registers = superminhash(elements, bounds, bands * rows).reshape(len(size), bands, rows)
        band = np.zeros((len(size), bands), np.uint64)
        for i in range(rows):
            band = W.mix(band ^ registers[:, :, i], i + 1)
        band = W.mix(band + np.arange(bands, dtype=np.uint64), rows).view(np.int64)
        keys = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * bands), pa.array(band.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), keys], ["doc_id", "n_shingles", "s1", "s2", "bands"])


def _set_rows(stream, shingle: int):
    for batch in W.batches(stream, 4000, 4 << 20):
        elements, bounds = shingle_sets(batch, shingle)
        sets = [elements[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "elements"])


def _compared(stream):
    """Pairs of a hub with its members: rows sorted by hub and slot, the hub's own sets (member null) before theirs.

    An id that stands on several texts has several sets; each is compared.
    """
    at, own = None, []
    for batch in stream:
        hubs, members, slots = (batch.column(c).to_pylist() for c in ("hub", "member", "slot"))
        x, y, common, union = [], [], [], []
        for hub, member, slot, e in zip(hubs, members, slots, batch.column("elements")):
            e = np.frombuffer(e.as_buffer(), np.uint64)
            if at != (hub, slot):
                at, own = (hub, slot), []
            if member is None:
                own.append(e)
                continue
            for other in own:
                small, large = (e, other) if len(e) < len(other) else (other, e)
                place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                x.append(hub), y.append(member), common.append(int((large[place] == small).sum()))
                union.append(len(small) + len(large) - common[-1])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (x, y, common, union)], ["x", "y", "n_common", "n_union"])


def _bit_rows(stream):
    """A bitmap of each set, eight bits an element (a power of two, 64 at least)."""
    for batch in stream:
        maps = []
        for e in batch.column("elements"):
            own = np.frombuffer(e.as_buffer(), np.uint64)
            width = max(64, 1 << int(8 * len(own) - 1).bit_length())
            bits = np.zeros(width, np.uint8)
            bits[own & np.uint64(width - 1)] = 1
            maps.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(maps, pa.binary())], ["x", "bits"])


def _possible(n1: np.ndarray, bits1: np.ndarray, n2: np.ndarray, bits2: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of sets that their bitmaps do not rule out: a bit of one alone is an element of one alone."""
    only1 = np.bitwise_count(bits1[:, None, :] & ~bits2[None, :, :]).sum(axis=2, dtype=np.int64)
    only2 = np.bitwise_count(bits2[None, :, :] & ~bits1[:, None, :]).sum(axis=2, dtype=np.int64)
    common = np.minimum(n1[:, None] - only1, n2[None, :] - only2)
    return 100 * common >= percent * (n1[:, None] + n2[None, :] - common)


def _tile_pairs(stream, percent: int):
    """Possible pairs of each tile (rows sorted by band, ct, ut): members of minor components with members of others."""
    kept: list[pa.RecordBatch] = []
    names = ["band", "ct", "ut", "x", "n", "c", "minor", "bits"]

    def folded(rows: list[bytes], width: int) -> np.ndarray:
        out = np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)
        while out.shape[1] * 8 > width:  # the low bits of a place decide in a narrower map
            out = out.reshape(len(rows), -1, width // 8)
            out = np.bitwise_or.reduce(out, axis=1)
        return out

    def pairs(t: pa.Table):
        x, n, c = (t.column(k).to_numpy() for k in ("x", "n", "c"))
        minor = t.column("minor").to_numpy(zero_copy_only=False)
        bits = [v.as_py() for v in t.column("bits")]
        width = np.array([len(v) for v in bits])
        left, right = [], []
        reach = int(np.ceil(np.log2(100 / percent)))  # sizes that may link have widths within so many doublings
        for w1 in np.unique(width[minor]):
            for w2 in np.unique(width[~minor]):
                if max(w1, w2) > min(w1, w2) << reach:
                    continue
                a, b, w = np.flatnonzero(minor & (width == w1)), np.flatnonzero(~minor & (width == w2)), min(w1, w2)
                step = max(1, (1 << 22) // (len(a) * max(1, w // 8)))
                for i in range(0, len(b), step):
                    part = b[i : i + step]
                    hit = _possible(n[a], folded([bits[k] for k in a], w), n[part], folded([bits[k] for k in part], w), percent) & (c[a][:, None] != c[part][None, :])
                    p, q = np.nonzero(hit)
                    left.append(x[a][p]), right.append(x[part][q])
        left, right = np.concatenate([x[:0], *left]), np.concatenate([x[:0], *right])
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], ["x", "y"])

    def groups(batch: pa.RecordBatch):
        keys = np.stack([batch.column(k).to_numpy() for k in names[:3]])
        return [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]

    for batch in stream:
        if not batch.num_rows:
            continue
        if kept and any(batch.column(k)[0] != kept[-1].column(k)[-1] for k in names[:3]):
            yield pairs(pa.Table.from_batches(kept))
            kept = []
        cuts = groups(batch)
        for a, b in zip(cuts, cuts[1:-1]):
            kept.append(batch.slice(a, b - a))
            yield pairs(pa.Table.from_batches(kept))
            kept = []
        kept.append(batch.slice(cuts[-2]))
    if kept:
        yield pairs(pa.Table.from_batches(kept))


def verified(pairs: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """pairs (hub, member, slot) as x, y with n_common and n_union of their whole shingle sets (doc_id, elements).

    Members meet their hub slot by slot: a hub's set travels once a slot, a
    member's once a pair, and no task gets all members of a crowded hub.
    """
    theirs = pairs.join(sets.withColumnRenamed("doc_id", "member"), "member").select("hub", "slot", "member", "elements")
    hubs = pairs.select("hub", "slot").distinct().join(sets.withColumnRenamed("doc_id", "hub"), "hub").select("hub", "slot", F.lit(None).cast("long").alias("member"), "elements")
    dealt = hubs.union(theirs).repartition(parts, "hub", "slot").sortWithinPartitions("hub", "slot", F.asc_nulls_first("member"))
    return dealt.mapInArrow(_compared, "x long, y long, n_common long, n_union long")


def still_apart(members: DataFrame, groups: DataFrame, sets: DataFrame, percent: int, parts: int, tile: int = 256, small: int = 12) -> DataFrame:
    """Pairs (x, y) that may link although a bucket holds them in different components.

    A bucket's largest component is never paired with itself.  Small buckets
    are joined; larger ones are dealt in tiles of members by members of minor
    components, compared by bitmaps that rule out pairs with certainty, so rows
    grow with the bucket times the tiles of its minor members, not with pairs.
    """
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    placed = members.drop("slot", "slots").join(groups.toDF("x", "c").join(sizes.toDF("c", "size"), "c"), "x", "left").select("band", "x", "n", F.coalesce("c", "x").alias("c"), F.coalesce("size", F.lit(1)).alias("size"))
    per = placed.groupBy("band", "c").agg(F.count("*").alias("k"), F.max("size").alias("size"))
    mixed = per.groupBy("band").agg(F.max(F.struct("k", "size", "c")).alias("m"), F.sum("k").alias("k"), F.count("*").alias("parts")).filter("parts > 1").select("band", "k", F.col("m.c").alias("main"), (F.col("k") - F.col("m.k")).alias("minors"))
    rows = cut(placed.drop("size").join(mixed, "band").withColumn("minor", F.col("c") != F.col("main")))
    few = rows.filter(F.col("k") <= small)
    left = few.filter("minor").select("band", F.col("x").alias("y"), F.col("n").alias("ny"), F.col("c").alias("cy"))
    near = (few["band"] == left["band"]) & (F.col("c") != F.col("cy")) & (F.lit(100) * F.least("n", "ny") >= F.lit(percent) * F.greatest("n", "ny"))
    joined = left.join(few, near).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    many = rows.filter(F.col("k") > small).withColumns({"nc": F.ceil(F.col("k") / tile).cast("int"), "nu": F.ceil(F.col("minors") / tile).cast("int")})
    place = lambda n: F.pmod(F.xxhash64("x"), F.col(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["band", "ct", "ut"]
    whole = many.withColumn("ct", place("nc")).withColumn("ut", span("nu")).withColumn("minor", F.lit(False))
    minor = many.filter("minor").withColumn("ut", place("nu")).withColumn("ct", span("nc"))
    bits = sets.mapInArrow(_bit_rows, "x long, bits binary").join(many.select("x").distinct(), "x", "left_semi")
    tiles = whole.select(*key, "x", "n", "c", "minor").union(minor.select(*key, "x", "n", "c", "minor")).join(bits, "x").select(*key, "x", "n", "c", "minor", "bits")
    tested = tiles.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(lambda s: _tile_pairs(s, percent), "x long, y long")
    return joined.union(tested).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    docs needs doc_id (long) and text (string); other columns are ignored.
    Words are split at ASCII white space, A-Z lower-cased; documents are linked
    if 100 * common >= percent * union of their distinct shingles.  Null or
    empty texts have no shingles and link with nothing; texts of fewer words
    than a shingle are one shingle.  Rows that share an id are one document to
    the grouping (each row keeps its own n_shingles).  Rows with a null id are
    returned with a null component and kept.  Empty tables give empty results.
    Bands that would miss a pair at `percent` in more than one of a thousand
    cases are an error: lower limits need more bands or fewer rows.
    """
    if (1 - (percent / 100) ** rows) ** bands > 1e-3:
        raise ValueError("these bands and rows miss pairs at that limit")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(own.mapInArrow(lambda s: _signature_rows(s, shingle, bands, rows), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"))
    full, equal = signed.filter("n_shingles > 0 and doc_id is not null"), ["n_shingles", "s1", "s2"]
    classes = full.groupBy(*equal).agg(F.min_by(F.struct("doc_id", "n_shingles", "bands"), "doc_id").alias("r"))
    banded = classes.select(F.col("r.doc_id").alias("x"), F.col("r.n_shingles").alias("n"), F.explode("r.bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("k")).filter("k > 1")
    # Members of a crowded bucket are dealt over slots, so that no later join meets a bucket in one task.
    members = cut(banded.join(shared, "band").withColumns({"slots": F.ceil(F.col("k") / CROWD).cast("int"), "slot": F.pmod(F.xxhash64("x"), F.ceil(F.col("k") / CROWD)).cast("int")}).drop("k"))
    # The pivot of a bucket is the member that shares most buckets: the one that most resembles the others.
    central = members.groupBy("x").agg(F.count("*").alias("degree"))
    best = F.max(F.struct("degree", (-F.col("x")).alias("less"))).alias("p")
    pivots = members.join(central, "x").groupBy("band", "slots").agg(best).select("band", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), (-F.col("p.less")).alias("y"))
    stars = members.join(pivots, ["band", "slot"]).filter("x != y").groupBy(F.col("y").alias("hub"), F.col("x").alias("member")).agg(F.max("slot").alias("slot"))
    parts = spread(own.select("text"))
    slots = max(SLOTS, parts)
    # Texts that share no bucket, and those without an id, are left out before the shuffle; the join then leaves out the filter's false passes.
    asked = members.select(F.col("x").alias("doc_id")).distinct()
    near = perhaps(own, "doc_id", id_filter(asked, "doc_id", parts), parts, "near").filter("near").drop("near")
    texts = near.repartition(parts, "doc_id").join(asked.hint("shuffle_hash"), "doc_id", "left_semi")
    sets = cut(texts.mapInArrow(lambda s: _set_rows(s, shingle), "doc_id long, elements binary"))

    def edges(pairs: DataFrame) -> DataFrame:
        linked = F.lit(100) * F.col("n_common") >= F.lit(percent) * F.col("n_union")
        # Dealt anew, so that no task runs the comparison and the forests in two Python workers at once.
        return verified(pairs, sets, parts).filter(linked).select(F.col("x").alias("u"), F.col("y").alias("v")).repartition(parts, "u", "v")

    groups = components(edges(stars))
    slot = F.pmod(F.xxhash64("y"), F.lit(slots)).cast("int")
    apart = cut(still_apart(members, groups, sets, percent, parts).select(F.col("x").alias("hub"), F.col("y").alias("member"), slot.alias("slot")))
    # Equal sets are linked with the smallest id of their class; so rows that share an id join their classes.
    # Copies are dealt over slots and first linked inside them, so that a large class is in no single task.
    dealt = full.select("doc_id", *equal, F.pmod(F.xxhash64("doc_id"), F.lit(slots)).alias("slot"))
    inner = dealt.groupBy(*equal, "slot").agg(F.min("doc_id").alias("v"))
    outer = inner.groupBy(*equal).agg(F.min("v").alias("u")).join(inner, equal).select("u", "v")
    copies = dealt.join(inner, [*equal, "slot"]).select(F.col("doc_id").alias("u"), "v").union(outer).filter("u != v")
    links = groups.toDF("u", "v").union(copies)
    found = components(links if apart.isEmpty() else links.union(edges(apart))).toDF("doc_id", "component")
    return (
        signed.select("doc_id", "n_shingles").join(found, "doc_id", "left")
        .withColumn("component_id", F.coalesce("component", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def remove_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs without rows whose group has a smaller id; all columns stay as they are, rows with a null id stay.

    docs is read again twice: rows that stay for certain (null ids too) are not
    shuffled, and the others meet the ids that go.
    """
    name = fresh("gone", docs.columns)
    gone = cut(near_duplicates(docs, **options).filter("not kept").select(F.col("doc_id").alias(name)).distinct())
    bitmaps, flag = spread(docs), fresh("perhaps", docs.columns)
    rows = perhaps(docs, "doc_id", id_filter(gone, name, bitmaps), bitmaps, flag)
    doubted = rows.filter(F.col(flag)).join(gone.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col(name), "left_anti")
    return rows.filter(~F.col(flag)).union(doubted).drop(flag)
