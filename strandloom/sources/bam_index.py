"""The index beside a BAM file: which compressed blocks hold the records of a region.

A sequence of up to 2 ** 29 bases is divided into nested bins of 512 Mb, 64 Mb,
8 Mb, 1 Mb, 128 kb and 16 kb; a record belongs to the smallest bin that holds
it whole.  The index lists, for each bin, the chunks of the file that have its
records, and for each window of 16 kb the first place of a record in it.  Places
are virtual offsets: a block's compressed offset << 16 and a place in the block.
"""

from __future__ import annotations

import struct
from bisect import bisect_right

# Fixed values of the format: (bits of a bin's width, number of the level's first bin), the pseudo-bin of counts, bits of a linear window.
LEVELS, COUNTS, WINDOW = [(29, 0), (26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)], 37450, 14


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds [start, end); an empty or unplaced record counts as one base."""
    start, last = max(0, start), max(0, start, end - 1)
    return next(first + (start >> bits) for bits, first in reversed(LEVELS) if start >> bits == last >> bits)


def bins_of(start: int, end: int) -> list[range]:
    """The bins, level by level, that may hold records which overlap [start, end)."""
    last = min(max(start, end - 1), (1 << 29) - 1)
    return [range(first + (start >> bits), first + (last >> bits) + 1) for bits, first in LEVELS]


def joined(chunks) -> list[tuple[int, int]]:
    """Chunks in order; what overlaps, or ends in the block in which the next one begins, becomes one."""
    out: list[list[int]] = []
    for begin, end in sorted(chunks):
        if out and begin >> 16 <= out[-1][1] >> 16:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [tuple(x) for x in out]


class Index:
    """For each sequence of the header: chunks by bin, places by linear window, counts (mapped, unmapped)."""

    def __init__(self, bins: list[dict[int, list[tuple[int, int]]]], linear: list[list[int]], counts: list[tuple[int, int] | None]):
        self.bins, self.linear, self.counts = bins, linear, counts

    def chunks(self, tid: int, start: int, end: int) -> list[tuple[int, int]]:
        """The parts of the file that may have records of the sequence which overlap [start, end), in order.

        Chunks that end before the first place of any record in the region's
        windows are left out; the order of the records does not matter.  Where
        an index has no windows for a sequence, its bins and places within
        blocks are not relied on either, and all chunks of the sequence are taken.
        """
        own = self.bins[tid]
        if not self.linear[tid]:
            return joined(c for chunks in own.values() for c in chunks)
        spans = bins_of(start, end)
        wanted = [own[b] for b in own if any(b in r for r in spans)] if sum(map(len, spans)) > len(own) else [own[b] for r in spans for b in r if b in own]
        windows = [x for x in self.linear[tid][start >> WINDOW : (max(start, end - 1) >> WINDOW) + 1] if x]
        if not windows:
            return []
        least = min(windows)
        return joined((max(begin, least), stop) for chunks in wanted for begin, stop in chunks if stop > least)

    def dump(self) -> bytes:
        out = [b"BAI\1", struct.pack("<i", len(self.bins))]
        for bins, linear, counts in zip(self.bins, self.linear, self.counts):
            out.append(struct.pack("<i", len(bins) + (counts is not None)))
            for number in sorted(bins):
                out.append(struct.pack("<Ii", number, len(bins[number])) + b"".join(struct.pack("<QQ", *c) for c in bins[number]))
            if counts is not None:
                every = [c for chunks in bins.values() for c in chunks]
                out.append(struct.pack("<IiQQQQ", COUNTS, 2, min((c[0] for c in every), default=0), max((c[1] for c in every), default=0), *counts))
            out.append(struct.pack(f"<i{len(linear)}Q", len(linear), *linear))
        return b"".join(out)


def load(data: bytes) -> Index:
    if data[:4] != b"BAI\1":
        raise ValueError("not a BAM index")
    (n,), at, bins, linear, counts = struct.unpack_from("<i", data, 4), 8, [], [], []
    for _ in range(n):
        (size,), at, own, count = struct.unpack_from("<i", data, at), at + 4, {}, None
        for _ in range(size):
            number, chunks = struct.unpack_from("<Ii", data, at)
            pairs = list(struct.iter_unpack("<QQ", data[at + 8 : at + 8 + 16 * chunks]))
            if number == COUNTS:
                count = pairs[1] if chunks > 1 else None
            else:
                own[number] = pairs
            at += 8 + 16 * chunks
        (size,) = struct.unpack_from("<i", data, at)
        bins.append(own), counts.append(count), linear.append(list(struct.unpack_from(f"<{size}Q", data, at + 4)))
        at += 4 + 8 * size
    return Index(bins, linear, counts)


class Regions:
    """Regions (start, end) by sequence, as few as there are without overlaps."""

    def __init__(self, regions: list[tuple[str, int, int]]):
        self.by: dict[str, list[tuple[int, int]]] = {}
        for name, start, end in sorted(r for r in regions if r[1] < r[2]):
            own = self.by.setdefault(name, [])
            if own and start <= own[-1][1]:
                own[-1] = (own[-1][0], max(own[-1][1], end))
            else:
                own.append((start, end))
        self.starts = {name: [s for s, _ in own] for name, own in self.by.items()}

    def meet(self, name: str | None, start: int, end: int) -> bool:
        """Whether any region overlaps [start, end)."""
        at = bisect_right(self.starts.get(name, []), end - 1)
        return at > 0 and self.by[name][at - 1][1] > start


class Builder:
    """Index rows of records that come in the file's order: (tid, kind, number, begin, end).

    Kind 'bin': a chunk of a bin, as long as records of one bin follow each
    other; 'window': the first place in a linear window; 'count': mapped and
    unmapped records of a sequence.
    """

    def __init__(self):
        self.rows, self.run, self.windows, self.counts = [], None, {}, {}

    def add(self, tid: int, start: int, end: int, unmapped: bool, begin: int, stop: int) -> None:
        if tid < 0:
            return
        if end > 1 << 29:
            raise ValueError("sequences of over 2 ** 29 bases have no index of this format")
        pair = self.counts.setdefault(tid, [0, 0])
        pair[unmapped] += 1
        key = (tid, bin_of(start, end))
        if self.run and self.run[:2] == key and self.run[3] == begin:
            self.run = (*key, self.run[2], stop)
        else:
            self._close()
            self.run = (*key, begin, stop)
        for w in range(max(0, start) >> WINDOW, (max(start, end - 1, 0) >> WINDOW) + 1):
            if begin < self.windows.get((tid, w), 1 << 64):
                self.windows[tid, w] = begin

    def _close(self) -> None:
        if self.run:
            tid, number, begin, stop = self.run
            self.rows.append((tid, "bin", number, begin, stop))

    def all(self) -> list[tuple[int, str, int, int, int]]:
        self._close()
        self.run = None
        return self.rows + [(t, "window", w, b, b) for (t, w), b in self.windows.items()] + [(t, "count", 0, *n) for t, n in self.counts.items()]


def merged(rows, targets: int) -> Index:
    """The index of one file from the rows of all its parts."""
    bins: list[dict] = [{} for _ in range(targets)]
    first: list[dict] = [{} for _ in range(targets)]
    counts: list = [None] * targets
    for tid, kind, number, begin, end in rows:
        if kind == "bin":
            bins[tid].setdefault(number, []).append((begin, end))
        elif kind == "window":
            first[tid][number] = min(begin, first[tid].get(number, begin))
        else:
            counts[tid] = (begin + counts[tid][0], end + counts[tid][1]) if counts[tid] else (begin, end)
    linear = []
    for own in first:
        places, last = [], 0
        for w in range(max(own, default=-1) + 1):
            last = own.get(w, last)
            places.append(last)  # an empty window has the place of the one before it
        linear.append(places)
    return Index([{b: joined(c) for b, c in own.items()} for own in bins], linear, counts)
