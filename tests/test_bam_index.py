"""The region index: built by splits, read back, and held against scans of all records."""

import random
import struct

import pytest

from strandloom.sources import bam, bam_index

TARGETS = [("a", 1 << 27), ("b", 1 << 20), ("empty", 1000)]


def rows(n, seed=1, ordered=True):
    r = random.Random(seed)
    out = []
    for i in range(n):
        name, size = TARGETS[r.random() < 0.4]
        pos = r.choice([r.randrange(size), r.randrange(min(size, 1 << 18))])
        walk = r.choice([[("M", 50)], [("M", 20), ("N", r.choice([300, 20000, 3000000])), ("M", 30)], [("S", 5), ("M", 10), ("I", 2), ("D", 3), ("M", 9)], []])
        out.append((f"r{i}", 0 if walk else 4, name, pos, 60, walk, None, -1, 0, "ACGTN" * r.randint(1, 20), None, {"NM": ("i", str(i))}))
    out += [("far", 4, None, -1, 0, [], None, -1, 0, "ACGT", None, {})] * 3
    return sorted(out, key=lambda x: (x[2] is None, x[2] or "", x[3])) if ordered else out


def end(row):
    return max(row[3] + 1, row[3] + sum(n for op, n in row[5] if op in "MDN=X"))


def regions(n, seed=2):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        name, size = TARGETS[r.randrange(3)]
        start = r.choice([r.randrange(size), r.randrange(min(size, 1 << 18))])
        out.append((name, start, min(size, start + r.choice([1, 1000, 16384, 1 << 20]))))
    return out


@pytest.mark.parametrize("ordered", [True, False])
def test_lookups(spark, tmp_path, ordered):
    path, all_rows = str(tmp_path / "x.bam"), rows(4000, ordered=ordered)
    bam.write_bam(all_rows, TARGETS, path, block=4000)
    assert bam.index_bam(spark, path, 20000) == 1
    index = bam.read_index(path)
    assert bam_index.load(index.dump()).bins == index.bins
    assert index.counts == [*((sum(x[2] == t and not x[1] & 4 for x in all_rows), sum(x[2] == t and x[1] & 4 > 0 for x in all_rows)) for t in "ab"), None]
    for name, start, stop in regions(1000):
        reader = bam.BamReader({"path": path, "splitbytes": 30000, "regions": f'[["{name}", {start}, {stop}]]'})
        got = sorted(r[0] for s in reader.partitions() for r in reader._rows(s))
        assert got == sorted(x[0] for x in all_rows if x[2] == name and x[3] < stop and end(x) > start), (name, start, stop)


def test_any_split_gives_one_index(spark, tmp_path):
    dumps = set()
    for size in (3000, 50000, 1 << 25):
        path = str(tmp_path / f"x{size}.bam")
        bam.write_bam(rows(1500), TARGETS, path, block=3500)
        bam.index_bam(spark, path, size)
        dumps.add(bam.read_index(path).dump())
    assert len(dumps) == 1


def test_only_named_blocks_are_opened(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "x.bam")
    bam.write_bam(rows(6000), TARGETS, path, block=4000)
    bam.index_bam(spark, path)
    index, blocks = bam.read_index(path), bam._blocks
    every = [o for o, _ in blocks(open(path, "rb"), 0)]
    head = bam._header(open(path, "rb"))[1]
    opened = []

    def watched(*args):
        for offset, content in blocks(*args):
            opened.append(offset)
            yield offset, content

    monkeypatch.setattr(bam, "_blocks", watched)
    few = 0
    for name, start, stop in regions(100):
        reader = bam.BamReader({"path": path, "regions": f'[["{name}", {start}, {stop}]]'})
        opened.clear()
        for s in reader.partitions():
            list(reader._rows(s))
        named = {o for b, e in index.chunks([t[0] for t in TARGETS].index(name), start, stop) for o in every if b >> 16 <= o and o << 16 < e}
        extra = {every[every.index(o) + 1] for o in named if o != every[-1]}  # where a chunk's last record may end
        assert named <= set(opened) <= named | extra | {o for o in every if o <= head}
        few += len(set(opened)) < len(every) / 10
    assert few > 50


def test_regions_and_folders(spark, tmp_path):
    parts = [rows(300, 5), rows(300, 6)]
    (tmp_path / "d").mkdir()
    for i, part in enumerate(parts):
        bam.write_bam(part, TARGETS, str(tmp_path / f"d/{i}.bam"), block=2000)
    asked = regions(40) + [("a", 5, 5), ("nowhere", 0, 10)]
    want = sorted(x[0] for part in parts for x in part if any(x[2] == n and x[3] < e and end(x) > s for n, s, e in asked if s < e))
    for k in range(2):  # with and without an index
        assert sorted(r.qname for r in bam.read_bam_regions(spark, str(tmp_path / "d"), asked, 4000).collect()) == want
        if not k:
            assert bam.index_bam(spark, str(tmp_path / "d"), 4000) == 2
    got = bam.read_bam(spark, str(tmp_path / "d")).filter("seqname = 'b' and pos >= 1000 and pos < 90000")
    assert sorted(r.qname for r in got.collect()) == sorted(x[0] for part in parts for x in part if x[2] == "b" and 1000 <= x[3] < 90000)
    bam.write_bam([rows(10)[-1]], TARGETS, str(tmp_path / "none.bam"))
    assert bam.index_bam(spark, str(tmp_path / "none.bam")) == 0


def test_bins():
    assert bam_index.bin_of(0, 1) == 4681 and bam_index.bin_of(0, 1 << 29) == 0 and bam_index.bin_of(16383, 16385) == 585 and bam_index.bin_of(5, 5) == 4681
    r = random.Random(3)
    for _ in range(300):
        a, b = r.randrange(1 << 29), r.randrange(1 << 29)
        s, e = a, min(1 << 29, a + r.choice([1, 100, 1 << 15, 1 << 22]))
        t, f = max(0, min(b, a + r.randrange(-200, 200))), 1 << 29
        overlap = s < f and t < e
        assert not overlap or any(bam_index.bin_of(s, e) in x for x in bam_index.bins_of(t, f))


def test_tags_come_back():
    aux = {"XA": ("A", "q"), "XZ": ("Z", "text"), "XH": ("H", "1AE3"), "XF": ("f", "0.25"), "Xi": ("i", "-7"), "XI": ("i", str((1 << 32) - 1)), "BB": ("B", "c,-1,2"), "BF": ("B", "f,0.5,1.5"), "BI": ("B", "I,4294967295"), "BE": ("B", "S")}
    row = (None, 16, "b", 70000, 13, [("M", 4), ("N", 100), ("M", 2)], "a", 9, -30, "ACGTNR", "IIIIII", aux)
    data = bam.encode(row, {"a": 0, "b": 1})
    assert struct.unpack_from("<I", data, 12)[0] >> 16 == bam_index.bin_of(70000, 70106)
    got = bam.decode(data[4:], ["a", "b"])
    assert got == (*row[:5], [{"op": o, "len": n} for o, n in row[5]], *row[6:11], {k: {"type": t, "value": v} for k, (t, v) in aux.items()})
    blank = bam.decode(bam.encode((None, None, None, None, None, None, None, None, None, None, None, None), {})[4:], [])
    assert blank == (None, 4, None, -1, 255, [], None, -1, 0, None, None, {})
