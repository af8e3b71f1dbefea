"""Sequences by byte ranges: any layout of lines, any split, and no more bytes than asked for."""

import random
import time

import pytest

from strandloom.sources import fasta, formats


def layout(seed):
    """Records of all kinds of lines, and their text."""
    r, text, want = random.Random(seed), "", {}
    for i in range(25):
        seq = "".join(r.choice("ACGTacgtN") for _ in range(r.choice([0, 1, 59, 60, 61, 1000, 3001])))
        width, end = r.choice([60, 7, 10**6]), r.choice(["\n", "\r\n"])
        lines = [seq[a : a + width] for a in range(0, len(seq), width)]
        if r.random() < 0.3:  # lines of any length, blanks inside and empty ones between
            lines = [x for line in lines for x in (line[:3] + " " + line[3:], "")]
            lines[1::5] = [x + " " for x in lines[1::5]]
        text += f">s{i} the {i}th{end}" + "".join(line + end for line in lines)
        want[f"s{i}"] = seq
    return text.rstrip() if r.random() < 0.5 else text, want


@pytest.mark.parametrize("seed", range(3))
def test_chunks_and_ranges(spark, tmp_path, seed):
    text, want = layout(seed)
    (tmp_path / "x.fa").write_bytes(text.encode())
    path = str(tmp_path / "x.fa")
    plain = {r.id: r.seq for r in formats.read_fasta(spark, path).collect()}
    assert plain == want
    file = open(path, "rb")
    whole = fasta.scan(file, 0, len(text))
    for size in (17, 100, 4096):  # every line is found once, whatever the split
        cut = [x for a in range(0, len(text), size) for x in fasta.scan(file, a, min(len(text), a + size))]
        spread = lambda rows: [(o + i * w, h, b, w, k) for o, h, n, b, w, k in rows for i in range(n)]
        assert spread(cut) == spread(whole)
    for split in (300, 1 << 20):
        chunks = {}
        for r in sorted(fasta.read_chunks(spark, path, 64, split).collect()):
            assert 0 < len(r.seq) <= 64 and r.chunk_start == len(chunks.get(r.seqname, ""))
            chunks[r.seqname] = chunks.get(r.seqname, "") + r.seq
        assert chunks == {k: v for k, v in want.items() if v}
    found = fasta.segments(spark, path, 500)
    asked = [(f"s{i}", a, a + n) for i in range(26) for a, n in ((0, 1), (58, 5), (0, 5000), (3000, 10), (5, 0))]
    got = fasta.fetch_ranges(spark.createDataFrame(asked, "seqname string, start long, end long"), found).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((n, a, b, want[n][a:b] if n in want else None) for n, a, b in asked), key=str)


def test_offsets(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a one\nACGT\nACGT\nAC\n>b\nACG\nACGT\n>c\n>d\nAC GT\n>e\nACGTA\n>f\nACGT\nACGT\n")
    got = {r.seqname: tuple(r)[1:] for r in fasta.offsets(fasta.segments(spark, str(tmp_path / "x.fa"), 11)).collect()}
    assert got["a"] == (10, 7, 4, 5, True) and got["b"][0] == 7 and not got["b"][4] and got["c"][:2] == (0, None) and not got["d"][4]
    assert got["e"][0] == 5 and got["e"][4] and got["f"] == (8, got["f"][1], 4, 5, True)


def test_only_ranges_are_read(spark, tmp_path, monkeypatch):
    path = tmp_path / "x.fa"
    path.write_text(">a\n" + "\n".join("ACGTACGTAC" for _ in range(20000)) + "\n")
    read = []

    class Watched:
        def __init__(self, file):
            self.file = file

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            read.append(n)
            return self.file.read(n)

    piece = {"offset": 3, "first": 12345, "last": 12445, "line_bases": 10, "line_bytes": 11, "blanks": False}
    assert fasta._stretch(Watched(open(path, "rb")), piece) == (b"ACGTACGTAC" * 20000)[12345:12445] and sum(read) <= 111


def test_time_grows_with_length(spark, tmp_path):
    def seconds(n):
        path = tmp_path / f"{n}.fa"
        path.write_text(">a\n" + "ACGTACGTAC" * (n // 10) + "\n")  # one line
        began = time.time()
        assert fasta.read_chunks(spark, str(path), split_bytes=1 << 20).selectExpr("sum(length(seq)) as n").first().n == n
        return time.time() - began

    seconds(100_000)
    short, long = seconds(4_000_000), seconds(32_000_000)
    assert long < 8 * short + 2
