"""Block-gzip text: every split size gives the same records, and plain gzip is still read."""

import gzip
import random

import pytest

from strandloom.sources import bam, blocks, formats, lines


def packed(data: bytes, seed=1) -> bytes:
    r, out, at = random.Random(seed), b"", 0
    while at < len(data):
        n = r.choice([1, 2, 3, 40, 700, 5000])
        out += bam._compressed(data[at : at + n])
        at += n
    return out + bam._compressed(b"")


@pytest.mark.parametrize("separator", ["\n", "\n>"])
def test_any_split(tmp_path, separator):
    r = random.Random(4)
    for end in ("", "\n", "\n>", "\n\n>"):
        data = (separator.join("".join(r.choice("ACGT>\n" if separator == "\n>" else "ACGT>") for _ in range(r.choice([0, 1, 5, 80, 3000]))) for _ in range(120)) + end).encode()
        file = tmp_path / "x.gz"
        file.write_bytes(packed(data))
        size, want = file.stat().st_size, data.split(separator.encode())
        if not want[-1]:
            want.pop()
        for step in (7, 60, 333, 4096, 1 << 20):
            got = [x for a in range(0, size, step) for part in blocks.records(open(file, "rb"), size, a, min(size, a + step), separator.encode()) for x in part]
            assert got == want


def test_readers(spark, tmp_path):
    reads = "".join(f"@r{i} x\n{'ACGT' * (1 + i % 30)}\n+\n{'IIII' * (1 + i % 30)}\n" for i in range(800)).encode()
    genome = "".join(f">s{i} n\n{'ACGTN' * 13}\n{'ACG' * i}\n" for i in range(200)).encode()
    for name, data in (("r.fastq", reads), ("g.fa", genome)):
        (tmp_path / name).write_bytes(data)
        (tmp_path / f"{name}.bgz").write_bytes(packed(data))
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(data))
        (tmp_path / f"b-{name}.gz").write_bytes(packed(data, 2))
    read = {"r.fastq": formats.read_fastq, "g.fa": formats.read_fasta}
    for name, f in read.items():
        want = sorted(map(tuple, f(spark, str(tmp_path / name)).collect()))
        for other in (f"{name}.bgz", f"{name}.gz", f"b-{name}.gz"):
            assert sorted(map(tuple, f(spark, str(tmp_path / other)).collect())) == want, other
    rows = lines.numbered(lines.text(spark, str(tmp_path / "r.fastq.bgz"), placed=True, split=500), "line")
    assert rows.rdd.getNumPartitions() > 10
    assert [r.value for r in rows.orderBy("line").collect()] == reads.decode().split("\n")[:-1]
    both = lines.numbered(lines.text(spark, [str(tmp_path / "r.fastq.bgz"), str(tmp_path / "r.fastq")], placed=True))
    assert both.count() == 6400 and both.agg({"ord": "max"}).first()[0] == 6399
