"""Projection of alignment blocks: the blocks are read once and dealt out in the parts of their files."""

import re

from strandloom import shared
from strandloom.operators import alignments
from strandloom.sources import formats


def test_cells_are_read_once(spark, tmp_path, monkeypatch):
    block = lambda i: f"SEQ human 1 {i * 10 + 1} {i * 10 + 3} {1 if i % 2 else -1}\nSEQ human 1 {i * 10 + 4} {i * 10 + 6} 1\nSEQ mouse 2 5 8 1\nDATA\nAGT\n-C-\nCG-\nG-A\n//\n"
    text = "##x\n" + "".join(block(i) for i in range(60))
    (tmp_path / "a.emf").write_text(text)
    monkeypatch.setattr(shared, "PART_BYTES", len(text) // 10)
    cells = formats.read_emf(spark, str(tmp_path / "a.emf"))
    want, turn = [], str.maketrans("ACGT", "TGCA")
    for i in range(60):
        up, k = i % 2 > 0, [0, 0]
        for row in ("AGT", "-C-", "CG-", "G-A"):
            for c in (0, 1):
                if row[c] == "-":
                    continue
                k[c] += 1
                back = c == 0 and not up
                pos = i * 10 + 3 - k[c] if back else i * 10 + (1, 4)[c] + k[c] - 2
                for col, name in ((0, "human"), (1, "human"), (2, "mouse")):
                    want.append((i, col, name, pos, row[col].translate(turn) if back else row[col]))
    out = alignments.project(cells, "human", ["human", "mouse"])
    assert sorted((r.block, r.col, r.species, r.pos, r.base) for r in out.collect()) == sorted(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    n = shared.parts(cells)
    assert "SortMergeJoin" not in plan and n > 4 and set(re.findall(r"hashpartitioning\(block#\d+L?, (\d+)\)", plan)) == {str(n)} and len(re.findall("posexplode", out._jdf.queryExecution().optimizedPlan().toString())) == 2
    last = {}
    for i, col, name, pos, base in want:
        if (i, col) >= last.get((name, pos), (-1, -1, ""))[:2]:
            last[name, pos] = (i, col, base)
    targets = spark.createDataFrame([("1", 620)], "seqname string, length long")
    got = alignments.projected_sequences(cells, "human", ["human", "mouse"], targets, 100)
    for r in got.collect():
        assert r.seq == "".join(last.get((r.species, p), (0, 0, "-"))[2] for p in range(r.chunk_start, min(620, r.chunk_start + 100)))
    assert set(re.findall(r"hashpartitioning\((?:seqname|ref_seqname)[^)]*, (\d+)\)", got._jdf.queryExecution().executedPlan().toString())) == {str(n)}
