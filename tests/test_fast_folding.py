"""Wide batches, whole numbers and walks give what narrow batches, doubles and plain loops give."""

import numpy as np
import pyarrow as pa

from strandloom.operators import folding
from strandloom.operators.folding import Batch, Model
from strandloom.operators.sampling import Klets


def texts(n, most, seed=1):
    r = np.random.default_rng(seed)
    return ["".join(r.choice(list("ACGT"), r.integers(0, most))) for _ in range(n)]


def test_wide_batches(monkeypatch):
    seqs, model = texts(40, 90), Model(24)
    single = [Batch([folding.letters(s)], model, False).best()[0] for s in seqs]
    assert model.table(False).dtype == np.int16 and Model(24, weights=(("AT", 0.5),)).table(False).dtype == float
    monkeypatch.setattr(folding, "TILE", 100)  # tiles end inside sequences
    for wide in (100, 1 << 18):
        got = {}

        def work(batch, at, codes):
            own = Batch(codes, model, False)
            yield from zip(at.tolist(), own.best())

        for at, value in folding._batches([pa.RecordBatch.from_arrays([pa.array(seqs)], ["s"])], work, wide):
            got[at] = value
        assert [got[i] for i in range(len(seqs))] == single
    fewer = []
    list(folding._batches([pa.RecordBatch.from_arrays([pa.array(seqs)], ["s"])], lambda *x: fewer.append(1) or (), folding.WIDE))
    assert len(fewer) == 1


def test_walks_keep_their_draws():
    def plain(own, random):
        n, k = len(own.seq), own.k
        turn = random.random(len(own.order))
        final = own.last_exits(random)
        turn[final[final >= 0]] = 2.0
        order = np.lexsort((turn, own.owner))
        target, letter = own.target[order].tolist(), own.letter[order].tolist()
        at, used, out = int(own.nodes[0]), own.begin[:-1].tolist(), []
        for _ in range(n - k + 1):
            i = used[at]
            used[at] = i + 1
            out.append(letter[i])
            at = target[i]
        return np.concatenate([own.letters[: k - 1], np.array(out, np.uint32)]).tobytes().decode("utf-32-le")

    for seq in [s for s in texts(20, 400, 2) if len(s) > 3]:
        for k in (2, 3):
            own = Klets(seq, k)
            assert own.draw(np.random.default_rng(5)) == plain(own, np.random.default_rng(5))


def test_few_files_are_many_tasks(spark, tmp_path):
    spark.createDataFrame(list(enumerate(texts(30, 60))), "id int, seq string").coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert folding.position_marginals(rows, "id", "seq").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert folding.energy_z(rows, "id", "seq", 3).count() == 30
