"""Seeded random operators: resampling, k-let preserving shuffles, random sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the md5 of the seed and the keys: the same in every run, partitioning and engine."""
    text = F.concat_ws("/", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def resample(lines: DataFrame, m: int, k: int = 1, seed: int = 1) -> DataFrame:
    """m groups of k neighbouring lines (ord, ...) drawn with replacement; rows in file order carry copy (0, 1, ...).

    A last group of fewer than k lines is not drawn from.
    """
    n = lines.agg(F.coalesce(F.floor((F.max("ord") + 1) / k), F.lit(0)).alias("n"))
    draws = lines.sparkSession.range(m).join(F.broadcast(n.filter("n > 0")), F.lit(True)).select(F.floor(uniform(seed, F.col("id")) * F.col("n")).alias("g"))
    times = draws.groupBy("g").agg(F.count("*").alias("c"))
    rows = lines.withColumn("g", F.floor(F.col("ord") / k)).join(times, "g")
    return rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("copy")).drop("g", "c")


class Klets:
    """A sequence prepared for shuffles that keep the counts of all substrings of length k; draw() as often as wanted.

    Substrings of length k - 1 are numbered nodes of a walk, the exits of a node
    a stretch of one array.  Preparing takes a sort for each letter of a node,
    a draw a sort and one pass over the sequence.
    """

    def __init__(self, seq: str, k: int):
        self.seq, self.k = seq, k
        self.letters = np.frombuffer(seq.encode("utf-32-le"), np.uint32)
        if not 1 < k < len(seq):
            return
        kinds, own = np.unique(self.letters, return_inverse=True)
        nodes = own
        for i in range(1, k - 1):  # nodes of one letter more, numbered anew
            _, nodes = np.unique(nodes[:-1] * len(kinds) + own[i:], return_inverse=True)
        self.nodes, self.count = nodes, int(nodes.max()) + 1
        self.order = np.argsort(nodes[:-1], kind="stable")  # exits by node
        self.owner, self.target, self.letter = nodes[:-1][self.order], nodes[1:][self.order], self.letters[k - 1 :][self.order]
        self.begin = np.searchsorted(self.owner, np.arange(self.count + 1))

    def last_exits(self, random: np.random.Generator) -> np.ndarray:
        """For each node but the last one of the walk the exit that is used last, -1 for that one: a uniform random tree towards it.

        Loop-erased random walks from each node until they meet the tree.
        """
        last, begin, target = int(self.nodes[-1]), self.begin.tolist(), self.target.tolist()
        leave = [-1] * self.count
        done = [False] * self.count
        done[last] = True
        drawn: list[float] = []
        for start in range(self.count):
            at = start
            while not done[at]:
                if not drawn:
                    drawn = random.random(1 << 10).tolist()
                leave[at] = begin[at] + int(drawn.pop() * (begin[at + 1] - begin[at]))
                at = target[leave[at]]
            at = start
            while not done[at]:
                done[at] = True
                at = target[leave[at]]
        leave[last] = -1
        return np.array(leave)

    def draw(self, random: np.random.Generator) -> str:
        """A permutation of the sequence, uniform among those with its counts of substrings."""
        n, k = len(self.seq), self.k
        if k >= n:
            return self.seq
        if k <= 1:
            return random.permutation(self.letters).tobytes().decode("utf-32-le")
        turn = random.random(len(self.order))
        final = self.last_exits(random)
        turn[final[final >= 0]] = 2.0
        begin = self.begin.tolist()
        # Few nodes have long stretches of exits, each of which is sorted alone.
        order = np.concatenate([a + np.argsort(turn[a:b]) for a, b in zip(begin, begin[1:])]) if 16 * self.count < n else np.lexsort((turn, self.owner))
        target = self.target[order].tolist()
        following = [iter(target[a:b]).__next__ for a, b in zip(begin, begin[1:])]
        at, walk = int(self.nodes[0]), [0] * (n - k + 1)
        for i in range(n - k + 1):
            walk[i] = at = following[at]()
        last = np.zeros(self.count, np.uint32)  # a node's last letter
        last[self.target] = self.letter
        return np.concatenate([self.letters[: k - 1], last[walk]]).tobytes().decode("utf-32-le")


def shuffled(seq: str, k: int, random: np.random.Generator) -> str:
    """A random permutation of seq with the same counts of all substrings of length k."""
    return Klets(seq, k).draw(random)


def klet_shuffle(rows: DataFrame, ident: str, seq: str, k: int = 2, draws: int = 1, seed: int = 1) -> DataFrame:
    """ident, draw, shuffled: `draws` permutations of each sequence, seeded by row and draw; each sequence is prepared once.

    A null sequence gives nulls.  Draws are sent on as they are made.
    """

    def each(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            ids, out, size = batch.column(0), [], 0
            for row, (s, h) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                own = None if s is None else Klets(s, k)
                for d in range(draws):
                    out.append((row, d, None if own is None else own.draw(np.random.default_rng([seed, h & 0xFFFFFFFFFFFFFFFF, d]))))
                    size += len(s or "")
                    if size > 4 << 20:
                        yield batch_of(ids, out)
                        out, size = [], 0
            if out:
                yield batch_of(ids, out)

    def batch_of(ids, out):
        at, draw, text = zip(*out)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(draw, pa.int32()), pa.array(text, pa.string())], [ident, "draw", "shuffled"])

    kind = dict(rows.dtypes)[ident]
    return rows.select(ident, F.col(seq).cast("string").alias("_s"), F.xxhash64(ident).alias("_h")).mapInArrow(each, f"{ident} {kind}, draw int, shuffled string")


def shuffled_matches(rows: DataFrame, ident: str, seq: str, pattern: str, k: int, draws: int = 1, seed: int = 1, invert: bool = False) -> DataFrame:
    """Shuffles of sequences that match a pattern (or do not): ident, draw, shuffled."""
    hit = F.col("shuffled").rlike(pattern)
    return klet_shuffle(rows, ident, seq, k, draws, seed).filter(~hit if invert else hit)


def permutation_z(scores: DataFrame, ident: str, score: str, permuted: DataFrame, permuted_score: str) -> DataFrame:
    """ident and z: a score against the mean and population deviation of the scores of its permutations."""
    stats = permuted.groupBy(ident).agg(F.avg(permuted_score).alias("m"), F.stddev_pop(permuted_score).alias("s"))
    return scores.join(stats, ident).select(ident, F.try_divide(F.col(score) - F.col("m"), F.col("s")).alias("z"))


def random_bases(rows: DataFrame, gc: float = 0.5, seed: int = 1, width: int = 80) -> DataFrame:
    """id, seq, wrapped: for each row (id, length) bases with that chance of G or C each, and the same in lines of `width`."""
    from ..functions.sequences import wrap

    u = lambda i: uniform(seed, F.col("id"), i)
    base = lambda i: F.when(u(i) < gc / 2, "G").when(u(i) < gc, "C").when(u(i) < gc + (1 - gc) / 2, "A").otherwise("T")
    places = F.filter(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("length").cast("long"), F.lit(1))), lambda i: i <= F.col("length"))
    drawn = rows.select("id", F.array_join(F.transform(places, base), "").alias("seq"))
    return drawn.select("id", "seq", wrap(F.col("seq"), width).alias("wrapped"))


def random_sequences(spark, n: int, length: int, gc: float = 0.5, seed: int = 1, width: int = 80) -> DataFrame:
    """random_bases() of n rows of one length."""
    return random_bases(spark.range(n).withColumn("length", F.lit(length)), gc, seed, width)


def pipe_sequences(rows: DataFrame, ident: str, seq: str, command: list[str], allow: bool = False) -> DataFrame:
    """ident, output: standard output of an external command fed each sequence as FASTA.  Runs only with allow=True."""
    if not allow:
        raise PermissionError("external commands run only with allow=True")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import subprocess

        for f in frames:
            out = [subprocess.run(command, input=f">{i}\n{s}\n", capture_output=True, text=True, check=True).stdout for i, s in zip(f[ident], f[seq])]
            yield pd.DataFrame({ident: f[ident], "output": out})

    return rows.select(ident, seq).mapInPandas(each, f"{ident} {dict(rows.dtypes)[ident]}, output string")
