"""Structures of sequences by pairing of bases: best energies, permutation z-scores, pair probabilities.

The model is that of maximum weighted pairing (Nussinov) and of its Boltzmann
sums (McCaskill without loop energies): nested pairs, each worth its weight, at
least `loop` bases inside a pair, both ends of a pair within `span` bases.  The
span is part of the model, as in local folding; it makes the work linear in
length (span * span / 2 operations a base), and a span of the sequence's length
is global folding.  Both recursions are the same sums over (max, +) and (+, *),
worked on all starts of a tile at once, for one length after the other; what lies
outside all pairs is swept along the sequences of a batch side by side.  Memory is
span * TILE numbers, whatever the length of a sequence, and a few numbers a base.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import spread
from .sampling import klet_shuffle, permutation_z

#: Hydrogen bonds of the pairs, G with U (or T) as one.
WEIGHTS = {"AT": 2.0, "AU": 2.0, "CG": 3.0, "GT": 1.0, "GU": 1.0}
TILE = 1 << 15
#: Bases of a batch of which only the best values are asked for: its tiles are worked one by one, and the more sequences are swept side by side the fewer steps it takes.
WIDE = 1 << 18


@dataclass(frozen=True)
class Model:
    """Weights of pairs (either order), bases inside a pair at least, bases from one end to the other at most, temperature of the sums."""

    span: int = 32
    loop: int = 3
    weights: tuple[tuple[str, float], ...] = tuple(WEIGHTS.items())
    temperature: float = 1.0

    def __post_init__(self):
        if self.loop < 0 or self.span < 2 or any(len(p) != 2 or w < 0 for p, w in self.weights):
            raise ValueError("a model needs a loop of 0 or more, a span of 2 or more and weights of 0 or more for pairs of letters")

    def table(self, sums: bool) -> np.ndarray:
        """What a pair of letters counts: its weight, or its Boltzmann factor; 0 for others."""
        if sums and self.span / 2 * max((w for _, w in self.weights), default=0) / self.temperature > 600:
            raise ValueError("sums of this span exceed the range of doubles: shorten the span or raise the temperature")
        out = np.zeros((128, 128))
        for (x, y), w in self.weights:
            for a in (x, x.lower()):
                for b in (y, y.lower()):
                    out[ord(a), ord(b)] = out[ord(b), ord(a)] = np.exp(w / self.temperature) if sums else w
        whole = not sums and (out == np.floor(out)).all() and out.max() * (self.span / 2 + 1) < 1 << 15
        return out.astype(np.int16) if whole else out  # best values inside a span are exact in small whole numbers, of which more fit a register


def letters(text: str) -> np.ndarray:
    """A letter a character; those outside ASCII pair with nothing."""
    return np.frombuffer(text.encode("ascii", "replace"), np.uint8)


class Inner:
    """Sums over the structures inside each stretch of a tile: within[d][i] for d bases from i, closed[k][i] with i and i + k paired.

    A pair of weight 0 adds nothing to a maximum, as leaving both ends free is as good.
    """

    def __init__(self, codes: np.ndarray, model: Model, table: np.ndarray, sums: bool):
        n, span, loop = len(codes), model.span, model.loop
        plus, times, one = (np.add, np.multiply, 1.0) if sums else (np.maximum, np.add, 0.0)
        self.pair = {k: table[codes[:-k], codes[k:]] for k in range(loop + 1, min(span, n))}
        self.within, self.closed = [np.full(n + 1 - d, one, table.dtype) for d in range(min(loop + 2, n + 1))], {}
        for d in range(loop + 1, min(span, n)):
            if d == len(self.within):  # then d > loop + 1
                m = n + 1 - d
                total = self.within[d - 1][1:].copy()
                for k in range(loop + 1, d):
                    plus(total, times(self.closed[k][:m], self.within[d - k - 1][k + 1 : k + 1 + m]), out=total)
                self.within.append(total)
            self.closed[d] = times(self.pair[d], self.within[d - 1][1 : n + 1 - d])

    def rows(self, n: int, model: Model, by_end: bool) -> np.ndarray:
        """closed as one row a base: by the pair's second base or by its first."""
        out = np.zeros((n, max(0, model.span - model.loop - 1)), self.within[0].dtype)
        for k, c in self.closed.items():
            out[k if by_end else 0 : n if by_end else n - k, k - model.loop - 1] = c
        return out

    def outside(self, outer: dict[int, np.ndarray], model: Model) -> dict[int, np.ndarray]:
        """Probability of each pair, from the weight of everything outside it if nothing encloses it."""
        weight = [np.zeros(len(w)) for w in self.within]
        found = {}
        for k in sorted(self.closed, reverse=True):
            # By now weight[k] is whole: all that refers to k bases is longer.
            if k < len(weight):
                m, w = len(weight[k]), weight[k]
                if k > model.loop + 1:
                    weight[k - 1][1 : 1 + m] += w
                for j in range(model.loop + 1, k):
                    rest = self.within[k - j - 1][j + 1 : j + 1 + m]
                    outer[j][:m] += w * rest
                    weight[k - j - 1][j + 1 : j + 1 + m] += w * self.closed[j][:m]
            # Pairs over k bases: enclosed ones were added by longer stretches.
            found[k] = outer[k] * self.closed[k]
            weight[k - 1][1 : 1 + len(outer[k])] += outer[k] * self.pair[k]
        return found


def sweep(known: np.ndarray, at: np.ndarray, lengths: np.ndarray, closed: np.ndarray, begin: np.ndarray, step: int, first: int, last: int, model: Model, sums: bool) -> None:
    """Fills known[at + j] for j = first..last from the entries before: the best value, or the logarithm of the sum, of j bases.

    Sequences are sorted by falling length; row j of a sequence is closed[begin + step * (j - first)].
    """
    back = 1 + np.arange(model.loop + 1, model.span)
    for j, live in zip(range(first, last + 1), np.searchsorted(-lengths, -np.arange(first, last + 1), "right").tolist()):
        here = at[:live] + j
        earlier, before = known[here[:, None] - back], known[here - 1]
        rows = closed[begin[:live] + step * (j - first)]
        if sums:
            known[here] = before + np.log1p((np.exp(earlier - before[:, None]) * rows).sum(1))
        else:
            known[here] = np.maximum(before, (earlier + rows).max(1, initial=-np.inf))


class Batch:
    """Some sequences to be worked on together: short ones side by side, or one long one tile after tile."""

    def __init__(self, codes: list[np.ndarray], model: Model, sums: bool):
        self.order = np.argsort([-len(c) for c in codes], kind="stable")
        self.model, self.sums, self.table = model, sums, model.table(sums)
        self.lengths = np.array([len(codes[i]) for i in self.order], np.int64)
        self.codes = np.concatenate([codes[i] for i in self.order]) if codes else np.zeros(0, np.uint8)
        self.start = np.cumsum(self.lengths) - self.lengths
        self.at = self.start + (model.span + 1) * (1 + np.arange(len(codes)))
        self.size = TILE if len(codes) == 1 else max(1, len(self.codes))
        self.made: dict[tuple[int, int], Inner] = {}

    def tiles(self) -> list[tuple[int, int]]:
        return [(a, min(a + self.size, len(self.codes))) for a in range(0, len(self.codes), self.size)]

    def inner(self, low: int, high: int) -> Inner:
        """Inner of a stretch; the last one is kept, as a batch of short sequences asks for the same stretch again."""
        if (low, high) not in self.made:
            self.made = {(low, high): Inner(self.codes[low:high], self.model, self.table, self.sums)}
        return self.made[low, high]

    def empty(self) -> np.ndarray:
        known = np.full(len(self.codes) + (self.model.span + 1) * (1 + len(self.at)), -np.inf)
        known[self.at] = 0.0
        return known

    def forward(self) -> np.ndarray:
        """The value of the first j bases of each sequence at at + j."""
        known, n = self.empty(), len(self.codes)
        if len(self.at) == 1:
            for a, b in self.tiles():
                sweep(known, self.at, self.lengths, self.ends(a, b), self.start, 1, a + 1, b, self.model, self.sums)
        elif n:
            rows = np.concatenate([self.ends(a, min(a + TILE, n)) for a in range(0, n, TILE)])
            sweep(known, self.at, self.lengths, rows, self.start, 1, 1, int(self.lengths[0]), self.model, self.sums)
        return known

    def ends(self, a: int, b: int) -> np.ndarray:
        """A row for each base of a stretch: its pairs with bases before it."""
        low = max(0, a - self.model.span)
        return self.inner(low, b).rows(b - low, self.model, True)[a - low :]

    def backward(self) -> np.ndarray:
        """The value of the last j bases of each sequence at at + j."""
        known, n = self.empty(), len(self.codes)
        for a, b in reversed(self.tiles()):
            high = min(n, b + self.model.span)
            rows = self.inner(a, high).rows(high - a, self.model, False)
            one = len(self.at) == 1
            first = n - b + 1 if one else 1
            sweep(known, self.at, self.lengths, rows, np.array([b - a - 1]) if one else self.start + self.lengths - 1, -1, first, n - a if one else int(self.lengths[0]), self.model, self.sums)
        return known

    def best(self) -> np.ndarray:
        """The largest weight of a structure of each sequence, in the order given."""
        out = np.zeros(len(self.order))
        out[self.order] = self.forward()[self.at + self.lengths]
        return out

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(sequence, i, j, probability) of pairs, tile by tile; pairs of probability 0 are left out."""
        n, span = len(self.codes), self.model.span
        ahead, behind = self.forward(), self.backward()
        own = np.repeat(np.arange(len(self.lengths)), self.lengths)
        place = np.arange(n) - self.start[own]
        left, right = ahead[self.at[own] + place], behind[self.at[own] + self.lengths[own] - place - 1]
        whole = ahead[self.at + self.lengths][own]
        for a, b in self.tiles():
            low, high = max(0, a - span), min(n, b + span)
            inner = self.inner(low, high)
            outer = {}
            for k in inner.closed:
                i, j = slice(low, high - k), slice(low + k, high)
                outer[k] = np.exp(np.where(own[i] == own[j], left[i] + right[j] - whole[i], -np.inf))
            for k, p in inner.outside(outer, self.model).items():
                i = np.flatnonzero(p[a - low : b - low] > 0) + a
                yield self.order[own[i]], place[i], place[i] + k, p[i - low]


def _batches(stream, work, most=TILE):
    """work(batch, rows, their letters) for runs of sequences of up to `most` bases, longer ones alone; like lengths come together, as a run takes as many steps as its longest."""
    for batch in stream:
        codes, at, size = [], [], 0
        texts = batch.column(batch.num_columns - 1).to_pylist()
        for row in sorted((i for i, text in enumerate(texts) if text is not None), key=lambda i: len(texts[i])):
            text = texts[row]
            if codes and size + len(text) > most:
                yield from work(batch, np.array(at), codes)
                codes, at, size = [], [], 0
            codes.append(letters(text)), at.append(row)
            size += len(text)
        if codes:
            yield from work(batch, np.array(at), codes)


def _kept(rows: DataFrame, ident: list[str], seq: str) -> tuple[DataFrame, str]:
    kinds = dict(rows.dtypes)
    return rows.select(*ident, F.col(seq).cast("string").alias("_s")), ", ".join(f"`{c}` {kinds[c]}" for c in ident)


def energies(rows: DataFrame, ident: list[str], seq: str, model: Model = Model()) -> DataFrame:
    """ident and energy: minus the largest weight of a structure; 0 for an empty sequence.  A null sequence has no row."""
    own, schema = _kept(rows, ident, seq)

    def work(batch, at, codes):
        values = -Batch(codes, model, False).best() + 0.0
        yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(at)) for i in range(len(ident))] + [pa.array(values)], [*ident, "energy"])

    return own.mapInArrow(lambda stream: _batches(stream, work, WIDE), f"{schema}, energy double")


def energy_z(rows: DataFrame, ident: str, seq: str, draws: int = 100, k: int = 2, seed: int = 1, model: Model = Model()) -> DataFrame:
    """ident, energy and z: the energy against those of `draws` shuffles of the sequence that keep its counts of k letters.

    ident tells the rows apart.  z is null where all shuffles have one energy (so it is for sequences that have one shuffle).
    """
    rows = spread(rows.select(ident, seq), ident)
    scores = energies(rows, [ident], seq, model)
    permuted = energies(klet_shuffle(rows, ident, seq, k, draws, seed), [ident, "draw"], "shuffled", model)
    return scores.join(permutation_z(scores, ident, "energy", permuted, "energy"), ident, "left")


def pair_probabilities(rows: DataFrame, ident: str, seq: str, model: Model = Model()) -> DataFrame:
    """ident, i, j, p: how likely bases i < j (from 0) are paired, over all structures by their Boltzmann weight; pairs that can occur only."""
    own, schema = _kept(rows, [ident], seq)

    def work(batch, at, codes):
        for which, i, j, p in Batch(codes, model, True).pairs():
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[which])), pa.array(i), pa.array(j), pa.array(p)], [ident, "i", "j", "p"])

    return own.mapInArrow(lambda stream: _batches(stream, work), f"{schema}, i long, j long, p double")


def position_marginals(rows: DataFrame, ident: str, seq: str, model: Model = Model()) -> DataFrame:
    """ident, pos, p: how likely each base is paired at all; one row a base, summed where the sequence is dealt to."""
    own, schema = _kept(spread(rows.select(ident, seq), ident), [ident], seq)

    def work(batch, at, codes):
        own = Batch(codes, model, True)
        lengths = np.array([len(c) for c in codes])
        start = np.cumsum(lengths) - lengths
        total = np.zeros(lengths.sum())
        for which, i, j, p in own.pairs():
            total += np.bincount(start[which] + i, p, len(total)) + np.bincount(start[which] + j, p, len(total))
        which = np.repeat(np.arange(len(codes)), lengths)
        for a in range(0, len(total), TILE):
            w = which[a : a + TILE]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[w])), pa.array(np.arange(a, a + len(w)) - start[w]), pa.array(total[a : a + TILE])], [ident, "pos", "p"])

    return own.mapInArrow(lambda stream: _batches(stream, work), f"{schema}, pos long, p double")
