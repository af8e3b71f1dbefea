"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors, one for each word and each of its
character n-grams, all hashed into one table; a softmax layer reads the label
from it.  Trained by stochastic gradient descent in numpy on a bounded sample.
Because the average is linear, a trained model is one number for each slot, and
scoring adds numbers; every distinct word of a chunk is taken apart once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .labelled import labelled_sample
from .runtime import held_out

#: Slots of the hashed table; the last stands for a word that repeats the one before it.
SLOTS = 1 << 17
GRAMS = (3, 4)
#: How often the last slot counts for each such word.
REPEAT = 4
WIDTH = 10
#: Labelled documents that a model learns from, at most.
TRAIN_ROWS = 4000


def distinct_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words, index of one word of each kind, kind of each word)."""
    hashes = W.word_hashes(raw, starts, ends)
    _, example, kind = np.unique(hashes, return_index=True, return_inverse=True)
    return hashes, example, kind


def subwords(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, count): the word's own slot and those of its character n-grams between < and >, word after word."""
    size = ends - starts
    total = size + 2
    begin = np.cumsum(total) - total
    text = np.empty(int(total.sum()), np.uint8)
    text[begin], text[begin + size + 1] = ord("<"), ord(">")
    inner = np.repeat(begin + 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())
    text[inner] = raw[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    first_byte = (text & 0xC0) != 0x80
    lead = np.append(np.flatnonzero(first_byte), len(text))  # characters, as places of their first bytes
    word_of = np.repeat(np.arange(len(starts)), total)[lead[:-1]]
    chars = np.bincount(word_of, minlength=len(starts))
    low = np.cumsum(chars) - chars
    slots, owner = [], []
    own = W.word_hashes(text, begin, begin + total)
    slots.append(own)
    owner.append(np.arange(len(starts)))
    for n in GRAMS:
        at = W.inside(np.append(low, len(lead) - 1), n)
        slots.append(W.word_hashes_loose(text, lead[at], lead[at + n]))
        owner.append(word_of[at])
    slots, owner = np.concatenate(slots), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (slots[order] % np.uint64(SLOTS - 1)).astype(np.int32), np.bincount(owner, minlength=len(starts))


def repeats(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words that equal the word before them in the same text."""
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[:-1][first[:-1] < len(hashes)]] = False
    return again


def features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct slots, weights that sum to 1) of each text; empty for texts without words."""
    raw, offsets = W.column_bytes(column)
    starts, ends, first = W.split(raw, offsets, W.spaces_split())
    hashes, example, kind = distinct_words(raw, starts, ends)
    slots, count = subwords(raw, starts[example], ends[example])
    bounds = np.concatenate([[0], np.cumsum(count)])
    again, out = repeats(hashes, first), []
    for a, b in zip(first, first[1:]):
        kinds, times = np.unique(kind[a:b], return_counts=True)
        own = np.concatenate([slots[:0], *(slots[bounds[k] : bounds[k + 1]] for k in kinds), np.full(1, SLOTS - 1, np.int32)])
        weight = np.concatenate([np.repeat(times, count[kinds]), [again[a:b].sum() * REPEAT]])
        one, place = np.unique(own, return_inverse=True)
        weight = np.bincount(place, weight)
        out.append((one, (weight / max(1.0, weight.sum())).astype(np.float32)) if b > a else (own[:0], np.zeros(0, np.float32)))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, rate: float = 0.5, batch: int = 16, seed: int = 7) -> tuple[np.ndarray, float]:
    """(one number for each slot, bias): the difference of the two logits, from embeddings and softmax layer."""
    random = np.random.default_rng(seed)
    table = ((random.random((SLOTS, WIDTH), np.float32) - 0.5) / WIDTH).astype(np.float32)
    layer, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    known = [i for i in range(len(rows)) if len(rows[i][0])]
    if not known or len(set(labels[known].tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return np.zeros(SLOTS, np.float32), float(np.log(share / (1 - share)))
    target = np.eye(2, dtype=np.float32)[labels]
    steps, step = epochs * -(-len(known) // batch), 0
    for _ in range(epochs):
        random.shuffle(known)
        for a in range(0, len(known), batch):
            part = known[a : a + batch]
            hidden = np.stack([rows[i][1] @ table[rows[i][0]] for i in part])
            logits = hidden @ layer + bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = odds / odds.sum(axis=1, keepdims=True) - target[part]
            speed = rate * (1 - step / steps)
            back = error @ layer.T
            layer -= speed * hidden.T @ error
            bias -= speed * 0.1 * error.sum(axis=0)
            for i, g in zip(part, back):  # a text's slots are distinct
                table[rows[i][0]] -= (speed * 30 * rows[i][1])[:, None] * g
            step += 1
    return table @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def _feature_rows(stream):
    for batch in W.batches(stream, 200, 4 << 20):
        own = features(batch.column("text"))
        packed = [pa.array([x[k].tobytes() for x in own], pa.binary()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *packed], ["doc_id", "label", "slots", "weights"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Learns from `limit` labelled rows at most that are not held out.

    Tasks take the texts apart; the driver, which trains, gets each text's
    distinct slots and weights (eight bytes a slot, SLOTS of them at most).
    """
    sample = labelled_sample(docs, labels, label, limit).mapInArrow(_feature_rows, "doc_id long, label int, slots binary, weights binary")
    rows, target = [], []
    for row in sample.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        rows.append((np.frombuffer(row["slots"], np.int32), np.frombuffer(row["weights"], np.float32)))
        target.append(row["label"])
    return train(rows, np.array(target, np.int64))


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, from its whole text.

    docs needs doc_id and text; other columns are ignored.  Null and empty
    texts score the bias alone; rows with a null id are scored, held_out false.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(stream):
        values, bias = shared.value
        for batch in W.batches(stream, 1 << 16, 2 << 20):
            raw, offsets = W.column_bytes(batch.column("text"))
            starts, ends, first = W.split(raw, offsets, W.spaces_split())
            hashes, example, kind = distinct_words(raw, starts, ends)
            slots, count = subwords(raw, starts[example], ends[example])
            bounds = np.concatenate([[0], np.cumsum(count)])
            again, full = repeats(hashes, first), np.flatnonzero(np.diff(first))
            value, number = np.zeros((2, batch.num_rows))
            if len(full):  # sums within a word and within a text, so that equal texts score alike wherever they stand
                own = np.add.reduceat(values[slots].astype(np.float64), bounds[:-1])[kind] + again * REPEAT * float(values[-1])
                value[full], number[full] = np.add.reduceat(own, first[full]), np.add.reduceat(count[kind] + again * REPEAT, first[full])
            logit = value / np.maximum(1, number) + bias
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-logit)))], ["doc_id", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = own.mapInArrow(rows, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
