"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding maps homoglyphs and digit substitutions onto one letter each, in the
lexicon and in the texts alike.  Entries are whole words or word stems with a
weight (log odds); exception phrases cancel the matches that they cover.  The
sum of weights, and the same sum by the text's length, go through a logistic
curve.  Lexicon, weights, exceptions and curve are learned from a bounded sample
of labelled rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .labelled import labelled_sample
from .runtime import cut, held_out

# Digits and signs that stand for letters, and letters of other scripts that look like Latin ones.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l",
}
#: i and l are easily swapped for each other and for 1, so all three fold to i.
ALIKE = {"l": "i"}
#: Labelled documents that a model learns from, and entries of its lexicon, at most.
TRAIN_ROWS = 10_000
LEXICON = 4000
STEMS = (4, 5, 6)


def fold_table() -> dict[int, str]:
    """Character table: lower case, full-width forms, homoglyphs, digit substitutions; zero-width characters vanish."""
    table = {ord(k): v for k, v in (SUBSTITUTES | HOMOGLYPHS | ALIKE).items()}
    table |= {ord(k.upper()): v for k, v in (HOMOGLYPHS | ALIKE).items() if len(k.upper()) == 1}
    for code in range(0xFF01, 0xFF5F):
        plain = unicodedata.normalize("NFKC", chr(code)).lower()
        table[code] = table.get(ord(plain), plain)
    for code in range(0x41, 0x5B):
        table.setdefault(code, chr(code + 0x20))
    return table | {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xAD, 0xFEFF)}


_SIGN = re.compile(r"[@$](?!\w)|(?<!\w)[@$]+(?=\s|$)")


def fold(text: str, table: dict[int, str | None]) -> str:
    """The folded text.  Signs stand for letters only where a letter or digit follows."""
    if "@" in text or "$" in text:
        text = _SIGN.sub(" ", text)
    return text.lower().translate(table)


def units(folded: str) -> set[str]:
    """What a lexicon may list of a text: whole words 'w=', stems 'p=', and pairs of words 'x='."""
    words = re.findall(r"\w+", folded)
    out = {f"w={w}" for w in words if len(w) > 2}
    out |= {f"p={w[:n]}" for w in words for n in STEMS if len(w) > n}
    return out


def _cluster(folded: str) -> int:
    """Near copies mostly share this: the smallest hashes of their words."""
    raw, offsets = W.column_bytes(pa.array([folded]))
    starts, ends, _ = W.split(raw, offsets, W.spaces_split())
    low = np.unique(W.word_hashes(raw, starts, ends))[:3]
    return int(np.bitwise_xor.reduce(W.mix(low)).view(np.int64)) if len(low) else 0


def listed(toxic: dict[str, int], other: dict[str, int], n: tuple[int, int], purity: float = 8.0) -> dict[str, float]:
    """Entries and weights from counts of units in toxic and other texts (each group of near copies counted once), n texts of each kind.

    An entry has to be `purity` times likelier in toxic texts.  What a listed
    stem covers is left out, and so is a stem that one longer entry explains.
    """
    weight = {}
    for u, k in toxic.items():
        odds = (k + 0.5) / (n[1] + 1) / ((other.get(u, 0) + 0.5) / (n[0] + 1))
        if odds >= purity:
            weight[u] = float(np.log(odds))
    # The most specific entry that explains nearly all of a stem's texts stands for it.
    for u in sorted((u for u in weight if u[0] == "p"), key=len):
        if u in weight and max((toxic[v] for v in weight if v != u and v[2:].startswith(u[2:])), default=0) >= 0.9 * toxic[u]:
            weight.pop(u)
    for u in list(weight):  # what a listed stem covers
        if any(f"p={u[2 : 2 + m]}" in weight for m in STEMS if m < len(u) - 2):
            weight.pop(u)
    return dict(sorted(weight.items(), key=lambda x: (-x[1] * toxic[x[0]], x[0]))[:LEXICON])


class Matcher:
    """Weighted matches of a lexicon, less those under exception phrases."""

    def __init__(self, lexicon: dict[str, float], exceptions: list[str]):
        import ahocorasick

        self.lexicon, self.exceptions = lexicon, exceptions
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for unit, weight in lexicon.items():
            entries.setdefault(unit[2:], []).append((unit[0], weight))
        for phrase in exceptions:
            entries.setdefault(phrase, []).append(("x", 0.0))
        for word, what in entries.items():
            self.automaton.add_word(word, (len(word), what))
        if entries:
            self.automaton.make_automaton()

    def found(self, folded: str) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, weight) of counted matches, one for each place at most."""
        if not len(self.automaton):
            return []
        hits, free = {}, []
        for end, (size, what) in self.automaton.iter(folded):
            start, end = end - size + 1, end + 1
            if start and (folded[start - 1].isalnum() or folded[start - 1] == "_"):
                continue
            closed = end == len(folded) or not (folded[end].isalnum() or folded[end] == "_")
            for kind, weight in what:
                if kind == "x" and closed:
                    free.append((start, end))
                elif kind == "p" and not closed or kind == "w" and closed:
                    if weight > hits.get(start, (0, 0, "", 0.0))[3]:
                        hits[start] = (start, end, kind, weight)
        return [h for h in hits.values() if not any(a <= h[0] and h[1] <= b for a, b in free)]


def measures(matcher: Matcher, folded: str) -> tuple[float, float, int]:
    """Sum of weights, and that sum by length, both on a log scale, and the number of matches."""
    hits = matcher.found(folded)
    total = sum(h[3] for h in hits)
    return np.log1p(total), np.log1p(100 * total / (folded.count(" ") + folded.count("\n") + 20)), len(hits)


def phrases(matcher: Matcher, folded: str) -> set[str]:
    """Pairs of words around the matches of a text."""
    pairs = set()
    for start, end, _, _ in matcher.found(folded):
        before, after = re.search(r"(\w+ )$", folded[max(0, start - 40) : start]), re.match(r"\w*( \w+)?", folded[end : end + 40])
        own = folded[start:end] + re.match(r"\w*", folded[end : end + 40])[0]
        pairs |= {before[1] + own} if before else set()
        pairs |= {folded[start:end] + after[0]} if after and after[1] else set()
    return pairs


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic curve by Newton steps; the last is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def _counts(rows: DataFrame, make) -> DataFrame:
    """unit, toxic, other: texts of each label that have it, summed up in tasks first; make() gives what takes a folded text's units."""

    def each(stream):
        taken, both = make(), (Counter(), Counter())
        for batch in stream:
            for text, label in zip(batch.column("text"), batch.column("label")):
                both[label.as_py()].update(taken(text.as_py()))
        names = list(both[0] | both[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[u] for u in names], pa.int64()) for c in (both[1], both[0]))], ["unit", "toxic", "other"])

    return rows.mapInArrow(each, "unit string, toxic long, other long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = TRAIN_ROWS, least: int = 3, purity: float = 8.0, common: int = 5) -> dict:
    """Learns from `limit` labelled rows at most that are not held out; without labels of both kinds nothing scores.

    Texts stay on the executors: tasks fold them and count, and the driver gets
    the units that may become entries (`least` groups of toxic texts and a
    hundredth of them have it), the exception phrases (`common` other texts and
    no toxic one have it) and two numbers for each row.
    """

    def folded(stream):
        table = fold_table()
        for batch in stream:
            texts = [fold(t.as_py() or "", table) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([_cluster(t) for t in texts], pa.int64()), pa.array(texts, pa.string())], ["doc_id", "label", "near", "text"])

    rows = cut(labelled_sample(docs, labels, label, limit).mapInArrow(folded, "doc_id long, label int, near long, text string"))
    firsts = rows.groupBy("near", "label").agg(F.min("doc_id").alias("doc_id"))
    count = {r["label"]: r["n"] for r in firsts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = (count.get(0, 0), count.get(1, 0))
    if not all(n):
        return {"lexicon": {}, "exceptions": [], "curve": [0.0, 0.0, -4.0]}
    single = rows.join(F.broadcast(firsts.select("doc_id")), "doc_id", "left_semi")  # `limit` numbers at most
    likelier = (F.col("toxic") + 0.5) / (n[1] + 1) >= purity * (F.col("other") + 0.5) / (n[0] + 1)
    able = _counts(single, lambda: units).filter((F.col("toxic") >= max(least, n[1] // 100)) & likelier).orderBy(F.desc("toxic"), "unit").limit(4 * LEXICON).collect()
    lexicon = listed({r["unit"]: r["toxic"] for r in able}, {r["unit"]: r["other"] for r in able}, n, purity)

    def around():
        matcher = Matcher(lexicon, [])
        return lambda text: phrases(matcher, text)

    free = _counts(rows, around).filter((F.col("other") >= common) & (F.col("toxic") == 0)).orderBy(F.desc("other"), "unit").limit(LEXICON)
    exceptions = sorted(r["unit"] for r in free.collect())

    def measured(stream):
        own = Matcher(lexicon, exceptions)
        for batch in stream:
            two = np.array([measures(own, t.as_py())[:2] for t in batch.column("text")]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(two[:, 0]), pa.array(two[:, 1])], ["doc_id", "label", "a", "b"])

    seen = rows.mapInArrow(measured, "doc_id long, label int, a double, b double").orderBy("doc_id").select("a", "b", "label").collect()
    x = np.array([tuple(r) for r in seen], np.float64)
    return {"lexicon": lexicon, "exceptions": exceptions, "curve": logistic(x[:, :2], x[:, 2]).tolist()}


def _scorer(known: dict):
    """A function from a text to its score and number of matches."""
    matcher, table, curve = Matcher(known["lexicon"], known["exceptions"]), fold_table(), known["curve"]

    def one(text: str | None) -> tuple[float, int]:
        a, b, n = measures(matcher, fold(text or "", table))
        return float(1 / (1 + np.exp(-np.clip(curve[0] * a + curve[1] * b + curve[2], -30, 30)))), n

    return one


def score(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches for each row of docs, from its whole text.

    docs needs doc_id and text; other columns are ignored.  Null and empty
    texts have no matches; rows with a null id are scored, held_out false.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LEXICON entries at most

    def rows(stream):
        one = _scorer(shared.value)
        for batch in stream:
            found = [one(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s for s, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], ["doc_id", "score", "n_matches"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = own.mapInArrow(rows, "doc_id long, score double, n_matches long")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_matches")


def remove_toxic(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """docs without rows that score `threshold` or more; all columns stay as they are, and nothing is shuffled.

    Null and empty texts have no matches and stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(stream):
        one = _scorer(shared.value)
        for batch in stream:
            yield batch.filter(pa.array([one(text.as_py())[0] < threshold for text in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
