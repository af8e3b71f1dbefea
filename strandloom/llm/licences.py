"""Licence scans: a positional index of rare words finds notices, mandatory phrases confirm them.

The index holds every notice's words with their places.  A file looks up, for
each notice, those of its words that are rarest in the corpus (highest inverse
document frequency); places of a word in the file and in the notice give the
place at which the notice would begin, and where the postings of several words
agree on it, the notice is compared word by word and has to hold its mandatory
phrases.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

# Phrases of the base labels, and public licence notices as (label, words, mandatory phrases).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2 0", "in compliance with the license"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2", ["gnu general public license as published by the free software foundation", "version 2"]),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3", ["gnu general public license as published by the free software foundation", "version 3"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee is hereby granted"]),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ["waived all copyright and related or neighboring rights"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["released into the public domain"]),
]
#: Rare words that a notice is looked up by, words that have to agree on its place, words by which its parts may be shifted, and the share of its words that has to be there.
RARE, AGREE, SHIFT, COVER = 6, 2, 2, 0.6
#: Score of a file that holds a base phrase and no notice.
BARE = 0.5


class Index:
    """Words of all notices and phrases as numbers, and the notices' words by place."""

    def __init__(self, notices=NOTICES, phrases=PHRASES):
        self.notices, self.phrases = [(label, text.split(), [p.split() for p in must]) for label, text, must in notices], {tuple(p.split()): label for p, label in phrases.items()}
        self.words = sorted({w for _, text, must in self.notices for w in [*text, *(x for p in must for x in p)]} | {w for p in self.phrases for w in p})
        raw = [w.encode() for w in self.words]
        ends = np.cumsum([len(x) for x in raw])
        hashes = W.word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends)
        self.order = np.argsort(hashes)
        self.hashes, self.number = hashes[self.order], {w: i for i, w in enumerate(self.words)}

    def numbers(self, batch_text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the number of every word, -1 for words of no notice, each text's first word) of a column of texts."""
        raw, offsets = W.column_bytes(batch_text)
        starts, ends, first = W.split(raw, offsets, W.alnum_split())
        hashes = W.word_hashes(raw, starts, ends, W.folded())
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1).astype(np.int32), first

    def of(self, words: list[str]) -> np.ndarray:
        return np.array([self.number[w] for w in words], np.int32)


def places(ids: np.ndarray, first: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Word numbers at which the words of a phrase stand one after another within one text."""
    at = np.flatnonzero(ids[: max(0, len(ids) - len(phrase) + 1)] == phrase[0])
    for j, w in enumerate(phrase[1:], 1):
        at = at[ids[at + j] == w]
    return at[np.searchsorted(first, at, "right") == np.searchsorted(first, at + len(phrase) - 1, "right")]


def document_frequencies(docs: DataFrame, index: Index) -> tuple[int, np.ndarray]:
    """(texts, texts that hold each word of the index), over all rows of docs: one small row a task."""

    def counted(stream):
        n, holds = 0, np.zeros(len(index.words), np.int64)
        for batch in W.batches(stream, 1 << 16, 4 << 20):
            ids, first = index.numbers(batch.column("text"))
            known = np.flatnonzero(ids >= 0)
            doc = np.searchsorted(first, known, "right")
            holds += np.bincount(np.unique(doc * len(holds) + ids[known]) % len(holds), minlength=len(holds))
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(holds)), pa.int32()), pa.array(np.append(n, holds), pa.int64())], ["word", "n"])

    total = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(counted, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = dict(total.collect())  # a row for each word of the index
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(len(index.words))])


def notice_places(ids: np.ndarray, first: np.ndarray, text: np.ndarray, must: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts, word numbers at which the notice begins, shares of its words found there) of confirmed notices in a column of texts."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    confirmed = [places(ids, first, p) for p in must]
    if any(not len(x) for x in confirmed):
        return none
    texts = np.arange(len(first) - 1)
    for x in confirmed:  # only texts that hold all mandatory phrases
        texts = np.intersect1d(texts, np.searchsorted(first, x, "right") - 1)
    mine = np.zeros(len(first) - 1, bool)
    mine[texts] = True
    own = np.isin(ids, text)
    at = np.flatnonzero(own)
    doc = np.searchsorted(first, at, "right") - 1
    at, doc = at[mine[doc]], doc[mine[doc]]
    kinds = np.unique(text)
    rank = np.empty(len(idf), np.int64)
    rank[kinds[np.lexsort((kinds, -idf[kinds]))]] = np.arange(len(kinds))
    # the RARE rarest of the notice's words that each text holds
    held = np.unique(doc * len(kinds) + rank[ids[at]])
    nth = np.arange(len(held)) - np.searchsorted(held // len(kinds), held // len(kinds))
    rare = np.isin(doc * len(kinds) + rank[ids[at]], held[nth < RARE])
    at, doc = at[rare], doc[rare]
    votes = [np.stack([doc[x], at[x] - j, np.full(x.sum(), w)]) for j, w in enumerate(text) if (x := ids[at] == w).any()]
    if not votes:
        return none
    doc, begin, _ = np.unique(np.concatenate(votes, axis=1), axis=1)  # a word's vote counts once
    one, n = np.unique(np.stack([doc, begin]), axis=1, return_counts=True)
    doc, begin = one[:, n >= min(AGREE, len(kinds))]
    out = []
    for a in range(0, len(doc), 1 << 14):
        d, b = doc[a : a + (1 << 14)], begin[a : a + (1 << 14)]
        low, high, found = first[d][:, None], first[d + 1][:, None], np.zeros((len(d), len(text)), bool)
        for shift in range(-SHIFT, SHIFT + 1):
            at = b[:, None] + np.arange(len(text)) + shift
            inside = (at >= low) & (at < high)
            found |= inside & (ids[np.clip(at, 0, len(ids) - 1)] == text)
        cover = found.mean(axis=1)
        good = cover >= COVER
        for x, p in zip(confirmed, must):
            lo = np.searchsorted(x, np.maximum(b - SHIFT, first[d]))
            good &= (lo < len(x)) & (x[np.minimum(lo, len(x) - 1)] + len(p) <= np.minimum(b + len(text) + SHIFT, first[d + 1]))
        out.append((d[good], b[good] - first[d][good], cover[good]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else none


def scan(docs: DataFrame, notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, bases (label, n, first, last) and notices (label, start, cover) of each row of docs, from its whole text.

    Words are runs of letters, digits and non-ASCII characters, A-Z
    lower-cased, numbered from 0.  bases counts the places of each phrase that
    the text holds; notices has the best covered place of each notice label
    (ties: the first).  How rare a word is, is counted over all rows first.
    docs needs doc_id and text; other columns are ignored.  Null and empty texts
    have no words; null ids and repeated rows are rows of their own; an empty
    table gives no rows.  Words are compared by 64-bit hashes.
    """
    index = Index(notices, phrases)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, holds = document_frequencies(own, index)
    idf = np.array([math.log((n + 1) / (k + 1)) for k in holds.tolist()])
    bases = [(label, index.of(list(p))) for p, label in index.phrases.items()]
    known = [(label, index.of(text), [index.of(p) for p in must]) for label, text, must in index.notices]
    base_type = pa.list_(pa.struct([("label", pa.string()), ("n", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))
    notice_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("cover", pa.float64())]))

    def rows(stream):
        for batch in W.batches(stream, 1 << 16, 4 << 20):
            ids, first = index.numbers(batch.column("text"))
            based, noticed = [[] for _ in range(batch.num_rows)], [{} for _ in range(batch.num_rows)]
            for label, phrase in bases:
                at = places(ids, first, phrase)
                texts, begin, n = np.unique(np.searchsorted(first, at, "right") - 1, return_index=True, return_counts=True)
                for t, a, k in zip(texts.tolist(), begin.tolist(), n.tolist()):
                    based[t].append({"label": label, "n": k, "first": int(at[a] - first[t]), "last": int(at[a + k - 1] - first[t])})
            for label, text, must in known:
                for t, start, cover in zip(*(x.tolist() for x in notice_places(ids, first, text, must, idf))):
                    best = noticed[t].get(label)
                    if best is None or (-cover, start) < (-best["cover"], best["start"]):
                        noticed[t][label] = {"label": label, "start": start, "cover": cover}
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(based, base_type), pa.array([[x[k] for k in sorted(x)] for x in noticed], notice_type)],
                ["doc_id", "n_words", "bases", "notices"],
            )

    return own.mapInArrow(rows, "doc_id long, n_words long, bases array<struct<label:string,n:long,first:long,last:long>>, notices array<struct<label:string,start:long,cover:double>>")


def digest(found: DataFrame) -> DataFrame:
    """scan() as doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    score is the share of its words that the best covered notice has; a base
    phrase alone gives 0.5, neither gives 0.
    """
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    each = lambda array, name: F.transform(array, lambda x: x[name])
    bare = F.when(F.size("bases") > 0, BARE).otherwise(0.0)
    return found.select(
        "doc_id", "n_words", F.aggregate("bases", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_base"), F.array_min(each("bases", "first")).alias("first_word"),
        F.array_max(each("bases", "last")).alias("last_word"), joined(each("bases", "label")).alias("base_labels"),
        joined(F.concat(each("bases", "label"), each("notices", "label"))).alias("labels"), F.greatest(bare, F.coalesce(F.array_max(each("notices", "cover")), F.lit(0.0))).alias("score"),
    )
