"""Filter audit, licence scan and spelling variants against plain loops."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import audit, licences, spelling
from strandloom.llm import words as W

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE, ALNUM, LETTERS = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile("[A-Za-zÀ-ÿ]+")
CLASH = "doc_id long, text string, lang string, source string, n_chars long, mask int, part string, same string, n long, word string, label string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 7, "p", "s", 3, "w", "l") for i, t, s in rows], CLASH)


def expect_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    masks = []
    for i, t, s in rows:
        t = t or ""
        w = SPACE.findall(t)
        fails = {x for x, bad in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t))) if bad}
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            fails.add("E")
        masks.append((i, s or "", fails))
    out = []
    for part in {m[1] for m in masks}:
        own, removed_all, lines = [m for m in masks if m[1] == part], Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [m for m in left if x in m[2]]
                left = [m for m in left if x not in m[2]]
                removed_all[x] += len(gone)
                lines.append((x, part, "".join(order), step, len(left), len(gone), sum(x in m[2] for m in own) - len(gone), sum(m[2] == {x} for m in own), sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone)))
        out += [(*line[1:], removed_all[line[0]]) for line in lines]
    return sorted(out)


def test_audit(spark, odd):
    many = " ".join(f"w{i}" for i in range(250))
    rows = [(i, t, ["a", None, "b"][k % 3]) for k, (i, t) in enumerate(odd)] + [(20, many, "a"), (21, many, "b"), (21, many, "b"), (19, many, "a"), (None, many, "a"), (22, many.upper(), "b"), (23, many + " #", None), (24, "x y " * 150, "a")]
    labels = [(20, 1, 0), (21, 1, 1), (21, 0, 0), (22, None, 1), (None, 1, 1), (2, 1, None)]
    own = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.filter_audit(clashing(spark, rows), own)
    assert sorted(map(tuple, got.collect())) == expect_audit(rows, labels)
    assert audit.filter_audit(clashing(spark, []), own).count() == 0
    assert sorted(map(tuple, audit.filter_audit(clashing(spark, rows), own.limit(0)).collect())) == expect_audit(rows, [])


def test_potentials(spark):
    """The glove game: one left glove, two right ones; 6 times the Shapley values are 4, 1, 1."""
    value = [int(bool(s & 1) and s >> 1 > 0) for s in range(8)]
    p = spark.range(1).selectExpr(f"transform(array({','.join(map(str, value))}), x -> cast(x as bigint)) as v").select(audit.potentials("v", 3)).first()[0]
    assert [p[7] - p[7 - b] for b in (1, 2, 4)] == [4, 1, 1]


def expect_licences(text, holds, n):
    ws = ALNUM.findall((text or "").translate(UP))
    find = lambda p, lo=0, hi=None: [a for a in range(lo, (len(ws) if hi is None else hi) - len(p) + 1) if ws[a : a + len(p)] == p]
    at = {label: find(p.split()) for p, label in licences.PHRASES.items()}
    spots = sorted(a for v in at.values() for a in v)
    base = {label for label, v in at.items() if v}
    best = {}
    for label, notice, must in licences.NOTICES:
        t = notice.split()
        if not all(find(p.split()) for p in must):
            continue
        mine = sorted({w for w in t if w in ws}, key=lambda w: (holds[w], w))[: licences.RARE]
        for b in range(-len(t), len(ws)):
            agree = {w for j, w in enumerate(t) if w in mine and 0 <= b + j < len(ws) and ws[b + j] == w}
            if len(agree) < min(licences.AGREE, len(set(t))):
                continue
            cover = np.mean([any(0 <= b + j + s < len(ws) and ws[b + j + s] == w for s in range(-licences.SHIFT, licences.SHIFT + 1)) for j, w in enumerate(t)])
            lo, hi = max(0, b - licences.SHIFT), min(len(ws), b + len(t) + licences.SHIFT)
            if cover >= licences.COVER and all(find(p.split(), lo, hi) for p in must):
                best[label] = max(best.get(label, 0), cover)
    score = max([licences.BARE if base else 0, *best.values()])
    return len(ws), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(best))), round(score, 9)


def test_licences(spark, odd):
    notices = [n[1] for n in licences.NOTICES]
    texts = [t for _, t in odd] + notices + [
        "x " * 40 + notices[3].title() + ". More text; CC-BY!", "MIT License mit license MIT-LICENSE", "gnu general public\nlicense" + " z" * 9, "licensed under some other license version 3 of the gnu",
        notices[9].replace("obtaining", "who obtains") + " " + notices[1], "this program, Foo, is free software " + " ".join(notices[5].split()[5:]), notices[10].replace("modify", ""), "cc by nc 4 0", "Licence MIT", " ".join(notices) * 3,
    ]
    rows = [(None if k % 9 == 0 else k, t, "s") for k, t in enumerate(texts)]
    held = [set(ALNUM.findall((t or "").translate(UP))) for t in texts]
    holds = defaultdict(int, Counter(w for s in held for w in s))
    got = Counter((r.doc_id, *r[1:7], round(r.score, 9)) for r in licences.digest(licences.scan(clashing(spark, rows))).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect())
    assert got == Counter((i, *expect_licences(t, holds, len(texts))) for i, t, _ in rows)
    assert licences.digest(licences.scan(clashing(spark, []))).count() == 0
    assert all(n[0] in dict(zip(texts, (expect_licences(t, holds, 1)[5] for t in texts)))[n[1]] for n in licences.NOTICES)


def expect_spelling(rows, often=3):
    count = Counter()
    for i, t in rows:
        for w in LETTERS.findall((t or "").translate(UP)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += len(w) >= 5
    n = {w: k for w, k in count.items() if k >= often}
    near = {w: set() for w in n}
    by = defaultdict(set)
    for w in n:
        for j in range(len(w)):
            by[w[:j], w[j + 1 :]].add(w)
    for (a, b), v in by.items():
        for w in v | ({a + b} & n.keys()):
            near[w] |= v - {w}
            if w == a + b:
                for x in v:
                    near[x].add(w)
    form = {w: b for w in n if near[w] and n[b := min(near[w], key=lambda x: (-n[x], x))] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n), key=str)


def test_spelling_of_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = expect_spelling([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sum(w[1] is not None for w in want) > 1000
    assert sorted(map(tuple, spelling.spelling_groups(docs).collect()), key=str) == want


def test_spelling(spark, odd):
    chain = ["abcdef", "abcdeg", "abcdgg", "abcggg", "abgggg", "aggggg"]  # forms that lead from one to the next
    text = " ".join(w for k, w in enumerate(chain) for _ in range(3 << k))
    rows = odd + [(30, text), (31, "Été été ÉTÉ été-là naïve naive naïfe " * 7), (32, "aabbc aabc abbcc aabbbc " * 5), (33, "x" * 70000 + " " + "x" * 69999), (34, ("x" * 70000 + " " + "x" * 69999 + " ") * 3)]
    want = expect_spelling(rows)
    got = spelling.spelling_groups(clashing(spark, [(*r, "s") for r in rows]))
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {w[0]: w[2] for w in want}["abcdef"] == "aggggg"
    assert spelling.spelling_groups(clashing(spark, [])).count() == 0
    assert spelling.spelling_groups(clashing(spark, [(1, "", "s"), (2, None, "s")])).count() == 0


def test_signatures_reach_every_edit():
    """Each single edit of a word leaves a signature in common, for letters of one and two bytes."""
    base = ["spelling", "aabbaab", "éàüôâêî", "qqqqqqq", "abcdé"]
    for word in base:
        edits = {word[:j] + c + word[j + k :] for j in range(len(word) + 1) for c in ("", "a", "é", "z", word[0]) for k in (0, 1)} - {word}
        for other in edits:
            if abs(len(other) - len(word)) + (len(other) == len(word)) != 1:
                continue
            short, long = sorted((word, other), key=lambda x: (len(x), x))
            sigs = [set(next(spelling._signatures(side)(iter([pa.RecordBatch.from_arrays([pa.array([w]), pa.array([1])], ["word", "n"])]))).column("sig").to_pylist()) for side, w in ((False, short), (True, long))]
            assert sigs[0] & sigs[1], (word, other)


def test_crc():
    words = ["", "a", "été", "x" * 300, "word"]
    raw, offsets = W.column_bytes(pa.array(words))
    heads = np.array([zlib.crc32(f"{i}:".encode()) for i in range(5)], np.uint32)
    assert spelling.crc_after(heads, raw, offsets[:-1], offsets[1:]).tolist() == [zlib.crc32(f"{i}:{w}".encode()) for i, w in enumerate(words)]


@pytest.mark.parametrize("name", ["op12_license_scan", "op13_spelling_variants"])
def test_schemas(spark, name):
    from strandloom.llm import queries

    want = {"op12_license_scan": "doc_id:bigint,n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double", "op13_spelling_variants": "word:string,form:string,root:string,n:bigint,n_near:bigint,form_n:bigint"}
    assert ",".join(f"{a}:{b}" for a, b in queries.QUERIES[name](spark, "/root/testdata/sf0.001").dtypes) == want[name]
