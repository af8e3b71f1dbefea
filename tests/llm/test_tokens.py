"""Token files: exact round trip through ORC, and the encoder against the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from strandloom.llm import runtime, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [0]


def test_encoder(library):
    r = random.Random(1)
    encode = tokens.encoder(PATH)
    texts = ["<|endoftext|> a b<|endoftext|>", "x<|endoftext|>. y", "it's, don't. a,b. 's. x..", "A!! B!!\nc*** d", "\x1c a b\x1c c", "\x85 a \x85 b", "ñé, ß. 中文。 中文, a"]
    texts += ["".join(r.choice(" \n\t.,'sté中a1! ") for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for text, got in zip(texts, encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == ids(library, text), repr(text)


def test_round_trip(spark, make, odd, library):
    rows = [(i, t) for i, t in odd]
    out = runtime.scratch(spark, "tokens-test")
    tokens.write_tokens(make(rows).repartition(3), out, PATH)
    stored = tokens.read_tokens(spark, out).collect()
    assert sorted(map(tuple, ((r.doc_id, tuple(r.tokens)) for r in stored)), key=str) == sorted(((i, tuple(ids(library, t))) for i, t in rows), key=str)
    table = tokens.token_table(spark, out).collect()
    order = sorted(table, key=lambda r: r.start)
    assert [r.doc_id for r in order if r.doc_id is not None] == sorted(i for i, _ in rows if i is not None) and order[0].doc_id is None
    at = 0
    for r in order:
        assert r.start == at
        at += r.n_tokens
    want = sorted((str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in rows for x in [ids(library, t)])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in table) == want
    plan = tokens.read_tokens(spark, out).filter("doc_id = 5")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,5)" in plan and tokens.read_tokens(spark, out).filter("doc_id = 5").count() == 1


def test_empty(spark, make):
    out = runtime.scratch(spark, "tokens-test")
    tokens.write_tokens(make([]), out, PATH)
    assert tokens.token_table(spark, out).count() == 0
