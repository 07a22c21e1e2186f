import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from progcorpus.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_encoder_equals_library_on_edge_texts(library):
    rnd = random.Random(7)
    texts = ["", " ", "\n\n \t x", "a<|endoftext|>b <|endoftext|", "<|endoftext|><|endoftext|>", "don't we'll I'D", "é" * 300,
             "a" * 5000, "ab" * 3000, "0" * 777, "=" * 1000 + "-" * 999, "日本語テキスト" * 40, "👍🏽👩‍👩‍👧" * 30, "​ 　 x\u0085y\x1cz",
             "  leading", "trailing   ", "١٢٣ ½ Ⅻ ²", "é" * 20]
    texts += ["".join(chr(rnd.choice([rnd.randrange(1, 128), rnd.randrange(1, 0x800), rnd.randrange(0x800, 0xD800),
                                      rnd.randrange(0x10000, 0x20000)])) for _ in range(rnd.randrange(200))) for _ in range(300)]
    encoder = bpe.Encoder(bpe.Vocabulary(PATH))
    for t, got in zip(texts, encoder.encode(texts)):
        want = library.encode(t, add_special_tokens=False).ids
        assert got.tolist() == want, repr(t[:40])
        assert bpe.decode_ids(encoder.v.bytes, want) == library.decode(want, skip_special_tokens=False)


def test_every_code_point_class(library):
    """The pattern's classes agree with the library's on every code point."""
    encoder = bpe.Encoder(bpe.Vocabulary(PATH))
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1 {chr(c)}" for c in points[i:i + 512]) for i in range(0, len(points), 512)]
    for t, got in zip(texts, encoder.encode(texts)):
        want = library.encode(t, add_special_tokens=False).ids
        assert got.tolist() == want, [hex(ord(x)) for x in t[1:2]]


def test_long_and_short_paths_agree():
    encoder = bpe.Encoder(bpe.Vocabulary(PATH))
    words = [b"thbleering", b"aaaaaaaaaa", b"ab" * 20, b"the", b"x", "éè".encode() * 5]
    assert encoder._matrix(words) == [encoder._single(w) for w in words]


def test_queries(docs_of, sf_docs, library):
    rows = [(1, None), (2, ""), (2, "same"), (2, "same"), (None, "null id"), (5, "b " * 20000)]
    docs = docs_of(rows).withColumnRenamed("lang", "ids")
    got = sorted(map(tuple, bpe.encode_digest(docs, PATH).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(back.encode())))
    assert got == sorted(want, key=str)
    texts = {r.doc_id: r.text for r in sf_docs.collect()}
    tokens = bpe.encode(sf_docs, PATH)
    assert {r.doc_id: r.ids for r in tokens.collect()} == {
        i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    assert {r.doc_id: r.text for r in bpe.decode(tokens, PATH).collect()} == texts
    assert bpe.encode_digest(sf_docs.limit(0), PATH).collect() == []
    assert bpe.decode(tokens.selectExpr("doc_id", "cast(null as array<int>) ids").limit(1), PATH).first().text == ""
