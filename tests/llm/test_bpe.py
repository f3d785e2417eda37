import hashlib
import os
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tracewright.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", " ", "  ", "\n", "\t", "é", "'s", "'", "1", "23", "　", "\xa0", "漢", "<|endoftext|>", "<|endof", ".", "!", "\x85", "\x1c", "²", "😀", "the ", " of"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def test_chunked_encoding_equals_the_library(reference):
    rng = random.Random(5)
    for bits in (1, 2, 4):
        encoder = bpe.Encoder(PATH, bits)
        for _ in range(1500):
            text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 90)))
            assert encoder.encode(text) == reference.encode(text, add_special_tokens=False).ids
    assert encoder.reused > 0


def test_latin_text_equals_the_library(reference):
    rng, encoder = random.Random(6), bpe.Encoder(PATH)
    assert encoder.latin is not None
    vocabulary = sorted(t for t in reference.get_vocab() if t.isalpha())
    pools = [[chr(c) for c in range(256)], list("abcdeéüß \n'"), vocabulary[:: len(vocabulary) // 3000], list("etaoinshr ")]
    for number in range(20_000):
        text = "".join(rng.choice(pools[number % 4]) for _ in range(rng.randint(0, 60)))
        assert encoder.whole(text) == reference.encode(text, add_special_tokens=False).ids, repr(text)


def test_shared_passages_are_encoded_once():
    rng = random.Random(1)
    words = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    encoder = bpe.Encoder(PATH)
    encoder.encode(words)
    before = encoder.encoded
    encoder.encode("a new head. " + words + " and a new tail")
    assert before > 20
    assert encoder.encoded - before <= 4


def test_query_rows(spark, documents, reference):
    rows = [(1, "Hello there, hello there."), (2, None), (3, ""), (4, "é" * 5000), (5, "x" * 20_000), (1, "Hello there, hello there."), (None, "end <|endoftext|> of")]
    found = bpe.encode(documents(rows), PATH)
    got = sorted(tuple(map(str, (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256))) for r in found.collect())
    want = []
    for i, text in rows:
        ids = reference.encode(text or "", add_special_tokens=False).ids
        want.append(tuple(map(str, (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()))))
    assert got == sorted(want)
    back = bpe.decode(found.where("doc_id > 1"), PATH).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in rows if i and i > 1}
    assert bpe.encode(documents([]), PATH).count() == 0


def test_other_kinds_of_tokenizer_are_encoded_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    text = "Some Text  with\nlines and words " * 200
    assert bpe.Encoder(path).encode(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert os.path.exists(path)
