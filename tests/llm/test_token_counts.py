import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tracewright.llm import token_counts  # noqa: E402

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pieces_of(n):
    def starts(text):  # pickled by value, so workers need not import this file
        return np.arange(0, len(text), n)

    return starts


def cut(text, starts):
    if starts is not token_counts.line_starts:
        return [text[i : i + 5] for i in range(0, len(text), 5)]
    lines = [part + "\n" for part in text.split("\n")]
    lines[-1] = lines[-1][:-1]
    return [line for line in lines if line]


def plain_counts(text, starts):
    """Token by token over characters."""
    encoding, _ = token_counts._encoding(PATH, PATTERN)
    lines = cut(text, starts)
    owner = [i for i, line in enumerate(lines) for _ in line]
    at = [c for c, char in enumerate(text) for _ in char.encode()]
    counts, byte = [0] * len(lines), 0
    for token in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(token))
        held = [owner[c] for c in sorted(set(at[byte : byte + size]))]
        counts[max(sorted(set(held)), key=held.count)] += 1
        byte += size
    return [(i, len(line), n) for i, (line, n) in enumerate(zip(lines, counts, strict=True))]


@pytest.mark.parametrize("starts", [token_counts.line_starts, pieces_of(5)])
def test_equals_plain_version(spark, documents, starts):
    rng = random.Random(9)
    pieces = ["word ", "é", "\n", "\n\n", "\n\n\n\n", " ", "x", "漢字", "😀", ".\n", "<|endoftext|>", "\r\n", "  \n  "]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 60)))) for i in range(120)]
    found = token_counts.by_section(documents([*rows, (900, None), (901, "")]), PATH, PATTERN, starts=starts).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.section)):
        got.setdefault(r.doc_id, []).append((r.section, r.n_chars, r.n_tokens))
    assert got == {i: plain_counts(t, starts) for i, t in rows}
    assert sum(r.n_crossing for r in found) > 0


def test_ties_go_to_the_earliest_section():
    owner, crossing = token_counts.allocate(np.array([0, 2, 4]), np.array([2, 4, 9]), np.array([0, 3, 5]), 9)
    assert owner.tolist() == [0, 0, 2]
    assert crossing.tolist() == [False, True, True]


def test_repeated_rows_and_no_rows(spark, documents):
    rows = [(1, "a\nb"), (1, "a\nb"), (None, "c")]
    assert token_counts.by_section(documents(rows).selectExpr("*", "1 AS section"), PATH, PATTERN).count() == 5
    assert token_counts.by_section(documents([]), PATH, PATTERN).count() == 0
