import re
from collections import Counter

import pytest

from tracewright.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, min_docs=3, top=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(lower))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in held.items() if n >= min_docs}

        def shares(some, kept=kept):
            n = Counter(t for d in some for t in d[2] if t in kept)
            return n, {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(kept)) for t in kept}

        _, q = shares(mine)
        groups = {s: shares([d for d in mine if d[1] == s]) for s in {d[1] for d in mine}}
        for source, (n, p) in groups.items():
            pairs = [(-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), other.encode(), other) for other, (_, o) in groups.items() if other != source]
            terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if n[t] and p[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, source, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def audited(spark, rows, **options):
    found = divergence.audit(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "'x' AS term", "2 AS p", "'y' AS item"), **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in found.collect())


def corpus():
    words = "the a of sea Sea élan naïve Ω blue red green one two three four five six 中文 x".split()
    rows = []
    for i in range(160):
        text = " ".join(words[(i * k * k + k) % (7 + i % 12)] + ("," if k % 5 else "-9_") for k in range(i % 23))
        rows.append((i % 150, text, ("en", "de", None)[i % 3], f"s{(i * i) % 7}" if i % 4 else "hot"))
    return [*rows, (1, None, "en", None), (2, "", "xx", "a"), (3, "word", "xx", "b"), (None, "the the", "en", "hot"), *[(9, "same same text", "en", "hot")] * 30, (10, "THE sea " * 4000, "en", "long")]


@pytest.mark.parametrize("sizes", [None, (5, 3, 2)])
def test_equals_plain_version(spark, monkeypatch, sizes):
    """Also with tiny blocks of terms, postings and peers. Such sizes only travel to tasks as part of the functions' module
    in local sessions, so the functions are called in this process for them, below."""
    if sizes:
        monkeypatch.setattr(divergence, "PEERS", sizes[2])
    assert audited(spark, corpus()) == plain(corpus())
    assert audited(spark, corpus(), min_docs=1, top=2) == plain(corpus(), min_docs=1, top=2)


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_blocks_of_postings_add_up(monkeypatch, rows):
    import pyarrow as pa

    table = pa.table({
        "lang": ["a"] * 7 + ["b"] * 2, "source": ["x", "y", "z", "x", "y", "x", "z", "x", "y"],
        "p": [50, 30, 20, 9, 8, 400, 2, 7, 5], "floor": [3, 2, 4, 3, 2, 3, 4, 1, 2], "opens": [True, False, False, True, False, True, False, True, False],
    })
    sums = Counter()
    monkeypatch.setattr(divergence, "BLOCK_ROWS", rows)
    for batch in divergence._scatter(iter(table.to_batches(max_chunksize=2))):
        for r in batch.to_pylist():
            sums[r["lang"], r["source"], r["item"]] += r["value"]
    f = lambda p, q: (p - q) ** 2 // q
    want, starts = Counter(), [0, 3, 5, 7, 9]
    held = table.to_pylist()
    for start, end in zip(starts, starts[1:], strict=False):
        for a in held[start:end]:
            for b in held[start:end]:
                if a is not b:
                    want[a["lang"], a["source"], b["source"]] += f(a["p"], b["p"]) - f(a["p"], b["floor"]) - f(a["floor"], b["p"]) + f(a["floor"], b["floor"])
    assert {k: v for k, v in sums.items() if v} == {k: v for k, v in want.items() if v}


def test_language_without_kept_terms_and_single_source(spark):
    rows = [(1, "one", "en", "a"), (2, "two", "en", "b"), (3, "alone", "fr", "c"), (4, None, None, None)]
    assert audited(spark, rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)] == plain(rows)


def test_ties_follow_bytes_and_empty_table(spark):
    rows = [(i, "ω z é a" if s == "a" else "b c d e", "en", s) for s in "ab" for i in range(3)]
    found = [r for r in audited(spark, rows) if r[2] == "term" and r[1] == "a"]
    assert [r[3] for r in sorted(found, key=lambda r: r[5])] == ["a", "z", "é", "ω"] and len({r[4] for r in found}) == 1
    assert audited(spark, []) == []


def test_counts_are_handed_on_in_parts(monkeypatch, spark):
    rows = corpus()
    want = sorted(map(tuple, divergence.term_counts(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    assert sorted(map(tuple, divergence.term_counts(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == want
