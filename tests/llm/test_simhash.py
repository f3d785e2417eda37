import random

import numpy as np
import pytest
import xxhash

from tracewright.llm import simhash


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    head = {i: i for i in prints}

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = root(a), root(b)
                head[max(x, y)] = min(x, y)
    return {i: root(i) for i in prints}


@pytest.mark.parametrize("text", ["", None, " \t\n", "One", "one two", "One two THREE", "a b c d e f g " * 9, "Ä ä\x0bB\x1cc x y", "word " * 40_000])
def test_fingerprint_equals_plain_version(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text if text is None or len(text) < 1000 else text)


def test_components_equal_plain_version(spark, documents):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    rows += [(100 + i, " ".join(["x"] * 300 + [rng.choice(words)])) for i in range(40)]  # near copies
    rows += [(200, None), (201, ""), (202, rows[5][1]), (203, rows[5][1])]
    found = {r.doc_id: r for r in simhash.report(documents(rows)).collect()}
    prints = {i: simhash.fingerprint(t) for i, t in rows}
    assert {i: r.fingerprint for i, r in found.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in found.items()} == plain_components(prints)


@pytest.mark.parametrize("size", [40, 400])
def test_links_of_long_and_short_lists(spark, size):
    """Fingerprints that vary in two bytes only fill one posting list."""
    rng = np.random.default_rng(size)
    low = rng.choice(1 << 12, size, replace=False)
    fps = [int(v & 0xFF) | int(v >> 8) << 56 for v in low]
    rows = [(fp - (1 << 64) if fp >> 63 else fp, i) for i, fp in enumerate(fps)]
    found = {(r.a, r.b) for r in simhash.links(spark.createDataFrame(rows, "fp long, rep long")).collect()}
    assert found == {(i, j) for i in range(size) for j in range(i + 1, size) if (fps[i] ^ fps[j]).bit_count() <= 2}


def test_repeated_rows_missing_ids_and_no_rows(spark, documents):
    rows = [(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (3, "a b c d"), (None, "other words stand here alone")]
    found = sorted(((r.doc_id, r.component_id) for r in simhash.report(documents(rows)).collect()), key=str)
    assert found == [(3, 3), (7, 3), (7, 3), (None, 3), (None, None)]
    kept = simhash.deduplicated(documents(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "None", "None"]
    assert simhash.report(documents([])).count() == 0


def test_components_of_a_long_path(spark):
    from tracewright.llm.common import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    found = {r.id: r.component_id for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
