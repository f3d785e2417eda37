import hashlib
import random
import re

import pytest

from tracewright.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_report(docs, items):
    out = []
    for i, text in docs:
        words, hit, ids = plain_words(text), set(), set()
        for item, passage in items:
            other = plain_words(passage)
            n = min(10, len(other))
            for p in range(len(other) - n + 1) if n and item is not None else ():
                for q in range(len(words) - n + 1):
                    if words[q : q + n] == other[p : p + n]:
                        hit |= set(range(q, q + n))
                        ids.add(str(item))
        out.append((i, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows():
    rng = random.Random(11)
    vocabulary = ["Alpha", "beta", "é", "Ünder", "x1", "2", "gamma-delta", "ω"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(10, 25))) for i in range(6)] + [(20, text(4)), (21, "single"), (22, text(9)), (23, None), (24, ""), (25, "!?"), (None, "alpha beta"), (2, text(12))]
    docs = [(i, text(rng.randint(0, 40))) for i in range(20)]
    for i in range(12):
        passage = plain_words(items[i % 9][1]) if items[i % 9][1] else []
        start = rng.randint(0, max(0, len(passage) - 12))
        docs.append((100 + i, text(rng.randint(0, 9)) + ". " + ", ".join(passage[start : start + rng.randint(8, 14)]).upper().replace("É", "é") + " - " + text(5)))
    return docs + [(200, None), (201, ""), (202, "..."), (203, items[0][1]), (203, items[0][1]), (None, items[0][1]), (204, "pad " * 30_000 + items[1][1] + " pad" * 30_000)], items


@pytest.mark.parametrize("filter_rows", [1_000_000, 3])
def test_equals_plain_version(spark, documents, filter_rows):
    docs, items = rows()
    found = decontaminate.report(documents(docs), spark.createDataFrame(items, "item_id long, text string"), filter_rows=filter_rows)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()), key=str)
    assert got == plain_report(docs, items)
    assert any(r[5] for r in got)
    assert not all(r[5] for r in got)


def test_every_run_of_ten_words_shares_a_fingerprint():
    rng = random.Random(2)
    for _ in range(300):
        run = [f"v{rng.randint(0, 30)}" for _ in range(10)]
        sides = []
        for _ in range(2):
            around = [f"u{rng.randint(0, 99)}" for _ in range(20)]
            hashes, counts = decontaminate._word_hashes([" ".join(around[: rng.randint(0, 9)] + run + around[10:])])
            sides.append(set(next(decontaminate.fingerprints(hashes, counts, (), 10, 4))[1].tolist()))
        assert sides[0] & sides[1]


def test_clashing_columns_and_empty_tables(spark, documents):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = documents([(1, "one two three four five six seven eight nine ten eleven"), (2, "clean"), (3, None)])
    for name in ("digest", "fp", "row", "items", "n_words", "item_id"):
        docs = docs.withColumnRenamed("source", "source").selectExpr("*", f"'q' AS {name}")
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == 3
    assert decontaminate.report(documents([]), items).count() == 0
