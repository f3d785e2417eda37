import random
from zlib import crc32

import numpy as np
import pytest

from tracewright.llm import quality


def plain_learn(texts, labels, bits, passes, alpha, beta, l1, l2):
    """The update one number at a time."""
    z, n = {}, {}

    def weight(i):
        s = z.get(i, 0.0)
        return 0.0 if abs(s) <= l1 else -(s - np.sign(s) * l1) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    vectors = []
    for text in texts:
        _, buckets, values = quality.features([text], bits)
        vectors.append([*zip(buckets.tolist(), values.tolist(), strict=True), (1 << bits, 1.0)])
    for _ in range(passes):
        for x, y in zip(vectors, labels, strict=True):
            w = {i: weight(i) for i, _ in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x)))
            for i, v in x:
                g = (p - y) * v
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def corpus(n=400):
    rng, rows, labels = random.Random(8), [], []
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "and"]
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(5, 40))).capitalize() + "."
        good = rng.random() < 0.7
        rows.append((i, text if good else text.upper().replace(" ", "!! ")))
        labels.append((i, int(good), 0))
    return rows, labels


def test_learning_equals_plain_version():
    rows, labels = corpus(60)
    texts, marks = [t for _, t in rows], np.array([m[1] for m in labels], dtype=float)
    options = {"bits": 12, "passes": 2, "alpha": 0.5, "beta": 1.0, "l1": 0.01, "l2": 0.1}
    found, want = quality.learn(texts, marks, **options), plain_learn(texts, marks, **options)
    assert np.allclose(found, [want.get(i, 0.0) for i in range(len(found))])


def test_unit_vectors_do_not_depend_on_the_block():
    texts = ["One two two.", "", "é É x", "!!", "a" * 50_000]
    rows, buckets, values = quality.features(texts, 14)
    for i, text in enumerate(texts):
        alone = quality.features([text], 14)
        assert buckets[rows == i].tolist() == alone[1].tolist()
        assert np.allclose(values[rows == i], alone[2])
        assert not len(alone[2]) or np.isclose((alone[2] ** 2).sum(), 1)


def test_held_out_accuracy_and_edges(spark, documents):
    rows, labels = corpus()
    marks = spark.createDataFrame([*labels, *labels[:5], (9999, 1, 0), (3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = documents([*rows, (500, None), (501, ""), (None, "alpha beta"), rows[0]])
    found = quality.report(docs, marks).collect()
    assert len(found) == len(rows) + 4
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    truth = {i: q for i, q, _ in labels}
    held = [r.predicted == truth[r.doc_id] for r in found if r.held_out and r.doc_id in truth]
    assert np.mean(held) > 0.97


@pytest.mark.parametrize("labelled", [True, False])
def test_accepted_keeps_columns(spark, documents, labelled):
    rows, labels = corpus(120)
    marks = spark.createDataFrame(labels if labelled else [], "doc_id long, quality int, toxic int")
    docs = documents(rows).selectExpr("*", "7 AS score", "8 AS label")
    kept = quality.accepted(docs, marks)
    assert kept.dtypes == docs.dtypes
    truth = {i for i, q, _ in labels if q}
    ids = {r.doc_id for r in kept.collect()}
    assert (len(ids ^ truth) <= 4) if labelled else (len(ids) == 120)
    assert quality.accepted(documents([]), marks).count() == 0
