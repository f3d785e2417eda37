import hashlib
import os
import sys

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
sys.path.insert(0, os.path.dirname(__file__))

from test_decontaminate import plain_report  # noqa: E402
from test_near import plain_groups  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from tracewright.llm import pii, quality  # noqa: E402
from tracewright.llm.common import read  # noqa: E402
from tracewright.llm.queries import vocabulary  # noqa: E402

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def plain_accepts(text, weights):
    """Score of one text, feature by feature."""
    _, buckets, values = quality.features([text or ""], (len(weights) - 1).bit_length() - 1)
    return 1 / (1 + np.exp(-(sum(weights[b] * v for b, v in zip(buckets, values, strict=True)) + weights[-1]))) >= 0.5


@needs_tables
def test_run_equals_plain_version(spark):
    docs = read(spark, SF, "documents")
    weights = quality.train(docs, quality.marks(read(spark, SF, "labels")))
    rows = {r.doc_id: r for r in docs.collect() if plain_accepts(r.text, weights)}
    firsts = plain_groups([(i, r.text) for i, r in rows.items()])
    rows = {i: r for i, r in rows.items() if firsts[i] == i}
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    dirty = {r[0] for r in plain_report([(i, r.text) for i, r in rows.items()], items) if r[5]}
    texts = {i: pii.redacted(r.text or "", pii.find_spans(r.text)) for i, r in rows.items() if i not in dirty}
    tokenizer = Tokenizer.from_file(vocabulary())
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: r.ids for i, r in found.items()} == want
    assert all(r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() for i, r in found.items())
    assert 0 < len(want) < docs.count()


@needs_tables
@pytest.mark.parametrize("stage", [s[1] for s in corpus_pipeline.STAGES[:-1]], ids=[s[0] for s in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_bear_odd_rows(spark, documents, stage):
    odd = documents([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "word " * 50_000), (None, "mail a@b.cc"), (10**6 + 3, "good day"), (10**6 + 3, "good day")])
    docs = read(spark, SF, "documents").limit(40).unionByName(odd).selectExpr("*", "1 AS score", "'x' AS spans", "2 AS digest", "3 AS fp")
    kept = stage(spark, docs, SF)
    assert kept.dtypes == docs.dtypes
    assert {(r.spans, r.digest) for r in kept.select("spans", "digest").collect()} == {("x", 2)}
    assert stage(spark, docs.limit(0), SF).count() == 0


@needs_tables
def test_redaction_changes_only_documents_with_spans(spark, documents):
    docs = documents([(1, "mail a@b.cc now"), (2, "clean"), (3, None)])
    found = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.personal_data(spark, docs, SF).collect()}
    assert found == {1: ("mail [EMAIL] now", 16), 2: ("clean", 5), 3: (None, 0)}
