import math
import os

import numpy as np
import pytest

from tracewright.llm import neighbours
from tracewright.llm.common import read

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, every=50, k=5):
    good = [(n, i, np.array(v, dtype=np.float32).astype(float)) for n, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, i, a in good:
        if i is not None and i % every == 0:
            near = [(-float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), math.inf if j is None else j, m, j) for m, j, b in good if m != n and len(a) == len(b)]
            out += [(i, rank, j, round(-score, 6)) for rank, (score, _, _, j) in enumerate(sorted((round(s, 12), x, m, j) for s, x, m, j in near)[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, schema=SCHEMA, **options):
    df = neighbours.nearest(spark.createDataFrame(rows, schema).selectExpr("*", "1 AS id", "2 AS bucket", "3 AS `row`"), **options)
    return sorted(((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in df.collect()), key=str)


def cloud(n=600, dims=12, seed=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(30, dims))
    return [(i, (middle[i % 30] + rng.normal(size=dims) * 0.2).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("hashes,chunk_rows", [(1, 4096), (2, 4096), (1, 20)])
def test_all_buckets_are_exact(spark, hashes, chunk_rows):
    assert found(spark, cloud(), hashes=hashes, recall=1.0, chunk_rows=chunk_rows, every=10, sample_queries=1000) == plain(cloud(), 10)


@pytest.mark.parametrize("hashes", [1, 2])
def test_recall_of_fitted_probes(spark, hashes):
    rows = cloud(2000)
    mine, true = ({(q, v) for q, _, v, _ in x} for x in (found(spark, rows, hashes=hashes, every=5, sample_queries=40), plain(rows, 5)))
    assert len(mine & true) >= 0.9 * len(true)
    spark_rows = neighbours.index(spark.createDataFrame(rows, SCHEMA), 4, hashes, 5)
    queries = spark_rows.where("id % 5 = 0").select("row", "id", "dim", "vector")
    probes = neighbours.fitted_probes(spark_rows, queries, 4, hashes, 5, 5, 0.96, 40)
    assert probes < 0.5 * (2 * 16) ** hashes  # not every bucket


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, table):
    if not os.path.isdir(f"/root/testdata/{table}"):
        pytest.skip("test data not present")
    vectors = read(spark, f"/root/testdata/{table}", "embeddings")
    true = plain([(r.vec_id, r.embedding) for r in vectors.collect()])
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in neighbours.nearest(vectors).collect()]
    assert len(got) == len(true) and len({r[::2] for r in got} & {r[::2] for r in true}) >= 0.9 * len(true)
    scores = {(q, v): s for q, _, v, s in true}
    assert all(abs(s - scores[q, v]) < 2e-6 for q, _, v, s in got if (q, v) in scores)


def test_copies_ties_and_missing_ids(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(80, 0, -1)] + [(None, [1.0, 2.0, 3.0])] * 3 + [(0, [1.0, 2.0, 3.0]), (0, [2.0, 4.0, 6.0])] + [(200 + i, [-1.0, 0.5, float(i)]) for i in range(1, 9)]
    assert found(spark, rows, chunk_rows=16) == plain(rows)


def test_vectors_that_take_no_part_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 1.0]), (6, [-1.0, 0.1]), (7, []), (50, [1.0, 1.0, 1.0]), (100, None), (150, [0.0, 0.0])]
    assert found(spark, rows) == plain(rows) == [(0, 1, 6, round(-1 / math.sqrt(1.01), 6))]


def test_queries_that_find_too_few_are_looked_up_everywhere(spark):
    """Single buckets hold fewer than five rows here."""
    rng = np.random.default_rng(8)
    rows = [(i * 50, v.tolist()) for i, v in enumerate(rng.normal(size=(9, 32)))]
    assert found(spark, rows, recall=0.01, tables=1) == plain(rows)


def test_no_rows_no_queries_and_huge_numbers(spark):
    assert found(spark, []) == [] and found(spark, [(3, [1.0]), (4, [2.0])]) == []
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [1e300, 0.0])]
    assert [(r[0], r[2]) for r in found(spark, rows, "vec_id long, embedding array<double>")] == [(0, 1), (0, 2)]
