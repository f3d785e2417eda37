import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from tracewright.llm import centroids

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k, rounds, dims, scale=256):
    good = lambda v: v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if good(v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    middle = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(middle))

    for _ in range(rounds):
        members = [nearest(v)[1] for _, v in kept]
        for n in set(members):
            mine = [v for (_, v), m in zip(kept, members, strict=True) if m == n]
            middle[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    placed = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in placed:
        inertia[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), digest[n]) for i, d, n in placed), key=str)


def found(spark, rows, schema=SCHEMA, **options):
    df = centroids.clusters(spark.createDataFrame(rows, schema).selectExpr("*", "1 AS id", "2 AS cluster", "3 AS `values`"), **options)
    return sorted((tuple(r) for r in df.collect()), key=str)


def cloud(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, dims))
    return [(i, (middle[i % 6] + rng.normal(size=dims) * 0.4).tolist()) for i in range(n)]


@pytest.mark.parametrize("bits", [1, 3, 6, 8])
def test_equals_plain_version(spark, bits):
    rows = cloud(300, 5)
    assert found(spark, rows, dims=5, k=9, rounds=3, bits=bits) == plain(rows, 9, 3, 5)


def test_borders_from_a_tiny_sample_give_the_same_rows(spark):
    rows = cloud(300, 5)
    assert found(spark, rows, dims=5, k=9, rounds=3, sample_rows=2) == plain(rows, 9, 3, 5)


def test_left_out_repeated_and_tied_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [1.0, nan]), (4, [1.0, None]), (5, [inf, 0.0]), (6, [1.0, 2.0, 3.0]), (7, [2.0**40, 0.0])]
    rows = [(8, [0.5, 0.5]), (8, [0.5, 0.5]), (None, [0.25, -0.001]), (9, [-0.5, 0.5]), (10, [0.0, 0.0]), (11, [0.0, 0.0])] + [(i, [1.0, 1.0]) for i in range(20, 60)]
    for k in (2, 3, 40):
        assert found(spark, odd + rows, dims=2, k=k, rounds=2) == plain(rows, k, 2, 2)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(5, [1.0, 0.0]), (6, [0.0, 1.0])]
    assert found(spark, rows, dims=2) == plain(rows, 40, 5, 2)
    assert found(spark, [], dims=2) == [] and found(spark, [(1, None)], dims=2) == []


def test_intervals_hold_the_distances_and_spare_most_of_them(spark):
    rows = cloud(800, 16)
    file, cells, first = centroids.prepared(spark.createDataFrame(rows, SCHEMA), dims=16, k=12)
    held = file.collect()
    values = np.array([r["values"] for r in held], dtype=np.int64)
    lookup = centroids.Lookup(cells, np.array(first, dtype=np.int64))
    low, high = lookup.intervals(cells.of(values), (values**2).sum(axis=1))
    exact = ((values[:, None] - lookup.centroids) ** 2).sum(axis=2)
    assert (low <= exact).all() and (exact <= high).all() and (low < high).any()
    model = centroids.fit(file, cells, first, 3)
    assert all(total == 800 * 12 for _, total in model.measured) and all(part < 0.2 * total for part, total in model.measured)


def test_cells_survive_packing():
    for bits in (1, 3, 5, 8):
        cells = centroids.Cells(np.zeros((7, (1 << bits) - 1)), None, None, bits)
        some = np.random.default_rng(1).integers(0, 1 << bits, (9, 7)).astype(np.uint8)
        import pyarrow as pa

        assert (cells.unpack(pa.array(cells.pack(some), pa.binary())) == some).all()
