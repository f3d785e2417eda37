import math

import numpy as np
import pytest

from tracewright.llm import embeddings
from tracewright.llm.common import Shelf

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, threshold=0.93):
    good = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    head, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows):
            if i < j and la is not None and la == lb and good(a) and good(b) and len(a) == len(b):
                x, y = np.array(a, dtype=np.float32).astype(float), np.array(b, dtype=np.float32).astype(float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    head[max(root(i), root(j))] = min(root(i), root(j))
    return sorted((r[0], links[i], rows[root(i)][0]) for i, r in enumerate(rows))


def clouds(seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, 8))
    points = centre[rng.integers(0, 12, 220)] + rng.normal(size=(220, 8)) * rng.choice([0.02, 0.1, 0.4], (220, 1))
    points = np.concatenate([points, rng.normal(size=(40, 8)), points[:15], np.outer(np.arange(1, 41), centre[0])]).astype(np.float32)
    labels = [int(x) for x in rng.integers(0, 2, len(points))]
    return [(i, p.tolist(), la) for i, (p, la) in enumerate(zip(points, labels, strict=True))]


@pytest.mark.parametrize("leaf_rows", [2048, 40])
def test_equals_plain_version(spark, leaf_rows):
    rows = clouds()
    found = embeddings.near_copies(spark.createDataFrame(rows, SCHEMA), leaf_rows=leaf_rows).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == plain(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_unusable_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, nan], 1), (4, [1.0, None], 1), (5, [1.0, 1.0], None), (6, [1.0, 1.0], 1), (7, [2.0, 2.0], 1), (8, [], 1), (9, [1.0, 1.0, 1.0], 1), (10, [inf, 1.0], 1), (11, [1.0, 1.0], 2)]
    found = embeddings.near_copies(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cid", "2 AS node")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(i, int(i in (6, 7)), 6 if i == 7 else i) for i in range(1, 12)]


def test_repeated_and_missing_ids_and_no_rows(spark):
    rows = [(6, [1.0, 1.0], 1), (6, [1.0, 1.0], 1), (None, [1.0, 1.01], 1)]
    found = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embeddings.near_copies(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == [("6", 2, 6, True), ("6", 2, 6, True), ("None", 2, 6, False)]
    assert embeddings.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_covers_its_points():
    points = embeddings._unit(np.random.default_rng(3).normal(size=(300, 5)))
    tree = embeddings.Tree(points)
    for node in range(len(tree.start)):
        below = tree.below(node)
        assert embeddings._distances(points[below], points[tree.centre[node] : tree.centre[node] + 1]).max() <= tree.radius[node] + 1e-9
        assert not tree.children[node] or sorted(below) == sorted(x for c in tree.children[node] for x in tree.below(c))


def test_size_guess_does_not_grow_with_the_levels(spark, monkeypatch):
    """Each level halves its radius, and the planner's guess of a table's bytes was raised to a power at each of them."""
    rng = np.random.default_rng(5)
    near = np.eye(8)[0] + 0.5 ** np.arange(1, 12).repeat(4)[:, None] * rng.normal(size=(44, 8))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(near)]
    digits, kept = [], embeddings.stored

    def watched(df):
        digits.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        assert digits[-1] < 2000
        return kept(df)

    monkeypatch.setattr(embeddings, "stored", watched)
    found = embeddings.near_copies(spark.createDataFrame(rows, SCHEMA), leaf_rows=4).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == plain(rows)
    assert len(digits) > 12


def test_shelf_keeps_tables_until_cleared(spark):
    shelf = Shelf(spark)
    first, second = shelf.put(spark.range(3)), shelf.put(spark.range(0))
    assert (first.count(), second.count(), second.dtypes) == (3, 0, [("id", "bigint")])
    shelf.clear(keep=1)
    assert len(shelf.paths) == 1 and second.count() == 0
    shelf.clear()
    assert shelf.paths == []


def test_tiles_of_few_cells_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 8 * 60)
    rows = clouds(4)
    found = embeddings.near_copies(spark.createDataFrame(rows, SCHEMA), leaf_rows=20).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == plain(rows)


@pytest.mark.parametrize("noise", [0.01, 0.1, 0.3])
def test_traversal_equals_all_pairs(noise):
    """Whole, partly and hardly linked clouds, as one tree and as two; spanning links connect what links connect."""
    rng = np.random.default_rng(9)
    points = embeddings._unit(np.eye(16)[rng.integers(0, 3, 400)] + noise * rng.normal(size=(400, 16)))
    weights = rng.integers(1, 4, 400)
    for cut in (400, 150):
        a, b = embeddings.Tree(points[:cut]), embeddings.Tree(points[cut:]) if cut < 400 else None
        found = embeddings.traverse(a, b or a, weights[:cut], weights[cut:] if b else weights, 0.93)
        linked = points @ points.T >= 0.93
        np.fill_diagonal(linked, False)
        if b:
            linked[:cut, :cut] = linked[cut:, cut:] = False
        assert found.counts.tolist() == (linked @ weights).tolist()
        assert all(linked[x, y] for x, y in found.spanning)
        group = np.arange(400)
        while (least := np.minimum(group, np.where(linked, group, 400).min(axis=1))).tolist() != group.tolist():
            group = least
        assert len(found.spanning) == 400 - len(set(group.tolist()))
