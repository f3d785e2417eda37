"""Exact threshold pairs of embeddings by dual traversal of cover trees.

Vectors take part if their label is not null and they are not null, empty or zero and hold no null, NaN or infinite
number; only vectors of one label (and length) are compared. Equal vectors are one class and never expanded into pairs.

Each label is a tree whose levels halve their radius. Above, Spark builds it: a cell of more than ``leaf_rows`` classes
picks centres that lie more than the level's radius apart and hands every member to its nearest centre, round by round,
until all cells fit; a hot label only gets more levels. Below, each cell holds its own tree as arrays, which a task
builds. The same bounds prune both: with covering radii r and s, the points below two nodes lie at least
d(centres) - r - s and at most d(centres) + r + s apart. Node pairs beyond the threshold are dropped, node pairs
entirely within it are counted without looking at their points, and what is left is compared in double precision.
A task returns link counts and a spanning set of links, so its output grows with its points and not with their pairs.

Repeated rows are vectors of their own. Vectors without an id link and count, but cannot name a component; their
``kept`` is false, and ``component_id`` is null where no linked vector has an id. Further columns are ignored; empty
tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import Shelf, components, stored, uniform

#: Bounds decide only beyond this margin; closer calls are left to the comparison of the points.
MARGIN = 1e-6
BUCKET = 24
CENTRES = 32
BLOCK = 256
#: Numbers of the vectors of one tile, 16 MB of them; cells are compared by pairs of tiles.
TILE = 1 << 21
NODE = "node string, parent string, label int, dim int, centre array<double>, radius double, leaf boolean"


def usable(label: Column, vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in the squares
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def net(points: np.ndarray, radius: float, most: int | None = None) -> tuple[np.ndarray, float]:
    """Indices of points more than ``radius`` apart that cover all others within it; at ``most`` so many. With fewer
    than two the radius is halved, as long as the points differ. Returns the radius used, too."""
    while True:
        picked, nearest = [0], _distances(points, points[:1])[:, 0]
        while nearest.max() > radius and (most is None or len(picked) < most):
            far = int(nearest.argmax())
            picked.append(far)
            nearest = np.minimum(nearest, _distances(points, points[far : far + 1])[:, 0])
        if len(picked) > 1 or nearest.max() < 1e-7:
            return np.array(picked), radius
        radius /= 2


class Tree:
    """A cover tree over unit vectors: node i holds the points order[start[i]:end[i]] within radius[i] of centre[i]."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.start, self.end, self.centre, self.radius, self.children = [], [], [], [], []
        self._grow(0, len(points), 2.0)

    def _grow(self, start: int, end: int, radius: float) -> int:
        own = self.order[start:end].copy()
        near = _distances(self.points[own], self.points[own[:1]])[:, 0]
        node = len(self.start)
        self.start.append(start)
        self.end.append(end)
        self.centre.append(own[0])
        self.radius.append(float(near.max()))
        self.children.append([])
        if end - start > BUCKET and near.max() > 1e-7:
            picked, radius = net(self.points[own], min(radius, float(near.max())) / 2)
            nearest = _distances(self.points[own], self.points[own[picked]]).argmin(axis=1)
            nearest[picked] = np.arange(len(picked))
            at = start
            for child in range(len(picked)):
                inside = own[nearest == child]
                inside = np.concatenate(([own[picked[child]]], inside[inside != own[picked[child]]]))
                self.order[at : at + len(inside)] = inside
                at += len(inside)
            sizes = np.bincount(nearest, minlength=len(picked))
            if len(picked) > 1:
                for child, size in enumerate(sizes):
                    first = start + int(sizes[:child].sum())
                    self.children[node].append(self._grow(first, first + int(size), radius))
        return node

    def below(self, node: int) -> np.ndarray:
        return self.order[self.start[node] : self.end[node]]


class Links:
    """Link counts of the points of two blocks and a spanning set of their links."""

    def __init__(self, weights_a: np.ndarray, weights_b: np.ndarray, same: bool):
        self.weights, self.same, self.offset = (weights_a, weights_b), same, 0 if same else len(weights_a)
        self.counts = np.zeros(len(weights_a) + (0 if same else len(weights_b)), dtype=np.int64)
        self.head = np.arange(len(self.counts))
        self.spanning: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        while self.head[x] != x:
            self.head[x] = self.head[self.head[x]]
            x = self.head[x]
        return x

    def _join(self, a: int, b: int) -> None:
        x, y = self._root(a), self._root(b)
        if x != y:
            self.head[max(x, y)] = min(x, y)
            self.spanning.append((a, b))

    def all_pairs(self, a: np.ndarray, b: np.ndarray, one_node: bool) -> None:
        """Every point of a with every point of b; with ``one_node`` both are one node, whose points link mutually."""
        wa, wb = self.weights[0][a], self.weights[1][b]
        self.counts[a] += wb.sum() - (wa if one_node else 0)
        if not one_node:
            self.counts[b + self.offset] += wa.sum()
        for x in a.tolist():
            self._join(x, int(b[0]) + self.offset)
        for y in b.tolist():
            self._join(int(a[0]), y + self.offset)

    def some_pairs(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray, one_node: bool) -> None:
        if one_node:
            linked = linked & ~np.eye(len(a), dtype=bool)
        self.counts[a] += linked @ self.weights[1][b]
        if not one_node:
            self.counts[b + self.offset] += linked.T @ self.weights[0][a]
        for x, y in _forest(linked):
            self._join(int(a[x]), int(b[y]) + self.offset)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that connect what all links of the matrix connect; fewer than it has rows and columns."""
    if np.count_nonzero(linked) <= sum(linked.shape):
        return list(zip(*(x.tolist() for x in np.nonzero(linked)), strict=True))
    out, fresh, seen = [], np.ones(linked.shape[1], dtype=bool), ~linked.any(axis=1)
    for first in range(len(linked)):
        stack = [] if seen[first] else [first]
        seen[first] = True
        while stack:
            x = stack.pop()
            met = np.flatnonzero(linked[x] & fresh)
            if not len(met):
                continue
            fresh[met] = False
            out += [(x, y) for y in met.tolist()]
            shared = linked[:, met]
            rows = np.flatnonzero(shared.any(axis=1) & ~seen)
            seen[rows] = True
            out += zip(rows.tolist(), met[shared[rows].argmax(axis=1)].tolist(), strict=True)
            stack += rows.tolist()
    return out


def traverse(left: Tree, right: Tree, weights_a: np.ndarray, weights_b: np.ndarray, threshold: float) -> Links:
    """Links at a cosine of ``threshold`` or more between two trees, or inside one if both are the same object."""
    same = left is right
    links, limit = Links(weights_a, weights_b, same), math.sqrt(max(2.0 - 2.0 * threshold, 0.0))
    stack = [(0, 0)]
    while stack:
        a, b = stack.pop()
        one = same and a == b
        below_a, below_b = left.children[a] or [a], right.children[b] or [b]
        if below_a == [a] and below_b == [b]:
            p, q = left.below(a), right.below(b)
            links.some_pairs(p, q, left.points[p] @ right.points[q].T >= threshold, one)
            continue
        ca, cb = np.array([left.centre[i] for i in below_a]), np.array([right.centre[i] for i in below_b])
        ra, rb = np.array([left.radius[i] for i in below_a]), np.array([right.radius[i] for i in below_b])
        apart, reach = _distances(left.points[ca], right.points[cb]), ra[:, None] + rb[None, :]
        open_pairs = apart - reach <= limit + MARGIN
        if one:
            open_pairs &= np.tri(len(below_a), dtype=bool).T  # each pair of children once
        # Children without children are compared as one block.
        ends_a, ends_b = (np.array([not tree.children[i] for i in below]) for tree, below in ((left, below_a), (right, below_b)))
        ends = open_pairs & ends_a[:, None] & ends_b[None, :]
        if ends.any():
            rows, columns = (np.flatnonzero(ends_a if one else ends.any(axis=axis)) for axis in (1, 0))
            p, q = (np.concatenate([tree.below(below[i]) for i in at]) for tree, below, at in ((left, below_a, rows), (right, below_b, columns)))
            links.some_pairs(p, q, left.points[p] @ right.points[q].T >= threshold, one)
            open_pairs &= ~ends
        for i, j in zip(*np.nonzero(open_pairs), strict=True):
            x, y = below_a[i], below_b[j]
            itself = same and x == y
            if (apart[i, j] + reach[i, j] if not itself else 2 * ra[i]) < limit - MARGIN:
                links.all_pairs(left.below(x), right.below(y), itself)
            else:
                stack.append((x, y))
    return links


def _classes(vectors: DataFrame) -> DataFrame:
    """(cid, label, dim, vector, n, rep): different usable vectors of a label with their number and smallest id."""
    good = vectors.where(usable(F.col("label"), F.col("vector")))
    grouped = good.groupBy("label", "vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("rep"))
    return stored(grouped.select(F.monotonically_increasing_id().alias("cid"), "label", F.size("vector").alias("dim"), "vector", "n", "rep"))


def _cells(classes: DataFrame, leaf_rows: int, shelf: Shelf) -> tuple[DataFrame, DataFrame]:
    """(points with their leaf ``node``, all nodes), both kept in ``shelf``: Spark's levels of the trees."""
    root = F.concat_ws("/", F.col("label").cast("string"), F.col("dim").cast("string"))
    points = classes.select("cid", "label", "dim", "vector", "n", root.alias("node"), F.lit(2.0).alias("radius"), F.lit(0.0).alias("away"))
    done, nodes, levels, columns = [], [], Shelf(classes.sparkSession), ("cid", "node", "vector", "n", "dim")

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cid")
        unit = _unit(np.array(part["vector"].tolist(), dtype=np.float64))
        most = int(min(CENTRES, 2 + 2 * part["count"].iloc[0] // leaf_rows))
        picked, radius = net(unit, part["radius"].iloc[0] / 2, most)
        if len(picked) == 1:
            picked = np.repeat(picked, most)
        return pd.DataFrame({"node": part["node"].iloc[0], "centres": [unit[picked].ravel().tolist()], "level": radius})

    def nearest(source):
        for batch in source:
            for block, centres, node, level, label, dim in zip(*(batch.column(c) for c in ("members", "centres", "node", "level", "label", "dim")), strict=True):
                values, dim = block.values, dim.as_py()
                cids = values.field("cid").to_numpy()
                gaps = _distances(_unit(_matrix(values.field("vector"), dim)), centres.values.to_numpy().reshape(-1, dim))
                # Equal centres share their points, so also one direction in many lengths is divided.
                ties = gaps <= gaps.min(axis=1, keepdims=True) + 1e-9
                turn = cids % ties.sum(axis=1) + 1
                chosen = (np.cumsum(ties, axis=1) == turn[:, None]).argmax(axis=1)
                columns = {
                    "cid": values.field("cid"), "label": pa.array([label.as_py()] * len(cids), pa.int32()), "dim": pa.array([dim] * len(cids), pa.int32()),
                    "vector": values.field("vector"), "n": values.field("n"), "node": pa.array([f"{node.as_py()}/{i}" for i in chosen.tolist()], pa.string()),
                    "radius": pa.array([level.as_py()] * len(cids), pa.float64()), "away": pa.array(gaps[np.arange(len(cids)), chosen]), "parent": pa.array([node.as_py()] * len(cids), pa.string()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    while True:
        large = stored(points.groupBy("node").count().where(F.col("count") > leaf_rows))
        if large.isEmpty():
            done.append(shelf.put(points.select(*columns)))
            break
        done.append(shelf.put(points.join(large, "node", "left_anti").select(*columns)))
        # About 8 candidates for every centre, two at least: a share of the cell that does not grow with it.
        drawn = points.join(large, "node").withColumn("place", uniform("cid")).where(F.col("place") * F.col("count") < 16 * CENTRES)
        centres = stored(drawn.groupBy("node").applyInPandas(pick, "node string, centres array<double>, level double"))
        fields = f"cid long, label int, dim int, vector {dict(points.dtypes)['vector']}, n long, node string, radius double, away double, parent string"
        # Blocks of members, so that the centres travel with each block and not with each member.
        part = F.pmod(F.xxhash64("cid"), F.ceil(F.col("count") / BLOCK))
        members = points.join(large, "node").groupBy("node", "label", "dim", part.alias("part")).agg(F.collect_list(F.struct("cid", "vector", "n")).alias("members"))
        moved = levels.put(members.join(centres, "node").select("members", "centres", "node", "level", "label", "dim").mapInArrow(nearest, fields))
        inner = moved.groupBy("node", "parent", "label", "dim").agg(F.max("away").alias("radius"), F.count("*").alias("count"))
        split = inner.join(centres.withColumnRenamed("node", "parent"), "parent").withColumn("at", F.element_at(F.split("node", "/"), -1).cast("int"))
        nodes.append(stored(split.select("node", "parent", "label", "dim", F.slice("centres", F.col("at") * F.col("dim") + 1, F.col("dim")).alias("centre"), "radius", (F.col("count") <= leaf_rows).alias("leaf"))))
        levels.clear(keep=1)
        points = moved.drop("parent")
    levels.clear()
    points = done[0]
    for part in done[1:]:
        points = points.unionByName(part)
    roots = classes.groupBy("label", "dim").agg(F.count("*").alias("count")).select(
        root.alias("node"), F.lit(None).cast("string").alias("parent"), "label", "dim", F.lit(None).cast("array<double>").alias("centre"), F.lit(2.0).alias("radius"), (F.col("count") <= leaf_rows).alias("leaf")
    )
    for part in nodes:
        roots = roots.unionByName(part)
    return points, shelf.put(roots)


def _leaf_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): leaf cells whose points may link; a <= b. Level by level, from the pairs that survived above."""
    limit = math.sqrt(max(2.0 - 2.0 * threshold, 0.0)) + MARGIN
    below = nodes.where("parent is not null")
    pairs, out = nodes.where("parent is null").select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("leaf").alias("leaf_a"), F.col("leaf").alias("leaf_b")), None
    shape = ("node", "centre", "radius", "leaf")
    stay = nodes.where("leaf").select(F.col("node").alias("parent"), *shape)
    steps = below.select("parent", *shape).unionByName(stay)
    while True:
        ready = pairs.where("leaf_a and leaf_b").select("a", "b")
        out = ready if out is None else out.unionByName(ready)
        pairs = pairs.where("not (leaf_a and leaf_b)")
        if pairs.isEmpty():
            return stored(out)
        left = steps.select(F.col("parent").alias("a"), *[F.col(c).alias(f"{c}_a") for c in shape])
        right = steps.select(F.col("parent").alias("b"), *[F.col(c).alias(f"{c}_b") for c in shape])
        wide = pairs.select("a", "b").join(left, "a").join(right, "b").where("a <> b or node_a <= node_b")
        square = F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        near = wide.where((F.col("node_a") == F.col("node_b")) | (F.sqrt(square) - F.col("radius_a") - F.col("radius_b") <= limit))
        pairs = stored(near.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), "leaf_a", "leaf_b").distinct())


def _tiles(leaves: DataFrame) -> DataFrame:
    """(node, tile): leaf cells of one tree, dealt to tiles of about ``TILE`` numbers."""
    sizes = stored(leaves.groupBy("node", "dim").agg(F.count("*").alias("rows")).withColumn("root", F.substring_index("node", "/", 2)))
    parts = sizes.groupBy("root").agg(F.ceil(F.sum(F.col("rows") * F.col("dim")) / TILE).alias("parts"))
    return stored(sizes.join(parts, "root").select("node", F.concat_ws(":", "root", F.pmod(F.xxhash64("node"), "parts").cast("string")).alias("tile")))


def _compare(leaves: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(cid, n_links, other): link counts with other = null, and spanning links with n_links = null.

    Pairs of cells are dealt by their pair of tiles, with one copy of each cell among them, whose tree is built once.
    """
    tiles = _tiles(leaves)
    placed = pairs.join(tiles.select(F.col("node").alias("a"), F.col("tile").alias("tile_a")), "a").join(tiles.select(F.col("node").alias("b"), F.col("tile").alias("tile_b")), "b")
    placed = stored(placed.select(F.least("tile_a", "tile_b").alias("s"), F.greatest("tile_a", "tile_b").alias("t"), "a", "b"))
    blocks = leaves.groupBy("node", "dim").agg(F.collect_list(F.struct("cid", "n", "vector")).alias("points"))  # leaf_rows at most
    cells = placed.select("s", "t", F.explode(F.array("a", "b")).alias("node")).distinct().join(blocks, "node")
    rows = cells.select("s", "t", F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), "dim", "points").unionByName(placed, allowMissingColumns=True)
    rows = rows.repartition("s", "t").sortWithinPartitions("s", "t", F.col("b").isNotNull(), "a", "b")

    def load(points, dim):
        values = points.values
        return values.field("cid").to_numpy(), values.field("n").to_numpy(), Tree(_unit(_matrix(values.field("vector"), dim)))

    def run(source):
        tile, held, counts, spanning = None, {}, {}, []

        def settled():
            """What the pairs of one pair of tiles have given."""
            hit = {node: np.flatnonzero(n) for node, n in counts.items()}
            points = [held[node][0][rows] for node, rows in hit.items()]
            links = [counts[node][rows] for node, rows in hit.items()]
            a, b = (np.concatenate([np.empty(0, dtype=np.int64), *(x[i] for x in spanning)]) for i in (0, 1))
            cids = np.concatenate([a, *points])
            n_links = pa.concat_arrays([pa.nulls(len(a), pa.int64()), *(pa.array(n, pa.int64()) for n in links)])
            return pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), n_links, pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(cids) - len(a), pa.int64())])], ["cid", "n_links", "other"])

        for batch in source:
            names, points = (batch.column(c).to_pylist() for c in ("s", "t", "a", "b", "dim")), batch.column("points")
            for row, (s, t, a, b, dim) in enumerate(zip(*names, strict=True)):
                if (s, t) != tile:
                    if counts:
                        yield settled()
                    tile, held, counts, spanning = (s, t), {}, {}, []
                if b is None:
                    held[a] = load(points[row], dim)
                    continue
                (cids_a, weights_a, left), (cids_b, weights_b, right) = held[a], held[b]
                found = traverse(left, right, weights_a, weights_b, threshold)
                counts[a] = counts.get(a, 0) + found.counts[: len(cids_a)]
                if a != b:
                    counts[b] = counts.get(b, 0) + found.counts[len(cids_a) :]
                if found.spanning:
                    cids = cids_a if a == b else np.concatenate([cids_a, cids_b])
                    spanning.append(cids[np.array(found.spanning).T])
        if counts:
            yield settled()

    return rows.mapInArrow(run, "cid long, n_links long, other long")


def near_copies(vectors: DataFrame, threshold: float = 0.93, leaf_rows: int = 2048, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept), one row per vector."""
    source = vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    classes = _classes(source)
    kept = Shelf(vectors.sparkSession)
    leaves, nodes = _cells(classes, leaf_rows, kept)
    pairs = _leaf_pairs(nodes, threshold)
    found = stored(_compare(leaves, pairs, threshold))
    kept.clear()
    counts = found.where("n_links is not null").groupBy("cid").agg(F.sum("n_links").alias("others"))
    joined = stored(components(found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")), kept.put))
    kept.clear()
    placed = classes.select("cid", "label", "vector", "n", "rep").join(joined.withColumnRenamed("id", "cid"), "cid", "left")
    placed = placed.withColumn("component", F.coalesce("component_id", "cid")).drop("component_id")
    names = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    classed = placed.join(names, "component").join(counts, "cid", "left")
    classed = classed.select("label", "vector", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    good = usable(F.col("label"), F.col("vector"))
    linked = source.where(good).join(classed, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = source.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("vec_id").alias(key), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
