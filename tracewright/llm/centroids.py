"""Centroid clustering in whole numbers over a vector-approximation file.

Kept are the vectors of exactly ``dims`` components, none of them null or not finite; every component x becomes
floor(``scale`` x). The approximation file holds for each vector a few bits (``bits``) per dimension, the number of the
cell its component lies in, and the exact square of its length. Per round, lookup tables (cell, centroid) give the least
and the most that a dimension can add to the product of vector and centroid, hence an interval of the squared distance to
every centroid. A centroid is out where its interval lies above the end of another one. A vector left with one centroid is
assigned by its cells alone; only where intervals overlap is the full vector fetched, and measured against just the
centroids that are left. All sums are whole, so bounds need no margin and ties go to the smaller number.

Cell borders come from quantiles of a sample of about ``sample_rows`` vectors and the true least and largest component of
all vectors; any borders give the same results. A round is one pass over the file without a shuffle of vectors: a task
adds up its vectors per centroid, and at most ``k`` rows a task leave it. Only the k centroids pass through the driver.
Cells and vector of a row stay side by side: the update adds up every vector once a round in any case, and fetching by
join would shuffle more than it spares.

Vectors with a component of 2^19 or more (with ``scale`` 256) take no part, because squared distances would not fit a
long. Rows without an id take part and can start a centroid under the hash of the empty id; equal hashes are told apart by
the vector. Repeated rows count as often as they stand there. With fewer than ``k`` kept vectors each starts a centroid.
Sums of distances beyond a long are null. Further columns are ignored, and empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import stored

LARGEST = 1 << 27
#: Rows that are looked up at once, so that the tables of bounds stay in cache.
ROWS = 2048
_PARTIAL = "cluster int, n long, measured long, sums array<bigint>"


class Model(NamedTuple):
    centroids: list[list[int]]
    #: Per round: distances computed on full vectors, and distances there are.
    measured: list[tuple[int, int]]


class Cells(NamedTuple):
    """Borders of the cells: ``cuts`` (dims, cells - 1), and the ``least`` and ``most`` component of each cell (dims, cells)."""

    cuts: np.ndarray
    least: np.ndarray
    most: np.ndarray
    bits: int

    def of(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cut, values[:, j], side="right") for j, cut in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def pack(self, cells: np.ndarray) -> list[bytes]:
        wide = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return [x.tobytes() for x in np.packbits(wide.reshape(len(cells), -1), axis=1)]

    def unpack(self, packed: pa.Array) -> np.ndarray:
        dims = len(self.cuts)
        size = -(-dims * self.bits // 8)
        data = np.frombuffer(b"".join(packed.to_pylist()), dtype=np.uint8).reshape(-1, size)
        wide = np.unpackbits(data, axis=1)[:, : dims * self.bits].reshape(len(data), dims, self.bits)
        return (wide @ (1 << np.arange(self.bits)[::-1]).astype(np.uint8)).astype(np.intp)


def whole(vector: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of every component; null for vectors that take no part."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LARGEST))
    usable = vector.isNotNull() & (F.size(vector) == dims) & fits
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def _first_centroids(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The vectors with the smallest hash of ``seed`` and id; k rows, whatever the table holds."""
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r["values"]) for r in vectors.select(hashed.alias("hash"), "values").orderBy("hash", "values").limit(k).collect()]


def _cells(vectors: DataFrame, dims: int, bits: int, sample_rows: int) -> Cells | None:
    ends = vectors.agg(F.count("*").alias("n"), *[f(F.get("values", F.lit(j))).alias(f"{name}{j}") for name, f in (("least", F.min), ("most", F.max)) for j in range(dims)]).first()
    if not ends["n"]:
        return None
    drawn = vectors.sample(min(1.0, sample_rows / ends["n"]), seed=11).limit(2 * sample_rows).select("values").toPandas()["values"]
    sample = np.array(drawn.tolist() or [[0] * dims], dtype=np.int64).reshape(-1, dims)
    number = 1 << bits
    cuts = np.quantile(sample, np.arange(1, number) / number, axis=0, method="higher").T.astype(np.int64)
    low, high = (np.array([[ends[f"{name}{j}"]] for j in range(dims)], dtype=np.int64) for name in ("least", "most"))
    # An empty cell may have its ends in the wrong order; no vector looks it up.
    return Cells(cuts, np.hstack([low, np.maximum(cuts, low)]), np.hstack([np.minimum(cuts - 1, high), high]), bits)


def _approximated(vectors: DataFrame, cells: Cells) -> DataFrame:
    """(id, values, cells, square): the approximation file beside the vectors."""

    def run(source):
        for batch in source:
            if batch.num_rows:
                values = _matrix(batch.column("values"), len(cells.cuts))
                columns = [batch.column("id"), batch.column("values"), pa.array(cells.pack(cells.of(values)), pa.binary()), pa.array((values**2).sum(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "values", "cells", "square"])

    return stored(vectors.mapInArrow(run, f"id {dict(vectors.dtypes)['id']}, values array<int>, cells binary, square long"))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy().astype(np.int64).reshape(-1, dims)


class Lookup:
    """For every dimension, cell and centroid the least and the most that the product of the two can add."""

    def __init__(self, cells: Cells, centroids: np.ndarray):
        ends = cells.least[:, :, None] * centroids.T[:, None, :], cells.most[:, :, None] * centroids.T[:, None, :]
        self.least, self.most = np.minimum(*ends), np.maximum(*ends)
        self.centroids, self.squares = centroids, (centroids**2).sum(axis=1)

    def intervals(self, cells: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, centroids): bounds of the squared distances."""
        low, high = np.zeros((2, len(cells), len(self.centroids)), dtype=np.int64)
        for j in range(cells.shape[1]):
            low += self.least[j][cells[:, j]]
            high += self.most[j][cells[:, j]]
        both = square[:, None] + self.squares
        return both - 2 * high, both - 2 * low

    def nearest(self, cells: np.ndarray, square: np.ndarray, fetch) -> tuple[np.ndarray, int]:
        """Number of the nearest centroid per row, and how many distances were measured; ``fetch`` gives rows' vectors."""
        out, measured = np.empty(len(cells), dtype=np.int64), 0
        for at in range(0, len(cells), ROWS):
            low, high = self.intervals(cells[at : at + ROWS], square[at : at + ROWS])
            left = low <= high.min(axis=1, keepdims=True)
            out[at : at + ROWS] = left.argmax(axis=1)
            unclear = np.flatnonzero(left.sum(axis=1) > 1)
            if len(unclear):
                row, centroid = np.nonzero(left[unclear])
                exact = np.full((len(unclear), left.shape[1]), np.iinfo(np.int64).max)
                exact[row, centroid] = ((fetch(at + unclear)[row] - self.centroids[centroid]) ** 2).sum(axis=1)
                out[at + unclear] = exact.argmin(axis=1)  # the first of equal ones
                measured += len(row)
        return out, measured


def _update(file: DataFrame, cells: Cells, centroids: list[list[int]]) -> tuple[list[list[int]], tuple[int, int]]:
    dims = len(cells.cuts)

    def run(source):
        lookup = Lookup(cells, np.array(centroids, dtype=np.int64))
        sums, counts, measured = np.zeros((len(centroids), dims), dtype=np.int64), np.zeros(len(centroids), dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)
        for batch in source:
            if batch.num_rows:
                values = _matrix(batch.column("values"), dims)
                cluster, exact = lookup.nearest(cells.unpack(batch.column("cells")), batch.column("square").to_numpy(), values.__getitem__)
                order = np.argsort(cluster, kind="stable")
                found, starts = np.unique(cluster[order], return_index=True)
                sums[found] += np.add.reduceat(values[order], starts)
                counts += np.bincount(cluster, minlength=len(counts))
                measured[0] += exact
        rows = [pa.array(np.arange(len(counts), dtype=np.int32)), pa.array(counts), pa.array(measured), pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * dims), pa.array(sums.ravel()))]
        yield pa.RecordBatch.from_arrays(rows, ["cluster", "n", "measured", "sums"])

    parts = file.select("values", "cells", "square").mapInArrow(run, _PARTIAL)
    columns = [F.sum(F.get("sums", F.lit(j)).cast("decimal(38,0)")).alias(f"s{j}") for j in range(dims)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("measured").alias("measured"), *columns).collect()  # k rows
    out = [list(c) for c in centroids]
    for r in rows:
        if r["n"]:
            out[r["cluster"]] = [int(r[f"s{j}"]) // r["n"] for j in range(dims)]
    return out, (sum(r["measured"] for r in rows), sum(r["n"] for r in rows) * len(centroids))


def fit(file: DataFrame, cells: Cells, centroids: list[list[int]], rounds: int) -> Model:
    """Centroids after ``rounds`` of assigning and averaging; empty ones stay."""
    measured = []
    for _ in range(rounds):
        centroids, exact = _update(file, cells, centroids)
        measured.append(exact)
    return Model(centroids, measured)


def assign(file: DataFrame, cells: Cells, centroids: list[list[int]]) -> DataFrame:
    """(id, cluster, distance): nearest centroid and the squared distance to it."""

    def run(source):
        lookup = Lookup(cells, np.array(centroids, dtype=np.int64))
        for batch in source:
            if batch.num_rows:
                values = _matrix(batch.column("values"), len(cells.cuts))
                cluster, _ = lookup.nearest(cells.unpack(batch.column("cells")), batch.column("square").to_numpy(), values.__getitem__)
                distance = ((values - lookup.centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return file.mapInArrow(run, f"id {dict(file.dtypes)['id']}, cluster int, distance long")


def prepared(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 40, scale: int = 256, seed: str = "2:", bits: int = 6, sample_rows: int = 4096):
    """(approximation file, cells, first centroids), or None without any vector that takes part."""
    source = vectors.select(F.col(key).alias("id"), whole(F.col(vector), dims, scale).alias("values")).where("values is not null")
    cells = _cells(source, dims, bits, sample_rows)
    if cells is None:
        return None
    file = _approximated(source, cells)
    return file, cells, _first_centroids(file, k, seed)


def clusters(vectors: DataFrame, key: str = "vec_id", rounds: int = 5, **options) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per vector that takes part."""
    id_type = dict(vectors.dtypes)[key]
    ready = prepared(vectors, key, **options)
    if ready is None:
        return vectors.sparkSession.createDataFrame([], f"{key} {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    file, cells, first = ready
    model = fit(file, cells, first, rounds)
    placed = stored(assign(file, cells, model.centroids))
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    total = sum(int(r["s"]) for r in sums)
    fit_long = lambda x: x if x < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(r["cluster"], fit_long(int(r["s"])), fit_long(total), digest(model.centroids[r["cluster"]])) for r in sums]
    named = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # k rows at most, so a broadcast is safe at any size of the table.
    return placed.join(F.broadcast(named), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
