"""Approximate nearest neighbours by cosine with cross-polytope hashing.

A table's hash turns a unit vector by three rounds of random signs and a Hadamard transform and takes the nearest signed
axis; ``hashes`` of them in a row make the bucket, one by default and two where buckets would hold more than about
``bucket_rows`` vectors. Every vector stands in one bucket of each of ``tables`` tables. A query looks into the
``probes`` buckets whose axes it is nearest to, in every table, and is compared exactly with all that they hold.

``probes`` is fitted: up to ``sample_queries`` queries are compared with all rows, and the number is the smallest with
which ``recall`` of their true neighbours lie in a probed bucket. It ends at all buckets, where the search is exact, so no
data can push the sample's recall below the target. Queries that find fewer than ``k`` although there are more rows are
looked up in all buckets of one table, which is every row.

Buckets are cut into chunks of about ``chunk_rows`` rows by hash and the queries of a bucket into blocks, so a bucket with
a third of all rows is many tasks, and neither rows nor queries of a bucket meet in one. A chunk returns at most ``k``
rows a query.

Vectors that are null, empty or zero or hold null, NaN or infinite components take no part; vectors of other lengths are
no candidates. Repeated rows are rows of their own: a query meets all rows but itself, also those with its id. Rows
without an id are no queries; as candidates they come last among ties. Equal vectors tie exactly. Further columns are
ignored, and an empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import stored

QUERIES = 256
#: Scores of the block product that lie this close to the k-th are computed anew, pair by pair.
MARGIN = 1e-9
_NO_ID = np.iinfo(np.int64).max


def usable(vector):
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows scaled by powers of two, which changes no digit, so that squares neither overflow nor vanish."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.ldexp(values, -np.frexp(np.abs(values).max(axis=1, keepdims=True, initial=0.0))[1])


def _norms(values: np.ndarray) -> np.ndarray:
    return np.sqrt((values * values).sum(axis=1))


def hadamard(values: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row, its length kept; rows are a power of two long."""
    n, width = values.shape
    half = 1
    while half < width:
        pairs = values.reshape(n, width // (2 * half), 2, half)
        values = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return values / np.sqrt(width)


class Hash:
    """One table's hash for vectors of one length."""

    def __init__(self, dim: int, table: int, hashes: int, seed: int):
        self.width, self.hashes = 1 << max(0, dim - 1).bit_length(), hashes
        self.signs = np.random.default_rng([seed, dim, table]).choice([-1.0, 1.0], (hashes, 3, self.width))

    def scores(self, values: np.ndarray) -> np.ndarray:
        """(hashes, rows, signed axes): product of every turned row with every signed axis."""
        padded = np.zeros((len(values), self.width))
        padded[:, : values.shape[1]] = values / _norms(values)[:, None]
        out = np.empty((self.hashes, len(values), 2 * self.width))
        for h, rounds in enumerate(self.signs):
            turned = padded
            for signs in rounds:
                turned = hadamard(turned * signs)
            out[h, :, 0::2], out[h, :, 1::2] = turned, -turned
        return out

    def buckets(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), dtype=np.int64)
        for best in self.scores(values).argmax(axis=2):
            out = out * 2 * self.width + best
        return out

    def ranked(self, values: np.ndarray) -> np.ndarray:
        """(rows, buckets): all buckets, nearest axes first."""
        scores = self.scores(values)
        total = scores[0]
        for more in scores[1:]:
            total = (total[:, :, None] + more[:, None, :]).reshape(len(values), -1)
        return np.argsort(-total, axis=1, kind="stable")


def _best(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, numbers: np.ndarray, ids: np.ndarray, k: int):
    """(query, row, score) of the k best rows of each query: highest cosine first, then smallest id, then row number."""
    norms, query_norms = _norms(rows), _norms(queries)
    rough = (queries @ rows.T) / (query_norms[:, None] * norms)
    rough[own[:, None] == numbers] = -np.inf
    least = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(queries), -np.inf)
    q, r = np.nonzero((rough >= least[:, None] - MARGIN) & (rough > -np.inf))
    score = np.empty(len(q))
    for at in range(0, len(q), 65536):
        part = slice(at, at + 65536)
        score[part] = (queries[q[part]] * rows[r[part]]).sum(axis=1) / (query_norms[q[part]] * norms[r[part]])
    order = np.lexsort((numbers[r], ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], r[place < k], score[place < k]


def index(vectors: DataFrame, tables: int, hashes: int, seed: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row, id, dim, vector, buckets): every row that takes part with its bucket in each table."""
    source = vectors.where(usable(F.col(vector))).select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.size(vector).alias("dim"), F.col(vector).alias("vector"))

    def run(source):
        known = {}
        for batch in source:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                values = _matrix(part.column("vector"), dim)
                if dim not in known:
                    known[dim] = [Hash(dim, t, hashes, seed) for t in range(tables)]
                buckets = np.stack([h.buckets(values) for h in known[dim]], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * tables), pa.array(buckets.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "buckets"])

    return stored(source.mapInArrow(run, f"row long, id long, dim int, vector {dict(vectors.dtypes)[vector]}, buckets array<bigint>"))


def fitted_probes(rows: DataFrame, queries: DataFrame, tables: int, hashes: int, seed: int, k: int, recall: float, sample_queries: int) -> int:
    """Buckets to probe in each table so that the sample's true neighbours are met with ``recall``."""
    sample = queries.select("row", "dim", "vector").orderBy(F.xxhash64("row")).limit(sample_queries).collect()  # bounded by the parameter
    by_dim = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append((r["row"], r["vector"]))

    def block(dim):
        lists = pa.array([v for _, v in by_dim[dim]], pa.list_(pa.float64()))
        return np.array([n for n, _ in by_dim[dim]], dtype=np.int64), _matrix(lists, dim)

    def run(source):
        for batch in source:
            dims = batch.column("dim").to_numpy()
            for dim in set(np.unique(dims).tolist()) & set(by_dim):
                part = batch.filter(pa.array(dims == dim))
                own, values = block(dim)
                q, r, score = _best(values, own, _matrix(part.column("vector"), dim), part.column("row").to_numpy(), _ids(part.column("id")), k)
                yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(score), *(part.column(c).take(pa.array(r)) for c in ("id", "row", "dim", "buckets"))], ["query", "score", "id", "row", "dim", "buckets"])

    found = rows.mapInArrow(run, "query long, score double, id long, row long, dim int, buckets array<bigint>")
    first = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    true = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query", "dim", "buckets").collect()  # k a query
    needed = []
    for dim in by_dim:
        own, values = block(dim)
        at = {n: i for i, n in enumerate(own.tolist())}
        mine = [(at[r["query"]], r["buckets"]) for r in true if r["dim"] == dim]
        if mine:
            least = np.full(len(mine), np.iinfo(np.int64).max)
            for t in range(tables):
                ranked = Hash(dim, t, hashes, seed).ranked(values)
                place = np.argsort(ranked, axis=1)
                least = np.minimum(least, [place[q, b[t]] for q, b in mine])
            needed += least.tolist()
    needed.sort()
    return needed[max(0, int(np.ceil(recall * len(needed))) - 1)] + 1 if needed else 1


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy()


def probed(queries: DataFrame, probes: int | None, tables: int, hashes: int, seed: int) -> DataFrame:
    """(table, bucket, dim, row, vector): the buckets each query looks into; all of one table without ``probes``."""

    def run(source):
        known = {}
        for batch in source:
            for at in range(0, batch.num_rows, QUERIES):
                some = batch.slice(at, QUERIES)
                dims = some.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    part = some.filter(pa.array(dims == dim))
                    values = _matrix(part.column("vector"), dim)
                    for table in range(tables if probes else 1):
                        if (dim, table) not in known:
                            known[dim, table] = Hash(dim, table, hashes, seed)
                        ranked = known[dim, table].ranked(values)[:, :probes]
                        again = pa.array(np.repeat(np.arange(len(part)), ranked.shape[1]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(ranked.size, table, dtype=np.int32)), pa.array(ranked.ravel()), *(part.column(c).take(again) for c in ("dim", "row"))], ["table", "bucket", "dim", "row"])

    return queries.mapInArrow(run, "table int, bucket long, dim int, row long")


def _compared(rows: DataFrame, looks: DataFrame, queries: DataFrame, k: int, chunk_rows: int) -> DataFrame:
    """(query, row, id, score): the best rows of every chunk that a query looks into."""
    bucket = ["dim", "table", "bucket"]
    places = rows.select("row", "id", "dim", "vector", F.posexplode("buckets").alias("table", "bucket"))
    sizes = places.groupBy(*bucket).count()
    chunk = F.pmod(F.xxhash64("row"), F.ceil(F.col("count") / chunk_rows)).alias("chunk")
    chunks = places.join(sizes, bucket).groupBy(*bucket, chunk).agg(F.collect_list(F.struct("row", "id", "vector")).alias("held"))
    asked = looks.groupBy(*bucket).count()
    part = F.pmod(F.xxhash64("row"), F.ceil(F.col("count") / QUERIES)).alias("part")
    looks = looks.join(asked, bucket).select("row", *bucket, part).join(queries.select("row", "vector"), "row")
    blocks = looks.groupBy(*bucket, "part").agg(F.collect_list(F.struct("row", "vector")).alias("asking"))
    met = blocks.join(chunks, bucket).select("dim", "asking", "held")

    def run(source):
        for batch in source:
            for dim, asking, held in zip(*(batch.column(c) for c in ("dim", "asking", "held")), strict=True):
                dim, asking, held = dim.as_py(), asking.values, held.values
                own = asking.field("row").to_numpy()
                numbers = held.field("row")
                q, r, score = _best(_matrix(asking.field("vector"), dim), own, _matrix(held.field("vector"), dim), numbers.to_numpy(), _ids(held.field("id")), k)
                yield pa.RecordBatch.from_arrays([pa.array(own[q]), numbers.take(pa.array(r)), held.field("id").take(pa.array(r)), pa.array(score)], ["query", "row", "id", "score"])

    found = met.mapInArrow(run, "query long, row long, id long, score double")
    return found.groupBy("query", "row").agg(F.first("id").alias("id"), F.first("score").alias("score"))  # met in several tables


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, tables: int = 4, hashes: int | None = None, recall: float = 0.96, sample_queries: int = 64,
            chunk_rows: int = 4096, bucket_rows: int = 1 << 16, seed: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by ``every``."""
    if hashes is None:
        dim = vectors.where(usable(F.col(vector))).agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("dim")).first()
        hashes = 2 if dim["n"] > bucket_rows * 4 * (dim["dim"] or 1) else 1
    rows = index(vectors, tables, hashes, seed, key, vector)
    queries = rows.where(F.col("id") % every == 0).select("row", "id", "dim", "vector")
    probes = fitted_probes(rows, queries, tables, hashes, seed, k, recall, sample_queries)
    found = stored(_compared(rows, probed(queries, probes, tables, hashes, seed), queries, k, chunk_rows))
    there = rows.groupBy("dim").agg((F.count("*") - 1).alias("others"))
    short = queries.join(found.groupBy("query").count().withColumnRenamed("query", "row"), "row", "left").join(there, "dim")
    short = stored(short.where(F.coalesce("count", F.lit(0)) < F.least(F.lit(k), "others")).select("row", "id", "dim", "vector"))
    if not short.isEmpty():
        whole = _compared(rows, probed(short, None, tables, hashes, seed), short, k, chunk_rows)
        found = found.join(short.select(F.col("row").alias("query")), "query", "left_anti").unionByName(whole)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = best.join(queries.select(F.col("row").alias("query"), F.col("id").alias("query_id")), "query")
    return named.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
