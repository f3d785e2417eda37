"""Helpers that the corpus operators share: tables, stored steps, connected components, hashed words."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.session import cut_lineage as stored
from tracewright.session import shared_folder, ship_package

__all__ = ["Shelf", "arrays", "components", "crc_remainder", "free_name", "packed", "read", "running_hash", "shared_folder", "span_hashes", "stored", "text_blocks", "uniform"]

#: Texts are handled in blocks of about this many characters, so that numpy works on cache-sized arrays.
BLOCK_CHARS = 1 << 19
#: Values that a partition of a packed table holds, 8 MB of long numbers.
PACKED = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_remainder(column: str | Column, modulus: int) -> Column:
    """crc32 of the column's text, modulo ``modulus``; null for null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary")) % modulus


def uniform(column: str | Column) -> Column:
    """A repeatable number in [0, 1) from the column's value."""
    column = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.xxhash64(column, F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)


def packed(df: DataFrame, values: int | Column = 1) -> DataFrame:
    """A stored table in as many partitions as its ``values`` (a row's number of them) ask for.

    Small tables then feed exchanges from few tasks, and what fits into one partition needs no exchange to be joined.
    """
    df = stored(df)
    total = df.agg(F.sum(values if isinstance(values, Column) else F.lit(values))).first()[0] or 0
    return df.coalesce(max(1, -(-total // PACKED)))


class Shelf:
    """Tables kept as files of the shared folder, for loops whose rounds join what the round before has made.

    The planner takes the product of both sides as the size of a join, and a checkpoint keeps that guess. Round by round
    it is raised to a power, until its digits alone fill the driver. The size of files is read anew.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, posixpath.join(shared_folder(spark), f"shelf-{uuid.uuid4().hex}"), []

    def put(self, df: DataFrame) -> DataFrame:
        path = posixpath.join(self.folder, uuid.uuid4().hex)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, keep: int = 0) -> None:
        """Frees the disk of all tables but the ``keep`` put last; nothing may read them any more."""
        gone, self.paths = self.paths[: len(self.paths) - keep], self.paths[len(self.paths) - keep :]
        for path in gone:
            self.spark.range(0).write.mode("overwrite").parquet(path)


def components(edges: DataFrame, store: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """(id, component_id) for every id in ``edges`` (a, b: long): the smallest id that its links reach.

    Alternates two steps until nothing changes: every id hands its smallest neighbour to its larger neighbours, then
    links its smaller neighbours to the smallest of them. The number of rounds grows with the logarithm of the longest
    path. Minima are combined before the shuffle, and the joins are plain equi-joins that adaptive execution can split
    at a hot id; no group is collected. Empty edges give an empty result. ``store`` keeps the links of a round.
    """
    links = store(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = store(small.where("u <> v").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionAll(roots)


def text_blocks(texts: list[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive rows with about ``limit`` characters together; null counts as empty."""
    start, held, size = 0, [], 0
    for row, text in enumerate(texts):
        held.append(text or "")
        size += len(held[-1])
        if size >= limit:
            yield start, held
            start, held, size = row + 1, [], 0
    if held:
        yield start, held


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        size = max(n, 2 * BLOCK_CHARS)
        grown = np.full(size, base, dtype=np.uint64)
        grown[0] = 1
        known = _powers[name] = np.cumprod(grown, dtype=np.uint64)
    return known


def running_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of ``codes`` times rising powers; ``span_hashes`` turns two of them into the hash of a span."""
    out = np.empty(len(codes) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(codes))[: len(codes)], out=out[1:])
    return out


def span_hashes(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span, equal for equal code sequences wherever they stand."""
    down = _power("down", _INVERSE, len(running))
    mixed = (running[end] - running[start]) * down[start]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29))


def arrays(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of ``lengths``, one after the other."""
    total = int(lengths.sum())
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.arange(total) - starts
