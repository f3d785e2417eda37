"""Sharding by extendible hashing, with DataFrame operations only.

A row's hash is read bit by bit from the left. A bucket is a prefix of bits; the directory holds the shortest prefixes
whose rows together fit ``limit`` bytes, so only oversized buckets are split on another bit. Sums are taken once at a
depth at which nearly all buckets must fit (two bits below the average), then folded upwards bit by bit; rows of
buckets that are still too large there go on alone, deeper. Sums are combined before each shuffle, and rows meet
the directory by a join on their own prefix; no bucket is collected, and the driver sees only two totals.

Rows whose bits are used up (equal keys, also null keys) are told apart by their stored row number, so a key that holds
a third of all rows is spread over as many shards as it needs. A single row over the limit is a shard of its own. Sizes
are the bytes of the text; null counts as nothing. Empty tables give no rows. Columns of the same name are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import free_name, stored

#: Bits of a key's hash; as many further bits come from the hash of the row number.
KEY_BITS = 60


def key_bits(key: str | Column) -> Column:
    """60 bits of the MD5 of the key's text, as a string of 0 and 1."""
    digits = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.lpad(F.conv(digits, 16, 2), KEY_BITS, "0")


def _next_depth(depth: int, start: int) -> int:
    """Eight bits on, then all bits of the key, then as many bits of the row number as at first, then eight on."""
    if depth < KEY_BITS:
        return min(KEY_BITS, depth + 8) if depth == start else KEY_BITS
    return min(2 * KEY_BITS, KEY_BITS + start if depth == KEY_BITS else depth + 8)


def _directory(rows: DataFrame, depth: int, below: int, limit: int) -> DataFrame:
    """(cell, shard, shard_bytes, shard_rows) for the cells at ``depth``; shard is null where the cell is too large."""
    cells = rows.groupBy(F.substring("bits", 1, depth).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
    cells = stored(cells)
    # Every cell adds to the buckets above it; the largest one that fits is its shard.
    above = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(below), F.lit(depth))).alias("at"))
    buckets = above.groupBy(F.substring("cell", F.lit(1), F.col("at")).alias("bucket")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    fits = buckets.where((F.col("bytes") <= limit) | (F.col("n") == 1) | (F.length("bucket") == 2 * KEY_BITS))
    choices = cells.select("cell", F.explode(F.sequence(F.lit(below), F.lit(depth))).alias("at")).withColumn("bucket", F.substring("cell", F.lit(1), F.col("at")))
    chosen = choices.join(fits, "bucket").groupBy("cell").agg(F.min(F.struct("at", "bucket", "bytes", "n")).alias("best"))
    return cells.select("cell").join(chosen, "cell", "left").select(
        "cell", F.col("best.bucket").alias("shard"), F.col("best.bytes").alias("shard_bytes"), F.col("best.n").alias("shard_rows")
    )


def assign(docs: DataFrame, key: str = "doc_id", limit: int = 128 << 20) -> DataFrame:
    """(key, n_bytes, shard, depth, shard_bytes, shard_rows), one row per row; ``shard`` is the prefix, "" for the root."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return _named(_placed(stored(rows.withColumn("row", F.monotonically_increasing_id())), limit), key)


def _placed(rows: DataFrame, limit: int) -> DataFrame:
    """(key, n_bytes, row, shard, shard_bytes, shard_rows) for stored rows of (key, n_bytes, row)."""
    rows = rows.select("key", "n_bytes", "row", F.concat(key_bits("key"), key_bits("row")).alias("bits"))
    total, number = rows.agg(F.sum("n_bytes"), F.count("*")).first()
    if not number:
        return rows.select("key", "n_bytes", "row", F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_rows"))
    start = min(KEY_BITS, 2 + max(0, math.ceil(math.log2(max(1, total / limit)))))
    below, depth, out = 0, start, None
    while True:
        directory = stored(_directory(rows, depth, below, limit))
        found = rows.withColumn("cell", F.substring("bits", 1, depth)).join(directory, "cell")
        done = found.where("shard is not null").select("key", "n_bytes", "row", "shard", "shard_bytes", "shard_rows")
        out = done if out is None else out.unionByName(done)
        if directory.where("shard is null").isEmpty():
            return out
        rows = stored(found.where("shard is null").select("key", "n_bytes", "row", "bits"))
        below, depth = depth + 1, _next_depth(depth, start)


def _named(found: DataFrame, key: str) -> DataFrame:
    return found.select(F.col("key").alias(key), "n_bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_rows")


def write(docs: DataFrame, path: str, key: str = "doc_id", limit: int = 128 << 20) -> DataFrame:
    """Writes whole documents as Parquet, a folder ``shard=<prefix>`` each, and returns (shard, shard_bytes, shard_rows).

    The prefix is written with a leading ``r``, for the root. Documents find their shard by the bits of key and row
    number, as in ``assign``; a shard is written by one task, which its limit bounds, except for a single larger document.
    The columns of the documents stay as they are.
    """
    shard, row, text_bytes = (free_name(docs, name) for name in ("shard", "row", "n_bytes"))
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    # The same numbers as in the stored rows: keys are told apart by them.
    placed = _placed(rows.select(F.col(key).alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col(row).alias("row")), limit)
    found = rows.join(placed.select(F.col("row").alias(row), F.concat(F.lit("r"), F.col("shard")).alias(shard)), row)
    found.drop(row).repartition(shard).write.partitionBy(shard).parquet(path)
    return placed.groupBy("shard").agg(F.min("shard_bytes").alias("shard_bytes"), F.min("shard_rows").alias("shard_rows"))
